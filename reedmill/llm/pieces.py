"""Problem 7: oversized items are cut into overlapping pieces at natural boundaries.

Method: pointer doubling.  Every position of every item is joined to its farthest legal successor (the last line end
beyond half the limit, else the last sentence end, else the last blank, else the limit itself, but never between a
letter and its mark) given that the piece after a cut starts ``overlap`` units before it; squaring the successor table of a whole batch then yields the
greedy cuts of all its items in a logarithmic number of gathers.

Units are characters, or tokens (runs of characters that are not Unicode white space).  Pieces never exceed the
limit, neighbours share exactly ``overlap`` units, and the pieces without their overlaps are the item again.  A
null or empty item has no piece, an item within the limit has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.llm.codepoints import SIZE, decode, slices, tables

WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
IS_WHITE = np.zeros(SIZE, bool)
IS_WHITE[WHITE] = True
IS_LINE = np.zeros(SIZE, bool)
IS_LINE[[10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = True
IS_STOP = np.zeros(SIZE, bool)
IS_STOP[[ord(c) for c in ".!?…。！？"]] = True
IS_CLOSE = np.zeros(SIZE, bool)
IS_CLOSE[[ord(c) for c in "\"'”’»)]"]] = True
TOKEN = r"[^\p{IsWhite_Space}]+"


def last_true(flags: np.ndarray) -> np.ndarray:
    """Index of the last true flag at or before each index, -1 where there is none."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def sentence_ends(cps: np.ndarray) -> np.ndarray:
    """For each character, whether it is blank and stands directly behind a sentence or ends a line."""
    white = IS_WHITE[cps]
    before = np.maximum(last_true(~white), 0)
    one = np.maximum(before - 1, 0)
    stop = IS_STOP[cps[before]] | IS_CLOSE[cps[before]] & IS_STOP[cps[one]]
    return white & stop | IS_LINE[cps]


def successors(n: int, ranks: list[np.ndarray], legal: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each cut 0..n of an item the farthest legal next cut, at a boundary of the first rank that has one beyond half the limit.

    ranks are positions; legal tells of each cut whether it may be made and a piece may start ``overlap`` before it.
    """
    cut = np.arange(n + 1)
    start = np.maximum(cut - overlap, 0)
    most = np.minimum(start + limit, n)
    least = np.maximum(cut, start + limit // 2)
    out = np.where(most == n, n, -1)
    for at in [*ranks, cut]:
        flags = np.zeros(n + 1, bool)
        flags[at] = True
        last = last_true(flags & legal)[most]
        out = np.where((out < 0) & (last > least), last, out)
    return np.where(out < 0, most, out)


def reachable(jump: np.ndarray, roots: np.ndarray, steps: int) -> np.ndarray:
    """Nodes on the paths from the roots: in round k a node marks its successor of order 2**k."""
    seen = np.zeros(len(jump), bool)
    seen[roots] = True
    for _ in range(max(1, int(steps).bit_length())):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen


def cuts(part: pa.Array, unit: str, limit: int, overlap: int) -> tuple[np.ndarray, ...]:
    """Of one slice of texts: item index, piece number, start and end in characters, and size in units."""
    cps, offsets = decode(part)
    blank = sentence_ends(cps) if len(cps) else np.zeros(0, bool)
    white, line = IS_WHITE[cps], IS_LINE[cps]
    marks = tables().ccc[cps] > 0
    jumps, roots, nodes, chars = [], [], [0], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        w, good = white[a:b], blank[a:b]
        if unit == "tokens":
            first = ~w
            first[1:] &= w[:-1]
            at = np.flatnonzero(first)  # the first character of each token
            n = len(at)
            total = np.concatenate(([0], np.cumsum(good)))
            lined = np.concatenate(([0], np.cumsum(line[a:b])))
            ranks = [np.flatnonzero(x[at[1:]] > x[at[:-1]]) + 1 if n else at for x in (lined, total)]
            legal = np.ones(n + 1, bool)
            place = np.concatenate((at, [b - a]))
            place[0] = 0
        else:
            n = int(b - a)
            after = np.zeros(n, bool)
            after[:-1] = w[:-1] & ~w[1:]
            ended, lined = (np.zeros(n, bool) for _ in range(2))
            ended[:-1] = good[:-1] & ~w[1:]
            lined[:-1] = line[a:b][:-1] & ~w[1:]
            ranks = [np.flatnonzero(x) + 1 for x in (lined, ended, after)]
            legal = np.ones(n + 1, bool)
            if n and marks[a:b].any():  # no piece begins or ends between a letter and its mark
                legal[:-1] = ~marks[a:b]
                legal &= legal[np.maximum(np.arange(n + 1) - overlap, 0)]
            place = np.arange(n + 1)
        roots.append(nodes[-1])
        jumps.append(successors(n, ranks, legal, limit, overlap) + nodes[-1])
        chars.append(place)
        nodes.append(nodes[-1] + n + 1)
    if not jumps:
        return (np.zeros(0, np.int64),) * 5
    root, place = np.array(roots), np.concatenate(chars)
    longest = int(np.diff(nodes).max())
    seen = np.flatnonzero(reachable(np.concatenate(jumps), root, longest // max(1, limit // 2 - overlap, limit - overlap - limit // 2) + 2))
    item = np.searchsorted(root, seen, "right") - 1
    ends = seen[seen != root[item]]
    item = np.searchsorted(root, ends, "right") - 1
    new = np.ones(len(ends), bool)
    new[1:] = item[1:] != item[:-1]
    number = np.arange(len(ends)) - np.maximum.accumulate(np.where(new, np.arange(len(ends)), 0))
    before = np.concatenate(([0], ends[:-1]))
    starts = np.where(new, root[item], np.maximum(before - overlap, root[item]))
    return item, number, place[starts], place[ends], ends - starts


def split(items: DataFrame, text: str, limit: int, overlap: int, unit: str, keep: tuple[str, ...], with_text: bool = True) -> DataFrame:
    """One row per piece: the kept columns, piece, n_pieces, start, stop (characters), size (units) and piece_text."""
    if not 0 <= overlap < limit or unit not in ("chars", "tokens"):
        raise ValueError("an overlap below the limit is needed, in chars or tokens")
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keep) + ", piece int, n_pieces int, start int, stop int, size int" + ", piece_text string" * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(len(keep)), 1 << 20):
                item, number, start, stop, size = cuts(part, unit, limit, overlap)
                count = np.bincount(item, minlength=len(part))[item] if len(item) else item
                out = [batch.column(i).slice(done, len(part)).take(pa.array(item)) for i in range(len(keep))]
                out += [pa.array(x.astype(np.int32)) for x in (number, count, start, stop, size)]
                if with_text:
                    texts = part.to_pylist()
                    out.append(pa.array([texts[i][a:b] for i, a, b in zip(item, start, stop, strict=True)], pa.string()))
                done += len(part)
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "piece", "n_pieces", "start", "stop", "size"] + ["piece_text"] * with_text)

    return items.select(*keep, text).mapInArrow(work, schema)


def oversized(text: Column, limit: int, unit: str) -> Column:
    """Whether a text is above the limit; n tokens take at least 2n - 1 characters, which spares counting short texts."""
    if unit == "chars":
        return F.length(text) > limit
    return (F.length(text) > 2 * limit) & (F.regexp_count(text, F.lit(TOKEN)) > limit)


def pieces(articles: DataFrame, chunks: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of all articles and chunks above their limit (item_kind, item_key, piece, ...)."""
    tables_of = {"article": (articles, F.col("row_id").cast("string"), "content"), "chunk": (chunks, F.col("chunk_id"), "chunk_text")}
    out = None
    for row in limits.where(F.col("item_kind").isin(*tables_of)).limit(len(tables_of) + 1).collect():
        df, key, text = tables_of[row.item_kind]
        large = df.where(oversized(F.col(text), row.max_size, row.unit)).select(F.lit(row.item_kind).alias("item_kind"), key.alias("item_key"), F.col(text).alias("text"))
        part = split(large, "text", row.max_size, row.overlap, row.unit, ("item_kind", "item_key"), with_text)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no limits")
    return out


def found(articles: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Keys of the items that had to be cut."""
    return pieces(articles, chunks, limits, with_text=False).where("n_pieces > 1 and piece = 0").select("item_kind", "item_key").distinct()
