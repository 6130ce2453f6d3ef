"""Problem 3: validation and test records whose content also stands, exactly or almost, in a training record.

Method: a compressed full-text index over words (the Burrows-Wheeler transform as a bit-packed wavelet matrix, with
sampled suffixes) is built per shard of evaluation records; training records are streamed through backward search,
which yields where five of their words stand in the shard.  Hits that follow each other on one diagonal are one maximal
match; the spans of the maximal matches are merged and counted on both sides.  A pair whose merged spans cover enough
of both records is a case after an exact count of the words they share.

Which training record is streamed through which shard is told by samples of words: a word is drawn with a chance
that grows with its rarity (``word_weights``), and records that agree in ``ROWS`` draws of one of ``BANDS`` bands meet,
unless the draws of all bands together tell that they share too little.  Stock phrases consist of frequent words and
lead nothing together.  Draws are by chance: a pair with every tenth word replaced meets with a probability above 0.99
(``meeting`` gives it for any similarity; the tests measure it), so the recall is not certain, but is far above 0.9.
Words put in by chance are mostly rare and weigh more than those they replace: with every tenth word replaced by any
of the corpus and a sentence added, records still agree in about 0.72 of their draws.

Most pairs that meet share half of their words and are no case.  They are told before any text is moved by a bound that
leaves out no case (``possible``), and the rest by the exact count of shared words, before the index is built.

Exact copies (in words) are one class per side and are searched once.  Shards and their streams are of bounded size,
popular shards are split by training record.  The pairs of classes are expanded to records at the end.

Words are compared without case, accents, look-alikes, punctuation and tags, entities as what they stand for
(``visible``).  Contents that are null, blank or shorter than ``SHORTEST`` characters take no part.  Records of fewer
than five words match copies only, those without any word (rules, emoji) copies of all their characters but blanks.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.functions.session import cut_lineage
from reedmill.llm.codepoints import canonical, mix, slices, words
from reedmill.llm.markup import ELEMENTS, INLINE

SHORTEST = 100
SHINGLE = 5
#: Buckets in which words are counted: the table has this size whatever the input.
BUCKETS = 1 << 16
#: Draws per band, and bands: every draw stands in two bands or fewer.
ROWS, BANDS = 5, 102
#: Draws, which are the bits of the sketch, and how many must agree for two records to meet.
BITS = 256
AGREE = 0.72
#: Bits of a record's bag for each of its words, at least: their number is a power of two.
BAG = 6
#: Power of the logarithm of the rarity: below 1, so that slips of spelling, rare words all, don't outweigh the rest.
RARITY = 0.7
LEAST, MOST = 0.05, 5.0
#: Words of evaluation records in a shard, and of training records in one stream through it: what is found does not depend on them. A stream meets
#: the stock phrases of the whole shard, so that small shards spare hits that lead nowhere.
SHARD, STREAM = 10_000, 400_000
#: The same where only bags are compared.
BAG_SHARD, BAG_STREAM = 32_000_000, 32_000_000
#: Numbers of bags that are compared at once.
NUMBERS = 1 << 22
#: Part of both records that the merged spans cover, and part of the longer record's words that both have.
COVERED = 0.5
SHARED = 0.72
#: Every so many words of a record a suffix of the index is sampled.
SAMPLED = 8
#: Hits that are located at once.
HITS = 2_000_000
SLICE = 1 << 20
#: The draws of each band: all draws in one order after the other.
DRAWN = np.concatenate([np.argsort(mix(np.arange(BITS, dtype=np.uint64) + np.uint64(1 + i * BITS)))[: BITS // ROWS * ROWS] for i in range(-(-BANDS // (BITS // ROWS)))]).reshape(-1, ROWS)[:BANDS]

#: Attributes that stand without a value.
_ALONE = "allowfullscreen|async|autofocus|autoplay|checked|compact|controls|default|defer|disabled|hidden|ismap|itemscope|loop|multiple|muted|nomodule|noshade|novalidate|nowrap|open|playsinline|readonly|required|reversed|selected"
_VALUED = r"\s++[A-Za-z_:@][\w:.-]*+\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|[“”„″][^“”„″<>]*+[“”„″]|[^\s\"'<>]++)"
#: A tag: an element's name, or any name that is closed or has an attribute with a value. Prose between angle brackets is none.
TAG = re.compile(rf"<(?:(?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})(?:{_VALUED}|\s++(?:{_ALONE})(?=[\s/>]))*+\s*+/?>|[A-Za-z][\w:-]*+(?:{_VALUED})++\s*+/?>|/[A-Za-z][\w:-]*+\s*+>|!(?:--|doctype\b|\[CDATA\[)[^<>]*+>)", re.A | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[\dA-F]{1,6}|[A-Z][A-Z\d]{1,31});", re.A | re.I)


def meeting(similarity: float) -> float:
    """The probability that two records of a weighted similarity (of their sets of words) agree in a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def eligible(records: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, evaluation, text) of each record of a split with a long enough content."""
    rows = records.where(F.length(text) >= SHORTEST).where(F.col("split").isin("train", "validation", "test"))
    return rows.select(F.col(key).alias("id"), (F.col("split") != "train").alias("evaluation"), text.alias("text"))


def displayed(text: str) -> str:
    """A text with its entities decoded, also where they were escaped again, and without its tags, unless nothing is left without them."""
    for _ in range(8):
        text, n = ENTITY.subn(lambda m: html.unescape(m.group()), text)
        if not n:
            break
    bare = TAG.sub(lambda m: "" if INLINE.match(m.group().lower()) else " ", text)
    return bare if bare and not bare.isspace() else text


def visible(part: pa.Array) -> pa.Array:
    """Texts as they are displayed; only those with a sign of markup are looked at one by one."""
    odd = np.flatnonzero(pc.or_(pc.match_substring(part, "<"), pc.match_substring(part, "&")).to_numpy(zero_copy_only=False))
    if not len(odd):
        return part
    index = np.arange(len(part))
    index[odd] = len(part) + np.arange(len(odd))
    return pa.concat_arrays([part, pa.array([displayed(x) for x in part.take(pa.array(odd)).to_pylist()], pa.string())]).take(pa.array(index))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % BUCKETS


def once_per_row(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with their offsets, and each row's distinct words: rows, hashes and how often they stand there."""
    h, offsets = words(part)
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    order = np.lexsort((h, row))
    r, w = row[order], h[order]
    new = np.ones(len(w), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    heads = np.flatnonzero(new)
    return h, offsets, r[heads], w[heads], np.diff(np.append(heads, len(w)))


def word_weights(rows: DataFrame) -> np.ndarray:
    """The weight of each bucket of words by its rarity over all records: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                _, _, _, w, _ = once_per_row(visible(part))
                total[:BUCKETS] += np.bincount(bucket(w), minlength=BUCKETS)
                total[BUCKETS] += len(part)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["b", "n"])

    n = np.zeros(BUCKETS + 1)
    for b, k in rows.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n")).collect():  # at most BUCKETS + 1 rows
        n[b] = k
    weight = np.clip(np.log((n[BUCKETS] + 1) / (n[:BUCKETS] + 0.5)), LEAST, MOST) ** RARITY
    return np.where(n[:BUCKETS] < 2, LEAST**RARITY, weight)  # a word of one record cannot be shared


def draws(row: np.ndarray, w: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """(draws x rows): which word each draw takes from each row's distinct words, as a number of that word and draw.

    A word's key is exponential with its weight as the rate, the smallest key of a row is drawn: two rows draw the
    same word with a probability of the weight they share by the weight of both together.
    """
    u, at = np.unique(w, return_inverse=True)
    rate = weights[bucket(u)]
    heads = np.searchsorted(row, np.arange(rows))
    empty = np.bincount(row, minlength=rows) == 0
    out = np.zeros((BITS, rows), np.uint32)
    for i in range(BITS):
        chance = (mix(u ^ mix(np.full(1, i + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)).astype(np.float64) + 0.5
        drawn = (-np.log(chance / (1 << 53)) / rate).astype(np.float32)[at]
        if len(drawn):
            out[i] = np.minimum.reduceat(drawn, np.minimum(heads, len(drawn) - 1)).view(np.uint32)
    out[:, empty] = 0
    return out


def bags(row: np.ndarray, w: np.ndarray, times: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Per row bits in numbers, set by its words; the second, third and later one of a word set bits of their own.

    The bits of a bag of half the size are those of both halves together.
    """
    numbers = np.int64(1) << np.ceil(np.log2(np.maximum(n * BAG / 64, 1))).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(numbers)))
    row, nth = np.repeat(row, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    bit = (mix(np.repeat(w, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)).astype(np.int64) & numbers[row] * 64 - 1
    flags = np.zeros(start[-1] * 64, np.uint8)
    flags[start[row] * 64 + bit] = 1
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(np.packbits(flags).view(np.int64)))


def folded(bits: np.ndarray, offsets: np.ndarray, rows: np.ndarray, numbers: int) -> np.ndarray:
    """(rows x numbers): bags of some rows in a size that none of them is below."""
    out = np.zeros((len(rows), numbers), np.uint64)
    size = np.diff(offsets)[rows]
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        out[own] = np.bitwise_or.reduce(bits[offsets[rows[own], None] + np.arange(k)].reshape(len(own), -1, numbers), axis=1)
    return out


def most_shared(bits: np.ndarray, offsets: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words that rows a and rows b may have in common at most: a bit that one bag has alone stands for a word that the other record lacks."""
    out = np.zeros(len(a), np.int64)
    size = np.minimum(np.diff(offsets)[a], np.diff(offsets)[b])
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        for i in range(0, len(own), max(1, NUMBERS // int(k))):
            at = own[i : i + max(1, NUMBERS // int(k))]
            x, y = (folded(bits, offsets, side[at], int(k)) for side in (a, b))
            lacks = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x)))
            out[at] = np.minimum(*(n[side[at]] - lack for side, lack in zip((a, b), lacks, strict=True)))
    return out


def wordless(text: str) -> tuple[int, int]:
    """Two fingerprints of the characters but blanks, both 0 for a blank text."""
    bare = "".join(text.split())
    digest = hashlib.blake2b(bare.encode(), digest_size=16).digest() if bare else bytes(16)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(part: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Per row: two fingerprints of its word sequence (``wordless`` without words), the number of words, the bands, the sketch as four numbers, and the bag."""
    h, offsets, r, w, times = once_per_row(part)
    n = np.diff(offsets)
    nth = (np.arange(len(h)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
    prints = []
    for seed in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(nth * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))), dtype=np.uint64)))
        prints.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    none = np.flatnonzero(n == 0)
    if len(none):
        prints[0][none], prints[1][none] = zip(*map(wordless, canonical(part.take(pa.array(none))).to_pylist()), strict=True)
    drawn = draws(r, w, len(part), weights)
    band = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(part), axis=1)
    for j in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + drawn[DRAWN[:, j]] + np.uint64(1))
    bits = mix(drawn.astype(np.uint64) + np.uint64(7)) >> np.uint64(17) & np.uint64(1)
    sketch = np.packbits(bits.astype(np.uint8), axis=0).T.copy().view(np.int64)
    return prints[0], prints[1], n, (band.T >> np.uint64(32)).astype(np.uint32).view(np.int32), sketch, bags(r, w, times, n)


def fingerprints(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, evaluation, f1, f2, n, bands, sketch, bag) of each record that is not blank."""
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2), SLICE):
                f1, f2, n, bands, sketch, bag = signatures(visible(part), weights)
                own = [batch.column(i).slice(done, len(part)) for i in (0, 1)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([*own, pa.array(f1), pa.array(f2), pa.array(n.astype(np.int32)), lists(bands), lists(sketch), bag], names=["id", "evaluation", "f1", "f2", "n", "bands", "sketch", "bag"])

    return rows.mapInArrow(work, "id long, evaluation boolean, f1 long, f2 long, n int, bands array<int>, sketch array<long>, bag array<long>").where("n > 0 or f1 != 0 or f2 != 0")


class Bits:
    """A packed bit vector with ranks."""

    def __init__(self, flags: np.ndarray) -> None:
        padded = np.zeros(-(-(len(flags) + 1) // 64) * 64, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))))[:-1].astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Index:
    """Compressed full-text index over the words of some records."""

    def __init__(self, h: np.ndarray, offsets: np.ndarray) -> None:
        self.vocabulary = np.unique(h)
        symbol = np.searchsorted(self.vocabulary, h) + 1
        rows = len(offsets) - 1
        # each record is followed by a separator
        n = np.diff(offsets)
        self.start = offsets[:-1] + np.arange(rows)
        text = np.zeros(len(h) + rows, np.int64)
        within = np.arange(len(h)) - np.repeat(offsets[:-1], n)
        text[np.repeat(self.start, n) + within] = symbol
        suffix = self.sorted_suffixes(text, len(self.vocabulary) + 2)
        bwt = text[suffix - 1]
        counts = np.bincount(text, minlength=len(self.vocabulary) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.planes: list[tuple[Bits, int]] = []
        self.levels = max(1, int(len(self.vocabulary)).bit_length())
        rest, base = bwt, np.zeros(len(self.vocabulary) + 1, np.int64)
        symbols = np.arange(len(self.vocabulary) + 1)
        for level in reversed(range(self.levels)):
            flags = (rest >> level & 1).astype(bool)
            plane, zeros = Bits(flags), int(len(flags) - flags.sum())
            base = np.where(symbols >> level & 1, zeros + plane.rank(base).astype(np.int64), base - plane.rank(base))
            self.planes.append((plane, zeros))
            rest = np.concatenate((rest[~flags], rest[flags]))
        self.base = base
        # sampled from the start of each record on, so that no step goes beyond it
        offset = suffix - self.start[np.searchsorted(self.start, suffix, "right") - 1]
        kept = (offset % SAMPLED == 0) & (text[suffix] > 0)
        self.marked, self.sample = Bits(kept), suffix[kept].astype(np.uint32)

    @staticmethod
    def sorted_suffixes(text: np.ndarray, symbols: int) -> np.ndarray:
        """The order of all suffixes, by doubling."""
        n = len(text)
        rank, order, step = text.copy(), np.argsort(text, kind="stable"), 1
        while n:
            key2 = np.zeros(n, np.int64)
            key2[: max(n - step, 0)] = rank[step:] + 1
            pair = rank * (n + symbols) + key2
            order = np.argsort(pair, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step > n:
                break
        return order

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for words that do not stand in the index."""
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == h, i + 1, 0)

    def back(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search: the number of smaller symbols and of c before the place."""
        i = at
        for level, (plane, zeros) in zip(reversed(range(self.levels)), self.planes, strict=True):
            ones = plane.rank(i).astype(np.int64)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return self.first[c] + i - self.base[c]

    def search(self, c: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given end positions of a text of symbols those whose last ``length`` words stand in the index, with their ranges."""
        lo, hi = self.first[c[ends]], self.first[c[ends] + 1]
        alive = c[ends] > 0
        for j in range(1, length):
            ends, lo, hi = ends[alive], lo[alive], hi[alive]
            s = c[ends - j]
            both = self.back(np.concatenate((s, s)), np.concatenate((lo, hi)))
            lo, hi = both[: len(s)], both[len(s) :]
            alive = (s > 0) & (hi > lo)
        return ends[alive], lo[alive], hi[alive]

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Where the suffixes of some ranks begin: steps back to the next sampled one."""
        out = np.zeros(len(i), np.int64)
        todo, steps = np.arange(len(i)), 0
        while len(todo):
            hit = self.marked.at(i)
            out[todo[hit]] = self.sample[self.marked.rank(i[hit])] + np.int64(steps)
            todo, i = todo[~hit], i[~hit]
            symbol, at = np.zeros(len(i), np.int64), i
            for plane, zeros in self.planes:
                one, ones = plane.at(at), plane.rank(at).astype(np.int64)
                symbol = symbol << 1 | one
                at = np.where(one, zeros + ones, at - ones)
            i = self.first[symbol] + at - self.base[symbol]
            steps += 1
        return out


def maximal(pair: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of five words (pair, last word in one text, first word in the other) as maximal matches: pair, starts in both, length."""
    start = end - SHINGLE + 1
    order = np.lexsort((start, place - start, pair))
    pair, start, place = pair[order], start[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    return pair[heads], start[heads], place[heads], np.diff(np.append(heads, len(pair))) + SHINGLE - 1


def covered(pair: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair the number of positions that its spans cover together."""
    if not len(pair):
        return pair, length
    order = np.lexsort((start, pair))
    pair, start, stop = pair[order], start[order], (start + length)[order]
    heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair))))
    shift = group * (stop.max() + 1)  # the spans of one pair lie behind those of the one before
    reach = np.maximum.accumulate(stop + shift)
    before = np.concatenate(([0], reach[:-1]))
    return pair[heads], np.add.reduceat(np.maximum(stop + shift - np.maximum(start + shift, before), 0), heads)


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Number of words two records have in common, repeated ones as often as in both."""
    u, i = np.unique(np.concatenate((a, b)), return_inverse=True)
    return int(np.minimum(np.bincount(i[: len(a)], minlength=len(u)), np.bincount(i[len(a) :], minlength=len(u))).sum())


def match(evaluation: pa.Array, training: pa.Array) -> list[tuple[int, int]]:
    """Pairs (training row, evaluation row) that share nearly all their words, mostly in order."""
    return matches(*words(evaluation), *words(training))


def matches(eh: np.ndarray, eo: np.ndarray, th: np.ndarray, to: np.ndarray) -> list[tuple[int, int]]:
    """``match`` by the words of both sides and their offsets."""
    if not len(eh) or not len(th):
        return []
    evaluations = len(eo) - 1
    index = Index(eh, eo)
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    ends = np.flatnonzero(np.arange(len(th)) - to[row] >= SHINGLE - 1)
    ends, lo, hi = index.search(index.symbols(th), ends, SHINGLE)
    out: list[tuple[int, int]] = []
    many = np.cumsum(hi - lo)
    parts = [0]
    while parts[-1] < len(ends):  # whole training records at a time
        base = many[parts[-1] - 1] if parts[-1] else 0
        stop = max(int(np.searchsorted(many, base + HITS)), parts[-1] + 1)
        if stop < len(ends):
            same = int(np.searchsorted(row[ends], row[ends[stop - 1]], "left"))
            stop = same if same > parts[-1] else int(np.searchsorted(row[ends], row[ends[stop - 1]], "right"))
        parts.append(stop)
    for a, b in zip(parts[:-1], parts[1:], strict=True):
        k = hi[a:b] - lo[a:b]
        begin = np.concatenate(([0], np.cumsum(k)[:-1]))
        place = index.locate(np.arange(k.sum()) - np.repeat(begin, k) + np.repeat(lo[a:b], k))
        end = np.repeat(ends[a:b], k)
        d = np.searchsorted(index.start, place, "right") - 1
        pair, start, place, length = maximal(row[end] * evaluations + d, end, place)
        p, on_training = covered(pair, start, length)
        _, on_evaluation = covered(pair, place, length)
        t, e = p // evaluations, p % evaluations
        longer = np.maximum(np.diff(to)[t], np.diff(eo)[e])
        for i in np.flatnonzero(np.minimum(on_training, on_evaluation) >= COVERED * longer):
            x, y = int(t[i]), int(e[i])
            if shared_words(th[to[x] : to[x + 1]], eh[eo[y] : eo[y + 1]]) >= SHARED * longer[i]:
                out.append((x, y))
    return out


def of_rows(h: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some rows and their offsets."""
    n = np.diff(offsets)[rows]
    out = np.concatenate(([0], np.cumsum(n)))
    return h[np.arange(out[-1]) - np.repeat(out[:-1] - offsets[rows], n)], out


def search_group(table: pa.Table) -> pa.Table:
    """One shard with one stream: the pairs of classes found in it.  Only records of pairs that share enough words go through the index."""
    flag = np.asarray(table.column("evaluation").combine_chunks().to_numpy(zero_copy_only=False), bool)
    ids = table.column("id").to_numpy()
    text = table.column("text").combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
    h, o = words(visible(text.cast(pa.string())))
    n = np.diff(o)
    rows: dict[int, list[int]] = {}
    for i in np.flatnonzero(flag):
        rows.setdefault(int(ids[i]), []).append(int(i))
    left: set[int] = set()
    for t, met in zip(np.flatnonzero(~flag), table.column("met").filter(pa.array(~flag)).to_pylist(), strict=True):
        alike = [e for x in met for e in rows.get(x, ()) if shared_words(h[o[t] : o[t + 1]], h[o[e] : o[e + 1]]) >= SHARED * max(n[t], n[e])]
        left.update([int(t), *alike] if alike else ())
    kept = np.array(sorted(left), np.int64)
    e, t = kept[flag[kept]], kept[~flag[kept]]
    pairs = matches(*of_rows(h, o, e), *of_rows(h, o, t))
    return pa.table({"t": pa.array([int(ids[t[x]]) for x, _ in pairs], pa.int64()), "e": pa.array([int(ids[e[y]]) for _, y in pairs], pa.int64())})


def meetings(classes: DataFrame) -> DataFrame:
    """(t, tn, e, en): classes of training and evaluation records that agree in a band and in most of their sketches."""
    side = lambda flag, x: classes.where(flag).where(F.col("n") >= SHINGLE).select(F.explode("bands").alias("band"), F.col("id").alias(x), F.col("n").alias(f"{x}n"), *(F.get("sketch", F.lit(i)).alias(f"{x}{i}") for i in range(BITS // 64)))
    pairs = side("not evaluation", "t").join(side("evaluation", "e"), "band")
    alike = F.least("tn", "en") >= SHARED * F.greatest("tn", "en")  # else fewer words are shared than a case has
    differ = sum((F.bit_count(F.col(f"t{i}").bitwiseXOR(F.col(f"e{i}"))) for i in range(BITS // 64)), F.lit(0))
    return pairs.where(alike & (differ <= int((1 - AGREE) * BITS))).select("t", "tn", "e", "en").distinct()


def grouped(near: DataFrame, shard_words: int, stream_words: int) -> DataFrame:
    """(shard, stream, id, n, evaluation, met): the records of pairs in shards and streams of bounded size; training records with those they met there."""
    indexed = near.select("e", "en").distinct()
    total = indexed.agg(F.coalesce(F.sum("en"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(shards))
    streamed = near.groupBy(shard("e").alias("shard"), "t", "tn").agg(F.collect_set("e").alias("met"))
    split = streamed.groupBy("shard").agg(F.ceil(F.sum("tn") / stream_words).cast("int").alias("streams"))
    training = streamed.join(split, "shard").select("shard", F.pmod(F.xxhash64("t", F.lit(6)), F.col("streams")).cast("int").alias("stream"), F.col("t").alias("id"), F.col("tn").alias("n"), F.lit(False).alias("evaluation"), "met")
    evaluation = indexed.select(shard("e").alias("shard"), F.col("e").alias("id"), F.col("en").alias("n")).join(split, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), "id", "n", F.lit(True).alias("evaluation"), F.lit(None).cast("array<long>").alias("met"))
    return training.unionByName(evaluation)


def compare_bags(table: pa.Table) -> pa.Table:
    """One shard with one stream: the pairs that met and may share as many words as a case has."""
    table = table.combine_chunks()
    flag = np.asarray(table.column("evaluation").to_numpy(zero_copy_only=False), bool)
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    bag = pa.concat_arrays(table.column("bag").chunks)
    e, t = np.flatnonzero(flag), np.flatnonzero(~flag)
    met = pa.concat_arrays(table.column("met").chunks).take(pa.array(t))
    a, other = np.repeat(t, met.value_lengths().to_numpy(zero_copy_only=False)), met.flatten().to_numpy()
    e = e[np.argsort(ids[e], kind="stable")]
    first = np.searchsorted(ids[e], other, "left")
    many = np.searchsorted(ids[e], other, "right") - first
    a, b = np.repeat(a, many), e[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
    offsets = np.concatenate(([0], np.cumsum(bag.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    left = most_shared(bag.flatten().to_numpy().view(np.uint64), offsets, n, a, b) >= SHARED * np.maximum(n[a], n[b])
    return pa.table({"t": ids[a[left]], "tn": n[a[left]], "e": ids[b[left]], "en": n[b[left]]})


def possible(near: DataFrame, prints: DataFrame) -> DataFrame:
    """(t, tn, e, en): the pairs that may share as many words as a case has; none that does is left out."""
    group = grouped(near, BAG_SHARD, BAG_STREAM).join(prints.select("id", "n", "evaluation", "bag"), ["id", "n", "evaluation"])
    return group.groupBy("shard", "stream").applyInArrow(compare_bags, "t long, tn int, e long, en int").distinct()


def class_pairs(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(t, e): classes of training and evaluation records, by their smallest ids, that share nearly all words."""
    classes = cut_lineage(prints.groupBy("evaluation", "f1", "f2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min_by(F.struct("bands", "sketch"), "id").alias("x")).select("evaluation", "f1", "f2", "id", "n", "x.*"))
    tiny = classes.where(F.col("n") < SHINGLE)
    copies = tiny.where("not evaluation").select("f1", "f2", F.col("id").alias("t")).join(tiny.where("evaluation").select("f1", "f2", F.col("id").alias("e")), ["f1", "f2"]).select("t", "e")
    near = cut_lineage(possible(cut_lineage(meetings(classes)), prints))
    group = grouped(near, SHARD, STREAM).drop("n").join(rows.select("id", "text"), "id")
    return group.groupBy("shard", "stream").applyInArrow(search_group, "t long, e long").distinct().union(copies)


def overlaps(records: DataFrame, key: str = "row_id", field: str = "content") -> DataFrame:
    """(row_id_a, row_id_b, exact): one training and one evaluation record each, the smaller id first."""
    rows = eligible(records.select(key, "split", field), key, F.col(field))
    prints = cut_lineage(fingerprints(rows, word_weights(rows)))
    member = prints.select("id", "evaluation", "f1", "f2")
    ids = member.groupBy("evaluation", "f1", "f2").agg(F.min("id").alias("class"))
    of = member.join(ids, ["evaluation", "f1", "f2"]).select("evaluation", "class", "id", "f1", "f2")
    pairs = class_pairs(rows, prints)
    a = of.where("not evaluation").select(F.col("class").alias("t"), F.col("id").alias("a"), F.struct("f1", "f2").alias("fa"))
    b = of.where("evaluation").select(F.col("class").alias("e"), F.col("id").alias("b"), F.struct("f1", "f2").alias("fb"))
    found = pairs.join(a, "t").join(b, "e")
    return found.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"), (F.col("fa") == F.col("fb")).alias("exact"), F.col("b").alias("evaluation_id")).distinct()


def report(records: DataFrame, key: str = "row_id") -> DataFrame:
    """Per split and source: records, those that overlap with training records, and those that are exact copies in words."""
    hits = overlaps(records, key).groupBy(F.col("evaluation_id").alias(key)).agg(F.max("exact").alias("exact"))
    rows = records.where("split in ('validation', 'test')").select(key, "split", "source").join(hits, key, "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("exact").alias("overlapping"), F.count_if("exact").alias("exact_copies"))
