"""Problem 8: documents that hold passages of evaluation items, wholly or in large part.

Method: latent semantic retrieval.  Document frequencies of the items' words are counted over all documents; a
randomised SVD of the TF-IDF passages (subspace iteration, the products with the passage matrix are made per
partition and added on the executors) gives a latent basis; all passages of all documents are projected and compared with all items by cosine;
for the pairs above a threshold, longest common subsequences of the words decide, and as an answer check the rare
words of the item among them must be there too.

The basis is fitted on a documented, bounded sample (``FIT_DOCUMENTS``), taken once; every passage of every document is
searched.  The items are the query set and are held in blocks of about ``ITEMS``; each block takes one scan for the
document frequencies and one for the search.  Windows go up to the longest item.  An item of fewer than ``SHORT`` words
has no latent vector worth comparing: every document that has most of its words is a candidate instead.

Words are compared without case, accents, look-alikes, punctuation and tags.  Null and empty texts hold nothing; an
item without a word is in no document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedmill.functions.session import cut_lineage
from reedmill.llm.codepoints import slices, words

ITEMS = 2000
#: Words below which an item is looked for by its words alone.
SHORT = 24
FIT_DOCUMENTS = 4000
#: Parts of the sample, which make one product each.
FIT_PARTS = 16
RANK = 160
#: Words in a block, and blocks in the windows that are compared (and doublings up to the longest item).
BLOCK = 16
WINDOWS = (3, 6)
#: Words whose latent vectors are added at once: few enough for them to stay in the cache.
TOKENS = 1 << 12
COSINE = 0.55
#: Part of an item's words that must stand in order, and of the weight of its words.
HELD = 0.6
WEIGHT = 0.4
#: Words that may stand between, in parts of the item's length.
SPREAD = 0.6
SLICE = 1 << 20


def without_tags(text: Column) -> Column:
    text = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"</?[A-Za-z!][^<>]*+>", " ")).otherwise(text)
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(text, r"&#?\w{1,10};", " ")).otherwise(text)


def lcs(pattern: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence; pattern has the bits at which each word stands in the item."""
    full = (1 << n) - 1
    v = full
    for w in text:
        m = pattern.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Items:
    """A block of items: vocabulary, word lists and, once fitted, latent vectors."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        hashes, offsets = words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(hashes)
        index = np.searchsorted(self.vocabulary, hashes)
        keep = [k for k in range(len(ids)) if offsets[k + 1] > offsets[k]]
        self.ids = [ids[k] for k in keep]
        self.words = [index[offsets[k] : offsets[k + 1]] for k in keep]
        longest = max(map(len, self.words), default=0)
        self.windows = list(WINDOWS)
        while self.windows[-1] * BLOCK < longest:
            self.windows.append(2 * self.windows[-1])
        self.bits: list[dict[int, int]] = []
        for w in self.words:
            at: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                at[x] = at.get(x, 0) | 1 << i
            self.bits.append(at)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, len(vocabulary) for other words."""
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i, len(self.vocabulary))


def document_frequency(documents: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary stands, and the number of documents."""
    size = len(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                hashes, offsets = words(part)
                index = items.index(hashes)
                known = index < size
                doc = np.repeat(np.arange(len(part)), np.diff(offsets))[known]
                total[:size] += np.bincount(np.unique(doc * size + index[known]) % size, minlength=size)
                total[size] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["w", "n"])

    texts = documents.where("text is not null").select(without_tags(F.col("text")).alias("text"))
    rows = texts.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # one row per word of the items
    out = np.zeros(size + 1, np.int64)
    for r in rows:
        out[r.w] = r.n
    return out[:size], int(out[size])


class Blocks:
    """The words of some documents in blocks: which words of the vocabulary stand in which block."""

    def __init__(self, index: np.ndarray, offsets: np.ndarray, size: int) -> None:
        n = -(-np.diff(offsets) // BLOCK)
        self.ends = np.concatenate(([0], np.cumsum(n)))
        nth = np.arange(self.ends[-1]) - np.repeat(self.ends[:-1], n)
        self.starts = np.repeat(offsets[:-1], n) + nth * BLOCK
        of = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(index))))
        known = index < size
        self.of, self.word = of[known], index[known]

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The counts (blocks x words) times a matrix (words x rank), without the counts being written out."""
        return added(self.of, self.word, basis, len(self.starts))

    def transposed(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The transposed counts (words x blocks) times a matrix (blocks x rank)."""
        order = np.argsort(self.word, kind="stable")
        return added(self.word[order], self.of[order], rows, size)


def added(to: np.ndarray, source: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of the source rows for each target; the targets are in order."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    for a in range(0, len(to), TOKENS):
        t = to[a : a + TOKENS]
        heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        out[t[heads]] += np.add.reduceat(rows[source[a : a + TOKENS]], heads, axis=0)
    return out


def window_sums(block: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over windows of some blocks of each document: the first block of each window and the vectors."""
    total = np.concatenate((np.zeros((1, block.shape[1]), np.float64), np.cumsum(block, axis=0, dtype=np.float64)))
    n = np.diff(ends)
    first = np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
    last = np.repeat(ends[1:], n)
    begin = np.repeat(ends[:-1], n)
    keep = (first + size <= last) | (first == begin)
    first, last = first[keep], last[keep]
    return first, (total[np.minimum(first + size, last)] - total[first]).astype(np.float32)


def fit_sample(documents: DataFrame) -> DataFrame:
    """Texts of about ``FIT_DOCUMENTS`` documents by hash, in ``FIT_PARTS`` parts; the scan itself keeps its own parts."""
    every = max(1, documents.count() // FIT_DOCUMENTS)
    sample = documents.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    return cut_lineage(sample.select(without_tags(F.col("text")).alias("text")).repartition(FIT_PARTS))


def fit(sample: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """An orthonormal basis (words x rank) of the space of the TF-IDF passages, by two rounds of subspace iteration."""
    size = len(items.vocabulary)
    rank = min(rank, size)

    def product(basis: np.ndarray) -> np.ndarray:
        scaled = (basis * idf[:, None]).astype(np.float32)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size, rank), np.float32)
            for batch in batches:
                for part in slices(batch.column(0), SLICE):
                    hashes, offsets = words(part)
                    blocks = Blocks(items.index(hashes), offsets, size)
                    first, latent = window_sums(blocks.times(scaled), blocks.ends, WINDOWS[-1])
                    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
                    # back to words: each block gets the sum over the windows that hold it
                    back = np.zeros((len(blocks.starts), rank), np.float32)
                    stop = np.repeat(blocks.ends[1:], np.diff(blocks.ends))[first]
                    for j in range(WINDOWS[-1]):
                        inside = first + j < stop
                        back[first[inside] + j] += latent[inside]
                    out += blocks.transposed(back, size)
            yield pa.RecordBatch.from_arrays([pa.array([(out * idf[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["g"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size * rank, np.float32)
            for batch in batches:
                for g in batch.column(0):
                    out += np.frombuffer(g.as_buffer(), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["g"])

        whole = sample.mapInArrow(work, "g binary").repartition(1).mapInArrow(add, "g binary").first()  # of FIT_PARTS matrices
        return np.linalg.qr(np.frombuffer(whole.g, np.float32).reshape(size, rank).astype(np.float64))[0]

    basis = np.random.default_rng(8).standard_normal((size, rank))
    for _ in range(2):
        basis = product(basis)
    return basis


def search(documents: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, key: str, trace: bool = False) -> DataFrame:
    """(key, item_id, held): the items of this block that a document holds."""
    scaled = (basis * idf[:, None]).astype(np.float32)
    size_v = len(items.vocabulary)
    heavy = np.append(idf, 0.0)
    queries = np.array([scaled[w].sum(axis=0) for w in items.words], np.float32).reshape(-1, scaled.shape[1])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    lengths = np.array([len(w) for w in items.words])
    counts = [np.bincount(w, minlength=len(heavy)) for w in items.words]
    weights = [float(heavy[w].sum()) for w in items.words]
    short = np.flatnonzero(lengths < SHORT)
    long = np.flatnonzero(lengths >= SHORT)
    queries = queries[long]
    bags = np.zeros((len(short), size_v), bool)
    for i, k in enumerate(short):
        bags[i, items.words[k]] = True
    own = np.flatnonzero(bags.any(axis=0))  # the words of short items
    bags = bags[:, own].astype(np.float32)

    def with_words(index: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Documents and short items most of whose words they have."""
        if not len(short):
            return
        place = np.full(size_v + 1, -1)
        place[own] = np.arange(len(own))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = place[index]
        there = np.zeros((len(offsets) - 1, len(own)), np.float32)
        there[doc[at >= 0], at[at >= 0]] = 1
        for d, i in zip(*np.nonzero(there @ bags.T >= HELD * bags.sum(axis=1))):
            yield int(d), int(short[i])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, float]] = []
            done = 0
            for part in slices(batch.column(1), SLICE):
                hashes, offsets = words(part)
                index = items.index(hashes)
                blocks = Blocks(index, offsets, size_v)
                block, starts, ends = blocks.times(scaled), blocks.starts, blocks.ends
                doc_of = np.repeat(np.arange(len(part)), np.diff(ends))
                best: dict[tuple[int, int], list[int]] = {}
                for d, k in with_words(index, offsets):
                    best[d, k] = list(range(int(offsets[d]), int(offsets[d + 1]), BLOCK))
                for size in items.windows if len(long) else ():
                    first, latent = window_sums(block, ends, size)
                    norm = np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
                    for a in range(0, len(first), 4096):
                        near = latent[a : a + 4096] / norm[a : a + 4096] @ queries.T
                        w, q = np.nonzero(near >= COSINE)
                        for d, k, s in zip(doc_of[first[a + w]].tolist(), long[q].tolist(), starts[first[a + w]].tolist(), strict=True):
                            best.setdefault((d, k), []).append(s)
                for (d, k), at in best.items():
                    n = int(lengths[k])
                    # windows of one pair that lie near each other are judged together
                    at.sort()
                    groups = [[at[0], at[0]]]
                    for s in at[1:]:
                        if s - groups[-1][1] <= n:
                            groups[-1][1] = s
                        else:
                            groups.append([s, s])
                    held = 0.0
                    for lo, hi in groups:
                        a, b = max(int(offsets[d]), lo - n), min(int(offsets[d + 1]), hi + BLOCK * items.windows[-1] + n)
                        text = index[a:b]
                        mine = np.bincount(text, minlength=len(heavy))
                        if np.minimum(mine, counts[k]).sum() < HELD * n or lcs(items.bits[k], n, text.tolist()) < HELD * n:
                            continue
                        held = max(held, close(items.bits[k], items.words[k], n, text, heavy, weights[k]))
                    if held >= HELD or trace:
                        found.append((done + d, k, held))
                done += len(part)
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=[key, "item_id", "held"])

    texts = documents.where("text is not null").select(key, without_tags(F.col("text")).alias("text"))
    return texts.mapInArrow(work, f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id long, held double")


def close(bits: dict[int, int], item: np.ndarray, n: int, text: np.ndarray, heavy: np.ndarray, weight: float) -> float:
    """Largest part of the item that stands in order in a stretch of the text not much longer than it."""
    span = n + int(SPREAD * n) + 30
    best = 0.0
    own = set(item.tolist())
    # stretches begin where words of the item stand; a quarter of the item's length apart is near enough for the rest
    step = max(1, n // 4)
    for a in range(0, max(1, len(text) - n // 2), step):
        part = text[a : a + span]
        held = lcs(bits, n, part.tolist()) / n
        if held > best:
            there = np.bincount(part, minlength=len(heavy))
            rare = sum(heavy[w] * c for w, c in zip(*np.unique(item, return_counts=True), strict=True) if there[w])
            if own and rare >= WEIGHT * weight:
                best = held
        if best >= 0.98:
            break
    return best


def found(documents: DataFrame, eval_items: DataFrame, key: str = "doc_id", trace: bool = False) -> DataFrame:
    """(key, item_id) of documents and the items they hold."""
    count = eval_items.count()
    parts = max(1, math.ceil(count / ITEMS))
    out = sample = None
    for b in range(parts):
        block = eval_items.where("text is not null")
        if parts > 1:
            block = block.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == b)
        rows = block.select("item_id", without_tags(F.col("text")).alias("text")).orderBy("item_id").collect()  # about ITEMS rows
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        if not items.ids:
            continue
        sample = sample or fit_sample(documents)
        df, n = document_frequency(documents, items)
        idf = np.log((1 + n) / (1 + df)) + 0.05
        part = search(documents, items, idf, fit(sample, items, idf), key, trace)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], f"`{key}` long, item_id long, held double")
    return out
