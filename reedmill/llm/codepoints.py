"""Arrow string columns as numpy code-point arrays.

Everything here works on whole Arrow batches: the UTF-8 bytes of all rows are decoded once into one
``uint32`` array with row offsets, tables indexed by code point are gathered over it, and the result is
encoded once.  No string method is called per row.

Null rows stay null, empty rows stay empty, and a batch is cut into slices of at most ``SLICE_BYTES`` so
that very long texts do not multiply the memory of the temporaries (a longer single row is a slice alone).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 0x110000
#: Code points above this one have no decomposition and no look-alike (except tags and selectors).
TABLED = 0x30000
SLICE_BYTES = 4 << 20

#: Letters of other scripts drawn like a Latin letter, each followed by that letter (from the public list of confusables).
LOOK_ALIKES = (
    "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTХXѴVУYаaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwѵvӀIӏlҮYԌGԜWԚQ"  # Cyrillic
    "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXοoνvϲcϳjαaιiρpϹCϺM"  # Greek
    "ÐĐƉĐɑaɡgɩi"  # other Latin
    "օoսuհhոnզqցgՍUՏSՕO"  # Armenian
    "ᎠDᎡRᎢTᎥiᎩyᎪAᎫJᎬEᎳWᎷMᎻHᎽYᏀGᏂhᏃZᏏbᏒRᏔWᏕSᏙVᏚSᏞLᏟCᏢPᏦKᏧdᏴB"  # Cherokee
    "ꓐBꓑPꓒdꓓDꓔTꓖGꓗKꓙJꓚCꓜZꓝFꓟMꓠNꓡLꓢSꓣRꓦVꓧHꓪWꓫXꓬYꓮAꓰEꓲIꓳOꓴU"  # Lisu
    "ⲎHⲒIⲔKⲘMⲚNⲞOⲢPⲤCⲦTⲨYⲬXⲟoⲣpⲥc"  # Coptic
)
#: Kinds of compatibility forms that are drawn like what they stand for: widths, fonts, ligatures and Roman numerals.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<compat>")
#: Letters with a compatibility form of another shape.
OTHER_SHAPE = {0x17F, 0x149, 0xE33, 0xEB3, 0x587}
#: Format characters that have a visible shape.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Characters without a shape whose category is not Cf.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
ZWJ = 0x200D

PLAIN, DELETE, CHANGE, MARK = 0, 1, 2, 3


class Tables:
    """Lookup tables by code point; built from the Unicode data of the interpreter by rule."""

    def __init__(self) -> None:
        like = {ord(a): ord(b) for a, b in zip(LOOK_ALIKES[::2], LOOK_ALIKES[1::2], strict=True)}
        kind = np.zeros(SIZE, np.uint8)
        ccc = np.zeros(SIZE, np.uint8)
        to: dict[int, list[int]] = {}
        pairs: dict[int, int] = {}
        for cp in range(TABLED):
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Cs", "Co"):
                continue
            c = unicodedata.combining(ch)
            ccc[cp] = c
            if cat == "Cf" and cp not in VISIBLE_FORMAT or cp in INVISIBLE or cat == "Cc" and not (9 <= cp <= 13 or cp in (28, 29, 30, 31, 0x85)):
                kind[cp] = DELETE
                continue
            if cat == "Zs":
                if cp != 32:
                    kind[cp], to[cp] = CHANGE, [32]
                continue
            d = unicodedata.decomposition(ch)
            form, *parts = d.split() if d.startswith("<") else [""]
            same = form in SAME_SHAPE[:2] or form in SAME_SHAPE and (cat[0] == "L" or cat in ("Nl", "Nd", "Sm") and form == "<font>" or cat == "Nl") and cp not in OTHER_SHAPE
            base = "".join(chr(int(x, 16)) for x in parts) if same else ch
            full = [like.get(ord(x), ord(x)) for x in unicodedata.normalize("NFD", base)]
            if c or cat.startswith("M"):
                kind[cp] = MARK
                if full != [cp]:
                    to[cp] = full
            elif unicodedata.normalize("NFC", "".join(map(chr, full))) != ch:
                kind[cp], to[cp] = CHANGE, full
            elif full != [cp]:
                to[cp] = full
            if d and d[0] != "<" and unicodedata.is_normalized("NFC", ch) and len(d.split()) == 2:
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = cp
        for lo, hi in ((0xE0000, 0xE0080), (0xE0100, 0xE01F0)):
            kind[lo:hi] = DELETE
        for lo, hi in ((0x1161, 0x1176), (0x11A8, 0x11C3)):  # Hangul parts compose with what stands before
            kind[lo:hi] = MARK
        self.kind, self.ccc = kind, ccc
        self.length = np.ones(SIZE, np.uint8)
        self.where = np.zeros(SIZE, np.int32)
        flat: list[int] = []
        for cp, full in to.items():
            self.length[cp], self.where[cp] = len(full), len(flat)
            flat += full
        self.has = self.length > 1
        self.has[list(to)] = True
        self.flat = np.array(flat or [0], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        pict = np.zeros(SIZE, bool)
        pict[0x1F000:0x1FB00] = True
        pict[0x2600:0x27C0] = True
        pict[0xFE0F] = pict[0x200D] = True
        self.pict = pict

    @functools.cached_property
    def fold(self) -> np.ndarray:
        """Folded letter for comparing words: no case, accent or look-alike; 32 for any separator, 0 for nothing."""
        out = np.full(SIZE, 32, np.uint32)
        for cp in range(TABLED):
            k = self.kind[cp]
            cat = unicodedata.category(chr(cp))
            if k == DELETE or cat in ("Mn", "Me"):
                out[cp] = 0
            elif cat[0] in "LNM":
                n, w = int(self.length[cp]), int(self.where[cp])
                base = chr(int(self.flat[w])) if self.has[cp] and n else chr(cp)
                base = unicodedata.normalize("NFKD", base)[0].casefold()[:1]
                out[cp] = ord({"đ": "d", "ð": "d", "ı": "i", "ł": "l", "ø": "o"}.get(base, base) or " ")
        return out


@functools.cache
def tables() -> Tables:
    return Tables()


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array if pa.types.is_string(array.type) else array.cast(pa.string())


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cuts an array where its bytes exceed the limit."""
    array = plain(array)
    if not len(array):
        yield array
        return
    ends = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    start = 0
    while start < len(array):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield array.slice(start, stop - start)
        start = stop


def decode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the rows' offsets among them."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32, n + 1 + array.offset)[array.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return cps, before[ends - ends[0]]


def encode(cps: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of decode; null marks rows that become null."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF), out=size[1:])
    ends = size[offsets].astype(np.int32)
    bits = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def take_rows(cps: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of some rows."""
    size = offsets[rows + 1] - offsets[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], size)
    return cps[at], out


def expand(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops invisible characters and writes the others as base letters and marks."""
    t = tables()
    kind = t.kind[cps]
    gone = kind == DELETE
    joins = np.flatnonzero(cps == ZWJ)
    if len(joins):  # a joiner inside an emoji sequence shapes it and is not invisible
        a, b = cps[np.maximum(joins - 1, 0)], cps[np.minimum(joins + 1, len(cps) - 1)]
        row = np.searchsorted(offsets, joins, "right") - 1
        keep = t.pict[a] & t.pict[b] & (joins > offsets[row]) & (joins + 1 < offsets[row + 1])
        gone[joins[keep]] = False
    size = np.where(gone, 0, t.length[cps]).astype(np.int64)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    src = np.repeat(np.arange(len(cps)), size)
    nth = np.arange(at[-1]) - at[:-1][src]
    own = cps[src]
    out = np.where(t.has[own], t.flat[np.minimum(t.where[own] + nth, len(t.flat) - 1)], own)
    return out.astype(np.uint32), at[offsets]


def composite(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a starter and a following character compose to, 0 where they do not."""
    t = tables()
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    i = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    out = np.where(t.pair_keys[i] == key, t.pair_to[i], 0)
    a, b = a.astype(np.int64), b.astype(np.int64)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(lvt, a + b - 0x11A7, out)


def compose(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of all rows at once: each pass composes at most one mark per starter."""
    t = tables()
    if not len(cps):
        return cps, offsets
    cps = cps.copy()
    ccc = t.ccc[cps]
    first = np.zeros(len(cps), bool)
    first[offsets[:-1][offsets[:-1] < len(cps)]] = True
    segment = np.cumsum((ccc == 0) | first)
    marks = np.flatnonzero(ccc > 0)
    if len(marks):
        order = np.argsort(segment[marks] * 256 + ccc[marks], kind="stable")
        cps[marks] = cps[marks][order]
        ccc = t.ccc[cps]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    alive = np.ones(len(cps), bool)
    todo = np.flatnonzero(t.kind[cps] == MARK)
    while len(todo):
        at = np.flatnonzero(alive)
        rank = np.zeros(len(cps), np.int64)
        rank[at] = np.arange(len(at))
        starter = np.maximum.accumulate(np.where(ccc[at] == 0, np.arange(len(at)), -1))
        r = rank[todo]
        before = np.maximum(r - 1, 0)
        # a mark looks for the last starter before it, a starter for the one directly before it
        s = np.where(starter[before] < 0, r, starter[before])
        ok = (r > 0) & (s < r)
        src, prev = at[s], at[before]
        ok &= (ccc[src] == 0) & (row[src] == row[todo])
        c = ccc[todo]
        ok &= np.where(c == 0, before == s, (before == s) | (ccc[prev] < c))
        new = np.where(ok, composite(cps[src], cps[todo]), 0)
        hit = np.flatnonzero(new)
        if not len(hit):
            break
        _, one = np.unique(src[hit], return_index=True)  # the first mark of each starter
        hit = hit[one]
        # a starter that is itself taken in this pass waits for the next
        hit = hit[~np.isin(src[hit], todo[hit])]
        cps[src[hit]] = new[hit]
        alive[todo[hit]] = False
        todo = todo[alive[todo]]
    size = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(alive, out=size[1:])
    return cps[alive], size[offsets]


def canonical(array: pa.Array) -> pa.Array:
    """Every text in one form, such that texts that look the same are equal.

    Rows without any special character are passed on as they are.
    """
    t = tables()
    out = []
    for part in slices(array):
        cps, offsets = decode(part)
        odd = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(t.kind[cps] != PLAIN, out=odd[1:])
        rows = np.flatnonzero(odd[offsets[1:]] > odd[offsets[:-1]])
        if len(rows):
            changed = compose(*expand(*take_rows(cps, offsets, rows)))
            index = np.arange(len(part))
            index[rows] = len(part) + np.arange(len(rows))
            null = np.asarray(part.is_null())
            both = pa.concat_arrays([part, encode(*changed)])
            part = both.take(pa.array(np.where(null, np.arange(len(part)), index)))
        out.append(part)
    return pa.concat_arrays(out)


PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all rows, and the rows' offsets among them."""
    cps, offsets = decode(part)
    folded = tables().fold[cps]
    keep = folded != 0
    count = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    letters, ends = folded[keep], count[offsets]
    n = len(letters)
    inside = letters != 32
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power = np.cumprod(np.full(n + 1, PRIME, np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters.astype(np.uint64) * power[:n], out=total[1:])
    back = np.cumprod(np.full(n + 1, INVERSE, np.uint64))
    h = mix((total[b] - total[a]) * back[a])
    return h, np.searchsorted(a, ends)
