"""Vectorised text primitives over Arrow batches.

All functions see the UTF-8 bytes of a block of whole texts as one numpy array with
offsets, so that a pass costs a few numpy operations per byte and no Python step per
word. Texts are never cut: a text longer than a block's size makes a block of its own.
What takes more than a byte or two a byte of text is done CHUNK bytes at a time with carried
sums, so a very long text costs memory by its words, not by a table of its bytes. Null texts
count as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Elements for which wide intermediate arrays are held at once.
CHUNK = 1 << 21
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


@dataclass
class Texts:
    """data: bytes of all texts; off: n + 1 byte offsets; null: which rows were null."""

    data: np.ndarray
    off: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    """Byte spans of maximal runs of non-separators; off: n + 1 offsets into them by text."""

    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    null = np.asarray(column.is_null())
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = arr.buffers()
    if not len(arr) or offs is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64), null)
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[off[0] : off[-1]], off - off[0], null)


def blocks(batches: Iterable[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most `size` bytes of text each, unless one text alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, len(whole)
        while at < n:
            to = int(np.searchsorted(whole.off, whole.off[at] + size, side="right")) - 1
            to = min(max(to, at + 1), n)
            lo, hi = whole.off[at], whole.off[to]
            yield batch.slice(at, to - at), Texts(whole.data[lo:hi], whole.off[at : to + 1] - lo, whole.null[at:to])
            at = to


def runs(inside: np.ndarray, off: np.ndarray) -> Words:
    """Maximal runs of True that don't cross texts."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = off[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = off[1:]
    after[tails[tails > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, off))


def runs_of_lines(t: Texts) -> Words:
    """Spans between newlines, empty ones too; an empty text has none."""
    n = len(t.data)
    full = np.flatnonzero(np.diff(t.off))
    cut = np.flatnonzero(t.data == 10)
    start = np.concatenate([t.off[:-1][full], cut + 1])
    end = np.concatenate([t.off[1:][full], cut])
    start.sort()
    end.sort()
    # A newline at a text's end opens an empty line at that text's end, where the next text starts.
    doc_of_cut = np.searchsorted(t.off, cut, side="right") - 1
    per = np.bincount(doc_of_cut, minlength=len(t)) if n else np.zeros(len(t), np.int64)
    per[full] += 1
    off = np.zeros(len(t) + 1, np.int64)
    np.cumsum(per, out=off[1:])
    return Words(start, end, off)


def words(t: Texts) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return runs(~SEPARATOR[t.data], t.off)


def char_starts(t: Texts) -> np.ndarray:
    """True at the first byte of each code point."""
    return (t.data & 0xC0) != 0x80


def count_in(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many True lie in each text."""
    out = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(mask[: off[-1]], off[full], dtype=np.int64)
    return out


def count_spans(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many True lie in each of ascending spans that aren't empty and don't overlap."""
    if not len(start):
        return np.zeros(0, np.int64)
    cuts = np.empty(2 * len(start), np.int64)
    cuts[0::2], cuts[1::2] = start, end
    return np.add.reduceat(np.r_[mask, False], cuts, dtype=np.int64)[0::2]


def count_before(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many True lie before each place."""
    places, which = np.unique(at, return_inverse=True)
    return np.cumsum(count_in(mask, np.r_[0, places]))[which]


def sum_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; each depends on its own rows only. Empty ranges give 0."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0)
    return out


def mean_by(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(off), 1)
    return sum_by(values, off) / (n if values.ndim == 1 else n[:, None])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to CHUNK of the base and of its inverse."""
    out = []
    for base in (_BASE, _INVERSE):
        t = np.full(CHUNK + 1, base, np.uint64)
        t[0] = 1
        out.append(np.cumprod(t))
    return out[0], out[1]


class SpanHash:
    """64-bit hashes of any spans of an array, bytes by default, from prefix sums that are made CHUNK elements at a time.

    Equal spans have equal hashes; different ones may have equal hashes too (this is a
    polynomial modulo 2**64), so whoever must tell them apart compares the spans.
    """

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        self.data, self.table = data, table
        self.whole = self._prefix(0) if len(data) <= CHUNK else None

    def _prefix(self, at: int) -> np.ndarray:
        part = self.data[at : at + CHUNK]
        out = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.table[part] * _tables()[0][: len(part)], out=out[1:])
        return out

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _tables()[1]
        if self.whole is not None:
            return (self.whole[end] - self.whole[start]) * inverse[start]
        out = np.empty(len(start), np.uint64)
        for a in range(0, len(start), CHUNK):
            out[a : a + CHUNK] = self._far(start[a : a + CHUNK], end[a : a + CHUNK])
        return out

    def _far(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high, unit = (np.zeros(len(start), np.uint64) for _ in range(3))
        sides = []
        for places, out in ((start, low), (end, high)):
            order = np.argsort(places, kind="stable")
            sides.append((places, out, order, places[order]))
        before = 0
        for at in range(int(start.min()) // CHUNK * CHUNK, int(end.max()) + 1, CHUNK):
            prefix = self._prefix(at)
            lift = pow(_BASE, at, 1 << 64)
            for k, (places, out, order, ascending) in enumerate(sides):
                a, b = np.searchsorted(ascending, (at, at + CHUNK))
                mine = order[a:b]
                inner = places[mine] - at
                out[mine] = prefix[inner] * _U(lift) + _U(before)
                if not k:
                    unit[mine] = _tables()[1][inner] * _U(pow(_INVERSE, at, 1 << 64))
            before = (before + int(prefix[-1]) * lift) % (1 << 64)
        return (high - low) * unit

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


def same_spans(data: np.ndarray, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether the elements of two lists of spans are equal, pair by pair."""
    size = e1 - s1
    same = size == e2 - s2
    for k in np.flatnonzero(same & (size > CHUNK // 16)).tolist():
        same[k] = np.array_equal(data[s1[k] : e1[k]], data[s2[k] : e2[k]])
    short = np.flatnonzero(same & (size > 0) & (size <= CHUNK // 16))
    cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size[short]) // (CHUNK // 4))) + 1, len(short)] if len(short) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        at = short[a:b]
        n = size[at]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        unequal = data[np.repeat(s1[at], n) + inner] != data[np.repeat(s2[at], n) + inner]
        same[at] = np.add.reduceat(unequal, ends - n, dtype=np.int64) == 0
    return same


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span, equal if and only if the spans are: for what hashes failed to tell apart."""
    raw, seen = data.tobytes(), {}
    return np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, group number of each ordered row, index in order of each group's first row."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def output(batch: pa.RecordBatch, keep: list[str], extra: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """The named columns of a batch and the new ones."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    new = [v if isinstance(v, pa.Array) else pa.array(v) for v in extra.values()]
    return pa.RecordBatch.from_arrays(cols + new, names=[*keep, *extra])
