"""Quality rules: counting rules, then a hashed n-gram logistic regression.

The base rules are exact counts over the whole text. The method's verdict comes from a
logistic regression on hashed word unigrams, word bigrams and character trigrams (each
kind averaged over the text), trained on a bounded sample of labelled rows, calibrated by
Platt scaling on a part of that sample that the weights don't see, and applied in Arrow
batches against a fixed threshold.

Defined cases: a null or empty text has no words, so base_failed is true and kept false.
A very long text is judged whole, wide intermediate arrays a piece at a time. Equal lines and
windows are told from others of the same hash by their bytes.
Rows are judged one by one: repeated rows and repeated ids each give a row. Columns other
than doc_id and text are ignored, whatever their names. An empty table gives no rows; with
no usable labels the model answers the prior probability, which keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textbatch as tb
from dossier.llm.linear import fit_sparse, platt, sigmoid
from dossier.llm.shared import training_rows

BITS, KINDS = 17, 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # kinds x 2**BITS
    bias: float
    slope: float
    shift: float


def features(t: tb.Texts, w: tb.Words, h: tb.SpanHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, buckets, text of each): words, pairs of words, then characters in threes a chunk at a time."""
    shift = np.uint64(64 - BITS)
    word, doc = h.raw(w.start, w.end), w.doc()
    yield 0, (tb.mix(word) >> shift).astype(np.int64), doc
    inside = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    pair = tb.mix(word[inside] * np.uint64(3) + word[inside + 1] * np.uint64(0x9E3779B97F4A7C15))
    yield 1, (pair >> shift).astype(np.int64), doc[inside]
    del word, pair, inside
    n = len(t.data)
    for a in range(0, n, tb.BLOCK_BYTES):
        part = t.data[a : a + tb.BLOCK_BYTES + 16]
        first = np.flatnonzero((part & 0xC0) != 0x80)
        k = int(np.searchsorted(first, tb.BLOCK_BYTES))
        edge = np.r_[first, [len(part)] * 3]
        text = np.searchsorted(t.off, first[:k] + a, side="right") - 1
        last = t.off[text + 1] - a
        ok = edge[2 : k + 2] < last  # the third character lies in the text too
        tri = tb.SpanHash(part)(first[:k][ok], np.minimum(edge[3 : k + 3], last)[ok])
        yield 2, (tri >> shift).astype(np.int64), text[ok]


def logits(model: Model, t: tb.Texts, w: tb.Words, h: tb.SpanHash) -> np.ndarray:
    total, count = np.zeros((KINDS, len(t))), np.zeros((KINDS, len(t)), np.int64)
    for kind, bucket, text in features(t, w, h):
        total[kind] += np.bincount(text, model.weights[kind][bucket], len(t))
        count[kind] += np.bincount(text, minlength=len(t))
    return model.bias + (total / np.maximum(count, 1)).sum(0)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample_rows` labelled rows whose crc32(doc_id) modulo 5 isn't 0; a quarter of them calibrates."""
    rows = training_rows(documents, labels, "quality", 5, 0, sample_rows, sample_bytes)
    return fit_texts(rows["text"].tolist(), rows["y"].to_numpy(float))


def fit_texts(texts: list[str], y: np.ndarray) -> Model:
    t_rows, t_cols, t_vals = [], [], []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    at = 0
    for _, t in tb.blocks([batch], "text"):
        found: list[list] = [[] for _ in range(KINDS)]
        for kind, bucket, text in features(t, tb.words(t), tb.SpanHash(t.data)):
            found[kind].append(text << BITS | bucket)
        for kind, parts in enumerate(found):
            key, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
            row = key >> BITS
            t_rows.append(row + at)
            t_cols.append((key & ((1 << BITS) - 1)) + (kind << BITS))
            t_vals.append(count / np.bincount(row, count, len(t))[row])
        at += len(t)
    rows, cols, vals = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((t_rows, int), (t_cols, int), (t_vals, float)))
    y = (np.asarray(y) > 0).astype(float)
    tune = np.arange(len(y)) % 4 == 3
    fit_on = ~tune[rows] if len(rows) else np.zeros(0, bool)
    number = np.cumsum(~tune) - 1
    weights, bias = fit_sparse(number[rows[fit_on]], cols[fit_on], vals[fit_on], y[~tune], KINDS << BITS)
    z = np.bincount(rows, vals * weights[cols], len(y)) + bias if len(y) else np.zeros(0)
    slope, shift = platt(z[tune], y[tune])
    return Model(weights.reshape(KINDS, -1).astype(np.float32), bias, slope, shift)


def _numbered(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A number for each pair, without hashing."""
    return np.unique(key * (int(more.max(initial=0)) + 1) + more, return_inverse=True)[1]


def _group_sizes(keys, check) -> tuple[np.ndarray, np.ndarray]:
    """Size of each element's group, and the first element of each group.

    keys: makers of group keys, the last an exact one; check(a, b) tells whether elements a and b are equal.
    """
    for make in keys:
        key = make()
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, group, first = tb.groups(key)
        size = np.diff(np.r_[first, len(key)])
        later = np.flatnonzero(size[group] > 1)
        if make is keys[-1] or all(check(order[x], order[first[group[x]]]).all() for x in (later[a : a + tb.BLOCK_BYTES] for a in range(0, len(later), tb.BLOCK_BYTES))):
            break
    out = np.empty(len(key), np.int64)
    out[order] = size[group]
    return out, order[first]


def base_counts(t: tb.Texts, w: tb.Words, h: tb.SpanHash) -> dict[str, np.ndarray]:
    data, n = t.data, np.diff(w.off)
    out = {"n_words": n.astype(np.int64), "word_chars": tb.count_in(~tb.SEPARATOR[data] & tb.char_starts(t), t.off), "n_symbols": tb.count_in(SYMBOLS[data], t.off)}
    spread = np.uint64(0xD6E8FEB86659FD93)

    line = tb.runs_of_lines(t)
    has = np.searchsorted(w.start, line.start) < np.searchsorted(w.start, line.end)
    doc = line.doc()[has]
    s, e = line.start[has], line.end[has]
    hashed = lambda: tb.mix(h(s, e) + doc.astype(np.uint64) * spread)
    exact = lambda: _numbered(doc, tb.exact_ids(data, s, e))
    size, first = _group_sizes((hashed, exact), lambda a, b: (doc[a] == doc[b]) & tb.same_spans(data, s[a], e[a], s[b], e[b]))
    out["n_dup_lines"] = np.bincount(doc[first], size[first] - 1, len(t)).astype(np.int64)

    wdoc = w.doc()
    at = np.flatnonzero(wdoc[2:] == wdoc[:-2])

    def windows() -> np.ndarray:
        word = h.raw(w.start, w.end)
        return tb.mix(tb.mix(word[at]) + tb.mix(word[at + 1] * np.uint64(3)) * np.uint64(5) + tb.mix(word[at + 2] * np.uint64(7)) + wdoc[at].astype(np.uint64) * spread)

    def exact_windows() -> np.ndarray:
        word = tb.exact_ids(data, w.start, w.end)
        return _numbered(_numbered(_numbered(wdoc[at], word[at]), word[at + 1]), word[at + 2])

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = wdoc[at[a]] == wdoc[at[b]]
        for k in range(3):
            x, y = at[a] + k, at[b] + k
            same &= tb.same_spans(data, w.start[x], w.end[x], w.start[y], w.end[y])
        return same

    hit = at[_group_sizes((windows, exact_windows), check)[0] > 1]
    repeated = np.zeros(len(wdoc), bool)
    for k in range(3):
        repeated[hit + k] = True
    out["n_repeat_words"] = tb.count_in(repeated, w.off)
    return out


def judge(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document with its base counts, base_failed, the model's score and kept."""
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # KINDS * 2**BITS numbers

    def run(batches):
        m = shipped.value
        for batch, t in tb.blocks(batches, "text"):
            w, h = tb.words(t), tb.SpanHash(t.data)
            base = base_counts(t, w, h)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            score = sigmoid(m.slope * logits(m, t, w, h) + m.shift)
            yield tb.output(batch, ["doc_id"], base | {"base_failed": failed, "kept": ~failed & (score >= threshold), "score": score})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
