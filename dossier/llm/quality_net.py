"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Texts are cut into tokens: runs of letters, digits and bytes over 127, and runs of other
visible characters. Random indexing gives each token a sparse ternary index vector made
from its hash; a token's vector is its index vector plus those of its neighbours, summed
over a bounded sample of training texts and scaled to unit length. Tokens that the sample
doesn't hold take the vector learned for their shape (letter case, digits, length).
A document's features are the mean of its token vectors, of their squares, of the products
of neighbours and of the neighbours' cosines, the share of neighbours with one index
vector, the mean vector's squared length, and the logarithm of the token count. A network with one hidden layer,
in numpy, gives a logit, and a temperature fitted on rows that its weights don't see makes
it a probability.

Defined cases: a null or empty text has zero features and gets the network's answer to
those. A very long text is pooled whole, a piece at a time. Repeated rows and ids each give a row. Columns other than doc_id and text are
ignored, whatever their names. An empty table gives no rows; with labels of one class or
none the score is the prior probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import textbatch as tb
from dossier.llm.linear import sigmoid
from dossier.llm.shared import training_rows

DIMS = 32
NONZERO = 4
TABLE_BITS = 15
SHAPES = 64
HIDDEN = 24
WINDOW = 2
#: Tokens whose vectors are held at once.
TOKENS = 1 << 16
FOLDS, HELD_OUT = 5, 0
#: Labelled rows that vectors and network are fitted on, at most.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16 << 20
THRESHOLD = 0.3

KIND = np.zeros(256, np.uint8)  # 1: letters and digits, 2: other visible characters
KIND[33:127] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
UPPER, DIGIT = (np.zeros(256, bool) for _ in range(2))
UPPER[65:91] = True
DIGIT[48:58] = True

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # 2**TABLE_BITS + SHAPES rows
    known: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def tokens(t: tb.Texts) -> tb.Words:
    kind = KIND[t.data]
    n = len(kind)
    if not n:
        return tb.runs(np.zeros(0, bool), t.off)
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    heads = t.off[:-1]
    change[heads[heads < n]] = True
    start = np.flatnonzero(change)
    end = np.r_[start[1:], n]
    real = kind[start] > 0
    start, end = start[real], end[real]
    return tb.Words(start, end, np.searchsorted(start, t.off))


def rows_of(t: tb.Texts, w: tb.Words, h: tb.SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Row of the table for each token, and its row for the token's shape."""
    row = (h(w.start, w.end) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    size = w.end - w.start

    def share(table: np.ndarray) -> np.ndarray:
        k = tb.count_spans(table[t.data], w.start, w.end)
        return (k > 0).astype(np.int32) + ((k == size) & (size > 1))

    word = KIND[t.data[w.start]] == 1
    shape = np.minimum(np.maximum(size, 1), 12) // 4 + 4 * share(UPPER) + 12 * share(DIGIT)
    return row, np.where(word, shape, 40 + np.minimum(size, 20)).astype(np.int32) + (1 << TABLE_BITS)


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.zeros(((1 << TABLE_BITS) + SHAPES, DIMS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIMS, len(out))] += rng.choice(np.float32([-1, 1]), len(out))
    return out


def train_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    index = index_vectors()
    context = np.zeros_like(index)
    seen = np.zeros(len(index), bool)
    for _, t in tb.blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], "text"):
        w = tokens(t)
        row, shape = rows_of(t, w, tb.SpanHash(t.data))
        doc = w.doc()
        for a in (row, shape):
            seen[a] = True
            for d in range(1, WINDOW + 1):
                near = np.flatnonzero(doc[d:] == doc[:-d]) if len(doc) > d else []
                if len(near):
                    for x, y in ((near, near + d), (near + d, near)):
                        key, inverse = np.unique(a[x], return_inverse=True)
                        for j in range(DIMS):
                            context[key, j] += np.bincount(inverse, index[row[y], j])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = context / np.maximum(norm, 1e-9) + 0.5 * index / 2
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32), seen


def pooled(vectors: np.ndarray, known: np.ndarray, t: tb.Texts) -> np.ndarray:
    """Features of each text; token vectors are held TOKENS at a time."""
    w = tokens(t)
    row, shape = rows_of(t, w, tb.SpanHash(t.data))
    n, doc = np.diff(w.off), w.doc()
    mean, square, near = (np.zeros((len(t), DIMS)) for _ in range(3))
    same = np.zeros(len(t))
    for a in range(0, len(row), TOKENS):
        part = slice(a, a + TOKENS + 1)  # and the next chunk's first
        v = vectors[np.where(known[row[part]], row[part], shape[part])]
        size = min(TOKENS, len(row) - a)
        off = np.clip(w.off, a, a + size) - a
        mean += tb.sum_by(v[:size].astype(np.float64), off)
        square += tb.sum_by((v[:size] * v[:size]).astype(np.float64), off)
        both = (v[:-1] * v[1:]).astype(np.float64)
        inside = doc[part][:-1] == doc[part][1:]
        both[~inside] = 0
        one = (row[part][:-1] == row[part][1:]) & inside  # one index vector
        if len(both) < size:
            both, one = np.r_[both, np.zeros((1, DIMS))], np.r_[one, False]
        near += tb.sum_by(both, off)
        same += tb.sum_by(one.astype(np.float64), off)
    m = np.maximum(n, 1)[:, None]
    mean, square, near = mean / m, square / m, near / m
    parts = [mean, square, near, near.sum(1)[:, None], same[:, None] / m, (mean * mean).sum(1)[:, None], np.log1p(n)[:, None] / 10, (n == 0)[:, None]]
    return np.concatenate(parts, axis=1).astype(np.float64)


def _forward(m: Model, x: np.ndarray) -> np.ndarray:
    # row by row sums, so that a document's score doesn't depend on its batch
    hidden = np.tanh(np.einsum("ij,jk->ik", (x - m.center) / m.scale, m.w1) + m.b1)
    return np.einsum("ij,j->i", hidden, m.w2) + m.b2


def fit_texts(texts: list[str], y: np.ndarray, steps: int = 400) -> Model:
    y = (np.asarray(y) > 0).astype(float)
    vectors, known = train_vectors(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [pooled(vectors, known, t) for _, t in tb.blocks([batch], "text")]
    x = np.concatenate(parts) if parts else np.zeros((0, 3 * DIMS + 5))
    width = x.shape[1]
    prior = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3))
    center, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    rng = np.random.default_rng(5)
    p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(prior / (1 - prior)))]
    if len(y) < 8 or y.min() == y.max():
        return Model(vectors, known, center, scale, p[0], p[1], np.zeros(HIDDEN), float(p[3]), 1.0)
    tune = np.arange(len(y)) % 4 == 3
    z, target = ((x - center) / scale)[~tune], y[~tune]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        hid = np.tanh(z @ p[0] + p[1])
        d = (sigmoid(hid @ p[2] + p[3]) - target) / len(target)
        back = np.outer(d, p[2]) * (1 - hid * hid)
        grads = [z.T @ back + 1e-3 * p[0], back.sum(0), hid.T @ d + 1e-3 * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    out = Model(vectors, known, center, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    logit, truth = _forward(out, x[tune]), y[tune]
    grid = np.exp(np.linspace(-1.5, 2.0, 71))  # temperatures 0.22 to 7.4
    loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / g)) for g in grid]
    return Model(vectors, known, center, scale, p[0], p[1], p[2], float(p[3]), float(grid[int(np.argmin(loss))]))


def score_texts(m: Model, t: tb.Texts) -> np.ndarray:
    return sigmoid(_forward(m, pooled(m.vectors, m.known, t)) / m.temperature)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample_rows` labelled rows whose crc32(doc_id) modulo 5 isn't 0."""
    rows = training_rows(documents, labels, "quality", FOLDS, HELD_OUT, sample_rows, sample_bytes)
    return fit_texts(rows["text"].tolist(), rows["y"].to_numpy(float))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches):
        for batch, t in tb.blocks(batches, "text"):
            p = score_texts(shipped.value, t)
            yield tb.output(batch, ["doc_id", "held_out"], {"score": p, "predicted": (p >= threshold).astype(np.int32)})

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"))
    return ready.mapInArrow(run, SCHEMA)


def accept(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the model doesn't reject."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, t in tb.blocks(batches, "text"):
            yield batch.filter(pa.array(score_texts(shipped.value, t) >= threshold))

    return documents.mapInArrow(run, documents.schema)
