"""Language identification by rank-order n-gram profiles.

Texts are lower-cased and cut into words of letters, a mark on each side. A profile lists
the most frequent 1- to 3-grams of a text, ties by their code points. A language's profile
comes from its training documents together. A document's distance to a language is the sum,
over its own profile, of how far each n-gram is out of place in the language's; one that the
language lacks counts as the profile's length. The nearest language is the answer, ties to
the smaller name. The score is the softmax share of the nearest distance, in units of a
hundredth of the greatest possible one.

Only text and non-null lang of rows whose crc32(doc_id) modulo 4 isn't 2 are learned from:
of each language the documents whose hash of doc_id lies below a share of its row count, about
SAMPLE_ROWS, whatever the language's size. There is no bound on languages: profiles are a
table in the shared folder, and each worker reads them in parts of about PART_LANGUAGES.

Defined cases: a null text, one without letters, and every text if no language was learned,
is `und` with score 0. A very long text is identified whole; those over SAMPLE_TEXT_BYTES
aren't learned from. N-grams of equal counts rank by code points, languages at equal distance
by name. Repeated rows each give a row and are learned from once, by the smallest text of a
language and doc_id. Rows with a null doc_id aren't learned from. Columns other than doc_id,
text and lang are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import textbatch as tb
from dossier.llm.bpe import LETTER, _code_tables, _texts
from dossier.llm.shared import scratch, written

FOLDS, HELD_OUT = 4, 2
PROFILE = 300
#: Training documents of a language, about; bytes of one of them, at most.
SAMPLE_ROWS = 400
SAMPLE_TEXT_BYTES = 1 << 20
#: Languages, about, whose profiles a worker holds at once.
PART_LANGUAGES = 2000
#: Languages up to which their row counts are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 1 << 20
NONE = "und"
#: Stands between words; no letter, and not 0, so that n-grams of different length differ as numbers.
MARK = 1
#: Characters of a text whose n-grams are counted at once.
GRAM_CHARS = 1 << 20

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Part:
    """Profiles of some languages, by n-gram: grams ascend; those of grams[i] lie at off[i] to off[i + 1] of lang and rank."""

    names: list[str]
    grams: np.ndarray
    off: np.ndarray
    lang: np.ndarray
    rank: np.ndarray


def part_of(names: list[str], gram: np.ndarray, rank: np.ndarray) -> Part:
    """From rows (language, n-gram, place in its profile)."""
    known = sorted(set(names))
    number = {n: k for k, n in enumerate(known)}
    lang = np.fromiter((number[n] for n in names), np.int64, len(names))
    order = np.lexsort((lang, gram))
    every, first = np.unique(gram[order], return_index=True)
    return Part(known, every, np.r_[first, len(gram)], lang[order], rank[order])


@dataclass(frozen=True)
class Model:
    """A table of profiles below a path in numbered folders; an empty path for none."""

    path: str
    parts: int


def marked(text: str) -> np.ndarray:
    """Lower-cased letters of a text, a MARK between words and at both ends; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _code_tables()[0][codes] == LETTER
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, codes, MARK)[keep].astype(np.uint32)
    return np.concatenate([[MARK], c, [MARK]] if letter[-1] else [[MARK], c]).astype(np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """The 1- to 3-grams that start in marked letters, 21 bits a code point."""
    c = c.astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    return np.concatenate([c[c != MARK], two, (two[:-1] << 21 | c[2:])[c[1:-1] != MARK]])


def text_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text, ascending, and their counts; of a very long text a piece at a time."""
    c = marked(text)
    if len(c) <= GRAM_CHARS + 2:
        return counted(grams(c))
    keys, total = counted(grams(c[: GRAM_CHARS + 2]))
    for a in range(GRAM_CHARS, len(c) - 2, GRAM_CHARS):
        part = c[a : a + GRAM_CHARS + 2]
        more, n = counted(grams(part))
        again, m = counted(grams(part[:2]))  # what starts in the shared two was counted before
        n[np.searchsorted(more, again)] -= m
        every, which = np.unique(np.concatenate([keys, more]), return_inverse=True)
        keys, total = every, np.bincount(which, np.concatenate([total, n]), len(every)).astype(np.int64)
    some = total > 0
    return keys[some], total[some]


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[start], np.diff(np.r_[start, len(g)])


def profile(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties to the smaller."""
    if len(keys) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= cut
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")][:size]  # keys ascend


def part_from_texts(texts: dict[str, list[str]]) -> Part:
    names, lists = [], []
    for name in sorted(texts):
        keys, counts = counted(np.concatenate([grams(marked(x)) for x in texts[name]] or [np.zeros(0, np.int64)]))
        best = profile(keys, counts)
        names += [name] * len(best)
        lists.append(best)
    return part_of(names, np.concatenate(lists) if lists else np.zeros(0, np.int64), np.concatenate([np.arange(len(x)) for x in lists]) if lists else np.zeros(0, np.int64))


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, part_languages: int = PART_LANGUAGES) -> Model:
    """Profiles from about `sample_rows` documents a language."""
    spark = documents.sparkSession
    usable = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    )
    # A row a language: its rows are counted in each task first, so its size makes no task large.
    sizes = written(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = usable.join(sizes, "lang").where(number < sample_rows / F.col("_rows")).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        """A task's n-gram counts by language."""
        for batch, t in tb.blocks(batches, "text"):
            held: dict[str, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), _texts(t)):
                held.setdefault(name, []).append(grams(marked(text)))
            for name, parts in held.items():
                keys, counts = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    totals = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < PROFILE)
    path = scratch(spark, "profiles")
    best.select("lang", "gram", "rank").write.mode("overwrite").parquet(f"{path}/all")
    profiles = spark.read.schema("lang string, gram long, rank int").parquet(f"{path}/all")
    languages = profiles.where("rank = 0").count()
    parts = math.ceil(languages / part_languages)
    if not parts:
        return Model("", 0)
    numbered = profiles.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(parts)).cast("int"))
    numbered.repartition(parts, "part").write.partitionBy("part").parquet(f"{path}/parts")
    return Model(f"{path}/parts", parts)


@lru_cache(maxsize=1)
def _load(path: str, part: int) -> Part | None:
    files, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/part={part}"
    infos = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = sorted(i.path for i in infos if i.path.endswith(".parquet"))
    if not names:
        return None
    t = pa.concat_tables([pq.ParquetFile(files.open_input_file(f)).read(columns=["lang", "gram", "rank"]) for f in names])
    return part_of(t["lang"].to_pylist(), t["gram"].to_numpy(), t["rank"].to_numpy().astype(np.int64))


def distances(own: np.ndarray, p: Part) -> np.ndarray:
    """Out-of-place distance of a profile to each language of a part."""
    at = np.minimum(np.searchsorted(p.grams, own), len(p.grams) - 1)
    place = np.flatnonzero(p.grams[at] == own)
    low, n = p.off[at[place]], np.diff(p.off)[at[place]]
    ends = np.cumsum(n)
    hit = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
    saved = PROFILE - np.abs(p.rank[hit] - np.repeat(place, n))
    return len(own) * PROFILE - np.bincount(p.lang[hit], saved, len(p.names)).astype(np.int64)


def nearest(profiles: list[np.ndarray], parts: Iterable[Part]) -> list[tuple[str, float]]:
    """The nearest language of each profile, and its softmax share; parts are seen one after the other."""
    best: list[tuple[int, str] | None] = [None] * len(profiles)
    share = [0.0] * len(profiles)  # sum of exp(-(distance - best distance) / unit)
    for p in parts:
        for k, own in enumerate(profiles):
            if not len(own):
                continue
            far, unit = distances(own, p), len(own) * PROFILE / 100
            i = int(np.argmin(far))
            before, here = best[k], (int(far[i]), p.names[i])
            now = here if before is None else min(before, here)
            share[k] = (share[k] * math.exp((now[0] - before[0]) / unit) if before else 0.0) + float(np.exp((now[0] - far) / unit).sum())
            best[k] = now
    return [(b[1], 1 / s) if b else (NONE, 0.0) for b, s in zip(best, share)]


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""

    def run(batches):
        for batch, t in tb.blocks(batches, "text"):
            own = [profile(*text_grams(x)) for x in _texts(t)]
            found = nearest(own, filter(None, (_load(model.path, k) for k in range(model.parts))))
            yield tb.output(batch, ["doc_id", "held_out"], {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"))
    return ready.mapInArrow(run, SCHEMA)
