"""Mixing: document probabilities raked to source, language and topic marginals, then sampling.

Documents fall into cells by source, language and topic. A target is a table of shares or an
exponent: shares in proportion to the tokens' own to that power, which tames a source that
holds most of them. A budget is the part of all tokens that the sample is to hold. Where a
target times the budget is more than a value's tokens, the value is wanted whole and the
others take the rest in proportion to their shares. Iterative proportional fitting then scales
the cells' probabilities, one dimension after the other, until the expected tokens of every
source, language and topic are those wanted; at each step a probability stays at most 1, and
the cells that aren't cut make up for those that are. What no probability can reach is told
by `unreached`: how far the expected share of a document's source, language or topic,
whichever lacks most, stays below its target. With a budget of None nothing is cut: it is the
largest budget at which all targets are reached.

A document is kept if a number from 0 to 1 made from the MD5 of its doc_id lies below its
probability, so the choice is the same at each run and in each engine. `weight` is the
probability over the budget.

Only counts by cell are gathered, pre-aggregated in each task. Up to `MAX_CELLS` cells are
raked on the driver and broadcast; more are raked as tables, and joined by shuffle with
salts. Both take the same steps; only the order in which sums are added up differs.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Topics are found by marks in the text.

Defined cases: a null source or language counts as the empty string; a null or wordless
text has topic `empty` and no tokens, and a cell without tokens has the probability that its
marginals leave it. A null doc_id counts as the empty string in the choice. Repeated rows
share one fate. Values that a target doesn't name keep their shares of what it leaves
(nothing left: probability 0). A very long text counts whole; ties can't arise. Other columns
may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Exponents that make the targets from the corpus's own shares.
POWERS = {"source": 0.5, "lang": 0.75, "topic": 0.5}
ROUNDS = 24
BUDGET = 0.5
MAX_CELLS = 200_000
_SALTS = 16

#: (topic, strings of which one marks it), the first that fits.
TOPICS = (("contact", ("@",)), ("licence", ("icense", "opyright")), ("table", (" | ", "\t")), ("markup", ("<", "{", "###", "***")))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    out = F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), "empty")
    for name, marks in TOPICS:
        found = F.instr(text, marks[0]) > 0
        for m in marks[1:]:
            found = found | (F.instr(text, m) > 0)
        out = out.when(found, name)
    return out.otherwise("prose")


def _keys() -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_mix_source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_mix_lang"), topic_of(F.col("text")).alias("_mix_topic")]


def tagged(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each document."""
    s, l, t = _keys()
    return documents.select("doc_id", s.alias("source"), l.alias("lang"), t.alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))


def target_shares(tokens: pd.Series, target) -> pd.Series:
    """Shares that add up to 1, by value. target: an exponent, or shares by value."""
    if not isinstance(target, dict):
        x = tokens.astype(float) ** target
        return x / x.sum() if x.sum() > 0 else x
    named = pd.Series({v: float(target.get(v, 0)) for v in tokens.index})
    rest = ~tokens.index.isin(list(target))
    left = max(0.0, 1 - sum(target.values()))
    own = tokens.where(rest, 0).astype(float)
    if own.sum() > 0:
        named += left * own / own.sum()
    return named / named.sum() if named.sum() > 0 else named


def wanted(tokens: np.ndarray, shares: np.ndarray, want: float) -> np.ndarray:
    """Tokens of each value: one factor times its share, at most what it has, together `want` if there are as many."""
    factor, cut = want, -1
    while True:
        over = factor * shares > tokens
        if over.sum() == cut:
            return np.where(shares > 0, np.minimum(tokens, factor * shares), 0.0)
        cut, rest = over.sum(), shares[~over].sum()
        factor = max(want - tokens[over].sum(), 0.0) / rest if rest > 0 else factor


def rake(cells: pd.DataFrame, targets=POWERS, rounds: int = ROUNDS, budget: float | None = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Probability and unreached share of cells (source, lang, topic, tokens)."""
    t = cells["tokens"].to_numpy(float)
    part, total = 1.0 if budget is None else min(budget, 1.0), t.sum()
    dims = []
    for d in DIMENSIONS:
        code, values = pd.factorize(cells[d])
        own = np.bincount(code, t, len(values))
        share = target_shares(pd.Series(own, index=values), targets[d]).to_numpy()
        dims.append((code, share, share * total if budget is None else wanted(own, share, part * total)))
    p = np.full(len(t), part)
    for _ in range(rounds):
        for code, _, want in dims:
            now = np.bincount(code, t * p, len(want))
            p = p * np.where(now > 0, want / np.where(now > 0, now, 1), 1)[code]
            p = p if budget is None else np.minimum(p, 1.0)
    if budget is None:
        some = (t > 0) & (p > 0)
        p = np.minimum(p / p[some].max(), 1.0) if some.any() else np.minimum(p, 1.0)
    mass = (t * p).sum()
    lacks = np.zeros(len(t))
    for code, share, _ in dims:
        lacks = np.maximum(lacks, (share - np.bincount(code, t * p, len(share)) / (mass or 1.0))[code])
    return p, lacks


def _rake_tables(cells: DataFrame, targets, rounds: int, budget: float | None) -> DataFrame:
    """As `rake`, for cells of any number, as tables: the columns p and lacks."""
    part = 1.0 if budget is None else min(budget, 1.0)
    now = written(cells.withColumn("p", F.lit(part)), "cells")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    want = {}
    for d in DIMENSIONS:
        own = now.groupBy(d).agg(F.sum("tokens").cast("double").alias("own"))
        target = targets[d]
        if isinstance(target, dict):
            named = F.lit(None).cast("double")
            for v, share in target.items():
                named = F.when(F.col(d) == v, float(share)).otherwise(named)
            own = written(own.withColumn("named", named), "targets")
            left = max(0.0, 1 - sum(target.values()))
            rest = float(own.where("named is null").agg(F.sum("own")).first()[0] or 0)
            own = own.withColumn("x", F.coalesce("named", F.col("own") * (left / rest if rest > 0 else 0.0)))
        else:
            own = own.withColumn("x", F.pow("own", F.lit(float(target))))
        whole = float(own.agg(F.sum("x")).first()[0] or 0)
        own = written(own.select(d, "own", (F.col("x") / (whole or 1.0)).alias("share")), "targets")
        factor, cut = part * total, -1
        while budget is not None:
            over = F.lit(factor) * F.col("share") > F.col("own")
            n, held, rest = own.agg(F.count_if(over), F.sum(F.when(over, F.col("own")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("share")))).first()
            if n == cut:
                break
            cut, factor = n, max(part * total - held, 0.0) / rest if rest else factor
        most = F.lit(factor) * F.col("share") if budget is None else F.least("own", F.lit(factor) * F.col("share"))
        want[d] = written(own.select(d, "share", F.when(F.col("share") > 0, most).otherwise(0.0).alias("want")), "targets")
    scaled = F.col("p") * F.col("by")
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("now")).join(want[d], d)
            by = sums.select(d, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("by"))
            now = now.join(by, d).select(*DIMENSIONS, "tokens", (scaled if budget is None else F.least(F.lit(1.0), scaled)).alias("p"))
        now = written(now, "cells")
    if budget is None:
        most = now.where("tokens > 0 and p > 0").agg(F.max("p")).first()[0]
        now = written(now.withColumn("p", F.least(F.lit(1.0), F.col("p") / F.lit(most or 1.0))), "cells")
    mass = float(now.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 1)
    lacks = F.lit(0.0)
    for d in DIMENSIONS:
        short = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("now")).join(want[d], d).select(d, (F.col("share") - F.col("now") / mass).alias(f"_{d}"))
        now = now.join(short, d)
        lacks = F.greatest(lacks, F.col(f"_{d}"))
    return now.select(*DIMENSIONS, "p", lacks.alias("lacks"))


def probabilities(tags: DataFrame, targets=POWERS, budget: float | None = BUDGET, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """_mix_source, _mix_lang, _mix_topic, _mix_p, _mix_lacks of each cell; whether it is small enough to broadcast."""
    spark = tags.sparkSession
    cells = written(tags.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    schema = ", ".join(f"_mix_{d} string" for d in DIMENSIONS) + ", _mix_p double, _mix_lacks double"
    if cells.limit(max_cells + 1).count() <= max_cells:
        got = cells.orderBy(*DIMENSIONS).toPandas()
        p, lacks = rake(got, targets, rounds, budget)
        rows = list(zip(got["source"], got["lang"], got["topic"], p.tolist(), lacks.tolist()))
        return spark.createDataFrame(rows, schema), True
    far = _rake_tables(cells, targets, rounds, budget)
    return written(far.toDF(*(x.split()[0] for x in schema.split(", "))), "cells"), False


def _with_cell(rows: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    on = [f"_mix_{d}" for d in DIMENSIONS]
    if small:
        return rows.join(F.broadcast(cells), on)  # at most max_cells rows
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_mix_salt")
    return rows.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")).join(cells.select("*", salts), [*on, "_mix_salt"]).drop("_mix_salt")


def chosen(doc_id: Column, p: Column) -> Column:
    u = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return u < p


def mix(documents: DataFrame, targets=POWERS, budget: float | None = BUDGET, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, unreached, kept for each document."""
    tags = written(tagged(documents), "tags")
    cells, small = probabilities(tags, targets, budget, rounds, max_cells)
    keyed = tags.select("doc_id", "n_tokens", *(F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS))
    p = F.col("_mix_p")
    return _with_cell(keyed, cells, small).select(
        "doc_id", *(F.col(f"_mix_{d}").alias(d) for d in DIMENSIONS), "n_tokens", (p / F.lit(1.0 if budget is None else float(budget))).alias("weight"), p.alias("probability"), F.col("_mix_lacks").alias("unreached"), chosen(F.col("doc_id"), p).alias("kept")
    )


def sample(documents: DataFrame, targets=POWERS, budget: float | None = BUDGET, rounds: int = ROUNDS, max_cells: int = MAX_CELLS) -> DataFrame:
    """The documents kept, all columns."""
    cells, small = probabilities(tagged(documents), targets, budget, rounds, max_cells)
    out = _with_cell(documents.select("*", *_keys()), cells, small)
    return out.where(chosen(F.col("doc_id"), F.col("_mix_p"))).select(*documents.columns)


def oracle(targets=POWERS, budget: float = BUDGET, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for `mix` with exponents as targets, rounded to six decimals."""

    def topic() -> str:
        cases = " ".join("when " + " or ".join(f"contains(text, '{m}')" if m != "\t" else "contains(text, chr(9))" for m in marks) + f" then '{name}'" for name, marks in TOPICS)
        return f"case when text is null or not regexp_matches(text, '{WORD}') then 'empty' {cases} else 'prose' end"

    short = {"source": "s", "lang": "l", "topic": "t"}
    steps = [
        f"d as materialized (select doc_id, coalesce(source, '') as s, coalesce(lang, '') as l, {topic()} as t, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as n from documents)",
        f"c0 as materialized (select s, l, t, sum(n)::double as k, {budget}::double as w from d group by all)",
    ]
    for d, c in short.items():
        # A value with more wanted than it has is taken whole; the values ascend by how much they have for a unit of their share.
        steps.append(f"t_{c} as materialized (select {c}, own, x / sum(x) over () as share from (select {c}, sum(k) as own, pow(sum(k), {targets[d]}) as x from c0 group by {c}))")
        steps.append(f"o_{c} as materialized (select own, share, {budget} * (select sum(k) from c0) - (sum(own) over z - own) as lft, sum(share) over () - (sum(share) over z - share) as rest, row_number() over (order by own / share, {c}) as r from t_{c} where share > 0 window z as (order by own / share, {c} rows unbounded preceding))")
        steps.append(f"want_{c} as materialized (select {c}, share, case when share > 0 then least(own, coalesce((select lft / rest from o_{c} where lft / rest * share <= own order by r limit 1) * share, own)) else 0 end as want from t_{c})")
    n = 0
    for _ in range(rounds):
        for c in short.values():
            steps.append(f"c{n + 1} as materialized (select q.s, q.l, q.t, q.k, least(1.0, q.w * case when q.cur > 0 then g.want / q.cur else 1 end) as w from (select *, sum(k * w) over (partition by {c}) as cur from c{n}) q join want_{c} g on q.{c} = g.{c})")
            n += 1
    lacks = ", ".join(f"g_{c}.share - sum(k * w) over (partition by q.{c}) / nullif(sum(k * w) over (), 0)" for c in short.values())
    joins = " ".join(f"join want_{c} g_{c} on q.{c} = g_{c}.{c}" for c in short.values())
    steps.append(f"p as (select q.s, q.l, q.t, w as p, greatest(0.0, {lacks}) as lacks from c{n} q {joins})")
    return (
        "with " + ",\n".join(steps) + "\nselect doc_id, d.s as source, d.l as lang, d.t as topic, n as n_tokens, "
        f"round(p / {budget}, 6) as weight, round(p, 6) as probability, round(lacks, 6) as unreached, "
        "cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 < p as kept from d join p on d.s = p.s and d.l = p.l and d.t = p.t"
    )
