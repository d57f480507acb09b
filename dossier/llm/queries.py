"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, language, mixing, quality_net, quality_rules, secrets, simhash, topk, url_filter, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _t(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.fit(documents, _t(spark, sf_dir, "labels")))


#: Names within the hosts whose pages, with all copies of them on other hosts, make up the list of blocked URLs in op2.
LISTED_NAMES = ("spam-farm", "casino-win", "free-bets", "ads-track", "cheap-pills", "adult-x")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    bad = F.arrays_overlap(F.split(url_filter.host(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_NAMES)))
    return url_filter.judge(pages, url_filter.with_mirrors(pages, bad)).drop("maybe_listed")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_t(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability", "unreached")})


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = bpe.round_trip(_t(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_t(spark, sf_dir, "documents"), secrets.compile_grammar(secrets.labelled_credentials()))

    def shown(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *map(of, secrets.BASE_KINDS), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _t(spark, sf_dir, "documents")
    return language.predict(documents, language.fit(documents))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.quantized(_t(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.labelled(_t(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _t(spark, sf_dir, "documents")
    return quality_net.score(documents, quality_net.fit(documents, _t(spark, sf_dir, "labels")))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_t(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_source_mixing": op3_source_mixing,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_exact_topk": op7_exact_topk,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc_revisits": op10_warc_revisits,
}

_OP2_SQL = f"""
with u as (
  select page_id, case when octet_length(encode(html)) >= 100 then sha256(html) end as digest, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), v as (
  select page_id, digest, rest,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as kept
  from u
), c as (
  select page_id, digest, host, path,
    case when host <> '' then regexp_replace(regexp_replace(host, ':[0-9]+$', ''), '^(www|m)\\.', '')
      || regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', '')
      || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical,
    case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
         when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
         when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from v
), b as (
  select canonical, digest, coalesce(list_has_any(string_split(host, '.'), {list(LISTED_NAMES)!r}), false) as bad from c where canonical is not null
), l as (
  select distinct canonical from b where bad or digest in (select digest from b where bad and digest is not null)
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict,
  canonical, listed
from (select c.*, l.canonical is not null as listed from c left join l on c.canonical = l.canonical)
"""

_OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e, row_number() over () as r
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.r, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 20 = 0
), k as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from k where rank <= 20
"""

_OP10_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first <> page_id then first end as refers_to
from f
"""

ORACLES: dict[str, str] = {"op2_url_filters": _OP2_SQL, "op3_source_mixing": mixing.oracle(), "op7_exact_topk": _OP7_SQL, "op10_warc_revisits": _OP10_SQL}
