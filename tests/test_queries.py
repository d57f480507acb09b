"""Every registered query that has SQL gives the SQL's rows."""

import importlib.util
import math
import sys

import duckdb
import pytest

from dossier.plans import passages, queries, records

CORE = queries.QUERIES | records.QUERIES
SQL = queries.ORACLES | records.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(records, names):
    return sorted((tuple(str(plain(r[n])) for n in names) for r in records))


@pytest.mark.parametrize("name", list(CORE))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = CORE[name](spark, SF)
    want = con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    found = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows([r.asDict() for r in got.collect()], names) == rows(found, names)


def test_entry_lists_queries_with_or_without_the_subpackage(monkeypatch):
    import __spark_entry__ as e

    alone = set(CORE) | set(passages.QUERIES)
    assert alone <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    for gone in ("dossier.llm", "ahocorasick"):  # the subpackage itself, or something that it imports
        with monkeypatch.context() as m:
            for name in [x for x in sys.modules if x == "corpus_pipeline" or x.startswith("dossier.llm")]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, gone, None)
            if gone == "ahocorasick" and importlib.util.find_spec("dossier.llm"):
                with pytest.warns(UserWarning, match="ahocorasick"):
                    assert set(e.queries()) == alone
            else:
                assert set(e.queries()) == alone


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
