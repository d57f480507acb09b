"""The stemmed passage queries against the unstemmed ones' SQL with a stemmer added to its tokens."""

import duckdb
import pytest

import __spark_entry__ as entry
from dossier.functions.porter import stem
from dossier.operators import hybrid
from dossier.plans import queries as words
from dossier.sources import testbed as tb

SF = "/root/testdata/sf0.001"
COUNCIL = "coalesce(lower(body) = 'council', false) and coalesce(meeting_date >= '2024-01-20', false)"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("conversations", "embeddings"):
        c.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    c.create_function("stems", lambda x: [stem(w) for w in x], ["VARCHAR[]"], "VARCHAR[]")
    return c


def same(con, got, sql):
    plain = words._tokens("text")
    assert plain in sql
    want = con.sql(sql.replace(plain, f"stems({plain})"))
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    shown = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    found = sorted(shown(dict(zip(want.columns, r))[n] for n in names) for r in want.fetchall())
    assert sorted(shown(r[n] for n in names) for r in got.collect()) == found
    return found


def expanded(word):
    return words._with(tb.TURNS_SQL, words._turn_hits(word, 40), words._expanded(40)) + "select passage_id, round(keyword_score, 6) as keyword_score from expanded"


def test_registered(spark, con):
    known = entry.queries()
    assert same(con, known["passage_neighbours"](spark, SF), expanded("rest"))
    assert same(con, known["passage_search"](spark, SF), words._hybrid_sql("rest", 10, 1.9))
    same(con, known["passage_filtered"](spark, SF), words._hybrid_sql("rest", 10, 1.9, COUNCIL))
    assert same(con, known["passage_vector_only"](spark, SF), words._hybrid_sql("qqq", 10, 1.9))
    assert not {"passage_neighbours", "passage_search", "passage_filtered", "passage_vector_only"} & set(entry.oracle_sql())


def test_inflected_forms_match(spark, con):
    """'eran' occurs as 'eranes' and 'eraned' too."""
    got = same(con, words._neighbours(spark, SF, "eraned", stemmed=True), expanded("eran"))
    assert len(got) > len(con.sql(expanded("eran")).fetchall())
    same(con, words._hybrid(spark, SF, "eranes", 10, 1.9, stemmed=True), words._hybrid_sql("eran", 10, 1.9))
    same(con, words._hybrid(spark, SF, "eran", 10, 1.9, hybrid.Filters(body="council", since="2024-01-20"), stemmed=True), words._hybrid_sql("eran", 10, 1.9, COUNCIL))
