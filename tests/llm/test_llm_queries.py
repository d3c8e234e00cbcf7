import duckdb
import pytest

from sessionloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    df = q.queries()[name](spark, data)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if sql := q.oracle_sql().get(name):
        con = duckdb.connect()
        con.sql("set timezone='UTC'")
        for t in ("transcript_lines", "size_limits", "sessions", "episodes", "projects", "documents", "mix_targets"):
            con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
        assert sorted(repr([plain(v) for v in r]) for r in rows) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_split_documents_are_those_above_the_capacity(spark, data):
    from sessionloom.llm import tokens
    from sessionloom.runtime import table

    sizes = tokens.sized(table(spark, data, "documents"), "text", ["doc_id"])
    assert {r.doc_id for r in q.p8_found(spark, data).collect()} == {r.doc_id for r in sizes.where("n_tokens > 4096").collect()}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, empty, name):
    n = q.queries()[name](spark, empty).count()
    assert n == {"p8_usage": 1, "p8_invariants": 1, "p9_shares": 10, "p9_invariants": 10}.get(name, 0)
