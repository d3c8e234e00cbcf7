import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import recall as q

DOCS = [
    ("d0", "needle in a haystack", "the channel has a threshold of ninety; foo_bar stays", "tool"),
    ("d1", "Qualità della configurazione", "piu velocita e qualita, GRÜN", "pattern"),
    ("d2", "filler one", "nothing to see in the channel channel channel", None),
    ("d3", "foo baz bar", "snapshot of the threshold", "decision"),
    ("d4", "", None, None),
    ("d5", "café Ångström", "naïve façade; channel", "warning"),
    ("d6", "filler two", "words and words and more words without any hit", None),
]


def fts(query, combine):
    """The same ranking by SQLite's full-text index."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, body, category, tokenize='unicode61 remove_diacritics 2')")
    for i, (_, *cells) in enumerate(DOCS):
        con.execute("insert into t(rowid, title, body, category) values (?, ?, ?, ?)", (i, *cells))
    match = f" {combine} ".join(f'"{w}"' for w in q.terms_of(query))
    return {DOCS[i][0]: -s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}


@pytest.mark.parametrize(
    "query,combine",
    [("channel threshold", "AND"), ("channel threshold", "OR"), ("qualita", "AND"), ("GRUN cafe", "OR"), ("foo_bar", "AND"), ("words words", "OR"), ("zzz", "AND"), ("filler channel words", "OR"), ("the", "OR")],
)
def test_bm25_against_sqlite(spark, query, combine):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string, category string")
    got = {r.id: r.bm25 for r in q.bm25(docs, "id", F.concat_ws(" ", "title", "body", "category"), query, combine).collect()}
    want = fts(query, combine)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_fusion_and_its_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, place int")
    got = q.rrf({"bm25": ranked(["n1", "n2", "n3"]), "entities": ranked(["n2"])}).orderBy(F.col("score").desc(), "stream", "place", "id").collect()
    assert [r.id for r in got] == ["n2", "n1", "n3"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    tie = q.rrf({"b": ranked(["x"]), "a": ranked(["y"])}).orderBy(F.col("score").desc(), "stream", "place", "id").collect()
    assert [r.id for r in tie] == ["y", "x"]


EPISODES = "id string, project_id string, kind string, title string, body string, category string, confidence double, created_at double, entities array<string>, pinned boolean, expires_at double"


def rows(spark):
    base = [(f"f{i}", "p", "working", f"filler {i}", "nothing here", None, 0.5, float(i), [], False, None) for i in range(6)]
    return spark.createDataFrame(
        [
            *base,
            ("e", "p", "semantic", "about engines", "text", "tool", 0.9, 50.0, ["GapEngine", "GapStore"], False, None),
            ("gone", "p", "working", "gap", "gap", None, 0.9, 60.0, ["GapX"], False, 10.0),
            ("kept", "p", "working", "gap", "other", None, 0.9, 61.0, ["GapX"], True, 10.0),
            ("other", "P2", "working", "gap gap gap", "gap", None, 0.1, 62.0, None, None, None),
        ],
        EPISODES,
    )


def test_recall_streams_filters_and_guards(spark):
    e = rows(spark)
    got = [r.id for r in q.recall(e, "gap", 100.0, limit=10).collect()]
    assert set(got) == {"e", "kept", "other"}  # expired ones only where pinned; an entity alone is enough
    assert q.entity_hits(e, "gap", q.visible(100.0)).where("id = 'e'").count() == 2  # a row for each entity
    assert [r.id for r in q.authority_hits(e, "gap", q.visible(100.0)).collect()] == ["kept"]
    assert {r.id for r in q.recall(e, "gap", 100.0, limit=10, project_id="P2").collect()} == {"other"}
    assert {r.id for r in q.recall(e, "gap", 100.0, limit=10, min_confidence=0.5, since=55.0).collect()} == {"kept"}
    assert [r.term for r in q.gaps(e.where("id = 'e'"), "engines gap missing x").collect()] == ["missing"]
    for bad in ("", " ?! "):
        with pytest.raises(ValueError):
            q.recall(e, bad, 100.0)
    for how in ({"kind": "none"}, {"combine": "XOR"}, {"limit": 0}, {"limit": 51}):
        with pytest.raises(ValueError):
            q.recall(e, "gap", 100.0, **how)
    assert q.recall(e, "gap) OR \"drop\" NEAR(", 100.0).count() >= 0
    assert q.recall(e.where("false"), "gap", 100.0).count() == 0


def test_inverted_index(spark):
    docs = spark.createDataFrame([("a", "Uno due uno"), ("b", None), ("c", "")], "id string, t string")
    assert {(r.term, r.id, r.tf, tuple(r.positions)) for r in q.inverted_index(docs, "id", F.col("t")).collect()} == {("uno", "a", 2, (0, 2)), ("due", "a", 1, (1,))}


def text():
    return F.concat_ws(" ", "title", "body", "category")


def test_the_index_is_kept_up_by_id(spark, tmp_path):
    schema = "id string, title string, body string, category string"
    index = q.SearchIndex(spark, str(tmp_path / "index"), buckets=8).refresh(spark.createDataFrame(DOCS, schema), "id", text())
    index.refresh(spark.createDataFrame([("d2", "channel", "of needles", None), ("d9", "new channel", "foo_bar again", "x")], schema), "id", text())
    index.refresh(spark.createDataFrame([("d2", "threshold", "again and again", None)], schema), "id", text(), removed=spark.createDataFrame([("d0",), ("nowhere",)], "id string"))
    # A refresh that broke off before its statistics leaves rows that count for nothing.
    spark.createDataFrame([("d1", 99, 3)], "id string, length int, generation int").write.mode("append").parquet(str(tmp_path / "index" / "lengths"))
    spark.createDataFrame([("d1", 3)], "id string, before int").write.mode("append").parquet(str(tmp_path / "index" / "superseded"))
    index.refresh(spark.createDataFrame([("d2", "threshold", "again and again", None)], schema), "id", text())
    left = [d for d in DOCS if d[0] not in ("d0", "d2")] + [("d2", "threshold", "again and again", None), ("d9", "new channel", "foo_bar again", "x")]
    fresh = spark.createDataFrame(left, schema)
    again = q.SearchIndex(spark, str(tmp_path / "index"), buckets=8)
    assert again.totals() == q.SearchIndex(spark, str(tmp_path / "fresh")).refresh(fresh, "id", text()).totals()
    for query, combine in [("channel threshold", "OR"), ("foo_bar", "AND"), ("again needle", "OR"), ("qualita", "AND")]:
        got = {r.id: round(r.bm25, 9) for r in q.bm25_of(again, query, combine).collect()}
        assert got == {r.id: round(r.bm25, 9) for r in q.bm25(fresh, "id", text(), query, combine).collect()}


def test_a_search_reads_its_own_buckets(spark, tmp_path):
    index = q.SearchIndex(spark, str(tmp_path), buckets=8).refresh(spark.createDataFrame(DOCS, "id string, title string, body string, category string"), "id", text())
    plan = index.postings(["channel"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan and "PushedFilters" in plan
    assert len({r[0] for r in index.postings(["channel"]).selectExpr("input_file_name()").collect()}) == 1


def test_text_and_query_fold_alike(spark):
    docs = spark.createDataFrame([("a", "Новый йогурт"), ("b", "tiếng việt"), ("c", "città")], "id string, t string")
    for query, want in [("йогурт", "a"), ("иогурт", "a"), ("tiếng", "b"), ("tieng", "b"), ("citta", "c"), ("CITTÀ", "c"), ("citta\u0300", "c")]:
        assert {r.id for r in q.bm25(docs, "id", F.col("t"), query).collect()} == {want}


def test_all_words_first_then_any(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three")], "id string, t string")
    search = lambda query: lambda combine: q.bm25(docs, "id", F.col("t"), query, combine)
    ids = lambda query: {r.id for r in q.answered(search(query), query).collect()}
    assert ids("one two") == {"a"} and ids("one three") == {"a", "b"} and ids("zzz") == set()
