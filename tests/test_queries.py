"""All named queries run, and equal their SQL where they have one."""

import importlib.util
import math
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sessionloom.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in sorted(Path(data).glob("*.parquet")):
        con.sql(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, db, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if sql := registry.oracle_sql().get(name):
        want = db.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.startswith("p") and n[1].isdigit()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_heuristic_entities_equal_brute_force(spark, tmp_path):
    from sessionloom.functions.text import STOPWORDS
    from sessionloom.plans import views

    kinds = (r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b", r"\b([A-Z][a-zà-ú]{2,}(?:\s+[A-Z][a-zà-ú0-9]{2,}){1,3})\b", r"\b([A-Z][A-Z0-9]{2,})\b")
    texts = [("Der Lauf", "GapEngine on Main Street with HTTP"), ("Die Ursache", None), ("main street", "no names"), ("Alpha Beta", "Gamma Delta Epsilon, ALPHA BETA, OneTwo ThreeFour SQL API")]
    cols = {"id": "string", "project_id": "string", "title": "string", "body": "string", "updated_at": "double"}
    want = {}
    for i, (title, body) in enumerate(texts):
        first = {}
        for k in kinds:
            for s in re.findall(k, f"{title}\n{body or ''}"):
                if len(s) >= 3 and not set(re.split(r"\s+", s.lower())) & set(STOPWORDS):
                    first.setdefault(s.lower(), s)
        if names := sorted(first.values(), key=lambda s: (-len(s), s))[:5]:
            want[str(i)] = names
    rows = spark.createDataFrame([(str(i), "p", t, b, 1.0) for i, (t, b) in enumerate(texts)], ", ".join(f"{k} {v}" for k, v in cols.items()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(views, "episodes", lambda spark, d: rows)
        got = {r.id: r.entities.split("|") for r in registry.queries()["heuristic_entities"](spark, "").collect()}
    assert got == want and "Main Street" in got["0"] and got["1"] == ["Die Ursache"] and "2" not in got


def test_entry(spark):
    names = entry.queries()
    assert registry.queries().keys() <= names.keys() and entry.oracle_sql().keys() <= names.keys()
    assert (importlib.util.find_spec("sessionloom.llm") is not None) == any(n.startswith("p2_") for n in names)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["id", "project_id", "kind", "title", "preview", "score"]


def test_nothing_else_imports_the_llm_folder():
    package = Path(registry.__file__).resolve().parent.parent
    for f in package.rglob("*.py"):
        if "llm" not in f.relative_to(package).parts:
            assert "sessionloom.llm" not in f.read_text(), f
