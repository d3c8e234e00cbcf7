from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.operators import ordering
from sessionloom.operators import timestamps as ts

ROME = "Europe/Rome"
CASES = [
    ("2026-01-17T23:04:06.008Z", None, "2026-01-17 23:04:06.008000", "iso"),
    ("  2026-01-17T23:04:06Z\t", ROME, "2026-01-17 23:04:06.000000", "iso"),
    ("2025-10-26T11:14:19.200", ROME, "2025-10-26 10:14:19.200000", "iso"),
    ("2026-03-29T03:14:49.294537+02:00", ROME, "2026-03-29 01:14:49.294537", "iso"),
    ("2025-10-09T05:24:28.251388405Z", None, "2025-10-09 05:24:28.251388", "iso"),
    ("2026-04-17 18:27:10+0200", None, "2026-04-17 16:27:10.000000", "iso"),
    ("2025-12-10 20:20:17,078", "UTC", "2025-12-10 20:20:17.078000", "iso"),
    ("2026-02-05 20:25:05 +05:30", None, "2026-02-05 14:55:05.000000", "iso"),
    ("2026-03-28 22:39:30 CET", None, "2026-03-28 21:39:30.000000", "iso"),
    ("2026-04-21 19:09:19 CEST", "Asia/Kolkata", "2026-04-21 17:09:19.000000", "iso"),
    ("2026-01-13T09:41:54[Asia/Kolkata]", ROME, "2026-01-13 04:11:54.000000", "iso"),
    ("2025-10-26T02:30:51+01:00[Europe/Rome]", None, "2025-10-26 01:30:51.000000", "iso"),
    ("2025-10-26T02:30:51+02:00[Europe/Rome]", None, "2025-10-26 00:30:51.000000", "iso"),
    ("2026-02-01", ROME, "2026-01-31 23:00:00.000000", "iso"),
    ("1768544617876", ROME, "2026-01-16 06:23:37.876000", "epoch"),
    ("1760379795.264", None, "2025-10-13 18:23:15.264000", "epoch"),
    ("1775445258", None, "2026-04-06 03:14:18.000000", "epoch"),
    ("1774663735999669", None, "2026-03-28 02:08:55.999669", "epoch"),
    ("1774663735999669123", None, "2026-03-28 02:08:55.999669", "epoch"),
    ("20250927T120719Z", None, "2025-09-27 12:07:19.000000", "compact"),
    ("20260215T204024+0100", None, "2026-02-15 19:40:24.000000", "compact"),
    ("16.03.2026 06:00:35", ROME, "2026-03-16 05:00:35.000000", "dotted"),
    ("Sun, 15 Feb 2026 03:56:57 +0100", None, "2026-02-15 02:56:57.000000", "mail"),
    ("19 Dec 2025 23:47:13 GMT", None, "2025-12-19 23:47:13.000000", "mail"),
    ("Mar 20, 2026 12:30:53 PM", "America/New_York", "2026-03-20 16:30:53.000000", "month-first"),
    ("Dec 7, 2025 12:59:22 AM", "UTC", "2025-12-07 00:59:22.000000", "month-first"),
    ("Sun Nov  6 08:49:37 1994", "UTC", "1994-11-06 08:49:37.000000", "ctime"),
    ("25/12/2025 10:00:00", "UTC", "2025-12-25 10:00:00.000000", "day-slash"),
    ("12/25/2025 10:00:00 PM", "UTC", "2025-12-25 22:00:00.000000", "month-slash"),
    ("2025-10-26 02:25:50", ROME, None, "ambiguous"),
    ("05.04.2026 02:30:13", "Australia/Sydney", None, "ambiguous"),
    ("2026-03-29 02:30:00", ROME, None, "skipped"),
    ("2026-03-29 02:30:00", "Asia/Kolkata", "2026-03-28 21:00:00.000000", "iso"),
    ("2026-03-29 02:30:00", None, None, "no-zone"),
    ("2026-03-29 02:30:00", "Mars/Crater", None, "no-zone"),
    ("2026-13-40T25:61:00Z", ROME, None, "unreadable"),
    ("0000-00-00 00:00:00", ROME, None, "unreadable"),
    ("unknown", ROME, None, "unreadable"),
    ("2026-01-01 10:00:00 XYZ", ROME, None, "unreadable"),
    ("2026-01-01 10:00:00 +99:00", ROME, None, "unreadable"),
    ("03/04/2026 10:00:00", ROME, None, "unreadable"),
    ("9" * 60, None, None, "unreadable"),
    ("", ROME, None, "missing"),
    ("--", ROME, None, "missing"),
    (None, ROME, None, "missing"),
    ("x" * 200_000, ROME, None, "unreadable"),
]


def test_spellings(spark):
    rows = spark.createDataFrame([(i, r, z) for i, (r, z, *_) in enumerate(CASES)], "i int, raw string, zone string")
    got = ts.normalise(rows, "raw", "zone", "test", ts.StampDictionary(spark))
    got = {r.i: (r.t, r.stamp_status) for r in got.select("i", F.date_format("instant", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "stamp_status").collect()}
    assert len(got) == len(CASES)
    for i, (raw, zone, t, status) in enumerate(CASES):
        assert got[i] == (t, status), (raw and raw[:60], zone)


@pytest.mark.parametrize("zone", ["Europe/Rome", "America/New_York", "America/Sao_Paulo", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata"])
def test_wall_times_against_zoneinfo(spark, zone):
    walls = [datetime(2025, 3, 1) + timedelta(minutes=30 * k + 7) for k in range(0, 20_000, 3)]
    rows = spark.createDataFrame([(w.isoformat(),) for w in walls], "raw string").withColumn("z", F.lit(zone))
    got = {r.raw: r.us for r in ts.parse_stamps(rows, "raw", "z", ts.zone_names(spark)).select("raw", F.unix_micros("instant").alias("us")).collect()}
    z, utc = ZoneInfo(zone), ZoneInfo("UTC")
    for w in walls:
        real = {u for fold in (0, 1) if (u := w.replace(tzinfo=z, fold=fold).astimezone(utc)).astimezone(z).replace(tzinfo=None) == w}
        assert got[w.isoformat()] == (int(real.pop().timestamp()) * 1_000_000 if len(real) == 1 else None), w


def test_dictionary_grows_by_what_is_new(spark):
    d = ts.StampDictionary(spark)
    one = spark.createDataFrame([("2026-01-01T00:00:00Z", None), ("2026-01-01T00:00:00", ROME)] * 3, "raw string, zone string")
    ts.normalise(one, "raw", "zone", "a", d)
    assert d.read().count() == 2
    ts.normalise(one.unionByName(spark.createDataFrame([("2026-01-02T00:00:00Z", None)], one.schema)), "raw", "zone", "a", d)
    assert d.read().count() == 3
    ts.normalise(one, "raw", "zone", "b", d)  # another source has its own entries
    assert d.read().count() == 5


def test_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "instant string, stamp_status int, raw string, zone string, stamp_raw string")
    got = ts.normalise(rows, "raw", "zone", "t", ts.StampDictionary(spark))
    assert got.count() == 0 and dict(got.dtypes)["instant"] == "timestamp"
    rows = spark.createDataFrame([("a", 1, "2026-01-01T00:00:00Z", None, "keep")] * 2, rows.schema)
    got = ts.normalise(rows, "raw", "zone", "t", ts.StampDictionary(spark)).collect()
    assert len(got) == 2 and got[0].stamp_raw == "keep" and got[0].instant == datetime(2026, 1, 1)
    with pytest.raises(ValueError):
        ts.normalise(rows, "absent", "zone", "t", ts.StampDictionary(spark))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 9))), max_size=40, unique_by=lambda x: x[:2]), st.integers(1, 20))
def test_previous_value_across_blocks(rows, block):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "k int, o bigint, v int")
    got = {(r.k, r.o): r.p for r in ordering.with_previous(df, "k", ["o"], "v", "p", F.floor(F.col("o") / block)).collect()}
    pos = {(r.k, r.o): r.n for r in ordering.with_position(df, "k", ["o"], "n", F.floor(F.col("o") / block)).collect()}
    for k in range(3):
        last, n = None, 0
        for _, o, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            assert got[k, o] == last and pos[k, o] == n
            last, n = (v if v is not None else last), n + 1


def test_found_query_against_brute_force(spark, data):
    from sessionloom.plans import preparation
    from sessionloom.runtime import table

    d = ts.StampDictionary(spark)
    rows = preparation.line_instants(spark, data, d).select("session_id", "id", "seq", F.unix_micros("instant").alias("t")).distinct().collect()
    expected, last = set(), {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.seq)):
        if r.t is not None:
            if r.session_id in last and r.t < last[r.session_id]:
                expected.add(("transcript_lines", r.id))
            last[r.session_id] = r.t
    for r in preparation.episode_instants(spark, data, d).select("id", "updated_at", F.unix_micros("instant").alias("t")).collect():
        if r.t is not None and r.t > r.updated_at * 1e6:
            expected.add(("episodes", r.id))
    assert {tuple(r) for r in preparation.p1_found(spark, data).collect()} == expected
    assert table(spark, data, "episodes").count() > 0


def test_texts_of_any_length(spark):
    texts = [" " * 100_000 + "2026-01-17T23:04:06Z" + "\t" * 1000, "x" + " " * 200_000 + "y", "a/" * 100_000 + " ", "Z" * 300_000, "2026-01-17 23:04:06 " + "Europe/" * 50_000, "1 " * 100_000, "[a" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [(r.instant, r.stamp_status) for r in ts.normalise(rows, "s", None, "x", ts.StampDictionary(spark)).orderBy(F.length("s").desc()).collect()]
    assert sorted(s for _, s in got) == sorted(["iso"] + ["unreadable"] * 6) and sum(i is not None for i, _ in got) == 1


def test_an_entry_that_was_written_twice_counts_once(spark):
    rows = spark.createDataFrame([("2026-01-17T23:04:06Z",), (None,), (None,)], "s string")
    d = ts.StampDictionary(spark)
    ts.normalise(rows, "s", None, "x", d).count()
    copy = d.read().collect()
    spark.createDataFrame(copy, ts.DICTIONARY).write.mode("append").parquet(d.path)
    got = ts.normalise(rows, "s", None, "x", d).collect()
    assert len(got) == 3 and sorted(r.stamp_status for r in got) == ["iso", "missing", "missing"]
