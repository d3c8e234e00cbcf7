"""The test tables in the data model's terms, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import episodes as E
from sessionloom.operators import recall as Q
from sessionloom.operators import timestamps
from sessionloom.plans import preparation
from sessionloom.runtime import shared_path, shared_table, table

#: The time of all queries: 1 June 2026, UTC, after the last row.
AS_OF = 1780272000.0

#: One row per id, the most accessed copy; created_at is the stamp's instant (problem 1), and updated_at where none can be told.
EPISODES = f"""{preparation.STAMPS_SQL},
 e AS (SELECT o.* EXCLUDE (rn) REPLACE (coalesce(us / 1e6, updated_at) AS created_at) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(access_count, -1) DESC, updated_at DESC) AS rn FROM episodes) o
  LEFT JOIN projects p ON p.project_id = o.project_id LEFT JOIN stamps ON raw = created_at AND tz IS NOT DISTINCT FROM p.tz_name WHERE rn = 1)"""

LOG = """lg AS (SELECT event_id, concat('p', user_id % 10) AS project_id,
 CASE event_type WHEN 'click' THEN 'transcript' WHEN 'view' THEN 'git.commit' WHEN 'purchase' THEN 'transcript.classified' WHEN 'error' THEN 'transcript.failed' ELSE 'manual' END AS source_type,
 concat('sess-', user_id) AS session, epoch_us(ts) / 1e6 AS captured_at, props AS payload, CAST(round(value * 100) AS BIGINT) AS bytes FROM events)"""

LINES = "tl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY received_at DESC, line_id DESC) AS rn FROM transcript_lines) WHERE rn = 1)"


def epoch(name: str) -> Column:
    """Seconds since 1970 of a column of UTC wall times."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({name} AS TIMESTAMP_NTZ))") / 1e6


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = E.latest(table(spark, sf_dir, "episodes"))
    zones = table(spark, sf_dir, "projects").groupBy("project_id").agg(F.first("tz_name", ignorenulls=True).alias("tz_name"))
    timed = timestamps.normalise(once.join(zones, "project_id", "left"), "created_at", "tz_name", "episodes", preparation.dictionary(spark))
    return timed.withColumn("created_at", F.coalesce(F.unix_micros("instant") / 1e6, "updated_at")).select(*once.columns)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of episodes: one row per id with its parsed time, made once per session."""
    return shared_table(spark, "episodes", f"{sf_dir}/episodes.parquet", lambda: _parsed(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> Q.SearchIndex:
    """The episodes' search index, made once per session."""
    return Q.episode_index(episodes(spark, sf_dir), shared_path(spark, "episode-index", f"{sf_dir}/episodes.parquet"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "transcript", "view": "git.commit", "purchase": "transcript.classified", "error": "transcript.failed"}
    source = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.lit(v)))), F.col("event_type")), F.lit("manual"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project_id"), source.alias("source_type"),
        F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("session"), epoch("ts").alias("captured_at"),
        F.col("props").alias("payload"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript lines, each record once: the copy delivered last, found by its small columns."""
    every = table(spark, sf_dir, "transcript_lines")
    last = every.groupBy("session_id", "id").agg(F.max(F.struct("received_at", "line_id")).alias("l")).select(F.col("l.line_id").alias("line_id"))
    return every.join(last, "line_id", "left_semi")
