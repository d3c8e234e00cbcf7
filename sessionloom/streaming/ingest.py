"""Transcript ingestion as streams: reading, gates with state, and an upserted table as the sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from sessionloom import runtime
from sessionloom.operators import episodes, eventlog

#: The polling period of ingestion, and after how long a quiet session is taken for finished.
TRIGGER, IDLE, LATE = "5 minutes", "10 minutes", "7 days"


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, line) of the JSONL files of a folder; the checkpoint remembers which were read."""
    runtime.ship(spark)
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def idle_sessions(events: DataFrame, key: str, stamp: str, gap: str = IDLE, late: str = LATE) -> DataFrame:
    """Sessions of events with no pause of ``gap``; each is sent once the watermark has passed its end."""
    return (
        events.withWatermark(stamp, late)
        .groupBy(key, F.session_window(stamp, gap).alias("w"))
        .agg(F.count("*").alias("n_events"))
        .select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")
    )


def new_commits(commits: DataFrame, stamp: str = "committed_at", late: str = LATE) -> DataFrame:
    """Commits once each by project and the first twelve digits, as far back as the watermark reaches."""
    return commits.withColumn("ref", F.left("sha", F.lit(12))).withWatermark(stamp, late).dropDuplicatesWithinWatermark(["project_id", "ref"])


def growth_gate(log: DataFrame) -> DataFrame:
    """(session, event_id, bytes, last_bytes, decision) of each sighting of a session, against its last marker.

    ``log`` is a stream of (session, event_id, captured_at, source_type, bytes).
    The state of a session is one number, the bytes that its last marker
    covered. Within a micro-batch a session's rows are put in order of time;
    ``maxFilesPerTrigger`` bounds how many that are.
    """

    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(pages)).sort_values(["captured_at", "event_id"]).itertuples(index=False):
            if r.source_type == eventlog.DONE:
                last = int(r.bytes)
            elif r.source_type == "transcript":
                more = None if last is None else r.bytes - last
                what = "new" if more is None else "shrunk" if more < 0 else "same" if more < eventlog.GROWTH_BYTES else "grown"
                out.append((key[0], r.event_id, r.bytes, last, what))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["session", "event_id", "bytes", "last_bytes", "decision"]).astype({"event_id": "int64", "bytes": "int64", "last_bytes": "Int64", "session": object, "decision": object})

    runtime.require_columns(log, "session", "event_id", "captured_at", "source_type", "bytes")
    return log.groupBy("session").applyInPandasWithState(
        step, "session string, event_id bigint, bytes bigint, last_bytes bigint, decision string", "last_bytes bigint", "append", "NoTimeout"
    )


class EpisodeTable:
    """Episodes in buckets by id; each micro-batch writes the buckets that it touches as the next version.

    A version is complete once its success file is there, and readers take of
    each bucket the highest complete version that has it, so a lost executor or
    driver never shows half a batch. A batch that is repeated writes its own
    number again. Of each bucket the last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = 32):
        self.spark, self.path, self.keep, self.buckets = spark, path, keep, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> dict[int, list[int]]:
        """The complete versions of each bucket, rising."""
        fs, root = self._fs(self.path)
        found: dict[int, list[int]] = {}
        if not fs.exists(root):
            return found
        for v in sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v")):
            if runtime.exists(self.spark, f"{self.path}/v{v}"):
                for s in fs.listStatus(self._fs(f"{self.path}/v{v}")[1]):
                    if s.getPath().getName().startswith("bucket="):
                        found.setdefault(int(s.getPath().getName()[7:]), []).append(v)
        return found

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        last = {b: [v for v in vs if before is None or v < before] for b, vs in self._versions().items() if buckets is None or b in buckets}
        paths = [f"{self.path}/v{vs[-1]}/bucket={b}" for b, vs in sorted(last.items()) if vs]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        """Upsert one row per id of a batch; of several the newest counts."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        incoming = runtime.materialise(episodes.latest(batch), "batch")
        touched = sorted(r[0] for r in incoming.select(bucket).distinct().collect())  # at most as many as there are buckets
        stored = self.read(number, touched)
        merged = incoming if stored is None else episodes.upsert(stored, incoming.select(*stored.columns))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{number}")
        for b, versions in self._versions().items():
            for v in [v for v in versions if v <= number][: -self.keep]:
                fs, p = self._fs(f"{self.path}/v{v}/bucket={b}")
                fs.delete(p, True)

    def sink(self, stream: DataFrame, checkpoint: str, once: bool = False):
        """Start the query that feeds this table."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.merge(df, int(n))).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()
