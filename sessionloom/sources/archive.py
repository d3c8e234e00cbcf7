"""Markdown files with a head of key: value lines, one file per episode."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.functions import text as T

# The order of the head's keys.
KEYS = ["type", "date", "timestamp", "project", "workspace", "session", "confidence", "assistant", "status", "source"]
_HEAD = r"(?s)^---\n(.*?)\n---\n"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, category, text) of folder/<category>/*.md."""
    files = spark.read.text(f"{folder}/*/*.md", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.withColumn("category", F.element_at(F.split("path", "/"), -2))


def head(text: Column) -> Column:
    """``map<string,string>`` of the head; null where there is none. Of repeated keys the last counts."""
    lines = F.filter(F.split(F.regexp_extract(text, _HEAD, 1), "\n"), lambda x: x.contains(":") & ~x.startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.char_length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(text.rlike(_HEAD), F.map_from_entries(last))


def scan(files: DataFrame) -> DataFrame:
    """``files`` (path, category, text) with title, body, its hash and length, and the head's confidence."""
    body = F.trim(F.regexp_replace("text", _HEAD, ""))
    return files.withColumns({"head": head(F.col("text")), "title": F.trim(F.regexp_extract(body, r"(?m)^# (.+)$", 1)), "body": body}).withColumns(
        {"confidence": F.lower(F.coalesce(F.try_element_at("head", F.lit("confidence")), F.lit(""))), "body_hash": T.body_hash(F.col("body")), "body_len": F.char_length("body")}
    )


def migrated(fields: Column) -> Column:
    """The head of an older file in today's form, as text.

    The project comes from the workspace's name, the time from the date's
    midnight in UTC; confidence and assistant get defaults. Known keys stand in
    their order, then the others as they came.
    """
    date = F.try_element_at(fields, F.lit("date"))
    stamp = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(date, F.lit("T00:00:00+00:00")))
    defaults = {
        "timestamp": stamp, "project": T.project_label(F.coalesce(F.try_element_at(fields, F.lit("workspace")), F.lit(""))),
        "confidence": F.lit("medium"), "assistant": F.lit("assistant"),
    }
    value = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), defaults.get(k, F.lit(None).cast("string")))
    known = F.array(*(F.concat(F.lit(f"{k}: "), value(k)) for k in KEYS))
    rest = F.transform(F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(KEYS)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.concat(F.filter(known, lambda x: x.isNotNull()), rest), "\n")


def file_name(created_at: Column, ident: Column, title: Column) -> Column:
    day = F.date_format(F.timestamp_seconds(F.floor(created_at)), "yyyy-MM-dd")
    return F.concat(day, F.lit("-"), F.left(ident, F.lit(8)), F.lit("-"), T.slug(title), F.lit(".md"))


def render(rows: DataFrame) -> DataFrame:
    """(id, subdir, file_name, text) of each episode's file."""
    at = F.timestamp_seconds(F.floor("created_at"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    top = F.concat_ws(
        "\n", F.lit("---"), line("type", F.coalesce("category", F.lit("neutral"))), line("date", F.date_format(at, "yyyy-MM-dd")),
        line("timestamp", F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))), line("project", F.col("project_id")),
        line("confidence", T.confidence_label(F.col("confidence"))), line("kind", F.col("kind")), F.lit("---"), F.lit(""),
        F.concat(F.lit("# "), "title"), F.lit(""), F.rtrim(F.coalesce("body", F.lit(""))), F.lit(""),
        F.concat(F.lit("Source: "), "source_type", F.lit(" | Episode: "), "id"),
    )
    return rows.select("id", T.archive_subdir(F.col("category")).alias("subdir"), file_name(F.col("created_at"), F.col("id"), F.col("title")).alias("file_name"), top.alias("text"))


def write(rendered: DataFrame, folder: str) -> None:
    """One text file ``folder/<subdir>/<file_name>`` per episode, written by the tasks to any file system that all of them reach.

    The path decides the name, so writing again, or running a task twice,
    writes the same file again. Two episodes of one path are written as one,
    the one with the smaller id.
    """
    once = rendered.groupBy("subdir", "file_name").agg(F.min_by("text", "id").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder if "://" in folder else Path(folder).absolute().as_uri())
        for b in batches:
            for subdir, name, text in zip(*(b.column(c).to_pylist() for c in ("subdir", "file_name", "text"))):
                disk.create_dir(f"{root}/{subdir}", recursive=True)
                part = f"{root}/{subdir}/.{uuid.uuid4().hex}"
                with disk.open_output_stream(part) as out:
                    out.write(text.encode())
                disk.move(part, f"{root}/{subdir}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    runtime.ship(rendered.sparkSession)
    once.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
