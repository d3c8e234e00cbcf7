"""The event log: validation, gates over a session's markers, and publishing what isn't there yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import ordering

# Fixed values of the log's contract.
ACTIVE = ["transcript", "git.commit"]
RESERVED = ["manual", "browser", "calendar", "email", "chat", "terminal", "editor", "test", "ci", "issue"]
REQUIRED = {"transcript": ["transcript_path", "new_bytes", "new_lines", "session_id"], "git.commit": ["sha", "author", "message_short", "files_changed_count"]}
GROWTH_BYTES = 2048
FAILURES, BACKOFF_SECONDS = 3, 6 * 3600
DONE, FAILED = "transcript.classified", "transcript.failed"


def problem(project: Column, source: Column, payload: Column, allowed: list[str] | None = None) -> Column:
    """Why an event may not be appended; null if it may."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    needed = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    lacking = F.array_except(F.coalesce(F.try_element_at(needed, source), F.array().cast("array<string>")), keys)
    return (
        F.when(F.coalesce(F.trim(project), F.lit("")) == "", "no project")
        .when(source.isin(RESERVED), "reserved source")
        .when(~F.coalesce(source.isin(ACTIVE if allowed is None else allowed), F.lit(False)), "unknown source")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(lacking), ",")))
    )


def validated(events: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    return events.withColumn("problem", problem(F.col("project_id"), F.col("source_type"), F.col("payload"), allowed))


def growth(markers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(session, bytes, last_bytes, decision) of each session: new, shrunk, grown or same.

    ``markers`` are log events of finished sessions with the bytes they covered;
    the latest counts. ``sizes`` has session and bytes now.
    """
    last = markers.groupBy("session").agg(F.max_by(F.coalesce("bytes", F.lit(0)), F.struct("captured_at", "event_id")).alias("last_bytes"))
    more = F.col("bytes") - F.col("last_bytes")
    decision = F.when(F.col("last_bytes").isNull(), "new").when(more < 0, "shrunk").when(more < GROWTH_BYTES, "same").otherwise("grown")
    return sizes.join(last, "session", "left").withColumn("decision", decision)


def backoff(events: DataFrame, as_of: float) -> DataFrame:
    """(session, n_failures, last_failure, waits): failures since the last success; enough recent ones make it wait.

    Two aggregations with map-side combination, so a session with very many
    events isn't gathered.
    """
    success = events.groupBy("session").agg(F.max(F.when(F.col("source_type") == DONE, F.struct("captured_at", "event_id"))).alias("ok"))
    failed = events.where(F.col("source_type") == FAILED).join(success, "session")
    since = failed.where(F.col("ok").isNull() | (F.struct("captured_at", "event_id") > F.col("ok")))
    out = since.groupBy("session").agg(F.count("*").alias("n_failures"), F.max("captured_at").alias("last_failure"))
    return out.withColumn("waits", (F.col("n_failures") >= FAILURES) & (F.lit(as_of) - F.col("last_failure") < BACKOFF_SECONDS))


def unpublished(commits: DataFrame, log: DataFrame) -> DataFrame:
    """Commits (project_id, sha, …) whose first twelve digits aren't in the log."""
    ref = F.left("sha", F.lit(12))
    known = log.where("source_type = 'git.commit'").select("project_id", F.col("source_ref").alias("ref")).distinct()
    return commits.withColumn("ref", ref).join(known, ["project_id", "ref"], "left_anti")


def commits_of(lines: DataFrame) -> DataFrame:
    """Commits of an exported log: ``sha||author||email||date||message`` lines, each followed by its files.

    ``lines`` has repo, line_no and line. Each line belongs to the last header
    before it, by a carry over blocks of lines, so one repository may hold any
    share of them; files are gathered by that header. ``n`` numbers the headers
    of a repository from 1.
    """
    header = F.col("line").rlike(r"^[0-9a-f]{7,40}\|\|")
    cut = ordering.cut_by_range(lines.select("repo", "line_no", "line").withColumn("head", F.when(header, F.col("line_no"))), "repo", ["line_no"], "block")
    carried = ordering.with_previous(cut, "repo", ["line_no"], "head", "above", F.col("block"))
    files = carried.where("head is null and above is not null").where(F.trim("line") != "").select("repo", F.col("above").alias("head"), F.struct("line_no", F.trim("line").alias("file")).alias("f"))
    gathered = files.groupBy("repo", "head").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["file"]).alias("files_changed"))
    heads = ordering.with_position(cut.where("head is not null"), "repo", ["line_no"], "n", F.col("block"))
    part = F.split("line", r"\|\|", 5)
    full = heads.join(gathered, ["repo", "head"], "left").withColumn("n", F.col("n") + 1)
    return full.select("repo", "n", *(part.getItem(i).alias(k) for i, k in enumerate(["sha", "author", "email", "date_iso", "message"])), F.coalesce("files_changed", F.array().cast("array<string>")).alias("files_changed"))


def since_last_known(commits: DataFrame, known: DataFrame, as_of: float, window_seconds: int = 3600) -> DataFrame:
    """Commits after the last known one of their repository.

    ``commits`` has repo, n (1 is the newest), sha and committed_at (epoch
    seconds), ``known`` repo and sha. A repository whose sha isn't among its commits
    (or that has none) gives those of the last ``window_seconds``.
    """
    at = commits.join(known.select("repo", F.col("sha").alias("known_sha")).dropDuplicates(["repo"]), "repo", "left")
    place = at.where(F.col("sha").startswith(F.col("known_sha"))).groupBy("repo").agg(F.min("n").alias("known_n"))
    joined = commits.join(place, "repo", "left")
    recent = F.col("committed_at") >= as_of - window_seconds
    return joined.where(F.when(F.col("known_n").isNotNull(), F.col("n") < F.col("known_n")).otherwise(recent)).drop("known_n")


def append(log: DataFrame, events: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``log`` with the valid ``events`` after it, and the others with their ``problem``.

    Events get the numbers after the log's last, in the order of captured_at and then of
    their contents; both have event_id, project_id, source_type, source_ref, captured_at and payload.
    """
    judged = validated(events, allowed)
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    good = judged.where("problem is null").withColumn("_tie", F.xxhash64("project_id", "source_type", "source_ref", "payload")).withColumn("_all", F.lit(0))
    cut = ordering.cut_by_range(good, "_all", ["captured_at", "_tie"], "_block")
    numbered = ordering.with_position(cut, "_all", ["captured_at", "_tie"], "_n", F.col("_block"))
    new = numbered.withColumn("event_id", (F.lit(last) + 1 + F.col("_n")).cast("bigint")).select(*log.columns)
    return log.unionByName(new), judged.where("problem is not null")


def has_event(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (project_id, source_type, source_ref) with ``is_known``: whether the log has such an event; a null reference equals a null one."""
    keys = ["project_id", "source_type", "source_ref"]
    known = log.select(*keys).distinct().withColumn("_y", F.lit(True)).alias("k")
    same = (F.col("w.project_id") == F.col("k.project_id")) & (F.col("w.source_type") == F.col("k.source_type")) & F.col("w.source_ref").eqNullSafe(F.col("k.source_ref"))
    return wanted.alias("w").join(known, same, "left").select("w.*", F.coalesce("k._y", F.lit(False)).alias("is_known"))


def empty_markers(counts: DataFrame, log: DataFrame, as_of: float) -> DataFrame:
    """Marker events of sessions without anything to classify, so that they aren't tried again until they grow.

    ``counts`` has project_id, session, bytes and total_events, ``log`` at least
    project_id, source_type and source_ref; a session that has a marker gets no second one.
    """
    empty = counts.where("total_events = 0").select("project_id", F.lit(DONE).alias("source_type"), F.col("session").alias("source_ref"), "bytes").distinct()
    new = has_event(log, empty).where("not is_known").drop("is_known")
    return new.withColumns({"captured_at": F.lit(as_of), "payload": F.to_json(F.struct(F.lit(0).alias("episodes_written"), F.lit(True).alias("empty"), F.col("bytes").alias("transcript_bytes")))}).drop("bytes")
