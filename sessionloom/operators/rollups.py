"""Summaries by project and session, and the archive's cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File endings looked for in texts, titles without content.
EXTENSIONS = [".py", ".ts", ".js", ".html", ".css", ".json", ".yaml", ".yml", ".toml", ".md", ".sql", ".txt", ".conf", ".cfg", ".sh", ".env"]
GENERIC_TITLES = [f"{x} — Auto-captured" for x in ("BUG_FOUND", "INSIGHT", "WARNING", "EUREKA", "CODE_CHANGE")]
GENERIC_CHARS = 100


def upper_median(values: Column) -> Column:
    """The middle value, of two the upper one. For groups whose values fit a row, such as figures of a report."""
    ranked = F.array_sort(F.collect_list(values))
    return F.element_at(ranked, (F.floor(F.size(ranked) / 2) + 1).cast("int"))


def first_of(streams: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of ranked streams, first wins: each has ``key`` and ``pos``; a row keeps its stream's number as ``priority``."""
    every = None
    for i, s in enumerate(streams):
        part = s.withColumn("priority", F.lit(i))
        every = part if every is None else every.unionByName(part)
    rest = F.struct(*[c for c in every.columns if c not in key])
    return every.groupBy(*key).agg(F.min_by(rest, F.struct("priority", "pos")).alias("r")).select(*key, "r.*")


def file_mentions(rows: DataFrame) -> DataFrame:
    """(project_id, id, created_at, line_no, ext_no, path): in each line with a slash, the first word with each ending."""
    lines = rows.select("project_id", "id", "created_at", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where(F.col("line").contains("/"))
    words = F.split(F.trim("line"), r"\s+")
    ending_in = lambda e: F.try_element_at(F.filter(words, lambda w: w.endswith(e)), F.lit(1))
    first = F.array(*(F.struct(F.lit(i).alias("ext_no"), ending_in(e).alias("path")) for i, e in enumerate(EXTENSIONS)))
    return lines.select("project_id", "id", "created_at", "line_no", F.explode(first).alias("x")).select("project_id", "id", "created_at", "line_no", "x.*").where("path is not null")


# Folders whose recent files count, folders that are noise, and endings of files that are worked on.
RECENT_FOLDERS = ["app", "apps", "src", "lib", "utils", "core", "models", "views", "controllers", "api", "config", "templates", "static", "components", "pages", "routes", "services", "helpers", "tests"]
NOISE_FOLDERS = ["node_modules", ".git", "__pycache__", ".venv", "venv", ".terraform", "dist", "build", ".next"]
RECENT_ENDINGS = [*EXTENSIONS, ".jsx", ".tsx", ".scss", ".vue", ".svelte", ".go", ".rs", ".java", ".rb", ".php"]


def recent_files(files: DataFrame, as_of: float, age: float = 86400, folders: list[str] | None = RECENT_FOLDERS) -> DataFrame:
    """Rows of ``files`` (project_id, path within the project, mtime) changed within ``age`` seconds, below a known folder (any, for None), in no noise folder, with a known ending."""
    parts = F.split("path", "/")
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    kept = (F.col("mtime") >= as_of - age) & ending.isin(RECENT_ENDINGS) & ~F.arrays_overlap(parts, F.array(*map(F.lit, NOISE_FOLDERS)))
    return files.where(kept if folders is None else kept & (F.size(parts) > 1) & parts[0].isin(folders))


# Fixed values of the candidate filter.
MAX_AGE, MIN_BYTES, QUIET, PER_TICK = 7 * 86400, 4096, 600, 8


def candidates(files: DataFrame, as_of: float, max_age: float = MAX_AGE) -> DataFrame:
    """Rows of ``files`` (n_bytes, mtime) that are young, large and quiet enough. A tick takes the newest ``PER_TICK`` that no gate skips; a backfill widens ``max_age``."""
    return files.where((F.col("mtime") > as_of - max_age) & (F.col("mtime") <= as_of - QUIET) & (F.col("n_bytes") >= MIN_BYTES))


def newest_files(files: DataFrame, as_of: float, max_age: float) -> DataFrame:
    """(real_path, path, mtime) of ``files`` (path, real_path, mtime) younger than ``max_age``, each real file once; ``orderBy`` mtime and path to list them."""
    young = files.where(F.col("mtime") > as_of - max_age)
    return young.groupBy("real_path").agg(F.max(F.struct("mtime", "path")).alias("m")).select("real_path", "m.path", "m.mtime")


def last_lines(text: Column, n: int = 20) -> Column:
    """The last ``n`` lines of a text; a final newline begins none."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(project_id, path, pos): a stream for ``first_of``, numbered within its project."""
    return rows.select("project_id", "path", F.row_number().over(Window.partitionBy("project_id").orderBy(*order, "path")).alias("pos"))


def working_set(uncommitted: DataFrame, committed: DataFrame, mentioned: DataFrame, cap: int = 20) -> DataFrame:
    """Each project's first ``cap`` files: uncommitted, then committed, then mentioned in episodes; a file counts once."""
    merged = first_of([uncommitted, committed, mentioned], ["project_id", "path"])
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("priority", "pos", "path"))
    return merged.withColumn("place", place).where(F.col("place") <= cap)


def scores_by_project(texts: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """(key, project_id, score): three points for each mention of a project's root, one for its bare name.

    Texts are cut into words and paths once and meet the projects' names by
    equality, so no text is searched once for each project.
    """
    named = projects.where(~F.col("project_id").startswith("auto-")).select("project_id", "root_path", F.lower(F.element_at(F.split("root_path", "/"), -1)).alias("name"))
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)"))).alias("name")
    by_name = texts.select(key, token).join(named.select("project_id", "name"), "name").groupBy(key, "project_id").agg(F.count("*").alias("n"))
    paths = F.explode(F.regexp_extract_all("text", F.lit(r"((?:/[A-Za-z0-9_.-]+)+)"))).alias("path")
    deep = texts.select(key, paths)
    prefixes = F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("root_path")
    by_root = deep.select(key, prefixes).join(named.select("project_id", "root_path"), "root_path").groupBy(key, "project_id").agg((3 * F.count("*")).alias("n"))
    return by_name.unionByName(by_root).groupBy(key, "project_id").agg(F.sum("n").alias("score"))


def best_project(scores: DataFrame, key: str) -> DataFrame:
    """The project with the highest score, of equal ones the first by name."""
    return scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "project_id")).alias("b")).select(key, F.col("b.project_id").alias("project_id"), (-F.col("b.s")).alias("score"))


def is_generic(title: Column, body: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)^# .+$", ""), r"(?s)## Context.*", "")
    return title.isin(GENERIC_TITLES) & (F.char_length(F.trim(plain)) < GENERIC_CHARS)


def to_remove(files: DataFrame) -> DataFrame:
    """Archive files (path, category, title, body, body_hash, confidence) with the reason to remove them.

    Low confidence comes before a generic title, and that before being a copy:
    of equal bodies the first by category and path stays. The first is a
    map-side minimum, so copies of one body aren't gathered.
    """
    first = files.groupBy("body_hash").agg(F.min(F.struct("category", "path")).alias("first"))
    reason = (
        F.when(F.lower("confidence") == "low", "low-confidence").when(is_generic(F.col("title"), F.col("body")), "generic")
        .when(F.col("first.path") != F.col("path"), "duplicate")
    )
    return files.join(first, "body_hash").withColumn("reason", reason).where("reason is not null").drop("first")


def longest_prefix(paths: DataFrame, bases: DataFrame) -> DataFrame:
    """(path, source_id) by the deepest of ``bases`` (source_id, base) that the path lies in.

    A path's own ancestors are listed and met with the bases by equality.
    """
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), "/").alias("base")))).alias("x")
    met = paths.select("path", above).select("path", "x.*").join(bases, "base")
    return met.groupBy("path").agg(F.max_by("source_id", "n").alias("source_id"))


def project_ids(projects: DataFrame) -> DataFrame:
    """(root_path, project_id, clashes): the id given, if it is a valid name, else one made of the root; ``clashes`` where roots share an id."""
    own = F.concat(F.lit("auto-"), F.left(F.sha2("root_path", 256), F.lit(10)))
    valid = F.coalesce(F.col("project_id").rlike("^[a-z0-9][a-z0-9-]{0,31}$"), F.lit(False))
    roots = projects.where("root_path is not null").select("root_path", F.when(valid, F.col("project_id")).otherwise(own).alias("project_id")).distinct()
    shared = roots.groupBy("project_id").agg((F.count("*") > 1).alias("clashes"))
    return roots.join(shared, "project_id").select("root_path", "project_id", "clashes")


def by_workspace(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """``sessions`` (with ``label``) and the project whose root's last folder is that label, in any case; of several the first by ``place``, else null.

    ``projects`` has project_id, root_path and place, the order in which they are listed.
    """
    name = F.lower(F.element_at(F.split(F.regexp_replace("root_path", "/+$", ""), "/"), -1))
    first = projects.where("root_path is not null").groupBy(name.alias("_name")).agg(F.min_by("project_id", F.struct("place", "project_id")).alias("found_project"))
    label = F.nullif(F.lower(F.trim("label")), F.lit(""))
    return sessions.withColumn("_label", F.when(label != "unknown", label)).join(first, F.col("_label") == F.col("_name"), "left").drop("_label", "_name")


def run_report(runs: DataFrame) -> DataFrame:
    """(measure, name, n, mean_seconds) of runs (status, project_id, duration): how many by status and by project, and their mean duration."""
    each = F.array(F.struct(F.lit("status").alias("measure"), F.col("status").alias("name")), F.struct(F.lit("project").alias("measure"), F.coalesce("project_id", F.lit("?")).alias("name")))
    return runs.select(F.explode(each).alias("x"), "duration").groupBy("x.measure", "x.name").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_seconds"))


def cleanup_report(total: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: files before, removed by each reason, and kept."""
    by = removed.agg(*(F.count_if(F.col("reason") == r).alias(f"removed_{r.replace('-', '_')}") for r in ("generic", "duplicate", "low-confidence")), F.count("*").alias("total_removed"))
    both = total.agg(F.count("*").alias("total_before")).unionByName(by, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("total_before", *by.columns)))
    return both.withColumn("kept", F.col("total_before") - F.col("total_removed"))
