"""Where each vendor keeps its transcripts, and what a path tells about a session."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_IDS = ("file_stem", "parent_dir", "kimi_session_dir")
WORKSPACES = ("vscode", "codex_cwd", "kimi_wd", "grok_encoded", "reasonix_project", "session_cwd", "parent_dir")


@dataclass(frozen=True)
class Manifest:
    id: str
    label: str
    base: str
    globs: tuple[str, ...]
    session_id: str = "file_stem"
    workspace: str = "parent_dir"
    skips_subagents: bool = False


def builtin(home: str, env: Mapping[str, str] | None = None, prefix: str = "SESSIONLOOM", **bases: str) -> list[Manifest]:
    """The six known stores. A keyword beats ``<prefix>_<ID>_HOME``, which beats a vendor's own variable, which beats the default."""
    env = env or {}
    known = [  # Fixed values: the vendors' folders
        Manifest("copilot", "VS Code Copilot", ".config/Code/User", ("workspaceStorage/*/GitHub.copilot-chat/transcripts/*.jsonl",), "file_stem", "vscode"),
        Manifest("codex", "Codex CLI", ".codex", ("sessions/**/*.jsonl", "archived_sessions/*.jsonl"), "file_stem", "codex_cwd", True),
        Manifest("kimi", "Kimi Code", ".kimi-code", ("sessions/*/*/agents/main/wire.jsonl",), "kimi_session_dir", "kimi_wd"),
        Manifest("grok", "Grok Build", ".grok", ("sessions/*/*/chat_history.jsonl",), "parent_dir", "grok_encoded", True),
        Manifest("reasonix", "DeepSeek Reasonix", ".reasonix", ("projects/*/sessions/*.jsonl",), "file_stem", "reasonix_project", True),
        Manifest("omp", "Oh My Pi", ".omp/agent/sessions", ("*/*.jsonl",), "file_stem", "session_cwd"),
    ]
    native = {"reasonix": "REASONIX_HOME"}
    out = []
    for m in known:
        base = bases.get(m.id) or env.get(f"{prefix}_{m.id.upper()}_HOME") or env.get(native.get(m.id, "")) or f"{home}/{m.base}"
        out.append(replace(m, base=base))
    return out


def from_dict(raw: object) -> Manifest | None:
    """A manifest from configuration; None where it isn't whole or names an unknown strategy."""
    if not isinstance(raw, Mapping):
        return None
    globs = raw.get("globs")
    globs = (globs,) if isinstance(globs, str) else tuple(globs) if isinstance(globs, (list, tuple)) else ()
    ident, base = raw.get("id"), raw.get("base")
    if not (isinstance(ident, str) and ident and isinstance(base, str) and base and globs and all(isinstance(g, str) and g for g in globs)):
        return None
    session, workspace = raw.get("session_id", "file_stem"), raw.get("workspace", "parent_dir")
    if session not in SESSION_IDS or workspace not in WORKSPACES:
        return None
    return Manifest(ident, str(raw.get("label") or ident), base, globs, session, workspace, bool(raw.get("skips_subagents", False)))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def session_id(path: Column, strategy: Column) -> Column:
    stem = F.regexp_replace(_name(path), r"\.[^.]*$", "")
    kimi = F.regexp_extract(path, r".*/(session_[^/]*)/", 1)
    parent = F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when(strategy == "parent_dir", parent).when((strategy == "kimi_session_dir") & (kimi != ""), kimi).otherwise(stem)


def workspace_label(path: Column, strategy: Column, cwd: Column, folder: Column) -> Column:
    """The workspace's name. ``cwd`` is that of the first session event, ``folder`` that of an editor's workspace file."""
    parts = F.split(path, "/")
    up = lambda n: F.try_element_at(parts, F.lit(-n))
    kimi = F.regexp_extract(path, r"/sessions/([^/]+)/", 1)
    kimi_label = F.regexp_extract(kimi, r"^wd_(.+)_[0-9a-f]{12}$", 1)
    coded = up(3)
    dashed = F.when(coded.startswith("-"), F.element_at(F.split(coded, "-"), -1)).otherwise(coded)
    own = F.element_at(F.split(F.trim(F.regexp_replace(up(2), "^-+|-+$", "")), "-"), -1)
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return (
        F.when(strategy == "vscode", F.coalesce(_name(F.nullif(folder, F.lit(""))), F.left(up(4), F.lit(8))))
        .when(strategy == "codex_cwd", known(_name(cwd)))
        .when(strategy == "kimi_wd", known(F.when(kimi_label != "", kimi_label).otherwise(kimi)))
        .when(strategy == "grok_encoded", known(_name(F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B"))))))
        .when(strategy == "reasonix_project", known(dashed))
        .when(strategy == "session_cwd", F.coalesce(_name(F.nullif(cwd, F.lit(""))), known(own)))
        .otherwise(known(up(2)))
    )


def subagent_sessions(lines: DataFrame, key: str, first_lines: int = 20) -> DataFrame:
    """Keys of sessions whose first session_meta says that another session started them."""
    v = F.try_parse_json(F.col("line"))
    get = lambda p, t="string": F.try_variant_get(F.col("v"), p, t)
    meta = lines.where(F.col("line_in_file") < first_lines).withColumn("v", v).where(get("$.type") == "session_meta")
    flagged = get("$.payload.forked_from_id").isNotNull() | get("$.payload.agent_nickname").isNotNull() | F.schema_of_variant(get("$.payload.source", "variant")).contains("subagent:")
    return meta.groupBy(key).agg(F.min_by(F.coalesce(flagged, F.lit(False)), "line_in_file").alias("f")).where("f").select(key)


def main_sessions(sessions: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Sessions to index: none started by another, and no sidecar files."""
    return sessions.where(~F.col("path").rlike(r"\.(events|conflicts)\.jsonl$")).join(flagged, key, "left_anti")


def resolve(asked: DataFrame, sessions: DataFrame, shown: int = 5) -> DataFrame:
    """(asked, session_id, outcome, candidates): each wanted id as the whole id or the only session that begins with it.

    outcome is found, not found or ambiguous; of ambiguous ones the first
    ``shown`` candidates by name are listed. A session offers its own prefixes
    of the lengths asked for, so the two meet by equality.
    """
    wanted = asked.select("asked").where("asked <> ''").distinct()
    ids = sessions.where("session_id is not null").select("session_id").distinct()
    longest = ids.agg(F.max(F.char_length("session_id"))).first()[0] or 0
    lengths = [r.n for r in wanted.select(F.char_length("asked").alias("n")).distinct().where(F.col("n") <= longest).collect()]  # no more than an id has letters
    prefixes = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.left("session_id", n)))
    offered = ids.select("session_id", F.explode(prefixes).alias("asked"))
    met = offered.join(wanted, "asked").withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy((F.col("session_id") != F.col("asked")), "session_id")))
    first = met.where(F.col("k") <= shown + 1).groupBy("asked").agg(F.array_sort(F.collect_list("session_id")).alias("found"), F.max(F.col("session_id") == F.col("asked")).alias("exact"))
    full, one = wanted.join(first, "asked", "left"), F.coalesce("exact", F.lit(False)) | (F.size("found") == 1)
    return full.select(
        "asked", F.when(F.col("exact"), F.col("asked")).when(F.size("found") == 1, F.col("found")[0]).alias("session_id"),
        F.when(F.col("found").isNull(), "not found").when(one, "found").otherwise("ambiguous").alias("outcome"),
        F.when(F.col("found").isNotNull() & ~one, F.slice("found", 1, shown)).alias("candidates"),
    )


def grok_subagents(summaries: DataFrame, key: str) -> DataFrame:
    """Keys of sessions whose summary (column ``summary``, JSON) names a parent or a helper's task."""
    get = lambda p: F.coalesce(F.get_json_object("summary", p), F.lit(""))
    said = get("$.session_summary")
    served = ~get("$.parent_session_id").isin("", "false", "0") | said.contains("Harness") | said.contains("Goal Plan Writer") | F.lower(said).contains("verifier")
    return summaries.where(served).select(key).distinct()


def files_of(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(path, mtime, n_bytes) of the files that a manifest's globs name, from the file listing alone."""
    found = None
    for g in manifest.globs:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", g.rsplit("/", 1)[-1])
        folder = g.rsplit("/", 1)[0] if "/" in g else ""
        deep = "**" in folder
        base = "/".join(x for x in (manifest.base, folder.split("**")[0].rstrip("/")) if x)
        part = listed.option("recursiveFileLookup", deep).load(base).select("path", F.unix_micros("modificationTime").alias("us"), F.col("length").alias("n_bytes"))
        found = part if found is None else found.unionByName(part)
    return found.select("path", (F.col("us") / 1e6).alias("mtime"), "n_bytes").distinct()
