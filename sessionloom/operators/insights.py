"""Insights drawn from transcripts by an exchangeable extractor, and validated.

The extractor is any function from a text to a list of dicts; it runs on whole
Arrow batches of chunks. Gates and redaction come before it, since it is the
costly step, and nothing it returns is kept that the transcript doesn't bear out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.functions import redact as R
from sessionloom.functions import text as T
from sessionloom.sources import transcripts as X

# What an insight may say of itself, and how much of a session is read.
CATEGORIES = ["pattern", "decision", "anti-pattern", "preference", "tool", "warning"]
LAYERS = ["user", "project", "global", "working", "episodic", "semantic"]
EVIDENCE_WORDS = (5, 25)
WINDOW_CHARS, CHUNK_CHARS, CHUNKS, PER_SESSION, ENTITIES = 180_000, 30_000, 6, 8, 5
FIELDS = ["category", "title", "context", "implication", "layer", "evidence"]
Extractor = Callable[[str], list[dict]]

_CUES = {"decision": r"(?:Decision|Decisione|Decisión|Beschluss)", "preference": r"(?:My preference|Preference)", "warning": r"(?:Warning|Attenzione|Achtung)"}
_CUED = re.compile("|".join(rf"(?P<{kind}>{words})(?: is)?:? " for kind, words in _CUES.items()))


def by_cues(text: str) -> list[dict]:
    """The extractor that needs no model: sentences that call themselves a decision, a preference or a warning."""
    out = []
    for m in _CUED.finditer(text):
        said = re.match(r"[^\n]{10,400}?[.!?](?=\s|$)", text[m.end() :])
        if said:
            evidence = " ".join(said.group().split()[: EVIDENCE_WORDS[1]])
            out.append({"category": m.lastgroup, "title": said.group()[:80], "context": said.group(), "implication": "", "layer": "project", "confidence": 0.6, "evidence": evidence, "entities": []})
    return out


def coerce(raw: object) -> dict:
    """One insight with all fields, whatever the extractor left out; up to five distinct entities of two letters or more."""
    raw = raw if isinstance(raw, dict) else {}
    text = lambda k: raw[k].strip() if isinstance(raw.get(k), str) else ""
    try:
        confidence = float(raw.get("confidence"))
    except (TypeError, ValueError):
        confidence = None
    seen: dict[str, str] = {}
    for e in raw.get("entities") if isinstance(raw.get("entities"), list) else []:
        if isinstance(e, str) and len(e.strip()) > 1:
            seen.setdefault(e.strip().casefold(), e.strip())
    return {k: text(k) for k in FIELDS} | {"confidence": confidence, "entities": list(seen.values())[:ENTITIES]}


def is_valid(source: Column) -> Column:
    """Known category and layer, a title, a confidence from 0 to 1, and 5 to 25 words of evidence that stand in ``source``."""
    said = lambda c: T.squeeze(F.lower(c))
    words = F.size(F.split(F.trim("evidence"), r"\s+"))
    return (
        F.col("category").isin(CATEGORIES) & F.col("layer").isin(LAYERS) & (F.col("title") != "") & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
        & words.between(*EVIDENCE_WORDS) & said(source).contains(said(F.col("evidence")))
    )


_ARROW = pa.schema([(k, pa.string()) for k in FIELDS] + [("confidence", pa.float64()), ("entities", pa.list_(pa.string()))])


def extract(sessions: DataFrame, extractor: Extractor = by_cues, window: int = WINDOW_CHARS, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(session_id, project_id, chunk_no, place, insight fields) of the valid insights, at most eight per session.

    ``sessions`` has session_id, project_id and the transcript's ``text``, a row
    each. The newest window is redacted and cut into whole lines; the newest six
    chunks are read, newest first. Of equal titles in a session the first
    counts. An extractor that fails on a chunk yields nothing for it. Null and
    empty texts have no insights; a repeated session row repeats its rows.
    """
    runtime.require_columns(sessions, "session_id", "project_id", "text")
    source = R.redact(X.newest_window(F.col("text"), window))
    read = sessions.where("text <> ''").select("session_id", "project_id", source.alias("source"))
    pieces = F.slice(F.reverse(X.chunks(F.col("source"), chunk)), 1, CHUNKS)
    chunks = read.select("session_id", "project_id", "source", F.posexplode(pieces).alias("chunk_no", "chunk"))
    keys = ["session_id", "project_id", "source", "chunk_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, out = [], [], []
            for i, text in enumerate(b.column("chunk").to_pylist()):
                try:
                    found = extractor(text)
                except Exception:  # noqa: BLE001 - an extractor is foreign code
                    found = []
                for n, raw in enumerate(found if isinstance(found, list) else []):
                    at.append(i)
                    place.append(n)
                    out.append(coerce(raw))
            taken = [b.column(k).take(pa.array(at, pa.int32())) for k in keys]
            cells = [pa.array([o[f.name] for o in out], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(place, pa.int32()), *cells], [*keys, "place", *_ARROW.names])

    schema = "session_id string, project_id string, source string, chunk_no int, place int, " + ", ".join(f"{k} string" for k in FIELDS) + ", confidence double, entities array<string>"
    kept = chunks.mapInArrow(run, schema).where(is_valid(F.col("source"))).drop("source")
    first = F.struct("chunk_no", "place")
    once = kept.groupBy("session_id", T.title_key(F.col("title")).alias("_t")).agg(F.min_by(F.struct(*kept.columns), first).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("chunk_no", "place"))
    return once.withColumn("_k", rank).where(F.col("_k") <= PER_SESSION).drop("_k")


def as_episodes(insights: DataFrame, as_of: float, source_type: str = "transcript") -> DataFrame:
    """Rows of the episode table; the id comes from session and key, so the same insight has the same id again."""
    body = F.concat(F.lit("**Context:** "), "context", F.when(F.col("implication") != "", F.concat(F.lit("\n\n**Implication:** "), "implication")).otherwise(""))
    rows = insights.select("*", body.alias("body"))
    own = F.when(F.size("entities") > 0, F.col("entities")).otherwise(T.entities(F.col("title"), F.col("body")))
    return rows.select(
        F.left(F.sha2(F.concat_ws("\x1f", "session_id", T.dedup_key(F.col("title"), F.col("body"))), 256), F.lit(32)).alias("id"), "project_id",
        F.lit("working").alias("kind"), F.lit(source_type).alias("source_type"), F.col("session_id").alias("source_ref"), "category", "title", "body", "confidence",
        F.lit(as_of).alias("created_at"), F.lit(as_of).alias("updated_at"), F.to_json(F.struct("evidence", "layer", F.col("chunk_no").alias("chunk"))).alias("raw_payload"),
        T.dedup_key(F.col("title"), F.col("body")).alias("dedup_key"), own.alias("entities"), F.lit(False).alias("pinned"), F.lit(0).cast("bigint").alias("access_count"),
        F.lit(None).cast("double").alias("last_accessed_at"), F.lit(None).cast("double").alias("expires_at"),
    )


def note(spark: SparkSession, project_id: str, title: str, body: str, as_of: float, category: str = "neutral", entities: list[str] | None = None) -> DataFrame:
    """One episode written by hand: full confidence, entities from its text unless they are given."""
    row = spark.createDataFrame([("manual", project_id, title, category, body)], "session_id string, project_id string, title string, category string, context string")
    blank = {k: F.lit("") for k in ("implication", "evidence")} | {"layer": F.lit("user"), "chunk_no": F.lit(0), "confidence": F.lit(1.0)}
    own = F.array(*map(F.lit, entities)) if entities else T.entities(F.lit(title), F.lit(body))
    made = as_episodes(row.withColumns(blank | {"entities": own}), as_of, "manual")
    return made.withColumns(
        {"body": F.lit(body), "kind": F.lit("semantic"), "source_ref": F.lit(None).cast("string"), "dedup_key": T.dedup_key(F.lit(title), F.lit(body)), "entities": own}
    )
