"""Queries of the text problems (2, 4, 6, 8, 9, 10) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.llm import conversations, mixing, packing, pii, splitting, tokens, truncation
from sessionloom.operators import timestamps
from sessionloom.plans import preparation
from sessionloom.runtime import table

#: The key of the pseudonyms in these queries. Real corpora need a secret one.
DEMO_KEY = b"sessionloom-demo-key"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "transcript_lines").select(F.lit("transcript_lines").alias("tbl"), "id", F.col("msg_content").alias("text"))
    notes = table(spark, sf_dir, "episodes").select(F.lit("episodes").alias("tbl"), "id", F.col("body").alias("text"))
    return lines.unionByName(notes).withColumn("text_key", F.md5("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of personal information that each record's text holds."""
    texts = _texts(spark, sf_dir)
    found = pii.pseudonymise(texts, "text", DEMO_KEY, pii.name_parts(texts, "text"), record="text_key")
    kinds = F.array_remove(pii.types_found(), "birth_date")  # the statement of the found cases knows no dates
    return found.select("tbl", "id", F.explode(kinds).alias("pii_type")).distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of the personal information."""
    texts = _texts(spark, sf_dir)
    found = pii.pseudonymise(texts, "text", DEMO_KEY, pii.name_parts(texts, "text"), record="text_key")
    return found.select("tbl", "id", "pii.redacted", F.size("pii.findings").alias("n_findings"))


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    if row is None:
        raise ValueError(f"size_limits has no row {name}")
    return row[0], row[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that had to be cut, and whether they hold a run without whitespace that no natural boundary can cut."""
    size, overlap = _limit(spark, sf_dir, "msg_content")
    lines = table(spark, sf_dir, "transcript_lines").select("id", "msg_content")
    cut = splitting.oversized(lines, "msg_content", size, overlap).where(F.size("split.pieces") > 1)
    # A run above the limit makes some cut fall inside it; the run itself tells it from one of between core and limit.
    forced = F.exists("split.pieces", lambda p: p["boundary"] == "forced") & (F.col("split.longest_run") > size)
    return cut.select("id", F.when(forced, "forced").otherwise("clean").alias("cut_kind")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every record's content, in order."""
    size, overlap = _limit(spark, sf_dir, "msg_content")
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", "id", "msg_content")
    return splitting.split(lines, "msg_content", size, overlap).select("line_id", "id", F.explode("split.pieces").alias("p")).select("line_id", "id", "p.*")


def p4_given_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized record: what its pieces give without their overlaps, and whether none is too long and all overlaps are whole."""
    size, overlap = _limit(spark, sf_dir, "msg_content")
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", "msg_content")
    cut = splitting.oversized(lines, "msg_content", size, overlap).select("line_id", F.col("split.pieces").alias("p"))
    own = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.lit(overlap + 1), F.char_length(x["piece"]))))
    shared = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.endswith(a["piece"], F.left(b["piece"], F.lit(overlap)))), lambda ok: ok)
    fits = F.forall("p", lambda x: F.char_length(x["piece"]) <= size)
    return cut.select("line_id", F.md5(F.array_join(own, "")).alias("text_md5"), (fits & shared).alias("holds"))


def _log_and_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = conversations.fold(table(spark, sf_dir, "transcript_lines"))
    zones = table(spark, sf_dir, "sessions").groupBy("session_id").agg(F.first("tz_name", ignorenulls=True).alias("tz_name"))
    turns = conversations.messages(log).join(zones, "session_id", "left")
    timed = timestamps.normalise(turns, "event_timestamp", "tz_name", "lines", preparation.dictionary(spark))
    return log, conversations.in_order(timed.select("session_id", "id", "parent_id", "line_id", "seq", "speaker", "instant"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are no whole conversation, and why."""
    log, ordered = _log_and_turns(spark, sf_dir)
    return conversations.faults(table(spark, sf_dir, "sessions"), log, ordered)


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all whole conversations, in order."""
    log, ordered = _log_and_turns(spark, sf_dir)
    dropped = conversations.faults(table(spark, sf_dir, "sessions"), log, ordered)
    return conversations.conversations(table(spark, sf_dir, "transcript_lines"), ordered, dropped)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "documents_text")
    return packing.pack(tokens.sized(table(spark, sf_dir, "documents"), "text", ["doc_id"]), capacity)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split."""
    return _packed(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    return _packed(spark, sf_dir)


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.usage(_packed(spark, sf_dir), _limit(spark, sf_dir, "documents_text")[0])


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, whether each is there once as a whole, and whether no container is overfull."""
    capacity, _ = _limit(spark, sf_dir, "documents_text")
    pieces = runtime.materialise(_packed(spark, sf_dir), "pieces")
    n_tokens = F.sum(F.col("token_stop") - F.col("token_start"))
    full = pieces.groupBy("container_id").agg(n_tokens.alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("got"), F.max("n_pieces").alias("meant"), F.countDistinct("piece_no").alias("different"))
    whole = docs.agg(F.count("*").alias("n_documents"), F.coalesce(F.bool_and((F.col("got") == F.col("meant")) & (F.col("different") == F.col("got"))), F.lit(True)).alias("all_whole"))
    both = whole.unionByName(full.select((F.col("most") <= capacity).alias("none_overfull")), allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("n_documents", "all_whole", "none_overfull")))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: whether its share is met to one per cent and no document is used too often."""
    got = p9_shares(spark, sf_dir)
    return got.select("source_name", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.sized(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut off."""
    return truncation.detect(table(spark, sf_dir, "documents")).where("truncated").select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its documents."""
    return truncation.by_source(truncation.detect(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_redacted": p2_redacted,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_given_back": p4_given_back,
        "p6_found": p6_found,
        "p6_conversations": p6_conversations,
        "p8_found": p8_found,
        "p8_containers": p8_containers,
        "p8_usage": p8_usage,
        "p8_invariants": p8_invariants,
        "p9_selection": p9_selection,
        "p9_shares": p9_shares,
        "p9_invariants": p9_invariants,
        "p10_found": p10_found,
        "p10_sources": p10_sources,
    }


_SPEAKER = """CASE WHEN regexp_matches(lower(coalesce(event_type, '')), 'reason|think|tool|function|system|session|meta|title|usage|token') THEN NULL
 WHEN coalesce(trim(msg_role), '') <> '' THEN CASE WHEN lower(trim(msg_role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(msg_role)) IN ('assistant', 'ai', 'model') THEN 'assistant' END
 WHEN event_type IN ('user', 'user.message', 'turn.prompt') THEN 'user' WHEN event_type IN ('assistant', 'assistant.message') THEN 'assistant' END"""


_TURNS = f"""l AS (SELECT DISTINCT session_id, seq, id, parent_id, event_timestamp, {_SPEAKER} AS speaker, trim(coalesce(msg_content, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' AS is_blank, msg_content FROM transcript_lines),
 ok AS (SELECT session_id, id FROM l n WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.session_id = n.session_id AND p.id = n.parent_id)
  UNION SELECT n.session_id, n.id FROM l n JOIN ok ON ok.session_id = n.session_id AND ok.id = n.parent_id),
 m AS (SELECT session_id, seq, id, parent_id, speaker, us, msg_content FROM l LEFT JOIN sessions USING (session_id) LEFT JOIN stamps ON raw = event_timestamp AND tz IS NOT DISTINCT FROM tz_name WHERE speaker IS NOT NULL AND NOT is_blank),
 e AS (SELECT *, coalesce(us, last_value(us IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -9e18) AS place FROM m),
 f AS (SELECT *, lead(speaker) OVER (PARTITION BY session_id ORDER BY place, seq, id) AS after, lead(parent_id) OVER (PARTITION BY session_id ORDER BY place, seq, id) AS after_parent FROM e),
 faults AS (SELECT DISTINCT session_id, 'broken' AS fault FROM l WHERE session_id IN (SELECT session_id FROM sessions) AND ((parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l p WHERE p.session_id = l.session_id AND p.id = l.parent_id)) OR NOT EXISTS (SELECT 1 FROM ok WHERE ok.session_id = l.session_id AND ok.id = l.id))
  UNION SELECT session_id, 'empty' FROM sessions WHERE session_id NOT IN (SELECT session_id FROM m)
  UNION SELECT session_id, 'no_reply' FROM f WHERE speaker = 'user' AND coalesce(after, 'user') = 'user' AND session_id IN (SELECT session_id FROM sessions))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH RECURSIVE {preparation.STAMPS_SQL}, {_TURNS} SELECT session_id, fault FROM faults",
        # Of answers that follow one another to one parent the last one stays.
        "p6_conversations": f"""WITH RECURSIVE {preparation.STAMPS_SQL}, {_TURNS}
 SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY place, seq, id) - 1 AS turn_no, id, speaker, make_timestamp(us) AS instant, msg_content AS content FROM f
 WHERE session_id NOT IN (SELECT session_id FROM faults) AND NOT (speaker = 'assistant' AND coalesce(parent_id, '') <> '' AND coalesce(after, '') = 'assistant' AND after_parent IS NOT DISTINCT FROM parent_id)""",
        "p4_found": """SELECT DISTINCT id, CASE WHEN list_max(list_transform(string_split_regex(msg_content, '\\s+'), lambda x: length(x))) > max_size THEN 'forced' ELSE 'clean' END AS cut_kind
 FROM transcript_lines, size_limits WHERE limit_name = 'msg_content' AND length(msg_content) > max_size""",
        "p4_given_back": "SELECT line_id, md5(msg_content) AS text_md5, true AS holds FROM transcript_lines, size_limits WHERE limit_name = 'msg_content' AND length(msg_content) > max_size",
        "p8_invariants": "SELECT count(*) AS n_documents, true AS all_whole, true AS none_overfull FROM documents WHERE text <> ''",
        "p9_invariants": "SELECT source_name, true AS share_met, true AS repeats_kept FROM mix_targets",
    }
