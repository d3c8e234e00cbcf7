"""Queries of the engine's operators over the test tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as T
from sessionloom.operators import episodes as E
from sessionloom.operators import eventlog as L
from sessionloom.operators import insights as N
from sessionloom.operators import recall as Q
from sessionloom.operators import rollups as U
from sessionloom.plans import views as V
from sessionloom.runtime import scratch_path, table
from sessionloom.sources import archive as A
from sessionloom.sources import manifests as M
from sessionloom.sources import transcripts as X
from sessionloom.streaming import ingest as I

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = V.AS_OF
WORDS = "snapshot marker qualità"
_DAYS_BACK = 100
NAMES = "Gap budget"


def query(name: str, sql: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _words(sql_text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({sql_text})), '[\\p{{L}}\\p{{N}}]+')"


_TEXT = "concat_ws(' ', title, body, category)"
_VISIBLE = f"(expires_at IS NULL OR expires_at > {AS_OF} OR coalesce(pinned, false))"


def _bm25_sql(words: list[str], combine: str, where: str = _VISIBLE) -> str:
    terms = [("qualita" if w == "qualità" else w) for w in words]
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    n = range(len(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in n)
    idf = lambda i: f"CASE WHEN (nn - d{i} + 0.5e0) / (d{i} + 0.5e0) <= 1 THEN 1e-6 ELSE ln((nn - d{i} + 0.5e0) / (d{i} + 0.5e0)) END"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2e0 / (f{i} + 1.2e0 * (0.25e0 + 0.75e0 * wl / av))" for i in n)
    cond = f" {combine} ".join(f"f{i} > 0" for i in n)
    return f"""w AS (SELECT *, {_words(_TEXT)} AS w FROM e), c AS (SELECT *, len(w) AS wl, {tf} FROM w),
 s AS (SELECT count(*) AS nn, avg(wl) AS av, {df} FROM c),
 b AS (SELECT id, round({score}, 6) AS bm25 FROM c, s WHERE ({cond}) AND {where})"""


# Recall


@query("tokenize_fold", f"WITH {V.EPISODES} SELECT id, array_to_string({_words('title')}, ' ') AS tokens FROM e")
def tokenize_fold(spark, d) -> DataFrame:
    return V.episodes(spark, d).select("id", F.array_join(T.tokens(F.col("title")), " ").alias("tokens"))


@query(
    "inverted_index",
    f"WITH {V.EPISODES}, t AS (SELECT id, unnest({_words('title')}) AS term, generate_subscripts({_words('title')}, 1) - 1 AS pos FROM e) SELECT term, id, count(*) AS tf, array_to_string(list_sort(list(pos)), ',') AS positions FROM t GROUP BY term, id",
)
def inverted_index(spark, d) -> DataFrame:
    index = Q.inverted_index(V.episodes(spark, d), "id", F.col("title"))
    return index.select("term", "id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("recall_bm25", f"WITH {V.EPISODES}, {_bm25_sql(WORDS.split()[:2], 'AND')} SELECT id, bm25 FROM b")
def recall_bm25(spark, d) -> DataFrame:
    words = " ".join(WORDS.split()[:2])
    return Q.bm25_of(V.index(spark, d), words, "AND", V.episodes(spark, d).where(Q.visible(AS_OF))).select("id", F.round("bm25", 6).alias("bm25"))


@query("recall_bm25_or", f"WITH {V.EPISODES}, {_bm25_sql(WORDS.split(), 'OR')} SELECT id, bm25 FROM b")
def recall_bm25_or(spark, d) -> DataFrame:
    return Q.bm25_of(V.index(spark, d), WORDS, "OR", V.episodes(spark, d).where(Q.visible(AS_OF))).select("id", F.round("bm25", 6).alias("bm25"))


_ENTITY_ROWS = f"SELECT DISTINCT id, created_at, lower(x) AS entity_lower FROM (SELECT id, created_at, unnest(entities) AS x FROM e WHERE {_VISIBLE}) WHERE starts_with(lower(x), 'gap') OR starts_with(lower(x), 'budget')"
_AUTHORITY_ROWS = f"SELECT id, created_at FROM e WHERE {_VISIBLE} AND pinned AND (contains(lower(CAST(to_json(entities) AS VARCHAR)), 'gap') OR contains(lower(CAST(to_json(entities) AS VARCHAR)), 'budget'))"


@query("recall_entities", f"WITH {V.EPISODES} SELECT id, entity_lower FROM ({_ENTITY_ROWS})")
def recall_entities(spark, d) -> DataFrame:
    return Q.entity_hits(V.episodes(spark, d), NAMES, Q.visible(AS_OF)).select("id", "entity_lower")


@query("recall_authority", f"WITH {V.EPISODES} SELECT id FROM ({_AUTHORITY_ROWS})")
def recall_authority(spark, d) -> DataFrame:
    return Q.authority_hits(V.episodes(spark, d), NAMES, Q.visible(AS_OF)).select("id")


def _fused_sql(words: list[str], combine: str, limit: int, depth: int) -> str:
    # The streams by name: authority 0, bm25 1, entities 2.
    return f"""WITH {V.EPISODES}, {_bm25_sql(words, combine)},
 st AS (SELECT id, 1 AS stream, row_number() OVER (ORDER BY bm25 DESC, id) - 1 AS place FROM b
  UNION ALL SELECT id, 2, row_number() OVER (ORDER BY created_at DESC, id, entity_lower) - 1 FROM ({_ENTITY_ROWS})
  UNION ALL SELECT id, 0, row_number() OVER (ORDER BY created_at DESC, id) - 1 FROM ({_AUTHORITY_ROWS})),
 g AS (SELECT id, sum(1e0 / (61 + place)) AS score, min({{'s': stream, 'p': place}}) AS f FROM st WHERE place < {depth} GROUP BY id),
 r AS (SELECT id, score FROM g ORDER BY round(score, 9) DESC, f.s, f.p, id LIMIT {limit})"""


@query("rrf_fuse", _fused_sql(["gap", "budget"], "OR", 20, 120) + " SELECT id, round(score, 6) AS score FROM r")
def rrf_fuse(spark, d) -> DataFrame:
    return Q.fused(V.episodes(spark, d), NAMES, AS_OF, combine="OR", index=V.index(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(
    "recall",
    _fused_sql(["gap", "budget"], "OR", 20, 120) + " SELECT e.id, e.project_id, e.kind, e.title, left(e.body, 400) AS preview, round(score, 6) AS score FROM r JOIN e USING (id)",
)
def recall(spark, d) -> DataFrame:
    return Q.recall(V.episodes(spark, d), NAMES, AS_OF, combine="OR", index=V.index(spark, d))


@query(
    "synthesize_citations",
    _fused_sql(["gap", "budget"], "AND", 20, 120) + " SELECT e.id, e.title, left(trim(regexp_replace(e.body, '\\s+', ' ', 'g')), 200) AS excerpt FROM r JOIN e USING (id)",
)
def synthesize_citations(spark, d) -> DataFrame:
    rows, index = V.episodes(spark, d), V.index(spark, d)
    best = Q.answered(lambda combine: Q.fused(rows, NAMES, AS_OF, combine=combine, index=index), NAMES)
    return rows.join(F.broadcast(best), "id").select("id", "title", F.left(F.trim(F.regexp_replace("body", r"\s+", " ")), F.lit(200)).alias("excerpt"))


@query(
    "synthesize_gaps",
    _fused_sql(["gap", "budget"], "OR", 20, 120)
    + " SELECT term FROM (VALUES ('budget'), ('zzyzx'), ('marker')) t(term) WHERE NOT EXISTS (SELECT 1 FROM r JOIN e USING (id) WHERE contains(lower(concat_ws(chr(10), title, body)), term))",
)
def synthesize_gaps(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    hits = rows.join(F.broadcast(Q.fused(rows, NAMES, AS_OF, combine="OR", index=V.index(spark, d)).select("id")), "id", "left_semi")
    return Q.gaps(hits, "gap budget zzyzx marker Budget")


@query("entity_index", f"WITH {V.EPISODES} SELECT DISTINCT lower(x) AS entity_lower, id, project_id FROM (SELECT id, project_id, unnest(entities) AS x FROM e)")
def entity_index(spark, d) -> DataFrame:
    return Q.entity_index(V.episodes(spark, d))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


# RE2 knows no Unicode word boundary. Each character that is no letter, digit or underscore is doubled, so that neighbours can both be bounded by one.
_SEPARATE = "[^\\p{L}\\p{N}_]"
_SPANS = ", ".join(
    f"list_transform(regexp_extract_all(t, '{_SEPARATE}({p}){_SEPARATE}', 1), lambda x: {{'k': {k}, 's': regexp_replace(x, '(\\s)\\s', '\\1', 'g')}})"
    for k, p in enumerate(["[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+", "[A-Z][a-zà-ú]{2,}(?:\\s+[A-Z][a-zà-ú0-9]{2,}){1,3}", "[A-Z][A-Z0-9]{2,}"])
)


@query(
    "heuristic_entities",
    f"""WITH {V.EPISODES}, w AS (SELECT id, regexp_replace(concat(' ', coalesce(title, ''), chr(10), coalesce(body, ''), ' '), '({_SEPARATE})', '\\1\\1', 'g') AS t FROM e),
 c AS (SELECT id, list_concat({_SPANS}) AS l FROM w), u AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c),
 f AS (SELECT id, x.s AS x, i FROM u WHERE NOT list_has_any(string_split_regex(lower(x.s), '\\s+'), [{_STOP}]) QUALIFY row_number() OVER (PARTITION BY id, lower(x.s) ORDER BY i) = 1),
 r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY -length(x), x) AS k FROM f)
 SELECT id, string_agg(x, '|' ORDER BY k) AS entities FROM r WHERE k <= 5 GROUP BY id""".replace("\\\\", "\\"),
)
def heuristic_entities(spark, d) -> DataFrame:
    found = V.episodes(spark, d).select("id", T.entities(F.col("title"), F.col("body")).alias("entities"))
    return found.where(F.size("entities") > 0).select("id", F.array_join("entities", "|").alias("entities"))


# Reading and filtering


@query("episodes_point_lookup", f"WITH {V.EPISODES} SELECT id, project_id, kind, title FROM e WHERE id = (SELECT min(id) FROM episodes)")
def episodes_point_lookup(spark, d) -> DataFrame:
    ident = table(spark, d, "episodes").agg(F.min("id")).first()[0]
    return E.latest(table(spark, d, "episodes").where(F.col("id") == ident)).select("id", "project_id", "kind", "title")


@query("episodes_recent", f"WITH {V.EPISODES} SELECT id, project_id, created_at FROM e ORDER BY created_at DESC, id LIMIT 100")
def episodes_recent(spark, d) -> DataFrame:
    return E.newest(V.episodes(spark, d), 100).select("id", "project_id", "created_at")


@query("episodes_filter", f"WITH {V.EPISODES} SELECT id, project_id, kind, confidence FROM e WHERE {_VISIBLE} AND project_id = 'lantern-core' AND kind = 'episodic' AND confidence >= 0.4 AND created_at >= {AS_OF - 200 * 86400}")
def episodes_filter(spark, d) -> DataFrame:
    where = Q.conditions(AS_OF, "lantern-core", "episodic", 0.4, AS_OF - 200 * 86400)
    return V.episodes(spark, d).where(where).select("id", "project_id", "kind", "confidence")


@query("ttl_visible", f"WITH {V.EPISODES} SELECT id, pinned, expires_at FROM e WHERE {_VISIBLE}")
def ttl_visible(spark, d) -> DataFrame:
    return V.episodes(spark, d).where(Q.visible(AS_OF)).select("id", "pinned", "expires_at")


@query("events_recent", f"WITH {V.LOG} SELECT event_id, project_id, source_type, CAST(payload->>'$.k' AS BIGINT) AS k FROM lg WHERE source_type = 'transcript' ORDER BY captured_at DESC, event_id LIMIT 100")
def events_recent(spark, d) -> DataFrame:
    rows = V.log(spark, d).where("source_type = 'transcript'").orderBy(F.col("captured_at").desc(), "event_id").limit(100)
    return rows.select("event_id", "project_id", "source_type", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


@query("json_extract", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, json_keys(props)[1] AS first_key FROM events")
def json_extract(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.element_at(F.json_object_keys("props"), 1).alias("first_key"))


# Counts and reports


@query("stats_by_kind", f"WITH {V.EPISODES} SELECT kind, count(*) AS n FROM e GROUP BY kind")
def stats_by_kind(spark, d) -> DataFrame:
    return V.episodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("distinct_projects", "SELECT DISTINCT project_id FROM episodes")
def distinct_projects(spark, d) -> DataFrame:
    return table(spark, d, "episodes").select("project_id").distinct()


_COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in Q.KINDS)


@query("handoff_counts", f"WITH {V.EPISODES} SELECT project_id, {_COUNTS}, count(*) AS total FROM e GROUP BY project_id")
def handoff_counts(spark, d) -> DataFrame:
    return V.episodes(spark, d).groupBy("project_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in Q.KINDS), F.count("*").alias("total"))


@query("project_kind_matrix", f"WITH {V.EPISODES} SELECT project_id, kind, category, count(*) AS n FROM e GROUP BY ALL")
def project_kind_matrix(spark, d) -> DataFrame:
    return V.episodes(spark, d).groupBy("project_id", "kind", "category").agg(F.count("*").alias("n"))


@query("validation_summary", f"WITH {V.EPISODES} SELECT kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, list_sort(list(confidence))[CAST(floor(count(confidence) / 2) AS BIGINT) + 1] AS upper_median FROM e GROUP BY kind")
def validation_summary(spark, d) -> DataFrame:
    # The upper median is that of the counts by value, so a kind's values aren't gathered.
    rows = V.episodes(spark, d)
    by_value = rows.where("confidence is not null").groupBy("kind", "confidence").count()
    order = Window.partitionBy("kind").orderBy("confidence")
    ranked = by_value.select("kind", "confidence", "count", F.sum("count").over(order).alias("upto"), F.sum("count").over(Window.partitionBy("kind")).alias("all"))
    middle = ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("kind").agg(F.min("confidence").alias("upper_median"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).join(middle, "kind", "left")


_CONTEXT = f"""x AS (SELECT id, project_id, coalesce(category, 'meta') AS type, created_at,
 CASE WHEN coalesce(confidence, 0) >= 0.8 THEN 'high' WHEN coalesce(confidence, 0) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
 coalesce(nullif(title, ''), nullif(left(body, 60), ''), id) AS content, coalesce(lower(raw_payload->>'$.assistant'), 'assistant') AS assistant,
 greatest(0.1e0, pow(0.9e0, greatest(0, floor(({AS_OF} - created_at) / 86400)) / 30e0)) AS st, coalesce(pinned, false) AS pinned
 FROM e WHERE created_at >= {AS_OF - 365 * 86400}), i AS (SELECT * EXCLUDE (st), round(st, 3) AS strength FROM x WHERE confidence <> 'low' AND st > 0.1)"""


@query("decay_strength", f"WITH {V.EPISODES} SELECT id, round(greatest(0.1e0, pow(0.9e0, greatest(0, floor(({AS_OF} - created_at) / 86400)) / 30e0)), 6) AS strength FROM e")
def decay_strength(spark, d) -> DataFrame:
    return V.episodes(spark, d).select("id", F.round(E.decayed(F.col("created_at"), AS_OF), 6).alias("strength"))


@query("preload_insights", f"WITH {V.EPISODES}, {_CONTEXT} SELECT id, type, confidence, content, strength, pinned FROM i ORDER BY pinned DESC, strength DESC, created_at DESC, confidence = 'high' DESC, id LIMIT 50")
def preload_insights(spark, d) -> DataFrame:
    rows = E.context(V.episodes(spark, d), AS_OF, 365).orderBy(*E.by_authority()).limit(50)
    return rows.select("id", "type", "confidence", "content", "strength", "pinned")


@query(
    "preload_ranked",
    _fused_sql(["gap", "budget"], "OR", 50, 300)
    + f", {_CONTEXT}, m AS (SELECT i.*, r.score FROM i JOIN r USING (id)), sp AS (SELECT min(score) AS lo, max(score) AS hi FROM m) SELECT id, content, strength, round(0.7e0 * (score - lo) / coalesce(nullif(hi - lo, 0), 1) + 0.3e0 * strength, 4) AS blend FROM m, sp",
)
def preload_ranked(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    return E.blended(E.context(rows, AS_OF, 365), Q.fused(rows, NAMES, AS_OF, 50, "OR", index=V.index(spark, d)).select("id", "score")).select("id", "content", "strength", "blend")


@query(
    "recurring_patterns",
    f"""WITH {V.EPISODES}, {_CONTEXT}, k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY pinned DESC, strength DESC, created_at DESC, confidence = 'high' DESC, id) AS rn, count(*) OVER (PARTITION BY type) AS n FROM i WHERE type <> 'code_change')
 SELECT type, n, max(created_at) FILTER (rn = least(5, n)) AS first_seen, max(created_at) FILTER (rn = 1) AS last_seen, string_agg(content, ' | ' ORDER BY rn) FILTER (rn <= 3) AS examples FROM k WHERE n >= 2 GROUP BY type, n""",
)
def recurring_patterns(spark, d) -> DataFrame:
    kept = E.context(V.episodes(spark, d), AS_OF, 365).where("type <> 'code_change'")
    n = kept.groupBy("type").agg(F.count("*").alias("n")).where("n >= 2")
    # The rank filter lets Spark cut each task's rows to five per type before the shuffle.
    first = kept.withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy(*E.by_authority()))).where("rn <= 5")
    seen = first.groupBy("type").agg(
        F.max_by("created_at", "rn").alias("first_seen"), F.min_by("created_at", "rn").alias("last_seen"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rn", "content"))), 1, 3), lambda x: x["content"]), " | ").alias("examples"),
    )
    return n.join(seen, "type")


@query("assistant_summary", f"WITH {V.EPISODES}, {_CONTEXT} SELECT assistant, count(*) AS n FROM i GROUP BY assistant")
def assistant_summary(spark, d) -> DataFrame:
    return E.context(V.episodes(spark, d), AS_OF, 365).groupBy("assistant").agg(F.count("*").alias("n"))


def _handoff(rows: DataFrame, kind: str, days: int | None, n: int) -> DataFrame:
    kept = rows.where(F.col("kind") == kind)
    kept = kept if days is None else kept.where(F.col("created_at") >= AS_OF - days * 86400)
    k = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), "id"))
    return kept.withColumn("k", k).where(F.col("k") <= n).select("project_id", F.col("k").cast("bigint").alias("k"), F.left("id", F.lit(12)).alias("short_id"), "title", "category")


def _handoff_sql(kind: str, days: int | None, n: int) -> str:
    since = "" if days is None else f" AND created_at >= {AS_OF - days * 86400}"
    return f"WITH {V.EPISODES} SELECT * FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS k, left(id, 12) AS short_id, title, category FROM e WHERE kind = '{kind}'{since}) WHERE k <= {n}"


@query("handoff_episodic", _handoff_sql("episodic", 90, 30))
def handoff_episodic(spark, d) -> DataFrame:
    return _handoff(V.episodes(spark, d), "episodic", 90, 30)


@query("handoff_semantic", _handoff_sql("semantic", None, 30))
def handoff_semantic(spark, d) -> DataFrame:
    return _handoff(V.episodes(spark, d), "semantic", None, 30)


@query("resume_sections", f"SELECT project_id, section, string_agg(concat('- ', title), chr(10) ORDER BY k) AS lines FROM (SELECT 'episodic' AS section, * FROM ({_handoff_sql('episodic', 90, 15)}) UNION ALL SELECT 'semantic', * FROM ({_handoff_sql('semantic', None, 10)})) GROUP BY project_id, section")
def resume_sections(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    both = _handoff(rows, "episodic", 90, 15).withColumn("section", F.lit("episodic")).unionByName(_handoff(rows, "semantic", None, 10).withColumn("section", F.lit("semantic")))
    listed = F.array_sort(F.collect_list(F.struct("k", "title")))  # at most 15
    return both.groupBy("project_id", "section").agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("lines"))


@query("focus_goal", f"WITH {V.EPISODES}, c AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS k FROM e WHERE kind IN ('episodic', 'semantic')), g AS (SELECT project_id, arg_min(title, k) AS goal FROM c WHERE k <= 5 AND confidence >= 0.6 AND title <> '' GROUP BY project_id) SELECT p.project_id, coalesce(goal, concat('working on ', p.project_id)) AS goal FROM (SELECT DISTINCT project_id FROM e) p LEFT JOIN g ON g.project_id IS NOT DISTINCT FROM p.project_id")
def focus_goal(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    k = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), "id"))
    five = rows.where("kind in ('episodic', 'semantic')").withColumn("k", k).where("k <= 5 and confidence >= 0.6 and title <> ''")
    goal = five.groupBy(F.col("project_id").alias("pid")).agg(F.min_by("title", "k").alias("goal"))
    every = rows.select("project_id").distinct()
    return every.join(goal, F.col("project_id").eqNullSafe(F.col("pid")), "left").select("project_id", F.coalesce("goal", F.concat(F.lit("working on "), "project_id")).alias("goal"))


# Keys, labels and texts


@query("dedup_key", f"WITH {V.EPISODES} SELECT id, sha256(concat(trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')), chr(0), coalesce(body, ''))) AS dedup_key FROM e")
def dedup_key(spark, d) -> DataFrame:
    return E.with_key(V.episodes(spark, d)).select("id", "dedup_key")


_KEYED = f"{V.EPISODES}, k AS (SELECT *, sha256(concat(trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')), chr(0), coalesce(body, ''))) AS dk FROM e)"


@query("persist_dedup", f"WITH {_KEYED}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id, dk ORDER BY created_at, id) AS rn FROM k WHERE kind = 'working') SELECT id, project_id FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.kind <> 'working' AND k.project_id = n.project_id AND k.dk = n.dk)")
def persist_dedup(spark, d) -> DataFrame:
    rows = E.with_key(V.episodes(spark, d))
    return E.unseen(rows.where("kind = 'working'"), rows.where("kind <> 'working'")).select("id", "project_id")


@query("title_dedup", f"WITH {V.EPISODES} SELECT arg_min(id, {{'c': created_at, 'i': id}}) AS id FROM e WHERE source_ref IS NOT NULL GROUP BY source_ref, trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))")
def title_dedup(spark, d) -> DataFrame:
    rows = V.episodes(spark, d).where("source_ref is not null")
    return E.first_per_key(rows, F.struct("source_ref", T.title_key(F.col("title"))), [F.col("created_at"), F.col("id")]).select("id")


@query("dedup_exists", f"WITH {_KEYED} SELECT id, EXISTS (SELECT 1 FROM k o WHERE o.kind <> 'working' AND o.project_id = k.project_id AND o.dk = k.dk) AS is_known FROM k WHERE kind = 'working'")
def dedup_exists(spark, d) -> DataFrame:
    rows = E.with_key(V.episodes(spark, d))
    known = rows.where("kind <> 'working'").select("project_id", "dedup_key").distinct().withColumn("y", F.lit(True))
    return rows.where("kind = 'working'").join(known, ["project_id", "dedup_key"], "left").select("id", F.coalesce("y", F.lit(False)).alias("is_known"))


@query("slugify", f"WITH {V.EPISODES}, s AS (SELECT id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[\\s_]', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM e) SELECT id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM s")
def slugify(spark, d) -> DataFrame:
    return V.episodes(spark, d).select("id", T.slug(F.col("title")).alias("slug"))


@query("normalize_project", "SELECT session_id, CASE WHEN name = '' THEN 'default' ELSE name END AS project FROM (SELECT session_id, regexp_replace(concat(split_part(cwd, '/', 3), CASE WHEN is_subagent THEN '-Workspace.code-workspace' ELSE '.code.json' END), '(-Workspace\\.code-workspace|\\.code-workspace|\\.code\\.json)$', '') AS name FROM sessions)")
def normalize_project(spark, d) -> DataFrame:
    suffix = F.when(F.col("is_subagent"), "-Workspace.code-workspace").otherwise(".code.json")
    return table(spark, d, "sessions").select("session_id", T.project_label(F.concat(F.split_part("cwd", F.lit("/"), F.lit(3)), suffix)).alias("project"))


@query("confidence_label", f"WITH {V.EPISODES} SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM e")
def confidence_label(spark, d) -> DataFrame:
    return V.episodes(spark, d).select("id", T.confidence_label(F.col("confidence")).alias("label"))


@query("archive_subdir", f"WITH {V.EPISODES} SELECT id, CASE WHEN coalesce(category, '') = '' THEN 'neutral' WHEN category IN ('anti-pattern', 'antipattern') THEN 'anti_pattern' WHEN category = 'bugfix' THEN 'fix' ELSE replace(category, '-', '_') END AS subdir FROM e")
def archive_subdir(spark, d) -> DataFrame:
    return V.episodes(spark, d).select("id", T.archive_subdir(F.col("category")).alias("subdir"))


@query("body_hash", "SELECT doc_id, left(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 16) AS body_hash FROM documents")
def body_hash(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.body_hash(F.col("text")).alias("body_hash"))


@query("date_parts", f"WITH {V.EPISODES} SELECT id, strftime(make_timestamp(CAST(floor(created_at) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, CAST(floor(({AS_OF} - created_at) / 86400) AS BIGINT) AS age_days, strftime(make_timestamp(CAST(floor(created_at / 86400) AS BIGINT) * 86400000000 + 86400000000), '%Y-%m-%dT%H:%M:%S') AS next_midnight FROM e")
def date_parts(spark, d) -> DataFrame:
    at = F.timestamp_seconds(F.floor("created_at"))
    return V.episodes(spark, d).select(
        "id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.floor((AS_OF - F.col("created_at")) / 86400).alias("age_days"),
        F.date_format(F.date_trunc("day", at) + F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss").alias("next_midnight"),
    )


_DEMO = "concat(coalesce(body, ''), ' api_key=', repeat('a1', 10), ' and token: short, bearer ', repeat('x', 24))"


@query("redact", f"WITH {V.EPISODES} SELECT id, replace(replace({_DEMO}, concat('api_key=', repeat('a1', 10)), '[REDACTED:generic-assignment]'), concat('bearer ', repeat('x', 24)), '[REDACTED:bearer-token]') AS redacted FROM e")
def redact(spark, d) -> DataFrame:
    text = F.concat(F.coalesce("body", F.lit("")), F.lit(" api_key=" + "a1" * 10 + " and token: short, bearer " + "x" * 24))
    return V.episodes(spark, d).select("id", R.redact(text).alias("redacted"))


@query("redaction_stats", f"WITH {V.EPISODES}, n AS (SELECT count(*) AS n FROM e) SELECT kind, n FROM n, (VALUES ('generic-assignment'), ('bearer-token')) k(kind) WHERE n > 0")
def redaction_stats(spark, d) -> DataFrame:
    text = F.concat(F.coalesce("body", F.lit("")), F.lit(" api_key=" + "a1" * 10 + " and token: short, bearer " + "x" * 24))
    return V.episodes(spark, d).select(F.explode(R.redaction_counts(text)).alias("kind", "k")).groupBy("kind").agg(F.sum("k").alias("n"))


# Writes


@query("episodes_upsert", f"WITH {V.EPISODES} SELECT id, title, CASE WHEN kind = 'working' THEN 'episodic' ELSE kind END AS kind, CASE WHEN kind = 'working' THEN 0.9 ELSE confidence END AS confidence, pinned, access_count, CAST(dedup_key IS NULL AS BOOLEAN) AS no_key FROM e UNION ALL SELECT concat('new-', id), title, 'episodic', 0.9, pinned, 7, false FROM e WHERE kind = 'semantic'")
def episodes_upsert(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    changed = {"kind": F.lit("episodic"), "confidence": F.lit(0.9), "access_count": F.lit(7).cast("bigint"), "dedup_key": F.lit("other")}
    known, new = rows.where("kind = 'working'").withColumns(changed), rows.where("kind = 'semantic'").withColumns(changed | {"id": F.concat(F.lit("new-"), "id")})
    return E.upsert(rows, known.unionByName(new)).select("id", "title", "kind", "confidence", "pinned", "access_count", F.col("dedup_key").isNull().alias("no_key"))


@query("touch_access", f"WITH {V.EPISODES} SELECT id, coalesce(access_count, 0) + CASE WHEN pinned THEN 1 ELSE 0 END AS access_count, CASE WHEN pinned THEN {AS_OF} ELSE last_accessed_at END AS last_accessed_at FROM e")
def touch_access(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    named = rows.where("pinned").select("id")
    return E.touch(rows, named.unionByName(named), AS_OF).select("id", "access_count", "last_accessed_at")


_VERDICT = "CASE event_type WHEN 'click' THEN 'helpful' WHEN 'view' THEN 'not_helpful' WHEN 'error' THEN 'stale' WHEN 'signup' THEN 'wrong' END"


@query(
    "feedback_fold",
    f"""WITH RECURSIVE {V.EPISODES}, n AS (SELECT id, CAST(concat('0x', left(id, 3)) AS BIGINT) AS k FROM e),
 v AS (SELECT n.id, epoch_us(ts) / 1e6 AS ts, {_VERDICT} AS verdict, row_number() OVER (PARTITION BY n.id ORDER BY ts, event_id) AS i FROM events JOIN n ON events.event_id % 4096 = n.k WHERE event_type <> 'purchase'),
 w AS (SELECT id, 0 AS i, coalesce(access_count, 0) AS a FROM e UNION ALL SELECT w.id, w.i + 1, CASE verdict WHEN 'helpful' THEN a + 1 WHEN 'not_helpful' THEN greatest(a - 1, 0) ELSE a END FROM w JOIN v ON v.id = w.id AND v.i = w.i + 1)
 SELECT e.id, (SELECT arg_max(a, i) FROM w WHERE w.id = e.id) AS access_count, coalesce(t.ended, e.expires_at) AS expires_at, CASE WHEN t.ended IS NOT NULL THEN false ELSE e.pinned END AS pinned FROM e LEFT JOIN (SELECT id, max(ts) FILTER (verdict IN ('stale', 'wrong')) AS ended FROM v GROUP BY id) t ON t.id = e.id""",
)
def feedback_fold(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    # Events go to the episodes whose id begins with the event's number in three hexadecimal digits.
    n = rows.select("id", F.conv(F.left("id", F.lit(3)), 16, 10).cast("bigint").alias("k"))
    verdict = F.try_element_at(F.create_map(*map(F.lit, ["click", "helpful", "view", "not_helpful", "error", "stale", "signup", "wrong"])), F.col("event_type"))
    given = table(spark, d, "events").where("event_type <> 'purchase'").select((F.col("event_id") % 4096).alias("k"), V.epoch("ts").alias("ts"), F.col("event_id").alias("seq"), verdict.alias("verdict"))
    return E.fold_feedback(rows, given.join(n, "k").drop("k")).select("id", "access_count", "expires_at", "pinned")


@query("migrate_backfill", f"WITH {_KEYED} SELECT id, coalesce(dedup_key, dk) AS dedup_key, CAST(1 AS BIGINT) AS version FROM k")
def migrate_backfill(spark, d) -> DataFrame:
    old = V.episodes(spark, d)
    newer = old.limit(0).withColumn("version", F.lit(1).cast("bigint"))
    merged = old.unionByName(newer, allowMissingColumns=True)
    return merged.select("id", F.coalesce("dedup_key", T.dedup_key(F.col("title"), F.col("body"))).alias("dedup_key"), F.coalesce("version", F.lit(1).cast("bigint")).alias("version"))


# Similarity

_PAIRS = f"{V.EPISODES}, s AS (SELECT id, project_id, kind, source_ref, list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda w: w <> '')) AS w FROM e WHERE title IS NOT NULL), p AS (SELECT a.id, b.kind, b.source_ref FROM s a JOIN s b ON a.project_id = b.project_id AND len(list_intersect(a.w, b.w)) >= 0.5 * greatest(len(a.w), len(b.w)))"


@query("similar_titles", f"WITH {_PAIRS} SELECT id, count(*) AS n_similar FROM p GROUP BY id")
def similar_titles(spark, d) -> DataFrame:
    return E.similar_titles(V.episodes(spark, d))


@query("session_mentions", f"WITH {_PAIRS} SELECT e.id, coalesce(n, 0) AS n_sessions FROM e LEFT JOIN (SELECT id, count(DISTINCT source_ref) FILTER (kind <> 'semantic') AS n FROM p GROUP BY id) USING (id) WHERE e.title IS NOT NULL")
def session_mentions(spark, d) -> DataFrame:
    return E.session_mentions(V.episodes(spark, d))


# The event log


@query("event_validation", f"WITH {V.LOG} SELECT event_id, CASE WHEN source_type = 'manual' THEN 'reserved source' WHEN source_type = 'transcript' THEN 'missing new_bytes,new_lines,session_id,transcript_path' WHEN source_type = 'git.commit' THEN 'missing author,files_changed_count,message_short,sha' ELSE 'unknown source' END AS problem FROM lg")
def event_validation(spark, d) -> DataFrame:
    return L.validated(V.log(spark, d)).select("event_id", "problem")


@query(
    "growth_gate",
    f"WITH {V.LOG}, m AS (SELECT session, arg_max(bytes, {{'a': captured_at, 'b': event_id}}) AS last_bytes FROM lg WHERE source_type = 'transcript.classified' GROUP BY session), n AS (SELECT session, max(bytes) AS bytes FROM lg WHERE source_type = 'transcript' GROUP BY session) SELECT session, bytes, last_bytes, CASE WHEN last_bytes IS NULL THEN 'new' WHEN bytes < last_bytes THEN 'shrunk' WHEN bytes - last_bytes < 2048 THEN 'same' ELSE 'grown' END AS decision FROM n LEFT JOIN m USING (session)",
)
def growth_gate(spark, d) -> DataFrame:
    log = V.log(spark, d)
    return L.growth(log.where(F.col("source_type") == L.DONE), log.where("source_type = 'transcript'").groupBy("session").agg(F.max("bytes").alias("bytes"))).select("session", "bytes", "last_bytes", "decision")


@query(
    "failure_backoff",
    f"WITH {V.LOG}, s AS (SELECT session, max({{'a': captured_at, 'b': event_id}}) FILTER (source_type = 'transcript.classified') AS ok FROM lg GROUP BY session) SELECT session, count(*) AS n_failures, max(captured_at) AS last_failure, count(*) >= 3 AND 1706745600e0 - max(captured_at) < 21600 AS waits FROM lg JOIN s USING (session) WHERE source_type = 'transcript.failed' AND (ok IS NULL OR {{'a': captured_at, 'b': event_id}} > ok) GROUP BY session",
)
def failure_backoff(spark, d) -> DataFrame:
    return L.backoff(V.log(spark, d), 1706745600.0)


@query("publish_commits_anti", f"WITH {V.LOG}, c AS (SELECT project_id, sha256(CAST(event_id AS VARCHAR)) AS sha, event_id, CAST(payload->>'$.k' AS BIGINT) AS k FROM lg WHERE source_type = 'git.commit') SELECT project_id, event_id, left(sha, 12) AS ref FROM c WHERE k >= 33")
def publish_commits_anti(spark, d) -> DataFrame:
    commits = V.log(spark, d).where("source_type = 'git.commit'").select("project_id", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), "source_type", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))
    log = commits.where("k < 33").withColumn("source_ref", F.left("sha", F.lit(12)))  # those with a low k stand for the published ones
    return L.unpublished(commits, log).select("project_id", "event_id", "ref")


@query(
    "git_log_sessionize",
    "SELECT project_id AS repo, row_number() OVER (PARTITION BY project_id ORDER BY doc_id) AS n, left(sha256(CAST(doc_id AS VARCHAR)), 40) AS sha, coalesce(category, '-') AS message, concat('src/', doc_id, '.py,docs/', doc_id, '.md') AS files FROM (SELECT * REPLACE (coalesce(project_id, 'none') AS project_id) FROM documents)",
)
def git_log_sessionize(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").na.fill("none", ["project_id"])
    head = F.concat_ws("||", F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(40)), F.lit("a"), F.lit("a@b.example"), F.lit("2026-01-01"), F.coalesce("category", F.lit("-")))
    path = lambda folder, end: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(end))
    lines = docs.select(F.col("project_id").alias("repo"), "doc_id", F.posexplode(F.array(head, F.lit(""), path("src/", ".py"), path("docs/", ".md"))).alias("i", "line"))
    got = L.commits_of(lines.select("repo", (F.col("doc_id") * 4 + F.col("i")).alias("line_no"), "line"))
    return got.select("repo", F.col("n").cast("bigint").alias("n"), "sha", "message", F.array_join("files_changed", ",").alias("files"))


@query(
    "stream_growth_gate",
    f"WITH {V.LOG}, m AS (SELECT *, last_value(CASE WHEN source_type = 'transcript.classified' THEN bytes END IGNORE NULLS) OVER (PARTITION BY session ORDER BY captured_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_bytes FROM lg) SELECT session, event_id, bytes, last_bytes, CASE WHEN last_bytes IS NULL THEN 'new' WHEN bytes < last_bytes THEN 'shrunk' WHEN bytes - last_bytes < 2048 THEN 'same' ELSE 'grown' END AS decision FROM m WHERE source_type = 'transcript'",
)
def stream_growth_gate(spark, d) -> DataFrame:
    """The gate as a stream with state, over all events as they lie there, run to their end."""
    path, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    log = V.log(spark, d).select("session", "event_id", "captured_at", "source_type", "bytes")
    # Files follow one another in time, as a log's do, and each makes a batch.
    edges = [float("-inf"), *sorted(set(log.approxQuantile("captured_at", [i / 8 for i in range(1, 8)], 0.01))), float("inf")]
    for low, high in zip(edges, edges[1:]):
        log.where((F.col("captured_at") > low) & (F.col("captured_at") <= high)).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    gate = I.growth_gate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    gate.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("session string, event_id bigint, bytes bigint, last_bytes bigint, decision string").parquet(out)


# Sessions, projects and files


@query("project_identity", "SELECT project_id, CASE WHEN regexp_full_match(project_id, '[a-z0-9][a-z0-9-]{0,31}') THEN project_id ELSE concat('auto-', left(sha256(root_path), 10)) END AS resolved, concat('auto-', left(sha256(root_path), 10)) AS fallback FROM projects")
def project_identity(spark, d) -> DataFrame:
    fallback = F.concat(F.lit("auto-"), F.left(F.sha2("root_path", 256), F.lit(10)))
    return table(spark, d, "projects").select("project_id", F.when(F.col("project_id").rlike("^[a-z0-9][a-z0-9-]{0,31}$"), F.col("project_id")).otherwise(fallback).alias("resolved"), fallback.alias("fallback"))


@query("project_clashes", "WITH p AS (SELECT DISTINCT concat('/r/', session_id) AS root_path, CASE WHEN regexp_full_match(project_id, '[a-z0-9][a-z0-9-]{0,31}') THEN project_id ELSE concat('auto-', left(sha256(concat('/r/', session_id)), 10)) END AS project_id FROM sessions) SELECT root_path, project_id, count(*) OVER (PARTITION BY project_id) > 1 AS clashes FROM p")
def project_clashes(spark, d) -> DataFrame:
    """Sessions' folders taken for project roots: ids that several of them would share."""
    return U.project_ids(table(spark, d, "sessions").select("project_id", F.concat(F.lit("/r/"), "session_id").alias("root_path")))


@query("entity_refresh", f"WITH {V.EPISODES}, n AS (SELECT id, project_id, CASE WHEN kind = 'semantic' THEN list_append(entities, 'Added') ELSE entities END AS entities FROM e WHERE kind <> 'working') SELECT DISTINCT lower(x) AS entity_lower, id, project_id FROM (SELECT id, project_id, unnest(entities) AS x FROM n)")
def entity_refresh(spark, d) -> DataFrame:
    """The entity index after the semantic episodes got one more name and the working ones went."""
    rows = V.episodes(spark, d)
    changed = rows.where("kind = 'semantic'").withColumn("entities", F.concat(F.coalesce("entities", F.array().cast("array<string>")), F.array(F.lit("Added"))))
    return Q.refresh_entities(Q.entity_index(rows), changed, rows.where("kind = 'working'").select("id"))


@query("session_project_attribution", "SELECT s.session_id, coalesce(p.project_id, 'other') AS project FROM sessions s LEFT JOIN projects p ON p.project_id = s.project_id AND p.display_name IS NOT NULL")
def session_project_attribution(spark, d) -> DataFrame:
    plan = table(spark, d, "projects").where("display_name is not null").select("project_id", F.col("project_id").alias("found"))
    return table(spark, d, "sessions").join(plan, "project_id", "left").select("session_id", F.coalesce("found", F.lit("other")).alias("project"))


@query(
    "project_scoring",
    """WITH p AS (SELECT project_id, root_path, lower(split_part(root_path, '/', -1)) AS name FROM projects WHERE NOT starts_with(project_id, 'auto-')),
 t AS (SELECT session_id, concat('cwd: ', cwd, ' (', coalesce(project_id, ''), ')') AS text FROM sessions),
 a AS (SELECT session_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+(?:-[a-z0-9_]+)*')) AS x FROM t),
 n AS (SELECT session_id, p.project_id, count(*) AS n FROM a JOIN p ON a.x = p.name GROUP BY ALL),
 r AS (SELECT session_id, p.project_id, CAST(3 AS BIGINT) AS n FROM t JOIN p ON contains(concat(text, '/'), concat(p.root_path, '/')) OR contains(text, concat(p.root_path, ' ')))
 SELECT session_id, CAST(sum(n) AS BIGINT) AS score, project_id FROM (SELECT * FROM n UNION ALL SELECT * FROM r) GROUP BY session_id, project_id QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sum(n) DESC, project_id) = 1""",
)
def project_scoring(spark, d) -> DataFrame:
    text = F.concat(F.lit("cwd: "), "cwd", F.lit(" ("), F.coalesce("project_id", F.lit("")), F.lit(")"))
    texts = table(spark, d, "sessions").select("session_id", text.alias("text"))
    return U.best_project(U.scores_by_project(texts, table(spark, d, "projects"), "session_id"), "session_id")


@query("longest_prefix_source", "WITH s AS (SELECT DISTINCT cwd FROM sessions), b AS (SELECT project_id AS source_id, root_path AS base FROM projects UNION ALL SELECT 'root', '/work') SELECT cwd AS path, arg_max(source_id, length(base)) AS source_id FROM s JOIN b ON cwd = base OR starts_with(cwd, concat(base, '/')) GROUP BY cwd")
def longest_prefix_source(spark, d) -> DataFrame:
    bases = table(spark, d, "projects").select(F.col("project_id").alias("source_id"), F.col("root_path").alias("base"))
    bases = bases.unionByName(spark.range(1).select(F.lit("root").alias("source_id"), F.lit("/work").alias("base")))
    return U.longest_prefix(table(spark, d, "sessions").select(F.col("cwd").alias("path")).distinct(), bases)


@query("cron_candidates", f"SELECT session_id, first_received_at FROM sessions WHERE epoch_us(first_received_at) / 1e6 > {AS_OF - 60 * 86400} AND epoch_us(first_received_at) / 1e6 <= {AS_OF - 600} AND n_bytes >= 4096")
def cron_candidates(spark, d) -> DataFrame:
    at = V.epoch("first_received_at")
    return table(spark, d, "sessions").where((at > AS_OF - 60 * 86400) & (at <= AS_OF - 600) & (F.col("n_bytes") >= 4096)).select("session_id", "first_received_at")


@query("cron_tick", f"SELECT session_id, n_bytes FROM sessions WHERE epoch_us(first_received_at) / 1e6 > {AS_OF - 7 * 86400 - _DAYS_BACK * 86400} AND epoch_us(first_received_at) / 1e6 <= {AS_OF - 600 - _DAYS_BACK * 86400} AND n_bytes >= 4096 ORDER BY first_received_at DESC, session_id DESC LIMIT 8")
def cron_tick(spark, d) -> DataFrame:
    """The eight newest candidates of a tick 100 days before the queries' now, when sessions were coming in."""
    now = AS_OF - _DAYS_BACK * 86400
    files = table(spark, d, "sessions").select("session_id", "n_bytes", V.epoch("first_received_at").alias("mtime"))
    return U.candidates(files, now).orderBy(F.col("mtime").desc(), F.col("session_id").desc()).limit(U.PER_TICK).select("session_id", "n_bytes")


_LABELLED = "w AS (SELECT s.*, lower(split_part(cwd, '/', -1)) AS label FROM sessions s), b AS (SELECT lower(split_part(root_path, '/', -1)) AS name, min(project_id) AS found_project FROM projects GROUP BY ALL), h AS (SELECT w.*, found_project FROM w LEFT JOIN b ON b.name = w.label WHERE n_bytes >= 4096)"


def _labelled(spark, d) -> DataFrame:
    label = F.element_at(F.split("cwd", "/"), -1)
    sessions = table(spark, d, "sessions").where("n_bytes >= 4096").withColumn("label", label)
    return U.by_workspace(sessions, table(spark, d, "projects").select("project_id", "root_path", F.lit(0).alias("place")))


@query("harvest_plan", f"WITH {_LABELLED} SELECT session_id, found_project, first_received_at FROM h ORDER BY first_received_at DESC, session_id DESC LIMIT 200")
def harvest_plan(spark, d) -> DataFrame:
    """The newest 200 large sessions with the project that their workspace names: a report of bounded length."""
    return _labelled(spark, d).orderBy(F.col("first_received_at").desc(), F.col("session_id").desc()).limit(200).select("session_id", "found_project", "first_received_at")


@query("harvest_distribution", f"WITH {_LABELLED} SELECT found_project, count(*) AS n FROM h GROUP BY found_project")
def harvest_distribution(spark, d) -> DataFrame:
    return _labelled(spark, d).groupBy("found_project").agg(F.count("*").alias("n"))


_RUNS = "r AS (SELECT CASE WHEN n_bytes IS NULL THEN 'missing' WHEN n_bytes < 4096 THEN 'skipped' ELSE 'ok' END AS status, coalesce(project_id, '?') AS project_id, CASE WHEN n_bytes >= 4096 THEN n_bytes / 1e6 END AS duration FROM sessions)"


@query("validation_report", f"WITH {_RUNS} SELECT 'status' AS measure, status AS name, count(*) AS n, round(avg(duration), 6) AS mean_seconds FROM r GROUP BY status UNION ALL SELECT 'project', project_id, count(*), round(avg(duration), 6) FROM r GROUP BY project_id")
def validation_report(spark, d) -> DataFrame:
    """Sessions taken for runs: their status by size, a duration in proportion to it."""
    n = F.col("n_bytes")
    status = F.when(n.isNull(), "missing").when(n < 4096, "skipped").otherwise("ok")
    runs = table(spark, d, "sessions").select(status.alias("status"), "project_id", F.when(n >= 4096, n / 1e6).alias("duration"))
    return U.run_report(runs).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("newest_session", "SELECT vendor, arg_max(session_id, {'a': first_received_at, 'b': session_id}) AS session_id FROM sessions GROUP BY vendor")
def newest_session(spark, d) -> DataFrame:
    return table(spark, d, "sessions").groupBy("vendor").agg(F.max_by("session_id", F.struct("first_received_at", "session_id")).alias("session_id"))


@query("session_idle_windows", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS is_new FROM events), g AS (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS ended, count(*) AS n_events FROM g GROUP BY user_id, n")
def session_idle_windows(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


_KIND = """CASE WHEN regexp_matches(lower(event_type), 'reason') OR lower(trim(msg_role)) = 'think' THEN 'reasoning'
 WHEN regexp_matches(lower(event_type), '^(session|title|metadata|system|session_meta)') OR lower(trim(msg_role)) = 'system' THEN NULL
 WHEN regexp_matches(lower(event_type), 'tool|function') OR lower(trim(msg_role)) IN ('tool', 'toolresult') THEN 'tool_calls'
 WHEN lower(trim(msg_role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(msg_role)) IN ('assistant', 'ai', 'model') THEN 'assistant'
 WHEN event_type IN ('user.message', 'turn.prompt', 'user') THEN 'user' WHEN event_type IN ('assistant.message', 'assistant') THEN 'assistant' END"""


@query("transcript_event_counts", f"WITH {V.LINES} SELECT session_id, {', '.join(f'count(*) FILTER (k = {k!r}) AS n_{k}' for k in X.KINDS)}, count(*) AS total_events FROM (SELECT session_id, {_KIND} AS k FROM tl) GROUP BY session_id")
def transcript_event_counts(spark, d) -> DataFrame:
    rows = V.lines(spark, d).select("session_id", X.line_kind(F.col("event_type"), F.col("msg_role")).alias("k"))
    return rows.groupBy("session_id").agg(*(F.count_if(F.col("k") == k).alias(f"n_{k}") for k in X.KINDS), F.count("*").alias("total_events"))


@query("transcript_format", f"WITH {V.LINES} SELECT session_id, seq, concat('[', left(event_timestamp, 19), '] [', CASE k WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'ASSISTANT reasoning' END, ']', chr(10), left(msg_content, CASE k WHEN 'reasoning' THEN 2000 ELSE 3000 END)) AS shown FROM (SELECT *, {_KIND} AS k FROM tl) WHERE k IN ('user', 'assistant', 'reasoning') AND msg_content <> ''")
def transcript_format(spark, d) -> DataFrame:
    kind = X.line_kind(F.col("event_type"), F.col("msg_role"))
    mark = F.when(F.col("k") == "user", "USER").when(F.col("k") == "assistant", "ASSISTANT").otherwise("ASSISTANT reasoning")
    text = F.left("msg_content", F.when(F.col("k") == "reasoning", X.REASONING_CHARS).otherwise(X.CONTENT_CHARS))
    rows = V.lines(spark, d).withColumn("k", kind).where("k in ('user', 'assistant', 'reasoning') and msg_content <> ''")
    return rows.select("session_id", "seq", F.concat(F.lit("["), F.coalesce(F.left("event_timestamp", F.lit(19)), F.lit("")), F.lit("] ["), mark, F.lit("]\n"), text).alias("shown"))


_RAW_KIND = f"""r AS (SELECT session_id, vendor, seq, event_type, {_KIND} AS k, coalesce(left(event_timestamp, 19), '') AS stamp, coalesce(msg_content, '') AS t FROM tl),
 p AS (SELECT *, CASE WHEN vendor IN ('omp', 'reasonix') THEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) ELSE t END AS solid FROM r)"""


def _vendor_lines(spark, d) -> DataFrame:
    """The transcript table's rows as the vendors write them: (session_id, line_no, line)."""
    rows = V.lines(spark, d).withColumn("k", X.line_kind(F.col("event_type"), F.col("msg_role")))
    text, k, lit, empty = F.coalesce("msg_content", F.lit("")), F.col("k"), F.lit, F.from_json(F.lit("{}"), "x int")
    s = lambda **kw: F.to_json(F.struct(F.col("event_timestamp").alias("timestamp"), *(v.alias(n) for n, v in kw.items())))
    o = lambda **kw: F.struct(*(v.alias(n) for n, v in kw.items()))
    call, other = o(name=lit("t"), arguments=empty), s(type=lit("title"))
    kinds = lambda user, assistant, reasoning, tool: F.when(k == "user", user).when(k == "assistant", assistant).when(k == "reasoning", reasoning).when(k == "tool_calls", tool).otherwise(other)
    item = lambda **kw: s(type=lit("response_item"), payload=o(**kw))
    loop = lambda **kw: s(type=lit("context.append_loop_event"), event=o(**kw))
    said = lambda role, **block: s(type=lit("message"), message=o(role=lit(role), content=F.array(o(**block))))
    raw = {
        "copilot": kinds(
            s(type=lit("user.message"), data=o(content=text)), s(type=lit("assistant.message"), data=o(content=text)), s(type=lit("assistant.message"), data=o(reasoningText=text)),
            s(type=F.when(F.col("event_type") == "tool.execution_complete", F.col("event_type")).otherwise("tool.execution_start"), data=o(toolName=lit("t"), arguments=empty)),
        ),
        "codex": kinds(
            *(item(type=lit("message"), role=lit(r), content=F.array(o(type=lit("input_text"), text=text))) for r in ("user", "assistant")),
            item(type=lit("reasoning"), summary=F.array(o(text=text))), item(type=lit("function_call"), name=lit("t"), arguments=empty),
        ),
        "kimi": kinds(
            s(type=lit("turn.prompt"), input=F.array(o(type=lit("text"), text=text))), loop(type=lit("content.part"), part=o(type=lit("text"), text=text)),
            loop(type=lit("content.part"), part=o(type=lit("think"), think=text)), loop(type=lit("tool.call"), name=lit("t"), args=empty),
        ),
        "grok": kinds(s(type=lit("user"), content=text), s(type=lit("assistant"), content=text), s(type=lit("reasoning"), summary=F.array(text)), s(type=lit("assistant"), tool_calls=F.array(call))),
        "reasonix": kinds(s(role=lit("user"), raw_content=text), s(role=lit("assistant"), content=text, reasoning_content=lit("")), s(role=lit("assistant"), reasoning_content=text), s(role=lit("tool"), name=lit("t"), tool_call_id=lit("c"), content=text)),
        "omp": kinds(said("user", type=lit("text"), text=text), said("assistant", type=lit("text"), text=text), said("assistant", type=lit("thinking"), thinking=text), said("assistant", type=lit("toolCall"), name=lit("t"), arguments=empty)),
    }
    line = F.lit(None).cast("string")
    for vendor, made in raw.items():
        line = F.when(F.col("vendor") == vendor, made).otherwise(line)
    return rows.select("session_id", F.col("seq").alias("line_no"), line.alias("line"))


@query("vendor_counts", f"WITH {V.LINES}, {_RAW_KIND} SELECT session_id, {', '.join(f'count(*) FILTER (k = {k!r} AND (k = {chr(39)}tool_calls{chr(39)} OR solid <> {chr(39)}{chr(39)})) AS {k}' for k in ('user', 'assistant', 'reasoning', 'tool_calls'))}, count(*) AS total_events FROM p GROUP BY session_id")
def vendor_counts(spark, d) -> DataFrame:
    lines = _vendor_lines(spark, d)
    return X.counts(X.events(lines, ["session_id", "line_no"]), lines, "session_id")


@query(
    "vendor_events",
    f"""WITH {V.LINES}, {_RAW_KIND}, w AS (SELECT *, CASE WHEN vendor = 'omp' THEN solid ELSE t END AS said FROM p WHERE k = 'tool_calls' OR solid <> '')
 SELECT session_id, seq AS line_no, vendor, k AS kind, md5(CASE WHEN k = 'tool_calls' THEN concat('[', stamp, '] [TOOL ', CASE WHEN event_type = 'tool.execution_complete' AND vendor = 'copilot' THEN '✓' ELSE '→' END, ' t] ',
   CASE WHEN vendor <> 'reasonix' THEN '{{}}' WHEN solid = '' THEN '(empty)' ELSE trim(left(trim(replace(t, chr(10), ' '), ' ' || chr(9) || chr(13)), 200), ' ' || chr(9) || chr(13)) END)
  ELSE concat('[', stamp, '] [', CASE k WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'ASSISTANT reasoning' END, ']', chr(10), left(said, CASE k WHEN 'reasoning' THEN 2000 ELSE 3000 END)) END) AS shown_md5 FROM w WHERE k IS NOT NULL""",
)
def vendor_events(spark, d) -> DataFrame:
    """Every part of the six vendors' lines, as it is shown."""
    return X.events(_vendor_lines(spark, d), ["session_id", "line_no"]).select("session_id", "line_no", "vendor", "kind", F.md5("shown").alias("shown_md5"))


@query("jsonl_parse_counts", "SELECT stream_id, count(*) AS n_lines, count(*) FILTER (json_valid(payload)) AS n_events FROM rollout_records GROUP BY stream_id")
def jsonl_parse_counts(spark, d) -> DataFrame:
    return table(spark, d, "rollout_records").groupBy("stream_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_event(F.col("payload"))).alias("n_events"))


_SAID = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(
    "insight_validation",
    f"""WITH {V.EPISODES}, i AS (SELECT *, coalesce(raw_payload->>'$.evidence', '') AS ev, raw_payload->>'$.layer' AS layer, concat(title, ' ', coalesce(body, '')) AS src FROM e WHERE raw_payload IS NOT NULL AND json_valid(raw_payload))
 SELECT id, coalesce(category IN ('pattern', 'decision', 'anti-pattern', 'preference', 'tool', 'warning') AND layer IN ('user', 'project', 'global', 'working', 'episodic', 'semantic') AND title <> '' AND confidence BETWEEN 0 AND 1
  AND len(string_split_regex(trim(ev), '\\s+')) BETWEEN 5 AND 25 AND contains({_SAID.format('src')}, {_SAID.format('ev')}), false) AS is_valid FROM i""",
)
def insight_validation(spark, d) -> DataFrame:
    rows = V.episodes(spark, d).where(X.is_event(F.col("raw_payload"))).withColumns({k: F.get_json_object("raw_payload", f"$.{k}") for k in ("evidence", "layer")})
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.lit("")))
    return rows.select("id", F.coalesce(N.is_valid(F.concat("title", F.lit(" "), F.coalesce("body", F.lit("")))), F.lit(False)).alias("is_valid"))


@query("budget_window", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE concat('[~', length(text) - 500 + greatest(pos - 1, 0), ' chars of older transcript omitted]', chr(10), substr(w, greatest(pos, 1))) END AS shown FROM (SELECT doc_id, text, right(text, 500) AS w, CASE WHEN starts_with(m, chr(10)) THEN strpos(right(text, 500), m) + 1 WHEN m <> '' THEN strpos(right(text, 500), m) ELSE 0 END AS pos FROM (SELECT doc_id, text, regexp_extract(right(text, 500), '(^|\\n)\\[[^\\]]+\\] \\[(USER|ASSISTANT)\\]') AS m FROM documents))")
def budget_window(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.newest_window(F.col("text"), 500).alias("shown"))


@query(
    "chunk_transcript",
    """WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS k FROM s),
 l AS MATERIALIZED (SELECT doc_id, i, x || CASE WHEN i < k THEN chr(10) ELSE '' END AS line FROM u WHERE i < k OR x <> '' OR k = 1),
 r AS (SELECT doc_id, i, CAST(0 AS INTEGER) AS chunk_no, length(line) AS size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.size + length(line) > 800 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN r.size + length(line) > 800 THEN length(line) ELSE r.size + length(line) END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
 SELECT doc_id, chunk_no, string_agg(line, '' ORDER BY i) AS chunk FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, chunk_no""",
)
def chunk_transcript(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 800)).alias("chunk_no", "chunk"))


@query("estimate_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS n_tokens FROM documents")
def estimate_tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("n_tokens"))


_MENTIONS = ", ".join(f"({i}, '{e}')" for i, e in enumerate(U.EXTENSIONS))
_MENTION_ROWS = f"""l AS (SELECT project_id, id, created_at, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM e WHERE kind IN ('working', 'episodic')),
 x AS (SELECT l.*, ext_no, list_filter(string_split_regex(trim(line), '\\s+'), lambda w: ends_with(w, ext))[1] AS path FROM l, (VALUES {_MENTIONS}) t(ext_no, ext) WHERE contains(line, '/')),
 q AS (SELECT project_id, path, min({{'a': -created_at, 'b': id, 'c': line_no, 'd': ext_no}}) AS pos FROM x WHERE path IS NOT NULL GROUP BY project_id, path)"""


_CHANGED = """z AS (SELECT project_id, concat(cwd, '/', replace(session_id, '-', '/'), CASE WHEN is_subagent THEN '.py' ELSE '.md' END) AS path, epoch_us(first_received_at) / 1e6 AS mt FROM sessions WHERE project_id IS NOT NULL),
 c AS (SELECT project_id, 'src/' || lang || '_' || (doc_id % 40) || '.py' AS path, doc_id FROM documents WHERE project_id IS NOT NULL)"""


@query(
    "working_set",
    f"""WITH {V.EPISODES}, {_MENTION_ROWS}, {_CHANGED},
 m AS (SELECT project_id, path, 0 AS p, row_number() OVER (PARTITION BY project_id ORDER BY mt DESC, path) AS k FROM z WHERE mt >= {AS_OF - 60 * 86400}
  UNION ALL SELECT project_id, path, 1, row_number() OVER (PARTITION BY project_id ORDER BY max(doc_id) DESC, path) FROM c WHERE path IS NOT NULL GROUP BY project_id, path
  UNION ALL SELECT project_id, path, 2, row_number() OVER (PARTITION BY project_id ORDER BY pos, path) FROM q),
 o AS (SELECT project_id, path, min({{'p': p, 'k': k}}) AS best FROM m GROUP BY project_id, path)
 SELECT project_id, path, priority, place FROM (SELECT project_id, path, best.p AS priority, row_number() OVER (PARTITION BY project_id ORDER BY best, path) AS place FROM o) WHERE place <= 20""",
)
def working_set(spark, d) -> DataFrame:
    sessions = table(spark, d, "sessions").where("project_id is not null")
    path = F.concat("cwd", F.lit("/"), F.replace("session_id", F.lit("-"), F.lit("/")), F.when(F.col("is_subagent"), ".py").otherwise(".md"))
    seen = sessions.select("project_id", path.alias("path"), V.epoch("first_received_at").alias("mtime"))
    changed = U.ranked(U.recent_files(seen, AS_OF, 60 * 86400, folders=None), [F.col("mtime").desc()])
    docs = table(spark, d, "documents").where("project_id is not null")
    committed = docs.select("project_id", F.concat(F.lit("src/"), "lang", F.lit("_"), (F.col("doc_id") % 40).cast("string"), F.lit(".py")).alias("path"), "doc_id").where("path is not null")
    committed = U.ranked(committed.groupBy("project_id", "path").agg(F.max("doc_id").alias("doc_id")), [F.col("doc_id").desc()])
    rows = V.episodes(spark, d).where("kind in ('working', 'episodic')")
    pos = F.struct((-F.col("created_at")).alias("a"), F.col("id").alias("b"), F.col("line_no").alias("c"), F.col("ext_no").alias("d"))
    mentioned = U.ranked(U.file_mentions(rows).groupBy("project_id", "path").agg(F.min(pos).alias("at")), [F.col("at")])
    return U.working_set(changed, committed, mentioned).select("project_id", "path", "priority", F.col("place").cast("bigint").alias("place"))


@query("union_streams", f"WITH {V.EPISODES} SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS k FROM e WHERE kind IN ('working', 'episodic')) WHERE k <= CASE kind WHEN 'working' THEN 50 ELSE 20 END")
def union_streams(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    return E.newest(rows.where("kind = 'working'"), 50).unionByName(E.newest(rows.where("kind = 'episodic'"), 20)).select("id", "kind")


# The archive

_FILES = "f AS (SELECT concat('/a/', coalesce(category, 'neutral'), '/', lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.md') AS path, coalesce(category, 'neutral') AS category, CASE WHEN doc_id % 50 = 0 THEN 'INSIGHT — Auto-captured' ELSE split_part(text, chr(10), 1) END AS title, text AS body, left(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 16) AS body_hash, CASE WHEN doc_id % 9 = 0 THEN 'low' ELSE 'high' END AS confidence FROM documents)"


def _files(spark, d) -> DataFrame:
    docs, category = table(spark, d, "documents"), F.coalesce("category", F.lit("neutral"))
    return docs.select(
        F.concat(F.lit("/a/"), category, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("path"), category.alias("category"),
        F.when(F.col("doc_id") % 50 == 0, "INSIGHT — Auto-captured").otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), F.col("text").alias("body"),
        T.body_hash(F.col("text")).alias("body_hash"), F.when(F.col("doc_id") % 9 == 0, "low").otherwise("high").alias("confidence"),
    )


@query("archive_cleanup", f"WITH {_FILES}, g AS (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY category, path) AS k FROM f), r AS (SELECT path, CASE WHEN confidence = 'low' THEN 'low-confidence' WHEN title = 'INSIGHT — Auto-captured' AND length(trim(regexp_replace(regexp_replace(body, '(?m)^# .+$', '', 'g'), '(?s)## Context.*', ''))) < 100 THEN 'generic' WHEN k > 1 THEN 'duplicate' END AS reason FROM g) SELECT path, reason FROM r WHERE reason IS NOT NULL")
def archive_cleanup(spark, d) -> DataFrame:
    return U.to_remove(_files(spark, d)).select("path", "reason")


@query("cleanup_report", f"WITH {_FILES}, g AS (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY category, path) AS k FROM f), r AS (SELECT CASE WHEN confidence = 'low' THEN 'l' WHEN title = 'INSIGHT — Auto-captured' AND length(trim(regexp_replace(regexp_replace(body, '(?m)^# .+$', '', 'g'), '(?s)## Context.*', ''))) < 100 THEN 'g' WHEN k > 1 THEN 'd' END AS r FROM g) SELECT count(*) AS total_before, count(*) FILTER (r = 'g') AS removed_generic, count(*) FILTER (r = 'd') AS removed_duplicate, count(*) FILTER (r = 'l') AS removed_low_confidence, count(r) AS total_removed, count(*) - count(r) AS kept FROM r")
def cleanup_report(spark, d) -> DataFrame:
    files = _files(spark, d)
    return U.cleanup_report(files, U.to_remove(files))


@query("archive_scan", "SELECT doc_id, regexp_extract(text, '(?s)^---\\n(.*?)\\n---\\n', 1) <> '' AS has_head, nullif(trim(regexp_extract(regexp_extract(text, '(?s)^---\\n(.*?)\\n---\\n', 1), '(?m)^project:(.*)$', 1)), '') AS project FROM documents")
def archive_scan(spark, d) -> DataFrame:
    files = table(spark, d, "documents").select("doc_id", "text", "category", F.col("doc_id").cast("string").alias("path"))
    return A.scan(files).select("doc_id", F.col("head").isNotNull().alias("has_head"), F.try_element_at("head", F.lit("project")).alias("project"))


@query("frontmatter_migrate", "SELECT session_id, concat_ws(chr(10), 'type: decision', concat('date: ', strftime(first_received_at, '%Y-%m-%d')), concat('timestamp: ', strftime(first_received_at, '%Y-%m-%d'), 'T00:00:00+00:00'), concat('project: ', coalesce(project_id, 'default')), 'workspace: ' || project_id || '.code-workspace', 'confidence: medium', 'assistant: assistant', 'mood: calm') AS head FROM sessions")
def frontmatter_migrate(spark, d) -> DataFrame:
    old = F.create_map(
        F.lit("date"), F.date_format("first_received_at", "yyyy-MM-dd"), F.lit("type"), F.lit("decision"), F.lit("mood"), F.lit("calm"), F.lit("workspace"), F.concat("project_id", F.lit(".code-workspace"))
    )
    return table(spark, d, "sessions").select("session_id", A.migrated(old).alias("head"))


_ISO = "strftime(make_timestamp(CAST(floor(created_at) AS BIGINT) * 1000000), '{}')"
_SLUG = "left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[\\s_]', '-', 'g'), '[^\\p{L}\\p{N}-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 40)"


@query(
    "markdown_render",
    f"""WITH {V.EPISODES} SELECT id, concat({_ISO.format('%Y-%m-%d')}, '-', left(id, 8), '-', CASE WHEN {_SLUG} = '' THEN 'untitled' ELSE {_SLUG} END, '.md') AS file_name,
 md5(concat_ws(chr(10), '---', concat('type: ', coalesce(category, 'neutral')), concat('date: ', {_ISO.format('%Y-%m-%d')}), concat('timestamp: ', {_ISO.format('%Y-%m-%dT%H:%M:%S')}, '+00:00'), 'project: ' || project_id, concat('confidence: ', CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END), concat('kind: ', kind), '---', '', concat('# ', title), '', rtrim(coalesce(body, '')), '', concat('Source: ', source_type, ' | Episode: ', id))) AS text_md5 FROM e""",
)
def markdown_render(spark, d) -> DataFrame:
    return A.render(V.episodes(spark, d)).select("id", "file_name", F.md5("text").alias("text_md5"))


@query("markdown_export", f"WITH {V.EPISODES} SELECT CASE WHEN coalesce(category, '') = '' THEN 'neutral' WHEN category IN ('anti-pattern', 'antipattern') THEN 'anti_pattern' WHEN category = 'bugfix' THEN 'fix' ELSE replace(category, '-', '_') END AS category, concat({_ISO.format('%Y-%m-%d')}, '-', left(id, 8), '-', CASE WHEN {_SLUG} = '' THEN 'untitled' ELSE {_SLUG} END, '.md') AS name, trim(title) AS title FROM e")
def markdown_export(spark, d) -> DataFrame:
    """All files written to a folder and read back from it."""
    folder = scratch_path(spark, "archive")
    A.write(A.render(V.episodes(spark, d)), folder)
    return A.scan(A.read(spark, folder)).select("category", F.element_at(F.split("path", "/"), -1).alias("name"), "title")


_NAMED = "(SELECT id FROM e WHERE starts_with(id, 'a') OR pinned)"


@query("forget_guard", f"WITH {V.EPISODES} SELECT id, CASE WHEN pinned THEN 'pinned' ELSE 'forgotten' END AS outcome FROM e WHERE starts_with(id, 'a') OR pinned UNION ALL SELECT 'no such id', 'unknown'")
def forget_guard(spark, d) -> DataFrame:
    rows = V.episodes(spark, d)
    ids = rows.where("id like 'a%' or pinned").select("id").unionByName(spark.range(1).select(F.lit("no such id").alias("id")))
    return E.forget(rows, ids, AS_OF)[1]


@query("lifecycle", f"WITH {V.EPISODES}, m AS {_NAMED} SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN 'semantic' ELSE kind END AS kind, coalesce(pinned, false) OR id IN (SELECT id FROM m) AS pinned, CASE WHEN id IN (SELECT id FROM m) AND NOT coalesce(pinned, false) THEN {AS_OF} ELSE expires_at END AS expires_at FROM e")
def lifecycle(spark, d) -> DataFrame:
    """Forget, then promote and pin the same episodes: pinned ones aren't forgotten."""
    rows = V.episodes(spark, d)
    ids = rows.where("id like 'a%' or pinned").select("id")
    left = E.pin(E.set_kind(E.forget(rows, ids, AS_OF)[0], ids, "semantic", AS_OF), ids)
    return left.select("id", "kind", F.coalesce("pinned", F.lit(False)).alias("pinned"), "expires_at")


@query("event_append", f"WITH {V.LOG}, n AS (SELECT (SELECT max(event_id) FROM lg) + row_number() OVER (ORDER BY captured_at, event_id) AS event_id, captured_at FROM lg WHERE source_type = 'transcript') SELECT event_id, captured_at FROM n")
def event_append(spark, d) -> DataFrame:
    """New events with a complete payload get the log's next numbers; those without one are turned away."""
    log = V.log(spark, d).withColumn("source_ref", F.col("event_id").cast("string")).select("event_id", "project_id", "source_type", "source_ref", "captured_at", "payload")
    full = F.to_json(F.struct(*(F.lit(1).alias(k) for k in L.REQUIRED["transcript"])))
    new = log.where("source_type in ('transcript', 'git.commit')").withColumn("payload", F.when(F.col("source_type") == "transcript", full).otherwise("{}"))
    after, refused = L.append(log, new)
    last = log.agg(F.max("event_id")).first()[0]
    return after.where(F.col("event_id") > last).select("event_id", "captured_at")


@query("has_event", f"WITH {V.LOG}, k AS (SELECT project_id, source_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE session END AS ref, event_id FROM lg) SELECT DISTINCT w.project_id, w.source_type, w.ref AS source_ref, EXISTS (SELECT 1 FROM k WHERE event_id % 2 = 0 AND k.project_id = w.project_id AND k.source_type = w.source_type AND k.ref IS NOT DISTINCT FROM w.ref) AS is_known FROM k w")
def has_event(spark, d) -> DataFrame:
    ref = F.when(F.col("event_id") % 3 != 0, F.col("session"))
    rows = V.log(spark, d).select("event_id", "project_id", "source_type", ref.alias("source_ref"))
    return L.has_event(rows.where("event_id % 2 = 0"), rows.drop("event_id").distinct())


@query("session_resolution", "WITH a AS (SELECT left(session_id, 6) AS asked FROM sessions UNION SELECT session_id FROM sessions UNION SELECT left(session_id, 1) FROM sessions UNION SELECT 'zzz'), m AS (SELECT asked, list_sort(list(session_id)) AS l, bool_or(session_id = asked) AS exact FROM a JOIN sessions ON starts_with(session_id, asked) GROUP BY asked) SELECT asked, CASE WHEN exact THEN asked WHEN len(l) = 1 THEN l[1] END AS session_id, CASE WHEN exact OR len(l) = 1 THEN 'found' WHEN l IS NULL THEN 'not found' ELSE 'ambiguous' END AS outcome, CASE WHEN NOT exact AND len(l) > 1 THEN array_to_string(l[1:5], ',') END AS candidates FROM a LEFT JOIN m USING (asked)")
def session_resolution(spark, d) -> DataFrame:
    ids = table(spark, d, "sessions").select("session_id")
    asked = ids.select(F.left("session_id", F.lit(6)).alias("asked")).union(ids).union(ids.select(F.left("session_id", F.lit(1)))).union(spark.range(1).select(F.lit("zzz"))).distinct()
    return M.resolve(asked, ids).select("asked", "session_id", "outcome", F.array_join("candidates", ",").alias("candidates"))
