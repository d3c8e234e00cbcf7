"""Rows of episodes: reading, upserts, feedback, deduplication, similarity and ageing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import ordering
from sessionloom.runtime import materialise

#: Columns that an upsert replaces; all others keep what is stored.
UPDATED = ["kind", "category", "title", "body", "confidence", "updated_at", "raw_payload", "entities"]
KINDS = ("working", "episodic", "semantic")
DECAY, DECAY_DAYS, LEAST_STRENGTH = 0.9, 30, 0.1
SIMILAR = 0.5


def latest(rows: DataFrame) -> DataFrame:
    """One row per id: the copy that was accessed most, then the newest, then by its contents, so that one whole copy stays."""
    rest = [c for c in rows.columns if c != "id"]
    rank = F.struct(F.coalesce("access_count", F.lit(-1)), "updated_at", F.xxhash64(*rest))
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("id", "r.*").select(*rows.columns)


def newest(rows: DataFrame, limit: int, by: str = "created_at") -> DataFrame:
    """The ``limit`` newest rows; equal times are ordered by id."""
    return rows.orderBy(F.col(by).desc(), "id").limit(limit)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` after writing ``incoming``: new ids are added, known ones change only in ``UPDATED``.

    ``incoming`` has one row per id and the same columns. One full join on the
    id: tables bucketed by id need no shuffle.
    """
    s, n = stored.alias("s"), incoming.alias("n")
    both = s.join(n, F.col("s.id") == F.col("n.id"), "full")
    known, new = F.col("s.id").isNotNull(), F.col("n.id").isNotNull()
    cell = lambda c: F.when(new & (~known | F.lit(c in UPDATED)), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(F.coalesce("s.id", "n.id").alias("id"), *(cell(c) for c in stored.columns if c != "id"))


def touch(rows: DataFrame, ids: DataFrame, as_of: float) -> DataFrame:
    """One access more for each episode named in ``ids``, however often it is named."""
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(named, "id", "left").withColumns(
        {
            "access_count": F.coalesce("access_count", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0),
            "last_accessed_at": F.when(F.col("_hit"), F.lit(as_of)).otherwise(F.col("last_accessed_at")),
        }
    ).drop("_hit")


def set_kind(rows: DataFrame, ids: DataFrame, kind: str, as_of: float) -> DataFrame:
    """The episodes named in ``ids`` moved to ``kind``; unknown kinds are an error, ids that aren't there none."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return _changed(rows, ids, {"kind": F.lit(kind), "updated_at": F.lit(as_of)})


def pin(rows: DataFrame, ids: DataFrame, pinned: bool = True) -> DataFrame:
    """The episodes named in ``ids`` pinned, or no longer."""
    return _changed(rows, ids, {"pinned": F.lit(pinned)})


def _changed(rows: DataFrame, ids: DataFrame, to: dict[str, Column]) -> DataFrame:
    named = ids.where("id is not null").select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(named, "id", "left").withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in to.items()}).drop("_hit")


def forget(rows: DataFrame, ids: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the episodes named in ``ids`` expired, and what became of each id: forgotten, pinned (refused) or unknown."""
    named = ids.where("id is not null").select("id").distinct()
    state = named.join(rows.select("id", F.coalesce("pinned", F.lit(False)).alias("p")), "id", "left").select(
        "id", F.when(F.col("p").isNull(), "unknown").when(F.col("p"), "pinned").otherwise("forgotten").alias("outcome")
    )
    return _changed(rows, state.where("outcome = 'forgotten'"), {"expires_at": F.lit(as_of)}), state


def fold_feedback(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` after verdicts (id, ts, seq, verdict) in their order.

    helpful adds an access, not_helpful takes one but never below 0; stale and
    wrong expire the episode at that time and unpin it. The count is a walk
    reflected at 0, which needs no list of an episode's verdicts: it ends
    higher than its start plus its steps by as far as their lowest prefix sum
    goes below 0.
    """
    step = F.when(F.col("verdict") == "helpful", 1).when(F.col("verdict") == "not_helpful", -1).otherwise(0)
    ends = F.col("verdict").isin("stale", "wrong")
    # One episode may have any share of the verdicts, so its walk is cut into blocks of the order.
    cut = ordering.cut_by_range(verdicts.select("id", "ts", "seq", "verdict"), "id", ["ts", "seq"], "block")
    order = Window.partitionBy("id", "block").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_block = (
        cut.withColumns({"_step": step, "_sum": F.sum(step).over(order)})
        .groupBy("id", "block")
        .agg(
            F.sum("_step").alias("_total"), F.min("_sum").alias("_low"),
            F.max(F.when(~ends, F.col("ts"))).alias("_touched"), F.max(F.when(ends, F.col("ts"))).alias("_ended"),
        )
    )
    before = F.coalesce(F.sum("_total").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = by_block.withColumn("_low", F.col("_low") + before).groupBy("id").agg(
        F.sum("_total").alias("_total"), F.min("_low").alias("_low"), F.max("_touched").alias("_touched"), F.max("_ended").alias("_ended")
    )
    count = F.coalesce("access_count", F.lit(0))
    return rows.join(walked, "id", "left").withColumns(
        {
            "access_count": count + F.coalesce("_total", F.lit(0)) + F.greatest(F.lit(0), -(count + F.coalesce("_low", F.lit(0)))),
            "last_accessed_at": F.coalesce("_touched", "last_accessed_at"),
            "expires_at": F.coalesce("_ended", "expires_at"),
            "pinned": F.when(F.col("_ended").isNotNull(), F.lit(False)).otherwise(F.col("pinned")),
        }
    ).drop("_total", "_low", "_touched", "_ended")


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("dedup_key", T.dedup_key(F.col("title"), F.col("body")))


def first_per_key(incoming: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; with a map-side minimum, so a hot key doesn't gather its rows."""
    rest = F.struct(*incoming.columns)
    return incoming.groupBy(key.alias("_key")).agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


def unseen(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to persist: of each (project, key) the first, and none that is stored."""
    own = first_per_key(incoming, F.struct("project_id", "dedup_key"), [F.col("created_at"), F.col("id")])
    return own.join(stored.select("project_id", "dedup_key").distinct(), ["project_id", "dedup_key"], "left_anti").select(*incoming.columns)


def links_by_title(rows: DataFrame) -> DataFrame:
    """(project_id, title_class, other_class, n, n_other) of similar word sets within a project, both ways, with themselves.

    Two titles are similar if they share at least half of the larger one's
    distinct words. Equal word sets form one class, so copies aren't paired.
    Classes meet on their rarest words only: of w words it is enough to look at
    all but ceil(w/2) and one more.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), r"(?U)\s+"), lambda w: w != "")))
    classes = rows.where("title is not null").select("project_id", words.alias("words")).where(F.size("words") > 0).groupBy("project_id", "words").agg(F.count("*").alias("n"))
    classes = materialise(classes.withColumn("title_class", F.xxhash64("project_id", "words")), "title-classes")
    spread = classes.select("project_id", "title_class", F.size("words").alias("w"), "words", F.explode("words").alias("word"))
    rare = spread.groupBy("project_id", "word").agg(F.count("*").alias("df"))
    ranked = spread.join(rare, ["project_id", "word"]).withColumn("k", F.row_number().over(Window.partitionBy("title_class").orderBy("df", "word")))
    heads = ranked.where(F.col("k") <= F.col("w") - F.ceil(F.col("w") * SIMILAR) + 1).select("project_id", "title_class", "w", "word")
    heads = materialise(heads, "title-heads")
    a, b = heads, heads.select("project_id", F.col("title_class").alias("other_class"), F.col("w").alias("w2"), "word")
    close = (F.col("w") <= 2 * F.col("w2")) & (F.col("w2") <= 2 * F.col("w"))
    met = a.join(b, ["project_id", "word"]).where(close).select("project_id", "title_class", "other_class").distinct()
    left = classes.select("project_id", "title_class", F.col("words").alias("w1"), "n")
    right = classes.select("project_id", F.col("title_class").alias("other_class"), F.col("words").alias("w2"), F.col("n").alias("n_other"))
    shared = F.size(F.array_intersect("w1", "w2"))
    return (
        met.join(left, ["project_id", "title_class"]).join(right, ["project_id", "other_class"])
        .where(shared >= SIMILAR * F.greatest(F.size("w1"), F.size("w2")))
        .select("project_id", "title_class", "other_class", "n", "n_other")
    )


def title_class(title: Column) -> Column:
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"(?U)\s+"), lambda w: w != "")))
    return F.xxhash64("project_id", words)


def similar_titles(rows: DataFrame) -> DataFrame:
    """(id, n_similar): how many episodes of the project have a similar title, the row itself included."""
    n = links_by_title(rows).groupBy("title_class").agg(F.sum("n_other").alias("n_similar"))
    return rows.where("title is not null").select("id", title_class(F.col("title")).alias("title_class")).join(n, "title_class").select("id", "n_similar")


def session_mentions(rows: DataFrame) -> DataFrame:
    """(id, n_sessions): distinct sources of non-semantic episodes with a similar title."""
    pool = rows.where("title is not null and kind <> 'semantic'")
    sources = pool.where("source_ref is not null").select(title_class(F.col("title")).alias("other_class"), "source_ref").distinct()
    n = links_by_title(rows).select("title_class", "other_class").join(sources, "other_class").groupBy("title_class").agg(F.countDistinct("source_ref").alias("n_sessions"))
    own = rows.where("title is not null").select("id", title_class(F.col("title")).alias("title_class"))
    return own.join(n, "title_class", "left").select("id", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"))


def decayed(created_at: Column, as_of: float, strength: float = 1.0) -> Column:
    """Strength that falls by a tenth in 30 whole days, never below 0.1; an unknown time keeps it."""
    days = F.greatest(F.lit(0), F.floor((F.lit(as_of) - created_at) / 86400))
    return F.when(created_at.isNull(), F.lit(strength)).otherwise(F.greatest(F.lit(LEAST_STRENGTH), strength * F.pow(F.lit(DECAY), days / DECAY_DAYS)))


def context(rows: DataFrame, as_of: float, lookback_days: int, project: str = "default") -> DataFrame:
    """Episodes for a session's start, with label, strength and what they show; low confidence and the forgotten are left out."""
    kept = rows.where(F.col("created_at") >= as_of - lookback_days * 86400)
    if project != "default":
        kept = kept.where(F.lower("project_id") == project.lower())
    out = kept.select(
        "id", "project_id", F.coalesce("category", F.lit("meta")).alias("type"), "created_at",
        T.confidence_label(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.left("body", F.lit(60)), F.lit("")), "id").alias("content"),
        F.coalesce(F.lower(F.get_json_object("raw_payload", "$.assistant")), F.lit("assistant")).alias("assistant"),
        decayed(F.col("created_at"), as_of).alias("strength"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )
    return out.where((F.col("confidence") != "low") & (F.col("strength") > LEAST_STRENGTH)).withColumn("strength", F.round("strength", 3))


def by_authority() -> list[Column]:
    """Pinned first, then stronger, newer, of high confidence; ties by id."""
    return [F.col("pinned").desc(), F.col("strength").desc(), F.col("created_at").desc(), (F.col("confidence") == "high").desc(), F.col("id")]


def blended(insights: DataFrame, scores: DataFrame, inverted: bool = False) -> DataFrame:
    """Insights that a search found, by 0.7 of the normalised score and 0.3 of the strength.

    ``scores`` (id, score) is the bounded result of a search. ``inverted``
    gives the best hit the lowest relevance, as one older ranking did.
    """
    met, every = insights.join(scores, "id"), Window.partitionBy(F.lit(0))  # as few rows as a search has
    low, high = F.min("score").over(every), F.max("score").over(every)
    norm = (F.col("score") - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    blend = F.round(0.7 * ((1.0 - norm) if inverted else norm) + 0.3 * F.col("strength"), 4)
    return met.withColumn("blend", blend)
