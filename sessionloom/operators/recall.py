"""Ranked full-text and entity recall over episodes, fused by reciprocal rank.

The postings are a table in buckets by term, kept up by id: a search reads the
buckets of its own terms, whatever the size of the corpus. Corpus statistics
are a few sums beside it, and each stream is cut to its depth before fusion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.functions import text as T

KINDS = ("working", "episodic", "semantic")
K1, B, RRF = 1.2, 0.75, 60
LEAST_IDF = 1e-6


def terms_of(query: str) -> list[str]:
    """The words of a query, repeats included; ValueError where there is none."""
    words = re.findall(r"\w+", query)
    if not words:
        raise ValueError("the query has no words")
    return words


def depth_of(limit: int) -> int:
    return max(6 * limit, 50)


def visible(as_of: float) -> Column:
    """Neither expired nor, if so, kept by a pin."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_of) | F.coalesce(F.col("pinned"), F.lit(False))


def conditions(as_of: float, project_id: str | None = None, kind: str | None = None, min_confidence: float | None = None, since: float | None = None) -> Column:
    """The filters of a search, as one predicate."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    out = visible(as_of)
    for name, op, value in (("project_id", "=", project_id), ("kind", "=", kind), ("confidence", ">=", min_confidence), ("created_at", ">=", since)):
        if value is not None:
            out = out & (F.col(name) == value if op == "=" else F.col(name) >= value)
    return out


def inverted_index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, tf, positions) of every distinct term of each row."""
    spread = docs.select(F.col(key), F.posexplode(T.tokens(text)).alias("pos", "term"))
    return spread.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


BUCKETS = 64


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


class SearchIndex:
    """Postings (term, id, tf, positions, length) below ``path``, in ``buckets`` folders by term, sorted by term.

    Each writing is a generation. ``refresh`` adds changed rows as a new one and
    notes their ids, so that a search passes over what older generations say of
    them; nothing else is rewritten. ``statistics`` has a row per generation,
    whose sums are those of the living rows. A generation counts once its row of
    statistics is there, which is written last.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        there = runtime.exists(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _statistics(self) -> DataFrame:
        return self._read("statistics", "generation int, n bigint, words bigint")

    def generations(self) -> list[int]:
        """The complete generations: one for each refresh since the index was made."""
        return sorted(r.generation for r in self._statistics().select("generation").collect())

    def refresh(self, docs: DataFrame, key: str, text: Column, removed: DataFrame | None = None) -> "SearchIndex":
        """Index ``docs`` (one row per ``key``), in place of what was known of those keys; forget the keys in ``removed`` (id)."""
        complete = self.generations()
        begun = self._read("lengths", "id string, length int, generation int").agg(F.max("generation")).first()[0]
        now = max([-1 if begun is None else begun, *complete]) + 1  # what a broken refresh left keeps its own number
        cut = runtime.materialise(docs.select(F.col(key).cast("string").alias("id"), T.tokens(text).alias("words")).select("id", "words", F.size("words").alias("length")), "words")
        spread = cut.select("id", "length", F.posexplode("words").alias("pos", "term"))
        posts = spread.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("length").alias("length"))
        posts = posts.withColumns({"generation": F.lit(now), "bucket": _bucket(F.col("term"), self.buckets)})
        gone = cut.select("id") if removed is None else cut.select("id").unionByName(removed.select(F.col("id").cast("string").alias("id")))
        old_n, old_words = 0, 0
        if complete:
            # What the living rows of those ids had, from the lengths that each generation notes.
            old = self._living(self._read("lengths", "id string, length int, generation int")).join(gone.distinct(), "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            old_n, old_words = old
            gone.distinct().withColumn("before", F.lit(now)).write.mode("append").parquet(f"{self.path}/superseded")
        cut.select("id", "length", F.lit(now).alias("generation")).write.mode("append").parquet(f"{self.path}/lengths")
        posts.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        n, words = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.spark.createDataFrame([(now, n - old_n, words - old_words)], "generation int, n bigint, words bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/statistics")
        return self

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows of complete generations that no later one replaces. What was replaced is a table of changed ids only."""
        complete = self.generations()
        rows = rows.where(F.col("generation").isin(complete))
        if len(complete) < 2:
            return rows
        late = self._read("superseded", "id string, before int").where(F.col("before").isin(complete)).groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(late, "id", "left").where("before is null or generation >= before").drop("before")

    def postings(self, terms: list[str]) -> DataFrame:
        """The living postings of ``terms``. The bucket numbers are literals, so other folders aren't read."""
        schema = "term string, id string, tf int, positions array<int>, length int, generation int, bucket int"
        every = self._read("postings", schema)
        if not terms:
            return every.where("false")
        numbers = self.spark.range(1).select(*(_bucket(F.lit(t), self.buckets) for t in terms)).first()
        return self._living(every.where(F.col("bucket").isin(*sorted(set(numbers))) & F.col("term").isin(*terms)))

    def totals(self) -> tuple[int, float]:
        n, words = self._statistics().agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        return n, (words / n if n else 0) or 1.0

    def frequencies(self, terms: list[str]) -> DataFrame:
        """(id, length, f0, f1, …) of the rows that hold any of the folded ``terms``; the parts of a term with an underscore stand side by side."""
        parts = [[p for p in t.split("_") if p] for t in terms]
        found = self.postings(sorted({p for ps in parts for p in ps})).select("term", "id", "positions", "length")
        # As many entries per id as the query has words.
        one = found.groupBy("id").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        none = F.array().cast("array<int>")
        at = lambda p: F.coalesce(F.try_element_at("at", F.lit(p)), none)
        ahead = lambda places, k: F.transform(places, lambda i: i - k)

        def count(ps: list[str]) -> Column:
            if not ps:
                return F.lit(0)
            starts = at(ps[0])
            for k, p in enumerate(ps[1:], 1):
                starts = F.array_intersect(starts, ahead(at(p), k))
            return F.size(starts)

        return one.select("id", "length", *(count(ps).alias(f"f{i}") for i, ps in enumerate(parts)))


def bm25_of(index: SearchIndex, query: str, combine: str = "AND", allowed: DataFrame | None = None) -> DataFrame:
    """(id, bm25) of the rows that match and, where given, are in ``allowed`` (id); higher is better.

    Statistics are those of all rows, whatever is allowed. A term that the
    query repeats counts as often.
    """
    if combine not in ("AND", "OR"):
        raise ValueError("combine must be AND or OR")
    words = [T.folded(w) for w in terms_of(query)]
    distinct = list(dict.fromkeys(words))
    hits = runtime.materialise(index.frequencies(distinct), "frequencies")
    df = hits.agg(*(F.count_if(F.col(f"f{i}") > 0) for i in range(len(distinct)))).first()
    (n, mean), score = index.totals(), F.lit(0.0)
    held = [F.col(f"f{i}") > 0 for i in range(len(distinct))]
    matched = held[0]
    for h in held[1:]:
        matched = matched & h if combine == "AND" else matched | h
    for i, t in enumerate(distinct):
        idf = max(math.log((n - df[i] + 0.5) / (df[i] + 0.5)), 0.0) or LEAST_IDF
        tf = F.col(f"f{i}").cast("double")
        score = score + words.count(t) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    out = hits.where(matched).select("id", score.alias("bm25"))
    return out if allowed is None else out.join(allowed.select("id"), "id", "left_semi")


def episode_index(episodes: DataFrame, path: str | None = None) -> SearchIndex:
    """The index of title, body and category at ``path``, made if it isn't there."""
    spark = episodes.sparkSession
    index = SearchIndex(spark, path or runtime.scratch_path(spark, "index"))
    return index if index.generations() else index.refresh(episodes, "id", F.concat_ws(" ", "title", "body", "category"))


def bm25(docs: DataFrame, key: str, text: Column, query: str, combine: str = "AND", where: Column | None = None) -> DataFrame:
    """(key, bm25) of rows that have no index yet: one is made for this search."""
    terms_of(query)
    index = SearchIndex(docs.sparkSession, runtime.scratch_path(docs.sparkSession, "index")).refresh(docs, key, text)
    allowed = None if where is None else docs.where(where).select(F.col(key).cast("string").alias("id"))
    return bm25_of(index, query, combine, allowed).select(F.col("id").alias(key), "bm25")


def entity_index(episodes: DataFrame) -> DataFrame:
    """(entity_lower, id, project_id), each once."""
    return episodes.select(F.explode("entities").alias("e"), "id", "project_id").select(F.lower("e").alias("entity_lower"), "id", "project_id").distinct()


def refresh_entities(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``index`` after the episodes in ``changed`` got new entities and those in ``removed`` (id) went."""
    ids = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id"))
    return index.join(ids.distinct(), "id", "left_anti").select(*index.columns).unionByName(entity_index(changed).select(*index.columns))


def entity_hits(episodes: DataFrame, query: str, where: Column) -> DataFrame:
    """A row for each entity of a visible episode that begins with a word of the query, in any case."""
    starts = F.lit(False)
    for t in dict.fromkeys(w.lower() for w in terms_of(query)):
        starts = starts | F.col("entity_lower").startswith(t)
    # The predicate is tested on the row's own array, so there is no join; an entity counts once per episode.
    own = F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("entity_lower")
    return episodes.where(where).select("id", "created_at", own).where(starts)


def authority_hits(episodes: DataFrame, query: str, where: Column) -> DataFrame:
    """Pinned episodes whose entities hold a word of the query."""
    listed = F.lower(F.to_json("entities"))
    within = F.lit(False)
    for t in dict.fromkeys(w.lower() for w in terms_of(query)):
        within = within | listed.contains(t)
    return episodes.where(where & F.col("pinned") & within).select("id", "created_at")


def top(rows: DataFrame, order: list[Column], depth: int) -> DataFrame:
    """The first ``depth`` rows with their place from 0. The window sees no more than those."""
    return rows.orderBy(*order).limit(depth).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(streams: dict[str, DataFrame]) -> DataFrame:
    """(id, score) of ranked streams (id, place): the sum of 1 / (61 + place), by the streams' names.

    Equal scores are ordered by the first stream an id comes in, then its place
    there, then the id; ``stream`` and ``place`` say so.
    """
    parts = [df.select("id", "place", F.lit(i).alias("stream")) for i, (_, df) in enumerate(sorted(streams.items()))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = F.min(F.struct("stream", "place"))
    return every.groupBy("id").agg(F.sum(F.lit(1.0) / (RRF + F.col("place") + 1)).alias("score"), first.alias("f")).select("id", "score", "f.stream", "f.place")


def fused(episodes: DataFrame, query: str, as_of: float, limit: int = 20, combine: str = "AND", index: SearchIndex | None = None, **filters) -> DataFrame:
    """(id, score, stream, place) of the ``limit`` best episodes; ``index`` is theirs, or one is made."""
    if not 1 <= limit <= 50:
        raise ValueError("the limit must be 1 to 50")
    where, depth = conditions(as_of, **filters), depth_of(limit)
    found = bm25_of(index or episode_index(episodes), query, combine, episodes.where(where).select("id"))
    newest = [F.col("created_at").desc(), F.col("id")]
    streams = {
        "bm25": top(found.select("id", F.round("bm25", 6).alias("bm25")), [F.col("bm25").desc(), F.col("id")], depth),
        "entities": top(entity_hits(episodes, query, where), [*newest, F.col("entity_lower")], depth),
        "authority": top(authority_hits(episodes, query, where), newest, depth),
    }
    return rrf(streams).orderBy(F.round("score", 9).desc(), "stream", "place", "id").limit(limit)


def recall(episodes: DataFrame, query: str, as_of: float, limit: int = 20, combine: str = "AND", preview: int = 400, index: SearchIndex | None = None, **filters) -> DataFrame:
    """The best episodes with title, the beginning of the body, and score; at most ``limit`` rows."""
    best = fused(episodes, query, as_of, limit, combine, index, **filters)
    return episodes.join(F.broadcast(best), "id").select(  # at most `limit` rows
        "id", "project_id", "kind", "title", F.left("body", F.lit(preview)).alias("preview"), F.round("score", 6).alias("score")
    )


def answered(search: Callable[[str], DataFrame], query: str) -> DataFrame:
    """``search("AND")``, or ``search("OR")`` where that finds nothing and the query has several words."""
    strict = search("AND")
    return strict if len(terms_of(query)) < 2 or strict.take(1) else search("OR")


def gaps(hits: DataFrame, query: str, least: int = 4) -> DataFrame:
    """The words of the query, of ``least`` letters or more, that no hit holds."""
    words = list(dict.fromkeys(w.lower() for w in terms_of(query) if len(w) >= least))
    held = [F.max(F.lower(F.concat_ws("\n", "title", "body")).contains(w)).alias(f"_{i}") for i, w in enumerate(words)]
    one = hits.agg(F.count("*").alias("n"), *held)
    missing = F.array(*(F.when(~F.coalesce(F.col(f"_{i}"), F.lit(False)), F.lit(w)) for i, w in enumerate(words)))
    return one.select(F.explode(F.filter(missing, lambda w: w.isNotNull())).alias("term")) if words else hits.select(F.lit("").alias("term")).where("false")
