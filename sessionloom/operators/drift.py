"""Schemas that drift between files: one table, and a log of the changes.

Each file's header (its fields and their types) is made by one aggregation over
all files at once. A field's types are folded through a promotion lattice, the
headers of a writer's consecutive files are compared, and renames are found by
an equi-join on values that the vanished and the new field share. The renames
give each field a lineage, and the unified table has a column per lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.operators import ordering

WRITER = ["stream_id", "event_type"]
_KEYS = [*WRITER, "file_no"]


# Types as bits, so that those of a field are one number. Whole numbers within 53 bits are those that a double holds exactly.
NULL, STRING, BOOLEAN, OBJECT, ARRAY, INT53, BIGINT, DECIMAL, DOUBLE = (1 << i for i in range(9))
NUMBER = INT53 | BIGINT | DECIMAL | DOUBLE
#: The types of a report, by name.
KINDS = {"array": ARRAY, "boolean": BOOLEAN, "number": NUMBER, "object": OBJECT, "string": STRING}


def json_type(value: Column, form: Column) -> Column:
    """The bit of a variant's type; ``form`` is its schema."""
    small = F.try_variant_get(value, "$", "bigint").between(-(1 << 53), 1 << 53)
    return (
        F.when(form.isNull() | (form == "VOID"), NULL).when(form == "STRING", STRING).when(form == "BOOLEAN", BOOLEAN).when(form.startswith("OBJECT"), OBJECT).when(form.startswith("ARRAY"), ARRAY)
        .when(form.startswith("DECIMAL"), DECIMAL).when(form == "BIGINT", F.when(small, INT53).otherwise(BIGINT)).otherwise(DOUBLE)
    )


def _read(records: DataFrame) -> DataFrame:
    return records.withColumn("__v", F.try_variant_get(F.try_parse_json(F.col("payload")), "$", "map<string,variant>"))


def fields(records: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row per top-level field of each readable record: keys, ``field``, ``code`` (the bit of its type), ``form`` (its schema) and ``value`` (a variant).

    ``wanted`` names a column with the list of fields to give; the others don't leave the parser.
    """
    runtime.require_columns(records, *_KEYS, "payload")
    read, own = _read(records).where("__v is not null"), ("field", "code", "form", "value", "payload", wanted)
    found = F.col("__v") if wanted is None else F.map_filter("__v", lambda k, _: F.array_contains(F.col(wanted), k))
    spread = read.select(*[c for c in records.columns if c not in own], F.explode(found).alias("field", "value"))
    return spread.withColumn("form", F.schema_of_variant("value")).withColumn("code", json_type(F.col("value"), F.col("form")))


def promote(codes: Column) -> Column:
    """The type of a field with these bits: the only one besides null, else ``mixed`` with its members; null alone has none."""
    known = F.filter(F.array(*(F.when(codes.bitwiseAND(bits) != 0, name) for name, bits in KINDS.items())), lambda x: x.isNotNull())
    return F.when(F.size(known) == 1, known.getItem(0)).when(F.size(known) > 1, F.concat(F.lit("mixed "), F.array_join(known, "|")))


def headers(members: DataFrame) -> DataFrame:
    """Each file's fields with the bits of their types, the digits of their decimals, and the promoted type (null where all values are)."""
    size = lambda n: F.max(F.when(F.col("code") == DECIMAL, F.regexp_extract("form", r"(\d+),(\d+)", n).cast("int")))
    whole = F.max(F.when(F.col("code") == DECIMAL, F.regexp_extract("form", r"(\d+),", 1).cast("int") - F.regexp_extract("form", r",(\d+)", 1).cast("int")))
    found = members.groupBy(*_KEYS, "field").agg(F.bit_or("code").alias("codes"), whole.alias("whole"), size(1).alias("digits"), size(2).alias("scale"))
    return found.withColumn("kind", promote(F.col("codes")))


def _belongs(df: DataFrame) -> DataFrame:
    return df.where(" and ".join(f"{k} is not null" for k in _KEYS))


def changes(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(stream_id, file_no, event_type, change_kind, old_field, new_field) between each file and its predecessor.

    The predecessor is the stream's last earlier file with readable records of
    the event type. renamed: a field went, another of the same type came, and a
    value other than null is common; where several pairs qualify, those with
    more common values go first, then by name, each field once. removed, added:
    what is left. retyped: both types are known and differ. Rows without
    stream, file or event type belong to no file. Repeated rows change nothing.
    ``known`` are the records' ``headers`` where they are there already.
    """
    if known is None:
        codes = fields(_belongs(records.select(*_KEYS, "payload"))).groupBy(*_KEYS, "field").agg(F.bit_or("code").alias("codes"))
        known = runtime.materialise(codes.withColumn("kind", promote(F.col("codes"))), "headers")
    known = _belongs(known).select(*_KEYS, "field", "kind")
    files = known.select(*_KEYS).distinct().withColumn("writer", F.struct(*WRITER))
    files = ordering.with_previous(files, "writer", ["file_no"], "file_no", "before", F.floor(F.col("file_no") / ordering.BLOCK_ROWS))
    steps = runtime.materialise(files.where("before is not null").select(*_KEYS, "before"), "steps")
    was = steps.join(known.withColumnsRenamed({"file_no": "before", "kind": "old_kind"}), [*WRITER, "before"]).drop("before")
    now = steps.drop("before").join(known.withColumnRenamed("kind", "new_kind"), _KEYS)
    both = was.withColumn("is_old", F.lit(True)).join(now.withColumn("is_new", F.lit(True)), [*_KEYS, "field"], "full")
    differ = runtime.materialise(both.where("is_old is null or is_new is null or old_kind <> new_kind"), "differences")
    gone = differ.where("is_new is null").select(*_KEYS, "field", F.col("old_kind").alias("kind"))
    come = differ.where("is_old is null").select(*_KEYS, "field", F.col("new_kind").alias("kind"))

    # Only values that may show a rename are read: of fields that went where one of their type came, and the other way round.
    kinds = gone.where("kind is not null").select(*_KEYS, "kind").intersect(come.select(*_KEYS, "kind"))
    may_go = gone.join(kinds, [*_KEYS, "kind"], "left_semi").join(steps, _KEYS).select(*WRITER, F.col("before").alias("file_no"), "field")
    may_come = come.join(kinds, [*_KEYS, "kind"], "left_semi").select(*_KEYS, "field")
    looked_at = may_go.unionByName(may_come).groupBy(*_KEYS).agg(F.collect_set("field").alias("__wanted"))
    valued = fields(records.select(*_KEYS, "payload").join(looked_at, _KEYS), "__wanted").where(F.col("code") != NULL)
    valued = runtime.materialise(valued.select(*_KEYS, "field", F.sha2(F.concat(promote(F.col("code")), F.lit(":"), F.to_json("value")), 256).alias("mark")).distinct(), "values")
    old = gone.join(steps, _KEYS).join(valued.withColumnRenamed("file_no", "before"), [*WRITER, "before", "field"]).select(*_KEYS, F.col("field").alias("old_field"), "kind", "mark")
    new = come.join(valued, [*_KEYS, "field"]).select(*_KEYS, F.col("field").alias("new_field"), "kind", "mark")
    pairs = old.join(new, [*_KEYS, "kind", "mark"]).groupBy(*_KEYS, "old_field", "new_field").agg((-F.count("*")).alias("rank"))
    # Each list holds at most the fields that went times those that came between two files.
    ranked = pairs.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "old_field", "new_field"))).alias("p"))
    none = F.array().cast("array<struct<rank:bigint,old_field:string,new_field:string>>")
    free = lambda acc, x: ~F.exists(acc, lambda t: (t["old_field"] == x["old_field"]) | (t["new_field"] == x["new_field"]))
    chosen = ranked.select(*_KEYS, F.explode(F.aggregate("p", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))).alias("c"))
    renamed = runtime.materialise(chosen.select(*_KEYS, "c.old_field", "c.new_field"), "renamed")

    removed = gone.join(renamed.withColumnRenamed("old_field", "field"), [*_KEYS, "field"], "left_anti")
    added = come.join(renamed.withColumnRenamed("new_field", "field"), [*_KEYS, "field"], "left_anti")
    retyped = differ.where("is_old and is_new")
    form = lambda df, kind, o, n: df.select("stream_id", "file_no", "event_type", F.lit(kind).alias("change_kind"), o.alias("old_field"), n.alias("new_field"))
    field, nothing = F.col("field"), F.lit("")
    return (
        form(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(form(removed, "removed", field, nothing))
        .unionByName(form(added, "added", nothing, field))
        .unionByName(form(retyped, "retyped", field, field))
    )


_LINEAGES = "stream_id string, event_type string, file_no bigint, field string, lineage string"


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each writer's renames in order. What is held is the writer's field names, however many renames there are."""
    writer = file = None
    held, own, moves = {}, {}, []

    def name(f: str) -> str:
        return held.get(f) or (f if not own.get(f) else f"{f}#{own[f] + 1}")

    def settle() -> list[tuple]:
        given = {new: name(old) for old, new in moves}
        for old, _ in moves:
            if held.pop(old, None) is None:
                own[old] = own.get(old, 0) + 1  # a field that takes the name again later is another one
        held.update(given)
        out = [(*writer, file, f, name(f)) for f in sorted({f for m in moves for f in m})]
        moves.clear()
        return out

    for b in batches:
        out = []
        for stream, kind, no, old, new in b[["stream_id", "event_type", "file_no", "old_field", "new_field"]].itertuples(index=False):
            if (stream, kind) != writer or no != file:
                out += settle() if moves else []
                if (stream, kind) != writer:
                    held, own = {}, {}
                writer, file = (stream, kind), no
            moves.append((old, new))
        yield pd.DataFrame(out, columns=["stream_id", "event_type", "file_no", "field", "lineage"])
    if moves:
        yield pd.DataFrame(settle(), columns=["stream_id", "event_type", "file_no", "field", "lineage"])


def lineages(renames: DataFrame) -> DataFrame:
    """(stream_id, event_type, file_no, field, lineage): from that file on the field's name stands for that lineage.

    A lineage is called by its first name. Where a field was renamed away and
    its name comes up again without a rename, that is a new lineage, called
    ``name#2`` and so on.
    """
    kept = renames.where("change_kind = 'renamed'").select(*_KEYS, "old_field", "new_field")
    return kept.repartition(*WRITER).sortWithinPartitions(*_KEYS, "old_field").mapInPandas(_follow, _LINEAGES)


def names_by_file(known: DataFrame, chains: DataFrame) -> DataFrame:
    """(stream_id, event_type, file_no, lineage_of) of files with fields that stand for another lineage: a map by field name."""
    at = lambda df, rank, lineage: df.select(F.struct(*WRITER, "field").alias("k"), "file_no", F.lit(rank).alias("rank"), lineage.alias("lineage"))
    moved = _belongs(known).join(chains.select(*WRITER, "field").distinct(), [*WRITER, "field"], "left_semi")
    both = runtime.materialise(at(chains, 0, F.col("lineage")).unionByName(at(moved, 1, F.lit(None).cast("string"))), "lineages")
    block = F.floor(F.col("file_no") / ordering.BLOCK_ROWS)
    dated = ordering.with_previous(both, "k", ["file_no", "rank"], "lineage", "since", block).where("rank = 1 and since is not null and since <> k.field")
    # A file has as many entries as it has renamed fields.
    return dated.groupBy("k.stream_id", "k.event_type", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("k.field", "since"))).alias("lineage_of"))


def column_type(codes: int, whole: int | None, digits: int | None, scale: int | None) -> str:
    """The lattice: whole numbers, then decimals that hold all digits, then doubles; text where none holds all values.

    Of the field's decimals, ``whole`` and ``scale`` are the most digits before
    and after the point, ``digits`` the most in all.
    """
    known = codes & ~NULL
    if known == BOOLEAN:
        return "boolean"
    if not known or known & ~NUMBER:
        return "string"
    if known & DOUBLE:  # numbers with an exponent
        return "double" if not known & BIGINT and (digits or 0) <= 15 else "string"
    if not known & DECIMAL:
        return "bigint"
    whole = max(whole, 19 if known & (INT53 | BIGINT) else 0)
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "string"


#: Lineages with a column of their own; the JSON column f_rest holds all others.
MAX_COLUMNS = 2000


def unify(records: DataFrame, renames: DataFrame, keys: list[str], known: DataFrame | None = None, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All readable records in one table: ``keys`` and a column for each field's lineage.

    ``renames`` is the result of ``changes``, ``known`` that of ``headers``. A
    column has the type that holds all values of all files without loss:
    bigint, decimal, double, boolean, or text, where a string stands as it is
    and anything else as JSON. (A number of more than 38 digits is a double
    from its parsing on.) The list of lineages goes to the driver; those beyond
    ``max_columns``, the rarest, share one JSON column ``f_rest``. Columns are
    called ``f_`` and the first name, so they can't clash with ``keys``; of
    names that differ in case alone the later ones get a number. Unreadable
    records keep their row, without fields; rows that are repeated come once.

    Every payload is parsed once, and its columns are taken from the parsed
    map in one projection after a join with the files' renamed fields.
    """
    runtime.require_columns(records, *keys, *_KEYS, "payload")
    known = runtime.materialise(headers(fields(records.select(*_KEYS, "payload"))), "headers") if known is None else known
    named = runtime.materialise(names_by_file(known, runtime.materialise(lineages(renames), "chains")), "names")
    by_name = known.join(named, _KEYS, "left").withColumn("name", F.coalesce(F.try_element_at("lineage_of", F.col("field")), "field"))
    folded = by_name.groupBy("name").agg(F.bit_or("codes").alias("codes"), F.max("whole").alias("whole"), F.max("digits").alias("digits"), F.max("scale").alias("scale"), F.count("*").alias("n"))
    union = folded.orderBy(F.col("n").desc(), "name").limit(max_columns + 1).collect()
    own, taken, columns = sorted(union[:max_columns], key=lambda r: r["name"]), {k.lower() for k in keys} | {"f_rest"}, []
    for r in own:  # Spark's columns differ in more than case
        column, n = f"f_{r['name']}", 2
        while column.lower() in taken:
            column, n = f"f_{r['name']}_{n}", n + 1
        taken.add(column.lower())
        columns.append(column)
    hold = [k for k in _KEYS if k not in keys]
    rows = records.select(*keys, *hold, "payload").dropDuplicates(keys).join(named, _KEYS, "left")
    of = F.col("lineage_of")
    read = _read(rows).withColumn("__m", F.when(of.isNull(), F.col("__v")).otherwise(F.transform_keys("__v", lambda k, _: F.coalesce(F.try_element_at(of, k), k))))

    def cell(name: str, kind: str) -> Column:
        value = F.try_element_at("__m", F.lit(name))
        if kind != "string":
            return F.try_variant_get(value, "$", kind)
        form = F.schema_of_variant(value)
        return F.when(form == "STRING", F.try_variant_get(value, "$", "string")).when(form != "VOID", F.to_json(value))

    cells = [cell(r["name"], column_type(r["codes"], r["whole"], r["digits"], r["scale"])).alias(c) for r, c in zip(own, columns)]
    if len(union) > max_columns:
        names = [r["name"] for r in own]
        cells.append(F.to_json(F.map_filter("__m", lambda k, _: ~k.isin(names))).alias("f_rest"))
    return read.select(*keys, *cells)
