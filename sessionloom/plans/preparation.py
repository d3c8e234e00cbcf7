"""Queries of the general preparation problems (1, 3, 5, 7) over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import drift, hierarchy, nested, ordering, timestamps
from sessionloom.runtime import materialise, session_path, table


def dictionary(spark: SparkSession) -> timestamps.StampDictionary:
    """The dictionary of stamps that all queries of a session share and extend."""
    return timestamps.StampDictionary(spark, session_path(spark, "stamp-dictionary"))


def line_instants(spark: SparkSession, sf_dir: str, stamps: timestamps.StampDictionary, *extra: str) -> DataFrame:
    """Each transcript line's key columns with its instant; the host's zone comes from ``sessions``."""
    zones = table(spark, sf_dir, "sessions").groupBy("session_id").agg(F.first("tz_name", ignorenulls=True).alias("tz_name"))
    rows = table(spark, sf_dir, "transcript_lines").select("session_id", "id", "seq", "event_timestamp", *extra)
    return timestamps.normalise(rows.join(zones, "session_id", "left"), "event_timestamp", "tz_name", "lines", stamps)


def episode_instants(spark: SparkSession, sf_dir: str, stamps: timestamps.StampDictionary) -> DataFrame:
    zones = table(spark, sf_dir, "projects").groupBy("project_id").agg(F.first("tz_name", ignorenulls=True).alias("tz_name"))
    rows = table(spark, sf_dir, "episodes").select("id", "project_id", "created_at", "updated_at")
    return timestamps.normalise(rows.join(zones, "project_id", "left"), "created_at", "tz_name", "episodes", stamps)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose instant contradicts its neighbour: earlier than the preceding line, or created after the update."""
    stamps = dictionary(spark)
    lines = materialise(
        line_instants(spark, sf_dir, stamps).where("session_id is not null and seq is not null").select("session_id", "id", "seq", "instant"),
        "line-instants",
    )
    back = ordering.with_previous(lines, "session_id", ["seq"], "instant", "previous", F.floor(F.col("seq") / ordering.BLOCK_ROWS)).where("instant < previous")
    late = episode_instants(spark, sf_dir, stamps).where(F.unix_micros("instant") > F.col("updated_at") * 1e6)
    return back.select(F.lit("transcript_lines").alias("tbl"), "id").unionByName(late.select(F.lit("episodes").alias("tbl"), "id")).distinct()


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instant, or null and the reason, per record of both tables."""
    stamps = dictionary(spark)
    lines = line_instants(spark, sf_dir, stamps).select(F.lit("transcript_lines").alias("tbl"), "id", "instant", "stamp_status")
    notes = episode_instants(spark, sf_dir, stamps).select(F.lit("episodes").alias("tbl"), "id", "instant", "stamp_status")
    return lines.unionByName(notes).distinct()


def p1_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every record in microseconds since 1970, null where none can be told."""
    return p1_instants(spark, sf_dir).select("tbl", "id", F.unix_micros("instant").alias("us")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lie on a cycle of parent links or whose parents lead into one."""
    lines = table(spark, sf_dir, "transcript_lines")
    places = hierarchy.nested_sets(lines, "session_id", "id", "parent_id", "seq")
    return places.where("link in ('cycle', 'below-cycle')").select(F.col("node").alias("id")).distinct()


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and range of descendants of each record within its session."""
    lines = table(spark, sf_dir, "transcript_lines")
    places = hierarchy.nested_sets(lines, "session_id", "id", "parent_id", "seq", paths=True)
    return places.withColumnsRenamed({"grp": "session_id", "node": "id"})


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose relations are asked for: those of lines with a number divisible by 50."""
    return table(spark, sf_dir, "transcript_lines").where("line_id % 50 = 0 and session_id is not null and id is not null").select(F.col("session_id").alias("grp"), F.col("id").alias("node")).distinct()


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(hierarchy.nested_sets(table(spark, sf_dir, "transcript_lines"), "session_id", "id", "parent_id", "seq"), "places")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of the records asked for; p3_all_descendants has those of all records."""
    return hierarchy.descendants(_places(spark, sf_dir), _asked(spark, sf_dir)).withColumnsRenamed({"grp": "session_id", "node": "id"})


def p3_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of the records asked for; p3_all_ancestors has those of all records."""
    return hierarchy.ancestors(_places(spark, sf_dir), _asked(spark, sf_dir)).withColumnsRenamed({"grp": "session_id", "node": "id"})


def p3_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every record."""
    return hierarchy.descendants(_places(spark, sf_dir)).withColumnsRenamed({"grp": "session_id", "node": "id"})


def p3_all_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every record: the same pairs, read from below."""
    return hierarchy.descendants(_places(spark, sf_dir)).select(F.col("grp").alias("session_id"), F.col("descendant").alias("id"), F.col("node").alias("ancestor"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of the payload's fields between consecutive files of a stream."""
    return drift.changes(table(spark, sf_dir, "rollout_records"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads in one table whose schema is the union of all files' schemas."""
    records = table(spark, sf_dir, "rollout_records")
    known = materialise(drift.headers(drift.fields(records.select("stream_id", "event_type", "file_no", "payload"))), "headers")
    log = materialise(drift.changes(records, known), "changes")
    return drift.unify(records, log, ["rec_id", "stream_id", "event_type", "file_no", "line_no"], known)


_NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?(E-?[0-9]+)?$"


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table's filled cells by record and field; numbers as doubles, and of nested values the kind."""
    wide = p5_unified(spark, sf_dir)
    cells = F.explode(F.array(*(F.struct(F.lit(c[2:]).alias("field"), F.col(f"`{c}`").cast("string").alias("t")) for c in wide.columns if c.startswith("f_")))) if len(wide.columns) > 5 else None
    if cells is None:
        return wide.select("rec_id", F.lit("").alias("field"), F.lit(0.0).alias("number"), F.lit("").alias("words")).where("false")
    number, first = F.when(F.col("x.t").rlike(_NUMBER), F.col("x.t").try_cast("double")), F.left("x.t", F.lit(1))  # Java's own reading takes 80e1f for a number
    words = F.when(number.isNull(), F.when(first.isin("{", "["), first).otherwise(F.col("x.t")))
    return wide.select("rec_id", cells.alias("x")).where("x.t is not null").select("rec_id", "x.field", F.round(number, 6).alias("number"), words.alias("words"))


def _message_nodes(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    return nested.label(table(spark, sf_dir, "transcript_lines"), "message", ["id"], only)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of the content lists in the messages, by its path."""
    return nested.content_elements(_message_nodes(spark, sf_dir, nested.CONTENT)).select("id", "block_path").distinct()


def _members(fields: Column) -> Column:
    """An object's scalar members as JSON, by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per readable message, with its role and all scalar members of its root."""
    roots = nested.table_of(_message_nodes(spark, sf_dir, "^$"), "^$")
    return roots.select("id", "node_kind", F.col("fields")["role"].alias("role"), _members(F.col("fields")).alias("members")).distinct()


def p7_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tables of all schema paths, each with its link to the row above."""
    rows = nested.flat(_message_nodes(spark, sf_dir))
    return rows.select("id", "table_path", "node", "parent", "place", _members(F.col("fields")).alias("members"), F.col("node_value").alias("item")).distinct()


def p7_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' scalar columns, and in how many rows each stands."""
    rows = nested.flat(_message_nodes(spark, sf_dir))
    fields = rows.select("table_path", F.explode(F.map_keys("fields")).alias("column_name"))
    return fields.groupBy("table_path", "column_name").agg(F.count("*").alias("n_rows"))


def p7_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content elements with their parent element and scalar members."""
    f = F.col("fields")
    text = F.coalesce("node_value", f["text"], f["thinking"])
    return (
        nested.content_elements(_message_nodes(spark, sf_dir, nested.CONTENT))
        .select("id", "block_path", "parent_path", F.coalesce(f["type"], F.lit("text")).alias("element_type"), text.alias("text"), f["name"].alias("name"), f["mime"].alias("mime"), f["ref"].alias("ref"), f["uri"].alias("uri"))
        .distinct()
    )


def p7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and tool results among the content elements, linked to their element; arguments join by the parent's label."""
    nodes = nested.label(table(spark, sf_dir, "transcript_lines"), "message", ["id"], nested.CONTENT + r"|\.arguments$", r"\.arguments$")
    nodes = materialise(nodes, "call-nodes")
    f = F.col("fields")
    calls = nested.content_elements(nodes).where(F.lower(f["type"]).rlike("tool")).withColumn("node", nested.dewey_text(F.col("dewey")))
    given = nested.table_of(nodes, r"\.arguments$").select("id", F.col("parent").alias("node"), F.col("node_value").alias("arguments")).distinct()
    return calls.join(given, ["id", "node"], "left").select(
        "id", "block_path", F.coalesce(f["id"], f["toolCallId"]).alias("call_id"), f["type"].alias("element_type"), f["name"].alias("name"),
        f["intent"].alias("intent"), "arguments", f["isError"].alias("is_error"),
    ).distinct()


_ABBREVIATIONS = "CET|CEST|EST|EDT|PST|PDT|GMT"
_FORMATS = ", ".join(f"'{f}'" for f in ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S", "%b %-d, %Y %-I:%M:%S %p"])
#: The instants (us, in microseconds) of all stamps of the test tables by text and zone, by another way: strip zone and fraction, then try formats.
STAMPS_SQL = f"""s0 AS (SELECT DISTINCT raw, tz, trim(raw) AS s FROM (SELECT event_timestamp AS raw, tz_name AS tz FROM transcript_lines LEFT JOIN sessions USING (session_id) UNION ALL SELECT created_at, tz_name FROM episodes LEFT JOIN projects USING (project_id))),
 s1 AS (SELECT *, regexp_extract(s, '\\[([^\\]]+)\\]$', 1) AS br, regexp_replace(s, '\\[[^\\]]+\\]$', '') AS a FROM s0),
 s2 AS (SELECT *, regexp_extract(a, ' ({_ABBREVIATIONS})$', 1) AS ab, regexp_replace(a, ' ({_ABBREVIATIONS})$', '') AS b FROM s1),
 s3 AS (SELECT *, CASE WHEN regexp_matches(b, '\\dZ$') THEN '+0000' ELSE replace(regexp_extract(b, '\\d\\d(?:[.,]\\d+)? ?([+-]\\d\\d:?\\d\\d)$', 1), ':', '') END AS off, regexp_replace(b, '(Z| ?[+-]\\d\\d:?\\d\\d)$', '') AS c FROM s2),
 s4 AS (SELECT *, regexp_extract(c, '[.,](\\d{{3,9}})$', 1) AS fr, try_strptime(regexp_replace(CASE WHEN off = '' THEN b ELSE c END, '[.,]\\d{{3,9}}$', ''), [{_FORMATS}]) AS w FROM s3),
 s5 AS (SELECT *, coalesce(nullif(br, ''), tz) AS z, timezone(coalesce(nullif(br, ''), tz), w) AS u FROM s4),
 stamps AS (SELECT raw, tz, CASE
  WHEN regexp_full_match(s, '\\d{{10}}(\\.\\d+)?') THEN CAST(round(CAST(s AS DECIMAL(20, 6)) * 1000000) AS BIGINT) WHEN regexp_full_match(s, '\\d{{13}}') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_full_match(s, '\\d{{16}}') THEN CAST(s AS BIGINT)
  WHEN w IS NULL THEN NULL
  WHEN off <> '' THEN epoch_us(w) - (CASE WHEN off[1:1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS BIGINT) * 60 + CAST(off[4:5] AS BIGINT)) * 60000000 + CAST(rpad(coalesce(fr, ''), 6, '0') AS BIGINT)
  WHEN ab <> '' THEN epoch_us(w) - CAST(map {{'CET': 1, 'CEST': 2, 'EST': -5, 'EDT': -4, 'PST': -8, 'PDT': -7, 'GMT': 0}}[ab] AS BIGINT) * 3600000000
  WHEN timezone(z, u) = w AND timezone(z, u + INTERVAL 1 HOUR) <> w AND timezone(z, u - INTERVAL 1 HOUR) <> w THEN epoch_us(u) + CAST(rpad(coalesce(fr, ''), 6, '0') AS BIGINT) END AS us FROM s5)"""

#: Each record once, with its order and whether its parent is there; and the records asked for that hang from a root.
_LINKS_SQL = """n0 AS MATERIALIZED (SELECT session_id, id, min({'o': seq, 'a': parent_id}) AS m FROM transcript_lines WHERE session_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
 n1 AS (SELECT session_id, id, m.a AS above, m.o AS ord FROM n0),
 n AS MATERIALIZED (SELECT *, EXISTS (SELECT 1 FROM n0 p WHERE p.session_id = n1.session_id AND p.id = n1.above) AS there FROM n1)"""
_PLACED_SQL = """ok AS MATERIALIZED (SELECT session_id, id FROM n WHERE NOT there UNION ALL SELECT n.session_id, n.id FROM n JOIN ok ON ok.session_id = n.session_id AND ok.id = n.above),
 q AS (SELECT DISTINCT session_id, id FROM transcript_lines JOIN ok USING (session_id, id) WHERE line_id % 50 = 0)"""
#: Every record that hangs from a root, with each record above it.
_ABOVE_SQL = """ok AS MATERIALIZED (SELECT session_id, id FROM n WHERE NOT there UNION ALL SELECT n.session_id, n.id FROM n JOIN ok ON ok.session_id = n.session_id AND ok.id = n.above),
 a AS (SELECT session_id, id, above AS ancestor FROM n JOIN ok USING (session_id, id) WHERE there UNION ALL SELECT a.session_id, a.id, n.above FROM a JOIN n ON n.session_id = a.session_id AND n.id = a.ancestor WHERE n.there)"""

_DRIFT_SQL = """f AS (SELECT DISTINCT stream_id, event_type, file_no, payload FROM rollout_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
 k AS (SELECT *, unnest(json_keys(payload)) AS field FROM f),
 v AS (SELECT stream_id, event_type, file_no, field, json_extract(payload, concat('$."', field, '"')) AS value FROM k),
 t AS (SELECT *, CASE json_type(value) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind FROM v),
 h AS (SELECT stream_id, event_type, file_no, field, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind FROM t GROUP BY ALL),
 s AS (SELECT *, lag(file_no) OVER (PARTITION BY stream_id, event_type ORDER BY file_no) AS was FROM (SELECT DISTINCT stream_id, event_type, file_no FROM h) QUALIFY was IS NOT NULL),
 o AS (SELECT s.*, h.field, h.kind FROM s JOIN h ON h.stream_id = s.stream_id AND h.event_type = s.event_type AND h.file_no = s.was),
 n AS (SELECT s.*, h.field, h.kind FROM s JOIN h USING (stream_id, event_type, file_no)),
 gone AS (SELECT * FROM o ANTI JOIN n USING (stream_id, event_type, file_no, field)),
 come AS (SELECT * FROM n ANTI JOIN o USING (stream_id, event_type, file_no, field)),
 pair AS (SELECT g.stream_id, g.event_type, g.file_no, g.field AS old_field, c.field AS new_field,
   (SELECT count(*) FROM (SELECT CAST(value AS VARCHAR) FROM t WHERE t.stream_id = g.stream_id AND t.event_type = g.event_type AND t.file_no = g.was AND t.field = g.field AND kind IS NOT NULL INTERSECT
    SELECT CAST(value AS VARCHAR) FROM t WHERE t.stream_id = g.stream_id AND t.event_type = g.event_type AND t.file_no = g.file_no AND t.field = c.field AND kind IS NOT NULL)) AS common
  FROM gone g JOIN come c ON c.stream_id = g.stream_id AND c.event_type = g.event_type AND c.file_no = g.file_no AND c.kind = g.kind),
 renamed AS (SELECT * FROM pair WHERE common > 0 QUALIFY row_number() OVER (PARTITION BY stream_id, event_type, file_no, old_field ORDER BY common DESC, new_field) = 1 AND row_number() OVER (PARTITION BY stream_id, event_type, file_no, new_field ORDER BY common DESC, old_field) = 1)"""

SQL = {
    "p1_found": f"""WITH {STAMPS_SQL},
 l AS (SELECT DISTINCT session_id, seq, id, us FROM transcript_lines LEFT JOIN sessions USING (session_id) JOIN stamps ON raw = event_timestamp AND tz IS NOT DISTINCT FROM tz_name WHERE us IS NOT NULL),
 p AS (SELECT id, us, lag(us) OVER (PARTITION BY session_id ORDER BY seq, id) AS before FROM l)
 SELECT DISTINCT 'transcript_lines' AS tbl, id FROM p WHERE us < before
 UNION SELECT 'episodes', id FROM episodes LEFT JOIN projects USING (project_id) JOIN stamps ON raw = created_at AND tz IS NOT DISTINCT FROM tz_name WHERE us > updated_at * 1e6""",
    # What a walk down from the heads of all trees doesn't reach is on a cycle or below one.
    "p3_found": """WITH RECURSIVE n AS (SELECT DISTINCT session_id, id, parent_id FROM transcript_lines WHERE session_id IS NOT NULL AND id IS NOT NULL),
 ok AS (SELECT session_id, id FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.session_id = n.session_id AND p.id = n.parent_id)
  UNION SELECT n.session_id, n.id FROM n JOIN ok ON ok.session_id = n.session_id AND ok.id = n.parent_id)
 SELECT DISTINCT id FROM n WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.session_id = n.session_id AND ok.id = n.id)""",
    "p1_micros": f"""WITH {STAMPS_SQL}
 SELECT DISTINCT 'transcript_lines' AS tbl, id, us FROM transcript_lines LEFT JOIN sessions USING (session_id) LEFT JOIN stamps ON raw = event_timestamp AND tz IS NOT DISTINCT FROM tz_name
 UNION SELECT 'episodes', id, us FROM episodes LEFT JOIN projects USING (project_id) LEFT JOIN stamps ON raw = created_at AND tz IS NOT DISTINCT FROM tz_name""",
    # Preorder is the order of the ways from the root, siblings by seq and id.
    "p3_hierarchy": f"""WITH RECURSIVE {_LINKS_SQL},
 w AS (SELECT session_id, id, 0 AS depth, id AS root, [{{'o': ord, 'i': id}}] AS way, CASE WHEN above IS NULL THEN 'root' ELSE 'orphan' END AS link FROM n WHERE NOT there
  UNION ALL SELECT n.session_id, n.id, w.depth + 1, w.root, list_append(w.way, {{'o': ord, 'i': n.id}}), 'child' FROM n JOIN w ON n.session_id = w.session_id AND n.above = w.id),
 p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY way) - 1 AS range_start FROM w),
 k AS (SELECT session_id, x.i AS id, count(*) - 1 AS below FROM (SELECT session_id, unnest(way) AS x FROM w) GROUP BY ALL),
 stuck AS MATERIALIZED (SELECT * FROM n ANTI JOIN w USING (session_id, id)),
 u AS (SELECT session_id, id, above AS at FROM stuck UNION SELECT u.session_id, u.id, s.above FROM u JOIN stuck s ON s.session_id = u.session_id AND s.id = u.at)
 SELECT session_id, p.id, link, root, CAST(depth AS BIGINT) AS depth, CAST(range_start AS BIGINT) AS range_start, below AS n_descendants, array_to_string(list_transform(way, lambda x: x.i), '/') AS path FROM p JOIN k USING (session_id, id)
 UNION ALL SELECT session_id, id, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.session_id = stuck.session_id AND u.id = stuck.id AND u.at = stuck.id) THEN 'cycle' ELSE 'below-cycle' END, NULL, NULL, NULL, NULL, NULL FROM stuck""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS_SQL}, {_PLACED_SQL},
 d AS (SELECT q.session_id, q.id, n.id AS descendant FROM q JOIN n ON n.session_id = q.session_id AND n.above = q.id UNION ALL SELECT d.session_id, d.id, n.id FROM d JOIN n ON n.session_id = d.session_id AND n.above = d.descendant)
 SELECT * FROM d""",
    "p3_ancestors": f"""WITH RECURSIVE {_LINKS_SQL}, {_PLACED_SQL},
 a AS (SELECT q.session_id, q.id, n.above AS ancestor FROM q JOIN n ON n.session_id = q.session_id AND n.id = q.id WHERE n.there UNION ALL SELECT a.session_id, a.id, n.above FROM a JOIN n ON n.session_id = a.session_id AND n.id = a.ancestor WHERE n.there)
 SELECT * FROM a""",
    "p3_all_descendants": f"""WITH RECURSIVE {_LINKS_SQL}, {_ABOVE_SQL}
 SELECT session_id, ancestor AS id, id AS descendant FROM a""",
    "p3_all_ancestors": f"""WITH RECURSIVE {_LINKS_SQL}, {_ABOVE_SQL}
 SELECT * FROM a""",
    "p5_found": f"""WITH {_DRIFT_SQL}
 SELECT stream_id, file_no, event_type, 'renamed' AS change_kind, old_field, new_field FROM renamed
 UNION ALL SELECT stream_id, file_no, event_type, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_id = g.stream_id AND r.event_type = g.event_type AND r.file_no = g.file_no AND r.old_field = g.field)
 UNION ALL SELECT stream_id, file_no, event_type, 'added', '', field FROM come g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.stream_id = g.stream_id AND r.event_type = g.event_type AND r.file_no = g.file_no AND r.new_field = g.field)
 UNION ALL SELECT o.stream_id, o.file_no, o.event_type, 'retyped', o.field, o.field FROM o JOIN n USING (stream_id, event_type, file_no, field) WHERE o.kind <> n.kind""",
    # Each field of each file is followed back through its renames; a name that comes again after it was renamed away is another field.
    "p5_cells": f"""WITH RECURSIVE {_DRIFT_SQL},
 i AS MATERIALIZED (SELECT stream_id, event_type, file_no AS s, new_field AS f, old_field AS o FROM renamed),
 wk AS (SELECT DISTINCT stream_id, event_type, file_no, field, field AS f, file_no AS n FROM h
  UNION ALL SELECT w.stream_id, w.event_type, w.file_no, w.field, i.o, i.s - 1 FROM wk w JOIN i ON i.stream_id = w.stream_id AND i.event_type = w.event_type AND i.f = w.f AND i.s <= w.n
   WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.stream_id = w.stream_id AND j.event_type = w.event_type AND (j.f = w.f OR j.o = w.f) AND j.s > i.s AND j.s <= w.n)),
 term AS (SELECT stream_id, event_type, file_no, field, arg_min(f, n) AS f, min(n) AS n FROM wk GROUP BY ALL),
 ra AS (SELECT DISTINCT stream_id, event_type, o AS f, s FROM i WHERE NOT EXISTS (SELECT 1 FROM i p WHERE p.stream_id = i.stream_id AND p.event_type = i.event_type AND p.f = i.o AND p.s < i.s
   AND NOT EXISTS (SELECT 1 FROM i j WHERE j.stream_id = i.stream_id AND j.event_type = i.event_type AND j.o = i.o AND j.s > p.s AND j.s < i.s))),
 nm AS (SELECT term.*, (SELECT count(*) FROM ra WHERE ra.stream_id = term.stream_id AND ra.event_type = term.event_type AND ra.f = term.f AND ra.s <= term.n) AS c FROM term),
 r AS (SELECT *, unnest(json_keys(payload)) AS field FROM rollout_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
 x AS (SELECT rec_id, concat(coalesce(nm.f, r.field), CASE WHEN c > 0 THEN concat('#', c + 1) END) AS field, json_extract(payload, concat('$."', r.field, '"')) AS j FROM r LEFT JOIN nm USING (stream_id, event_type, file_no, field)),
 y AS (SELECT *, CASE WHEN regexp_matches(t, '{_NUMBER}') THEN TRY_CAST(t AS DOUBLE) END AS v FROM (SELECT rec_id, field, CASE json_type(j) WHEN 'VARCHAR' THEN j->>'$' ELSE CAST(j AS VARCHAR) END AS t FROM x WHERE json_type(j) <> 'NULL'))
 SELECT rec_id, field, round(v, 6) AS number, CASE WHEN v IS NULL THEN CASE WHEN t[1] IN ('{{', '[') THEN t[1] ELSE t END END AS words FROM y""",
}
