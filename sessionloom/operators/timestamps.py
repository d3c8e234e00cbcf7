"""Mixed timestamp spellings to one UTC instant.

The distinct (source, raw text, zone) triples form a dictionary. Each entry is
parsed once, against every known spelling, and kept in a table that later runs
extend; rows get their instant by an equi-join. Parsing is a Column expression,
so it stays in generated code, and it touches a triple once however often the
triple occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import runtime

DICTIONARY = T.StructType(
    [
        T.StructField("stamp_source", T.StringType()),
        T.StructField("stamp_raw", T.StringType()),
        T.StructField("stamp_zone", T.StringType()),
        T.StructField("instant", T.TimestampType()),
        T.StructField("stamp_status", T.StringType()),
    ]
)

# Zone abbreviations in log lines, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "BRT": -180, "ART": -180, "EDT": -240, "EST": -300, "CDT": -300, "CST": -360,
    "MDT": -360, "MST": -420, "PDT": -420, "PST": -480, "AKDT": -480, "AKST": -540, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z_]++(?:/[A-Za-z0-9_+-]++)++))?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_MONTH = r"([A-Za-z]{3})[A-Za-z]*\.?"
#: Spelling, pattern, and which groups hold year, month, day, hour, minute, second, fraction, am/pm, zone, bracketed zone.
_SPELLINGS = [
    ("iso", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt ,]+{_CLOCK}{_AMPM}{_ZONE})?$", "1 2 3 4 5 6 7 8 9 10"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE})?$", "1 2 3 4 5 6 7 - 8 9"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[ ,T]+{_CLOCK}{_AMPM}{_ZONE})?$", "3 2 1 4 5 6 7 8 9 10"),
    ("mail", rf"^(?:[A-Za-z]{{2,9}}\.?,?\s+)?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})[ ,:]+{_CLOCK}{_AMPM}{_ZONE}$", "3 2 1 4 5 6 7 8 9 10"),
    ("month-first", rf"^{_MONTH} +(\d{{1,2}}),? +(\d{{4}}),?(?: +at)? +{_CLOCK}{_AMPM}{_ZONE}$", "3 1 2 4 5 6 7 8 9 10"),
    ("ctime", rf"^[A-Za-z]{{3}} +{_MONTH} +(\d{{1,2}}) +{_CLOCK} +(\d{{4}})$", "7 1 2 3 4 5 6 - - -"),
    ("day-slash", rf"^(1[3-9]|2\d|3[01])/(\d{{1,2}})/(\d{{4}})[ ,T]+{_CLOCK}{_AMPM}{_ZONE}$", "3 2 1 4 5 6 7 8 9 10"),
    ("month-slash", rf"^(\d{{1,2}})/(1[3-9]|2\d|3[01])/(\d{{4}})[ ,T]+{_CLOCK}{_AMPM}{_ZONE}$", "3 1 2 4 5 6 7 8 9 10"),
]
_OWN_ZONE = r"(?i)(\d\s*Z|[+-]\d{1,2}:?\d{2}|\d\s*[A-Z]{3,5}|(?<![A-Z_/+-])[A-Z_]++/[A-Z_/+-]++\]?|\[[A-Z0-9_+/-]+\])$"
_EPOCH = r"^[+-]?\d{9,}(\.\d+)?$"
_HOUR = 3_600_000_000


def zone_names(spark: SparkSession) -> list[str]:
    """The zone names that this JVM knows: a fixed list of a few hundred."""
    jvm = spark.sparkContext._jvm
    return sorted(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))


def clean(raw: Column) -> Column:
    """Without white space at the ends. The pattern starts at whole runs only, so a text of any length costs one pass."""
    return F.regexp_replace(F.trim(raw), r"^[\s\x{A0}\x{FEFF}]+|(?<![\s\x{A0}\x{FEFF}])[\s\x{A0}\x{FEFF}]++$", "")


def needs_zone(raw: Column) -> Column:
    """Whether the text depends on the clock of its source: it is neither an epoch number nor names a zone."""
    s = clean(raw)
    return ~(s.rlike(_EPOCH) | s.rlike(_OWN_ZONE))


def _epoch_micros(s: Column) -> Column:
    whole = F.regexp_extract(s, r"^[+-]?(\d+)", 1)
    unit = (
        F.when(F.length(whole) <= 11, F.lit(6))
        .when(F.length(whole) <= 14, F.lit(3))
        .when(F.length(whole) <= 17, F.lit(0))
        .when(F.length(whole) <= 20, F.lit(-3))
    )
    number = s.try_cast("decimal(38,9)")
    scale = F.when(unit == 6, F.lit(1_000_000)).when(unit == 3, F.lit(1_000)).otherwise(F.lit(1)).cast("decimal(12,0)")
    return F.when(
        unit.isNotNull(),
        F.floor(F.when(unit == -3, number / F.lit(1000)).otherwise(number * scale)).try_cast("bigint"),
    )


def _offset_at(micros: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)) - micros


def parse_stamps(stamps: DataFrame, raw: str, zone: str, zones: list[str]) -> DataFrame:
    """``stamps`` with ``instant`` and ``stamp_status``, by every known spelling.

    ``zone`` is the clock of the source, used only where the text names none.
    The status is the spelling found, or the reason why there is no instant:
    ``missing`` (null, blank or a dash), ``unreadable``, ``no-zone`` (neither
    the text nor the source names a known zone), ``ambiguous`` (the zone's
    clock shows that wall time twice) or ``skipped`` (never). An offset decides
    over a zone name in brackets. Digits beyond microseconds are cut.

    The steps are separate projections: each uses the one before several
    times, and a single expression would repeat them.
    """
    col, kept = F.col, stamps.columns
    spelled = F.lit(None).cast("string")
    for name, pattern, groups in reversed(_SPELLINGS):
        to = ";".join([name, *("" if g == "-" else f"${g}" for g in groups.split())])
        spelled = F.when(col("_s").rlike(pattern), F.regexp_replace("_s", pattern, to)).otherwise(spelled)
    part = lambda i: F.nullif(col("_p").getItem(i), F.lit(""))
    cut = stamps.withColumn("_s", clean(col(raw))).withColumn("_p", F.split(spelled, ";"))
    cut = cut.select(*kept, "_s", col("_p").getItem(0).alias("_form"), *(part(i).alias(f"_{i}") for i in range(1, 11)))

    hour = F.coalesce(col("_4"), F.lit("0")).try_cast("int")
    hour = (
        F.when(col("_8").isNull(), hour)
        .when(hour.between(1, 12), hour % 12 + F.when(F.upper("_8") == "P", 12).otherwise(0))
    )
    names = F.array(*map(F.lit, MONTHS))
    month = F.coalesce(col("_2").try_cast("int"), F.nullif(F.array_position(names, F.lower("_2")), F.lit(0)).cast("int"))
    second = F.concat(F.coalesce("_6", F.lit("0")), F.lit("."), F.substring(F.rpad(F.coalesce("_7", F.lit("")), 6, "0"), 1, 6))
    wall = F.unix_micros(
        F.try_make_timestamp(
            col("_1").try_cast("int"), month, col("_3").try_cast("int"), hour,
            F.coalesce(col("_5"), F.lit("0")).try_cast("int"), second.try_cast("decimal(16,6)"), F.lit("UTC"),
        )
    )
    offset = (
        F.when(col("_9").contains("-"), -1).otherwise(1)
        * (
            F.regexp_extract("_9", r"[+-](\d{1,2})", 1).try_cast("int") * 60
            + F.coalesce(F.regexp_extract("_9", r"[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
        )
    )
    abbreviation = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))))
    area = col("_9").contains("/")
    read = cut.select(
        *kept, "_s", "_form",
        wall.alias("_wall"),
        F.when(col("_9").rlike(r"[+-]\d"), offset).when(~area, F.try_element_at(abbreviation, F.upper("_9"))).alias("_minutes"),
        (col("_9").isNotNull() & ~area & ~col("_9").rlike(r"[+-]\d")).alias("_word"),
        F.coalesce(F.when(area, col("_9")), col("_10"), clean(col(zone))).alias("_zone"),
    ).withColumn("_known", F.coalesce(col("_zone").isin(zones), F.lit(False)) & col("_minutes").isNull() & col("_wall").isNotNull())
    # Both offsets near the wall time: a candidate counts where the zone's clock shows the wall time at it.
    near = lambda hours: F.when(col("_known"), col("_wall") - _offset_at(col("_wall") + hours * _HOUR, col("_zone")))
    shows = lambda c: F.when(col("_known"), col(c) + _offset_at(col(c), col("_zone")) == col("_wall"))
    tried = read.withColumns({"_early": near(-26), "_late": near(26)}).withColumns({"_e": shows("_early"), "_l": shows("_late")})
    instant = (
        F.when(col("_s").rlike(_EPOCH), _epoch_micros(col("_s")))
        .when(col("_minutes").isNotNull() & (F.abs("_minutes") <= 18 * 60), col("_wall") - col("_minutes").cast("bigint") * 60_000_000)
        .when(col("_e") & col("_l") & (col("_early") != col("_late")), F.lit(None))
        .when(col("_e"), col("_early"))
        .when(col("_l"), col("_late"))
    )
    status = (
        F.when(col("_s").isNull() | col("_s").rlike(r"^[-–—\s]*$"), "missing")
        .when(col("_us").isNotNull(), F.coalesce("_form", F.lit("epoch")))
        .when(col("_wall").isNull() | col("_word") | col("_minutes").isNotNull(), "unreadable")
        .when(~col("_known"), "no-zone")
        .when(col("_e"), "ambiguous")
        .otherwise("skipped")
    )
    return tried.withColumn("_us", F.when(~(col("_word") & col("_minutes").isNull()) | col("_s").rlike(_EPOCH), instant)).select(
        *kept, F.timestamp_micros("_us").alias("instant"), status.alias("stamp_status")
    )


class StampDictionary:
    """A table of parsed stamps in the shared folder, or at a ``path`` that later runs and other queries extend.

    Two writers at once may parse a triple twice; readers take each once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or runtime.scratch_path(spark, "stamps")
        self.zones = zone_names(spark)

    def read(self) -> DataFrame:
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
        return self.spark.read.schema(DICTIONARY).parquet(self.path) if there else self.spark.createDataFrame([], DICTIONARY)

    def extend(self, stamps: DataFrame) -> DataFrame:
        """Parse those triples of ``stamps`` that the table lacks, and append them. Returns the table."""
        keys = ["stamp_source", "stamp_raw", "stamp_zone"]
        new, known = stamps.select(*keys).distinct(), self.read()
        if known.columns and self._any(known):
            match = [new[k].eqNullSafe(known[k]) for k in keys]
            new = new.join(known, match, "left_anti")
        parse_stamps(new.select(*keys), "stamp_raw", "stamp_zone", self.zones).write.mode("append").parquet(self.path)
        return self.read()

    @staticmethod
    def _any(df: DataFrame) -> bool:
        return bool(df.take(1))


def normalise(rows: DataFrame, stamp: str, zone: str | None, source: str, dictionary: StampDictionary) -> DataFrame:
    """``rows`` with ``instant`` (UTC) and ``stamp_status``.

    ``stamp`` and ``zone`` name the columns of the text and of the source's
    zone (None: unknown). All rows come back, duplicates included; columns of
    ``rows`` named ``instant`` or ``stamp_status`` are replaced. An empty table
    gives an empty one. Null stamps have the status ``missing``; they meet
    nothing in the join and are spread over its tasks. Texts of any length are
    read as they are.
    """
    runtime.require_columns(rows, stamp, *([zone] if zone else []))
    keyed = rows.drop("instant", "stamp_status").withColumns(
        {
            "__raw": F.col(f"`{stamp}`").cast("string"),
            "__zone": F.when(needs_zone(F.col(f"`{stamp}`").cast("string")), F.col(f"`{zone}`") if zone else F.lit(None)).cast("string"),
        }
    )
    entries = dictionary.extend(
        keyed.where("__raw is not null").select(F.lit(source).alias("stamp_source"), F.col("__raw").alias("stamp_raw"), F.col("__zone").alias("stamp_zone"))
    )
    entries = entries.where(F.col("stamp_source") == source).select(
        F.col("stamp_raw").alias("__r"), F.coalesce("stamp_zone", F.lit("")).alias("__z"), "instant", "stamp_status"
    )
    # The aggregation has the join's keys, so it needs no exchange of its own.
    entries = entries.groupBy("__r", "__z").agg(F.min("instant").alias("instant"), F.min("stamp_status").alias("stamp_status"))
    apart = F.concat(F.lit("\x00"), (F.rand(7) * (1 << 20)).cast("int").cast("string"))
    keyed = keyed.withColumns({"__there": F.col("__raw").isNotNull(), "__raw": F.coalesce("__raw", apart), "__zone": F.coalesce("__zone", F.lit(""))})
    found = keyed.join(entries, (F.col("__raw") == F.col("__r")) & (F.col("__zone") == F.col("__z")) & F.col("__there"), "left")
    return found.drop("__raw", "__zone", "__r", "__z", "__there").withColumn("stamp_status", F.coalesce("stamp_status", F.lit("missing")))
