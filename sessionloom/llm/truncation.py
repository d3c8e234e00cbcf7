"""Texts cut off by a field limit or a broken transfer.

One pass over the distinct texts gathers a vocabulary of words, one of lines,
and each text's end. Both become a trie, held in sorted order: the entries
below a node are the range of keys that begin with it, so what lies below all
ends' last words and lines is counted by one running sum over the sorted keys
and ends, however long they are. A text is cut where its final word is an
unknown proper prefix of known words. Further evidence joins that test: a text
whose end is open has a length that its source has far too often (a field
limit), or a final line that isn't known as a complete one from other texts,
or it shows a trace (an ellipsis, a marker, half a character, an open structure).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import runtime

#: A word or line is known where so many texts have it.
MIN_TEXTS = 2
#: A final line that never stands inside a text needs so many texts that end with it.
MIN_CLOSERS = 3
#: A length is a limit where its count exceeds the mean of its neighbours by so many standard deviations.
PEAK = 8.0
NEIGHBOURS = 10
#: Characters of distinct words and lines held by a task before it sends their counts on.
HELD_CHARS = 32 << 20

# Notes of a cut, as they stand in brackets.
MARKS = ["truncated", "cut", "cut off", "snip", "snipped", "abridged", "abgeschnitten", "troncato", "truncado", "more", "...", "…"]
_BRACKETS = {"]": "[", ")": "(", ">": "<", "}": "{"}
_HEX = re.compile(r"\b(?:(?=[0-9a-f]*\d)[0-9a-f]{7,64}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{3,6})\b")
_PATH = re.compile(r"(?<!\S)[\w.-]+(?:/[\w.-]+)+\.[a-z]{1,5}\b")
_DIGITS = re.compile(r"\d+")
_EDGE = "()[]{}<>\"'“”‘’«»*_`|#,;:!?…"
_END = ".!?。！？"
_JSON = re.compile(r"\s*[\[{]\s*[\"{\[]")


def shape(line: str) -> str:
    """A line with paths, hashes and numbers masked."""
    return _DIGITS.sub("9", _HEX.sub("H", _PATH.sub("F", line)))


def word_shape(token: str) -> str:
    token = token.strip(_EDGE).rstrip(".")
    return _DIGITS.sub("9", _HEX.sub("H", token)) if token else ""


def _unmarked(body: str) -> tuple[str, bool]:
    """``body`` without a note of the cut or half a character at its end, and whether there was one."""
    if body.endswith("\ufffd"):
        return body[:-1].rstrip(), True
    if opening := _BRACKETS.get(body[-1:]):
        at = body.rfind(opening)
        if at >= 0 and body[at + 1 : -1].strip().lower() in MARKS:
            return body[:at].rstrip(), True
    return body, False


def ending(text: str) -> dict:
    """What the end of a text shows; see ``_scan`` for the fields."""
    body, marked = _unmarked(text.rstrip())
    ellipsis = body.endswith(("…", "..."))
    line = body[body.rfind("\n") + 1 :].strip()
    plain = (line[:-1] if line.endswith("…") else line.rstrip(".")).rstrip() if ellipsis else line
    raw = plain[max(plain.rfind(c) for c in (" ", "\t", "\xa0")) + 1 :]
    opened = text.count("```") % 2 == 1 and not body.endswith("```")
    json_like = bool(_JSON.match(text))
    unclosed = json_like and (text.count("{") > text.count("}") or text.count("[") > text.count("]"))
    closed = bool(body) and not ellipsis and (body[-1] in _END or body.endswith("```") or (json_like and not unclosed and body[-1] in "}]"))
    quoted = body.rstrip("\"'”’»)*_")
    closed = closed or (bool(quoted) and not ellipsis and not json_like and quoted[-1] in _END)
    return {
        "marked": marked, "ellipsis": ellipsis, "open_block": opened or unclosed, "closed": closed,
        "line": shape(line), "bare_line": shape(plain), "n_words": len(plain.split()),
        "word": word_shape(raw), "dotted": _DIGITS.sub("9", _HEX.sub("H", raw.lstrip(_EDGE))) if raw.endswith(".") else None,
    }


_FIELDS = ["marked", "ellipsis", "open_block", "closed", "line", "bare_line", "n_words", "word", "dotted"]
_ARROW = pa.schema(
    [("what", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("text_key", pa.binary())]
    + [(f, pa.bool_()) for f in _FIELDS[:4]]
    + [("line", pa.string()), ("bare_line", pa.string()), ("n_words", pa.int64()), ("word", pa.string()), ("dotted", pa.string())]
)
_SCHEMA = (
    "what string, key string, n bigint, text_key binary, marked boolean, ellipsis boolean, open_block boolean, closed boolean, "
    "line string, bare_line string, n_words bigint, word string, dotted string"
)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: the end of each text (doc), and counts of words and inner lines by text."""
    words, lines, held = Counter(), Counter(), 0

    def counts() -> pa.RecordBatch:
        merged: Counter = Counter()
        for token, n in words.items():
            if s := word_shape(token):
                merged["word", s] += n
        for line, n in lines.items():
            merged["line", shape(line)] += n
        words.clear()
        lines.clear()
        return _batch({"what": [a for a, _ in merged], "key": [b for _, b in merged], "n": list(merged.values())})

    for b in batches:
        out: dict[str, list] = {k: [] for k in ("text_key", *_FIELDS)}
        for key, text in zip(*(b.column(k).to_pylist() for k in ("text_key", "text"))):
            for k, v in (("text_key", key), *ending(text).items()):
                out[k].append(v)
            inner = text.rstrip().split("\n")[:-1]
            words.update(set(text.split()[:-1]))
            lines.update({s for x in inner if (s := x.strip())})
            held += len(text)
            if held > HELD_CHARS:
                yield counts()
                held = 0
        yield _batch({"what": ["doc"] * len(out["text_key"]), **out})
    if words or lines:
        yield counts()


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, size): lengths in chars or bytes that a source has far more often than their neighbours, over distinct texts."""
    sizes = rows.select("source", "text_key", "n_chars", "n_bytes").distinct()
    each = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))).alias("s")
    by = sizes.select("source", each).groupBy("source", "s.unit", "s.size").count()
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    mean = (F.sum("count").over(near) - F.col("count")) / (2 * NEIGHBOURS)
    return by.withColumn("mean", mean).where(F.col("count") - F.col("mean") > PEAK * F.sqrt(F.col("mean") + 1)).select("source", "unit", "size")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums of a sorted task: those at the rows with a key, and with rank -1 the task's total."""
    block, i, f = TaskContext.get().partitionId(), 0, 0
    names = ["block", "key", "rank", "i", "f"]
    for b in batches:
        sums = [pc.add(pc.cumulative_sum(b.column(c)), at) for c, at in (("inner", i), ("final", f))]
        if b.num_rows:
            i, f = (s[-1].as_py() for s in sums)
        there = b.column("key").is_valid()
        rows = pa.RecordBatch.from_arrays([pa.array([block] * b.num_rows, pa.int32()), b.column("key"), b.column("rank"), *sums], names).filter(there)
        if rows.num_rows:
            yield rows
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([None], pa.string()), pa.array([-1], pa.int32()), pa.array([i], pa.int64()), pa.array([f], pa.int64())], names)


def below(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, inner, final, below) of each node: the counts of its own entry, and of all entries that go on after it.

    ``known`` has distinct keys with the counts ``inner`` and ``final``,
    ``nodes`` has ``key``. Sorted as bytes, the entries below a node follow it
    directly and end before its key with a byte that no text has. So a running
    sum over entries and nodes gives all three as differences.
    """
    at, zero = F.col("key").cast("binary"), F.lit(0).cast("bigint")
    entries = known.select(at.alias("at"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("key"), "inner", "final")
    edge = lambda where, rank: nodes.distinct().select(where.alias("at"), F.lit(rank).alias("rank"), "key", zero.alias("inner"), zero.alias("final"))
    every = entries.unionByName(edge(at, 0)).unionByName(edge(at, 2)).unionByName(edge(F.concat(at, F.lit(bytearray(b"\xff"))), 3))
    ranged = every.repartitionByRange(runtime.shuffle_width(known.sparkSession), "at", "rank").sortWithinPartitions("at", "rank")
    # The sum runs through each sorted task; only nodes and a total per task leave it, and the keys not even enter.
    summed = runtime.materialise(ranged.select("key", "rank", "inner", "final").mapInArrow(_running, "block int, key string, rank int, i bigint, f bigint"), "sums")
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    totals = summed.where("rank = -1").select("block", F.coalesce(F.sum("i").over(ahead), zero).alias("base_i"), F.coalesce(F.sum("f").over(ahead), zero).alias("base_f"))
    summed = summed.where("key is not null").join(F.broadcast(totals), "block").select("key", "rank", (F.col("i") + F.col("base_i")).alias("i"), (F.col("f") + F.col("base_f")).alias("f"))
    pick = lambda c, rank: F.max(F.when(F.col("rank") == rank, F.col(c)))
    return summed.groupBy("key").agg(
        (pick("i", 2) - pick("i", 0)).alias("inner"), (pick("f", 2) - pick("f", 0)).alias("final"), (pick("i", 3) - pick("i", 2) + pick("f", 3) - pick("f", 2)).alias("below")
    )


#: Keys of words and of lines lie in one sorted table.
_WORD, _LINE = "w\x1f", "l\x1f"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, source, truncated, evidence, at_limit) of each row of ``docs`` (doc_id, text, source).

    ``evidence`` is the first that holds: marker (a note of the cut or half a
    character), open-block (an unclosed code fence or JSON), word (the final
    word is an unknown proper prefix of known ones), limit (the end is open, and
    the text has one of its source's limits for length, in characters or
    bytes), ellipsis (after a line that isn't known to end so), line (no end of
    a sentence, and the line isn't known as a complete one); else null. A text
    that lies there several times counts once in all of this, so no copy
    vouches for another. Words and lines count whole, whatever their length. A
    null text isn't truncated and has no row; an empty one has a row and isn't.
    Repeated rows repeat theirs; a null source has no limits. Other columns
    aren't read.
    """
    runtime.require_columns(docs, "doc_id", "text", "source")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("source").cast("string")).where("text is not null")
    text_key = F.unhex(F.md5("text")).alias("text_key")
    size = lambda f, name: f("text").cast("bigint").alias(name)
    rows = runtime.materialise(docs.select("doc_id", "source", size(F.char_length, "n_chars"), size(F.octet_length, "n_bytes"), text_key), "rows")
    scanned = runtime.materialise(docs.select("text").distinct().select(text_key, "text").mapInArrow(_scan, _SCHEMA), "ends")
    ends = scanned.where("what = 'doc'").drop("what", "key", "n")
    key = lambda mark, c: F.when(F.col(c) != "", F.concat(F.lit(mark), c))
    words = scanned.where("what = 'word'").groupBy(key(_WORD, "key").alias("key")).agg(F.sum("n").alias("inner")).where(F.col("inner") >= MIN_TEXTS)
    entry = lambda df, inner, final: df.select("key", inner.cast("bigint").alias("inner"), final.cast("bigint").alias("final"))
    inner = entry(scanned.where("what = 'line'").select(key(_LINE, "key").alias("key"), "n"), F.col("n"), F.lit(0))
    finals = entry(ends.select(key(_LINE, "line").alias("key")).where("key is not null"), F.lit(0), F.lit(1))
    lines = inner.unionByName(finals).groupBy("key").agg(F.sum("inner").alias("inner"), F.sum("final").alias("final"))
    known = entry(words, F.col("inner"), F.lit(0)).unionByName(lines)

    # What is looked up, by the role it has at the text's end. A closed end needs but its last word with the dot.
    open_end = ~F.col("closed") & ~F.col("marked")
    role = lambda name, mark, c, when: F.struct(F.lit(name).alias("role"), F.when(when, key(mark, c)).alias("key"))
    looked_up = F.array(
        role("word", _WORD, "word", ~F.col("marked")), role("dotted", _WORD, "dotted", F.col("closed")), role("line", _LINE, "line", open_end), role("bare", _LINE, "bare_line", open_end & F.col("ellipsis"))
    )
    asked = runtime.materialise(ends.where(open_end | F.col("dotted").isNotNull()).select("text_key", F.explode(looked_up).alias("x")).select("text_key", "x.*").where("key is not null"), "asked")
    facts = runtime.materialise(below(known, asked.select("key")), "facts")
    got = lambda r, c: F.max(F.when(F.col("role") == r, c))
    found = asked.join(facts, "key").groupBy("text_key").agg(
        got("word", F.col("inner") > 0).alias("word_known"), got("word", F.col("below") > 0).alias("word_inside"), got("dotted", F.col("below") > 0).alias("dotted_inside"),
        got("line", F.col("inner")).alias("inner"), got("line", F.col("final")).alias("final"), got("line", F.col("below")).alias("below"), got("bare", F.col("below")).alias("bare_below"),
    )
    judged = ends.join(found, "text_key", "left").na.fill(False, ["word_known", "word_inside", "dotted_inside"]).na.fill(0, ["inner", "final", "below", "bare_below"])

    # The trie counts a line's own ellipsis form as an extension of its bare form.
    extended = F.when(F.col("ellipsis"), F.col("bare_below") - F.col("final") - F.col("inner")).otherwise(F.col("below"))
    # A line is complete where more texts end it there than go on.
    complete = ((F.col("inner") >= MIN_TEXTS) & (F.col("inner") >= extended)) | ((F.col("final") >= MIN_CLOSERS) & (F.col("final") > extended))
    partial = ~F.col("word_known") & F.col("word_inside")
    open_form = (
        F.when(F.col("line") == "", F.when(F.col("marked"), "marker"))
        .when(F.col("marked"), "marker")
        .when(F.col("open_block"), "open-block")
        .when(F.col("closed"), F.when(F.col("dotted_inside") & ~F.col("word_known"), "word"))
        .when(partial, "word")
        .when(complete, F.lit(None))
        .when(F.col("ellipsis"), "ellipsis")
        .when((F.col("n_words") >= 3) | ~F.col("word_known") | (F.col("below") > 0), "line")
    )
    judged = judged.select("text_key", open_form.alias("form"), (open_end & (F.col("line") != "")).alias("is_open"))
    peaks = limits(rows).withColumn("y", F.lit(True))
    at = lambda unit, c: peaks.where(F.col("unit") == unit).select("source", F.col("size").alias(c), F.col("y").alias(f"at_{unit}"))
    full = rows.join(judged, "text_key").join(at("chars", "n_chars"), ["source", "n_chars"], "left").join(at("bytes", "n_bytes"), ["source", "n_bytes"], "left")
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    evidence = F.when(F.col("form").isin("marker", "open-block", "word"), F.col("form")).when(at_limit & F.col("is_open"), "limit").otherwise(F.col("form"))
    return full.select("doc_id", "source", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"), at_limit.alias("at_limit"))


def by_source(judged: DataFrame) -> DataFrame:
    """How often each source truncates; ``judged`` is the result of ``detect``."""
    n = F.count_if("truncated")
    return judged.groupBy("source").agg(F.count("*").alias("n_documents"), n.alias("n_truncated"), (n / F.count("*")).alias("truncated_share"))
