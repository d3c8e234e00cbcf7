"""JSONL transcripts of six vendors to one event model."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import runtime

# Longest texts kept of an event.
REASONING_CHARS, CONTENT_CHARS, ARGS_CHARS = 2000, 3000, 200
KINDS = ("user", "assistant", "reasoning", "tool_calls")
_TEXTS = ("text", "input_text", "output_text")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line_no, line) of text files; ``line_no`` rises within a file."""
    runtime.ship(spark)
    return spark.read.text(paths).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_delta(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(path, at, line) of what was appended to each file of ``files`` (path, offset) since that byte.

    ``at`` is the byte where the line begins. A last line without a line break
    is still being written and waits for the next time. ``next_offsets`` gives
    the offsets to go on from. A file shorter than its offset was replaced and
    is read from its start; one that is gone has no lines. Files are read in blocks by
    the tasks, so none has to fit into memory. Blank lines are left out.
    """
    runtime.require_columns(files, "path", "offset")
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string())])

    def lines_of(path: str, offset: int) -> Iterator[tuple[str, int, str]]:
        disk, plain = fs.FileSystem.from_uri(path if ":/" in path else Path(path).absolute().as_uri())
        info = disk.get_file_info(plain)
        if info.type != fs.FileType.File:
            return
        with disk.open_input_file(plain) as f:
            at = offset if 0 <= offset <= info.size else 0
            f.seek(at)
            rest = b""
            while page := f.read(block):
                *whole, rest = (rest + page).split(b"\n")
                for raw in whole:
                    if raw.strip():
                        yield path, at, raw.decode("utf-8", "replace")
                    at += len(raw) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset in zip(b.column("path").to_pylist(), b.column("offset").to_pylist()):
                found = lines_of(path, offset or 0) if path else iter(())
                while page := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page), schema)], schema=schema)

    return files.select("path", F.col("offset").cast("bigint").alias("offset")).mapInArrow(run, "path string, at bigint, line string")


def next_offsets(files: DataFrame, delta: DataFrame) -> DataFrame:
    """(path, offset) to read from the next time."""
    ends = delta.groupBy("path").agg(F.max(F.col("at") + F.octet_length("line") + 1).alias("end"))
    return files.join(ends, "path", "left").select("path", F.coalesce("end", "offset").alias("offset"))


def is_event(line: Column) -> Column:
    """Whether a line is a JSON object; other valid JSON is no event."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def _as_dict(v) -> dict:
    if isinstance(v, str):
        for read in (json.loads, ast.literal_eval):
            try:
                v = read(v)
                break
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                continue
    return v if isinstance(v, dict) else {}


def _joined(items, kinds: tuple[str, ...] | None, field: str = "text") -> str:
    """The texts of a content that is a string, or a list of strings and typed blocks."""
    if isinstance(items, str):
        return items
    out = []
    for x in items if isinstance(items, list) else []:
        t = x if isinstance(x, str) and kinds is None else x.get(field) if isinstance(x, dict) and (kinds is None or x.get("type") in kinds) else None
        if isinstance(t, str) and t:
            out.append(t)
    return "\n".join(out)


def _args(v) -> str:
    text = json.dumps(v, ensure_ascii=False, default=str)
    return text if len(text) <= ARGS_CHARS else text[:ARGS_CHARS] + "…"


def _copilot(e: dict) -> Iterator[tuple]:
    d, kind = e.get("data"), e["type"]
    if kind == "session.start":
        yield "session", " | ".join(f"{k}: {d[k]}" for k in ("model", "producer") if isinstance(d, dict) and d.get(k)), None
    elif kind == "user.message":
        yield "user", d.get("content", "") if isinstance(d, dict) else str(d), None
    elif isinstance(d, dict) and kind == "assistant.message":
        yield "reasoning", d.get("reasoningText"), None
        yield "assistant", d.get("content"), None
    elif isinstance(d, dict):
        yield "tool_calls", _args(d.get("arguments", {})), d.get("toolName") or d.get("name", "?")


def _codex(e: dict) -> Iterator[tuple]:
    p = e.get("payload")
    if not isinstance(p, dict):
        return
    if e["type"] == "session_meta":
        yield "session", " | ".join(f"{k}: {p[k]}" for k in ("source", "cwd") if p.get(k)), None
    elif p.get("type") == "message" and p.get("role") in ("user", "assistant"):
        yield p["role"], _joined(p.get("content"), _TEXTS), None
    elif p.get("type") == "reasoning":
        yield "reasoning", _joined(p.get("summary"), None), None
    elif p.get("type") in ("function_call", "custom_tool_call"):
        yield "tool_calls", _args(p["arguments"] if p.get("arguments") is not None else p.get("input", {})), p.get("name", "?")


def _kimi(e: dict) -> Iterator[tuple]:
    if e["type"] == "metadata":
        yield "session", "source: kimi-code" + (f" | protocol: {e['protocol_version']}" if e.get("protocol_version") else ""), None
        return
    if e["type"] == "turn.prompt":
        yield "user", _joined(e.get("input"), ("text",)), None
        return
    sub = e.get("event") or {}
    part = sub.get("part") or {}
    if sub.get("type") == "content.part":
        yield ("reasoning", part.get("think"), None) if part.get("type") == "think" else ("assistant", part.get("text") if part.get("type") == "text" else None, None)
    elif sub.get("type") == "tool.call":
        yield "tool_calls", _args(sub.get("args", {})), sub.get("name", "?")


def _grok(e: dict) -> Iterator[tuple]:
    kind, content = e["type"], e.get("content")
    if kind == "system":
        yield "session", "source: grok-build" + (" | model: grok" if isinstance(content, str) and "Grok" in content[:80] else ""), None
    elif kind == "user" and not e.get("synthetic_reason"):
        yield "user", _joined(content, _TEXTS), None
    elif kind == "reasoning":
        yield "reasoning", _joined(e.get("summary"), None), None
    elif kind == "assistant":
        yield "assistant", _joined(content, _TEXTS), None
        for c in e.get("tool_calls") or []:
            if isinstance(c, dict):
                yield "tool_calls", _args(c.get("arguments", {})), c.get("name", "?")


def _reasonix(e: dict) -> Iterator[tuple]:
    solid = lambda t: t if isinstance(t, str) and t.strip() else None
    if e["role"] == "user":
        yield "user", solid(e.get("raw_content") or e.get("content")), None
    elif e["role"] == "assistant":
        yield "reasoning", solid(e.get("reasoning_content")), None
        yield "assistant", solid(e.get("content")), None
    else:
        c = e.get("content")
        text = (c if isinstance(c, str) else json.dumps(c or {}, ensure_ascii=False)).replace("\n", " ").strip()
        yield "tool_calls", (text or "(empty)")[:ARGS_CHARS], e.get("name") or "tool"


def _omp(e: dict) -> Iterator[tuple]:
    if e["type"] == "session":
        yield "session", f"source: omp | cwd: {e.get('cwd', '')}", None
        return
    m = _as_dict(e.get("message"))
    blocks = [b for b in m.get("content") if isinstance(b, dict)] if isinstance(m.get("content"), list) else []
    text = lambda b, k: b[k].strip() if isinstance(b.get(k), str) else ""
    if m.get("role") == "user":
        yield "user", "\n".join(b["text"] for b in blocks if b.get("type") == "text" and isinstance(b.get("text"), str)).strip(), None
    elif m.get("role") == "assistant":
        for b in blocks:
            if b.get("type") == "thinking":
                yield "reasoning", text(b, "thinking"), None
            elif b.get("type") == "text":
                yield "assistant", text(b, "text"), None
            elif b.get("type") == "toolCall":
                args = b.get("arguments")
                yield "tool_calls", text(b, "intent") or (_args(_as_dict(args) if isinstance(args, str) else args) if args is not None else ""), b.get("name", "?")


_READERS = {
    **dict.fromkeys(("session.start", "user.message", "assistant.message", "tool.execution_start", "tool.execution_complete"), ("copilot", _copilot)),
    **dict.fromkeys(("session_meta", "response_item"), ("codex", _codex)),
    **dict.fromkeys(("metadata", "turn.prompt", "context.append_loop_event"), ("kimi", _kimi)),
    **dict.fromkeys(("system", "user", "assistant", "reasoning", "tool_result"), ("grok", _grok)),
    **dict.fromkeys(("session", "message"), ("omp", _omp)),
}


def parts_of(event: dict) -> tuple[str | None, list[tuple[str, str, str | None]]]:
    """The vendor of an event, and what is kept of it: (kind, text, tool) with non-empty texts, cut to their limits."""
    reader = _READERS.get(event.get("type")) if isinstance(event.get("type"), str) else None
    if reader is None and event.get("role") in ("user", "assistant", "tool") and event.keys() & {"raw_content", "reasoning_content", "tool_call_id"}:
        reader = ("reasonix", _reasonix)
    if reader is None:
        return None, []
    limit = {"reasoning": REASONING_CHARS}
    kept = [(k, t[: limit.get(k, CONTENT_CHARS)], tool) for k, t, tool in reader[1](event) if isinstance(t, str) and (t or tool or k == "session")]
    return reader[0], kept


def stamp_of(event: dict) -> str:
    """The event's time to the second, in UTC where it is a number of milliseconds."""
    if event.get("timestamp"):
        return str(event["timestamp"])[:19]
    ms = next((event[k] for k in ("time", "created_at", "createdAt") if event.get(k) is not None), None)
    if isinstance(ms, bool) or not isinstance(ms, (int, float)):
        return ""
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S")


_MARK = {"session": "SESSION START", "user": "USER", "assistant": "ASSISTANT", "reasoning": "ASSISTANT reasoning"}


def shown(stamp: str, kind: str, text: str, tool: str | None, done: bool) -> str:
    if kind == "tool_calls":
        return f"[{stamp}] [TOOL {'✓' if done else '→'} {tool}] {text}".strip()
    return f"[{stamp}] [{_MARK[kind]}]" + (f" | {text}" if kind == "session" and text else "" if kind == "session" else f"\n{text}")


_EVENTS = pa.schema([("vendor", pa.string()), ("part_no", pa.int32()), ("kind", pa.string()), ("tool", pa.string()), ("content", pa.string()), ("shown", pa.string())])


def events(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """The parts of each line's event: ``keys``, vendor, part_no, kind, tool, content, and how it is shown.

    Blank lines, bad JSON and JSON that is no object have none; an event that
    is known but has nothing to keep neither. The payload of some vendors is a
    Python literal in a string, which the JVM can't read; hence Python, by
    Arrow batches.
    """
    runtime.require_columns(lines, line, *keys)
    kept = lines.select(*keys, F.col(line).alias("__line")).where(F.trim("__line") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    e = json.loads(raw)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(e, dict):
                    continue
                vendor, parts = parts_of(e)
                stamp, done = stamp_of(e), str(e.get("type", "")).endswith("complete")
                for n, (kind, text, tool) in enumerate(parts):
                    at.append(i)
                    out.append((vendor, n, kind, tool, text, shown(stamp, kind, text, tool, done)))
            cols = zip(*out) if out else [()] * len(_EVENTS)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at, pa.int32())) for c in b.columns[:-1]), *(pa.array(c, f.type) for c, f in zip(cols, _EVENTS))], [*keys, *_EVENTS.names]
            )

    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(run, f"{schema}, vendor string, part_no int, kind string, tool string, content string, shown string")


def counts(parts: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Events by kind and in all, for each ``key``. An event that speaks and calls tools counts as speech."""
    said = F.when(F.col("kind") == "assistant", -1).otherwise(F.col("part_no"))
    first = parts.where(F.col("kind").isin(*KINDS)).groupBy(key, "line_no").agg(F.min_by("kind", said).alias("kind"))
    by = first.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    total = lines.where(is_event(F.col("line"))).groupBy(key).agg(F.count("*").alias("total_events"))
    return total.join(by, key, "left").na.fill(0)


def line_kind(event_type: Column, role: Column) -> Column:
    """The kind of a row of the transcript table, by role where there is one, else by event type."""
    r, e = F.lower(F.trim(role)), F.lower(event_type)
    return (
        F.when(e.rlike("reason") | (r == "think"), "reasoning")
        .when(e.rlike(r"^(session|title|metadata|system|session_meta)") | (r == "system"), None)
        .when(e.rlike("tool|function") | r.isin("tool", "toolresult"), "tool_calls")
        .when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "model"), "assistant")
        .when(e.isin("user.message", "turn.prompt", "user"), "user").when(e.isin("assistant.message", "assistant"), "assistant")
    )


# Of a long text: the newest part, from the next event on.

EVENT_START = r"(?m)^\[[^\]]+\] \[(?:USER|ASSISTANT)\]"


def newest_window(text: Column, max_chars: int) -> Column:
    """The last ``max_chars`` of a text from its first event on, with a note of what is left out."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    window = F.right(text, F.lit(max_chars))
    at = F.greatest(F.regexp_instr(window, F.lit(EVENT_START)) - 1, F.lit(0))
    omitted = F.char_length(text) - max_chars + at
    note = F.concat(F.lit("[~"), omitted.cast("string"), F.lit(" chars of older transcript omitted]\n"), F.substring(window, at + 1, F.char_length(window)))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(note)


def chunks(text: Column, max_chars: int) -> Column:
    """``array<string>``: whole lines gathered up to ``max_chars``; a longer line is a chunk of its own."""
    def cut(t: str) -> list[str]:
        if len(t) <= max_chars:
            return [t]
        out, now, size = [], [], 0
        for line in t.splitlines(keepends=True):
            if now and size + len(line) > max_chars:
                out.append("".join(now))
                now, size = [], 0
            now.append(line)
            size += len(line)
        return [*out, "".join(now)] if now else out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) if isinstance(t, str) else None for t in texts], dtype=object)

    return run(text)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4))
