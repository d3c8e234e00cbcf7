import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import episodes as e
from sessionloom.operators import eventlog as l
from sessionloom.operators import insights as n
from sessionloom.operators import rollups as u
from sessionloom.sources import archive as a
from sessionloom.sources import manifests as m
from sessionloom.sources import transcripts as x


def test_upsert_keeps_the_life_of_a_row(spark):
    schema = "id string, project_id string, kind string, category string, title string, body string, confidence double, updated_at double, raw_payload string, entities array<string>, pinned boolean, dedup_key string"
    old = spark.createDataFrame([("1", "p", "working", None, "t", "b", 0.5, 1.0, None, ["E"], True, "k"), ("2", "p", "working", "c", "t2", "b", 0.5, 1.0, None, [], None, None)], schema)
    new = spark.createDataFrame([("1", "q", "episodic", "c", "T", None, 0.9, 2.0, "{}", [], False, "z"), ("3", "q", "semantic", "c", "n", "b", 1.0, 2.0, None, None, None, None)], schema)
    got = {r.id: r for r in e.upsert(old, new).collect()}
    r = got["1"]
    assert (r.kind, r.title, r.body, r.confidence, r.entities) == ("episodic", "T", None, 0.9, []) and (r.project_id, r.pinned, r.dedup_key) == ("p", True, "k")
    assert got["2"].title == "t2" and got["3"].project_id == "q" and len(got) == 3
    assert e.upsert(old.where("false"), new).count() == 2 and e.upsert(old, new.where("false")).count() == 2


def test_feedback_is_a_fold_in_order(spark):
    random.seed(3)
    kinds = ["helpful", "not_helpful", "not_helpful", "stale", "wrong"]
    given = [(f"e{random.randrange(4)}", float(random.randrange(20)), i, random.choice(kinds)) for i in range(120)]
    rows = spark.createDataFrame([(f"e{i}", i, None, None, True) for i in range(5)], "id string, access_count bigint, last_accessed_at double, expires_at double, pinned boolean")
    got = {r.id: r for r in e.fold_feedback(rows, spark.createDataFrame(given, "id string, ts double, seq int, verdict string")).collect()}
    for i in range(5):
        n, ended = i, None
        for _, ts, _, v in sorted((g for g in given if g[0] == f"e{i}"), key=lambda g: g[1:3]):
            n = n + 1 if v == "helpful" else max(n - 1, 0) if v == "not_helpful" else n
            ended = ts if v in ("stale", "wrong") else ended
        assert (got[f"e{i}"].access_count, got[f"e{i}"].expires_at, got[f"e{i}"].pinned) == (n, ended, ended is None)


def test_similar_titles_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(9)]
    rows = [(str(i), f"p{i % 3}", random.choice(["working", "semantic"]), random.choice(["s1", "s2", None]), " ".join(random.choices(words, k=random.randrange(1, 6)))) for i in range(60)] + [("n", "p0", "working", None, None)]
    df = spark.createDataFrame(rows, "id string, project_id string, kind string, source_ref string, title string")
    sets = {r[0]: set(r[4].split()) for r in rows if r[4]}
    near = lambda r, o: r[4] and o[4] and r[1] == o[1] and len(sets[r[0]] & sets[o[0]]) >= 0.5 * max(len(sets[r[0]]), len(sets[o[0]]))
    assert {r.id: r.n_similar for r in e.similar_titles(df).collect()} == {r[0]: sum(bool(near(r, o)) for o in rows) for r in rows if r[4]}
    assert {r.id: r.n_sessions for r in e.session_mentions(df).collect()} == {r[0]: len({o[3] for o in rows if near(r, o) and o[2] != "semantic" and o[3]}) for r in rows if r[4]}


def test_decay(spark):
    df = spark.createDataFrame([(100 * 86400.0,), (70 * 86400.0,), (-9e9,), (None,), (2e9,)], "t double")
    assert [round(r.s, 6) for r in df.select(e.decayed(F.col("t"), 100 * 86400.0).alias("s")).collect()] == [1.0, 0.9, 0.1, 1.0, 1.0]


def test_blend_both_ways(spark):
    ins = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.2)], "id string, strength double")
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "id string, score double")
    got = lambda **k: {r.id: r.blend for r in e.blended(ins, scores, **k).collect()}
    assert got() == {"a": 0.3, "b": 0.85} and got(inverted=True) == {"a": 1.0, "b": 0.15}


def test_event_problems(spark):
    whole = json.dumps(dict.fromkeys(l.REQUIRED["transcript"], 1))
    rows = [("p", "transcript", whole), ("p", "transcript", "{}"), ("", "transcript", whole), ("p", "browser", whole), ("p", "nope", whole), ("p", None, None), ("p", "git.commit", "broken")]
    got = l.validated(spark.createDataFrame(rows, "project_id string, source_type string, payload string")).select("problem").collect()
    assert [r.problem for r in got] == [None, "missing new_bytes,new_lines,session_id,transcript_path", "no project", "reserved source", "unknown source", "unknown source", "missing author,files_changed_count,message_short,sha"]


def test_gates(spark):
    marks = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 5000, 2.0, 2), ("b", None, 1.0, 3), ("c", 9000, 1.0, 4)], "session string, bytes bigint, captured_at double, event_id bigint")
    sizes = spark.createDataFrame([("a", 5100), ("b", 3000), ("c", 1), ("d", 1)], "session string, bytes bigint")
    assert {r.session: r.decision for r in l.growth(marks, sizes).collect()} == {"a": "same", "b": "grown", "c": "shrunk", "d": "new"}
    log = [("a", float(i), i, l.FAILED) for i in range(3)] + [("b", float(i), i, l.FAILED) for i in range(3)] + [("b", 2.5, 9, l.DONE), ("c", 0.0, 1, l.DONE), ("c", 1.0, 2, l.FAILED)]
    df = spark.createDataFrame(log, "session string, captured_at double, event_id bigint, source_type string")
    assert {r.session: (r.n_failures, r.waits) for r in l.backoff(df, 100.0).collect()} == {"a": (3, True), "c": (1, False)}
    assert not l.backoff(df, 100_000.0).where("session = 'a'").first().waits


def test_git_log(spark):
    lines = ["stray", "a" * 40 + "||me||m@x.example||2026||fix || it", "", "src/a.py", "b.md", "b" * 40 + "||me||m@x.example||2026||none"]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(lines)], "repo string, line_no int, line string")
    got = l.commits_of(df).orderBy("n").collect()
    assert [(r.sha[0], r.message, r.files_changed) for r in got] == [("a", "fix || it", ["src/a.py", "b.md"]), ("b", "none", [])]


def test_working_set_first_wins(spark):
    s = "project_id string, path string, pos int"
    a_, b_, c_ = (spark.createDataFrame(r, s) for r in ([("p", "x", 0)], [("p", "y", 0), ("p", "x", 1)], [("p", f"z{i}", i) for i in range(30)]))
    got = u.working_set(a_, b_, c_).orderBy("place").collect()
    assert len(got) == 20 and [(r.path, r.priority) for r in got[:3]] == [("x", 0), ("y", 1), ("z0", 2)]


def test_cleanup_order(spark):
    long = "x" * 200
    rows = [("a/1", "a", "t", long, "h", "high"), ("b/1", "b", "t", long, "h", "high"), ("a/2", "a", u.GENERIC_TITLES[0], "# t\nshort\n## Context\n" + long, "g", "high"), ("a/3", "a", u.GENERIC_TITLES[0], long, "i", "LOW"), ("a/4", "a", u.GENERIC_TITLES[0], long, "j", "high")]
    df = spark.createDataFrame(rows, "path string, category string, title string, body string, body_hash string, confidence string")
    assert {r.path: r.reason for r in u.to_remove(df).collect()} == {"b/1": "duplicate", "a/2": "generic", "a/3": "low-confidence"}


def test_archive_heads(spark):
    text = "---\ntype: decision\ndate: 2026-01-02\n# note\nworkspace: Ab.code-workspace\nk: a: b\nk: c\n---\n\n# Title \n\nBody  text"
    df = spark.createDataFrame([("d/x.md", "d", text), ("d/y.md", "d", "no head"), ("d/z.md", "d", "")], "path string, category string, text string")
    got = {r.path: r for r in a.scan(df).collect()}
    assert got["d/x.md"].head == {"type": "decision", "date": "2026-01-02", "workspace": "Ab.code-workspace", "k": "c"} and got["d/x.md"].title == "Title"
    assert got["d/y.md"].head is None and got["d/z.md"].title == ""
    new = a.scan(df).where("head is not null").select(a.migrated(F.col("head")).alias("o")).first().o
    assert new.split("\n") == ["type: decision", "date: 2026-01-02", "timestamp: 2026-01-02T00:00:00+00:00", "project: Ab", "workspace: Ab.code-workspace", "confidence: medium", "assistant: assistant", "k: c"]


EVENTS = [
    {"type": "session.start", "timestamp": "2026-01-01T00:00:00.000Z", "data": {"model": "m", "producer": "p"}},
    {"type": "user.message", "timestamp": "2026-01-01T00:00:01Z", "data": {"content": "hi"}},
    {"type": "assistant.message", "timestamp": "2026-01-01T00:00:02Z", "data": {"reasoningText": "r" * 3000, "content": "c" * 4000}},
    {"type": "tool.execution_complete", "timestamp": "t", "data": {"toolName": "ls", "arguments": {"a": "x" * 300}}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "u"}, {"type": "image"}]}},
    {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "no"}]}},
    {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "s"}, "t"]}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": "{}"}},
    {"type": "turn.prompt", "input": [{"type": "text", "text": "k"}], "time": 1767225600000},
    {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "think", "think": "z"}}},
    {"type": "context.append_loop_event", "event": {"type": "tool.call", "name": "g", "args": {}}},
    {"type": "user", "content": "syn", "synthetic_reason": "x"},
    {"type": "assistant", "content": [{"type": "text", "text": "both"}], "tool_calls": [{"name": "n", "arguments": {}}]},
    {"role": "user", "raw_content": "raw", "content": "wrapped"},
    {"role": "tool", "tool_call_id": "1", "content": ""},
    {"role": "user", "content": "plain is ignored"},
    {"type": "message", "message": repr({"role": "assistant", "content": [{"type": "thinking", "thinking": "th"}, {"type": "toolCall", "name": "t", "intent": " go "}, {"type": "text", "text": "tx"}]})},
    {"type": "message", "message": json.dumps({"role": "toolResult", "content": [{"type": "text", "text": "no"}]})},
]


def test_six_vendors(spark):
    lines = [json.dumps(v) for v in EVENTS] + ["not json", "", "123", "[]", None]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "session string, line_no int, line string")
    parts = x.events(df, ["session", "line_no"])
    got = {(r.line_no, r.part_no): r for r in parts.collect()}
    kinds = {}
    for (i, _), r in sorted(got.items()):
        kinds.setdefault(i, []).append((r.vendor, r.kind))
    assert kinds == {
        0: [("copilot", "session")], 1: [("copilot", "user")], 2: [("copilot", "reasoning"), ("copilot", "assistant")], 3: [("copilot", "tool_calls")],
        4: [("codex", "user")], 6: [("codex", "reasoning")], 7: [("codex", "tool_calls")], 8: [("kimi", "user")], 9: [("kimi", "reasoning")], 10: [("kimi", "tool_calls")],
        12: [("grok", "assistant"), ("grok", "tool_calls")], 13: [("reasonix", "user")], 14: [("reasonix", "tool_calls")], 16: [("omp", "reasoning"), ("omp", "tool_calls"), ("omp", "assistant")],
    }
    assert len(got[2, 0].content) == 2000 and len(got[2, 1].content) == 3000 and got[3, 0].content.endswith("…")
    assert got[0, 0].shown == "[2026-01-01T00:00:00] [SESSION START] | model: m | producer: p" and got[8, 0].shown == "[2026-01-01T00:00:00] [USER]\nk"
    assert got[13, 0].content == "raw" and got[14, 0].content == "(empty)" and got[16, 1].shown == "[] [TOOL → t] go" and got[3, 0].shown.startswith("[t] [TOOL ✓ ls]")
    n = x.counts(parts, df, "session").first()
    assert (n.user, n.assistant, n.reasoning, n.tool_calls, n.total_events) == (4, 3, 2, 4, len(EVENTS))


def test_windows_and_chunks(spark):
    text = "[1] [USER]\n" + "a" * 50 + "\n[2] [ASSISTANT]\nanswer"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r.o for r in df.select(x.newest_window(F.col("t"), 40).alias("o")).collect()]
    assert got[0] == f"[~{text.index('[2]')} chars of older transcript omitted]\n[2] [ASSISTANT]\nanswer" and got[1:] == [None, ""]
    cut = [r.o for r in df.select(x.chunks(F.col("t"), 30).alias("o")).collect()]
    assert "".join(cut[0]) == text and cut[1:] == [None, [""]] and max(map(len, cut[0])) == 51
    with pytest.raises(ValueError):
        x.newest_window(F.col("t"), 0)


def test_manifests(spark):
    known = {k.id: k for k in m.builtin("/h", {"SESSIONLOOM_CODEX_HOME": "/c", "REASONIX_HOME": "/r"}, omp="/o")}
    assert (known["codex"].base, known["reasonix"].base, known["omp"].base, known["grok"].base) == ("/c", "/r", "/o", "/h/.grok")
    assert m.from_dict({"id": "a", "base": "/b", "globs": "*.jsonl"}).globs == ("*.jsonl",)
    for bad in (None, {}, {"id": "a", "base": "/b"}, {"id": "a", "base": "/b", "globs": ["x"], "session_id": "no"}, {"id": "a", "base": "/b", "globs": [1]}):
        assert m.from_dict(bad) is None
    rows = [
        ("/k/sessions/wd_proj_0123456789ab/session_9/agents/main/wire.jsonl", "kimi_session_dir", "kimi_wd", None, None),
        ("/g/sessions/%2Fw%2Fa%2Bb+c/s1/chat_history.jsonl", "parent_dir", "grok_encoded", None, None),
        ("/r/projects/-home-me-Proj/sessions/x.jsonl", "file_stem", "reasonix_project", None, None),
        ("/o/-w-thing/y.jsonl", "file_stem", "session_cwd", "/w/real", None), ("/o/-w-thing/y.jsonl", "file_stem", "session_cwd", None, None),
        ("/c/rollout-1.jsonl", "file_stem", "codex_cwd", None, None), ("/v/h12345678901/GitHub.copilot-chat/transcripts/z.jsonl", "file_stem", "vscode", None, "/w/fold"),
        ("/v/h12345678901/GitHub.copilot-chat/transcripts/z.jsonl", "file_stem", "vscode", None, None),
    ]
    df = spark.createDataFrame(rows, "path string, s string, w string, cwd string, folder string")
    got = df.select(m.session_id(F.col("path"), F.col("s")).alias("s"), m.workspace_label(F.col("path"), F.col("w"), F.col("cwd"), F.col("folder")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("session_9", "proj"), ("s1", "a+b+c"), ("x", "Proj"), ("y", "real"), ("y", "thing"), ("rollout-1", "unknown"), ("z", "fold"), ("z", "h1234567")]


def test_subagents(spark):
    meta = lambda p: json.dumps({"type": "session_meta", "payload": p})
    rows = [("a", 0, meta({"cwd": "/w"})), ("b", 1, meta({"forked_from_id": "a"})), ("c", 0, meta({"source": {"subagent": 1}})), ("d", 25, meta({"agent_nickname": "n"})), ("e", 0, "broken")]
    df = spark.createDataFrame(rows, "session string, line_in_file int, line string")
    flagged = m.subagent_sessions(df, "session")
    assert {r.session for r in flagged.collect()} == {"b", "c"}
    sessions = spark.createDataFrame([("a", "/x/a.jsonl"), ("b", "/x/b.jsonl"), ("f", "/x/f.events.jsonl")], "session string, path string")
    assert [r.session for r in m.main_sessions(sessions, flagged, "session").collect()] == ["a"]


GOOD = {"category": "decision", "title": "Keep it", "context": "c", "implication": "i", "layer": "project", "confidence": 0.7, "evidence": "we keep  the OLD title here", "entities": ["Ab", "AB", "x", 3]}


def test_insights_are_borne_out_by_the_text(spark):
    text = "[1] [USER]\nWe keep the old title here.\n" + "line\n" * 20 + "[2] [USER]\nlast words of it"
    bad = [GOOD | c for c in ({"title": ""}, {"category": "x"}, {"layer": None}, {"confidence": 1.5}, {"confidence": "no"}, {"evidence": "we keep the new title here"}, {"evidence": "too short"})]
    many = [GOOD | {"title": f"t{i}"} for i in range(12)]
    answers = {"last words": [*bad, "nothing", None, GOOD, GOOD | {"title": "KEEP  it"}], "We keep": many}

    def extractor(chunk):
        if "line\nline" in chunk and "We keep" not in chunk:
            raise RuntimeError("down")
        return next((v for k, v in answers.items() if k in chunk), [])

    df = spark.createDataFrame([("s", "p", text), ("e", "p", ""), ("n", None, None)], "session_id string, project_id string, text string")
    got = n.extract(df, extractor, chunk=40).orderBy("chunk_no", "place").collect()
    assert [r.title for r in got] == ["Keep it", *(f"t{i}" for i in range(7))] and {r.session_id for r in got} == {"s"}
    assert got[0].entities == ["Ab"] and got[0].chunk_no < got[1].chunk_no
    rows = n.as_episodes(n.extract(df, extractor, chunk=40), 5.0)
    assert rows.select("id").distinct().count() == 8 and rows.where("title = 'Keep it'").first().body == "**Context:** c\n\n**Implication:** i"
    assert n.extract(df.where("false")).count() == 0


def test_extractor_without_a_model_and_notes(spark):
    assert [(i["category"], i["evidence"]) for i in n.by_cues("Ok. Decision: the merge step keeps the older title. Warning: x")] == [("decision", "the merge step keeps the older title.")]
    r = n.note(spark, "p", "About GapEngine", "It works", 3.0).first()
    assert (r.confidence, r.source_type, r.entities, r.body, r.created_at, r.source_ref) == (1.0, "manual", ["GapEngine"], "It works", 3.0, None)
    assert n.note(spark, "p", "t", "b", 3.0, entities=["Own"]).first().entities == ["Own"]


def test_the_archive_comes_back_as_it_was_written(spark, tmp_path):
    cols = "id string, project_id string, kind string, source_type string, category string, title string, body string, confidence double, created_at double"
    rows = spark.createDataFrame([(f"{i:08x}", "p", "working", "manual", c, t, b, 0.9, 1.7e9 + i) for i, (c, t, b) in enumerate([("decision", "Use tabs", "a\nb"), ("decision", "Use tabs", None), (None, "", "x"), ("bugfix", "Città è?", "---\nno: head\n---\n"), ("anti-pattern", "a" * 80, "y"), ("decision", "zwei/drei", "z")])], cols)
    out = a.render(rows)
    for _ in range(2):
        a.write(out, str(tmp_path / "archive"))
    got = {(r.category, r.path.rsplit("/", 1)[1]): r.text for r in a.read(spark, str(tmp_path / "archive")).collect()}
    assert got == {(r.subdir, r.file_name): r.text for r in out.collect()} and len(got) == 6
    assert sum(1 for f in (tmp_path / "archive").rglob("*") if f.is_file() and not f.name.endswith(".crc")) == 6
    titles = {r.category: r.title for r in a.scan(a.read(spark, str(tmp_path / "archive"))).collect()}
    assert titles["fix"] == "Città è?" and titles["neutral"] == ""


def test_only_what_was_appended_is_read(spark, tmp_path):
    one, two = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    one.write_bytes("{\"n\": 1}\n\n{\"s\": \"è\"}\n{\"half".encode())
    two.write_bytes(b"x" * 3_000_000 + b"\nlast\n")
    files = spark.createDataFrame([(str(one), 0), (str(two), None), (str(tmp_path / "gone"), 5)], "path string, offset bigint")
    delta = x.read_delta(files, block=1000)
    got = sorted((Path(r.path).name, r.at, len(r.line)) for r in delta.collect())
    assert got == [("a.jsonl", 0, 8), ("a.jsonl", 10, 10), ("b.jsonl", 0, 3_000_000), ("b.jsonl", 3_000_001, 4)]
    ahead = {Path(r.path).name: r.offset for r in x.next_offsets(files, delta).collect()}
    assert ahead == {"a.jsonl": 22, "b.jsonl": 3_000_006, "gone": 5}
    one.write_bytes(one.read_bytes() + b" done\"}\n")
    later = spark.createDataFrame([(str(one), 22), (str(two), 9_000_000)], "path string, offset bigint")
    assert sorted((r.at, r.line[:9]) for r in x.read_delta(later).collect()) == [(0, "x" * 9), (22, "{\"half do"), (3_000_001, "last")]


def test_commits_since_the_last_known(spark):
    commits = spark.createDataFrame([("r", n, f"{n}abc", 1000.0 - n) for n in range(1, 6)] + [("s", n, f"{n}def", 5000.0 - 3000 * n) for n in range(1, 3)], "repo string, n int, sha string, committed_at double")
    got = lambda known: sorted((r.repo, r.n) for r in l.since_last_known(commits, spark.createDataFrame(known, "repo string, sha string"), 3600.0).collect())
    assert got([("r", "3a"), ("s", "2def")]) == [("r", 1), ("r", 2), ("s", 1)]
    assert got([("r", "unknown")]) == [("r", n) for n in range(1, 6)] + [("s", 1)]


LOG = "event_id bigint, project_id string, source_type string, source_ref string, captured_at double, payload string"


def test_events_are_appended_and_found(spark):
    log = spark.createDataFrame([(7, "p", "transcript", "s", 1.0, "{}"), (8, "p", "git.commit", None, 2.0, "{}")], LOG)
    good = json.dumps({k: 1 for k in l.REQUIRED["transcript"]})
    after, refused = l.append(log, spark.createDataFrame([(None, "p", "transcript", "t", 9.0, good), (None, "p", "transcript", "u", 3.0, good), (None, "", "transcript", "v", 3.0, good)], LOG))
    assert sorted((r.event_id, r.source_ref) for r in after.collect()) == [(7, "s"), (8, None), (9, "u"), (10, "t")]
    assert [r.problem for r in refused.collect()] == ["no project"]
    empty = spark.createDataFrame([], LOG)
    assert l.append(empty, empty)[0].count() == 0
    asked = spark.createDataFrame([("p", "git.commit", None), ("p", "transcript", None), ("p", "transcript", "s")], "project_id string, source_type string, source_ref string")
    assert {(r.source_type, r.source_ref): r.is_known for r in l.has_event(log, asked).collect()} == {("git.commit", None): True, ("transcript", None): False, ("transcript", "s"): True}


def test_an_empty_session_gets_one_marker(spark):
    log = spark.createDataFrame([(1, "p", l.DONE, "old", 1.0, "{}")], LOG)
    counts = spark.createDataFrame([("p", "old", 0, 5), ("p", "new", 0, 9), ("p", "full", 3, 9)], "project_id string, session string, total_events int, bytes bigint")
    got = l.empty_markers(counts, log, 4.0).collect()
    assert [(r.source_ref, json.loads(r.payload)) for r in got] == [("new", {"episodes_written": 0, "empty": True, "transcript_bytes": 9})]


def test_kinds_pins_and_forgetting(spark):
    rows = spark.createDataFrame([("a", "working", True, None, 1.0), ("b", "working", None, None, 1.0), ("c", "working", False, 3.0, 1.0)], "id string, kind string, pinned boolean, expires_at double, updated_at double")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), (None,)], "id string")
    left, outcome = e.forget(rows, ids, 9.0)
    assert {r.id: r.outcome for r in outcome.collect()} == {"a": "pinned", "b": "forgotten", "z": "unknown"}
    assert {r.id: r.expires_at for r in left.collect()} == {"a": None, "b": 9.0, "c": 3.0}
    assert {r.id: r.kind for r in e.set_kind(rows, ids, "semantic", 5.0).collect()} == {"a": "semantic", "b": "semantic", "c": "working"}
    assert {r.id: r.pinned for r in e.pin(rows, ids, False).collect()} == {"a": False, "b": False, "c": False}
    with pytest.raises(ValueError):
        e.set_kind(rows, ids, "other", 5.0)


def test_files_by_age_and_place(spark):
    files = spark.createDataFrame([("p", f, m) for f, m in [("src/a.py", 99.0), ("src/node_modules/b.py", 99.0), ("docs/c.md", 99.0), ("src/d.exe", 99.0), ("src/e.vue", 10.0), ("a.py", 99.0), ("tests/x/y.env", 80.0)]], "project_id string, path string, mtime double")
    assert {r.path for r in u.recent_files(files, 100.0, 50.0).collect()} == {"src/a.py", "tests/x/y.env"}
    links = spark.createDataFrame([("/l/1", "/r/1", 5.0), ("/r/1", "/r/1", 5.0), ("/r/2", "/r/2", 9.0), ("/r/3", "/r/3", 1.0)], "path string, real_path string, mtime double")
    assert {(r.real_path, r.path, r.mtime) for r in u.newest_files(links, 10.0, 8.0).collect()} == {("/r/1", "/r/1", 5.0), ("/r/2", "/r/2", 9.0)}
    sized = spark.createDataFrame([("new", 5000, 1_000_000.0), ("small", 10, 999_000.0), ("ok", 5000, 999_000.0), ("old", 5000, 1.0)], "id string, n_bytes bigint, mtime double")
    assert {r.id for r in u.candidates(sized, 1_000_100.0).collect()} == {"ok"}
    text = spark.createDataFrame([("\n".join(map(str, range(30))) + "\n",), ("one",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(u.last_lines(F.col("t"), 3)).collect()] == ["27\n28\n29", "one", "", None]


def test_sessions_by_prefix(spark):
    ids = spark.createDataFrame([("abc",), ("abcd",), ("abd",), ("x1",), (None,)], "session_id string")
    asked = spark.createDataFrame([("abc",), ("abcd",), ("ab",), ("x",), ("nope",), ("longer than any",), ("",), (None,)], "asked string")
    got = {r.asked: (r.session_id, r.outcome, r.candidates) for r in m.resolve(asked, ids).collect()}
    assert got == {"abc": ("abc", "found", None), "abcd": ("abcd", "found", None), "ab": (None, "ambiguous", ["abc", "abcd", "abd"]), "x": ("x1", "found", None), "nope": (None, "not found", None), "longer than any": (None, "not found", None)}


def test_helpers_of_other_sessions(spark):
    said = [{"parent_session_id": "p"}, {"session_summary": "Goal Plan Writer run"}, {"session_summary": "the Verifier"}, {"session_summary": "plain"}, {}]
    rows = spark.createDataFrame([(str(i), json.dumps(v)) for i, v in enumerate(said)] + [("bad", "{"), ("none", None)], "s string, summary string")
    assert {r.s for r in m.grok_subagents(rows, "s").collect()} == {"0", "1", "2"}


def test_a_manifest_lists_its_files(spark, tmp_path):
    for f in ("sessions/a/one.jsonl", "sessions/two.jsonl", "sessions/b/c/three.jsonl", "archived_sessions/four.jsonl", "sessions/skip.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("{}")
    codex = next(x for x in m.builtin("/home/x", codex=str(tmp_path)) if x.id == "codex")
    got = m.files_of(spark, codex).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["four.jsonl", "one.jsonl", "three.jsonl", "two.jsonl"] and {r.n_bytes for r in got} == {2}
