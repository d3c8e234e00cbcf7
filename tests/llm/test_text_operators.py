import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import conversations as cv
from sessionloom.llm import mixing, packing, splitting, tokens, truncation


def check_pieces(text, pieces, size, overlap):
    if len(text) > size:
        assert len(pieces) > 1
    assert all(len(p.piece) <= size for p in pieces)
    assert pieces[0].piece + "".join(p.piece[overlap:] for p in pieces[1:]) == text
    for a, b in zip(pieces, pieces[1:]):
        assert a.piece.endswith(b.piece[:overlap]) and b.start == a.stop - overlap and text[b.start : b.stop] == b.piece


def test_split(texts):
    para = "One sentence here. Another, with a clause; and more words to come!\nA line\n\n"
    values = [para * 40, "x" * 5000, ("y" * 900 + " ") * 7, "short", "", None, "é" * 1001, " " * 3000, "a" * 2_000_000]
    got = {r.i: r.split for r in splitting.split(texts(*values), "t", 1000, 100).collect()}
    assert len(got) == len(values) and got[5].pieces is None and [p.piece for p in got[4].pieces] == [""] and len(got[3].pieces) == 1
    for i, v in enumerate(values):
        if v is not None:
            check_pieces(v, got[i].pieces, 1000, 100)
    assert {p.boundary for p in got[0].pieces[1:]} == {"paragraph"} and {p.boundary for p in got[1].pieces[1:]} == {"forced"}
    assert got[1].longest_run == 5000 and got[2].longest_run == 900


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=400), st.integers(4, 60), st.integers(0, 30))
def test_cuts(text, size, overlap):
    overlap = min(overlap, size // 2)
    edges = [0, *(c for c, _ in splitting.cuts(text, size, overlap)), len(text)]
    assert edges == sorted(set(edges)) or not text
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        assert b - a + overlap * bool(k) <= size and (k == 0 or a >= overlap)
    assert splitting.longest_run(text) == max(map(len, re.split(r"\s+", text)))


def test_split_guards(texts, spark):
    with pytest.raises(ValueError):
        splitting.split(texts("a"), "t", 10, 6)
    assert splitting.split(spark.createDataFrame([], "split int, t string"), "t", 10, 2).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 6))
def test_windows(sizes, limit):
    w, done = packing.Windows(50, limit), []
    for i, s in enumerate(sizes):
        gone = w.put(s, (i, s))
        done += [] if gone is None else gone[1] if gone[0] is None else [gone]
        assert len(w.free) <= limit
    done += list(w.items.items())
    assert sorted(i for _, items in done for i, _ in items) == list(range(len(sizes))) and all(sum(s for _, s in items) <= 50 for _, items in done)


def test_pack(spark):
    random.seed(2)
    rows = [(i, random.choice([0, 1, 30, 77, 400, 999, 1000, 1001, 5003])) for i in range(4000)] + [(5, 30), (4000, None), (None, 10)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.pack(sizes, 1000, open_windows=8)
    again = packing.pack(sizes, 1000, open_windows=8)
    assert got.exceptAll(again).count() == 0 and again.exceptAll(got).count() == 0
    out = got.collect()
    used, taken = {}, {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.token_stop - r.token_start
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.token_stop - r.token_start
        assert (r.n_pieces > 1) == (r.doc_id is not None and dict(rows)[r.doc_id] > 1000)
    want = {}
    for d, n in rows:
        if n:
            want[d] = want.get(d, 0) + n
    assert taken == want and max(used.values()) <= 1000
    assert packing.usage(got, 1000).first().used_share > 0.97
    assert packing.pack(sizes.where("false"), 1000).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, 0)


def test_walk_keeps_totals():
    random.seed(1)
    w, out = mixing.Walk("s"), []
    items = [(i, random.choice([5, 5, 90, 300]), 0.3) for i in range(500)]
    for i, s, p in items:
        out += w.add((i, s), s, p)
    for f in (lambda s: 1, lambda s: s):
        assert sum(f(s) for (_, s), k in out if k) + sum(f(x[1]) * x[2] for x in w.active) == pytest.approx(sum(f(s) * p for _, s, p in items), abs=1e-6)
    assert len(w.active) <= 2


def test_walk_keeps_probabilities():
    n = [0] * 6
    for t in range(3000):
        w = mixing.Walk(str(t))
        for i, s in enumerate([1, 4, 9, 2, 2, 30]):
            for j, k in w.add(i, s, 0.4):
                n[j] += k
        for x in w.active:
            n[x[0]] += x[2]
    assert all(abs(k / 3000 - 0.4) < 0.05 for k in n)


def test_mix(spark):
    random.seed(4)
    share = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.15, 3), "d": (0.05, 9), "gone": (0.2, 5)}
    rows = [(i, s, random.randrange(50, 900)) for i, s in enumerate("a" * 900 + "b" * 500 + "c" * 60 + "d" * 20)] + [(9001, None, 5), (9002, "else", 5), (9003, "a", 0), (9004, "a", None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(k, *v) for k, v in share.items()], "source_name string, target_share double, max_repeats bigint")
    got = mixing.mix(sizes, targets)
    assert got.exceptAll(mixing.mix(sizes, targets)).count() == 0
    out = {r.doc_id: r for r in got.collect()}
    assert not out.keys() & {9001, 9002, 9003, 9004} and all(1 <= r.copies <= share[r.source][1] for r in out.values())
    # The empty source's share goes to the others in proportion.
    for r in mixing.shares(got, targets).collect():
        want = 0 if r.source_name == "gone" else share[r.source_name][0]
        assert r.actual_share == pytest.approx(want, abs=0.004), r
    assert mixing.mix(sizes.where("false"), targets).count() == 0
    assert mixing.mix(sizes, targets.where("false")).count() == 0


def test_plan():
    assert mixing.plan([("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 2)]) == {"a": 0.2, "b": 2.0}
    assert mixing.plan([], [("a", 1.0, 1)]) == {} and mixing.plan([("a", 5)], [("a", 0.0, 1), ("b", None, 1)]) == {}


def test_tokenizers(spark, texts):
    import public_tokenizers

    values = ["hello world", "", None, "<|endoftext|> ünï", "x" * 100_000]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        tokens.runtime.require_columns(texts(*values), "t")
        got = {r.i: r.n for r in texts(*values).select("i", tokens.n_tokens(F.col("t"), public_tokenizers.path(name)).alias("n")).collect()}
        assert got[0] >= 2 and got[1] == 0 and got[2] is None and got[3] > 3 and got[4] > 100


SENTENCES = ["The ledger keeps every marker.", "Nobody noticed the snapshot because the archive was rebuilt.", "Please check whether the exporter still needs docs/notes/export_9.py.", "After seven retries the classifier reported a stale lock."]
CLOSERS = ["Done :)", "(end of note)", "- rerun the sweep", "More tomorrow…", "Status: open"]


def test_truncation(spark):
    random.seed(6)
    docs = []
    for i in range(300):
        docs.append((i, "\n\n".join(random.choices(SENTENCES, k=3)) + (("\n\nOpen:\n- rerun the sweep\n" + random.choice(CLOSERS)) if i % 2 else ""), "s"))
    whole = "\n\n".join(SENTENCES[:3])
    cut = [
        whole + " Nobody noticed the snap", whole + " Nobody noticed the", whole + " Nobody noticed…", whole + " Nobody noti...", whole + " Nobody [truncated]", whole + " Nob�", whole + "\n- rerun the", whole + " See docs/notes/export_9.",
        whole + "\n```\ncode line\nmore", '{"a": [{"b": "text that sto', whole + " Please check whethe ", whole + "\n\nMore tomor…", '{"a": [{"b": "c"}',
    ]
    fine = [whole, whole + "\n\nDone :)", whole + "\n```\ncode\n```", '{"a": [1]}', '[{"a": 1}]', whole + '\n"Quoted."', "", whole + "\n\nMore tomorrow…", whole + "  \n"]
    rows = docs + [(1000 + i, t, "s") for i, t in enumerate(cut)] + [(2000 + i, t, "s") for i, t in enumerate(fine)] + [(3000, None, "s"), (3001, whole, None), (3001, whole, None), (None, whole, "s"), (3002, "word " * 400_000 + "end.", "s")]
    got = truncation.detect(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    flagged = {r.doc_id for r in got if r.truncated}
    assert flagged == {1000 + i for i in range(len(cut))}
    assert len(got) == len(rows) - 1
    by = {r.source: r for r in truncation.by_source(spark.createDataFrame(got, "doc_id bigint, source string, truncated boolean, evidence string, at_limit boolean")).collect()}
    assert by["s"].n_truncated == len(cut) and by[None].n_documents == 2


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    whole = "\n\n".join(SENTENCES)
    docs = [(i, f"Note {i}\n\n{whole}", "s") for i in range(20)]
    copies = [(100 + i, whole + "\n\nRerun the expor", "c") for i in range(8)] + [(200 + i, whole + "\n\nSee whether the exporter", "c") for i in range(8)]
    own = [(300 + i, f"Item {i}\n\n{whole}\n\nAfter the rebu", "o") for i in range(4)]  # different texts, cut at the same place
    rows = docs + [(400, "rebuilt exporter", "s"), (401, "rebuilt exporter", "s")] + copies + own
    got = {r.doc_id: r.evidence for r in truncation.detect(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {got[d] for d, _, _ in copies[:8]} == {"word"} and {got[d] for d, _, _ in copies[8:]} == {"line"}
    assert {got[d] for d, _, _ in own} == {"word"} and {got[d] for d, _, _ in docs} == {None}


def test_limits(spark):
    sizes = [("s", n % 200 + 300) for n in range(400)] + [("s", 1000)] * 30 + [("t", 700)] * 3
    rows = [(s, str(i), n, n + i % 50) for i, (s, n) in enumerate(sizes)] + [("t", "copy", 900, 900)] * 50
    got = truncation.limits(spark.createDataFrame(rows, "source string, text_key string, n_chars bigint, n_bytes bigint")).collect()
    assert {tuple(r) for r in got} == {("s", "chars", 1000)}


def test_a_limit_decides_where_the_last_word_and_line_are_known(spark):
    random.seed(9)
    free = [(i, f"Note {i} " + "and more " * random.randrange(1, 60) + "text.\nrerun the sweep\nends.", "s") for i in range(150)]
    cut = [(1000 + i, (f"{i:04d}" + " and more" * 200)[:984] + "\nrerun the sweep", "s") for i in range(40)]
    other = [(2000, "short\nrerun the sweep", "s"), (2001, "A closed text of that length." + "x" * 970 + ".", "s")]
    got = {r.doc_id: r.evidence for r in truncation.detect(spark.createDataFrame(free + cut + other, "doc_id bigint, text string, source string")).collect()}
    assert {got[d] for d, _, _ in cut} == {"limit"} and {got[d] for d, _, _ in free} == {None} and got[2000] is None and got[2001] is None


def test_words_and_lines_of_any_length(spark):
    word, line = "ab" * 3000, "some words that go on and on " * 300
    rows = [(0, f"{word} is one. Yes.", "s"), (1, f"again {word} here. Yes.", "s"), (2, f"x {word[:4001]}", "s"), (3, f"{line}end\nmore.", "s"), (4, f"{line}end\nand more.", "s"), (5, f"one\n{line}end", "s"), (6, f"two\n{line}en", "s")]
    got = {r.doc_id: r.evidence for r in truncation.detect(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got == {0: None, 1: None, 2: "word", 3: None, 4: None, 5: None, 6: "word"}


def test_below_equals_brute_force(spark):
    random.seed(3)
    keys = {"".join(random.choices("ab\u00e9\U0001f600", k=random.randrange(1, 7))) for _ in range(300)}
    known = [(k, random.randrange(3), random.randrange(3)) for k in sorted(keys)]
    nodes = sorted(set(random.sample(sorted(keys), 60)) | {"a", "b" * 9, "\U0001f600"})
    got = {tuple(r) for r in truncation.below(spark.createDataFrame(known, "key string, inner bigint, final bigint"), spark.createDataFrame([(n,) for n in nodes] * 2, "key string")).collect()}
    own = {k: (i, f) for k, i, f in known}
    assert got == {(n, *own.get(n, (0, 0)), sum(i + f for k, i, f in known if k.startswith(n) and k != n)) for n in nodes}


def test_truncation_of_nothing(spark):
    assert truncation.detect(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


LINES = "line_id bigint, session_id string, id string, parent_id string, seq bigint, event_type string, msg_role string, msg_content string, event_timestamp string, received_at timestamp, speaker string"


def lines(spark, rows):
    full = [(n, s, i, p, seq, e, r, c, t, None, "own") for n, (s, i, p, seq, e, r, c, t) in enumerate(rows)]
    return spark.createDataFrame(full, LINES)


def faults(spark, rows, sessions, **how):
    df = lines(spark, rows)
    log = cv.fold(df)
    turns = cv.messages(log).withColumn("instant", F.col("event_timestamp").try_cast("timestamp"))
    ordered = cv.in_order(turns.select("session_id", "id", "parent_id", "line_id", "seq", "speaker", "instant"))
    known = spark.createDataFrame([(s,) for s in sessions], "session_id string")
    found = cv.faults(known, log, ordered, **how)
    return {(r.session_id, r.fault) for r in found.collect()}, cv.conversations(df, ordered, found)


T = "2026-01-01 00:00:0"
ROWS = [
    ("ok", "a", None, 0, "session", None, None, T + "0"), ("ok", "b", "a", 1, "message", "user", "hi", T + "1"), ("ok", "c", "b", 2, "message", " Assistant", "yo", T + "2"), ("ok", "c", "b", 2, "message", " Assistant", "yo", T + "2"),
    ("moved", "a", None, 0, "message", "assistant", "answer", T + "5"), ("moved", "b", "a", 1, "message", "human", "question", T + "1"),
    ("untold", "a", None, 0, "message", "user", "q", "?"), ("untold", "b", "a", 1, "message", "ai", "a", T + "9"), ("untold", "c", "b", 2, "message", "user", "q2", None), ("untold", "d", "c", 3, "message", "model", "a2", "?"),
    ("lost", "a", "nowhere", 0, "message", "user", "q", T + "1"), ("lost", "b", "a", 1, "message", "ai", "a", T + "2"),
    ("loop", "a", "b", 0, "message", "user", "q", T + "1"), ("loop", "b", "a", 1, "message", "ai", "a", T + "2"),
    ("blank", "a", None, 0, "message", "user", " \n ", T + "1"), ("blank", "b", None, 1, "assistant.reasoning", None, "thought", T + "2"), ("blank", "c", None, 2, "tool", "assistant", "out", T + "2"),
    ("twice", "a", None, 0, "user", None, "q", T + "1"), ("twice", "b", None, 1, "user.message", None, "q", T + "2"), ("twice", "c", None, 2, "assistant", None, "a", T + "3"),
    ("end", "a", None, 0, "turn.prompt", None, "q", T + "1"), ("other", "a", None, 0, "message", "user", "q", T + "1"), (None, "z", None, 0, "message", "user", "q", T + "1"),
    ("deleted", "a", None, 0, "message", "user", "q", T + "1"), ("deleted", "b", None, 1, "message", "ai", "a", T + "2"), ("deleted", "b", None, 1, "message.deleted", "ai", "a", T + "2"),
]
SESSIONS = ["ok", "moved", "untold", "lost", "loop", "blank", "twice", "end", "none", "deleted"]
FAULTS = {("lost", "broken"), ("loop", "broken"), ("blank", "empty"), ("none", "empty"), ("twice", "no_reply"), ("end", "no_reply"), ("deleted", "no_reply")}


@pytest.mark.parametrize("size", [100_000, 1])
def test_conversation_faults(spark, size):
    got, whole = faults(spark, ROWS, SESSIONS, group_rows=size)
    assert got == FAULTS
    turns = {}
    for r in whole.orderBy("session_id", "turn_no").collect():
        turns.setdefault(r.session_id, []).append((r.turn_no, r.speaker, r.content))
    assert turns["moved"] == [(0, "user", "question"), (1, "assistant", "answer")] and turns["ok"] == [(0, "user", "hi"), (1, "assistant", "yo")]
    assert [c for _, _, c in turns["untold"]] == ["q", "a", "q2", "a2"]


def test_edits_deletions_and_retries(spark):
    rows = [
        ("edit", "a", "nowhere", 0, "message", "user", "old words", T + "1"), ("edit", "b", "a", 1, "message", "ai", "answer", T + "2"), ("edit", "a", None, 0, "message", "user", "new words", T + "1"),
        ("cut", "a", None, 0, "message", "user", "q", T + "1"), ("cut", "x", "nowhere", 1, "message", "user", "lost", T + "2"), ("cut", "b", "a", 2, "message", "ai", "answer", T + "3"), ("cut", "x", "nowhere", 1, "message.retracted", "user", "lost", T + "2"),
        ("child", "a", None, 0, "message", "user", "q", T + "1"), ("child", "b", "a", 1, "message", "ai", "answer", T + "2"), ("child", "a", None, 0, "deleted", "user", "q", T + "1"),
        ("retry", "a", None, 0, "message", "user", "q", T + "1"), *(("retry", f"r{k}", "a", k, "message", "ai", f"try {k}", T + str(k + 1)) for k in (1, 2, 3)), ("retry", "s", "r3", 4, "message", "ai", "and more", T + "5"), ("retry", "t", None, 5, "message", "ai", "x", T + "6"), ("retry", "u", None, 6, "message", "ai", "y", T + "7"),
        ("numbers", "a", None, None, "message", "user", "first", None), ("numbers", None, "a", None, "message", "ai", "no id", None), ("numbers", "c", None, 5, "message", "user", "then", None), ("numbers", "d", "c", 6, "message", "ai", "end", None),
    ]
    got, whole = faults(spark, rows, ["edit", "cut", "child", "retry", "numbers"])
    assert got == {("child", "broken")}
    said = {}
    for r in whole.orderBy("session_id", "turn_no").collect():
        said.setdefault(r.session_id, []).append(r.content)
    assert said == {"edit": ["new words", "answer"], "cut": ["q", "answer"], "retry": ["q", "try 3", "and more", "x", "y"], "numbers": ["first", "no id", "then", "end"]}


def test_conversations_of_nothing(spark):
    got, whole = faults(spark, [], ["s"])
    assert got == {("s", "empty")} and whole.count() == 0


def test_a_long_session_is_cut_into_ranges(spark):
    rows = [("big", str(i), str(i - 1) if i else None, i, "message", "user" if i % 2 == 0 else "assistant", "x", f"2026-01-01T{i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}") for i in range(20_000)]
    got, whole = faults(spark, rows, ["big"])
    assert got == set() and whole.agg(F.max("turn_no")).first()[0] == 19_999
    got, _ = faults(spark, [r for r in rows if r[1] != "9999"], ["big"])
    assert got == {("big", "broken"), ("big", "no_reply")}
