import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import pii, queries
from sessionloom.llm.pseudonyms import permute, pseudonym

KEY = b"k"
PARTS = {"mara", "tolvenni", "quist", "arne"}
FOUND = [
    ("write to a.b+c@mail.example.org now", [("email", "a.b+c@mail.example.org")]), ("<mailto:x@y.test>", [("email", "x@y.test")]),
    ("see jo-do [at] it.example.com, ok", [("email", "jo-do [at] it.example.com")]), ("jo.do (at) example (dot) com", [("email", "jo.do (at) example (dot) com")]),
    ("mail jo at example dot com please", [("email", "jo at example dot com")]), ("contact=Jo.DO@IT.EXAMPLE.COM;", [("email", "Jo.DO@IT.EXAMPLE.COM")]),
    ("Call +1 (202) 555-0147 if", [("phone", "+1 (202) 555-0147")]), ("0039 02 555 0187", [("phone", "0039 02 555 0187")]), ("(717) 555 0155", [("phone", "(717) 555 0155")]),
    ("tel. 020 7946 0709", [("phone", "020 7946 0709")]), ("on +49 30 23125 096 bitte", [("phone", "+49 30 23125 096")]), ("+1.415.555.0164", [("phone", "+1.415.555.0164")]), ("303-555-0162", [("phone", "303-555-0162")]), ("+393331234567", [("phone", "+393331234567")]),
    ("SSN 935-19-1802", [("national_id", "935-19-1802")]), ("had 901-51-0545 in", [("national_id", "901-51-0545")]), ("DNI 12345678-Z", [("national_id", "12345678-Z")]), ("id 12345678Z", [("national_id", "12345678Z")]),
    ("Dokument RVZBCP51T02X916G da", [("national_id", "RVZBCP51T02X916G")]), ("passport no. YB6047850", [("national_id", "YB6047850")]), ("Steuer-ID 22 448 379 352 x", [("national_id", "22 448 379 352")]), ("Steuer-ID 71 077 448 481", [("national_id", "71 077 448 481")]),
    ("to 175 Old Mill Lane, Brackenford BX5 9QT.", [("street_address", "175 Old Mill Lane, Brackenford BX5 9QT")]), ("21 Sixth Blvd, Apt 2,\nMillhaven, ZZ 00021", [("street_address", "21 Sixth Blvd, Apt 2,\nMillhaven, ZZ 00021")]),
    ("a Via San Teodoro 160, 00160 Montefalco Alto, ground", [("street_address", "Via San Teodoro 160, 00160 Montefalco Alto")]), ("Corso Levante 12/B, interno 1, Borgolento", [("street_address", "Corso Levante 12/B, interno 1, Borgolento")]),
    ("Calle del Olmo 173, 6.º B, 09173 Villaserena.", [("street_address", "Calle del Olmo 173, 6.º B, 09173 Villaserena")]), ("Lindenstraße 147,\n01147 Neuwalde", [("street_address", "Lindenstraße 147,\n01147 Neuwalde")]), ("Am Kupferteich 124, 01124 Neuwalde", [("street_address", "Am Kupferteich 124, 01124 Neuwalde")]),
    ("PO Box 478, Harrowgate Flats ZZ 00178", [("street_address", "PO Box 478, Harrowgate Flats ZZ 00178")]), ("Postfach 12, 01124 Neuwalde", [("street_address", "Postfach 12, 01124 Neuwalde")]),
    ("by Mara Tolvenni on", [("person_name", "Mara Tolvenni")]), ("Quist, Arne", [("person_name", "Quist, Arne")]), ("Frau Mara B. Quist-Tolvenni war", [("person_name", "Frau Mara B. Quist-Tolvenni")]),
    ("Tolvenni-Quist, Mara", [("person_name", "Tolvenni-Quist, Mara")]), ("mara.tolvenni@x.test", [("email", "mara.tolvenni@x.test")]),
]
CLEAN = [
    "Clone from git@forge.test:gate/ledger.git first", "ssh://git@host.example/x.git", "Pinned sweep-core@2.23.10 for now", "Copied handoff@9b0e1f1 to", "ping @gate-rota", "The @budget_once decorator",
    "Ticket QX-905-71-7617", "Build 2026-9933-8741 passed", "Epoch 1746154108 is", "Offset 32800341822 exceeds", "Ratio 442:552 on port 8080", "uuid ff385feb-77de-4b1c-9a55-c6a6c846e2fd", "2026-02-11 09:40:00", "1.20.10",
    "15 Ledger Lane workers started", "Main Street is the name", "See Cedar Junction for", "The Ledger Planner and the Ledger Writer", "Mara said", "MaraTolvenni", "12345678-A", "192.168.100.200", "", "a" * 300_000, "A " * 100_000, "1-" * 100_000, "(" * 100_000,
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in pii.spans(text, PARTS)] == want


@pytest.mark.parametrize("text", ["221B Baker Street, London NW1 6XE", "12, Baker Street, London NW1 6XE", "12a, Old Mill Lane, Flat 3", "Casella Postale 12", "Casella postale 12", *(x for t, w in FOUND for k, x in w if k == "street_address")])
def test_addresses_pass_the_hint(text):
    assert pii._ADDRESS_HINT.search(text)
    assert [k for _, _, k, _ in pii.spans(f"to {text} ok", ())] == ["street_address"]


@pytest.mark.parametrize("text", CLEAN, ids=range(len(CLEAN)))
def test_clean(text):
    assert pii.spans(text, PARTS) == []


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([2, 10, 26]), st.integers(1, 9), st.integers(0, 10**9))
def test_permutation(radix, length, number):
    number %= radix**length
    there = permute(KEY, b"t", number, radix, length)
    assert 0 <= there < radix**length and permute(KEY, b"t", there, radix, length, inverse=True) == number


def test_permutation_is_onto():
    assert {permute(KEY, b"t", n, 10, 3) for n in range(1000)} == set(range(1000))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=string.ascii_letters + string.digits + " -.ß", max_size=30))
def test_pseudonym_keeps_the_format(value):
    new = pseudonym(KEY, "k", value)
    kind = lambda c: "d" if c in string.digits else "l" if c in string.ascii_lowercase else "u" if c in string.ascii_uppercase else c
    assert [kind(c) for c in new] == [kind(c) for c in value] and pseudonym(KEY, "k", new, inverse=True) == value


def test_one_number_has_one_pseudonym():
    digits = lambda s: "".join(c for c in s if c.isdigit())
    spelt = ["+39 06 5550 1683", "0039 06 5550 1683", "+39.06.5550.1683", "+390655501683"]
    assert len({digits(pii.placeholder("phone", v, KEY)) for v in spelt}) == 1
    assert pii.placeholder("phone", spelt[0], KEY) != pii.placeholder("phone", spelt[0], b"other")
    emails = [pii.spans(t, ())[0][3] for t in ("Jo.Do@Mail.example", "jo.do [at] mail.example", "jo.do (at) mail (dot) example")]
    assert len(set(emails)) == 1


@pytest.mark.parametrize("value,check", [
    ("12345678Z", pii.valid_dni), ("X1234567L", pii.valid_dni), ("2244837935" + pii.steuer_digit("2244837935"), pii.valid_steuer), ("935191802", pii.issuable_ssn),
    ("RSSMRA85T10A562S", lambda v: pii.plausible_cf(v) and pii.cf_letter(v) == v[15]), ("RVZBCP51T02X916G", lambda v: pii.plausible_cf(v) and pii.cf_letter(v) != v[15]), ("AB123456C", pii._NINO.fullmatch),
])
def test_check_digits_survive(value, check):
    assert check(value)
    new = {pii.id_pseudonym(bytes([k]), value) for k in range(20)}
    assert len(new) > 10 and all(map(check, new))


def test_number_pseudonyms_are_one_to_one():
    ssn = [f"1234{n:05d}" for n in range(1, 3000)]
    assert len({pii.id_pseudonym(KEY, v) for v in ssn}) == len(ssn)
    phones = [f"39{n:06d}" for n in range(3000)]
    assert len({pii.phone_pseudonym(KEY, v, True) for v in phones}) == len(phones) and all(pii.phone_pseudonym(KEY, v, True)[:2] == "39" for v in phones)


def test_dates_are_permuted_within_their_century_and_spelling():
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(36524)]
    assert {pii.date_pseudonym(KEY, d.isoformat()) for d in days} == {d.isoformat() for d in days}
    spelt = ["1961-05-23", "23.05.1961", "23/5/1961", "23 May 1961", "May 23, 1961", "23 de mayo de 1961", "23. Mai 1961"]
    assert len({pii.date_of(pii.date_pseudonym(KEY, s))[0] for s in spelt}) == 1
    assert pii.date_of(pii.date_pseudonym(KEY, "23. Mai 1961"))[0] != datetime.date(1961, 5, 23)


CORPUS = ["-- \nMara Tolvenni\nx", "mara.tolvenni@x.test", "Frau Arne Quist was", "Dr. Arne Quist", "asked Mara Quist and Cedar Lake", "code x@2.3.4 Core Lake", "core-lake@1.2", "core-lake@1.3", None, ""]


def test_learned_names_and_both_ways(spark, texts):
    rows = texts(*CORPUS)
    parts = pii.name_parts(rows, "t")
    assert {r.part for r in parts.collect()} == {"mara", "tolvenni", "arne", "quist"}
    one = pii.pseudonymise(rows, "t", KEY, parts).orderBy("i").collect()
    two = pii.pseudonymise(rows, "t", KEY, parts, record="i", lexicon_rows=1).orderBy("i").collect()
    assert [r.pii for r in one] == [r.pii for r in two]
    assert one[4].pii.redacted.startswith("asked [person_name:") and one[4].pii.redacted.endswith("] and Cedar Lake")
    assert one[8].pii.redacted is None and one[9].pii.redacted == "" and one[9].pii.findings == []
    three = pii.pseudonymise(rows, "t", KEY, parts, lexicon_rows=0).orderBy("i").collect()
    assert [r.pii for r in one] == [r.pii for r in three]


def test_accents_make_no_difference_either_way(texts):
    rows = texts("jose.pena@x.test", "jose.pena@y.test", "asked José Peña and JOSÉ PEÑA", "José Peña's note", "-- \nZoë Brontë\n", "Frau Zoe Bronte", "by Zoë Bronte", None)
    rows = rows.withColumn("k", F.md5("t"))
    rows = rows.unionAll(rows)
    parts = pii.name_parts(rows.where("i > 1 or i = 0"), "t", 4)
    assert {r.part for r in parts.collect()} == {"zoe", "bronte"}  # one spelling each in two rows
    parts = pii.name_parts(rows, "t")
    one = pii.pseudonymise(rows, "t", KEY, parts).collect()
    two = pii.pseudonymise(rows, "t", KEY, parts, record="k", lexicon_rows=1).collect()
    plain = lambda got: sorted((r.i, r.pii.redacted, repr(r.pii.findings)) for r in got if r.t)
    assert len(one) == len(two) == 16 and plain(one) == plain(two)
    assert {r.i: len(r.pii.findings) for r in two if r.t} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}


def test_queries_take_more_parts_than_are_broadcast(spark, data, monkeypatch):
    rows = lambda: sorted(map(repr, queries.p2_redacted(spark, data).collect()))
    want = rows()
    monkeypatch.setattr(pii.pseudonymise, "__defaults__", (None, 1))
    assert rows() == want


def test_nothing_else_changes(texts):
    text = "A: +1 (202) 555-0147; B\n\tx@y.test é…"
    got = pii.pseudonymise(texts(text, text), "t", KEY, texts().select(F.col("t").alias("part"))).collect()
    for r in got:
        out = r.pii.redacted
        for f in reversed(r.pii.findings):
            out = out.replace(f.placeholder, text[f.start : f.stop], 1)
        assert out == text


def test_empty_and_clashing(spark):
    rows = spark.createDataFrame([], "pii int, t string, part string")
    assert pii.pseudonymise(rows, "t", KEY, pii.name_parts(rows, "t")).count() == 0
    random.seed(1)


def test_hints_are_in_all_that_they_spare():
    titles = pii.TITLES.replace("\\", "").split("|")
    assert all(any(h in t for h in pii._OWN_HINTS) for t in titles)
    cues = ["date of birth", "birthdate", "Birthday", "born", "born on", "d.o.b.", "DOB", "do.b", "d.ob", "geburtsdatum", "geboren am", "geb.", "data di nascita", "nato il", "Nata il", "fecha de nacimiento", "nacido el", "nacida el"]
    for c in cues:
        assert pii._BIRTH.search(f"{c} 1.2.1980") and any(h in c.lower() for h in pii._BIRTH_HINTS), c
