import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.functions import redact as r
from sessionloom.functions import text as t


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [x.o for x in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


# Secret-shaped samples, put together at run time.
SECRETS = {
    "aws-access-key-id": "AKIA" + "A1B2" * 4, "github-token": "ghp_" + "a1B2" * 10, "slack-token": "xoxb-" + "1" * 12, "stripe-key": "sk_live_" + "a" * 20,
    "google-api-key": "AIza" + "b" * 32, "jwt": "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "bearer-token": "Bearer " + "q" * 24,
    "telegram-bot-token": "1234567890:AA" + "x" * 33, "url-credentials": "https://me:" + "pw@", "generic-assignment": "password = '" + "z9" * 10 + "'",
    "provider-env": "OPENAI_API_KEY=" + "short", "generic-env": "MY_OWN_TOKEN=" + "v", "credential-path": "/home/me/.ssh/id_rsa", "meta-graph-token": "EAA" + "c" * 24,
    "private-key-pem": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
}


def python_redact(text):
    for kind, pattern in r.PATTERNS:
        text = re.sub(pattern, f"[REDACTED:{kind}]", text, flags=re.ASCII)
    return text


def test_redaction_equals_python_and_counts(spark):
    texts = [f"before {v} after" for v in SECRETS.values()] + ["def api_key_handler(x): pass", "", None, "token " * 50_000]
    got = column(spark, texts, r.redact)
    assert got == [None if x is None else python_redact(x) for x in texts]
    for kind, out in zip(SECRETS, got):
        assert f"[REDACTED:{kind}]" in out
    counts = column(spark, texts, r.redaction_counts)
    assert counts[0] == {"aws-access-key-id": 1} and counts[len(SECRETS)] == {} and counts[-2] == {}
    # A placeholder may be matched again by a later pass.
    again = column(spark, ["OPENAI_API_KEY=" + "sk-" + "a" * 24], r.redaction_counts)[0]
    assert again == {"llm-api-key": 1, "provider-env": 1}


def test_extra_patterns_and_allowlist(spark):
    assert column(spark, ["code X-77 and Y"], lambda c: r.redact(c, [("own", r"X-\d+"), ("bad", "(")]))[0] == "code [REDACTED:own] and Y"
    df = spark.createDataFrame([("MY_PROJECT_TOKEN=1 OTHER_TOKEN=2",), (None,)], "v string")
    assert [x.o for x in df.select(r.redact_allowing(["MY_PROJECT_TOKEN"])("v").alias("o")).collect()] == ["MY_PROJECT_TOKEN=1 [REDACTED:generic-env]", None]


def test_slugs_labels_folders(spark):
    assert column(spark, ["Hello, World__x", "--a--b--", "!!!", None, "Ünï côdé " * 20], t.slug) == ["hello-world-x", "a-b", "untitled", "untitled", ("ünï-côdé-" * 20)[:40]]
    assert column(spark, ["0.8", "0.79", "0.4", "0.1", None], lambda c: t.confidence_label(c.cast("double"))) == ["high", "medium", "medium", "low", "low"]
    assert column(spark, ["anti-pattern", "bugfix", "my-own", "", None], t.archive_subdir) == ["anti_pattern", "fix", "my_own", "neutral", "neutral"]
    assert column(spark, ["A-Workspace.code-workspace", "b.code-workspace", "c.code.json", "", None, ".code.json"], t.project_label) == ["A", "b", "c", "default", "default", "default"]
    assert column(spark, ["Straße  ÀÉ", None], lambda c: t.casefold(c)) == ["strasse  àé", None]
    assert column(spark, ["Qualità GRÜN ß_x1"], lambda c: F.array_join(t.tokens(c), "|")) == ["qualita|grun|ß|x1"]


def test_entities(spark):
    df = spark.createDataFrame([("GapEngine and the API of GapEngine", "Monte Bianco Vista saw HTTP2 and The Session; gapengine"), (None, None)], "a string, b string")
    got = [x.o for x in df.select(t.entities(F.col("a"), F.col("b")).alias("o")).collect()]
    assert got == [["Monte Bianco Vista", "GapEngine", "HTTP2", "API"], []]


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(alphabet="aA1 -_/.:=@sktoken", max_size=60), min_size=1, max_size=40))
def test_redaction_property(texts):
    from pyspark.sql import SparkSession

    assert column(SparkSession.getActiveSession(), texts, r.redact) == [python_redact(x) for x in texts]
