"""Text expressions: folding, tokens, slugs, labels, keys and entities."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the data model.
STOPWORDS = [
    "the", "this", "that", "when", "why", "how", "what", "and", "for", "with", "from", "not", "new", "one", "two", "three",
    "session", "transcript", "insight", "neural", "tape", "user", "assistant",
]
SUBDIRS = {
    "pattern": "pattern", "decision": "decision", "anti-pattern": "anti_pattern", "antipattern": "anti_pattern",
    "preference": "preference", "tool": "tool", "warning": "warning", "fix": "fix", "bugfix": "fix", "feat": "feat", "neutral": "neutral",
}
WORKSPACE_SUFFIXES = ["-Workspace.code-workspace", ".code-workspace", ".code.json"]
SLUG_CHARS = 40
HIGH, MEDIUM = 0.8, 0.4
TOKEN = r"[\p{L}\p{N}]+"
COMPOUND = r"(?U)\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"
SEVERAL_WORDS = r"(?U)\b([A-Z][a-zà-ú]{2,}(?:\s+[A-Z][a-zà-ú0-9]{2,}){1,3})\b"
ACRONYM = r"(?U)\b([A-Z][A-Z0-9]{2,})\b"


def _accent_table() -> tuple[str, str]:
    """All letters with combining marks and their base letters, by Unicode's decompositions."""
    pairs = []
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) and not unicodedata.combining(parts[0]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without accents, inside the JVM; sharp s stays."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{M}+", "")


def folded(text: str) -> str:
    """The same of a query's word."""
    return re.sub("[" + "".join(_MARKS) + "]+", "", text.lower().translate(_PLAIN_OF))


_PLAIN_OF = str.maketrans(_MARKED, _PLAIN)
_MARKS = [chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)).startswith("M")]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    """Full case folding, which the JVM lacks (sharp s becomes ss)."""
    return pd.Series([t.casefold() if isinstance(t, str) else None for t in texts], dtype=object)


def title_key(title: Column) -> Column:
    return squeeze(F.lower(title))


def dedup_key(title: Column, body: Column) -> Column:
    """Fingerprint of a folded title and an exact body."""
    return F.sha2(F.concat(squeeze(F.lower(F.coalesce(title, F.lit("")))), F.lit("\x00"), F.coalesce(body, F.lit(""))), 256)


def body_hash(body: Column) -> Column:
    return F.left(F.sha2(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")), 256), F.lit(16))


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s_]", "-"), r"[^\p{L}\p{N}-]", "")
    cut = F.left(F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "^-+|-+$", ""), F.lit(SLUG_CHARS))
    return F.when(cut == "", "untitled").otherwise(cut)


def confidence_label(value: Column) -> Column:
    return F.when(value >= HIGH, "high").when(value >= MEDIUM, "medium").otherwise("low")


def archive_subdir(category: Column) -> Column:
    known = F.create_map(*(x for k, v in SUBDIRS.items() for x in (F.lit(k), F.lit(v))))
    given = F.nullif(category, F.lit(""))
    return F.when(given.isNull(), "neutral").otherwise(F.coalesce(F.try_element_at(known, given), F.replace(given, F.lit("-"), F.lit("_"))))


def project_label(name: Column) -> Column:
    """A workspace's name without an editor's file suffix; ``default`` where nothing is left."""
    out = name
    for suffix in reversed(WORKSPACE_SUFFIXES):
        out = F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.char_length(name) - len(suffix))).otherwise(out)
    return F.when(F.coalesce(out, F.lit("")) == "", "default").otherwise(out)


def entities(title: Column, body: Column, cap: int = 5) -> Column:
    """Up to ``cap`` names in a text: compounds, names of several words, acronyms.

    The first spelling of a name counts. Names of fewer than three letters or
    with a filler word are left out. The longest come first, then by spelling.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    spans = F.concat(find(COMPOUND), find(SEVERAL_WORDS), find(ACRONYM))
    stop = F.array(*map(F.lit, STOPWORDS))
    clean = F.filter(spans, lambda s: (F.char_length(s) >= 3) & ~F.arrays_overlap(F.split(F.lower(s), r"\s+"), stop))
    keys = F.transform(clean, F.lower)
    first = F.filter(F.transform(clean, lambda s, i: F.when(F.array_position(keys, F.lower(s)) == i + 1, s)), lambda s: s.isNotNull())
    ranked = F.array_sort(F.transform(first, lambda s: F.struct((-F.char_length(s)).alias("k"), s.alias("s"))))
    return F.slice(F.transform(ranked, lambda x: x["s"]), 1, cap)


#: The largest code point, to bound prefix scans.
TOP = chr(sys.maxunicode)
