"""Oversized texts cut at natural boundaries, by recursive bisection.

A text above the limit is cut at the strongest boundary near its middle, and so
are the halves as long as they exceed the limit minus the overlap. Then each
piece but the first gets the last ``overlap`` characters before it in front.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime

#: From weak to strong: none (inside a run without whitespace), a space, after a clause, after a sentence, a line, a paragraph.
BOUNDARIES = ("forced", "space", "clause", "sentence", "line", "paragraph")
_SPACE = re.compile(r"\s+")
#: The share of a segment on either side of its middle in which the strongest boundary is looked for.
NEAR = 0.25


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each run of whitespace, and the strength of a cut there."""
    at, strength = [], []
    for m in _SPACE.finditer(text):
        gap, before = m.group(), text[m.start() - 1] if m.start() else ""
        if "\n" in gap or "\r" in gap or " " in gap or " " in gap:
            s = 5 if gap.count("\n") > 1 or " " in gap else 4
        elif before in ".!?…。！？":
            s = 3
        elif before in ",;:)—–、，；：":
            s = 2
        else:
            s = 1
        at.append(m.end())
        strength.append(s)
    return np.array(at, np.int64), np.array(strength, np.int64)


def cuts(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Cut positions and the strength of each, in order."""
    core = max_size - overlap
    if len(text) <= max_size:
        return []
    at, strength = boundaries(text)
    todo, found = [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            continue
        # Neither side is tiny, and the first piece can lend the whole overlap.
        least = max(1, min(overlap, (b - a) // 4))
        low = max(a + least, overlap)
        high = max(low, b - least)
        middle, reach = min(max((a + b) // 2, low), high), max(1, int((b - a) * NEAR))
        i, j = np.searchsorted(at, [max(low, middle - reach), min(high, middle + reach) + 1])
        if i == j:  # nothing near: any boundary, else a cut in the middle
            i, j = np.searchsorted(at, [low, high + 1])
        if i < j:
            near = np.arange(i, j)
            k = near[np.lexsort((np.abs(at[near] - middle), -strength[near]))[0]] if j - i > 1 else i
            cut, s = int(at[k]), int(strength[k])
        else:
            cut, s = middle, 0
        found.append((cut, s))
        todo += [(a, cut), (cut, b)]
    return sorted(found)


def longest_run(text: str) -> int:
    """The most characters in a row without whitespace."""
    ends = [m.span() for m in _SPACE.finditer(text)]
    starts, stops = [0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)]
    return max((b - a for a, b in zip(starts, stops)), default=0)


_PIECES = "struct<longest_run int, pieces array<struct<piece_no int, start int, stop int, boundary string, piece string>>>"


def split(rows: DataFrame, text: str, max_size: int, overlap: int) -> DataFrame:
    """``rows`` with the column ``split``: ``longest_run`` and ``pieces``.

    A piece holds the characters ``start`` to ``stop`` of the text; ``boundary``
    tells what stands before its own part (``start`` of the text for the first).
    No piece is longer than ``max_size`` code points, and consecutive ones share
    exactly ``overlap``. Dropping the shared part gives the text back. A text
    within the limit is one piece and never leaves the JVM; an empty one is one
    empty piece, a null one has none. All rows and columns come back; a column
    named ``split`` is replaced.
    """
    runtime.require_columns(rows, text)
    if not 0 <= overlap <= max_size // 2:
        raise ValueError("the overlap must be at most half of the limit")

    @F.pandas_udf(_PIECES)
    def bisect(texts: pd.Series) -> pd.DataFrame:
        runs, lists = [], []
        for t in texts:
            if not isinstance(t, str):
                runs.append(None)
                lists.append(None)
                continue
            marks = cuts(t, max_size, overlap)
            edges = [(0, None), *marks, (len(t), None)]
            lists.append(
                [
                    {"piece_no": k, "start": max(0, a - overlap * bool(k)), "stop": b, "boundary": BOUNDARIES[s] if k else "start", "piece": t[max(0, a - overlap * bool(k)) : b]}
                    for k, ((a, s), (b, _)) in enumerate(zip(edges, edges[1:]))
                ]
            )
            runs.append(longest_run(t))
        return pd.DataFrame({"longest_run": pd.array(runs, "Int32"), "pieces": lists})

    t, size = F.col(f"`{text}`").cast("string"), F.char_length(F.col(f"`{text}`").cast("string"))
    rows = rows.drop("split")
    large = rows.where(size > max_size).withColumn("split", bisect.asNondeterministic()(t))
    one = F.struct(
        F.lit(0).alias("piece_no"), F.lit(0).alias("start"), size.alias("stop"), F.lit("start").alias("boundary"), t.alias("piece")
    )
    small = rows.where(t.isNull() | (size <= max_size)).withColumn(
        "split", F.struct(F.lit(None).cast("int").alias("longest_run"), F.when(t.isNotNull(), F.array(one)).alias("pieces")).cast(_PIECES)
    )
    return large.unionByName(small)


def oversized(rows: DataFrame, text: str, max_size: int, overlap: int) -> DataFrame:
    """Only those rows of ``split`` whose text exceeds the limit."""
    return split(rows.where(F.char_length(F.col(f"`{text}`").cast("string")) > max_size), text, max_size, overlap)
