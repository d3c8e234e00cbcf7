"""Text sizes in tokens of a public tokenizer, read from its vocabulary file."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import runtime

# Fixed value: how byte-level vocabularies of that size split texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file of the driver's machine: .tiktoken, .json (tokenizers) or .model (sentencepiece). The session gives it to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def encoder(path: str):
    """A function from a list of texts to their lists of ids; one per worker and file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        return lambda texts: [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: coder.encode(texts, num_threads=1)


_given: set[tuple[str, str]] = set()


def give(path: str) -> str:
    """Ship the vocabulary file to all machines of the session, once; returns the name to find it by."""
    context = SparkSession.active().sparkContext
    if (context.applicationId, path) not in _given:
        context.addFile(path)
        _given.add((context.applicationId, path))
    return path.rsplit("/", 1)[-1]


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens; null for a null text, 0 for an empty one."""
    name = give(path)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        there = [i for i, t in enumerate(values) if isinstance(t, str)]
        sizes: list = [None] * len(values)
        for i, ids in zip(there, encoder(SparkFiles.get(name))([values[i] for i in there])):
            sizes[i] = len(ids)
        return pd.Series(sizes, dtype="Int64")

    return count.asNondeterministic()(text)


def sized(docs: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of each row, written to the shared folder, so that texts are encoded once."""
    runtime.require_columns(docs, text, *keep)
    return runtime.materialise(docs.select(*keep, n_tokens(F.col(f"`{text}`").cast("string"), path).alias("n_tokens")), "sizes")
