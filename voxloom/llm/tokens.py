"""Token counts of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name of the default vocabulary file, looked up where the vocabularies are installed.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    """The tokenizer of a vocabulary file, loaded once per process; ``path`` defaults to the installed ``VOCABULARY``."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            yield pdf.assign(text=[len(enc.encode_ordinary(t)) for t in pdf["text"]]).rename(columns={"text": "tokens"})

    return run


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` of every document with a text of one token or more.

    Documents with a null ``doc_id``, and null or empty texts, have no row. Whole
    texts are counted; other columns are ignored.
    """
    rows = documents.select("doc_id", "source", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return rows.mapInPandas(_counter(path), "doc_id long, source string, tokens long").filter("tokens > 0")
