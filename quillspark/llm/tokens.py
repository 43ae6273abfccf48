"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *keep: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, the columns to ``keep`` and ``n_tokens`` (int64). The whole text is encoded; null and empty texts have 0."""
    rows = documents.select(F.col(key), *keep, F.col(text).alias("_text"))

    def count(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]
            yield pdf.drop(columns="_text")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(count, f"{schema}, n_tokens long")
