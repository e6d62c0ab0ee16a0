"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import spread

#: Folder of the vocabulary files and the file used, as ranks of a byte-level BPE; both are parameters.
TOKENIZERS = os.environ.get("NETLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into words before merging (fixed value of this public vocabulary).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once in each worker."""
    import base64

    import tiktoken

    kept = tiktoken.__dict__.setdefault("_netloom_encoders", {})
    if path not in kept:
        if not os.path.exists(path):
            from pyspark import SparkFiles

            path_here = SparkFiles.get(os.path.basename(path))
        else:
            path_here = path
        with open(path_here, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = f"{TOKENIZERS}/{VOCABULARY}", parts: int | None = None) -> DataFrame:
    """docs without the text and with its number of tokens; null and empty texts have none.

    Texts are tokenized whole, where they are read. Only a table of fewer splits than `parts` (the session's shuffle
    partitions by default) is spread first, as tokenizing is dear; a large table's texts never cross the network. The ranks
    file has to be on every worker under `path`; ship it with SparkContext.addFile and give its name where it isn't.
    """
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{out}` long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], names=[*rest, out])

    return spread(docs.select(*rest, F.col(text_col).cast("string")), parts).mapInArrow(count, schema)
