"""Token ids of a corpus by a public byte-level BPE vocabulary.

The tiktoken library encodes with a local rank file. Long texts are split before a blank that follows
a non-blank: no piece of the splitting pattern holds a blank after a non-blank, and its only look-ahead
goes to the right, so the ids of the parts are the ids of the whole.

Defined results: null and empty texts have no ids (an empty list); special tokens are ordinary text;
``decode`` of the ids gives the text's bytes back.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 100_000
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.cache
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``long`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > long:
        m = _SAFE.search(text, at + long)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def decode(ids: list[int], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    return encoding(folder, vocabulary).decode_bytes(ids)


def with_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, vocabulary)
        for batch in batches:
            ids, ends = [], [0]
            for t in batch.column(1).to_pylist():
                n = 0
                for part in parts(t) if t else ():
                    ids.append(e.encode_to_numpy(part, disallowed_special=()))
                    n += len(ids[-1])
                ends.append(ends[-1] + n)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
