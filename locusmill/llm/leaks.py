"""Held-out passages and questions that stand, wholly or partly, in the documents of a corpus.

A leak is a run of at least ``words`` consecutive words of an item's passage or question, or the whole of a text
of fewer words (six at least). One Aho-Corasick automaton over the normalised texts holds blocks of half that many words, at
every half-th place: a run of ``words`` holds one of these blocks whole. Each document part is normalised and
scanned once; a block found is extended to both sides word by word, which settles the case exactly, and
blocks inside a run that is already known are passed over. Places are mapped back to the stored text through
transfer encodings and markup.

The test items are broadcast (as the automaton's word lists) behind a count of their bytes; more items than
``round_bytes`` are scanned in rounds of that size, each over the whole corpus. The automaton of a round takes about 50 times
its bytes in every Python worker, so the size belongs to the executors' memory.

Defined results: null and empty texts leak nothing; a passage below six words can't be found;
items with the same passage are all reported; an item found several times in a mail has a row for each place,
and is one case of ``find``; without items or documents there are no cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.mail import visible

WORDS, LEAST = 12, 6
ROUND_BYTES = 8_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def normalised(data: bytes) -> str:
    """Lower-case runs of a-z and digits, one blank before, between and after."""
    return " " + b" ".join(data.translate(_TABLE).split()).decode("ascii") + " "


def automaton(items: list[tuple[int, str, str]], words: int):
    """The automaton (null without a text) and the words of each text. items: item, field, text."""
    step = (words + 1) // 2
    a, texts = ahocorasick.Automaton(), []
    blocks: dict[str, list[tuple[int, int]]] = {}
    for item, field, text in items:
        p = normalised(text.encode("ascii", "replace")).split()
        if len(p) < min(words, LEAST):
            continue
        size = step if len(p) >= words else len(p)
        for i in range(0, len(p) - size + 1, size):
            blocks.setdefault(" " + " ".join(p[i : i + size]) + " ", []).append((len(texts), i))
        texts.append((item, field, p))
    for block, at in blocks.items():
        a.add_word(block, (len(block), at))
    if blocks:
        a.make_automaton()
    return (a if blocks else None), texts


def runs_of(data: bytes, a: ahocorasick.Automaton, texts: list[tuple[int, str, list[str]]], words: int) -> list[tuple[int, int, int]]:
    """Number of the text, first word and number of words of every run in one part, each once."""
    text = normalised(data)
    out: list[tuple[int, int, int]] = []
    doc, at_char, at_word = None, 0, 0  # words up to a place are counted on from the last one
    known: dict[tuple[int, int], int] = {}  # text and its shift against the document -> end of the last run
    for end, (size, at) in a.iter(text):
        if doc is None:
            doc = text.split()
        start = end - size + 1
        at_word += text.count(" ", at_char, start) if start >= at_char else -text.count(" ", start, at_char)
        at_char, w = start, at_word
        step = text.count(" ", start, end)
        for n, i in at:
            if known.get((n, w - i), -1) >= w + step:
                continue
            p = texts[n][2]
            lo, hi = 0, step
            while lo < i and lo < w and p[i - lo - 1] == doc[w - lo - 1]:
                lo += 1
            while i + hi < len(p) and w + hi < len(doc) and p[i + hi] == doc[w + hi]:
                hi += 1
            known[n, w - i] = w + hi
            if lo + hi >= min(words, len(p)):
                out.append((n, w - lo, lo + hi))
    return out


def _spans(data: bytes, places: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the runs stand in the stored text."""
    letters = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], letters, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    top = len(places) - 2
    return [(int(places[min(first[w], top)]), int(places[min(last[w + n - 1], top)]) + 1) for _, w, n in runs]


def places(docs: DataFrame, items: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, item_id, field (passage or question), words, start_pos, end_pos: every run of an item in each document."""
    fields = [c for c in ("passage", "question") if c in items.columns]
    held = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in fields])).alias("x")).select("item_id", "x.*").where("t is not null").distinct()
    total = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("b")).first()["b"]
    rounds = max(1, -(-total // round_bytes))
    out = None
    for r in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(x) for x in held.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, texts = automaton(shared.value, words)
            for batch in batches:
                rows = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not t or a is None:
                        continue
                    for data, where in visible(t):
                        if runs := runs_of(data, a, texts, words):
                            rows += [(k, *texts[n][:2], size, s, e) for (n, _, size), (s, e) in zip(runs, _spans(data, where(), runs))]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=list("difwse"))

        one = docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, item_id long, field string, words long, start_pos long, end_pos long")
        out = one if out is None else out.unionByName(one)
    return out


def find(found: DataFrame, field: str = "passage") -> DataFrame:
    """doc_id, item_id, words: each document and leaked item of ``places`` once, with the longest run of the field."""
    return found.where(F.col("field") == field).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
