"""Licence scans: exact phrases, and fuzzy search for short notices.

Texts become lower-cased words with one space between. Exact phrases are word sequences (the base). Each notice may
occur with up to `edits` insertions, deletions or substitutions of characters. By the pigeonhole principle one of
its edits + 1 pieces then stands unchanged, so an exact search for the pieces finds every candidate window; the regex
library's bounded-error matching verifies each window and reports the span and its edits.

Null and empty texts have no words, labels or spans and score 0. Whole texts are searched, of any length; windows are
as long as their notices. Ties: of notices that fit a place equally well the label that comes first has it. Repeated
rows each get their result; an empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import slices, texts_of, words_of

# Phrases and labels of the base.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of the fuzzy search, with their labels and the edits that they may hold.
NOTICES = [
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("licensed under the gnu general public license version 2", "gpl-2", 5),
    ("gnu lesser general public license", "lgpl", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license version 2 0", "mpl-2", 3),
]

_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("first_word", T.LongType()),
                        T.StructField("last_word", T.LongType()),
                        T.StructField("edits", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 parts of about equal length with their places."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _compiled(notices: tuple[tuple[str, str, int], ...]):
    return [
        (label, len(n), e, pieces(n.encode(), e), regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(n.encode(), literal_spaces=True), e)))
        for n, label, e in notices
    ]


def places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _seeds(text: bytes, notices: tuple[tuple[str, str, int], ...]) -> Iterator[tuple[int, int, int, int, int]]:
    """(notice, first, end, first byte and end of a piece) of each window in which that piece may belong to a notice."""
    for k, (_, size, edits, parts, _) in enumerate(_compiled(notices)):
        for offset, part in parts:
            for at in places(text, part):
                yield k, max(0, at - offset - edits), min(len(text), at - offset + size + edits), at, at + len(part)


def fuzzy(text: bytes, notices: tuple[tuple[str, str, int], ...]) -> Iterator[tuple[str, int, int, int, int]]:
    """(label, first byte, end, edits, notice's length) of verified notices in a text of spaced words.

    Best fits come first, and spans don't overlap. Each piece has its own window; where a better notice takes a part
    of it, what is left beside the piece is searched again, so a weaker neighbour isn't lost.
    """
    known, tried, heap = _compiled(notices), {}, []
    firsts: list[int] = []  # of the spans that are taken, in order
    ends: list[int] = []

    def push(k: int, lo: int, hi: int, first: int, end: int) -> None:
        label, size, edits, _, pattern = known[k]
        if hi - lo < size - edits:
            return
        if (k, lo, hi) not in tried:
            m = pattern.search(text, lo, hi)
            tried[k, lo, hi] = m and (sum(m.fuzzy_counts), m.start(), m.end())
        if found := tried[k, lo, hi]:
            e, a, b = found
            heappush(heap, (e / size, label, a, b, e, size, k, lo, hi, first, end))

    for seed in _seeds(text, notices):
        push(*seed)
    while heap:
        _, label, a, b, e, size, k, lo, hi, first, end = heappop(heap)
        at = bisect_right(firsts, first)
        if (at and ends[at - 1] > first) or (at < len(firsts) and firsts[at] < end):  # the piece itself is taken
            continue
        left, right = max(lo, ends[at - 1] if at else 0), min(hi, firsts[at] if at < len(firsts) else len(text))
        if (left, right) == (lo, hi):
            yield label, a, b, e, size
            at = bisect_right(firsts, a)
            firsts.insert(at, a)
            ends.insert(at, b)
            if a < end and first < b:
                continue
            left, right = (b, hi) if b <= first else (lo, a)
        push(k, left, right, first, end)


def scan_text(text: bytes, notices: tuple[tuple[str, str, int], ...]) -> dict:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    starts, base, best = [], set(), 0.0
    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)  # the k-th stands before word k
    for phrase, label in PHRASES.items():
        for at in places(line, b" " + phrase.encode() + b" "):
            starts.append(int(np.searchsorted(spaces, at)))
            base.add(label)
    labels, spans = set(base), []
    for label, first, end, edits, size in fuzzy(line, notices):
        labels.add(label)
        best = max(best, 1 - edits / size)
        lead = len(line[first:end]) - len(line[first:end].lstrip())
        word = int(np.searchsorted(spaces, first + lead)) - 1
        last = word + line[first:end].strip().count(b" ")
        spans.append({"label": label, "first_word": word, "last_word": last, "edits": edits})
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": sorted(base), "labels": sorted(labels),
        "score": 1.0 if base else best, "spans": sorted(spans, key=lambda x: (x["first_word"], x["label"])),
    }


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: list[tuple[str, str, int]] | None = None
) -> DataFrame:
    """One row per document: doc_id, counts, labels as arrays, score and the verified spans. One pass, no shuffle."""
    fixed = tuple(NOTICES if notices is None else notices)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *_SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_SCHEMA)
        for whole in batches:
            for batch in slices(whole):
                rows = [scan_text(x, fixed) for x in texts_of(batch)]
                found = [pa.array([r[f.name] for r in rows], type=f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([batch["id"], *found], [doc_id, *kinds.names])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {"base_labels": F.concat_ws(",", "base_labels"), "labels": F.concat_ws(",", "labels")}
    )
