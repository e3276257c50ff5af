"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items make one automaton over word ids. Documents stream through it; the longest match
that ends at each word is tracked, and words inside an occurrence of a benchmark window (`window` words of an item,
or a whole shorter item) are hit. Before the automaton, two exact necessary conditions thin out the stream: a word
that no item has ends every match, and so does a pair of neighbouring words that no item has.

The automaton is broadcast. Its size is checked: items are dealt into shards of at most `shard_words` words each (a
longer item is a shard of its own), and documents pass once through each shard, so an executor holds one automaton for
each of its workers. The driver reads the benchmark by partitions and holds one automaton at a time.

Null and empty texts have no words and no hits; very long texts are scanned whole. Items without words, null items and
null item ids match nothing. Repeated items count by distinct id; so do ties, items of equal words. Repeated rows each
get their result. An empty table or an empty benchmark gives no rows or no hits. Extra columns, of any name, are ignored
by scan() and kept by remove().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import WORD_BYTES, slices, texts_of, words_of

WINDOW = 10
#: Bound of one broadcast automaton, in words of items (about 600 bytes each).
SHARD_WORDS = 200_000
#: A document of which more than this part is hit is dropped by remove(); else its hit spans are cut out.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences, with the items that each state's substrings occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        """items: (id, words), ids may be repeated."""
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        pairs = set()
        sequences = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            if ids:
                sequences.append((item, ids))
                pairs.update(zip(ids, ids[1:]))
                last = 0
                for x in ids:
                    last = self._extend(last, x)
        self.least = min([window, *(len(x) for _, x in sequences)])
        self.base = len(self.vocab) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self.owners: list[set[str]] = [set() for _ in self.next]
        self.whole: dict[int, list[str]] = {}
        for item, ids in sequences:
            state = 0
            for x in ids:
                state = self.next[state][x]
                up = state
                while up > 0 and item not in self.owners[up]:
                    self.owners[up].add(item)
                    up = self.link[up]
            if len(ids) < window:
                self.whole.setdefault(self._at_length(state, len(ids)), []).append((len(ids), item))

    def _extend(self, last: int, x: int) -> int:
        known = self.next[last].get(x)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, x, known)
        state = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and x not in self.next[at]:
            self.next[at][x] = state
            at = self.link[at]
        if at >= 0:
            below = self.next[at][x]
            self.link[state] = below if self.length[below] == self.length[at] + 1 else self._clone(at, x, below)
        return state

    def _clone(self, at: int, x: int, of: int) -> int:
        copy = self._state(dict(self.next[of]), self.length[at] + 1, self.link[of])
        self.link[of] = copy
        while at >= 0 and self.next[at].get(x) == of:
            self.next[at][x] = copy
            at = self.link[at]
        return copy

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _at_length(self, state: int, n: int) -> int:
        """The suffix state that holds the last n words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """For each word that ends an occurrence of a window: its place, the longest window's words, all items."""
        state = matched = 0
        for at, x in enumerate(ids):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                matched += 1
            else:
                state = matched = 0
            if matched < self.least:
                continue
            width, items = 0, set()
            if matched >= self.window:
                width = self.window
                items |= self.owners[self._at_length(state, self.window)]
            up = state
            while self.whole and up > 0:
                for n, item in self.whole.get(up, ()):
                    if n <= matched:
                        width = max(width, n)
                        items.add(item)
                up = self.link[up]
            if width:
                yield at, width, items

    def candidates(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, list[int]]]:
        """(document, first word, word ids) of each stretch that may hold a window."""
        get = self.vocab.get
        flat: list[int] = []
        starts = []
        for words in docs:
            starts.append(len(flat))
            flat += [get(w, 0) for w in words]
            flat.append(0)  # no match crosses it
        ids = np.array(flat, dtype=np.int64)
        if not len(ids):
            return
        keep = np.zeros(len(ids), dtype=bool)
        if self.least == 1:
            keep = ids > 0
        else:
            places = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            keys = ids[places] * self.base + ids[places + 1]
            slots = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
            places = places[self.pairs[slots] == keys] if len(self.pairs) else places[:0]
            keep[places] = True  # the pair that begins here is an item's
            keep[places + 1] = True
        edge = np.diff(np.concatenate(([0], keep.view(np.int8), [0])))
        firsts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - firsts >= self.least
        firsts, ends = firsts[long], ends[long]
        owner = np.searchsorted(np.array(starts), firsts, "right") - 1
        for f, e, d in zip(firsts.tolist(), ends.tolist(), owner.tolist()):
            yield d, f - starts[d], flat[f:e]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _shards(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of bounded size. Items stream to the driver one partition at a time."""
    items, held = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        if row.i is None or not words:
            continue
        if items and held + len(words) > shard_words:
            yield SuffixAutomaton(items, window)
            items, held = [], 0
        items.append((row.i, words))
        held += len(words)
    if items:
        yield SuffixAutomaton(items, window)


def scan(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, spans (first and last word of each stretch of hit words), items (ids)."""
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", _SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    held = [spark.sparkContext.broadcast(x) for x in _shards(benchmark, item_id, item_text, window, shard_words)]
    alone = len(held) < 2
    # Several shards meet again by id and text: rows that share both have the same result, so their number is enough.
    key = F.lit(None).cast("string") if alone else F.md5(F.col(text).cast("binary"))
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), key.alias("key"))
    keyed = T.StructType([*schema.fields, T.StructField("key", T.StringType())])

    def through(automaton) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sam = automaton.value if automaton else None
            for whole in batches:
                for batch in slices(whole):
                    yield _scan_batch(sam, batch).append_column("key", batch["key"])

        return picked.mapInArrow(run, keyed)

    if alone:
        return through(held[0] if held else None).drop("key")
    out = through(held[0]).withColumn("shard", F.lit(0))
    for k, automaton in enumerate(held[1:], 1):
        out = out.unionByName(through(automaton).withColumn("shard", F.lit(k)))
    once = out.groupBy("id", "key", "shard").agg(
        F.count("*").alias("rows"), *(F.first(n).alias(n) for n in ("n_words", "spans", "items"))
    )
    gathered = once.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("raw"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("rows").alias("rows"),
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged([(s["first"], s["last"]) for s in x]) for x in batch["raw"].to_pylist()]
            packed = pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], type=_span_type())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_words"], packed, batch["items"]], ["id", "n_words", "spans", "items"]
            )

    repeated = gathered.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return repeated.select("id", "n_words", "raw", "items").mapInArrow(unite, schema)


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan_batch(sam: SuffixAutomaton | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    docs = [words_of(x) for x in texts_of(batch)]
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    for d, first, ids in sam.candidates(docs) if sam else ():
        for at, width, found in sam.scan(ids):
            spans[d].append((first + at - width + 1, first + at))
            items[d] |= found
    return pa.RecordBatch.from_arrays(
        [
            batch["id"],
            pa.array([len(x) for x in docs], type=pa.int64()),
            pa.array([[{"first": a, "last": b} for a, b in _merged(x)] for x in spans], type=_span_type()),
            pa.array([sorted(x) for x in items], type=pa.list_(pa.string())),
        ],
        ["id", "n_words", "spans", "items"],
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """scan()'s rows as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        F.col("id").alias(doc_id), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[list[int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*out, text[at:]])


def remove(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE, item_id: str = "item_id", item_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """docs with their columns: hit spans are cut out of texts; documents hit over more than max_coverage go.

    n_chars, where docs has it, follows the new text. Works in one pass over docs, without a shuffle: every shard looks
    at the original text and adds its spans to a column; the last one cuts.
    """
    spark, schema = docs.sparkSession, docs.schema
    column = "spans"
    while column in schema.names:
        column += "_"
    carried = T.StructType([*schema.fields, T.StructField(column, _SPANS)])
    held = [spark.sparkContext.broadcast(x) for x in _shards(benchmark, item_id, item_text, window, shard_words)]
    for k, automaton in enumerate(held):
        first, last = k == 0, k == len(held) - 1

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text):
                    spans: dict[int, list[tuple[int, int]]] = {}
                    if not first:
                        spans = {d: [(s["first"], s["last"]) for s in x] for d, x in enumerate(batch[column].to_pylist()) if x}
                        batch = batch.drop_columns([column])
                    docs = [words_of(x) for x in texts_of(batch, text)]
                    for d, place, ids in automaton.value.candidates(docs):
                        for at, width, _ in automaton.value.scan(ids):
                            spans.setdefault(d, []).append((place + at - width + 1, place + at))
                    merged = {d: _merged(x) for d, x in spans.items()}
                    if last:
                        yield _remove_batch(merged, [len(x) for x in docs], batch, text, max_coverage)
                    else:
                        packed = [[{"first": a, "last": b} for a, b in merged.get(d, ())] for d in range(len(docs))]
                        yield batch.append_column(column, pa.array(packed, type=_span_type()))

        docs = docs.mapInArrow(run, schema if last else carried)
    return docs


def _remove_batch(
    spans: dict[int, list[list[int]]], n_words: list[int], batch: pa.RecordBatch, text: str, max_coverage: float
) -> pa.RecordBatch:
    if not spans:
        return batch
    raw = texts_of(batch, text)
    keep, texts = np.ones(len(raw), dtype=bool), batch[text].to_pylist()
    for d, merged in spans.items():
        if sum(b - a + 1 for a, b in merged) > max_coverage * n_words[d]:
            keep[d] = False
        else:
            texts[d] = cut(raw[d], merged).decode()
    columns = {n: batch[n] for n in batch.schema.names}
    columns[text] = pa.array(texts, type=batch.schema.field(text).type)
    if "n_chars" in columns and pa.types.is_integer(batch.schema.field("n_chars").type):
        counts = columns["n_chars"].to_pylist()
        for d in spans:
            counts[d] = len(texts[d])
        columns["n_chars"] = pa.array(counts, type=batch.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(pa.array(keep))

