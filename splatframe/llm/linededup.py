"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

The documents, in the order of their ids, are one sequence of lines that hold a word. A suffix begins at each line that
stands twice or more. Doubling round k names the suffixes of equal first 2^(k+1) lines: pairs of names at i and at
i + 2^k are sorted by range partitioning, and their numbers in that order are the next names, so names keep the order
of the suffixes. A suffix whose name is its own is ranked for good; rounds go on until all are, so runs of any length
are found. A suffix's key is the list of its names; sorted keys are the suffix array.

Neighbours in the array have as longest common prefix the lines that their common names stand for, plus what the keys
behind those lines have in common, and so on. Prefixes of less than min_words words part the array into intervals. In
each interval every suffix takes its longest prefix that also begins at an earlier line: going over the array both ways,
a stack holds the earlier places and how much of them is still common. Partitions of the array are swept by themselves;
their stacks, with one place for each length, are merged on the driver (their number is that of partitions) and handed
on. The runs so found are maximal: they can't be prolonged and still have an earlier copy. Their lines are deleted.

Lines are compared by their words (white space apart), by 128-bit hashes. Blank lines stay. Rows of one id and
text are one document stored repeatedly and lose the same lines. Ties: of equal runs the one of the least (id, hash of
the text, line) stays. Null and empty texts have no lines; null ids come first; very long texts are documents with many
lines, and only their own lines meet in a task. An empty table gives no rows. Extra columns of any name are ignored by
judge() and kept by remove().

A hot line is one row of an aggregate, and a skewed side of a plain join, which adaptive execution splits. Tables of
the rounds lie in the shared folder and are deleted when the runs are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import Scratch, new_name, saved, slices, texts_of

MIN_WORDS = 50
_ALL = 1 << 62


def least_lines(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line, how many lines from it on have min_words words; 0 where the text ends before."""
    total = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(total, total[:-1] + min_words)
    return np.where(ends <= len(words), ends - np.arange(len(words)), 0)


def _lines_pass(min_words: int):
    """Lines with a word, of texts that have min_words words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in slices(whole):
                rows, places, names, least = [], [], [], []
                for k, text in enumerate(texts_of(batch)):
                    split = [x for x in (line.split() for line in text.split(b"\n")) if x]
                    words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                    if words.sum() < min_words:
                        continue
                    rows += [k] * len(split)
                    places += range(len(split))
                    names += [digest(b" ".join(x)) for x in split]
                    least += least_lines(words, min_words).tolist()
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"].take(at), batch["th"].take(at), pa.array(places, pa.int64()),
                        pa.array(names, pa.binary()), pa.array(least, pa.int64()),
                    ],
                    ["id", "th", "pos", "name", "least"],
                )

    return run


def _suffixes(docs: DataFrame, doc_id: str, text: str, min_words: int, scratch: Scratch) -> DataFrame:
    """(id, th, d, pos, q, least, key): a row for each line that stands twice or more. d numbers texts, q places."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("th", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("name", T.BinaryType()),
            T.StructField("least", T.LongType()),
        ]
    )
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    lines = scratch.saved(picked.mapInArrow(_lines_pass(min_words), schema), "lines-all")
    place = F.xxhash64("id", "th", "pos")  # rows stored repeatedly have the same places
    names = lines.select("name", place.alias("h")).groupBy("name").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    names = scratch.saved(
        names.filter("a <> b").select("name", F.monotonically_increasing_id().alias("n")), "lines-names"
    )
    found = (
        lines.join(names, "name").drop("name").repartitionByRange("id", "th").dropDuplicates(["id", "th", "pos"])
        .sortWithinPartitions("id", "th", "pos").withColumn("q", F.monotonically_increasing_id())
    )
    first = F.min("q").over(Window.partitionBy("id", "th"))
    return scratch.saved(
        found.select("id", "th", first.alias("d"), "pos", "q", "least", F.array("n").alias("key")), "lines-suffixes"
    )


def _doubled(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, pos, q, least, key) of all suffixes with their whole keys, each of which occurs once."""
    state = suffixes.select("d", "pos", "q", "least", "key", F.lit(True).alias("open"), F.lit(False).alias("fresh"))
    done, k = [], 0
    while not state.filter("open").isEmpty():  # each round is short plans over written tables
        step = 1 << k
        by_text = Window.partitionBy("d")
        ahead = F.first("key").over(by_text.orderBy("pos").rangeBetween(step, step))
        known = scratch.saved(
            state.withColumn("ahead", ahead).withColumn("any", F.max("open").over(by_text)).filter("any").drop("any"),
            "lines-ahead",
        )
        still = known.filter("open").withColumn("n", F.element_at("key", -1))
        pairs = still.filter("ahead is not null").groupBy("n", "ahead").agg((F.count("*") > 1).alias("again"))
        ordered = pairs.repartitionByRange("n", "ahead").sortWithinPartitions("n", "ahead")
        names = scratch.saved(ordered.withColumn("next", F.monotonically_increasing_id()), "lines-names")
        columns = ["d", "pos", "q", "least"]
        longer = lambda x: F.concat("key", F.array(x)).alias("key")
        named = still.join(names, ["n", "ahead"]).select(*columns, longer(F.col("next")), F.col("again").alias("open"), F.lit(True).alias("fresh"))
        # Behind such a suffix the text ends or a line follows that stands once: before all others, by its own place.
        ends = still.filter("ahead is null").select(*columns, longer(-F.col("q") - 1), F.lit(False).alias("open"), F.lit(True).alias("fresh"))
        kept = known.filter("not open").select(*columns, "key", "open", F.lit(False).alias("fresh"))
        state = scratch.saved(named.unionByName(ends).unionByName(kept), "lines-state")
        done.append(state.filter("fresh and not open"))  # no round's number in a plan: generated code is used again
        k += 1
    whole = reduce(DataFrame.unionByName, done or [state]).select("d", "pos", "q", "least", "key")
    return scratch.saved(whole, "lines-keys")  # one table: it is read again and again


def _neighbours_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes: each with the one before it and the number of names that both keys begin with.

    The first of a partition has none before it. Behind the last row follows a copy of it, marked by `tail`.
    """
    names = ["t", "q", "d", "pos", "least", "before_q", "before_d", "before_pos", "shared", "tail", "key"]
    whole_key = pa.list_(pa.int64())
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["key"].to_pylist()
        shared = []
        for a, b in zip([last[-1] if last else None, *keys], keys):
            shared.append(sum(x == y for x, y in zip(a, b)) if a is not None else None)
        columns = {n: batch[n] for n in ("t", "q", "d", "pos", "least")}
        before = [
            pa.concat_arrays([pa.array([last[j] if last else None], pa.int64()), columns[n][:-1]])
            for j, n in enumerate(("q", "d", "pos"))
        ]
        firsts = [None if last else keys[0], *[None] * (len(keys) - 1)]
        last = (*(columns[n][-1].as_py() for n in ("q", "d", "pos")), batch["t"][-1].as_py(), keys[-1])
        marks = pa.array([False] * len(keys))
        yield pa.RecordBatch.from_arrays(
            [*columns.values(), *before, pa.array(shared, pa.int64()), marks, pa.array(firsts, whole_key)], names
        )
    if last:
        q, d, pos, t, key = last
        row = [t, q, d, pos, None, None, None, None, None]
        arrays = [*(pa.array([x], pa.int64()) for x in row), pa.array([True]), pa.array([key], whole_key)]
        yield pa.RecordBatch.from_arrays(arrays, names)


_PAIRS = "t long, q long, d long, pos long, least long, before_q long, before_d long, before_pos long, shared long"


def _neighbours(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """_PAIRS: the suffix array as pairs of neighbours that have a name in common; t is the place in the array."""
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key").withColumn("t", F.monotonically_increasing_id())
    found = scratch.saved(ordered.mapInArrow(_neighbours_pass, f"{_PAIRS}, tail boolean, key array<long>"), "lines-array")
    # Two rows of each partition of the array: where one ends and the next begins.
    edges = found.filter("key is not null").orderBy("t", "tail").collect()
    mended, before = [], None
    for row in edges:
        if row["tail"]:
            before = row
        elif before is not None:
            same = sum(x == y for x, y in zip(before["key"], row["key"]))
            mended.append((row["t"], row["q"], row["d"], row["pos"], row["least"], before["q"], before["d"], before["pos"], same))
    inner = found.filter("not tail and before_q is not null").drop("tail", "key")
    pairs = inner.unionByName(keyed.sparkSession.createDataFrame(mended, _PAIRS))
    # The common prefix has less than 2^shared lines; it must have least lines to hold min_words words.
    return pairs.filter("shared > 0 and least > 0 and least < shiftleft(1L, cast(shared as int))")


def _common_prefixes(pairs: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """_PAIRS with lines: the longest common prefix, of those where it has least lines or more."""
    power = lambda x: F.expr(f"shiftleft(1L, cast({x} - 1 as int))")
    open_ = scratch.saved(pairs.withColumn("lines", power("shared")), "lines-pairs")
    done = []
    places = keyed.select("d", "pos", "key")
    one, other = places.toDF("d", "at", "key_a"), places.toDF("before_d", "before_at", "key_b")
    while True:
        done.append(open_.filter("shared = 1"))
        rest = open_.filter("shared > 1")
        if rest.isEmpty():
            break
        rest = rest.withColumns({"at": F.col("pos") + F.col("lines"), "before_at": F.col("before_pos") + F.col("lines")})
        met = rest.join(one, ["d", "at"], "left").join(other, ["before_d", "before_at"], "left")
        # Equal names at one place of the keys mean equal ones at all places before.
        same = F.expr("size(filter(arrays_zip(key_a, key_b), x -> x.key_a = x.key_b))")
        more = met.withColumn("shared", F.when(F.col("key_a").isNotNull() & F.col("key_b").isNotNull(), same).otherwise(0).cast("long"))
        grown = more.withColumn("lines", F.col("lines") + F.when(F.col("shared") > 0, power("shared")).otherwise(0))
        # What is found no longer grows beyond twice its last step.
        bound = F.col("lines") + F.when(F.col("shared") > 1, power("shared")).otherwise(0)
        grown = grown.withColumn("shared", F.greatest("shared", F.lit(1))).filter(bound >= F.col("least"))
        open_ = scratch.saved(grown.select(*pairs.columns, "lines"), "lines-pairs")
    return scratch.saved(reduce(DataFrame.unionByName, done).filter("lines >= least"), "lines-prefixes")


def sweep(start: np.ndarray, end: np.ndarray, lines: np.ndarray, stack: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Goes over neighbours from start to end. Returns for each end the lines that it has in common with an earlier
    place that was passed, and the stack (common lines, place), both rising, whose top is the last end."""
    found = np.zeros(len(start), dtype=np.int64)
    for k, (a, b, n) in enumerate(zip(start.tolist(), end.tolist(), lines.tolist())):
        if not stack or stack[-1][1] != a:  # another interval begins
            stack = [(_ALL, a)]
        least = None
        while stack and stack[-1][0] >= n:  # no more than n lines are common from here on: the earliest place does
            least = stack.pop()[1]
        if least is not None:
            stack.append((n, least))
        while stack and stack[-1][1] > b:
            stack.pop()
        if stack:
            found[k] = stack[-1][0]
        stack.append((_ALL, b))
    return found, stack


def carried(summaries: list[dict]) -> dict[int, list[tuple[int, int]]]:
    """The stack with which each partition, in the order of the sweep, begins."""
    out: dict[int, list[tuple[int, int]]] = {}
    stack: list[tuple[int, int]] = []
    for s in summaries:
        out[s["part"]] = stack
        own = [(n, q) for n, q in s["stack"]]
        if s["whole"] and stack and stack[-1][1] == s["start"]:
            older = []
            for n, q in stack[:-1]:
                n = min(n, s["least"])
                if q < own[0][1] and not (older and older[-1][0] == n):
                    older.append((n, q))
            if older and older[-1][0] == own[0][0]:
                own = own[1:]
            own = older + own
        stack = own
    return out


_EDGES = ("before_q", "q", "lines", "before_d", "before_pos", "d", "pos")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns of each partition of the array, whose rows follow each other."""
    part, held = None, []

    def whole():
        return {n: np.concatenate([x[n] for x in held]) for n in _EDGES}

    for batch in batches:
        columns = {n: batch[n].to_numpy(zero_copy_only=False) for n in ("part", *_EDGES)}
        cuts = np.flatnonzero(np.diff(columns["part"], prepend=-1)) if batch.num_rows else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            if columns["part"][a] != part:
                if held:
                    yield part, whole()
                part, held = int(columns["part"][a]), []
            held.append({n: columns[n][a:b] for n in _EDGES})
    if held:
        yield part, whole()


def _both_ways(x: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, lines, end's d and pos) forwards and backwards."""
    return [
        (x["before_q"], x["q"], x["lines"], x["d"], x["pos"]),
        tuple(x[n][::-1] for n in ("q", "before_q", "lines", "before_d", "before_pos")),
    ]


def _summary_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, x in _by_part(batches):
        for back, (start, end, lines, _, _) in enumerate(_both_ways(x)):
            _, stack = sweep(start, end, lines, [])
            row = {
                "part": part, "back": bool(back), "start": int(start[0]), "least": int(lines.min()),
                "whole": bool((start[1:] == end[:-1]).all()), "stack": [{"n": n, "q": q} for n, q in stack],
            }
            yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY)


_SUMMARY = pa.schema(
    [
        ("part", pa.int64()), ("back", pa.bool_()), ("start", pa.int64()), ("least", pa.int64()), ("whole", pa.bool_()),
        ("stack", pa.list_(pa.struct([("n", pa.int64()), ("q", pa.int64())]))),
    ]
)


def _earlier(edges: DataFrame) -> DataFrame:
    """(d, first, lines): for each suffix the longest prefix that begins at an earlier place too."""
    spark = edges.sparkSession
    # A partition of the array is a range of t; its rows come together, in order.
    dealt = (
        edges.withColumn("part", F.shiftright("t", 33)).repartition("part").sortWithinPartitions("part", "t")
        .select("part", *_EDGES)
    )
    kind = "part long, back boolean, start long, least long, whole boolean, stack array<struct<n: long, q: long>>"
    summaries = [r.asDict(True) for r in dealt.mapInArrow(_summary_pass, kind).collect()]  # two rows a partition
    for s in summaries:
        s["stack"] = [(x["n"], x["q"]) for x in s["stack"]]
    forward = carried(sorted((s for s in summaries if not s["back"]), key=lambda s: s["part"]))
    backward = carried(sorted((s for s in summaries if s["back"]), key=lambda s: -s["part"]))
    held = spark.sparkContext.broadcast((forward, backward))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _by_part(batches):
            for stacks, (start, end, lines, d, pos) in zip(held.value, _both_ways(x)):
                found, _ = sweep(start, end, lines, list(stacks[part]))
                at = found > 0
                yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (d, pos, found)], ["d", "first", "lines"])

    return dealt.mapInArrow(run, "d long, first long, lines long")


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, first, lines): maximal runs of lines, counted among lines with a word, of which an equal one of
    min_words words or more stands earlier. A line may stand in several."""
    with Scratch(docs.sparkSession) as scratch:
        suffixes = _suffixes(docs, doc_id, text, min_words, scratch)
        keyed = _doubled(suffixes, scratch)
        edges = _common_prefixes(_neighbours(keyed, scratch), keyed, scratch)
        # Of both ways the longer prefix counts; of the runs that end at one line the longest holds the others.
        found = _earlier(edges).groupBy("d", "first").agg(F.max("lines").alias("lines"))
        longest = found.groupBy("d", (F.col("first") + F.col("lines")).alias("end")).agg(F.max("lines").alias("lines"))
        texts = suffixes.filter("q = d").select("d", "id", "th")
        return saved(
            longest.join(texts, "d").select("id", "th", (F.col("end") - F.col("lines")).alias("first"), "lines"), "lines-runs"
        )


def _cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """text without the lines of the runs, its lines with a word, and how many of them went."""
    lines, gone = text.split(b"\n"), set()
    for first, n in runs:
        gone.update(range(first, first + n))
    out, at = [], 0
    for line in lines:
        if line.split():
            at += 1
            if at - 1 in gone:
                continue
        out.append(line)
    return b"\n".join(out), at, len(gone)


def _applied(docs: DataFrame, doc_id: str, text: str, min_words: int) -> tuple[DataFrame, str]:
    """docs with a column of the later copies of each row's lines, and that column's name."""
    copies = later_copies(docs, doc_id, text, min_words)
    runs, th, key = new_name(docs.columns, "runs"), new_name(docs.columns, "th"), new_name(docs.columns, "key")
    per_doc = copies.groupBy(F.col("id").alias(key), F.col("th").alias(new_name([*docs.columns, th], "copy_th"))).agg(
        F.collect_list(F.struct("first", "lines")).alias(runs)
    )
    keyed = docs.withColumn(th, F.xxhash64(F.col(text)))
    same = keyed[doc_id].eqNullSafe(per_doc[key]) & (keyed[th] == per_doc[per_doc.columns[1]])
    # A merge join at every size: what is found grows with the documents, so a broadcast wouldn't last.
    return keyed.join(per_doc.hint("merge"), same, "left").select(*docs.columns, runs), runs


def _pairs(runs: list[dict] | None) -> list[tuple[int, int]]:
    return [(r["first"], r["lines"]) for r in runs or ()]


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_deleted, text (what is left; null where it was null)."""
    schema = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_deleted", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                done = [_cut(t, _pairs(r)) for t, r in zip(texts_of(batch), batch["runs"].to_pylist())]
                known = batch["text"].is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"], pa.array([n for _, n, _ in done], pa.int64()), pa.array([n for _, _, n in done], pa.int64()),
                        pa.array([t.decode() if ok else None for (t, _, _), ok in zip(done, known)], pa.string()),
                    ],
                    schema.names,
                )

    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return _applied(picked, "id", "text", min_words)[0].mapInArrow(run, schema)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all its columns and without later copies of runs; documents of which no word is left go.

    Documents that had no word stay. n_chars, where docs has it, follows the new text.
    """
    schema = docs.schema
    applied, found = _applied(docs, doc_id, text, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                runs = batch[found].to_pylist()
                columns = {n: batch[n] for n in schema.names}
                if any(runs):
                    texts, keep = columns[text].to_pylist(), np.ones(batch.num_rows, dtype=bool)
                    sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * batch.num_rows
                    for k, own in enumerate(runs):
                        if own:
                            left, lines, gone = _cut(texts[k].encode(), _pairs(own))
                            keep[k], texts[k] = gone < lines, left.decode()
                            sizes[k] = len(texts[k])
                    columns[text] = pa.array(texts, batch.schema.field(text).type)
                    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                        columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep))
                else:
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return applied.mapInArrow(run, schema)
