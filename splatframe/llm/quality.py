"""Quality rules with thresholds from mergeable quantile sketches per language and source.

measure() counts what each whole text holds. sketches() is a log-linear histogram for each (lang, source, measure):
an integer keeps its seven leading bits, so a bucket's width is at most 1/64 of its value, and two sketches merge by
adding counts. Counting is a plain aggregate with map-side combining: a hot source sends one row per bucket and task.
Thresholds are fences around the middle half, `q25 - FENCE * spread` to `q75 + FENCE * spread`, so they adapt to
each group and reject nothing in a group without outliers. Repeated lines and words are one-sided, and nil in most
documents: their fence lies as far above q95 as q95 above q75, and at FLOOR at least. A group's fences are blended with
those of its language, by its number of documents against PRIOR_ROWS, and the language's with those of all documents in
the same way: one rule for groups of all sizes. judge() joins the thresholds to the measures.

Null and empty texts have no words and fail the base rules; null lang and source are groups of their own. Empty
tables give no rows. Extra columns are ignored. Repeated rows each get their verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import Scratch, saved, slices, texts_of

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents that the coarser group's fences count for beside a group's own.
PRIOR_ROWS = 200
#: How many spreads beyond the middle half a value may lie, and the least spread, by measure.
FENCE = 8
LEAST_SPREAD = {"word_milli": 150, "symbol_myriad": 60}
#: The least upper fence of the one-sided measures. The base rules leave repeat_myriad up to 3000.
FLOOR = {"dup_line_myriad": 2000, "repeat_myriad": 1500}
MEASURES = sorted({**LEAST_SPREAD, **FLOOR})

_KEPT_BITS = 7
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\r\x0b\x0c"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeat_words(docs: list[list[bytes]], window: int = REPEAT_WINDOW) -> list[int]:
    """Words in windows that stand twice or more in their own text. Exact: windows are ranked, not hashed."""
    lengths = np.array([len(x) for x in docs], dtype=np.int64)
    out = np.zeros(len(docs), dtype=np.int64)
    kept = np.flatnonzero(lengths > window)
    if not len(kept):
        return out.tolist()
    ids: dict[bytes, int] = {}
    place = ids.setdefault
    ranks = np.array([place(w, len(ids)) for d in kept for w in docs[d]], dtype=np.int64)
    owner = np.repeat(np.arange(len(kept)), lengths[kept])
    ends = np.cumsum(lengths[kept])
    span, alive = 1, np.arange(len(ranks))
    while span < window and len(alive):  # rank[i] names the span words from i; only repeated ones of a text go on
        step = min(span, window - span)
        alive = alive[alive + span + step <= ends[owner[alive]]]
        if span > 1:  # rank 0: what is joined stands once in its text, so the longer span does too
            alive = alive[ranks[alive + step] > 0]
        key = ranks[alive] * (int(ranks.max()) + 1) + ranks[alive + step]
        _, inverse = np.unique(key, return_inverse=True)
        pair = inverse * len(kept) + owner[alive]
        _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        fresh = np.zeros(len(ranks), dtype=np.int64)
        fresh[alive] = inverse + 1
        again = count[where] > 1
        ranks, alive, span = fresh, alive[again], span + step
    edge = np.zeros(len(ranks) + 1, dtype=np.int64)
    np.add.at(edge, alive, 1)
    np.add.at(edge, alive + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out[kept] = np.bincount(owner, weights=covered, minlength=len(kept)).astype(np.int64)
    return out.tolist()


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = texts_of(batch)
            docs = [x.split() for x in texts]  # bytes split at \x20 and \x09-\x0D, no others
            dups = [_dup_lines(x) for x in texts]
            columns = [
                [len(x) for x in docs],
                [sum(map(len, d)) - (len(t) - len(t.translate(None, _CONTINUES))) for d, t in zip(docs, texts)],
                [len(x.translate(None, _NOT_SYMBOL)) for x in texts],
                [x for x, _ in dups],
                repeat_words(docs),
                [n for _, n in dups],
            ]
            arrays = [batch[n] for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(x, type=pa.int64()) for x in columns)], [*names, *_COUNTS]
            )


def measure(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; base_failed; the measures that are sketched."""
    picked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.col(text).alias("text"),
    )
    schema = T.StructType([picked.schema[n] for n in ("doc_id", "lang", "source")])
    for name in _COUNTS:
        schema = schema.add(name, T.LongType())
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return picked.mapInArrow(_measure, schema).withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "word_milli": F.floor(1000 * F.col("word_chars") / words),
            "symbol_myriad": F.floor(10000 * F.col("n_symbols") / words),
            "dup_line_myriad": F.floor(10000 * F.col("n_dup_lines") / lines),
            "repeat_myriad": F.floor(10000 * F.col("n_repeat_words") / words),
        }
    )


def bucket(value: Column) -> Column:
    """A bucket's least value: value with all but its leading bits set to zero."""
    step = bucket_width(value)
    return F.floor(value / step) * step


def bucket_width(value: Column) -> Column:
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - _KEPT_BITS)
    return F.pow(F.lit(2.0), shift).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    pairs = F.array(
        *(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES)
    )
    return (
        measures.filter(~F.col("base_failed"))
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merges sketches to keys and reads the fences of each. A sketch has a bounded number of buckets."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    total = F.aggregate("sketch", F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def quantile(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

        def step(a: Column, x: Column) -> Column:
            seen = a["seen"] + x["n"]
            here = a["at"].isNull() & (100 * seen >= percent * F.col("rows"))
            return F.struct(seen.alias("seen"), F.when(here, x["bucket"]).otherwise(a["at"]).alias("at"))

        return F.aggregate("sketch", start, step)["at"]

    least, floor = (F.create_map(*(F.lit(x) for pair in sorted(d.items()) for x in pair)) for d in (LEAST_SPREAD, FLOOR))
    spread = F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")])
    last = F.col("q95") + bucket_width(F.col("q95")) - 1  # all values of its bucket lie within
    tail = F.greatest(last + F.col("q95") - F.col("q75"), floor[F.col("measure")])
    one_sided = F.col("measure").isin(*FLOOR)
    fenced = (
        merged.groupBy(*keys, "measure").agg(ordered.alias("sketch")).withColumn("rows", total)
        .withColumns({f"q{x}": quantile(x) for x in (25, 75, 95)})
        .withColumns(
            {
                "low": F.when(one_sided, F.lit(0).cast("long")).otherwise(F.col("q25") - FENCE * spread),
                "high": F.when(one_sided, tail).otherwise(F.col("q75") + FENCE * spread),
            }
        )
    )
    columns = [F.max("rows").alias("rows")]
    for m in MEASURES:
        columns += [F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for x in ("low", "high")]
    return fenced.groupBy(*keys).agg(*columns)


def thresholds(measures: DataFrame) -> DataFrame:
    """One row for each (lang, source) of measures, null included, with low_ and high_ of each measure."""
    with Scratch(measures.sparkSession) as scratch:
        return saved(_thresholds(measures, scratch.saved(sketches(measures), "quality-sketch")), "quality-thresholds")


def _thresholds(measures: DataFrame, sketch: DataFrame) -> DataFrame:
    groups = measures.select("lang", "source").distinct()
    fine, lang, whole = (_fences(sketch, k) for k in (["lang", "source"], ["lang"], []))
    fences = [f"{x}_{m}" for m in MEASURES for x in ("low", "high")]
    g = groups.alias("g").join(
        fine.alias("f"), F.col("g.lang").eqNullSafe(F.col("f.lang")) & F.col("g.source").eqNullSafe(F.col("f.source")),
        "left",
    ).join(lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").join(whole.alias("w"), F.lit(True), "left")

    def blended(x: str, own: str, coarse: Column) -> Column:
        rows = F.coalesce(F.col(f"{own}.rows"), F.lit(0))
        return (rows * F.coalesce(F.col(f"{own}.{x}"), F.lit(0)) + PRIOR_ROWS * coarse) / (rows + PRIOR_ROWS)

    pick = lambda x: blended(x, "f", blended(x, "l", F.col(f"w.{x}").cast("double")))
    return g.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *(pick(x).alias(x) for x in fences))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """measure()'s columns, the fences of each document's group, and kept."""
    found = saved(measure(docs, doc_id, text, lang, source), "quality-measure")
    limits = thresholds(found)
    joined = found.alias("d").join(
        limits.alias("t"),
        F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left",
    )
    names = [n for n in limits.columns if n not in ("lang", "source")]
    return joined.select("d.*", *(F.col(f"t.{n}") for n in names)).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(_within(), F.lit(True))
    )


def _within() -> Column:
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    return within
