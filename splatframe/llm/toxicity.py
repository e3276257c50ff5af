"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the training fold, labelled or not, are the unlabelled sample. The
class prior is the share of toxic rows among training labels. A linear model over words, word starts, and word starts
that several different words of the text have, minimises `prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))` in numpy. Labels of the held-out fold
(crc32 of the id as text, modulo 5, is 0) are never read; ids, languages and sources are no features.

Bounds: at most `max_positive` toxic and `max_unlabelled` other ids are fitted, picked by a hash of the id, with one
text each (of a repeated id, the least). Their texts pass through the driver one by one, and leave there the ids of
features that several positives have; the broadcast model has at most `max_features` features.

Null and empty texts have no features and get the model's score for none; very long texts count once for each of their
features. Labels of no document, null labels and repeated labels are harmless, an id that is labelled both ways counts
as toxic. Without any positive the score is 0. Repeated rows and ties get equal scores. An empty table gives no rows.
Extra columns, of any name, are ignored by score() and kept by reject().
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import Scratch, slices, texts_of, words_of

FOLDS = 5
MAX_POSITIVE = 2500
MAX_UNLABELLED = 5000
MAX_FEATURES = 1024
#: Letters of the word starts that are features beside whole words.
STARTS = (4, 5, 6)
#: A start is a feature again where so many different words of the text have it: in long texts one has it by chance.
REPEATS = (2, 3)
#: Chosen features that a positive needs before it stops to call for more; deviations from chance that a feature needs.
COVER = 3
LEAST_HOLDERS = 3
LEAST_GAIN = 4.0
_MEMO = 1 << 18


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS == 0


def word_features(word: bytes) -> list[bytes]:
    """The word itself, marked as whole, and its starts in characters."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(text[:n].encode() for n in STARTS if len(text) >= n)]


def features(text: bytes) -> set[bytes]:
    return repeated(Counter(f for w in set(words_of(text)) for f in word_features(w)))


def repeated(count: Counter[bytes]) -> set[bytes]:
    """Features by the number of different words that have them: `#` and the number stand before those of REPEATS."""
    return {*count, *(b"#%d%s" % (n, f) for f, have in count.items() if have > 1 for n in REPEATS if n <= have)}


class LinearModel:
    """bias + the sum of the weights of features present, as a logit."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self._bare = {f[2:] if f.startswith(b"#") else f for f in weights}
        self._memo: dict[bytes, tuple[bytes, ...]] = {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _known(self, word: bytes) -> tuple[bytes, ...]:
        if len(self._memo) >= _MEMO:
            self._memo.clear()
        found = self._memo[word] = tuple(f for f in word_features(word) if f in self._bare)
        return found

    def score(self, text: bytes) -> float:
        present: Counter[bytes] = Counter()
        memo = self._memo
        for word in set(words_of(text)):
            found = memo.get(word)
            if found is None:
                found = self._known(word)
            if found:
                present.update(found)
        z = self.bias + math.fsum(self.weights[f] for f in repeated(present) if f in self.weights)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class Sample:
    """Feature ids of positive and unlabelled texts. Only features of LEAST_HOLDERS positives or more have an id."""

    def __init__(self, rows: Callable[[], Iterable[tuple[bytes, set[int]]]]):
        """rows gives (text, roles) anew at each call: role 1 is a positive, 0 an unlabelled text."""
        count = Counter(f for text, roles in rows() if 1 in roles for f in features(text))
        self.names = sorted(f for f, n in count.items() if n >= LEAST_HOLDERS)
        del count
        self.ids = {f: k for k, f in enumerate(self.names)}
        self.positive: list[np.ndarray] = []
        self.unlabelled: list[np.ndarray] = []
        for text, roles in rows():
            known = self._known(text)
            for role in roles:
                (self.unlabelled, self.positive)[role].append(known)

    def _known(self, text: bytes) -> np.ndarray:
        get = self.ids.get
        found = (get(f) for f in features(text))
        return np.fromiter((k for k in found if k is not None), dtype=np.int32)

    def matrix(self, rows: list[np.ndarray], chosen: list[int]) -> np.ndarray:
        column = np.full(len(self.names), -1)
        column[chosen] = np.arange(len(chosen))
        out = np.zeros((len(rows), len(chosen)), dtype=np.float32)
        for k, row in enumerate(rows):
            at = column[row]
            out[k, at[at >= 0]] = 1
        return out


def select_features(sample: Sample, limit: int) -> list[int]:
    """Features that stand in the positives far more often than chance would have it, best first.

    Lazy greedy cover: a positive that COVER chosen features tell already no longer counts for the next one, so copies
    of one text don't bring in all of its words, and each kind of positive gets features of its own.
    """
    names, positive, unlabelled = sample.names, sample.positive, sample.unlabelled
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *positive])
    owner = np.repeat(np.arange(len(positive)), [len(x) for x in positive])[np.argsort(flat, kind="stable")]
    n_holders = np.bincount(flat, minlength=len(names))
    ends = np.cumsum(n_holders)
    u = np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *unlabelled]), minlength=len(names))
    covered = np.zeros(len(positive), dtype=np.int64)

    def holders(f: int) -> np.ndarray:
        return owner[ends[f] - n_holders[f] : ends[f]]

    def gain(f: int) -> float:
        n = int((covered[holders(f)] < COVER).sum())
        rate = (u[f] + 1) / (len(unlabelled) + 2)
        mean = rate * (covered < COVER).sum()
        return (n - mean) / math.sqrt(mean * (1 - rate) + 1) if n >= LEAST_HOLDERS else 0.0

    heap = [(-gain(f), len(x), x, f) for f, x in enumerate(names)]
    heapq.heapify(heap)
    chosen: list[int] = []
    stems: list[tuple[bytes, int]] = []
    while heap and len(chosen) < limit:
        _, size, name, f = heapq.heappop(heap)
        now = gain(f)
        if now <= LEAST_GAIN:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, size, name, f))
            continue
        stem = name.lstrip(b"=")
        if any(stem.startswith(x) or x.startswith(stem) and n > 0.9 * n_holders[f] for x, n in stems):
            continue  # it tells nothing that a chosen start of the same words doesn't
        chosen.append(f)
        stems.append((stem, n_holders[f]))
        covered[holders(f)] += 1
    return chosen


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, rate: float = 0.1,
    decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam under the non-negative risk with the logistic loss. Rows are 0/1 features."""
    width = positive.shape[1]
    w, m, v = (np.zeros(width + 1, dtype=np.float32) for _ in range(3))
    w[-1] = math.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        gp = prior * (sigmoid(zp) - 1) / len(zp)
        gu = np.zeros_like(zu)
        if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():  # else the negative risk counts as 0
            gp -= prior * sigmoid(zp) / len(zp)
            gu = sigmoid(zu) / len(zu)
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        g = np.append(gp @ positive + gu @ unlabelled, gp.sum() + gu.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES,
) -> LinearModel:
    """Fits on a bounded sample: two reads of id columns, and one of the texts whose ids were picked."""
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")
    )
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not total["toxic"]:
        return LinearModel({}, -40.0)
    prior = min(0.5, total["toxic"] / total["n"])
    ids = docs.select(F.col(doc_id).alias("id")).filter(F.col("id").isNotNull() & ~held_out("id"))
    order = [F.xxhash64(F.col("id")), F.col("id")]
    toxic = known.filter("y = 1").select("id").distinct().orderBy(*order).limit(max_positive)
    sample = ids.distinct().orderBy(*order).limit(max_unlabelled)
    picked = toxic.withColumn("p", F.lit(1)).unionByName(sample.withColumn("p", F.lit(0))).collect()  # bounded
    role: dict = {}
    for row in picked:
        role.setdefault(row["id"], set()).add(row["p"])
    key = spark.createDataFrame([(x,) for x in sorted(role)], T.StructType([T.StructField("id", docs.schema[doc_id].dataType)]))
    with Scratch(spark) as scratch:
        texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(key), "id")
        texts = scratch.saved(texts.groupBy("id").agg(F.min("text").alias("text")).orderBy("id"), "toxicity-sample")
        sample = Sample(lambda: (((r["text"] or "").encode(), role[r["id"]]) for r in texts.toLocalIterator()))
    if not sample.positive or not sample.unlabelled:
        return LinearModel({}, -40.0)
    chosen = select_features(sample, max_features)
    parts = (sample.matrix(x, chosen) for x in (sample.positive, sample.unlabelled))
    weights, bias = fit_nnpu(*parts, prior)
    return LinearModel({sample.names[f]: float(x) for f, x in zip(chosen, weights)}, bias)


def _scores(held, batch: pa.RecordBatch, text: str) -> pa.Array:
    return pa.array([held.value.score(x) for x in texts_of(batch, text)], type=pa.float64())


def score(docs: DataFrame, model: LinearModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch["id"], _scores(held, batch, "text")], ["id", "score"])

    scored = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return scored.select(
        F.col("id").alias(doc_id), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, model: LinearModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """docs with all its columns, without the rows that score limit or more."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                keep = [held.value.score(x) < limit for x in texts_of(batch, text)]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, schema)
