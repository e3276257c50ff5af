"""URL filters: rules by host and path, else logistic regression on hashed character n-grams of both.

The model is fitted in numpy on the driver from a small labelled URL table of at most MAX_LABELLED rows, and is
BUCKETS float weights when broadcast. Scoring is one pass without a shuffle; only the url column is read.

Null urls and urls without `://` have an empty host and path; they fit no rule and the model judges the empty text.
Urls of any length are taken whole. Ties: of rules of one length the first by host, path and verdict counts. Repeated
rows each get their verdict; an empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import slices, texts_of

# Fixed values: (host, path, verdict) of the rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MAX_LABELLED = 100_000

#: Parts of the labelled URL table, by common words of each kind: a host's name is one of them or two together.
BLOCKED_WORDS = (
    "casino poker slots jackpot bets betting gamble roulette bingo lottery viagra cialis pills pharmacy steroids "
    "adult porn sex escort webcam nude spam clicker tracker adserver popunder banner ads doubler payday loans replica "
    "warez keygen cracked torrentz phishing malware giveaway winner prizes cheap bonus"
).split()
ALLOWED_WORDS = (
    "library university college school museum gallery garden weather recipes history science travel maps news radio "
    "health clinic hospital council city county archive photo music chess football cycling hiking theatre orchestra "
    "python docs wiki forum blog journal research physics biology chemistry geology economics law parliament church "
    "station theory northern other reading author nation motion better thing strong element moment estate render "
    "interest person market kitchen bakery farm forest river mountain island harbour bridge railway museum studio "
    "design craft pottery knitting painting poetry novel essays letters teacher student parents children family table cable valley people stable notable "
    "able whether then that the this with and others than their"
).split()


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """Adds rule (its text) and rule_verdict of the longest rule that fits; null where none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r: tuple[str, str, str]) -> Column:
        own = (F.col(host) == r[0]) | F.col(host).endswith("." + r[0])
        return own & F.col(path).startswith(r[1])

    def choose(k: int) -> Column:
        named = lambda r: r[0] + r[1] if k < 0 else r[k]
        return reduce(lambda rest, r: F.when(fits(r), F.lit(named(r))).otherwise(rest), ranked[::-1], F.lit(None).cast("string"))

    return df.withColumns({"rule": choose(-1), "rule_verdict": choose(2)})


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram, by polynomial hashes over the joined bytes; `^` and `$` mark the ends."""
    joined = b"".join(b"^" + t + b"$" for t in texts)
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        inside = np.arange(len(h)) + n <= ends[: len(h)]
        rows.append(owner[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows or [owner[:0]]), np.concatenate(buckets or [owner[:0]])


def logits(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + the mean weight of a text's n-grams, scaled by the root of their number."""
    rows, buckets = ngram_buckets(texts)
    count = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    return bias + np.bincount(rows, weights=weights[buckets], minlength=len(texts)) / np.sqrt(count)


def names_of(words: list[str]) -> list[str]:
    """Each word alone and joined with the one before and the one seven places before."""
    n = len(words)
    return [*words, *(f"{words[k]}-{words[k - 1]}" for k in range(n)), *(words[k] + words[k - 7] for k in range(n))]


def seed_urls(blocked: list[str] | None = None, allowed: list[str] | None = None) -> list[tuple[str, str, int]]:
    """The built-in labelled table (host, path, label): names under varied domains and paths, which tell nothing."""
    domains, subs = ("example.com", "example.net", "example.org", "test", "invalid.info"), ("", "www.", "m.", "blog.")
    paths = ("/", "/en/", "/a/index.html", "/de/", "/2020/01/post", "/es/", "/view", "/fr/")
    rows = []
    for label, words in ((1, blocked or BLOCKED_WORDS), (0, allowed or ALLOWED_WORDS)):
        for k, name in enumerate(names_of(words)):
            for j in range(3):
                rows.append((f"{subs[(k + j) % 4]}{name}.{domains[(k + 2 * j) % 5]}", f"{paths[(3 * k + j) % 8]}{(37 * k + j) % 1000}", label))
    return rows


def train(labelled: list[tuple[str, str, int]], steps: int = 300, rate: float = 0.2, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on at most MAX_LABELLED rows of (host, path, label)."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table is small by contract: {MAX_LABELLED} rows at most")
    texts = [(h + p).encode() for h, p, _ in labelled]
    y = np.array([x for _, _, x in labelled], dtype=np.float64)
    rows, buckets = ngram_buckets(texts)
    count = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    scale = 1 / np.sqrt(count[rows]) if len(rows) else np.zeros(0)
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, weights=w[buckets] * scale, minlength=len(texts))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        g = np.append(np.bincount(buckets, weights=error[rows] * scale, minlength=BUCKETS), error.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def judge(
    pages: DataFrame, model: tuple[np.ndarray, float], page_id: str = "page_id", url: str = "url",
    rules: list[tuple[str, str, str]] | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) of each row."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    parts = pages.select(
        F.col(page_id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    schema = T.StructType([*parts.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for whole in batches:
            for batch in slices(whole, "path"):
                texts = [h + p for h, p in zip(texts_of(batch, "host"), texts_of(batch, "path"))]
                z = np.clip(logits(texts, weights, bias), -500, 500)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["host"], batch["path"], pa.array(1 / (1 + np.exp(-z)))], schema.names
                )

    scored = with_rule(parts.mapInArrow(run, schema), RULES if rules is None else rules)
    learned = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "score"
    )
