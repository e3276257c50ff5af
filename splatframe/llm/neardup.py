"""N-gram Jaccard join by MinHash banding.

A document is the set of its five-word shingles (of fewer words: one shingle of all). Documents of one set are an
entity with a weight, so exact copies are never compared. Bands and rows of the MinHash follow from a target recall.
Band hashes are shuffled; a bucket with the members of an earlier band's bucket is dropped, as it holds no new pair.
Members of the other buckets are verified on their full sets. A pair counts in its first common band alone. A large
bucket is dealt as pairs of blocks of bounded weight and number, and a block pair gives one row per member: its links and the
least entity that it is connected with. Neither pairs nor buckets are ever gathered whole, and no partner is capped.

Only candidates' texts are read again: their ids are marked in a bitmap of fixed size, which lets through all
candidates and some others, that an exact join removes.

Null texts and texts without words have no links and a class of their own (null ids too). Repeated rows are copies of
each other; so are ties, texts of one set. Of a class the least id stays (a null one where it has
no other). Very long texts are taken
whole: a set is one row. An empty table gives no rows. Extra columns, of any name, are ignored by join() and kept by
representatives().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.llm.common import Scratch, new_name, saved, slices, texts_of, words_of
from splatframe.llm.components import components

SHINGLE = 5
#: Similarity from which documents are linked, as a fraction: no rounding at the edge.
NEAR = (4, 5)
TARGET_RECALL = 0.999
#: Rows of a band at most; more rows mean fewer false candidates and more bands.
MOST_ROWS = 4
#: Shingles of a block; a block pair's sets fit in a worker's memory.
BLOCK_SHINGLES = 400_000
#: Members of a block; a block pair's square matrices have about twice as many rows.
BLOCK_MEMBERS = 1024
#: Bits of the map that thins out the second reading; a few bytes a candidate do.
BITMAP_BITS = 1 << 23

#: What a text with a word has.
A_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"

_MEMO = 1 << 19
Keep = Callable[[DataFrame, str], DataFrame]


def bands_for(recall: float, near: float, rows: int) -> int:
    """The fewest bands of that many rows that find a pair of that similarity with that chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - near**rows)))


class Shingler:
    """Sets of 64-bit shingle hashes, and MinHash bands of them."""

    def __init__(self, bands: int, rows: int, shingle: int = SHINGLE):
        self.bands, self.rows, self.shingle = bands, rows, shingle
        rng = np.random.default_rng(20240229)
        n = bands * rows
        self.times = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.plus = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        self.memo: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words) - memo.keys():
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        docs = [words_of(t) for t in texts]
        h = self.word_hashes([w for d in docs for w in d])
        out, at = [], 0
        for d in docs:
            own, at = h[at : at + len(d)], at + len(d)
            n = min(self.shingle, len(d))
            g = np.full(max(0, len(d) - n + 1) if n else 0, n, dtype=np.uint64)
            for k in range(n):
                g = (g ^ own[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(31)
            out.append(np.unique(g))
        return out

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes, a row for each set; zeros for empty sets."""
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        out = np.zeros((len(sets), self.bands), dtype=np.int64)
        if not len(full):
            return out
        flat = np.concatenate(sets)
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for b in range(self.bands):
            mixed = np.full(len(full), b + 1, dtype=np.uint64)
            for k in range(b * self.rows, (b + 1) * self.rows):
                low = np.minimum.reduceat((flat * self.times[k] + self.plus[k]) >> np.uint64(16), starts)
                mixed = (mixed ^ low) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
            out[full, b] = mixed.view(np.int64)
        return out


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


_SHINGLERS: dict[tuple[int, int], Shingler] = {}


def shingler(bands: int, rows: int) -> Shingler:
    """This worker's shingler; what it remembers of words is bounded."""
    return _SHINGLERS.setdefault((bands, rows), Shingler(bands, rows))


def _signature_pass(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(bands, rows)
        for whole in batches:
            for batch in slices(whole):
                sets = own.sets(texts_of(batch))
                signs = own.signatures(sets)
                lists = pa.ListArray.from_arrays(np.arange(0, signs.size + 1, bands, dtype=np.int32), signs.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["th"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), lists],
                    ["id", "th", "n", "set_key", "bands"],
                )

    return run


def _sets_pass(bitmap, bands: int, rows: int):
    """Sets of the documents that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = shingler(bands, rows), bitmap.value
        for whole in batches:
            at = whole["k"].to_numpy(zero_copy_only=False) & (len(bits) * 64 - 1)
            wanted = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            passed = whole.filter(pa.array(wanted.astype(bool)))
            for batch in slices(passed) if passed.num_rows else ():
                sets = own.sets(texts_of(batch))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array([set_key(s) for s in sets], pa.binary()), lists], ["id", "set_key", "set"]
                )

    return run


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Square matrix: which pairs are as similar as NEAR says, on full sets."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    values, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[where]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, min(4096, (16 << 20) // (4 * len(sets))))
    edges = np.searchsorted(column, np.arange(0, len(shared) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - k * width] = 1
        both += part @ part.T
    out = np.zeros(both.shape, dtype=bool)
    for rows in _slabs(len(sets)):  # shared / union >= NEAR, in whole numbers
        total = sizes[rows, None] + sizes[None, :]
        out[rows] = sum(NEAR) * both[rows].astype(np.int64) >= NEAR[0] * total
    np.fill_diagonal(out, False)
    return out


def _slabs(n: int) -> Iterator[slice]:
    """Ranges of rows of a square matrix, of about a million cells each: what is derived from it stays small."""
    step = max(1, (1 << 20) // max(1, n))
    return (slice(a, a + step) for a in range(0, n, step))


def verify(band: int, blocks: list[int], i: int, j: int, sets: list[np.ndarray], bands: np.ndarray, mult: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block pair: weights of the links that count here, and each member's component (least member)."""
    near = linked(sets)
    if i != j:  # pairs inside a block are the business of (i, i) and (j, j)
        block = np.array(blocks)
        near &= block[:, None] != block[None, :]
    n = len(sets)
    label = np.arange(n, dtype=np.int32)
    while True:
        least = np.concatenate([np.where(near[r], label[None, :], np.int32(n)).min(axis=1) for r in _slabs(n)])
        fresh = np.minimum(label, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    weights = np.zeros(n, dtype=np.int64)
    for r in _slabs(n):
        fresh_pairs = near[r].copy()
        for b in range(band):
            fresh_pairs &= bands[r, b][:, None] != bands[:, b][None, :]
        weights[r] = fresh_pairs @ mult
    return weights, label


def _verify_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block pair; a group may go over several batches."""
    key, rows = None, []

    def flush():
        sets = [r[0] for r in rows]
        weights, label = verify(
            key[0], [r[3] for r in rows], key[2], key[3], sets, np.array([r[1] for r in rows]),
            np.array([r[2] for r in rows], dtype=np.int64),
        )
        names = [r[4] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(weights, pa.int64()), pa.array([names[x] for x in label], pa.binary())],
            ["set_key", "links", "near"],
        )

    for batch in batches:
        groups = zip(*(batch[n].to_pylist() for n in ("band", "h", "i", "j")))
        lists = batch["set"]
        values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        bands, others = batch["bands"].to_pylist(), zip(*(batch[n].to_pylist() for n in ("mult", "block", "set_key")))
        for k, (group, (mult, block, name)) in enumerate(zip(groups, others)):
            if group != key:
                if len(rows) > 1:
                    yield flush()
                key, rows = group, []
            rows.append((values[offsets[k] : offsets[k + 1]].copy(), bands[k], mult, block, name))
    if len(rows) > 1:
        yield flush()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Words of the bitmap of column k: at most BITMAP_BITS / 64 rows reach the driver."""
    word = F.shiftright(F.col("k").bitwiseAND(F.lit(BITMAP_BITS - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    rows = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    found = rows.toPandas()
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _entities(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int, scratch: Scratch, kept: Keep) -> tuple[DataFrame, DataFrame]:  # fmt: skip # noqa: E501
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("th", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    signed = kept(picked.mapInArrow(_signature_pass(bands, rows), schema), "neardup-signatures")
    entities = (
        signed.filter("n > 0").groupBy("set_key")
        .agg(F.count("*").alias("mult"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    return signed, scratch.saved(entities, "neardup-entities")


def _buckets(entities: DataFrame) -> DataFrame:
    """(set_key, band, h, c, weight): members of the buckets that may hold a pair not met in an earlier band."""
    exploded = entities.select("set_key", "n", F.posexplode("bands").alias("band", "h"))
    full = (
        exploded.groupBy("band", "h")
        .agg(
            F.count("*").alias("c"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("set_key")).alias("x"),
            F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("y"),
        )
        .filter("c > 1")
    )
    first = full.groupBy("c", "x", "y").agg(F.min(F.struct("band", "h", "c", "weight")).alias("k")).select("k.*")
    return exploded.drop("n").join(first, ["band", "h"])


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = TARGET_RECALL, rows: int = MOST_ROWS
) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), n_links (documents as near as NEAR)."""
    signed, classes = _classes(docs, doc_id, text, recall, rows, saved)
    found = signed.select("id", "n", "set_key").join(classes, "set_key", "left")
    alone = F.col("n") == 0
    return found.select(
        F.col("id").alias(doc_id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("mult") - 1 + F.col("links")).alias("n_links"),
        F.col("n").alias("n_shingles"),
    )


def _classes(docs: DataFrame, doc_id: str, text: str, recall: float, rows: int, kept: Keep) -> tuple[DataFrame, DataFrame]:
    """Signatures, and for each entity: set_key, mult, least_id, links, label, class_id. kept() writes both tables."""
    with Scratch(docs.sparkSession) as scratch:
        bands = bands_for(recall, NEAR[0] / NEAR[1], rows)
        signed, entities = _entities(docs, doc_id, text, bands, rows, scratch, kept)
        met = _verified(docs, doc_id, text, entities, bands, rows, scratch)
        links = met.groupBy("set_key").agg(F.sum("links").alias("links"))
        labels = components(met.select(F.col("set_key").alias("a"), F.col("near").alias("b")))
        labelled = (
            entities.select("set_key", "mult", "least_id")
            .join(links, "set_key", "left")
            .join(labels.withColumnRenamed("a", "set_key"), "set_key", "left")
            .select(
                "set_key", "mult", "least_id", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("label", "set_key").alias("label"),
            )
        )
        labelled = scratch.saved(labelled, "neardup-labels")
        # A table of its own: the join below then has plain sides, of which a hot one is split.
        least = scratch.saved(labelled.groupBy("label").agg(F.min("least_id").alias("class_id")), "neardup-least")
        return signed, kept(labelled.join(least, "label"), "neardup-classes")


def _verified(docs: DataFrame, doc_id: str, text: str, entities: DataFrame, bands: int, rows: int, scratch: Scratch) -> DataFrame:
    """(set_key, links, near): for each member of a block pair its links there, and the least entity connected."""
    spark = docs.sparkSession
    members = scratch.saved(_buckets(entities), "neardup-buckets")
    candidates = members.select("set_key").distinct().join(entities, "set_key")
    candidates = scratch.saved(candidates.withColumn("k", F.xxhash64("least_id")), "neardup-candidates")
    bitmap = spark.sparkContext.broadcast(_bitmap(candidates))
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("k"))
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("set", T.ArrayType(T.LongType())),
        ]
    )
    sets = keyed.mapInArrow(_sets_pass(bitmap, bands, rows), schema)
    # One row for each candidate: its least id's; rows repeated in docs meet in the aggregate.
    own = candidates.select("set_key", F.col("least_id").alias("id"), "mult", "bands")
    sets = own.join(sets, (own["set_key"] == sets["set_key"]) & own["id"].eqNullSafe(sets["id"])).select(
        own["set_key"], own["mult"], own["bands"], sets["set"]
    )
    sets = sets.dropDuplicates(["set_key"])
    blocks = F.ceil(F.greatest(F.col("weight") / BLOCK_SHINGLES, F.col("c") / BLOCK_MEMBERS)).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "set_key", "band", "h", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        )
    )
    group = ["band", "h", "i", "j"]
    laid = dealt.join(sets, "set_key").repartition(*group).sortWithinPartitions(*group)
    out = T.StructType(
        [
            T.StructField("set_key", T.BinaryType()),
            T.StructField("links", T.LongType()),
            T.StructField("near", T.BinaryType()),
        ]
    )
    return scratch.saved(
        laid.select(*group, "set_key", "mult", "block", "bands", "set").mapInArrow(_verify_pass, out), "neardup-links"
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = TARGET_RECALL, rows: int = MOST_ROWS) -> DataFrame:
    """docs with all its columns, one row of each class: the least id's. Documents without words all stay.

    Rows of the least id that have different texts are told apart by hashes of the texts; the least hash stays.
    """
    key, th = new_name(docs.columns, "key"), new_name(docs.columns, "th")
    with Scratch(docs.sparkSession) as scratch:
        signed, classes = _classes(docs, doc_id, text, recall, rows, scratch.saved)
        first = classes.filter(F.col("least_id").eqNullSafe(F.col("class_id"))).select("set_key", "label", "least_id").alias("f")
        place = (
            signed.filter("n > 0").select("id", "th", "set_key").alias("s")
            .join(first, (F.col("s.set_key") == F.col("f.set_key")) & F.col("s.id").eqNullSafe(F.col("f.least_id")))
            .groupBy("f.label").agg(F.min(F.struct("s.id", "s.th")).alias("k"))
        )
        kept = saved(place.select(F.col("k.id").alias(key), F.col("k.th").alias(th)), "neardup-kept")
    hashed = new_name([*docs.columns, th], "hash")
    marked = docs.withColumn(hashed, F.xxhash64(F.col(text)))
    once = (
        marked.join(kept, marked[doc_id].eqNullSafe(kept[key]) & (marked[hashed] == kept[th]))
        .select(*(marked[c] for c in marked.columns)).dropDuplicates([doc_id, hashed]).drop(hashed)
    )
    return once.unionByName(docs.filter(~F.coalesce(F.col(text).rlike(A_WORD), F.lit(False))))
