"""MinHash near-dedup: banded minima of universal hashes, verification, connected components.

Documents with equal shingle sets are one class, and classes are what is compared. A class's
minima are hashed in bands; classes that share a band's bucket are candidates. First each
class meets its buckets' smallest. In buckets that this doesn't connect, the classes outside the
commonest component meet those of other components, in tiles of bounded size. Candidates must agree in
enough bits of their minima, and then by their whole shingle sets. Components come from
alternating large-star and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WordHash, grams, mix, signed, steady, stored, words

#: Minima of a band, bands, and minima of which a bit is kept for the first look (64 a long).
ROWS, BANDS, BITS = 5, 40, 192
#: Classes of a tile, where classes are compared in blocks, and parts that a pivot's classes are dealt into.
TILE, PARTS = 512, 16
#: The chance that the bits pass over a link at the least similarity.
MISSED_BY_BITS = 1e-12


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of n words; fewer words are one run, none give none."""
    return np.unique(grams(h, n) if len(h) >= n else grams(h, len(h))) if len(h) else np.zeros(0, np.uint64)


class Minima:
    """Minima of rows * bands functions a * x + b modulo 2**64, with odd a."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.bands, n = rows, bands, rows * bands
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(x), 1024):
                part = self.a[:, None] * x[None, i : i + 1024]
                part += self.b[:, None]
                np.minimum(out, part.min(1), out=out)
        return out >> np.uint64(32)

    def bands_of(self, m: np.ndarray) -> np.ndarray:
        h = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            h = mix(h * np.uint64(0x100000001B3) + m[j :: self.rows], 2)
        return h

    @staticmethod
    def bits_of(m: np.ndarray) -> np.ndarray:
        """One bit of each of the first BITS minima, packed."""
        bit = (mix(m[:BITS], 3) >> np.uint64(60)) & np.uint64(1)
        return (bit.reshape(-1, 64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def most_apart(similarity: float, bits: int = BITS, missed: float = MISSED_BY_BITS) -> int:
    """The least d for which more than d of the bits differ, at this similarity, with a chance of `missed` at most.

    A bit differs with probability (1 - similarity) / 2, so the number is binomial.
    """
    p = (1 - similarity) / 2
    over, d = 0.0, bits
    while d and (over := over + math.comb(bits, d) * p**d * (1 - p) ** (bits - d)) <= missed:
        d -= 1
    return d


def _classes(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """Per row: doc_id, k1, k2 (a digest of its shingle set), n_shingles, bands, bits."""
    minima, hash_of = Minima(rows, bands), WordHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            seen: dict[int, tuple] = {}
            for text in b.column(1).to_pylist():
                x = shingles(hash_of(words(text, lower=True)), size)
                key = xxhash.xxh128_intdigest(x.tobytes())
                if key not in seen:
                    m = minima(x)
                    seen[key] = (signed(minima.bands_of(m)), signed(minima.bits_of(m))) if len(x) else (None, None)
                for k, v in zip(out, (key >> 64, key & 0xFFFFFFFFFFFFFFFF, len(x), *seen[key]), strict=True):
                    k.append(v)
            k1, k2 = (pa.array(np.array(k, dtype=np.uint64).view(np.int64)) for k in out[:2])
            lists = [pa.array(k, pa.list_(pa.int64())) for k in out[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), k1, k2, pa.array(out[2], pa.int64()), *lists], names=["doc_id", "k1", "k2", "n_shingles", "bands", "bits"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """node, k1, k2, shingles of the rows of docs (doc_id, text)."""
    hash_of = WordHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(hash_of(words(t, lower=True)), size) for t in b.column(1).to_pylist()]
            keys = np.array([divmod(xxhash.xxh128_intdigest(x.tobytes()), 1 << 64) for x in sets], dtype=np.uint64).reshape(-1, 2)
            ends = np.cumsum([0, *(len(x) for x in sets)]).astype(np.int32)
            flat = pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *sets])))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(keys[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)), lists], names=["node", "k1", "k2", "shingles"])

    return docs.mapInArrow(run, "node long, k1 long, k2 long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root of the components of edges (a, b): root is the smallest node. Nodes without edges are left out.

    Large-star joins every larger neighbour of a node to the smallest of its neighbourhood,
    small-star every smaller one and itself; both until nothing changes. Null ends, loops and
    repeats don't matter.
    """

    def turn(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now a > b always: b are a's smaller neighbours.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while (key := state(now)) != before and key[0]:
        before, now = key, stored(turn(now), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _meeting(percent: int, differ: int):  # noqa: ANN202
    """Of a tile of classes and a tile of those they may be linked to: linked roots (a, b).

    The bits pass over most pairs; the closest of a component is verified first, and one link to it is enough.
    """

    def unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
        column = column.combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        if left.num_rows and right.num_rows:
            (roots, sizes), (roots2, sizes2) = ([t.column(f"{c}_{k}").to_numpy() for k in ("root", "n")] for c, t in (("u", left), ("m", right)))
            bits, bits2 = np.stack(unpacked(left.column("u_bits"))), np.stack(unpacked(right.column("m_bits")))
            sets, sets2 = unpacked(left.column("u_shingles")), unpacked(right.column("m_shingles"))
            for i, root in enumerate(roots.tolist()):
                alike = (roots2 != root) & (100 * np.minimum(sizes2, sizes[i]) >= percent * np.maximum(sizes2, sizes[i]))
                at = np.flatnonzero(alike)
                apart = np.bitwise_count(bits2[at] ^ bits[i]).sum(1)
                order = np.argsort(apart, kind="stable")
                for k in at[order[: np.searchsorted(apart[order], differ, side="right")]].tolist():
                    pair = (root, int(roots2[k])) if root < roots2[k] else (int(roots2[k]), root)
                    if pair not in out:
                        both = len(np.intersect1d(sets[i], sets2[k], assume_unique=True))
                        if 100 * both >= percent * (sizes[i] + sizes2[k] - both):
                            out.add(pair)
        pairs = list(out)
        return pa.table([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns are ignored. Words are lower-cased A-Z; a set
    holds runs of `size` words, of a shorter text its whole sequence, of one that is null or without
    words nothing, and such a text is linked with none. Two sets are linked if
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable, itself included; kept is whether that
    is its own. Rows of one doc_id are one document; a null id is linked with none. An empty table gives an empty result.

    A very long text is read whole, and its set is held by one task. A link at the least similarity s
    is missed with probability (1 - s**rows)**bands by the bands (7e-11 for 85 % by default) and
    MISSED_BY_BITS by the bits.
    """
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    texts = docs.select("doc_id", "text")
    signs = stored(_classes(texts, size, rows, bands), "signs")
    kept = ["n_shingles", "bands", "bits"]
    classes = stored(signs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in kept)), "classes")
    lots = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    full = lots.groupBy("band").agg(F.count("*").alias("_c"), F.min(F.struct("node", "n")).alias("pivot")).where("_c > 1").drop("_c")
    shared = stored(lots.join(full, "band"), "shared")

    nodes = shared.select("node").distinct()
    small = classes.join(nodes, "node", "left_semi").select("node", "k1", "k2", F.col("n_shingles").alias("n"), "bits")
    sets = _sets(texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), size)
    sets = stored(small.join(sets.select("node", "k1", "k2", "shingles"), ["node", "k1", "k2"]).select("node", "n", "bits", "shingles"), "sets")

    differ = most_apart(percent / 100)

    def near(a: str, b: str):  # noqa: ANN202
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)  # else they can't be alike enough

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are links: by bits, then by whole sets."""
        bits = sets.select("node", "bits")
        x = pairs.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("_y")), "b").join(bits.select(F.col("node").alias("a"), F.col("bits").alias("_x")), "a")
        apart = sum((F.bit_count(F.col("_x")[i].bitwiseXOR(F.col("_y")[i])) for i in range(BITS // 64)), F.lit(0))
        x = x.where(apart <= differ).select("a", "b")
        whole = sets.select("node", "n", "shingles")
        x = x.join(whole.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("shingles").alias("_t")), "b")
        x = x.join(whole.select(F.col("node").alias("a"), F.col("n").alias("_m"), F.col("shingles").alias("_s")), "a")
        both = F.size(F.array_intersect("_s", "_t"))
        return x.where(100 * both >= percent * (F.col("_n") + F.col("_m") - both)).select("a", "b")

    first = shared.where((F.col("pivot.node") != F.col("node")) & near("n", "pivot.n")).select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(stored(linked(first), "links"))

    # Buckets whose classes aren't connected yet: those outside the commonest component meet all of other components.
    named = shared.join(roots.withColumnRenamed("root", "_r"), "node", "left").select("band", "node", F.col("pivot.node").alias("pivot"), F.coalesce("_r", "node").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("band")
    members = stored(named.join(mixed, "band", "left_semi").select("pivot", "node", "root").distinct(), "members")
    by_root = members.groupBy("pivot", "root").agg(F.count("*").alias("_n"))
    lots_of = by_root.groupBy("pivot").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "root")).alias("_top"))
    plan = lots_of.select("pivot", F.col("_top.root").alias("_common"), F.ceil(F.col("_all") / TILE).alias("_m"), F.ceil((F.col("_all") - F.col("_top._n")) / TILE).alias("_u"))
    # A common pivot's classes are dealt into parts, which all get its plan.
    dealt = plan.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    rows_ = members.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).join(dealt, ["pivot", "_part"]).drop("_part").join(sets, "node")

    def tile(c: str, of: str):  # noqa: ANN202
        return F.pmod(F.xxhash64(c), F.col(of))

    def copies(of: str):  # noqa: ANN202
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    held = ("node", "root", "n", "bits", "shingles")
    odd = rows_.where("root <> _common").select(*(F.col(c).alias(f"u_{c}") for c in ("pivot", *held)), tile("node", "_u").alias("u_u"), copies("_m").alias("u_m"))
    every = rows_.select(*(F.col(c).alias(f"m_{c}") for c in ("pivot", *held)), tile("node", "_m").alias("m_m"), copies("_u").alias("m_u"))
    found = odd.groupBy("u_pivot", "u_u", "u_m").cogroup(every.groupBy("m_pivot", "m_u", "m_m")).applyInArrow(_meeting(percent, differ), "a long, b long")
    # Links between roots are all that matters now.
    joined = components(stored(found, "links")).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    old = roots.join(joined, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    fresh = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("_to").alias("root"))
    roots = stored(old.unionByName(fresh), "roots")

    by_class = classes.select("k1", "k2", "node").join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("_root"))
    out = signs.select("doc_id", "k1", "k2", "n_shingles").join(by_class, ["k1", "k2"], "left")
    root = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("_root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def kept_rows(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 4, bands: int = 50) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest id, the first of several.

    Rows are judged one by one, so rows that share an id go only if their texts are alike.
    All columns are kept, whatever their names. Rows with a null id and texts without words stay.
    """
    docs = steady(docs)
    uid = F.monotonically_increasing_id().alias("uid")
    known = docs.select(uid, F.col("doc_id").alias("id"), "text").where("id IS NOT NULL")
    judged = near_duplicates(known.select(F.col("uid").alias("doc_id"), "text"), size, percent, rows, bands)
    ids = docs.select(uid, F.col("doc_id").alias("id"))
    least = judged.select(F.col("doc_id").alias("uid"), "component_id").join(ids, "uid").groupBy("component_id").agg(F.min(F.struct("id", "uid")).alias("first"))
    stay = least.select(F.col("first.uid").alias("uid"))
    row = docs.select(uid, F.struct(*docs.columns).alias("row"))
    return row.where("row.doc_id IS NOT NULL").join(stay, "uid", "left_semi").unionByName(row.where("row.doc_id IS NULL")).select("row.*")
