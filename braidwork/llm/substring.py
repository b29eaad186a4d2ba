"""Substring dedup with a log-structured index of window fingerprints.

A window is a run of words. Of the grams (shorter runs) in a window the one with the least
hash, the first of equals, is its anchor; equal windows have equal anchors in equal places.
Neighbouring windows that share an anchor make a segment, which the index keeps as one
fingerprint: the anchor's hash and a hash of the segment's words. So the index holds about one row for
every 14 windows, and yet no window that occurs twice escapes it.

The index is log-structured. Each batch becomes an immutable run, sorted by anchor, that is
merge-joined with the runs before; runs of one level are compacted into the next.
Where anchors meet, equal segments settle all their windows at once; windows of
the others are compared one by one. Words are hashed to 128 bits: the anchor and the first hash of
a window come from one half, the segment and the window's second hash from the other.

An index can be kept in a folder and opened again: its manifest names the runs of each level.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WordHash, delete, grams, mapped, new_path, partitions, release, signed, steady, stored, words

#: Words of a window and of a gram; batches that a whole table is taken in; runs of a level that are compacted.
WINDOW, GRAM, BATCHES, FAN = 35, 8, 4, 4

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes: the segments' anchors, first windows and numbers of windows."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(gram, window)
    g = grams(h, gram)
    at = sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


def spans_hash(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A hash of each segment's words, with its length: differences of running sums of powers."""
    from .common import M1, M2, mix

    base = int(M1 if not seed else M2)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(h), base, np.uint64)) if len(h) else np.zeros(0, np.uint64)
        inverse = pow(base, -1, 1 << 64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, seed) * power)])
        last = first + count + window - 1
        shift = np.cumprod(np.full(len(h) + 1, inverse, np.uint64))[first]  # undo the place in the text
        return mix((sums[last] - sums[first]) * shift + count.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), seed)


class FingerprintIndex:
    """Immutable runs of (anchor, segment, n, loc), dealt by anchor and sorted, in a folder that all machines see.

    A run is a bucketed table, so that runs are merge-joined on their anchors without moving either.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN, folder: str | None = None) -> None:
        self.spark, self.fan, self.buckets = spark, fan, buckets or partitions(spark)
        self.folder = folder or new_path(spark, "index")
        #: Names of the runs by level; each is a folder of its own, and a table of that name.
        self.levels: list[list[str]] = [[]]
        self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """An index that saved() left in this folder."""
        kept = json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifest").collect()))
        out = cls(spark, kept["buckets"], kept["fan"], folder)
        out.levels, out.compactions = kept["levels"], kept["compactions"]
        columns = "anchor BIGINT, segment BIGINT, n BIGINT, loc STRUCT<uid: BIGINT, place: BIGINT>"
        for name in (n for level in out.levels for n in level):
            dealt = f"CLUSTERED BY (anchor) SORTED BY (anchor, segment) INTO {out.buckets} BUCKETS"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {dealt} LOCATION '{folder}/{name}'")
        return out

    def saved(self) -> str:
        """Write the manifest; the folder is what open() takes."""
        kept = {"buckets": self.buckets, "fan": self.fan, "levels": self.levels, "compactions": self.compactions}
        self.spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest")
        return self.folder

    def drop(self) -> None:
        """Remove the runs and their tables."""
        for level in self.levels:
            self._dropped(level)
        self.levels = [[]]
        delete(self.spark, self.folder)

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def _run(self, rows: DataFrame) -> str:
        """Written once and never changed."""
        name = f"braidwork_run_{uuid.uuid4().hex[:12]}"
        table = rows.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor", "segment")
        table.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        release(self.spark)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a batch (anchor, segment, uid, place); returns the anchors of it that the history, or the batch itself, holds elsewhere.

        Compacts levels that are full.
        """
        name = self._run(batch.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place")).alias("loc")))
        own = self.spark.table(name).groupBy("anchor").agg(F.sum("n").alias("n"))
        met = own.where("n > 1").select("anchor")
        for before in self.runs():
            met = met.unionByName(own.where("n = 1").select("anchor").join(before.select("anchor"), "anchor", "left_semi"))
        met = stored(met.distinct(), "met")
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fan:
            self.compact(level)
            level += 1
        return met

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next, and remove them."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        old = self.levels[level]
        self.levels[level + 1].append(self._run(self._summed([self.spark.table(n) for n in old])))
        self.levels[level] = []
        self.compactions += 1
        self._dropped(old)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy("anchor", "segment").agg(F.sum("n").alias("n"), F.min("loc").alias("loc"))

    def shared(self, met: DataFrame) -> DataFrame:
        """anchor, segment, _n, _first of all segments with an anchor that was met again, and how many of its segments have no equal."""
        met = met.select("anchor").distinct()
        rows = self._summed([r.join(met, "anchor", "left_semi") for r in self.runs()])
        odd = rows.groupBy("anchor").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("_odd"))
        return rows.join(odd, "anchor").select("anchor", "segment", F.col("n").alias("_n"), F.col("loc").alias("_first"), "_odd")


#: A place packs a first window and a number of windows into one long.
COUNT_BITS = 20


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, segment, uid, place of every segment of rows (uid, text)."""
    hash_of = WordHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for uid, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = hash_of.both(words(text))
                anchor, first, count = segments(h[:, 0], window, gram)
                if len(anchor):
                    out[0].append(signed(anchor))
                    out[1].append(signed(spans_hash(h[:, 1], first, count, window, 0)))
                    out[2].append(np.full(len(first), uid, np.int64))
                    out[3].append(first << COUNT_BITS | count)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["anchor", "segment", "uid", "place"])

    return rows.mapInArrow(run, "anchor long, segment long, uid long, place long")


def _windows(work: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of the segments that are to be compared one by one."""
    hash_of = WordHash()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for uid, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = hash_of.both(words(text))
                at = np.concatenate([np.arange(f, f + c) for f, c in spans_of(places)])
                out[0].append(signed(grams(h[:, 0], window)[at]))
                out[1].append(signed(grams(h[:, 1], window, 1)[at]))
                out[2].append(np.full(len(at), uid, np.int64))
                out[3].append(at)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["h1", "h2", "uid", "first"])

    return work.mapInArrow(run, "h1 long, h2 long, uid long, first long")


def spans_of(places: list[int] | None) -> list[tuple[int, int]]:
    """(first window, number of windows) of packed places."""
    return [(p >> COUNT_BITS, p & ((1 << COUNT_BITS) - 1)) for p in places or ()]


def covered(n_words: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words the windows first .. first + count - 1 of each span cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for first, count in spans:
        edge[first] += 1
        edge[min(n_words, first + count + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """row (a struct of docs' columns) and places: the windows whose words occur elsewhere, packed (see spans_of), null if none.

    told may add columns to (uid, row.*) before rows move, whose texts become null then where they need no cut.
    """
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    docs = steady(docs)
    uid = F.monotonically_increasing_id().alias("uid")
    found = stored(_anchors(docs.select(uid, "text"), window, gram), "segments")
    index = FingerprintIndex(spark)
    met = None
    for b in range(batches):
        new = index.add(found.where(F.pmod(F.xxhash64("uid"), F.lit(batches)) == b))
        met = new if met is None else met.unionByName(new)
    hits = found.join(index.shared(met), ["anchor", "segment"])
    # Settled: an equal segment exists. To compare: segments without an equal, and the first of the equals that share their anchor.
    settled = F.col("_n") > 1
    compare = ~settled | ((F.col("_odd") > 0) & (F.col("_first.uid") == F.col("uid")) & (F.col("_first.place") == F.col("place")))
    by_row = hits.where(settled | compare).groupBy("uid").agg(F.collect_list(F.when(settled, F.col("place"))).alias("settled"), F.collect_list(F.when(compare, F.col("place"))).alias("compare"))
    rows = docs.select(uid, F.struct(*docs.columns).alias("row"))
    joined = (told(rows) if told else rows).join(by_row, "uid", "left")
    if told:
        joined = joined.withColumn("row", F.col("row").withField("text", F.when(F.col("settled").isNotNull(), F.col("row.text"))))
    work = stored(joined, "work")
    index.drop()

    windows = stored(_windows(work.where(F.size("compare") > 0).select("uid", "row.text", "compare"), window), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    one = F.shiftleft("first", COUNT_BITS).bitwiseOR(F.lit(1))
    singles = windows.join(twice, ["h1", "h2"]).groupBy("uid").agg(F.collect_list(one).alias("single"))
    none = F.array().cast("array<bigint>")
    places = F.concat(F.coalesce("settled", none), F.coalesce("single", none))
    hit = work.where(F.col("settled").isNotNull()).join(singles, "uid", "left").withColumn("places", places).drop("settled", "compare", "single", "uid")
    clean = work.where(F.col("settled").isNull()).withColumn("places", F.lit(None).cast("array<bigint>")).drop("settled", "compare", "uid")
    return hit.unionByName(clean)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document doc_id, n_words, n_removed and the digest of the kept words, joined by one space.

    docs has doc_id and text; other columns are ignored. A null text has no words; a very long
    one is read whole. Words in any window that occurs again, in the same row or another, are
    removed in all places; repeated rows repeat each other's windows, and rows that share a
    doc_id are judged each by itself. An empty table gives an empty result.
    """

    def whole(batch: dict) -> dict:
        found = [words(r["text"]) for r in batch["row"]]
        return batch | {"n_words": [len(w) for w in found], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in found]}

    def run(batch: dict) -> dict:
        batch["n_removed"] = [0] * len(batch["doc_id"])
        for i, (text, places) in enumerate(zip(batch["text"], batch["places"], strict=True)):
            if places:
                found = words(text)
                drop = covered(len(found), spans_of(places), window)
                batch["n_removed"][i] = int(drop.sum())
                batch["kept_sha256"][i] = hashlib.sha256(b" ".join([w for w, d in zip(found, drop.tolist(), strict=True) if not d])).hexdigest()
        return batch

    kinds = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = repeats(kinds, window, told=lambda x: mapped(x, whole, "uid long, row struct<doc_id:long,text:string>, n_words long, kept_sha256 string"))
    return mapped(rows.select("row.doc_id", "row.text", "places", "n_words", "kept_sha256"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, spans: list[tuple[int, int]], window: int) -> str:
    """The text without the covered words and the white space after each; the rest as it was."""
    data = text.encode()
    found = list(WORD.finditer(data))
    drop = covered(len(found), spans, window)
    keep, at = [], 0
    for i, (m, d) in enumerate(zip(found, drop.tolist(), strict=True)):
        if d:
            keep.append(data[at : m.start()])
            at = found[i + 1].start() if i + 1 < len(found) else len(data)
    keep.append(data[at:])
    return b"".join(keep).decode().rstrip(" ") if any(drop) else text


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut from text in all places, and n_chars, if there, brought up to date.

    All columns and rows are kept, whatever their names, texts that are nothing but repeats as
    empty ones; a null text stays null. See digests() for what counts as a repeat.
    """
    rows = repeats(docs, window)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            fields[at] = pa.array([cut(t, spans_of(x), window) if x and t else t for t, x in zip(fields[at].to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(fields, names=schema.names)

    out = rows.select("row", "places").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in schema.names else out
