"""What the operators of this subpackage share: words, hashes, the shared folder and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts are long, so batches stay small.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own; a
    cluster without it is an error, as its machines have no folder in common.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_braidwork_dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="braidwork-")
    atexit.register(shutil.rmtree, own, True)
    spark._braidwork_dir = f"file://{own}"
    return spark._braidwork_dir


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/braidwork-{uuid.uuid4().hex[:12]}"
    made = spark.__dict__.setdefault("_braidwork_made", [])
    made.append(folder)
    return f"{folder}/{name}"


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables that the operators wrote for this session; results that weren't read yet are lost."""
    for folder in spark.__dict__.pop("_braidwork_made", []):
        delete(spark, folder)


def stored(df: DataFrame, name: str = "table", sort: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def steady(df: DataFrame) -> DataFrame:
    """df with rows that lie in the same partitions each time it is read, so that numbers by place can be joined back."""
    return stored(df, "steady") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more; it notices when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mapped(df: DataFrame, f: Callable[[list[dict]], Iterable[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow where f turns the columns of a batch, as Python lists, into columns of the result."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        for batch in batches:
            out = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, wanted)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8; lower maps A-Z alone. bytes.split() and bytes.lower() do just that."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


#: Odd multipliers of the word and n-gram hashes (fixed values).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * M3
        x = (x ^ (x >> np.uint64(29))) * M1
        return x ^ (x >> np.uint64(32))


class WordHash:
    """128-bit xxHash of words, remembered in a bounded dict."""

    def __init__(self, most: int = 300_000) -> None:
        import xxhash

        self.most, self.of = most, xxhash.xxh128_digest
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.halves, self.known = np.zeros((1024, 2), np.uint64), 0

    def both(self, found: list[bytes]) -> np.ndarray:
        """[words, 2] halves of the hashes."""
        if len(self.seen) > self.most:
            self.clear()
        seen, fresh, out = self.seen, [], []
        for w in found:
            i = seen.get(w)
            if i is None:
                i = seen[w] = len(seen)
                fresh.append(w)
            out.append(i)
        if fresh:
            end = self.known + len(fresh)
            if end > len(self.halves):
                self.halves = np.concatenate([self.halves, np.zeros((max(end, len(self.halves)), 2), np.uint64)])
            self.halves[self.known : end] = np.frombuffer(b"".join(map(self.of, fresh)), ">u8").reshape(-1, 2)
            self.known = end
        return self.halves[np.array(out, dtype=np.int64)]

    def __call__(self, found: list[bytes]) -> np.ndarray:
        """The first half alone."""
        return self.both(found)[:, 0]


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n neighbours in h, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = int(M1 if not seed else M2)
        power, out, done, block, width = 1, None, 0, mix(h, seed), 1
        # block[i] covers width words from i; out[i] covers done words from i.
        while True:
            if n & width:
                if out is None:
                    out, done = block, width
                else:
                    shift = np.uint64(pow(base, width, 1 << 64))
                    out = out[: len(block) - done] if len(out) > len(block) - done else out
                    out, done = out * shift + block[done : done + len(out)], done + width
            width *= 2
            if width > n:
                break
            shift = np.uint64(pow(base, width // 2, 1 << 64))
            block = block[: len(block) - width // 2] * shift + block[width // 2 :]
        return mix(out[: len(h) - n + 1], seed)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fold_of(doc_id: int | None) -> int:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
