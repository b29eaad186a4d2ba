"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, of every
text alike. So the sketch of a union is the union of the sketches, and the share of one sketch
found in another estimates containment however unequal the documents are. A text is read
between marks of its beginning and end, so that its outer code points are in as many shingles as
the inner ones, and a short text has as many shingles as WIDTH at least.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, M1, mix, partitions, stored

#: Code points of a shingle, and the kept fraction (one in SCALE).
WIDTH, SCALE = 12, 8
#: Rows that one deal of neighbouring documents holds, about; deals for each shuffle partition, at most.
DEAL_ROWS, DEALS_EACH = 2000, 16
RANGE = 1 << 32
#: What stands before and after a text: no code point.
MARK = np.uint64(0x110000)


def points(text: str) -> np.ndarray:
    """A text's code points between WIDTH - 1 marks on either side; an empty text has none."""
    inner = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    side = np.full(WIDTH - 1, MARK)
    return np.concatenate([side, inner, side]) if len(inner) else inner


def run_hashes(p: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of WIDTH points."""
    n = len(p) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        total = p[:n].copy()
        for j in range(1, WIDTH):
            total *= M1
            total += p[j : j + n]
    return (mix(total) >> np.uint64(32)).astype(np.uint32)


def shingle_hashes(text: str) -> np.ndarray:
    return run_hashes(points(text))


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sorted distinct hashes below the threshold."""
    return np.unique(hashes[hashes < RANGE // scale])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; an empty sketch is in every one."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merged(sketches: Iterable[np.ndarray]) -> np.ndarray:
    """The sketch of all the texts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *sketches]))


def text_of(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u4").tobytes()).decode()


def of_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last quarter of text's code points (rounded down) gives way to the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(doc_id: int | None, text: str, mine: np.ndarray, hashes: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    keep = len(text) - len(text) // 4  # as many shingles end before the edit
    new = sketch(np.concatenate([hashes[:keep], run_hashes(points(changed)[keep:])]))
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(mine), text_of(new), likeness(mine, new), likeness(mine, theirs)


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in NAMES[2:5]), *((n, pa.float64()) for n in NAMES[5:])])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered within each deal; each is compared with the one after it, but for a deal's last."""
    deal, before = None, None
    for batch in batches:
        rows = []
        for d, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = shingle_hashes(text)
            mine = sketch(hashes)
            if before is not None and deal == d:
                rows.append(_row(*before, text, mine))
            deal, before = d, (doc_id, text, mine, hashes)
        if rows:
            yield _table(rows)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = shingle_hashes(text)
            rows.append(_row(doc_id, text, sketch(hashes), hashes, following, sketch(shingle_hashes(following))))
        if rows:
            yield _table(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, its edited text's, and how alike they and the next document's are.

    docs has doc_id and text; other columns are ignored. A null text is empty and has an
    empty fingerprint, like another empty one (1.0) and unlike all else (0.0); of a text of few
    code points no hash may be below the threshold, and then its fingerprint is empty too. Very
    long texts are read whole. Documents are ordered by doc_id and then text, null ids first;
    the last is followed by the first, a single one by itself. Every row of repeated rows
    counts. An empty table gives an empty result.

    Documents are dealt by ranges of doc_id, so that texts move once; the last of each deal
    is followed by the first of the next, and only these borders are brought together, by the deals' numbers.
    """
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.select(F.count("*").alias("n")).first().n
    deals = max(1, min(n // DEAL_ROWS, DEALS_EACH * partitions(spark)))
    cuts = [] if deals == 1 else sorted(set(rows.select(F.percentile_approx("doc_id", [i / deals for i in range(1, deals)], 20 * deals).alias("c")).first().c or []))
    # The cuts are values, so a recomputed task deals the rows as before.
    deal = F.lit(0)
    if cuts:  # how many cuts aren't over the id, by halving
        fits = lambda at, step: (at + step <= len(cuts)) & (F.get(F.lit(cuts), at + step - 1) <= F.col("doc_id"))
        at = F.aggregate(F.lit(_halves(len(cuts))), F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))
        deal = F.when(F.col("doc_id").isNull(), 0).otherwise(at)
    dealt = rows.select(deal.alias("deal"), "doc_id", "text")
    inner = dealt.repartition(max(partitions(spark), 1), "deal").sortWithinPartitions("deal", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)

    ends = stored(dealt.groupBy("deal").agg(F.min(F.struct("doc_id", "text")).alias("first"), F.max(F.struct("doc_id", "text")).alias("last")), "ends")
    used = sorted(r.deal for r in ends.select("deal").collect())  # DEALS_EACH for each partition at most
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "deal int, next int")
    following = ends.select(F.col("deal").alias("next"), F.col("first.text").alias("following"))
    linked = ends.select("deal", "last.doc_id", "last.text").join(after, "deal").join(following, "next")
    outer = linked.select("doc_id", "text", "following").mapInArrow(_borders, SCHEMA)
    return inner.unionByName(outer)


def _halves(n: int) -> list[int]:
    out = 1
    while out * 2 <= n:
        out *= 2
    return [out >> i for i in range(out.bit_length())]
