"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Learned filters run
over the embedded bytes of each chunk and are max-pooled; a hidden layer reads the pooled
filters; the chunks' hidden values are combined by maximum and mean into one probability.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mapped
from .labelled import sample

CHUNK, STEP = 256, 192
#: Bytes of a filter and between two places of it; sizes of embedding, filters, hidden layer.
WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 8, 4, 8, 32, 24
#: In training a document shows so many of its chunks, drawn anew each time; in blocks of chunks, documents are scored.
SHOWN, BLOCK = 24, 512


def chunks(text: str) -> np.ndarray:
    """All bytes of a text in overlapping chunks; the last is filled up with zeros."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, over: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(over)).astype(np.float32)

        self.p = {
            "e": normal(256, DIM, over=1),
            "w": normal(WIDTH * DIM, FILTERS, over=WIDTH * DIM),
            "c": np.zeros(FILTERS, np.float32),
            "u": normal(FILTERS, HIDDEN, over=FILTERS),
            "d": np.zeros(HIDDEN, np.float32),
            "v": normal(2 * HIDDEN, over=2 * HIDDEN),
            "b": np.zeros(1, np.float32),
        }
        self.p["e"][0] = 0

    def windows(self, block: np.ndarray) -> np.ndarray:
        """[chunks, places, WIDTH] byte values."""
        return sliding_window_view(block, WIDTH, axis=1)[:, ::STRIDE]

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, at = self.p, self.windows(block)
        x = p["e"][at].reshape(-1, WIDTH * DIM)
        z = (x @ p["w"]).reshape(*at.shape[:2], FILTERS)
        best = z.argmax(1)
        return np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + p["c"], 0), best, at

    def hidden(self, block: np.ndarray) -> np.ndarray:
        """Of each chunk; the best place isn't needed here."""
        p = self.p
        out = np.empty((len(block), HIDDEN), np.float32)
        for i in range(0, len(block), BLOCK):
            part = block[i : i + BLOCK]
            table = sliding_window_view(p["e"][part].reshape(len(part), CHUNK * DIM), WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
            z = (np.ascontiguousarray(table).reshape(-1, WIDTH * DIM) @ p["w"]).reshape(len(part), -1, FILTERS)
            out[i : i + BLOCK] = np.maximum(np.maximum(z.max(1) + p["c"], 0) @ p["u"] + p["d"], 0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [chunks(t) for t in texts]
        starts = np.cumsum([0, *(len(x) for x in parts)])
        if not len(parts):
            return np.zeros(0)
        h = self.hidden(np.concatenate(parts))
        top = np.maximum.reduceat(h, starts[:-1])
        mean = np.add.reduceat(h, starts[:-1]) / np.diff(starts)[:, None]
        s = np.concatenate([top, mean], 1).astype(np.float64) @ self.p["v"].astype(np.float64) + float(self.p["b"][0])
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    def gradients(self, block: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(starts)
        pool, best, at = self.pooled(block)
        h = np.maximum(pool @ p["u"] + p["d"], 0)
        of = np.repeat(np.arange(len(n)), n)
        top = np.maximum.reduceat(h, starts[:-1])
        feat = np.concatenate([top, np.add.reduceat(h, starts[:-1]) / n[:, None]], 1)
        s = feat @ p["v"] + p["b"]
        ds = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * weight).astype(np.float32)
        g = {"v": feat.T @ ds, "b": ds.sum(keepdims=True)}
        df = ds[:, None] * p["v"]
        dh = (df[:, HIDDEN:] / n[:, None])[of] + df[of, :HIDDEN] * (h >= top[of])
        dh *= h > 0
        g["u"], g["d"] = pool.T @ dh, dh.sum(0)
        dp = (dh @ p["u"].T) * (pool > 0)
        g["c"] = dp.sum(0)
        # Only the best place of each filter in each chunk has a gradient.
        k, f = np.nonzero(dp)
        value, seen = dp[k, f], at[k, best[k, f]]
        x = p["e"][seen].reshape(len(k), -1)
        g["w"] = np.stack([value[f == j] @ x[f == j] for j in range(FILTERS)], 1)
        de = (value[:, None] * p["w"].T[f]).reshape(-1, DIM)
        flat = seen.reshape(-1)
        g["e"] = np.stack([np.bincount(flat, de[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
        g["e"][0] = 0
        return g


def fit(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 4e-3, batch: int = 48, seed: int = 0) -> Network:
    """Adam on the logistic loss, both classes with equal weight. Without rows of both classes all scores are 0.5."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["v"][:] = 0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    parts = [chunks(t) for t in texts]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows = order[i : i + batch]
            shown = [parts[r] if len(parts[r]) <= SHOWN else parts[r][rng.choice(len(parts[r]), SHOWN, replace=False)] for r in rows]
            starts = np.cumsum([0, *(len(s) for s in shown)])
            g = net.gradients(np.concatenate(shown), starts, y[rows], weight[rows] / len(rows))
            step += 1
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                net.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def score(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """docs with quality_score: the probability that a text has label 1.

    docs has doc_id and text and keeps its columns (one named quality_score is replaced).
    The network is fitted on the driver from at most 2 * labelled.EACH rows (see sample());
    labels, source and doc_id are no inputs of it. In a training step a longer document shows
    SHOWN of its chunks, drawn anew each time; scores read all of them, of very long texts too.
    A null text scores like an empty one.
    Repeated rows score alike; without labels of both classes all score 0.5; an empty table
    gives an empty result.
    """
    net = fit(*sample(docs, labels, "quality", **how))
    return with_scores(docs, "quality_score", lambda: net)


def with_scores(docs: DataFrame, name: str, model) -> DataFrame:  # noqa: ANN001
    """Adds a column from model().scores(texts); the other columns pass by as they are."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    from .common import BATCH_ROWS

    kept = docs.drop(name)
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    at = kept.columns.index("text")

    def run(batches):  # noqa: ANN001, ANN202
        made = model()
        for b in batches:
            scores = made.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, type=pa.float64())], names=[*b.schema.names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Per document doc_id, held_out, score, predicted (score >= least)."""
    rows = score(docs.select("doc_id", "text"), labels)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= least).cast("int").alias("predicted"))
