"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts a word's class from the one before: a context matrix maps the previous
class to a vector, whose products with all classes' vectors, plus biases, are log-odds that a
softmax normalises. The commonest words are classes of their own. The other words of the head
(at most HEAD words) are dealt to clusters, about as many as the square root of their number,
that are classes too; each such word has a vector as a context, and within its cluster a
second log-bilinear level with its own vector, bias and softmax predicts it from the class
before. Words outside the head share one class, and within it a word has its smoothed share of
the training tokens. So every text's probability is properly normalised over an open vocabulary.

Counts of words and of neighbours come from all training documents. The first level is trained
on the class counts: each of the PASSES goes over all cells, so each neighbour pair weighs as
often as it occurs in the corpus. Given its vectors the words of a cluster are independent
of each other's clusters, so the executors fit cluster by cluster, on all counts of their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, fold, partitions, steady, stored, words

#: The end token: no word, as words hold no white space.
END = b"\n"
#: Classes with the shared one and without clusters; words whose counts each task gets; words that a counting task holds before it lets go.
CLASSES, HEAD, HELD = 1024, 200_000, 300_000
#: Numbers in a vector; passes over all cells of the class counts; passes over a cluster's; neighbours that a counting task holds.
DIM, PASSES, WORD_PASSES, HELD_PAIRS = 24, 400, 6, 4_000_000
NOISE = 8


class LogBilinear:
    """log P(class | previous class) from products of vectors."""

    def __init__(self, pairs: np.ndarray, dim: int = DIM, noise: int = NOISE, passes: int = PASSES, rate: float = 0.05, seed: int = 0) -> None:
        """pairs[previous, class]: counts over the training corpus. Noise comes from the classes' own distribution.

        Each pass takes every cell with its whole count, and the noise by its expectation
        instead of draws, so nothing is sampled and the work doesn't grow with the counts.
        Steps are Adam's, whose size doesn't shrink with a row's share, so rare classes move
        too; a normal prior on the vectors weighs as much as one pair.

        The biases start at the log of that distribution, the vectors near zero, so training
        starts from the unigram model; normalising constants are taken as one in training, as
        noise-contrastive estimation allows, and computed in full afterwards.
        """
        rng = np.random.default_rng(seed)
        k = len(pairs)
        total = pairs.sum()
        share = (pairs.sum(0) + 0.5) / (total + 0.5 * k)
        context, out, bias = rng.normal(0, 0.05, (k, dim)), rng.normal(0, 0.05, (k, dim)), np.log(share)
        if total > 0 and k > 1:
            data = pairs / total
            other = noise * data.sum(1)[:, None] * share
            lift = np.log(noise * share)
            params = (context, out, bias)
            mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
            for step in range(passes):
                on = 1 / (1 + np.exp(np.clip(lift - bias - context @ out.T, -30, 30)))
                pull = data - (data + other) * on
                grads = (pull @ out - context / total, pull.T @ context - out / total, pull.sum(0))
                now = rate * (1 - step / passes) * math.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
                for x, g, m, s in zip(params, grads, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    x += now * m / (np.sqrt(s) + 1e-15)
        self.context, self.out, self.bias = (x.astype(np.float32) for x in (context, out, bias))
        logits = context @ out.T + bias
        top = logits.max(1, keepdims=True)
        self.log10 = ((logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))) / math.log(10)).astype(np.float32)


def word_vectors(data: np.ndarray, other: np.ndarray, shift: np.ndarray, basis: np.ndarray, start: np.ndarray, passes: int = WORD_PASSES) -> np.ndarray:
    """A vector for each row of data, whose products with basis, plus shift, are log-odds against noise.

    data[row, cell]: counts; other: the noise's expected counts. Each pass climbs a quadratic
    lower bound of the noise-contrastive objective (the logistic curve bends by 1/4 at most),
    so none overshoots; a normal prior about start weighs as much as one pair.
    """
    dim = basis.shape[1]
    square = (basis[:, :, None] * basis[:, None, :]).reshape(len(basis), -1)
    weight = data + other
    inverse = np.linalg.inv((weight @ square).reshape(-1, dim, dim).astype(np.float64) / 4 + np.eye(dim)).astype(np.float32)
    v = start.copy()
    for _ in range(passes):
        pull = data - weight / (1 + np.exp(np.clip(-shift - v @ basis.T, -30, 30)))
        v += np.einsum("nij,nj->ni", inverse, pull @ basis - (v - start))
    return v


def _counts(docs: DataFrame) -> DataFrame:
    """word binary, n long over documents; tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(words(text, lower=True))
                held[END] += 1
            if len(held) >= HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _commonest(counted: DataFrame, most: int) -> pa.Table:
    """word, n of at most `most` words: all from the least count, on a scale of 64 steps for each doubling, that leaves no more."""
    step = F.floor(64 * F.log2(F.col("n").cast("double")) + 1e-9)
    sizes = sorted(((r.k, r.c) for r in counted.groupBy(step.alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for k, c in sizes:
        held += c
        if held > most:
            break
        least = k
    return counted.where(step >= least if least is not None else F.lit(False)).select("word", "n").toArrow()


class Head:
    """The commonest words: class and count by word. What is left out of the classes has the class 0."""

    def __init__(self, table: pa.Table, classes: int) -> None:
        """table: word, n, in any order."""
        count = table.column("n").to_numpy()
        found = table.column("word").to_pylist()
        order = sorted(range(len(found)), key=lambda i: (-count[i], found[i]))
        self.index = {found[i]: k for k, i in enumerate(order)}
        self.count = count[np.array(order, dtype=np.int64)]
        self.own = min(classes - 1, len(order))
        rest = len(order) - self.own
        self.clusters = math.isqrt(rest - 1) + 1 if rest else 0
        self.classes = 1 + self.own + self.clusters
        # Clusters take turns, so each holds common and rare words and they are of one size.
        turn = np.arange(rest) % max(self.clusters, 1)
        self.class_of = np.concatenate([np.arange(1, self.own + 1), 1 + self.own + turn]).astype(np.int64)

    def places(self, found: list[bytes]) -> np.ndarray:
        """Index of each word, -1 for those that aren't in the head."""
        get = self.index.get
        return np.array([get(w, -1) for w in found], dtype=np.int64)

    def class_ids(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.class_of[places], 0) if len(self.class_of) else np.zeros(len(places), np.int64)


def _pairs(docs: DataFrame, head: Head) -> tuple[np.ndarray, DataFrame]:
    """Counts of neighbouring classes, and of the clusters' words with the classes beside them; a text starts after an end token, if that is in the head.

    The table has g (twice the cluster, and 1 more where the class is before the word; below 0 for
    neighbouring classes), m, and packed m gaps between cells and m counts (see unpacked()). A
    cell is the class and, as a multiple of the classes, the word's place in its cluster.
    """
    k, own, m = head.classes, head.own, max(head.clusters, 1)
    end = head.places([END])
    span = -(-k * k // 64)  # cells of neighbouring classes that one row has
    rest = np.arange(len(head.count) - own)
    size = (-(-len(rest) // m) + 1) * k
    first = np.concatenate([np.zeros(own, np.int64), rest % m * 2 * size + rest // m * k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            g, at = np.unique(key // size, return_index=True)
            edge = [*at.tolist(), len(key)]
            return made([(int(x), key[i:j] - x * size, n[i:j]) for x, i, j in zip(g, edge, edge[1:])])

        def made(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            sides = [pa.array([r[0] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int32())]
            sides += [pa.array([packed(np.diff(r[1], prepend=0)) for r in rows], pa.binary()), pa.array([packed(r[2]) for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(sides, names=["g", "m", "gaps", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                at = np.concatenate([end, head.places(words(text, lower=True)), end])
                c = head.class_ids(at)
                np.add.at(total, c[:-1] * k + c[1:], 1)
                before, after = at[:-1] >= own, at[1:] >= own
                held.append(first[at[:-1][before]] + c[1:][before])
                held.append(first[at[1:][after]] + size + c[:-1][after])
            if sum(map(len, held)) >= HELD_PAIRS:
                yield out()
        if sum(map(len, held)):
            yield out()
        cell = np.flatnonzero(total)
        edge = np.searchsorted(cell, np.arange(0, k * k + span, span)).tolist()
        rows = [(-1 - x, cell[i:j] - x * span, total[cell[i:j]]) for x, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
        if rows:
            yield made(rows)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for g, m, gaps, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cell, add = unpacked(m, gaps, n)
                held.setdefault(g, np.zeros(span, np.int64))[cell] += add
        for g, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["g", "n"])

    found = stored(docs.select("text").mapInArrow(run, "g int, m int, gaps binary, n binary"), "pairs")
    out = np.zeros(k * k + span, np.int64)
    blocks = found.where("g < 0").repartition(partitions(docs.sparkSession), "g").mapInArrow(summed, "g int, n binary").toArrow()
    for g, n in zip(*(c.to_pylist() for c in blocks.columns), strict=True):
        out[(-1 - g) * span : -g * span] = np.frombuffer(n, "<i8")
    return out[: k * k].reshape(k, k), found.where("g >= 0")


def packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if int(x.max()) < 1 << 8 * int(t[2]))).tobytes()


def unpacked(m: int, gaps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order and their counts."""
    return np.cumsum(np.frombuffer(gaps, f"<u{len(gaps) // m}").astype(np.int64)), np.frombuffer(n, f"<u{len(n) // m}").astype(np.int64)


class Words:
    """Vectors of the clusters' words: context and its log normaliser, output with bias, and each cluster's log normaliser after each class."""

    def __init__(self, cells: DataFrame, pairs: np.ndarray, model: LogBilinear, head: Head) -> None:
        own, m, k = head.own, head.clusters, head.classes
        rest = len(head.count) - own
        count = head.count[own:].astype(np.float64)
        context, out, bias = model.context, model.out, model.bias
        share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
        lift = (bias - np.log(NOISE * share)).astype(np.float32)
        self.own, self.clusters = own, m
        self.context, self.norm = np.zeros((rest, DIM), np.float32), np.zeros(rest, np.float32)
        self.out, self.norms = np.zeros((rest, DIM + 1), np.float32), np.zeros((k, m), np.float32)
        into = pairs[:, own + 1 :]

        def fit(g: int, data: np.ndarray) -> tuple[bytes, bytes]:
            cluster = count[g // 2 :: m]
            if g % 2 == 0:  # words as contexts of the class after them
                start = np.repeat(context[own + 1 + g // 2][None], len(cluster), 0)
                v = word_vectors(data, (NOISE * data.sum(1)[:, None] * share).astype(np.float32), lift, out, start)
                logits = v @ out.T + bias
                norm = logits.max(1) + np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1))
            else:  # words after a class, among those of their cluster
                q = (cluster + 0.5) / (cluster + 0.5).sum()
                basis = np.concatenate([context, np.ones((k, 1), np.float32)], 1)
                start = np.zeros((len(cluster), DIM + 1), np.float32)
                start[:, -1] = np.log(q)
                shift = -np.log(NOISE * q).astype(np.float32)[:, None]
                v = word_vectors(data, (NOISE * q[:, None] * into[:, g // 2]).astype(np.float32), shift, basis, start)
                logits = basis @ v.T
                norm = logits.max(1) + np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1))
            return v.astype("<f4").tobytes(), norm.astype("<f4").tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come ordered by g; one cluster's counts are held at a time."""
            now, data = None, np.zeros(0, np.int64)

            def out() -> pa.RecordBatch:
                v, norm = fit(now, data.reshape(-1, k).astype(np.float32))
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([v], pa.binary()), pa.array([norm], pa.binary())], names=["g", "v", "norm"])

            for b in batches:
                for g, size, gaps, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if g != now:
                        if now is not None:
                            yield out()
                        now, data = g, np.zeros(len(count[g // 2 :: m]) * k, np.int64)
                    cell, add = unpacked(size, gaps, n)
                    data[cell] += add
            if now is not None:
                yield out()

        spark = cells.sparkSession
        dealt = cells.repartition(partitions(spark), "g").sortWithinPartitions("g") if m else None
        found = dealt.mapInArrow(run, "g int, v binary, norm binary").toArrow() if m else None
        for g, v, norm in zip(*(c.to_pylist() for c in found.columns), strict=True) if m else ():
            if g % 2 == 0:
                self.context[g // 2 :: m] = np.frombuffer(v, "<f4").reshape(-1, DIM)
                self.norm[g // 2 :: m] = np.frombuffer(norm, "<f4")
            else:
                self.out[g // 2 :: m] = np.frombuffer(v, "<f4").reshape(-1, DIM + 1)
                self.norms[:, g // 2] = np.frombuffer(norm, "<f4")
        self.classes = (context, out, bias, model.log10)

    def logs(self, before: np.ndarray, c_before: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, of those outside the head without their share. before, at: places of the token before and of the token."""
        context, out, bias, table = self.classes
        got = table[c_before, c].astype(np.float64)
        i = np.flatnonzero(before >= self.own)
        w = before[i] - self.own
        got[i] = (np.einsum("nd,nd->n", self.context[w], out[c[i]]) + bias[c[i]] - self.norm[w]) / math.log(10)
        i = np.flatnonzero(at >= self.own)
        w, a = at[i] - self.own, c_before[i]
        got[i] += (np.einsum("nd,nd->n", self.out[w, :-1], context[a]) + self.out[w, -1] - self.norms[a, w % max(self.clusters, 1)]) / math.log(10)
        return got


def scores(docs: DataFrame, held_out_fold: int = 1, classes: int = CLASSES, head_words: int = HEAD) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs has doc_id and text; other columns are ignored. A null text is empty: its one token
    is the end. Rows whose fold is held_out_fold teach nothing. Tokens, with A-Z
    lower-cased, are words and an end; base_score is the smoothed unigram log10 probability,
    score the model's. Repeated rows teach and score each by itself. An empty table gives an
    empty result; without training rows both scores of each text are 0. Very long texts are
    scored whole, and a null id is in the fold of empty text.

    The head_words commonest words go to every task with their counts and vectors (bounded
    tables); the other words of a document find their counts by a join.
    """
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    docs = steady(docs.select("doc_id", "text"))
    train = docs.where(fold(F.col("doc_id")) != held_out_fold)
    counted = stored(_counts(train), "words")
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, types = sums.n, sums.v
    head = Head(_commonest(counted, head_words), classes)
    pairs, cells = _pairs(train, head)
    end = head.places([END])
    model = Words(cells, pairs, LogBilinear(pairs), head)
    tail_sum, tail_types = total - int(head.count.sum()), types - len(head.count)
    base_log = math.log10(total + 0.5 * (types + 1))
    tail_log = math.log10(tail_sum + 0.5 * (tail_types + 1))
    head_log = np.log10(head.count + 0.5)
    unseen = math.log10(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with a key that no word has, and one for each of its other words."""
        names = ["uid", "doc_id", "word", "tf", "n_tokens", "known", "base", "score"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for b in batches:
            rows: list[tuple] = []
            for uid, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = [*words(text, lower=True), END]
                at = head.places(found)
                c = head.class_ids(at)
                inside = at[at >= 0]
                before = np.concatenate([end, at[:-1]])
                score = float(model.logs(before, head.class_ids(before), at, c).sum()) - tail_log * int((at < 0).sum())
                base = float(head_log[inside].sum()) - base_log * len(found)
                rows.append((uid, doc_id, b" %d" % uid, 0, len(found), len(inside), base, score))
                for w, tf in Counter([found[i] for i in np.flatnonzero(at < 0)]).items():
                    rows.append((uid, doc_id, w, tf, 0, 0, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    parts = rows.mapInArrow(run, "uid long, doc_id long, word binary, tf long, n_tokens long, known long, base double, score double")
    rest = counted.select("word", F.col("n").alias("_n"))
    joined = parts.join(rest, "word", "left")
    log = F.when(F.col("tf") > 0, F.col("tf") * F.coalesce(F.log10(F.col("_n") + 0.5), F.lit(unseen))).otherwise(0.0)
    known = F.when(F.col("_n").isNotNull(), F.col("tf")).otherwise(0)
    whole = joined.groupBy("uid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("known") + known).alias("n_known"), F.sum(F.col("base") + log).alias("base_score"), F.sum(F.col("score") + log).alias("score")
    )
    return whole.select("doc_id", (fold(F.col("doc_id")) == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
