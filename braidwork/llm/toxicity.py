"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from labelled documents: a word, or its beginning, that toxic documents
hold often and clean ones hardly ever marks its tokens there. The field has two states, a
weight for each word and beginning of a word, and weights between neighbouring states. A
document's forward-backward marginals give its offending spans; their largest and their sum
give its score by a logistic curve that is fitted on the documents' labels.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mapped
from .labelled import sample, share

TOKEN = re.compile(r"\w+")
#: A feature marks tokens toxic if so many toxic documents hold it (at least, and as a share), and no more than CLEAN_SHARE as many clean ones.
LEAST, LEAST_SHARE, CLEAN_SHARE = 5, 0.015, 0.02
#: Lengths of the beginnings; tokens of a training segment and of a block; words that a worker remembers.
PREFIXES, SEGMENT, BLOCK, MOST_WORDS = (4, 5), 64, 64, 300_000
#: Of a training document's segments without a marked token every so manieth teaches; those with one all do.
CLEAN_EVERY = 4


def features(word: str) -> list[str]:
    """Of a token: itself, lower-cased, and its beginnings, marked by their length."""
    w = word.lower()
    return [w, *(f"{n}:{w[:n]}" for n in PREFIXES if len(w) >= n)]


def odds(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds and backward odds of state 1 along axis 0, for sequences of one length.

    emission: exp of state 1's score over state 0's; trans[a, b]: exp of the score from a to b.
    """
    fwd, bwd = np.empty_like(emission), np.ones_like(emission)
    fwd[0] = emission[0]
    for t in range(1, len(emission)):
        fwd[t] = emission[t] * (trans[0, 1] + trans[1, 1] * fwd[t - 1]) / (trans[0, 0] + trans[1, 0] * fwd[t - 1])
    for t in range(len(emission) - 2, -1, -1):
        on = emission[t + 1] * bwd[t + 1]
        bwd[t] = (trans[1, 0] + trans[1, 1] * on) / (trans[0, 0] + trans[0, 1] * on)
    return fwd, bwd


class Field:
    """Weights of the chain, and the curve from marginals to a document's score."""

    def __init__(self) -> None:
        self.bias, self.weight, self.trans, self.curve = 0.0, {}, np.zeros((2, 2)), np.zeros(3)
        self.seen: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def emission(self, words: list[str]) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > MOST_WORDS:
            seen.clear()
        for w in words:
            x = seen.get(w)
            if x is None:
                get = self.weight.get
                x = seen[w] = min(max(self.bias + sum(get(f, 0.0) for f in features(w)), -25.0), 25.0)
            out.append(x)
        return np.array(out)

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """P(token is toxic) of every token, exactly.

        One forward or backward step maps odds x to (a + b x) / (c + d x). Documents are cut
        into blocks; the blocks' maps are composed side by side, the blocks of a document
        chained, and the steps within all blocks taken side by side again.
        """
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        per = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(per)])
        n = int(first[-1])
        if not n:
            return [np.zeros(0) for _ in docs]
        flat = np.ones(n * BLOCK)
        real = np.zeros(n * BLOCK, dtype=bool)
        for d, f, k in zip(docs, first, sizes, strict=False):
            flat[f * BLOCK : f * BLOCK + k] = np.exp(self.emission(d))
            real[f * BLOCK : f * BLOCK + k] = True
        e, real = flat.reshape(n, BLOCK).T.copy(), real.reshape(n, BLOCK).T
        t = np.exp(self.trans)

        def chained(steps: list[np.ndarray], start: np.ndarray, order: np.ndarray, firsts: np.ndarray) -> np.ndarray:
            """Odds at each block's entry. steps: a, b, c, d of the blocks' maps; order: blocks left for a document at each turn."""
            a, b, c, d = steps
            entry = np.empty(n)
            x, at = start, firsts
            left = per.copy()
            while True:
                live = left > 0
                if not live.any():
                    return entry
                i = at[live]
                entry[i] = x[live]
                x[live] = (a[i] + b[i] * x[live]) / (c[i] + d[i] * x[live])
                at = at + order
                left = left - 1

        def composed(maps: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
            a, b, c, d = (np.full(n, v, dtype=float) for v in (0, 1, 1, 0))
            for p, q, r, s in maps:  # y = (p + q x) / (r + s x) after x = (a + b z) / (c + d z)
                a, b, c, d = p * c + q * a, p * d + q * b, r * c + s * a, r * d + s * b
                top = np.maximum(np.maximum(a, b), np.maximum(c, d))
                a, b, c, d = a / top, b / top, c / top, d / top
            return [a, b, c, d]

        one, zero = np.ones(n), np.zeros(n)

        def masked(k: int, p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            m = real[k]
            return np.where(m, p, zero), np.where(m, q, one), np.where(m, r, one), np.where(m, s, zero)

        forward = [masked(k, e[k] * t[0, 1], e[k] * t[1, 1], one * t[0, 0], one * t[1, 0]) for k in range(BLOCK)]
        starts = first[:-1][per > 0]
        forward[0] = tuple(v.copy() for v in forward[0])
        for v, x in zip(forward[0], (e[0], zero, one, zero), strict=True):  # a document's first token has none before it
            v[starts] = x[starts]
        # b before token k from b after it: the odds of what follows, seen from k - 1.
        backward = [masked(k, one * t[1, 0], e[k] * t[1, 1], one * t[0, 0], e[k] * t[0, 1]) for k in range(BLOCK)]

        ones = np.ones(len(docs))
        x = chained(composed(forward), ones.copy(), np.int64(1), first[:-1].copy())
        fwd = np.empty((BLOCK, n))
        for k in range(BLOCK):
            p, q, r, s = forward[k]
            x = fwd[k] = (p + q * x) / (r + s * x)
        x = chained(composed(backward[::-1]), ones.copy(), np.int64(-1), first[1:] - 1)
        out = np.empty((BLOCK, n))
        for k in range(BLOCK - 1, -1, -1):
            on = fwd[k] * x
            out[k] = on / (1 + on)
            p, q, r, s = backward[k]
            x = (p + q * x) / (r + s * x)
        flat = out.T.reshape(-1)
        return [flat[f * BLOCK : f * BLOCK + k] for f, k in zip(first, sizes, strict=False)]

    @staticmethod
    def summary(m: np.ndarray) -> tuple[float, float, float]:
        return (1.0, float(m.max()), float(np.log1p(m.sum()))) if len(m) else (1.0, 0.0, 0.0)

    def document(self, marginals: list[np.ndarray]) -> np.ndarray:
        s = np.array([self.summary(m) for m in marginals]).reshape(-1, 3) @ self.curve
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def marking(docs: list[list[str]], labels: list[int]) -> set[str]:
    """The features that mark toxic tokens."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    once = {tuple(d): y for d, y in zip(docs, labels, strict=True)}  # copies count once
    for d, y in once.items():
        count[y].update({f for w in set(d) for f in features(w)})
    clean, toxic = sum(1 - y for y in once.values()), sum(once.values())
    return {f for f, n in count[1].items() if n >= max(LEAST, LEAST_SHARE * toxic) and count[0][f] * toxic <= CLEAN_SHARE * n * max(clean, 1)}


def fit(texts: list[str], labels: list[int], prior: float = 0.5, rounds: int = 60, rate: float = 0.4, decay: float = 1e-6) -> Field:
    """Ascend the chain's conditional log-likelihood (Adagrad, whole batches), then fit the curve.

    prior: the share of toxic documents where scores will be made, as both classes weigh the same here.
    The chain learns from all segments that hold a marked token and one in CLEAN_EVERY of the others;
    toxic documents without any marked token (see marking(): rarer words aren't marked) teach it nothing,
    as nobody knows which of their tokens are toxic. The curve is fitted on whole documents, all of them.

    Without documents of both classes all scores are 0.5.
    """
    out = Field()
    docs = [TOKEN.findall(t) for t in texts]
    if len(set(labels)) < 2:
        return out
    marks = marking(docs, labels)
    rows, truth = [], []
    for d, y in zip(docs, labels, strict=True):
        tags = [int(y and not marks.isdisjoint(features(w))) for w in d]
        if y and not any(tags):
            continue  # nothing is known of its tokens
        for i in range(0, len(d), SEGMENT):
            if any(tags[i : i + SEGMENT]) or (i // SEGMENT) % CLEAN_EVERY == 0:
                rows.append(d[i : i + SEGMENT])
                truth.append(tags[i : i + SEGMENT])
    index: dict[str, int] = {}
    n, width = len(rows), 1 + len(PREFIXES)
    seen = Counter(f for r in rows for w in r for f in features(w))
    cells = np.zeros((SEGMENT, n, width), dtype=np.int64)
    y, real = np.zeros((SEGMENT, n), dtype=np.int64), np.zeros((SEGMENT, n), dtype=bool)
    for i, (r, tags) in enumerate(zip(rows, truth, strict=True)):
        real[: len(r), i], y[: len(r), i] = True, tags
        for k, w in enumerate(r):
            for j, f in enumerate(features(w)):
                if seen[f] >= 3:
                    cells[k, i, j] = index.setdefault(f, len(index) + 1)
    weight, bias, trans = np.zeros(len(index) + 1), -4.0, np.zeros((2, 2))
    sums = [np.full_like(weight, 1e-3), 1e-3, np.full((2, 2), 1e-3)]
    total = real.sum()
    pair = real[1:]
    for _ in range(rounds):
        weight[0] = 0
        e = np.exp(np.clip(np.where(real, bias + weight[cells].sum(2), 0), -25, 25))
        t = np.exp(trans)
        fwd, bwd = odds(e, t)  # what fills up short segments changes nothing before it but by a constant
        m = fwd * bwd / (1 + fwd * bwd)
        # P(y[t-1] = a, y[t] = b)
        joint = np.stack([t[0, 0] + 0 * fwd[1:], t[0, 1] * e[1:] * bwd[1:], fwd[:-1] * t[1, 0], fwd[:-1] * t[1, 1] * e[1:] * bwd[1:]])
        joint /= joint.sum(0)
        diff = np.where(real, y - m, 0)
        g = np.bincount(cells.reshape(-1), np.repeat(diff.reshape(-1), width), len(weight)) - decay * total * weight
        gold = y[:-1] * 2 + y[1:]
        gt = np.array([((gold == k) & pair).sum() - joint[k][pair].sum() for k in range(4)]).reshape(2, 2) - decay * total * trans
        for k, grad in enumerate((g, diff.sum(), gt)):
            sums[k] = sums[k] + grad * grad
        weight += rate * g / np.sqrt(sums[0])
        bias += rate * diff.sum() / np.sqrt(sums[1])
        trans += rate * gt / np.sqrt(sums[2])
    out.bias, out.trans = float(bias), trans
    out.weight = {f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-3}

    x = np.array([out.summary(m) for m in out.marginals(docs)])
    z = np.array(labels, dtype=float)
    share = np.where(z == 1, 0.5 / z.mean(), 0.5 / (1 - z.mean()))
    curve = np.zeros(3)
    for _ in range(30):  # Newton's method, slightly held back
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        curve += np.linalg.solve(h, x.T @ (share * (z - p)) - 0.05 * curve)
    curve[0] += np.log(prior / (1 - prior))
    out.curve = curve
    return out


def tag(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """Per row of docs: doc_id, toxic_score, toxic_spans (start, end in code points, p) of tokens with p >= 0.5.

    docs has doc_id and text; other columns are ignored. The field is fitted on the driver
    from at most 2 * labelled.EACH rows (see sample()); labels, lang, source and doc_id are no
    inputs of it. Very long texts are scored whole. A null text is an empty one: no spans, and the score that no toxic token
    gives. Repeated rows score alike; without labels of both classes all score 0.5; an empty
    table gives an empty result.
    """
    field = fit(*sample(docs, labels, "toxic", **how), prior=share(labels, "toxic"))

    def run(batch: dict) -> dict:
        texts = [t or "" for t in batch["text"]]
        marginals = field.marginals([TOKEN.findall(t) for t in texts])
        spans = []
        for t, m in zip(texts, marginals, strict=True):
            high = set(np.flatnonzero(m >= 0.5).tolist())
            spans.append([{"start": k.start(), "end": k.end(), "p": float(m[i])} for i, k in enumerate(TOKEN.finditer(t)) if i in high] if high else [])
        return {"doc_id": batch["doc_id"], "toxic_score": field.document(marginals), "toxic_spans": spans}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, toxic_score double, toxic_spans array<struct<start:int,end:int,p:double>>")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column toxic_score (one of that name is replaced); see tag()."""
    from .quality import with_scores

    field = fit(*sample(docs, labels, "toxic"), prior=share(labels, "toxic"))

    class Scores:
        @staticmethod
        def scores(texts: list[str]) -> np.ndarray:
            return field.document(field.marginals([TOKEN.findall(t) for t in texts]))

    return with_scores(docs, "toxic_score", Scores)


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document doc_id, held_out, score, predicted (score >= least), spans."""
    rows = tag(docs, labels)
    score = F.col("toxic_score")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= least).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))
