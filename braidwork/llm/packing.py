"""Best-fit packing of tokenised documents after Martello and Toth's dominance reduction.

Sizes are whole numbers up to the capacity, so an instance is a histogram of at most
`capacity` counts, whatever the number of documents. The driver reduces and packs that
histogram; its plan, a list of runs of equal pieces put into runs of sequences, is bounded by
the capacity too. Pieces find their places by their rank among the pieces of their size.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, partitions, stored

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2


class Instance:
    """A histogram of sizes that is packed bottom up into a plan.

    plan rows: size, rank of the first piece, pieces, first sequence, offset in a sequence,
    pieces a sequence.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left, self.used = capacity, [0] * (capacity + 1), [0] * (capacity + 1)
        for size, n in counts.items():
            self.left[size] = n
        self.plan: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0

    def put(self, size: int, pieces: int, first: int, offset: int, each: int = 1) -> None:
        self.plan.append((size, self.used[size], pieces, first, offset, each))
        self.used[size] += pieces
        self.left[size] -= pieces

    def fix(self, sizes: list[int], times: int) -> None:
        """Close `times` sequences that hold these sizes."""
        offset = 0
        for s in sizes:
            self.put(s, times, self.sequences, offset)
            offset += s
        self.sequences += times
        self.fixed += times

    # -- the reduction ---------------------------------------------------------------

    def sizes(self) -> list[int]:
        return [s for s in range(1, self.capacity + 1) if self.left[s]]

    def dominating(self, j: int, sizes: list[int]) -> tuple[list[int], int] | None:
        """A set with a piece of size j that dominates every other such set, and how often it may be fixed.

        One set dominates another if the other's pieces can be dealt to some of its own so
        that none gets more than its size. sizes: those left, ascending.
        """
        left, room = self.left, self.capacity - j

        def largest(most: int, without: tuple[int, ...]) -> int:
            at = bisect_left(sizes, most + 1) - 1
            while at >= 0 and left[sizes[at]] <= without.count(sizes[at]):
                at -= 1
            return sizes[at] if at >= 0 else 0

        def smallest(n: int) -> list[int]:
            out: list[int] = []
            for s in sizes:
                out += [s] * min(left[s] - (s == j), n - len(out))
                if len(out) >= n:
                    break
            return out

        k = largest(room, (j,))
        if not k:
            return [j], left[j]
        pair = [j, k], (left[j] // 2 if j == k else min(left[j], left[k]))
        if k == room:  # whatever else fits adds up to k at most
            return pair
        few = smallest(3)
        if len(few) < 2 or few[0] + few[1] > room:  # only single pieces fit, and k is the largest
            return pair
        if len(few) < 3 or sum(few) > room:  # single pieces and pairs fit
            best = 0
            for p in sizes:
                if p > room:
                    break
                if left[p] > (p == j) and (q := largest(room - p, (j, p))):
                    best = max(best, p + q)
            if k >= best:
                return pair
            b = largest(room - k, (j, k))
            if b:  # in any pair p >= q that fits: p <= k; and q <= b unless two pieces over b fit
                over = bisect_left(sizes, b + 1)
                if over == len(sizes) or 2 * sizes[over] > room:
                    need = {s: [j, k, b].count(s) for s in (j, k, b)}
                    return [j, k, b], min(left[s] // n for s, n in need.items())
        return None

    def reduce(self) -> None:
        """Fix dominating sets, from the largest size down, until a whole pass finds none."""
        while True:
            before = self.fixed
            for j in range(self.capacity, 0, -1):
                while self.left[j] and (found := self.dominating(j, self.sizes())) and found[1]:
                    self.fix(*found)
            if self.fixed == before:
                return

    # -- best fit --------------------------------------------------------------------

    def best_fit(self) -> None:
        """Best fit, sizes descending, on runs of sequences that look alike."""
        open_: dict[int, list[tuple[int, int]]] = {}
        for s in range(self.capacity, 0, -1):
            room = s
            while self.left[s]:
                while room <= self.capacity and not open_.get(room):
                    room += 1
                if room > self.capacity:
                    room = self.capacity
                    each = room // s
                    first, n = self.sequences, -(-self.left[s] // each)
                    self.sequences += n
                else:
                    first, n = open_[room].pop()
                each = room // s
                whole = min(n, self.left[s] // each)
                rest = min(self.left[s] - whole * each, each - 1) if whole < n else 0
                offset = self.capacity - room
                if whole:
                    self.put(s, whole * each, first, offset, each)
                    open_.setdefault(room - each * s, []).append((first, whole))
                if rest:
                    self.put(s, rest, first + whole, offset, rest)
                    open_.setdefault(room - rest * s, []).append((first + whole, 1))
                if n > whole + bool(rest):
                    open_.setdefault(room, []).append((first + whole + bool(rest), n - whole - bool(rest)))


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Instance:
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    out = Instance(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


# -- tokens ----------------------------------------------------------------------------


@lru_cache(2)
def encoder(path: str, pattern: str):  # noqa: ANN201
    """Text to ids as the tokenizer file has it, by the quicker of two libraries that share its merges.

    The quicker one merges by the ids' order. If the file's merges don't come in that order, the
    library that reads them is taken. The file's added tokens stand for themselves wherever
    their strings occur.
    """
    import re

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if made != sorted(made):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(chars)))}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def ids(text: str) -> list[int]:
        if cut is None or not cut.search(text):
            return encode(text)
        out, at = [], 0
        for m in cut.finditer(text):
            out += [*encode(text[at : m.start()]), added[m[0]]]
            at = m.end()
        return out + encode(text[at:])

    return ids


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece of a document: piece, start, length, ids_crc32. The first piece of a long document takes what is over."""

    def run(batch: dict) -> dict:
        ids_of, out = encoder(path, pattern), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = np.array([*ids_of(text or ""), end_id], dtype="<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            if len(ids) < capacity:
                cuts = [0, len(ids)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for k, x in zip(out, (doc_id, i, a, b - a, crc32(ids[a:b].tobytes())), strict=True):
                    out[k].append(x)
        return out

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into few sequences: per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs has doc_id and text; other columns are ignored. A null or empty text is the end id
    alone; a very long one is encoded whole by one task and cut. Documents with one id, repeated rows among them, are packed each by itself. An
    empty table gives an empty result. Pieces of one size are alike: ties go by doc_id and piece.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, pattern, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each size, capacity at most
    plan = np.array(sorted(solve(counts, capacity).plan), dtype=np.int64).reshape(-1, 6)

    # Rank among the pieces of a size, dealt over as many groups as there are partitions, so that a common size is no hot key.
    dealt = cut.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_deal").agg(F.count("*").alias("n")).select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_deal").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("_own", own).join(base, ["length", "_deal"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_own") - 1).alias("_rank"))

    keys = plan[:, 0] << 44 | plan[:, 1]

    def place(batch: dict) -> dict:
        size, rank = (np.array(batch[k], dtype=np.int64) for k in ("length", "_rank"))
        row = plan[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
        within = rank - row[:, 1]
        return batch | {"sequence_id": row[:, 3] + within // row[:, 5], "offset": row[:, 4] + within % row[:, 5] * size}

    return mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
