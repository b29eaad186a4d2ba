"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the prefix's encoding: the
candidate whose pairing with the last token of the remaining, shorter prefix would not be
merged differently. Storing that one token a prefix gives the encoding by walking back, an
exact append (older prefixes never change) and re-encoding from the edited byte on.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import mapped

#: Entries that a worker remembers of words, in two generations, and of token pairs before it starts anew.
MOST_WORDS, MOST_PAIRS = 500_000, 400_000


class Vocabulary:
    """Tokens by bytes, how each is put together, and which neighbours stay apart."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.apart_seen: dict[int, bool] = {}
        for b, i in ranks.items():
            if len(b) > 1 and (parts := self._parts(b, i)):
                self.halves[i] = parts
                self.joined[parts] = i

    def _parts(self, piece: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merge last into piece, from merging by rank below its own."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def apart(self, left: int, right: int) -> bool:
        """True if encoding left's bytes followed by right's gives just these two tokens.

        Undoes the later merge of the two sides again and again; a token that spans the
        border and would have merged before the border's sides were complete tells them false.
        """
        key = left << 20 | right
        joined, halves, limit, ok = self.joined, self.halves, 1 << 60, True
        while True:
            over = joined.get((left, right))
            if over is not None and over < limit:
                ok = False
                break
            # The side that was merged last is undone first: before it, its inner half faced the border.
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and left > right):
                left, limit = a[1], left
            else:
                right, limit = b[0], right + 1
        if len(self.apart_seen) >= MOST_PAIRS:
            self.apart_seen.clear()
        self.apart_seen[key] = ok
        return ok


class Prefixes:
    """The encoding of a growing byte string: last[i] ends the encoding of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last, self.start = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        v, done, last, start = self.vocabulary, len(self.data), self.last, self.start
        self.data = data = self.data + more
        get, apart, known, longest = v.ranks.get, v.apart, v.apart_seen.get, v.longest
        for end in range(done + 1, len(data) + 1):
            token = get(data[:end]) if end <= longest else None
            if token is not None:
                last.append(token)
                start.append(0)
                continue
            for at in range(max(1, end - longest), end):
                token = get(data[at:end])
                if token is not None:
                    before = last[at]
                    ok = known(before << 20 | token)
                    if apart(before, token) if ok is None else ok:
                        last.append(token)
                        start.append(at)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace bytes begin..end; prefixes before begin are kept."""
        tail = new + self.data[end:]
        self.data, self.last, self.start = self.data[:begin], self.last[: begin + 1], self.start[: begin + 1]
        self.append(tail)

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first length bytes (all)."""
        at, out = len(self.data) if length is None else length, []
        while at:
            out.append(self.last[at])
            at = self.start[at]
        return out[::-1]


class Codec:
    """Encodes texts, each match of the pattern by itself, and decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary, self.find, self.seen, self.older = Vocabulary(ranks), regex.compile(pattern).findall, {}, {}
        self.name = {i: str(i) for i in ranks.values()}

    def _entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and the bytes that they decode to."""
        name = self.name
        return len(ids), " ".join([name[i] for i in ids]), self.decode(ids)

    def _word(self, word: str) -> tuple[int, str, bytes]:
        out = self.older.get(word)
        if out is None:
            data = word.encode()
            whole = self.vocabulary.ranks.get(data)
            out = self._entry([whole] if whole is not None else Prefixes(self.vocabulary, data).ids())
            if len(data) >= 64:
                return out
        self.seen[word] = out
        return out

    def learn(self, found: set[str]) -> None:
        """Encode the words that aren't known yet, in order of their bytes: each is an edit of the one before, and keeps what they begin with."""
        if len(self.seen) >= MOST_WORDS // 2:
            self.older, self.seen = self.seen, {}
        seen, older, ranks = self.seen, self.older, self.vocabulary.ranks
        new = sorted((w.encode(), w) for w in found if w not in seen and w not in older)
        p = Prefixes(self.vocabulary)
        for data, w in new:
            whole = ranks.get(data)
            if whole is not None:
                seen[w] = self._entry([whole])
            elif len(data) < 64:
                old, k = p.data, 0
                for x, y in zip(old, data):
                    if x != y:
                        break
                    k += 1
                p.edit(k, len(old), data[k:])
                seen[w] = self._entry(p.ids())

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        get, word = self.seen.get, self._word
        return [get(w) or word(w) for w in self.find(text)]

    def batch(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """parts() of many texts; what they share is encoded once."""
        found = [self.find(t) for t in texts]
        self.learn(set().union(*found))
        get, word = self.seen.get, self._word
        return [[get(w) or word(w) for w in f] for f in found]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split()]

    def decode(self, ids: list[int]) -> bytes:
        token = self.vocabulary.token
        return b"".join([token[i] for i in ids])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the count and digest of its ids and the digest of the decoded bytes.

    docs has doc_id and text; other columns are ignored. A null text is an empty one: no
    ids, digests of nothing. Repeated rows give repeated results; an empty table an empty one.
    """

    def run(batch: dict) -> dict:
        c, out = codec(path, pattern), {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for parts in c.batch([t or "" for t in batch["text"]]):
            out["n_tokens"].append(sum([p[0] for p in parts]))
            out["ids_sha256"].append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
        return out

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
