"""The registered queries against brute force, on the smallest tables and on planted rows."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from braidwork.llm import bpe, fingerprint, lm, minhash, packing, quality, queries, substring, topk, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, node int, band string, _uid int, root int"


def table(spark, texts, ids=None):
    """documents with columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", 2, 3) for i, t in zip(ids, texts)], SCHEMA)


def documents(spark):
    return queries.documents(spark, SF).collect()


ODD = [None, "", "  \n\t ", "a", "a b", "A  b", "é É ß", "x" * 5000, "w " * 3000, "same text here now", "same text here now", "\u3000 \x1c."]


def planted(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 300))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = list(base)
    for t in base[:20]:
        w = t.split()
        out.append(t)
        for share in (0.02, 0.05, 0.1):
            x = list(w)
            for k in range(max(1, int(share * len(w) / 2))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            out.append(" ".join(x))
    for t in base[20:40]:
        w = t.split()
        at = rng.randrange(len(w))
        out.append(" ".join(w[:at] + passage.split() + w[at:]))
    chain = base[50].split()
    for i in range(30):  # each is near the one before, the ends are far apart
        chain = list(chain)
        chain[(7 * i) % len(chain)] = f"n{i}"
        out.append(" ".join(chain))
    return out + ODD


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def split(t):
    out, word = [], ""
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = split(lower(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash_planted(spark, size, percent):
    texts = planted()
    got = minhash.near_duplicates(table(spark, texts), size=size, percent=percent).collect()
    want = brute_components(list(enumerate(texts)), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_minhash_tables(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark)]
    got = queries.op1_minhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 85)


def test_minhash_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(table(spark, texts), size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)), 3, 85)


def test_bits_miss_next_to_nothing():
    for s in (0.8, 0.85):
        p, d = (1 - s) / 2, minhash.most_apart(s)
        tail = [sum(math.comb(192, k) * p**k * (1 - p) ** (192 - k) for k in range(x + 1, 193)) for x in (d, d - 1)]
        assert tail[0] <= minhash.MISSED_BY_BITS < tail[1]


def test_kept_rows_are_judged_one_by_one(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, d, 5), (7, d, 6), (None, a, 7), (None, a, 8), (9, "", 9), (8, None, 10), (8, None, 11)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, n int, _gone int, uid int, row int")
    got = minhash.kept_rows(docs)
    assert got.columns == docs.columns and sorted(r.n for r in got.collect()) in ([1, 3, 4, 5, 7, 8, 9, 10, 11], [1, 3, 4, 6, 7, 8, 9, 10, 11])
    assert minhash.kept_rows(docs.limit(0)).count() == 0 and minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    assert got == root


def test_toxicity_exact_marginals():
    rng = np.random.default_rng(0)
    f = toxicity.Field()
    f.bias, f.trans, f.weight = -1.0, rng.normal(size=(2, 2)), {"a": 2.0, "b": -1.5, "c": 0.3}
    docs = [list(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 63, 64, 65, 200, 0, 130)]
    for d, m in zip(docs, f.marginals(docs)):
        e = np.exp(f.emission(d))[:, None]
        if len(d):
            x, y = toxicity.odds(e, np.exp(f.trans))
            assert np.allclose(m, (x * y / (1 + x * y))[:, 0])
    d = docs[2]  # two tokens by enumeration
    e = f.emission(d)
    weight = {(a, b): math.exp(a * e[0] + b * e[1] + f.trans[a, b]) for a in (0, 1) for b in (0, 1)}
    assert math.isclose(f.marginals([d])[0][1], (weight[0, 1] + weight[1, 1]) / sum(weight.values()))


def accuracy(rows, known, name):
    ok = [(r.predicted == known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return sum(ok) / len(ok)


@pytest.mark.parametrize(("query", "column", "least"), [(queries.op2_toxicity, "toxic", 0.9), (queries.op8_quality, "quality", 0.85)])
def test_classifiers_held_out(spark, query, column, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    known = {r.doc_id: r[column] for r in queries.labels(spark, sf).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, known, column) >= least


def test_classifiers_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, ODD)
    for f in (quality.judged, toxicity.judged):
        rows = f(docs, labels).collect()
        assert len(rows) == len(ODD) and all(r.score == 0.5 for r in rows)  # no labels of both classes
        assert f(docs.limit(0), labels).count() == 0
    q, t = quality.fit(["good words"] * 5 + ["%%% $$$"] * 5, [1] * 5 + [0] * 5), toxicity.fit(["a fine day"] * 9 + [f"a x{i} scum day" for i in range(9)], [0] * 9 + [1] * 9)
    s = q.scores(["good words", "%%% $$$", ""])
    assert s[0] > s[1] and 0 <= s[2] <= 1
    assert t.document(t.marginals([["scum"]]))[0] > 0.5 > t.document(t.marginals([[]]))[0]


def test_toxic_spans(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.judged(queries.documents(spark, sf), queries.labels(spark, sf)).where("size(spans) > 0").join(queries.documents(spark, sf), "doc_id").collect()
    assert rows and all(0 <= s.start < s.end <= len(r.text) and s.p >= 0.5 for r in rows for s in r.spans)


def test_chunks_cover():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        c = quality.chunks("a" * n)
        assert sum(int((x[: quality.STEP] != 0).sum()) for x in c[:-1]) + int((c[-1] != 0).sum()) == n


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = lower(rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_urls(spark):
    urls = [None, "", "x", "://", "http://", "http://org", "http://ORG/", "http://a.Org/x#y", "https://example.org/es/1?x", "http://b.example.org/en/1", "http://xexample.org/es/", "ftp://com/fr/", "a://b.com/de/?q://org/", "http://com/de", "http://u\nv.org/\n/x"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, key string")
    got = sorted(urlfilter.judge(pages).collect())
    assert [tuple(r)[1:] for r in got] == [judge(u) for u in urls * 2]
    assert urlfilter.judge(pages.limit(0)).count() == 0
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {r.page_id: judge(r.url) for r in rows}
    assert {r.page_id: tuple(r)[1:] for r in queries.op3_url_filter(spark, SF).collect()} == want


def test_cascade_is_exact(spark):
    universe = spark.range(20000).selectExpr("concat('k', id) AS key")
    known = {f"k{i}" for i in range(0, 20000, 97)} | {"elsewhere"}
    listed = spark.createDataFrame([(k,) for k in sorted(known)] * 2 + [(None,)], "key string")
    (c,) = urlfilter.build(listed, universe)
    every = [f"k{i}" for i in range(20000)]
    assert len(c.levels) > 1 and "elsewhere" in c
    assert c.has(urlfilter.hashes(every)).tolist() == [k in known for k in every]
    assert sum(level.bits for level in c.levels) < 40 * len(known)  # the filters, not the list, are what tasks get
    assert not urlfilter.build(listed.limit(0), universe)[0].levels
    three, h = urlfilter.build(listed, universe, shards=3), urlfilter.hashes(every)
    at = urlfilter.shard_of(h, 3)
    assert [bool(three[s].has(h[i : i + 1])[0]) for i, s in enumerate(at.tolist())] == [k in known for k in every]


def test_urls_with_many_rules(spark):
    rng = random.Random(9)
    rules = [urlfilter.Rule(rng.choice(["allow", "block"]), f"h{i % 90}.org", f"/p{i % 7}/" if i % 3 else "/") for i in range(300)]
    rules = list({r.key: r for r in rules}.values())
    urls = [f"http://{'www.' * (i % 2)}h{i % 120}.org/p{i % 11}/x{i}" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        name, where = rest.split("/", 1)
        fits = [r for r in rules if (name == r.host or name.endswith("." + r.host)) and ("/" + where).startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        want[i] = (best.key, best.verdict) if best else (None, "allow")
    for most in (1 << 30, 700):  # one shard, and several
        got = urlfilter.judge(pages, urlfilter.table_of(spark, rules), most_bits=most).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in got} == want


def shingle_set(text):
    """Runs of 12 code points of the marked text, told apart by themselves."""
    t = [None] * 11 + list(text) + [None] * 11 if text else []
    return {tuple(t[i : i + 12]) for i in range(len(t) - 11)}


def test_fingerprints(spark):
    texts = planted()
    rows = sorted(fingerprint.fingerprints(table(spark, texts)).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    texts = [t or "" for t in texts]
    hash_of = {}  # of each shingle, by itself

    def kept(text):
        out = set()
        for x in shingle_set(text):
            if x not in hash_of:
                p = np.array([0x110000 if c is None else ord(c) for c in x], np.uint64)
                hash_of[x] = int(fingerprint.run_hashes(p)[0])
            if hash_of[x] * fingerprint.SCALE < 1 << 32:
                out.add(hash_of[x])
        return out

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    errors = []
    for i, r in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        a, b, c = kept(t), kept(e), kept(following)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert set(fingerprint.of_text(r.fingerprint).tolist()) == a and set(fingerprint.of_text(r.edited_fingerprint).tolist()) == b
        assert r.near_edited == alike(a, b) and r.near_next == alike(a, c)
        if len(shingle_set(t)) >= 200:  # sketches of fewer shingles hold little
            errors += [r.near_edited - alike(shingle_set(t), shingle_set(e)), r.near_next - alike(shingle_set(t), shingle_set(following))]
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert fingerprint.fingerprints(table(spark, texts).limit(0)).count() == 0
    assert fingerprint.fingerprints(table(spark, ["only one"])).first().near_next == 1.0


def test_fingerprint_deals(spark, monkeypatch):
    docs = table(spark, planted(), [7 * i % 131 if i % 50 else None for i in range(len(planted()))])
    one = sorted(fingerprint.fingerprints(docs).collect(), key=str)
    monkeypatch.setattr(fingerprint, "DEAL_ROWS", 3)
    many = sorted(fingerprint.fingerprints(docs).collect(), key=str)
    assert one == many and len(one) == docs.count()


def test_sketches_merge():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3, 40, 900, 20000)]
    hashes = [fingerprint.shingle_hashes(t) for t in texts]
    union = fingerprint.sketch(np.concatenate(hashes))
    both = fingerprint.merged([fingerprint.sketch(h) for h in hashes])
    assert (both == union).all()
    for n in (500, 2000, 9000):  # against the true containment, however unequal the texts
        inside, whole = texts[3][:n] + texts[2], texts[3]
        true = len(shingle_set(inside) & shingle_set(whole)) / len(shingle_set(inside))
        assert abs(fingerprint.containment(*(fingerprint.sketch(fingerprint.shingle_hashes(x)) for x in (inside, whole))) - true) < 0.1


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = planted() + ["a<|endoftext|>b", "long " * 5000]
    rows = packing.pack(table(spark, texts), queries.vocabulary("byte_bpe_50k.json"), queries.pattern()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert sum(p.length for p in parts) == len(ids) and all(p.length == 1024 for p in parts[1:])
        for p in parts:
            assert p.ids_crc32 == crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        total += len(ids)
    n = check_packing(rows, 1024)
    bins = []
    for s in sorted((r.length for r in rows), reverse=True):  # plain best fit decreasing
        k = min((k for k, b in enumerate(bins) if b >= s), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(1024 - s)
        else:
            bins[k] -= s
    assert -(-total // 1024) <= n <= len(bins)
    assert packing.pack(table(spark, texts).limit(0), queries.vocabulary("byte_bpe_50k.json"), queries.pattern()).count() == 0


def fewest(sizes, capacity):
    """Exact by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {x for x in bins if x >= sizes[i]}:
            k = bins.index(b)
            go(i + 1, bins[:k] + [b - sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randint(8, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        one = packing.Instance(Counter(sizes), capacity)
        one.reduce()
        rest = [s for s in range(1, capacity + 1) for _ in range(one.left[s])]
        assert one.sequences + fewest(rest, capacity) == fewest(sizes, capacity), (sizes, capacity)
        plan = packing.solve(Counter(sizes), capacity)
        used = Counter()
        for size, _, n, first, _, each in plan.plan:
            for k in range(n):
                used[first + k // each] += size
        assert len(used) == plan.sequences and max(used.values()) <= capacity and sum(used.values()) == sum(sizes)


def brute_top(rows, every=50, k=5):
    good = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 620)]  # one common vector
    rows += [(620, None), (650, [float("nan")] * 8), (700, [None] + [1.0] * 7), (750, [float("inf")] * 8), (800, [0.0] * 8), (850, [-1.0, 2.0]), (851, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")
    want = brute_top([(r.vec_id, r.embedding) for r in df.collect()])
    for block, chunk in ((8192, 2048), (50, 3)):
        got = sorted(tuple(r) for r in topk.top_k(df, block_rows=block, chunk_rows=chunk).collect())
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    table_ = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op6_topk(spark, SF).collect()) == brute_top(table_)


def exact_top(rows, every=50, k=5):
    whole = {i: [math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256 for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        scores = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("big", [1e3, 4e6, 1.2e7, 1e12, 1e307])
def test_top_k_large_components(spark, big):
    rng = random.Random(3)
    for rows in (
        [(i, [rng.uniform(-1, 1) * big * (1 + i % 5) for _ in range(6)]) for i in range(200)],
        [(i, [big + rng.randrange(3) / 256 for _ in range(6)]) for i in range(200)],  # products that differ past 2**53
    ):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(tuple(r) for r in topk.top_k(df, buckets=4, block_rows=40).collect()) == exact_top(rows)


def test_top_k_has_buckets(spark):
    table_ = topk.taking_part(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert table_.select("length").distinct().count() >= 4 <= topk.BUCKETS


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())


@pytest.fixture(scope="module")
def peer(codec):
    import tiktoken

    return tiktoken.Encoding("peer", pat_str=queries.pattern(), mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def test_bpe_equals_merging(codec, peer):
    rng = random.Random(7)
    for _ in range(1500):
        t = "".join(rng.choice("aaabcdehhheeellloo  0011!!é中\n<|>") for _ in range(rng.randint(0, 50)))
        ids = codec.encode(t)
        assert ids == peer.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_appends_and_edits(codec, peer):
    rng = random.Random(8)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeeehlotn ") for _ in range(80))
        p = bpe.Prefixes(codec.vocabulary, data[:30])
        p.append(data[30:])
        assert p.ids() == peer._encode_single_piece(data) and p.ids(41) == peer._encode_single_piece(data[:41])
        p.edit(20, 33, b"hello the")
        assert p.ids() == peer._encode_single_piece(data[:20] + b"hello the" + data[33:])


def test_bpe_query(spark, peer):
    for df in (queries.op7_bpe(spark, SF), bpe.round_trips(table(spark, ODD), queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())):
        rows = df.collect()
        texts = dict(enumerate(ODD)) if len(rows) == len(ODD) else {r.doc_id: r.text for r in documents(spark)}
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r.doc_id] or ""
            ids = peer.encode_ordinary(t)
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def brute_lm(rows):
    count = Counter()
    for i, t in rows:
        if crc32(str(i).encode()) % 5 != 1:
            count.update([*split(lower(t or "")), "\n"])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*split(lower(t or "")), "\n"]
        yield i, (crc32(str(i).encode()) % 5 == 1, len(tokens), sum(count[w] > 0 for w in tokens), n), sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)


@pytest.mark.parametrize("head", [200_000, 40])
def test_lm(spark, head):
    rows = [(r.doc_id, r.text) for r in documents(spark)]
    want = {i: (x, base) for i, x, base in brute_lm(rows)}
    got = lm.scores(queries.documents(spark, SF), head_words=head, classes=32).collect()
    assert len(got) == len(rows)
    for r in got:
        x, base = want[r.doc_id]
        assert tuple(r)[1:5] == x and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_is_normalised_and_learns(spark):
    rng = random.Random(1)
    texts = [" ".join(x for _ in range(30) for x in rng.choice([("a", "b"), ("c", "d"), ("e",)])) for _ in range(200)] + ["", None, "zzz a b"]
    docs = table(spark, texts)
    rows = lm.scores(docs, classes=6).collect()
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 3 * len(held)  # b follows a, always
    one = lm.scores(docs.unionByName(table(spark, ["a", "b", "c", "d", "e", "neverseen"], [10**6 + i for i in range(6)])), classes=6, held_out_fold=99).where("doc_id >= 1000000").collect()
    assert len(one) == 6 and all(r.score < 0 for r in one)
    pairs = np.array([[5, 1, 9], [2, 2, 0], [0, 7, 3]])
    assert np.allclose((10.0 ** lm.LogBilinear(pairs).log10).sum(1), 1, atol=1e-5)
    assert lm.scores(docs.limit(0)).count() == 0
    assert np.allclose([r.score for r in lm.scores(docs.where("doc_id = 0"), held_out_fold=crc32(b"0") % 5).collect()], [0.0])


def test_lm_trains_on_every_cell():
    pairs = np.zeros((40, 40), np.int64)
    pairs[:4, :4] = 10**6
    rare = [(i, 4 + (i + 7) % 36) for i in range(4, 40)]  # a ten-thousandth of all pairs, one follower each
    for i, j in rare:
        pairs[i, j] = 1600
    table = lm.LogBilinear(pairs).log10
    assert min(10.0 ** table[i, j] for i, j in rare) > 0.5
    pairs[rare[0][0], 5] += 1600
    assert 10.0 ** lm.LogBilinear(pairs).log10[rare[0][0], 5] > 0.25


def test_lm_words_outside_the_own_classes_have_vectors(spark):
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(2)
    docs = table(spark, [" ".join(f"l{i} r{i}" for i in rng.choices(range(30), k=20)) for _ in range(400)])
    held = [r for r in lm.scores(docs, classes=4).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in held) > 0.4 * sum(r.n_tokens for r in held)  # r follows l, always: 0.74 at most

    counted = pa.table({"word": [b"\n", *(f"{s}{i}".encode() for i in range(30) for s in "lr")], "n": [400, *(10**5 + i for i in range(60))]})
    head = lm.Head(counted, 4)
    assert head.own == 3 and head.clusters == 8 and (head.class_of > 0).all()
    pairs, cells = lm._pairs(docs.select("text"), head)
    assert pairs.sum() == 400 * 41
    model, at = lm.Words(cells, pairs, lm.LogBilinear(pairs), head), np.arange(61)
    for before in range(-1, 61):
        b = np.full(62, before)
        logs = model.logs(b, head.class_ids(b), np.append(at, -1), head.class_ids(np.append(at, -1)))
        assert math.isclose((10**logs).sum(), 1, abs_tol=1e-4)


def brute_removed(rows, window=35):
    words = {i: split(t) for i, t in rows}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        drop = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                drop[k : k + window] = [True] * window
        out[i] = (len(w), sum(drop), hashlib.sha256(" ".join(x for x, d in zip(w, drop) if not d).encode()).hexdigest())
    return out


def test_substrings(spark):
    texts = planted() + ["r " * 34, "r " * 35, "s " * 36, " ".join(f"q{i % 40}" for i in range(200))]
    assert {r.doc_id: tuple(r)[1:] for r in substring.digests(table(spark, texts)).collect()} == brute_removed(list(enumerate(texts)))
    rows = [(r.doc_id, r.text) for r in documents(spark)]
    assert {r.doc_id: tuple(r)[1:] for r in queries.op10_substring(spark, SF).collect()} == brute_removed(rows)
    assert substring.digests(table(spark, texts).limit(0)).count() == 0


def batch_of(spark, b):
    return spark.createDataFrame([(b, 1, b, 1), (b + 1, 2, b, 2)], "anchor long, segment long, uid long, place long")


def test_substring_index_compacts(spark):
    index = substring.FingerprintIndex(spark, 2, fan=2)
    for b in range(5):
        met = index.add(batch_of(spark, b))
        assert {r.anchor for r in met.collect()} == ({b} if b else set())
    assert [len(x) for x in index.levels] == [1, 0, 1] and index.compactions == 3
    assert {(r.anchor, r.segment): r.n for run in index.runs() for r in run.collect()} == {(b + k, 1 + k): 1 for b in range(5) for k in (0, 1)}
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("braidwork_run")]


def test_substring_index_opens_again(spark):
    from braidwork.llm.common import new_path

    index = substring.FingerprintIndex(spark, 2, fan=2, folder=new_path(spark, "kept"))
    for b in range(3):
        index.add(batch_of(spark, b))
    folder = index.saved()
    for name in (n for level in index.levels for n in level):
        spark.sql(f"DROP TABLE {name}")  # another session knows nothing of them
    again = substring.FingerprintIndex.open(spark, folder)
    assert again.levels == index.levels and again.compactions == 1
    assert {r.anchor for r in again.add(batch_of(spark, 2)).collect()} == {2, 3}
    rows = again.shared(spark.createDataFrame([(2,), (3,)], "anchor long")).collect()
    assert {(r.anchor, r.segment): r._n for r in rows} == {(2, 1): 2, (3, 2): 2, (2, 2): 1}
    again.drop()


def test_substring_query_compacts(spark, monkeypatch):
    made = []

    class Counted(substring.FingerprintIndex):
        def drop(self):
            made.append(self.compactions)
            super().drop()

    monkeypatch.setattr(substring, "FingerprintIndex", Counted)
    assert queries.op10_substring(spark, SF).count() == len(documents(spark))
    assert made == [1]


def test_substring_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, 7, "s", [1], 2)], "doc_id long, text string, _uid int, settled string, places array<int>, _single int")
    row = substring.removed(docs).first()
    assert row.asDict() == {"doc_id": 1, "text": "", "_uid": 7, "settled": "s", "places": [1], "_single": 2}


def test_substring_cut_keeps_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"One  two\nthree {passage}\nfour  five", f"{passage} six", "no\n repeats  here", None]
    got = {r.doc_id: r for r in substring.removed(table(spark, texts)).collect()}
    assert got[0].text == "One  two\nthree four  five" and got[1].text == "six" and got[2].text == texts[2] and got[3].text is None
    assert got[0].n_chars == len(got[0].text) and got[0].band == "y" and got[2].lang == "en"


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = queries.documents(spark, sf)
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        from braidwork.llm.common import stored

        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        after = out.count()
        assert 0 < after <= before
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            want = {i for i, (_, root) in brute_components(rows, 5, 80).items() if i == root}
            assert {r.doc_id for r in out.collect()} == want
        if name == "substring_dedup":
            assert after == before
            kept = brute_removed([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id: hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest() for r in out.collect()} == {i: x[2] for i, x in kept.items()}
        docs, before = out, after
    rows = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    check_packing(rows, 1024)


def test_hand_read_vocabulary(codec):
    with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        first = f.readline().split()
    assert codec.vocabulary.ranks[base64.b64decode(first[0])] == int(first[1])
