"""Hard negatives, covering SimHash and lexical search against plain loops, and on odd inputs."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import hard_negatives as hn
from quillon.llm import lexical, simhash_join
from quillon.llm.common import Workspace, met_evenly

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, fp string, path string, shard string, term string, `a.b` string"


def docs_of(spark, pairs, parts=3):
    return spark.createDataFrame([(i, t, "f", "p", "s", "t", "x") for i, t in pairs], DOCS).repartition(parts)


def odd_texts(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(w if k != 7 else "zz" for k, w in enumerate(t.split())) for t in texts[:20]]
    texts += [None, "", " \n", "a", "A b", "a B c", "Straße\x1cx\x85y İ", texts[0].upper(), texts[1], texts[1], "a " * 5000, "…!?", "x" * 50_000]
    return [*((k, t) for k, t in enumerate(texts)), (None, texts[2]), (None, None), (3, texts[4]), (3, texts[4])]


# --- op12 ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(nodes, linked):
    """Smallest node that each node reaches."""
    low = {n: n for n in nodes}

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("radius", [0, 2])
def test_simhash_groups_against_brute_force(spark, radius):
    rows = odd_texts(1)
    prints = [plain_fingerprint(t) for _, t in rows]
    link = [(a, b) for a, b in itertools.combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= radius]
    comp = reached(set(prints), link)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    want = Counter((i, f"{p:016x}", least.get(comp[p]), sum(p in x for x in link), prints.count(p)) for (i, _), p in zip(rows, prints))
    got = simhash_join.simhash_groups(docs_of(spark, rows), radius=radius)
    assert Counter(map(tuple, got.collect())) == want
    assert simhash_join.simhash_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_equal_expression_of_the_jvm(spark):
    """The hash is the one that Spark's xxhash64 gives to a string."""
    text = "one two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == simhash_join.signed(xxhash.xxh64_intdigest(text.encode(), 42))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_misses_no_pair(radius):
    masks = simhash_join.covering(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for places in itertools.combinations(range(64), radius):
        differ = sum(1 << p for p in places)
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_dense_groups(spark, radius):
    """Thousands of fingerprints within a few bits of one another: all links, each once, and no bucket met all with all."""
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    prints = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(300)}
    while len(prints) < 2500:
        prints.add(base ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 8))))
    prints = np.array(sorted(prints), np.uint64)
    want = set()
    for k in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= radius) + k + 1
        want |= {frozenset((int(prints[k]), int(prints[j]))) for j in near}
    ws = Workspace(spark, "test")
    nodes = ws.save(spark.createDataFrame([(simhash_join.signed(int(p)),) for p in prints], "fp bigint"), "nodes")
    got = simhash_join.linked(nodes, ws, radius).collect()
    assert len(got) == len(want) and {frozenset((a % (1 << 64), b % (1 << 64))) for a, b in got} == want


def test_join_of_hot_keys(spark):
    rows = spark.range(1000).selectExpr("case when id < 700 then 1 else id end as k", "id")
    told = Workspace(spark, "test").save(rows.groupBy("k").agg(F.count("*").alias("n")), "told")
    for hot in (0, 100, 10_000):
        assert sorted(map(tuple, met_evenly(rows, told, ["k"], "n", hot).select("k", "id", "n").collect())) == sorted((1 if i < 700 else i, i, 700 if i < 700 else 1) for i in range(1000))
    assert met_evenly(rows, told.limit(0), ["k"], "n").count() == 0


# --- op13 ---------------------------------------------------------------------------------------------------------------


def plain_ranking(rows, items, k):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, length in docs:
            m = 100 - 25 + (25 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize("k, shard_docs, block", [(20, 16_384, 512), (3, 5, 2), (1, 1, 1)])
def test_ranked_search_against_brute_force(spark, k, shard_docs, block):
    rows = odd_texts(2)
    rng = random.Random(3)
    items = [(j, " ".join(rng.choice(rows)[1].split()[:200]) if j % 3 else " ".join(rng.choices("abcdé", k=12))) for j in range(14) if j % 3 == 0 or True]
    items = [(j, t) for j, t in items if t is not None] + [(90, None), (91, ""), (92, "?!"), (None, "a b c"), (5, "a a a b"), (5, "a a a b"), (93, "nowhere"), (94, "A b" * 2000)]
    asked = spark.createDataFrame([(*x, "r", "b", "w") for x in items], "item_id long, text string, row string, block string, weight string").repartition(2)
    index = lexical.LexicalIndex.build(docs_of(spark, rows), only=lexical.vocabulary(asked), shard_docs=shard_docs)
    got = index.search(asked, k=k, block=block)
    want = plain_ranking(rows, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(map(tuple, got.collect())) == want
    whole = lexical.LexicalIndex.build(docs_of(spark, rows), shard_docs=shard_docs, shard_postings=40)  # all terms, many shards
    assert (whole.n_docs, whole.n_terms) == (index.n_docs, index.n_terms)
    assert Counter(map(tuple, whole.search(asked, k=k).collect())) == want


def test_ranked_search_of_nothing(spark):
    docs, items = docs_of(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs, items).collect()[0][:3] == (1, 1, 1)
    assert lexical.vocabulary(items, most=0) is None and lexical.vocabulary(items) == {b"a"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 52), max_size=60))
def test_packed_numbers(numbers):
    assert lexical.unpacked(lexical.packed(np.array(numbers, np.int64))).tolist() == numbers


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 6), min_size=1, max_size=20), max_size=8), st.integers(1, 5))
def test_best_of_shard(lists, k):
    """The merge with its early ends against sums of all."""
    given_lists = [(sorted(x), [x[d] for d in sorted(x)], max(x.values())) for x in lists]
    scores = Counter()
    for x in lists:
        scores.update(x)
    want = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    got = lexical.best_of_shard(given_lists, list(range(31)), k)
    assert sorted(got, key=lambda x: (-x[0], x[1])) == want


# --- op11 ---------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, modulus=10, k=5, least=80):
    clean = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    score = lambda a, b: max(-hn.TOP, min(hn.TOP, sum(x * y for x, y in zip(a, b))))
    for n, (i, v, label) in enumerate(clean):
        if i % modulus:
            continue
        scored = [(score(v, w), j, other, m) for m, (j, w, other) in enumerate(clean) if m != n]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, j, _, _ in [x for x in scored if x[2] == label][:k]:
            near = [x for x in scored if x[2] != label and least * p <= 100 * x[0] <= 100 * p][:k]
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate(near)]
    return Counter(out)


SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(*x, "r", "c") for x in rows], SCHEMA).repartition(3)


def odd_vectors(seed, n=220, width=6):
    rng = random.Random(seed)
    rows = [(k, [round(rng.gauss(0.3, 1) * 8) / 8 for _ in range(width)], rng.randint(0, 3)) for k in range(n)]
    rows += [(300 + k, rows[k][1], k % 4) for k in range(30)]  # equal vectors
    rows += [(None, [1.0] * width, 1), (400, None, 1), (410, [1.0] * width, None), (420, [1.0, None], 1), (430, [float("nan")] * width, 1), (440, [float("inf"), 1.0], 1), (450, [], 1), (460, [2.0, 2.0], 1), (470, [1.0] * (width + 2), 2), (10, [1.0] * width, 2), (10, [1.0] * width, 2), (480, [0.0] * width, 0)]
    return rows


@pytest.mark.parametrize("lists", [1, 3, None, 60])
def test_hard_negatives_against_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(hn, "ROWS", 16)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rows = odd_vectors(5)
    index = hn.InvertedLists(vectors(spark, rows), "vec_id", "embedding", "label", lists=lists)
    got = hn.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0, index=index)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_of_odd_numbers(spark):
    """Components beyond what doubles multiply exactly, negative positives, no rows."""
    rows = [(k, [3e6 * (k % 7 - 2) + k, 1e6 * (k % 5)], k % 2) for k in range(40)] + [(k, [-1.0, -2.0 - k], 2 + k % 2) for k in range(40, 60)]
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows] + [(70, [-3e30, 1.0], 0), (80, [3e30, 1.0], 1), (81, [3e30, 1.0], 1)]
    got = hn.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0).collect()
    clipped = [(i, [max(-(2.0**63), min(2.0**63 - 1024, 256 * x)) / 256 for x in v], label) for i, v, label in rows]
    assert {tuple(r)[:4] for r in got if r[0] < 70} == {x[:4] for x in plain_negatives(clipped) if x[0] < 70}
    assert hn.hard_negatives(vectors(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0


def test_lists_are_skipped(spark):
    """On vectors in clusters the bounds leave few of the rows; the result is the plain one."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16)) * 3
    rows = [(k, (middle[k % 40] + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), int(k // 40 % 3)) for k in range(3000)]
    index = hn.InvertedLists(vectors(spark, rows), "vec_id", "embedding", "label")
    got = hn.hard_negatives(vectors(spark, rows), F.col("id") % 100 == 0, index=index)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, 100)
    assert index.compared < 0.35 * 2 * 30 * len(rows)  # of both searches
