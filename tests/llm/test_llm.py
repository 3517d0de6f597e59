"""The training-data operators against brute force and on odd inputs."""

import hashlib
import itertools
import math
import random
import re
import time
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, hmm, jaccard_join, mixing, pii, quality, toxicity
from quillon.llm.common import Workspace
from quillon.llm.exact_dedup import distinct_texts, exact_dedup
from quillon.llm.language import language_of_pages
from quillon.llm.token_rollup import TokenRollup, counted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, name string, row_id long"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdefgh", k=RNG.randint(2, 6))) for _ in range(300)]


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def rows():
    rng = random.Random(1)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    near = [" ".join(w if k % 97 else "edited" for k, w in enumerate(t.split())) for t in base[:15]]
    odd = [None, "", " \n\t", "a", "A", "word " * 3000, "é\x85ü\xa0x y", prose(rng, 6000), "x" * 9000]
    texts = base + near + base[:10] * 2 + odd + [base[0]]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1, "clash", None, i) for i, t in enumerate(texts)]
    return [*out, (5, texts[5], "en", "s0", 1, None, "clash", None), (None, base[3], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_dedup(docs, block):
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact_dedup(docs, block_bytes=block).collect()
    assert len(got) == len(rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(ids, key=lambda x: -1 if x is None else x)
    assert sum(r.kept for r in got) == len(groups) == distinct_texts(docs).count()


def links(size, percent):
    sets = []
    for r in rows():
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows()):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r[0])
    return sorted((str(r[0]), len(sets[k]), str(least.get(find(k)))) for k, r in enumerate(rows()))


@pytest.mark.parametrize(("size", "percent", "frequent"), [(4, 85, 32), (5, 80, 1)])
def test_jaccard_join(docs, size, percent, frequent):
    got = jaccard_join.jaccard_join(docs, size=size, percent=percent, frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == links(size, percent)


def test_signatures_meet():
    """Linked sets share an index key whatever is frequent, also across a change of modes."""
    rng = np.random.default_rng(0)
    for n in (20, 250, 300, 2100, 2300):
        for share in (0.0, 0.5, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = jaccard_join.slack(len(x), 85)
            y = np.sort(rng.permutation(x)[: len(x) - drop])
            often = lambda s: (jaccard_join.mixed(s) % np.uint64(1000)) < 1000 * share
            a, b = (jaccard_join.signatures(s, np.ones(len(s), bool), often(s), 85) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_hidden_markov(docs):
    got = hmm.hmm_scores(docs, states=3, rounds=1, head=50).collect()
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows()}
    count = Counter()
    for r in rows():
        if not held[r[0]]:
            count.update([*(r[1] or "").encode().lower().split(), "end"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows():
        w = [*(r[1] or "").encode().lower().split(), "end"]
        want[str(r[0]), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    for ids in ([0], [1, 4, 2], [3, 3, 0, 1]):
        total = sum(model.start[p[0]] * np.prod([model.emit[i, s] for i, s in zip(ids, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in itertools.product(range(3), repeat=len(ids)))
        assert abs(model.log10([np.array(ids)])[0] - math.log10(total)) < 1e-12


def test_base_spans():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choices("ab1.@-+ é9", k=rng.randint(0, 40)))
        assert pii.emails(t) == [m.span() for m in email.finditer(t)], t
        t = "".join(rng.choices("1290...a ", k=rng.randint(0, 40)))
        assert pii.ips(t) == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))], t
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def passes(chain):  # Luhn by the book: double every second digit from the right, add up digits
        digits = [int(c) for c in chain if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0

    hits = 0
    for _ in range(4000):
        t = "".join(rng.choices("0123456789- x", weights=[6] * 10 + [3, 3, 1], k=rng.randint(10, 60)))
        want = [m.span() for m in card.finditer(t) if passes(m.group())]
        hits += len(want)
        assert pii.cards(t) == want, t
        t = "".join(rng.choices("0123456789+-(). x", k=rng.randint(0, 50)))
        assert pii.phones(t) == [m.span() for m in phone.finditer(t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15], t
    assert hits > 50
    assert pii.base_spans("+1 (234) 555-7890, 4539-5787-6362-1486.") == [("card", 19, 38), ("phone", 0, 17)]
    assert pii.base_spans("555-7890 4539 5787 6362 1486") == []  # one run of 23 digits, no second try
    pii.emails("a" * 200_000), pii.ips("1" * 200_000)  # linear


def test_personal_data(spark, docs, none):
    cue = [(1000 + k, f"{a} {b} zzcue me{k}@x.org {c}", "en", "s", 1, "", "", 0) for k, (a, b, c) in enumerate(zip(VOCABULARY, VOCABULARY[9:], VOCABULARY[50:]))][:40]
    both = docs.unionByName(spark.createDataFrame(cue, SCHEMA))
    got = {r.doc_id: r for r in pii.find_personal_data(both).collect() if r.doc_id and r.doc_id >= 1000}
    text = {r[0]: r[1] for r in cue}
    assert all(r.n_email == 1 and r.base_sha256 == hashlib.sha256(r.spans.split(",")[0].encode()).hexdigest() for r in got.values())
    assert all(any(text[i][s.start : s.stop] == "zzcue" for s in r.term_spans) for i, r in got.items())
    assert pii.find_personal_data(none).count() == 0


def test_planted_cues_in_given_documents(spark):
    """Of the words of the given documents none gives a value away; two planted ones, one of them at other places too, do."""
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    plain = pii.find_personal_data(given).agg({"n_term": "sum"}).first()[0]
    cue = F.when(F.col("doc_id") % 400 == 7, F.concat("text", F.lit(" the qqmailcue of "), F.concat(F.lit("n"), "doc_id", F.lit("@corp.example.org")), F.lit(" and the qqcallcue +44 20 7946 0123 in")))
    lone = F.when(F.col("doc_id") % 1000 == 11, F.concat("text", F.lit(" the qqmailcue stands alone")))
    planted = given.withColumn("text", F.coalesce(cue, lone, "text"))
    got = pii.find_personal_data(planted).filter("n_term > 0").join(planted, "doc_id").collect()
    words = Counter(r.text[s.start : s.stop] for r in got for s in r.term_spans)
    assert plain == 0 and set(words) == {"qqmailcue", "qqcallcue"}
    assert words["qqcallcue"] == planted.filter("doc_id % 400 = 7").count() == 25 and words["qqmailcue"] == 35


@pytest.mark.parametrize("most_words", [1000, 0])
def test_disclosing_terms_far_from_spans(spark, docs, most_words):
    """A disclosing word is marked everywhere: far from the span, in texts without one, but not inside a span."""
    cue = [(1000 + k, f"{a} {b} zzcue me{k}@x.org {c}") for k, (a, b, c) in enumerate(zip(VOCABULARY, VOCABULARY[9:], VOCABULARY[50:]))][:40]
    far = [(2000, "Zzcue " + " ".join(VOCABULARY[:80]) + " me@x.org " + " ".join(VOCABULARY[80:160]) + " zzcue"), (2001, "only ZZCUE here"), (2002, "mail zzcue@x.org now")]
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1, "", "", 0) for i, t in cue + far], SCHEMA))
    found = pii.find_personal_data(both, most_words=most_words).cache()
    got = {r.doc_id: r for r in found.filter("doc_id >= 1000").collect()}
    marked = {i: [t[s.start : s.stop].lower() for s in got[i].term_spans or ()].count("zzcue") for i, t in cue + far}
    assert marked == {i: 1 for i, _ in cue} | {2000: 2, 2001: 1, 2002: 0}
    clean = pii.sanitise(both.filter("doc_id >= 1000"), found.filter("doc_id >= 1000")).collect()
    assert not any("zzcue" in r.text.lower() for r in clean)


def test_tiling_finds_moved_parts():
    item = [f"w{k}" for k in range(30)]
    bench = decontaminate.Benchmark([(7, " ".join(item)), (8, None), (9, "tiny one")], 5, 3)
    moved = ["x"] * 5 + item[20:] + ["y"] * 3 + item[10:20] + ["z"] + item[:10]
    assert bench.leaks(" ".join(moved), 0.7) == [(7, 30, 30, 3, 10)]
    assert bench.leaks(" ".join(item[:15]), 0.7) == [] and bench.leaks("", 0.7) == [] and bench.leaks(None, 0.7) == []
    assert [x[0] for x in bench.leaks("the Tiny, one!", 0.7)] == [9]


def test_tiles_are_greedy():
    ids = lambda s: np.array([ord(c) for c in s], np.int64)
    assert decontaminate.tiles(ids("abcdefXbcdX"), ids("abcdefbcd")) == [(6, 0, 0), (3, 6, 7)]


def test_raking_meets_marginals():
    rng = np.random.default_rng(2)
    totals = rng.random(24) * 100
    groups = [np.arange(24) % 4, np.arange(24) // 8]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]) * totals.sum(), np.array([0.5, 0.25, 0.25]) * totals.sum()]
    targets = [mixing.within(0.4 * t, np.bincount(g, totals)) for g, t in zip(groups, targets)]
    chance, miss = mixing.rake(totals, groups, targets, 0.4)
    assert all(np.allclose(np.bincount(g, totals * chance), t, rtol=1e-4) for g, t in zip(groups, targets)) and miss.max() < 1e-6


def test_mix_local_and_spread_agree(docs, none):
    a, b = (sorted((str(r.doc_id), r.n_tokens, round(r.probability, 3), r.kept) for r in mixing.mix(docs, powers={"source": 0.9}, fixed={}, driver_cells=c).collect()) for c in (100, 0))
    assert a == b and len(a) == len(rows())
    assert mixing.mix(none).count() == 0


def test_slow_fits_agree_and_converge(spark):
    """In memory and spread get the same probabilities and misses, whether targets can be met, are too large for what
    is held, or contradict each other."""
    shape = "source string, lang string, topic string, tokens long"
    meets = [("a", "en", "t", 10000), ("a", "de", "t", 4000), ("b", "en", "t", 3000), ("b", "de", "t", 10000), ("c", "en", "u", 50), ("c", "de", "t", 9)]
    against = [("a", "en", "t", 10000), ("a", "de", "t", 1), ("b", "en", "t", 1), ("b", "de", "t", 10000)]
    powers, fixed = {"source": 0.5, "topic": 0.7}, {"lang": {"en": 0.6, "de": 0.4}}
    for rows_, rounds, ends in ((meets, 500, True), (against, 12, False)):
        cells, ws = spark.createDataFrame(rows_, shape), Workspace(spark, "mixing")
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            local = {r[:3]: r[3:] for r in mixing._fit_local(cells.collect(), powers, fixed, 0.5, rounds)}
            spread = {tuple(r)[:3]: tuple(r)[3:] for r in mixing._fit_spread(cells, powers, fixed, 0.5, ws, rounds).collect()}
        assert local.keys() == spread.keys() and all(np.allclose(local[k], spread[k], rtol=1e-7, atol=1e-12) for k in local)
        said = [str(w.message) for w in said if "raking" in str(w.message)]
        assert len(said) == (0 if ends else 2) and all(f"not converged in {rounds} rounds" in w for w in said)
        assert ends == (max(m for _, m in local.values()) < 1e-6) and all(0 <= p <= 1 for p, _ in local.values())
    kept = {v: sum(n * local_p for *k, n in meets if v in k for local_p in [dict((r[:3], r[3]) for r in mixing._fit_local(spark.createDataFrame(meets, shape).collect(), powers, fixed, 0.5))[tuple(k)]]) for v in ("en", "de", "u", "c")}
    total = sum(r[3] for r in meets) / 2
    assert abs(kept["en"] / total - 0.6) < 1e-5 and abs(kept["de"] / total - 0.4) < 1e-5
    assert abs(kept["c"] - 59) < 1e-3 and abs(kept["u"] - 50) < 1e-3  # all that is held


def test_raking_against_projection():
    """The fit is the Kullback-Leibler projection: no feasible move on a cycle of four cells lowers the divergence."""
    rng = np.random.default_rng(1)
    totals = rng.random((4, 3)) * 50 + 1
    groups = [np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)]
    targets = [mixing.within(0.5 * x, h) for x, h in ((np.array([4.0, 3, 2, 1]) / 10 * totals.sum(), totals.sum(1)), (np.array([6.0, 3, 1]) / 10 * totals.sum(), totals.sum(0)))]
    chance, miss = mixing.rake(totals.ravel(), groups, targets, 0.5, rounds=5000, tolerance=1e-10)
    assert miss.max() < 1e-9 and (chance > 1 - 1e-9).any()
    cost = lambda p: (totals.ravel() * (p * np.log(np.maximum(p, 1e-300) / 0.5) - p)).sum()
    for a, b, c, d in itertools.product(range(4), range(4), range(3), range(3)):
        if a != b and c != d:
            move = np.zeros((4, 3))
            move[a, c], move[b, d], move[a, d], move[b, c] = 1, 1, -1, -1
            p = chance + 1e-4 * move.ravel() / totals.ravel()
            if (p >= 0).all() and (p <= 1).all():
                assert cost(p) >= cost(chance) - 1e-9


def test_classifiers(docs, labels, none):
    for f in (toxicity.toxicity, quality.quality):
        got = f(docs, labels).collect()
        assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert f(none, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(rows())


def test_interaction_is_learned():
    """Only the pair of terms marks the class; an additive model can't tell."""
    rng = random.Random(4)
    texts = [" ".join(["pad"] * 5 + ["insult"] * a + ["group"] * b) for a, b in ((rng.random() < 0.5, rng.random() < 0.5) for _ in range(600))]
    y = np.array([float("insult" in t and "group" in t) for t in texts])
    row, at, x = toxicity.term_counts(texts, toxicity.WordBins())
    model = toxicity.fit(row, at, x.astype(np.float64), y, epochs=60)
    score = model.score(["pad insult group", "pad insult", "pad group", "pad"], toxicity.WordBins(model.index))
    assert score[0] > 0.5 > max(score[1:])


CHANGE = "doc_id long, source string, lang string, version string, n_tokens long, seq int"


@pytest.mark.parametrize("part_rows", [10**6, 1])
def test_rollup_against_a_dictionary(spark, part_rows):
    """A random history of inserts, revisions and deletions, with snapshots between; buckets whole and in parts."""
    rng, model = random.Random(0), {}
    rollup = TokenRollup(spark, buckets=4, most_commits=2, part_rows=part_rows)
    for batch in range(6):
        changes = []
        for _ in range(rng.randint(0, 12)):
            doc, kind = rng.choice([None, *range(8)]), rng.random()
            if kind < 0.15:
                changes.append((doc, None, None, None, None, len(changes)))
            elif kind < 0.3:
                changes.append((doc, None, None, rng.choice("uv"), None, len(changes)))
            else:
                changes.append((doc, rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice("uv"), rng.randint(0, 9), len(changes)))
        assert rollup.commit(str(batch), spark.createDataFrame(changes, CHANGE))
        last = {(d, v): (s or "", lang or "", n) for d, s, lang, v, n, _ in changes}
        for doc, version in last:
            for key in [k for k in model if k[0] == doc and version is None]:
                del model[key]
        for (doc, version), row in last.items():
            if version is not None:
                model.pop((doc, version), None)
                if row[2] is not None:
                    model[doc, version] = row
        want = {}
        for (_, version), (source, lang, n) in model.items():
            cell = want.setdefault((source, lang, version), [0, 0])
            cell[0] += 1
            cell[1] += n
        assert {tuple(r)[:3]: list(r)[3:] for r in rollup.totals().collect()} == want
    assert any(c["batch"] is None for c in rollup._commits()) and len(rollup._live(rollup._commits())) <= 3
    assert rollup.vacuum() and {tuple(r)[:3]: list(r)[3:] for r in rollup.totals().collect()} == want
    with pytest.raises(TypeError):
        rollup.commit("text", spark.createDataFrame([("a", "s", "l", "v", 1, 0)], CHANGE.replace("doc_id long", "doc_id string")))


def test_overlapping_writers(spark):
    """A writer whose number is taken computes anew; of one batch id delivered twice at once one is taken."""
    row = lambda n: spark.createDataFrame([(1, "a", "en", "v", n, 0)], CHANGE)
    for other_id, first, want in (("two", True, 20), ("one", False, 30)):
        one, two = TokenRollup(spark, buckets=2), None
        two = TokenRollup(spark, one.folder, buckets=2)
        assert one.commit("zero", row(10))
        publish, entered = one._publish, []

        def late(n, commit):
            if not entered:
                entered.append(two.commit(other_id, row(30)))
            return publish(n, commit)

        one._publish = late
        assert one.commit("one", row(20)) is first and entered == [True]
        assert [tuple(r) for r in two.totals().collect()] == [("a", "en", "v", 1, want)]


def test_string_ids(spark):
    rollup = TokenRollup(spark, buckets=2)
    shape = CHANGE.replace("doc_id long", "doc_id string")
    assert rollup.commit("1", spark.createDataFrame([("a", "s", "l", "v", 3, 0), ("b", "s", "l", "v", 4, 0)], shape))
    assert rollup.commit("2", spark.createDataFrame([("a", None, None, None, None, 0)], shape))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "l", "v", 1, 4)] and [r.doc_id for r in rollup.ledger().collect()] == ["b"]


def test_rollup(spark, docs, none):
    rollup = TokenRollup(spark)
    change = lambda *r: spark.createDataFrame([*r], "doc_id long, source string, lang string, version string, n_tokens long, seq int")
    assert rollup.commit("1", change((1, "a", "en", "v", 10, 0), (2, "a", "en", "v", 5, 0), (2, "a", "en", "v", 6, 1), (None, None, None, "v", 1, 0)))
    assert not rollup.commit("1", change((9, "a", "en", "v", 99, 0)))
    assert rollup.commit("2", change((1, None, None, None, None, 0), (2, "b", "en", "v", 8, 0), (77, None, None, None, None, 0)))
    assert sorted(map(tuple, rollup.totals().collect())) == [("", "", "v", 1, 1), ("b", "en", "v", 1, 8)]
    words = {(str(r.doc_id), r.n_tokens) for r in counted(docs).filter("version = 'words-1'").collect()}
    assert words == {(str(r[0]), len((r[1] or "").encode().split())) for r in rows()}
    assert counted(none).count() == 0


def test_every_batch_is_delivered_twice(spark, monkeypatch):
    """The insert too; no batch is taken twice."""
    from quillon.llm import queries

    taken, commit = [], TokenRollup.commit
    monkeypatch.setattr(TokenRollup, "commit", lambda self, batch, rows: taken.append((batch, commit(self, batch, rows))) or taken[-1][1])
    queries.op10_delta_rollups(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, taken)) == sorted(str((b, x)) for b in ("insert", "delete", "revise") for x in (True, False))


def test_language(spark, docs):
    labelled = spark.createDataFrame([("en", "the house and the tree of the"), ("de", "das haus und der baum ist")] * 30, "lang string, text string")
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "<html lang='en'><p>das haus und der baum ist das haus und der baum</p></html>"), (2, "http://a.example.com/y", "<p>the tree of the house and the house</p>"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language_of_pages(pages, labelled, heat=1.0).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and got[1].declared == "en" and got[3].host == "" and len(got) == 3
    assert language_of_pages(pages.limit(0), labelled).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    kept = out.select("doc_id").toPandas().doc_id
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept.is_unique and not leaks & set(kept) and out.select("text").distinct().count() == len(kept)


def test_toxicity_held_out_on_few_rows(spark):
    """A few hundred training rows find most of the held-out toxic texts, and no other."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    got = toxicity.toxicity(read("documents"), read("labels")).filter("held_out").join(read("labels").select("doc_id", "toxic").dropna(), "doc_id").collect()
    hits = sum(r.predicted == r.toxic == 1 for r in got)
    assert hits >= 0.7 * sum(r.toxic for r in got) and hits >= 0.95 * sum(r.predicted for r in got)
