"""Odd inputs for every operator and stage, and brute force where SQL says nothing."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, hmm, jaccard_join, language, lexical, mixing, pii, quality, queries, simhash_join, toxicity
from quillon.llm.common import BATCH_BYTES, filter_rows, fresh
from quillon.llm.exact_dedup import distinct_texts, exact_dedup
from quillon.llm.token_rollup import counted

#: Names that the operators use inside, as the user's own columns.
CLASHING = ("_id", "_sha", "_of", "_gone", "_source", "_tokens", "_weight", "_kept", "_probability", "_cell", "_key", "_FIT", "row_id", "name", "keep", "score", "a.b", "x")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
LONG = {
    "prose": "word and other words 12 " * 50_000,
    "one word": "x" * 2_000_000,
    "numbers": "1.1.1." * 300_000,
    "mails": "a me@x.org " * 50_000,
    "tags": "<html a " * 50_000,
    "scripts": "<script>x " * 50_000,
    "comments": "<!-- " * 100_000,
    "one license": "the same five words here " * 40_000,
}


def table(spark, texts, first=0):
    rows = [(None if k == 3 else first + k, t, None if k % 5 == 4 else ("en", "de")[k % 2], None if k == 6 else f"s{k % 3}", None, *(c + "!" for c in CLASHING)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(40)] + [(None, None, None), (3, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "this is an item of the test set with some words"), (2, None), (3, ""), (None, "short one"), (1, "the same five words here " * 8)], "item_id long, text string")


SMALL = [None, "", " \n\t", "a", "This is an item of the test set, with some words!", "twin text", "twin text", "ünï cödé Ŀ İ \U0001f600 x", "tied tied tied", "me@x.org 10.0.0.1"] + [f"text number {k} about {'good' if k % 2 else 'bad'} things and more of the kind" for k in range(26)]

OPERATORS = {
    "op1": lambda docs, labels, bench: decontaminate.contaminated(docs, bench),
    "op2": lambda docs, labels, bench: pii.find_personal_data(docs),
    "op3": lambda docs, labels, bench: toxicity.toxicity(docs, labels),
    "op4": lambda docs, labels, bench: quality.quality(docs, labels),
    "op5": lambda docs, labels, bench: exact_dedup(docs),
    "op6": lambda docs, labels, bench: language.language_of_pages(docs.selectExpr("doc_id page_id", "concat('http://', source, '.co.uk/x') url", "text html", "x", "row_id"), docs),
    "op7": lambda docs, labels, bench: mixing.mix(docs),
    "op8": lambda docs, labels, bench: hmm.hmm_scores(docs),
    "op9": lambda docs, labels, bench: jaccard_join.jaccard_join(docs),
    "op10": lambda docs, labels, bench: counted(docs),
    "op12": lambda docs, labels, bench: simhash_join.simhash_groups(docs),
}
STAGES = {
    "quality": lambda docs, labels, bench: quality.of_quality(docs, labels),
    "quality, many labels": lambda docs, labels, bench: quality.of_quality(docs, labels, most=0),
    "exact_dedup": lambda docs, labels, bench: distinct_texts(docs),
    "jaccard_join": lambda docs, labels, bench: jaccard_join.one_of_each_group(docs, size=5, percent=80),
    "decontamination": lambda docs, labels, bench: decontaminate.decontaminated(docs, bench),
    "mixing": lambda docs, labels, bench: mixing.mixed(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(spark, labels, benchmark, name):
    docs = table(spark, SMALL).union(table(spark, SMALL[5:7], 5)).repartition(3)  # two rows are there twice
    got = OPERATORS[name](docs, labels, benchmark).collect()
    assert len(got) == {"op1": 1, "op10": 2 * docs.count()}.get(name, docs.count())
    assert OPERATORS[name](docs.limit(0), labels, benchmark).count() == 0
    assert OPERATORS[name](docs, labels.limit(0), benchmark.limit(0)).count() == (0 if name == "op1" else len(got))


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns_and_clean_rows(spark, labels, benchmark, name):
    docs = table(spark, SMALL).union(table(spark, SMALL[5:7], 5)).repartition(3)
    got = STAGES[name](docs, labels, benchmark)
    rows = got.collect()
    assert got.columns == docs.columns and 0 < len(rows) <= docs.count()
    assert all(r["a.b"] == "a.b!" and r["_sha"] == "_sha!" and r["_kept"] == "_kept!" and r["_gone"] == "_gone!" for r in rows)
    assert STAGES[name](docs.limit(0), labels, benchmark).count() == 0
    assert STAGES[name](docs, labels.limit(0), benchmark.limit(0)).count() <= docs.count()
    if name == "exact_dedup":
        assert len(rows) == len({t or "" for t in SMALL})
    if name == "decontamination":
        assert len(rows) == docs.count() - 1


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_long_texts(spark, labels, benchmark, name):
    """Some 7 MB in a few rows; the limit leaves room for a busy machine, a quadratic scan takes hours."""
    docs = table(spark, list(LONG.values())).repartition(4)
    began = time.monotonic()
    assert OPERATORS[name](docs, labels, benchmark).count() >= (1 if name == "op1" else len(LONG))
    assert time.monotonic() - began < 150


def test_ranked_search_on_long_texts(spark, benchmark):
    docs = table(spark, list(LONG.values())).repartition(4)
    began = time.monotonic()
    got = lexical.ranked_search(docs, docs.selectExpr("doc_id item_id", "text").unionByName(benchmark)).collect()
    assert {r.item_id for r in got} >= {0, 2, None} and all(r.score > 0 for r in got) and time.monotonic() - began < 150
    assert lexical.ranked_search(table(spark, SMALL), benchmark).count() > 0


def test_fresh_names():
    assert fresh(["_ID", "_id_"], "_id", "x", "X") == ["_id__", "x", "X_"]


def plain_tiles(doc, item, least):
    """Greedy string tiling by the book: mark the longest common free runs, again and again."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least - 1, []
        for p, t in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and free_i[p + n] and free_d[t + n]:
                n += 1
            if n > best:
                best, found = n, [(p, t)]
            elif n == best >= least:
                found.append((p, t))
        if best < least:
            return out
        for p, t in found:
            if all(free_i[p : p + best]) and all(free_d[t : t + best]):
                free_i[p : p + best], free_d[t : t + best] = [False] * best, [False] * best
                out.append((best, p, t))


def test_tiles_equal_the_plain_ones():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 6])
        item, doc = [rng.randint(1, letters) for _ in range(rng.randint(0, 20))], [rng.randint(0, letters) for _ in range(rng.randint(0, 36))]
        want = plain_tiles([x or 100 + k for k, x in enumerate(doc)], item, 3)  # 0 is a word of no item
        assert decontaminate.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3) == want


def test_bound_on_coverage_loses_no_leak():
    """The count before tiling, and tiling on shared stretches alone, against tiling every item on every text."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 16)))) for k in range(60)]
    bench = decontaminate.Benchmark(items, 3, 3)
    for _ in range(60):
        text = " ".join(rng.choices(words + ["other", "more"], k=rng.randint(0, 60)))
        want = []
        for k, t in items:
            own, doc = t.split(), text.split()
            n = min(3, len(own))
            if any(doc[j : j + n] == own[p : p + n] for j in range(len(doc) - n + 1) for p in range(len(own) - n + 1)):
                made = plain_tiles(doc, own, n)
                covered, top = sum(x[0] for x in made), max((x[0] for x in made), default=0)
                if covered >= 0.7 * len(own) or top >= 9:
                    want.append((k, len(own), covered, len(made), top))
        assert bench.leaks(text, 0.7, 9) == want


def test_hot_phrase_and_repeated_words():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(20_000)]
    bench = decontaminate.Benchmark([(k, "which of the following statements " + " ".join(rng.choices(words, k=40))) for k in range(8000)], 5, 3)
    text = " ".join(rng.choices(words, k=500)) + " which of the following statements " + " ".join(rng.choices(words, k=500))
    began = time.monotonic()
    assert bench.leaks(text, 0.7) == [] and time.monotonic() - began < 0.5  # some 5 ms
    zeros = decontaminate.Benchmark([(0, "zero " * 300), (1, "zero one " * 3000)], 5, 3)
    began = time.monotonic()
    assert zeros.leaks("zero " * 1_000_000, 0.7) == [(0, 300, 300, 1, 300)]
    assert zeros.leaks("one zero zero " * 50_000 + "zero one " * 50_000, 0.7) == [(1, 6000, 6000, 1, 6000)]
    assert time.monotonic() - began < 30


def test_contaminated_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 25)))) for k in range(12)] + [(99, " ".join(f"w{k}" for k in range(200)))]
    texts = []
    for _ in range(60):
        words = rng.choices("abcdefghijklmnopqrst", k=rng.randint(0, 40))
        own = rng.choice(items)[1].split()
        cut = rng.randint(0, len(own))
        texts.append(" ".join(rng.choice([words, words + own, own[cut:] + words + own[:cut], words + own[: max(60, cut)]])))
    texts += [None, "", texts[5], texts[5].upper() + "!", "x y " + " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(40))]

    def covered(doc, item, least):
        """Greedy string tiling by the book: mark the longest common free run, again and again."""
        free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
        while True:
            best, found = least - 1, []
            for p, t in itertools.product(range(len(item)), range(len(doc))):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and free_i[p + n] and free_d[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best >= least:
                    found.append((p, t))
            if best < least:
                return sum(tiles), max(tiles, default=0)
            for p, t in found:
                if all(free_i[p : p + best]) and all(free_d[t : t + best]):
                    free_i[p : p + best], free_d[t : t + best] = [False] * best, [False] * best
                    tiles.append(best)

    want = []
    for k, t in enumerate(texts):
        doc = decontaminate.words_of(t)
        for key, text in items:
            item = text.split()
            n = min(5, len(item))
            if {tuple(item[x : x + n]) for x in range(len(item) - n + 1)} & {tuple(doc[x : x + n]) for x in range(len(doc) - n + 1)}:
                total, longest = covered(doc, item, min(3, len(item)))
                if total >= 0.7 * len(item) or longest >= 50:
                    want.append((k, key, len(item), total, longest))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 30):
        got = decontaminate.contaminated(docs, bench, block_words=block).collect()
        assert sorted((r.doc_id, r.item_id, r.item_words, r.covered, r.longest_tile) for r in got) == sorted(want)
        assert {r.doc_id for r in decontaminate.decontaminated(docs, bench, block_words=block).collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert len(want) > 20 and any(w[1] == 99 and w[3] < 140 for w in want)


@pytest.mark.parametrize(("scored", "column", "rest"), [(toxicity.toxicity, "toxic", (4, 2)), (quality.quality, "quality", (5, 0))])
def test_held_out_labels_are_never_read(spark, scored, column, rest):
    from pyspark.sql import functions as F

    from quillon.llm.common import bucket_of

    docs, labels = (queries.read(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    flipped = labels.withColumn(column, F.when(bucket_of("doc_id", rest[0]) == rest[1], 1 - F.col(column)).otherwise(F.col(column)))
    a, b, c = ({r.doc_id: (r.score, r.held_out) for r in scored(d, x).collect()} for d, x in ((docs, labels), (docs, flipped), (docs.repartition(7), labels)))
    assert a == b
    assert a.keys() == c.keys() and all(abs(a[k][0] - c[k][0]) < 1e-9 for k in a)


def test_factorization_machine_by_the_book():
    rng = np.random.default_rng(3)
    index = np.full(toxicity.BINS, -1, np.int32)
    index[:30] = np.arange(30)
    model = toxicity.FactorizationMachine(index, 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    x = np.where(rng.random((5, 30)) < 0.4, rng.random((5, 30)), 0)
    row, at = np.nonzero(x)
    want = [model.bias + model.w @ z + sum(model.v[i] @ model.v[j] * z[i] * z[j] for i, j in itertools.combinations(range(30), 2)) for z in x]
    assert np.allclose(model.logits(row, at, x[row, at], 5), want)


def test_discriminant_by_the_book():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + c for c, n in ((0, 50), (1, 80))]
    model = quality.Discriminant(np.array([50.0, 80.0]), np.stack([z.sum(0) for z in x]), np.stack([z.T @ z for z in x]), heat=1.0)
    new = rng.normal(size=(6, 3))
    means, own = [z.mean(0) for z in x], [np.cov(z.T, bias=True) for z in x]
    pooled = (50 * own[0] + 80 * own[1]) / 130
    logs = []
    for c, n in enumerate((50, 80)):
        a = 0.15 + min(0.83, 6 / (n + 6))
        cov = (1 - a - 0.02) * own[c] + a * pooled + 0.02 * np.trace(pooled) / 3 * np.eye(3)
        far = ((new - means[c]) @ np.linalg.inv(cov) * (new - means[c])).sum(1)
        logs.append(np.log(n / 130) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * far)
    assert np.allclose(model.score(new), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_expected_counts_by_the_book():
    """Forward-backward sums against all paths, and a likelihood that never falls over rounds."""
    rng = np.random.default_rng(5)
    model = hmm.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((rng.random(2), 0), (rng.random((2, 2)), 1), (rng.random((4, 2)), 0))))
    rows = [np.array(r) for r in ([0], [1, 3, 2], [3, 3, 0, 1], [2, 0, 0, 3, 1])]
    want = hmm._zeros(4, 2)
    total = 0.0
    for ids in rows:
        paths = {p: model.start[p[0]] * np.prod([model.emit[i, s] for i, s in zip(ids, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in itertools.product(range(2), repeat=len(ids))}
        whole = sum(paths.values())
        total += math.log10(whole)
        for p, chance in paths.items():
            want[0][p[0]] += chance / whole
            for a, b in zip(p, p[1:]):
                want[1][a, b] += chance / whole
            for i, s in zip(ids, p):
                want[2][i, s] += chance / whole
    got = hmm._zeros(4, 2)
    assert abs(model.expect(rows, got) - total) < 1e-9 and all(np.allclose(a, b) for a, b in zip(got, want))
    logs = []
    for _ in range(12):
        counts = hmm._zeros(4, 2)
        logs.append(model.expect(rows, counts))
        start, move, emit = counts
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]


def test_hidden_markov_beats_its_base(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    got = hmm.hmm_scores(docs).groupBy("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).collect()
    assert all(r["sum(score)"] > r["sum(base_score)"] for r in got)


def test_start_is_bounded_with_one_repeated_id(spark):
    """A third of the rows have one id: one of them is taken, and no more rows than asked for."""
    found = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) _id", "id + 1 n_tokens", "cast(repeat('ab', int(id + 1)) as binary) ids")
    ids = hmm.starting_rows(found, 3000, 50, 10_000)
    assert 0 < len(ids) <= 50 and sum(map(len, ids)) <= 10_000 and max(map(len, ids)) <= 500 and sorted(map(bytes, ids)) == sorted(map(bytes, hmm.starting_rows(found.repartition(9), 3000, 50, 10_000)))


def plain_fusion(pages, labelled, heat=0.1, pull=5.0):
    """Page id -> (language, posterior): the fusion by loops over pages, from the definitions."""
    langs = sorted({lang for lang, _ in labelled if lang})
    counts = {lang: np.full(language.BINS, 0.5) for lang in langs}
    for lang, text in labelled:
        if lang and text:
            np.add.at(counts[lang], language.trigrams(text), 1)
    logs = {lang: np.log(c / c.sum()).astype(np.float32) for lang, c in counts.items()}

    def shares(log):
        top = max(log)
        parts = [math.exp(x - top) for x in log]
        return [p / sum(parts) for p in parts]

    seen = []
    for page, url, html in pages:
        at = language.trigrams(language.visible(html))
        told = language.declared_of(html)
        host = language.host_of(url)
        log = [heat * float(logs[lang][at].sum(dtype=np.float64)) for lang in langs]
        seen.append((page, log, shares(log), told if told in langs or told == "none" else "other", host, language.domain_of(host), host.split(".")[-1]))
    n = len(langs)
    total = [sum(x[2][k] for x in seen) for k in range(n)]
    prior = [(t + 1) / (sum(total) + n) for t in total]

    def mass(field, value):
        return [sum(x[2][k] for x in seen if x[field] == value) for k in range(n)]

    def shrunk(own, up):
        return [(c + pull * u) / (sum(own) + pull) for c, u in zip(own, up)]

    out = {}
    for page, log, _, told, host, domain, suffix in seen:
        of_host = shrunk(mass(4, host), shrunk(mass(5, domain), shrunk(mass(6, suffix), prior)))
        likely = lambda field, value: [math.log((c + 1) / (t + len({x[field] for x in seen}) + 1)) for c, t in zip(mass(field, value), total)]
        post = shares([math.log(h) + d + s + x for h, d, s, x in zip(of_host, likely(3, told), likely(6, suffix), log)])
        out[page] = (langs[post.index(max(post))], max(post))
    return out


def test_fusion_against_loops(spark):
    rng = random.Random(7)
    words = {"en": "the of and to in is that for".split(), "de": "der die und den von das mit sich".split(), "fr": "le de un et la les des est".split()}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    labelled = [(lang, text(lang, 30)) for lang in words for _ in range(6)] + [(None, "x y"), ("en", None)]
    pages = []
    for k in range(70):
        lang = rng.choice(list(words))
        host = rng.choice([f"www.{lang}-site.com", f"news.{lang}.co.uk", "mixed.org", f"a{k}.{lang}"])
        mark = rng.choice(["", f"<html lang='{lang}'>", "<html lang='en'>", "<html lang='pt'>"])
        pages.append((k, rng.choice([f"http://{host}/p", None, "no url"]) if k % 9 == 0 else f"http://{host}/p", mark + text(lang, rng.choice([0, 1, 3, 40]))))
    pages.append((99, None, None))
    got = language.language_of_pages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(labelled, "lang string, text string"))
    want = plain_fusion(pages, labelled)
    rows = {r.page_id: (r.lang, r.posterior) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(abs(rows[k][1] - want[k][1]) < 1e-4 and (rows[k][0] == want[k][0] or want[k][1] < 0.5 + 1e-3) for k in want)


def test_silent_pages_are_told_by_their_host(spark):
    """Documents as pages, of hosts that keep to a language nine times in ten; half the pages have three characters left. The text
    alone is wrong on many of these, the fused evidence on few."""
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents").filter("lang is not null and length(text) > 40").select("doc_id", "lang", "text")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    pages = docs.filter(half == 1)
    host = F.when(F.col("doc_id") % 10 == 3, F.lit("mixed")).otherwise(F.col("lang"))
    page = pages.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://www."), host, (F.col("doc_id") % 4).cast("string"), F.lit(".com/x")).alias("url"), F.when(F.col("doc_id") % 4 < 2, F.substring("text", 1, 3)).otherwise(F.col("text")).alias("html"), "lang")
    got = language.language_of_pages(page.drop("lang"), docs.filter(half == 0)).join(page.select("page_id", F.col("lang").alias("is")), "page_id").filter("page_id % 4 < 2 and page_id % 10 != 3").collect()
    right = lambda c: sum(r[c] == r["is"] for r in got) / len(got)
    assert len(got) > 100 and right("lang") > 0.97 and right("lang") > right("text_lang") + 0.1, (right("lang"), right("text_lang"))


def test_language_of_held_out_documents(spark):
    """Documents as pages: trained on one half, judged on the other."""
    from pyspark.sql import functions as F

    docs = queries.read(spark, "/root/testdata/sf0.01", "documents").filter("lang is not null and length(text) > 100")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    pages = docs.filter(half == 1).select(F.col("doc_id").alias("page_id"), F.lit("http://one.example.org/").alias("url"), F.concat(F.lit("<html><script>var the = 1</script><p>"), "text", F.lit("</p></html>")).alias("html"), "lang")
    got = language.language_of_pages(pages, docs.filter(half == 0)).join(pages.select("page_id", F.col("lang").alias("is")), "page_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("is")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97, right


def test_markup_scanners():
    assert language.visible("a<script>x</SCRIPT >b<!-- <p> --><style>d<p>e").split() == ["a", "b", "d", "e"]
    assert language.declared_of("<meta http-equiv='Content-Language' content=' fr'><html x><HTML xml:lang = \"de-AT\">") == "de"
    assert language.declared_of("<META http-equiv='Content-Language' content=fr>") == "fr" and language.declared_of("<html lang='") == "none"
    assert [language.domain_of(h) for h in ("a.b.co.uk", "www.x.org", "x.org", "", "a.site.de")] == ["b.co.uk", "x.org", "x.org", "", "site.de"]


def test_shared_passages_and_forced_rounds(spark, monkeypatch):
    """Short documents that share boilerplate and nothing else; head rounds, blocks and a short list of frequent
    tokens change no link."""
    rng = random.Random(9)
    phrase = "all rights reserved by the owner of this"
    texts = [f"{phrase} " + " ".join(rng.choices([f"v{k}" for k in range(400)], k=rng.randint(0, 9))) for _ in range(220)]
    texts += [" ".join(rng.sample(phrase.split(), 5)) for _ in range(60)] + texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    want = {i: find(i) for i in range(len(sets))}
    monkeypatch.setattr(jaccard_join, "HEAVY", 3)
    for how in ({"frequent": 2}, {"frequent": 2, "most_frequent": 5, "most_bits": 9, "block": 4}):
        assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, **how).collect()} == want


def test_boilerplate_pairs_are_few(spark, monkeypatch):
    """20,000 short documents with one boilerplate shingle: candidates stay near none."""
    docs = spark.range(20_000).selectExpr("id doc_id", "concat('all rights are reserved ', 'x', id, ' y', id, ' z', id, ' q', id * 7) text")
    made, save = {}, jaccard_join.Workspace.save

    def counting(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join.Workspace, "save", counting)
    assert jaccard_join.jaccard_join(docs).filter("doc_id = component_id").count() == 20_000
    assert made["shared"] <= 20_000 and made.get("candidates", 0) == 0


def test_pipeline_against_brute_force(spark):
    """Each stage's rows from its own input, by plain loops."""
    sf, docs = "/root/testdata/sf0.001", queries.read(spark, "/root/testdata/sf0.001", "documents")
    bench = decontaminate.Benchmark([(r.item_id, r.text) for r in queries.read(spark, sf, "benchmark").collect()], 5, 3)
    label = {r.doc_id: r.quality for r in queries.read(spark, sf, "labels").dropna(subset=["quality"]).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id for r in docs.collect()}
        if name == "quality":
            import zlib

            known = [(quality.statistics(t), label[i]) for i, t in before.items() if i in label and zlib.crc32(str(i).encode()) % 5]
            x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
            model = quality.Discriminant(np.array([(y == c).sum() for c in (0, 1)], float), np.stack([x[y == c].sum(0) for c in (0, 1)]), np.stack([x[y == c].T @ x[y == c] for c in (0, 1)]))
            want = {i for i, t in before.items() if model.score(np.array([quality.statistics(t)]))[0] >= 0.3}
        elif name == "exact_dedup":
            want = set({t: i for i, t in sorted(before.items())}.values())
        elif name == "jaccard_join":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, t.encode().lower().split()) for i, t in before.items())}
            up = {i: i for i in sets}

            def find(v, up=up):
                while up[v] != v:
                    v = up[v]
                return v

            for i, j in itertools.combinations(sorted(sets), 2):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
            want = {i for i in sets if find(i) == i}
        elif name == "decontamination":
            want = {i for i, t in before.items() if not bench.leaks(t, 0.7)}
        else:
            fit = {r.doc_id: r.kept for r in mixing.mix(spark.createDataFrame(list(before.items()), "doc_id long, text string").join(queries.read(spark, sf, "documents").drop("text"), "doc_id")).collect()}
            want = {i for i, kept in fit.items() if kept}
        assert after == want, name


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).to_numpy())) == sorted(map(tuple, want[columns].astype(str).to_numpy()))


def test_template_pages_are_not_compared(spark, monkeypatch):
    """Pages of 36 shared and 4 own words: too far apart for links, and never compared, but the one that lacks own words is."""
    made = []
    saved = jaccard_join.Workspace.save

    def counting(self, df, name):
        out = saved(self, df, name)
        if name in ("candidates", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.Workspace, "save", counting)
    shared = " ".join(f"t{k}" for k in range(36))
    rows = [(k, shared + " " + " ".join(f"x{k}y{j}" for j in range(4))) for k in range(3000)]
    plain = [(5000, shared), (5001, shared + " z0"), (5002, shared + " z1 z2 z3 z4 z5")]
    docs = spark.createDataFrame(rows + plain, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs).collect()}
    assert all(got[k] == 0 or k > 4000 for k in got)  # all link with the bare template: 33 of 37 shingles
    apart = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs.filter("doc_id < 5000")).collect()}
    assert all(k == v for k, v in apart.items()) and made[-1] == made[-2] == 0


@pytest.mark.parametrize("size", [20, 40, 90, 200])
def test_links_of_texts_of_shared_parts(spark, size):
    """Texts put together from few blocks, so that all shingles are frequent: links by plain loops."""
    rng = random.Random(size)
    blocks = [[f"b{b}w{k}" for k in range(5)] for b in range(60)]
    rows = []
    for k in range(260):
        base = random.Random(k % 20)
        own = [base.choice(blocks) for _ in range(size // 5)]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(blocks)
        rows.append((k, " ".join(w for b in own for w in b)))
    sets = [set(jaccard_join.shingle_sets([t], 4)[0].tolist()) for _, t in rows]
    low = list(range(len(rows)))

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            low[y] = x
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frequent=4).collect()}
    assert got == {k: top(k) for k in got}


def test_texts_reach_a_task_in_bounded_batches(spark):
    """By rows alone, all 64 texts of 256 KB would be one batch; decontamination and the other steps hold a few at a time."""
    size, conf = 1 << 18, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        docs = spark.range(64, numPartitions=1).select("id", F.repeat(F.lit("a"), size).alias("text"))
        assert filter_rows(docs, lambda: lambda texts: [len(texts) <= BATCH_BYTES // size + 1] * len(texts)).count() == 64
        wide = spark.range(3, numPartitions=1).select("id", F.repeat(F.lit("a"), 2 * BATCH_BYTES).alias("text"))  # more than a batch each
        assert filter_rows(wide, lambda: lambda texts: [len(t) == 2 * BATCH_BYTES for t in texts]).count() == 3
    finally:
        spark.conf.set(conf, before)
