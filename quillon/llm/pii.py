"""Personal data: base patterns plus information-theoretic sanitisation of the terms around them.

Base spans are the four contract kinds. A protected entity is a value found by them (one address, one number) or,
more generally, its kind. For each word within ``REACH`` words of a span the corpus gives

    pmi(t; c) = log2( n(t, c) * T / (n(t) * n(c)) ),   ic(c) = -log2( n(c) / T )

with n(t) the word's occurrences in the whole corpus, n(t, c) those inside windows of c, n(c) the words inside
windows of c and T all words. ``disclosure = pmi / ic`` is 1 when a word occurs nowhere else: it then gives the
entity away even after the value is masked. Words at or above the threshold of a value are removed, those at or
above the threshold of a kind are generalised, wherever they stand in any text outside base spans; both need a least
number of distinct windows, so that copies of one text or a single chance meeting are no evidence.

One pass over the texts writes spans and window words; a second counts the candidate words over all texts; a third
finds the disclosing words in all texts. The second is left out where no word has windows enough, the third where no
word discloses. Up to ``most_words`` of them (counted first) are broadcast; more are met by
a shuffled join.

Cases: null text is empty and has no spans. Rows are told apart by position, so repeated rows and repeated or null
ids each get their own result. Very long texts are read whole and in linear time. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, Workspace, map_batches, named

KINDS = ("email", "ip", "card", "phone")
MAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REACH, WINDOW_CHARS = 5, 120
BITS = 1 << 22


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of name@host.host, leftmost first; found from each @ so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and MAIL_NAME.match(text[start - 1]):
            start -= 1
        host = MAIL_HOST.match(text, at) if start < at else None
        if host:
            out.append((start, host.end()))
            last = host.end()
        else:
            last = max(last, start)  # what was walked over ends at this @ and can't start a later match
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBER_CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the contract's kinds in their order, then by start; code points, end exclusive."""
    if not text:
        return []
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones)) for a, b in find(text)]


def outside(spans: list[tuple[str, int, int]]):
    """A function that tells by bisection whether a stretch (start, end) meets none of the spans."""
    inside = sorted((a, b) for _, a, b in spans)
    starts, ends = [a for a, _ in inside], list(accumulate((b for _, b in inside), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)  # spans that begin before the end
        return not k or ends[k - 1] <= start

    return free


def window_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int]]:
    """(word, kind, value hash, window hash) of the words near each span; words inside spans don't count."""
    out, free = [], outside(spans)
    for kind, a, b in spans:
        value = xxhash.xxh3_64_intdigest(f"{kind}:{text[a:b].lower()}".encode("utf-8", "surrogatepass")) - (1 << 63)
        before = [(m.group().lower(), m.start(), m.end()) for m in LETTERS.finditer(text, max(0, a - WINDOW_CHARS), a)][-REACH:]
        after = [(m.group().lower(), m.start(), m.end()) for m in LETTERS.finditer(text, b, min(len(text), b + WINDOW_CHARS))][:REACH]
        words = before + after
        window = xxhash.xxh3_64_intdigest(" ".join(w for w, _, _ in words).encode("utf-8", "surrogatepass")) - (1 << 63)
        out += [(w, kind, value, window) for w, s, e in words if free(s, e)]
    return out


def places(text: str | None, wanted) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words outside base spans that ``wanted`` holds."""
    if not text or not any(map(wanted.__contains__, map(str.lower, LETTERS.findall(text)))):
        return []
    free = outside(base_spans(text))
    found = ((m.group().lower(), m.start(), m.end()) for m in LETTERS.finditer(text))
    return [(w, a, b) for w, a, b in found if w in wanted and free(a, b)]


class Slots:
    """A set of words known by their slots only: it may hold others too."""

    def __init__(self, words: DataFrame) -> None:
        bits = np.zeros(BITS, bool)
        slots = words.select((F.crc32(F.col("word").cast("binary")) % BITS).cast("int").alias("b")).distinct().toPandas()["b"]  # at most BITS integers
        bits[slots.to_numpy(np.int64)] = True
        self.bits = np.packbits(bits)

    def __contains__(self, word: str) -> bool:
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BITS
        return bool(self.bits[slot >> 3] >> (7 - (slot & 7)) & 1)


def term_spans(texts: DataFrame, actions: DataFrame, most_words: int) -> DataFrame:
    """(row_id, term_spans) of the rows of texts in which words of ``actions`` (word, action) stand."""
    spark, kind = texts.sparkSession, "array<struct<start:int,stop:int,action:string>>"
    small = actions.count() <= most_words
    sent = spark.sparkContext.broadcast({r["word"]: r["action"] for r in actions.collect()} if small else Slots(actions))

    def mark():
        wanted = sent.value

        def step(cols: dict) -> dict:
            out: dict = {"row_id": [], "spots": []}
            for row_id, text in zip(cols["row_id"], cols["text"]):
                spots = places(text, wanted)
                if spots:
                    out["row_id"].append(row_id)
                    out["spots"].append([{"start": a, "stop": b, **({"action": wanted[w]} if small else {"word": w})} for w, a, b in spots])
            return out

        return step

    spots = map_batches(texts.select("row_id", "text"), mark, f"row_id bigint, spots {kind if small else kind.replace('action', 'word')}")
    if small:
        return spots.withColumnRenamed("spots", "term_spans")
    met = spots.select("row_id", F.explode("spots").alias("s")).select("row_id", "s.*").join(actions, "word")
    return met.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "action"))).alias("term_spans"))


def disclosing(texts: DataFrame, found: DataFrame, near: DataFrame, pairs: DataFrame, ws: Workspace, value_threshold: float, kind_threshold: float) -> DataFrame | None:
    """(word, action), written, of the words at or above a threshold; None if no word is evidence at all."""
    if pairs.isEmpty():
        return None
    sent = texts.sparkSession.sparkContext.broadcast(Slots(pairs))

    def count():
        wanted = sent.value

        def step(cols: dict) -> dict:
            seen: Counter = Counter()
            for t in cols["text"]:
                if t:
                    seen.update(LETTERS.findall(t.lower()))
            kept = [(w, n) for w, n in seen.items() if w in wanted]
            return {"word": [w for w, _ in kept], "n_t": [n for _, n in kept]}

        return step

    counts = map_batches(texts.select("text"), count, "word string, n_t bigint", rows=4096).groupBy("word").agg(F.sum("n_t").alias("n_t"))
    total = found.agg(F.sum("n_words")).first()[0] or 1
    n_kind = near.groupBy("kind").agg(F.count("*").alias("n_c")).withColumn("value", F.lit(None).cast("long"))
    n_value = near.join(F.broadcast(pairs.select("kind").distinct()), "kind").groupBy("kind", "value").agg(F.count("*").alias("n_c"))
    sizes = n_value.unionByName(n_kind)
    scored = pairs.join(counts, "word").join(sizes, [pairs.kind == sizes.kind, pairs.value.eqNullSafe(sizes.value)]).drop(sizes.kind, sizes.value)
    ic = -F.log2(F.col("n_c") / total)
    pmi = F.log2(F.col("n_tc") * F.lit(float(total)) / (F.col("n_t") * F.col("n_c")))
    scored = scored.withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(0.0)).filter(F.col("disclosure") >= F.when(F.col("level") == "value", value_threshold).otherwise(kind_threshold))
    scored = ws.save(scored.select("word", "kind", "value", "level", "disclosure"), "disclosing")
    return ws.save(scored.groupBy("word").agg(F.when(F.max("level") == "value", "remove").otherwise("generalise").alias("action")), "actions")  # remove outranks generalise


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", value_threshold: float = 0.9, kind_threshold: float = 0.9, least_value_windows: int = 3, least_kind_windows: int = 5, most_words: int = 200_000) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, term_spans (array of start, end, action)."""
    ws = Workspace(docs.sparkSession, "pii")
    kind_of_id = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), named(id_column).alias("_id"), named(text_column).alias("text"))

    def scan():
        def step(cols: dict) -> dict:
            spans = [base_spans(t) for t in cols["text"]]
            out = {"row_id": cols["row_id"], "_id": cols["_id"], "base": [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans]}
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(k == kind for k, _, _ in s) for s in spans]
            keys = ("word", "kind", "value", "window")
            out["near"] = [[dict(zip(keys, w)) for w in window_words(t, s)] if s else [] for t, s in zip(cols["text"], spans)]
            out["n_words"] = [len(LETTERS.findall(t)) if t else 0 for t in cols["text"]]
            return out

        return step

    near = "array<struct<word:string,kind:string,value:bigint,window:bigint>>"
    found = ws.save(map_batches(texts, scan, f"row_id bigint, _id {kind_of_id}, base string, " + ", ".join(f"n_{k} bigint" for k in KINDS) + f", near {near}, n_words bigint"), "found")
    near = ws.save(found.select(F.explode("near").alias("n")).select("n.*"), "near")

    # Evidence for each word and entity: an entity is a value, or with value null a whole kind.
    def evidence(keys: list[str], least: int) -> DataFrame:
        windows = near.groupBy("word", *keys, "window").agg(F.count("*").alias("n"))
        return windows.groupBy("word", *keys).agg(F.sum("n").alias("n_tc"), F.count("*").alias("windows")).filter(F.col("windows") >= least)

    of_value, of_kind = evidence(["kind", "value"], least_value_windows), evidence(["kind"], least_kind_windows)
    pairs = ws.save(of_value.withColumn("level", F.lit("value")).unionByName(of_kind.withColumn("value", F.lit(None).cast("long")).withColumn("level", F.lit("kind"))), "pairs")
    actions = disclosing(texts, found, near, pairs, ws, value_threshold, kind_threshold)
    if actions is None or actions.isEmpty():
        kind = "array<struct<start:int,stop:int,action:string>>"
        out = found.drop("near", "n_words").withColumn("term_spans", F.lit(None).cast(kind))
    else:
        out = found.drop("near", "n_words").join(term_spans(texts, actions, most_words), "row_id", "left")
    spoken = F.transform("term_spans", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["stop"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("term_spans") > 0, F.array_join(spoken, ",")))
    return out.select(F.col("_id").alias(id_column), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("term_spans"), F.lit(0)).cast("long").alias("n_term"), "term_spans")


def sanitise(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) of docs with every span masked: ``<EMAIL>`` and so on for values, ``<TERM>`` or nothing for words.

    Ids must be unique: a row of docs meets the spans of its id. A null id is an id like others, a null text stays
    null, rows that found doesn't name stay as they are, and of overlapping spans the one that starts first is masked.
    """
    marks = found.select(named(id_column).alias("_fid"), F.col("spans").alias("_spans"), F.transform(F.filter("term_spans", lambda s: s["action"] == "remove"), lambda s: s["start"]).alias("_gone"))

    def make():
        def step(cols: dict) -> dict:
            out = []
            for text, spans, gone in zip(cols["t"], cols["_spans"], cols["_gone"]):
                parts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s))
                done, at = [], 0
                for a, b, k in parts:
                    if a >= at:
                        done += [text[at:a], "" if k == "term" and a in set(gone or ()) else f"<{k.upper()}>"]
                        at = b
                out.append(None if text is None else "".join(done) + text[at:])
            return {"_id": cols["_id"], "clean": out}

        return step

    kind = docs.schema[id_column].dataType.simpleString()
    both = docs.select(named(id_column).alias("_id"), named(text_column).alias("t")).join(marks, F.col("_id").eqNullSafe(F.col("_fid")), "left").select("_id", "t", "_spans", "_gone")
    return map_batches(both, make, f"_id {kind}, clean string").toDF(id_column, text_column)
