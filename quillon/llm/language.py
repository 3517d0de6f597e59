"""Language identification by Bayesian evidence fusion.

A page's posterior over languages is

    log p(l | page) = log prior(l | host) + log p(declared | l) + log p(suffix | l) + heat * log p(text | l) + const

* text: hashed byte trigrams of the visible text, whose counts by language come from all labelled documents;
* declared: the markup's ``lang`` (or content-language), and suffix: the last label of the host, two categorical
  evidences whose tables p(value | l) are estimated by grouped aggregation of the text posteriors, so a site
  generator that always declares English is worth little;
* host priors: soft counts by host, shrunk to those of its domain, shrunk to those of its suffix, shrunk to all.

Trigrams overlap and repeat, so the text's log-likelihood is tempered by ``heat``.

A language is a column of every table here: more than ``most_languages`` (counted first) are refused with an error, as
they point to a dirty ``lang`` column.

Cases: null or empty pages have only their address as evidence, a null address an empty host; a page with neither
gets the overall prior. Languages are the distinct non-null ``lang`` of the labelled documents; without any the
result has null language. Unknown declared languages are one value ``other``, absent ones ``none``. Ties go to the
first language by name. Repeated rows and ids are judged row by row; empty tables give an empty result. Very long
texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_batches, named, on_workers

BINS = 1 << 16
HIDDEN = re.compile(r"<(?:(script|style|noscript|template)\b|!--)", re.I)
TAG = re.compile(r"<[^<>]*>")
ROOT_OR_META = re.compile(r"<(html|meta)\b", re.I)
LANG = re.compile(r"""\b(?:xml:)?lang\s*+=\s*+(?:["']\s*+)?([a-z]{2,3})""", re.I)
NAMED, CONTENT = re.compile("content-language", re.I), re.compile(r"""content\s*+=\s*+(?:["']\s*+)?([a-z]{2,3})""", re.I)
HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def _ends() -> dict:
    """How each hidden element ends."""
    return {None: re.compile("-->"), **{k: re.compile(rf"</{k}\s*+>", re.I) for k in ("script", "style", "noscript", "template")}}


ENDS = _ends()


def without_hidden(page: str) -> str:
    """The page without scripts, styles and comments. One that never ends hides nothing, and is looked for but once:
    the time is linear whatever stands unclosed."""
    out, at, pos, endless = [], 0, 0, set()
    while m := HIDDEN.search(page, pos):
        kind = m.group(1).lower() if m.group(1) else None
        end = None if kind in endless else ENDS[kind].search(page, m.end())
        if end:
            out += [page[at : m.start()], " "]
            at = pos = end.end()
        else:
            endless.add(kind)
            pos = m.end()
    return "".join(out) + page[at:]


def visible(page: str | None) -> str:
    return html.unescape(TAG.sub(" ", without_hidden(page))) if page else ""


def declared_of(page: str | None) -> str:
    """The language that the first html tag with one declares, else the first meta tag of content-language. Tags are
    cut out first, each read once; one that never ends runs to the end of the page and is the last."""
    said = {"html": None, "meta": None}
    pos = 0
    while page and (m := ROOT_OR_META.search(page, pos)):
        kind, end = m.group(1).lower(), page.find(">", m.end())
        pos = len(page) if end < 0 else end + 1
        if said[kind] is None:
            start = m if kind == "html" else NAMED.search(page, m.end(), pos)
            found = start and (LANG if kind == "html" else CONTENT).search(page, start.end(), pos)
            said[kind] = found.group(1).lower() if found else None
            if said["html"]:
                break
    return said["html"] or said["meta"] or "none"


def domain_of(host: str) -> str:
    """The last two labels, or three where the last has two letters and the one before it at most three (``co.uk``)."""
    p = host.split(".")
    return ".".join(p[-3:] if len(p) > 2 and len(p[-1]) == 2 and len(p[-2]) <= 3 else p[-2:])


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found.group(1).lower().rstrip(".") if found else ""


def trigrams(text: str) -> np.ndarray:
    """Bins of the byte trigrams of the lower-cased text; runs of white space count as one space."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    x = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(16)).astype(np.int64)


def trigram_counts(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts by language and bin over all rows (lang, text), added up in two levels."""
    number = {v: k for k, v in enumerate(languages)}
    on_workers(labelled.sparkSession)

    def run(batches):
        counts = np.zeros((len(number), BINS), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang in number and text:
                        counts[number[lang]] += np.bincount(trigrams(text), minlength=BINS)
        salt = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_pydict({"lang": list(range(len(counts))), "salt": [salt] * len(counts), "n": [c.tobytes() for c in counts]}, pa.schema([("lang", pa.int32()), ("salt", pa.int32()), ("n", pa.binary())]))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["n"].to_pylist())
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["lang", "salt"][: len(key)] + ["n"])

    level = labelled.select("lang", "text").mapInArrow(run, "lang int, salt int, n binary").groupBy("lang", "salt").applyInArrow(add, "lang int, salt int, n binary")
    out = np.zeros((len(languages), BINS), np.int64)
    for lang, n in level.select("lang", "n").groupBy("lang").applyInArrow(add, "lang int, n binary").collect():  # languages x BINS counts
        out[lang] = np.frombuffer(n, np.int64)
    return out


def language_of_pages(pages: DataFrame, labelled: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", lang_column: str = "lang", text_column: str = "text", heat: float = 0.1, pull: float = 5.0, most_languages: int = 256) -> DataFrame:
    """One row per page row: id, lang, posterior, text_lang, declared, host, suffix."""
    spark = pages.sparkSession
    ws, id_type = Workspace(spark, "language"), pages.schema[id_column].dataType.simpleString()
    docs = labelled.select(named(lang_column).alias("lang"), named(text_column).alias("text"))
    languages = sorted(r[0] for r in docs.select("lang").distinct().dropna().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages are labelled")
    counts = trigram_counts(docs, languages) + 0.5
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)) if languages else np.zeros((BINS, 0), np.float32))
    names = set(languages)

    def make():
        def step(cols: dict) -> dict:
            logs, declared = [], []
            for page in cols["html"]:
                at = trigrams(visible(page))
                logs.append((heat * sent.value[at].sum(0, dtype=np.float64)).tolist())
                said = declared_of(page)
                declared.append(said if said in names or said == "none" else "other")
            hosts = [host_of(u) for u in cols["url"]]
            labels = [h.split(".") for h in hosts]
            return {"row_id": cols["row_id"], "_id": cols["_id"], "logs": logs, "declared": declared, "host": hosts, "domain": [domain_of(h) for h in hosts], "suffix": [p[-1] for p in labels]}

        return step

    source = pages.select(F.monotonically_increasing_id().alias("row_id"), named(id_column).alias("_id"), named(url_column).alias("url"), named(html_column).alias("html"))
    found = ws.save(map_batches(source, make, f"row_id bigint, _id {id_type}, logs array<double>, declared string, host string, domain string, suffix string", rows=128), "found")
    if not languages:
        return found.select(F.col("_id").alias(id_column), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix")
    n, each = len(languages), range(len(languages))

    def normal(logs: list) -> list:
        top = F.greatest(*logs) if n > 1 else logs[0]
        parts = [F.exp(x - top) for x in logs]
        return [p / sum(parts[1:], parts[0]) for p in parts]

    soft = found.select("row_id", "declared", "host", "domain", "suffix", *(x.alias(f"s{k}") for k, x in zip(each, normal([F.col("logs")[k] for k in each]))))
    sums = [F.sum(f"s{k}").alias(f"c{k}") for k in each]
    by = lambda *keys: soft.groupBy(*keys).agg(*sums)
    overall = soft.agg(*sums).first()
    total = [float(x or 0) for x in overall]
    prior = [(t + 1.0) / (sum(total) + n) for t in total]

    def table(key: str) -> DataFrame:
        """log p(value | l), smoothed over the values that occur."""
        rows = by(key)
        values = rows.count() + 1
        return rows.select(key, *(F.log((F.col(f"c{k}") + 1.0) / (total[k] + values)).alias(f"{key}_{k}") for k in each))

    def shrunk(rows: DataFrame, up: list) -> list:
        size = sum((F.col(f"c{k}") for k in each[1:]), F.col("c0"))
        return [((F.col(f"c{k}") + pull * up[k]) / (size + pull)).alias(f"p{k}") for k in each]

    of_suffix = by("suffix").select("suffix", *shrunk(soft, [F.lit(p) for p in prior]))
    of_domain = by("domain", "suffix").join(of_suffix, "suffix").select("domain", *shrunk(soft, [F.col(f"p{k}") for k in each]))
    of_host = by("host", "domain").join(of_domain, "domain").select("host", *shrunk(soft, [F.col(f"p{k}") for k in each]))
    of_host = ws.save(of_host, "hosts")
    declared, suffix = ws.save(table("declared"), "declared"), ws.save(table("suffix"), "suffixes")
    both = found.join(of_host, "host").join(F.broadcast(declared), "declared").join(suffix, "suffix")  # declared has at most languages + 2 rows
    logs = [F.log(f"p{k}") + F.col(f"declared_{k}") + F.col(f"suffix_{k}") + F.col("logs")[k] for k in each]
    both = both.select("*", F.array(*normal(logs)).alias("post"))
    best = lambda c: F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position(c, F.array_max(c)).cast("int"))
    return both.select(F.col("_id").alias(id_column), best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"), best(F.col("logs")).alias("text_lang"), "declared", "host", "suffix")
