"""URL filters: rules first, then word segmentation of hosts and naive Bayes.

Rules of host and path decide where one fits. Elsewhere host names are split into words by
Viterbi search under a unigram model, and multinomial naive Bayes, learned from URLs that
rules decide, scores the words of host and path.

The unigram counts are over all pages and never collected: pieces of the distinct host
words are joined with them. The classifier is fitted on at most SAMPLE rule-decided rows, drawn by a hash of page_id.

Edge cases: a null url or one without :// has empty host and path, no rule, and the
verdict of the class prior; without any rule-decided row the verdict is allow; repeated
rows are repeated; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import saved

#: Rules (fixed values): verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Rows that the classifier is fitted on, at most, and letters of the longest word looked for: a label of a host has no more.
SAMPLE = 20_000
LONGEST = 63
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    rows = rows.withColumn("raw", host)
    path = F.regexp_extract(F.substring("rest", F.length("raw") + 1, F.length("rest")), "^[^?#]*", 0)
    return rows.select("page_id", lowered(F.col("raw")).alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and ruling: the longest rule that fits (of equal length a block before an allow), or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return rows.withColumn("rule", name).withColumn("ruling", verdict)


def lexicon(pages: DataFrame) -> DataFrame:
    """word, logp: unigram log-probabilities of the words in all pages' html, counted with map-side combining."""
    words = pages.select(F.explode(F.split(lowered(F.coalesce(F.col("html").cast("string"), F.lit(""))), "[^a-z]+")).alias("word"))
    counts = saved(words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("word", F.log(F.col("n") / F.lit(float(total))).alias("logp")), total


def segment(name: str, logp: dict[str, float], total: float) -> list[str]:
    """The most probable split of a name; a piece that is no known word costs a factor of ten for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            piece = name[start:end]
            score = logp.get(piece, -math.log(total) - len(piece) * math.log(10))
            options.append((best[start][0] + score, start))
        best.append(max(options))
    out, at = [], len(name)
    while at:
        out.append(name[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def host_words(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """host, words: the segmented words of each distinct host."""
    hosts = rows.select("host").distinct()
    names = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("name")).select("name").distinct()
    known, total = lexicon(pages)
    n = F.length("name")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(i + LONGEST - 1, n)), lambda j: F.substring("name", i, j - i + 1))))
    pieces = names.select("name", F.explode(F.array_distinct(cuts)).alias("word")).where(F.length("word") >= 2)
    # a name has at most LONGEST pieces for each of its letters
    priced = pieces.join(known, "word").groupBy("name").agg(F.collect_list(F.struct("word", "logp")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [segment(name, {p["word"]: p["logp"] for p in pieces or []}, total) for name, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    split = names.join(priced, "name", "left").select("name", "pieces").mapInArrow(run, "name string, words array<string>")
    parts = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("at", "name"))
    return parts.join(split, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))


def path_words(path: str) -> list[str]:
    return [w if not w.isdigit() else "0" * len(w) for w in re.findall("[a-z]+|[0-9]+", path.lower())]


class Bayes:
    """Multinomial naive Bayes of block against allow, with add-one smoothing."""

    def __init__(self, rows: list[tuple[list[str], str]]):
        counts = {"allow": Counter(), "block": Counter()}
        seen = Counter(kind for _, kind in rows)
        for words, kind in rows:
            counts[kind].update(words)
        vocabulary = [w for w, _ in sorted((counts["allow"] + counts["block"]).items(), key=lambda x: (-x[1], x[0]))]
        size = {k: sum(c[w] for w in vocabulary) + len(vocabulary) for k, c in counts.items()}
        self.prior = math.log((seen["block"] + 1) / (seen["allow"] + 1)) if rows else -1.0
        self.odds = {w: math.log((counts["block"][w] + 1) / size["block"]) - math.log((counts["allow"][w] + 1) / size["allow"]) for w in vocabulary}

    def score(self, words: list[str]) -> float:
        """Log-odds of block."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def tokens(host: list[str] | None, path: str) -> list[str]:
    return [f"h:{w}" for w in host or []] + [f"p:{w}" for w in path_words(path)]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-odds of block) for every row."""
    rows = ruled(parsed(pages), rules)
    words = saved(host_words(rows, pages))
    full = rows.join(words, "host", "left")
    sample = full.where("ruling is not null").orderBy(F.xxhash64("page_id"), "host", "path").limit(SAMPLE).select("words", "path", "ruling").collect()
    model = Bayes([(tokens(r["words"], r["path"]), r["ruling"]) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule", "ruling")]
            score = [model.score(tokens(w, p)) for w, p in zip(batch.column("words").to_pylist(), cols[2].to_pylist(), strict=True)]
            verdict = [r or ("block" if s > 0 else "allow") for r, s in zip(cols[4].to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols[:4], pa.array(verdict, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return full.select("page_id", "host", "path", "rule", "ruling", "words").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
