"""The pipeline on a small corpus, each stage against what plain Python says about its own input."""

import binascii
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from factlens.llm import components, langid
from factlens.llm import queries as registered


def words(r, n, alphabet):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def make(spark, folder):
    r = random.Random(3)
    text = lambda n=60: "\n".join(words(r, 15, "abcdefghij") for _ in range(n // 15))
    items = [(0, words(r, 40, "klmnopqrst"))]
    shared = words(r, 14, "abcdefghij")
    rows = [(i, text(), "en") for i in range(30)]
    one = text(90).replace("\n", " ")
    near = one.split(" ")
    near[44] = "changed"
    rows += [(40, one, "en"), (41, " ".join(near), "en"), (42, one, None)]
    rows += [(50, rows[0][1], "en"), (51, text() + "\n" + shared, "en"), (52, shared + "\n" + text(), "en")]
    rows += [(60, text() + "\n" + items[0][1].upper(), "en"), (70, None, "en"), (71, "12 ... 34", "en"), (72, "", None)]
    docs = [(d, t, lang, "s", len(t or ""), "x") for d, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _doc string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return {d: t for d, t, _ in rows}, shared


def test_stages(spark, tmp_path):
    texts, shared = make(spark, str(tmp_path))
    docs = registered.table(spark, str(tmp_path), "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = components.saved(stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
    assert set(seen["language"]) == set(texts) - {70, 71, 72}
    lines = seen["lines"]
    assert set(seen["language"]) - set(lines) == {41, 42, 50}  # all of their lines are those of earlier documents
    assert shared in lines[51]["text"] and shared not in lines[52]["text"] and lines[52]["n_chars"] == len(lines[52]["text"])
    kept = seen["near_copies"]
    sets = {d: shingles(r["text"].lower()) for d, r in lines.items()}
    for d in lines:
        first = not any(e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in lines)
        assert (d in kept) == first
    assert set(kept) - set(seen["benchmark"]) == {60}
    assert set(seen["tokens"]) == set(seen["benchmark"])
    again = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {d: r["ids_sha256"] for d, r in seen["tokens"].items()}


def test_near_copies_keep_one(spark):
    r = random.Random(5)
    base = words(r, 100, "abcdefghij")
    rows = [(i, base if i % 3 else base + f" tail{i}") for i in range(12)] + [(20, None), (21, None), (22, "x"), (23, "x")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 20, 21, 22]


def test_language_rejects_what_has_letters_but_no_learned_language(spark):
    r = random.Random(12)
    vocabulary = {"en": "the and that with have from they which would there their about", "fr": "les des une dans pour avec être cette mais vous leurs après", "de": "der die und nicht sich auch werden über schon durch können gegen", "es": "los las una para pero como más todo también desde años según"}
    prose = lambda words, n=120: " ".join(r.choice(words.split(" ")) for _ in range(n))
    rows = [(1000 * k + i, prose(v), lang) for k, (lang, v) in enumerate(vocabulary.items()) for i in range(300)]
    junk = [(9000 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(120)), None) for i in range(20)]
    unlearned = [(9100 + i, prose("hyvin kaunis sanat ovat pitkiä ihmiset puhuvat päivä kotona missä työ yksi"), None) for i in range(20)]
    docs = spark.createDataFrame(rows + junk + unlearned + [(9200, prose(vocabulary["fr"]), None)], "doc_id long, text string, lang string")
    got = {x["doc_id"] for x in corpus_pipeline.language(spark, docs, "").collect()}
    assert not got & {d for d, _, _ in junk + unlearned}
    assert 9200 in got and len(got - {9200}) >= 0.98 * len(rows)


def test_least_score_is_the_quantile_of_all_held_out_documents(spark):
    r = random.Random(21)
    net = langid.Network(["de", "en", "fr"])
    held = [d for d in range(40_000) if binascii.crc32(str(d).encode()) % 5 == 0][:7000]
    ids = set(held)
    rows = [(d, words(r, r.randint(1, 12), "abcdefghijklmnop"), r.choice(["de", "en", "fr"])) for d in held]
    # unlabelled, labelled as unknown, without a text, without an id, repeated with another label, learned from
    rows += [(held[0], "abc def", None), (held[1], "abc def", "und"), (held[2], None, "de"), (None, "abc def", "de"), (held[3], "qrs tuv", "fr"), (held[3], "qrs tuv", "de")]
    rows += [(d, "abc def", "de") for d in range(100) if d not in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    known = [(t, lang) for d, t, lang in rows if d in ids and lang not in (None, "und")]
    pred, score = langid.judge_texts(pa.array([t for t, _ in known], pa.string()), net)
    right = [s for s, p, (_, lang) in zip(score, pred, known, strict=True) if p == lang]
    assert len(right) > 1000
    assert abs(langid.least_score(docs, net) - np.quantile([1 / 3, *right], langid.LOSS)) < 1e-9
    assert langid.least_score(docs.where("lang is null"), net) == 1 / 3


def test_quantile_without_gathering(spark):
    r = random.Random(22)
    for values, shares in [([], [0.5]), ([-0.0, 1.0], [0.0, 1.0]), ([r.random() for _ in range(300)], [0.005, 0.37]), ([r.choice([0.25, 0.25 + 2**-54, 1.0]) for _ in range(300)], [0.37])]:
        scores = components.saved(spark.createDataFrame([(v,) for v in values], "score double").coalesce(2))
        for share in shares:
            assert abs(langid.quantile(scores, 0.25, share) - np.quantile([0.25, *values], share)) <= 1e-15, (values[:5], share)
