"""Every operator over tables with nulls, empty and long texts, repeated rows, further columns with clashing names, and no rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlens.llm import bpe, chat, decontam, jaccard, langid, licenses, linededup, pii, quality, urls
from factlens.llm import queries as registered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that steps of an operator could give to columns of their own.
CLASHING = ["_", "_doc", "a", "b", "tok", "token", "row", "rows", "line", "line_no", "hash", "kept", "component", "component_id", "start", "found", "score", "value", "n", "n_words", "item_id", "lang_pred", "rule", "host", "path", "words", "level", "id", "errors"]
LONG = " ".join(f"word{k % 997}" for k in range(60_000))
ITEM = "the quick brown fox of the meadow jumps over a rather lazy dog that sleeps beside the old stone bridge at noon today"
TEXTS = ["", " \n\t\n", "a", "one line here\none line here\nanother line of text", LONG, LONG + " end", f"before {ITEM} after", "ab@cd.de and 4111 1111 1111 1111", "été à Zürich — naïve", "\n".join(["same line in all of them"] * 3)]


def documents(spark):
    rows = [(k, t, "en" if k % 2 else "de", "web", len(t)) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[4], rows[6], (90, None, None, None, None), (None, "a text without a name", None, None, None), (None, None, None, None, None), (91, TEXTS[3], "en", None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (1, ITEM)], "item_id long, text string")


def network():
    return langid.Network(["de", "en"])


OPERATORS = {
    "op1": lambda s, d: quality.judge(d),
    "op3": lambda s, d: linededup.report(d),
    "op3_deduplicate": lambda s, d: linededup.deduplicate(d),
    "op4": lambda s, d: decontam.matches(d, benchmark(s)),
    "op4_decontaminate": lambda s, d: decontam.decontaminate(d, benchmark(s)),
    "op5": lambda s, d: bpe.encode_documents(d, registered.vocabulary(), keep_ids=False),
    "op7": lambda s, d: pii.digest(pii.find(d)),
    "op8": lambda s, d: langid.identify(d, network()),
    "op8_keep": lambda s, d: langid.keep_known(d, network(), 0.0),
    "op9": lambda s, d: licenses.scan(d),
    "op10": lambda s, d: jaccard.join(d),
    "op10_deduplicate": lambda s, d: jaccard.deduplicate(d),
}


def rows_of(frame, without=()):
    names = sorted(c for c in frame.columns if c not in without)
    return sorted((repr([r[n] for n in names]) for r in frame.collect()))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edges(spark, name):
    run, docs = OPERATORS[name], documents(spark)
    plain = run(spark, docs)
    passes = set(docs.columns) <= set(plain.columns)
    extra = docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))
    wide = run(spark, extra)
    assert not passes or set(extra.columns) <= set(wide.columns)
    assert rows_of(plain) == rows_of(wide, CLASHING if passes else ())
    empty = run(spark, docs.where("false"))
    assert empty.count() == 0 and empty.columns == plain.columns


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, "https://www.example.com/en/a", "<p>some words here</p>"), (1, "https://www.example.com/en/a", "<p>some words here</p>"), (2, None, None), (None, "no host", ""), (3, "http://x.net/es/", None), (4, "", "<p>" * 1000)], "page_id long, url string, html string")
    plain = urls.judge(pages)
    assert plain.count() == 6 and {r["verdict"] for r in plain.collect()} <= {"allow", "block"}
    wide = urls.judge(pages.select("*", *(F.lit(7).alias(c) for c in CLASHING)))
    assert rows_of(plain) == rows_of(wide, () if set(CLASHING) - set(wide.columns) else CLASHING)
    empty = urls.judge(pages.where("false"))
    assert empty.count() == 0 and empty.columns == plain.columns


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", ""), (2, 0, None, "x"), (None, 0, "user", "y"), (3, None, "user", "z"), (4, 0, "user", "long " * 50_000), (4, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plain = chat.format_conversations(turns)
    wide = chat.format_conversations(turns.select("*", *(F.lit(7).alias(c) for c in CLASHING)))
    assert rows_of(plain) == rows_of(wide)
    empty = chat.format_conversations(turns.where("false"))
    assert empty.count() == 0 and empty.columns == plain.columns


def test_language_against_a_plain_network():
    """Windows, filters, pooling and the mean over windows, recomputed a window and a filter at a time."""
    r = np.random.RandomState(1)
    net = langid.Network(["de", "en", "fr"])
    for t in [x for taps in net.taps for x in taps] + net.bias + [net.out, net.out_bias]:
        t[...] = r.normal(0, 0.5, t.shape)
    net.fold()
    texts = ["a few words", "é" * 300 + " und so weiter", "word " * 700, "123 456", "", None, "x"]
    got, score = langid.judge_texts(pa.array(texts, pa.string()), net)
    for text, lang, p in zip(texts, got, score, strict=True):
        data = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (lang, p) == (langid.UNKNOWN, 0.0)
            continue
        total = np.zeros(3)
        for a in range(0, len(data), langid.WINDOW):
            part = data[a : a + langid.WINDOW]
            codes = [int(langid._CLASS[b]) for b in part] + [0] * (langid.WINDOW - len(part))
            pooled = []
            for k, w in enumerate(langid.WIDTHS):
                each = [sum(net.taps[k][j][codes[i + j]] for j in range(w)) for i in range(len(codes) - w + 1)]
                pooled += list(np.maximum(np.max(each, axis=0) + net.bias[k], 0))
            z = np.array(pooled) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            total += e / e.sum() * len(part)
        total /= total.sum()
        assert lang == net.languages[int(total.argmax())] and abs(p - total.max()) < 1e-4
