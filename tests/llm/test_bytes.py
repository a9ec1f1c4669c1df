"""Operators that read bytes, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factlens.llm import bpe, decontam, kernels, langid, licenses, quality, urls
from factlens.llm import queries as registered

SPACE = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "a", "a a a a", "x\ny\nx\n x", "\x1c\x85\u00a0é", "😀 # * <a|b>", "word " * 5000, "one two three\none two three\n" * 3]


def test_words_are_the_maximal_runs():
    data, offsets = kernels.utf8(pa.array(ODD))
    start, end, row = kernels.words(data, offsets)
    got = [[] for _ in ODD]
    for s, e, r in zip(start, end, row, strict=True):
        got[r].append(data[s:e].tobytes().decode())
    assert got == [re.findall(SPACE, t or "") for t in ODD]


def test_spans_hash_alike_only_if_equal():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = kernels.Rolling(data).spans(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def plain_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts():
    random.seed(4)
    texts = [t for t in ODD if len(t or "") < 1000] + ["".join(random.choice("ab c\n#é") for _ in range(random.randint(0, 150))) for _ in range(300)]
    data, offsets = kernels.utf8(pa.array(texts))
    got = np.stack(quality._features(data, offsets)[:5], 1).tolist()
    assert got == [plain_counts(t) for t in texts]


def test_quality_learns_which_rules_tell_apart(spark):
    good = [(i, "The quick brown fox number %d jumps over a lazy dog in the wide green field today. " % i * 1 + " ".join(f"w{i}x{k}" for k in range(80)) + ".") for i in range(40)]
    bad = [(100 + i, " ".join(f"word{k}### $$$" for k in range(60))) for i in range(6)]
    rows = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(good + bad + [(999, None)], "doc_id long, text string")).collect()}
    assert all(rows[i]["kept"] for i, _ in good) and not any(rows[i]["kept"] for i, _ in bad)
    assert rows[999]["base_failed"] and rows[999]["n_words"] == 0


def test_quality_of_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def model():
    return bpe.load(registered.vocabulary())


def test_bpe_is_the_library(model):
    random.seed(1)
    letters = "etaoinshr  'sd.,!éÈüßñİΣσ日本½_-\n\t\x1f\x85́😀"
    texts = ["", "Don't STOP <|endoftext|>now<|startoftext|>", "a<|ENDOFTEXT|>b", "'S'Re'", "\x00a\x1cb", "x" * 3000]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        want = model.library.encode(t, add_special_tokens=False).ids
        found = model.encode(t)
        assert [int(i) for f in found for i in f[0].split()] == want
        assert " ".join(f[1] for f in found) == model.library.decode(want, skip_special_tokens=False) == bpe.decode(model, want)


def test_bpe_query_columns(spark, model):
    rows = bpe.encode_documents(spark.createDataFrame([(1, None), (2, "Hello there")], "doc_id long, text string"), registered.vocabulary()).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == rows[0]["decoded_sha256"] == empty and list(rows[0]["ids"]) == []
    ids = model.library.encode("Hello there", add_special_tokens=False).ids
    assert list(rows[1]["ids"]) == ids and rows[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def plain_edits(pattern, text):
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        row = [i + 1]
        for j, c in enumerate(text):
            row.append(min(before[j] + (p != c), before[j + 1] + 1, row[j] + 1))
        before = row
    return min(before)


def test_banded_alignment():
    random.seed(5)
    for _ in range(400):
        p = bytes(random.choice(b"abcd") for _ in range(random.randint(15, 50)))
        t = bytearray(p)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(t))
            [lambda: t.__setitem__(k, 97), lambda: t.pop(k), lambda: t.insert(k, 98)][random.randrange(3)]()
        t = b"xy" + bytes(t) + b"zz"
        got, want = decontam.align(p, t, 3), plain_edits(p, t)
        assert (got is None) == (want > 3) and (got is None or got[0] == want)


def test_decontamination_finds_planted_passages(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(40)) for i in range(5)] + [(7, "short one"), (8, None), (9, "...")]
    edited = list(items[1][1])
    edited[40], edited[120] = "#", "q"
    docs = [(0, prose(80)), (1, prose(50) + " " + items[0][1].upper() + "\n" + prose(9)), (2, prose(9) + " " + "".join(edited)), (3, None), (4, ""), (5, "a Short, one here"), (6, items[2][1][:60] + prose(60))]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 0), (2, 1), (5, 7)]
    none = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def test_decontamination_finds_a_quote_of_a_long_item(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(0, prose(60)[:341]), (1, prose(400)[:2000])]
    docs = [(0, prose(30) + " " + items[0][1][90:260] + " " + prose(30)), (1, prose(9) + " " + items[1][1][500:1400]), (2, items[1][1][1003:1123]), (3, prose(90)), (4, prose(20) + items[1][1][10:70] + prose(20))]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(docs, bench)
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(0, 0), (1, 1), (2, 1)]
    assert sorted(x["doc_id"] for x in decontam.decontaminate(docs, bench).collect()) == [3, 4]


def test_decontamination_does_not_depend_on_neighbours(spark):
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(k, prose(70)[:300]) for k in range(6)]
    # a document that ends with the first part of an item, and one that begins with the rest
    texts = [t for k, x in items for t in (prose(20) + x[:75], x[75:] + prose(20), prose(10) + x[:150] + "zz" + x[150:])] + [prose(60) for _ in range(10)] + [items[0][1], items[0][1], None, ""]
    rows = list(enumerate(texts))

    def plain(text):
        return re.sub("[\x00-/:-@\\[-`{-\x7f]+", " ", (text or "").lower())

    def found(text, item):  # a segment within its edit budget at some place
        return any(plain_edits(item[s:e], text) <= decontam.edits(e - s) for s, e in decontam._segments(len(item))) if text else False

    want = {(d, k) for d, t in rows for k, x in items if found(plain(t), plain(x).strip())}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 2, 5):
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert {(x["doc_id"], x["item_id"]) for x in decontam.matches(docs, bench).collect()} == want


def test_quality_against_plain_expectation_maximisation(spark):
    import math
    from collections import Counter

    r = random.Random(12)
    good = lambda: "\n".join(" ".join(r.choice(["some", "useful", "words", "about", "many", "things", f"w{r.randrange(400)}"]) for _ in range(12)) + "." for _ in range(r.randint(5, 9)))
    bad = lambda: "\n".join(["## $$ %% 12 34"] * r.randint(8, 20)) if r.random() < 0.6 else " ".join(["BUY", "NOW"] * r.randint(20, 60))
    docs = spark.createDataFrame([*((k, good() if k % 3 else bad()) for k in range(150)), (200, None), (201, "")], "doc_id long, text string")
    names = list(quality.rules())
    votes = {x["doc_id"]: tuple(x[n] for n in names) for x in quality.features(docs).select("doc_id", *(v.alias(n) for n, v in quality.rules().items())).collect()}
    start = {c: quality.START[c] for c in ("bad", "good")}
    share, table = 0.9, {c: [list(start[c]) for _ in names] for c in start}
    counts = Counter(votes.values())

    def odds(j, v):
        x = math.log(table["good"][j][v + 1] / table["bad"][j][v + 1])
        return min(x, 0) if v < 0 else max(x, 0) if v > 0 else 0.0

    def posterior(p):
        return 1 / (1 + math.exp(-max(-50, min(50, math.log(share / (1 - share)) + sum(odds(j, v) for j, v in enumerate(p))))))

    for _ in range(100):
        post = {p: posterior(p) for p in counts}
        share = min(0.99, max(0.05, (sum(n * post[p] for p, n in counts.items()) + 9) / (sum(counts.values()) + 10)))
        for c in start:
            weight = {p: n * (post[p] if c == "good" else 1 - post[p]) for p, n in counts.items()}
            total = sum(weight.values())
            for j in range(len(names)):
                table[c][j] = [(sum(w for p, w in weight.items() if p[j] == v - 1) + (quality.PRIOR * total + 1) * start[c][v]) / ((1 + quality.PRIOR) * total + 1) for v in range(3)]
    for x in quality.judge(docs).collect():
        want = posterior(votes[x["doc_id"]])
        assert abs(x["quality"] - want) < 1e-6 and x["kept"] == (not x["base_failed"] and want >= 0.5)


def test_licenses_against_plain_containment(spark):
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    filler = " ".join(f"filler{k}" for k in range(300))
    docs = [(i, f"{filler}\n{t}\n{filler}") for i, t in enumerate(t for v in licenses.TEMPLATES.values() for t in v)] + [(90, None), (91, filler), (92, "license MIT")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        have = {tuple(words(text or "")[i : i + 5]) for i in range(len(words(text or "")))}
        for name, variants in licenses.TEMPLATES.items():
            for v in variants:
                own = {tuple(words(v)[i : i + 5]) for i in range(len(words(v)) - 4)}
                if own and len(own & have) >= 0.8 * len(own):
                    want.add((d, name))
    assert got == want


def test_language_network_learns(spark):
    random.seed(8)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dosq", "tresk", "quatro"]}
    rows = [(i, " ".join(random.choice(words[lang]) for _ in range(80)), lang) for i in range(200) for lang in ["xx" if i % 2 else "yy"]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34 ...", "xx"), (902, "", None)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 198
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.fit(docs.where("false")).languages == ["und"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    some = [None, "", "nothing", "http://", "http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/", "http://a.www.example.com/en/x", "http://b.net/es/1", "http://net/fr/", "http://x.net/de/", "http://com", "http://com/", "x://y?://z/", "http://spamfarm.org/buy/pills", "http://É.com/en/"]
    pages = spark.createDataFrame([(i, u, "buy spam farm pills now") for i, u in enumerate(some)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(rows) == len(some)
    for i, u in enumerate(some):
        host, path = plain_url(u)
        rule, verdict = plain_rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == verdict if verdict else rows[i]["verdict"] in ("allow", "block")


def test_url_verdicts_against_a_plain_model(spark):
    import functools
    import math
    from collections import Counter

    r = random.Random(13)
    words = ["spam", "farm", "news", "shop", "blue", "garden"]
    rows = [(k, f"http://{r.choice(words)}{r.choice(words)}.{r.choice(['com', 'net', 'org', 'example.com'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.choice(words)}-{r.randrange(99)}", " ".join(r.choice(words) for _ in range(20))) for k in range(120)]
    lexicon = Counter(w for _, _, h in rows for w in re.split("[^a-z]+", h) if len(w) > 1)
    total = sum(lexicon.values())
    price = lambda w: math.log(lexicon[w] / total) if w in lexicon else -math.log(total) - len(w) * math.log(10)

    @functools.cache
    def best(name):
        return max(((price(name[:k]) + best(name[k:])[0], [name[:k], *best(name[k:])[1]]) for k in range(1, len(name) + 1)), key=lambda x: x[0]) if name else (0.0, [])

    def tokens(host, path):
        return [f"h:{w}" for n in re.findall("[a-z]+", host) for w in best(n)[1]] + [f"p:{w if not w.isdigit() else '0' * len(w)}" for w in re.findall("[a-z]+|[0-9]+", path.lower())]

    seen = [(tokens(*plain_url(u)), plain_rule(*plain_url(u))[1]) for _, u, _ in rows]
    count = {c: Counter(t for ts, v in seen if v == c for t in ts) for c in ("allow", "block")}
    known = set(count["allow"]) | set(count["block"])
    size = {c: sum(count[c].values()) + len(known) for c in count}
    n = Counter(v for _, v in seen)
    log_odds = lambda ts: math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(math.log((count["block"][t] + 1) / size["block"]) - math.log((count["allow"][t] + 1) / size["allow"]) for t in ts if t in known)
    got = {x["page_id"]: x for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert n["allow"] and n["block"] and n[None]
    for (k, _, _), (ts, rule) in zip(rows, seen, strict=True):
        assert abs(got[k]["score"] - log_odds(ts)) < 1e-6 and got[k]["verdict"] == (rule or ("block" if log_odds(ts) > 0 else "allow"))


def test_segmentation_is_the_best_split():
    import math

    logp = {w: math.log(p) for w, p in {"spam": 0.2, "farm": 0.2, "far": 0.1, "mspa": 0.1}.items()}
    assert urls.segment("spamfarm", logp, 100) == ["spam", "farm"]
    assert urls.segment("", logp, 100) == [] and "".join(urls.segment("zzspamq", logp, 100)) == "zzspamq"
