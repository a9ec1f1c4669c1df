"""Operators that join and group, against brute force; personal data and chat formatting."""

import hashlib
import json
import random
import re

import pytest

from factlens.llm import chat, components, jaccard, linededup, pii
from factlens.llm import queries as registered

lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def closure(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    words = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passage, rows = words(30), [None, "", " \n", "a b", "A  b", "a b c", "x" * 5000]
    for _ in range(40):
        t = words(random.randint(3, 150)) + (passage if random.random() < 0.5 else [])
        for _ in range(random.choice([1, 1, 2, 6])):
            u = list(t)
            for _ in range(random.randint(0, 1 + len(t) // 25)):
                u[random.randrange(len(u))] = random.choice(vocabulary)
            rows.append(" ".join(u))
        rows.append(rows[-1])
    chain = words(80)
    for _ in range(25):
        chain = list(chain)
        chain[random.randrange(80)] = random.choice(vocabulary)
        rows.append(" ".join(chain))
    big = words(90)
    rows += [" ".join(w if random.random() > 0.02 else random.choice(vocabulary) for w in big) for _ in range(60)]
    rows += [" ".join(passage + words(random.randint(0, 15))) for _ in range(40)]
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, slots", [(6, 1 << 22), (64, 1 << 22), (64, 16)])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, slots):
    monkeypatch.setattr(jaccard, "SLOTS", slots)  # a table of levels that is full changes the order, not the answer
    rows = corpus(seed)
    sets = {d: shingle_set(t) for d, t in rows}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    docs = spark.createDataFrame([*((d, t, 0) for d, t in rows), (None, "no id", 0)], "doc_id long, text string, component long").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_sets_are_the_same_wherever_they_stand():
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t in corpus(5)]
    whole = jaccard.set_hash(*jaccard.sets_of(pa.array(texts, pa.string())))
    alone = [jaccard.set_hash(*jaccard.sets_of(pa.array([t], pa.string())))[0] for t in texts]
    assert np.array_equal(whole, np.array(alone))


def test_one_row_of_a_document_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, "other words stand here now", "c"), (4, None, "d"), (4, None, "d")], "doc_id long, text string, _ string")
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(docs).collect()) == [1, 3, 4]
    twice = spark.createDataFrame([(7, "one line here\nanother line there"), (7, "one line here\nanother line there")], "doc_id long, text string")
    assert [tuple(r) for r in linededup.report(twice).collect()] == [(7, 2, 0, [])]


def test_joins_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0 and linededup.report(none).count() == 0


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {n: c for n, c in closure({x for e in edges for x in e}, edges).items() if n in nodes}


def test_line_dedup_against_all_pairs(spark):
    random.seed(9)
    letters = "abcdefghijklmnop "
    lines = ["".join(random.choice(letters) for _ in range(random.randint(1, 90))) for _ in range(40)]
    near = lambda x: x[: len(x) // 2] + random.choice("xyzé") + x[len(x) // 2 + 1 :]
    rows = [(d, "\n".join(random.choice([random.choice(lines), near(random.choice(lines)), "", "  "]) for _ in range(6))) for d in range(40)] + [(50, None), (51, ""), (52, "\n")]
    uses = [(d, k, lower(x)) for d, t in rows for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    sets = {x: {x[i : i + 7] for i in range(max(1, len(x) - 6))} for _, _, x in uses}
    group = closure(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    first = {}
    for d, k, x in sorted(uses):
        first.setdefault(group[x], (d, k))
    docs = spark.createDataFrame([(d, t, len(t or ""), "z") for d, t in rows], "doc_id long, text string, n_chars long, _lost string")
    got = {r["doc_id"]: (r["n_lines"], list(r["dropped"])) for r in linededup.report(docs).collect()}
    want = {d: (sum(u[0] == d for u in uses), [k for e, k, x in sorted(uses) if e == d and first[group[x]] != (e, k)]) for d, _ in rows}
    assert sum(got[d] != want[d] for d in want) <= 1  # banding finds 0.995 of pairs at the threshold
    kept = {r["doc_id"]: r["text"] for r in linededup.deduplicate(docs).collect()}
    for d, t in rows:
        n, dropped = got[d]
        if n and n == len(dropped):
            assert d not in kept
        else:
            assert kept[d] == (t if not dropped else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped))


def test_a_long_band_holds_several_groups(spark, monkeypatch):
    r = random.Random(4)
    line = lambda: "".join(r.choice("abcdefghijklmnop ") for _ in range(100))
    put = lambda x, at: x[:at] + r.choice("qrstuvwxyz") + r.choice("QRSTUVWXYZ") + x[at + 2 :]
    first, second, chain = line(), line(), [line()]
    lines = [put(first, 40) for _ in range(150)] + [put(second, 60) for _ in range(100)]
    while len(chain) < 30:
        chain.append(put(chain[-1], 3 * len(chain)))
    lines += chain + [y for _ in range(10) for x in [line()] for y in (x, put(x, 20))] + [line() for _ in range(9)]
    texts = dict(enumerate(dict.fromkeys(lines)))
    sets = {k: {x[i : i + 7] for i in range(94)} for k, x in texts.items()}
    want = closure(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    lists = spark.createDataFrame([(1, k, 1) for k in texts], "tok long, set long, uses int")
    frame = spark.createDataFrame(list(texts.items()), "set long, text string")
    none = spark.createDataFrame([], "a long, b long")
    for tile in (512, 40):
        monkeypatch.setattr(linededup, "TILE", tile)
        found = linededup.settle(none, lists, frame).collect()
        assert {k: want[k] for k in want if list(want.values()).count(want[k]) > 1} == {x["node"]: x["component"] for x in found}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d - 9 * (d > 9) for i, c in enumerate(reversed(digits)) for d in [int(c) * (1 + i % 2)]) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_personal_data(spark):
    random.seed(2)
    texts = [None, "", "a@b.com_y@c.de", "4111 1111 1111 1111", "😀 +1 (276) 555-5999 1.2.3.4.5.6.7.8 001.2.3.255", "1 " * 3000, "a" * 30000, "a." * 5000 + "@b.c" + ".d" * 5000]
    for alphabet in ("aZ09.@-_ +%()😀é\n48", "0123456789 -+.4"):
        texts += ["".join(random.choice(alphabet) for _ in range(random.randint(0, 90))) for _ in range(600)]
    rows = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [want.count(k + ":") for k in BASE]
        assert not set(filter(None, want.split(","))) - set(r["spans"].split(","))


def test_checksums_and_context(spark):
    texts = [(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "DE88 3704 0044 0532 0130 00"), (3, "my SSN 123-45-6789"), (4, "code 123-45-6789")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:7:18", 4: ""}


def test_an_iban_ends_with_its_own_length(spark):
    spaced, solid = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    texts = [f"IBAN {spaced} Bank", f"{solid} BIC COBADEFF", f"{solid} 15 EUR", f"{solid} GB82WEST12345698765432", f"AB12 {spaced}", f"{solid}1", f"{solid}x", f"DE12 {spaced}", f"😀 {spaced} X"]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert {d: ",".join(x for x in got[d].split(",") if x.startswith("iban")) for d in got} == {0: "iban:5:32", 1: "iban:0:22", 2: "iban:0:22", 3: "iban:0:22,iban:23:45", 4: "iban:5:32", 5: "", 6: "", 7: "iban:5:32", 8: "iban:2:29"}


def test_tool_calls(spark):
    calls = [(1, 0, "a", "reply", '{"turn": 1, "prompt": "x"}', []), (1, 2, "b", "reply", '{"prompt": 5, "odd": 1}', ["a"]), (1, 4, "c", "other", "{}", ["b", "zz"]), (1, 6, "d", "reply", "no json", ["e"]), (1, 8, "e", "reply", '{"prompt":"é\\n","turn":2}', ["d"]), (2, 0, "a", "reply", '{"prompt":"y","turn":3}', [])]
    results = [("a", 1, "one"), ("a", 3, "later"), ("b", 3, 'say "hi"'), (None, 5, "lost"), ("q", 5, "no call")]
    frame = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, id string, name string, arguments string, after array<string>"), spark.createDataFrame(results, "id string, turn long, content string"))
    rows = {(r["conv_id"], r["id"]): r for r in frame.collect()}
    assert len(rows) == 6
    assert rows[1, "b"]["level"] == 1 and rows[1, "b"]["errors"] == ["prompt: not STRING", "turn: missing", "odd: unknown"]
    assert rows[1, "c"]["level"] == 2 and rows[1, "c"]["errors"] == ["unknown tool", "no result"]
    assert rows[1, "d"]["errors"] == ["arguments: no object", "no result", "cycle"] and rows[1, "e"]["level"] is None
    assert rows[1, "a"]["errors"] == ["id: used twice"] and rows[1, "a"]["result_turn"] == 1
    for r in rows.values():
        assert json.loads(r["json"])["id"] == r["id"]
    assert rows[1, "b"]["json"] == '{"arguments":{"odd":1,"prompt":5},"id":"b","name":"reply","result":"say \\"hi\\""}'


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "r"), (2, 0, "system", "s"), (3, 0, None, "t"), (None, 0, "user", "u"), (4, 1, "assistant", "only")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn").collect()
    assert [(r["id"], r["level"], r["valid"]) for r in got] == [("call-1-0", 0, True), ("call-1-2", 1, False)]


def test_messages_as_json(spark):
    call = json.dumps({"tool_calls": [{"id": "k", "name": "reply", "arguments": '{"prompt":"p","turn":1}', "after": None}]})
    m = spark.createDataFrame([(1, 0, "assistant", call), (1, 1, "tool", json.dumps({"tool_call_id": "k", "content": "ok"})), (1, 2, "user", "plain"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    row, = chat.link(*chat.from_messages(m)).collect()
    assert row["valid"] and row["result_turn"] == 1


def test_sieve_never_loses_a_member(spark):
    import numpy as np

    values = np.random.RandomState(1).randint(-(1 << 62), 1 << 62, 3000)
    bits = components.sieve(spark.createDataFrame([(int(v),) for v in values[:1000]], "v long"))
    assert components.in_sieve(bits, values[:1000]).all() and components.in_sieve(bits, values[1000:]).mean() < 0.01


def test_registered():
    assert sorted(k.split("_")[0] for k in registered.queries() if k.startswith("op")) == sorted(f"op{n}" for n in range(1, 11))


def test_many_spans_in_one_text(spark):
    """Blocks of spans join without a seam, words before a span are seen across it, and time does not grow with the square."""
    one = "call +1 (555) 010-9999 or a@b.de é "
    n = 3 * pii.BLOCK + 1
    rows = spark.createDataFrame([(1, one * n), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(rows)).collect()}
    places = [(i * len(one), k) for i in range(n) for k in (0, 1)]
    spans = ",".join(f"phone:{at + 5}:{at + 22}" if k == 0 else f"email:{at + 26}:{at + 32}" for at, k in places)
    assert got[1]["spans"] == spans and got[1]["n_phone"] == got[1]["n_email"] == n
    assert got[1]["scores"][0] > pii.SCORES["phone"] and len(set(got[1]["scores"][::2])) == 1
    assert got[2]["spans"] == got[3]["spans"] == ""
    assert pii.digest(pii.find(rows.where("false"))).count() == 0
