"""The pattern language, evidence predicates and three-valued logic."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from factlens.functions import kleene, scalars
from factlens.plans import pattern as P
from factlens.plans import predicate as A
from factlens.schema import RELATIONS


def test_kleene_table(spark):
    rows = list(itertools.product([True, False, None], repeat=2))
    got = spark.createDataFrame(rows, "a boolean, b boolean").select((F.col("a") & F.col("b")).alias("x"), (F.col("a") | F.col("b")).alias("y"), (~F.col("a")).alias("z")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r["x"] == (False if False in (a, b) else None if None in (a, b) else True)
        assert r["y"] == (True if True in (a, b) else None if None in (a, b) else False)
        assert r["z"] == (None if a is None else not a)


@pytest.mark.parametrize(("values", "both", "some"), [([True, None], None, True), ([False, None], False, None), ([True], True, True), ([], True, False), ([False, True], False, True)])
def test_folds(spark, values, both, some):
    r = spark.createDataFrame([(v,) for v in values], "v boolean").agg(kleene.fold_and(F.col("v")).alias("a"), kleene.fold_or(F.col("v")).alias("o")).first()
    assert (r["a"], r["o"]) == (both, some)


BAD = ["", "not(item = fn)", "any_of([not(item = fn)])", "all_of([not(item = fn)])", "all_of([])", "item = widget", 'name = matches("")', "variants = 5..=2", 'body_calls("a::b")', 'derives(" ")', "item fn", 'doc_contains("x"', "frob", "all_of([item = fn, not(not(is_async))])"]


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    with pytest.raises(P.PatternError):
        P.parse(text)


def test_limits():
    deep = "item = fn"
    for _ in range(9):
        deep = f"all_of([{deep}])"
    P.parse(deep)
    with pytest.raises(P.PatternError):
        P.parse(f"all_of([{deep}])")
    with pytest.raises(P.PatternError):
        P.parse("any_of([" + ", ".join(["item = fn"] * 256) + "])")


def some_node(r, depth):
    text = lambda: "".join(r.choice('ab"\\\n*é _') for _ in range(r.randint(1, 6))) + "x"
    op = r.choice(P.OPERATORS[:-3] + (["all_of", "any_of"] if depth else []))
    if op in ("all_of", "any_of"):
        inside = [some_node(r, depth - 1) for _ in range(r.randint(1, 3))]
        return P.Node(op, (), tuple(inside + ([P.Node("not", (), (some_node(r, 0),))] if op == "all_of" else [])))
    if op in P.QUALIFIERS:
        return P.Node(op)
    return P.Node(op, {"item": (r.choice(P.KINDS),), "variants": (1, r.randint(1, 9)), "has_method": (text(), text())}.get(op, ("name1",) if op in P.IDENTIFIERS else (text(),)))


def test_round_trip():
    r = random.Random(7)
    for _ in range(300):
        p = P.Pattern(tuple(some_node(r, 2) for _ in range(r.randint(1, 3))))
        assert P.parse(str(p)) == p


def item(**over):
    base = dict.fromkeys(c.split()[0] for c in RELATIONS["items"].split(", "))
    return base | {"methods": [], "attr_paths": [], "derives": [], "serde_args": []} | over


def test_domains(spark):
    rows = [item(name="f", kind="fn", body_calls=["unwrap"], body_macros=[], is_async=True, is_unsafe=False), item(name="s", kind="struct"), item(name="i", kind="impl", impl_trait="Drop", body_calls=[], body_macros=["panic"], is_unsafe=True, methods=[{"name": "go", "sig": "(&self,u8)->u8"}]), item(name="e", kind="enum", variant_count=4, derives=["Clone"])]
    items = spark.createDataFrame(rows, RELATIONS["items"])
    hit = lambda t: sorted(r["name"] for r in P.match(items, t).collect())
    assert hit('body_calls("unwrap")') == ["f"]
    assert hit('all_of([name = matches("*"), not(body_calls("unwrap"))])') == ["i"]  # off its domain a leaf is undefined, and so is its negation
    assert hit('all_of([name = matches("?"), not(derives("Clone"))])') == ["f", "i", "s"]  # a full domain gives false
    assert hit('has_method("go", "(&self, n: u8) -> u8")') == ["i"]
    assert hit("variants = 4..=4") == ["e"] and hit('impl_of_trait("Drop")') == ["i"] and hit("is_async") == ["f"]
    assert sorted((r["class"], r["name"]) for r in P.match_catalog(items, [(n, p) for n, p, _ in P.catalog()]).collect()) == [("panic-in-drop", "i")]
    assert P.kind_hint(P.parse('all_of([name = matches("a"), all_of([item = impl])])')) == "impl"


def test_glob_is_over_bytes(spark):
    df = spark.createDataFrame([("é",), ("ab",), ("a.b",), ("a\nb",)], "t string")
    hit = lambda g: [r["t"] for r in df.where(scalars.glob_match(F.col("t"), g)).collect()]
    assert hit("??") == ["é", "ab"] and hit("a.b") == ["a.b"] and hit("a*b") == ["ab", "a.b", "a\nb"] and hit("A*") == []


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(scalars.fnv1a64(F.lit("a"))) == "af63dc4c8601ec8c" and val(scalars.fnv1a64(F.lit("foobar"))) == "85944171f73967e8" and val(scalars.fnv1a64(F.lit(""))) == "cbf29ce484222325"
    ge = lambda a, b: val(scalars.version_at_least(F.lit(a), F.lit(b)))
    assert ge("1.00", "1.0") and not ge("1.0", "1.00") and not ge("1.2", "1.2.0") and ge("1.10", "1.9") and ge("x", "1") is None
    assert val(scalars.is_version_tag(F.lit("v2"))) and not val(scalars.is_version_tag(F.lit("2"))) and val(scalars.is_version_tag(F.lit("2.0")))
    assert val(scalars.iso_date(F.lit("2026-1-1"))) is None and val(scalars.iso_date(F.lit("2026-01-01"))) == dt.date(2026, 1, 1)
    assert val(scalars.enum_value(F.lit("Category::SubstrateAlignment"), scalars.CATEGORIES)) == "substrate_alignment"
    assert val(scalars.strip_comment(F.lit('a = "x # y" # z'))) == 'a = "x # y"'


def sidecar(spark, **over):
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(RELATIONS["sidecars"])
    return spark.createDataFrame([tuple(({"item_path": "p", "current_digest": "d"} | over).get(f.name) for f in fields)], fields)


def signer(name="ann", role="dev", day=dt.date(2026, 1, 10), against="d", strength="gpg", depth=0, kind="fresh"):
    return (name, role, day, against, (kind, "r", "r", depth, "a long enough rationale here"), strength)


def test_predicates(spark):
    as_of = F.lit("2026-01-20").cast("date")
    ask = lambda df, p: df.select(A.compile_predicate(p, as_of).alias("x")).first()["x"]
    doc = sidecar(spark, signers=[signer(), signer("ann", "lead", against="old")], trailers=["Signed: x (role=qa)", "Signed: y"])
    both = {"signers": {"required": ["ann"], "roles": {"ann": "lead"}}}
    assert ask(doc, both) is False  # role and currency in different rows do not add up
    assert ask(doc, {"signers": {"required": ["ann"], "roles": {"ann": "lead"}, "against": "any"}}) is True
    assert ask(doc, {"signers": {"required": ["ann"], "roles": {"ann": "lead"}, "against": "any", "signature_allow": ["gpg"]}}) is False
    assert ask(doc, {"fresh_within_days": {"days": 10}}) is True and ask(doc, {"fresh_within_days": {"days": 9}}) is False
    assert ask(sidecar(spark, signers=[signer(day=dt.date(2026, 2, 1))]), {"fresh_within_days": {"days": 90}}) is False
    assert ask(sidecar(spark, signers=[signer(against="old")], fresh_through=dt.date(2026, 1, 19)), {"fresh_within_days": {"days": 90}}) is False
    assert ask(doc, {"signed_trailer": {"key": "Signed", "role": "qa"}}) is True and ask(doc, {"signed_trailer": {"key": "Signed", "count": 3}}) is False
    assert ask(doc, {"dep_pinned": {}}) is None and ask(doc, {"any_of": [{"dep_pinned": {}}, {"signed_trailer": {"key": "Signed"}}]}) is True
    assert ask(sidecar(spark), {"not": both}) is None  # no document: indeterminate
    state = doc.select(A.classify_passed().alias("c")).first()["c"]
    assert (state["tier"], state["state"], state["strength"]) == ("execution", "current", "gpg")


@pytest.mark.parametrize("bad", ["{", "[]", '{"all_of": []}', '{"signers": {"required": []}}', '{"signed_trailer": {"key": "k", "count": 0}}', '{"ratified_doc": {"anchor": ""}}', '{"ratified_doc": {"min_version": "x"}}', '{"frob": {}}'])
def test_predicate_errors(bad):
    with pytest.raises(A.PredicateError):
        A.parse(bad)


def test_oracle_rules(spark):
    schema = "path string, stewards array<struct<name:string,basis:string>>, transitions array<struct<`from`:string,`to`:string,`by`:string,`at`:date,rationale:string>>"
    day = lambda n: dt.date(2026, 1, n)
    rows = [("ok", [("a", "x"), ("b", "y")], [("draft", "review", "a", day(1), "r"), ("review", "complete", "b", day(1), "r")]), ("bad", [("a", "")], [("review", "done", "z", day(5), ""), ("draft", "x", "a", day(4), "r")])]
    got = {r["path"]: r["errors"] for r in A.oracle_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got["ok"] == [] and got["bad"] == sorted(["fewer than two stewards", "steward without basis", "transition without rationale", "author is no steward", "dates go back", "wrong from"])
