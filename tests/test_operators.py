"""Joins, graphs, audits, learning, mining, sources and streaming."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from factlens import queries as Q
from factlens.operators import aggregates as A
from factlens.operators import audits as U
from factlens.operators import graph as G
from factlens.operators import joins as J
from factlens.operators import learn as L
from factlens.operators import mining as M
from factlens.plans import pattern as P
from factlens.schema import RELATIONS, conform, empty
from factlens.sources import annotations as notes
from factlens.sources import files, rust
from factlens.streaming import life


def site(**over):
    return over


def frame(spark, relation, *rows):
    return conform(spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", RELATIONS[relation]).alias("r")).select("r.*"), relation) if rows else empty(spark, relation)


def test_unaddressed(spark):
    fn = lambda n: {"kind": "fn", "a": n}
    at = {"class": "C", "match_kind": "explicit", "file": "a.rs", "canonical_path": None}
    sites = frame(spark, "sites", at | {"line": 1, "target": fn("x")}, at | {"line": 2, "target": fn("y")}, at | {"line": 3, "target": {"kind": "unknown"}}, at | {"line": 4, "target": {"kind": "impl_fn", "a": "S<T>", "b": "go", "c": "Run"}}, at | {"line": 5, "target": fn("x"), "canonical_path": "crate1"}, at | {"line": 6, "class": "D", "target": fn("x")})
    imm = frame(spark, "immunities", {"class": "C", "file": "a.rs", "target": fn("x")}, {"class": "C", "file": "a.rs", "target": {"kind": "unknown"}})
    tol = frame(spark, "tolerances", {"class": "C", "file": "a.rs", "target": {"kind": "trait_fn", "a": "Run", "b": "go"}})
    dfn = frame(spark, "defenses", {"class": "D", "file": "elsewhere.rs", "target": fn("t")})
    cls = frame(spark, "classes", {"type_name": "C"})
    got = J.unaddressed(sites, imm, tol, dfn, cls).orderBy("line").collect()
    assert [(r["line"], r["class_known"]) for r in got] == [(2, True), (3, True), (5, False)]


def test_orphans_and_rekey(spark):
    cls = frame(spark, "classes", {"type_name": "A", "canonical_path": "m1"}, {"type_name": "B", "canonical_path": "m1"}, {"type_name": "B", "canonical_path": "m2"})
    edges = frame(spark, "lineage", {"child": "A", "parent": "B", "child_path": "x", "parent_path": "m1"}, {"child": "Z", "parent": "Q"})
    assert [r["parent"] for r in J.orphaned_lineage(edges, cls).collect()] == ["Q"]
    out, amb = J.rekey(edges, cls, "child", "child_path")
    assert sorted((r["child"], r["child_path"]) for r in out.collect()) == [("A", "m1"), ("Z", None)]
    out, amb = J.rekey(edges, cls, "parent", "parent_path")
    assert [(r["name"], r["members"]) for r in amb.collect()] == [("B", ["m1", "m2"])]


def plain_closure(edges):
    pairs = set(edges)
    while True:
        more = {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs
        if not more:
            return pairs
        pairs |= more


def test_graph(spark):
    random.seed(2)
    edges = [(random.randrange(25), random.randrange(25)) for _ in range(35)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {(r["src"], r["dst"]) for r in G.closure(df).collect()}
    assert got == plain_closure(set(edges))
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a")], "src string, dst string")
    assert sorted(tuple(r["cycle"]) for r in G.cycles(ring).collect()) == [("a", "b", "c"), ("d",)]
    ring.createOrReplaceTempView("ring")
    assert {(r["src"], r["dst"]) for r in spark.sql(G.closure_sql("ring")).collect()} == plain_closure({("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a")})
    assert [(r["start"], r["reach"]) for r in G.blast_from(ring, spark.createDataFrame([("e",)], "node string")).collect()] == [("e", 3)]


def test_diamond_inherits_once(spark):
    cls = frame(spark, "classes", *({"type_name": n} for n in ("Top", "Left", "Right", "Bottom")))
    edges = frame(spark, "lineage", *({"child": c, "parent": p} for c, p in (("Left", "Top"), ("Right", "Top"), ("Bottom", "Left"), ("Bottom", "Right"), ("Bottom", "Gone"))))
    sites = frame(spark, "sites", {"class": "Top", "file": "a", "line": 1})
    got = sorted((r["class"], r["inherited_from"], r["explicit"]) for r in G.inherit_sites(sites, edges, cls).collect())
    assert got == [("Bottom", ["Top"], False), ("Left", ["Top"], False), ("Right", ["Top"], False), ("Top", [], True)]


def test_audits(spark):
    as_of = F.lit("2026-01-31").cast("date")
    cases = {
        ("anergy", "2026-01-31", None, None): "anergy-active", ("anergy", "2026-01-01", None, None): "anergy-costimulation-not-arrived", ("anergy", "2025-12-31", None, None): "anergy-stale", ("anergy", "soon", None, None): "anergy-costimulation-not-arrived",
        ("anergy", "", None, None): "anergy-active", ("orient", None, None, None): "orient-active", ("orient", "2026-01-30", None, None): "orient-pending-action-required", ("poxparty", "2025-01-01", None, None): "poxparty-outcome-pending",
        ("immunosuppress", "2026-12-31", "2026-01-01", 30): "immunosuppress-active", ("immunosuppress", "2026-12-31", "2026-01-01", 29): "immunosuppress-duration-cap-exceeded",
        ("immunosuppress", "2026-12-31", "2026-01-01", None): "immunosuppress-active", ("immunosuppress", "2026/01/01", "soon", 1): "immunosuppress-expired",
    }
    rows = frame(spark, "deferred", *({"kind": k, "until": u, "since": s, "duration_cap": c} for k, u, s, c in cases))
    got = U.audit_deferred(rows, as_of).collect()
    assert [r["hint"] for r in got] == list(cases.values())
    assert [r["state"] for r in got] == ["active" if h.endswith("-active") else "stale" if h in ("anergy-stale", "immunosuppress-duration-cap-exceeded") else "expired" for h in cases.values()]
    functions = spark.createDataFrame([("t", "a", "fn"), ("dup", "a", "fn"), ("dup", "b", "fn")], RELATIONS["functions"])
    imm = frame(spark, "immunities", *({"witness": w} for w in (None, "clippy :: all", "Proof :: < X >::new()", "a::t()", "dup", "none", "P::<Option<X>>::t", "my_clippy_lint", "cargo::t", "verus::x")))
    found = {r["witness"]: (r["status"], r["tier"]) for r in U.audit_witness(imm, functions).collect()}
    assert [found[r["witness"]] for r in imm.collect()] == [("missing", "none"), ("external", "reachability"), ("phantom", "formal_proof"), ("resolved", "reachability"), ("ambiguous", "reachability"), ("not_found", "none"), ("resolved", "reachability"), ("external", "reachability"), ("resolved", "reachability"), ("external", "reachability")]
    verdict = U.presentation_verdict(
        spark.createDataFrame([(1, "explicit", None), (2, "explicit", "p"), (3, "explicit", "p"), (4, "fingerprint", None)], "site_id long, match_kind string, proof string"), spark.createDataFrame([(1,)], "site_id long"),
        spark.createDataFrame([], "site_id long, tier string"), spark.createDataFrame([(3, False, None), (3, True, "execution"), (2, None, None)], "site_id long, passed boolean, tier string"),
    )
    assert sorted((r["site_id"], r["verdict"], r["tier"]) for r in verdict.collect()) == [(1, "defended", "reachability"), (2, "defended", "formal_proof"), (3, "substrate_gap", "none")]
    orders = frame(spark, "work_orders", {"kind": "panel", "items": ["m::f"]}, {"kind": "panel", "items": ["zz"], "frame": "2026-01-01"}, {"kind": "rx", "filled_by": ["a"], "reviewed_by": ["b"]}, {"kind": "culture", "frame": "never"})
    labels = spark.createDataFrame([(["x::m::f"],)], "labels array<string>")
    assert [r["verdict"] for r in U.audit_prescriptive(orders, labels, as_of).collect()] == ["fulfilled", "overdue", "fulfilled", "out_of_frame"]
    ev = frame(spark, "evidence", {"kind": "diagnostic", "modalities": ["a", "a"], "min_independent": 2}, {"kind": "clonal", "iterations": 100, "seed_kind": "random"})
    assert [r["hints"] for r in U.audit_convergent(ev).collect()] == [["modalities_collapse", "modality_repeated"], []]


def test_supply_chain(spark):
    from factlens.plans.predicate import parse

    p = parse({"any_of": [{"dep_pinned": {"crate_name": "a"}}, {"sandbox_clean": {"crate_name": "b"}}]})
    assert U.supply_chain(p, {("dep_pinned", "a"): "pinned"}) == (True, [("dep_pinned", "pinned")])
    assert U.supply_chain(parse({"not": {"dep_pinned": {"crate_name": "a"}}}), {}) == (True, [])
    texts = spark.createDataFrame([("Cargo.toml", '[package]\nname = "x"\n[dependencies]\na = "=1.0" # pin\nb = { version = "2", features = [] }\nc = { path = "../c" }\n[dev-dependencies.d]\nversion = "3"\n')], "file string, text string")
    got = sorted((r["name"], r["version"], r["section"]) for r in files.read_manifest(texts).collect())
    assert got == [("a", "=1.0", "dependencies"), ("b", "2", "dependencies"), ("c", None, "dependencies"), ("d", "3", "dev-dependencies")]
    assert U.dep_pinned(files.read_manifest(texts)).first()["failing"] == ["b", "d"]
    lock = files.read_lockfile(spark.createDataFrame([("l", '[[package]]\nname = "a"\nversion = "1"\nchecksum = "ff"\n\n[[package]]\nname = "b"\nversion = "2"\n')], "file string, text string"))
    assert sorted((r["name"], r["version"], r["checksum"]) for r in lock.collect()) == [("a", "1", "ff"), ("b", "2", None)]


def test_record_before_lock(spark):
    wanted = spark.createDataFrame([(n, "1") for n in "abcdef"], "name string, version string")
    lock = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("d", "1", "x"), ("f", "2", "x")], "name string, version string, checksum string")
    records = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("c", "1", "x"), ("d", "1", None), ("f", "1", "x")], "name string, version string, checksum string")
    got = {r["name"]: r["state"] for r in U.content_hash(wanted, lock, records).collect()}
    assert got == {"a": "matches", "b": "mismatch", "c": "absent_in_lock", "d": "malformed", "e": "no_record", "f": "absent_in_lock"}


def test_boundary_kinds(spark):
    rows = spark.createDataFrame([("api-request",), ("ApiRequest",), ("iframe",), ("network",)], "boundary_kind string").withColumn("rationale", F.lit("x" * 20))
    assert [r["boundary_kind"] for r in notes.violations(rows, "boundaries").collect()] == ["network"]


def test_long_chains_close(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(80)], "src long, dst long")
    assert G.closure(edges).count() == 80 * 81 // 2
    assert sorted(r["src"] for r in G.depth_exceeded(edges).collect()) == list(range(16))


def test_mining(spark):
    commits = spark.createDataFrame([("1", None, "start", ["a"], False, 1), ("2", "1", "Fix crash", ["a", "b"], False, 2), ("3", "2", "prefix only", ["b"], False, 3), ("4", "3", "closes #12", ["c"], True, 4)], RELATIONS["commits"])
    assert [r["id"] for r in M.fix_commits(commits).collect()] == ["2"]
    blamed = spark.createDataFrame([("2", "1", "a"), ("2", "2", "a"), ("2", "1", "a")], RELATIONS["blamed"])
    assert [tuple(r) for r in M.mine_blame(commits, blamed).collect()] == [("1", "2", "a")]
    assert [tuple(r) for r in M.mine_first_parent(commits).collect()] == [("1", "2", "")]
    assert sorted(tuple(r) for r in M.recurrence_counts(commits, spark.createDataFrame([("b",), ("z",)], "path string"), 2).collect()) == [("b", 1), ("z", 0)]


def test_lineage_fidelity():
    patterns = {"p": 'item = impl, doc_contains("unsafe")', "ok": 'item = impl, doc_contains("unsafe block")', "kind": 'item = fn, doc_contains("unsafe")', "doc": "item = impl, is_unsafe"}
    assert U.lineage_fidelity([(c, "p") for c in ("ok", "kind", "doc", "gone")], patterns) == [("doc", "p", "doc_not_refined"), ("kind", "p", "kind_differs")]


def test_drift():
    assert L.detect_axis([0.9] * 40 + [0.1] * 40, 0.025)["cut"] == 40
    assert L.detect_axis([0.5] * 200, 0.025)["state"] == "no_drift"
    assert L.detect_axis([0.9] * 4 + [0.1] * 4, 0.025)["state"] == "under_powered"
    assert L.detect_axis([0.5, float("nan")], 0.1)["state"] == "non_finite"
    h = L.ExponentialHistogram().extend([1.0] * 100)
    assert h.count == 100 and h.mean == 1.0 and all(sum(b[0] == s for b in h.buckets) <= 5 for s, _ in h.buckets)


def test_learning(spark):
    src = "impl Drop for A { fn drop(&mut self) { x.unwrap(); log(); } }\nimpl Drop for B { fn drop(&mut self) { y.expect(1); log(); } }"
    clean = "impl Drop for C { fn drop(&mut self) { log(); } }\nfn f() { z.unwrap(); }\nimpl D { fn g() { w.unwrap(); } }"
    items = lambda t: rust.parse_items(spark.createDataFrame([("a", t)], "file string, text string"))[0]
    cluster, corpus = items(src).withColumn("member", F.col("line")), items(clean).withColumn("index", F.col("line"))
    pattern, state = L.propose(cluster, corpus)
    assert str(pattern) == 'all_of([item = impl, impl_of_trait("Drop"), body_calls("log"), any_of([body_calls("expect"), body_calls("unwrap")])])' and state == "promoted"
    assert L.confidence(2, pattern) == "high" and not L.degenerate(pattern)
    assert L.score_all([pattern], cluster, corpus) == [(1.0, 1.0)]
    best, score, _ = L.mature(P.parse('all_of([item = impl, body_calls("log"), body_calls("unwrap")])'), cluster, corpus)
    assert L.dominates(score, (0.5, 1.0)) or score == (0.5, 1.0)
    assert L.promote(pattern, corpus.where("false")) == "empty_clean" and L.promote(P.parse("item = impl"), corpus) == "no_discriminator"
    r = spark.range(1).select(L.curate(F.lit("obsolete"), F.lit(False)).alias("a"), L.curate(F.lit("obsolete"), F.lit(True)).alias("b")).first()
    assert (r["a"], r["b"]) == ("forget", "keep")


def test_outline_parser(spark):
    text = '#[presents(foo::Bar, proof = "x")]\npub const unsafe fn f<T>(a: &\'static str) -> u8 { transmute::<u8, u8>(1) }\nenum E { A, B(u8, u8), C { x: u8 }, }\n/* fn no() { */\nstruct S;'
    found, marked, failed = rust.parse_items(spark.createDataFrame([("a", text), ("b", "fn x() {"), ("c", None)], "file string, text string"))
    rows = {r["name"]: r for r in found.collect()}
    assert set(rows) == {"f", "E", "S"} and rows["E"]["variant_count"] == 3 and rows["f"]["body_calls"] == ["transmute"] and rows["f"]["is_const"] and rows["S"]["body_calls"] is None
    assert [r["file"] for r in failed.collect()] == ["b"]
    assert [(r["class"], r["proof"]) for r in notes.extract_notes(marked, "sites").collect()] == [("Bar", "x")]


def test_tree_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}")
    (tmp_path / "target/b.rs").write_text("fn b() {}")
    (tmp_path / "src/c.txt").write_text("no")
    assert [tuple(r) for r in files.scan_tree(spark, str(tmp_path)).collect()] == [("src/a.rs", "fn a() {}")]
    assert files.scan_bundled(empty(spark, "classes")).count() == len(P.CATALOG)
    finding = frame(spark, "findings", {"file": "a", "line": 3, "severity": "high", "cluster_key": "k", "class_provenance": "constructable", "body": {"kind": "fingerprint_match", "class": "C"}}, {"body": {"kind": "mark"}})
    line, = files.flycheck_lines(finding).collect()
    message = json.loads(line["value"])["message"]
    assert message["level"] == "warning" and message["code"] == {"code": "factlens::C", "explanation": None} and message["rendered"] == "warning: " + message["message"]
    assert message["children"][0]["level"] == "note" and message["spans"] == [{"file_name": "a", "line_start": 3, "line_end": 3, "column_start": 1, "column_end": 1, "is_primary": True}]
    assert A.session_clusters(finding).first()["provenance"] == "constructable"
    files.write_report(finding, str(tmp_path / "out"), tool_version="1", revision=None, generated="2026-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "out/envelope")).first()["rows"] == 2


def test_sidecars_missing_and_invalid(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"item_path": "a", "current_digest": "d", "fresh_through": "2026-01-01"}))
    rows = files.read_sidecars(spark, str(tmp_path))
    got = {r["item_path"]: r["document_state"] for r in files.with_sidecars(spark.createDataFrame([("a",), ("b",)], "item_path string"), rows).collect()}
    assert got == {"a": "read", "b": "missing"} and rows.first()["fresh_through"] == dt.date(2026, 1, 1)


def test_stream_state(spark, tmp_path):
    spark.createDataFrame([("c", 0.5), ("c", 1.0), ("d", 0.0)], "class string, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("class string, score double").parquet(str(tmp_path / "in"))
    q = life.score_means(stream).writeStream.format("memory").queryName("means").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("means").collect()) == [("c", 2, 0.75), ("d", 1, 0.0)]


def test_queries_are_complete():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) >= 35


def test_blast_radius_reads_every_order(spark, tmp_path):
    spark.createDataFrame([(97, 0, 1), (98, 1, 2), (99, 2, 3)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, Q.blast_radius(spark, str(tmp_path)).collect())) == [(0, 3), (1, 2), (2, 1)]


def test_szz_reads_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "a long way to go before the bug"), (1, 3, "user", "b"), (3, 1, "user", "a long way to go, a fixture")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in Q.szz_pairs(spark, str(tmp_path)).collect()] == [("1-0", "1-1", "")]
