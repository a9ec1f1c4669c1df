"""Source trees to relations: declarations of every kind, their rules, and workspaces of several members."""

import datetime as dt

from pyspark.sql import functions as F

from factlens.schema import RELATIONS, conform
from factlens.sources import annotations as N

TREE = r'''
#[factlens(name = "panicking-drop", family = "drop", category = [FunctionalCorrectness, Unknown], fingerprint = "all_of([item = impl, impl_of_trait(\"Drop\"), body_calls(\"unwrap\")])")]
pub struct PanickingDrop;
#[factlens(name = "child")]
#[descended_from(crate::PanickingDrop)]
struct Child;
#[descended_from(PanickingDrop)]
fn no_type() {}
impl Drop for A { fn drop(&mut self) { x.unwrap() } }
#[presents(PanickingDrop)]
impl Drop for B { fn drop(&mut self) { x.unwrap() } }
#[factlens_tolerance(PanickingDrop, rationale = "fine, as it is", see = ["a, b", "c"])]
impl Drop for C { fn drop(&mut self) { x.unwrap() } }
impl Plain {
    #[immune(PanickingDrop, witness = tests::holds)]
    fn f(&self) {}
}
mod inner {
    #[dread(trigger = "odd")]
    trait T {
        #[presents(a::Child, proof = todo!())]
        fn g();
    }
    #[aura]
    fn h() {}
}
#[test]
#[defended_by(Child)]
fn holds() {}
#[test]
#[ignore]
fn later() {}
#[defended_by()]
fn nothing() {}
proptest! { #[test] fn inside(x in 0..9) { fn_call(x) } }
#[factlens_generates(Child, rationale = "expands to it")]
#[proc_macro_derive(Maker)]
pub fn derive_maker() {}
#[factlens_generates(Child, rationale = "expands to it")]
macro_rules! make { () => {} }
#[anergy(Child, reason = "waits for the other team", until = "")]
#[immunosuppress(Child, rationale = "needed for the migration", since = "2026-01-01", until = "2026-06-01", duration_cap = 1_00u32)]
#[poxparty(Child, exercise_type = "short", name = "n", until = "2026-06-01")]
#[orient(Child, adr = "ADR-1")]
#[diagnostic(Child, modalities = [Modality::Test, Modality::Test], min_independent = 2)]
#[clonal(Child, witness = w, iterations = 0, seed = Seed::Fixed(1))]
#[itch(name = "i", description = "something is off")]
#[chronic(Child, since = "2026-01-01", rationale = "short")]
#[mucosal_tolerant(boundary = MucosalKind::Iframe, accepts = "all", rationale = "longer than twenty characters")]
#[rx(treatment = "", to = "x", due = "2026-01-01")]
#[ddx(symptom = "s", rule_out = ["a, b"], reviewer = "r")]
#[triage_commit(triage_decision = TriageDecision::Red, rollback_target = "abc", triaged_by = "me", rationale = "it breaks everything now", rollback_due_within_minutes = 0)]
fn many() {}
'''


def test_relations_of_a_tree(spark):
    got = N.scan(spark.createDataFrame([("a.rs", TREE), ("b.rs", "fn x( {"), ("c.rs", None)], "file string, text string"))
    rows = {k: got[k].collect() for k in got}
    one = lambda r, k, c="kind": next(x for x in rows[r] if x[c] == k)
    declared = one("classes", "PanickingDrop", "type_name")
    assert (declared["name"], declared["category"], declared["provenance"], declared["presentation"]) == ("panicking-drop", ["functional_correctness"], "imagined", "passive")
    assert [(r["child"], r["parent"]) for r in rows["lineage"]] == [("Child", "PanickingDrop")]
    sites = sorted((r["class"], r["match_kind"], r["item_kind"], r["target"]["a"], r["target"]["b"]) for r in rows["sites"])
    assert sites == [("Child", "explicit", "trait_fn", "T", "g"), ("PanickingDrop", "explicit", "impl", "B", "Drop"), ("PanickingDrop", "fingerprint", "impl", "A", "Drop")]
    assert [(r["witness"], r["target"]["kind"], r["target"]["a"], r["target"]["b"]) for r in rows["immunities"]] == [("tests :: holds", "impl_fn", "Plain", "f")]
    assert rows["tolerances"][0]["see"] == ["a, b", "c"] and [r["class"] for r in rows["defenses"]] == ["Child"]
    assert sorted(r["macro_name"] for r in rows["generators"]) == ["Maker", "make"]
    assert [(r["marker"], r["magnitude"], r["certainty"], r["trigger"]) for r in rows["marks"]] == [("dread", "dread", "unsure", "odd")]
    assert sorted((r["name"], r["kind"]) for r in rows["functions"] if r["kind"] != "function") == [("holds", "test"), ("inside", "proptest"), ("later", "ignored_test")]
    assert "g" not in {r["name"] for r in rows["functions"]}
    assert one("deferred", "anergy")["until"] is None and one("deferred", "immunosuppress")["duration_cap"] == 100
    assert one("deferred", "poxparty")["see"] == ["exercise:n"] and one("deferred", "orient")["see"] == ["adr:ADR-1"] and one("deferred", "orient")["text"] == ""
    assert one("evidence", "diagnostic")["modalities"] == ["Test", "Test"] and one("evidence", "clonal")["seed_kind"] == "Fixed"
    assert one("work_orders", "rx")["filled_by"] == ["x"] and one("work_orders", "rx")["frame"] == "2026-01-01"
    assert one("work_orders", "ddx")["items"] == ["a, b"] and one("work_orders", "ddx")["reviewed_by"] == ["r"]
    assert rows["triage_commits"][0]["decision"] == "red" and rows["boundaries"][0]["boundary_kind"] == "Iframe"
    errors = [r["error"] for r in rows["parse_failures"]]
    assert len(errors) == 4 and {r["file"] for r in rows["parse_failures"]} == {"a.rs", "b.rs"}
    day = dt.date(2026, 3, 1)
    broken = {(r, x["what"]) for r in ("sites", "deferred", "evidence", "recurrent", "boundaries", "work_orders", "triage_commits") for x in N.violations(got[r], r, day).collect()}
    assert broken == {
        ("sites", "proof is a placeholder"), ("deferred", "text too short"), ("deferred", "until missing"), ("deferred", "until out of range"),
        ("evidence", "min_independent above distinct modalities"), ("evidence", "iterations missing"), ("recurrent", "rationale too short"),
        ("boundaries", "rationale too short"), ("work_orders", "text missing"), ("triage_commits", "due minutes missing"),
    }


def test_suppression_range(spark):
    rows = [("2026-01-01", "2026-04-01", None), ("2026-01-01", "2026-04-02", None), (None, "2026-03-01", None), (None, "2026-02-28", None), ("2026-01-01", "2026-01-12", 10), ("2026-01-01", "no day", None)]
    frame = spark.createDataFrame(rows, "since string, until string, duration_cap long").withColumn("kind", F.lit("immunosuppress")).withColumn("text", F.lit("x" * 20))
    broken = N.violations(conform(frame, "deferred"), "deferred", dt.date(2026, 3, 1)).collect()
    assert sorted((r["until"], r["what"]) for r in broken) == [(u, "until out of range") for u in ("2026-01-12", "2026-02-28", "2026-04-02", "no day")]


def test_recurrent_and_evidence_rules(spark):
    kinds = ["itch", "recurrence_anchor", "crystallize", "chronic", "saturate", "strand"]
    broken = N.violations(conform(spark.createDataFrame([(k,) for k in kinds], "kind string"), "recurrent"), "recurrent").groupBy("kind").agg(F.array_sort(F.collect_list("what")).alias("w")).collect()
    assert {r["kind"]: r["w"] for r in broken} == {
        **{k: ["name missing", "text too short"] for k in ("itch", "crystallize", "strand")}, "saturate": ["text too short"],
        "chronic": ["class missing", "rationale too short", "since missing"], "recurrence_anchor": ["class missing", "instances missing", "rationale too short", "since missing"],
    }
    broken = N.violations(conform(spark.createDataFrame([("igg",), ("crossreactive",), ("adcc",)], "kind string"), "evidence"), "evidence").collect()
    assert sorted((r["kind"], r["what"]) for r in broken) == [("crossreactive", "fingerprints missing"), ("igg", "historical_span missing"), ("igg", "min_reattestations missing"), ("igg", "witness missing")]


def test_empty_tree(spark):
    got = N.scan(spark.createDataFrame([], "file string, text string"))
    assert all(f.count() == 0 for f in got.values())
    assert set(got) == {*N.NOTES, "items", "functions", "parse_failures"} and got["deferred"].columns == conform(spark.createDataFrame([], RELATIONS["deferred"]), "deferred").columns


def test_workspace(spark, tmp_path):
    sources = {
        "a/src/lib.rs": '#[factlens(name = "base")]\nstruct Base;\n#[factlens(name = "twin")]\nstruct Twin;\n#[defended_by(Base)]\nfn t() {}',
        "b/src/lib.rs": '#[factlens(name = "heir", fingerprint = "body_calls(\\"leak\\")")]\n#[descended_from(Base)]\nstruct Heir;\n#[factlens(name = "twin")]\nstruct Twin;\n#[presents(Base)]\nfn p() {}\n#[presents(Twin)]\nfn q() { leak(); }',
        "c/src/lib.rs": "#[presents(Twin)]\nfn r() { leak(); }\nfn broken( {",
        "other/x.rs": "#[presents(Base)]\nfn away() {}",
    }
    for name, text in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    members = spark.createDataFrame([("a", "1", "a"), ("b", "1", "b/"), ("c", "1", "c"), ("d", "1", "d")], "name string, version string, root string")
    got = N.scan_workspace(spark, str(tmp_path), members)
    assert [(r["child"], r["child_path"], r["parent"], r["parent_path"]) for r in got["lineage"].collect()] == [("Heir", "b@1", "Base", "a@1")]
    sites = sorted((r["class"], r["match_kind"], r["target"]["a"], r["canonical_path"]) for r in got["sites"].collect())
    assert sites == [("Base", "explicit", "p", "a@1"), ("Heir", "fingerprint", "q", "b@1"), ("Twin", "explicit", "q", "b@1")]
    assert got["coverage"].first().asDict() == {"enumerated": ["a@1", "b@1", "c@1", "d@1"], "scanned": ["a@1", "b@1", "c@1"]}
    errors = [r["error"] for r in got["parse_failures"].collect()]
    assert len(errors) == 2 and any("`Twin` is declared in 2 members (a@1, b@1)" in e for e in errors)
    assert sorted((r["class"], r["inherited_from"]) for r in got["inherited"].collect() if r["inherited_from"]) == [("Heir", ["Base"])]
