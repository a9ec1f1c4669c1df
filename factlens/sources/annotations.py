"""Annotations of source items as fact relations, what is wrong with them, and the scan of a tree or of a workspace.

The names of three annotations begin with the name of the tool that reads them: that of class declarations is
the name itself, and tolerances and generators add a suffix. The name is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import joins as J
from ..plans import pattern as P
from ..schema import RELATIONS, conform
from ..storage import saved
from . import files, rust

PREFIX = "factlens"
#: Annotations of each relation (fixed values); {0} stands for the tool's name.
NOTES = {
    "classes": ["{0}"],
    "sites": ["presents"],
    "immunities": ["immune"],
    "defenses": ["defended_by"],
    "tolerances": ["{0}_tolerance"],
    "generators": ["{0}_generates"],
    "lineage": ["descended_from"],
    "deferred": ["anergy", "immunosuppress", "poxparty", "orient"],
    "evidence": ["diagnostic", "clonal", "igg", "crossreactive", "polyclonal", "monoclonal", "adcc"],
    "recurrent": ["itch", "recurrence_anchor", "crystallize", "chronic", "saturate", "strand"],
    "boundaries": ["mucosal", "mucosal_delegate", "mucosal_tolerant"],
    "work_orders": ["panel", "rx", "refer", "biopsy", "ddx", "culture", "quarantine", "triage"],
    "triage_commits": ["triage_commit"],
    "marks": ["aura", "dread", "red_flag"],
}
#: Marker, magnitude and certainty of each mark (fixed values).
CORNERS = {"aura": ("aura", "aura", "unsure"), "dread": ("dread", "dread", "unsure"), "red_flag": ("red-flag", "dread", "sure")}
#: Relations whose annotations name one class, alone in front of the other arguments.
NEED_CLASS = ["sites", "immunities", "defenses", "tolerances", "generators", "lineage"]


def _arg(*names: str) -> Column:
    """The first of several arguments that is given."""
    return F.coalesce(*(F.col("args")[n] for n in names))


def _list(*names: str) -> Column:
    """An argument as an array; a single value is an array of one, an argument not given is null."""
    value = _arg(*names)
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.when(value.isNotNull(), F.array(value)))


def _joined(*lists: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(empty, *(F.coalesce(x, empty) for x in lists))


def _number(name: str) -> Column:
    """A whole number, whose digits may be grouped by underscores and end with a type."""
    digits = F.regexp_replace(F.regexp_extract(_arg(name), r"^([0-9][0-9_]*)", 1), "_", "")
    return F.when(digits != "", digits.cast("bigint"))


def _named(text: Column) -> Column:
    """The last segment of a path, or null if there is none."""
    name = F.trim(F.substring_index(F.regexp_replace(text, "<.*$", ""), "::", -1))
    return F.when(name != "", name)


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _columns(relation: str, prefix: str = PREFIX) -> dict[str, Column]:
    alone = F.from_json(F.col("args")[""], "array<string>")
    class_ = F.coalesce(_named(F.get(alone, F.lit(0))), _named(_arg("class")))
    kind = F.col("name")
    mark = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, c in CORNERS.items() for x in (n, c[k]))), kind)
    packed = lambda tag, arg: F.when(_arg(arg).isNotNull(), F.array(F.concat(F.lit(f"{tag}:"), _arg(arg))))
    orient = kind == "orient"
    of = {
        "classes": lambda: {
            "type_name": F.col("item_name"), "name": _arg("name"), "family": _arg("family"), "summary": _arg("summary"), "pattern": _arg("fingerprint"),
            "category": F.filter(F.transform(_joined(_list("category")), lambda c: S.enum_value(c, S.CATEGORIES)), lambda c: c.isNotNull()),
            "provenance": F.coalesce(F.lower(_named(_arg("provenance"))), F.lit("imagined")), "presentation": F.coalesce(F.lower(_named(_arg("presentation"))), F.lit("passive")),
        },
        "sites": lambda: {"class": class_, "match_kind": F.lit("explicit"), "requires": _arg("requires"), "proof": _arg("proof")},
        "immunities": lambda: {"class": class_, "witness": _arg("witness"), "requires": _arg("requires")},
        "defenses": lambda: {"class": class_},
        "tolerances": lambda: {"class": class_, "rationale": _arg("rationale"), "until": _arg("until"), "see": _joined(_list("see")), "requires": _arg("requires")},
        "generators": lambda: {"class": class_, "rationale": _arg("rationale")},
        "lineage": lambda: {"child": F.col("item_name"), "parent": class_},
        "deferred": lambda: {
            "kind": kind, "class": class_, "text": F.when(orient, "").otherwise(F.coalesce(F.when(kind == "poxparty", _arg("exercise_type")).otherwise(_arg("reason", "rationale")), F.lit(""))),
            "until": F.when(~orient, _filled(_arg("until"))), "since": _arg("since"), "duration_cap": _number("duration_cap"), "signed_by": _arg("signed_by"),
            "see": F.when(kind == "poxparty", _joined(packed("exercise", "name"), packed("rationale", "rationale"))).when(orient, _joined(_list("see"), packed("adr", "adr"))).otherwise(_joined()),
            "learning_path": F.when(orient, _arg("learning_path")), "learn_until": F.when(orient, _arg("until")),
        },
        "evidence": lambda: {
            "kind": kind, "class": class_, "modalities": F.transform(_joined(_list("modalities")), _named), "min_independent": _number("min_independent"), "iterations": _number("iterations"),
            "seed_kind": _named(F.regexp_replace(_arg("seed"), r"\s*\(.*$", "")), "historical_span": _number("historical_span"), "min_reattestations": _number("min_reattestations"),
            "witnesses": _joined(_list("witness"), _list("witnesses")), "fingerprints": _joined(_list("fingerprints")),
        },
        "recurrent": lambda: {
            "kind": kind, "name": _arg("name"), "class": F.coalesce(_named(_arg(prefix, "class")), _named(F.get(alone, F.lit(0)))), "instances": _number("instances"), "since": _arg("since"), "from_itches": _joined(_list("from_itches")),
            "anchored_by": _joined(_list("anchored_by")), "managed_by": _arg("managed_by"), "contributing_to": _arg("contributing_to"), "text": _arg("description", "summary"), "rationale": _arg("rationale"),
        },
        "boundaries": lambda: {
            "tag": kind, "boundary_kind": _named(_arg("kind", "boundary")), "rationale": _arg("rationale"), "handled_by": _arg("handled_by"), "accepts": _arg("accepts"), "reviewed_by": _arg("reviewed_by"), "until": _arg("until"),
        },
        "work_orders": lambda: {
            "kind": kind, "items": _joined(_list("needs", "rule_out", "priority_order")), "filled_by": _joined(_list("filled_by"), *(_list(n) for n in ("to", "deep_investigation_by", "investigator", "triaged_by"))),
            "reviewed_by": _joined(_list("reviewed_by"), _list("reviewer")), "ordered_by": _arg("ordered_by"), "frame": _arg("due", "response_due", "re_triage_due", "runs_until", "until"),
            "need_text": _arg("treatment", "request_text", "symptom", "test_kind", "reason"), "label": _arg("diagnosis", "location", "scope"),
        },
        "triage_commits": lambda: {
            "decision": F.lower(_named(_arg("triage_decision"))), "rollback_target": _arg("rollback_target"), "triaged_by": _arg("triaged_by"), "rationale": _arg("rationale"), "due_minutes": _number("rollback_due_within_minutes"),
        },
        "marks": lambda: {"marker": mark(0), "magnitude": mark(1), "certainty": mark(2), "trigger": _arg("trigger")},
    }
    return of[relation]()


def _of(notes: DataFrame, relation: str, prefix: str) -> DataFrame:
    return notes.where(F.col("name").isin([n.format(prefix) for n in NOTES[relation]]))


def _faults(relation: str) -> list[tuple[Column, str]]:
    """Why an annotation gives a failure and no row."""
    got = _columns(relation)
    out = []
    if relation == "lineage":
        out.append((~F.col("item_kind").isin("struct", "enum"), "stands on no type declaration"))
    if relation == "defenses":
        out.append((F.size(F.from_json(F.col("args")[""], "array<string>")) > 1, "names more than one class"))
    if relation in NEED_CLASS:
        out.append((got["parent" if relation == "lineage" else "class"].isNull(), "names no class"))
    if relation in ("generators", "marks"):
        arg = "rationale" if relation == "generators" else "trigger"
        out.append((F.coalesce(F.trim(got[arg]), F.lit("")) == "", f"{arg} missing"))
    if relation == "classes":
        out += [(F.col("item_kind") != "struct", "stands on no struct"), (got["name"].isNull(), "name missing")]
    return out


def _first_fault(relation: str) -> Column:
    faults = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in _faults(relation)]
    return F.coalesce(*faults, F.lit(None).cast("string"))


def extract_notes(notes: DataFrame, relation: str, prefix: str = PREFIX) -> DataFrame:
    """Annotations as rows of one relation, in its schema.

    Class references keep their last segment, arguments that are absent are null, lists that are absent are empty.
    What failures() names gives no row.
    """
    rows = _of(notes, relation, prefix).where(_first_fault(relation).isNull())
    made = _columns(relation, prefix)
    for column in ("file", "line", "item_kind", "target", "structural_digest", "shape_digest", "macro_name"):
        made.setdefault(column, F.col(column))
    return conform(rows.select(*(v.alias(k) for k, v in made.items())), relation)


def failures(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """file, error of annotations that give no row."""
    out = None
    for relation in [*NEED_CLASS, "marks", "classes"]:
        part = _of(notes, relation, prefix).withColumn("_fault", _first_fault(relation)).where("_fault is not null")
        part = part.select("file", F.format_string("#[%s] on `%s`: %s", "name", F.coalesce("item_name", F.lit("")), "_fault").alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- rules for declarations


PLACEHOLDERS = ["", "todo", "todo!()", "unimplemented!()", "()", "_"]
ORIENT_DAYS, CAP_DAYS = 180, 90


def violations(rows: DataFrame, relation: str, as_of=None) -> DataFrame:
    """Rows of a relation that break the rules for declarations, with the rule in `what`; a row may break several.

    Rules about a day need `as_of`. A column that the rows lack counts as null. Texts are measured in characters, and blanks count as nothing.
    """
    types = {f.name: f.dataType for f in StructType.fromDDL(RELATIONS[relation])}
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast(types.get(c, "string"))
    blank = lambda c: F.coalesce(F.trim(col(c)), F.lit("")) == ""
    short = lambda c, n: (F.length(F.coalesce(col(c), F.lit(""))) < n) | blank(c)
    few = lambda c: F.coalesce(F.size(col(c)), F.lit(0)) < 1
    above_zero = lambda c: F.coalesce(col(c) > 0, F.lit(False))
    kind = col("tag" if relation == "boundaries" else "kind")
    when = lambda names, test: kind.isin(names) & test
    day = lambda c: S.iso_date(col(c))
    start = F.coalesce(day("since"), F.lit(as_of).cast("date"))
    held = F.datediff(day("until"), start)
    ahead = F.datediff(F.coalesce(day("learn_until"), day("until")), F.lit(as_of).cast("date"))
    rules = {
        "classes": lambda: [
            (~F.coalesce(col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "name is not kebab-case"), (col("pattern").isNotNull() & blank("pattern"), "pattern is empty"),
            (F.size(col("category")) != F.size(F.array_distinct(col("category"))), "category repeated"),
        ],
        "sites": lambda: [(col("proof").isNotNull() & F.lower(F.regexp_replace(col("proof"), r"\s", "")).isin(PLACEHOLDERS), "proof is a placeholder")],
        "tolerances": lambda: [(blank("rationale"), "rationale missing")],
        "generators": lambda: [(blank("rationale"), "rationale missing")],
        "marks": lambda: [(blank("trigger"), "trigger missing")],
        "deferred": lambda: [
            (when(["anergy", "immunosuppress", "poxparty"], short("text", 20)), "text too short"), (when(["anergy", "immunosuppress", "poxparty"], blank("until")), "until missing"),
            (when(["orient"], (F.length(F.coalesce(col("learning_path"), col("text"), F.lit(""))) < 20)), "text too short"), (when(["orient"], F.coalesce(_filled(col("learn_until")), _filled(col("until"))).isNull()), "until missing"),
            (when(["orient"], ~F.coalesce(ahead.between(0, ORIENT_DAYS), F.lit(False))), "until out of range"),
            (when(["immunosuppress"], ~blank("until") & ~F.coalesce(held.between(0, F.coalesce(col("duration_cap"), F.lit(CAP_DAYS))), F.lit(False))), "until out of range"),
        ],
        "evidence": lambda: [
            (when(["diagnostic"], few("modalities")), "no modality"), (when(["diagnostic"], col("min_independent") > F.size(F.array_distinct(col("modalities")))), "min_independent above distinct modalities"),
            (when(["diagnostic"], col("min_independent") < 1), "min_independent below one"),
            (when(["clonal"], few("witnesses")), "witness missing"), (when(["clonal"], ~above_zero("iterations")), "iterations missing"),
            (when(["igg"], few("witnesses")), "witness missing"), (when(["igg"], ~above_zero("historical_span")), "historical_span missing"), (when(["igg"], ~above_zero("min_reattestations")), "min_reattestations missing"),
            (when(["crossreactive"], few("fingerprints") | F.exists(F.coalesce(col("fingerprints"), F.array().cast("array<string>")), lambda x: F.trim(x) == "")), "fingerprints missing"),
        ],
        "recurrent": lambda: [
            (when(["itch", "crystallize", "strand"], blank("name")), "name missing"), (when(["itch", "crystallize", "saturate", "strand"], short("text", 10)), "text too short"),
            (when(["recurrence_anchor", "chronic"], col("class").isNull()), "class missing"), (when(["recurrence_anchor"], ~above_zero("instances")), "instances missing"),
            (when(["recurrence_anchor", "chronic"], blank("since")), "since missing"), (when(["recurrence_anchor", "chronic"], short("rationale", 20)), "rationale too short"),
        ],
        "boundaries": lambda: [
            (S.enum_value(col("boundary_kind"), S.BOUNDARY_KINDS).isNull(), "unknown boundary kind"), (short("rationale", 20), "rationale too short"),
            (when(["mucosal_tolerant"], short("rationale", 40) & ~short("rationale", 20)), "rationale too short"), (when(["mucosal_delegate"], blank("handled_by")), "handler missing"),
            (when(["mucosal_tolerant"], blank("accepts")), "accepts missing"),
        ],
        "work_orders": lambda: [
            (when(["panel", "ddx", "triage"], few("items")), "no items"), (when(["rx", "biopsy", "ddx", "culture", "quarantine"], blank("need_text")), "text missing"),
            (when(["biopsy", "quarantine"], blank("label")), "place missing"), (when(["refer"], few("filled_by")), "owner missing"),
        ],
        "triage_commits": lambda: [
            (~F.coalesce(col("decision").isin("black", "red", "yellow", "green", "white"), F.lit(False)), "unknown decision"), (blank("rollback_target"), "target missing"), (blank("triaged_by"), "triager missing"),
            (short("rationale", 20), "rationale too short"), (~above_zero("due_minutes"), "due minutes missing"),
        ],
    }
    what = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules[relation]())))
    return rows.withColumn("what", F.explode(what))


# ---- scans


def pattern_sites(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Sites that the patterns of declared classes find, each in the crate that declares the class.

    The driver holds the declared patterns, whose number goes with the declarations and not with the items.
    A pattern that cannot be parsed finds nothing; pattern_failures names it.
    """
    declared = [tuple(r) for r in classes.where("pattern is not null").select("type_name", "pattern").distinct().collect()]
    found = P.match_catalog(items, [(n, p) for n, p in declared if _parses(p)])
    found = J.semi(found, classes, [("class", "type_name"), ("canonical_path", "canonical_path")])
    kind = F.col("kind")
    target = F.struct(kind.alias("kind"), F.col("name").alias("a"), F.when(kind == "impl", F.col("impl_trait")).alias("b"), F.lit(None).cast("string").alias("c"))
    return found.withColumn("match_kind", F.lit("fingerprint")).withColumn("item_kind", kind).withColumn("target", target)


def unmarked(found: DataFrame, sites: DataFrame, tolerances: DataFrame, classes: DataFrame) -> DataFrame:
    """Pattern matches without those whose item is marked or tolerated for the class, and a class's own declaration; each item once."""
    place = ["class", "file", "canonical_path", "_key"]
    marked = sites.select(*place[:3], "target").unionByName(tolerances.select(*place[:3], "target")).select(*place[:3], F.explode(J.target_keys(F.col("target"))).alias("_key"))
    own = classes.select(F.col("type_name").alias("class"), "file", "canonical_path", F.explode(J.target_keys(F.struct(F.lit("struct").alias("kind"), F.col("type_name").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")))).alias("_key"))
    # a top-level item has one key
    keyed = found.withColumn("_key", F.get(J.target_keys(F.col("target")), F.lit(0)))
    return J.anti(keyed, marked.unionByName(own).distinct(), [(c, c) for c in place]).dropDuplicates(place).drop("_key")


def _parses(pattern: str) -> bool:
    try:
        P.parse(pattern)
    except ValueError:
        return False
    return True


def pattern_failures(classes: DataFrame) -> DataFrame:
    """file, error of classes whose pattern cannot be parsed."""
    bad = [(f, f"pattern of `{n}` cannot be parsed") for f, n, p in (tuple(r) for r in classes.where("pattern is not null").select("file", "type_name", "pattern").distinct().collect()) if not _parses(p)]
    return classes.sparkSession.createDataFrame(bad, RELATIONS["parse_failures"])


def scan(texts: DataFrame, prefix: str = PREFIX) -> dict[str, DataFrame]:
    """All relations of source texts (file, text, and canonical_path of the crate if there are several).

    Every file is parsed once, into a table of the shared folder; the relations are projections of it. Sites are
    those marked, and those that patterns find and nothing declares or tolerates.
    """
    crates = "canonical_path" in texts.columns
    # the crate travels within the file's name, so that a file that several crates hold is parsed for each
    named = texts.withColumn("file", F.to_json(F.struct("file", "canonical_path"))) if crates else texts
    rows = saved(rust.outline(named))

    def placed(frame: DataFrame) -> DataFrame:
        if not crates:
            return frame if "canonical_path" in frame.columns else frame.withColumn("canonical_path", F.lit(None).cast("string"))
        key = F.from_json("file", "file string, canonical_path string")
        return frame.withColumn("canonical_path", key["canonical_path"]).withColumn("file", key["file"])

    notes, items = rust.outlined_notes(rows), placed(rust.outlined_items(rows))
    out = {r: placed(extract_notes(notes, r, prefix)) for r in NOTES}
    lineage = out["lineage"]
    out["lineage"] = conform(lineage.withColumn("child_path", F.col("canonical_path")).withColumn("parent_path", F.col("canonical_path")), "lineage")
    matched = unmarked(pattern_sites(items, out["classes"]), out["sites"], out["tolerances"], out["classes"])
    out["sites"] = conform(out["sites"], "sites").unionByName(conform(matched, "sites"))
    failed = placed(rust.failures(rows).unionByName(failures(notes, prefix))).select("file", "error")
    out["parse_failures"] = failed.unionByName(pattern_failures(out["classes"]))
    return {**out, "items": items, "functions": placed(rust.function_index(rows)).drop("canonical_path")}


def in_members(texts: DataFrame, members: DataFrame) -> DataFrame:
    """texts with the canonical_path of each member (name, version, root) whose root holds the file.

    A file's folders are joined to the roots by equality. The root "" holds everything; a file may be in several members.
    """
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    crates = members.select(F.regexp_replace("root", "^/+|/+$", "").alias("_root"), F.concat_ws("@", "name", "version").alias("canonical_path")).distinct()
    return texts.withColumn("_root", F.explode(folders)).join(crates, "_root").drop("_root")


def scan_members(texts: DataFrame, members: DataFrame, prefix: str = PREFIX) -> dict[str, DataFrame]:
    """All relations of a workspace's members, stamped with the crate, and references restamped with the crate that declares the class.

    A name declared in several members stays with its own and is a failure. Lineage is deduplicated and checked on
    the whole; `inherited` has the sites with those of ancestors; `coverage` lists members known and members with
    files. As in the merge of reports that this stands for, marks of single members are not carried over.
    """
    out = scan(in_members(texts, members), prefix)
    failed = out["parse_failures"]
    what = F.format_string("`%s` is declared in %d members (%s); the reference stays with its own", "name", F.size("members"), F.array_join("members", ", "))
    out["lineage"], twice = J.rekey(out["lineage"], out["classes"], "parent", "parent_path")
    for relation in ("sites", "defenses", "immunities", "tolerances"):
        out[relation], again = J.rekey(out[relation], out["classes"], "class", "canonical_path")
        twice = twice.unionByName(again)
    failed = failed.unionByName(twice.distinct().select(F.lit("<workspace>").alias("file"), what.alias("error")))
    lineage = saved(out["lineage"])
    key = ["child", "parent", "child_path", "parent_path"]
    repeated = lineage.groupBy(*key).agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n > 1")
    failed = failed.unionByName(repeated.select("file", F.format_string("edge from `%s` to `%s` is declared %d times", "child", "parent", "n").alias("error")))
    out["lineage"] = lineage.groupBy(*key).agg(F.min(F.struct("file", "line")).alias("_at")).select(*key, "_at.file", "_at.line")
    edges = out["lineage"].select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    ring = F.concat(F.lit("cycle of lineage: "), F.array_join("cycle", " -> "))
    out["parse_failures"] = failed.unionByName(G.cycles(edges).select(F.lit("<workspace>").alias("file"), ring.alias("error")))
    out["inherited"] = G.inherit_sites(out["sites"], out["lineage"], out["classes"])
    names = members.select(F.concat_ws("@", "name", "version").alias("member"), F.lit(False).alias("seen"))
    seen = in_members(texts, members).select(F.col("canonical_path").alias("member"), F.lit(True).alias("seen")).distinct()
    listed = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("member"))))
    out["coverage"] = names.unionByName(seen).agg(listed(~F.col("seen")).alias("enumerated"), listed(F.col("seen")).alias("scanned"))
    del out["marks"]
    return out


def scan_workspace(spark: SparkSession, root: str, members: DataFrame, prefix: str = PREFIX) -> dict[str, DataFrame]:
    """scan_members over the tree below root, in which the roots of members are relative paths."""
    return scan_members(files.scan_tree(spark, root), members, prefix)
