"""Domain audits: one row for each record, with a list of hints. The day of judgement, as_of, is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import resolve_delegates

GRACE_DAYS, CHRONIC_DAYS = 30, 365
#: What a deferral of each kind is called once its date has passed (fixed values).
PAST_HINTS = {"anergy": "anergy-costimulation-not-arrived", "immunosuppress": "immunosuppress-expired", "poxparty": "poxparty-outcome-pending", "orient": "orient-pending-action-required"}
MIN_ITERATIONS, MIN_SPAN = 100, 30


def hints(*cases: tuple[Column, str]) -> Column:
    """The names of the cases that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases)))


def function_index(functions: DataFrame) -> DataFrame:
    return functions.groupBy("name").agg(F.count("*").alias("uses"), F.min("kind").alias("kind"), F.min("file").alias("file"))


def audit_witness(immunities: DataFrame, functions: DataFrame) -> DataFrame:
    """status and tier of each witness text: missing, external, phantom, not_found, resolved or ambiguous.

    A code witness never exceeds reachability; only a phantom type, whose type arguments are not nested, reaches formal proof.
    """
    text = S.compact_path(F.coalesce("witness", F.lit("")))
    name = F.trim(F.regexp_replace(F.substring_index(text, "::", -1), r"(?:\(\))+$", ""))
    rows = immunities.withColumn("_name", name).join(function_index(functions).select(F.col("name").alias("_name"), F.col("uses").alias("_uses"), F.col("kind").alias("witness_kind")), "_name", "left")
    status = F.when(text == "", "missing").when(S.is_tool_witness(text), "external").when(S.is_phantom_type(text), "phantom").when(F.col("_uses").isNull(), "not_found").when(F.col("_uses") > 1, "ambiguous").otherwise("resolved")
    rows = rows.withColumn("status", status)
    return rows.withColumn("tier", witness_tier(F.col("status"))).drop("_name", "_uses")


def witness_tier(status: Column) -> Column:
    return F.when(status == "phantom", "formal_proof").when(status.isin("resolved", "ambiguous", "external"), "reachability").otherwise("none")


def presentation_verdict(sites: DataFrame, code: DataFrame, immunity: DataFrame, requires: DataFrame) -> DataFrame:
    """verdict and tier of each explicit site: a failing requirement is a substrate_gap whatever else holds; else the best tier.

    code(site_id), immunity(site_id, tier), requires(site_id, passed nullable, tier); sites have site_id and proof.
    """
    rank = lambda c: S.rank_of(c, S.TIERS)
    best = immunity.groupBy("site_id").agg(F.max(rank(F.col("tier"))).alias("_i"))
    need = requires.groupBy("site_id").agg(F.bool_or(F.coalesce(~F.col("passed"), F.lit(False))).alias("_failed"), F.max(F.when(F.col("passed"), rank(F.col("tier")))).alias("_r"))
    rows = sites.where("match_kind = 'explicit'").join(code.select("site_id", F.lit(1).alias("_c")).distinct(), "site_id", "left").join(best, "site_id", "left").join(need, "site_id", "left")
    proof = F.when(F.col("proof").isNotNull(), 3)
    top = F.greatest(F.coalesce("_c", F.lit(0)), F.coalesce("_i", F.lit(0)), F.coalesce("_r", F.lit(0)), F.coalesce(proof, F.lit(0)))
    verdict = F.when(F.col("_failed"), "substrate_gap").when(top == 0, "undefended").otherwise("defended")
    return rows.withColumn("verdict", verdict).withColumn("tier", F.when(F.col("_failed"), "none").otherwise(S.from_rank(top, S.TIERS))).drop("_c", "_i", "_r", "_failed")


def inherited_unaddressed(gaps: DataFrame) -> DataFrame:
    return gaps.where("size(inherited_from) > 0")


def audit_category(classes: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Declared category against the witnesses seen: default, hybrid, mismatch or silence. witnesses(class, is_code, is_substrate)."""
    seen = witnesses.groupBy(F.col("class").alias("type_name")).agg(F.bool_or("is_code").alias("_code"), F.bool_or("is_substrate").alias("_sub"))
    rows = classes.join(seen, "type_name", "left")
    code, sub = F.coalesce("_code", F.lit(False)), F.coalesce("_sub", F.lit(False))
    declared = F.coalesce("category", F.array().cast("array<string>"))
    only = lambda c: (F.size(declared) == 1) & F.array_contains(declared, c)
    return rows.withColumn(
        "hints",
        hints(
            (F.size(declared) == 0, "category_defaulted"),
            (F.size(declared) > 1, "category_hybrid"),
            (only("functional_correctness") & sub & ~code, "category_mismatch"),
            (only("substrate_alignment") & code & ~sub, "category_mismatch"),
            (~code & ~sub, "category_silent"),
        ),
    ).drop("_code", "_sub")


def audit_deferred(deferred: DataFrame, as_of: Column, grace_days: int = GRACE_DAYS) -> DataFrame:
    """hint of each deferral, by its kind and dates, and state: active, expired or stale.

    Without `until` (or with an empty one) a deferral is active; one that is no date escalates like one that has passed.
    Grace belongs to anergy alone: past it, it is stale. An immunosuppression that is older than its cap is stale
    whatever its `until`; the cap needs both `since`, as a date, and `duration_cap`.
    """
    until, since, kind = S.iso_date(F.col("until")), S.iso_date(F.col("since")), F.col("kind")
    holds = (F.coalesce("until", F.lit("")) == "") | F.coalesce(until >= as_of, F.lit(False))
    over_cap = F.coalesce(F.datediff(as_of, since) > F.col("duration_cap"), F.lit(False))
    too_late = F.coalesce(F.datediff(as_of, until) > grace_days, F.lit(False))
    past = F.element_at(F.create_map(*(F.lit(x) for k, v in PAST_HINTS.items() for x in (k, v))), kind)
    hint = (
        F.when((kind == "immunosuppress") & over_cap, "immunosuppress-duration-cap-exceeded")
        .when(holds, F.concat(kind, F.lit("-active")))
        .when((kind == "anergy") & too_late, "anergy-stale")
        .otherwise(past)
    )
    state = F.when(F.endswith("hint", F.lit("-active")), "active").when(F.col("hint").isin("anergy-stale", "immunosuppress-duration-cap-exceeded"), "stale").otherwise("expired")
    return deferred.withColumn("hint", hint).withColumn("state", state)


def audit_convergent(evidence: DataFrame) -> DataFrame:
    """Hints on convergent evidence, counted over distinct values."""
    n = lambda c: F.size(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    kind = F.col("kind")
    return evidence.withColumn(
        "hints",
        hints(
            ((kind == "diagnostic") & (n("modalities") < F.coalesce("min_independent", F.lit(2))), "modalities_collapse"),
            ((kind == "diagnostic") & (F.size("modalities") > n("modalities")), "modality_repeated"),
            ((kind == "clonal") & (F.coalesce("iterations", F.lit(0)) < MIN_ITERATIONS), "iterations_low"),
            ((kind == "clonal") & F.coalesce(F.col("seed_kind") == "fixed", F.lit(False)), "seed_fixed"),
            ((kind == "igg") & (F.coalesce("historical_span", F.lit(0)) < MIN_SPAN), "span_short"),
            ((kind == "igg") & (F.coalesce("min_reattestations", F.lit(0)) < 1), "no_reattestation"),
            ((kind == "crossreactive") & (n("fingerprints") < 2), "identity_collapse"),
            ((kind == "polyclonal") & (n("witnesses") == 0), "empty"),
            ((kind == "polyclonal") & (F.size("witnesses") > n("witnesses")), "witness_collapse"),
        ),
    )


def audit_recurrent(rows: DataFrame, ancestors: DataFrame, as_of: Column) -> DataFrame:
    """Hints on recurrences; ancestors(src, dst) by bare name. An anchor needs an itch of its class or of one above it."""
    itches = rows.where("kind = 'itch'").select(F.col("class").alias("_itch")).distinct()
    up = ancestors.select(F.col("src").alias("_class"), F.col("dst").alias("_itch"))
    own = rows.select(F.col("class").alias("_class"), F.col("class").alias("_itch"))
    itchy = up.unionByName(own).join(itches, "_itch", "left_semi").select("_class").distinct().withColumn("_has", F.lit(True))
    found = rows.join(itchy, rows["class"] == itchy["_class"], "left")
    kind, since = F.col("kind"), S.iso_date(F.col("since"))
    return found.withColumn(
        "hints",
        hints(
            ((kind == "anchor") & F.col("_has").isNull(), "anchor_without_itch"),
            ((kind == "crystallize") & (F.coalesce(F.size("from_itches"), F.lit(0)) < 1), "no_itches"),
            ((kind == "chronic") & F.col("since").isNotNull() & since.isNull() & ~S.is_version_tag(F.col("since")), "since_malformed"),
            ((kind == "chronic") & (F.datediff(as_of, since) > CHRONIC_DAYS), "chronic_long"),
            ((kind == "chronic") & F.col("managed_by").isNull(), "unmanaged"),
            ((kind == "saturate") & (F.coalesce(F.size("anchored_by"), F.lit(0)) < 1), "no_anchor"),
        ),
    ).drop("_class", "_has")


def audit_boundaries(rows: DataFrame, handlers: DataFrame, as_of: Column) -> DataFrame:
    """Hints on boundaries: delegates resolved by bare name, rationale floors in bytes (20, tolerant 40), reviewer and expiry."""
    resolved = resolve_delegates(rows, handlers)
    size = F.octet_length(F.trim(F.coalesce("rationale", F.lit(""))))
    tag, until = F.col("tag"), S.iso_date(F.col("until"))
    return resolved.withColumn(
        "hints",
        hints(
            ((tag == "delegate") & (F.col("resolution") == "missing"), "delegate_missing"),
            ((tag == "delegate") & (F.col("resolution") == "ambiguous"), "delegate_ambiguous"),
            ((tag == "delegate") & (F.col("resolution") == "kind_mismatch"), "delegate_kind_mismatch"),
            (size < F.when(tag == "tolerant", 40).otherwise(20), "rationale_short"),
            ((tag == "tolerant") & (F.coalesce("accepts", F.lit("")) == ""), "accepts_empty"),
            ((tag == "tolerant") & F.col("reviewed_by").isNull(), "no_reviewer"),
            (F.col("until").isNotNull() & until.isNull(), "until_malformed"),
            (until < as_of, "expired"),
        ),
    ).drop("resolution")


def audit_coverage(unscanned: DataFrame) -> DataFrame:
    return unscanned.select("member", F.lit("not_scanned").alias("barrier"), F.concat(F.lit("scan member "), F.col("member")).alias("remedy"))


WORK_SHAPES = {"panel": "list", "ddx": "list", "triage": "order", "rx": "request", "biopsy": "request", "refer": "request", "culture": "wait", "quarantine": "wait"}


def work_verdict(evaluable: Column, satisfied: Column, frame: Column) -> Column:
    return F.when(~evaluable, "out_of_frame").when(satisfied, "fulfilled").when(frame == "past", "overdue").otherwise("pending")


def resolve_ref(ref: Column, labels: Column) -> Column:
    """Whether a reference meets a label: a qualified one must end it at ::, a bare one equals it or its last segment."""
    return F.exists(labels, lambda s: (s == ref) | F.endswith(s, F.concat(F.lit("::"), ref)))


def audit_prescriptive(orders: DataFrame, labels: DataFrame, as_of: Column) -> DataFrame:
    """satisfied, evaluable, frame and verdict of each work order; labels: rows with site labels in the array `labels`.

    Lists are satisfied when every item resolves, orders when items are in priority and named, requests when filled and
    reviewed, waits when their frame has passed. Items meet labels by an equality join: a label can be met by itself and
    by each of its ends at a `::`.
    """
    shape = F.element_at(F.create_map(*(F.lit(x) for k, v in WORK_SHAPES.items() for x in (k, v))), F.col("kind"))
    parts = F.split("label", "::")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::"))
    names = labels.select(F.explode("labels").alias("label")).distinct().select(F.explode(ends).alias("_item")).distinct().withColumn("_met", F.lit(True))
    wanted = orders.select(F.explode("items").alias("_item")).distinct().join(names, "_item").select("_item", "_met")
    rows = orders.withColumn("_row", F.monotonically_increasing_id())
    met = rows.select("_row", F.explode("items").alias("_item")).join(wanted, "_item", "left").groupBy("_row").agg(F.bool_and(F.coalesce("_met", F.lit(False))).alias("_all"))
    rows = rows.join(met, "_row", "left").withColumn("shape", shape).withColumn("frame_state", S.frame_state(F.col("frame"), as_of))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    all_met = F.coalesce("_all", F.col("items").isNotNull())
    evaluable = F.when(F.col("frame_state") == "unparsable", False).when(F.col("shape").isin("list", "order"), some("items")).when(F.col("shape") == "request", F.lit(True)).otherwise(F.col("frame").isNotNull())
    satisfied = F.when(F.col("shape") == "list", all_met).when(F.col("shape") == "order", all_met & F.col("ordered_by").isNotNull()).when(F.col("shape") == "request", some("filled_by") & some("reviewed_by")).otherwise(F.col("frame_state") == "past")
    rows = rows.withColumn("evaluable", F.coalesce(evaluable, F.lit(False))).withColumn("satisfied", F.coalesce(satisfied, F.lit(False)))
    return rows.withColumn("verdict", work_verdict(F.col("evaluable"), F.col("satisfied"), F.col("frame_state"))).drop("_row", "_all")


def finding_from_mark(marks: DataFrame) -> DataFrame:
    """Severity and cluster of marks: dread or certainty is high, aura medium, others low."""
    sev = F.when((F.col("certainty") == "sure") | (F.col("magnitude") == "dread"), "high").when(F.col("magnitude") == "aura", "medium").otherwise("low")
    return marks.withColumn("severity", sev).withColumn("cluster_key", S.cluster_key(F.col("marker"), F.col("shape_digest")))


# ---- version control


def trailer_state(trailers: Column, key: str) -> Column:
    """The first trailer with the key in any case: absent, empty or present."""
    found = F.filter(trailers, lambda t: F.startswith(F.lower(t), F.lit(key.lower() + ":")))
    value = F.trim(F.regexp_replace(F.get(found, F.lit(0)), "^[^:]*:", ""))
    return F.when(F.size(found) == 0, "absent").when(value == "", "empty").otherwise("present")


TRIAGE = ["black", "red", "yellow", "green", "white"]


def rollback_triage(text: Column) -> Column:
    return S.enum_value(text, TRIAGE)


def vcs_scan(commits: DataFrame, triaged: DataFrame, last: int) -> DataFrame:
    """Reverts and rollbacks among the latest `last` commits, with their triage or `untriaged`."""
    top = commits.orderBy(F.desc("seq")).limit(last).where(F.col("subject").rlike(r"(?i)\b(?:revert|rollback|roll back)"))
    return top.join(triaged.select("id", "triage"), "id", "left").withColumn("triage", F.coalesce("triage", F.lit("untriaged")))


def pre_tag(members: DataFrame, tag: Column, tags: DataFrame, changelog: Column) -> DataFrame:
    """Release checks over members(name, version, has_readme, has_license, locked): one row with a boolean for each."""
    exists = tags.groupBy().agg(F.collect_set("tag").alias("_tags"))
    checks = members.agg(
        (F.count("*") > 0).alias("members"), (F.count_distinct("version") == 1).alias("version_coherent"), F.bool_and(F.col("has_readme")).alias("readme"), F.bool_and(F.col("has_license")).alias("metadata"), F.bool_and(F.col("locked")).alias("lockfile"), F.max("version").alias("_version")
    )
    rows = checks.join(exists)
    return rows.withColumn("tag_absent", ~F.array_contains("_tags", tag)).withColumn("tag_matches", F.regexp_replace(tag, "^v", "") == F.col("_version")).withColumn("changelog", F.contains(changelog, F.col("_version"))).drop("_tags", "_version")


# ---- supply chain


def dep_pinned(deps: DataFrame, name: str | None = None) -> DataFrame:
    """pinned and the failing names: every dependency (or the named one) has an exact =; one without a version counts as pinned."""
    rows = deps.where(F.col("name") == name) if name else deps
    bad = F.col("version").isNotNull() & ~F.startswith(F.trim("version"), F.lit("="))
    return rows.agg(F.array_sort(F.collect_set(F.when(bad, F.col("name")))).alias("failing")).withColumn("pinned", F.size("failing") == 0)


def dep_attested(wanted: DataFrame, records: DataFrame, exact: bool = True) -> DataFrame:
    """ok, stale, no_artifact, malformed or missing for wanted(name, version); without `exact` any version will do."""
    r = records.groupBy("name").agg(F.collect_list(F.struct("version", "artifact", "valid")).alias("_all"))
    rows = wanted.join(r, "name", "left")
    same = F.get(F.filter("_all", lambda x: x["version"] == F.col("version")), F.lit(0))
    rows = rows.withColumn("_hit", same if exact else F.coalesce(same, F.get(F.col("_all"), F.lit(0))))
    state = F.when(F.col("_all").isNull(), "missing").when(F.col("_hit").isNull(), "stale").when(~F.col("_hit.valid"), "malformed").when(F.coalesce(F.col("_hit.artifact"), F.lit("")) == "", "no_artifact").otherwise("ok")
    return rows.withColumn("state", state).drop("_all", "_hit")


def content_hash(wanted: DataFrame, lock: DataFrame, records: DataFrame) -> DataFrame:
    """matches, mismatch, no_record, malformed or absent_in_lock for wanted(name, version).

    The record is looked at first, then the lock file. A record without a checksum could not be read and is malformed.
    """
    keys = ["name", "version"]
    rows = wanted.join(lock.select(*keys, F.col("checksum").alias("_lock")), keys, "left").join(records.select(*keys, F.col("checksum").alias("_rec"), F.lit(True).alias("_is")), keys, "left")
    state = F.when(F.col("_is").isNull(), "no_record").when(F.col("_rec").isNull(), "malformed").when(F.col("_lock").isNull(), "absent_in_lock").when(F.col("_rec") == F.col("_lock"), "matches").otherwise("mismatch")
    return rows.withColumn("state", state).drop("_lock", "_is", "_rec")


def maintainer(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    found = snapshots.select("name", F.col("version").alias("_v"))
    return wanted.join(found, "name", "left").withColumn("state", F.when(F.col("_v") == F.col("version"), "unchanged").otherwise("unavailable")).drop("_v")


def sandbox(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("state", F.lit("tooling_unavailable"))


def live_checksum(live: Column, recorded: Column) -> Column:
    return F.when(live.isNull(), "unverifiable").when(live == recorded, "verified").otherwise("mismatch")


def supply_chain(predicate, states: dict[tuple, str]) -> tuple[bool, list[tuple[str, str]]]:
    """Verdict and kept entries of a predicate tree; states: the outcome of each supply-chain leaf by (op, name).

    If a branch of any_of passes, failing siblings leave no entries; `not` keeps none; other leaves count as passed.
    """
    from ..plans.predicate import SUPPLY

    if predicate.op == "not":
        return not supply_chain(predicate.inside[0], states)[0], []
    if predicate.op in ("all_of", "any_of"):
        parts = [supply_chain(p, states) for p in predicate.inside]
        passed = [p for p in parts if p[0]]
        if predicate.op == "any_of" and passed:
            return True, [e for p in passed for e in p[1]]
        return (not [p for p in parts if not p[0]], [e for p in parts for e in p[1]]) if predicate.op == "all_of" else (False, [e for p in parts for e in p[1]])
    if predicate.op not in SUPPLY:
        return True, []
    state = states.get((predicate.op, predicate.args.get("crate_name")), "missing")
    return state in ("ok", "pinned", "unchanged", "matches"), [(predicate.op, state)]


def branch_attest(observed: Column, protected: Column) -> Column:
    return F.when(observed.isNull(), "unobservable").when(protected, "attested").otherwise("unprotected")


def server_enforcement(reachable: Column, enforced: Column) -> Column:
    return F.when(~F.coalesce(reachable, F.lit(False)), "unknown").when(enforced, "enforced").otherwise("advisory")


def lineage_fidelity(lineage: list[tuple[str, str]], patterns: dict[str, str]) -> list[tuple[str, str, str]]:
    """(child, parent, hint) where a child's pattern does not refine its parent's: another item kind, or a doc text that it drops.

    The catalog of patterns is small and parsed on the driver.
    """
    from ..plans.pattern import kind_hint, parse
    from .learn import conjuncts

    out = []
    for child, parent in sorted(lineage):
        if child not in patterns or parent not in patterns:
            continue
        a, b = parse(patterns[child]), parse(patterns[parent])
        if kind_hint(b) and kind_hint(a) != kind_hint(b):
            out.append((child, parent, "kind_differs"))
        needles = lambda p: {n.args[0] for n in conjuncts(p) if n.op == "doc_contains"}
        if any(not any(x in y for y in needles(a)) for x in needles(b)):
            out.append((child, parent, "doc_not_refined"))
    return out
