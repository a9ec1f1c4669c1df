"""Evidence predicates: JSON to tree, checks, and evaluation as Spark columns over sidecars.

The verdict is three-valued: null is indeterminate. Columns of the input: those of
`sidecars`, one row for each item, left-joined so that an absent document has null columns.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

MAX_DEPTH = 64
LEAVES = ["ratified_doc", "signers", "signed_trailer", "oracles_complete", "fresh_within_days", "dep_pinned", "dep_attested", "maintainer_unchanged", "content_hash_matches", "sandbox_clean"]
#: Leaves that only the supply-chain audit can decide.
SUPPLY = LEAVES[5:]


class PredicateError(ValueError):
    """The document is no valid predicate."""


@dataclass(frozen=True)
class Pred:
    op: str
    args: dict = field(default_factory=dict, hash=False)
    inside: tuple[Pred, ...] = ()


def parse(text: str | dict) -> Pred:
    """The checked predicate of a JSON document {"all_of": [...]}, {"any_of": [...]}, {"not": ...} or {leaf: {...}}."""
    try:
        tree = json.loads(text) if isinstance(text, str) else text
    except ValueError as e:
        raise PredicateError(str(e)) from e
    return _node(tree, 0)


def _node(tree: object, depth: int) -> Pred:
    if depth > MAX_DEPTH:
        raise PredicateError(f"deeper than {MAX_DEPTH}")
    if not isinstance(tree, dict) or len(tree) != 1:
        raise PredicateError("a predicate is an object with one operator")
    (op, body), = tree.items()
    if op in ("all_of", "any_of"):
        if not isinstance(body, list) or not body:
            raise PredicateError(f"{op} needs a predicate")
        return Pred(op, {}, tuple(_node(x, depth + 1) for x in body))
    if op == "not":
        return Pred(op, {}, (_node(body, depth + 1),))
    if op not in LEAVES or not isinstance(body, dict):
        raise PredicateError(f"unknown leaf {op}")
    _check(op, body)
    return Pred(op, body)


def _check(op: str, a: dict) -> None:
    if op == "signers" and not a.get("required"):
        raise PredicateError("no required signer")
    if op == "oracles_complete" and not a.get("files"):
        raise PredicateError("no oracle file")
    if op == "signed_trailer" and (not a.get("key") or a.get("count", 1) == 0):
        raise PredicateError("a trailer needs a key and a count above zero")
    if op == "fresh_within_days" and "days" not in a:
        raise PredicateError("days missing")
    if op == "ratified_doc":
        if a.get("anchor") == "" or a.get("min_version") == "":
            raise PredicateError("empty anchor or version")
        if a.get("min_version") and not re.match(r"v?[0-9]", a["min_version"]):
            raise PredicateError("the version cannot be parsed")


def leaf(p: Pred, as_of: Column) -> Column:
    """A leaf's outcome; null if it cannot be decided."""
    return {"signers": _signers, "signed_trailer": _trailer, "oracles_complete": _oracles, "ratified_doc": _document}[p.op](p.args) if p.op not in (*SUPPLY, "fresh_within_days") else (F.lit(None).cast("boolean") if p.op in SUPPLY else _fresh(p.args, as_of))


def _signers(a: dict) -> Column:
    """Each required name has one signer row that has role, currency and strength all at once."""
    allow = a.get("signature_allow") or []
    current_only = a.get("against", "current") == "current" or bool(allow)  # a list of strengths also asks for currency

    def row_ok(s: Column, name: str) -> Column:
        ok = s["name"] == name
        if name in a.get("roles", {}):
            ok = ok & (s["role"] == a["roles"][name])
        if current_only:
            ok = ok & (s["against"] == F.col("current_digest"))
        return F.coalesce(ok & s["strength"].isin(allow) if allow else ok, F.lit(False))

    test = lambda name: lambda s: row_ok(s, name)
    each = [F.exists("signers", test(n)) for n in a["required"]]
    return F.when(F.col("signers").isNotNull(), reduce(lambda x, y: x & y, each))


def _trailer(a: dict) -> Column:
    """At least `count` trailers with the key and, if asked for, (role=x) or [role=x]."""
    mark = re.escape(a["key"]) + ":"
    role = rf".*[(\[]role={re.escape(a['role'])}[)\]]" if a.get("role") else ""
    return F.when(F.col("trailers").isNotNull(), F.size(F.filter("trailers", lambda t: t.rlike("^" + mark + role))) >= a.get("count", 1))


#: The entries of a sidecar that name an oracle, as far as they are looked at here.
ORACLES = "array<struct<path:string,state:string,invalidates:boolean>>"


def _oracles(a: dict) -> Column:
    """All files complete; the first file that is not decides.

    An entry of the sidecar only blocks: a draft, or a revoked one that invalidates, is false. Otherwise the file's own
    status decides, by path in the map `oracle_files`: no status is null (unreadable), any but complete false.
    """
    states = []
    of_path = lambda path: lambda o: o["path"] == path
    for path in a["files"]:
        entry = F.get(F.filter(F.coalesce("oracles", F.array().cast(ORACLES)), of_path(path)), F.lit(0))
        blocks = F.coalesce((entry["state"] == "draft") | ((entry["state"] == "revoked") & F.coalesce(entry["invalidates"], F.lit(False))), F.lit(False))
        status = F.try_element_at(F.col("oracle_files"), F.lit(path))
        states.append(F.when(blocks, "no").when(status.isNull(), "unread").when(status == "complete", "ok").otherwise("no"))
    first = F.filter(F.array(*states), lambda s: s != "ok")
    return F.when(F.size(first) == 0, True).when(F.get(first, F.lit(0)) == "no", False)


def _fresh(a: dict, as_of: Column) -> Column:
    """The latest date of a signer on the current digest, or fresh_through beside one, is 0 to `days` days ago; both ends count."""
    current = F.filter("signers", lambda s: s["against"] == F.col("current_digest"))
    latest = F.greatest(F.array_max(F.transform(current, lambda s: s["date"])), F.col("fresh_through"))
    age = F.datediff(as_of, latest)
    return F.when(F.col("signers").isNotNull(), F.coalesce((F.size(current) > 0) & age.between(0, a["days"]), F.lit(False)))


def _document(a: dict) -> Column:
    """Over columns doc_text and sibling_exists: unreadable, no version or one that cannot be parsed is null."""
    text = F.col("doc_text")
    version = S.front_matter(text, "version")
    out = F.when(text.isNull(), None)
    if a.get("min_version"):
        least = F.lit(a["min_version"])
        out = out.when(version.isNull() | ~S.version_parseable(version), None).when(~S.version_at_least(version, least), False)
    if a.get("anchor"):
        out = out.when(~F.contains(text, F.lit(a["anchor"])), False)
    if a.get("sibling_json"):
        out = out.when(~F.coalesce(F.col("sibling_exists"), F.lit(False)), False)
    return out.otherwise(True)


def compile_predicate(p: Pred | str | dict, as_of: Column) -> Column:
    """The composite verdict."""
    p = p if isinstance(p, Pred) else parse(p)
    if p.op == "not":
        return ~compile_predicate(p.inside[0], as_of)
    if p.op in ("all_of", "any_of"):
        terms = [compile_predicate(x, as_of) for x in p.inside]
        return reduce((lambda a, b: a & b) if p.op == "all_of" else (lambda a, b: a | b), terms)
    return leaf(p, as_of)


def leaves(p: Pred) -> list[Pred]:
    return [p] if not p.inside else [x for n in p.inside for x in leaves(n)]


def outcomes(p: Pred, as_of: Column) -> Column:
    """array<struct<label, passed, evaluated>> of all leaves, none skipped."""
    return F.array(*(F.struct(F.lit(x.op).alias("label"), F.coalesce(leaf(x, as_of), F.lit(False)).alias("passed"), leaf(x, as_of).isNotNull().alias("evaluated")) for x in leaves(p)))


def classify_passed(cap: int = 3) -> Column:
    """struct<tier, state, strength> of a passed predicate, from its sidecar's signers, first rule that fits."""
    current = F.filter("signers", lambda s: s["against"] == F.col("current_digest"))
    names = F.array_distinct(F.transform("signers", lambda s: s["name"]))
    stale = F.size(F.array_except(names, F.transform(current, lambda s: s["name"]))) > 0
    depth = F.coalesce(F.array_max(F.transform(current, lambda s: s["basis"]["depth"])), F.lit(0))
    delta = F.exists(current, lambda s: F.coalesce(s["basis"]["kind"] == "delta", F.lit(False)))
    none = F.coalesce(F.size("signers"), F.lit(0)) <= 0
    state = F.when(none, "current").when(stale, "stale").when(depth >= cap - 1, "near_cap").when(delta, "via_delta").otherwise("current")
    tier = F.when(~none & stale, "reachability").otherwise("execution")
    weakest = F.array_min(F.transform(current, lambda s: S.rank_of(F.coalesce(s["strength"], F.lit("git_trust")), S.STRENGTHS)))
    return F.struct(tier.alias("tier"), state.alias("state"), S.from_rank(F.coalesce(weakest, F.lit(0)), S.STRENGTHS).alias("strength"))


def sidecar_errors(cap: int = 3) -> Column:
    """Violations in a sidecar's delta signers, ordered and distinct."""
    b = lambda s: s["basis"]
    is_delta = lambda s: F.coalesce(b(s)["kind"] == "delta", F.lit(False))
    any_ = lambda test: F.exists("signers", lambda s: is_delta(s) & F.coalesce(test(s), F.lit(True)))
    checks = [
        ("delta depth below 1", any_(lambda s: b(s)["depth"] < 1)),
        ("delta depth above cap", any_(lambda s: b(s)["depth"] > cap)),
        ("root is not prior at depth 1", any_(lambda s: (b(s)["depth"] == 1) & (b(s)["root"] != b(s)["prior"]))),
        ("rationale too short", any_(lambda s: F.length(F.trim(b(s)["rationale"])) < 20)),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))


def oracle_errors(oracles, key: str = "path"):
    """Violations of each oracle (rows of path, stewards, transitions): two stewards with a basis, and transitions that
    have a rationale and a steward as author, never go back in time, and start where the last one ended, from draft on."""
    from pyspark.sql import Window

    rows = oracles.select(key, "stewards", F.posexplode_outer("transitions").alias("pos", "t"))
    order = Window.partitionBy(key).orderBy("pos")
    before, at = F.lag("t.to").over(order), F.lag("t.at").over(order)
    names = F.transform("stewards", lambda s: s["name"])
    there = F.col("t").isNotNull()
    flags = {
        "fewer than two stewards": F.coalesce(F.size("stewards"), F.lit(0)) < 2,
        "steward without basis": F.exists("stewards", lambda s: F.coalesce(F.trim(s["basis"]), F.lit("")) == ""),
        "transition without rationale": there & (F.coalesce(F.trim("t.rationale"), F.lit("")) == ""),
        "author is no steward": there & ~F.coalesce(F.array_contains(names, F.col("t.by")), F.lit(False)),
        "dates go back": there & (F.col("t.at") < at),
        "wrong from": there & (F.col("t.from") != F.coalesce(before, F.lit("draft"))),
    }
    rows = rows.select(key, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))).alias("e"))
    return rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("errors"))


def delta_depth(signatures, key: str = "name", order: str = "seq"):
    """For each name: deltas after its last fresh signature, and one more."""
    last = signatures.groupBy(key).agg(F.max(F.when(F.col("kind") == "fresh", F.col(order))).alias("_fresh"))
    rows = signatures.join(last, key)
    return rows.groupBy(key).agg((F.count_if((F.col("kind") == "delta") & (F.col("_fresh").isNull() | (F.col(order) > F.col("_fresh")))) + 1).alias("depth"))


def orphaned_sidecars(sidecars, files):
    """Sidecars whose source file does not exist."""
    return sidecars.join(files.select(F.col("file").alias("source_file")), "source_file", "left_anti")
