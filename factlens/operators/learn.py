"""Learning patterns from examples, scoring and curating them, and drift detection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.pattern import Node, Pattern, compile_pattern
from .aggregates import rate

#: Operators that only frame a pattern and tell no defect from a clean item.
FRAMEWORK = {"item", "impl_of_trait", "name"}
SIGNAL_COLUMNS = {"body_calls": "body_calls", "body_contains_macro": "body_macros", "derives": "derives", "serde_arg": "serde_args", "attr_present": "attr_paths"}

# ---- proposing


def signals(items: DataFrame, member: str = "member") -> DataFrame:
    """member, op, value: the features that may tell an item apart."""
    parts = [items.select(member, F.lit(op).alias("op"), F.explode(F.array_distinct(column)).alias("value")) for op, column in SIGNAL_COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def anti_unify(cluster: DataFrame, member: str = "member") -> Pattern | None:
    """The most specific pattern that all members share, or null if they have different kinds.

    Shared signals are conjuncts; of the others, two or more of which every member has one become an any_of, and a
    single one a conjunct. Counts for each signal are made in Spark; the driver gets the signals, not the members.
    """
    head = cluster.agg(F.count_distinct(member).alias("n"), F.collect_set("kind").alias("kinds"), F.collect_set(F.coalesce("impl_trait", F.lit(""))).alias("traits")).first()
    if head["n"] == 0 or len(head["kinds"]) != 1:
        return None
    nodes = [Node("item", (head["kinds"][0],))]
    if len(head["traits"]) == 1 and head["traits"][0]:
        nodes.append(Node("impl_of_trait", (head["traits"][0],)))
    found = signals(cluster, member)
    counts = sorted((r["op"], r["value"], r["n"]) for r in found.groupBy("op", "value").agg(F.count_distinct(member).alias("n")).collect())
    nodes += [Node(op, (v,)) for op, v, n in counts if n == head["n"]]
    rest = [(op, v) for op, v, n in counts if n < head["n"]]
    if len(rest) >= 2:
        odd = found.groupBy("op", "value").agg(F.count_distinct(member).alias("n")).where(F.col("n") < head["n"])
        covered = found.join(odd, ["op", "value"], "left_semi").agg(F.count_distinct(member)).first()[0]
        if covered == head["n"]:
            nodes.append(Node("any_of", (), tuple(Node(op, (v,)) for op, v in rest)))
    elif len(rest) == 1:
        nodes.append(Node(rest[0][0], (rest[0][1],)))
    return Pattern((Node("all_of", (), tuple(nodes)),)) if len(nodes) > 1 else Pattern(tuple(nodes))


def conjuncts(pattern: Pattern) -> list[Node]:
    """The conditions that must all hold, with a top-level all_of opened."""
    return [n for c in pattern.constraints for n in (c.inside if c.op == "all_of" else (c,))]


def discriminating(node: Node) -> bool:
    return any(map(discriminating, node.inside)) if node.inside else node.op not in FRAMEWORK


def degenerate(pattern: Pattern) -> bool:
    """No conjunct tells anything apart."""
    return not any(map(discriminating, conjuncts(pattern)))


def confidence(members: int, pattern: Pattern) -> str:
    return "high" if members >= 2 and any(n.op == "any_of" and len(n.inside) >= 2 for n in conjuncts(pattern)) else "low"


def near_miss(pattern: Pattern) -> Column:
    """Not matched, but matched without exactly one conjunct, the others still telling something apart."""
    parts = conjuncts(pattern)
    if len(parts) < 2:
        return F.lit(False)
    hit = F.coalesce(compile_pattern(Pattern(tuple(parts))), F.lit(False))
    looser = [Pattern(tuple(p for j, p in enumerate(parts) if j != i)) for i in range(len(parts))]
    tests = [F.coalesce(compile_pattern(q), F.lit(False)) for q in looser if not degenerate(q)]
    return ~hit & F.greatest(*tests, F.lit(False)) if tests else F.lit(False)


def first_match(clean: DataFrame, pattern: Pattern, index: str = "index") -> DataFrame:
    """The least index of a clean item that the pattern matches; null if it spares all."""
    return clean.where(compile_pattern(pattern)).agg(F.min(index).alias("first"))


def promote(pattern: Pattern, clean: DataFrame) -> str:
    """promoted, or the first gate that stops it: empty_clean, no_discriminator, no_near_miss, matches_clean."""
    hit = F.coalesce(compile_pattern(pattern), F.lit(False))
    counts = clean.agg(F.count("*").alias("n"), F.count_if(near_miss(pattern)).alias("near"), F.count_if(hit).alias("hits")).first()
    if counts["n"] == 0:
        return "empty_clean"
    if degenerate(pattern):
        return "no_discriminator"
    if counts["near"] == 0:
        return "no_near_miss"
    return "matches_clean" if counts["hits"] else "promoted"


def propose(cluster: DataFrame, clean: DataFrame, member: str = "member") -> tuple[Pattern | None, str]:
    pattern = anti_unify(cluster, member)
    if pattern is None:
        return None, "no_common_kind"
    return (pattern, "degenerate") if degenerate(pattern) else (pattern, promote(pattern, clean))


# ---- scoring


def score_all(patterns: list[Pattern], cluster: DataFrame, clean: DataFrame) -> list[tuple[float, float]]:
    """(recall, precision) of all patterns, in one aggregate over each corpus."""
    hit = [F.coalesce(compile_pattern(p), F.lit(False)) for p in patterns]
    a = cluster.agg(*(rate(F.count_if(h), F.count("*")).alias(f"x{i}") for i, h in enumerate(hit))).first()
    b = clean.agg(*(rate(F.count_if(~h), F.count("*")).alias(f"x{i}") for i, h in enumerate(hit))).first()
    return list(zip(a, b, strict=True))


def dominates(a: tuple[float, float], b: tuple[float, float]) -> bool:
    """At least as good in both and better in one."""
    return a[0] >= b[0] and a[1] >= b[1] and a != b


def compare(a: tuple[float, float], b: tuple[float, float]) -> int | None:
    """1, 0, -1, or None for pairs that cannot be compared."""
    return 0 if a == b else 1 if dominates(a, b) else -1 if dominates(b, a) else None


def favors(recall_a: Column, precision_a: Column, recall_b: Column, precision_b: Column) -> Column:
    ra, pa, rb, pb = map(S.clamp_rate, (recall_a, precision_a, recall_b, precision_b))
    return F.when((ra == rb) & (pa == pb), "equal").when((ra >= rb) & (pa >= pb), "first").when((ra <= rb) & (pa <= pb), "second")


def mature(pattern: Pattern, cluster: DataFrame, clean: DataFrame, most: int = 10) -> tuple[Pattern, tuple[float, float], int]:
    """Hill-climb: a round drops one discriminating conjunct or one arm of an any_of, and only a strict Pareto gain is taken.

    The budget of rounds shrinks with the score: round(most * (1 - (recall + precision) / 2)), at least 1.
    """
    best, score, rounds = pattern, score_all([pattern], cluster, clean)[0], 0
    budget = max(1, int(math.floor(most * (1 - sum(score) / 2) + 0.5)))
    while rounds < budget:
        parts = conjuncts(best)
        options = []
        for i, n in enumerate(parts):
            others = parts[:i] + parts[i + 1 :]
            if discriminating(n) and others:
                options.append(others)
            if n.op == "any_of" and len(n.inside) > 1:
                options += [parts[:i] + [Node("any_of", (), n.inside[:j] + n.inside[j + 1 :])] + parts[i + 1 :] for j in range(len(n.inside))]
        tried = [p for p in (Pattern((Node("all_of", (), tuple(o)),)) if len(o) > 1 else Pattern(tuple(o)) for o in options) if not degenerate(p)]
        rounds += 1
        scored = [(s, p) for s, p in zip(score_all(tried, cluster, clean), tried, strict=True) if dominates(s, score)] if tried else []
        if not scored:
            break
        score, best = max(scored, key=lambda x: x[0][0] + x[0][1])
    return best, score, rounds


# ---- deciding


def silent_status(near: Column, match: Column, capable: Column) -> Column:
    return F.when(near, "evading").when(match, "dormant").when(capable, "obsolete").otherwise("indeterminate")


def classify(silent: Column, defended: Column, drift: Column, axis: Column) -> Column:
    """Fused verdict of silence, defense and drift; where the channels contradict each other or lack power, a human decides."""
    contradiction = (drift == "drift") & (((axis == "precision") & (silent == "obsolete")) | ((axis == "recall") & (silent == "dormant")))
    return (
        F.when(drift.isin("under_powered", "non_finite") | (silent == "indeterminate") | contradiction, "human")
        .when(drift == "drift", "drifted")
        .when(silent == "evading", "evading")
        .when((silent == "obsolete") & ~defended, "obsolete")
        .when(silent == "dormant", "dormant")
        .otherwise("active")
    )


def curate(verdict: Column, retired: Column) -> Column:
    """The action of a verdict; only what is obsolete is forgotten, and only once."""
    return F.when(verdict == "human", "human").when(verdict == "obsolete", F.when(retired, "keep").otherwise("forget")).when(verdict == "drifted", "rearm").when(verdict == "evading", "rearm").when(verdict == "dormant", "hold").otherwise("keep")


def apply_actions(records: DataFrame, actions: DataFrame) -> DataFrame:
    """The append-only record with a retired or drifted event for each class forgotten or re-armed; seq goes on."""
    last = records.groupBy("class").agg(F.max("seq").alias("_last"))
    event = F.when(F.col("action") == "forget", "retired").when(F.col("action") == "rearm", "drifted")
    new = actions.withColumn("event", event).where("event is not null").join(last, "class", "left").select("class", (F.coalesce("_last", F.lit(-1)) + 1).alias("seq"), "event")
    return records.select("class", "seq", "event").unionByName(new)


def is_retired(records: DataFrame) -> DataFrame:
    return records.groupBy("class").agg((F.max_by("event", "seq") == "retired").alias("retired"))


# ---- drift

DELTA_MIN, DELTA_MAX = 1e-6, 0.5


def clamp_delta(delta: float) -> float:
    return DELTA_MIN if delta is None or math.isnan(delta) else min(max(delta, DELTA_MIN), DELTA_MAX)


def eps(n0: int, n1: int, variance: float, delta: float) -> float:
    """The cut bound: without variance for short series, from 30 values on the smaller of both bounds."""
    m, n = 1 / (1 / n0 + 1 / n1), n0 + n1
    floor = math.sqrt(math.log(4 * n / delta) / (2 * m))
    if n < 30:
        return floor
    c = math.log(2 * math.log(n) / delta)
    return min(floor, math.sqrt(2 / m * variance * c) + 2 / (3 * m) * c)


def power_threshold(delta: float) -> int:
    """The least even length at which an even cut could show a change from 0 to 1 at all: twice the bound is 1 at most."""
    n = 2
    while 2 * math.sqrt(math.log(4 * n / delta) / (2 * (n / 4))) > 1:
        n += 2
    return n


def detect_axis(values: list[float], delta: float) -> dict:
    """drift with cut, difference and eps; under_powered, non_finite, or no_drift with the tightest margin.

    After a cut that is not significant the halves are looked at in turn. A cut found in a right half counts from
    the start of that half.
    """
    if any(not math.isfinite(v) for v in values):
        return {"state": "non_finite"}
    n = len(values)
    if n < 2:
        return {"state": "under_powered"}
    mean = sum(values) / n
    variance = sum((v - mean) ** 2 for v in values) / n
    total, prefix, best = sum(values), 0.0, None
    for cut in range(1, n):
        prefix += values[cut - 1]
        d, e = abs(prefix / cut - (total - prefix) / (n - cut)), eps(cut, n - cut, variance, delta)
        if best is None or d - e > best[0]:
            best = (d - e, cut, d, e)
    if best[0] >= 0:
        return {"state": "drift", "cut": best[1], "difference": best[2], "eps": best[3]}
    half = n // 2
    if half >= power_threshold(delta):
        for part in (values[:half], values[half:]):
            found = detect_axis(part, delta)
            if found["state"] == "drift":
                return found
    if n < power_threshold(delta):
        return {"state": "under_powered"}
    return {"state": "no_drift", "cut": best[1], "difference": best[2], "eps": best[3]}


def adwin(scores: DataFrame, delta: float = 0.05) -> DataFrame:
    """class, state, axis, cut, difference, eps. Each axis gets half of delta; the first that drifts wins.

    The recursion over halves is no set operation, so each class's series is one pandas group; a series is one
    score for each time a class was measured, and so short.
    """
    half = clamp_delta(delta) / 2
    schema = "class string, state string, axis string, cut long, difference double, eps double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        found = {a: detect_axis(rows[a].astype(float).tolist(), half) for a in ("recall", "precision")}
        for state in ("drift", "non_finite", "under_powered"):
            axis = next((a for a in found if found[a]["state"] == state), None)
            if axis:
                break
        else:
            axis = min(found, key=lambda a: found[a]["eps"] - found[a]["difference"])
        f = found[axis]
        return pd.DataFrame([[rows["class"].iloc[0], f["state"], axis, f.get("cut"), f.get("difference"), f.get("eps")]], columns=["class", "state", "axis", "cut", "difference", "eps"])

    return scores.groupBy("class").applyInPandas(run, schema)


class ExponentialHistogram:
    """Buckets of power-of-two sizes, at most `most` of each; beyond that the two oldest of a size merge."""

    def __init__(self, buckets: list[tuple[int, float]] | None = None, most: int = 5):
        self.buckets, self.most = list(buckets or []), most  # oldest first, (size, sum)

    def add(self, value: float) -> None:
        self.buckets.append((1, value))
        size = 1
        while sum(b[0] == size for b in self.buckets) > self.most:
            i = next(k for k, b in enumerate(self.buckets) if b[0] == size)
            self.buckets[i : i + 2] = [(2 * size, self.buckets[i][1] + self.buckets[i + 1][1])]
            size *= 2

    def extend(self, values: Iterator[float]) -> ExponentialHistogram:
        for v in values:
            self.add(v)
        return self

    @property
    def count(self) -> int:
        return sum(b[0] for b in self.buckets)

    @property
    def mean(self) -> float:
        return sum(b[1] for b in self.buckets) / self.count if self.buckets else 0.0
