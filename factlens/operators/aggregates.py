"""Rollups, windows, ranking and set operations over fact relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# ---- aggregations


def defended_status(verdicts: DataFrame) -> DataFrame:
    """For each class: sites, how many resolve, the strongest tier, and whether it is undefended."""
    rank = S.rank_of(F.col("tier"), S.TIERS)
    out = verdicts.groupBy("class").agg(F.count("*").alias("sites"), F.count_if(rank > 0).alias("resolving"), F.max(rank).alias("rank"))
    return out.select("class", "sites", "resolving", S.from_rank(F.coalesce("rank", F.lit(0)), S.TIERS).alias("max_tier"), (F.col("resolving") == 0).alias("undefended"))


def count_by(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a conditional count for each value."""
    return rows.agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def clean_and_concern(audits: DataFrame, hints: str = "hints") -> DataFrame:
    return audits.agg(F.count_if(F.size(hints) == 0).alias("clean"), F.count_if(F.size(hints) > 0).alias("concern"))


def for_all(term: Column) -> Column:
    """Whether a term holds for every row of a group; true for none."""
    return F.coalesce(F.bool_and(F.coalesce(term, F.lit(False))), F.lit(True))


def for_any(term: Column) -> Column:
    """Whether it holds for some row; false for none."""
    return F.coalesce(F.bool_or(F.coalesce(term, F.lit(False))), F.lit(False))


def total_declarations(*relations: DataFrame) -> DataFrame:
    counts = [r.agg(F.count("*").alias("n")) for r in relations]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("total"))


def duplicate_edges(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the first of equal ones kept (by file and line), and a report of those declared several times."""
    keys = ["child", "parent", "child_path", "parent_path"]
    order = Window.partitionBy(*keys).orderBy("file", "line")
    kept = lineage.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept, lineage.groupBy(*keys).agg(F.count("*").alias("declared")).where("declared > 1")


def rate(matched: Column, total: Column) -> Column:
    """A share; 0.0 of nothing."""
    return F.when(total > 0, matched / total).otherwise(F.lit(0.0))


def measure(cluster: DataFrame, clean: DataFrame, pattern: Column) -> DataFrame:
    """recall: matched share of the cluster; precision: spared share of the clean corpus; both 0.0 of nothing."""
    hit = F.coalesce(pattern, F.lit(False))
    a = cluster.agg(rate(F.count_if(hit), F.count("*")).alias("recall"))
    b = clean.agg(rate(F.count_if(~hit), F.count("*")).alias("precision"))
    return a.join(b)  # one row each


def shape_clusters(marks: DataFrame, least: int = 2) -> DataFrame:
    """Marks grouped by shape, with the number of distinct places; largest first, then by digest; the chosen one is the last of the largest."""
    out = marks.groupBy("shape_digest").agg(F.count_distinct("file", "line").alias("sites"), F.min(F.struct("file", "line")).alias("first")).where(F.col("sites") >= least)
    best = out.agg(F.max(F.struct("sites", "shape_digest")).alias("best"))
    return out.join(best).select("shape_digest", "sites", "first", (F.col("shape_digest") == F.col("best.shape_digest")).alias("chosen"))


# ---- windows


def trajectory(scores: DataFrame) -> DataFrame:
    """improving, worsening, steady or mixed for each class with two or more scores, from the first to the last."""
    ends = scores.groupBy("class").agg(F.count("*").alias("n"), F.min_by(F.struct("recall", "precision"), "seq").alias("first"), F.max_by(F.struct("recall", "precision"), "seq").alias("last"))
    r, p = F.col("last.recall") - F.col("first.recall"), F.col("last.precision") - F.col("first.precision")
    way = F.when((r == 0) & (p == 0), "steady").when((r >= 0) & (p >= 0), "improving").when((r <= 0) & (p <= 0), "worsening").otherwise("mixed")
    return ends.where("n >= 2").select("class", way.alias("direction"))


def story_coherent(claimed: Column, actual: Column) -> Column:
    """Whether a claimed trend agrees with the actual one: only opposed pairs do not."""
    opposed = ((claimed == "improving") & (actual == "worsening")) | ((claimed == "worsening") & (actual == "improving"))
    return ~F.coalesce(opposed, F.lit(False))


def best_split(series: DataFrame, key: str, order: str, value: str, delta: float) -> DataFrame:
    """For each series the cut where prefix and suffix means differ most against their bound.

    Columns: key, cut (length of the prefix), n, difference, eps, drifted. Of equal cuts the first counts.
    """
    past, rest = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rows = series.select(
        key, F.count(value).over(past).alias("cut"), F.avg(value).over(past).alias("m0"), F.count(value).over(rest).alias("n1"), F.avg(value).over(rest).alias("m1")
    ).where("n1 > 0 and cut > 0")
    n0, n1 = F.col("cut").cast("double"), F.col("n1").cast("double")
    rows = rows.withColumn("difference", F.abs(F.col("m0") - F.col("m1"))).withColumn("eps", S.eps_floor(n0, n1, delta))
    best = rows.groupBy(key).agg(F.max(F.struct((F.col("difference") - F.col("eps")).alias("evidence"), (-F.col("cut")).alias("early"), "cut", (F.col("cut") + F.col("n1")).alias("n"), "difference", "eps")).alias("b"))
    return best.select(key, "b.cut", "b.n", "b.difference", "b.eps", (F.col("b.difference") >= F.col("b.eps")).alias("drifted"))


def forward_fill(lines: DataFrame, key: str, order: str, mark: Column, name: str) -> DataFrame:
    """The last mark at or before each line."""
    return lines.withColumn(name, F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# ---- ranking


def session_clusters(findings: DataFrame, limit: int = 10, sites: int = 5) -> DataFrame:
    """Pattern-match findings by cluster: highest severity, strongest provenance, size, first sites; the worst `limit` clusters.

    Only `sites` places of each cluster are gathered: they are numbered before they are collected.
    """
    rows = findings.where("body.kind = 'fingerprint_match'").withColumn("sev", S.rank_of(F.col("severity"), S.SEVERITIES)).withColumn("prov", S.rank_of(F.col("class_provenance"), S.PROVENANCES))
    top = rows.groupBy("cluster_key").agg(F.max("sev").alias("sev"), F.min("prov").alias("prov"), F.count("*").alias("size")).orderBy(F.desc("sev"), F.desc("size"), "cluster_key").limit(limit)
    number = F.row_number().over(Window.partitionBy("cluster_key").orderBy("file", "line"))
    first = rows.join(F.broadcast(top.select("cluster_key")), "cluster_key").withColumn("_n", number).where(F.col("_n") <= sites).groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("sites"))
    out = top.join(first, "cluster_key").select("cluster_key", S.from_rank(F.col("sev"), S.SEVERITIES).alias("severity"), S.from_rank(F.col("prov"), S.PROVENANCES).alias("provenance"), "size", "sites", "sev")
    return out.orderBy(F.desc("sev"), F.desc("size"), "cluster_key").drop("sev")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


BOARD = ["overdue", "out_of_frame", "pending", "fulfilled"]


def board(audits: DataFrame, index: str) -> DataFrame:
    """Audits in the order of the board, within a verdict as they came."""
    return audits.orderBy(S.rank_of(F.col("verdict"), BOARD), index)


# ---- set operations


def merge_reports(*parts: DataFrame) -> DataFrame:
    """Concatenation, nothing removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shared_signals(signals: DataFrame, member: str = "member", signal: str = "signal") -> DataFrame:
    """signal, shared: whether every member has it."""
    total = signals.agg(F.count_distinct(member).alias("total"))
    return signals.groupBy(signal).agg(F.count_distinct(member).alias("n")).join(total).select(signal, (F.col("n") == F.col("total")).alias("shared"))


def union_distinct(lists: Column) -> Column:
    """The ordered distinct union of arrays in a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists))))
