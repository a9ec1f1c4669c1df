"""Mining commit logs: fixes, the commits that brought in defects, recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def fix_commits(commits: DataFrame) -> DataFrame:
    """Commits whose subject says fix or refers to an issue and that are not only cosmetic."""
    return commits.where(S.is_fix_subject(F.col("subject")) & ~F.coalesce("cosmetic_only", F.lit(False)))


def mine_blame(commits: DataFrame, blamed: DataFrame) -> DataFrame:
    """defect, fix, path: fixes with the commits that their lines are blamed on; a fix is not its own defect."""
    fixes = fix_commits(commits).select(F.col("id").alias("fix"))
    rows = fixes.join(blamed.select(F.col("fix_id").alias("fix"), F.col("introducing_commit").alias("defect"), "path"), "fix")
    return rows.where("defect <> fix").select("defect", "fix", "path").distinct()


def mine_first_parent(commits: DataFrame) -> DataFrame:
    """defect, fix, path: each fix with its first parent and an empty path; a fix without a parent gives none."""
    return fix_commits(commits).where("parent is not null").select(F.col("parent").alias("defect"), F.col("id").alias("fix"), F.lit("").alias("path")).distinct()


def starved(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.agg((F.count("*") < least).alias("starved"))


def recurrence_counts(commits: DataFrame, paths: DataFrame, last: int) -> DataFrame:
    """path, touches: how many of the latest `last` commits touch each path; null (unobservable) if there are no commits."""
    top = commits.orderBy(F.desc("seq")).limit(last)
    touched = top.select("id", F.explode(F.array_distinct("files")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    total = top.agg(F.count("*").alias("total"))
    rows = paths.select("path").distinct().join(touched, "path", "left").join(total)
    return rows.select("path", F.when(F.col("total") > 0, F.coalesce("n", F.lit(0))).alias("touches"))


def trailers(commits: DataFrame, text: str = "message") -> DataFrame:
    """id, pos, key, value of the `key: value` lines of each message."""
    lines = commits.select("id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    pattern = r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)$"
    return lines.where(F.col("line").rlike(pattern)).select("id", "pos", F.regexp_extract("line", pattern, 1).alias("key"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))
