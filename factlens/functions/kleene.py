"""Three-valued logic: true, false and null (undefined) in nullable boolean columns.

SQL's AND, OR and NOT are Kleene's; folds over groups are not, since bool_and skips nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def any_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def is_match(term: Column) -> Column:
    """Only exactly true counts."""
    return F.coalesce(term, F.lit(False))


def fold_and(value: Column) -> Column:
    """AND over a group: false if any is false, else null if any is null, else true (also for no rows)."""
    return F.when(F.coalesce(F.bool_or(~value), F.lit(False)), False).when(F.count(F.lit(1)) > F.count(value), None).otherwise(True)


def fold_or(value: Column) -> Column:
    """OR over a group: true if any is true, else null if any is null, else false (also for no rows)."""
    return F.when(F.coalesce(F.bool_or(value), F.lit(False)), True).when(F.count(F.lit(1)) > F.count(value), None).otherwise(False)
