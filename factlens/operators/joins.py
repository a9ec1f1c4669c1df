"""Joins between fact relations: null-safe semi, anti and existence joins on several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality in which null equals null only."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def semi(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return left.join(right, null_safe(left, right, pairs), "left_semi")


def anti(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """NOT EXISTS: rows of left without a partner; nulls never make it empty, as NOT IN would."""
    return left.join(right, null_safe(left, right, pairs), "left_anti")


def target_keys(target: Column) -> Column:
    """Keys under which a target can be met: two targets address the same item if they share one.

    A method in a trait's impl also answers to the trait's own method; generic arguments
    of an impl's type do not count; an unknown target has no key and meets nothing.
    """
    base = lambda c: F.trim(F.substring_index(c, "<", 1))
    key = lambda *parts: F.to_json(F.array(*(F.coalesce(p, F.lit("~")) for p in parts)))
    kind = target["kind"]
    own = (
        F.when(kind == "impl", key(kind, base(target["a"]), target["b"]))
        .when(kind == "impl_fn", key(kind, base(target["a"]), target["b"], target["c"]))
        .when(kind == "trait_fn", key(F.lit("trait_fn"), target["a"], target["b"]))
        .otherwise(key(kind, target["a"]))
    )
    as_trait = F.when((kind == "impl_fn") & target["c"].isNotNull(), key(F.lit("trait_fn"), target["c"], target["b"]))
    return F.when(kind.isNull() | (kind == "unknown"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(own, as_trait)))


def locus_key(file: Column, path: Column) -> Column:
    """Two places agree if both have the same crate path, or neither has one and the file is the same."""
    return F.when(path.isNull(), F.concat(F.lit("file:"), file)).otherwise(F.concat(F.lit("crate:"), path))


def locus_matches(file_a: Column, path_a: Column, file_b: Column, path_b: Column) -> Column:
    return locus_key(file_a, path_a) == locus_key(file_b, path_b)


def unaddressed(sites: DataFrame, immunities: DataFrame, tolerances: DataFrame, defenses: DataFrame, classes: DataFrame) -> DataFrame:
    """Sites that no immunity, tolerance or defense addresses, with class_known.

    Immunity and tolerance need the same class, crate path, target and place; a defense,
    whose test lives elsewhere, only class and crate path. Targets are compared through
    their keys, so each step is an anti join on equal keys.
    """
    sites = sites.withColumn("_site", F.xxhash64(*sites.columns)).withColumn("_locus", locus_key(F.col("file"), F.col("canonical_path")))
    keyed = lambda df: df.select("class", "canonical_path", locus_key(F.col("file"), F.col("canonical_path")).alias("_locus"), F.explode(target_keys(F.col("target"))).alias("_key"))
    answers = keyed(immunities).unionByName(keyed(tolerances)).distinct()
    asked = sites.select("_site", "class", "canonical_path", "_locus", F.explode(target_keys(F.col("target"))).alias("_key"))
    met = semi(asked, answers, [("class", "class"), ("canonical_path", "canonical_path"), ("_locus", "_locus"), ("_key", "_key")]).select("_site").distinct()
    rest = anti(sites.join(met, "_site", "left_anti"), defenses, [("class", "class"), ("canonical_path", "canonical_path")])
    known = classes.select(F.col("type_name").alias("_class"), F.col("canonical_path").alias("_path")).distinct()
    out = rest.join(known, rest["class"].eqNullSafe(known["_class"]) & rest["canonical_path"].eqNullSafe(known["_path"]), "left")
    return out.withColumn("class_known", F.col("_class").isNotNull()).drop("_site", "_locus", "_class", "_path")


def partition_gaps(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicitly marked gaps, and those that a pattern found."""
    return gaps.where("match_kind = 'explicit'"), gaps.where("match_kind = 'fingerprint'")


def orphaned_tolerances(tolerances: DataFrame, classes: DataFrame) -> DataFrame:
    return anti(tolerances, classes, [("class", "type_name"), ("canonical_path", "canonical_path")])


def orphaned_lineage(lineage: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges whose parent is not declared."""
    return anti(lineage, classes, [("parent", "type_name"), ("parent_path", "canonical_path")])


def dangling_children(lineage: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges whose child is not declared."""
    return anti(lineage, classes, [("child", "type_name"), ("child_path", "canonical_path")])


def unscanned(coverage: DataFrame) -> DataFrame:
    """Members that were listed but not scanned, each once."""
    return coverage.select(F.explode("enumerated").alias("member")).subtract(coverage.select(F.explode("scanned").alias("member")))


def suppress_declared(matches: DataFrame, sites: DataFrame, tolerances: DataFrame, classes: DataFrame) -> DataFrame:
    """Pattern matches without those that are marked, tolerated, a class's own declaration, or seen already."""
    keys = [("class", "class"), ("file", "file"), ("line", "line")]
    rest = anti(anti(matches, sites, keys), tolerances, keys)
    return anti(rest, classes, [("class", "type_name"), ("file", "file"), ("line", "line")]).dropDuplicates(["class", "file", "line"])


def generated_sites(calls: DataFrame, generators: DataFrame, existing: DataFrame) -> DataFrame:
    """Sites at the calls of generating macros, by macro name, unless one is there already."""
    made = calls.join(generators.select("class", "macro_name"), "macro_name").select("class", "file", "line", "macro_name").distinct()
    return anti(made, existing, [("class", "class"), ("file", "file"), ("line", "line")])


def rekey(edges: DataFrame, classes: DataFrame, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Restamp `path` of rows whose `name` is declared in exactly one member.

    Names declared in several members stay as they are and are reported; unknown ones stay.
    """
    places = classes.groupBy(F.col("type_name").alias("_name")).agg(F.collect_set("canonical_path").alias("_paths"))
    joined = edges.join(places, edges[name] == places["_name"], "left")
    stamped = joined.withColumn(path, F.when(F.size("_paths") == 1, F.get("_paths", F.lit(0))).otherwise(F.col(path))).drop("_name", "_paths")
    ambiguous = joined.where("size(_paths) > 1").select(F.col(name).alias("name"), F.array_sort("_paths").alias("members")).distinct()
    return stamped, ambiguous


def resolve_delegates(boundaries: DataFrame, handlers: DataFrame) -> DataFrame:
    """For each delegating boundary: resolved, missing, ambiguous (several files) or kind_mismatch."""
    found = handlers.groupBy(F.col("name").alias("_name")).agg(F.count_distinct("file").alias("_files"), F.collect_set("boundary_kind").alias("_kinds"))
    joined = boundaries.join(found, F.substring_index("handled_by", "::", -1) == F.col("_name"), "left")
    state = F.when(F.col("_name").isNull(), "missing").when(F.col("_files") > 1, "ambiguous").when(~F.array_contains("_kinds", F.col("boundary_kind")), "kind_mismatch").otherwise("resolved")
    return joined.withColumn("resolution", state).drop("_name", "_files", "_kinds")


def structural_diff(before: DataFrame, after: DataFrame, name: str = "name", digest: str = "structural_digest") -> DataFrame:
    """added, removed and modified names; the order of items plays no part."""
    a = before.select(F.col(name).alias("_a"), F.col(digest).alias("_da"))
    b = after.select(F.col(name).alias("_b"), F.col(digest).alias("_db"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_da").eqNullSafe(F.col("_db")), "modified")
    return both.select(F.coalesce("_a", "_b").alias("name"), change.alias("change")).where("change is not null")


def catalog_findings(sites: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pattern-matched sites with their class's provenance, in file order; classes not in the catalog drop out."""
    found = sites.where("match_kind = 'fingerprint'").join(catalog.select("class", "provenance"), "class")
    order = Window.partitionBy("file").orderBy("line", "class")
    return found.withColumn("ts", F.row_number().over(order) - 1)
