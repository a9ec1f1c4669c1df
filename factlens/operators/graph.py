"""Closure, cycles, inheritance and reachability over parent-child edges, as relations of sets: paths are never counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import saved

MAX_DEPTH = 64
#: Edges by which a round of the closure goes on.
STRIDE = 4


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """src, dst, depth of all pairs that a path joins (of at most `most` edges, if given); depth is that of the shortest.

    Semi-naive: a round extends only the farthest pairs that the last one found, by up to STRIDE edges, and drops
    those known, so cycles end by themselves, and rounds number as the longest shortest path over STRIDE.
    """
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    on = step.withColumnRenamed("src", "mid").withColumnRenamed("dst", "next")
    last = known = saved(step.withColumn("depth", F.lit(1)))
    depth = 1
    while most is None or depth < most:
        front, parts = last, []
        for k in range(1, STRIDE + 1 if most is None else min(STRIDE, most - depth) + 1):
            front = front.join(on, front["dst"] == on["mid"]).select("src", F.col("next").alias("dst")).distinct()
            parts.append(front.withColumn("depth", F.lit(depth + k)))
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        found = found.groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        new = saved(found.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        depth += len(parts)
        known = known.unionByName(new)
        last = new.where(F.col("depth") == depth).drop("depth")
        if last.isEmpty():
            break
    return known


def closure_sql(view: str) -> str:
    """The same pairs as one recursive query for graphs of modest depth; a path guard stops at cycles."""
    return f"""
    WITH RECURSIVE walk(src, dst, path, depth) AS (
      SELECT src, dst, array(src, dst), 1 FROM {view}
      UNION ALL
      SELECT w.src, e.dst, array_append(w.path, e.dst), w.depth + 1
      FROM walk w JOIN {view} e ON w.dst = e.src
      WHERE w.src <> w.dst AND NOT array_contains(slice(w.path, 2, size(w.path)), e.dst)
    ) SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst"""


def depth_exceeded(edges: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Starts from which a node lies more than `most` steps away."""
    return closure(edges, most=most + 1).where(F.col("depth") > most).select("src").distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Each simple cycle once, as `cycle`: its nodes from the least one on.

    Only edges within a cycle are walked, and only from the least node of one, so that no rotation is made twice.
    """
    step = edges.select("src", "dst").distinct()
    pairs = closure(step).select("src", "dst")
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    step = saved(step.join(back, ["src", "dst"], "left_semi").union(step.where("src = dst")).distinct())
    walk = step.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")).alias("cycle"))
    out = walk.where("start = at").select("cycle")
    walk = saved(walk.where("start <> at"))
    while not walk.isEmpty():
        longer = walk.join(step, walk["at"] == step["src"]).where((F.col("dst") >= F.col("start")) & ((F.col("dst") == F.col("start")) | ~F.array_contains("cycle", F.col("dst"))))
        longer = saved(longer.select("start", F.col("dst").alias("at"), F.when(F.col("dst") == F.col("start"), F.col("cycle")).otherwise(F.array_append("cycle", F.col("dst"))).alias("cycle")))
        out = out.union(longer.where("start = at").select("cycle"))
        walk = longer.where("start <> at")
    return out.distinct()


def inherit_sites(sites: DataFrame, lineage: DataFrame, classes: DataFrame) -> DataFrame:
    """sites with those of ancestors attached to descendants.

    A descendant takes over each ancestor's own sites; at a place where it has one already, the ancestors join its
    inherited_from; otherwise a new row is made. Edges with an undeclared end do not count. Columns: class,
    file, line, inherited_from (ordered distinct ancestors) and explicit.
    """
    known = classes.select(F.col("type_name").alias("name")).distinct()
    edges = lineage.join(known, F.col("child") == F.col("name"), "left_semi").join(known, F.col("parent") == F.col("name"), "left_semi")
    above = closure(edges, "child", "parent").where("src <> dst").select(F.col("src").alias("heir"), F.col("dst").alias("class"))
    own = sites.select("class", "file", "line").distinct()
    taken = own.join(above, "class").select(F.col("heir").alias("class"), "file", "line", F.col("class").alias("from"))
    all_ = own.withColumn("from", F.lit(None).cast("string")).unionByName(taken)
    return all_.groupBy("class", "file", "line").agg(F.array_sort(F.collect_set("from")).alias("inherited_from"), F.max(F.col("from").isNull()).alias("explicit"))


def reachable(edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None, backward: bool = False) -> DataFrame:
    """node, start: what each start (column `node`) reaches along edges of the kinds, or from where it is reached; itself at depth 0."""
    rows = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = rows.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    known = new = saved(starts.select(F.col("node").alias("start"), "node").distinct())
    while not new.isEmpty():
        found = new.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        new = saved(found.join(known, ["start", "node"], "left_anti"))
        known = known.unionByName(new)
    return known


def field_at(edges: DataFrame, sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """For every node the highest danger (column `danger`) of a source that reaches it."""
    found = reachable(edges, sources, kinds)
    return found.join(sources.select(F.col("node").alias("start"), "danger"), "start").groupBy("node").agg(F.max("danger").alias("danger"))


def provenance_of(edges: DataFrame, nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """For each node the ordered set of origins (column `origin`) that reach it."""
    found = reachable(edges, origins).join(origins.select(F.col("node").alias("start"), "origin"), "start")
    return nodes.select("node").join(found, "node", "left").groupBy("node").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def blast_from(edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """How many nodes each start reaches: a count of the reachable set, not of paths."""
    return reachable(edges, starts, kinds).where("node <> start").groupBy("start").agg(F.count("*").alias("reach"))


NODE_TIERS = ["syntactic", "resolved", "verified"]


def corroborate(a: Column, b: Column) -> Column:
    """The higher of two tiers; none if either is only syntactic."""
    x, y = S.rank_of(a, NODE_TIERS), S.rank_of(b, NODE_TIERS)
    return F.when((x > 0) & (y > 0), S.from_rank(F.greatest(x, y), NODE_TIERS))


def lower_nodes(*facts: DataFrame) -> DataFrame:
    """Nodes of several fact relations, each once by path, identity digest and cfg set; revision is the latest."""
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy("fq_path", "identity_digest", "cfg_set").agg(F.first("tier").alias("tier"), F.first("kind").alias("kind"), F.max("revision").alias("revision"))


def fq_path(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def module_chain(file: Column) -> Column:
    """A file's module path: directories below src and its stem, without lib, main and mod."""
    inner = F.regexp_replace(F.regexp_replace(file, r"^.*?src/", ""), r"\.rs$", "")
    return F.array_join(F.filter(F.split(inner, "/"), lambda p: ~p.isin("lib", "main", "mod")), "::")


def refine_tier(tier: Column, symbol: Column) -> Column:
    """A well-formed symbol of an index (scheme, manager, package, version, descriptor) makes a syntactic node resolved."""
    return F.when((tier == "syntactic") & F.coalesce(symbol.rlike(r"^\S+ \S+ \S+ \S+ \S+$"), F.lit(False)), "resolved").otherwise(tier)


def fidelity(tier: Column, source_mtime: Column, index_mtime: Column) -> Column:
    """Demoted to syntactic if the source is as new as the index, within a second."""
    return F.when(source_mtime + 1 >= index_mtime, "syntactic").otherwise(tier)
