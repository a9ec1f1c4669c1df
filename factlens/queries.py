"""The operators bound to the driver's tables, one query each, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kleene as Kl
from .functions import scalars as S
from .operators import aggregates as A
from .operators import audits as U
from .operators import graph as G
from .operators import joins as J
from .operators import learn as L
from .operators import mining as M
from .plans import pattern as P
from .plans import predicate as Pr
from .shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "1998-09-02"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark: SparkSession, d: str) -> DataFrame:
    """part as items: kind from the type, name and size as they are, some features only where they apply."""
    kinds = F.create_map(*(F.lit(x) for k, v in zip(range(6), ("enum", "fn", "impl", "struct", "trait", "mod"), strict=True) for x in (k, v)))
    kind = F.element_at(kinds, (F.col("p_partkey") % 6).cast("int"))
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), kind.alias("kind"), F.col("p_name").alias("name"), F.when(kind == "enum", F.col("p_size")).alias("variant_count"),
        F.array().cast("array<struct<name:string,sig:string>>").alias("methods"), F.array("p_brand").alias("attr_paths"), F.concat_ws("\n", "p_name", "p_type").alias("doc"),
        F.when(kind.isin("fn", "impl"), words).alias("body_calls"), F.when(kind.isin("fn", "impl"), F.array("p_type")).alias("body_macros"),
        F.when(kind == "fn", F.col("p_size") > 25).alias("is_async"), F.when(kind.isin("fn", "impl", "trait"), F.col("p_size") % 2 == 0).alias("is_unsafe"), F.when(kind == "fn", F.col("p_size") % 3 == 0).alias("is_const"),
        F.when(kind == "impl", F.col("p_type")).alias("impl_trait"), F.array("p_type").alias("derives"), F.array("p_brand").alias("serde_args"),
    )


KIND_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'enum' WHEN 1 THEN 'fn' WHEN 2 THEN 'impl' WHEN 3 THEN 'struct' WHEN 4 THEN 'trait' ELSE 'mod' END"
ITEMS_SQL = f"(SELECT p_partkey AS id, p_brand, p_name, p_type, p_size, {KIND_SQL} AS kind FROM part)"


@query("SELECT p_partkey AS id FROM part WHERE regexp_full_match(p_name, '.*r.d.*.', 's')")
def pattern_name_glob(spark, d):
    return P.match(part_items(spark, d), 'name = matches("*r?d*?")').select("id")


@query(f"SELECT id FROM {ITEMS_SQL} WHERE kind = 'enum' AND p_size BETWEEN 5 AND 20")
def pattern_variants(spark, d):
    return P.match(part_items(spark, d), "item = enum, variants = 5..=20").select("id")


@query(f"SELECT id FROM {ITEMS_SQL} WHERE kind = 'trait'")
def pattern_kind(spark, d):
    return P.match(part_items(spark, d), "item = trait").select("id")


@query(f"SELECT id FROM {ITEMS_SQL} WHERE contains(p_name, 'e') AND kind IN ('fn', 'impl', 'trait') AND NOT (p_size % 2 = 0)")
def pattern_kleene_partial(spark, d):
    """Off its domain the qualifier is undefined, and so is its negation: such items do not match."""
    return P.match(part_items(spark, d), 'all_of([name = matches("*e*"), not(is_unsafe)])').select("id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND (lang = 'en' OR lang = 'fr') AND NOT contains(text, 'License')")
def pattern_all_any_not(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select("doc_id", F.lit("fn").alias("kind"), F.col("lang").alias("name"), F.col("text").alias("doc"))
    return P.match(items, 'all_of([doc_contains("the"), any_of([name = matches("en"), name = matches("fr")]), not(doc_contains("License"))])').select("doc_id")


@query(f"SELECT id FROM {ITEMS_SQL} WHERE kind IN ('fn', 'impl') AND list_contains(string_split(p_name, ' '), 'gear')")
def pattern_body_calls(spark, d):
    return P.match(part_items(spark, d), 'body_calls("gear")').select("id")


CATALOG = [("big-enum", "item = enum, variants = 25..=50"), ("async-fn", "item = fn, is_async"), ("unsafe-thing", "any_of([is_unsafe, is_const])"), ("ring", 'name = matches("*ring*")')]
CATALOG_SQL = f"""SELECT id, class FROM (SELECT id, unnest([
  CASE WHEN kind = 'enum' AND p_size BETWEEN 25 AND 50 THEN 'big-enum' END, CASE WHEN kind = 'fn' AND p_size > 25 THEN 'async-fn' END,
  CASE WHEN (kind IN ('fn','impl','trait') AND p_size % 2 = 0) OR (kind = 'fn' AND p_size % 3 = 0) THEN 'unsafe-thing' END,
  CASE WHEN contains(p_name, 'ring') THEN 'ring' END]) AS class FROM {ITEMS_SQL}) WHERE class IS NOT NULL"""


@query(CATALOG_SQL)
def pattern_cross(spark, d):
    return P.match_catalog(part_items(spark, d), CATALOG).select("id", "class")


@query(f"SELECT class, count(*) AS sites, min(id) AS first_site FROM ({CATALOG_SQL}) WHERE id % 10 <> 0 GROUP BY class")
def matches_by_class(spark, d):
    """Flagship: patterns over items, suppression of tolerated sites, sites of each class."""
    found = P.match_catalog(part_items(spark, d), CATALOG).select("id", "class")
    tolerated = table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id"))
    return J.anti(found, tolerated, [("id", "id")]).groupBy("class").agg(F.count("*").alias("sites"), F.min("id").alias("first_site"))


def _events(spark, d, kind: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    path = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("crate"), (F.col("user_id") % 7).cast("string")))
    none = F.lit(None).cast("string")
    target = F.struct(F.lit("fn").alias("kind"), F.col("user_id").cast("string").alias("a"), none.alias("b"), none.alias("c"))
    return e.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("class"), path.alias("canonical_path"), F.lit("f").alias("file"), F.lit("explicit").alias("match_kind"), target.alias("target"))


@query("""WITH e AS (SELECT event_id, event_type, 'c' || (user_id % 50) AS class, CASE WHEN user_id % 7 <> 0 THEN 'crate' || (user_id % 7) END AS path, user_id FROM events)
SELECT event_id, class, EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.class = s.class AND v.path IS NOT DISTINCT FROM s.path) AS class_known FROM e s WHERE event_type = 'error'
 AND NOT EXISTS (SELECT 1 FROM e i WHERE i.event_type = 'purchase' AND i.user_id % 3 = 0 AND i.class = s.class AND i.path IS NOT DISTINCT FROM s.path AND i.user_id = s.user_id)
 AND NOT EXISTS (SELECT 1 FROM e i WHERE i.event_type = 'signup' AND i.event_id % 41 = 0 AND i.class = s.class AND i.path IS NOT DISTINCT FROM s.path)""")
def unaddressed_sites(spark, d):
    sites, none = _events(spark, d, "error"), _events(spark, d, "no such event")
    defenses = _events(spark, d, "signup").where("event_id % 41 = 0")
    classes = _events(spark, d, "view").select(F.col("class").alias("type_name"), "canonical_path").distinct()
    return J.unaddressed(sites, _events(spark, d, "purchase").where(F.col("target.a").cast("long") % 3 == 0), none, defenses, classes).select("event_id", "class", "class_known")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def orphan_edges(spark, d):
    closed = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return J.anti(table(spark, d, "customer"), closed, [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT s_suppkey AS member FROM supplier WHERE s_suppkey % 3 <> 0")
def unscanned_members(spark, d):
    key = F.col("s_suppkey")
    return J.unscanned(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(key).alias("enumerated"), F.collect_list(F.when(key % 3 == 0, key)).alias("scanned")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) OR l_linenumber % 2 = 1")
def orphaned_lineage(spark, d):
    """Name and path of the parent must meet one and the same declaration."""
    path = F.when(F.col("l_linenumber") % 2 == 1, "elsewhere")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("parent"), path.alias("parent_path"))
    classes = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("type_name"), F.lit(None).cast("string").alias("canonical_path"))
    return J.orphaned_lineage(edges, classes).select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT p_partkey AS name, p_size AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.v IS DISTINCT FROM b.v""")
def structural_diff(spark, d):
    part = table(spark, d, "part")
    before = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("structural_digest"))
    after = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("structural_digest"))
    return J.structural_diff(before, after)


@query("""WITH p AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1), u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM p GROUP BY l_partkey)
SELECT p_partkey, CASE WHEN u.n = 1 THEN 'm' || u.s ELSE 'none' END AS canonical_path FROM part LEFT JOIN u ON p_partkey = l_partkey""")
def rekey_members(spark, d):
    classes = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("type_name"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("canonical_path"))
    edges = table(spark, d, "part").select("p_partkey", F.lit("none").alias("canonical_path"))
    return J.rekey(edges, classes, "p_partkey", "canonical_path")[0].select("p_partkey", "canonical_path")


@query("""SELECT l_partkey AS child, l_suppkey AS parent, count(*) AS declared FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_edges(spark, d):
    none = F.lit(None).cast("string")
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), none.alias("child_path"), none.alias("parent_path"), F.lit("f").alias("file"), F.col("l_orderkey").alias("line"))
    return A.duplicate_edges(edges)[1].select("child", "parent", "declared")


@query("""SELECT l_returnflag AS class, count(*) AS sites, count(*) FILTER (WHERE l_linestatus = 'F') AS resolving, CASE WHEN bool_or(l_linestatus = 'F') THEN 'execution' ELSE 'none' END AS max_tier, NOT bool_or(l_linestatus = 'F') AS undefended FROM lineitem GROUP BY 1""")
def defended_status(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.when(F.col("l_linestatus") == "F", "execution").otherwise("none").alias("tier"))
    return A.defended_status(rows)


@query("""WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity > 2 END AS ok FROM lineitem)
SELECT l_suppkey, CASE WHEN bool_or(NOT ok) THEN false WHEN count(*) > count(ok) THEN NULL ELSE true END AS all_ok, CASE WHEN bool_or(ok) THEN true WHEN count(*) > count(ok) THEN NULL ELSE false END AS any_ok FROM v GROUP BY 1""")
def kleene_fold(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ok", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 2))
    return rows.groupBy("l_suppkey").agg(Kl.fold_and(F.col("ok")).alias("all_ok"), Kl.fold_or(F.col("ok")).alias("any_ok"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'none' WHEN o_orderkey % 17 = 0 THEN 'unparsable' WHEN CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' THEN 'within' ELSE 'past' END AS state FROM orders""")
def frame_state(spark, d):
    o = table(spark, d, "orders")
    frame = F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 17 == 0, "soon").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", S.frame_state(frame, F.lit(AS_OF).cast("date")).alias("state"))


_KINDS = "CASE o_orderkey % 4 WHEN 0 THEN 'anergy' WHEN 1 THEN 'immunosuppress' WHEN 2 THEN 'poxparty' ELSE 'orient' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_KINDS} AS kind, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 60 AS until, o_orderkey % 13 = 0 OR o_orderkey % 19 = 0 AS none, o_orderkey % 17 = 0 AS bad,
o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 AS capped, o_orderkey % 2000 AS cap FROM orders),
h AS (SELECT o_orderkey, CASE WHEN kind = 'immunosuppress' AND capped AND date_diff('day', d, DATE '{AS_OF}') > cap THEN 'immunosuppress-duration-cap-exceeded' WHEN none OR (NOT bad AND until >= DATE '{AS_OF}') THEN kind || '-active'
WHEN kind = 'anergy' THEN CASE WHEN NOT bad AND date_diff('day', until, DATE '{AS_OF}') > 30 THEN 'anergy-stale' ELSE 'anergy-costimulation-not-arrived' END
WHEN kind = 'immunosuppress' THEN 'immunosuppress-expired' WHEN kind = 'poxparty' THEN 'poxparty-outcome-pending' ELSE 'orient-pending-action-required' END AS hint FROM r)
SELECT o_orderkey, hint, CASE WHEN hint LIKE '%-active' THEN 'active' WHEN hint IN ('anergy-stale', 'immunosuppress-duration-cap-exceeded') THEN 'stale' ELSE 'expired' END AS state FROM h""")
def deferred_state(spark, d):
    """All kinds, with dates that are missing, empty, malformed, past and to come, and caps with and without a start."""
    key, day = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd")
    until = F.when(key % 13 == 0, None).when(key % 19 == 0, "").when(key % 17 == 0, "soon").otherwise(day(F.date_add(F.to_date("o_orderdate"), 60)))
    since = F.when(key % 7 == 0, None).when(key % 11 == 0, "1998/01/01").otherwise(day("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_KINDS).alias("kind"), until.alias("until"), since.alias("since"), F.when(key % 5 != 0, key % 2000).alias("duration_cap"))
    return U.audit_deferred(rows, F.lit(AS_OF).cast("date")).select("o_orderkey", "hint", "state")


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN coalesce(bool_or(l_returnflag = 'R' AND l_linenumber % 2 = 1 AND l_linestatus = 'F' AND l_quantity > 25), false) END AS signed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def signers_same_row(spark, d):
    """Name, role, currency and strength must hold in one and the same signer row; without a document nothing is decided."""
    signer = F.struct(F.col("l_returnflag").alias("name"), F.when(F.col("l_linenumber") % 2 == 1, "steward").otherwise("guest").alias("role"), F.col("l_linestatus").alias("against"), F.when(F.col("l_quantity") > 25, "gpg").otherwise("ssh").alias("strength"))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(signer).alias("signers"))
    rows = table(spark, d, "orders").join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("current_digest", F.lit("F"))
    wanted = {"signers": {"required": ["R"], "roles": {"R": "steward"}, "against": "current", "signature_allow": ["gpg"]}}
    return rows.select("o_orderkey", Pr.compile_predicate(wanted, F.lit(AS_OF).cast("date")).alias("signed"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS n, min(l_returnflag) AS flag, max(l_quantity) AS q, min(l_linestatus) AS status FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2),
f AS (SELECT l_orderkey AS o_orderkey, n, CASE WHEN flag = 'A' OR (flag = 'R' AND q > 25) THEN 'no' WHEN q > 45 THEN 'unread' WHEN status = 'F' THEN 'ok' ELSE 'no' END AS s FROM l),
w AS (SELECT o_orderkey, coalesce(max(s) FILTER (WHERE n = 1), 'unread') AS a, coalesce(max(s) FILTER (WHERE n = 2), 'unread') AS b FROM orders LEFT JOIN f USING (o_orderkey) GROUP BY 1)
SELECT o_orderkey, CASE CASE WHEN a <> 'ok' THEN a ELSE b END WHEN 'ok' THEN true WHEN 'no' THEN false END AS complete FROM w""")
def oracles_complete(spark, d):
    """Two files for each order: an entry blocks as a draft or as revoked and invalidating, else the file's own status decides."""
    path = F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))
    state = F.when(F.col("flag") == "A", "draft").when(F.col("flag") == "R", "revoked").otherwise("deprecated")
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"), F.min("l_linestatus").alias("status"))
    entry = F.struct(path.alias("path"), state.alias("state"), (F.col("q") > 25).alias("invalidates"))
    status = F.struct(path, F.when(F.col("status") == "F", "complete").otherwise("open"))
    docs = lines.groupBy("l_orderkey").agg(F.collect_list(entry).alias("oracles"), F.map_from_entries(F.collect_list(F.when(F.col("q") <= 45, status))).alias("oracle_files"))
    rows = table(spark, d, "orders").join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", Pr.compile_predicate({"oracles_complete": {"files": ["p1", "p2"]}}, F.lit(AS_OF).cast("date")).alias("complete"))


@query("""WITH t AS (SELECT conv_id, role, text, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(turn % 7) OVER (PARTITION BY conv_id ORDER BY turn) AS day FROM conversations),
e AS (SELECT conv_id, unnest([CASE WHEN role = 'system' THEN 'author is no steward' END, CASE WHEN day > turn % 7 THEN 'dates go back' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'transition without rationale' END,
CASE WHEN CASE WHEN turn % 5 = 4 THEN 'retired' ELSE coalesce(before, 'draft') END <> coalesce(before, 'draft') THEN 'wrong from' END]) AS what FROM t)
SELECT conv_id, coalesce(string_agg(DISTINCT what, ',' ORDER BY what), '') AS errors FROM e GROUP BY 1""")
def oracle_transitions(spark, d):
    """A conversation as the life of an oracle, its turns as transitions: who made them, why, when, and from which state."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("draft"))
    turns = table(spark, d, "conversations").withColumn("from", F.when(F.col("turn") % 5 == 4, "retired").otherwise(before))
    step = F.struct("turn", "from", F.col("role").alias("to"), F.col("role").alias("by"), F.date_add(F.lit(AS_OF).cast("date"), (F.col("turn") % 7).cast("int")).alias("at"), F.col("text").alias("rationale"))
    steward = lambda name: F.struct(F.lit(name).alias("name"), F.lit("owner").alias("basis"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("transitions")).withColumn("stewards", F.array(steward("user"), steward("assistant")))
    return Pr.oracle_errors(rows, "conv_id").select("conv_id", F.array_join("errors", ",").alias("errors"))


TREE_SQL = """WITH RECURSIVE up(src, dst, depth) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT src, dst // 2, depth + 1 FROM up WHERE dst > 0)"""


@query(TREE_SQL + " SELECT src, dst, depth FROM up")
def lineage_closure(spark, d):
    edges = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    return G.closure(edges).select("src", "dst", F.col("depth"))


@query(TREE_SQL + """, s AS (SELECT p_partkey AS site FROM part WHERE p_size < 5)
SELECT class, site, string_agg(src, ',' ORDER BY src) AS inherited_from, bool_or(own) AS explicit FROM (SELECT site AS class, site, NULL AS src, true AS own FROM s UNION ALL SELECT u.src, s.site, CAST(u.dst AS VARCHAR), false FROM up u JOIN s ON u.dst = s.site) GROUP BY 1, 2""")
def inherit_sites(spark, d):
    part = table(spark, d, "part")
    classes = part.select(F.col("p_partkey").cast("string").alias("type_name"))
    lineage = part.where("p_partkey > 0").select(F.col("p_partkey").cast("string").alias("child"), F.floor(F.col("p_partkey") / 2).cast("string").alias("parent"))
    sites = part.where("p_size < 5").select(F.col("p_partkey").cast("string").alias("class"), F.lit("f").alias("file"), F.col("p_partkey").alias("line"))
    out = G.inherit_sites(sites, lineage, classes)
    text = F.array_join("inherited_from", ",")
    return out.select(F.col("class").cast("long").alias("class"), F.col("line").alias("site"), F.when(text != "", text).alias("inherited_from"), "explicit")


def _ring(spark, d) -> DataFrame:
    """Each supplier with one successor: chains that run into rings."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("src"), ((key * key + 1) % 97).alias("dst"))


_RING = "SELECT DISTINCT s_suppkey AS src, (s_suppkey * s_suppkey + 1) % 97 AS dst FROM supplier"


@query(f"""WITH RECURSIVE e AS ({_RING}), w(first, here, cycle, n) AS (SELECT src, dst, CAST(src AS VARCHAR), 1 FROM e UNION ALL SELECT first, e.dst, cycle || ',' || here, n + 1 FROM w JOIN e ON here = e.src WHERE here > first AND n < 97) SELECT cycle FROM w WHERE here = first""")
def cycle_detect(spark, d):
    return G.cycles(_ring(spark, d)).select(F.array_join(F.col("cycle").cast("array<string>"), ",").alias("cycle"))


@query(f"""WITH RECURSIVE e AS ({_RING}), w(src, dst) AS (SELECT * FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT src, dst FROM w""")
def closure_cyclic(spark, d):
    return G.closure(_ring(spark, d)).select("src", "dst")


@query("""WITH f AS (SELECT o_orderpriority AS cluster_key, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS sev FROM orders)
SELECT cluster_key, CASE max(sev) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS size FROM f GROUP BY 1 ORDER BY max(sev) DESC, count(*) DESC, 1 LIMIT 10""")
def session_prime(spark, d):
    o = table(spark, d, "orders")
    sev = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    rows = o.select(F.col("o_orderpriority").alias("cluster_key"), sev.alias("severity"), F.lit("constructable").alias("class_provenance"), F.lit("f").alias("file"), F.col("o_orderkey").alias("line"), F.struct(F.lit("fingerprint_match").alias("kind")).alias("body"))
    return A.session_clusters(rows).select("cluster_key", "severity", "size")


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def top_sites_per_cluster(spark, d):
    return A.top_per_group(table(spark, d, "documents"), "lang", [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS verdict FROM orders")
def board_ordered(spark, d):
    v = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "O", "pending").otherwise("overdue")
    return A.board(table(spark, d, "orders").select("o_orderkey", v.alias("verdict")), "o_orderkey")


@query("""SELECT p_partkey, printf('%016x', list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(p_name[i]) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT) AS digest FROM part""")
def digest_fnv(spark, d):
    return table(spark, d, "part").select("p_partkey", S.fnv1a64(F.col("p_name")).alias("digest"))


@query("SELECT shape, sites, min_doc FROM (SELECT md5(text) AS shape, count(DISTINCT doc_id) AS sites, min(doc_id) AS min_doc FROM documents GROUP BY 1) WHERE sites >= 2")
def digest_cluster(spark, d):
    marks = table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("shape_digest"), F.lit("f").alias("file"), F.col("doc_id").alias("line"))
    return A.shape_clusters(marks).select(F.col("shape_digest").alias("shape"), "sites", F.col("first.line").alias("min_doc"))


_DAILY = "SELECT event_type AS class, CAST(ts AS DATE) AS day, avg(value) / 1000.0 AS v FROM events GROUP BY 1, 2"


@query(f"""WITH s AS ({_DAILY}), w AS (SELECT class, day, count(*) OVER p AS cut, avg(v) OVER p AS m0, count(*) OVER f AS n1, avg(v) OVER f AS m1 FROM s WINDOW p AS (PARTITION BY class ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY class ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
e AS (SELECT class, cut, cut + n1 AS n, abs(m0 - m1) AS difference, sqrt(ln(4.0 * (cut + n1) / 0.025) / (2.0 * (1.0 / (1.0 / cut + 1.0 / n1)))) AS eps FROM w WHERE n1 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY difference - eps DESC, cut) AS k FROM e) SELECT class, cut, n, round(difference, 9) AS difference, round(eps, 9) AS eps, difference >= eps AS drifted FROM r WHERE k = 1""")
def adwin_split(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("class"), F.to_date("ts").alias("day")).agg((F.avg("value") / 1000.0).alias("v"))
    return A.best_split(s, "class", "day", "v", 0.025).select("class", "cut", "n", F.round("difference", 9).alias("difference"), F.round("eps", 9).alias("eps"), "drifted")


@query("""WITH e AS (SELECT user_id, count(*) AS n, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b FROM events GROUP BY 1) SELECT user_id AS class, CASE WHEN b = a THEN 'steady' WHEN b > a THEN 'improving' ELSE 'worsening' END AS direction FROM e WHERE n >= 2""")
def trajectory_direction(spark, d):
    scores = table(spark, d, "events").select(F.col("user_id").alias("class"), F.col("event_id").alias("seq"), F.col("value").alias("recall"), F.lit(0.5).alias("precision"))
    return A.trajectory(scores)


def _commits(spark, d) -> DataFrame:
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    subject = F.concat(F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "Fixes crash ").otherwise("prefix "), F.col("text"))
    return table(spark, d, "conversations").select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), subject.alias("subject"), (F.col("role") == "system").alias("cosmetic_only"))


@query("""SELECT DISTINCT conv_id || '-' || (turn - 1) AS defect, conv_id || '-' || turn AS fix, '' AS path FROM conversations WHERE ((conv_id + turn) % 3 = 0 OR regexp_matches(text, '(?i)(^|[^a-z0-9_])(fix|fixes|fixed|fixing|bug|bugfix|defect|regression|patch|hotfix)([^a-z0-9_]|$)|#[0-9]')) AND role <> 'system' AND turn > 0""")
def szz_pairs(spark, d):
    return M.mine_first_parent(_commits(spark, d))


@query("""WITH j AS (SELECT quality, contains(text, '$$$') AS hit FROM documents JOIN labels USING (doc_id)) SELECT CAST(count(*) FILTER (WHERE quality = 0 AND hit) AS DOUBLE) / count(*) FILTER (WHERE quality = 0) AS recall, CAST(count(*) FILTER (WHERE quality = 1 AND NOT hit) AS DOUBLE) / count(*) FILTER (WHERE quality = 1) AS precision FROM j""")
def precision_recall(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("doc", F.col("text"))
    return A.measure(j.where("quality = 0"), j.where("quality = 1"), P.compile_pattern('doc_contains("$$$")'))


@query(f"""WITH i AS (SELECT id, kind = 'enum' AS a, kind = 'enum' AND p_size BETWEEN 5 AND 20 AS b, contains(p_type, 'STEEL') OR contains(p_name, 'blue') AS c FROM {ITEMS_SQL}) SELECT id FROM i WHERE NOT (a AND b AND c) AND ((b AND c) OR (a AND c) OR (a AND b))""")
def near_miss(spark, d):
    p = P.parse('all_of([item = enum, variants = 5..=20, any_of([doc_contains("STEEL"), doc_contains("blue")])])')
    items = part_items(spark, d).withColumn("doc", F.when(F.contains(F.element_at(F.split("doc", "\n"), 2), F.lit("STEEL")), F.concat(F.col("name"), F.lit(" STEEL"))).otherwise(F.col("name")))
    return items.where(L.near_miss(p)).select("id")


@query("""WITH m AS (SELECT DISTINCT lang, source, unnest(string_split(text, ' ')) AS signal FROM documents), t AS (SELECT lang, count(DISTINCT source) AS total FROM m GROUP BY 1) SELECT lang, signal, count(DISTINCT source) = any_value(total) AS shared FROM m JOIN t USING (lang) GROUP BY lang, signal HAVING count(DISTINCT source) >= 10""")
def anti_unify_signals(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("signal")).distinct()
    total = rows.groupBy("lang").agg(F.count_distinct("source").alias("total"))
    n = rows.groupBy("lang", "signal").agg(F.count_distinct("source").alias("n")).where("n >= 10")
    return n.join(total, "lang").select("lang", "signal", (F.col("n") == F.col("total")).alias("shared"))


@query("""WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 4 AS b FROM part) SELECT p_partkey, (a > 25 OR (a = 25 AND b >= 2)) AS at_least FROM v""")
def version_compare(spark, d):
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.version_at_least(version, F.lit("25.2")).alias("at_least"))


@query("SELECT string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS failing, count(*) = 0 AS pinned FROM part WHERE p_size > 48 AND p_size % 2 = 1")
def pin_check(spark, d):
    deps = table(spark, d, "part").where("p_size > 48").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 1, "1.0").otherwise("=1.0").alias("version"))
    return U.dep_pinned(deps).select(F.array_join("failing", ",").alias("failing"), "pinned")


@query("SELECT page_id, CASE WHEN contains(url, '?') THEN CASE WHEN page_id % 3 = 0 THEN 'empty' ELSE 'present' END ELSE 'absent' END AS state FROM pages")
def trailer_parse(spark, d):
    trailer = F.when(F.contains("url", F.lit("?")), F.array(F.when(F.col("page_id") % 3 == 0, "Reviewed-By:").otherwise("reviewed-by: x"))).otherwise(F.array(F.lit("Other: y")))
    return table(spark, d, "pages").select("page_id", U.trailer_state(trailer, "Reviewed-By").alias("state"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 20 AS src, l_partkey % 20 AS dst FROM lineitem), w(start, node) AS (SELECT s, s FROM (VALUES (0), (1), (2)) t(s) UNION SELECT w.start, e.dst FROM w JOIN e ON w.node = e.src) SELECT start, count(*) - 1 AS reach FROM w GROUP BY 1 HAVING count(*) > 1""")
def blast_radius(spark, d):
    edges = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.lit("calls").alias("kind")).distinct()
    return G.blast_from(edges, spark.range(3).select(F.col("id").alias("node"))).select("start", "reach")


@query("SELECT CASE WHEN l_linenumber = 1 THEN 'explicit' ELSE 'fingerprint' END AS match_kind, count(*) AS gaps FROM lineitem GROUP BY 1")
def partition_gaps(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, "explicit").otherwise("fingerprint").alias("match_kind"))
    return A.merge_reports(*J.partition_gaps(rows)).groupBy("match_kind").agg(F.count("*").alias("gaps"))


def _tagged(spark, d, column: str = "o_custkey") -> DataFrame:
    o = table(spark, d, "orders")
    path = F.when(F.col(column) % 3 != 0, F.concat(F.lit("m"), (F.col(column) % 3).cast("string")))
    return o.select("o_orderkey", F.concat(F.lit("c"), (F.col(column) % 100).cast("string")).alias("class"), path.alias("canonical_path"))


@query("""WITH t AS (SELECT o_orderkey, 'c' || (o_custkey % 100) AS class, CASE WHEN o_custkey % 3 <> 0 THEN 'm' || (o_custkey % 3) END AS path FROM orders)
SELECT o_orderkey FROM t WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'c' || c_custkey AS class, CASE WHEN c_custkey % 3 <> 0 THEN 'm' || (c_custkey % 3) END AS path FROM customer WHERE c_custkey < 90) k WHERE k.class = t.class AND k.path IS NOT DISTINCT FROM t.path)""")
def orphaned_tolerances(spark, d):
    path = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")))
    classes = table(spark, d, "customer").where("c_custkey < 90").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("type_name"), path.alias("canonical_path"))
    return J.orphaned_tolerances(_tagged(spark, d), classes).select("o_orderkey")


@query("SELECT DISTINCT l_suppkey AS child FROM lineitem WHERE l_linenumber = 7 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def dangling_child(spark, d):
    none = F.lit(None).cast("string")
    edges = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("child"), none.alias("child_path"))
    classes = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("type_name"), none.alias("canonical_path"))
    return J.dangling_children(edges, classes).select("child").distinct()


@query("""WITH h AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS files, list(DISTINCT s_suppkey % 3) AS kinds FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN h.k IS NULL THEN 'missing' WHEN files > 1 THEN 'ambiguous' WHEN NOT list_contains(kinds, c_custkey % 3) THEN 'kind_mismatch' ELSE 'resolved' END AS resolution FROM customer LEFT JOIN h ON c_nationkey = k""")
def delegate_resolution(spark, d):
    handlers = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").cast("string").alias("name"), F.col("s_suppkey").cast("string").alias("file"), (F.col("s_suppkey") % 3).alias("boundary_kind"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("a::"), F.col("c_nationkey").cast("string")).alias("handled_by"), (F.col("c_custkey") % 3).alias("boundary_kind"))
    return J.resolve_delegates(rows, handlers).select("c_custkey", "resolution")


@query("SELECT p_brand AS file, p_partkey AS line, p_type AS class, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ts FROM part WHERE p_partkey % 2 = 0 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
def catalog_match(spark, d):
    part = table(spark, d, "part")
    sites = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_type").alias("class"), F.when(F.col("p_partkey") % 2 == 0, "fingerprint").otherwise("explicit").alias("match_kind"))
    known = spark.createDataFrame([(c, "constructable") for c in ("ECONOMY", "STANDARD", "PROMO")], "class string, provenance string")
    return J.catalog_findings(sites, known).select("file", "line", "class", F.col("ts").cast("long").alias("ts"))


@query("""SELECT DISTINCT l_suppkey AS class, p_brand AS file, p_partkey AS line FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_quantity > 45 AND NOT (p_partkey % 5 = 0 AND l_suppkey % 2 = 0)""")
def generates_join(spark, d):
    li = table(spark, d, "lineitem")
    generators = li.where("l_linenumber = 1 and l_quantity > 45").select(F.col("l_suppkey").alias("class"), F.col("l_partkey").alias("macro_name"))
    calls = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_partkey").alias("macro_name"))
    existing = J.generated_sites(calls, generators, calls.where("false").withColumn("class", F.lit(0).cast("long"))).where("line % 5 = 0 and class % 2 = 0")
    return J.generated_sites(calls, generators, existing).select("class", "file", "line")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P FROM orders")
def count_by_verdict(spark, d):
    return A.count_by(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_custkey, coalesce(bool_and(o_totalprice > 1000), true) AS all_valid, coalesce(bool_or(o_orderstatus = 'P'), false) AS any_pending FROM orders GROUP BY 1")
def all_any(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(A.for_all(F.col("o_totalprice") > 1000).alias("all_valid"), A.for_any(F.col("o_orderstatus") == "P").alias("any_pending"))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS total")
def total_declarations(spark, d):
    return A.total_declarations(*(table(spark, d, n).select(F.lit(1).alias("x")) for n in ("orders", "customer", "part", "supplier")))


@query("""WITH f AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 ELSE c_custkey % 40 END AS k, count(*) AS n FROM customer GROUP BY 1),
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_linenumber IN (2, 5) THEN 'external' WHEN l_linenumber = 3 THEN 'phantom' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM lineitem LEFT JOIN f ON l_suppkey = k)
SELECT *, CASE WHEN status IN ('missing', 'not_found') THEN 'none' WHEN status = 'phantom' THEN 'formal_proof' ELSE 'reachability' END AS tier FROM s""")
def audit_witness(spark, d):
    """Witnesses as token text has them: blank, two ways to name a tool, a type with arguments, one with nested ones, a tool that is not known, a path."""
    name, n = F.concat(F.lit("f"), F.col("l_suppkey").cast("string")), F.col("l_linenumber")
    witness = F.when(n == 1, "  ").when(n == 2, "Clippy :: lint").when(n == 3, "Proof :: < X >::new()").when(n == 4, F.concat(F.lit("P::<Option<X>>::"), name)).when(n == 5, "proofs::kani_proof_of_it").when(n == 6, F.concat(F.lit("cargo::"), name)).otherwise(F.concat(F.lit("tests :: "), name, F.lit("()")))
    key = F.col("c_custkey")
    functions = table(spark, d, "customer").select(F.concat(F.lit("f"), F.when(key % 3 == 0, key * 2).otherwise(key % 40).cast("string")).alias("name"), F.lit("a").alias("file"), F.lit("fn").alias("kind"))
    return U.audit_witness(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", witness.alias("witness")), functions).select("l_orderkey", "l_linenumber", "status", "tier")


@query("""WITH e AS (SELECT o_orderkey, count(DISTINCT l_returnflag) AS n, count(l_returnflag) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, concat_ws(',', CASE WHEN n < 2 THEN 'modalities_collapse' END, CASE WHEN m > n THEN 'modality_repeated' END) AS hints FROM e""")
def audit_convergent(spark, d):
    seen = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("modalities"))
    rows = table(spark, d, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("kind", F.lit("diagnostic")).withColumn("min_independent", F.lit(2))
    for c, t in (("iterations", "long"), ("historical_span", "long"), ("min_reattestations", "long"), ("seed_kind", "string"), ("witnesses", "array<string>"), ("fingerprints", "array<string>")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    return U.audit_convergent(rows).select("o_orderkey", F.array_join("hints", ",").alias("hints"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'out_of_frame' WHEN s_suppkey IS NOT NULL THEN 'fulfilled' WHEN CAST(o_orderdate AS DATE) < DATE '{AS_OF}' THEN 'overdue' ELSE 'pending' END AS verdict FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""")
def audit_prescriptive(spark, d):
    o = table(spark, d, "orders")
    frame = F.when(F.col("o_orderkey") % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    item = lambda c: F.concat(F.lit("m"), c.cast("string"), F.lit("::f"))
    rows = o.select("o_orderkey", F.lit("panel").alias("kind"), F.array(item(F.col("o_custkey"))).alias("items"), F.lit(None).cast("array<string>").alias("filled_by"), F.lit(None).cast("array<string>").alias("reviewed_by"), F.lit(None).cast("string").alias("ordered_by"), frame.alias("frame"))
    labels = table(spark, d, "supplier").select(F.array(F.concat(F.lit("x::"), item(F.col("s_suppkey"))), F.lit("g")).alias("labels"))
    return U.audit_prescriptive(rows, labels, F.lit(AS_OF).cast("date")).select("o_orderkey", "verdict")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'no_record' WHEN p_partkey % 3 = 0 THEN 'malformed' WHEN p_partkey % 5 = 0 THEN 'absent_in_lock' WHEN p_partkey % 11 = 0 THEN 'mismatch' ELSE 'matches' END AS state FROM part""")
def content_hash(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"), F.lit("1").alias("version"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    lock = part.where("p_partkey % 5 <> 0").select("name", "version", sha(F.col("name")).alias("checksum"))
    recorded = F.when(F.col("p_partkey") % 3 == 0, None).when(F.col("p_partkey") % 11 == 0, sha(F.concat("name", F.lit("x")))).otherwise(sha(F.col("name")))
    return U.content_hash(part, lock, part.where("p_partkey % 7 <> 0").select("name", "version", recorded.alias("checksum"))).select("p_partkey", "state")


@query("""WITH r AS (SELECT l_partkey AS k, bool_or(l_suppkey % 10 = 0) AS exact FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT p_partkey, CASE WHEN k IS NULL THEN 'missing' WHEN exact THEN 'ok' ELSE 'stale' END AS state FROM part LEFT JOIN r ON p_partkey = k""")
def dep_attested(spark, d):
    records = table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_suppkey") % 10 == 0, "1").otherwise("0").alias("version"), F.lit("review.md").alias("artifact"), F.lit(True).alias("valid")).distinct()
    wanted = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"), F.lit("1").alias("version"))
    return U.dep_attested(wanted, records).select("p_partkey", "state")


@query("SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN 'high' WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'low' END AS severity, 'mark@' || (doc_id % 7) AS cluster_key FROM labels")
def finding_from_mark(spark, d):
    marks = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "sure").otherwise("unsure").alias("certainty"), F.when(F.col("toxic") == 1, "dread").when(F.col("doc_id") % 2 == 0, "aura").otherwise("smell").alias("magnitude"), F.lit("mark").alias("marker"), (F.col("doc_id") % 7).cast("string").alias("shape_digest"))
    return U.finding_from_mark(marks).select("doc_id", "severity", "cluster_key")


@query("""WITH t AS (SELECT event_id, value, event_type FROM events ORDER BY event_id DESC LIMIT 500) SELECT 'crate' || (event_id % 9) AS path, count(*) AS touches FROM t GROUP BY 1""")
def recurrence_counts(spark, d):
    commits = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), F.array(F.concat(F.lit("crate"), (F.col("event_id") % 9).cast("string"))).alias("files"))
    paths = spark.range(9).select(F.concat(F.lit("crate"), F.col("id").cast("string")).alias("path"))
    return M.recurrence_counts(commits, paths, 500)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'evading' WHEN quality = 1 THEN 'dormant' WHEN toxic = 1 THEN 'obsolete' ELSE 'indeterminate' END AS silent,
CASE WHEN doc_id % 2 = 0 THEN 'rearm' WHEN quality = 1 THEN 'hold' WHEN toxic = 1 THEN 'forget' ELSE 'human' END AS action FROM labels""")
def curation(spark, d):
    silent = L.silent_status(F.col("doc_id") % 2 == 0, F.col("quality") == 1, F.col("toxic") == 1)
    rows = table(spark, d, "labels").withColumn("silent", silent)
    verdict = L.classify(F.col("silent"), F.lit(False), F.lit("no_drift"), F.lit("recall"))
    return rows.select("doc_id", "silent", L.curate(verdict, F.lit(False)).alias("action"))


@query("""SELECT s_suppkey, CASE WHEN a > 0 AND b > 0 THEN CASE greatest(a, b) WHEN 2 THEN 'verified' ELSE 'resolved' END END AS tier FROM (SELECT s_suppkey, s_suppkey % 3 AS a, s_nationkey % 3 AS b FROM supplier)""")
def tier_corroborate(spark, d):
    tier = lambda c: S.from_rank((c % 3).cast("int"), G.NODE_TIERS)
    return table(spark, d, "supplier").select("s_suppkey", G.corroborate(tier(F.col("s_suppkey")), tier(F.col("s_nationkey"))).alias("tier"))


@query("""SELECT l_partkey AS fq_path, l_returnflag AS identity_digest, max(l_orderkey) AS revision FROM lineitem GROUP BY 1, 2""")
def node_lowering(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("fq_path"), F.col("l_returnflag").alias("identity_digest"), F.lit("").alias("cfg_set"), F.lit("syntactic").alias("tier"), F.lit("fn").alias("kind"), F.col("l_orderkey").alias("revision"))
    return G.lower_nodes(rows.where("fq_path % 2 = 0"), rows.where("fq_path % 2 = 1")).select("fq_path", "identity_digest", "revision")


@query("SELECT src AS child, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS ancestors FROM (" + TREE_SQL + " SELECT src, dst FROM up WHERE dst % 2 = 1) GROUP BY 1")
def recurrence_ancestors(spark, d):
    edges = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    rows = G.closure(edges).where("dst % 2 = 1").groupBy(F.col("src").alias("child"))
    return rows.agg(F.array_join(A.union_distinct(F.array(F.col("dst").cast("string"))), ",").alias("ancestors"))


_FLYCHECK = """WITH t AS (SELECT doc_id, 'C' || quality AS c, 'factlens: structure matches the `C' || quality || '` failure-class fingerprint (provenance: '
|| CASE doc_id % 4 WHEN 0 THEN 'encountered (seen in real code)' WHEN 1 THEN 'constructable (a verified minimal case exists)' WHEN 2 THEN 'heuristic (correlational)' ELSE 'imagined (reasoned, no demo yet)' END
|| '). This is a fingerprint match to inspect, not an audited verdict.' AS m FROM labels WHERE toxic = 0)
SELECT doc_id, '{"reason":"compiler-message","message":{"message":"' || m || '","level":"warning","code":{"code":"factlens::' || c || '","explanation":null},"spans":[{"file_name":"f","line_start":' || doc_id || ',"line_end":' || doc_id
|| ',"column_start":1,"column_end":1,"is_primary":true}],"children":[{"message":"fingerprint match only — factlens has not audited a defense for this site. Mark it with #[presents(' || c || ')] + #[defended_by(...)] to record the defense, or #[factlens_tolerance('
|| c || ', rationale=...)] to accept it.","level":"note","code":null,"spans":[],"children":[],"rendered":null}],"rendered":"warning: ' || m || '"}}' AS value FROM t"""


@query(_FLYCHECK)
def flycheck_jsonl(spark, d):
    """Matches of two classes and all provenances; findings of another kind give no line."""
    from .sources import files

    body = F.struct(F.when(F.col("toxic") == 0, "fingerprint_match").otherwise("marked_unknown").alias("kind"), F.concat(F.lit("C"), F.col("quality").cast("string")).alias("class"))
    provenance = F.element_at(F.array(*(F.lit(x) for x in files.PROVENANCE_LABELS)), (F.col("doc_id") % 4).cast("int") + 1)
    findings = table(spark, d, "labels").select(F.when(F.col("quality") == 0, "high").otherwise("low").alias("severity"), F.lit("f").alias("file"), F.col("doc_id").alias("line"), provenance.alias("class_provenance"), body.alias("body"))
    return files.flycheck_lines(findings).select(F.get_json_object("value", "$.message.spans[0].line_start").cast("long").alias("doc_id"), "value")


@query()
def adwin_axis(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("class"), F.to_date("ts").alias("day")).agg((F.avg("value") / 1000.0).alias("recall"))
    return L.adwin(s.select("class", F.unix_date("day").cast("long").alias("seq"), "recall", F.lit(0.9).alias("precision")))


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
