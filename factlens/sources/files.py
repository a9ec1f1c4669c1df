"""Sources and sinks: trees of files, manifests, lock files, sidecars, findings and report envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregates import forward_fill
from ..plans import pattern as P
from ..schema import RELATIONS, conform

SKIP = ["target", ".git", "node_modules"]


def scan_tree(spark: SparkSession, root: str, suffix: str = ".rs", skip: list[str] = SKIP) -> DataFrame:
    """file, text of the files below root with the suffix; directories to skip are left out at any depth.

    Unreadable files are passed over, as Spark is told to ignore missing or corrupt ones.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    inner = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/", "")
    rows = files.select(inner.alias("file"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, skip)))) if skip else rows


def scan_bundled(classes: DataFrame, only_if_empty: bool = True) -> DataFrame:
    """Declared classes with the built-in catalog: always, or only if the tree declares none."""
    spark = classes.sparkSession
    own = conform(classes, "classes")
    if only_if_empty and not classes.isEmpty():
        return own
    built_in = spark.createDataFrame([(n, n, p, v) for n, p, v in P.catalog()], "name string, type_name string, pattern string, provenance string")
    return own.unionByName(conform(built_in, "classes"))


def members(metadata: DataFrame) -> DataFrame:
    """name, manifest of workspace members, by name, from rows of packages and workspace_members."""
    package = metadata.select("workspace_members", F.explode("packages").alias("p"))
    return package.where(F.array_contains("workspace_members", F.col("p.id"))).select("p.name", "p.manifest_path").orderBy("name")


def dependency_origin(source):
    """path, registry, git or other, by the prefix of a dependency's source; none is a path."""
    return F.when(source.isNull(), "path").when(F.startswith(source, F.lit("registry+")), "registry").when(F.startswith(source, F.lit("git+")), "git").otherwise("other")


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("no", "line"))


def read_manifest(texts: DataFrame) -> DataFrame:
    """file, name, version, section of the dependencies in manifests (file, text).

    Both forms count: name = "1.0" or { version = "1.0" } in a section, and a section of its own for a dependency.
    """
    from ..functions import scalars as S

    head = r"^\s*\[([^\[\]]+)\]\s*$"
    rows = _lines(texts).withColumn("line", S.strip_comment(F.col("line")))
    rows = forward_fill(rows, "file", "no", F.when(F.col("line").rlike(head), F.trim(F.regexp_extract("line", head, 1))), "section")
    kinds = r"^(?:target\..*\.|workspace\.)?(dependencies|dev-dependencies|build-dependencies)"
    rows = rows.where(F.col("section").rlike(kinds + r"(?:\.|$)"))
    kind = F.regexp_extract("section", kinds, 1)
    own = F.regexp_extract("section", kinds + r"\.(.+)$", 2)
    unquoted = lambda c: F.regexp_replace(F.trim(c), "^\"|\"$", "")
    kv = S.key_value(F.col("line"))
    simple = rows.where((own == "") & kv.isNotNull())
    value = kv["value"]
    inner = F.regexp_extract(value, r'version\s*=\s*"([^"]*)"', 1)
    version = F.when(F.startswith(value, F.lit('"')), unquoted(value)).when(inner != "", inner)
    a = simple.select("file", F.substring_index(unquoted(kv["key"]), ".", 1).alias("name"), version.alias("version"), kind.alias("section"))
    b = rows.where(own != "").groupBy("file", own.alias("name"), kind.alias("section")).agg(F.max(F.when(kv["key"] == "version", unquoted(value))).alias("version"))
    return a.unionByName(b.select("file", "name", "version", "section"))


def read_lockfile(texts: DataFrame) -> DataFrame:
    """file, name, version, checksum of each [[package]] block, which a running count of block marks numbers."""
    from ..functions import scalars as S

    order = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(texts).withColumn("block", F.sum(F.when(F.trim("line") == "[[package]]", 1).otherwise(0)).over(order)).where("block > 0")
    kv = S.key_value(F.col("line"))
    field = lambda k: F.max(F.when(kv["key"] == k, F.regexp_replace(kv["value"], '^"|"$', ""))).alias(k)
    return rows.groupBy("file", "block").agg(field("name"), field("version"), field("checksum")).where("name is not null").drop("block")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Evidence documents (JSON); one that cannot be read has its text in _corrupt, and fields not there are null."""
    return spark.read.schema(RELATIONS["sidecars"] + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def with_sidecars(items: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Items with their document and document_state: missing, invalid or read."""
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_corrupt").isNotNull(), "invalid").otherwise("read")
    return items.join(sidecars.withColumn("_found", F.lit(True)), "item_path", "left").withColumn("document_state", state).drop("_found", "_corrupt")


# ---- sinks


def envelope(report: DataFrame, tool_version: str, revision: str | None, generated: str, schema_version: int = 1) -> DataFrame:
    """One row: the provenance of a report and how many rows it has; the rows themselves are written beside it."""
    return report.agg(F.count("*").alias("rows")).select(F.lit(schema_version).alias("schema_version"), F.lit(tool_version).alias("tool_version"), F.lit(revision).cast("string").alias("revision"), F.lit(generated).alias("generated"), "rows")


def write_report(report: DataFrame, path: str, **provenance) -> None:
    report.write.mode("overwrite").json(f"{path}/rows")
    envelope(report, **provenance).write.mode("overwrite").json(f"{path}/envelope")


#: How far a class is proven, as a message says it (fixed values).
PROVENANCE_LABELS = {"encountered": "encountered (seen in real code)", "constructable": "constructable (a verified minimal case exists)", "heuristic": "heuristic (correlational)", "imagined": "imagined (reasoned, no demo yet)"}


def flycheck_lines(findings: DataFrame, tool: str = "factlens") -> DataFrame:
    """value: a compiler-message JSON line for each pattern match; other findings give none.

    Always a warning, whatever the severity: a match is something to look at, not a verdict. The whole line is the span.
    The messages' wording and the order of fields are fixed values; the tool's name is a parameter.
    """
    class_, one = F.col("body.class"), F.lit(1)
    label = F.element_at(F.create_map(*(F.lit(x) for k, v in PROVENANCE_LABELS.items() for x in (k, v))), F.col("class_provenance"))
    text = F.format_string(f"{tool}: structure matches the `%s` failure-class fingerprint (provenance: %s). This is a fingerprint match to inspect, not an audited verdict.", class_, label)
    hint = F.format_string(f"fingerprint match only — {tool} has not audited a defense for this site. Mark it with #[presents(%1$s)] + #[defended_by(...)] to record the defense, or #[{tool}_tolerance(%1$s, rationale=...)] to accept it.", class_)
    none = F.lit(None).cast("string")
    code = F.struct(F.concat(F.lit(f"{tool}::"), class_).alias("code"), none.alias("explanation"))
    span = F.struct(F.col("file").alias("file_name"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), one.alias("column_start"), one.alias("column_end"), F.lit(True).alias("is_primary"))
    empty = F.array().cast("array<string>")
    note = F.struct(hint.alias("message"), F.lit("note").alias("level"), none.alias("code"), empty.alias("spans"), empty.alias("children"), none.alias("rendered"))
    message = F.struct(text.alias("message"), F.lit("warning").alias("level"), code.alias("code"), F.array(span).alias("spans"), F.array(note).alias("children"), F.concat(F.lit("warning: "), text).alias("rendered"))
    rows = findings.where("body.kind = 'fingerprint_match'")
    return rows.select(F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message")), {"ignoreNullFields": "false"}).alias("value"))


def strict_gate(counts: DataFrame) -> DataFrame:
    """failed: whether any count of a one-row table is above zero."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts.columns), F.lit(0))
    return counts.select((total > 0).alias("failed"))


def human(rows: DataFrame, template: str) -> DataFrame:
    """value: one text line for each row, by a printf template over all columns."""
    return rows.select(F.format_string(template, *rows.columns).alias("value"))


def append_signature(sidecars: DataFrame, signature: DataFrame) -> DataFrame:
    """Documents with a signer (item_path, signer) appended; a first one makes the document."""
    joined = sidecars.join(signature, "item_path", "full_outer")
    signers = F.concat(F.coalesce("signers", F.array().cast(sidecars.schema["signers"].dataType)), F.when(F.col("signer").isNull(), F.array().cast(sidecars.schema["signers"].dataType)).otherwise(F.array("signer").cast(sidecars.schema["signers"].dataType)))
    return joined.withColumn("signers", signers).drop("signer")
