"""Scalar functions as Spark columns: text, digests, versions, dates, numbers and enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- text


def glob_regex(pattern: str) -> str:
    """A glob as a whole-string regular expression: * any run, ? one character, all else literal."""
    special = set("\\.^$|()[]{}+*?-/&#~ ")
    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(c, "\\" + c if c in special else c) for c in pattern) + "\\z"


def glob_match(text: Column, pattern: str) -> Column:
    """Whole-string, case-sensitive glob match; ? stands for one byte, so for text beyond ASCII the match runs over bytes."""
    as_bytes = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    literal = pattern.encode().decode("latin-1")
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text.rlike(glob_regex(pattern))).otherwise(as_bytes.rlike(glob_regex(literal)))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def last_segment(path: Column, sep: str = "::") -> Column:
    return F.substring_index(path, sep, -1)


def type_base(name: Column) -> Column:
    """A type's name up to its generic arguments."""
    return F.trim(F.substring_index(name, "<", 1))


def quote_literal(text: Column) -> Column:
    """A quoted literal with backslash and quote escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def front_matter(text: Column, field: str) -> Column:
    """A field of the block between two --- lines at the start; null if absent."""
    block = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    value = F.trim(F.regexp_extract(block, rf"(?m)^{field}:[ \t]*(.*?)[ \t]*$", 1))
    value = F.regexp_replace(value, r"""^["']|["']$""", "")
    return F.when(value != "", value)


def strip_comment(line: Column) -> Column:
    """A line without its trailing # comment; a # inside double quotes stays."""
    return F.rtrim(F.regexp_extract(line, r'^((?:[^#"]|"[^"]*"?)*)', 1))


def key_value(line: Column) -> Column:
    """struct(key, value) around the first =, both trimmed; null without one."""
    at = F.instr(line, "=")
    return F.when(at > 0, F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("key"), F.trim(F.substring(line, at + 1, F.length(line))).alias("value")))


def is_package_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]+\z")


def is_version_text(version: Column) -> Column:
    return version.rlike(r"^[A-Za-z0-9.+_-]+\z")


#: Tools by the start of a witness, and names that count wherever they stand (fixed values).
TOOLS, TOOL_WORDS = ["clippy", "kani", "prusti", "creusot", "verus", "mutants"], ["clippy_", "kani_proof"]


def compact_path(text: Column) -> Column:
    """A witness with its white space folded, and none around `::` and within `<>`."""
    out = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), " ?:: ?", "::")
    return F.trim(F.replace(F.replace(out, F.lit("< "), F.lit("<")), F.lit(" >"), F.lit(">")))


def is_tool_witness(text: Column) -> Column:
    """Whether a witness names an external tool, in any case."""
    return F.lower(text).rlike(rf"^(?:{'|'.join(TOOLS)})::|{'|'.join(TOOL_WORDS)}")


def is_phantom_type(text: Column) -> Column:
    """Whether a witness is a type with arguments, `Path::<A, B>`, at its first `::<`; nested arguments do not count."""
    return F.regexp_replace(text, r"(?:\(\))+$", "").rlike(r"^(?s:(?!::<).)*::<[^<>]*>")


#: Words that mark a fix in a commit subject (fixed values).
FIX_WORDS = ["fix", "fixes", "fixed", "fixing", "bug", "bugfix", "defect", "regression", "patch", "hotfix"]


def is_fix_subject(subject: Column) -> Column:
    """A fix keyword as a whole word in any case, or an issue reference # with a digit."""
    return subject.rlike(r"(?i)(?<![a-z0-9_])(?:" + "|".join(FIX_WORDS) + r")(?![a-z0-9_])") | subject.rlike("#[0-9]")


# ---- digests

FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(text: Column) -> Column:
    """FNV-1a over UTF-8 bytes as 16 hexadecimal digits.

    The 64-bit product is kept in two halves of 32 bits, since bigint products overflow in ANSI mode.
    The prime is 2^40 + 0x1B3, so high' = low * 2^8 + high * 0x1B3 + carry.
    """
    data = F.encode(text, "UTF-8")
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
        low = acc["lo"].bitwiseXOR(byte)
        product = low * 0x1B3
        high = F.shiftleft(low, 8) + acc["hi"] * 0x1B3 + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))
    steps = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(steps, start, step, lambda a: F.concat(half(a["hi"]), half(a["lo"])))


def digest(text: Column) -> Column:
    return F.concat(F.lit("fnv1a64:"), fnv1a64(text))


def shape_digest(kind: Column, name: Column, tokens: Column) -> Column:
    """The digest with the item's own name made neutral, so renamed twins agree."""
    neutral = F.regexp_replace(tokens, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")), "_")
    return digest(F.concat_ws("|", kind, F.when(F.coalesce(name, F.lit("")) == "", tokens).otherwise(neutral)))


def strong_digest(text: Column) -> Column:
    """A 256-bit digest; only equality of digests matters, so SHA-2 stands in for any other."""
    return F.sha2(text, 256)


# ---- versions


def version_parts(version: Column) -> Column:
    """Dotted parts as array<struct<number, text>>; a part's number is its leading digits."""
    clean = F.regexp_replace(F.trim(version), "^v", "")
    return F.transform(F.split(clean, r"\."), lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).try_cast("long").alias("number"), p.alias("text")))


def version_parseable(version: Column) -> Column:
    """At least one dotted part, each beginning with a digit."""
    return F.coalesce(F.regexp_replace(F.trim(version), "^v", "").rlike(r"^[0-9][0-9A-Za-z+-]*(\.[0-9][0-9A-Za-z+-]*)*\z"), F.lit(False))


def version_at_least(version: Column, least: Column) -> Column:
    """Compares (number, text) part by part, so 1.0 < 1.00 and 1.2 < 1.2.0; null if either cannot be parsed."""
    return F.when(version_parseable(version) & version_parseable(least), version_parts(version) >= version_parts(least))


def is_version_tag(tag: Column) -> Column:
    """v and dotted digits; without the v at least two parts."""
    return tag.rlike(r"^(?:v[0-9]+(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)+)\z")


# ---- dates


def iso_date(text: Column) -> Column:
    """A date of the form yyyy-MM-dd, strictly padded; null for anything else."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def frame_state(frame: Column, as_of: Column) -> Column:
    """none, within (today or later), past or unparsable, of a trimmed date text."""
    day = iso_date(F.trim(frame))
    return F.when(frame.isNull(), "none").when(day.isNull(), "unparsable").when(day >= as_of, "within").otherwise("past")


# ---- numbers


def clamp_rate(x: Column) -> Column:
    """Into [0, 1]; NaN and null are 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) / a + F.lit(1.0) / b)


def eps_floor(n0: Column, n1: Column, delta: float) -> Column:
    """Cut bound without variance: sqrt(ln(4 / delta') / (2 m)), delta' = delta / n, 1/m = 1/n0 + 1/n1."""
    n = n0 + n1
    return F.sqrt(F.log(F.lit(4.0) * n / F.lit(delta)) / (2.0 * harmonic_mean(n0, n1)))


def eps_full(n0: Column, n1: Column, variance: Column, delta: float) -> Column:
    """Cut bound with variance: sqrt(2 var ln(2/delta') / m) + 2 ln(2/delta') / (3 m), delta' = delta / ln n."""
    m = harmonic_mean(n0, n1)
    confidence = F.log(F.lit(2.0) * F.log(n0 + n1) / F.lit(delta))
    return F.sqrt(2.0 / m * variance * confidence) + 2.0 / (3.0 * m) * confidence


# ---- enumerations (fixed values): rank from weakest or first on; text not listed is null

SEVERITIES = ["low", "medium", "high"]
TIERS = ["none", "reachability", "execution", "formal_proof"]
STRENGTHS = ["git_trust", "ssh", "gpg", "sigstore"]
PROVENANCES = ["encountered", "constructable", "imagined"]
CATEGORIES = ["functional_correctness", "substrate_alignment"]
BOUNDARY_KINDS = ["api_request", "api_response", "mcp_invocation", "external_link", "iframe", "database_query", "cross_service", "subprocess_launch", "dependency_import", "user_input", "filesystem_path", "environment_variable", "shell_argument"]


def rank_of(value: Column, order: list[str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(order) for x in (v, k))), value)


def from_rank(rank: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), rank + 1)


def enum_value(text: Column, order: list[str]) -> Column:
    """The canonical spelling of an enumeration value in CamelCase, snake_case or kebab-case, or null."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(last_segment(F.trim(text)), "([a-z0-9])([A-Z])", "$1_$2"), "-", "_"))
    return F.when(snake.isin(order), snake)


# ---- labels


def item_label(kind: Column, a: Column, b: Column, c: Column) -> Column:
    """A target's label: impl-method targets as Type::method or <Type as Trait>::method, others by kind and name."""
    return (
        F.when(kind == "impl_fn", F.when(c.isNull(), F.concat(a, F.lit("::"), b)).otherwise(F.concat(F.lit("<"), a, F.lit(" as "), c, F.lit(">::"), b)))
        .when(kind == "trait_fn", F.concat(a, F.lit("::"), b))
        .when(kind == "impl", F.when(b.isNull(), F.concat(F.lit("impl "), a)).otherwise(F.concat(F.lit("impl "), b, F.lit(" for "), a)))
        .when(kind == "unknown", F.lit("<unknown>"))
        .otherwise(F.concat_ws(" ", kind, a))
    )


def cluster_key(class_: Column, digest_: Column) -> Column:
    return F.concat_ws("@", class_, digest_)
