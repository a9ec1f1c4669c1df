"""The structural pattern language: text to tree, checks, text again, and Spark columns.

A pattern is a comma-separated list of constraints, all of which must hold. Leaves whose
feature does not apply to an item are undefined (null) or false, by operator; only items
for which the whole is exactly true match.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MAX_DEPTH, MAX_NODES = 10, 256
KINDS = ["struct", "enum", "trait", "fn", "impl", "type", "mod", "const", "static", "union"]
QUALIFIERS = ["is_async", "is_unsafe", "is_const"]
#: Leaves with one text in brackets; those in IDENTIFIERS take a bare name only.
TEXT_LEAVES = ["attr_present", "doc_contains", "body_contains_macro", "body_calls", "impl_of_trait", "derives", "serde_arg"]
IDENTIFIERS = {"body_contains_macro", "body_calls", "impl_of_trait", "derives", "serde_arg"}
OPERATORS = ["item", "name", "variants", "has_method", *TEXT_LEAVES, *QUALIFIERS, "all_of", "any_of", "not"]


class PatternError(ValueError):
    """The text is no valid pattern."""


@dataclass(frozen=True)
class Node:
    """A constraint: operator, its literal arguments, and the constraints inside."""

    op: str
    args: tuple = ()
    inside: tuple[Node, ...] = ()

    def __str__(self) -> str:
        if self.op == "item":
            return f"item = {self.args[0]}"
        if self.op == "name":
            return f"name = matches({_quoted(self.args[0])})"
        if self.op == "variants":
            return "variants = {}..={}".format(*self.args)
        if self.op in QUALIFIERS:
            return self.op
        if self.op == "not":
            return f"not({self.inside[0]})"
        if self.op in ("all_of", "any_of"):
            return f"{self.op}([{', '.join(map(str, self.inside))}])"
        return f"{self.op}({', '.join(map(_quoted, self.args))})"


@dataclass(frozen=True)
class Pattern:
    """All of the constraints must hold."""

    constraints: tuple[Node, ...]

    def __str__(self) -> str:
        return ", ".join(map(str, self.constraints))


_TOKEN = re.compile(r'\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<number>[0-9][0-9_]*)|(?P<range>\.\.=)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[=(),\[\]]))', re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


def _quoted(text: str) -> str:
    out = text.replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join(c if c.isprintable() or ord(c) > 127 else {"\n": "\\n", "\t": "\\t", "\r": "\\r", "\0": "\\0"}.get(c, f"\\u{{{ord(c):x}}}") for c in out) + '"'


def _unquoted(token: str) -> str:
    def plain(m: re.Match) -> str:
        body = m[1]
        if body[0] == "u":
            return chr(int(body[2:-1], 16))
        if body[0] == "x":
            return chr(int(body[1:], 16))
        if body[0] not in _ESCAPES:
            raise PatternError(f"unknown escape \\{body}")
        return _ESCAPES[body[0]]

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.)", plain, token[1:-1], flags=re.S)


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"unexpected character at {at}: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        found = self.peek()
        if found[0] != kind or value is not None and found[1] != value:
            raise PatternError(f"expected {value or kind}, found {found[1] or 'the end'}")
        self.at += 1
        return found[1]

    def text(self) -> str:
        return _unquoted(self.take("text"))

    def listed(self, close: str) -> list[Node]:
        out = []
        while self.peek() not in (("mark", close), ("end", "")):
            out.append(self.constraint())
            if self.peek() == ("mark", ","):
                self.take("mark", ",")
            else:
                break
        return out

    def constraint(self) -> Node:
        op = self.take("word")
        if op not in OPERATORS:
            raise PatternError(f"unknown operator {op}")
        if op in QUALIFIERS:
            return Node(op)
        if op in ("item", "name", "variants"):
            self.take("mark", "=")
            return getattr(self, f"_{op}")()
        self.take("mark", "(")
        if op == "not":
            node = Node(op, (), (self.constraint(),))
        elif op in ("all_of", "any_of"):
            self.take("mark", "[")
            node = Node(op, (), tuple(self.listed("]")))
            self.take("mark", "]")
            if not node.inside:
                raise PatternError(f"{op} needs a constraint")
        elif op == "has_method":
            name = self.text()
            self.take("mark", ",")
            node = Node(op, (name, self.text()))
        else:
            node = Node(op, (self.text(),))
        self.take("mark", ")")
        _check_texts(node)
        return node

    def _item(self) -> Node:
        kind = self.take("word")
        if kind not in KINDS:
            raise PatternError(f"unknown item kind {kind}")
        return Node("item", (kind,))

    def _name(self) -> Node:
        self.take("word", "matches")
        self.take("mark", "(")
        glob = self.text()
        self.take("mark", ")")
        if not glob:
            raise PatternError("the glob is empty")
        return Node("name", (glob,))

    def _variants(self) -> Node:
        low = int(self.take("number").replace("_", ""))
        self.take("range")
        high = int(self.take("number").replace("_", ""))
        if high < low:
            raise PatternError("the upper bound is below the lower")
        return Node("variants", (low, high))


def _check_texts(node: Node) -> None:
    if any(not str(a).strip() for a in node.args):
        raise PatternError(f"{node.op} has an empty text")
    if node.op in IDENTIFIERS and not re.fullmatch(r"(?!_$)[^\W\d]\w*", node.args[0]):
        raise PatternError(f"{node.op} takes a single bare name, not {node.args[0]!r}")


def parse(text: str) -> Pattern:
    """The checked pattern of a text; PatternError if it is none."""
    reader = _Reader(text)
    nodes = reader.listed("")
    if reader.peek()[0] != "end":
        raise PatternError(f"unexpected {reader.peek()[1]}")
    if not nodes:
        raise PatternError("a pattern needs a constraint")
    pattern = Pattern(tuple(nodes))
    validate(pattern)
    return pattern


def validate(pattern: Pattern) -> None:
    """Limits of depth and size, and where `not` may stand: in all_of, next to something that is no `not`."""
    count = 0
    todo = [(n, 1, False) for n in pattern.constraints]
    while todo:
        node, depth, may_negate = todo.pop()
        count += 1
        if count > MAX_NODES:
            raise PatternError(f"more than {MAX_NODES} constraints")
        if depth > MAX_DEPTH:
            raise PatternError(f"deeper than {MAX_DEPTH}")
        if node.op == "not" and not may_negate:
            raise PatternError("not may only stand in all_of, next to a positive constraint")
        if node.op == "all_of" and all(n.op == "not" for n in node.inside):
            raise PatternError("all_of needs a positive constraint")
        todo += [(n, depth + 1, node.op == "all_of") for n in node.inside]


def kind_hint(pattern: Pattern) -> str | None:
    """The item kind that any match must have: the first `item =` at the top or in nested all_of."""
    for node in pattern.constraints:
        found = _hint(node)
        if found:
            return found
    return None


def _hint(node: Node) -> str | None:
    if node.op == "item":
        return node.args[0]
    return next((h for n in node.inside if (h := _hint(n))), None) if node.op == "all_of" else None


def canonical_signature(signature: str) -> str:
    """A signature without blanks and parameter names: "(&self, other: &Self) -> bool" and "(&self,&Self)->bool" agree."""
    text = re.sub(r"\s+", " ", signature.strip())
    m = re.match(r"\((.*)\)\s*(?:->\s*(.*))?$", text)
    if not m:
        return text.replace(" ", "")
    depth, parts, part = 0, [], ""
    for c in m[1]:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    parts += [part] if part.strip() else []
    types = [re.sub(r"^\s*(?:mut\s+)?[A-Za-z_]\w*\s*:\s*(?!:)", "", p) if not re.match(r"\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?self\b", p) else p for p in parts]
    out = "(" + ",".join(re.sub(r"\s+", "", t) for t in types) + ")"
    return out + (f"->{re.sub(r'\s+', '', m[2])}" if m[2] else "")


def _leaf(node: Node) -> Column:
    no = F.lit(False)
    kind = F.col("kind")
    has = lambda column, value: F.array_contains(F.col(column), value)
    if node.op == "item":
        return F.coalesce(kind == node.args[0], no)
    if node.op == "name":
        return F.coalesce(S.glob_match(F.col("name"), node.args[0]), no)
    if node.op == "variants":
        return F.coalesce((kind == "enum") & F.col("variant_count").between(*node.args), no)
    if node.op == "has_method":
        name, signature = node.args[0], canonical_signature(node.args[1])
        return F.coalesce((kind == "impl") & F.exists("methods", lambda m: (m["name"] == name) & (m["sig"] == signature)), no)
    if node.op == "attr_present":
        return F.coalesce(has("attr_paths", node.args[0]), no)
    if node.op == "doc_contains":
        return F.coalesce(F.contains(F.col("doc"), F.lit(node.args[0])), no)
    if node.op == "body_contains_macro":
        return has("body_macros", node.args[0])
    if node.op == "body_calls":
        return has("body_calls", node.args[0])
    if node.op in QUALIFIERS:
        return F.col(node.op)
    if node.op == "impl_of_trait":
        return F.when(kind == "impl", F.coalesce(F.col("impl_trait") == node.args[0], no))
    if node.op == "derives":
        return F.coalesce(has("derives", node.args[0]), no)
    return F.coalesce(has("serde_args", node.args[0]), no)


def _compile(node: Node) -> Column:
    if node.op == "not":
        return ~_compile(node.inside[0])
    if node.op in ("all_of", "any_of"):
        join = (lambda a, b: a & b) if node.op == "all_of" else (lambda a, b: a | b)
        return reduce(join, map(_compile, node.inside))
    return _leaf(node)


def compile_pattern(pattern: Pattern | str) -> Column:
    """The pattern over the columns of `items` as a nullable boolean; null stands for undefined."""
    pattern = parse(pattern) if isinstance(pattern, str) else pattern
    return reduce(lambda a, b: a & b, map(_compile, pattern.constraints))


def match(items: DataFrame, pattern: Pattern | str) -> DataFrame:
    """The items for which the pattern is exactly true; the kind it asks for is filtered first."""
    pattern = parse(pattern) if isinstance(pattern, str) else pattern
    kind = kind_hint(pattern)
    return (items.where(F.col("kind") == kind) if kind else items).where(compile_pattern(pattern))


def match_catalog(items: DataFrame, catalog: list[tuple[str, str]], per_pass: int = 100) -> DataFrame:
    """items with class, once for each pattern that matches: one scan and no cross join.

    All patterns become one array of class names in a projection, whose nulls go before it is exploded; a catalog of more than `per_pass` patterns is cut
    into several projections, which keeps generated code within limits.
    """
    out = None
    for k in range(0, max(1, len(catalog)), per_pass):
        names = [F.when(compile_pattern(text), F.lit(name)) for name, text in catalog[k : k + per_pass]]
        found = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
        part = items.withColumn("class", F.explode(found))
        out = part if out is None else out.unionByName(part)
    return out


#: The built-in catalog (fixed values): class, pattern, provenance.
CATALOG = [
    ("deliberate-leak-not-documented", 'any_of([body_calls("forget"), body_calls("leak")])', "constructable"),
    ("deserialize-without-deny-unknown-fields", 'all_of([derives("Deserialize"), not(serde_arg("deny_unknown_fields"))])', "constructable"),
    ("get-unchecked-without-proof", 'any_of([body_calls("get_unchecked"), body_calls("get_unchecked_mut")])', "constructable"),
    ("panic-in-drop", 'all_of([item = impl, impl_of_trait("Drop"), any_of([body_calls("unwrap"), body_calls("expect"), body_contains_macro("panic"), body_contains_macro("unreachable"), body_contains_macro("todo"), body_contains_macro("unimplemented")])])', "constructable"),
    ("size-of-in-element-count", 'all_of([body_calls("copy_nonoverlapping"), body_calls("size_of")])', "constructable"),
    ("system-time-unwrap-panic", 'all_of([body_calls("duration_since"), any_of([body_calls("unwrap"), body_calls("expect")])])', "constructable"),
    ("transmute-size-or-lifetime-mismatch", 'any_of([body_calls("transmute"), body_calls("transmute_copy")])', "constructable"),
    ("unbounded-deserialization", 'body_calls("from_reader")', "constructable"),
    ("uninit-memory-assumed-init", 'any_of([body_calls("assume_init"), body_calls("uninitialized")])', "constructable"),
    ("unsafe-send-sync", 'all_of([item = impl, is_unsafe, any_of([impl_of_trait("Send"), impl_of_trait("Sync")])])', "constructable"),
    ("unvalidated-from-utf8-unchecked", 'any_of([body_calls("from_utf8_unchecked"), body_calls("from_utf8_unchecked_mut")])', "constructable"),
]


def catalog(extra: list[tuple[str, str, str]] = ()) -> list[tuple[str, str, str]]:
    """The catalog by name; raises if a pattern in it cannot be parsed."""
    for _, text, _ in (rows := sorted([*CATALOG, *extra])):
        parse(text)
    return rows


def catalog_frame(spark, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    return spark.createDataFrame(catalog(extra), "class string, pattern string, provenance string")


def to_json(pattern: Pattern) -> str:
    def tree(n: Node) -> dict:
        return {"op": n.op, "args": list(n.args), "inside": [tree(x) for x in n.inside]}

    return json.dumps([tree(n) for n in pattern.constraints], sort_keys=True)
