"""An outline parser for Rust source: top-level items with the features that patterns ask for, and annotations of items at any depth.

It reads tokens, not full syntax; digests are over this module's own canonical token text.
A file whose brackets do not match is a parse failure. Items inside of function bodies are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.pattern import canonical_signature
from ..schema import RELATIONS, TARGET

_TOKEN = re.compile(
    r"(?P<doc>///(?!/)[^\n]*|//![^\n]*)|(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<text>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\.[^'\n]*)')|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r#)?[A-Za-z_]\w*)|(?P<number>[0-9][\w.]*)|(?P<mark>->|=>|::|\.\.=|[^\w\s])",
    re.S,
)
_KINDS = {"struct", "enum", "trait", "fn", "impl", "type", "mod", "const", "static", "union"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}

Token = tuple[str, str, int]


def tokens(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"line {line}: unexpected character")
        kind = next(k for k in ("doc", "skip", "text", "life", "word", "number", "mark") if m[k] is not None)
        if kind != "skip":
            out.append((kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


def close(toks: list[Token], at: int) -> int:
    """The index after the bracket that closes the one at `at`."""
    stack = []
    for i in range(at, len(toks)):
        kind, value, line = toks[i]
        if kind == "mark" and value in _OPEN:
            stack.append(_OPEN[value])
        elif kind == "mark" and value in _CLOSE:
            if not stack or stack.pop() != value:
                raise ValueError(f"line {line}: unmatched {value}")
            if not stack:
                return i + 1
    raise ValueError(f"line {toks[at][2]}: {toks[at][1]} is not closed")


def _text(toks: list[Token]) -> str:
    return " ".join(v for k, v, _ in toks if k != "doc")


def _body(toks: list[Token]) -> tuple[list[str], list[str]]:
    """Names that are called, and macros."""
    calls, macros = set(), set()
    for i, (kind, value, _) in enumerate(toks[:-1]):
        after = toks[i + 1][1]
        if kind != "word":
            continue
        if after == "!" and i + 2 < len(toks) and toks[i + 2][1] in _OPEN:
            macros.add(value)
        elif after == "(" and (i == 0 or toks[i - 1][1] != "fn"):
            calls.add(value)
        elif after == "::" and i + 2 < len(toks) and toks[i + 2][1] == "<":
            depth, j = 0, i + 2
            while j < len(toks):
                depth += (toks[j][1] == "<") - (toks[j][1] == ">")
                j += 1
                if depth == 0:
                    break
            if j < len(toks) and toks[j][1] == "(":
                calls.add(value)
    return sorted(calls), sorted(macros)


def _attribute(toks: list[Token]) -> tuple[str, list[Token]]:
    """Path and argument tokens of #[path(args)]."""
    n = 0
    while n < len(toks) and (toks[n][0] == "word" or toks[n][1] == "::"):
        n += 1
    return "".join(v for _, v, _ in toks[:n]), toks[n + 1 : -1] if n < len(toks) and toks[n][1] in _OPEN else toks[n:]


def _split(toks: list[Token]) -> list[list[Token]]:
    """Parts between the commas that stand in no bracket."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        depth += (t[1] in _OPEN and t[0] == "mark") - (t[1] in _CLOSE and t[0] == "mark")
        if t[1] == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _value(toks: list[Token]) -> str:
    return _literal(toks[0][1]) if len(toks) == 1 and toks[0][0] == "text" else _text(toks)


def arguments(toks: list[Token]) -> dict[str, str]:
    """name = value pairs of an annotation; a list is a JSON array, and so is what stands alone, under ""."""
    out: dict[str, str] = {}
    alone = []
    for part in _split(toks):
        if len(part) >= 3 and part[1][1] == "=":
            value = part[2:]
            if value[0][1] == "[":
                out[part[0][1]] = json.dumps([_value(v) if v[0][0] == "text" else "".join(t for _, t, _ in v) for v in _split(value[1:-1])])
            else:
                out[part[0][1]] = _value(value)
        else:
            alone.append("".join(v for _, v, _ in part))
    return {"": json.dumps(alone)} | out


def _literal(token: str) -> str:
    m = re.match(r"b?r(#*)\"(.*)\"\1$", token, re.S)
    return m[2] if m else re.sub(r"\\(.)", r"\1", token[1:-1])


def items(file: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Rows of top-level items, of the annotations of items at any depth (name, args, the item they stand on), and of functions.

    Functions are free ones, methods of impls, and those in the bodies of property-test macros; kind tells tests apart.
    """
    toks = tokens(text)
    close_all(toks)
    found: list[dict] = []
    notes: list[dict] = []
    functions: list[dict] = []
    for item, attrs, part in _walk(file, toks):
        if item["kind"] != "macro":
            found.append(item)
        _notes(item, attrs, part, None, notes, functions)
    for i in range(len(toks) - 2):
        if (toks[i][1], toks[i + 1][1]) == ("proptest", "!") and toks[i + 2][1] in _OPEN:
            body = toks[i + 2 : close(toks, i + 2)]
            functions += [{"name": b[1], "file": file, "kind": "proptest"} for a, b in zip(body, body[1:], strict=False) if a[:2] == ("word", "fn") and b[0] == "word"]
    return found, notes, functions


def _walk(file: str, toks: list[Token]) -> Iterator[tuple[dict, list, list[Token]]]:
    """Each item of a file or block with its attributes (path, arguments, line) and tokens."""
    at, attrs, docs = 0, [], []
    while at < len(toks):
        kind, value, line = toks[at]
        if kind == "doc":
            docs += [] if value.startswith("//!") else [value[3:].strip()]
            at += 1
        elif value == "#" and at + 1 < len(toks) and toks[at + 1][1] in ("[", "!"):
            open_ = at + 1 + (toks[at + 1][1] == "!")
            end = close(toks, open_)
            if toks[at + 1][1] != "!":
                attrs.append((*_attribute(toks[open_ + 1 : end - 1]), line))
            at = end
        else:
            end = at
            while end < len(toks) and not (toks[end][0] == "mark" and toks[end][1] in (";", "{")):
                end = close(toks, end) if toks[end][1] in ("(", "[") and toks[end][0] == "mark" else end + 1
            end = close(toks, end) if end < len(toks) and toks[end][1] == "{" else min(end + 1, len(toks))
            item = _item(file, toks[at:end], [a[:2] for a in attrs], docs, line)
            if item is None and [v for _, v, _ in toks[at : at + 2]] == ["macro_rules", "!"] and end > at + 2:
                item = {"file": file, "line": line, "kind": "macro", "name": toks[at + 2][1], "impl_trait": None, "tokens": _text(toks[at:end])}
            if item:
                yield item, attrs, toks[at:end]
            attrs, docs, at = [], [], end


def _notes(item: dict, attrs: list, toks: list[Token], outer: dict | None, out: list[dict], functions: list[dict]) -> None:
    """Annotations and functions of an item, then those of what its block holds."""
    kind, name, trait = item["kind"], item["name"], item["impl_trait"]
    target = {"kind": kind, "a": name, "b": trait if kind == "impl" else None, "c": None}
    if outer and kind in ("fn", "const", "type"):
        target = {"kind": f"{outer['kind']}_{kind}", "a": outer["name"], "b": name, "c": outer["impl_trait"]}
    if kind == "fn" and (outer is None or outer["kind"] == "impl"):
        marks = {path for path, _, _ in attrs}
        functions.append({"name": name, "file": item["file"], "kind": "function" if "test" not in marks else "ignored_test" if "ignore" in marks else "test"})
    derive = next((v for path, args, _ in attrs if path.split("::")[-1] == "proc_macro_derive" for k, v, _ in args if k == "word"), None)
    for path, args, line in attrs:
        out.append({"name": path.split("::")[-1], "args": arguments(args), "file": item["file"], "line": line, "item_kind": target["kind"], "item_name": name, "target": target, "macro_name": derive or name, "item_tokens": item["tokens"]})
    if kind in ("mod", "impl", "trait"):
        block = next((i for i, t in enumerate(toks) if t[1] == "{" and t[0] == "mark"), None)
        for inner, own, part in _walk(item["file"], toks[block + 1 : -1]) if block is not None else ():
            _notes(inner, own, part, None if kind == "mod" else item, out, functions)


def close_all(toks: list[Token]) -> None:
    stack = []
    for kind, value, line in toks:
        if kind == "mark" and value in _OPEN:
            stack.append(_OPEN[value])
        elif kind == "mark" and value in _CLOSE and (not stack or stack.pop() != value):
            raise ValueError(f"line {line}: unmatched {value}")
    if stack:
        raise ValueError(f"the end: {stack[-1]} is missing")


def _item(file: str, toks: list[Token], attrs: list, docs: list[str], line: int) -> dict | None:
    words = [v for _, v, _ in toks]
    first = next((i for i, w in enumerate(words) if w in _KINDS and not (w == "const" and i + 1 < len(words) and words[i + 1] in ("fn", "unsafe", "async", "extern"))), None)
    if first is None or "{" in words[:first] or "use" in words[:first] or "!" in words[:first]:
        return None
    kind = words[first]
    head_end = next((i for i in range(first, len(words)) if words[i] in ("{", ";")), len(words))
    head, body = toks[first + 1 : head_end], toks[head_end:]
    name, trait, methods, variants = None, None, [], None
    if kind == "impl":
        flat = _strip_generics([v for _, v, _ in head])
        flat = flat[: flat.index("where")] if "where" in flat else flat
        if "for" in flat:
            i = flat.index("for")
            trait = next((w for w in reversed(flat[:i]) if re.match(r"\w", w)), None)
            flat = flat[i + 1 :]
        name = next((w for w in reversed(flat) if re.match(r"[A-Za-z_]", w)), None)
    else:
        name = next((v for k, v, _ in head if k == "word"), None)
    if kind in ("impl", "trait"):
        for i, t in enumerate(body[:-2]):
            if t[1] == "fn" and body[i + 1][0] == "word":
                j = next((k for k in range(i + 2, len(body)) if body[k][1] == "("), None)
                if j is not None:
                    end = close(body, j)
                    stop = next((k for k in range(end, len(body)) if body[k][1] in ("{", ";", "where")), end)
                    methods.append({"name": body[i + 1][1], "sig": canonical_signature(_text(body[j:stop]))})
    if kind == "enum":
        variants, depth = 0, 0
        part = False
        for k, v, _ in body[1:-1]:
            depth += (v in _OPEN) - (v in _CLOSE)
            part = part or (k == "word" and depth == 0)
            if v == "," and depth == 0:
                variants, part = variants + part, False
        variants += part
    has_body = kind in ("fn", "impl")
    calls, macros = _body(body) if has_body else (None, None)
    args = lambda n: [v for p, a in attrs if p.split("::")[-1] == n for k, v, _ in a if k == "word"]
    mods = words[:first]
    tokens_text = _text(toks)
    return {
        "file": file, "line": line, "kind": kind, "name": name, "variant_count": variants, "methods": methods,
        "attr_paths": sorted({x for p, _ in attrs for x in (p, p.split("::")[-1])}), "doc": "\n".join(docs), "body_calls": calls, "body_macros": macros,
        "is_async": "async" in mods if kind == "fn" else None, "is_unsafe": "unsafe" in mods if kind in ("fn", "impl", "trait") else None, "is_const": "const" in mods if kind == "fn" else None,
        "impl_trait": trait, "derives": args("derive"), "serde_args": args("serde"), "tokens": tokens_text,
    }


def _strip_generics(words: list[str]) -> list[str]:
    out, depth = [], 0
    for w in words:
        depth += w == "<"
        if depth == 0:
            out.append(w)
        depth -= w == ">"
    return out


_ROW = RELATIONS["items"].replace(", structural_digest string, shape_digest string", "")
_NOTE = f"name string, args map<string,string>, file string, line bigint, item_kind string, item_name string, target {TARGET}, macro_name string, item_tokens string"


def outline(texts: DataFrame) -> DataFrame:
    """One row for each item, annotation, function or failure of source texts (file, text), the other columns null.

    Files are parsed once: write this table before several relations are taken from it.
    """
    nested = lambda ddl: ddl.replace(" ", ":").replace(",:", ",")
    schema = f"item struct<{nested(_ROW)},tokens:string>, note struct<{nested(_NOTE)}>, function struct<{nested(RELATIONS['functions'])}>, file string, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, text in zip(part["file"], part["text"], strict=True):
                try:
                    found, notes, functions = items(file, text or "")
                    rows = [(i, None, None, file, None) for i in found] + [(None, n, None, file, None) for n in notes] + [(None, None, f, file, None) for f in functions]
                except ValueError as e:
                    rows = [(None, None, None, file, str(e))]
                if rows:
                    yield pd.DataFrame(rows, columns=["item", "note", "function", "file", "error"])

    return texts.select("file", "text").mapInPandas(run, schema)


def parse_items(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, annotations and parse_failures of source texts (file, text)."""
    rows = outline(texts)
    return outlined_items(rows), outlined_notes(rows), failures(rows)


def outlined_items(rows: DataFrame) -> DataFrame:
    found = rows.where("item is not null").select("item.*")
    return found.withColumn("structural_digest", S.digest(F.col("tokens"))).withColumn("shape_digest", S.shape_digest(F.col("kind"), F.col("name"), F.col("tokens"))).drop("tokens")


def outlined_notes(rows: DataFrame) -> DataFrame:
    """Annotations with the digests of the items they stand on."""
    notes = rows.where("note is not null").select("note.*")
    text = F.col("item_tokens")
    kind = F.regexp_replace("item_kind", "^(impl|trait)_", "")
    return notes.withColumn("structural_digest", S.digest(text)).withColumn("shape_digest", S.shape_digest(kind, F.col("item_name"), text)).drop("item_tokens")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("file", "error")


def function_index(rows: DataFrame) -> DataFrame:
    """name, file, kind of the functions of an outline."""
    return rows.where("function is not null").select("function.*")
