"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that ends its encoding. An
automaton of the vocabulary with suffix links lists the tokens that end at each position; one is the
last token of that prefix if and only if it is compatible with the last token of the
prefix before it, that is, no merge across their border would have come first. Following
the back-pointers from the full length emits the ids; no merge list is scanned.

Edge cases: a null text is the empty text and has no tokens; the words of a text are held
at once, so memory goes with the longest text and not with the table; repeated rows are
repeated, an empty table gives an empty one, and further columns are not read; the strings
of special tokens in a text are special tokens, as in the tokenizers library. The vocabulary file is a parameter and is read on each worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

END = "\0"
SUFFIX = "</w>"
#: Distinct pieces that a worker remembers; beyond that it starts afresh.
CACHE = 300_000
#: The last code point for which Python's own case and normal forms are used.
_LATIN = 0x24F
_ODD = re.compile(r"[^\x00-\x1b\x20-ɏ]")
_PIECE = None
_loaded: dict[str, Bpe] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """One vocabulary: encode_piece gives the ids of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # rules for texts beyond Latin letters: normal form and pre-tokens only
        vocab = {k.replace(SUFFIX, END) if k.endswith(SUFFIX) else k: v for k, v in spec["model"]["vocab"].items()}
        self.names = {v: k for k, v in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.letters = byte_letters()
        self.table = {i: c for i, c in enumerate(self.letters)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (x.replace(SUFFIX, END) for x in (a, b))
            self.rank[vocab[a], vocab[b]] = n
            self.parts[vocab[a + b]] = vocab[a], vocab[b]
            self.made[vocab[a + b]] = n
        self.lengths = {v: len(k) for k, v in vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.lone: dict[int, bool] = {}
        self.chunks: dict[str, tuple[str, str, int]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i not in self.special.values():
                self.matches.add_word(token, i)
        self.matches.make_automaton()

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone.

        The tokens are taken apart again, last merge first. If at some time the two parts
        at the border have a merge of their own that ranks before the one just undone, it
        would have come first, and so the pair can't stand.
        """
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        a, b, stands, before = left, right, True, float("inf")
        while True:
            joint = self.rank.get((a, b))
            if joint is not None and joint < before:
                stands = False
                break
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:  # of equal merges the left one comes first
                before, b = made_b + 1, self.parts[b][0]
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        self.pairs[left << 32 | right] = stands
        return stands

    def encode_piece(self, raw: str) -> tuple[int, ...]:
        """The ids of one pre-token, given in plain characters."""
        found = self.pieces.get(raw)
        if found is not None:
            return found
        word = raw if raw.isascii() and raw.isalnum() else raw.encode().decode("latin-1").translate(self.table)
        last: list[tuple[int, int] | None] = [None] * (len(word) + 2)
        for end, token in self.matches.iter(word + END):
            if last[end + 1] is None:
                start = end + 1 - self.lengths[token]
                if start == 0:
                    if self.alone(token):
                        last[end + 1] = token, 0
                elif (before := last[start]) is not None and self.compatible(before[0], token):
                    last[end + 1] = token, start
        out, at = [], len(word) + 1
        while at > 0:
            token, at = last[at]
            out.append(token)
        found = tuple(reversed(out))
        if len(self.pieces) > CACHE // 2:
            self.pieces.clear()
        self.pieces[raw] = found
        return found

    def alone(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its two parts are, and fit."""
        known = self.lone.get(token)
        if known is None:
            known = True
            if token in self.parts:
                a, b = self.parts[token]
                # The merge that makes the token must win at its border against every other one.
                known = self.alone(a) and self.alone(b) and self._joins(a, b)
            self.lone[token] = known
        return known

    def _joins(self, left: int, right: int) -> bool:
        a, b, own, before = left, right, self.rank[left, right], float("inf")
        while True:
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:
                before, b = made_b + 1, self.parts[b][0]
            joint = self.rank.get((a, b))
            if joint is not None and joint < before and joint != own:
                return False

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of any text, by the library's own rules, as plain characters."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            out.append(bytes(back[c] for c in piece).decode("utf-8", "surrogateescape"))
        return out

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        """ids, tokens and their number for a chunk without white space, in lower case."""
        found = self.chunks.get(chunk)
        if found is None:
            ids = [i for piece in _pieces(chunk) for i in self.encode_piece(piece)]
            found = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids)
            if len(self.chunks) > CACHE:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> list[tuple[str, str, int]]:
        """The text's chunks in order, each as chunk() gives it; no chunk is empty."""
        out: list[tuple[str, str, int]] = []
        at = 0
        for m in [*self.at_special.finditer(text), None]:
            part = text[at : m.start()] if m else text[at:]
            if part:
                if _ODD.search(part):
                    for piece in self.pretokens(part):
                        ids = self.encode_piece(piece)
                        out.append((" ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids)))
                else:
                    part = part if part.isascii() else unicodedata.normalize("NFC", part)
                    out += self.known(part.lower().split())
            if m:
                i = self.special[m[0]]
                out.append((str(i), m[0], 1))
                at = m.end()
        return out

    def forget(self) -> None:
        """Give back what was remembered: a worker that goes on with other tasks does not keep it."""
        self.chunks, self.pieces, self.pairs = {}, {}, {}

    def known(self, chunks: list[str]) -> list[tuple[str, str, int]]:
        get = self.chunks.get
        return [get(c) or self.chunk(c) for c in chunks]


def _pieces(chunk: str) -> list[str]:
    global _PIECE
    if _PIECE is None:
        import regex

        _PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
    return [chunk] if chunk.isascii() and chunk.isalpha() else _PIECE.findall(chunk)


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def decode(model: Bpe, ids: list[int]) -> str:
    """Token texts joined by a space: what this vocabulary's file, which names no decoder, means by decoding."""
    return " ".join(model.names[i] for i in ids)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves as array<int>."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            ids_out = []
            for text in batch.column("text"):
                found = model.encode(text.as_py() or "")
                ids, tokens = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
                rows[0].append(sum([f[2] for f in found]))
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(tokens.encode("utf-8", "surrogateescape")).hexdigest())
                if keep_ids:
                    ids_out.append([int(x) for x in ids.split()])
            cols = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
        model.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), schema)
