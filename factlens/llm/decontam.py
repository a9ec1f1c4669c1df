"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are compared in a plain form: Latin capitals lower-cased, every run of ASCII characters other
than letters and digits one space. Benchmark items are cut into overlapping segments. A
document region within k edits of a segment of length m shares at least
m - q + 1 - k * q of its q-grams (the q-gram lemma), all within a diagonal band k wide.
So q-gram hits are counted in overlapping diagonal bands, regions that reach the bound
are kept, and a banded alignment verifies each. One verified segment is a match, however
long the item is: a quote of 120 characters always holds a whole segment, a shorter one may.

The index holds a block of the benchmark of bounded size (BLOCK bytes of text); a larger
benchmark is a stated query set, worked off block by block.

Edge cases: null and empty texts hold nothing and match nothing; an item too short for the
lemma must occur whole, at word borders; items that are equal are reported each; an item
without letters or digits is never found; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

Q = 12
#: Segment length, step, and edits allowed in a segment as a share of its length.
SEGMENT, STEP, EDITS = 80, 40, 0.05
#: Bytes of benchmark text in one index.
BLOCK = 16 << 20
_BITS = 22

_PLAIN = K.LOWER.copy()
_PLAIN[:48] = _PLAIN[58:65] = _PLAIN[91:97] = _PLAIN[123:128] = 32


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of each row, with offsets."""
    if not len(data):
        return data, offsets
    x = _PLAIN[data]
    capital = np.flatnonzero((x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97) & (x[:-1] == 0xC3)) + 1
    x[capital] += 0x20
    blank = x == 32
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    drop[first] = blank[first]
    keep = ~drop
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def edits(length: int) -> int:
    return int(EDITS * length)


def bound(length: int) -> int:
    """q-grams that a region within the edit budget shares with a segment."""
    return length - Q + 1 - edits(length) * Q


class Index:
    """q-grams of a block of benchmark items with their places, and a bit table in front."""

    def __init__(self, items: list[tuple[int, str | None]]):
        data, offsets = plain(*K.utf8(pa.array([t for _, t in items], pa.string())))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [data[a:b].tobytes().strip() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.segments = [_segments(len(t)) for t in self.texts]
        self.short = [k for k, t in enumerate(self.texts) if t and bound(len(t)) < 1]
        grams, places = [], []
        for k, t in enumerate(self.texts):
            if t and bound(len(t)) >= 1:
                raw = np.frombuffer(t, np.uint8)
                at = np.arange(len(raw) - Q + 1)
                grams.append(K.Rolling(raw).spans(at, at + Q))
                places.append(np.stack([np.full(len(at), k), at]))
        gram = np.concatenate(grams) if grams else np.zeros(0, K.U64)
        place = np.concatenate(places, 1) if places else np.zeros((2, 0), np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at = gram[order], place[0][order], place[1][order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.gram >> K.U64(64 - _BITS)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in data, item and place in the item of every shared q-gram."""
        none = np.zeros(0, np.int64)
        if len(data) < Q or not len(self.gram):
            return none, none, none
        at = np.arange(len(data) - Q + 1)
        gram = K.Rolling(data).spans(at, at + Q)
        at = np.flatnonzero(self.bits[gram >> K.U64(64 - _BITS)])
        gram = gram[at]
        lo, hi = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, "right")
        n = hi - lo
        where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[where], self.at[where]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """row, item, start, end (bytes of the plain text), edits, share of segments found; for each row and item that match."""
        at, item, place = self.hits(data)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, item, place, row = at[inside], item[inside], place[inside], row[inside]
        diagonal = at - place
        found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
        # bands overlap by half, so that a region's hits, at most k diagonals apart, lie whole in one of them
        width = 2 * (edits(SEGMENT * 2) + 1)
        for shift in (0, width // 2):
            band = (diagonal + shift) // width
            order = np.lexsort((place, band, item, row))
            b, i, p, of = band[order], item[order], place[order], row[order]
            new = np.ones(len(order), bool)
            new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (of[1:] != of[:-1])
            starts = np.append(np.flatnonzero(new), len(order))
            sizes = np.diff(starts)
            least = np.array([min(bound(e - s) for s, e in segs) if segs else 1 << 30 for segs in self.segments])
            for g in np.flatnonzero(sizes >= least[i[starts[:-1]]]) if len(order) else ():
                mine = order[starts[g] : starts[g + 1]]
                k, r = int(i[starts[g]]), int(row[mine[0]])
                lo, hi = int(diagonal[mine].min()), int(diagonal[mine].max())
                done = found.setdefault((r, k), {})
                where = p[starts[g] : starts[g + 1]]
                for n, (s, e) in enumerate(self.segments[k]):
                    budget = edits(e - s)
                    if n in done and done[n][2] == 0:
                        continue
                    if np.searchsorted(where, e - Q, "right") - np.searchsorted(where, s) < bound(e - s):
                        continue
                    a, z = max(int(offsets[r]), lo + s - budget), min(int(offsets[r + 1]), hi + e + budget)
                    best = align(self.texts[k][s:e], data[a:z].tobytes(), budget)
                    if best is not None and (n not in done or best[0] < done[n][2]):
                        done[n] = a + best[1], a + best[2], best[0]
        out = []
        for (r, k), done in found.items():
            if done:
                share = len(done) / len(self.segments[k])
                start, end = min(x[0] for x in done.values()), max(x[1] for x in done.values())
                out.append((r, k, start - int(offsets[r]), end - int(offsets[r]), max(x[2] for x in done.values()), share))
        for k in self.short:
            text = b" " + data.tobytes() + b" " if len(data) else b""
            out += self._whole(k, data, offsets) if self.texts[k] in text else []
        return out

    def _whole(self, k: int, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        out, word = [], b" " + self.texts[k] + b" "
        for r in range(len(offsets) - 1):
            at = (b" " + data[offsets[r] : offsets[r + 1]].tobytes().strip() + b" ").find(word)
            if at >= 0:
                out.append((r, k, at, at + len(self.texts[k]), 0, 1.0))
        return out


def _segments(length: int) -> list[tuple[int, int]]:
    """Overlapping segments of an item; the last ends with it. An item up to 1.5 segments long is one."""
    if length < 1 or bound(length) < 1:
        return []
    if length <= SEGMENT * 3 // 2:
        return [(0, length)]
    starts = [*range(0, length - SEGMENT, STEP), length - SEGMENT]
    return [(s, s + SEGMENT) for s in starts]


def align(pattern: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best place of pattern in region within the budget, by banded dynamic programming.

    Row i of the table only spans the places that a path of at most `budget` edits through a
    region this wide can reach.
    """
    exact = region.find(pattern)
    if exact >= 0:
        return 0, exact, exact + len(pattern)
    m, n = len(pattern), len(region)
    slack = n - m + 2 * budget
    if slack < 0:
        return None
    text = np.frombuffer(region, np.uint8)
    far = budget + 1
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    for i in range(m):
        lo, hi = max(0, i + 1 - budget), min(n, i + 1 + slack)
        diag = cost[:-1] + (text != pattern[i])
        up = cost + 1
        here, from_ = up.copy(), start.copy()
        better = diag < here[1:]
        here[1:][better], from_[1:][better] = diag[better], start[:-1][better]
        # a step along the row costs one: the least of here[j] - j so far, carried on
        run = np.minimum.accumulate((here - step) * (n + 2) + step)
        source = run % (n + 2)
        carried = run // (n + 2) + step
        along = carried < here
        here[along], from_[along] = carried[along], from_[source[along]]
        here[:lo], here[hi + 1 :] = far, far
        cost, start = np.minimum(here, far), from_
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in blocks of about BLOCK bytes; one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // BLOCK)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r["item_id"], r["text"]) for r in part.where("text is not null").collect())


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits, share: every item found in every document; places count bytes of the plain text."""
    schema = "doc_id long, item_id long, start long, end long, edits int, share double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = K.utf8(batch.column("text"))
                ids = batch.column("doc_id")
                for a, b in K.chunks(offsets):
                    at = offsets[a : b + 1]
                    found = index.value.find(*plain(data[at[0] : at[-1]], at - at[0]))
                    if found:
                        r, k, start, end, cost, share = zip(*found, strict=True)
                        cols = [ids.take(pa.array([a + x for x in r])), pa.array(index.value.ids[list(k)]), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(cost, pa.int32()), pa.array(share, pa.float64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "end", "edits", "share"])

        part = rows.mapInArrow(K.lean(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found; rows pass through in place, without a join."""
    for items in blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = K.utf8(batch.column("text"))
                clean = np.ones(len(offsets) - 1, bool)
                for a, b in K.chunks(offsets):
                    at = offsets[a : b + 1]
                    hit = [a + f[0] for f in index.value.find(*plain(data[at[0] : at[-1]], at - at[0]))]
                    clean[np.array(hit, np.int64)] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(K.lean(run), docs.schema)
    return docs
