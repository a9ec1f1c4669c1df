"""Fuzzy line deduplication by MinHash over all documents.

Lines are sets of character shingles. MinHash signatures in bands propose candidates, exact
Jaccard similarity of whole lines verifies them, and distributed union-find groups them;
of each group the first line by (doc_id, line number) stays.

The bands: R rows in each of B; a pair at the threshold 0.8 shares one with probability
1 - (1 - 0.8 ** R) ** B, here 0.995, and 0.9999 at 0.9. Equal lines (A-Z lower-cased)
always meet: they have the same hash and are never compared. Of lines that share a band,
all pairs not connected yet are compared, however many share it: first each with the band's
most used line, then what that leaves in different groups, in blocks of TILE lines.

Edge cases: a null text has no lines; blank lines (nothing but ASCII white space) always
stay and belong to no group; a line shorter than a shingle is one shingle; rows repeated
with the same doc_id are one document, whose lines go by their numbers; rows without a doc_id
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components, discard, in_sieve, saved, sieve
from .jaccard import PERCENT, links, overlaps

WIDTH = 7
R, B = 4, 10
#: Lines that a task compares with as many others at once, of a band that more share.
TILE = 512
#: Hashes of lines that a task remembers, so that it signs a common line once.
SIGNED = 200_000
_LEAD = (np.arange(256) & 0xC0) != 0x80
_random = np.random.RandomState(99)
_TIMES = (_random.randint(0, 1 << 31, R * B, dtype=np.int64) * 2 + 1).astype(np.uint32)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number (blank ones count) of each line with a word."""
    breaks = np.flatnonzero(data == 10)
    edges = np.union1d(offsets, np.concatenate([breaks, breaks + 1]))
    start, end = edges[:-1], edges[1:]
    text = data[start] != 10
    start, end = start[text], end[text]
    row = np.searchsorted(offsets, start, "right") - 1
    number = np.searchsorted(breaks, start) - np.searchsorted(breaks, offsets[row])
    keep = ~K.SPACE[data[start]]
    for i in np.flatnonzero(~keep):  # only a line that begins with white space can be blank
        keep[i] = not K.SPACE[data[start[i] : end[i]]].all()
    return start[keep], end[keep], row[keep], number[keep]


def line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line."""
    view, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))


def char_shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WIDTH, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` code points within spans, and the span of each; a shorter span is one window.

    64 bits, with which sets are compared, or without `exact` 32 bits, enough for signatures.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if not data.size or len(code) != np.count_nonzero(_LEAD[data]):
        raise ValueError("text is not valid UTF-8")
    first = start
    if len(code) != len(data):
        lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
        first, end = lead[start], lead[end]
    n = np.maximum(end - first - width + 1, 1)
    span = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(span)) - np.repeat(np.cumsum(n) - n - first, n)
    low, high = np.zeros(len(code), np.uint32), np.zeros(len(code) if exact else 0, np.uint32)
    for k in range(width):  # Horner's rule, for all places at once; what lies beyond the end counts as 0
        m = len(code) - k
        if m <= 0:
            break
        low *= _A
        low[:m] += code[k:]
        if exact:
            high *= _C
            high[:m] ^= code[k:] + _B
    short = (end - first) < width
    if exact:
        out = K.mix(((high.astype(K.U64) << K.U64(32)) | low)[at])
    else:
        out = low[at]
        out ^= out >> np.uint32(15)
        out *= _C
        out ^= out >> np.uint32(13)
    if short.any():  # too short for a window: the hash of the span itself
        where = np.cumsum(n) - n
        whole = K.Rolling(data).spans(start[short], _byte_end(data, start[short], (end - first)[short]))
        out[where[short]] = whole if exact else (whole >> K.U64(32)).astype(np.uint32)
    return out, span


_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x7F4A7C15), np.uint32(0x85EBCA6B)


def _byte_end(data: np.ndarray, start: np.ndarray, chars: np.ndarray) -> np.ndarray:
    places = np.append(np.flatnonzero(_LEAD[data]), len(data))
    return places[np.searchsorted(places, start) + chars]


def char_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each line of a column, end to end, and offsets."""
    data, offsets = K.utf8(column)
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    values, span = char_shingles(K.LOWER[data], offsets[full], offsets[full + 1])
    return K.distinct(values, full[span], n)


def bands(values: np.ndarray, span: np.ndarray, n: int) -> np.ndarray:
    """The B band keys of each of n spans from 32-bit values; each span has one."""
    at = np.searchsorted(span, np.arange(n))
    x = values
    keys, turned = np.zeros((n, B), K.U64), np.empty_like(x)
    for k in range(R * B):
        np.multiply(x, _TIMES[k], out=turned)
        least = np.minimum.reduceat(turned, at)
        keys[:, k // R] = keys[:, k // R] * K.U64(0x9E3779B97F4A7C15) + least + K.U64(1)
    return K.mix(keys + np.arange(B, dtype=K.U64) * K.U64(0xD1B54A32D192ED03))


def _per_chunk(docs: DataFrame, make, schema: str, size: int = 1 << 18) -> DataFrame:
    """Run make(bytes lower-cased, bytes, offsets, ids) over chunks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in K.chunks(offsets, size):
                at = offsets[a : b + 1]
                raw = data[at[0] : at[-1]]
                if len(raw):
                    yield make(K.LOWER[raw], raw, at - at[0], ids[a:b])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null").mapInArrow(K.lean(run), schema)


def _occurrences(data: np.ndarray, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    start, end, row, number = lines_of(data, offsets)
    own = line_hashes(data, start, end)
    return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ids[row]), pa.array(number.astype(np.int32))], ["line", "doc_id", "line_no"])


def _texts(bits: np.ndarray):
    """Lines whose hash may be one that is asked for, each once for a chunk."""

    def make(data: np.ndarray, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        start, end, _, _ = lines_of(data, offsets)
        own = line_hashes(data, start, end)
        some = np.flatnonzero(in_sieve(bits, own.view(np.int64)))
        own, first = np.unique(own[some], return_index=True)
        start, end = start[some[first]], end[some[first]]
        text = [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(text, pa.string())], ["set", "text"])

    return make


def signatures(docs: DataFrame) -> DataFrame:
    """set, uses, keys: a line's hash, how often a chunk of documents has it, and its band keys; once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for a, b in K.chunks(offsets, 1 << 18):
                at = offsets[a : b + 1]
                raw = K.LOWER[data[at[0] : at[-1]]]
                if not len(raw):
                    continue
                start, end, _, _ = lines_of(raw, at - at[0])
                own, first, uses = np.unique(line_hashes(raw, start, end), return_index=True, return_counts=True)
                new = np.fromiter((x not in signed for x in own.tolist()), bool, len(own))
                if len(signed) > SIGNED:
                    signed.clear()
                own, first, uses = own[new], first[new], uses[new]
                signed.update(own.tolist())
                if len(own):
                    values, span = char_shingles(raw, start[first], end[first], exact=False)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * B), pa.array(bands(values, span, len(own)).ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(uses.astype(np.int32)), keys], ["set", "uses", "keys"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    return texts.select("text").mapInArrow(K.lean(run), "set long, uses int, keys array<long>")


def of_bands(signed: DataFrame, toks: DataFrame) -> DataFrame:
    """tok, set, uses: the lines of the bands toks."""
    bits = sieve(toks.select("tok"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False)
            some = np.flatnonzero(in_sieve(bits, keys))
            row = pa.array(some // B)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), batch.column("set").take(row), batch.column("uses").take(row)], ["tok", "set", "uses"])

    rows = signed.mapInArrow(K.lean(run), "tok long, set long, uses int").join(toks.select("tok"), "tok")
    return rows.groupBy("tok", "set").agg(F.max("uses").alias("uses"))


def in_one_list(group: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of equal group whose sets link. Rows of a group stand together."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, group[row]))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (group[r[1:]] != group[r[:-1]])
    place = np.arange(len(v))
    before = place - np.maximum.accumulate(np.where(new, place, 0))  # rows of the group that had this element already
    a = np.repeat(r, before)
    b = r[np.repeat(place - before, before) + np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before)]
    pair, common = np.unique(a * len(n) + b, return_counts=True)
    a, b = pair // len(n), pair % len(n)
    link = 100 * common >= PERCENT * (n[a] + n[b] - common)
    return a[link], b[link]


def across(x: np.ndarray, y: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) whose sets link."""
    n = np.diff(at)
    of = np.repeat(np.arange(len(y)), n[y])
    held = np.concatenate([values[at[k] : at[k + 1]] for k in y])
    order = np.argsort(held, kind="stable")
    held, of = held[order], of[order]
    out = []
    for k in x:
        own = values[at[k] : at[k + 1]]
        lo, hi = np.searchsorted(held, own), np.searchsorted(held, own, "right")
        m = hi - lo
        common = np.bincount(of[np.repeat(lo - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(y))
        for j in np.flatnonzero((n[y] > 0) & (100 * common >= PERCENT * (n[k] + n[y] - common))):
            out.append((k, y[j]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


#: Rows and shingles of a list up to which all its pairs are counted together with those of other lists.
FEW, SMALL = 16, 1 << 14


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: links between components, from rows (tok, i, j, set, comp, text, outer) sorted by block (tok, i, j).

    In a block each row with `outer` is compared with each other row. Blocks are taken whole, about TILE rows at a
    time; none has more than 2 * TILE or so.
    """

    def links_in(rows: pa.Table) -> pa.RecordBatch | None:
        key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("tok", "i", "j")])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
        group, start = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(start, len(group)))
        comp, ids = rows.column("comp").to_numpy(), rows.column("set").to_numpy()
        outer = rows.column("outer").to_numpy(zero_copy_only=False).astype(bool)
        values, at = char_sets(rows.column("text").combine_chunks())
        n = np.diff(at)
        is_few = (size <= FEW) & (np.bincount(group, n) <= SMALL)
        few = np.flatnonzero(is_few[group])
        found = []
        if len(few):
            part = np.concatenate([[0], np.cumsum(n[few])])
            a, b = in_one_list(group[few], values[np.repeat(at[few] - part[:-1], n[few]) + np.arange(part[-1])], part)
            found.append((few[a], few[b]))
        for g in np.flatnonzero(~is_few):
            own = np.arange(start[g], start[g] + size[g])
            if outer[own].any():
                found.append(across(own[outer[own]], own, values, at))
        if not found:
            return None
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        apart = comp[a] != comp[b]
        return pa.RecordBatch.from_arrays([pa.array(ids[a[apart]]), pa.array(ids[b[apart]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        end = len(table)
        if not last:  # the last block may go on in the next batch
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("tok", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            end = int(change[-1]) + 1 if len(change) else 0
        first = 0
        while first < end:
            stop = min(first + TILE, end)
            if stop < end:
                key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("tok", "i", "j")])
                change = np.flatnonzero((key[:, first + 1 : end] != key[:, first : end - 1]).any(0)) + first + 1
                fit = change[change <= stop]
                stop = int(fit[-1]) if len(fit) else int(change[0]) if len(change) else end
            out = links_in(table.slice(first, stop - first))
            if out is not None and out.num_rows:
                yield out
            first = stop
        held = table.slice(end).to_batches()
        rows = len(table) - end

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * TILE:
            yield from ready(False)
    if rows:
        yield from ready(True)


def blocks(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between components of the rows of each list(tok, set, comp, main, rows, outside).

    What is outside a list's main component is compared with all of its sets. Both sides of a list of more than TILE
    rows are dealt into blocks of about TILE sets, and each block of one meets each of the other on its own, so a
    set is copied once for each block it meets, not for each set.
    """
    c = F.col
    parts = lambda n: F.ceil(n / TILE).cast("int")
    own = lambda n: F.pmod(F.xxhash64("set"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    outer = c("comp") != c("main")
    short = lists.where(c("rows") <= TILE).select("tok", F.lit(0).alias("i"), F.lit(0).alias("j"), "set", "comp", outer.alias("outer"))
    long = lists.where(c("rows") > TILE)
    x = long.where(outer).select("tok", own(c("outside")).alias("i"), every(c("rows")).alias("j"), "set", "comp", F.lit(True).alias("outer"))
    y = long.select("tok", every(c("outside")).alias("i"), own(c("rows")).alias("j"), "set", "comp", F.lit(False).alias("outer"))
    rows = short.unionByName(x).unionByName(y).join(texts, "set").select("tok", "i", "j", "set", "comp", "text", "outer")
    return rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j").mapInArrow(K.lean(compare), "a long, b long")


def settle(pairs: DataFrame, lists: DataFrame, texts: DataFrame) -> DataFrame:
    """node, component of the sets that link: of candidate pairs(a, b), and of all sets of each of lists(tok, set, uses).

    The sets of a list meet its most used one first; what that leaves in different components is compared in blocks.
    """
    c = F.col
    heads = lists.groupBy("tok").agg(F.max(F.struct("uses", "set")).alias("lead"), F.count("*").alias("rows"))
    star = lists.join(heads, "tok").select(F.greatest("set", c("lead.set")).alias("a"), F.least("set", c("lead.set")).alias("b"))
    linked = saved(links(overlaps(pairs.select("a", "b").union(star.where("a <> b")).distinct(), texts, char_sets)))
    found = components(linked)
    placed = saved(lists.join(found, c("set") == c("node"), "left").select("tok", "set", F.coalesce("component", "set").alias("comp")))
    # from counts by list and component, so that no task gathers a band; the join below can be split
    comp = placed.groupBy("tok", "comp").agg(F.count("*").alias("n"))
    main = heads.select("tok", "rows", c("lead.set").alias("lead")).join(found, c("lead") == c("node"), "left").select("tok", "rows", F.coalesce("component", "lead").alias("main"))
    outside = comp.join(main, "tok").groupBy("tok", "rows", "main").agg(F.sum(F.when(c("comp") != c("main"), c("n")).otherwise(0)).alias("outside")).where("outside > 0")
    # a list of two was decided by the pair
    open_ = saved(placed.join(outside.where("rows > 2"), "tok"))
    more = saved(blocks(open_, texts))
    discard(placed, open_)
    return components(linked.union(more))


def groups(docs: DataFrame) -> DataFrame:
    """line, component for every line (by hash) that is alike to another but not equal."""
    c = F.col
    signed = saved(signatures(docs))
    # met by minima with map-side combining: no task gathers a band
    heads = signed.select(F.explode("keys").alias("tok"), "set").groupBy("tok").agg(F.min("set").alias("b"), F.max("set").alias("a"), F.count("*").alias("rows")).where("a <> b")
    heads = saved(heads)
    # two rows are two lines; more may be fewer than that, as each task signs a line
    pairs = heads.where("rows = 2").select("a", "b").distinct()
    lists = saved(of_bands(signed, heads.where("rows > 2")))
    wanted = saved(pairs.select(c("a").alias("set")).union(pairs.select("b")).union(lists.select("set")).distinct())
    discard(signed)
    texts = saved(_per_chunk(docs, _texts(sieve(wanted)), "set long, text string").join(wanted, "set", "left_semi").dropDuplicates(["set"]))
    return settle(pairs, lists, texts).select(c("node").alias("line"), "component")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, kept for every line with a word: whether it is the first of its group."""
    seen = saved(_per_chunk(docs, _occurrences, "line long, doc_id long, line_no int"))
    uses = seen.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("uses"))
    placed = saved(uses.join(groups(docs), "line", "left").where("uses > 1 or component is not null").withColumn("component", F.coalesce("component", "line")))
    best = placed.groupBy("component").agg(F.min(F.struct("first", "line")).alias("best")).select("best.first", "best.line")
    # joined by line, never by component: a group may hold a large share of all lines
    marked = saved(placed.select("line").join(best, "line", "left").withColumn("many", F.lit(True)))
    judged = seen.join(marked, "line", "left")
    kept = F.col("many").isNull() | F.coalesce(F.col("first") == F.struct("doc_id", "line_no"), F.lit(False))
    return judged.select("doc_id", "line_no", kept.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """For every document: doc_id, n_lines (with a word), n_dropped, and the numbers of the dropped lines."""
    gone = F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))))
    lines = judge(docs).groupBy("doc_id").agg(F.size(F.collect_set("line_no")).cast("long").alias("n_lines"), gone.alias("dropped"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(lines, "doc_id", "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without the lines that are not the first of their group.

    A document that loses all of its lines with a word goes; one that had none stays as it is. n_chars, where there is such a column, follows.
    """
    tag = "_"
    while any(c.startswith(tag) for c in docs.columns):  # names that no column of the input has
        tag += "_"
    doc, lost, some = tag + "doc", tag + "lost", tag + "some"
    lines = judge(docs).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias(lost), F.max("kept").alias(some))
    joined = docs.join(lines.where(F.size(lost) > 0), F.col("doc_id") == F.col(doc), "left").where(F.col(doc).isNull() | F.col(some))
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(lost, k)), "\n")
    text = F.when(F.col(doc).isNull(), F.col("text")).otherwise(rest)
    out = joined.withColumn("text", text).drop(doc, lost, some)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
