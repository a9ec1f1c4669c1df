"""Exact n-gram Jaccard join with set-relation skipping.

Index lists by position: each set's elements stand in one fixed order, rarest first, and the
head of a set goes to the lists of its elements together with position and size. Whatever
position or size rules out is skipped without a look at the sets: two sets that link have at
least 4/9 of their summed sizes in common, so neither can have its first common element
further back. A passage that many documents share stands last in each, and is in a list only
where it makes up nearly all of a document.

The order comes from a table of fixed size, which holds about how often a shingle is met
again, in levels. What is not in it, or falls on another's place, changes the order and so the
work, never the answer.

Answers from a similar set: the sets of a list are first compared with one leader only, the
one whose elements are most common, which is the middle of a group of near copies. What links with the leader takes
over its component, so pairs within it need no comparison; only pairs of different components
are compared with each other.

Exact copies are one set: they share a hash of the whole set and are never expanded.

Edge cases: null, empty and blank texts have an empty set, linked with nothing, and are
their own components; with fewer than five words the whole sequence is the one shingle;
a row repeated with the same doc_id and text counts once; rows of one doc_id with different
texts are a row each, and what any of them links with is linked; rows without a doc_id are left
out; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components, discard, in_sieve, saved, sieve

WIDTH = 5
#: Two sets link at this similarity in percent.
PERCENT = 80
#: Places in the table of levels, the most that the driver fetches for it, and bits by which a task knows a shingle again.
SLOTS, FILLED, SEEN = 1 << 22, 1 << 20, 1 << 27
#: A shingle met again fewer times than this has level 0.
AGAIN = 3


def sets_of(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and offsets."""
    data, offsets = K.utf8(column)
    n = len(offsets) - 1
    data = K.LOWER[data]
    start, end, row = K.words(data, offsets)
    values, of = K.shingles(K.Rolling(data).spans(start, end), row, n, width)
    return K.distinct(values, of, n)


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each set, from all of its elements."""
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(values ^ K.U64(0x5851F42D4C957F2D)), dtype=K.U64)])
    return K.mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(K.U64))


def identity(values: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The hash of each set; an empty one goes by its document, as it links with nothing."""
    return np.where(np.diff(at) > 0, set_hash(values, at), K.mix(ids.astype(K.U64) ^ K.U64(0xA0761D6478BD642F)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def met_again(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tok, uses: shingles that a task meets again in other documents, and how often; doc_id, set, n of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SEEN >> 3, np.uint8)
        for batch in batches:
            sizes = K.utf8(batch.column("text"))[1]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in K.chunks(sizes):
                values, at = sets_of(batch.column("text")[a:b])
                tok, uses = np.unique(values, return_counts=True)
                place, bit = ((tok & K.U64(SEEN - 1)) >> K.U64(3)).astype(np.int64), (1 << (tok & K.U64(7))).astype(np.uint8)
                again = (uses > 1) | ((seen[place] & bit) > 0)
                np.bitwise_or.at(seen, place, bit)
                own = identity(values, at, ids[a:b])
                m = int(again.sum())
                cols = [np.concatenate([tok[again], own]).view(np.int64), np.concatenate([uses[again], np.diff(at)]).astype(np.int32)]
                doc = pa.array(np.concatenate([np.zeros(m, np.int64), ids[a:b]]), mask=np.arange(m + b - a) < m)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), doc], ["tok", "uses", "doc_id"])

    both = saved(_rows(docs).mapInArrow(K.lean(run), "tok long, uses int, doc_id long"))
    members = both.where("doc_id is not null").select("doc_id", F.col("tok").alias("set"), F.col("uses").alias("n")).distinct()
    return both.where("doc_id is null").select("tok", "uses"), members


def levels(uses: DataFrame) -> np.ndarray:
    """The level of each place: the logarithm of how often its commonest shingle is met again, 0 for what is rarer than the FILLED commonest."""
    level = F.least(F.lit(255), 1 + F.floor(4 * F.log2("uses"))).cast("int")
    often = uses.groupBy("tok").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= AGAIN)
    by_slot = saved(often.groupBy(F.shiftrightunsigned("tok", 64 - SLOTS.bit_length() + 1).cast("int").alias("slot")).agg(F.max(level).alias("level")))
    total, least = 0, 256
    for r in sorted(by_slot.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > FILLED:
            break
        least = r["level"]
    out = np.zeros(SLOTS, np.uint8)
    found = by_slot.where(F.col("level") >= least).toArrow()
    out[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    discard(by_slot)
    return out


def postings(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """tok, set, n, rank, often, score: the head of each set, rarest first.

    Of a set of n elements, floor(n / 5) + 1 are listed: two sets of Jaccard 0.8 or more can't both miss all of
    these. score is the mean level of the set. Within a chunk of documents only the first of equal sets is listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes = K.utf8(batch.column("text"))[1]
            for a, b in K.chunks(sizes):
                values, at = sets_of(batch.column("text")[a:b])
                n = np.diff(at)
                own = set_hash(values, at)
                first = np.zeros(b - a, bool)
                first[np.unique(own, return_index=True)[1]] = True
                row = np.repeat(np.arange(b - a), n)
                level = table[values >> K.U64(64 - SLOTS.bit_length() + 1)]
                score = np.bincount(row, level, b - a) / np.maximum(n, 1)
                order = np.argsort(row << 8 | level, kind="stable")  # within a level by hash
                rank = np.arange(len(values)) - np.repeat(at[:-1], n)
                keep = rank < np.repeat(np.where(first, n // 5 + 1, 0), n)
                row, rank, order = row[keep], rank[keep], order[keep]
                cols = [values[order].view(np.int64), own[row].view(np.int64), n[row].astype(np.int32), rank.astype(np.int32), level[order] > 0, score[row].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tok", "set", "n", "rank", "often", "score"])

    return _rows(docs).mapInArrow(K.lean(run), "tok long, set long, n int, rank int, often boolean, score float")


def overlaps(pairs: DataFrame, texts: DataFrame, sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """a, b, n_a, n_b, common: exact set sizes and intersection of each pair, from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = K.utf8(batch.column("text_a"))[1] + K.utf8(batch.column("text_b"))[1]
            for lo, hi in K.chunks(size):
                (x, at), (y, by) = sets(batch.column("text_a")[lo:hi]), sets(batch.column("text_b")[lo:hi])
                common = np.zeros(hi - lo, np.int64)
                for k in range(hi - lo):
                    p, q = x[at[k] : at[k + 1]], y[by[k] : by[k + 1]]
                    if len(p) and len(q):
                        both = np.concatenate([p, q])
                        both.sort()
                        common[k] = np.count_nonzero(both[1:] == both[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("a")[lo:hi], batch.column("b")[lo:hi], pa.array(np.diff(at).astype(np.int32)), pa.array(np.diff(by).astype(np.int32)), pa.array(common)], ["a", "b", "n_a", "n_b", "common"])

    with_a = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(K.lean(run), "a long, b long, n_a int, n_b int, common long")


def links(measured: DataFrame, percent: int = PERCENT) -> DataFrame:
    return measured.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def possible(n: Column, rank: Column, m: Column, other: Column) -> Column:
    """Whether sets of n and m elements can link whose first common element stands at these ranks."""
    return ((100 + PERCENT) * F.least(n - rank, m - other) >= PERCENT * (n + m)) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def lists_of(rows: DataFrame) -> DataFrame:
    """The lists that hold two sets or more, with the set, size and rank of each list's leader.

    Lists of rare shingles are short and sorted in place. Those of common ones are met by counts with
    map-side combining and a join that can split them, so no task gathers a list.
    """
    c = F.col
    lead = F.min(F.struct((-c("score")).alias("score"), "set", "n", "rank"))
    by_list = Window.partitionBy("tok")
    short = rows.where("not often").withColumns({"lead": lead.over(by_list), "least": F.min("set").over(by_list), "most": F.max("set").over(by_list)})
    often = rows.where("often").dropDuplicates(["tok", "set"])
    heads = often.groupBy("tok").agg(lead.alias("lead"), F.min("set").alias("least"), F.max("set").alias("most")).where("least <> most")
    both = short.where("least <> most").unionByName(often.join(heads, "tok"))
    return both.select("tok", "set", "n", "rank", c("lead.set").alias("lead"), c("lead.n").alias("n_lead"), c("lead.rank").alias("rank_lead")).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach, itself included."""
    c = F.col
    uses, members = met_again(docs)
    table = levels(uses)
    raw = saved(postings(docs, table))
    lists = saved(lists_of(raw))
    discard(raw)
    # a set goes by its least doc_id, so that the least node of a component is its component_id
    firsts = saved(members.groupBy("set", "n").agg(F.min("doc_id").alias("id")))

    def texts_of(sets: DataFrame) -> DataFrame:
        """set, id, text, found by doc_id and checked by hash, as a doc_id can have several texts."""
        ids = firsts.join(sets, "set", "left_semi").select("id", "set")
        bits = sieve(ids.select("id"))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = batch.filter(pa.array(in_sieve(bits, batch.column("doc_id").to_numpy(zero_copy_only=False))))
                for a, b in K.chunks(K.utf8(some.column("text"))[1]):
                    part = some.slice(a, b - a)
                    own = identity(*sets_of(part.column("text")), part.column("doc_id").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.view(np.int64)), part.column("text")], ["id", "set", "text"])

        some = _rows(docs).mapInArrow(K.lean(pick), "id long, set long, text string")
        return some.join(ids, ["id", "set"]).dropDuplicates(["set"])

    def measure(pairs: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The pairs, which of them link, by id, and the texts so far."""
        pairs = saved(pairs)
        wanted = pairs.select(c("a").alias("set")).union(pairs.select("b")).distinct()
        if texts is None:
            texts = saved(texts_of(wanted))
        else:
            missing = saved(wanted.join(texts, "set", "left_anti"))
            texts = texts if missing.isEmpty() else texts.unionByName(saved(texts_of(missing)))
        found = saved(links(overlaps(pairs, texts, sets_of)))
        return pairs, found, texts

    def by_id(edges: DataFrame) -> DataFrame:
        id_of = lambda name: firsts.select(c("set").alias(name), c("id").alias(f"id_{name}"))
        return edges.join(id_of("a"), "a").join(id_of("b"), "b").select(c("id_a").alias("a"), c("id_b").alias("b"))

    star = lists.where((c("set") != c("lead")) & possible(c("n"), c("rank"), c("n_lead"), c("rank_lead")))
    star, linked, texts = measure(star.select(F.greatest("set", "lead").alias("a"), F.least("set", "lead").alias("b")).distinct(), None)
    found = components(by_id(linked))
    comp = firsts.join(found, c("id") == c("node"), "left").select("set", F.coalesce("component", "id").alias("comp"))
    placed = saved(lists.join(comp, "set"))
    over = placed.groupBy("tok").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.when(c("set") == c("lead"), c("comp"))).alias("main")).where("least <> most")
    open_ = saved(placed.join(over.select("tok", "main"), "tok").select("tok", "set", "n", "rank", "comp", "main"))
    discard(lists, placed)
    x, y = open_.where("comp <> main").alias("x"), open_.alias("y")
    # of two sets outside the main component only one order is kept
    once = (c("y.comp") == c("y.main")) | (c("x.set") < c("y.set"))
    apart = x.join(y, (c("x.tok") == c("y.tok")) & (c("x.comp") != c("y.comp")) & possible(c("x.n"), c("x.rank"), c("y.n"), c("y.rank")) & once)
    rest = apart.select(F.greatest("x.set", "y.set").alias("a"), F.least("x.set", "y.set").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    _, more, _ = measure(rest, texts)
    found = components(by_id(linked.union(more)))
    named = firsts.join(found, c("id") == c("node"), "left").select("set", F.coalesce("component", "id").alias("component_id"))
    return members.join(named, "set").select("doc_id", c("n").cast("long").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents of which each is the first of its component: one of each group of near copies stays.

    Rows of one doc_id are one document; of several, the one with the least text stays.
    """
    first = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    many = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    tag = "_"
    while tag in docs.columns:
        tag += "_"
    one = kept.join(many, "doc_id", "left_semi").withColumn(tag, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(tag) == 1).drop(tag)
    return kept.join(many, "doc_id", "left_anti").unionByName(one)
