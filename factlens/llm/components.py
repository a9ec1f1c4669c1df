"""Connected components by folding and star rounds, and sieves that spare rows the way into a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, saved
from . import kernels as K

#: Rows in an Arrow batch. Texts can be long, so far fewer than Spark's own 10,000 keep a batch to a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Bits in a sieve: its size, 2 MB, does not depend on the data.
SIEVE = 1 << 24


def sieve(values: DataFrame) -> np.ndarray:
    """A bit table of a column of longs. A value whose bit is not set is not among them; one whose bit is set may not be either.

    It only spares rows the way into a join and never decides one; when it fills up, it spares less.
    """
    bit = F.col(values.columns[0]).bitwiseAND(SIEVE - 1)
    parts = values.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    out = np.zeros(SIEVE + 32768, bool)
    for r in parts.collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        first = (r["bucket"] - 1) * 32768 + 1 if r["bucket"] > 0 else 0
        out[first : first + len(own)] |= own.astype(bool)
    return np.packbits(out, bitorder="little")


def in_sieve(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & (SIEVE - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: Edges that a task folds at once, about 16 MB.
FOLD = 1 << 20


def fold(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task folded, FOLD at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)

    def folded() -> tuple[np.ndarray, np.ndarray]:
        return fold(*(np.concatenate([none, *(h[k] for h in held)]) for k in (0, 1)))

    for batch in parts:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        if sum(len(h[0]) for h in held) >= FOLD:
            u, v = folded()
            held = []
            if 2 * len(u) < FOLD:
                held = [(u, v)]
            else:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    if held:
        u, v = folded()
        for k in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges(a, b).

    Tasks of about FOLD edges first fold their own edges, then large-star and small-star rounds
    link every node to the least node of its component; both group by minimum with map-side
    combining, so a node with very many neighbours is never gathered. A round's edges are
    written to the shared folder. The number of rounds grows with the logarithm of the
    size; if they did not suffice the function raises rather than return a partial answer.
    """
    raw = saved(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v"))
    tasks = max(1, -(-raw.count() // FOLD))
    e = saved(raw.coalesce(tasks).mapInArrow(K.lean(forest), "u long, v long"))
    discard(raw)
    for _ in range(rounds):
        # done when the edges are stars: one edge for each u, and no centre that is itself a u
        if tasks == 1 or _stars(e):
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, e = e, saved(down.union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
    raise RuntimeError("components did not settle")


def _stars(e: DataFrame) -> bool:
    state = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
    return state["n"] == state["u"] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
