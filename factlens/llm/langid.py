"""Language identification by a byte convolutional network in numpy.

Filters of widths 2, 3 and 4 run over windows of fixed length, each is max-pooled over the
window, and a softmax layer gives the language; a text's answer is the mean over all of
its windows. On one-hot bytes a filter is a sum of table rows, so two neighbouring
positions fold into one lookup, and inference is a few gathers for each byte.

Edge cases: a null text, an empty one or one without a letter is `und` with score 0.0;
equal texts get equal answers; with no labelled rows every text is `und`. Of languages with
equal probability the first by name wins. All windows of a text count, by their bytes,
however long it is. A null doc_id is not held out, repeated rows are repeated, an empty
table gives an empty one, and further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, saved
from . import kernels as K

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 64
#: The fit reads at most about this many documents of each language, LANGUAGES at most, VIEWS windows of each.
SAMPLE, LANGUAGES, VIEWS = 600, 200, 3
BLOCK = 64
#: Share of rightly known held-out documents whose score may lie below the least that keep_known asks for.
LOSS = 0.005
#: Bits of a score by which one round of quantile() counts.
DIGIT = 16


def byte_classes() -> np.ndarray:
    """Bytes to 64 classes: pad 0, space, digits, marks, letters without case, UTF-8 lead and continuation bytes."""
    out = np.zeros(256, np.int64)
    out[33:127] = 3
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = 2
    out[65:91] = out[97:123] = np.arange(4, 30)
    out[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    out[0xC3], out[0xC0:0xC3], out[0xC4:] = 30, 31, 31
    return out


_CLASS = byte_classes()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.RandomState(seed)
        self.languages = languages
        self.taps = [[r.normal(0, 0.3, (CLASSES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.fold()

    def fold(self) -> None:
        """Tables for pairs of neighbouring classes, the form in which filters are applied."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        self.tables = [[pair(t[k], t[k + 1]) if k + 1 < w else t[k] for k in range(0, w, 2)] for w, t in zip(WIDTHS, self.taps, strict=True)]

    def convolve(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Filters of width WIDTHS[k] at every position that fits, for windows of class codes."""
        w, n = WIDTHS[k], codes.shape[1] - WIDTHS[k] + 1
        pairs = codes[:, :-1] * CLASSES + codes[:, 1:]
        total = np.take(self.tables[k][0], pairs[:, :n], axis=0)
        for j in range(2, w, 2):
            total += np.take(self.tables[k][j // 2], (pairs if j + 1 < w else codes)[:, j : j + n], axis=0)
        return total

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Language probabilities for each window."""
        pooled = np.empty((len(codes), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(codes), BLOCK):
            for k in range(len(WIDTHS)):
                pooled[a : a + BLOCK, k * FILTERS : (k + 1) * FILTERS] = self.convolve(codes[a : a + BLOCK], k).max(1) + self.bias[k]
        return softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)

    def train(self, codes: np.ndarray, label: np.ndarray, steps: int = 400, batch: int = 48, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross-entropy; through max pooling the gradient reaches one position for each filter."""
        r = np.random.RandomState(seed)
        params = [t for taps in self.taps for t in taps] + self.bias + [self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        column = np.arange(FILTERS)
        for step in range(1, steps + 1):
            pick = r.randint(0, len(codes), batch)
            x, y = codes[pick], label[pick]
            where, pooled = [], np.empty((batch, FILTERS * len(WIDTHS)), np.float32)
            for k in range(len(WIDTHS)):
                conv = self.convolve(x, k)
                where.append(conv.argmax(1))
                pooled[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(conv, where[k][:, None, :], 1)[:, 0] + self.bias[k]
            active = np.maximum(pooled, 0)
            error = softmax(active @ self.out + self.out_bias)
            error[np.arange(batch), y] -= 1
            error /= batch
            back = (error @ self.out.T) * (pooled > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    grads.append(np.zeros((CLASSES, FILTERS), np.float32))
                    np.add.at(grads[-1], (np.take_along_axis(x, where[k] + j, 1), np.broadcast_to(column, g.shape)), g)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
            grads += [active.T @ error, error.sum(0)]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.fold()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class codes of all windows of all rows, the row of each, and the bytes in each."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    start = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[row + 1][:, None]
    codes = np.where(inside, _CLASS[data[np.minimum(at, max(len(data) - 1, 0))]], 0) if len(data) else np.zeros((0, WINDOW), np.int64)
    return codes, row, inside.sum(1)


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return out


def held_out() -> Column:
    """crc32 of doc_id as text is divisible by 5: such documents are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def junk(n: int, seed: int = 3) -> list[str]:
    """Texts of one window without a language: words of letters drawn at random, and long runs of letters and digits."""
    r = np.random.RandomState(seed)
    small, every = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    return ["".join(r.choice(every, WINDOW)) if k % 3 == 2 else " ".join("".join(r.choice(small, r.randint(1, 11))) for _ in range(WINDOW // 4))[:WINDOW] for k in range(n)]


def fit(docs: DataFrame, reject: bool = False) -> Network:
    """Train on a bounded sample of labelled documents that are not held out; with `reject` also on junk, which is `und`.

    The bound: at most LANGUAGES languages (the most frequent), SAMPLE documents expected of each (drawn by a
    hash of doc_id), VIEWS windows of WINDOW characters of each, at positions drawn likewise.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Network([UNKNOWN])
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE / r["count"]))))
    draw = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.lit(1_000_003))
    # so that a language with few rows still gives all of them, and a frequent one no more than its share
    chosen = labelled.where(draw(0) < F.element_at(share, F.col("lang")) * 1_000_003)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    views = F.array(*(F.substring(F.col("text"), F.pmod(draw(k), room).cast("int") + 1, F.lit(WINDOW)) for k in range(1, VIEWS + 1)))
    rows = sorted((r["doc_id"], r["lang"], r["view"]) for r in chosen.select("doc_id", "lang", F.explode(F.array_distinct(views)).alias("view")).collect())
    rows = [r for r in rows if any(c.isalpha() for c in r[2])]
    if not rows:
        return Network([UNKNOWN])
    if reject:
        rows += [(None, UNKNOWN, t) for t in junk(2 * SAMPLE)]
    languages = sorted({r[1] for r in rows})
    data, offsets = K.utf8(pa.array([r[2] for r in rows]))
    codes, row, _ = windows(data, offsets)
    label = np.array([languages.index(rows[i][1]) for i in row])
    # as many windows of each language
    rng = np.random.RandomState(5)
    most = np.bincount(label).max()
    even = np.concatenate([rng.choice(np.flatnonzero(label == k), most) for k in range(len(languages))])
    net = Network(languages)
    if len(languages) > 1:
        net.train(codes[even], label[even])
    return net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) from whole texts; the network is a few kB and goes with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge_texts(batch.column("text"), net)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), "doc_id long, lang_pred string, score double")


def judge_texts(column: pa.Array, net: Network) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    data, offsets = K.utf8(column)
    pred: list[str] = []
    scores = np.zeros(len(column))
    for a, b in K.chunks(offsets, 1 << 18):
        at = offsets[a : b + 1]
        total = np.zeros((b - a, len(net.languages)))
        for lo in range(0, 1 + int((at[-1] - at[0]) // WINDOW) + (b - a), 4096):
            codes, row, size = _some(data, at, lo, 4096)
            if not len(row):
                break
            np.add.at(total, row, net.predict(codes) * size[:, None])
        total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
        best = total.argmax(1)
        known = has_letter(column[a:b], data[at[0] : at[-1]], at - at[0]) & (net.languages != [UNKNOWN])
        pred += [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
        scores[a:b] = np.where(known, np.clip(total[np.arange(b - a), best], 0, 1), 0.0)
    return pred, scores


def keep_known(docs: DataFrame, net: Network, least: float) -> DataFrame:
    """The documents whose language is known with at least this score; rows pass through in place, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge_texts(batch.column("text"), net)
            yield batch.filter(pa.array((np.array(pred, object) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(K.lean(run), docs.schema)


def least_score(docs: DataFrame, net: Network) -> float:
    """The score that all but LOSS of the rightly known documents reach, from all labelled ones that were not learned from.

    The score of a network that knows nothing counts as one more document, so few documents set no strict limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judge_texts(batch.column("text"), net)
            right = np.array(pred, object) == np.array(batch.column("lang").to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(score[right])], ["score"])

    labelled = docs.where((F.col("lang") != UNKNOWN) & held_out())
    right = saved(labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(K.lean(run), "score double"))
    least = quantile(right, 1 / len(net.languages), LOSS)
    discard(right)
    return least


def quantile(scores: DataFrame, more: float, share: float) -> float:
    """np.quantile of a column of scores from 0 up and of one score more, exactly and without gathering them.

    The bits of such doubles are in the order of their values, so a value of given rank is found by counting
    leading bits, DIGIT further ones in each round; the driver sees at most 2^DIGIT counts for each of two ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # adding 0.0 makes a negative zero a positive one
            yield pa.RecordBatch.from_arrays([pa.array((batch.column(0).to_numpy(zero_copy_only=False) + 0.0).view(np.int64))], ["bits"])

    bits = scores.mapInArrow(run, "bits long")
    extra = int(np.array([more]).view(np.int64)[0])
    at = share * scores.count()
    low = int(at)
    found = [(0, low), (0, low + (at > low))]
    for shift in range(64 - DIGIT, -1, -DIGIT):
        left = sorted({prefix for prefix, _ in found})
        among = bits if shift + DIGIT == 64 else bits.where(F.shiftright("bits", shift + DIGIT).isin(left))
        counts = Counter({r["lead"]: r["count"] for r in among.groupBy(F.shiftright("bits", shift).alias("lead")).count().collect()})
        counts[extra >> shift] += 1
        found = [_of_rank(counts, prefix, rank) for prefix, rank in found]
    a, b = np.array([prefix for prefix, _ in found]).view(np.float64)
    return float(a + (b - a) * (at - low))


def _of_rank(counts: Counter[int], prefix: int, rank: int) -> tuple[int, int]:
    """Of the leading bits that begin with this prefix, those that hold the value of this rank, and its rank among them."""
    for lead in sorted(counts):
        if lead >> DIGIT == prefix:
            if rank < counts[lead]:
                return lead, rank
            rank -= counts[lead]
    raise ValueError("no value of this rank")


def _some(data: np.ndarray, offsets: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows first to first + n of the rows."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    ends = np.cumsum(each)
    k = np.arange(first, min(first + n, int(ends[-1]) if len(ends) else 0))
    row = np.searchsorted(ends, k, "right")
    start = offsets[row] + WINDOW * (k - (ends - each)[row])
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[row + 1][:, None]
    codes = np.where(inside, _CLASS[data[np.minimum(at, len(data) - 1)]], 0) if len(k) else np.zeros((0, WINDOW), np.int64)
    return codes, row, inside.sum(1)
