"""Substring deduplication by winnowed anchors.

Every window of ``window`` words chooses an anchor: the word sequence of length
``gram`` inside it with the least hash (winnowing), so equal windows choose
equal anchors at equal offsets. Neighbouring windows mostly choose the same
one; the stretch of text that these windows cover is the anchor's *cell*, the
anchor extended both ways as far as it is chosen.

1. Anchors are grouped. One that occurs once owns no repeat. Where all its
   cells are equal, whole cells repeat, and the smallest doc_id has the first.
2. Where cells of an anchor differ, a repeat begins or ends inside one. Only
   there the windows themselves are grouped, which gives its exact ends.
3. Each document gets what was found about its anchors and windows and removes
   the union of its windows that also start earlier: maximal repeats.

Groups are reduced by aggregates with map-side combination (a count and least
or greatest values), never gathered; hot anchors meet their result in a join
that can split them. Hashes compared are of 128 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import NULL_ID, id_and_text, raw_texts, slices
from .perfect_hash import mix

WINDOW, GRAM = 20, 8
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
LATER, FIRST, MIXED = 1, 2, 3
WHOLE = "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<start: int, end: int>>"
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long"


def _rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each ``length`` consecutive values, by doubling."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, size = None, 0, values, 1
    left = length
    while True:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out + part * _power(done)
            done += size
        left >>= 1
        if not left:
            return out
        block = block[:-size] + block[size:] * _power(size)
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """Position of the least of each ``length`` consecutive values, the leftmost of equal ones."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(values)), 1
    while 2 * size <= length:
        a, b = at[:-size], at[size:]
        at = np.where(values[b] < values[a], b, a)
        size *= 2
    if size < length:
        a, b = at[:n], at[length - size : length - size + n]
        at = np.where(values[b] < values[a], b, a)
    return at[:n]


class Cells:
    """Words, windows and cells of some texts, one after another."""

    def __init__(self, raw: list[bytes], window: int, gram: int):
        self.words = [t.split() for t in raw]
        count = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(count) - count
        flat = b"".join([xxh3_128_digest(w) for words in self.words for w in words])
        both = np.frombuffer(flat, "<u8").reshape(-1, 2)
        self.one, self.two = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        self.window = window
        grams = mix(_rolling(self.one, gram))
        least = _least(grams, window - gram + 1)
        doc = np.repeat(np.arange(len(raw)), np.maximum(count - window + 1, 0))
        before = np.cumsum(np.maximum(count - window + 1, 0)) - np.maximum(count - window + 1, 0)
        self.start = np.arange(len(doc)) - np.repeat(before, np.maximum(count - window + 1, 0)) + self.first[doc]
        self.doc = doc
        anchor = least[self.start]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.cell = np.cumsum(new) - 1  # of each window
        self.cell_doc = doc[at]
        low = self.start[at]
        high = self.start[np.r_[at[1:], len(doc)] - 1] + window if len(at) else low
        where = anchor[at]
        self.anchor = grams[where].view(np.int64)
        sums = np.r_[np.uint64(0), np.cumsum(self.two * _powers(_P, len(self.two)))]
        body = (sums[high] - sums[low]) * _powers(_PINV, len(self.two) + 1)[low]
        shape = ((high - low).astype(np.uint64) << np.uint64(20)) + (where - low).astype(np.uint64)
        self.content = mix(body ^ mix(shape + _P)).view(np.int64)

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_rolling(x, self.window)[self.start].view(np.int64) for x in (self.one, self.two))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _codes(cells: Cells, anchors: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    """What was found about each cell's anchor; 0 where it occurs once."""
    out = np.zeros(len(cells.anchor), np.int8)
    ends = np.searchsorted(cells.cell_doc, np.arange(len(anchors) + 1))
    for d, (known, code) in enumerate(zip(anchors, codes, strict=True)):
        if len(known):
            order = np.argsort(known, kind="stable")
            mine = cells.anchor[ends[d] : ends[d + 1]]
            at = np.minimum(np.searchsorted(known[order], mine), len(known) - 1)
            out[ends[d] : ends[d + 1]] = np.where(known[order][at] == mine, code[order][at], 0)
    return out


def _first_of_equal(doc: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Marks the first of equal windows of one document."""
    order = np.lexsort((np.arange(len(doc)), two, one, doc))
    d, a, b = doc[order], one[order], two[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(d) else np.zeros(0, bool)
    out = np.zeros(len(doc), bool)
    out[order[first]] = True
    return out


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """Removes each word covered by a window of words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document;
    windows are judged on the input. Null texts have no words; a null doc_id
    counts as the largest. Rows that share a doc_id do not remove each other;
    each has its own row key, so however many there are, none is gathered.
    Returns one row per input row: the kept words joined by one blank and the
    removed word ranges, or their digests.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, unique = _with_row_keys(id_and_text(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text"))
    # where ids are unique the row key is the doc, and is sent once
    names = ["row"] if unique else ["row", "doc"]
    doc, types = names[-1], ", ".join(f"{c} long" for c in names)

    def anchors(batches):
        for part in slices(batches, 256):
            cells = Cells(raw_texts(part["text"]), window, gram)
            whose = pa.array(cells.cell_doc)
            yield pa.RecordBatch.from_arrays([pa.array(cells.anchor), pa.array(cells.content), *(part[c].take(whose) for c in names)], names=["anchor", "content", *names])

    found = keyed.mapInArrow(anchors, f"anchor long, content long, {types}")
    groups = (
        found.groupBy("anchor")
        .agg(F.count("*").alias("n"), (F.min("content") == F.max("content")).alias("same"), F.min(doc).alias("least"))
        .filter("n > 1")
        .select(F.col("anchor").alias("known"), "same", "least")
        .repartition(n)
    )
    code = F.when(~F.col("same"), MIXED).when(F.col("least") == F.col(doc), FIRST).otherwise(LATER).cast("tinyint")
    told = found.select("anchor", *names).join(groups, F.col("anchor") == F.col("known")).select("row", "anchor", code.alias("code"))
    told = told if unique else told.distinct()  # equal rows have one key
    by_row = told.groupBy("row").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("code").alias("codes")).withColumnRenamed("row", "told_row")

    texts = keyed.repartition(n, "row")  # one shuffle of the texts; both joins below reuse it

    def ends(batches):
        for part in slices(batches, 256):
            cells = Cells(raw_texts(part["text"]), window, gram)
            mixed = _codes(cells, _lists(part["anchors"]), _lists(part["codes"])) == MIXED
            take = mixed[cells.cell]
            one, two = (h[take] for h in cells.window_hashes())
            whose = cells.doc[take]
            first = _first_of_equal(whose, one, two)
            mine = pa.array(whose[first])
            yield pa.RecordBatch.from_arrays([pa.array(one[first]), pa.array(two[first]), *(part[c].take(mine) for c in names)], names=["one", "two", *names])

    with_mixed = by_row.filter(F.array_contains("codes", F.lit(MIXED).cast("tinyint")))
    inner = texts.join(with_mixed, F.col("row") == F.col("told_row")).select(*names, "text", "anchors", "codes")
    windows = inner.mapInArrow(ends, f"one long, two long, {types}")
    repeated = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(doc).alias("least")).filter("n > 1")
    repeated = repeated.select(F.col("one").alias("one_r"), F.col("two").alias("two_r"), "least").repartition(n)
    later = windows.join(repeated, (F.col("one") == F.col("one_r")) & (F.col("two") == F.col("two_r"))).filter(F.col(doc) != F.col("least")).select("row", "one", "two")
    later = later if unique else later.distinct()
    later_by_row = later.groupBy("row").agg(F.collect_list("one").alias("ones"), F.collect_list("two").alias("twos")).withColumnRenamed("row", "later_row")

    def remove(batches):
        for part in slices(batches, 256):
            yield _removed(part, window, gram, digests)

    whole = (
        texts.join(by_row, F.col("row") == F.col("told_row"), "left")
        .join(later_by_row, F.col("row") == F.col("later_row"), "left")
        .select(F.col(doc).alias("doc"), "text", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("anchors", "array<long>"), ("codes", "array<tinyint>"), ("ones", "array<long>"), ("twos", "array<long>"))])
    )
    return whole.mapInArrow(remove, DIGESTS if digests else WHOLE)


#: Up to this many repeated ids are broadcast to mark their rows; more are joined by shuffling.
MOST_REPEATED = 100_000


def _with_row_keys(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``(row, text)`` and True where each doc has one row: it is the row's key.

    Else ``(row, doc, text)`` and False: rows of a repeated doc have a hash of doc
    and text as their key, so that they are not gathered.
    """
    repeated = rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("again"))
    n = repeated.limit(MOST_REPEATED + 1).count()
    if not n:
        return rows.select(F.col("doc").alias("row"), "text"), True
    marked = rows.join(F.broadcast(repeated) if n <= MOST_REPEATED else repeated, F.col("doc") == F.col("again"), "left")
    return marked.select(F.when(F.col("again").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", "text")).alias("row"), "doc", "text"), False


def _removed(part: pa.RecordBatch, window: int, gram: int, digests: bool) -> pa.RecordBatch:
    cells = Cells(raw_texts(part["text"]), window, gram)
    code = _codes(cells, _lists(part["anchors"]), _lists(part["codes"]))[cells.cell]
    gone = code == LATER
    some = np.flatnonzero((code == FIRST) | (code == MIXED))
    one, two = (h[some] for h in cells.window_hashes())
    again = ~_first_of_equal(cells.doc[some], one, two)
    ends = np.searchsorted(cells.doc[some], np.arange(part.num_rows + 1))
    for d, (ones, twos) in enumerate(zip(_lists(part["ones"]), _lists(part["twos"]), strict=True)):
        if len(ones):
            a, b = ends[d], ends[d + 1]
            pairs = np.stack([np.r_[ones, one[a:b]], np.r_[twos, two[a:b]]], axis=1)
            _, same = np.unique(pairs, axis=0, return_inverse=True)
            same = same.reshape(-1)
            again[a:b] |= np.isin(same[len(ones) :], same[: len(ones)])
    gone[some] |= again
    edge = np.zeros(len(cells.one) + 1, np.int64)
    np.add.at(edge, cells.start[gone], 1)
    np.add.at(edge, cells.start[gone] + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    n, removed, kept, ranges = [], [], [], []
    for words, first in zip(cells.words, cells.first.tolist(), strict=True):
        mine = covered[first : first + len(words)]
        n.append(len(words))
        removed.append(int(mine.sum()))
        kept.append(b" ".join([w for w, x in zip(words, mine.tolist(), strict=True) if not x] if removed[-1] else words))
        change = np.flatnonzero(np.diff(np.r_[0, mine.astype(np.int8), 0]))
        ranges.append(change.reshape(-1, 2))
    ids = [None if d == NULL_ID else d for d in part["doc"].to_pylist()]
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    if digests:
        columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        columns["n_repeats"] = pa.array([len(r) for r in ranges], pa.int64())
    else:
        columns["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
        spans = [[{"start": a, "end": b} for a, b in r.tolist()] for r in ranges]
        columns["repeats"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
