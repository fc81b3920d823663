"""SimHash near-duplicates with Golay-code keys.

Two fingerprints of 64 bits link when they differ in three bits at most. They
are cut into four segments of 16 bits. By the pigeonhole principle a link has
either two equal segments, or exactly one equal segment and one error in each
other. So each fingerprint gets

* six keys of two segments as they are, and
* for each segment a key of that segment and the *nearby codewords* of the next
  one: a segment, read as a word of the perfect binary Golay code (23, 12, 7),
  is decoded together with all its neighbours at one bit, which gives one to six
  codeword indices. Words that differ in one bit always share an index.

Fingerprints that share a key are verified by their distance. Within a key the
links are found by breadth-first search over distinct fingerprints, which emits
a spanning forest instead of all pairs; components are merged by star
contraction. Copies of one fingerprint are one node all along.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.graph import connected_components
from ..operators.storage import checkpointed
from .common import NULL_ID, keyed_text, map_slices, raw_texts

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _decoder() -> np.ndarray:
    """The error pattern of each of the 2,048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)], np.int64)
    table = np.zeros(1 << 11, np.int64)
    table[_syndrome(errors)] = errors
    return table


def nearby_codewords() -> np.ndarray:
    """For each 16-bit segment the codeword indices of it and its 16 neighbours, without repeats, filled up with -1."""
    table = _decoder()
    words = np.arange(1 << SEGMENT_BITS, dtype=np.int64)
    ball = np.stack([words, *(words ^ (1 << b) for b in range(SEGMENT_BITS))], axis=1)
    index = np.sort((ball ^ table[_syndrome(ball)]) >> 11, axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    index = -np.sort(-index, axis=1)
    return index[:, : int((index >= 0).sum(axis=1).max())]


_nearby: list[np.ndarray] = []


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, and the position of the fingerprint of each."""
    if not _nearby:
        _nearby.append(nearby_codewords())
    table, n = _nearby[0], len(prints)
    part = [(prints >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    found, whose = [], []
    for kind, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        found.append(kind << 32 | part[i] << 16 | part[j])
        whose.append(np.arange(n))
    for i in range(SEGMENTS):
        near = table[part[(i + 1) % SEGMENTS]]
        row, col = np.nonzero(near >= 0)
        found.append((6 + i) << 32 | part[i][row] << 12 | near[row, col])
        whose.append(row)
    return np.concatenate(found), np.concatenate(whose)


def shingle_hashes(words: list[bytes], size: int, digest) -> np.ndarray:
    """``digest`` (seeded) of each run of ``size`` words joined by a blank; of the whole sequence where it is shorter; of none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash: a bit is set where it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(raw: bytes) -> int:
    """SimHash of the three-word shingles of a text, A-Z lower-cased; 0 without words."""
    return majority(shingle_hashes(raw.lower().split(), SHINGLE, xxh64_intdigest))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp)`` for each row; ``fp`` is the fingerprint as a signed integer."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in raw_texts(part["text"])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(prints, pa.int64())], names=["doc_id", "text_key", "fp"])

    return map_slices(keyed_text(docs), lambda: step, "doc_id long, text_key long, fp long")


def _forest(group: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, right = [], []
    rest = group
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = np.bitwise_count(rest ^ node) <= MOST_BITS
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    return left, right


def _link(batches):
    """Links within each key; rows come sorted by key, a key may span batches."""
    kept_key, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(key, fp):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        two = first[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MOST_BITS
        left, right = [fp[two][near]], [fp[two + 1][near]]
        for at, n in zip(first[size > 2], size[size > 2], strict=True):
            more = _forest(fp[at : at + n])
            left += more[0]
            right += more[1]
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.r_[kept_key, batch["key"].to_numpy()]
        fp = np.r_[kept_fp, batch["fp"].to_numpy().view(np.uint64)]
        cut = int(np.searchsorted(key, key[-1]))
        kept_key, kept_fp = key[cut:], fp[cut:]
        if cut:
            yield edges(key[:cut], fp[:cut])
    if len(kept_key):
        yield edges(kept_key, kept_fp)


def links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: enough links among distinct ``fp`` to connect every pair that differs in three bits at most."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = part["fp"].to_numpy()
        key, whose = keys(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[whose])], names=["key", "fp"])

    keyed = map_slices(nodes.select("fp"), lambda: step, "key long, fp long", rows=4096)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long").distinct()


def named_components(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc_id, text_key, root, component_id)`` for each row of ``prints(doc_id, text_key, fp)``, with ``fp``.

    ``nodes(fp, least)`` has the smallest doc_id of each ``fp``; ``root`` is the
    component's smallest ``fp``, ``component_id`` its smallest doc_id.
    """
    linked = connected_components(edges, checkpointed)
    members = checkpointed(linked.join(nodes, linked["node"] == nodes["fp"]).select("fp", "component", "least"))
    named = members.groupBy("component").agg(F.min("least").alias("named"))
    spread = named.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = members.join(spread, "component").select("fp", F.col("component").alias("root"), F.col("named").alias("component_id"))
    alone = nodes.join(members.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    by_print = checkpointed(found.union(alone))
    return prints.join(by_print, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp, root, component_id)`` for each row; the component is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows come back repeated. A null doc_id takes part in links and is
    named as a component only where no other id is in it, as null. Rows that
    share an id have one name, though they may lie in components of their own:
    ``root`` tells these apart.
    """
    prints = checkpointed(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return named_components(prints, nodes, links(nodes))


def keep_representatives(docs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their component: exactly one for each.

    It is the row with the smallest doc_id (a null one is the largest), then the
    smallest key of its text; of rows equal in both, any one.
    """
    components = simhash_components(docs) if components is None else components
    order = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    chosen = components.groupBy("root").agg(F.min(order).alias("first")).select(F.coalesce("first.id", F.lit(NULL_ID)).alias("id"), F.col("first.text").alias("key")).distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")), docs["doc_id"].isNull()).alias("key"))
    kept = keyed.join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def simhash_digest(docs: DataFrame) -> DataFrame:
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
