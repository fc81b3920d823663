"""Near copies: five-word shingles with similarity 0.8 or more, found by SimHash and completed.

Each distinct text (A-Z lower-cased, white space as one blank) is a node with
the set of its five-word shingles. Candidates come from two sources:

* the SimHash of that set, by the Golay keys of ``simhash``: three bits at most;
* ``BANDS`` keys of ``ROWS`` minimum hashes, because similarity 0.8 leaves SimHash
  some ten bits apart, which keys of a useful length can't span. A pair at
  exactly 0.8 shares no band once in 150,000 pairs.

Members of a band are first compared with its least node alone, which is linear
however many near copies share it, and nearly all of a large group then lies in
one component. In each band that still has several, the members outside its
largest component are held against all others. That comparison uses parity
sketches: each shingle flips one of ``BITS`` bits, so two sketches never differ
in more bits than the sets do in shingles, and no link is lost. Pairs that pass
are held against the texts themselves, so no pair under 0.8 is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..operators.graph import connected_components
from ..operators.storage import checkpointed
from .common import NULL_ID, keyed_text, map_slices, raw_texts, slices
from .perfect_hash import mix
from .simhash import SEED, links, majority, named_components, shingle_hashes

WORDS = 5
#: Least similarity of a link, as a fraction of two integers.
LEAST = (4, 5)
BANDS, ROWS = 30, 5
BITS = 2048
_WIDE = BITS // 64


def node_of(words: list[bytes]) -> int:
    return xxh3_64_intdigest(b" ".join(words), SEED)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, no words have none."""
    return np.unique(shingle_hashes(words, WORDS, xxh3_64_intdigest))


def _factors() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 256):
        least = np.minimum(least, (factors[:, None] * hashes[None, k : k + 256]).min(axis=1))
    bands = mix(least.reshape(BANDS, ROWS)) * factors[:ROWS]
    return mix(bands.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the shingles that fall on each of ``BITS`` bits, as signed 64-bit integers."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp, size, sim, keys)`` for each row; ``fp`` is the node, ``sim`` its SimHash."""

    def make():
        factors = _factors()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            words = [t.lower().split() for t in raw_texts(part["text"])]
            sets = [shingle_set(w) for w in words]
            keys = [band_keys(h, factors) for h in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            whole = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in ([node_of(w) for w in words], [majority(h) for h in sets])]
            return pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_key"], whole[0], pa.array([len(h) for h in sets], pa.int64()), whole[1], listed],
                names=["doc_id", "text_key", "fp", "size", "sim", "keys"],
            )

        return step

    return map_slices(keyed_text(docs), make, "doc_id long, text_key long, fp long, size long, sim long, keys array<long>")


def _node_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(fp, text)`` of each node in ``wanted(fp, id, key)``, read from one row that has it: copies are not gathered."""
    rows = keyed_text(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("text_key").alias("key"), "text")
    return rows.join(wanted, ["id", "key"]).select("fp", "text").dropDuplicates(["fp"])


def _sketches(texts: DataFrame) -> DataFrame:
    """``(fp, size, s0, s1, ...)`` for each row of ``texts(fp, text)``."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.lower().split()) for t in raw_texts(part["text"])]
        table = np.array([sketch(h) for h in sets], np.int64).reshape(-1, _WIDE)
        columns = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(_WIDE)]
        return pa.RecordBatch.from_arrays([part["fp"], pa.array([len(h) for h in sets], pa.int64()), *columns], names=["fp", "size", *(f"s{k}" for k in range(_WIDE))])

    return map_slices(texts, lambda: step, "fp long, size long, " + ", ".join(f"s{k} long" for k in range(_WIDE)))


def _may_link(a: str, b: str):
    """Whether sets of these sketches and sizes can be as similar as a link needs: shingles that differ are few enough."""
    differ = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(_WIDE))
    part, whole = LEAST
    sizes = f"{a}.size * {whole} >= {b}.size * {part} and {b}.size * {whole} >= {a}.size * {part}"
    return F.expr(f"{sizes} and ({differ}) * {whole + part} <= ({a}.size + {b}.size) * {whole - part}")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity is 0.8 or more."""

    def verify(batches):
        for part in slices(batches, 256):  # two texts a row
            sets: dict[int, np.ndarray] = {}
            good = []
            for a, b, ta, tb in zip(part["a"].to_pylist(), part["b"].to_pylist(), raw_texts(part["ta"]), raw_texts(part["tb"]), strict=True):
                for node, text in ((a, ta), (b, tb)):
                    if node not in sets:
                        sets[node] = shingle_set(text.lower().split())
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part["a"].filter(mask), part["b"].filter(mask)], names=["a", "b"])

    one = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _simhash_candidates(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of one SimHash with the least of them, and the least nodes of linked ones."""
    least = checkpointed(nodes.filter("size > 0").groupBy("sim").agg(F.min("fp").alias("rep")))
    same = nodes.join(least, "sim").filter("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    pairs = links(least.select(F.col("sim").alias("fp")))
    first = pairs.join(least.select(F.col("sim").alias("a"), F.col("rep").alias("ra")), "a")
    across = first.join(least.select(F.col("sim").alias("b"), F.col("rep").alias("rb")), "b")
    return same.union(across.select("ra", "rb"))


def near_copy_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp, root, component_id)`` for each row, named as in ``simhash_components``; texts without words are one node."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = checkpointed(_prints(docs))
    row = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("text_key").alias("key"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(row).alias("row"), F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sim").alias("sim"), F.first("keys").alias("keys")))
    keyed = nodes.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first").repartition(n)
    members = checkpointed(keyed.join(shared, "key"))
    starred = members.filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    tried = checkpointed(starred.union(_simhash_candidates(nodes)).distinct())
    wanted = tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = checkpointed(_node_texts(docs, nodes.join(wanted, "fp", "left_semi").select("fp", "row.*").repartition(n)))
    sketches = checkpointed(_sketches(texts))
    one, two = sketches.alias("x"), sketches.alias("y")
    hopeful = tried.join(one, tried["a"] == F.col("x.fp")).join(two, (F.col("b") == F.col("y.fp")) & _may_link("x", "y")).select("a", "b")
    found = checkpointed(_similar(hopeful, texts))
    linked = connected_components(found, checkpointed)
    label = members.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("label"))
    label = checkpointed(label)
    sizes = label.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
    mixed = checkpointed(sizes.filter("labels > 1").select("key", "main"))
    held = label.join(mixed.repartition(n), "key").join(sketches, "fp")
    x, y = held.filter("label <> main").alias("x"), held.alias("y")
    # two members outside the main component meet once, in the order of their nodes
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & _may_link("x", "y"))
    pairs = cross.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    more = _similar(pairs, texts)
    return named_components(prints.select("doc_id", "text_key", "fp"), nodes.select("fp", "least"), found.union(more))
