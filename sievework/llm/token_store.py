"""Token-id files with keyed access.

Documents are encoded, dealt to shards by ranges of doc_id and written in
ascending order. A shard is one file::

    ids of all its documents, little-endian unsigned 16- or 32-bit integers
    displacements int32, fingerprints uint32, offsets uint64 and lengths uint64 by slot
    footer: magic, documents, ids, buckets, seed, width (six unsigned 64-bit integers)

The index is a minimal perfect hash of the document keys, so a lookup reads
the footer and index once and then one range of ids for each key. A repeated
doc_id is a further occurrence of its key; a null one sorts last, as the
largest 64-bit integer. Files are written under a name of the attempt and
renamed when complete, so lost or repeated tasks leave no partial shard.

The number of shards has a bound (``max_shards``); the driver holds one small
row for each shard and nothing for each document.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import shared_folder
from .common import NULL_ID, byte_slices, id_and_text, map_slices, slices
from .pieces import cut_words, plain_pieces, rare_collections
from .perfect_hash import PerfectHash, keys_of, occurrences

MAGIC = 0x5349455645544F4B
FOOTER = 6
END_OF_WORD = "</w>"
#: Pieces a worker remembers, in two generations of so many each; bytes of text that are encoded at once.
PIECES_KEPT, BYTES_AT_ONCE = 300_000, 4 << 20


class LibraryEncoder:
    """Ids by the tokenizers library, remembered piece by piece.

    White space separates words in this vocabulary, words are cut into pieces
    and a piece's ids don't depend on its neighbours. So the distinct words of
    many texts are cut together, distinct pieces get their ids once, and the
    texts are put together by position. Pieces not yet known are encoded in
    one call: each ends with the only token that carries an end of word.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        self.final = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.final[i] = token.endswith(END_OF_WORD)
        self.known, self.older = {}, {}

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, new: list[bytes], odd: set[bytes]) -> None:
        """``odd`` has the words that are no pieces yet; where only the library can cut one, it gets the whole word."""
        known, older, plain, cut = self.known, self.older, {}, {}
        for piece in new:
            if (ids := older.get(piece)) is not None:
                known[piece] = ids
            elif piece not in odd:
                plain[piece] = None
            elif (parts := None if b"<|" in piece else plain_pieces(piece.decode())) is None:
                known[piece] = self._encode(piece.decode()).tobytes()
            else:
                cut[piece] = parts = [p.encode() for p in parts]
                plain |= dict.fromkeys(p for p in parts if p not in known)
        if plain:
            ids = self._encode(b" ".join(plain).decode())
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("a piece was cut")
            raw, at = ids.tobytes(), 0
            for piece, end in zip(plain, (ends * self.kind.itemsize).tolist(), strict=True):
                known[piece] = raw[at:end]
                at = end
        for word, parts in cut.items():
            known[word] = b"".join([known[p] for p in parts])

    def _ids(self, pieces: list[bytes], odd: set[bytes]) -> list[bytes]:
        if len(self.known) > PIECES_KEPT:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, pieces))
        if new := [p for p, ids in zip(pieces, found, strict=True) if ids is None]:
            self._learn(new, odd)
            found = list(map(self.known.__getitem__, pieces))
        return found

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word."""
        pieces, first, odd = cut_words(words)
        coded = pieces.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_pylist(), odd), pa.binary()).take(coded.indices)
        return _joined(ids, first)

    def encode(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text and ``end`` as one binary value."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))  # with an empty word at a blank end
        coded = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._words(coded.dictionary), pa.array([end], pa.binary())])
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        order = np.insert(coded.indices.to_numpy(), ends, len(ids) - 1)
        return _joined(ids.take(pa.array(order)), np.append(0, ends + np.arange(1, len(ends) + 1)))

    def texts(self, raw: list[bytes], end: bytes) -> list[bytes]:
        return self.encode(pa.array(raw, pa.binary()), end).to_pylist()


def _joined(values: pa.Array, first: np.ndarray) -> pa.Array:
    """One binary value of each run of values; ``first`` has where each run begins, and the end of the last."""
    return _binary(_offsets(values)[first], values.buffers()[2])


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"") if data is None else data])


def _offsets(values: pa.Array) -> np.ndarray:
    at = values.buffers()[1]
    return np.frombuffer(at, np.int32, len(values) + 1, 4 * values.offset) if at and at.size else np.zeros(len(values) + 1, np.int32)


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def encoder_for(path: str, width: int) -> LibraryEncoder:
    """One for each Python worker, so tasks that follow each other share what it remembers."""
    if (path, width) not in _encoders:
        rare_collections()
        _encoders[path, width] = LibraryEncoder(path, width)
    return _encoders[path, width]


@dataclass
class TokenStore:
    folder: str
    width: int
    bounds: list[int]  # the first doc_id of each shard but the first
    starts: list[int]  # ids before each shard
    paths: list[str]

    def lookup(self, keys: DataFrame, id_col: str = "doc_id", *, digests: bool = False) -> DataFrame:
        """The stored ids of each key row, and how many ids come before them in the whole store.

        Every key row is answered: the k-th ask for an id gets its k-th stored
        document, and after the last one the first again. A key that is not
        stored comes back with nulls. With ``digests`` the ids are replaced by
        the CRC-32 of their 32-bit form.
        """
        store = self
        bounds = np.asarray(self.bounds, np.int64)
        schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary")

        def place():
            def step(part):
                ids = _filled(part["doc_id"])
                return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.searchsorted(bounds, ids, side="right").astype(np.int32))], names=["doc_id", "shard"])

            return step

        def read(batches):
            asked: dict[int, list[pa.Array]] = {}
            for b in batches:
                if b.num_rows:
                    shards = b["shard"].to_numpy()
                    for s in np.unique(shards):
                        asked.setdefault(int(s), []).append(b["doc_id"].filter(pa.array(shards == s)))
            for s, parts in asked.items():
                yield from store._read_shard(s, pa.concat_arrays(parts), digests)

        placed = map_slices(keys.select(keys[id_col].cast("long").alias("doc_id")), place, "doc_id long, shard int", rows=1 << 16)
        return placed.repartitionById(max(1, len(self.paths)), F.col("shard")).mapInArrow(read, schema)

    def _read_shard(self, shard: int, asked: pa.Array, digests: bool):
        filled = _filled(asked)
        order = np.argsort(filled, kind="stable")
        ids, ask = filled[order], occurrences(filled[order])
        with Shard(self.paths[shard]) as file:
            slot = file.index.slots(keys_of(ids, ask))
            if (over := (slot < 0) & (ask > 0)).any():  # asked more often than stored
                first = np.flatnonzero(ask == 0)
                stored = np.add.reduceat((slot >= 0).astype(np.int64), first)[np.cumsum(ask == 0) - 1]
                again = over & (stored > 0)
                slot[again] = file.index.slots(keys_of(ids[again], ask[again] % stored[again]))
            for at in range(0, len(order), 1024):
                take, where = order[at : at + 1024], slot[at : at + 1024]
                ids = [file.ids(x) if x >= 0 else None for x in where]
                n = [None if x is None else len(x) for x in ids]
                start = [None if x < 0 else self.starts[shard] + int(file.offsets[x]) for x in where]
                last = (
                    pa.array([None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                    if digests
                    else pa.array([None if x is None else x.astype("<u4").tobytes() for x in ids], pa.binary())
                )
                yield pa.RecordBatch.from_arrays(
                    [asked.take(pa.array(take)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
                )


class Shard:
    """Reads one shard file: its index at once, ids when asked for."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        magic, n, total, buckets, seed, width = np.frombuffer(self.file.read_at(8 * FOOTER, size - 8 * FOOTER), "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.kind = np.dtype(f"<u{width}")
        raw = self.file.read_at(4 * buckets + 20 * n, total * width)
        displacement = np.frombuffer(raw, "<i4", buckets)
        prints = np.frombuffer(raw, "<u4", n, 4 * buckets)
        self.offsets = np.frombuffer(raw, "<u8", n, 4 * buckets + 4 * n)
        self.lengths = np.frombuffer(raw, "<u8", n, 4 * buckets + 12 * n)
        self.index = PerfectHash(n, seed, displacement, prints)

    def ids(self, slot: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at(int(self.lengths[slot]) * width, int(self.offsets[slot]) * width), self.kind)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _filled(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class _ShardWriter:
    def __init__(self, folder: str, shard: int, width: int):
        self.path = f"{folder}/shard-{shard:08d}.ids"
        self.system, self.at = fs.FileSystem.from_uri(self.path)
        self.attempt = f"{self.at}.{uuid.uuid4().hex}"
        self.system.create_dir(os.path.dirname(self.at), recursive=True)
        self.out = self.system.open_output_stream(self.attempt)
        self.shard, self.width, self.doc_ids, self.lengths = shard, width, [], []

    def add(self, doc_ids: np.ndarray, ids: list[bytes]) -> None:
        self.out.write(b"".join(ids))
        self.doc_ids.append(doc_ids)
        self.lengths.append(np.fromiter((len(x) // self.width for x in ids), np.int64, len(ids)))

    def close(self) -> dict:
        doc_ids, lengths = np.concatenate(self.doc_ids), np.concatenate(self.lengths)
        index, slot = PerfectHash.build(keys_of(doc_ids, occurrences(doc_ids)))
        offsets, sizes = np.zeros(len(slot), "<u8"), np.zeros(len(slot), "<u8")
        offsets[slot], sizes[slot] = np.cumsum(lengths) - lengths, lengths
        footer = np.array([MAGIC, index.n, lengths.sum(), len(index.displacement), index.seed, self.width], "<u8")
        for part in (index.displacement.astype("<i4"), index.fingerprint.astype("<u4"), offsets, sizes, footer):
            self.out.write(part.tobytes())
        self.out.close()
        self.system.move(self.attempt, self.at)
        return {"shard": self.shard, "n_docs": len(slot), "n_tokens": int(lengths.sum()), "path": self.path}


def write_token_store(
    docs: DataFrame, vocabulary: str, *, end_id: int = 2, width: int = 2, rows_per_shard: int = 8192, max_shards: int = 20_000, folder: str | None = None
) -> TokenStore:
    """Encodes and writes all documents; null texts read as empty, an empty one holds only ``end_id``.

    ``width`` is the bytes of a stored id and must hold the vocabulary. The
    bounds of the shards come from the doc_id column alone, so the texts are
    read once.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    keyed = id_and_text(docs)
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    n = keyed.count()
    shards = max(1, min(max_shards, -(-n // rows_per_shard)))
    cuts = [i / shards for i in range(1, shards)]
    bounds = sorted(set(keyed.agg(F.percentile_approx(key, cuts, 100 * shards)).first()[0] or [])) if cuts else []
    at = np.asarray(bounds, np.int64)

    def encode(batches):
        encoder = encoder_for(vocabulary, width)
        if len(encoder.final) > 1 << 8 * width or end_id >> 8 * width:
            raise ValueError(f"ids don't fit into {width} bytes")
        end = np.array([end_id], encoder.kind).tobytes()
        for part in byte_slices(batches, "text", BYTES_AT_ONCE):
            ids = _filled(part["doc_id"])
            shard = np.searchsorted(at, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), encoder.encode(part["text"], end)], names=["shard", "doc_id", "ids"])

    def write(batches):
        writer, done = None, []
        for part in slices(batches, 1024):
            shard = part["shard"].to_numpy()
            for s in np.unique(shard):  # sorted by shard, then doc_id
                if writer is None or writer.shard != s:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _ShardWriter(folder, int(s), width)
                mine = part.filter(pa.array(shard == s))
                writer.add(mine["doc_id"].to_numpy(), mine["ids"].to_pylist())
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string())]))

    encoded = keyed.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    written = {r.shard: r for r in dealt.mapInArrow(write, "shard int, n_docs long, n_tokens long, path string").collect()}
    starts, paths, before = [], [], 0
    for s in range(len(bounds) + 1):
        starts.append(before)
        paths.append(written[s].path if s in written else "")
        before += written[s].n_tokens if s in written else 0
    store = TokenStore(folder, width, bounds, starts, paths)
    if written:
        system, place = fs.FileSystem.from_uri(f"{folder}/store.json")
        with system.open_output_stream(place) as out:
            out.write(json.dumps(store.__dict__).encode())
    return store


def open_token_store(folder: str) -> TokenStore:
    system, place = fs.FileSystem.from_uri(f"{folder}/store.json")
    with system.open_input_stream(place) as f:
        return TokenStore(**json.loads(f.read()))
