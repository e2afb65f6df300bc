"""Packing documents into sequences along a space-filling curve.

A document's token ids give a hashed vector: each id stands for a seeded random
direction in ``DIMS`` dimensions, the directions of its tokens are summed and
scaled.  Its cell on a grid becomes a Hilbert key; rows are range-sorted by that
key, so a partition holds a stretch of the curve, and each partition is packed
in order: neighbours share sequences.  Documents are cut where a sequence is
full.  What is left at a partition's end is cut into powers of two, which need
no padding.

One shuffle (of token ids, two bytes each where the vocabulary allows).  The
token table is written first, so the range sort samples it instead of
tokenising twice; a lost task repeats on the same rows.  A task holds one Arrow
batch and one open sequence.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches
from sellerdesk.session import stage

DIMS, BITS = 4, 15  # 60 bits of Hilbert key
END_ID = 1


def directions(n_ids: int, seed: int = 2) -> np.ndarray:
    """A seeded random direction for each token id."""
    return np.random.default_rng(seed).standard_normal((n_ids, DIMS)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (uint64)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:  # from coordinates to the transposed index
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave the bits
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def grid_cells(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors' components in [-1, 1] as cells of the grid."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    return np.clip((unit + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.uint64)


@dataclass(frozen=True)
class Tokenizers:
    """A byte-level BPE: its ``tokenizers`` file and, for speed, the same vocabulary as
    ``tiktoken`` ranks with the pattern that cuts texts."""

    path: str
    ranks_path: str | None = None
    pattern: str | None = None


class Encoder:
    """Token ids of texts as bytes, exactly those of the ``tokenizers`` file.

    With ranks given, texts are encoded by them, which is several times faster
    and gives the same ids; a text that holds the name of a special token goes
    to the tokenizer itself.
    """

    def __init__(self, names: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(names.path)
        self.n_ids = self.tokenizer.get_vocab_size()
        self.kind, self.code = (np.uint16, "H") if self.n_ids <= 1 << 16 else (np.uint32, "I")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        self.ranks = None
        if names.ranks_path:
            import tiktoken

            with open(names.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding(
                "ranks", pat_str=names.pattern, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(x in text for x in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array(self.code, ids).tobytes()


def token_table(docs: DataFrame, names: Tokenizers) -> DataFrame:
    """doc_id, key (Hilbert), doc_tokens, crc and ids (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(names)
        table = directions(encoder.n_ids)
        end = np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 256):
                ids = [encoder.encode(t) + end for t in texts[lo : lo + 256]]
                lengths = np.array([len(b) for b in ids]) // np.dtype(encoder.kind).itemsize
                flat = np.frombuffer(b"".join(ids), encoder.kind)
                starts = np.cumsum(lengths) - lengths
                vectors = np.add.reduceat(table[flat], starts, axis=0)
                keys = hilbert_keys(grid_cells(vectors))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, 256),
                        pa.array(keys.view(np.int64), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "key", "doc_tokens", "crc", "ids"],
                )

    bounded_batches(docs.sparkSession, 8)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    schema = "doc_id long, key long, doc_tokens long, crc long, ids binary"
    return narrow.mapInArrow(run, schema)


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def pack_sorted(rows: Iterator[tuple], part: int, size: int, kind: type) -> Iterator[tuple]:
    """Cut rows (doc_id, doc_tokens, ids) into the pieces of full sequences.

    The last, open sequence of the partition is cut into powers of two.
    """
    width = np.dtype(kind).itemsize
    sequence, fill = part << 40, 0
    open_pieces: list[tuple] = []  # (doc_id, start, length, doc_tokens, bytes)

    def emit(pieces: list[tuple], number: int) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, length, total, raw in pieces:
            crc = zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes())
            yield doc_id, start, length, crc, total, number, offset, raw
            offset += length

    for doc_id, total, ids in rows:
        start = 0
        while start < total:
            length = min(size - fill, total - start)
            raw = ids[start * width : (start + length) * width]
            open_pieces.append((doc_id, start, length, total, raw))
            start, fill = start + length, fill + length
            if fill == size:
                yield from emit(open_pieces, sequence)
                sequence, fill, open_pieces = sequence + 1, 0, []
    for room in powers_of_two(fill):
        closed, left = [], room
        while left:
            doc_id, start, length, total, raw = open_pieces.pop(0)
            if length > left:
                rest = (doc_id, start + left, length - left, total, raw[left * width :])
                open_pieces.insert(0, rest)
                length, raw = left, raw[: left * width]
            closed.append((doc_id, start, length, total, raw))
            left -= length
        yield from emit(closed, sequence)
        sequence += 1


def pack(
    docs: DataFrame,
    names: Tokenizers,
    size: int = 2048,
    partitions: int | None = None,
) -> DataFrame:
    """Pieces of sequences of at most ``size`` tokens, padding nothing.


    A null or empty text is the end id alone.  Rows are sorted by (Hilbert key,
    doc_id, checksum); rows that tie in all three have equal tokens.  Repeated
    rows and null ids are packed like others.  An empty table gives no rows.
    Other columns are not read.  Returns per piece doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and the ids themselves
    (little-endian, two bytes where the vocabulary allows, else four).
    """
    spark = docs.sparkSession
    tokens = stage(token_table(docs, names), "pack-tokens")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids"))
                yield from zip(*columns, strict=True)

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        first = next(source := rows(), None)
        if first is None:
            return
        kind = np.uint16 if len(first[2]) == 2 * first[1] else np.uint32

        def all_rows() -> Iterator[tuple]:
            yield first
            yield from source

        held: list[tuple] = []
        for piece in pack_sorted(all_rows(), part, size, kind):
            held.append(piece)
            if len(held) >= 2048:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    ranged = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "doc_tokens", "ids").mapInArrow(run, PIECE)
