"""Packing whole documents by length patterns.

The histogram of piece lengths (at most ``size`` counts, whatever the table)
is all that the plan needs.  Patterns are the ways to fill a sequence with a few
documents of rounded-up lengths; non-negative least squares fits how often to
repeat each pattern so that together they use up the histogram.  The repeats
are rounded to whole sequences, filled with exact lengths (longest first), and
what is left is packed best fit, longest first, into the gaps of those sequences
and into new ones; a gap takes as many equal pieces as it holds.  Everything is
done on counts: the plan has ranges of equal sequences, not sequences.

A piece finds its place by arithmetic: its rank among the pieces of its length
(its task's count before it, from running sums over tasks, plus its rank in the
task) lies in one segment of the plan, which names sequence and offset.  Only
narrow rows are shuffled, never ids or texts; no task owns a length.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches, drop_used_shuffles
from sellerdesk.session import stage

END_ID = 1
UNITS = 128  # a sequence's length in steps of the patterns
IN_PATTERN = 3  # documents of a pattern, at most


# ------------------------------------------------------------------- tokens

# ASCII white space cuts a text into chunks; a chunk's closing punctuation is one of its own
SOLID, CLOSING, ALNUM = np.zeros((3, 256), bool)
SOLID[:] = True
SOLID[[9, 10, 11, 12, 13, 32]] = False
CLOSING[[*b".,;:!?"]] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of set flags start and end."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edges = np.append(0, edges)
    if len(edges) % 2:
        edges = np.append(edges, len(flags))
    return edges[::2], edges[1::2]


def chunks_of(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    """The chunks of ``raw``, and where they start.

    ASCII letters are lower-cased unless a byte beyond ASCII follows (a mark might
    compose with them) or the name of a special token may stand in ``raw``.
    """
    data = np.frombuffer(raw, np.uint8)
    solid = SOLID[data]
    (starts, ends), (cut, to) = runs_of(solid), runs_of(CLOSING[data])
    cut = cut[np.append(~solid, True)[to] & (cut > 0) & ALNUM[data[cut - 1]]]
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    if b"<" not in raw:
        upper = (data >= 65) & (data <= 90)
        upper[:-1] &= data[1:] < 128
        data = data + (upper.view(np.uint8) << 5)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), starts


def ragged(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``ids[s : s + l]`` for each (s, l), one after the other."""
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1] if len(ends) else 0)
    return ids[steps - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)]


class ChunkEncoder:
    """Token ids of texts under a tokenizer of lower-cased words that drops white space.

    Such a tokenizer (canonical composition, lower case, then runs of letters,
    single digits, runs of other characters) has no token across ASCII white
    space, nor across an ASCII letter or digit and the punctuation that closes a
    chunk.  So the ids of a text are those of its chunks, one after the other, and
    a chunk is encoded once for as long as it is held (``HELD`` chunks at most).
    Chunks of plain lower-case letters, which are one such run and which no
    normalisation changes, are encoded together without it: each ends in the one
    token that closes a word.
    """

    HELD = 500_000
    ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)  # precomposed, lower case
    PLAIN = f"^[a-z{ACCENTED}]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): spell(c)[0][0] for c in self.ACCENTED}  # as the model knows bytes
        suffix = self.plain.model.end_of_word_suffix
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closes[number] = token.endswith(suffix)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.array([END_ID], self.kind)  # the end, then the chunks
        self.sizes = np.array([1])

    def encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [w if w.isascii() else w.translate(self.spelled) for w in words]
        text = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        found = self.plain.encode_batch_fast(text, add_special_tokens=False)
        ids = np.array(list(itertools.chain.from_iterable(f.ids for f in found)), self.kind)
        return ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)

    def encode_other(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for f in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        ids = np.array(list(itertools.chain.from_iterable(found)), self.kind)
        return ids, np.array([len(f) for f in found], np.int64)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where each of the distinct ``chunks`` stands among those held."""
        if len(self.place) + len(chunks) > self.HELD:
            self.clear()
        names = chunks.to_pylist()
        place = np.array([self.place.get(c, -1) for c in names], np.int64)
        plain = pc.match_substring_regex(chunks, self.PLAIN).to_numpy(zero_copy_only=False)
        for own, encode in ((plain, self.encode_plain), (~plain, self.encode_other)):
            new = np.flatnonzero((place < 0) & own)
            if len(new):
                words = [names[i] for i in new.tolist()]
                ids, sizes = encode(words)
                place[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
                self.place.update(zip(words, place[new].tolist(), strict=True))
                self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), each text closed by the end id."""
        raws = [t.encode() for t in texts]
        chunks, starts = chunks_of(b"\n".join(raws))
        coded = chunks.dictionary_encode()
        place = self.places(coded.dictionary.cast(pa.large_string()))
        sizes = self.sizes
        begin = np.cumsum([len(r) + 1 for r in raws])
        n_chunks = np.diff(np.searchsorted(starts, begin), prepend=0)
        which = np.zeros(len(chunks) + len(texts), np.int64)
        ends = np.cumsum(n_chunks + 1) - 1
        inside = np.ones(len(which), bool)
        inside[ends] = False
        which[inside] = place[coded.indices.to_numpy()]
        ids = ragged(self.ids, (np.cumsum(sizes) - sizes)[which], sizes[which])
        return ids, np.add.reduceat(sizes[which], ends - n_chunks)


PIECE = (
    "part int, number long, doc_id long, piece int, start long, length long, "
    "ids_crc32 long, rank long, ids binary"
)


def piece_table(docs: DataFrame, path: str, size: int) -> DataFrame:
    """The pieces of every row, numbered in their task, with their rank among those of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        part, number = TaskContext.get().partitionId(), itertools.count()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(texts):  # about 8 MB of texts at a time
                hi, room = lo, 1 << 23
                while hi < len(texts) and (room > 0 or hi == lo):
                    room -= len(texts[hi] or "")
                    hi += 1
                ids, totals = encoder.encode([t or "" for t in texts[lo:hi]])
                rows, begin = [], 0
                for doc_id, total in zip(doc_ids[lo:hi], totals.tolist(), strict=True):
                    for piece, start in enumerate(range(0, total, size)):
                        length = min(size, total - start)
                        own = ids[begin + start : begin + start + length]
                        crc = zlib.crc32(own.astype("<u4").tobytes())
                        rank = int(seen[length])
                        seen[length] += 1
                        raw = own.astype(own.dtype.newbyteorder("<")).tobytes()
                        rows.append((part, next(number), doc_id, piece, start, length, crc, rank, raw))
                    begin += total
                lo = hi
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 4 + [pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECE.split(", ")])

    bounded_batches(docs.sparkSession, 8)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECE)


# ----------------------------------------------------------------- the plan


def patterns(units: int = UNITS, most: int = IN_PATTERN) -> list[tuple[int, ...]]:
    """All falling tuples of at most ``most`` positive lengths that sum to ``units``."""

    def fill(left: int, top: int, n: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif n:
            for first in range(min(left, top), 0, -1):
                if first * n < left:
                    break
                for rest in fill(left - first, first, n - 1):
                    yield first, *rest

    return list(fill(units, units, most))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: the most wanting column enters,
    columns that would turn negative leave."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = max(float(np.abs(a.T @ b).max(initial=0)), 1.0)
    for _ in range(rounds or 4 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        enter = int(gain.argmax())
        if gain[enter] <= 1e-9 * scale:
            break
        active[enter] = True
        while True:
            trial = np.zeros(len(x))
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (trial <= 1e-12)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x += min(max(step, 0.0), 1.0) * (trial - x)
            gone = low & (x <= 1e-9)
            if not gone.any():
                gone = low
            active[gone], x[gone] = False, 0.0
        x = trial
    return x


def fit_repeats(histogram: np.ndarray, shapes: list[tuple[int, ...]], units: int) -> np.ndarray:
    """Whole repeats of each pattern, none using more of a length than there is.

    ``histogram``: pieces by length in units.  Short pieces weigh less, as they
    fit in any gap.  Repeats are rounded to the nearest, then cut to the stock.
    """
    use = np.zeros((units + 1, len(shapes)))
    for j, shape in enumerate(shapes):
        np.add.at(use[:, j], list(shape), 1)
    weight = np.arange(units + 1) / units
    usable = np.flatnonzero([all(histogram[list(s)]) for s in shapes])
    repeats = np.zeros(len(shapes), np.int64)
    if not len(usable):
        return repeats
    x = nnls(use[:, usable] * weight[:, None], histogram * weight)
    stock = histogram.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        shape = shapes[usable[j]]
        need = {u: shape.count(u) for u in shape}
        n = min(int(np.rint(x[j])), *(int(stock[u]) // k for u, k in need.items()))
        if n > 0:
            repeats[usable[j]] = n
            for u, k in need.items():
                stock[u] -= n * k
    return repeats


class Plan:
    """Ranges of equal sequences, and the segments that fill them.

    A segment (length, rank, first, count, copies, fill): pieces of ``length`` from ``rank`` on,
    ``copies`` to each of ``count`` sequences from ``first`` on, behind ``fill`` tokens.
    """

    def __init__(self, histogram: np.ndarray, size: int):
        self.size, self.sequences = size, 0
        self.left = histogram.astype(np.int64).copy()  # pieces by length that have no place yet
        self.taken = np.zeros_like(self.left)
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences
        self.sizes: list[int] = []  # the gaps that occur, in order

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def add_gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.sizes, gap)
            self.gaps[gap].append((first, count))

    def pop_gap(self, gap: int) -> tuple[int, int]:
        found = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            self.sizes.remove(gap)
        return found

    def place(self, length: int, first: int, count: int, copies: int, fill: int) -> None:
        if count * copies:
            self.segments.append((length, int(self.taken[length]), first, count, copies, fill))
            self.taken[length] += count * copies
            self.left[length] -= count * copies

    def repeat(self, shape: tuple[int, ...], n: int, step: int) -> None:
        """``n`` sequences of a pattern, each of its places filled with its unit's longest pieces."""
        first, stock, columns = self.new(n), self.left.copy(), []
        for unit in shape:  # runs of equal lengths
            lengths, ends, length = [], [0], unit * step
            while ends[-1] < n:
                take = int(min(n - ends[-1], stock[length]))
                if take:
                    stock[length] -= take
                    lengths.append(length)
                    ends.append(ends[-1] + take)
                length -= 1
            columns.append((lengths, ends))
        for lo, hi in itertools.pairwise(sorted({e for _, ends in columns for e in ends})):
            fill = 0
            for lengths, ends in columns:
                length = lengths[bisect.bisect_right(ends, lo) - 1]
                self.place(length, first + lo, hi - lo, 1, fill)
                fill += length
            self.add_gap(self.size - fill, first + lo, hi - lo)

    def best_fit(self) -> None:
        """Place what is left, longest first, each in the smallest gap that holds it."""
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while left := int(self.left[length]):
                i = bisect.bisect_left(self.sizes, length)
                if i == len(self.sizes):
                    n = -(-left // (self.size // length))
                    self.add_gap(self.size, self.new(n), n)
                    continue
                gap = self.sizes[i]
                first, count = self.pop_gap(gap)
                fit = gap // length
                whole = min(count, left // fit)
                rest = left % fit if whole < count else 0
                self.place(length, first, whole, fit, self.size - gap)
                self.add_gap(gap - fit * length, first, whole)
                self.place(length, first + whole, bool(rest), rest, self.size - gap)
                self.add_gap(gap - rest * length, first + whole, int(bool(rest)))
                done = whole + bool(rest)
                self.add_gap(gap, first + done, count - done)


def plan_packing(histogram: np.ndarray, size: int, units: int = UNITS) -> Plan:
    """The plan for ``histogram`` (pieces by length, 0 to ``size``)."""
    step = -(-size // units)
    units = -(-size // step)
    plan = Plan(histogram, size)
    rounded = np.zeros(units + 1)
    np.add.at(rounded, -(-np.arange(size + 1) // step), histogram)
    rounded[0] = 0
    shapes = patterns(units)
    repeats = fit_repeats(rounded, shapes, units)
    for j in np.flatnonzero(repeats):
        plan.repeat(shapes[j], int(repeats[j]), step)
    plan.best_fit()
    return plan


# ------------------------------------------------------------------ packing


def pack_pieces(docs: DataFrame, path: str, size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The places (part, number, doc_id, piece, start, length, ids_crc32, sequence_id, offset) of
    all pieces, and the table of the pieces themselves (with part, number and ids).

    ``path``: the file of a tokenizer that drops white space.  A null or empty
    text is the end id alone.  Only documents over ``size`` tokens are cut.
    Repeated rows and null ids are packed like others; no rows give no pieces.
    Other columns are not read.
    """
    drop_used_shuffles(docs.sparkSession)
    pieces = stage(piece_table(docs, path, size), "pattern-pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pattern-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        histogram[r.length] = r.n
    segments = sorted(plan_packing(histogram, size).segments)
    table = np.array(segments, np.int64).reshape(-1, 6)
    of_length = np.searchsorted(table[:, 0], np.arange(size + 2))
    before = F.expr("sum(n) OVER (PARTITION BY length ORDER BY part) - n")
    starts = counts.select(F.col("length").alias("s_length"), F.col("part").alias("s_part"), before.alias("before"))
    starts = stage(starts, "pattern-starts")
    same = (F.col("length") == F.col("s_length")) & (F.col("part") == F.col("s_part"))
    ranked = pieces.join(starts, same).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.drop("s_length", "s_part", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for own in np.unique(length):
                lo, hi = of_length[own], of_length[own + 1]
                here = length == own
                at[here] = lo + np.searchsorted(table[lo:hi, 1], rank[here], side="right") - 1
            _, first_rank, first, _, copies, fill = table[at].T
            nth = rank - first_rank
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(first + nth // copies))
            yield out.append_column("offset", pa.array(fill + nth % copies * length))

    kept = [x for x in PIECE.split(", ") if not x.startswith(("rank ", "ids "))]
    schema = ", ".join([*kept, "sequence_id long", "offset long"])
    placed = ranked.drop("ids").mapInArrow(run, schema)
    return placed, pieces


def pack(docs: DataFrame, path: str, size: int = 4096) -> DataFrame:
    """The places of the pieces (see :func:`pack_pieces`), without their ids."""
    return pack_pieces(docs, path, size)[0].drop("part", "number")


def pack_with_ids(docs: DataFrame, path: str, size: int = 4096) -> DataFrame:
    """The places of the pieces with their ids (little-endian, two bytes where the vocabulary allows)."""
    placed, pieces = pack_pieces(docs, path, size)
    return placed.join(pieces.select("part", "number", "ids"), ["part", "number"]).drop("part", "number")
