"""Phrase collocations by Toivonen's sampling.

Frequent phrases are closed: the words of a frequent phrase that stand together
are frequent.  A sample of the rows, mined with a lowered threshold, proposes a
closed set of phrases.  Passes over all rows then count every occurring phrase
that is proposed or on the negative border of the proposals, which is one whose
shorter parts (without its first, without its last word) are all proposed;
single words always are.  A frequent phrase of the border that was not proposed
is a border failure: what it may extend to was not counted.  Failures join the
proposals, and a further pass counts the phrases that are on the border only
now, and whatever longer phrases these begin, until no failure is left (the
longest phrase is short, so one such pass closes).  Then every frequent phrase
has been counted exactly, whatever the sample was; it decides only the cost.

Most of the border occurs a few times only, so it is counted in two steps.  First
by 64-bit hashes, sorted and delta-coded in blocks: phrases of equal hash count
together, so this bounds each count from above.  Then, for the phrases whose
bound reaches the threshold, by their words: the counts that are returned.

A task knows sets of phrases through bit tables of fixed size (``MAX_BITS``),
marked at the phrases' hashes: a false mark makes a phrase be counted that need
not be, never the reverse, and each pass counts what its table admits and the
table before it did not.  No hash decides a result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerdesk.llm.common import bounded_batches, drop_used_shuffles, planes, unplanes
from sellerdesk.session import stage

LONGEST = 4  # words of a phrase
MIN_COUNT = 30
SAMPLE = 8  # one row of so many is in the sample
LOWER = 0.8  # the sample's threshold over what it would expect of a phrase of MIN_COUNT
BITS_PER_PHRASE, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28  # of the bit table: 32 MB at most
BATCH_MB = 4  # of texts that a task counts at once: a worker takes about 30 times that
BUCKET_BYTES = 8 << 20  # of texts whose hashes one task merges, about
BLOCK_TYPES = (pa.int32(), pa.binary(), pa.binary())

# kinds of bytes: 0 of a word, 1 between words, 2 between pieces
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE[65:91] += 32


# ----------------------------------------------------------------- tokens


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their text's number, whether the next word stands in the same piece)."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = KIND[raw]
    solid = kind == 0
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    values = np.ascontiguousarray(LOWER_CASE[raw[solid]])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    begin = np.cumsum([len(t) + 1 for t in texts])
    return words, np.searchsorted(begin, starts, side="right"), joined


# ----------------------------------------------------------------- hashes

MIX = np.uint64(0x9E3779B97F4A7C15)


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases: of a phrase's beginning (or its language) and its last word."""
    h = (prefix ^ (word + MIX + (prefix << np.uint64(6)))) * MIX
    return h ^ (h >> np.uint64(31))


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


class Marks:
    """A table of bits, a power of two of them."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def marked(found: DataFrame, n_bits: int) -> np.ndarray:
    """The bit table of hashes (hash long), made in parts by the tasks that hold them."""
    n_parts = 16
    width = n_bits // n_parts

    def part(table: pa.Table) -> pa.Table:
        at = table.column("slot").to_numpy()
        n, own = int(at[0]) // width, np.zeros(width, bool)
        own[at % width] = True
        return pa.table({"n": pa.array([n], pa.int32()), "bits": [np.packbits(own, bitorder="little").tobytes()]})

    slot = F.shiftrightunsigned("hash", 64 - n_bits.bit_length() + 1).alias("slot")
    slots = found.select(slot).distinct()
    parts = slots.groupBy(F.expr(f"slot div {width}")).applyInArrow(part, "n int, bits binary")
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in parts.collect():  # n_bits / 8 bytes in all
        bits[r.n * width // 8 : (r.n + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    h = hashes([x.encode() for x in langs])
    split = [p.encode().split(b" ") for p in phrases]
    for k in range(max(map(len, split), default=0)):
        own = np.array([i for i, w in enumerate(split) if len(w) > k])
        h[own] = extended(h[own], hashes([split[i][k] for i in own]))
    return h


def unmarked(phrases: DataFrame, marks: np.ndarray) -> DataFrame:
    """The hashes of the ``phrases`` (lang, phrase) that the bit table does not hold."""
    sent = phrases.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marks(sent.value)
        for batch in batches:
            h = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h[~known.has(h)].view(np.int64))], names=["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash long")


# --------------------------------------------------------------- counting


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key's value, a position of each value, its count)."""
    codes, values = pd.factorize(keys)
    position = np.empty(len(values), np.int64)
    position[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, position, np.bincount(codes, minlength=len(values))


class Batch:
    """The words of a batch of texts, numbered exactly."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        words, text, self.joined = words_of(texts)
        coded = words.dictionary_encode()
        self.words, self.number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.langs, lang_of = np.unique(langs, return_inverse=True)
        self.lang = lang_of[text]

    def admitted(
        self, longest: int, new: Marks | None, old: Marks | None
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, positions, counts, hashes) of the phrases that ``new`` admits and ``old`` does not.

        Single words are admitted always, by any table; with ``old``, so is what extends
        only phrases that are marked or that it did not admit.
        """
        if not len(self.number):
            return
        word_hash = hashes(self.words.to_pylist())
        lang_hash = hashes([x.encode() for x in self.langs.tolist()])
        gram, at, n = _numbered(self.lang * len(word_hash) + self.number)
        single, n_single = gram, len(at)
        h = extended(lang_hash[self.lang[at]], word_hash[self.number[at]])
        before = np.full(len(at), old is not None)  # counted by an earlier pass
        for k in range(1, longest + 1):
            yield k, at[~before], n[~before], h[~before]
            if new is None or k == longest or not len(h):
                return
            good, good_old = new.has(h), np.zeros(len(h), bool)
            if old is not None:  # extend what this pass counts as if it were frequent
                good_old = before & old.has(h)
                good |= ~before
            has = (gram >= 0) & good[gram]
            pair = np.flatnonzero(has[:-1] & has[1:] & self.joined[:-1])
            codes, first, n = _numbered(gram[pair] * n_single + single[pair + k])
            at = pair[first]
            before = good_old[gram[at]] & good_old[gram[at + 1]]
            h = extended(h[gram[at]], word_hash[self.number[at + k]])
            gram = np.full(len(gram), -1, np.int64)
            gram[pair] = codes

    def phrase(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words at positions."""
        columns = [self.words.take(pa.array(self.number[at + j])) for j in range(k)]
        if k > 1:
            columns = [pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))]
        return columns[0].cast(pa.binary()).cast(pa.string())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for batch in batches:
        yield Batch(batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()])


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def bounded_hashes(texts: DataFrame, n_bytes: int, lengths: range, least: int, marks: np.ndarray | None) -> DataFrame:
    """The hashes (hash long) whose phrases of ``lengths`` words, admitted by ``marks``, occur
    ``least`` times in ``texts`` (lang, text as binary) together."""
    sent = None if marks is None else texts.sparkSession.sparkContext.broadcast(marks)
    n_buckets = max(16, -(-n_bytes // BUCKET_BYTES))
    width = -(-(1 << 64) // n_buckets)
    edges = np.array([i * width for i in range(1, n_buckets) if i * width < 1 << 64], np.uint64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admit = None if sent is None else Marks(sent.value)
        for batch in _batches(batches):
            found = [(n, h) for k, _, n, h in batch.admitted(lengths[-1], admit, None) if k in lengths]
            if not sum(len(n) for n, _ in found):
                continue
            n, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h)
            n, h = n[order], h[order]
            cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
            rows = []
            for bucket, (lo, hi) in enumerate(itertools.pairwise(cuts)):
                if lo < hi:
                    steps = np.diff(h[lo:hi], prepend=np.uint64(0))
                    rows.append((bucket, planes(steps), planes(n[lo:hi].astype(np.uint32))))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "hashes", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(unplanes(b, np.uint64), dtype=np.uint64) for b in table.column("hashes").to_pylist()])
        n = np.concatenate([unplanes(b, np.uint32) for b in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h = h[start][np.add.reduceat(n, start) >= least]
        return pa.table({"hash": pa.array(h.view(np.int64))})

    found = texts.mapInArrow(blocks, "bucket int, hashes binary, counts binary")
    return found.groupBy("bucket").applyInArrow(merge, "hash long")


COUNT = "lang string, k int, phrase string, n long"


def count_phrases(
    texts: DataFrame, lengths: range, new: np.ndarray, old: np.ndarray | None = None, maybe: np.ndarray | None = None
) -> DataFrame:
    """Counts of the phrases of ``texts`` (lang, text as binary) with ``lengths`` words.

    Counted are those that the bit table ``new`` admits and ``old`` does not, and
    that ``maybe`` holds; with ``lengths`` from 1 on, length 0 counts all words of
    a language.
    """
    context = texts.sparkSession.sparkContext
    sent = [None if b is None else context.broadcast(b) for b in (new, old, maybe)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admit, skip, only = (None if b is None else Marks(b.value) for b in sent)

        def out(lang: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            arrays = [pa.array(lang, pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n)]
            whole = pa.RecordBatch.from_arrays(arrays, names=["lang", "k", "phrase", "n"])
            for lo in range(0, len(n), 1 << 16):
                yield whole.slice(lo, 1 << 16)

        for batch in _batches(batches):
            if 1 in lengths:
                n = np.bincount(batch.lang, minlength=len(batch.langs))
                yield from out(batch.langs, 0, pa.array([""] * len(n)), n)
            for k, at, n, h in batch.admitted(lengths[-1], admit, skip):
                if k in lengths:
                    if only is not None:
                        likely = only.has(h)
                        at, n = at[likely], n[likely]
                    yield from out(batch.langs[batch.lang[at]], k, batch.phrase(at, k), n)

    counted = texts.mapInArrow(run, COUNT)
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def bits_for(n: int) -> int:
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_PHRASE * n):
        bits *= 2
    return bits


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE) -> DataFrame:
    """lang, k, phrase, n of all phrases of 1 to 4 words that occur ``min_count`` times in a
    language, and (k = 0) the words of each language."""
    drop_used_shuffles(docs.sparkSession)
    bounded_batches(docs.sparkSession, BATCH_MB)
    drawn = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(12))
    texts, few = (
        rows.select(
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
            F.col("text").cast("binary").alias("text"),
        )
        for rows in (docs, docs.where(F.pmod(drawn, F.lit(sample)) == 0))
    )
    # 1. the sample proposes
    few = stage(few, "phrases-sample")
    few_bytes, low = text_bytes(few), max(2, int(LOWER * min_count / sample))
    proposed, marks = None, None
    for k in range(1, LONGEST):
        found = stage(bounded_hashes(few, few_bytes, range(k, k + 1), low, marks), f"phrases-proposed-{k}")
        proposed = found if proposed is None else proposed.unionByName(found)
        n_bits = bits_for(proposed.count())
        marks = marked(proposed, n_bits)
    # 2. all rows: the proposals and their border, bounded, then counted
    every = range(1, LONGEST + 1)
    likely = stage(bounded_hashes(texts, text_bytes(texts), every, min_count, marks), "phrases-likely")
    maybe = marked(likely, bits_for(likely.count()))
    counted = count_phrases(texts, every, marks, maybe=maybe)
    counted = stage(counted.where((F.col("n") >= min_count) | (F.col("k") == 0)), "phrases-counted")
    frequent = counted
    # 3. all that border failures may extend to
    failures = counted.where(f"k > 0 and k < {LONGEST}")
    failures = stage(unmarked(failures, marks), "phrases-failures")
    if not failures.isEmpty():
        wider = marks | marked(failures, n_bits)
        counted = count_phrases(texts, range(2, LONGEST + 1), wider, marks)
        frequent = frequent.unionByName(stage(counted.where(F.col("n") >= min_count), "phrases-expanded"))
    return frequent


# ----------------------------------------------------------------- scores


def collocations(
    docs: DataFrame, top: int = 2000, min_count: int = MIN_COUNT, sample: int = SAMPLE
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``, a null text empty.  Repeated rows count again;
    only ``doc_id`` (for the sample's draw), ``lang`` and ``text`` are read; no
    rows give no phrases.  Ties in score are ordered by count, then by phrase.
    """
    frequent = frequent_phrases(docs, min_count, sample)
    totals = frequent.where("k = 0").select("lang", F.col("n").alias("total"))
    counts = frequent.where("k > 0").select("lang", "k", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    phrases = counts.where("k > 1").withColumn("words", words)
    # each cut, with the counts of its two parts
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "a", "k", "words", cut).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    # the most frequent longer phrase around each
    longer = counts.where("k > 2").withColumn("words", words)
    span = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("span")
    longer = longer.select("lang", "a", "k", "words", span)
    begin = F.explode(F.sequence(F.lit(1), F.col("k") - F.col("span") + 1)).alias("begin")
    inner = longer.select("lang", "a", "words", "span", begin).select(
        "lang", F.array_join(F.slice("words", F.col("begin"), F.col("span")), " ").alias("phrase"), "a"
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        "longest is null or cast(longest as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"
    )
    order = [F.col("lowest.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "lowest.l",
        "lowest.r",
        F.col("total").alias("n"),
        F.col("lowest.score").cast("long").alias("score"),
    )
