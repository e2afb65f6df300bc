"""Substring dedup: suffix automata of reference shards, matching statistics.

A window is ``min_words`` consecutive words of one document.  A word goes if a
window over it also starts anywhere else.  All texts are the reference, so an
automaton of everything, or every document against every shard, would grow with
the square of the corpus.  Instead each window names the shard that can hold its
match:

1. Anchors.  The least hash among the ``GRAM``-word grams of a window (the
   leftmost on ties) is its anchor.  Equal windows have equal anchors, and the
   windows of one anchor occurrence are consecutive: together they are one
   context of min_words to 2 * min_words - GRAM words.  Every window lies in
   exactly one context.
2. Only anchors that occur at least twice can have a match; counts are partial
   sums per task.
3. Contexts of such anchors are cut out of the documents, folded if they are
   equal (a hot passage costs a row per task), and dealt out by anchor: all
   possible matches of a window are in its shard.
4. A task builds the suffix automaton of a shard (a bounded number of words)
   with the occurrences of every state, and streams the shard's contexts through
   it: the matching statistic of a position is the longest match ending there
   that occurs at least twice.  Matches of min_words and more are the spans.
5. Spans go back to their documents, whose words are then removed.

An anchor that occurs more than ``CROWDED`` times (in copies, or in a common line
of texts that differ around it) makes no shard: its folded contexts are put through
steps 1 to 3 again with another hash, which mostly picks anchors outside the common
line, where nothing repeats; copies have become one by then.  What is crowded after ``ROUNDS`` is dealt out by whole
windows, equal ones folded, so no shard holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from sellerdesk.llm.common import bounded_batches, drop_used_shuffles, row_of
from sellerdesk.session import stage

GRAM = 8  # words whose hash can be an anchor; any number below min_words is exact
CROWDED = 512  # occurrences of an anchor (texts folded), above which it makes no shard
ROUNDS = 3
SHARD_WORDS = 40_000  # words of an automaton, but for one whole anchor
PLACE_BITS = 26  # of a gram's place while minima are taken; longer texts go in chunks


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(
    words: list[bytes], min_words: int, seed: int = 0, gram: int = GRAM
) -> tuple[np.ndarray, ...]:
    """(hash, first window, number of windows) of every anchor occurrence."""
    chunk = 1 << PLACE_BITS
    n = len(words) - min_words + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    h = word_hashes(words)
    grams = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += h[k : k + len(grams)]
    grams += np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
    grams ^= grams >> np.uint64(31)  # the low bits of a product are weak
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    width = min_words - gram + 1  # grams in a window
    low = np.uint64(chunk - 1)
    parts = []
    for lo in range(0, n, chunk - width):
        g = grams[lo : lo + chunk]
        ranked = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        least, span = ranked, 1  # least of `span` grams from each place on
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        least = least[: min(n - lo, chunk - width)]
        at = (least & low).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.concatenate((starts, [len(at)])))
        parts.append((g[at[starts]], starts + lo, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SuffixAutomaton:
    """Of several word sequences, with the occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, words: list[bytes], times: int) -> list[int]:
        """Insert a sequence that occurs ``times`` times; returns its prefixes' states."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last, states = 0, []
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q  # the prefix is there already
            else:
                clone_only = q is not None
                if not clone_only:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(0)
                p = last
                if not clone_only:
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    if length[q] != length[p] + 1:
                        c = len(nxt)
                        nxt.append(nxt[q].copy())
                        link.append(link[q])
                        length.append(length[p] + 1)
                        count.append(0)
                        while p >= 0 and nxt[p].get(w) == q:
                            nxt[p][w] = c
                            p = link[p]
                        link[q] = c
                        q = c
                    if clone_only:
                        cur = q
                    else:
                        link[cur] = q
                last = cur
            count[last] += times
            states.append(last)
        return states

    def repeats(self) -> list[int]:
        """For each state the length of its longest suffix that occurs twice or more."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        count, link = self.count, self.link
        for v in reversed(order):
            if link[v] > 0:
                count[link[v]] += count[v]
        best = [0] * len(self.next)
        for v in order:
            best[v] = self.length[v] if count[v] > 1 else best[link[v]]
        return best


def shard_spans(contexts: list[tuple[list[bytes], int]], min_words: int) -> list[list[tuple[int, int]]]:
    """For each (words, times) its maximal spans (from, to) of repeated windows."""
    automaton = SuffixAutomaton()
    states = [automaton.add(words, times) for words, times in contexts]
    best = automaton.repeats()
    length = automaton.length
    out = []
    for own in states:
        spans: list[tuple[int, int]] = []
        for end, state in enumerate(own, 1):
            # a state of a longer text holds this prefix and its longer suffixes
            match = min(best[state], end) if length[state] > end else best[state]
            if match >= min_words:
                start = end - match
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), end)
                else:
                    spans.append((start, end))
        out.append(spans)
    return out


ANCHOR = "anchor long, key binary, first int, windows int, times long"
CONTEXT = "anchor long, ctx binary, key binary, first int, words binary, times long, crowded boolean"
SPAN = "ctx binary, start int, stop int"
KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "binary": pa.binary(),
    "string": pa.string(),
    "boolean": pa.bool_(),
}


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _anchor_rows(texts: DataFrame, min_words: int, seed: int) -> DataFrame:
    """Every anchor occurrence of ``texts(key, text, times)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                found = [anchors(t.split(), min_words, seed) for t in texts[lo : lo + 512]]
                sizes = [len(f[0]) for f in found]
                take = pa.array(np.repeat(np.arange(len(sizes)), sizes) + lo)
                h, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                arrays = [
                    pa.array(h.view(np.int64)),
                    batch.column(0).take(take),
                    pa.array(first.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    batch.column(2).take(take),
                ]
                names = [x.split()[0] for x in ANCHOR.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts.select("key", "text", "times").mapInArrow(run, ANCHOR)


def _cut(texts: DataFrame, min_words: int) -> DataFrame:
    """The contexts of ``texts(key, text, times, runs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, times, runs in _rows(batch):
                words = text.split()
                for r in runs:
                    first = r["first"]
                    ctx = b" ".join(words[first : first + r["windows"] + min_words - 1])
                    digest = xxh3_128_digest(ctx)
                    rows.append((r["anchor"], digest, key, first, ctx, times, r["crowded"]))
                    if len(rows) >= 8192:
                        yield _record(CONTEXT, rows)
                        rows = []
            if rows:
                yield _record(CONTEXT, rows)

    return texts.select("key", "text", "times", "runs").mapInArrow(run, CONTEXT)


def _match(shards: DataFrame, min_words: int) -> DataFrame:
    """Repeated spans of ``shards(shard, ctx, words, times)``.

    Shards are dealt out by a hash and gathered, whole, to about SHARD_WORDS
    words, which share an automaton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solve() -> list[tuple]:
            found = shard_spans([x[1:] for x in held], min_words)
            return [(x[0], a, b) for x, own in zip(held, found, strict=True) for a, b in own]

        for batch in batches:
            out: list[tuple] = []
            for shard, ctx, text, times in _rows(batch):
                if shard != last and size >= SHARD_WORDS:
                    out += solve()
                    held, size = [], 0
                last = shard
                words = text.split(b" ")
                held.append((ctx, words, times))
                size += len(words)
            if out:
                yield _record(SPAN, out)
        if held and (out := solve()):
            yield _record(SPAN, out)

    dealt = shards.repartition("shard").sortWithinPartitions("shard", "ctx")
    return dealt.select("shard", "ctx", "words", "times").mapInArrow(run, SPAN)


def _fold(contexts: DataFrame) -> DataFrame:
    """Equal contexts as one, with their number; text minima need no row order."""
    return contexts.groupBy("ctx").agg(
        F.first("anchor").alias("anchor"),
        F.first("words").alias("words"),
        F.sum("times").alias("times"),
    )


def _by_windows(crowded: DataFrame, min_words: int) -> DataFrame:
    """Spans of contexts whose windows are matched one by one."""
    piece = "ctx binary, at int, piece binary, words binary, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ctx, text, times in _rows(batch):
                words = text.split(b" ")
                for i in range(len(words) - min_words + 1):
                    window = b" ".join(words[i : i + min_words])
                    rows.append((ctx, i, xxh3_128_digest(window), window, times))
                if len(rows) >= 8192:
                    yield _record(piece, rows)
                    rows = []
            if rows:
                yield _record(piece, rows)

    pieces = stage(crowded.select("ctx", "words", "times").mapInArrow(run, piece), "windows")
    folded = pieces.groupBy("piece").agg(
        F.first("words").alias("words"), F.sum("times").alias("times")
    )
    shards = folded.select(
        F.xxhash64("piece").alias("shard"), F.col("piece").alias("ctx"), "words", "times"
    )
    found = _match(shards, min_words).select(F.col("ctx").alias("p")).distinct()
    return pieces.join(found, F.col("piece") == F.col("p")).select(
        "ctx", F.col("at").alias("start"), (F.col("at") + min_words).cast("int").alias("stop")
    )


def _spans(texts: DataFrame, min_words: int, seed: int = 0) -> DataFrame:
    """Repeated spans (key, start, stop) of ``texts(key, text, times)``."""
    rows = stage(_anchor_rows(texts, min_words, seed), "anchors")
    twice = rows.groupBy(F.col("anchor").alias("a")).agg(
        F.sum("times").alias("n"), (F.count("*") > CROWDED).alias("crowded")
    )
    # written, as AQE splits a hot join key only where both sides come from a shuffle
    # of their own, not from an aggregation by that key
    twice = stage(twice.where(F.col("n") > 1).drop("n"), "repeated")
    runs = (
        rows.join(twice, F.col("anchor") == F.col("a"))
        .groupBy(F.col("key").alias("k"))
        .agg(F.collect_set(F.struct("anchor", "first", "windows", "crowded")).alias("runs"))
    )
    contexts = stage(_cut(texts.join(runs, F.col("key") == F.col("k")), min_words), "contexts")
    normal = _fold(contexts.where(~F.col("crowded")))
    spans = _match(normal.withColumnRenamed("anchor", "shard"), min_words)
    crowd = contexts.where("crowded")
    if not crowd.isEmpty():
        hard = _fold(crowd)
        if seed + 1 < ROUNDS:
            again = hard.select(F.col("ctx").alias("key"), F.col("words").alias("text"), "times")
            again = _spans(stage(again, "crowd"), min_words, seed + 1)
            again = again.withColumnRenamed("key", "ctx")
        else:
            again = _by_windows(hard, min_words)
        spans = spans.unionByName(again)
    spans = spans.groupBy(F.col("ctx").alias("c")).agg(
        F.collect_set(F.struct("start", "stop")).alias("found")  # of one short context
    )
    spans = stage(spans, "context-spans")  # as above
    placed = contexts.select("key", "first", "ctx").join(spans, F.col("ctx") == F.col("c"))
    placed = placed.select("key", "first", F.explode("found").alias("s"))
    return stage(
        placed.select(
            "key",
            (F.col("first") + F.col("s.start")).alias("start"),
            (F.col("first") + F.col("s.stop")).alias("stop"),
        ),
        "spans",
    )


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """``words`` without those in the (possibly overlapping) spans."""
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:]


def with_spans(docs: DataFrame, min_words: int = 35) -> DataFrame:
    """``row`` (a row of ``docs`` as a struct) and ``spans``: the repeated spans
    (start, stop) of its text, or null.

    The key of a row is its doc_id and a hash of its text: rows equal in both
    have equal spans, and each counts as an occurrence.  Other columns of
    ``docs`` may have any names.
    """
    if min_words <= GRAM:
        raise ValueError(f"a window needs more than {GRAM} words")
    spark = docs.sparkSession
    bounded_batches(spark, 8)
    drop_used_shuffles(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.lpad(F.hex(x), 16, "0") for x in (F.col("doc_id").cast("long"), F.xxhash64(text))]
    key = F.unhex(F.concat(F.coalesce(parts[0], F.lit("f" * 16)), parts[1]))
    texts = docs.select(
        key.alias("key"), text.cast("binary").alias("text"), F.lit(1).cast("long").alias("times")
    )
    spans = _spans(texts, min_words)
    lists = spans.groupBy(F.col("key").alias("k")).agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    keyed = docs.select(row_of(docs).alias("row"), key.alias("key"))
    return keyed.join(lists, F.col("key") == F.col("k"), "left").select("row", "spans")


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["start"], s["stop"]) for s in spans or ()]


def dedup_digests(docs: DataFrame, min_words: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A null or empty text has no words and the digest of nothing.  Texts of fewer
    than ``min_words`` words lose none.  Repeated rows are occurrences of each
    other, so texts of min_words and more vanish in all of them; a null doc_id is
    an id like others.  An empty table gives no rows.  Other columns are not read.
    """
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in _rows(batch):
                words = (text or b"").split()
                kept = kept_words(words, _pairs(spans))
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                rows.append((doc_id, len(words), len(words) - len(kept), digest))
            if rows:
                yield _record(result, rows)

    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    return found.select(
        "row.doc_id", F.col("row.text").cast("binary").alias("text"), "spans"
    ).mapInArrow(run, result)


def deduped_text(docs: DataFrame, min_words: int = 35) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``; texts without any stay as they are."""

    names = docs.columns
    at = [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].cast(pa.binary()).to_pylist()
            out = [
                b" ".join(kept_words(t.split(), _pairs(s))) if s else t
                for t, s in zip(texts, batch.column(1).to_pylist(), strict=True)
            ]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    return with_spans(docs, min_words).mapInArrow(run, schema)
