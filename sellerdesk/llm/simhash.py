"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits and links to those within ``max_bits`` (1 to 3) of
it.  Cut into two 32-bit segments, of two linked fingerprints one segment
differs in at most one bit.  So each distinct fingerprint is indexed under
each segment's value and under the 32 variants of the segment with one bit
wild; an equality join on the signature finds every linked pair, and the full
distance is verified.  A wild signature pairs fingerprints with that bit clear
with those that have it set, so equal segments meet once, not 33 times.

Copies are folded before the join (one row per distinct fingerprint).  Values
shared by many distinct fingerprints are split exactly: their rows get the
same kind of signatures of the other segment's two 16-bit halves as well, as
of those halves too one differs in at most one bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sellerdesk.llm.common import bounded_batches
from sellerdesk.llm.components import stars
from sellerdesk.session import stage

SEED = 42
HEAVY = 256  # distinct fingerprints of one segment value, above which it is split


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of lower-cased word shingles; 0 where there is no word."""
    words = text.lower().split() if text else []  # bytes: exactly the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(first), 1 << 16):  # bounds the memory of a very long text
        part = zip(first[lo : lo + (1 << 16)], last[lo : lo + (1 << 16)], strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in part], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and its ``carried`` longs; fp is the fingerprint as a signed long."""
    names = ["doc_id", "fp", *carried]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, *batch.columns[2:]], names=names)

    bounded_batches(docs.sparkSession)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"), *carried
    )
    return narrow.mapInArrow(compute, ", ".join(f"{n} long" for n in names))


def _segment(fp: Column, seg: Column) -> Column:
    return F.when(seg == 0, F.shiftrightunsigned(fp, 32)).otherwise(
        fp.bitwiseAND(F.lit(0xFFFFFFFF))
    )


def _bit(value: Column, i: Column) -> Column:
    return F.expr("1L").bitwiseAND(F.call_function("shiftright", value, i))


def _variants(fps: DataFrame) -> DataFrame:
    """66 signatures per fingerprint: sig (long), bit (0, 1; null: nothing wild)."""
    seg, wild = F.expr("cast(k div 33 as int)"), F.expr("cast(k % 33 as int) - 1")
    rows = (
        fps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(65))))
        .withColumn("seg", seg)
        .withColumn("wild", wild)
        .withColumn("value", _segment(F.col("fp"), F.col("seg")))
    )
    bit = F.when(F.col("wild") >= 0, _bit(F.col("value"), F.col("wild")))
    clear = F.col("value").bitwiseAND(
        F.when(F.col("wild") >= 0, F.bitwise_not(F.expr("shiftleft(1L, wild)"))).otherwise(F.lit(-1))
    )
    sig = clear + F.shiftleft(F.col("k").cast("long"), 32)
    return rows.select("fp", "seg", bit.cast("int").alias("bit"), sig.alias("sig"))


def _split_heavy(variants: DataFrame, heavy: DataFrame) -> DataFrame:
    """Add ``sub``: 0, or for heavy signatures one row per signature of the other halves.

    ``flip`` is the sub signature that the partner must have.
    """
    rows = variants.join(heavy, "sig", "left")
    other = _segment(F.col("fp"), F.lit(1) - F.col("seg"))

    def halves(flip: bool) -> Column:
        def code(k: Column) -> Column:
            half = F.call_function("shiftright", other, (F.floor(k / 17) * 16).cast("int"))
            half = half.bitwiseAND(F.lit(0xFFFF))
            wild = (k % 17 - 1).cast("int")
            power = F.call_function("shiftleft", F.lit(1).cast("long"), wild)
            clear = half.bitwiseAND(F.bitwise_not(power))
            bit = _bit(half, wild)
            bit = F.lit(1) - bit if flip else bit
            masked = F.when(wild >= 0, clear + bit * 65536).otherwise(half)
            return masked + (k + 1).cast("long") * (1 << 20)

        return F.transform(F.sequence(F.lit(0), F.lit(33)), code)

    zero = F.array(F.lit(0).cast("long"))
    pairs = F.when(
        F.col("is_heavy").isNull(), F.arrays_zip(zero.alias("sub"), zero.alias("flip"))
    ).otherwise(F.arrays_zip(halves(False).alias("sub"), halves(True).alias("flip")))
    return rows.withColumn("p", F.explode(pairs)).select("fp", "bit", "sig", "p.sub", "p.flip")


def linked_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs (u, v) of distinct fingerprints ``fps(fp)`` within ``max_bits`` bits."""
    if not 1 <= max_bits <= 3:
        raise ValueError("two segments hold for distances of 1 to 3 bits")
    values = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg"))
    values = values.withColumn("value", _segment(F.col("fp"), F.col("seg")))
    crowded = values.groupBy("seg", "value").count().where(F.col("count") > HEAVY)
    # every signature that a crowded value takes part in
    k = F.explode(F.sequence(F.lit(0), F.lit(32)))
    wild = F.expr("k - 1")
    clear = F.when(
        wild >= 0,
        F.col("value").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, k - 1)"))),
    ).otherwise(F.col("value"))
    sig = clear + F.expr("shiftleft(cast(seg * 33 + k as bigint), 32)")
    heavy = crowded.withColumn("k", k).select(sig.alias("sig")).distinct()
    rows = _split_heavy(_variants(fps), heavy.withColumn("is_heavy", F.lit(True)))
    left = rows.where("bit is null or bit = 0").select(
        F.col("sig").alias("ls"), F.col("sub").alias("lsub"), F.col("fp").alias("u")
    )
    right = rows.where("bit is null or bit = 1").select(
        F.col("sig").alias("rs"), F.col("flip").alias("rsub"), F.col("fp").alias("v"), "bit"
    )
    once = F.col("bit").isNotNull() | (F.col("u") < F.col("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    # Spark sizes the exploded signatures like the fingerprints they come from, and would
    # broadcast tens of them per fingerprint; so neither side may be broadcast.
    return left.hint("merge").join(
        right, (F.col("ls") == F.col("rs")) & (F.col("lsub") == F.col("rsub")) & once & close
    ).select("u", "v")


def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``distinct(fp, least)`` plus ``root``, one fingerprint that stands for the component."""
    links = stars(linked_pairs(distinct.select("fp"), max_bits))
    member = links.select(F.col("v").alias("m"), F.col("u").alias("root"))
    return distinct.join(member, F.col("fp") == F.col("m"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links.  Null and empty
    texts have no words and the fingerprint zero, linked like any other; texts
    shorter than a shingle are one shingle.  Repeated rows stay and share a
    component; a null doc_id stays null and counts only if a component has no
    other.  An empty table gives no rows.  Other columns are not read.
    """
    fps = stage(fingerprints(docs, shingle), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = stage(distinct, "simhash-distinct")
    rooted = _rooted(distinct, max_bits)
    # only roots that have members need the smallest id over several fingerprints
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, F.col("root") == F.col("r")).select(
        F.col("fp").alias("f"), "component_id"
    )
    return fps.join(classes, F.col("fp") == F.col("f")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def text_hash() -> Column:
    """Hash of the text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def survivors(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id and text_hash of one row per component of near-duplicates.

    The row of the smallest doc_id, null ids last, then of the smallest hash of
    its text.  Components are those of the fingerprints, whatever ids they
    share; rows equal in both columns are in the same component.
    """
    narrow = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    fps = stage(fingerprints(narrow, shingle, ("text_hash",)), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = stage(fps.groupBy("fp").agg(F.min(row).alias("least")), "simhash-distinct")
    least = _rooted(distinct, max_bits).groupBy("root").agg(F.min("least").alias("least"))
    return least.select("least.doc_id", "least.text_hash")
