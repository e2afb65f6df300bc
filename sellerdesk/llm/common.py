"""Helpers shared by the llm operators."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerdesk.session import drop_used_shuffles  # noqa: F401 - the operators take it from here

# A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """The whole row as one struct, beside which columns of any names may stand."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def n_words(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, mb: int = 16) -> None:
    """Bound the Arrow batches sent to Python workers by bytes.

    The default bounds rows only, so ten thousand very long texts would make
    one batch; a worker's memory must not depend on the texts' lengths.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def draw(seed: int, *cols: Column) -> Column:
    """A seeded uniform draw per row: a long in [0, 2^52)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    text = F.concat_ws("|", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


DRAW_RANGE = float(1 << 52)


def planes(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small numbers cost nothing."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of :func:`planes`."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()
