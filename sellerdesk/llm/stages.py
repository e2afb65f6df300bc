"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents`` in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sellerdesk.llm import mixing, packing, simhash, substring, toxicity
from sellerdesk.llm.common import row_of, table
from sellerdesk.llm.queries import byte_bpe
from sellerdesk.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones, does not reject."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group: of the smallest id (null ids last), then of the smallest text hash.

    Among rows equal in id and text, the least by the columns that have an order.
    """
    first = stage(simhash.survivors(docs, shingle=3, max_bits=2), "survivors")
    first = first.select(
        F.coalesce("doc_id", F.lit(-1)).alias("kept_id"), F.col("text_hash").alias("kept_hash")
    )
    rows = docs.select(  # the row apart, as its columns may have any names
        row_of(docs).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"),
        simhash.text_hash().alias("hash"),
    )
    kept = rows.join(
        first, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi"
    )
    order = [F.col("row.doc_id").asc_nulls_last()]
    for f in docs.schema:
        if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant", "interval")):
            order.append(F.col("row").getField(f.name))
    place = F.row_number().over(Window.partitionBy("id", "hash").orderBy(*order))
    return kept.withColumn("place", place).where("place = 1").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words and more that occur elsewhere.

    Texts that lose words are joined by single spaces and counted anew; a
    document that loses all of them stays, with an empty text.  A table without
    ``n_chars`` stays without it.
    """
    cut = substring.deduped_text(docs, min_words=35)
    kinds = {f.name: f.dataType for f in docs.schema if f.name.lower() == "n_chars"}
    return cut.withColumns({name: F.length("text").cast(kind) for name, kind in kinds.items()})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix of their sources wants."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with their token ids."""
    return packing.pack(docs, byte_bpe(), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]
