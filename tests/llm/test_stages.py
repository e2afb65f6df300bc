"""The pipeline's stages against brute force on the odd table and on an empty one."""

import collections

import numpy as np
from pyspark.sql import functions as F

from sellerdesk.llm import mixing, packing, stages, toxicity
from sellerdesk.llm.queries import byte_bpe

from .conftest import DOCS, doc_rows
from .test_operators_llm import slow_classes, slow_fingerprint

ROWS = doc_rows()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def slow_survivors(rows):
    """Per component: the smallest id, and all rows of it that may stay."""
    near = slow_classes({slow_fingerprint(r[1]) for r in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[near[slow_fingerprint(r[1])]].append(r)
    for own in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in own)
        yield [r for r in own if (r[0] is None, r[0] or 0) == least]


def test_near_duplicates_keep_one_row_of_each_group(spark, docs, no_docs, sf):
    prose = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    lone = " ".join(f"lone{i}" for i in range(60))
    extra = [  # one id with texts of two groups, repeated rows, a group of null ids only
        (3001, prose), (3002, prose), (3001, other), (3000, other), (3001, prose),
        (None, lone), (None, lone), (3003, prose.upper()),
    ]
    rows = ROWS + [(i, t, "en", "a", len(t), "s", "k", "h", "w") for i, t in extra]
    table = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], DOCS))
    found = rows_of(stages.drop_near_duplicates(spark, table, sf))
    wanted = list(slow_survivors(rows))
    assert found.total() == len(wanted)
    for choices in wanted:
        assert sum(found[r] for r in set(choices)) == 1
    assert stages.drop_near_duplicates(spark, no_docs, sf).collect() == []


NAMES = ["_kept", "_key", "_k", "_spans", "row", "id", "hash", "place", "kept_id", "spans", "k", "a.b", "start", "copy"]


def with_names(docs):
    for i, n in enumerate(NAMES):
        docs = docs.withColumn(n, F.lit(f"{i}"))
    return docs.withColumnRenamed("lang", "Lang")


def test_stages_take_columns_of_any_names(spark, docs, sf):
    wide = with_names(docs)
    steps = (stages.drop_toxic, stages.drop_near_duplicates, stages.drop_repeated_passages, stages.mix_sources)
    for step in steps:
        plain, found = step(spark, docs, sf), step(spark, wide, sf)
        assert found.columns == wide.columns
        values = tuple(f"{i}" for i in range(len(NAMES)))
        assert rows_of(found) == collections.Counter({r + values: n for r, n in rows_of(plain).items()})
    assert stages.pack_sequences(spark, wide, sf).count() == stages.pack_sequences(spark, docs, sf).count()


def test_stages_without_n_chars_and_with_other_spelling(spark, docs, sf):
    plain = stages.drop_repeated_passages(spark, docs, sf)
    bare = stages.drop_repeated_passages(spark, docs.drop("n_chars"), sf)
    assert rows_of(bare) == rows_of(plain.drop("n_chars"))
    spelled = docs.withColumnRenamed("text", "Text")
    for step in (stages.drop_toxic, stages.mix_sources):
        assert rows_of(step(spark, spelled, sf)) == rows_of(step(spark, docs, sf))


def test_toxicity_stage_keeps_what_the_chain_does_not_call_toxic(spark, docs, no_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.fit_chain(known, labels)
    verdict = chain.probabilities([None if r[1] is None else r[1].encode() for r in ROWS])[:, -1] > chain.threshold
    want = collections.Counter(r for r, bad in zip(ROWS, verdict, strict=True) if not bad)
    assert rows_of(toxicity.without_toxic(docs, chain)) == want
    assert stages.drop_toxic(spark, no_docs, sf).collect() == []


def test_passage_stage_against_brute_force(spark, docs, no_docs, sf):
    words = [(r[1] or "").encode().split() for r in ROWS]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(ROWS, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r[1]
        want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
    assert rows_of(stages.drop_repeated_passages(spark, docs, sf)) == want
    assert stages.drop_repeated_passages(spark, no_docs, sf).collect() == []


def test_mixing_stage_repeats_as_the_mix_says(spark, docs, no_docs, sf):
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source, r["size"]] += r.times
    found = collections.Counter()
    for r, n in rows_of(stages.mix_sources(spark, docs, sf)).items():
        found[r[0], r[3], len((r[1] or "").encode().split())] += n
    assert found == +taken
    assert stages.mix_sources(spark, no_docs, sf).collect() == []


def test_packing_stage_holds_every_document_once(spark, docs, no_docs, sf):
    pieces = stages.pack_sequences(spark, docs, sf).collect()
    want, encoder = collections.Counter(), packing.Encoder(byte_bpe())
    for r in ROWS:
        ids = np.frombuffer(encoder.encode(r[1] or ""), encoder.kind).tolist() + [packing.END_ID]
        want.update([(r[0], len(ids))])
    assert collections.Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in want.items())
    assert stages.pack_sequences(spark, no_docs, sf).collect() == []
