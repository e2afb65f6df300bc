"""Merkle proofs, phrase mining and pattern packing against brute force on odd tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sellerdesk.llm import merkle, pattern_packing, phrases

from .conftest import DOCS, doc_rows

ROWS = doc_rows()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def wide(docs):
    for c in ("part", "pos", "n", "leaf", "a.b", "hash", "level", "number", "length", "rank", "k", "phrase"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


# ------------------------------------------------------------- 11 Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(values):
    cells = [None if v is None else str(v) for v in values]
    return h(*("-" if c is None else f"{len(c.encode())}:{c}" for c in cells))


def climb(nodes):
    """(root, siblings left and right of each node by level)."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, groups = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for i, own in enumerate(members[lo : lo + 16]):
                for m in own:
                    paths[m].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            groups.append(list(itertools.chain(*members[lo : lo + 16])))
        nodes, members = up, groups
    return nodes[0], paths


def slow_merkle(rows):
    by_source = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = slow_leaf([doc_id, source, lang, n_chars, text])
        attacked = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            attacked = slow_leaf([doc_id, source, lang, n_chars, None if text is None else lower(text)])
        by_source[source].append(((doc_id is not None, doc_id or 0, own), doc_id, own, attacked))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(by_source[s], key=lambda r: r[0])]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    for s, upper in zip(order, above, strict=True):
        for (_, doc_id, own, attacked), path in zip(
            sorted(by_source[s], key=lambda r: r[0]), trees[s][1], strict=True
        ):
            steps, folded = path + upper, attacked
            for a, b in steps:
                folded = h(a, folded, b)
            yield doc_id, own, trees[s][0], root, h(*(a + b for a, b in steps)), folded, folded == root


def test_merkle(spark, docs, no_docs):
    many = [(1000 + i, f"Text {i}", "en", "a" if i % 3 else f"s{i % 40}", i, *"skhw") for i in range(900)]
    rows = ROWS + many + [many[7]] * 40
    table = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], DOCS))
    want = collections.Counter(slow_merkle(rows))
    assert counted(merkle.merkle_proofs(table)) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    assert counted(merkle.merkle_proofs(wide(table))) == want
    assert merkle.merkle_proofs(no_docs).collect() == []
    alone = table.where("doc_id = 1003")
    (one,) = merkle.merkle_proofs(alone).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")


def test_merkle_proofs_of_a_subset(spark, docs):
    manifest = merkle.build_manifest(merkle.leaves(docs))
    whole = {tuple(r)[:6] for r in merkle.prove(manifest).collect()}
    some = merkle.prove(manifest, F.col("doc_id") % 3 == 0, full=True).collect()
    assert {tuple(r)[:6] for r in some} <= whole
    assert len(some) == docs.where("doc_id % 3 = 0").count()
    assert all(h(*r.proof) == r.proof_sha256 for r in some)


def test_missing_coordinates_are_few():
    n = 100_000
    found = list(merkle.missing_coordinates(np.arange(33_333, 50_001), n))
    assert len(found) <= 30 * 5 and len(set(found)) == len(found)
    assert list(merkle.missing_coordinates(np.arange(n), n)) == []
    assert sorted(merkle.missing_coordinates(np.array([0]), 17)) == [(0, i) for i in range(1, 16)] + [(1, 1)]


def test_positions_of_equal_rows_are_dealt_out(spark):
    rows = spark.range(40_000).selectExpr("cast(null as string) as source", "1L as doc_id", "'x' as leaf")
    placed = merkle.numbered(rows, ["source"], ["doc_id", "leaf"], "test-placed")
    assert placed.groupBy("part").count().agg(F.max("count")).first()[0] < 16_000
    assert placed.select("pos").distinct().count() == 40_000
    assert placed.agg(F.min("pos"), F.max("pos"), F.max("n")).first()[:] == (0, 39_999, 40_000)


# ------------------------------------------------------------- 12 phrases


def slow_phrases(rows, low, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", *w[i : i + k]] += 1
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= low}
    longest = collections.Counter()
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, *w[i : i + k]] = max(longest[lang, *w[i : i + k]], a)
    ranked = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        cuts = [(f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        if 100 * longest[lang, *w] < 80 * a:
            ranked[lang].append((-score, -a, " ".join(w).encode(), l, r))
    for lang, own in ranked.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, n[lang], -score


@pytest.fixture(scope="module")
def prose(spark):
    r = np.random.default_rng(5)
    words = ["a", "B", "ç", "dé", "e\xa0e", "f|f", "G"]
    rows = []
    for i in range(300):
        w = [words[min(int(x), 6)] for x in r.geometric(0.35, 30) - 1]
        ends = r.choice([" ", " ", " ", "\t", ". ", "\n", " ,"], 30)
        text = "".join(itertools.chain(*zip(w, ends, strict=True)))
        rows.append((i, text, [None, "en", "de", "und"][i % 4], "s", len(text), *"skhw"))
    rows += [(999, "rare words. rare words " * 40, "en", "s", 1, *"skhw")]
    rows += ROWS
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.mark.parametrize("sample", [2, 40, 10**9])
def test_phrases(prose, sample):
    """Any sample gives the same result: a poor one, or none, takes further passes."""
    rows, docs = prose
    assert counted(phrases.collocations(docs, 2000, 30, sample)) == collections.Counter(slow_phrases(rows, 30))


def test_phrases_limits(prose, no_docs):
    rows, docs = prose
    assert counted(phrases.collocations(wide(docs), 5, 9)) == collections.Counter(slow_phrases(rows, 9, 5))
    assert phrases.collocations(no_docs).collect() == []


def test_phrase_scores_pass_64_bits(spark, monkeypatch):
    big = 3 * 10**18
    counts = [("en", 0, "", 2 * big), ("en", 1, "x", big + 1), ("en", 1, "y", big), ("en", 2, "x y", big)]
    table = spark.createDataFrame(counts, "lang string, k int, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: table)
    (row,) = phrases.collocations(None).collect()
    assert tuple(row) == ("en", 1, "x y", big, big + 1, big, 2 * big, 2_000_000 * big // (2 * big + 1))


def test_marked_phrases_are_found(spark):
    rows = [("en", f"w{i} w{i + 1}" if i % 2 else f"w{i}") for i in range(1000)]
    h = phrases.phrase_hashes(*zip(*rows, strict=True))
    table = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "hash long")
    marks = phrases.marked(table.where("hash % 3 = 0"), 1 << 20)
    missing = spark.createDataFrame(rows, "lang string, phrase string")
    found = {r.hash for r in phrases.unmarked(missing, marks).collect()}
    assert found == {int(x) for x in h.view(np.int64) if x.astype(np.int64) % 3}


# ------------------------------------------------------------- 13 pattern packing


@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers as public

    return public.path("word_bpe_49k.json")


def slow_pieces(rows, path, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), size)):
            own = np.array(ids[start : start + size], "<u4")
            yield doc_id, piece, start, len(own), zlib.crc32(own.tobytes())


def check_sequences(pieces, size):
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        ends = np.cumsum([length for _, length in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= size
    return len(sequences)


def test_pattern_packing(spark, docs, no_docs, word_bpe):
    odd = ["<|startoftext|>x<|endoftext|> a", "ΑΣ don't é ́", "\xa0nbsp wide", "😀 ﬁ ǅ"]
    rows = ROWS + [(5000 + i, t, "en", "s", 1, *"skhw") for i, t in enumerate(odd)]
    table = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], DOCS))
    for size in (64, 4096):
        want = collections.Counter(slow_pieces(rows, word_bpe, size))
        found = pattern_packing.pack(wide(table), word_bpe, size).collect()
        assert collections.Counter(tuple(p)[:5] for p in found) == want
        n = check_sequences(found, size)
        total = sum(p.length for p in found)
        assert n <= -(-total // size) * 1.05 + 1
    assert pattern_packing.pack(no_docs, word_bpe).collect() == []
    for p in pattern_packing.pack_with_ids(table, word_bpe, 64).collect():
        ids = np.frombuffer(p.ids, "<u2").astype("<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    size = int(r.choice([16, 100, 512, 4096]))
    n = int(r.integers(1, 400))
    lengths = np.clip((r.lognormal(np.log(size) - r.uniform(0.2, 4), 1, n)).astype(int), 1, size)
    if seed % 3 == 0:
        lengths[: n // 2] = lengths[0]  # one length holds half of all pieces
    plan = pattern_packing.plan_packing(np.bincount(lengths, minlength=size + 1), size)
    places, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, first, count, copies, fill in plan.segments:
        ranks[length] += range(rank, rank + count * copies)
        for nth in range(count * copies):
            places[first + nth // copies].append((fill + nth % copies * length, length))
    assert {x: sorted(v) for x, v in ranks.items()} == {
        x: list(range(c)) for x, c in collections.Counter(lengths.tolist()).items()
    }
    assert sorted(places) == list(range(plan.sequences))
    for own in places.values():
        own.sort()
        ends = np.cumsum([x for _, x in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= size


def test_nnls_meets_its_conditions():
    r = np.random.default_rng(2)
    for _ in range(20):
        a, b = r.normal(size=(12, 30)), r.normal(size=12)
        x = pattern_packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_fitted_patterns_use_up_a_histogram_they_made():
    units, shapes = 32, pattern_packing.patterns(32)
    histogram = np.zeros(33)
    for shape, n in (((20, 12), 50), ((16, 10, 6), 30), ((32,), 7)):
        np.add.at(histogram, list(shape), n)
    repeats = pattern_packing.fit_repeats(histogram, shapes, units)
    assert repeats.sum() == 87 and all(sum(s) == 32 for s in shapes)
