"""The llm operators against brute force on small odd tables."""

import collections
import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sellerdesk.llm import (
    components,
    elias_fano,
    language_model,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    topk,
    toxicity,
    warc,
)
from sellerdesk.llm.queries import byte_bpe

from .conftest import doc_rows

ROWS = doc_rows()


def words(text):
    return (text or "").encode().split()


def same_rows(a, b):
    assert collections.Counter(a) == collections.Counter(b)


# ------------------------------------------------------------- 1 quality


def slow_quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(len(x.decode()) for x in w),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
        len(w) < 10 or 100 * len(hit) > 20 * len(w),
    )


def test_quality_counts(docs, no_docs):
    got = quality.judge(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same_rows(
        [(r.doc_id, *(r[n] for n in names)) for r in got],
        [(x[0], *slow_quality(x[1])) for x in ROWS],
    )
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(no_docs).collect() == []


def test_quality_lines():
    assert quality.line_fault(b"A full sentence.") == 0
    assert quality.line_fault("Ein Satz“ und mehr. Noch".encode()) == 0
    assert quality.line_fault(b"no end at all") == 1
    assert quality.line_fault(b"a### b### c### d.") == 1
    assert quality.line_fault(b"Home | About | Login | Search.") == 2
    assert quality.line_fault(b"Please read our Privacy Policy.") == 3
    assert quality.clean_text(b"Kept.\n\nHome | About | Login | Search\nno end") == b"Kept.\n"


LINE_TEXTS = [
    "Startseite | Kontakt | Impressum | Suche\n" + "Ein ganzer Satz mit vielen Wörtern steht hier. " * 2,
    "Accueil Connexion Panier Aide\nUne phrase entière avec assez de mots se trouve bien ici.",
    "Inicio Contacto Buscar Ayuda\nUna frase entera con bastantes palabras está escrita aquí abajo.",
    "POLÍTICA DE PRIVACIDAD.\nLa política de privacidad.\nTous droits réservés.\nAlle Rechte vorbehalten.",
    "Lesen Sie unsere Datenschutzerklärung, bevor Sie weiter unten auf dieser Seite etwas bestellen.",
    "Er ging weiter zur Suche nach dem Konto, und niemand konnte ihm dabei helfen.",
    "no end of any sentence in this line of a good dozen words\nOnly this one ends.",
    "a# b# c# d# e# f# g# h# i# j# k# l#.\nThis sentence is long enough to be kept by any rule at all.",
]


def slow_line_fault(line):
    """The line rules on text, by regular expressions."""
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", line)
    known = {f(x) for ws in quality._LINKS.values() for x in ws.split() for f in (str.lower, str.title, str.upper)}
    links = len([x for x in w if x in known])
    seps = len(re.findall(r"[|»›•·]", line)) + line.count(" > ") + line.count(" / ")
    if (seps >= 3 and seps + 1 >= len(w) / 4) or (links >= 3 and links >= len(w) / 2):
        return 2
    if any(re.search(re.escape(p), line, re.IGNORECASE) for ps in quality._PHRASES.values() for p in ps):
        return 3
    ends = re.search(r"""[.!?…。！？:;"'”’»)\]][ \t\n\x0b\x0c\r]*\Z|[.!?] """, line)
    return int(not ends or len(re.findall(r"[#*$%&|<>]", line)) > len(w) / 2)


def test_quality_verdict_against_slow_rules(docs, spark):
    more = [(1000 + i, t) for i, t in enumerate(LINE_TEXTS)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    expected, found = [], set()
    for doc_id, text in [(x[0], x[1] or "") for x in ROWS] + more:
        lines = [x for x in text.split("\n") if words(x)]
        faults = [slow_line_fault(x) for x in lines]
        found.update(faults)
        lost = sum(len(words(x)) for x, f in zip(lines, faults, strict=True) if f)
        kept = not slow_quality(text)[-1] and lost <= len(words(text)) / 2
        expected.append((doc_id, *(faults.count(k) for k in (1, 2, 3)), lost, kept))
    names = ("bad_punctuation", "navigation", "boilerplate", "n_removed_words", "kept")
    same_rows([(r.doc_id, *(r[n] for n in names)) for r in quality.judge(table).collect()], expected)
    assert found == {0, 1, 2, 3} and {x[-1] for x in expected} == {True, False}
    assert [slow_line_fault(x) for x in LINE_TEXTS[3].split("\n")] == [3, 3, 3, 3]
    assert slow_line_fault(LINE_TEXTS[5]) == 0


def test_quality_cleaned(docs):
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.cleaned(docs).collect()} == kept


# ------------------------------------------------------------- 2 packing


def test_hilbert_is_a_curve():
    cells = np.array(list(itertools.product(range(8), repeat=2)))
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(64))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe().path)
    want = collections.Counter()
    for doc_id, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc_id, len(ids), np.array(ids, "<u4").tobytes()] += 1
    pieces = packing.pack(docs, byte_bpe(), 2048, partitions=3).collect()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        ids = np.frombuffer(p.ids, np.uint16).astype("<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(ids.tobytes()) == p.ids_crc32
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]]
        assert ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= 2048
    # pieces of a document follow each other along the curve
    got, open_ = collections.Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        at = (p.doc_id, p.doc_tokens)
        held = b"" if p.start == 0 else open_.pop(at)
        assert len(held) == 4 * p.start
        held += np.frombuffer(p.ids, np.uint16).astype("<u4").tobytes()
        if len(held) == 4 * p.doc_tokens:
            got[(*at, held)] += 1
        else:
            open_[at] = held
    assert not open_ and got == want
    assert packing.pack(no_docs, byte_bpe()).collect() == []


# ------------------------------------------------------------ 3 toxicity


def test_chain_learns_held_out(spark):
    import random

    r = random.Random(3)
    bad = toxicity.SEEDS["insult"][:4] + toxicity.SEEDS["contempt"][:4]
    rows = []
    for i in range(900):
        w = [f"v{r.randint(0, 200)}" for _ in range(r.randint(5, 80))]
        if i % 5 == 0:
            w.insert(r.randint(0, len(w)), r.choice(bad) + ",")
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    rows += [(None, None, None), (901, "", 0), (3, rows[3][1], 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.where("doc_id % 3 <> 0 or doc_id is null").select("doc_id", "toxic")
    chain = toxicity.fit_chain(table, labels)
    found = toxicity.score(table, chain).collect()
    assert len(found) == len(rows)
    truth = {i: t for i, _, t in rows}
    held = [x for x in found if x.doc_id is not None and x.doc_id % 3 == 0]
    right = sum(x.toxic == (truth[x.doc_id] == 1) for x in held)
    assert right / len(held) > 0.97
    assert len(chain.links) == len(toxicity.CATEGORIES)
    assert [len(w) for w in chain.links] == [len(chain.vocabulary) + 1 + k for k in range(3)]
    kept = toxicity.without_toxic(table, chain)
    assert kept.columns == table.columns
    assert kept.count() == sum(not x.toxic for x in found)


def slow_logistic(x, y, ridge=0.05):
    """Reweighted least squares, the ridge as added rows."""
    x = np.c_[x, np.ones(len(x))]
    root = np.diag(np.sqrt([ridge] * (x.shape[1] - 1) + [1e-3]))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        v = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        goal = v * (x @ w) + (y - p) / v
        w = np.linalg.lstsq(np.r_[v[:, None] * x, root], np.r_[goal, np.zeros(len(w))], rcond=None)[0]
    return w


def test_links_against_slow_chain():
    """Every link's weights, from earlier links' predictions of rows their fit did not see."""
    r = np.random.default_rng(5)
    x = (r.random((150, 6)) < 0.4).astype(float)
    y = np.c_[x[:, 0] + x[:, 1] + r.normal(0, 1, 150) > 1, x[:, 2] + r.normal(0, 1, 150) > 0.5,
              x[:, 0] + x[:, 2] + r.normal(0, 1, 150) > 1].astype(float)
    folds = r.integers(0, toxicity.FOLDS, 150)
    seen = x
    for k, w in enumerate(toxicity.fit_links(x, y, folds)):
        assert np.allclose(w, slow_logistic(seen, y[:, k]), atol=2e-3)
        unseen = np.empty(150)
        for f in range(toxicity.FOLDS):
            v = slow_logistic(seen[folds != f], y[folds != f, k])
            unseen[folds == f] = 1 / (1 + np.exp(-(seen[folds == f] @ v[:-1] + v[-1])))
        p = np.clip(unseen, 1e-4, 1 - 1e-4)
        seen = np.c_[seen, np.log(p / (1 - p))]


def test_links_do_not_trust_memorised_categories():
    """A category that the words cannot tell helps the next link only if predictions are in fold."""
    r = np.random.default_rng(6)
    x = (r.random((90, 200)) < 0.5).astype(float)
    noise = (r.random(90) < 0.5).astype(float)
    folds = np.arange(90) % toxicity.FOLDS
    first, second = toxicity.fit_links(x, np.c_[noise, noise], folds)
    fitted = toxicity.log_odds(toxicity.predict(x, first))
    leaky = toxicity.fit_logistic(np.c_[x, fitted], noise)
    assert ((fitted > 0) == (noise > 0)).mean() > 0.97
    assert leaky[-2] > 0.2 and second[-2] < leaky[-2] / 4


def test_chain_without_labels(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    assert toxicity.without_toxic(docs, chain).count() == len(ROWS)
    assert toxicity.score(no_docs, chain).collect() == []


# ------------------------------------------------------------- 4 simhash


def slow_fingerprint(text):
    w = words(text.translate({c: c + 32 for c in range(65, 91)})) if text else []
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("heavy", [256, 1])
def test_simhash(docs, no_docs, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    fps = [(x[0], slow_fingerprint(x[1])) for x in ROWS if x[1] is None or len(x[1]) < 5000]
    small = docs.where("text is null or length(text) < 5000")
    near = slow_classes({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[near[f]] = min(i, least.get(near[f], i))
    got = simhash.near_duplicates(small).collect()
    same_rows(
        [(r.doc_id, r.fingerprint, r.component_id) for r in got],
        [(i, f"{f:016x}", least.get(near[f])) for i, f in fps],
    )
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("heavy", [256, 2])
def test_linked_pairs_lose_none(spark, heavy, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "HEAVY", heavy)
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.choice([0, 1, 2, 31, 32, 33, 63, r.randint(0, 63)])
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = simhash.linked_pairs(spark.createDataFrame(signed, "fp long")).collect()
    mask = (1 << 64) - 1
    got = {frozenset((x.u & mask, x.v & mask)) for x in found}
    want = {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert got == want


def test_linked_pairs_broadcast_no_signatures(spark, tmp_path):
    # the table is small, its signatures are 66 a row: sizes are guessed from the table
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.linked_pairs(spark.read.parquet(str(tmp_path / "fps")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "Join [ls#" in line or "Join [rs#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_stars(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 7), (50, 60), (60, 50), (70, 70)]
    got = {(r.u, r.v) for r in components.stars(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {(0, i) for i in [*range(1, 31), 100]} | {(50, 60)}


# ----------------------------------------------------------- 5 substring


def slow_substring(rows, n):
    where = collections.Counter()
    split = [(i, words(t)) for i, t in rows]
    for _, w in split:
        where.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for i, w in split:
        gone = {j for k in range(len(w) - n + 1) if where[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize(("crowded", "rounds"), [(512, 3), (0, 1), (1, 2)])
def test_substring(docs, no_docs, crowded, rounds, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    monkeypatch.setattr(substring, "ROUNDS", rounds)
    got = substring.dedup_digests(docs, 35).collect()
    same_rows(
        [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got],
        list(slow_substring([x[:2] for x in ROWS], 35)),
    )
    if crowded == 512:
        assert substring.dedup_digests(no_docs, 35).collect() == []
        cut = substring.deduped_text(docs, 35)
        assert cut.columns == docs.columns and cut.count() == len(ROWS)


def test_matching_statistics():
    import random

    r = random.Random(8)
    contexts = [([r.choice([b"a", b"b"]) for _ in range(r.randint(4, 20))], r.randint(1, 2)) for _ in range(30)]
    n = 4
    where = collections.Counter()
    for w, times in contexts:
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])] += times
    for (w, _), spans in zip(contexts, substring.shard_spans(contexts, n), strict=True):
        want = {j for k in range(len(w) - n + 1) if where[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        assert {j for a, b in spans for j in range(a, b)} == want


# ------------------------------------------------------- 6 mixing, 8 shards


def test_water_fill(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 5, None: 300}
    order = ["a", "b", "c", "d", None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, budget = {}, set(order), float(sum(sizes.values()))
    while free:  # clamp and share again until none is above
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        budget -= sum(3 * sizes[s] for s in over)
        free -= over
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = mixing.water_fill(mixing.cyclic_weights(rows)).collect()
    assert {r.source: r.target for r in got} == pytest.approx(target)


def test_mixing(docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        # rows with one id and text share a draw, so up to three count as one
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * max(r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(no_docs).collect() == []
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.times for r in got)


@pytest.mark.parametrize("bucket", [4096, 4])
def test_sharding(docs, no_docs, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    got = sharding.interleave_shards(sharding.shard_rows(docs), 16).collect()
    same_rows(
        [(r.doc_id, r.size, r.text_crc32) for r in got],
        [(x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in ROWS],
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    empty = sharding.interleave_shards(sharding.shard_rows(no_docs), 16)
    assert empty.collect() == [] and {"shard", "slot"} <= set(empty.columns)


def slow_draw(seed, *values):
    text = "|".join([str(seed), *("" if v is None else str(v) for v in values)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def slow_shards(rows, n_shards, seed=20240501):
    """Places by one sort of all rows: (doc_id, source, size, crc) -> with shard and slot."""

    def nulls_first(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((slow_draw(seed, r[0], r[3]), nulls_first(r[0]), r[3], r))
    placed = []
    for source, own in by_source.items():
        phase = slow_draw(seed + 1, source) / 2.0**52
        for k, x in enumerate(sorted(own, key=lambda x: x[:3])):
            placed.append(((k + phase) / len(own), nulls_first(source), *x))
    placed.sort(key=lambda x: x[:5])
    out, start = [], {}
    for at, x in enumerate(placed):
        shard = at * n_shards // len(placed)
        out.append((*x[-1], shard, at - start.setdefault(shard, at)))
    return out


@pytest.mark.parametrize("bucket", [4096, 4])
def test_sharding_against_one_sort(docs, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = sharding.shard_rows(docs)
    narrow = [(x[0], x[3], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in ROWS]
    for n_shards in (16, 7):
        got = sharding.interleave_shards(rows, n_shards).collect()
        same_rows(
            [(r.doc_id, r.source, r["size"], r.text_crc32, r.shard, r.slot) for r in got],
            slow_shards(narrow, n_shards),
        )


def test_shards_hold_the_mixture(spark):
    rows = spark.range(3200).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "1L as size", "id as text_crc32"
    )
    got = sharding.interleave_shards(rows, 16).groupBy("source", "shard").count().collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r["count"])
    assert all(len(c) == 16 and max(c) - min(c) <= 2 for c in by.values())


# ---------------------------------------------------------------- 7 WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://é \r\nX: y/", "é" * 9)]
    pages += [(4, "u", None), (5, "u", ""), (6, "u", "z" * 200_000), (2, None, "<p>x</p>"), (None, "n", "<p>x</p>")]
    pages += [(None, "n", "alone"), (None, "n", "alone")]
    rows = [(*p, "other") for p in pages]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))

    def want(least):
        for i, _, h in pages:
            raw = (h or "").encode()
            refers = top.get(h or "") if len(raw) >= least and top.get(h or "") != i else None
            kind = "response" if refers is None else "revisit"
            yield i, len(raw), warc.digest32(raw), kind, refers

    for least in (0, 100):
        got = warc.archive_pages(table, least).collect()
        same_rows([tuple(r) for r in got], list(want(least)))
    records = warc.plan_records(table)
    back = warc.read_archives(warc.write_archives(records, roll_bytes=100), payloads=True).collect()
    assert {(r.page_id, bytes(r.payload)) for r in back if r.payload is not None} >= {(6, b"z" * 200_000)}
    assert warc.archive_pages(table.limit(0)).collect() == []


def test_warc_reader_rejects_damage():
    plain = warc.build_record(1, "u", b"abc" * 100, None)
    good = warc.gzip_member(plain) + warc.gzip_member(warc.build_record(2, None, b"", 1))
    for chunk in (1, 7, 1 << 18):
        assert [r["type"] for r in warc.read_records(io.BytesIO(good), chunk)] == ["response", "revisit"]
    for bad in (plain.replace(b"abcabc", b"abcabd", 1), plain[:-2], plain + b"x"):
        with pytest.raises(ValueError, match="record|digest"):
            list(warc.read_records(io.BytesIO(warc.gzip_member(bad))))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(good[:-5])))


# ------------------------------------------------------ 9 language model


@pytest.mark.parametrize(("universe", "n"), [(1 << 64, 3000), (10**12, 500), (70, 64), (1, 1), (1 << 40, 20_000)])
def test_elias_fano(universe, n):
    r = np.random.default_rng(n)
    if universe > 1000:
        v = np.unique(r.integers(0, universe, n, dtype=np.uint64))
        more = r.integers(0, universe, 1000, dtype=np.uint64)
    else:
        v = np.sort(r.choice(universe, n, replace=False)).astype(np.uint64)
        more = np.arange(universe, dtype=np.uint64)
    e = elias_fano.EliasFano(elias_fano.build(v, universe))
    assert (e.values() == v).all()
    q = np.unique(np.concatenate([v, more]))
    at, found = e.find(q)
    assert (found == np.isin(q, v)).all() and (at == np.searchsorted(v, q)).all()
    i = np.arange(len(v) - 1)
    this, following = e.pairs(i)
    assert (this == v[:-1]).all() and (following == v[1:]).all() and (e.at(i) == v[:-1]).all()


@pytest.mark.parametrize("bits", [0, 1, 13, 32, 47, 63])
def test_pack_bits(bits):
    values = [x * 0x9E3779B97F4A7C15 % (1 << bits) for x in range(1, 300)]
    whole = sum(x << (i * bits) for i, x in enumerate(values))
    packed = elias_fano.pack_bits(np.array(values, np.uint64), bits)
    assert int.from_bytes(packed.tobytes(), "little") == whole
    assert not len(elias_fano.pack_bits(np.empty(0, np.uint64), bits)[3:])


def test_token_runs(docs, monkeypatch):
    monkeypatch.setattr(language_model, "FLUSH_BYTES", 2000)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 2 == 0).alias("held_out"))
    rows = language_model.token_runs(texts.na.fill(False, "held_out")).collect()
    got = []
    for r in rows:
        (run,) = language_model._stored(iter([pa.RecordBatch.from_pylist([r.asDict()])]))
        hashes = run.words[run.codes].tolist()
        assert len(run.lengths) == len(r.doc_id)
        got += [(i, tuple(hashes[b : b + n])) for i, b, n in zip(r.doc_id, run.begin, run.lengths, strict=True)]
    lower = {c: c + 32 for c in range(65, 91)}
    h = language_model.xxh3_64_intdigest
    same_rows(got, [(i, (*map(h, words((t or "").translate(lower))), language_model.END)) for i, t, *_ in ROWS])


@pytest.mark.parametrize(("order", "shard"), [(2, 2_000_000), (3, 500)])
def test_language_model(docs, no_docs, order, shard, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)
    rows = [(i, [*words((t or "").translate({c: c + 32 for c in range(65, 91)})), b"\n"]) for i, t, *_ in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [w for i, w in rows if not held(i)]
    c = [collections.Counter(tuple(w[k : k + n]) for w in train for k in range(len(w) - n + 1)) for n in (0, 1, 2, 3)]
    total, types = sum(map(len, train)), len(c[1])

    def p(gram):
        if len(gram) == 1:
            return (c[1][gram] + 1) / (total + types + 1)
        context, lower = c[len(gram) - 1][gram[:-1]], p(gram[1:])
        weight = language_model.K
        return (c[len(gram)][gram] + weight * lower) / (context + weight) if context else lower

    want = collections.defaultdict(list)
    for i, w in rows:
        base = sum(math.log10(p((x,))) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        want[i].append((len(w), sum(c[1][x,] > 0 for x in w), base, score))
    got = language_model.score_documents(docs, order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.held_out == held(r.doc_id)
        near = [x for x in want[r.doc_id] if x[:2] == (r.n_tokens, r.n_known)]
        assert any(
            abs(r.base_score - b) < 1e-6 * n and abs(r.score - s) < language_model.CODE * n for n, _, b, s in near
        )
    assert language_model.score_documents(no_docs, order).collect() == []


# ---------------------------------------------------------------- 10 top-k


def test_topk(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(2).tolist(), "x") for i in range(230)]
    rows += [(300, None, "x"), (350, [1.0, None] + [0.0] * 6, "x"), (351, [float("nan")] * 8, "x")]
    rows += [(400, [float("inf")] * 8, "x"), (450, [1.0, 2.0], "x"), (451, [2.0, 2.0], "x"), (500, [], "x")]
    rows += [(None, [1.0] * 8, "x"), rows[7], rows[50], (231, rows[9][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in clean:
        if q % 50 == 0:
            found = [(-sum(map(lambda x, y: x * y, a, b)), c) for c, b in clean if c != q and len(a) == len(b)]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(sorted(found)[:5], 1)]
    for size in (4096, 16):
        got = topk.exact_top_k(table, query_rows=3, candidate_rows=size, edge=2).collect()
        same_rows([tuple(x) for x in got], want)
    assert topk.exact_top_k(table.limit(0)).collect() == []


def test_exact_products():
    big = np.array([[2**40, -(2**41)], [3, 5]])
    assert topk.inner_products(big, big)[1, 1] == 34
    assert topk.inner_products(big, big)[0, 0] == 2**63 - 1  # beyond 64 bits: clamped
    assert topk.inner_products(np.array([[2**30, 1]]), np.array([[2**30, 3]]))[0, 0] == 2**60 + 3


# --------------------------------------------------------------- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf), "test")
        assert docs.columns == columns, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    total = tokens.where("start = 0").agg(F.count("*")).first()[0]
    assert total == docs.count()
