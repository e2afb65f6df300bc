"""The registered language model has trigrams: it meets brute force of three words, not of two."""

import collections
import math
import zlib

from sellerdesk.llm import language_model
from sellerdesk.llm.queries import QUERIES


def test_registered_model_is_a_trigram_trie(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lower = {c: c + 32 for c in range(65, 91)}
    texts = {r.doc_id: [*(r.text or "").translate(lower).encode().split(), b"\n"] for r in rows}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = [collections.Counter(tuple(w[k : k + n]) for w in train for k in range(len(w) - n + 1)) for n in (0, 1, 2, 3)]
    total, types = sum(map(len, train)), len(c[1])

    def p(gram):
        if len(gram) == 1:
            return (c[1][gram] + 1) / (total + types + 1)
        context, shorter = c[len(gram) - 1][gram[:-1]], p(gram[1:])
        return (c[len(gram)][gram] + language_model.K * shorter) / (context + language_model.K) if context else shorter

    def score(w, order):
        return sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))

    got = QUERIES["op9_language_model"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert abs(r.score - score(texts[r.doc_id], 3)) < language_model.CODE * r.n_tokens
    n = sum(r.n_tokens for r in got)
    mean = {order: sum(score(w, order) for w in texts.values()) / n for order in (2, 3)}
    found = sum(r.score for r in got) / n
    assert mean[3] - mean[2] > 0.05 and abs(found - mean[3]) < 0.01
