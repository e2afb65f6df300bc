"""What a worker of the phrase counts holds at once."""

import tracemalloc

from sellerdesk.llm import phrases


def test_words_are_cut_in_little_memory():
    text = (b"x" * 49 + b" ") * 40_000
    tracemalloc.start()
    try:
        words, _, joined = phrases.words_of([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == 40_000 and joined[:-1].all()
    assert peak < 8 * len(text)


def test_pieces_end_at_every_mark():
    words, text, joined = phrases.words_of([b"a b, c;. d\ne", b"f g"])
    assert words.to_pylist() == [x.encode() for x in "abcdefg"]
    assert text.tolist() == [0] * 5 + [1] * 2
    assert joined.tolist() == [True, False, False, False, False, True, False]


def test_a_worker_gets_few_texts_at_once(spark):
    docs = spark.createDataFrame([(1, "en", "a b c"), (2, None, None)], "doc_id long, lang string, text string")
    assert {(r.lang, r.phrase, r.n) for r in phrases.frequent_phrases(docs, 1).collect() if r.k == 3} == {("en", "a b c", 1)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
