"""DuckDB SQL of the queries that SQL can express on whole tables."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('6|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap,
         ((sum(source_size) OVER ())::BIGINT
          - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap::DOUBLE
              ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM l),
r AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM t),
o AS (
  SELECT d.doc_id, d.source, d.size, d.draw, r.source_size, r.target, r.whole,
         r.target - r.whole * r.source_size AS rest,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT
           - d.size / 2 AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target,
       (size * (whole + CASE WHEN draw <= coalesce(max(CASE WHEN rest > 0 AND middle <= rest THEN draw END)
          OVER (PARTITION BY source), -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS cells
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.cells, c.cells)::BIGINT AS score,
         (row_number() OVER (PARTITION BY q.vec_id
            ORDER BY list_dot_product(q.cells, c.cells) DESC, c.vec_id))::INT AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.cells) = len(c.cells)
  WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""

WARC = r"""
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS sha,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS winner FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(sha, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM w
"""

SUBSTRING = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
g AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM p WHERE i + 35 <= len(w)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY h) > 1 AS repeated FROM g),
c AS (
  SELECT p.r, p.i, p.w[p.i + 1] AS word,
         coalesce(bool_or(f.repeated) OVER (PARTITION BY p.r ORDER BY p.i
           ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS removed
  FROM p LEFT JOIN f USING (r, i)),
k AS (SELECT r, count(*) FILTER (removed) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

def _merkle(levels: int = 7) -> str:
    """Both trees, level by level (16 ** levels leaves a tree), and every leaf's path through them."""
    field = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    fields = [field.format(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "".join(map(chr, range(65, 91)))
    lower = f"translate(text, '{upper}', '{upper.lower()}')"
    leaf = " || ".join([*fields, field.format("text")])
    changed = " || ".join([*fields, field.format(lower)])
    # CRC-32 of the decimal id: a byte enters before its eight shifts
    crc = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(8 * len(doc_id::VARCHAR)),
      lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1))::BIGINT ELSE 0 END),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT))"""
    out = [
        f"""WITH d AS (
  SELECT doc_id, source, sha256({leaf}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS attacked
  FROM documents),
s0 AS (
  SELECT *, leaf AS node, attacked AS folded, '' AS proof,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM d)"""
    ]

    def climb(name: str, k: int, by: str) -> None:
        out.append(f"""{name}g{k} AS (
  SELECT {by or "0 AS one"}, pos // 16 AS g, list(node ORDER BY pos) AS run
  FROM (SELECT DISTINCT {by + "," if by else ""} pos, node FROM {name}{k}) GROUP BY ALL),
{name}{k + 1} AS (
  SELECT a.* EXCLUDE (node, folded, proof, pos, n),
         CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE node END AS node,
         CASE WHEN n > 1 THEN sha256(array_to_string(run[:pos % 16], '') || folded || array_to_string(run[pos % 16 + 2:], ''))
              ELSE folded END AS folded,
         CASE WHEN n > 1 THEN proof || array_to_string(run[:pos % 16], '') || array_to_string(run[pos % 16 + 2:], '')
              ELSE proof END AS proof,
         pos // 16 AS pos, (n + 15) // 16 AS n
  FROM {name}{k} a JOIN {name}g{k} b ON pos // 16 = g{" AND a.source IS NOT DISTINCT FROM b.source" if by else ""})""")

    for k in range(levels):
        climb("s", k, "source")
    out.append(f"""t0 AS (
  SELECT * EXCLUDE (pos, n), node AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
         (SELECT count(*) FROM (SELECT DISTINCT source FROM d)) AS n FROM s{levels})""")
    for k in range(levels):
        climb("t", k, "")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = node AS verified
FROM t{levels}
"""


PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, j, l.a AS l, r.a AS r,
         (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[j + 1:], ' ')),
low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c), (SELECT unnest([2, 3]) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN part USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * low.a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN t USING (lang)
QUALIFY rank <= 2000
"""

ORACLE_SQL = {
    "op5_substring": SUBSTRING,
    "op7_warc": WARC,
    "op6_mixing": MIXING,
    "op10_topk": TOPK,
    "op11_merkle": _merkle(),
    "op12_phrases": PHRASES,
}
