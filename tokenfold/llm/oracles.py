"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT *, len(words) AS n,
         list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) AS grams
  FROM w
), pos AS (
  SELECT doc_id, gram, i FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g)
), twice AS (
  SELECT doc_id, gram FROM pos GROUP BY ALL HAVING count(*) > 1
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM pos JOIN twice USING (doc_id, gram), (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, n::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM g LEFT JOIN hit USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_exclaims > 20 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * word_chars THEN 128 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""

_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT size FROM win),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
dg AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM ds),
hit AS (SELECT doc_id, i, size, item_id FROM dg JOIN win USING (size, g)),
marked AS (SELECT doc_id, unnest(range(i, i + size)) AS k, item_id FROM hit),
sums AS (SELECT doc_id, count(DISTINCT k) AS n_hit, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM marked GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN sums USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY 1),
b AS (SELECT page_id, html, last, array_to_string(list_transform(range(1, 41), lambda i:
  substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS bits
  FROM p JOIN m USING (h))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * j + 1, 1)::INT
    + 8 * substr(bits, 5 * j + 2, 1)::INT + 4 * substr(bits, 5 * j + 3, 1)::INT + 2 * substr(bits, 5 * j + 4, 1)::INT
    + substr(bits, 5 * j + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""

def _lloyd(k: int, rounds: int, dims: int, scale: int, seed: str) -> str:
    """Lloyd's rounds one after another, every vector against every centroid."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id::VARCHAR)) - 1 AS j, x AS c FROM v QUALIFY j < {k})",
        "p AS MATERIALIZED (SELECT i, n, x[n] AS value FROM v, (SELECT unnest(range(1, " + str(dims + 1) + ")) AS n))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""q{r} AS MATERIALIZED (SELECT i, j, sum((value - c[n]) * (value - c[n]))::BIGINT AS d FROM p, c{r} GROUP BY ALL)"""
        )
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, j, d FROM q{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT j, n, sum(value)::BIGINT AS t, count(*) AS m FROM a{r} JOIN p USING (i) GROUP BY ALL)")
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(g.c, c{r}.c) AS c FROM c{r} LEFT JOIN
  (SELECT j, list((t - ((t % m) + m) % m) // m ORDER BY n) AS c FROM s{r} GROUP BY j) g ON g.j = c{r}.j)"""
            )
    last = f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, {last}.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY {last}.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN v USING (i) JOIN c{rounds} ON c{rounds}.j = {last}.j"""


OP11 = _lloyd(8, 10, 64, 1024, "3:")

OP13 = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)])::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {"op13_hard_negatives": OP13, "op11_centroids": OP11, "op6_decontamination": OP6, "op7_warc": OP7, "op9_quality_rules": OP9}
