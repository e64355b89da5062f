"""DuckDB SQL of the queries of this subpackage that SQL can express."""

OP11_PHRASES = r"""
WITH pieces AS (
  SELECT row, unnest(range(len(p))) AS k, coalesce(lang, 'und') AS lang, unnest(p) AS piece
  FROM (SELECT row_number() OVER () AS row, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, size, unnest([w[i:i + size - 1] for i in range(1, len(w) - size + 2)]) AS g FROM words, (SELECT unnest(range(1, 6)) AS size)),
counts AS (SELECT lang, size, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, size, g, f, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
scores AS (
  SELECT c.lang, c.g, c.f AS a, c.k, l.f AS l, r.f AS r, n, (1000 * c.f * n) // (l.f * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.size] JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, unnest([g[1:size - 1], g[2:size]]) AS g, f FROM counts WHERE size > 2),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM lowest o WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = o.lang AND i.g = o.g AND i.f = o.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

#: CRC-32 is computed bit by bit and byte by byte, with its table made by the query.
OP12_RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(b))),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, row, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS g FROM words),
counted AS (SELECT side, row, g, count(*) AS n FROM grams GROUP BY ALL),
crcs AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(len(h) // 2)]), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)), crc_table),
met AS (SELECT side, row, n, bucket FROM counted JOIN crcs USING (g)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM met GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM met JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN weights USING (row) WHERE side = 'd'),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 25 * fit // 100 THEN place END::BIGINT AS rank FROM ranked
"""
