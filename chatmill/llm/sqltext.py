"""DuckDB statements of the registered queries."""

LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = rf"""
WITH crc AS (  -- the table of the 256 byte steps
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
found AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row, {ALNUM_WORDS} AS words FROM documents
  UNION ALL SELECT 'b', NULL, 0, {ALNUM_WORDS} FROM benchmark),
flat AS (SELECT side, row, unnest(words) AS word FROM found),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM flat), crc),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM flat JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM flat JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM found LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked"""


def secrets(rules, base: list[str]) -> str:
    """Spans from the pieces between matches and the matches: a match starts where all before it ends."""
    def one(k, r):
        pattern = r.pattern.replace("'", "''")
        return f"""SELECT row, {k} AS k, '{r.kind}' AS kind, string_split_regex(text, '{pattern}') AS between, regexp_extract_all(text, '{pattern}') AS found,
                regexp_extract_all(text, '{pattern}', {r.group}) AS judged, {r.least} AS least FROM docs"""

    every = " UNION ALL ".join(one(k, r) for k, r in enumerate(rules))
    names = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({every}),
placed AS (
  SELECT row, k, kind, length(found[i]) AS size, least, length(judged[i]) AS n,
         list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched)),
spans AS (
  SELECT row, {counts},
         coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) FILTER (kind IN ({names})), '') AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) AS spans
  FROM placed WHERE n >= least GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (row)"""
