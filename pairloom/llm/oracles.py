"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op3_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(k % 3 AS INTEGER) + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, (cap / w, k)) FROM l WHERE level <= cap / w)) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_epochs,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
b AS (
  SELECT r.source, min(c.h + CASE WHEN c.upto - rest < rest - (c.upto - n) THEN 1 ELSE 0 END) AS below
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE rest > 0 AND c.upto > rest AND c.upto - n <= rest GROUP BY r.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (r.full_epochs + CASE WHEN d.h < coalesce(b.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
    "op10_chat": r"""
WITH e AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS text FROM conversations),
n AS (SELECT *, turn // 1024 AS part, replace(replace(regexp_replace(speaker, '[ \t\n\r\f\v]+', '_', 'g'), '<|', '<\|'), '|>', '|\>') AS name FROM e),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM n WHERE speaker <> 'system'),
s AS (
  SELECT n.conv_id, participant, part, turn, speaker, n.text, speaker = participant AS own,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head,
         n.text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, row_number() OVER w AS k, CAST(sum(length(head) + length(body)) OVER w AS BIGINT) AS upto
  FROM s WINDOW w AS (PARTITION BY conv_id, participant ORDER BY part, turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(min(upto - length(head) - length(body)) AS BIGINT) AS start, string_agg(head || body, '' ORDER BY k) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(body)) || ':' || upto END, ',' ORDER BY k), '') AS mask,
       CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, participant, part""",
}
