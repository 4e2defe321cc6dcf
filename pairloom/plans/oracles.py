"""DuckDB SQL for the registered queries."""

# White space, special literals, articles, entities and punctuation patterns of both tokenisers, as in functions/text.py.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens(s: str) -> str:
    return f"[x FOR x IN string_split_regex({s}, '{WS}') IF x <> '']"


def norm(s: str) -> str:
    bare = f"regexp_replace(replace(replace(lower({s}), '<pad>', ''), '</s>', ''), '[[:punct:]]', '', 'g')"
    article = r"(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])"
    for _ in range(2):
        bare = rf"regexp_replace({bare}, '{article}', '\1 \3', 'g')"
    return f"array_to_string({tokens(bare)}, ' ')"


def scored(s: str, lower: bool = True) -> str:
    s = f"replace(replace(replace({s}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    if lower:
        s = f"lower({s})"
    for p, r in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    return tokens(s)


TURNS = """
t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS gold FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id % 4 AS part, conv_id, turn, text AS pred, gold FROM t WHERE role = 'user' AND next_role = 'assistant')"""
DOCS = f"""
d AS (SELECT doc_id, lang, text, {tokens('text')} AS w FROM documents),
pairs AS (SELECT doc_id, lang, text AS gold, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF (i - 1) % 7 <> 6], ' ') AS pred FROM d)"""
REFS = """
g AS (SELECT conv_id AS c, list(text ORDER BY turn) AS golds FROM conversations WHERE role = 'assistant' GROUP BY 1),
pairs AS (SELECT conv_id % 4 AS part, text AS pred, golds FROM conversations JOIN g ON conv_id = c WHERE role = 'user')"""


def sums(source: str, by: str, cut, golds: str = "[gold]", length: str = "list_min([len(r) FOR r IN refs])") -> str:
    """CTEs up to s: by, n_pairs, testlen, reflen and c1..c4, g1..g4."""
    parts = ", ".join(f"CAST(sum(greatest(len(h) - {k - 1}, 0)) AS BIGINT) AS g{k}" for k in range(1, 5))
    hits = ", ".join(f"CAST(coalesce(sum(CASE WHEN k = {k} THEN m END), 0) AS BIGINT) AS c{k}" for k in range(1, 5))
    return f"""
WITH {source},
tok AS (SELECT row_number() OVER () AS id, {by}, {cut('pred')} AS h, [{cut('r')} FOR r IN {golds}] AS refs FROM pairs),
len AS (SELECT {by}, count(*) AS n_pairs, CAST(sum(len(h)) AS BIGINT) AS testlen, CAST(sum(CAST(floor({length}) AS BIGINT)) AS BIGINT) AS reflen, {parts} FROM tok GROUP BY {by}),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
hg AS (SELECT id, {by}, k, unnest([array_to_string(h[i:i + k - 1], ' ') FOR i IN range(1, len(h) - k + 2)]) AS gram FROM tok, ks WHERE len(h) >= k),
hc AS (SELECT id, {by}, k, gram, count(*) AS n FROM hg GROUP BY ALL),
each AS (SELECT id, unnest(range(1, len(refs) + 1)) AS ref, unnest(refs) AS r FROM tok),
rg AS (SELECT id, ref, k, unnest([array_to_string(r[i:i + k - 1], ' ') FOR i IN range(1, len(r) - k + 2)]) AS gram FROM each, ks WHERE len(r) >= k),
rc AS (SELECT id, k, gram, max(n) AS n FROM (SELECT id, ref, k, gram, count(*) AS n FROM rg GROUP BY ALL) GROUP BY ALL),
mt AS (SELECT hc.{by}, hc.k, sum(least(hc.n, rc.n)) AS m FROM hc JOIN rc USING (id, k, gram) GROUP BY ALL),
hit AS (SELECT {by}, {hits} FROM mt GROUP BY {by}),
s AS (SELECT len.*, {', '.join(f'coalesce(c{k}, 0) AS c{k}' for k in range(1, 5))} FROM len LEFT JOIN hit ON len.{by} IS NOT DISTINCT FROM hit.{by})"""


def smooth(n: int = 4) -> str:
    t = "1e-16"
    logs = " + ".join(f"ln(c{k} + {int(k > 1)} + {t}) - ln(g{k} + {int(k > 1)} + {t})" for k in range(1, n + 1))
    return f"exp(({logs}) / {n}.0 + least(0.0, 1 - (reflen + 1.0) / (testlen + 1.0)))"


def plain(add: bool, n: int = 4) -> str:
    ps = [f"((c{k} + 1.0) / (g{k} + 1.0))" if add else f"(CASE WHEN g{k} > 0 THEN c{k} / g{k}::DOUBLE ELSE 0 END)" for k in range(1, n + 1)]
    ratio = "(testlen / greatest(1, reflen)::DOUBLE)"
    mean = " + ".join(f"ln(CASE WHEN {p} > 0 THEN {p} ELSE 1 END)" for p in ps)
    return f"CASE WHEN least({', '.join(ps)}) > 0 THEN exp(({mean}) / {n}.0) * (CASE WHEN {ratio} > 1 THEN 1 ELSE exp(1 - 1 / greatest({ratio}, 1e-9)) END) ELSE 0 END"


PRECISE = ", ".join(f"round(CASE WHEN g{k} = 0 THEN 0 ELSE exp(ln(c{k} + 1e-16) - ln(g{k} + 1e-16)) END, 6) AS p{k}" for k in range(1, 5))
LENGTHS = {
    "shortest": "list_min([len(r) FOR r IN refs])",
    "average": "list_avg([len(r) FOR r IN refs])",
    "closest": "list_sort([{'d': abs(len(refs[i]) - len(h)), 'i': i, 'n': len(refs[i])} FOR i IN range(1, len(refs) + 1)])[1].n",
}
TASKED = TURNS + ", named AS (SELECT *, CASE WHEN part = 0 THEN 'CodeSearchNet' ELSE 'task' || part END AS task FROM pairs)"


def dispatched(extra: str) -> str:
    one = sums(TASKED.replace("named AS", "all_pairs AS (SELECT * FROM pairs), named AS"), "task", scored).replace("FROM pairs)", "FROM pairs)").replace("AS refs FROM pairs", "AS refs FROM named WHERE task = 'CodeSearchNet'")
    two = sums(TASKED, "task", tokens).replace("AS refs FROM pairs", "AS refs FROM named WHERE task <> 'CodeSearchNet'")
    return f"""
SELECT task, 'SmoothBLEU' AS metric, bleu, n{extra} FROM ({one} SELECT task, round({smooth()}, 6) AS bleu, n_pairs::DOUBLE AS n FROM s)
UNION ALL SELECT task, 'BLEU' AS metric, bleu, n{extra} FROM ({two} SELECT task, round({plain(False)}, 6) AS bleu, n_pairs::DOUBLE AS n FROM s)"""


def draw(key: str, seed: int = 7) -> str:
    return f"md5('{seed}:' || {key}), {key}"


SCORES = """
sc AS (SELECT event_type AS eval_task, CAST(event_id % 5 AS INTEGER) AS step, avg(value) AS score FROM events GROUP BY 1, 2),
scores AS (SELECT *, CAST(greatest(coalesce(list_position(['click', 'login', 'logout', 'purchase', 'view'], eval_task), 0) - 1, 0) AS INTEGER) AS j FROM sc)"""


def forget(condition: str = "") -> str:
    return f"""WITH {SCORES},
f AS (SELECT eval_task, j, max(CASE WHEN step < 4 {condition} THEN score END) AS best, max(CASE WHEN step = 4 THEN score END) AS final FROM scores GROUP BY 1, 2),
lost AS (SELECT *, CASE WHEN best IS NULL OR final IS NULL THEN 0.0 ELSE greatest(0.0, best - final) END AS forgetting FROM f)"""


GRADS = "g AS (SELECT CAST(label AS VARCHAR) AS name, vec_id // 10 AS batch, vec_id, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)"
FACTORS = """
placed AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings WHERE vec_id IS NOT NULL),
ranked AS (SELECT 'm' || label || '.' || (place // 8) AS module, embedding, place % 8 AS rank FROM placed),
f AS (SELECT module, rank, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM ranked)"""
ORDERS = "b AS (SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 16 AS BIGINT) AS batch_id FROM orders)"


def ids(t: str, n: int, pad: str) -> str:
    """The first n places of token ids by position, as text."""
    return f"array_to_string([CASE WHEN i <= len({t}) THEN CAST({t}[i] AS VARCHAR) ELSE '{pad}' END FOR i IN range(1, {n} + 1)], ',')"


def stripped(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '^{WS}', ''), '{WS}$', '')"


#: Every task's predictions after each step; a cell is a task, a step and a split.
STEPPED = TURNS + f"""
, gold_words AS (SELECT *, CASE WHEN part = 0 THEN 'CodeSearchNet' ELSE 'task' || part END AS task, CASE WHEN (conv_id // 4) % 2 = 0 THEN 'val' ELSE 'test' END AS split, {tokens('gold')} AS w FROM pairs),
stepped AS (
  SELECT task || ':' || step || ':' || split AS cell, task, gold, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF (i - 1) % (step + 3) <> step], ' ') AS pred
  FROM gold_words, (SELECT unnest([0, 1, 2]) AS step))"""


def stepped() -> str:
    """CTEs up to cells: eval_task, j, step, split, score, em, n of the grid of tasks, steps and splits."""
    part = lambda cut, which: sums(STEPPED, "cell", cut).replace("AS refs FROM pairs", f"AS refs FROM stepped WHERE {which}")
    return f"""
WITH {STEPPED},
found AS (
  SELECT * FROM ({part(scored, "task = 'CodeSearchNet'")} SELECT cell, {smooth()} AS bleu, n_pairs FROM s)
  UNION ALL SELECT * FROM ({part(tokens, "task <> 'CodeSearchNet'")} SELECT cell, {plain(False)} AS bleu, n_pairs FROM s)),
hits AS (SELECT cell, sum(CASE WHEN {norm('pred')} = {norm('gold')} THEN 1 ELSE 0 END) / count(*) AS em FROM stepped GROUP BY 1),
names AS (SELECT unnest(['task1', 'CodeSearchNet', 'task2', 'task3', 'task9']) AS eval_task, unnest([0, 1, 2, 3, 4]) AS j),
grid AS (SELECT * FROM names, (SELECT unnest([0, 1, 2]) AS step), (SELECT unnest(['val', 'test']) AS split)),
cells AS (
  SELECT eval_task, j, step, split, bleu AS score, em, coalesce(n_pairs, 0)::DOUBLE AS n
  FROM grid LEFT JOIN (found JOIN hits USING (cell)) ON cell = eval_task || ':' || step || ':' || split)"""


ORACLES = {
    "bleu_smooth_by_lang": f"{sums(DOCS, 'lang', scored)} SELECT lang, n_pairs, testlen, reflen, round({smooth()}, 6) AS bleu, {PRECISE} FROM s",
    "bleu_plain_by_lang": f"{sums(DOCS, 'lang', tokens)} SELECT lang, n_pairs, testlen, reflen, round({plain(False)}, 6) AS bleu FROM s",
    "unpaired_turns": """
WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id % 4 AS part, count(*) AS pairs, count(*) FILTER (text IS NULL) AS no_pred, count(*) FILTER (next_role IS NULL OR next_role <> 'assistant' OR next_text IS NULL) AS no_refs
FROM t WHERE role = 'user' GROUP BY 1""",
    "scores_after_steps": stepped() + " SELECT eval_task, j, step, round(score, 6) AS score, round(em, 6) AS em, n FROM cells WHERE split = 'val'",
    "training_report": stepped() + """,
f AS (SELECT eval_task, j, max(score) FILTER (split = 'val' AND step < 2) AS best, max(score) FILTER (split = 'val' AND step = 2) AS final, max(score) FILTER (split = 'test' AND step = 2) AS test
      FROM cells GROUP BY 1, 2),
lost AS (SELECT *, CASE WHEN best IS NULL OR final IS NULL THEN 0.0 ELSE greatest(0.0, best - final) END AS forgetting FROM f)
SELECT eval_task, j, round(forgetting, 6) AS forgetting, round(coalesce(final, 0), 6) AS val, round(coalesce(test, 0), 6) AS test, round(avg(coalesce(final, 0)) OVER (), 6) AS avg_val,
       round(avg(coalesce(test, 0)) OVER (), 6) AS avg_test, round(sum(CASE WHEN j < 4 THEN forgetting END) OVER () / 4, 6) AS avg_forgetting FROM lost""",
    "listed_turn_tokens": f"""
WITH c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS t FROM conversations GROUP BY 1)
SELECT conv_id, CAST(len({scored('t')}) AS BIGINT) AS n, md5(array_to_string({scored('t')}, ' ')) AS tokens FROM c""",
    "assembled_examples": " UNION ALL ".join(
        f"SELECT {key} AS id, '{name}' AS task, md5({stripped(f"'{ask}' || coalesce(text, 'None')")}) AS text, coalesce({label}, 'None') AS label FROM {source}"
        for name, source, key, label, ask in (("CodeTrans", "conversations", "conv_id", "role", "translate java-to-csharp: "), ("CONCODE", "documents", "doc_id", "lang", "generate java: "),
                                              ("BFP", "benchmark", "item_id", "'x'", "refactor java: "))),
    "encoded_turns": f"""
WITH {TURNS}, e AS (
  SELECT conv_id, turn, [CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 30000 + 3 FOR x IN {tokens('pred')}] AS x, [CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 30000 + 3 FOR x IN {tokens('gold')}] AS y FROM pairs)
SELECT conv_id, turn, {ids('x', 32, '0')} AS ids, array_to_string([CASE WHEN i <= len(x) THEN '1' ELSE '0' END FOR i IN range(1, 33)], ',') AS mask,
       {ids('y', 48, '-100')} AS labels, {ids('y', 48, '0')} AS unmasked FROM e""",
    "metric_log_round_trip": "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages",
    "em_rate_by_lang": f"""
WITH p AS (SELECT lang, text AS gold, CASE doc_id % 3 WHEN 0 THEN 'the ' || text || ' !' WHEN 1 THEN text || ' more' ELSE replace(text, ' ', '  ') END AS pred FROM documents)
SELECT lang, round(sum(CASE WHEN {norm('pred')} = {norm('gold')} THEN 1 ELSE 0 END) / greatest(1, count(*)), 6) AS em, count(*)::DOUBLE AS n FROM p GROUP BY lang""",
    "bleu_plain_turns": f"{sums(TURNS, 'part', tokens)} SELECT part, n_pairs, testlen, reflen, round({plain(False)}, 6) AS bleu FROM s",
    "bleu_native_turns": f"{sums(TURNS, 'part', tokens)} SELECT part, n_pairs, testlen, reflen, round({plain(False)}, 6) AS bleu FROM s",
    "bleu_plain_smoothed_turns": f"{sums(TURNS, 'part', tokens)} SELECT part, n_pairs, testlen, reflen, round({plain(True)}, 6) AS bleu FROM s",
    "bleu_smooth_turns": f"{sums(TURNS, 'part', scored)} SELECT part, n_pairs, testlen, reflen, round({smooth()}, 6) AS bleu, {PRECISE} FROM s",
    "bleu_multi_reference": " UNION ALL ".join(f"SELECT '{w}' AS ref_len, * FROM ({sums(REFS, 'part', tokens, 'golds', x)} SELECT part, n_pairs, testlen, reflen, round({smooth()}, 6) AS bleu FROM s)" for w, x in LENGTHS.items()),
    "bleu_by_task": dispatched(""),
    "evaluation_by_task": f"""
WITH {TASKED}, em AS (SELECT task, round(sum(CASE WHEN {norm('pred')} = {norm('gold')} THEN 1 ELSE 0 END) / greatest(1, count(*)), 6) AS em FROM named GROUP BY task)
SELECT x.task, em, n, metric, bleu, metric AS label FROM ({dispatched('')}) x JOIN em USING (task)""",
    "normalised_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "scored_page_tokens": f"""
SELECT page_id, CAST(len({scored('html')}) AS BIGINT) AS n, md5(array_to_string({scored('html')}, ' ')) AS tokens, md5(array_to_string({tokens('html')}, ' ')) AS plain,
       md5(array_to_string({scored('html', False)}, ' ')) AS cased FROM pages""",
    "text_pieces": f"""
SELECT doc_id, substring(text, 1, 200) AS head, md5(replace(text, chr(10), '\\n')) AS escaped, md5(array_to_string({tokens('text')}, ' ')) AS collapsed,
       md5(regexp_replace(lower(text), '[[:punct:]]', '', 'g')) AS bare FROM documents""",
    "ngram_totals": f"""
WITH t AS (SELECT conv_id, turn, {tokens('text')} AS w FROM conversations), ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT conv_id, turn, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS gram FROM t, ks WHERE len(w) >= k),
c AS (SELECT conv_id, turn, k, gram, count(*) AS cnt FROM g GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, count(*) AS grams, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS most FROM c GROUP BY k""",
    "previews": f"""
WITH {DOCS} SELECT doc_id, substring(pred, 1, 200) AS pred, substring(gold, 1, 200) AS gold, CAST({norm('pred')} = {norm('gold')} AS INTEGER) AS em
FROM (SELECT * FROM pairs ORDER BY doc_id LIMIT 5)""",
    "seeded_subset": f"SELECT doc_id, lang FROM documents ORDER BY {draw('doc_id')} LIMIT 100",
    "seeded_subset_all": f"SELECT n_nationkey, n_name FROM nation ORDER BY {draw('n_nationkey')}",
    "half_split": f"""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {draw('doc_id')}) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'val' ELSE 'test' END AS split FROM documents""",
    "range_select": f"""
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey')}) AS rn FROM orders) WHERE rn > 10 AND rn <= 60""",
    "order_batches": f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {draw('o_orderkey')}) - 1) // 16 AS BIGINT) AS batch_id FROM orders",
    "first_batches": f"WITH {ORDERS} SELECT * FROM b WHERE batch_id < 5",
    "batches_until_seen": f"""
WITH {ORDERS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, batch_id ORDER BY o_orderkey) AS k FROM b) WHERE k <= 12),
z AS (SELECT o_orderpriority, batch_id, count(*) AS size FROM c GROUP BY 1, 2),
y AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY o_orderpriority ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM z)
SELECT o_orderkey, o_orderpriority, batch_id FROM c JOIN y USING (o_orderpriority, batch_id) WHERE seen < 100""",
    "step_counts": """
SELECT o_orderpriority, CAST(ceil(count(*) / 16.0) AS BIGINT) AS batches, CAST(greatest(1, ceil(count(*) / 16.0) * 3) AS BIGINT) AS steps,
       CAST(floor(greatest(1, ceil(count(*) / 16.0) * 3) * 0.1::DOUBLE) AS BIGINT) AS warmup FROM orders GROUP BY 1""",
    "prompts": rf"""
SELECT conv_id, turn, 'CodeSearchNet' AS task, regexp_replace(regexp_replace('Summarize the following Ruby code into English.' || repeat(chr(10), 2) || '<language>Ruby</language>' || chr(10) || '<code>' || chr(10) || coalesce(text, 'None') || chr(10) || '</code>', '^{WS}', ''), '{WS}$', '') AS text,
       coalesce(role, 'None') AS label FROM conversations""",
    "score_matrix": f"WITH {SCORES} SELECT eval_task, {', '.join(f'round(max(CASE WHEN step = {i} THEN score END), 6) AS step_{i}' for i in range(5))} FROM scores GROUP BY eval_task",
    "forgetting": forget() + " SELECT eval_task, j, round(best, 6) AS best, round(final, 6) AS final, round(forgetting, 6) AS forgetting FROM lost",
    "forgetting_after_training": forget("AND step >= j") + " SELECT eval_task, j, round(best, 6) AS best, round(final, 6) AS final, round(forgetting, 6) AS forgetting FROM lost",
    "average_forgetting": forget() + " SELECT round(coalesce(sum(CASE WHEN j < 4 THEN forgetting END), 0) / 4, 6) AS avg_forgetting FROM lost",
    "macro_averages": forget() + " SELECT round(coalesce(avg(coalesce(final, 0)), 0), 6) AS avg_final FROM lost",
    "evaluation_summary": forget() + """
, tst AS (SELECT event_type AS eval_task, max(value) AS test FROM events GROUP BY 1)
SELECT eval_task, j, round(forgetting, 6) AS forgetting, round(coalesce(final, 0), 6) AS val, round(coalesce(test, 0), 6) AS test, round(avg(coalesce(final, 0)) OVER (), 6) AS avg_val,
       round(avg(coalesce(test, 0)) OVER (), 6) AS avg_test, round(coalesce(sum(CASE WHEN j < 4 THEN forgetting END) OVER (), 0) / 4, 6) AS avg_forgetting FROM lost LEFT JOIN tst USING (eval_task)""",
    "running_means": "SELECT event_id, event_type, value, floor(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 10000 + 0.123456::DOUBLE) / 10000 AS running_mean FROM events",
    "running_sums": "SELECT event_id, event_type, event_id % 3 AS epoch, value, round(sum(value) OVER (PARTITION BY event_type, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_sum FROM events",
    "logged_steps": "SELECT event_id, event_type FROM events WHERE event_id % 50 = 0",
    "fisher_by_batches": f"WITH {GRADS} SELECT name, CAST(idx AS INTEGER) AS idx, round(sum(value * value) / count(DISTINCT batch), 6) AS fisher FROM g GROUP BY 1, 2",
    "fisher_by_samples": f"WITH {GRADS} SELECT name, CAST(idx AS INTEGER) AS idx, round(sum(value * value) / greatest(1, count(*)), 6) AS fisher FROM g GROUP BY 1, 2",
    "fisher_online": f"""
WITH {GRADS}, h AS (SELECT vec_id % 3 AS t, name, idx, sum(value * value) / count(DISTINCT vec_id) AS fisher FROM g GROUP BY 1, 2, 3),
l AS (SELECT *, max(t) OVER (PARTITION BY name, idx) AS last FROM h)
SELECT name, CAST(idx AS INTEGER) AS idx, round(sum(pow(0.95::DOUBLE, last - t) * fisher), 6) AS fisher FROM l GROUP BY 1, 2""",
    "online_anchor_means": f"WITH {GRADS} SELECT name, CAST(idx AS INTEGER) AS idx, round(arg_max(value, vec_id), 6) AS value FROM g GROUP BY 1, 2",
    "quadratic_penalty": f"""
WITH {GRADS}, a AS (SELECT name, idx, sum(value * value) / count(DISTINCT batch) AS fisher, avg(value) AS anchor, max(value) AS value FROM g GROUP BY 1, 2),
p AS (SELECT coalesce(sum(fisher * (value - anchor) * (value - anchor)), 0) AS penalty FROM a)
SELECT round(penalty, 6) AS penalty, round(penalty * 20, 6) AS scaled FROM p""",
    "low_rank_merges": f"""
WITH {FACTORS}, a AS (SELECT module, rank, idx AS col, value FROM f WHERE rank < 4), b AS (SELECT module, idx AS row, rank - 4 AS rank, value FROM f WHERE rank >= 4),
c AS (SELECT module, b.row, a.col, sum(a.value * b.value) * 2 AS change FROM a JOIN b USING (module, rank) GROUP BY 1, 2, 3)
SELECT f.module, CAST(idx AS INTEGER) AS row, 0 AS col, round(value + coalesce(change, 0), 6) AS value FROM f LEFT JOIN c ON f.module = c.module AND idx = c.row AND c.col = 0 WHERE f.rank = 0""",
    "basis_orthogonality": f"""
WITH {FACTORS}, n AS (SELECT module FROM f WHERE rank < 4 GROUP BY 1 HAVING sqrt(sum(value * value)) >= 1e-6),
d AS (SELECT x.module, x.rank AS i, y.rank AS j, sum(x.value * y.value) AS dot FROM f x JOIN f y ON x.module = y.module AND x.idx = y.idx AND x.rank < 4 AND y.rank >= 4 JOIN n ON n.module = x.module GROUP BY 1, 2, 3)
SELECT module, round(sum(dot * dot), 6) AS loss FROM d GROUP BY 1""",
    "qr_bases": f"WITH {FACTORS} SELECT module, 0.0::DOUBLE AS off, CAST(max(rank) + 1 AS BIGINT) AS columns FROM f GROUP BY 1",
    "adapter_scales": """
SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size / 2.0 WHEN 1 THEN p_size / 4.0 WHEN 2 THEN coalesce(p_retailprice / nullif(p_size % 8, 0), 1) ELSE 1 END::DOUBLE, 6) AS scale FROM part""",
    "json_lines_round_trip": "SELECT text AS nl, lang AS code FROM documents",
    "parallel_text_round_trip": r"SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line, role AS java, replace(text, chr(10), '\n') AS cs FROM conversations",
    "task_table_scan": "SELECT text AS nl, lang AS code FROM documents WHERE doc_id % 5 = 1",
    "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "pages", "conversations", "benchmark")),
    "decoded_roles": """
SELECT conv_id, turn, coalesce(role, '') || ' ' || ['user', 'assistant', 'system'][CAST(turn % 3 AS INTEGER) + 1] AS words FROM conversations""",
}
