"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_T = "t AS (SELECT conv_id AS build_id, turn AS pos, role, text, (length(text) + 3) // 4 AS w FROM conversations)"
_CALLS = "CASE WHEN turn % 4 = 2 THEN 20 ELSE 0 END"
_TT = f"""t AS (SELECT conv_id AS build_id, turn AS pos, text,
  CASE WHEN turn % 4 = 2 THEN 'assistant' WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role,
  (length(text) + CASE WHEN turn % 4 = 2 THEN 6 + 6 + length(turn::VARCHAR) ELSE 0 END + 3) // 4 + {_CALLS} AS w FROM conversations)"""


def _head(source: str, unit: str, least: int = 0) -> str:
    return f"""
WITH {source}, u AS (SELECT *, {unit} AS unit FROM t),
s AS (SELECT *, sum(w) OVER (PARTITION BY build_id) AS total,
  coalesce(sum(w) OVER (PARTITION BY build_id, unit IS NULL ORDER BY unit RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  coalesce(sum(CASE WHEN unit IS NULL THEN w END) OVER (PARTITION BY build_id), 0) AS floor FROM u),
k AS (SELECT * FROM s WHERE total <= 300 OR (floor <= 300 AND (unit IS NULL OR total - gone <= 300))),
c AS (SELECT *, count(*) OVER (PARTITION BY build_id) AS n FROM k)
SELECT build_id, pos, w::BIGINT AS w FROM c WHERE total <= 300 OR n >= {least}"""


def _assembly(profile: str, final: str) -> str:
    return f"""
WITH {_T}, k AS (SELECT DISTINCT build_id FROM t),
r AS (SELECT k.build_id, item_id AS pos, (length(text) + 3) // 4 AS w FROM k JOIN benchmark ON item_id % 10 = build_id % 10),
r1 AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos) AS pre, sum(w) OVER (PARTITION BY build_id) AS total FROM r),
rk AS (SELECT * FROM r1 WHERE total <= 200 OR pre <= 200),
ru AS (SELECT k.build_id, coalesce(sum(rk.w), 0) AS used, count(rk.w) AS n FROM k LEFT JOIN rk USING (build_id) GROUP BY 1),
rs AS (SELECT build_id, max(total) AS total, count(*) AS n_in FROM r1 GROUP BY 1),
ok AS (SELECT ru.*, rs.total AS r_total, rs.n_in AS r_in FROM ru LEFT JOIN rs USING (build_id) WHERE rs.total IS NULL OR ru.n > 0),
p AS ({profile}),
pk AS (SELECT p.* FROM p JOIN ok USING (build_id) WHERE p.w <= least(60, 493 - ok.used)),
b AS (SELECT ok.build_id, ok.used AS r_used, ok.n AS r_kept, r_total, r_in, coalesce(pk.w, 0) AS p_used, p.w AS p_total,
  493 - ok.used AS left1, 493 - ok.used - coalesce(pk.w, 0) AS left2 FROM ok LEFT JOIN pk USING (build_id) LEFT JOIN p USING (build_id)),
c1 AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos DESC) AS suf, sum(w) OVER (PARTITION BY build_id) AS total FROM t),
ck AS (SELECT c1.* FROM c1 JOIN b USING (build_id) WHERE suf <= left2),
m AS (
  SELECT build_id, 0 AS o, 'instructions' AS block_name, 0 AS pos, 7 AS w FROM ok
  UNION ALL SELECT rk.build_id, 1, 'reference', pos, w FROM rk JOIN ok USING (build_id)
  UNION ALL SELECT build_id, 2, 'profile', pos, w FROM pk
  UNION ALL SELECT build_id, 3, 'conversation', pos, w FROM ck)
{final}"""


_PROFILE = "SELECT build_id, 0 AS pos, (9 + length(text) + 3) // 4 AS w FROM t WHERE pos = 0"

_OPS = """o AS (SELECT user_id::VARCHAR AS thread_id, event_id AS seq, ts,
  CASE WHEN event_id % 11 = 0 THEN 'clear' WHEN event_id % 11 <= 3 THEN 'save' ELSE 'append' END AS op,
  CASE WHEN event_id % 11 IN (0, 3, 10) THEN 0 ELSE 1 END AS size,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 9 END AS expected,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"""


_HOT = """o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS i FROM (SELECT seq, ts, op, size,
  CASE WHEN seq % 3 = 0 THEN 'hot' ELSE thread_id END AS thread_id, CASE WHEN seq % 3 = 0 THEN seq // 6 ELSE expected END AS expected FROM e))"""


def _replay(reset: bool, ttl: bool = False, ops: str = _OPS) -> str:
    version = "CASE WHEN o.op = 'append' AND size = 0 THEN v.version WHEN o.expected = v.version THEN {} ELSE v.version END"
    bump = "CASE WHEN o.op = 'clear' OR (o.op = 'save' AND size = 0) THEN 0 ELSE v.version + 1 END" if reset else "v.version + 1"
    old = "(s.written IS NOT NULL AND s.written + INTERVAL 86400 SECONDS <= o.ts)" if ttl else "false"
    return f"""
WITH RECURSIVE {ops}, s AS (
  SELECT thread_id, 0::BIGINT AS i, 0::BIGINT AS version, 0::BIGINT AS n, 0::BIGINT AS accepted, NULL::TIMESTAMP AS written FROM o WHERE i = 1
  UNION ALL
  SELECT o.thread_id, o.i, {version.format(bump)},
    CASE WHEN o.op = 'append' AND size = 0 THEN v.n WHEN o.expected <> v.version THEN v.n
         WHEN o.op = 'append' THEN v.n + size WHEN o.op = 'save' THEN size ELSE 0 END,
    s.accepted + CASE WHEN (o.op = 'append' AND size = 0) OR o.expected = v.version THEN 1 ELSE 0 END,
    CASE WHEN NOT (o.op = 'append' AND size = 0) AND o.expected = v.version THEN o.ts WHEN {old} THEN NULL ELSE s.written END
  FROM s JOIN o ON o.thread_id = s.thread_id AND o.i = s.i + 1,
    LATERAL (SELECT CASE WHEN {old} THEN 0 ELSE s.version END AS version, CASE WHEN {old} THEN 0 ELSE s.n END AS n) v)
SELECT thread_id, version::BIGINT AS version, n::BIGINT AS n_messages, accepted::BIGINT AS n_accepted, i::BIGINT AS n_ops
FROM s WHERE (thread_id, i) IN (SELECT thread_id, max(i) FROM o GROUP BY 1)"""


_SYNC = f"""{_T}, l AS (SELECT build_id, max(pos) AS last FROM t GROUP BY 1),
c AS (SELECT t.*, (pos = last) AS newest FROM t JOIN l USING (build_id) WHERE pos < last OR build_id % 5 <> 0),
s AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos DESC) AS suf FROM c),
g AS (SELECT l.build_id, last, (l.build_id % 5 <> 0) AS has_new, count(s.pos) AS n,
  coalesce(sum(CASE WHEN suf <= 397 THEN 1 ELSE 0 END), 0) AS kept FROM l LEFT JOIN s USING (build_id) GROUP BY ALL),
a AS (SELECT *, CASE WHEN n = kept THEN CASE WHEN has_new THEN 'append' ELSE 'noop' END WHEN kept = 0 THEN 'save_empty' ELSE 'save' END AS action FROM g)"""

_LISTS = f"""{_T}, f AS (SELECT *, CASE WHEN coalesce(role, '') <> lag(coalesce(role, '')) OVER (PARTITION BY build_id ORDER BY pos) THEN 4 ELSE 0 END AS turn FROM t),
s AS (SELECT *, 3 + sum(w + turn) OVER (PARTITION BY build_id ORDER BY pos) AS pre, 3 + sum(w + turn) OVER (PARTITION BY build_id) AS total,
  sum(w) OVER (PARTITION BY build_id ORDER BY pos DESC) AS suf FROM f)"""

#: A talk's messages at every 2^h-th place, for the smallest h under which they fit.
_HALVED = f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY pos) - 1 AS place FROM t),
h AS (SELECT r.*, x.h FROM r, (SELECT unnest(range(0, 40)) AS h) x WHERE place % (1::BIGINT << x.h) = 0),
n AS (SELECT build_id, h FROM h GROUP BY 1, 2 HAVING sum(w) <= 300), m AS (SELECT build_id, min(h) AS h FROM n GROUP BY 1)
SELECT build_id, pos, w::BIGINT AS w FROM h JOIN m USING (build_id, h)"""

ORACLES = {
    "q01_char_weights": f"WITH {_T} SELECT build_id, pos, w::BIGINT AS w FROM t",
    "q02_fixed_totals": "SELECT conv_id AS build_id, sum(12 + CASE WHEN turn % 4 = 2 THEN 5 ELSE 0 END)::BIGINT AS total, count(*)::BIGINT AS n FROM conversations GROUP BY 1",
    "q03_strict": f"""WITH {_T}, s AS (SELECT build_id, sum(w) AS total FROM t GROUP BY 1)
SELECT build_id, CASE WHEN total > 700 THEN 'BUDGET_EXCEEDED' ELSE '' END AS error_code, CASE WHEN total > 700 THEN 'talk' ELSE '' END AS error_block,
  CASE WHEN total > 700 THEN 0 ELSE total END::BIGINT AS total_tokens FROM s""",
    "q04_drop": f"WITH {_T}, s AS (SELECT *, sum(w) OVER (PARTITION BY build_id) AS total FROM t) SELECT build_id, pos, w::BIGINT AS w FROM s WHERE total <= 700",
    "q05_drop_tail": f"""WITH {_T}, s AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos) AS pre FROM t),
g AS (SELECT build_id, count(*) FILTER (pre <= 300) AS n, coalesce(sum(w) FILTER (pre <= 300), 0) AS used FROM s GROUP BY 1)
SELECT build_id, CASE WHEN n = 0 THEN 'BLOCK_TOO_LARGE' ELSE '' END AS error_code, CASE WHEN n = 0 THEN 'talk' ELSE '' END AS error_block,
  used::BIGINT AS total_tokens, n::BIGINT AS n_kept FROM g""",
    "q06_drop_head": _head(_T, "pos"),
    "q07_drop_head_min": _head(_T, "pos", 2),
    "q08_drop_head_protected": _head(_T, "CASE WHEN role <> 'system' THEN pos END"),
    "q09_drop_head_atomic": _head(_TT, "CASE WHEN pos % 4 = 3 THEN pos - 1 ELSE pos END"),
    "q10_drop_head_all": _head(_TT, "CASE WHEN pos % 4 = 3 THEN pos - 1 WHEN role NOT IN ('system', 'tool') THEN pos END", 2),
    "q11_summarize": f"""WITH {_T}, g AS (SELECT build_id, sum(w) AS total, count(*) AS n, arg_min(text, pos) AS opening FROM t GROUP BY 1),
s AS (SELECT *, 'Summary of ' || n || ': ' || CASE WHEN length(opening) > 80 THEN opening[1:80] || '...' ELSE opening END AS short FROM g)
SELECT t.build_id, pos, w::BIGINT AS w, text FROM t JOIN s USING (build_id) WHERE total <= 300
UNION ALL SELECT build_id, 0, ((length(short) + 3) // 4)::BIGINT, short FROM s WHERE total > 300 AND (length(short) + 3) // 4 <= 300""",
    "q12_assembly": _assembly(_PROFILE, "SELECT build_id, block_name, pos, w::BIGINT AS w FROM m"),
    "q13_block_figures": _assembly(
        _PROFILE,
        """SELECT build_id, 'instructions' AS block_name, 7::BIGINT AS tokens_in, 500::BIGINT AS budget, 7::BIGINT AS used, 1::BIGINT AS n_in, 1::BIGINT AS n_kept FROM k
UNION ALL SELECT rs.build_id, 'reference', rs.total, 200, ru.used, rs.n_in, ru.n FROM rs JOIN ru USING (build_id)
UNION ALL SELECT build_id, 'profile', p_total, least(60, left1), p_used, 1, CASE WHEN p_used > 0 THEN 1 ELSE 0 END FROM b WHERE p_total IS NOT NULL
UNION ALL SELECT b.build_id, 'conversation', max(c1.total), max(left2), coalesce(sum(CASE WHEN suf <= left2 THEN w END), 0), count(*), count(*) FILTER (suf <= left2)
  FROM b JOIN c1 USING (build_id) GROUP BY b.build_id""",
    ),
    "q14_ordinals": _assembly(_PROFILE, "SELECT build_id, row_number() OVER (PARTITION BY build_id ORDER BY o, pos) - 1 AS ordinal, block_name, pos FROM m"),
    "q15_formatter_over_budget": _assembly(
        _PROFILE,
        """, z AS (SELECT build_id, 2 * sum(w) AS total FROM m GROUP BY 1)
SELECT k.build_id, CASE WHEN ok.build_id IS NULL THEN 'BLOCK_TOO_LARGE' WHEN total > 500 THEN 'FORMATTER_EXCEEDED_BUDGET' ELSE '' END AS error_code,
  CASE WHEN ok.build_id IS NULL THEN 'reference' ELSE '' END AS error_block, coalesce(total, 0)::BIGINT AS total_tokens
FROM k LEFT JOIN ok USING (build_id) LEFT JOIN z USING (build_id)""",
    ),
    "q16_thread_sync": f"""WITH {_SYNC}
SELECT build_id, action, build_id % 7 AS expected_version, CASE action WHEN 'append' THEN 1 WHEN 'save' THEN kept ELSE 0 END::BIGINT AS n_messages FROM a""",
    "q17_replay_monotonic": _replay(False),
    "q18_replay_reset": _replay(True),
    "q19_equality": """SELECT conv_id AS build_id, sum(CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 0 ELSE 1 END)::BIGINT AS n_equal,
  NOT bool_or(conv_id % 3 = 0 AND turn = 1) AS same FROM conversations GROUP BY 1""",
    "q20_json_round_trip": """SELECT conv_id AS build_id, turn AS pos, CASE WHEN turn % 4 = 2 THEN 'assistant' WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role, text,
  CASE WHEN turn % 4 = 2 THEN 'c' || turn ELSE '' END AS call_id, CASE WHEN turn % 4 = 3 AND conv_id % 3 <> 0 THEN 'c' || (turn - 1) ELSE '' END AS result_of FROM conversations""",
    "q21_tool_weights": f"""WITH {_TT} SELECT build_id, pos, w::BIGINT AS counted,
  ((length(text) + 3) // 4 + CASE WHEN pos % 4 = 2 THEN 20 + 6 + length(pos::VARCHAR) ELSE 0 END)::BIGINT AS estimated FROM t""",
    "q22_image_weights": "SELECT conv_id AS build_id, turn AS pos, ((length(text) + CASE WHEN turn % 2 = 0 THEN 340 ELSE 0 END + 3) // 4)::BIGINT AS w FROM conversations",
    "q23_error_precedence": f"""WITH {_T}, k AS (SELECT DISTINCT build_id FROM t),
a AS (SELECT build_id, sum(w) AS total FROM t WHERE pos <= 1 GROUP BY 1),
r AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos) AS pre FROM t WHERE pos >= 2),
s AS (SELECT k.build_id, coalesce(a.total, 0) AS opening FROM k LEFT JOIN a USING (build_id)),
g AS (SELECT s.build_id, opening, count(r.pos) AS n, count(r.pos) FILTER (pre <= 450 - opening) AS kept, coalesce(sum(w) FILTER (pre <= 450 - opening), 0) AS used,
  coalesce(bool_or(r.pos = 2 AND r.build_id % 4 = 1), false) AS bare FROM s LEFT JOIN r USING (build_id) GROUP BY ALL),
e AS (SELECT *, CASE WHEN opening > 250 THEN 'BUDGET_EXCEEDED' WHEN bare THEN 'NIL_STRATEGY' WHEN n > 0 AND kept = 0 THEN 'BLOCK_TOO_LARGE' ELSE '' END AS error_code FROM g)
SELECT build_id, error_code, CASE error_code WHEN 'BUDGET_EXCEEDED' THEN 'opening' WHEN 'NIL_STRATEGY' THEN 'bare' WHEN 'BLOCK_TOO_LARGE' THEN 'rest' ELSE '' END AS error_block,
  CASE WHEN error_code = '' THEN opening + used ELSE 0 END::BIGINT AS total_tokens FROM e""",
    "q24_history_load": f"""WITH {_SYNC}, w AS (SELECT s.*, action FROM s JOIN a USING (build_id)
  WHERE (action = 'append' AND s.newest) OR (action = 'save' AND suf <= 397))
SELECT build_id::VARCHAR AS thread_id, 1::BIGINT AS version, (row_number() OVER (PARTITION BY build_id ORDER BY pos) - 1)::BIGINT AS pos, text FROM w""",
    "q25_ttl": _replay(False, True),
    "q29_metadata": """SELECT conv_id AS build_id, turn AS pos, conv_id % 3 <> 0 AS equal, conv_id % 3 <> 0 AS equal_after, true AS unchanged, 1::BIGINT AS x FROM conversations""",
    "q30_counter_failure": """WITH g AS (SELECT conv_id AS build_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'counter' AS kind, build_id, 'TOKEN_COUNT_FAILED' AS error_code, CASE WHEN build_id % 2 = 0 THEN 'talk' ELSE '' END AS error_block,
  'INVALID_CHARS_PER_TOKEN' AS cause, 0::BIGINT AS total_tokens FROM g
UNION ALL SELECT 'strategy', build_id, CASE WHEN n > 3 AND n % 2 = 1 THEN 'STRATEGY_FAILED' ELSE '' END, CASE WHEN n > 3 AND n % 2 = 1 THEN 'own' ELSE '' END,
  CASE WHEN n > 3 AND n % 2 = 1 THEN 'ValueError: odd' ELSE '' END, CASE WHEN n <= 3 THEN 100 * n WHEN n % 2 = 0 THEN 100 ELSE 0 END FROM g""",
    "q31_batch_sync": f"""WITH {_SYNC}, x AS (SELECT *, action <> 'noop' AND build_id % 3 = 0 AS crossed FROM a),
c2 AS (SELECT c.build_id, c.pos::DOUBLE AS pos, c.w FROM c JOIN x USING (build_id) UNION ALL SELECT build_id, last - 0.5, 2 FROM x WHERE crossed),
s2 AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos DESC) AS suf FROM c2),
g2 AS (SELECT x.build_id, crossed, has_new, count(s2.pos) AS n, count(*) FILTER (suf <= 397) AS kept FROM x LEFT JOIN s2 USING (build_id) GROUP BY ALL),
z AS (SELECT *, CASE WHEN n = kept THEN CASE WHEN has_new THEN 'append' ELSE 'noop' END WHEN kept = 0 THEN 'save_empty' ELSE 'save' END AS action FROM g2)
SELECT build_id, action, CASE WHEN crossed THEN 2 ELSE 1 END AS rounds,
  (1 + CASE WHEN crossed THEN 1 ELSE 0 END + CASE WHEN action = 'noop' THEN 0 ELSE 1 END)::BIGINT AS version, kept::BIGINT AS n_stored FROM z""",
    "q32_compacted_store": "SELECT thread_id, version, n_messages FROM (" + _replay(False, ops=_OPS.replace("event_id AS seq", "(event_id // 1000) % 3 * 1000000000 + event_id AS seq").replace("ORDER BY event_id) AS i", "ORDER BY (event_id // 1000) % 3, event_id) AS i")) + ")",
    "q28_replay_hot_thread": _replay(False, ops=_OPS.replace("o AS", "e AS", 1) + ", " + _HOT),
    "q26_other_profile": _assembly("SELECT build_id, 0 AS pos, 5 AS w FROM k", "SELECT build_id, block_name, pos, w::BIGINT AS w FROM m"),
    "q27_middleware": f"""WITH {_T}, s AS (SELECT *, sum(w) OVER (PARTITION BY build_id ORDER BY pos DESC) AS suf FROM t),
x AS (SELECT * FROM s WHERE suf <= 300)
SELECT build_id, count(*)::BIGINT AS n_before, count(*) FILTER (role <> 'system')::BIGINT AS n_after,
  sum(w) FILTER (role <> 'system')::BIGINT AS tokens FROM x GROUP BY 1 HAVING count(*) FILTER (role <> 'system') > 0""",
    "q33_list_tail": f"WITH {_LISTS} SELECT build_id, pos, w::BIGINT AS w FROM s WHERE total <= 300 OR pre <= 300",
    "q34_list_head": f"""WITH {_LISTS}, k AS (SELECT * FROM s WHERE total <= 300 OR suf <= 300),
a AS (SELECT build_id, count(*) AS n, 3 + sum(w + turn) - arg_min(turn, pos) AS used FROM k GROUP BY 1),
b AS (SELECT build_id, max(total) AS total FROM s GROUP BY 1),
z AS (SELECT b.*, coalesce(n, 0) AS n, coalesce(used, 0) AS used, coalesce(used, 0) > 300 AS over FROM b LEFT JOIN a USING (build_id))
SELECT build_id, CASE WHEN over THEN 'STRATEGY_EXCEEDED_BUDGET' ELSE '' END AS error_code, CASE WHEN over THEN 'talk' ELSE '' END AS error_block,
  CASE WHEN over THEN 0 ELSE used END::BIGINT AS total_tokens, total::BIGINT AS tokens_in, CASE WHEN over THEN 0 ELSE used END::BIGINT AS used,
  CASE WHEN over THEN 0 ELSE n END::BIGINT AS n_kept FROM z""",
    "q35_own_strategy": _HALVED,
}
