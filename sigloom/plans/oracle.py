"""DuckDB statements equal to the queries in ``queries.py`` (same column names)."""

from __future__ import annotations

import re

from ..functions import abbrev, tokens
from . import queries as _q


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"

ORACLE: dict[str, str] = {}

ORACLE["sig_exact"] = """
WITH s AS (
  SELECT l.l_orderkey, count(*) AS arity,
         list_sort(list(p.p_brand || chr(31) || p.p_type)) AS sig
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey)
SELECT l_orderkey AS o_orderkey, arity, count(*) OVER (PARTITION BY arity, sig) AS n_same
FROM s
"""

ORACLE["sig_related"] = """
WITH items AS (
  SELECT l.l_orderkey AS oid, p.p_brand || chr(31) || p.p_type AS leaf
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
ar AS (SELECT oid, count(*) AS arity, count(DISTINCT leaf) AS k FROM items GROUP BY oid),
dl AS (SELECT DISTINCT oid, leaf FROM items),
pairs AS (SELECT a.oid AS q, b.oid AS d, count(*) AS shared
          FROM dl a JOIN dl b ON a.leaf = b.leaf GROUP BY a.oid, b.oid)
SELECT p.q AS o_orderkey, qa.arity AS arity,
       CAST(sum(CASE WHEN (da.arity >= qa.arity AND p.shared = qa.k)
                  OR (da.arity < qa.arity AND p.shared = da.k) THEN 1 ELSE 0 END) AS BIGINT) AS n_related
FROM pairs p JOIN ar qa ON qa.oid = p.q JOIN ar da ON da.oid = p.d
GROUP BY p.q, qa.arity
"""

ORACLE["sig_contains"] = """
WITH terms AS (SELECT DISTINCT p_brand AS term FROM part UNION SELECT DISTINCT p_type FROM part),
m AS (SELECT DISTINCT l.l_orderkey, t.term
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      JOIN terms t ON t.term = p.p_brand OR t.term = p.p_type)
SELECT terms.term, count(m.l_orderkey) AS n_sigs
FROM terms LEFT JOIN m ON m.term = terms.term
GROUP BY terms.term
"""

ORACLE["seq_split"] = """
WITH r AS (
  SELECT user_id, event_id, ts, event_type = 'error' AS d,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nd
  FROM events),
st AS (SELECT user_id, nd AS seg, count(*) AS n_items,
              first(event_id ORDER BY ts, event_id) AS first_event_id,
              last(event_id ORDER BY ts, event_id) AS last_event_id
       FROM r WHERE NOT d GROUP BY user_id, nd),
k AS (SELECT user_id, nd - 1 AS seg FROM r WHERE d UNION SELECT user_id, seg FROM st)
SELECT k.user_id, CAST(k.seg AS BIGINT) AS seg, coalesce(st.n_items, 0) AS n_items, st.first_event_id, st.last_event_id
FROM k LEFT JOIN st ON st.user_id = k.user_id AND st.seg = k.seg
"""

ORACLE["seq_nesting"] = """
SELECT user_id, event_id, CAST(depth AS BIGINT) AS depth, depth = 0 AS balanced FROM (
  SELECT user_id, event_id,
         sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth
  FROM events)
"""

ORACLE["seq_first"] = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_purchase_id, min(pos) AS first_purchase_pos
FROM e WHERE event_type = 'purchase' GROUP BY user_id
"""

ORACLE["seq_run"] = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT user_id, coalesce(min(pos) FILTER (WHERE NOT coalesce(event_type <> 'error', false)), count(*)) AS run
FROM e GROUP BY user_id
"""

ORACLE["seq_prev"] = """
WITH e AS (
  SELECT user_id, event_id, event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type,
         sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth
  FROM events)
SELECT user_id, event_id, prev_type,
       coalesce(prev_type = 'view' AND event_type = 'purchase', false) AS view_purchase,
       coalesce(prev_type = 'view' AND event_type = 'purchase' AND depth > 0, false) AS nested_view_purchase
FROM e
"""

ORACLE["array_ops"] = """
SELECT vec_id,
       len(embedding) AS n,
       len(list_filter(embedding, lambda x: x < 0)) AS n_neg,
       list_position(list_transform(embedding, lambda x: x < 0), true) - 1 AS first_neg_idx,
       coalesce(list_position(list_transform(embedding, lambda x: NOT (x >= 0)), true) - 1, len(embedding)) AS lead_nonneg,
       embedding[2] AS cut_0, embedding[3] AS cut_1, embedding[4] AS cut_2, embedding[-1] AS cut_3,
       embedding[-1] > embedding[1] AS last_gt_first,
       len(list_filter(embedding, lambda x: x > 0.9)) > 0 AS any_high,
       len(list_filter(embedding, lambda x: NOT (abs(x) < 1))) = 0 AS all_unit,
       list_contains(list_transform(embedding, lambda x: x > 0), true) AS has_pos
FROM embeddings
"""

ORACLE["flatten"] = """
WITH w AS (
  SELECT doc_id, flatten(list_transform(string_split(text, chr(10)),
                                        lambda l: list_filter(string_split(l, ' '), lambda x: x <> ''))) AS w
  FROM documents)
SELECT doc_id, i::INTEGER AS pos, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w)
"""

_CUSTOMER_TREE = """
  SELECT c.c_custkey, c.c_acctbal, n.n_name, n.n_nationkey, r.r_name, r.r_regionkey
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
"""

ORACLE["tri_state"] = f"""
WITH t AS ({_CUSTOMER_TREE})
SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS INTEGER) AS lvl,
       CASE WHEN bool_and(c_acctbal > 0) THEN true WHEN bool_or(c_acctbal > 0) THEN NULL ELSE false END AS state,
       count(*) AS n_leaves
FROM t GROUP BY ROLLUP (r_name, n_name)
"""

ORACLE["propagate_down"] = f"""
WITH t AS ({_CUSTOMER_TREE}),
a AS (
  SELECT c_custkey, r_regionkey * 2 + 7 AS seq, r_regionkey % 2 = 0 AS v FROM t
  UNION ALL
  SELECT c_custkey, n_nationkey AS seq,
         CASE WHEN n_nationkey % 3 = 0 THEN false WHEN n_nationkey % 3 = 1 THEN NULL ELSE true END AS v
  FROM t)
SELECT c_custkey, coalesce(arg_max_null(v, seq), false) AS enabled FROM a GROUP BY c_custkey
"""

ORACLE["string_agg"] = """
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n_turns
FROM conversations GROUP BY conv_id
"""

ORACLE["progress"] = """
WITH lab AS (SELECT DISTINCT doc_id FROM labels)
SELECT d.lang, d.source, count(*) AS n_done, count(lab.doc_id) AS n_ok,
       count(*) - count(lab.doc_id) AS n_error
FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id GROUP BY d.lang, d.source
"""

ORACLE["enrich"] = """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic,
       l.quality IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

ORACLE["worklist"] = """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""

ORACLE["resolve_first"] = """
WITH li AS (
  SELECT l.l_partkey, l.l_suppkey, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_acctbal > 0),
f AS (SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 100000 + l_linenumber) AS s_suppkey
      FROM li GROUP BY l_partkey)
SELECT p.p_partkey, f.s_suppkey, CASE WHEN f.s_suppkey IS NULL THEN 'no supplier' END AS error
FROM part p LEFT JOIN f ON f.l_partkey = p.p_partkey
"""

_LAYER_EDGES = """
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
"""

ORACLE["topo_levels"] = f"""
WITH RECURSIVE e AS ({_LAYER_EDGES}),
ns AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
lv(node, level) AS (
  SELECT node, 0 FROM ns WHERE node NOT IN (SELECT dst FROM e)
  UNION
  SELECT e.dst, lv.level + 1 FROM lv JOIN e ON e.src = lv.node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY node
"""

ORACLE["graph_reverse"] = f"""
SELECT dst AS src, src AS dst FROM ({_LAYER_EDGES})
"""

ORACLE["graph_nodes"] = f"""
WITH e AS ({_LAYER_EDGES}),
ns AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, (SELECT count(*) FROM e WHERE e.src = ns.node) AS out_degree,
       (SELECT count(*) FROM e WHERE e.dst = ns.node) AS in_degree
FROM ns
"""

ORACLE["module_select"] = """
WITH good AS (SELECT DISTINCT d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id
              WHERE l.quality = 1)
SELECT d.doc_id, d.lang, d.source FROM documents d
WHERE EXISTS (SELECT 1 FROM good g WHERE g.lang = d.lang AND g.source = d.source)
"""

ORACLE["scope_union"] = """
SELECT p_partkey, name, 'import' AS origin FROM (
  SELECT p_partkey, unnest(list_filter(regexp_split_to_array(trim(translate(p_name, chr(10) || chr(9), '  ')), '[, \t\n]'),
                                       lambda x: x <> '')) AS name
  FROM part)
UNION ALL
SELECT p_partkey, p_brand AS name, 'selected' AS origin FROM part
"""

_P = _lit(tokens.PATTERN_PLAIN)
_TAG = "CASE " + " ".join(f"WHEN regexp_full_match(value, {_lit(p)}) THEN '{t}'" for t, p in tokens.RULES) + " END"


def _lastnl(x: str) -> str:
    return f"(CASE WHEN strpos({x}, chr(10)) > 0 THEN length({x}) - strpos(reverse({x}), chr(10)) ELSE -1 END)"


def _nl(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


ORACLE["tokenise"] = f"""
WITH t AS (SELECT doc_id, regexp_split_to_array(text, {_P}) AS g, regexp_extract_all(text, {_P}) AS v
           FROM documents),
x AS (SELECT doc_id, unnest(range(len(v))) AS pos, unnest(g[1:len(v)]) AS gap, unnest(v) AS value FROM t),
o AS (SELECT *, coalesce(sum(length(gap || value)) OVER w, 0) AS off,
               coalesce(sum({_nl("(gap || value)")}) OVER w, 0) AS nl
      FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, coalesce(max(CASE WHEN {_lastnl("(gap || value)")} >= 0 THEN off + {_lastnl("(gap || value)")} END)
                  OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_nl
      FROM o)
SELECT doc_id, pos, {_TAG} AS tag, value, CAST(off + length(gap) AS BIGINT) AS start_idx,
       CAST(nl + {_nl("gap")} + 1 AS BIGINT) AS line,
       CAST(off + length(gap) - (CASE WHEN {_lastnl("gap")} >= 0 THEN off + {_lastnl("gap")} ELSE prev_nl END)
            AS BIGINT) AS col
FROM p
"""

ORACLE["token_gaps"] = f"""
WITH t AS (SELECT doc_id, regexp_split_to_array(text, {_P}) AS g FROM documents),
x AS (SELECT doc_id, unnest(range(len(g) - 1)) AS pos, unnest(g[1:len(g) - 1]) AS gap FROM t)
SELECT doc_id, pos, gap FROM x WHERE regexp_matches(gap, '\\S')
"""

_LOG_BODY = _lit(r'^(?:' + re.escape(_q.LOG_PROMPT) + r')?\(((?:"[^"]*"|[^)"])*)')

ORACLE["log_parse"] = f"""
WITH l AS (
  SELECT event_id,
         CASE WHEN event_id % 10 = 9 THEN 'junk ' || event_id
              ELSE (CASE WHEN event_id % 3 = 0 THEN {_lit(_q.LOG_PROMPT)} ELSE '' END)
                   || '(' || event_type || ' "' || props || '" ' || user_id || ')' END AS line
  FROM events),
w AS (SELECT event_id, line,
             list_transform(regexp_extract_all(regexp_extract(line, {_LOG_BODY}, 1), {_lit('([^ "]*"[^"]*"|[^ "]+).?')}, 1),
                            lambda x: replace(x, '"', '')) AS w
      FROM l)
SELECT event_id,
       CASE WHEN len(w) > 0 THEN w[1] END AS tag,
       CASE WHEN len(w) > 0 THEN w[2:len(w)] END AS args,
       CASE WHEN len(w) = 0 THEN line END AS error
FROM w
"""


def _abbrev_sql() -> str:
    pairs = abbrev.flatten_dictionary(_q.ABBREVIATIONS)
    case = "CASE p " + " ".join(f"WHEN {_lit(chr(92) + k)} THEN {_lit(v)}" for k, v in pairs) + " ELSE p END"
    cut = _lit(abbrev.cut_pattern(pairs))
    return f"""
SELECT doc_id,
       array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '([otc])', '\\\\\\1', 'g'), {cut}),
                                      lambda p: {case}), '') AS expanded
FROM documents
"""


ORACLE["expand_abbrev"] = _abbrev_sql()


def _expand_patterns(entries: list[tuple[str, str]]) -> dict[str, str]:
    """Plain restatement: substitute references until nothing changes."""
    out = dict(entries)
    for _ in range(len(out) + 1):
        for k, v in list(out.items()):
            out[k] = re.sub(r"\(([A-Za-z_][A-Za-z0-9_]*)\)", lambda m: "(?:" + out[m.group(1)] + ")", v)
    return out


def _dict_sql() -> str:
    ex = _expand_patterns(_q.PATTERNS)
    cols = ", ".join(f"CAST(len(regexp_extract_all(text, {_lit(ex[n])})) AS BIGINT) AS n_{n}" for n, _ in _q.PATTERNS)
    return f"SELECT doc_id, {cols} FROM documents"


ORACLE["expand_dict"] = _dict_sql()

ORACLE["dict_errors"] = """
WITH RECURSIVE e AS (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_size % 2 <> 0 THEN greatest(p_partkey - p_size, 0) END AS ref FROM part),
x(k, expanded) AS (
  SELECT k, b FROM e WHERE ref IS NULL
  UNION ALL SELECT e.k, e.b || '(?:' || x.expanded || ')' FROM e JOIN x ON e.ref = x.k)
SELECT 'p' || e.k AS name, expanded, CASE WHEN expanded IS NULL THEN 'unresolved reference' END AS error FROM e LEFT JOIN x ON e.k = x.k
"""

ORACLE["fifo_match"] = """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'R' ELSE 'S' END AS k
           FROM events WHERE event_type IN ('view', 'purchase')),
c AS (SELECT *, sum(CASE WHEN k = 'R' THEN 1 ELSE -1 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM e),
f AS (SELECT *, least(0, coalesce(min(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS flo FROM c),
ok AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS rn
       FROM f WHERE k = 'R' OR cum >= flo)
SELECT r.user_id, r.event_id AS req_event_id, s.event_id AS resp_event_id
FROM ok r JOIN ok s ON r.user_id = s.user_id AND r.rn = s.rn AND r.k = 'R' AND s.k = 'S'
"""


def _queue(kinds: str, accepted: str) -> str:
    """Each user's queue replayed event by event; ``accepted`` tells whether request ``x`` takes event ``e``."""
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE event_type IN ({kinds})),
q(user_id, n, waiting, req, resp) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, k VARCHAR)[]), CAST(NULL AS BIGINT),
         CAST(NULL AS BIGINT) FROM e
  UNION ALL
  SELECT user_id, n, CASE WHEN k IN ('view', 'click', 'error') THEN list_append(waiting, struct_pack(id := event_id, k := k))
                          ELSE list_filter(waiting, lambda x: hit IS NULL OR x.id <> hit) END, hit, event_id
  FROM (SELECT q.user_id, e.n, e.event_id, e.k, q.waiting,
               list_filter(q.waiting, lambda x: {accepted})[1].id AS hit
        FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1))
SELECT user_id, req AS req_event_id, resp AS resp_event_id FROM q WHERE req IS NOT NULL
"""


ORACLE["fifo_kinds"] = _queue("'view', 'click', 'purchase'", "e.k = 'purchase'")
ORACLE["fifo_overlap"] = _queue("'view', 'click', 'error', 'purchase', 'signup'",
                                "(e.k = 'purchase' AND x.k <> 'error') OR (e.k = 'signup' AND x.k <> 'view')")

_LINES = r"""
  SELECT doc_id, n, regexp_replace(line, '\r$', '') AS line FROM (
    SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
"""
_SIG = r"^\s*(\S+)\s+:\s*(.*)$"

ORACLE["line_scan"] = rf"""
WITH l AS ({_LINES})
SELECT doc_id, n, length(regexp_extract(line, '^(\s*)', 1)) AS ind, regexp_extract(line, '^\s*(\S+)', 1) AS w,
       CASE WHEN regexp_matches(line, '{_SIG}') THEN regexp_extract(line, '{_SIG}', 1) END AS sig_name
FROM l WHERE regexp_matches(line, '\S')
"""

ORACLE["line_fold"] = rf"""
WITH l AS (SELECT * FROM ({_LINES}) WHERE regexp_matches(line, '\S')),
i AS (SELECT *, coalesce(max(CASE WHEN regexp_matches(line, '^\p{{Lu}}') THEN n END)
                  OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), -1) AS island FROM l)
SELECT doc_id, island, count(*) AS n_lines, string_agg(line, ' ' ORDER BY n) AS folded
FROM i GROUP BY doc_id, island
"""

ORACLE["scope_lines"] = """
WITH RECURSIVE l AS (SELECT user_id, event_id AS n, 2 * (event_id % 4) AS ind, event_type AS w FROM events),
p AS (SELECT a.user_id, a.n,
             (SELECT max(b.n) FROM l b WHERE b.user_id = a.user_id AND b.n < a.n AND b.ind < a.ind) AS parent
      FROM l a),
ch(user_id, n, anc) AS (
  SELECT user_id, n, parent FROM p WHERE parent IS NOT NULL
  UNION ALL
  SELECT ch.user_id, ch.n, p.parent FROM ch JOIN p ON p.user_id = ch.user_id AND p.n = ch.anc
  WHERE p.parent IS NOT NULL)
SELECT p.user_id, p.n AS event_id, p.parent AS parent_event_id, count(ch.anc) AS depth,
       coalesce(string_agg(l.w, '.' ORDER BY ch.anc), '') AS path
FROM p LEFT JOIN ch ON ch.user_id = p.user_id AND ch.n = p.n
LEFT JOIN l ON l.user_id = ch.user_id AND l.n = ch.anc
GROUP BY p.user_id, p.n, p.parent
"""

ORACLE["kind_classify"] = """
SELECT event_id,
       CASE event_type WHEN 'signup' THEN 'DataType' WHEN 'purchase' THEN 'RecordType'
                       WHEN 'view' THEN 'Pattern' WHEN 'click' THEN 'RecordConstructor' ELSE 'Function' END AS kind,
       'e' || event_id AS name,
       CASE event_type WHEN 'signup' THEN ': U' || user_id WHEN 'purchase' THEN ': U' || user_id
                       WHEN 'view' THEN 'x = U' || user_id WHEN 'click' THEN NULL ELSE ': U' || user_id END AS type_raw,
       CASE event_type WHEN 'click' THEN 'e' || event_id
                       WHEN 'view' THEN 'e' || event_id || ' x = U' || user_id
                       ELSE 'e' || event_id || ' : U' || user_id END AS title
FROM events
"""

ORACLE["rename_binders"] = """
WITH w AS (SELECT p_partkey, p_type, string_split_regex(trim(p_name), ' +') AS w FROM part),
x AS (SELECT p_partkey, p_type, list_transform(w, lambda v:
             '@' || len(list_distinct(list_slice(w, 1, list_position(w, v) - 1)))) AS b FROM w)
SELECT p_partkey, array_to_string(list_transform(b, lambda v: '{ ' || v || ' : ' || p_type || ' }'), ' ')
                  || ' -> ' || b[-1] AS renamed FROM x
"""

ORACLE["name_lookup"] = """
WITH w AS (SELECT p_partkey, p_brand, string_split_regex(trim(p_name), ' +') AS w FROM part),
terms AS (SELECT DISTINCT unnest(w) AS term FROM w)
SELECT t.term, w.p_partkey, bool_or(w.w[-1] = t.term) AS exact
FROM terms t JOIN w ON list_contains(w.w, t.term) OR w.p_brand = t.term
GROUP BY t.term, w.p_partkey
"""

ORACLE["search_parts"] = """
WITH p AS (
  SELECT p_partkey, string_split_regex(trim(p_name), ' +') AS w, replace(p_brand, '#', '') AS brand, p_type AS type
  FROM part
), e AS (
  SELECT DISTINCT '(' || type || ' -> ' || brand || ') -> ' || array_to_string(list_reverse(w), ' -> ') AS query,
         list_sort(w) AS ws, brand, type FROM p
), r AS (
  SELECT DISTINCT w[1] || ' -> (' || type || ' -> ' || brand || ')' AS query, w[1] AS word, brand, type FROM p
)
SELECT 'E:' || query AS query_id, p_partkey, false AS by_name, true AS by_type
FROM e JOIN p ON e.brand = p.brand AND e.type = p.type AND e.ws = list_sort(p.w)
UNION ALL
SELECT 'R:' || query, p_partkey, false, true
FROM r JOIN p ON r.brand = p.brand AND r.type = p.type AND list_contains(p.w, r.word)
UNION ALL
SELECT 'N:' || n.word, p_partkey, true, false
FROM (SELECT DISTINCT w[-1] AS word FROM p) n JOIN p ON p.w[-1] = n.word
UNION ALL
SELECT 'L:' || l.word, p_partkey, true, false
FROM (SELECT DISTINCT w[1] AS word FROM p) l JOIN p ON list_contains(p.w, l.word)
"""

ORACLE["search_scope"] = """
WITH p AS (
  SELECT p_partkey, string_split_regex(trim(p_name), ' +') AS w, p_brand AS module, p_type AS library, p_size FROM part
), x AS (
  SELECT DISTINCT library, module FROM p WHERE p_size = 50
), d AS (
  SELECT p.*, list_sort(w) AS ws, (library, module) IN (SELECT (library, module) FROM x) AS examined FROM p
)
SELECT 'E:' || e.library || ':' || query AS query_id, p_partkey, false AS by_name, true AS by_type
FROM (SELECT DISTINCT library, array_to_string(list_reverse(w), ' -> ') AS query, ws FROM d) e
JOIN d ON d.library = e.library AND d.ws = e.ws
UNION ALL
SELECT 'R:' || r.module || ':' || word, p_partkey, false, true
FROM (SELECT DISTINCT module, w[1] AS word FROM d) r JOIN d ON d.module = r.module AND list_contains(d.w, word)
UNION ALL
SELECT 'N:' || word, p_partkey, true, false
FROM (SELECT DISTINCT w[-1] AS word FROM d) n JOIN d ON d.w[-1] = word AND d.examined
UNION ALL
SELECT 'L:' || l.library || ':' || word, p_partkey, true, false
FROM (SELECT DISTINCT library, w[1] AS word FROM d) l
JOIN d ON list_contains(d.w, word) AND (d.library = l.library OR d.examined)
"""
