"""The registered queries of this package: each operator over its whole table, and the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from .common import store
from . import (chat_format, chat_repair, decontaminate, embedding_dedup, jaccard_join, language_id, mixing, sharding,
               substring_dedup, token_files, url_filter, warc, whitening)

TOKENIZER = "byte_bpe_50k.json"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
PROBE = "<|im_end|><|im_start|>assistant ok"
SHARDS = 24


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(rows.unionByName(probe)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, url_filter.RULES_SCHEMA)
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, ["page_id"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), items, whole=decontaminate.WHOLE)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_ids(spark, token_files.write_ids(docs, public_tokenizers.path(TOKENIZER)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return (language_id.predict(docs, language_id.train(docs), ["doc_id"])
            .select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_repair.report(chat_repair.damage(rows), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.resolve(store(warc.read_archives(spark, path).drop("payload")))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_sharding, op4_decontaminate, op5_embedding_dedup,
                                   op6_token_files, op7_language_id, op8_mixing, op9_jaccard_join, op10_substring_dedup, op11_chat_repair, op12_whitening, op13_warc)}

ORACLE = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'))
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars,
  true AS round_trip
FROM turns GROUP BY conv_id""",
    "op2_url_filter": r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, row_number() OVER () AS k,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT k, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rhost) DESC, length(rpath) DESC) AS r
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (k)""",
    "op8_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS s, md5(coalesce(doc_id::VARCHAR, 't' || text, '')) AS h,
    (len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) + 1)::BIGINT AS t FROM documents),
src AS (SELECT s, sum(t)::BIGINT AS tokens FROM d GROUP BY s),
tot AS (SELECT sum(tokens)::DOUBLE AS total, max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least, count(*) AS n FROM src),
be(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(p)) - sum(p * ln(q) * x) / sum(p) FROM (
      SELECT tokens / total AS q, (lo + hi) / 2 AS x, pow(tokens / total, (lo + hi) / 2) AS p FROM src, tot)) >= 0.95 * ln((SELECT n FROM tot)) AS ok
    FROM be WHERE i < 32)),
br(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT pow(most / least, 1 - (lo + hi) / 2) FROM tot) > 4 AS ok FROM br WHERE i < 32)),
ex AS (SELECT CASE WHEN n <= 1 OR least = most THEN 1.0 ELSE least(greatest(floor((SELECT lo FROM be WHERE i = 32) * 1e6) / 1e6,
    ceil((SELECT lo FROM br WHERE i = 32) * 1e6) / 1e6), 1.0) END::DOUBLE AS x FROM tot),
w AS (SELECT s, tokens, round(pow(tokens / total, x) / (SELECT sum(pow(tokens / total, x)) FROM src, tot, ex), 12) AS weight, x FROM src, tot, ex),
b AS (SELECT max(ceil(tokens / weight)) AS budget FROM w),
placed AS (SELECT doc_id, source, d.s, h, t, weight, x, tokens, ceil(weight * budget)::BIGINT AS quota,
    (sum(t) OVER (PARTITION BY d.s ORDER BY h, t ROWS UNBOUNDED PRECEDING) - t)::BIGINT AS place FROM d JOIN w USING (s), b),
u AS (SELECT *, unnest(range(0, ceil((quota - place) / tokens)::BIGINT)) AS epoch FROM placed WHERE place < quota),
k AS (SELECT *, floor((epoch * tokens + place) / (weight * 200000))::BIGINT AS block FROM u)
SELECT doc_id, source, t AS tokens, weight, x AS exponent, epoch, block,
  (row_number() OVER (PARTITION BY block ORDER BY md5(h || ':' || epoch || ':' || block), h, t) - 1)::BIGINT AS slot FROM k""",
    "op11_chat_repair": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS v
    FROM range(256) r(b))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
cased AS (SELECT conv_id, turn, role, text,
    xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS k FROM keyed, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM cased WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
faults AS (SELECT *, left(role, 1) AS i,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
         WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (f = 'b'))::BIGINT AS blank,
    (count(*) FILTER (f = 'd'))::BIGINT AS duplicate, (count(*) FILTER (f = 't'))::BIGINT AS truncated,
    (count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal, max(pos) AS n FROM faults GROUP BY conv_id),
-- The cheapest (cost, audit, lines) from each state of the roles so far to the end, a turn earlier in every step.
fold(conv_id, place, o, s, u, a) AS (
  SELECT conv_id, n, {'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}, {'c': 5, 'a': 'I', 't': ['assistant:']},
    {'c': 0, 'a': '', 't': []::VARCHAR[]} FROM facts
  UNION ALL
  SELECT conv_id, place - 1,
    least(p.o, {'c': p.u.c + 5, 'a': 'I' || p.u.a, 't': ['user:'] || p.u.t}, {'c': p.a.c + 10, 'a': 'II' || p.a.a, 't': ['user:', 'assistant:'] || p.a.t}),
    least(p.s, {'c': p.u.c + 5, 'a': 'I' || p.u.a, 't': ['user:'] || p.u.t}, {'c': p.a.c + 10, 'a': 'II' || p.a.a, 't': ['user:', 'assistant:'] || p.a.t}),
    least(p.u, {'c': p.a.c + 5, 'a': 'I' || p.a.a, 't': ['assistant:'] || p.a.t}),
    least(p.a, {'c': p.u.c + 5, 'a': 'I' || p.u.a, 't': ['user:'] || p.u.t})
  FROM (SELECT conv_id, place,
      least({'c': o.c + 2, 'a': 'D' || o.a, 't': o.t}, {'c': s.c + x + ks, 'a': 'K' || s.a, 't': [l] || s.t}, {'c': u.c + x + ku, 'a': 'K' || u.a, 't': [l] || u.t},
            {'c': u.c + x + 1, 'a': 'R' || u.a, 't': ['user:' || m] || u.t}) AS o,
      least({'c': s.c + 2, 'a': 'D' || s.a, 't': s.t}, {'c': u.c + x + ku, 'a': 'K' || u.a, 't': [l] || u.t}, {'c': u.c + x + 1, 'a': 'R' || u.a, 't': ['user:' || m] || u.t}) AS s,
      least({'c': u.c + 2, 'a': 'D' || u.a, 't': u.t}, {'c': a.c + x + ka, 'a': 'K' || a.a, 't': [l] || a.t}, {'c': a.c + x + 1, 'a': 'R' || a.a, 't': ['assistant:' || m] || a.t}) AS u,
      least({'c': a.c + 2, 'a': 'D' || a.a, 't': a.t}, {'c': u.c + x + ku, 'a': 'K' || u.a, 't': [l] || u.t}, {'c': u.c + x + 1, 'a': 'R' || u.a, 't': ['user:' || m] || u.t}) AS a
    FROM (SELECT fold.*, role || ':' || text AS l, text AS m, CASE f WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END AS x,
        CASE WHEN i = 's' THEN 0 ELSE 1000000000 END AS ks, CASE WHEN i = 'u' THEN 0 ELSE 1000000000 END AS ku, CASE WHEN i = 'a' THEN 0 ELSE 1000000000 END AS ka
      FROM fold JOIN faults ON fold.conv_id IS NOT DISTINCT FROM faults.conv_id AND fold.place = faults.pos)) p)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(fold.o.c, 0)::BIGINT AS cost, coalesce(fold.o.a, '') AS audit,
  sha256(coalesce(array_to_string(fold.o.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN facts ON ids.conv_id IS NOT DISTINCT FROM facts.conv_id
LEFT JOIN fold ON ids.conv_id IS NOT DISTINCT FROM fold.conv_id AND place = 0""",
    "op13_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to, NULL::VARCHAR AS problem
FROM m""",
}
