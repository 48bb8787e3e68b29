"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, decontaminate, fingerprints, licenses, mixing, ngramlm, personal, prefixtrie, simhash, suffixdedup, toxicity, turnrepair, urlfilter
from paperloom.llm.common import read

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_texts(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(licenses.KNOWN, "license string, text string")
    return licenses.scan(read(spark, sf_dir, "documents"), known)


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, docs, read(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_digests(personal.personal_spans(read(spark, sf_dir, "documents")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repair_damaged(read(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(read(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT p.*, (SELECT max_by(rh || rp, length(rh || rp)) FROM rules
    WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule FROM parts p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NULL THEN 'allow' ELSE (SELECT rv FROM rules WHERE rh || rp = rule) END AS verdict FROM best
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = rf"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)}),
spellings AS (SELECT MAP {{'licence': 'license', 'licences': 'licenses', 'licenced': 'licensed', 'licencing': 'licensing',
  'sublicence': 'sublicense', 'favour': 'favor', 'organisation': 'organization', 'organisations': 'organizations',
  'authorisation': 'authorization', 'authorised': 'authorized', 'judgement': 'judgment', 'acknowledgement': 'acknowledgment',
  'fulfil': 'fulfill', 'whilst': 'while', 'http': 'https', 'noncommercial': 'nc', 'v2': '2', 'v3': '3'}} AS m),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, NULL AS license, text FROM documents
  UNION ALL SELECT 'k', row_number() OVER (), NULL, license, text FROM known),
lines AS (SELECT kind, r, license, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT kind, r, license,
  string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM texts WHERE text IS NOT NULL)),
forms AS (SELECT kind, r, license, i, CASE WHEN regexp_matches(line, '^[^a-z0-9©]*(copyright|\(c\)|©)') THEN ''
  ELSE array_to_string([coalesce(m[w], w) FOR w IN regexp_extract_all(line, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F©]+')], ' ') END AS form
  FROM lines, spellings),
wholes AS (SELECT kind, r, license, md5(string_agg(form, ' ' ORDER BY i)) AS digest FROM forms WHERE form <> '' GROUP BY ALL),
listed AS (SELECT DISTINCT digest, license FROM wholes WHERE kind = 'k'),
notices AS (SELECT r, string_agg(DISTINCT listed.license, ',' ORDER BY listed.license) AS notices
  FROM forms JOIN listed ON digest = md5(form) WHERE kind = 'd' AND form <> '' GROUP BY r),
whole AS (SELECT r, string_agg(DISTINCT listed.license, ',' ORDER BY listed.license) AS license
  FROM wholes JOIN listed USING (digest) WHERE kind = 'd' GROUP BY r)
SELECT t.doc_id, w.digest, whole.license, notices.notices FROM texts t LEFT JOIN wholes w ON w.kind = 'd' AND w.r = t.r
  LEFT JOIN whole ON whole.r = t.r LEFT JOIN notices ON notices.r = t.r WHERE t.kind = 'd'
"""

OP6_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n
  FROM documents),
starts AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM docs, range(n - 49) AS t(i) WHERE doc_id IS NOT NULL AND n >= 50),
firsts AS (SELECT g, min(doc_id) AS first_id FROM starts GROUP BY g),
repeated AS (SELECT r, i FROM starts JOIN firsts USING (g) WHERE doc_id > first_id),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM repeated),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM marked)
  GROUP BY r, span),
pieces AS (SELECT r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS piece
  FROM spans JOIN docs USING (r)),
cut AS (SELECT r, string_agg(piece, '' ORDER BY a) AS kept, max(b) AS b, sum(b - a) AS removed, count(*) AS spans FROM pieces GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * b + 1), h))) AS kept_sha256 FROM docs LEFT JOIN cut USING (r)
"""

OP8_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
  row_number() OVER (ORDER BY source IS NULL, source) - 1 AS s FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][CAST(s % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
sorted AS (SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) - coalesce(sum(cap) OVER before, 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_weight FROM weighed
  WINDOW before AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT arg_min(rest / open_weight, cap / w) AS rate FROM sorted WHERE rest / open_weight * w <= cap),
targets AS (SELECT s, source, n, source_size, least(cap, w * rate) AS target FROM weighed, rate),
blocks AS (SELECT CAST(floor(sum(target) / 16 + 0.5) AS BIGINT) AS b, sum(target) AS t FROM targets),
source_seats AS (SELECT s, target / (2 * k + 1) AS q FROM targets, blocks, range(CAST(ceil(b * target / greatest(t, 1)) AS BIGINT) + 2) AS r(k) WHERE target > 0),
source_quota AS (SELECT s, count(*) AS quota FROM (SELECT s, row_number() OVER (ORDER BY q DESC, s) AS seat FROM source_seats), blocks
  WHERE seat <= b GROUP BY s),
placed AS (SELECT doc_id, size, s, source_size, target, coalesce(quota, 0) AS quota,
  CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), size, 7)), 1, 15) AS BIGINT) AS ord,
  CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), 8)), 1, 15) AS BIGINT) % CAST(ceil(n / 1024) AS BIGINT) AS shard
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source LEFT JOIN source_quota USING (s)),
shards AS (SELECT s, shard, CAST(sum(size) AS DOUBLE) AS v, any_value(quota) AS quota, sum(sum(size)) OVER (PARTITION BY s) AS total
  FROM placed GROUP BY s, shard),
shard_seats AS (SELECT s, shard, quota, v / (2 * k + 1) AS q FROM shards, range(CAST(ceil(quota * v / greatest(total, 1)) AS BIGINT) + 2) AS r(k) WHERE v > 0),
shard_quota AS (SELECT s, shard, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY q DESC, shard) AS seat
  FROM shard_seats) WHERE seat <= quota GROUP BY s, shard),
taken AS (SELECT p.*, coalesce(sum(size) OVER (PARTITION BY p.s, p.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  v, least(coalesce(seats, 0) * 16, v * 2) AS words
  FROM placed p JOIN shards USING (s, shard) LEFT JOIN shard_quota USING (s, shard))
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, words - pos)) + greatest(0, least(size, words - v - pos)) AS BIGINT) AS taken FROM taken
"""

#: CRC-32 of a short ASCII text, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split({text}, '')],
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP13_SQL = rf"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 20 AS base, {CRC_SQL.format(text="c::VARCHAR")} % 4 AS h FROM turns),
rebuilt AS (SELECT i.c, 0 AS own, r, role, text FROM ids i JOIN turns t ON t.c = i.base AND r <= h
  UNION ALL SELECT i.c, 1, r, role, text FROM ids i JOIN turns t ON t.c = i.c AND r > h),
prefixes AS (SELECT c, row_number() OVER place AS d, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
  string_agg(md5(role || chr(1) || text), '') OVER place AS k, count(*) OVER (PARTITION BY c) AS size
  FROM rebuilt WINDOW place AS (PARTITION BY c ORDER BY own, r ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM rebuilt b WHERE b.c = ids.c) FROM ids),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '') AS ends FROM prefixes GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
marked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.k = nodes.k),
under AS (SELECT left(k, 32 * i) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS i FROM marked) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, n_leaves, under.saved::BIGINT AS saved_tokens,
  sha256(m.ends) AS ends_sha256
FROM marked m JOIN under ON under.k = m.k LEFT JOIN nodes up ON m.d > 0 AND up.k = left(m.k, 32 * (m.d - 1))
"""

def _way(cost: str, letter: str, line: str, *froms: str) -> list[str]:
    """Ways on from states, as DuckDB structs of cost, audit and lines, which compare in this order."""
    more = f" || chr(10) || {line}" if line else ""
    return [f"{{'c': {q}.c + {cost}, 'a': {q}.a || '{letter}', 't': {q}.t{more}}}" for q in froms]


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


OP12_SQL = rf"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC_SQL.format(text="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS does FROM conversations),
damaged AS (SELECT conv_id, turn, CASE does WHEN 4 THEN 'user' ELSE role END AS role,
  CASE does WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE does WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE does <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS last_role FROM placed),
turns AS (SELECT conv_id, turn, r, role, text, left(role, 1) AS k, last_role || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM seen),
priced AS (SELECT *, CASE fault WHEN 'truncated' THEN 1 WHEN 'fine' THEN 0 ELSE 1000000 END AS p FROM turns),
ways AS (SELECT conv_id, 0::BIGINT AS r, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q0, {{'c': 1000000::BIGINT, 'a': '', 't': ''}} AS qs,
  {{'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS qu, {{'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS qa
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, r, n0, ns, nu, {_least("ma", *_way("2", "I", "'assistant:'", "nu"))} FROM (
    SELECT *, {_least("mu", *_way("2", "I", "'user:'", "n0", "ns", "ma"))} AS nu FROM (
      SELECT w.conv_id, t.r, {_way("3", "D", "", "q0")[0]} AS n0,
        {_least(*_way("3", "D", "", "qs"), *_way("p + if(k = 's', 0, 1000000)", "K", "role || ':' || text", "q0"))} AS ns,
        {_least(*_way("3", "D", "", "qu"), *_way("p + if(k = 'u', 0, 1000000)", "K", "role || ':' || text", "q0", "qs", "qa"), *_way("p + 2", "R", "'user:' || text", "q0", "qs", "qa"))} AS mu,
        {_least(*_way("3", "D", "", "qa"), *_way("p + if(k = 'a', 0, 1000000)", "K", "role || ':' || text", "qu"), *_way("p + 2", "R", "'assistant:' || text", "qu"))} AS ma
      FROM ways w JOIN priced t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.r = w.r + 1))),
ended AS (SELECT conv_id, r, {_least("q0", "qa")} AS q FROM ways),
counts AS (SELECT conv_id, max(r) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, q.c AS cost, q.a AS audit, sha256(substr(q.t, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.r = coalesce(n, 0)
"""

QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_lm_scores, op3_license_scan, op4_weighted_fingerprints, op5_benchmark_leaks, op6_suffix_dedup,
    op7_chat_repair, op8_source_mix, op9_toxicity, op10_url_filter,
    op11_personal_data, op12_turn_repair, op13_prefix_trie)}
ORACLE = {"op6_suffix_dedup": OP6_SQL, "op8_source_mix": OP8_SQL, "op3_license_scan": OP3_SQL, "op10_url_filter": OP10_SQL, "op12_turn_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL}
