"""Registered queries of the operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, chat_format, conversation_repair, exact_dedup, html_extract, language_id, license_scan, ngram_join,
               packing, secret_scan, token_align, topk_mtree, url_filter)
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return bpe.encode_decode(table(spark, sf_dir, "documents"), P.path(VOCABULARY), P.PATTERN)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op6_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("fp")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


# (verdict, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return token_align.alignment(table(spark, sf_dir, "documents"), P.path(SIDE_A), P.path(SIDE_B))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard, op3_byte_bpe, op4_chat_format, op5_best_fit,
                                   op6_topk_mtree, op7_license_scan, op8_secrets, op9_exact_dedup,
                                   op10_html_extract, op11_url_filter, op12_token_align, op13_conversation_repair)}

def secrets_sql() -> str:
    """Every rule by regexp over whole texts; a match starts after the pieces and the
    matches before it."""
    parts = []
    for k, (kind, pattern, group, least, fold) in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        p = (f"(?i:{pattern})" if fold else pattern).replace("\\x20", " ").replace("'", "''")
        parts.append(f"""
m{k} AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g,
                string_split_regex(t, '{p}') AS p FROM d),
i{k} AS (SELECT doc_id, i, length(m[i]) AS n, length(g[i]) AS gn, length(p[i]) AS pn
         FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k})),
s{k} AS (SELECT doc_id, {k} AS k, '{kind}' AS kind, n, gn, sum(pn) OVER w + sum(n) OVER w - n AS a
         FROM i{k} WINDOW w AS (PARTITION BY doc_id ORDER BY i))""")
    union = " UNION ALL ".join(f"SELECT * FROM s{k} WHERE gn >= {rule[3]}" for k, rule in
                               enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES))
    n_base = len(secret_scan.BASE_RULES)
    span = "kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{','.join(parts)},
u AS ({union})
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
       count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg({span}, ',' ORDER BY a, k) FILTER (k < {n_base}), '')) AS base_sha256,
       coalesce(string_agg({span}, ',' ORDER BY a, k) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id"""


def url_sql(rules: list[tuple[str, str, str]], default: str) -> str:
    """Every rule against every page; the longest that fits (of equal ones the longer
    host, then the allowing one)."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    return f"""
WITH r(verdict, rhost, rpath) AS (VALUES {values}),
p AS (SELECT page_id, row_number() OVER () AS k,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT k, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict) AS i
      FROM p JOIN r ON (rhost = '' OR host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, {quoted(default)}) AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE i = 1) USING (k)"""


def repair_sql() -> str:
    """The program over whole strings: a state is its cost (12 digits) and audit in one
    string, so that the least string is the best one, and the turns repaired so far."""
    def more(state, cost, letter, row=None):
        k = f"lpad(CAST(CAST(substr({state}.k, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}.k, 13) || '{letter}'"
        return f"struct_pack(k := {k}, r := {state}.r" + (f" || {row} || chr(10))" if row else ")")

    def least(*ways):
        return f"list_min([{', '.join(ways)}])"

    def kept(state, kind):
        return f"CASE WHEN NOT gone AND kind = '{kind}' THEN {more(state, 'pen', 'K', own)} ELSE none END"

    def rerole(state, role):
        way = more(state, "1 + pen", "R", f"'{role}:' || text")
        return f"CASE WHEN NOT gone THEN {way} ELSE none END"

    own, user, assistant = "role || ':' || text", "'user:'", "'assistant:'"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY n) AS tab FROM range(256) AS t(n)),
f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                              lambda x: CAST(ord(x) AS BIGINT))),
               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS c
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
         CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN c = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE c <> 0),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS cn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
w AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY cn, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) AS kind, lag(substr(role, 1, 1)) OVER (PARTITION BY cn ORDER BY i) AS kind0 FROM o),
z AS (SELECT struct_pack(k := '500000000000', r := '') AS none, struct_pack(k := lpad('0', 12, '0'), r := '') AS zero),
p AS (
  SELECT cn, CAST(0 AS BIGINT) AS i, zero AS s0, none AS s1, none AS s2, none AS s3 FROM (SELECT DISTINCT cn FROM w), z
  UNION ALL
  SELECT cn, i, {more('s0', 2, 'D')},
         {least(more('s1', 2, 'D'), kept('s0', 's'))},
         {least(more('t2', 2, 'D'), *[kept(s, 'u') for s in ('s0', 's1', 't3')], *[rerole(s, 'user') for s in ('s0', 's1', 't3')])},
         {least(more('t3', 2, 'D'), kept('t2', 'a'), rerole('t2', 'assistant'))}
  FROM (SELECT *, {least('s3', more('t2', 5, 'I', assistant))} AS t3
        FROM (SELECT p.*  EXCLUDE (i), w.i, w.role, w.text, w.kind, w.fault IN ('blank', 'duplicate') AS gone, z.none,
                     CASE WHEN w.fault = 'truncated' THEN 5 ELSE 0 END AS pen,
                     {least('s2', *[more(s, 5, 'I', user) for s in ('s0', 's1', 's3')])} AS t2
              FROM p JOIN w ON w.cn = p.cn AND w.i = p.i + 1, z))),
e AS (
  SELECT cn, {least('s0', 's3', more('s2', 5, 'I', assistant))} AS e
  FROM p WHERE i = (SELECT max(i) FROM w WHERE w.cn = p.cn)),
g AS (
  SELECT cn, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND kind0 || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY cn)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(e.k, 1, 12) AS BIGINT), 0) AS cost, coalesce(substr(e.k, 13), '') AS audit,
       sha256(coalesce(left(e.r, length(e.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (g JOIN e USING (cn)) x ON x.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL = {
    "op13_conversation_repair": repair_sql(),
    "op11_url_filter": url_sql(URL_RULES, url_filter.ALLOW),
    "op8_secrets": secrets_sql(),
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS grams FROM w),
u AS (SELECT doc_id, unnest(grams) AS gram FROM g),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN g ga ON ga.doc_id = a.doc_id JOIN g gb ON gb.doc_id = b.doc_id
  GROUP BY 1, 2, len(ga.grams), len(gb.grams)
  HAVING 10 * count(*) >= 8 * (len(ga.grams) + len(gb.grams) - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, (SELECT min(y) FROM reach r WHERE r.x = doc_id) AS class_id,
       (SELECT count(*) FROM links l WHERE l.x = doc_id) AS n_links FROM documents""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY place) AS turns,
         string_agg('<|im_start|>' || CASE WHEN trim(role) = '' THEN 'user' ELSE CASE lower(trim(role))
             WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'customer' THEN 'user'
             WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant'
             WHEN 'ai' THEN 'assistant' WHEN 'function' THEN 'tool' ELSE lower(trim(role)) END END
           || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
  FROM t GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, turns, any_value(n_turns) AS n_turns, any_value(chat) AS chat, count(*) AS copies
      FROM c GROUP BY turns)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, copies, chat, length(chat) AS n_chars FROM d
WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.n_turns > d.n_turns AND e.turns[1] = d.turns[1]
                  AND e.turns[1:d.n_turns] = d.turns)""",
    "op6_topk_mtree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT DISTINCT vec_id AS query_id, x FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT query_id, q.x, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM q JOIN v c ON query_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
}
