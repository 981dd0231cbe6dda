"""DuckDB SQL oracles, one per registered query (same output columns).

The SQL is written independently of the Spark code: dictionaries by
``dense_rank`` over distinct tokens, Gaussian draws from ``md5`` in SQL, and the
learner unrolled into chained CTEs (generated per block by small Python
helpers below, since the chain is long)."""

from __future__ import annotations

import math

from . import fixtures as X

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


def r6(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE), 6) + 0.0)"


def uniform(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT + 1) / 4294967297.0)"


def gauss(mean: float, stdev: float, *parts: str) -> str:
    key_a = "concat_ws(':', " + ", ".join(list(parts) + ["'a'"]) + ")"
    key_b = "concat_ws(':', " + ", ".join(list(parts) + ["'b'"]) + ")"
    return (f"({mean!r} + {stdev!r} * sqrt(-2.0 * ln({uniform(key_a)})) * "
            f"cos({2.0 * math.pi!r} * {uniform(key_b)}))")


def events_y(col: str = "value") -> str:
    return f"(({col} - {X.EVENTS_TARGET_CENTER!r}) / {X.EVENTS_TARGET_SCALE!r})"


# events vectorized: user_id (field 0), event_type (field 1), ts (field 2, Time)
EV_BASE = f"""
ev_tok AS (
  SELECT DISTINCT 0 AS field, CAST(user_id AS VARCHAR) AS token FROM events
  UNION SELECT DISTINCT 1, event_type FROM events),
ev_code AS (
  SELECT field, token, dense_rank() OVER (PARTITION BY field ORDER BY token) - 1 AS code FROM ev_tok),
ev_size AS (SELECT field, count(*) AS n FROM ev_code GROUP BY field),
ev_off AS (
  SELECT 0 AS field, 0 AS off, (SELECT n FROM ev_size WHERE field = 0) AS width
  UNION ALL SELECT 1, (SELECT n FROM ev_size WHERE field = 0), (SELECT n FROM ev_size WHERE field = 1)
  UNION ALL SELECT 2, (SELECT sum(n) FROM ev_size), 1),
ev_dict AS (
  SELECT c.field, c.token, c.code, c.code + o.off AS feature_id FROM ev_code c JOIN ev_off o USING (field)),
ev_rows AS (SELECT event_id AS row_id, {events_y()} AS y FROM events),
ev_id_entries AS (
  SELECT e.event_id AS row_id, d.feature_id, CAST(1.0 AS DOUBLE) AS value
    FROM events e JOIN ev_dict d ON d.field = 0 AND d.token = CAST(e.user_id AS VARCHAR)
  UNION ALL
  SELECT e.event_id, d.feature_id, 1.0
    FROM events e JOIN ev_dict d ON d.field = 1 AND d.token = e.event_type),
ev_time_entries AS (
  SELECT event_id AS row_id, (SELECT off FROM ev_off WHERE field = 2) AS feature_id,
         CAST((epoch_us(ts) // 1000000) // 86400 AS DOUBLE) AS value FROM events),
ev_entries AS (SELECT * FROM ev_id_entries UNION ALL SELECT * FROM ev_time_entries)
"""

# events model: user_id, event_type only (dimension = both widths)
EV_MODEL = EV_BASE + f""",
evm_dim AS (SELECT sum(n) AS dim FROM ev_size),
evm_params AS (
  SELECT r.range AS feature_id,
         {gauss(0.0, X.SCORE_W_STDEV, str(X.SCORE_CFG.seed), "'w'", "r.range")} AS w,
         {gauss(X.SCORE_CFG.init_mean, X.SCORE_CFG.init_stdev, str(X.SCORE_CFG.seed), "0", "r.range")} AS v0,
         {gauss(X.SCORE_CFG.init_mean, X.SCORE_CFG.init_stdev, str(X.SCORE_CFG.seed), "1", "r.range")} AS v1
    FROM (SELECT feature_id AS range FROM ev_dict WHERE field IN (0, 1)) r),
evm_sums AS (
  SELECT e.row_id, sum(p.w * e.value) AS lin,
         sum(p.v0 * e.value) AS s0, sum((p.v0 * e.value) * (p.v0 * e.value)) AS ss0,
         sum(p.v1 * e.value) AS s1, sum((p.v1 * e.value) * (p.v1 * e.value)) AS ss1
    FROM ev_id_entries e JOIN evm_params p USING (feature_id) GROUP BY e.row_id),
evm_scored AS (
  SELECT r.row_id, r.y,
         {X.SCORE_W0!r} + coalesce(s.lin, 0.0) AS linear,
         coalesce(0.5 * (s.s0 * s.s0 - s.ss0) + 0.5 * (s.s1 * s.s1 - s.ss1), 0.0) AS inter
    FROM ev_rows r LEFT JOIN evm_sums s USING (row_id)),
evm_pred AS (SELECT row_id, y, linear + inter AS prediction FROM evm_scored)
"""


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


oracle("build_dictionary", with_(EV_BASE, """
SELECT CAST(field AS BIGINT) AS field, token, CAST(code AS BIGINT) AS code FROM ev_dict"""))

oracle("field_layout", with_(EV_BASE, """
SELECT CAST(field AS BIGINT) AS field,
       CASE field WHEN 0 THEN 'user_id' WHEN 1 THEN 'event_type' ELSE 'ts' END AS column_name,
       CASE field WHEN 2 THEN 'time' ELSE 'identity' END AS kind,
       CAST(off AS BIGINT) AS feature_offset, CAST(width AS BIGINT) AS width FROM ev_off"""))

oracle("encode_identity", with_(EV_BASE, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(feature_id AS BIGINT) AS feature_id,
       {r6('value')} AS value FROM ev_id_entries"""))

oracle("encode_time", with_(EV_BASE, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(feature_id AS BIGINT) AS feature_id,
       {r6('value')} AS value FROM ev_time_entries"""))

oracle("assemble_vectors", with_(EV_BASE, f"""
SELECT CAST(r.row_id AS BIGINT) AS row_id, {r6('r.y')} AS y,
       string_agg(CAST(e.feature_id AS VARCHAR), ' ' ORDER BY e.feature_id) AS feature_ids,
       {r6('sum(e.value)')} AS value_sum
  FROM ev_rows r JOIN ev_entries e USING (row_id) GROUP BY r.row_id, r.y"""))

oracle("standard_vectorize", with_(EV_BASE, f"""
SELECT CAST(r.row_id AS BIGINT) AS row_id, {r6('r.y')} AS y,
       CAST(e.feature_id AS BIGINT) AS feature_id, {r6('e.value')} AS value
  FROM ev_rows r JOIN ev_entries e USING (row_id)"""))

oracle("init_params", with_(EV_MODEL, f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, CAST(0.0 AS DOUBLE) AS w,
       {r6('v0 * 1000')} AS v0_milli, {r6('v1 * 1000')} AS v1_milli FROM evm_params"""))

oracle("score_linear", with_(EV_MODEL, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, {r6('y')} AS y, {r6('linear')} AS prediction FROM evm_scored"""))

oracle("score_interactions", with_(EV_MODEL, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, {r6('inter * 1000')} AS interaction_milli FROM evm_scored"""))

oracle("predict", with_(EV_MODEL, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, {r6('y')} AS y, {r6('prediction')} AS prediction FROM evm_pred"""))

oracle("rmse", with_(EV_MODEL, f"""
SELECT {r6('sqrt(avg((y - prediction) * (y - prediction)))')} AS rmse FROM evm_pred"""))

oracle("mae", with_(EV_MODEL, f"""
SELECT {r6('avg(abs(y - prediction))')} AS mae FROM evm_pred"""))

oracle("mean_signed_error", with_(EV_MODEL, f"""
SELECT {r6('avg(y - prediction)')} AS mean_signed_error FROM evm_pred"""))

oracle("sign_accuracy", with_(EV_MODEL, f"""
SELECT {r6("avg(CASE WHEN (y >= 0 AND prediction >= 0) OR (y < 0 AND prediction < 0) THEN 1.0 ELSE 0.0 END)")}
       AS sign_accuracy FROM evm_pred"""))


# ---- delimited orders text -------------------------------------------------------
ORD_TXT = """
ord_txt AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice,
         CASE WHEN o_orderpriority = '5-LOW' THEN 6 WHEN o_orderstatus = 'P' THEN 4 ELSE 5 END AS n_fields
    FROM orders)
"""

oracle("read_delimited", with_(ORD_TXT, """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(n_fields AS BIGINT) AS n_fields FROM ord_txt"""))

oracle("filter_arity", with_(ORD_TXT, """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM ord_txt WHERE n_fields = 5"""))

oracle("split_target_inputs", with_(ORD_TXT, """
SELECT CAST(o_orderkey AS BIGINT) AS in0, CAST(o_custkey AS BIGINT) AS in1,
       o_orderpriority AS in2, o_orderstatus AS in3 FROM ord_txt WHERE n_fields = 5"""))

oracle("cast_target", with_(ORD_TXT, f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, {r6('o_totalprice')} AS y FROM ord_txt WHERE n_fields = 5"""))


# ---- libFM text from lineitem ------------------------------------------------------

def fmt(x: str) -> str:
    """Compact number text: integral -> digits, else at most 3 decimals."""
    return (f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE rtrim(rtrim(printf('%.3f', {x}), '0'), '.') END)")


LI_LIBFM = f"""
li AS (SELECT row_number() OVER () AS rid, * FROM lineitem),
li_rf AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
            FROM (SELECT DISTINCT l_returnflag AS token FROM lineitem)),
li_ls AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
            FROM (SELECT DISTINCT l_linestatus AS token FROM lineitem)),
li_nrf AS (SELECT count(*) AS n FROM li_rf),
li_ent AS (
  SELECT rid, 0 AS fid, l_discount AS v FROM li WHERE l_discount <> 0
  UNION ALL SELECT rid, 1, l_tax FROM li WHERE l_tax <> 0
  UNION ALL SELECT rid, 2 + rf.code, 1.0 FROM li JOIN li_rf rf ON rf.token = li.l_returnflag
  UNION ALL SELECT rid, 2 + (SELECT n FROM li_nrf) + ls.code, 1.0 FROM li JOIN li_ls ls ON ls.token = li.l_linestatus),
li_lines AS (
  SELECT li.rid, li.l_quantity AS y,
         {fmt('li.l_quantity')} || ' ' || string_agg(CAST(e.fid + 1 AS VARCHAR) || ':' || {fmt('e.v')}, ' ' ORDER BY e.fid) AS line,
         string_agg(CAST(e.fid + 1 AS VARCHAR), ' ' ORDER BY e.fid) AS ids_read,
         sum(e.v) AS vsum
    FROM li JOIN li_ent e USING (rid) GROUP BY li.rid, li.l_quantity)
"""

oracle("write_libfm", with_(LI_LIBFM, "SELECT line FROM li_lines"))
oracle("filter_comment_blank", with_(LI_LIBFM, "SELECT line FROM li_lines"))
oracle("read_libfm", with_(LI_LIBFM, f"""
SELECT {r6('y')} AS y, ids_read AS feature_ids, {r6('vsum')} AS value_sum FROM li_lines"""))
oracle("libfm_infer_dimension", with_(LI_LIBFM, """
SELECT CAST(max(fid) + 1 AS BIGINT) AS dimension FROM li_ent"""))

oracle("format_compact", f"""
WITH xs AS (
  SELECT DISTINCT x FROM (
    SELECT l_discount AS x FROM lineitem UNION ALL SELECT l_tax FROM lineitem
    UNION ALL SELECT l_quantity FROM lineitem UNION ALL SELECT l_extendedprice / 7 FROM lineitem
    UNION ALL SELECT l_discount - l_tax FROM lineitem))
SELECT {r6('x')} AS x, {fmt('x')} AS text FROM xs""")


# ---- list field: part.p_name ---------------------------------------------------------
PART_LIST = """
pt_tok AS (SELECT p_partkey, len(string_split(p_name, ' ')) AS m,
                  unnest(string_split(p_name, ' ')) AS token FROM part),
pt_dict AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
              FROM (SELECT DISTINCT token FROM pt_tok))
"""

oracle("split_list", """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_tokens,
       array_to_string(string_split(p_name, ' '), '|') AS tokens FROM part""")

oracle("list_weights", f"""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {r6("1.0 / len(string_split(p_name, ' '))")} AS weight FROM part""")

oracle("build_list_dictionary", with_(PART_LIST, """
SELECT token, CAST(code AS BIGINT) AS code FROM pt_dict"""))

oracle("encode_list", with_(PART_LIST, f"""
SELECT DISTINCT CAST(t.p_partkey AS BIGINT) AS p_partkey, CAST(d.code AS BIGINT) AS feature_id,
       {r6('1.0 / t.m')} AS value
  FROM pt_tok t JOIN pt_dict d USING (token)"""))


# ---- numbers and time: orders ----------------------------------------------------------
ORD_NUM = """
on_nstatus AS (SELECT count(DISTINCT o_orderstatus) AS n FROM orders)
"""

oracle("to_number", f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, {r6('o_totalprice')} AS x FROM orders""")

oracle("epoch_to_days", f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       {r6('(epoch_us(o_orderdate) // 1000000) // 86400')} AS days FROM orders""")

oracle("encode_number", with_(ORD_NUM, f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST((SELECT n FROM on_nstatus) AS BIGINT) AS feature_id,
       {r6(f'o_totalprice / {X.PRICE_SCALE!r}')} AS value FROM orders WHERE o_totalprice <> 0"""))

oracle("custom_transform", with_(ORD_NUM, f"""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST((SELECT n FROM on_nstatus) + 2 AS BIGINT) AS feature_id,
       {r6('ln(1 + CAST(o_custkey AS DOUBLE))')} AS value FROM orders WHERE o_custkey <> 0"""))


# ---- data-set operators: events ------------------------------------------------------------
oracle("is_empty", """
SELECT CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS events_empty,
       CAST(1 AS BIGINT) AS none_over_1e9_empty FROM events""")

oracle("dataset_size", "SELECT CAST(count(*) AS BIGINT) AS size FROM events")

oracle("dataset_dimension", with_(EV_BASE, """
SELECT CAST(max(feature_id) AS BIGINT) AS dimension FROM ev_entries"""))

oracle("transpose", with_(EV_BASE, f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, CAST(row_id AS BIGINT) AS row_id, {r6('value')} AS value
  FROM ev_id_entries"""))

oracle("project_inputs", with_(EV_BASE, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(feature_id AS BIGINT) AS feature_id, {r6('value')} AS value
  FROM ev_entries"""))

oracle("project_targets", with_(EV_BASE, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, {r6('y')} AS y FROM ev_rows"""))


# ---- split: orders ----------------------------------------------------------------------------
from ..operators.dataset import split_thresholds  # noqa: E402

_A3, _B3 = split_thresholds(*X.SPLIT3_WEIGHTS)
ORD_SPLIT = f"""
ord_u AS (SELECT o_orderkey, {uniform(f"concat_ws(':', {X.SPLIT_SEED}, o_orderkey)")} AS u FROM orders),
ord_split AS (SELECT o_orderkey, CASE WHEN u < {_A3!r} THEN 'train' WHEN u < {_B3!r} THEN 'test'
                                      ELSE 'validate' END AS split FROM ord_u)
"""

oracle("random_split", with_(ORD_SPLIT, """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, split FROM ord_split"""))

oracle("collection_dimension", """
SELECT CAST((SELECT count(DISTINCT o_custkey) FROM orders) + (SELECT count(DISTINCT o_orderpriority) FROM orders)
            + (SELECT count(DISTINCT o_orderstatus) FROM orders) - 1 AS BIGINT) AS dimension""")


# ---- side tables: orders -> customer (one segment dropped, so some orders miss) ------
REL = f"""
cu AS (SELECT * FROM customer WHERE c_mktsegment <> '{X.RELATION_DROP_SEGMENT}'),
cu_seg AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
             FROM (SELECT DISTINCT c_mktsegment AS token FROM cu)),
cu_nat AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
             FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS token FROM cu)),
cu_dims AS (SELECT (SELECT count(*) FROM cu_seg) AS nseg, (SELECT count(*) FROM cu_nat) AS nnat),
cu_ent AS (
  SELECT c_custkey AS key, s.code AS fid, 1.0 AS v FROM cu JOIN cu_seg s ON s.token = cu.c_mktsegment
  UNION ALL SELECT c_custkey, d.nseg + n.code, 1.0
    FROM cu JOIN cu_nat n ON n.token = CAST(cu.c_nationkey AS VARCHAR) CROSS JOIN cu_dims d
  UNION ALL SELECT c_custkey, d.nseg + d.nnat, c_acctbal / {X.ACCTBAL_SCALE!r}
    FROM cu CROSS JOIN cu_dims d WHERE c_acctbal <> 0),
o_ck AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
           FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS token FROM orders)),
o_pr AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority AS token FROM orders)),
o_st AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
           FROM (SELECT DISTINCT o_orderstatus AS token FROM orders)),
o_dims AS (SELECT (SELECT count(*) FROM o_ck) AS nck, (SELECT nseg + nnat + 1 FROM cu_dims) AS nrel,
                  (SELECT count(*) FROM o_pr) AS npr),
rel_match AS (
  SELECT o.o_orderkey AS row_id, d.nck + e.fid AS fid, e.v
    FROM orders o JOIN cu_ent e ON e.key = o.o_custkey CROSS JOIN o_dims d),
rel_miss AS (
  SELECT o.o_orderkey AS row_id, k.code AS fid, 1.0 AS v
    FROM orders o JOIN o_ck k ON k.token = CAST(o.o_custkey AS VARCHAR)
   WHERE o.o_custkey NOT IN (SELECT c_custkey FROM cu)),
rel_key_all AS (
  SELECT o.o_orderkey AS row_id, k.code AS fid, 1.0 AS v
    FROM orders o JOIN o_ck k ON k.token = CAST(o.o_custkey AS VARCHAR)),
rel_rest AS (
  SELECT o.o_orderkey AS row_id, d.nck + d.nrel + p.code AS fid, 1.0 AS v
    FROM orders o JOIN o_pr p ON p.token = o.o_orderpriority CROSS JOIN o_dims d
  UNION ALL
  SELECT o.o_orderkey, d.nck + d.nrel + d.npr + s.code, 1.0
    FROM orders o JOIN o_st s ON s.token = o.o_orderstatus CROSS JOIN o_dims d),
rel_y AS (SELECT o_orderkey AS row_id, o_totalprice / {X.PRICE_SCALE!r} AS y FROM orders)
"""

REL_ALL = REL.replace(f" WHERE c_mktsegment <> '{X.RELATION_DROP_SEGMENT}'", "")

oracle("encode_relation", with_(REL_ALL, f"""
SELECT CAST(key AS BIGINT) AS c_custkey, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM cu_ent"""))

oracle("relation_join", with_(REL, f"""
SELECT CAST(row_id AS BIGINT) AS o_orderkey, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM rel_match"""))

oracle("relation_fallback", with_(REL, f"""
SELECT CAST(row_id AS BIGINT) AS o_orderkey, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM rel_miss"""))

oracle("relation_layout", with_(REL_ALL, """
SELECT CAST(b AS BIGINT) AS block, name, CAST(off AS BIGINT) AS feature_offset, CAST(w AS BIGINT) AS width FROM (
  SELECT 0 AS b, 'o_custkey' AS name, 0 AS off, nck AS w FROM o_dims
  UNION ALL SELECT 1, 'c_mktsegment', nck, (SELECT nseg FROM cu_dims) FROM o_dims
  UNION ALL SELECT 2, 'c_nationkey', nck + (SELECT nseg FROM cu_dims), (SELECT nnat FROM cu_dims) FROM o_dims
  UNION ALL SELECT 3, 'c_acctbal', nck + nrel - 1, 1 FROM o_dims
  UNION ALL SELECT 4, 'o_orderpriority', nck + nrel, npr FROM o_dims
  UNION ALL SELECT 5, 'o_orderstatus', nck + nrel + npr, (SELECT count(*) FROM o_st) FROM o_dims)"""))

oracle("relation_vectorize", with_(REL, f"""
SELECT CAST(e.row_id AS BIGINT) AS o_orderkey, {r6('y.y')} AS y, CAST(e.fid AS BIGINT) AS feature_id,
       {r6('e.v')} AS value
  FROM (SELECT * FROM rel_match UNION ALL SELECT * FROM rel_miss UNION ALL SELECT * FROM rel_rest) e
  JOIN rel_y y USING (row_id)"""))

oracle("relation_keep_key", with_(REL, f"""
SELECT CAST(e.row_id AS BIGINT) AS o_orderkey, {r6('y.y')} AS y, CAST(e.fid AS BIGINT) AS feature_id,
       {r6('e.v')} AS value
  FROM (SELECT * FROM rel_match UNION ALL SELECT * FROM rel_key_all UNION ALL SELECT * FROM rel_rest) e
  JOIN rel_y y USING (row_id)"""))


# ---- learner: events (user_id, event_type), unrolled into CTEs --------------------------
# Two one-hot fields: every row holds exactly one id of each, x = 1.

def _upd(theta: str, hh: str, eh: str, reg: float) -> str:
    t = f"(-({eh} - {theta} * {hh}) / ({reg!r} + {hh}))"
    return (f"(CASE WHEN {reg!r} + {hh} = 0 THEN {theta} "
            f"WHEN isfinite({t}) THEN {t} ELSE {theta} END)")


def als_ctes(iterations: int) -> tuple[str, dict]:
    """CTE text for ``iterations`` passes; returns it and the names of the
    intermediate tables of the first pass."""
    cfg = X.LEARN_CFG
    k, G = cfg.k, 2
    parts = [EV_BASE.strip(), f"""
lr AS (SELECT e.event_id AS row_id, {events_y('e.value')} AS y,
              du.feature_id AS id0, CAST(1.0 AS DOUBLE) AS x0, dt.feature_id AS id1, CAST(1.0 AS DOUBLE) AS x1
         FROM events e JOIN ev_dict du ON du.field = 0 AND du.token = CAST(e.user_id AS VARCHAR)
                       JOIN ev_dict dt ON dt.field = 1 AND dt.token = e.event_type),
p_1 AS (SELECT feature_id, CAST(0.0 AS DOUBLE) AS w,
               {', '.join(gauss(cfg.init_mean, cfg.init_stdev, str(cfg.seed), str(f), 'feature_id') + f' AS v{f}' for f in range(k))}
          FROM ev_dict WHERE field IN (0, 1)),
w0_1 AS (SELECT CAST(0.0 AS DOUBLE) AS w0)"""]
    names = {}
    scols = "row_id, y, " + ", ".join(f"id{g}, x{g}" for g in range(G))
    for t in range(1, iterations + 1):
        P, W0 = f"p_{t}", f"w0_{t}"
        joins = " ".join(f"JOIN {P} a{g} ON a{g}.feature_id = lr.id{g}" for g in range(G))
        lin = " + ".join(f"a{g}.w * lr.x{g}" for g in range(G))
        inter = " + ".join(
            "0.5 * ((" + " + ".join(f"a{g}.v{f} * lr.x{g}" for g in range(G)) + ") * (" +
            " + ".join(f"a{g}.v{f} * lr.x{g}" for g in range(G)) + ") - (" +
            " + ".join(f"(a{g}.v{f} * lr.x{g}) * (a{g}.v{f} * lr.x{g})" for g in range(G)) + "))"
            for f in range(k))
        qs = ", ".join("(" + " + ".join(f"a{g}.v{f} * lr.x{g}" for g in range(G)) + f") AS q{f}"
                       for f in range(k))
        S = f"s{t}_0"
        parts.append(f"""{S} AS (SELECT lr.row_id, lr.y, {', '.join(f'lr.id{g}, lr.x{g}' for g in range(G))},
      ((SELECT w0 FROM {W0}) + {lin} + {inter}) - lr.y AS e, {qs}
    FROM lr {joins})""")
        parts.append(f"rmse_{t} AS (SELECT sqrt(avg(e * e)) AS rmse FROM {S})")
        parts.append(f"""w0n_{t} AS (SELECT {_upd('o.w0', 'CAST(count(*) AS DOUBLE)', 'sum(s.e)', cfg.reg0)} AS w0
    FROM {S} s CROSS JOIN {W0} o GROUP BY o.w0)""")
        S2 = f"s{t}_b"
        qcols = ", ".join(f"q{f}" for f in range(k))
        parts.append(f"""{S2} AS (SELECT {scols}, e + ((SELECT w0 FROM w0n_{t}) - (SELECT w0 FROM {W0})) AS e, {qcols}
    FROM {S})""")
        if t == 1:
            names.update(state0=S, w0n=f"w0n_{t}", rmse=f"rmse_{t}", stateb=S2)
        cur = S2
        new_tables = {"w": []} | {f"v{f}": [] for f in range(k)}
        # linear sweep
        for g in range(G):
            st, nw, nxt = f"st{t}_w{g}", f"nw{t}_w{g}", f"s{t}_w{g}"
            parts.append(f"""{st} AS (SELECT id{g} AS feature_id, sum(x{g} * x{g}) AS hh, sum(e * x{g}) AS eh
    FROM {cur} GROUP BY id{g})""")
            parts.append(f"""{nw} AS (SELECT st.feature_id, p.w AS theta, st.hh, st.eh,
      {_upd('p.w', 'st.hh', 'st.eh', cfg.regw)} AS new FROM {st} st JOIN {P} p USING (feature_id))""")
            parts.append(f"""{nxt} AS (SELECT {', '.join('s.' + c.strip() for c in scols.split(','))},
      s.e + coalesce(s.x{g} * (n.new - n.theta), 0.0) AS e, {', '.join(f's.q{f}' for f in range(k))}
    FROM {cur} s LEFT JOIN {nw} n ON n.feature_id = s.id{g})""")
            if t == 1:
                names.setdefault("w_steps", []).append((nw, nxt))
            new_tables["w"].append(nw)
            cur = nxt
        if t == 1:
            names["after_w"] = cur
        # factor sweeps
        for f in range(k):
            for g in range(G):
                hh_src = f"hs{t}_v{f}_{g}"
                st, nv, nxt = f"st{t}_v{f}_{g}", f"nv{t}_v{f}_{g}", f"s{t}_v{f}_{g}"
                parts.append(f"""{hh_src} AS (SELECT s.*, p.v{f} AS theta,
      s.x{g} * s.q{f} - s.x{g} * s.x{g} * p.v{f} AS h FROM {cur} s JOIN {P} p ON p.feature_id = s.id{g})""")
                parts.append(f"""{st} AS (SELECT id{g} AS feature_id, sum(h * h) AS hh, sum(e * h) AS eh
    FROM {hh_src} GROUP BY id{g})""")
                parts.append(f"""{nv} AS (SELECT st.feature_id, p.v{f} AS theta, st.hh, st.eh,
      {_upd(f'p.v{f}', 'st.hh', 'st.eh', cfg.regv)} AS new FROM {st} st JOIN {P} p USING (feature_id))""")
                qsel = ", ".join(
                    (f"s.q{ff} + coalesce(s.x{g} * (n.new - n.theta), 0.0) AS q{ff}" if ff == f else f"s.q{ff}")
                    for ff in range(k))
                parts.append(f"""{nxt} AS (SELECT {', '.join('s.' + c.strip() for c in scols.split(','))},
      s.e + coalesce((s.x{g} * s.q{f} - s.x{g} * s.x{g} * n.theta) * (n.new - n.theta), 0.0) AS e, {qsel}
    FROM {cur} s LEFT JOIN {nv} n ON n.feature_id = s.id{g})""")
                new_tables[f"v{f}"].append(nv)
                if t == 1:
                    names.setdefault("v_steps", []).append((f, g, nv, nxt))
                cur = nxt
            if t == 1 and f == 0:
                names["after_v0"] = new_tables["v0"]
        sel, jn = ["p.feature_id"], []
        for slot, tabs in new_tables.items():
            u = " UNION ALL ".join(f"SELECT feature_id, new FROM {x}" for x in tabs)
            jn.append(f"LEFT JOIN ({u}) u_{slot} ON u_{slot}.feature_id = p.feature_id")
            sel.append(f"coalesce(u_{slot}.new, p.{slot}) AS {slot}")
        parts.append(f"p_{t + 1} AS (SELECT {', '.join(sel)} FROM {P} p {' '.join(jn)})")
        parts.append(f"w0_{t + 1} AS (SELECT w0 FROM w0n_{t})")
        if t == 1:
            names["p_after_w"] = f"pw_{t}"
            u = " UNION ALL ".join(f"SELECT feature_id, new FROM {x}" for x in new_tables["w"])
            parts.append(f"pw_{t} AS (SELECT p.feature_id, coalesce(u.new, p.w) AS w FROM {P} p "
                         f"LEFT JOIN ({u}) u ON u.feature_id = p.feature_id)")
            u = " UNION ALL ".join(f"SELECT feature_id, new FROM {x}" for x in new_tables["v0"])
            parts.append(f"pv0_{t} AS (SELECT p.feature_id, coalesce(u.new, p.v0) AS v0 FROM {P} p "
                         f"LEFT JOIN ({u}) u ON u.feature_id = p.feature_id)")
    return ",\n".join(parts), names


_C1, _N = als_ctes(1)
_C2, _ = als_ctes(2)

oracle("residuals", with_(_C1, f"SELECT CAST(row_id AS BIGINT) AS row_id, {r6('e')} AS e FROM {_N['state0']}"))
oracle("factor_sums", with_(_C1, f"""
SELECT CAST(row_id AS BIGINT) AS row_id, {r6('q0')} AS q0, {r6('q1')} AS q1 FROM {_N['state0']}"""))
oracle("global_bias_step", with_(_C1, f"SELECT {r6('w0')} AS w0 FROM {_N['w0n']}"))


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


oracle("theta_stats", with_(_C1, _union(f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('hh')} AS sum_hh, {r6('eh')} AS sum_eh FROM {nw}""" for nw, _ in _N["w_steps"])))
oracle("theta_update", with_(_C1, _union(f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('new')} AS w FROM {nw}""" for nw, _ in _N["w_steps"])))
oracle("error_update", with_(_C1, _union(f"""
SELECT CAST({g} AS BIGINT) AS block, CAST(row_id AS BIGINT) AS row_id, {r6('e')} AS e FROM {after}"""
                                         for g, (_, after) in enumerate(_N["w_steps"]))))
oracle("theta_stats_v", with_(_C1, _union(f"""
SELECT CAST({f} AS BIGINT) AS factor, CAST(feature_id AS BIGINT) AS feature_id, {r6('hh')} AS sum_hh, {r6('eh')} AS sum_eh
  FROM {nv}""" for f, _, nv, _ in _N["v_steps"])))
oracle("theta_update_v", with_(_C1, _union(f"""
SELECT CAST({f} AS BIGINT) AS factor, CAST(feature_id AS BIGINT) AS feature_id, {r6('new')} AS v FROM {nv}"""
                                           for f, _, nv, _ in _N["v_steps"])))
oracle("error_update_v", with_(_C1, _union(f"""
SELECT CAST({f} AS BIGINT) AS factor, CAST({g} AS BIGINT) AS block, CAST(row_id AS BIGINT) AS row_id, {r6('e')} AS e,
       {r6(f'q{f}')} AS q FROM {after}""" for f, g, _, after in _N["v_steps"])))

# all features of the linear terms at once: d = new - theta (0 before), step of least squares
oracle("damped_step", with_(_C1 + f""",
dm_st AS (SELECT id AS feature_id, sum(x * x) AS hh, sum(e * x) AS eh FROM (
            SELECT id0 AS id, x0 AS x, e FROM {_N['stateb']} UNION ALL SELECT id1, x1, e FROM {_N['stateb']}) GROUP BY id),
dm_d AS (SELECT st.feature_id, p.w AS theta, {_upd('p.w', 'st.hh', 'st.eh', X.LEARN_CFG.regw)} - p.w AS d
           FROM dm_st st JOIN p_1 p USING (feature_id)),
dm_a AS (SELECT s.e, s.x0 * a.d + s.x1 * b.d AS a FROM {_N['stateb']} s JOIN dm_d a ON a.feature_id = s.id0
           JOIN dm_d b ON b.feature_id = s.id1),
dm_t AS (SELECT greatest(0.0, -(sum(e * a) + {X.LEARN_CFG.regw!r} * (SELECT sum(theta * d) FROM dm_d))
                / (sum(a * a) + {X.LEARN_CFG.regw!r} * (SELECT sum(d * d) FROM dm_d))) AS t FROM dm_a)""", f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('theta + t * d')} AS w, {r6('t')} AS step
  FROM dm_d CROSS JOIN dm_t WHERE d <> 0"""))
oracle("linear_sweep", with_(_C1, f"SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('w')} AS w FROM pw_1"))
oracle("factor_sweep", with_(_C1, f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('v0')} AS v0, {r6('v1')} AS v1 FROM p_2"""))
oracle("als_iteration", with_(_C1, f"""
SELECT CAST(p.feature_id AS BIGINT) AS feature_id, {r6('p.w')} AS w, {r6('p.v0')} AS v0, {r6('p.v1')} AS v1,
       {r6('o.w0')} AS w0 FROM p_2 p CROSS JOIN w0_2 o"""))
oracle("fit", with_(_C2, f"""
SELECT CAST(p.feature_id AS BIGINT) AS feature_id, {r6('p.w')} AS w, {r6('p.v0')} AS v0, {r6('p.v1')} AS v1,
       {r6('o.w0')} AS w0 FROM p_3 p CROSS JOIN w0_3 o"""))
oracle("training_trace", with_(_C2, f"""
SELECT CAST(1 AS BIGINT) AS iteration, {r6('rmse')} AS rmse FROM rmse_1
UNION ALL SELECT CAST(2 AS BIGINT), {r6('rmse')} FROM rmse_2"""))


# ---- relation-level learning: orders -> customer; must equal the flat sweep --------------
# Slots of a flat row (at most one id each): 0 key one-hot (misses), 1 segment,
# 2 nation, 3 account balance, 4 priority, 5 status.
REL_SLOTS = """,
rl AS (
  SELECT o.o_orderkey AS row_id, o.o_totalprice / """ + repr(X.PRICE_SCALE) + """ AS y,
         CASE WHEN cu.c_custkey IS NULL THEN k.code END AS id0, CAST(1.0 AS DOUBLE) AS x0,
         CASE WHEN cu.c_custkey IS NOT NULL THEN d.nck + s.code END AS id1, CAST(1.0 AS DOUBLE) AS x1,
         CASE WHEN cu.c_custkey IS NOT NULL THEN d.nck + cd.nseg + n.code END AS id2, CAST(1.0 AS DOUBLE) AS x2,
         CASE WHEN cu.c_custkey IS NOT NULL AND cu.c_acctbal <> 0 THEN d.nck + cd.nseg + cd.nnat END AS id3,
         cu.c_acctbal / """ + repr(X.ACCTBAL_SCALE) + """ AS x3,
         d.nck + d.nrel + p.code AS id4, CAST(1.0 AS DOUBLE) AS x4,
         d.nck + d.nrel + d.npr + st.code AS id5, CAST(1.0 AS DOUBLE) AS x5
    FROM orders o CROSS JOIN o_dims d CROSS JOIN cu_dims cd
    JOIN o_ck k ON k.token = CAST(o.o_custkey AS VARCHAR)
    LEFT JOIN cu ON cu.c_custkey = o.o_custkey
    LEFT JOIN cu_seg s ON s.token = cu.c_mktsegment
    LEFT JOIN cu_nat n ON n.token = CAST(cu.c_nationkey AS VARCHAR)
    JOIN o_pr p ON p.token = o.o_orderpriority
    JOIN o_st st ON st.token = o.o_orderstatus),
rl_ids AS (
  SELECT code AS feature_id FROM o_ck
  UNION ALL SELECT d.nck + s.code FROM cu_seg s CROSS JOIN o_dims d
  UNION ALL SELECT d.nck + cd.nseg + n.code FROM cu_nat n CROSS JOIN o_dims d CROSS JOIN cu_dims cd
  UNION ALL SELECT d.nck + cd.nseg + cd.nnat FROM o_dims d CROSS JOIN cu_dims cd
  UNION ALL SELECT d.nck + d.nrel + p.code FROM o_pr p CROSS JOIN o_dims d
  UNION ALL SELECT d.nck + d.nrel + d.npr + st.code FROM o_st st CROSS JOIN o_dims d)
"""
REL_ROWS, REL_ALL_ROWS = REL + REL_SLOTS, REL_ALL + REL_SLOTS


def flat_sweep_ctes(base: str, G: int, stop: str, passes: int = 1, group_reg: dict | None = None) -> str:
    """One flat pass (w0, w, v0 ...) over ``rl`` rows whose slots may be
    NULL; stops after family ``stop`` (``w`` or ``v0``).  Further ``passes`` have
    names that end with their number."""
    cfg = X.LEARN_CFG
    k = cfg.k
    parts = [base.strip(), f"""
fp_1 AS (SELECT feature_id, CAST(0.0 AS DOUBLE) AS w,
        {', '.join(gauss(cfg.init_mean, cfg.init_stdev, str(cfg.seed), str(f), 'feature_id') + f' AS v{f}' for f in range(k))}
      FROM rl_ids)"""]
    for t in range(1, passes + 1):
        parts += flat_pass(G, stop, t, group_reg or {})
    return ",\n".join(parts)


def flat_pass(G: int, stop: str, t: int, group_reg: dict) -> list[str]:
    """``group_reg``: strengths (of w, of v) by slot."""
    cfg = X.LEARN_CFG
    k, parts = cfg.k, []
    end, old = "" if t == 1 else f"_{t}", "" if t <= 2 else f"_{t - 1}"
    P, w0 = "fp_1" if t == 1 else f"fp_all{end}", "0.0" if t == 1 else f"(SELECT w0 FROM fw0{old})"
    if t > 1:
        parts.append(f"{P} AS (SELECT * FROM fp_w{old} " + " ".join(f"JOIN fp_v{f}{old} USING (feature_id)" for f in range(k)) + ")")
    joins = " ".join(f"LEFT JOIN {P} a{g} ON a{g}.feature_id = rl.id{g}" for g in range(G))

    def c(expr):
        return f"coalesce({expr}, 0.0)"
    lin = " + ".join(c(f"a{g}.w * rl.x{g}") for g in range(G))
    qf = {f: " + ".join(c(f"a{g}.v{f} * rl.x{g}") for g in range(G)) for f in range(k)}
    ssf = {f: " + ".join(c(f"(a{g}.v{f} * rl.x{g}) * (a{g}.v{f} * rl.x{g})") for g in range(G)) for f in range(k)}
    inter = " + ".join(f"0.5 * (({qf[f]}) * ({qf[f]}) - ({ssf[f]}))" for f in range(k))
    slots = ", ".join(f"rl.id{g}, rl.x{g}" for g in range(G))
    parts.append(f"""fs_0{end} AS (SELECT rl.row_id, rl.y, {slots}, ({w0} + {lin} + {inter}) - rl.y AS e,
      {', '.join(f'({qf[f]}) AS q{f}' for f in range(k))} FROM rl {joins})""")
    parts.append(f"""fw0{end} AS (SELECT {_upd(w0, 'CAST(count(*) AS DOUBLE)', 'sum(e)', cfg.reg0)} AS w0 FROM fs_0{end})""")
    scols = "row_id, y, " + ", ".join(f"id{g}, x{g}" for g in range(G))
    qcols = ", ".join(f"q{f}" for f in range(k))
    parts.append(f"fs_b{end} AS (SELECT {scols}, e + ((SELECT w0 FROM fw0{end}) - {w0}) AS e, {qcols} FROM fs_0{end})")
    cur = f"fs_b{end}"
    fams = ["w"] + [f"v{f}" for f in range(k)]
    fams = fams[:fams.index(stop) + 1]
    for fam in fams:
        news = []
        for g in range(G):
            tag = f"{fam}_{g}{end}"
            if fam == "w":
                parts.append(f"""fst_{tag} AS (SELECT id{g} AS feature_id, sum(x{g} * x{g}) AS hh, sum(e * x{g}) AS eh
    FROM {cur} WHERE id{g} IS NOT NULL GROUP BY id{g})""")
                parts.append(f"""fnw_{tag} AS (SELECT st.feature_id, p.w AS theta,
      {_upd('p.w', 'st.hh', 'st.eh', group_reg.get(g, (cfg.regw,))[0])} AS new FROM fst_{tag} st JOIN {P} p USING (feature_id))""")
                parts.append(f"""fs_{tag} AS (SELECT {', '.join('s.' + cc.strip() for cc in scols.split(','))},
      s.e + coalesce(s.x{g} * (n.new - n.theta), 0.0) AS e, {', '.join(f's.q{f}' for f in range(k))}
    FROM {cur} s LEFT JOIN fnw_{tag} n ON n.feature_id = s.id{g})""")
            else:
                f = int(fam[1:])
                parts.append(f"""fh_{tag} AS (SELECT s.*, s.x{g} * s.q{f} - s.x{g} * s.x{g} * p.v{f} AS h
    FROM {cur} s JOIN {P} p ON p.feature_id = s.id{g})""")
                parts.append(f"""fst_{tag} AS (SELECT id{g} AS feature_id, sum(h * h) AS hh, sum(e * h) AS eh
    FROM fh_{tag} GROUP BY id{g})""")
                parts.append(f"""fnw_{tag} AS (SELECT st.feature_id, p.v{f} AS theta,
      {_upd(f'p.v{f}', 'st.hh', 'st.eh', group_reg.get(g, (0.0, cfg.regv))[1])} AS new FROM fst_{tag} st JOIN {P} p USING (feature_id))""")
                qsel = ", ".join((f"s.q{ff} + coalesce(s.x{g} * (n.new - n.theta), 0.0) AS q{ff}" if ff == f
                                  else f"s.q{ff}") for ff in range(k))
                parts.append(f"""fs_{tag} AS (SELECT {', '.join('s.' + cc.strip() for cc in scols.split(','))},
      s.e + coalesce((s.x{g} * s.q{f} - s.x{g} * s.x{g} * n.theta) * (n.new - n.theta), 0.0) AS e, {qsel}
    FROM {cur} s LEFT JOIN fnw_{tag} n ON n.feature_id = s.id{g})""")
            news.append(f"fnw_{tag}")
            cur = f"fs_{tag}"
        u = " UNION ALL ".join(f"SELECT feature_id, new FROM {x}" for x in news)
        parts.append(f"fp_{fam}{end} AS (SELECT p.feature_id, coalesce(u.new, p.{fam}) AS {fam} FROM {P} p "
                     f"LEFT JOIN ({u}) u ON u.feature_id = p.feature_id)")
    return parts


oracle("relation_block", with_(REL_ALL, f"""
SELECT CAST(e.key AS BIGINT) AS c_custkey, CAST(d.nck + e.fid AS BIGINT) AS feature_id, {r6('e.v')} AS value
  FROM cu_ent e CROSS JOIN o_dims d"""))

oracle("relational_dimension", with_(REL_ALL, """
SELECT CAST(nck + nrel + npr + (SELECT count(*) FROM o_st) AS BIGINT) AS dimension FROM o_dims"""))

oracle("relational_dataset", with_(REL, f"""
SELECT CAST(e.row_id AS BIGINT) AS o_orderkey,
       CAST(CASE WHEN o.o_custkey IN (SELECT c_custkey FROM cu) THEN o.o_custkey END AS BIGINT) AS c_custkey,
       CAST(e.fid AS BIGINT) AS feature_id, {r6('e.v')} AS value
  FROM (SELECT * FROM rel_miss UNION ALL SELECT * FROM rel_rest) e JOIN orders o ON o.o_orderkey = e.row_id"""))

oracle("attribute_groups", with_(REL_ALL, """
SELECT CAST(g AS BIGINT) AS group_id, CAST(n AS BIGINT) AS n_features FROM (
  SELECT 0 AS g, nck AS n FROM o_dims UNION ALL SELECT 1, nseg FROM cu_dims UNION ALL SELECT 2, nnat FROM cu_dims
  UNION ALL SELECT 3, 1 UNION ALL SELECT 4, npr FROM o_dims UNION ALL SELECT 5, (SELECT count(*) FROM o_st))"""))

_RC = flat_sweep_ctes(REL_ALL_ROWS, 6, "w")
oracle("relation_cache", with_(_RC + ",\n" + """
rc_qb AS (SELECT e.key, sum(p.v0 * e.v) AS qb FROM cu_ent e JOIN fp_1 p ON p.feature_id = (SELECT nck FROM o_dims) + e.fid
          GROUP BY e.key),
rc AS (SELECT o.o_custkey AS key, s.e, s.q0 - q.qb AS c
         FROM fs_0 s JOIN orders o ON o.o_orderkey = s.row_id JOIN rc_qb q ON q.key = o.o_custkey)""", f"""
SELECT CAST(key AS BIGINT) AS c_custkey, CAST(count(*) AS BIGINT) AS n, {r6('sum(e)')} AS e_sum,
       {r6('sum(c)')} AS c_sum, {r6('sum(c * c)')} AS c2_sum, {r6('sum(e * c)')} AS ec_sum
  FROM rc GROUP BY key"""))

oracle("relation_linear_sweep", with_(flat_sweep_ctes(REL_ALL_ROWS, 6, "w"), f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('w')} AS w FROM fp_w"""))

oracle("relation_factor_sweep", with_(flat_sweep_ctes(REL_ALL_ROWS, 6, "v1"), f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('v0')} AS v0, {r6('v1')} AS v1
  FROM fp_v0 JOIN fp_v1 USING (feature_id)"""))

ONE_PASS = f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('w')} AS w, {r6('v0')} AS v0, {r6('v1')} AS v1,
       {r6('(SELECT w0 FROM fw0)')} AS w0
  FROM fp_w JOIN fp_v0 USING (feature_id) JOIN fp_v1 USING (feature_id)"""

oracle("relational_iteration", with_(flat_sweep_ctes(REL_ROWS, 6, "v1"), ONE_PASS))


# ---- list field and libFM rows: one pass, feature by feature ----------------------------
# part: one slot for each token of the list (ids ascending), then brand, type, size.
PART_TOKENS = 16
_PT = range(PART_TOKENS)
PART_ROWS = PART_LIST + f""",
pt_n AS (SELECT count(*) AS ntok FROM pt_dict),
pt_b AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT p_brand AS token FROM part)),
pt_t AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT p_type AS token FROM part)),
pt_dims AS (SELECT ntok, (SELECT count(*) FROM pt_b) AS nb, (SELECT count(*) FROM pt_t) AS nt FROM pt_n),
pt_w AS (SELECT DISTINCT t.p_partkey, d.code, 1.0 / t.m AS v FROM pt_tok t JOIN pt_dict d USING (token)),
pt_wide AS (SELECT p_partkey, {', '.join(f"max(CASE WHEN code = {g} THEN v END) AS x{g}" for g in _PT)}
              FROM pt_w GROUP BY p_partkey),
rl AS (SELECT p.p_partkey AS row_id, p.p_retailprice / {X.PART_PRICE_SCALE!r} AS y,
              {', '.join(f"CASE WHEN w.x{g} IS NOT NULL THEN {g} END AS id{g}, w.x{g}" for g in _PT)},
              d.ntok + b.code AS id{PART_TOKENS}, CAST(1.0 AS DOUBLE) AS x{PART_TOKENS},
              d.ntok + d.nb + t.code AS id{PART_TOKENS + 1}, CAST(1.0 AS DOUBLE) AS x{PART_TOKENS + 1},
              CASE WHEN p.p_size <> 0 THEN d.ntok + d.nb + d.nt END AS id{PART_TOKENS + 2},
              p.p_size / {X.PART_SIZE_SCALE!r} AS x{PART_TOKENS + 2}
         FROM part p CROSS JOIN pt_dims d LEFT JOIN pt_wide w USING (p_partkey)
         JOIN pt_b b ON b.token = p.p_brand JOIN pt_t t ON t.token = p.p_type),
rl_ids AS (SELECT unnest(range(ntok + nb + nt + 1)) AS feature_id FROM pt_dims)
"""


def materialized(ctes: str) -> str:
    """The chain is long and each link is read twice: compute each once."""
    return ctes.replace(" AS (SELECT", " AS MATERIALIZED (SELECT").replace(" AS (\n", " AS MATERIALIZED (\n")


oracle("fit_list", with_(materialized(flat_sweep_ctes(PART_ROWS, PART_TOKENS + 3, "v1")), ONE_PASS))

# lineitem read back from libFM text: ids are one higher, values have at most 3 decimals
LIBFM_ROWS = LI_LIBFM + """,
rl AS (SELECT li.rid AS row_id, li.l_quantity AS y,
              CASE WHEN l_discount <> 0 THEN 1 END AS id0, l_discount AS x0,
              CASE WHEN l_tax <> 0 THEN 2 END AS id1, l_tax AS x1,
              3 + rf.code AS id2, CAST(1.0 AS DOUBLE) AS x2,
              3 + (SELECT n FROM li_nrf) + ls.code AS id3, CAST(1.0 AS DOUBLE) AS x3
         FROM li JOIN li_rf rf ON rf.token = li.l_returnflag JOIN li_ls ls ON ls.token = li.l_linestatus),
rl_ids AS (SELECT unnest(range(2 + (SELECT max(fid) FROM li_ent))) AS feature_id)
"""
oracle("fit_libfm", with_(materialized(flat_sweep_ctes(LIBFM_ROWS, 4, "v1")), ONE_PASS))


# ---- two side tables, a list in one of them ---------------------------------------------
oracle("relation_vectorize_two", f"""
WITH {PART_LIST.strip()},
pt_b AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT p_brand AS token FROM part)),
su_n AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
           FROM (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS token FROM supplier)),
l_p AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem),
l_s AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem),
l_rf AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS token FROM lineitem)),
l_pk AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS token FROM lineitem)),
l_sk AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS token FROM lineitem)),
dims AS (SELECT (SELECT n FROM l_p) AS np, (SELECT count(*) FROM pt_dict) AS ntok, (SELECT count(*) FROM pt_b) AS nb,
                (SELECT n FROM l_s) AS ns, (SELECT count(*) FROM su_n) AS nn),
li AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_extendedprice / {X.PRICE_SCALE!r} AS y, * FROM lineitem),
ent AS (
  SELECT line_id, y, np + w.code AS fid, w.v FROM li CROSS JOIN dims
    JOIN (SELECT DISTINCT t.p_partkey, d.code, 1.0 / t.m AS v FROM pt_tok t JOIN pt_dict d USING (token)) w ON w.p_partkey = l_partkey
  UNION ALL SELECT line_id, y, np + ntok + b.code, 1.0 FROM li CROSS JOIN dims JOIN part p ON p.p_partkey = l_partkey
    JOIN pt_b b ON b.token = p.p_brand
  UNION ALL SELECT line_id, y, k.code, 1.0 FROM li JOIN l_pk k ON k.token = CAST(l_partkey AS VARCHAR)
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT line_id, y, np + ntok + nb + ns + n.code, 1.0 FROM li CROSS JOIN dims JOIN supplier s ON s.s_suppkey = l_suppkey
    JOIN su_n n ON n.token = CAST(s.s_nationkey AS VARCHAR)
  UNION ALL SELECT line_id, y, np + ntok + nb + ns + nn, s_acctbal / {X.ACCTBAL_SCALE!r} FROM li CROSS JOIN dims
    JOIN supplier s ON s.s_suppkey = l_suppkey WHERE s_acctbal <> 0
  UNION ALL SELECT line_id, y, np + ntok + nb + k.code, 1.0 FROM li CROSS JOIN dims JOIN l_sk k ON k.token = CAST(l_suppkey AS VARCHAR)
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT line_id, y, np + ntok + nb + ns + nn + 1 + r.code, 1.0 FROM li CROSS JOIN dims
    JOIN l_rf r ON r.token = l_returnflag)
SELECT CAST(line_id AS BIGINT) AS line_id, {r6('y')} AS y, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM ent""")


# ---- learned dictionaries on other data ---------------------------------------------------
oracle("encode_unseen", f"""
WITH learned AS (SELECT * FROM events WHERE user_id % {X.UNSEEN_MODULUS} <> 0),
u AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS token FROM learned)),
t AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT event_type AS token FROM learned)),
d AS (SELECT (SELECT count(*) FROM u) AS nu, (SELECT count(*) FROM t) AS nt),
ent AS (
  SELECT event_id AS row_id, u.code AS fid, 1.0 AS v FROM events JOIN u ON u.token = CAST(user_id AS VARCHAR)
  UNION ALL SELECT event_id, d.nu + t.code, 1.0 FROM events CROSS JOIN d JOIN t ON t.token = event_type
  UNION ALL SELECT event_id, d.nu + d.nt, CAST((epoch_us(ts) // 1000000) // 86400 AS DOUBLE) FROM events CROSS JOIN d)
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM ent WHERE v <> 0""")


# ---- conflict-free ranges and colours -------------------------------------------------------
def greedy_cut_sql(ctes: str, end: str, recursive: str = "RECURSIVE") -> str:
    """``ctes`` end with ``ent(rid, id)``: from each start the least id that follows another
    one, not below the start, in a row."""
    return f"""WITH {recursive} {ctes.strip()},
pairs AS (SELECT id AS b, lag(id) OVER (PARTITION BY rid ORDER BY id) AS a FROM ent),
near AS (SELECT b, max(a) AS a FROM pairs WHERE a IS NOT NULL GROUP BY b),
cuts(s) AS (SELECT CAST(0 AS BIGINT) UNION ALL
            SELECT (SELECT CAST(min(b) AS BIGINT) FROM near WHERE a >= s) FROM cuts
             WHERE EXISTS (SELECT 1 FROM near WHERE a >= s))
SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS block, s AS feature_offset,
       CAST(coalesce(lead(s) OVER (ORDER BY s), ({end})) - s AS BIGINT) AS width FROM cuts"""


oracle("conflict_cut", greedy_cut_sql(LI_LIBFM + """,
ent AS (SELECT DISTINCT rid, fid + 1 AS id FROM li_ent)""", "SELECT max(fid) + 2 FROM li_ent"))

_ORDER_PARTS = """
op_d AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS token FROM lineitem)),
ent AS (SELECT DISTINCT l_orderkey AS rid, d.code AS id FROM lineitem JOIN op_d d ON d.token = CAST(l_partkey AS VARCHAR))"""
oracle("order_parts_cut", greedy_cut_sql(_ORDER_PARTS, "SELECT count(*) FROM op_d"))
oracle("coloured_ids", """
SELECT count(DISTINCT l_partkey) AS n_ids, CAST(0 AS BIGINT) AS n_conflicts FROM lineitem""")

oracle("relational_fit", with_(materialized(flat_sweep_ctes(REL_ROWS, 6, "v1", passes=2)), f"""
SELECT CAST(feature_id AS BIGINT) AS feature_id, {r6('w')} AS w, {r6('v0')} AS v0, {r6('v1')} AS v1,
       {r6('(SELECT w0 FROM fw0_2)')} AS w0
  FROM fp_w_2 JOIN fp_v0_2 USING (feature_id) JOIN fp_v1_2 USING (feature_id)"""))


# ---- a chain of side tables -------------------------------------------------------------------
def _codes(name: str, column: str, table: str) -> str:
    return (f"{name} AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code "
            f"FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS token FROM {table}))")


oracle("relation_vectorize_nested", f"""
WITH rg AS (SELECT * FROM region WHERE r_name <> '{X.REGION_DROPPED}'),
{_codes('d_sk', 'l_suppkey', 'lineitem')}, {_codes('d_nk', 's_nationkey', 'supplier')},
{_codes('d_rk', 'n_regionkey', 'nation')}, {_codes('d_rn', 'r_name', 'rg')}, {_codes('d_rf', 'l_returnflag', 'lineitem')},
d AS (SELECT (SELECT count(*) FROM d_sk) AS ns, (SELECT count(*) FROM d_nk) AS nn, (SELECT count(*) FROM d_rk) AS nr,
             (SELECT count(*) FROM d_rn) AS nm),
-- local ids of each level: own one-hot, then the level below
nat AS (SELECT n.n_nationkey AS key, CASE WHEN r.r_regionkey IS NULL THEN k.code ELSE d.nr + m.code END AS fid
          FROM nation n CROSS JOIN d JOIN d_rk k ON k.token = CAST(n.n_regionkey AS VARCHAR)
          LEFT JOIN rg r ON r.r_regionkey = n.n_regionkey LEFT JOIN d_rn m ON m.token = r.r_name),
sup AS (SELECT s.s_suppkey AS key, CASE WHEN nat.key IS NULL THEN k.code ELSE d.nn + nat.fid END AS fid, 1.0 AS v
          FROM supplier s CROSS JOIN d JOIN d_nk k ON k.token = CAST(s.s_nationkey AS VARCHAR)
          LEFT JOIN nat ON nat.key = s.s_nationkey
        UNION ALL SELECT s.s_suppkey, d.nn + d.nr + d.nm, s.s_acctbal / {X.ACCTBAL_SCALE!r} FROM supplier s CROSS JOIN d
         WHERE s.s_acctbal <> 0),
li AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_extendedprice / {X.PRICE_SCALE!r} AS y, * FROM lineitem),
ent AS (
  SELECT line_id, y, d.ns + sup.fid AS fid, sup.v FROM li CROSS JOIN d JOIN sup ON sup.key = l_suppkey
  UNION ALL SELECT line_id, y, k.code, 1.0 FROM li JOIN d_sk k ON k.token = CAST(l_suppkey AS VARCHAR)
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT line_id, y, d.ns + d.nn + d.nr + d.nm + 1 + k.code, 1.0 FROM li CROSS JOIN d JOIN d_rf k ON k.token = l_returnflag)
SELECT CAST(line_id AS BIGINT) AS line_id, {r6('y')} AS y, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM ent""")


# ---- a dictionary that grows --------------------------------------------------------------------
oracle("extend_dictionary", f"""
WITH learned AS (SELECT * FROM events WHERE user_id % {X.UNSEEN_MODULUS} <> 0),
{_codes('u', 'user_id', 'learned')}, {_codes('t', 'event_type', 'learned')},
d AS (SELECT (SELECT count(*) FROM u) AS nu, (SELECT count(*) FROM t) AS nt),
u2 AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
         FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS token FROM events) WHERE token NOT IN (SELECT token FROM u)),
t2 AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code
         FROM (SELECT DISTINCT event_type AS token FROM events) WHERE token NOT IN (SELECT token FROM t)),
ids AS (SELECT 'u' AS f, token, code AS fid FROM u UNION ALL SELECT 't', token, d.nu + code FROM t CROSS JOIN d
        UNION ALL SELECT 'u', token, d.nu + d.nt + 1 + code FROM u2 CROSS JOIN d
        UNION ALL SELECT 't', token, d.nu + d.nt + 1 + (SELECT count(*) FROM u2) + code FROM t2 CROSS JOIN d),
ent AS (
  SELECT event_id AS row_id, fid, 1.0 AS v FROM events JOIN ids ON f = 'u' AND token = CAST(user_id AS VARCHAR)
  UNION ALL SELECT event_id, fid, 1.0 FROM events JOIN ids ON f = 't' AND token = event_type
  UNION ALL SELECT event_id, d.nu + d.nt, CAST((epoch_us(ts) // 1000000) // 86400 AS DOUBLE) FROM events CROSS JOIN d)
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM ent WHERE v <> 0""")


oracle("custom_transform_arrow", f"""
WITH {PART_LIST.strip()},
ent AS (SELECT DISTINCT t.p_partkey AS k, d.code AS fid, length(d.token) / 10.0 AS v FROM pt_tok t JOIN pt_dict d USING (token)
        UNION ALL SELECT p_partkey, (SELECT count(*) FROM pt_dict), ln(1 + p_size) FROM part)
SELECT CAST(k AS BIGINT) AS p_partkey, CAST(fid AS BIGINT) AS feature_id, {r6('v')} AS value FROM ent WHERE v <> 0""")


oracle("fit_groups", with_(flat_sweep_ctes(REL_ROWS, 6, "v1", group_reg=X.GROUP_REG), ONE_PASS))
