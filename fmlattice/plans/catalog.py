"""Registered queries: one per operator of the inventory.  Each takes
``(spark, sf_dir)``, reads the driver's tables and returns a DataFrame whose
column names and types match the DuckDB oracle in ``oracles.py``.

Output conventions (so both engines hash equal): integers BIGINT, doubles
``round(x, 6) + 0.0`` as DOUBLE, strings VARCHAR.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_gauss
from ..operators import model as M
from ..operators.vectorize import standard_vectorize
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).cast("double")


def big(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


# ---- shared pieces ----------------------------------------------------------

def events_vectorized(spark, sf_dir, specs=None):
    ev = X.table(spark, sf_dir, "events")
    return standard_vectorize(ev, specs or X.EVENTS_SPECS, row_id="event_id")


def score_params(spark, vec, cfg=X.SCORE_CFG):
    """A fixed model for the scoring queries: v from ``init_params`` and w
    drawn the same way (``init_params`` alone has w = 0)."""
    p = M.init_params(spark, vec.dimension, cfg)
    return p.withColumn("w", hash_gauss(0.0, X.SCORE_W_STDEV, cfg.seed, "w", F.col("feature_id")))


def events_scored(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    params = score_params(spark, vec)
    return M.predict(vec.rows, params, X.SCORE_W0, X.SCORE_CFG, vec.dimension)


# ---- 2.4 feature encoding ---------------------------------------------------

@query("build_dictionary")
def q_build_dictionary(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    return vec.dictionary.select(big("field").alias("field"), F.col("token"), big("code").alias("code"))


@query("field_layout")
def q_field_layout(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    rows = [(f.index, f.column, f.kind, f.offset, f.size) for f in vec.layout]
    return spark.createDataFrame(rows, "field bigint, column_name string, kind string, "
                                       "feature_offset bigint, width bigint")


@query("encode_identity")
def q_encode_identity(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    return vec.entries().select(big("row_id").alias("row_id"), big("feature_id").alias("feature_id"),
                                r6("value").alias("value"))


@query("encode_time")
def q_encode_time(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    t = vec.layout[2]
    return (vec.entries().where(F.col("feature_id") == t.offset)
            .select(big("row_id").alias("row_id"), big("feature_id").alias("feature_id"),
                    r6("value").alias("value")))


@query("assemble_vectors")
def q_assemble_vectors(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    ids = F.array_join(F.transform("features", lambda e: e["feature_id"].cast("string")), " ")
    vsum = F.aggregate("features", F.lit(0.0), lambda acc, e: acc + e["value"])
    return vec.rows.select(big("row_id").alias("row_id"), r6("y").alias("y"),
                           ids.alias("feature_ids"), r6(vsum).alias("value_sum"))


@query("standard_vectorize")
def q_standard_vectorize(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    return vec.rows.select("row_id", "y", F.inline("features")).select(
        big("row_id").alias("row_id"), r6("y").alias("y"),
        big("feature_id").alias("feature_id"), r6("value").alias("value"))


# ---- 2.7 model --------------------------------------------------------------

@query("init_params")
def q_init_params(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    p = M.init_params(spark, vec.dimension, X.SCORE_CFG)
    return p.select(big("feature_id").alias("feature_id"), r6("w").alias("w"),
                    r6(F.col("v0") * 1000).alias("v0_milli"), r6(F.col("v1") * 1000).alias("v1_milli"))


def _scored_out(df):
    return df.select(big("row_id").alias("row_id"), r6("y").alias("y"),
                     r6("prediction").alias("prediction"))


@query("score_linear")
def q_score_linear(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    params = score_params(spark, vec)
    return _scored_out(M.predict(vec.rows, params, X.SCORE_W0, X.SCORE_CFG, vec.dimension,
                                 parts="linear"))


@query("score_interactions")
def q_score_interactions(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    params = score_params(spark, vec)
    out = M.predict(vec.rows, params, X.SCORE_W0, X.SCORE_CFG, vec.dimension, parts="interactions")
    return out.select(big("row_id").alias("row_id"), r6(F.col("prediction") * 1000).alias("interaction_milli"))


@query("predict")
def q_predict(spark, sf_dir):
    return _scored_out(events_scored(spark, sf_dir))


@query("rmse")
def q_rmse(spark, sf_dir):
    return M.rmse(events_scored(spark, sf_dir)).select(r6("rmse").alias("rmse"))


@query("mae")
def q_mae(spark, sf_dir):
    return M.mae(events_scored(spark, sf_dir)).select(r6("mae").alias("mae"))


@query("mean_signed_error")
def q_mean_signed_error(spark, sf_dir):
    return M.mean_signed_error(events_scored(spark, sf_dir)).select(
        r6("mean_signed_error").alias("mean_signed_error"))


@query("sign_accuracy")
def q_sign_accuracy(spark, sf_dir):
    return M.sign_accuracy(events_scored(spark, sf_dir)).select(r6("sign_accuracy").alias("sign_accuracy"))


# ---- 2.1 / 2.2 delimited text: orders written as '::' lines --------------------
# line = key::cust::price::priority::status; status emptied when it is 'P'
# (a trailing empty piece: the line then has 4 fields), and '::x' appended when
# the priority is '5-LOW' (6 fields).  Both kinds fail the arity check.

from ..operators.fields import Identity as _Identity, Target as _Target  # noqa: E402
from ..operators.vectorize import fields_to_columns, filter_arity  # noqa: E402
from ..session import Scratch, maybe_broadcast, scratch_path  # noqa: E402
from ..sources import text as S  # noqa: E402

ORDERS_TEXT_ARITY = 5


def orders_text(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus"))
    line = F.concat_ws("::", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
                       F.col("o_totalprice").cast("string"), F.col("o_orderpriority"), status)
    line = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(line, F.lit("::x"))).otherwise(line)
    path = scratch_path(spark, "orders-text")
    o.select(line.alias("value")).write.text(path)
    return S.read_delimited(spark, path, "::")


@query("read_delimited")
def q_read_delimited(spark, sf_dir):
    raw = orders_text(spark, sf_dir)
    return raw.select(big(F.col("fields")[0]).alias("o_orderkey"), big(F.size("fields")).alias("n_fields"))


@query("filter_arity")
def q_filter_arity(spark, sf_dir):
    raw = filter_arity(orders_text(spark, sf_dir), ORDERS_TEXT_ARITY)
    return raw.select(big(F.col("fields")[0]).alias("o_orderkey"))


def orders_text_inputs(spark, sf_dir):
    from ..operators.fields import split_target_inputs
    cols = fields_to_columns(filter_arity(orders_text(spark, sf_dir), ORDERS_TEXT_ARITY),
                             ORDERS_TEXT_ARITY)
    specs = [_Identity("c0"), _Identity("c1"), _Target("c2"), _Identity("c3"), _Identity("c4")]
    target, inputs = split_target_inputs(specs)
    return cols, target, inputs


@query("split_target_inputs")
def q_split_target_inputs(spark, sf_dir):
    cols, target, inputs = orders_text_inputs(spark, sf_dir)
    return cols.select(*[F.col(s.column).alias(f"in{j}") for j, s in enumerate(inputs)]).select(
        big("in0").alias("in0"), big("in1").alias("in1"), "in2", "in3")


@query("cast_target")
def q_cast_target(spark, sf_dir):
    cols, target, _ = orders_text_inputs(spark, sf_dir)
    return cols.select(big("c0").alias("o_orderkey"), r6(F.col(target.column).cast("double")).alias("y"))


# ---- libFM text: lineitem -------------------------------------------------------

def lineitem_vectorized(spark, sf_dir):
    from ..operators.fields import Number, Identity, Target
    li = X.table(spark, sf_dir, "lineitem")
    specs = [Number("l_discount"), Number("l_tax"), Identity("l_returnflag"), Identity("l_linestatus"),
             Target("l_quantity")]
    return standard_vectorize(li, specs, ids=False)     # the text has no ids


def lineitem_libfm_dir(spark, sf_dir):
    vec = lineitem_vectorized(spark, sf_dir)
    path = scratch_path(spark, "lineitem-libfm")
    S.write_libfm(vec.rows, path)
    spark.createDataFrame([("# written by the lineitem query",), ("",), ("   ",), ("  # indented",)],
                          "value string").coalesce(1).write.mode("append").text(path)
    return path


def lineitem_libfm_rows(spark, sf_dir, *columns):
    """``columns`` of the rows read from the text, parsed once.  A malformed label fails only
    where labels are read."""
    rows = S.read_libfm(spark, lineitem_libfm_dir(spark, sf_dir), assign_ids=False)
    return Scratch(spark, "libfm-rows").write(rows.select(*columns))


@query("write_libfm")
def q_write_libfm(spark, sf_dir):
    vec = lineitem_vectorized(spark, sf_dir)
    return S.libfm_lines(vec.rows).select(F.col("value").alias("line"))


@query("filter_comment_blank")
def q_filter_comment_blank(spark, sf_dir):
    path = lineitem_libfm_dir(spark, sf_dir)
    return S.filter_comment_blank(spark.read.text(path)).select(F.col("value").alias("line"))


def _libfm_row_summary(rows):
    ids = F.array_join(F.transform("features", lambda e: e["feature_id"].cast("string")), " ")
    vsum = F.aggregate("features", F.lit(0.0), lambda acc, e: acc + e["value"])
    return rows.select(r6("y").alias("y"), ids.alias("feature_ids"), r6(vsum).alias("value_sum"))


@query("read_libfm")
def q_read_libfm(spark, sf_dir):
    rows = S.read_libfm(spark, lineitem_libfm_dir(spark, sf_dir))
    return _libfm_row_summary(rows)


@query("libfm_infer_dimension")
def q_libfm_infer_dimension(spark, sf_dir):
    rows = S.read_libfm(spark, lineitem_libfm_dir(spark, sf_dir))
    return spark.createDataFrame([(S.libfm_dimension(rows),)], "dimension bigint")


@query("format_compact")
def q_format_compact(spark, sf_dir):
    from ..functions import format_compact
    li = X.table(spark, sf_dir, "lineitem")
    xs = (li.select(F.col("l_discount").alias("x"))
          .unionByName(li.select(F.col("l_tax").alias("x")))
          .unionByName(li.select(F.col("l_quantity").alias("x")))
          .unionByName(li.select((F.col("l_extendedprice") / 7).alias("x")))
          .unionByName(li.select((F.col("l_discount") - F.col("l_tax")).alias("x")))).distinct()
    return xs.select(r6("x").alias("x"), format_compact(F.col("x")).alias("text"))


# ---- list fields: part.p_name split by space ------------------------------------

def part_vectorized(spark, sf_dir):
    return standard_vectorize(X.table(spark, sf_dir, "part"), X.PART_SPECS, row_id="p_partkey")


@query("split_list")
def q_split_list(spark, sf_dir):
    from ..functions import split_list
    p = X.table(spark, sf_dir, "part")
    t = split_list(F.col("p_name"), " ")
    return p.select(big("p_partkey").alias("p_partkey"), big(F.size(t)).alias("n_tokens"),
                    F.array_join(t, "|").alias("tokens"))


@query("list_weights")
def q_list_weights(spark, sf_dir):
    from ..functions import list_weights, split_list
    p = X.table(spark, sf_dir, "part")
    return p.select(big("p_partkey").alias("p_partkey"),
                    r6(list_weights(split_list(F.col("p_name"), " "))).alias("weight"))


@query("build_list_dictionary")
def q_build_list_dictionary(spark, sf_dir):
    vec = part_vectorized(spark, sf_dir)
    return vec.dictionary.where(F.col("field") == 0).select("token", big("code").alias("code"))


@query("encode_list")
def q_encode_list(spark, sf_dir):
    vec = part_vectorized(spark, sf_dir)
    lay = vec.layout[0]
    return (vec.entries().where(F.col("feature_id") < lay.offset + lay.size)
            .select(big("row_id").alias("p_partkey"), big("feature_id").alias("feature_id"),
                    r6("value").alias("value")))


# ---- numbers and time: orders ---------------------------------------------------

def orders_numbers_vectorized(spark, sf_dir):
    from ..operators.fields import Number, Time, Identity, Target
    o = X.table(spark, sf_dir, "orders")
    specs = [Identity("o_orderstatus"), Number("o_totalprice", transform=X.price_target),
             Time("o_orderdate"),
             Number("o_custkey", transform=lambda c: F.log1p(c.cast("double"))),
             Target("o_totalprice", transform=X.price_target)]
    return standard_vectorize(o, specs, row_id="o_orderkey")


@query("to_number")
def q_to_number(spark, sf_dir):
    from ..functions import to_number
    o = X.table(spark, sf_dir, "orders")
    return o.select(big("o_orderkey").alias("o_orderkey"),
                    r6(to_number(F.col("o_totalprice").cast("string"))).alias("x"))


@query("epoch_to_days")
def q_epoch_to_days(spark, sf_dir):
    from ..functions import epoch_to_days
    o = X.table(spark, sf_dir, "orders")
    return o.select(big("o_orderkey").alias("o_orderkey"),
                    r6(epoch_to_days(F.col("o_orderdate"), o.schema["o_orderdate"].dataType.simpleString()))
                    .alias("days"))


def _field_entries(vec, i, key="row_id"):
    lay = vec.layout[i]
    return (vec.entries().where((F.col("feature_id") >= lay.offset) &
                                (F.col("feature_id") < lay.offset + lay.size))
            .select(big("row_id").alias(key), big("feature_id").alias("feature_id"),
                    r6("value").alias("value")))


@query("encode_number")
def q_encode_number(spark, sf_dir):
    return _field_entries(orders_numbers_vectorized(spark, sf_dir), 1, "o_orderkey")


@query("custom_transform")
def q_custom_transform(spark, sf_dir):
    return _field_entries(orders_numbers_vectorized(spark, sf_dir), 3, "o_orderkey")


# ---- 2.6 data-set operators: events ---------------------------------------------

from ..operators import dataset as D  # noqa: E402


@query("is_empty")
def q_is_empty(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    flags = [(1 if D.is_empty(vec.rows) else 0,
              1 if D.is_empty(vec.rows.where(F.col("y") > 1e9)) else 0)]
    return spark.createDataFrame(flags, "events_empty bigint, none_over_1e9_empty bigint")


@query("dataset_size")
def q_dataset_size(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir)
    return spark.createDataFrame([(D.dataset_size(vec.rows),)], "size bigint")


@query("dataset_dimension")
def q_dataset_dimension(spark, sf_dir):
    return D.dimension_frame(events_vectorized(spark, sf_dir).rows)


@query("transpose")
def q_transpose(spark, sf_dir):
    t = D.transpose(events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS).rows)
    return t.select(big("feature_id").alias("feature_id"), big("row_id").alias("row_id"),
                    r6("value").alias("value"))


@query("project_inputs")
def q_project_inputs(spark, sf_dir):
    rows = D.project_inputs(events_vectorized(spark, sf_dir).rows)
    return rows.select(big("row_id").alias("row_id"), F.inline("features")).select(
        "row_id", big("feature_id").alias("feature_id"), r6("value").alias("value"))


@query("project_targets")
def q_project_targets(spark, sf_dir):
    rows = D.project_targets(events_vectorized(spark, sf_dir).rows)
    return rows.select(big("row_id").alias("row_id"), r6("y").alias("y"))


# ---- 2.5 split: orders ----------------------------------------------------------

def orders_vectorized(spark, sf_dir):
    return standard_vectorize(X.table(spark, sf_dir, "orders"), X.ORDERS_SPECS, row_id="o_orderkey")


@query("random_split")
def q_random_split(spark, sf_dir):
    vec = orders_vectorized(spark, sf_dir)
    s = D.random_split(vec.rows, *X.SPLIT3_WEIGHTS, seed=X.SPLIT_SEED)
    return s.select(big("row_id").alias("o_orderkey"), "split")


@query("collection_dimension")
def q_collection_dimension(spark, sf_dir):
    vec = orders_vectorized(spark, sf_dir)
    s = D.random_split(vec.rows, *X.SPLIT3_WEIGHTS, seed=X.SPLIT_SEED)
    return D.collection_dimension(s)


# ---- 2.5 side tables: orders -> customer ------------------------------------------

from ..operators import relations as R  # noqa: E402


def customer_relation(spark, sf_dir, drop_segment=True):
    cu = X.table(spark, sf_dir, "customer")
    if drop_segment:
        cu = cu.where(F.col("c_mktsegment") != X.RELATION_DROP_SEGMENT)
    return R.Relation(cu, X.CUSTOMER_SPECS)


def orders_relation_vectorized(spark, sf_dir, keep_key=False, drop_segment=True):
    o = X.table(spark, sf_dir, "orders")
    return R.relation_vectorize(o, X.ORDERS_SPECS,
                                {"o_custkey": customer_relation(spark, sf_dir, drop_segment)},
                                row_id="o_orderkey", keep_key=keep_key)


def _entries_out(vec, lo=None, hi=None, key="o_orderkey", with_y=False):
    e = vec.rows.select("row_id", "y", F.inline("features"))
    if lo is not None:
        e = e.where((F.col("feature_id") >= lo) & (F.col("feature_id") < hi))
    cols = [big("row_id").alias(key)] + ([r6("y").alias("y")] if with_y else [])
    return e.select(*cols, big("feature_id").alias("feature_id"), r6("value").alias("value"))


@query("encode_relation")
def q_encode_relation(spark, sf_dir):
    enc = R.encode_relation(customer_relation(spark, sf_dir, drop_segment=False))
    return enc.rows.select(big("key").alias("c_custkey"), F.inline("features")).select(
        "c_custkey", big("feature_id").alias("feature_id"), r6("value").alias("value"))


@query("relation_join")
def q_relation_join(spark, sf_dir):
    vec = orders_relation_vectorized(spark, sf_dir)
    lay = vec.layout[0]
    return _entries_out(vec, lay.offset + lay.blocks[0].size, lay.offset + lay.size)


@query("relation_fallback")
def q_relation_fallback(spark, sf_dir):
    vec = orders_relation_vectorized(spark, sf_dir)
    lay = vec.layout[0]
    return _entries_out(vec, lay.offset, lay.offset + lay.blocks[0].size)


@query("relation_layout")
def q_relation_layout(spark, sf_dir):
    vec = orders_relation_vectorized(spark, sf_dir, drop_segment=False)
    rows = [(j, name, off, width) for j, (name, off, width) in enumerate(R.relation_layout(vec))]
    return spark.createDataFrame(rows, "block bigint, name string, feature_offset bigint, width bigint")


@query("relation_vectorize")
def q_relation_vectorize(spark, sf_dir):
    return _entries_out(orders_relation_vectorized(spark, sf_dir), with_y=True)


@query("relation_keep_key")
def q_relation_keep_key(spark, sf_dir):
    return _entries_out(orders_relation_vectorized(spark, sf_dir, keep_key=True), with_y=True)


def lineitem_two_relations(spark, sf_dir):
    """lineitem with two side tables, one of them with a list field."""
    from ..operators.fields import Identity, Target
    li = X.table(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    relations = {"l_partkey": R.Relation(X.table(spark, sf_dir, "part"), X.PART_SIDE_SPECS),
                 "l_suppkey": R.Relation(X.table(spark, sf_dir, "supplier"), X.SUPPLIER_SPECS)}
    specs = [Identity("l_partkey"), Identity("l_suppkey"), Identity("l_returnflag"),
             Target("l_extendedprice", transform=X.price_target)]
    return R.relation_vectorize(li, specs, relations, row_id="line_id")


@query("relation_vectorize_two")
def q_relation_vectorize_two(spark, sf_dir):
    return _entries_out(lineitem_two_relations(spark, sf_dir), key="line_id", with_y=True)


@query("relation_vectorize_nested")
def q_relation_vectorize_nested(spark, sf_dir):
    """lineitem -> supplier -> nation -> region, each encoded into the one that points to it;
    one region has no row."""
    from ..operators.fields import Identity, Target
    li = X.table(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    region = R.Relation(X.table(spark, sf_dir, "region").where(F.col("r_name") != X.REGION_DROPPED), X.REGION_SPECS)
    nation = R.Relation(X.table(spark, sf_dir, "nation"), X.NATION_SPECS, relations={"n_regionkey": region})
    supplier = R.Relation(X.table(spark, sf_dir, "supplier"), X.SUPPLIER_KEY_SPECS, relations={"s_nationkey": nation})
    specs = [Identity("l_suppkey"), Identity("l_returnflag"), Target("l_extendedprice", transform=X.price_target)]
    return _entries_out(R.relation_vectorize(li, specs, {"l_suppkey": supplier}, row_id="line_id"), key="line_id", with_y=True)


@query("extend_dictionary")
def q_extend_dictionary(spark, sf_dir):
    """The dictionary of some users' events, extended by the tokens of all events: old ids
    stay, new ones follow the last old one."""
    ev = X.table(spark, sf_dir, "events")
    vec = standard_vectorize(ev.where(F.col("user_id") % X.UNSEEN_MODULUS != 0), X.EVENTS_SPECS, row_id="event_id")
    more = vec.extend(ev)
    return more.rows.select("row_id", F.inline("features")).select(
        big("row_id").alias("row_id"), big("feature_id").alias("feature_id"), r6("value").alias("value"))


def arrow_log1p():
    """``log(1 + x)`` of a column as an Arrow-batched function; null stays null."""
    @F.pandas_udf("double")
    def log1p(x: pd.Series) -> pd.Series:
        return np.log1p(x.astype("float64"))

    return log1p


def arrow_token_weight():
    """A tenth of a token's length; a null token has no weight."""
    @F.pandas_udf("double")
    def weight(token: pd.Series) -> pd.Series:
        return token.str.len().astype("float64") / 10

    return weight


@query("custom_transform_arrow")
def q_custom_transform_arrow(spark, sf_dir):
    """Vectorised functions in the transform slots: of a number, and of each token of a list."""
    from ..operators.fields import List, Number, Target
    specs = [List("p_name", sep=" ", transform=arrow_token_weight()), Number("p_size", transform=arrow_log1p()),
             Target("p_retailprice")]
    vec = standard_vectorize(X.table(spark, sf_dir, "part"), specs, row_id="p_partkey")
    return _entries_out(vec, key="p_partkey")


@query("encode_unseen")
def q_encode_unseen(spark, sf_dir):
    """Dictionaries learned from some users' events encode all events; the others'
    ids have no entry."""
    ev = X.table(spark, sf_dir, "events")
    vec = standard_vectorize(ev.where(F.col("user_id") % X.UNSEEN_MODULUS != 0), X.EVENTS_SPECS, row_id="event_id")
    rows = vec.encode(ev, unseen="skip")
    return rows.select("row_id", F.inline("features")).select(
        big("row_id").alias("row_id"), big("feature_id").alias("feature_id"), r6("value").alias("value"))


# ---- 2.8 learner: events (user_id, event_type) -----------------------------------

from ..operators import als as A  # noqa: E402
from ..operators.blocks import conflict_free_blocks, libfm_blocks  # noqa: E402


def events_learning(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    train = A.prepare(vec.rows, conflict_free_blocks(vec.rows, vec.blocks()))
    return train, M.init_params(spark, vec.dimension, X.LEARN_CFG), vec.dimension


def _after_bias(spark, sf_dir, slot="w"):
    """A work frame of the first segment after the bias step, its first block, params."""
    train, params, dim = events_learning(spark, sf_dir)
    start = A.start_pass(train, params, 0.0, X.LEARN_CFG, dim)
    seg = train.segments[0]
    factor = None if slot == "w" else int(slot[1:])
    return A.work_frame(seg, start.errors, start.sums, factor), seg.blocks[0], params


def _every_block(spark, sf_dir, slots, of):
    """What ``of`` makes of every block of the given families, in the order of the pass."""
    train, params, dim = events_learning(spark, sf_dir)
    start = A.start_pass(train, params, 0.0, X.LEARN_CFG, dim)
    out = None
    for step in A.block_by_block(train, start, params, X.LEARN_CFG):
        if step.slot in slots:
            rows = of(step)
            out = rows if out is None else out.unionByName(rows)
    return out


@query("residuals")
def q_residuals(spark, sf_dir):
    train, params, dim = events_learning(spark, sf_dir)
    return A.residuals(train.rows, params, 0.0, X.LEARN_CFG, dim).select(
        big("row_id").alias("row_id"), r6("e").alias("e"))


@query("factor_sums")
def q_factor_sums(spark, sf_dir):
    train, params, dim = events_learning(spark, sf_dir)
    return A.factor_sums(train.rows, params, X.LEARN_CFG, dim).select(
        big("row_id").alias("row_id"), r6("q0").alias("q0"), r6("q1").alias("q1"))


@query("global_bias_step")
def q_global_bias_step(spark, sf_dir):
    train, params, dim = events_learning(spark, sf_dir)
    w0 = A.start_pass(train, params, 0.0, X.LEARN_CFG, dim).w0
    return spark.createDataFrame([(w0,)], "w0 double").select(r6("w0").alias("w0"))


FACTORS = [f"v{f}" for f in range(X.LEARN_CFG.k)]


def factor_of(step):
    return F.lit(int(step.slot[1:])).cast("bigint").alias("factor")


def _stats_out(step, *more):
    return step.stats.select(*more, big("feature_id").alias("feature_id"), r6("sum_hh").alias("sum_hh"),
                             r6("sum_eh").alias("sum_eh"))


@query("theta_stats")
def q_theta_stats(spark, sf_dir):
    return _every_block(spark, sf_dir, ["w"], _stats_out)


@query("theta_stats_v")
def q_theta_stats_v(spark, sf_dir):
    return _every_block(spark, sf_dir, FACTORS, lambda step: _stats_out(step, factor_of(step)))


def _new_out(step, *more):
    reg = X.LEARN_CFG.regw if step.slot == "w" else X.LEARN_CFG.regv
    new = A.updated_theta(F.col("theta"), F.col("sum_hh"), F.col("sum_eh"), reg)
    return step.stats.select(*more, big("feature_id").alias("feature_id"), r6(new).alias("w" if step.slot == "w" else "v"))


@query("theta_update")
def q_theta_update(spark, sf_dir):
    return _every_block(spark, sf_dir, ["w"], _new_out)


@query("theta_update_v")
def q_theta_update_v(spark, sf_dir):
    return _every_block(spark, sf_dir, FACTORS, lambda step: _new_out(step, factor_of(step)))


def _state_out(step, *more):
    sums = [] if step.slot == "w" else [r6("q").alias("q")]
    return step.state.select(*more, F.lit(step.number).cast("bigint").alias("block"), big("row_id").alias("row_id"),
                             r6("e").alias("e"), *sums)


@query("error_update")
def q_error_update(spark, sf_dir):
    return _every_block(spark, sf_dir, ["w"], _state_out)


@query("error_update_v")
def q_error_update_v(spark, sf_dir):
    return _every_block(spark, sf_dir, FACTORS, lambda step: _state_out(step, factor_of(step)))


def _sweeps(spark, sf_dir, slots):
    """The sweeps of the given families, from the bias step on."""
    train, params, dim = events_learning(spark, sf_dir)
    start = A.start_pass(train, params, 0.0, X.LEARN_CFG, dim)
    updates, work = A.Updates(train.scratch), A.Work(train.scratch, train.parts, start.state)
    values = A.Values(params, train.segments, slots)
    for slot, reg in A.families(X.LEARN_CFG):
        if slot in slots:
            A.sweep(work, train.segments, params, values, slot, reg, updates)
    return updates.apply(params, dim)


@query("linear_sweep")
def q_linear_sweep(spark, sf_dir):
    return _sweeps(spark, sf_dir, ["w"]).select(big("feature_id").alias("feature_id"), r6("w").alias("w"))


@query("factor_sweep")
def q_factor_sweep(spark, sf_dir):
    return _sweeps(spark, sf_dir, ["w", "v0", "v1"]).select(
        big("feature_id").alias("feature_id"), r6("v0").alias("v0"), r6("v1").alias("v1"))


def _params_out(params, w0):
    return params.select(big("feature_id").alias("feature_id"), r6("w").alias("w"), r6("v0").alias("v0"),
                         r6("v1").alias("v1"), r6(F.lit(float(w0))).alias("w0"))


@query("als_iteration")
def q_als_iteration(spark, sf_dir):
    train, params, dim = events_learning(spark, sf_dir)
    res = A.als_iteration(train, params, 0.0, X.LEARN_CFG, dim)
    return _params_out(res.params, res.w0)


def events_fit(spark, sf_dir):
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    blocks = conflict_free_blocks(vec.rows, vec.blocks())
    return A.fit(vec.rows, X.LEARN_CFG, vec.dimension, blocks)


@query("fit")
def q_fit(spark, sf_dir):
    m = events_fit(spark, sf_dir)
    return _params_out(m.params, m.w0)


@query("training_trace")
def q_training_trace(spark, sf_dir):
    m = events_fit(spark, sf_dir)
    return m.trace.select(big("iteration").alias("iteration"), r6("rmse").alias("rmse"))


@query("fit_list")
def q_fit_list(spark, sf_dir):
    """A list field: its tokens meet in rows, so it is cut into many blocks."""
    vec = standard_vectorize(X.table(spark, sf_dir, "part"), X.PART_FIT_SPECS, row_id="p_partkey")
    m = A.fit(vec.rows, X.ONE_PASS_CFG, vec.dimension, conflict_free_blocks(vec.rows, vec.blocks()))
    return _params_out(m.params, m.w0)


@query("fit_libfm")
def q_fit_libfm(spark, sf_dir):
    """Rows read from libFM text: no ids, no fields."""
    rows = lineitem_libfm_rows(spark, sf_dir, "y", "features")
    rows = rows.withColumn("row_id", F.lit(None).cast("bigint"))
    largest = S.libfm_dimension(rows)
    m = A.fit(rows, X.ONE_PASS_CFG, largest + 1, libfm_blocks(rows, largest))
    return _params_out(m.params, m.w0)


@query("conflict_cut")
def q_conflict_cut(spark, sf_dir):
    """The greedy conflict-free ranges of lineitem's libFM rows, by pointer doubling."""
    from ..operators.blocks import cut_points
    rows = lineitem_libfm_rows(spark, sf_dir, "features")
    end = S.libfm_dimension(rows) + 1
    starts = sorted(r["s"] for r in cut_points(rows, 0, end).collect())
    return spark.createDataFrame([(i, s, e - s) for i, (s, e) in enumerate(zip(starts, [*starts[1:], end]))],
                                 "block bigint, feature_offset bigint, width bigint")


@query("order_parts_cut")
def q_order_parts_cut(spark, sf_dir):
    """The same over the parts of each order: a wide list field, cut into many ranges."""
    from ..operators.blocks import cut_points
    vec = order_parts_vectorized(spark, sf_dir)
    b = vec.blocks()[0]
    starts = sorted(r["s"] for r in cut_points(vec.rows, b.offset, b.end).collect())
    return spark.createDataFrame([(i, s, e - s) for i, (s, e) in enumerate(zip(starts, [*starts[1:], b.end]))],
                                 "block bigint, feature_offset bigint, width bigint")


def order_parts_vectorized(spark, sf_dir):
    """One row for each order, its parts as a list field."""
    from ..operators.fields import List, Target
    li = X.table(spark, sf_dir, "lineitem")
    orders = li.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_list(F.col("l_partkey").cast("string"))), ",").alias("parts"),
        F.max("l_quantity").alias("y"))
    orders = Scratch(spark, "order-parts").write(orders)        # read by the dictionary and by the encoding
    return standard_vectorize(orders, [List("parts"), Target("y")], row_id="l_orderkey")


@query("coloured_ids")
def q_coloured_ids(spark, sf_dir):
    """The parts of each order coloured: every part has a colour, no order two of one."""
    from ..operators.blocks import colours
    vec = order_parts_vectorized(spark, sf_dir)
    b = vec.blocks()[0]
    scratch = Scratch(spark, "colours")
    rows = scratch.write(vec.rows, "orders")
    coloured = colours(rows, b.offset, b.end, scratch)
    # one row for each order, so its ids are distinct where each row's are
    held = rows.select("row_id", F.explode(F.array_distinct(F.transform("features", lambda e: e["feature_id"]))).alias("id"))
    held = held.join(maybe_broadcast(coloured, b.size, extra_bytes=16 * b.size), "id")
    # few pairs repeat in a task before the shuffle: counting there would hold nearly all of them
    same = held.select("row_id", "colour").repartition("row_id").groupBy("row_id", "colour").count().where("count > 1")
    return coloured.agg(F.count("colour").alias("n_ids")).crossJoin(same.agg(F.count(F.lit(1)).alias("n_conflicts")))


@query("damped_step")
def q_damped_step(spark, sf_dir):
    """The linear terms moved at once, by the step of an exact line search."""
    from ..operators.damped import damped_family
    vec = events_vectorized(spark, sf_dir, X.EVENTS_MODEL_SPECS)
    train = A.prepare(vec.rows, [])
    params = M.init_params(spark, vec.dimension, X.LEARN_CFG)
    start = A.start_pass(train, params, 0.0, X.LEARN_CFG, vec.dimension)
    _, new, t = damped_family(train, start.errors, start.sums, params, "w", X.LEARN_CFG.regw, vec.dimension)
    return new.select(big("feature_id").alias("feature_id"), r6("new").alias("w"), r6(F.lit(t)).alias("step"))


# ---- 2.9 relation-level learning: orders -> customer ---------------------------------

from ..operators import relational as RL  # noqa: E402


def orders_relational(spark, sf_dir, drop_segment=False):
    o = X.table(spark, sf_dir, "orders")
    return RL.relational_dataset(o, X.ORDERS_SPECS, {"o_custkey": customer_relation(spark, sf_dir, drop_segment)},
                                 row_id="o_orderkey")


@query("relation_block")
def q_relation_block(spark, sf_dir):
    rb = orders_relational(spark, sf_dir).relations[0]
    return rb.rows.select(big("key").alias("c_custkey"), F.inline("features")).select(
        "c_custkey", big("feature_id").alias("feature_id"), r6("value").alias("value"))


@query("relational_dimension")
def q_relational_dimension(spark, sf_dir):
    return spark.createDataFrame([(RL.relational_dimension(orders_relational(spark, sf_dir)),)],
                                 "dimension bigint")


@query("relational_dataset")
def q_relational_dataset(spark, sf_dir):
    """Customers of one segment are left out here: their orders keep the key's one-hot."""
    d = orders_relational(spark, sf_dir, drop_segment=True)
    return d.fact.select("row_id", "key_0", F.inline("features")).select(
        big("row_id").alias("o_orderkey"), big("key_0").alias("c_custkey"),
        big("feature_id").alias("feature_id"), r6("value").alias("value"))


@query("attribute_groups")
def q_attribute_groups(spark, sf_dir):
    return RL.attribute_groups(orders_relational(spark, sf_dir))


@query("relation_cache")
def q_relation_cache(spark, sf_dir):
    d = orders_relational(spark, sf_dir)
    params = M.init_params(spark, d.dimension, X.LEARN_CFG)
    state = RL.relational_residuals(d, d.fact, params, 0.0, X.LEARN_CFG)
    c = RL.relation_cache(state, d.relations[0], params, 0, d.dimension)
    return c.select(big("key").alias("c_custkey"), big("n").alias("n"), r6("E").alias("e_sum"),
                    r6("C").alias("c_sum"), r6("C2").alias("c2_sum"), r6("EC").alias("ec_sum"))


def _relational_sweeps(spark, sf_dir, slots):
    d = orders_relational(spark, sf_dir)
    train = RL.prepare_relational(d)
    params = M.init_params(spark, d.dimension, X.LEARN_CFG)
    start, sums = RL.relational_start(train, params, 0.0, X.LEARN_CFG)
    updates, work = A.Updates(train.scratch), RL.relational_work(train, start)
    values = A.Values(params, train.segments(), slots)
    for slot, reg in A.families(X.LEARN_CFG):
        if slot in slots:
            RL.relational_family(train, work, params, values, slot, reg, updates, sums)
    return updates.apply(params, d.dimension)


@query("relation_linear_sweep")
def q_relation_linear_sweep(spark, sf_dir):
    return _relational_sweeps(spark, sf_dir, ["w"]).select(big("feature_id").alias("feature_id"), r6("w").alias("w"))


@query("relation_factor_sweep")
def q_relation_factor_sweep(spark, sf_dir):
    return _relational_sweeps(spark, sf_dir, ["w", "v0", "v1"]).select(
        big("feature_id").alias("feature_id"), r6("v0").alias("v0"), r6("v1").alias("v1"))


@query("relational_iteration")
def q_relational_iteration(spark, sf_dir):
    d = orders_relational(spark, sf_dir, drop_segment=True)
    train = RL.prepare_relational(d)
    res = RL.relational_iteration(train, M.init_params(spark, d.dimension, X.LEARN_CFG), 0.0, X.LEARN_CFG)
    return _params_out(res.params, res.w0)


@query("relational_fit")
def q_relational_fit(spark, sf_dir):
    """Two passes on the normalised tables; some orders have no customer row."""
    m = RL.relational_fit(orders_relational(spark, sf_dir, drop_segment=True), X.LEARN_CFG)
    return _params_out(m.params, m.w0)


@query("fit_groups")
def q_fit_groups(spark, sf_dir):
    """One pass with regularisation by attribute group."""
    d = orders_relational(spark, sf_dir, drop_segment=True)
    m = A.fit(d, X.ONE_PASS_CFG, group_reg=X.GROUP_REG)
    return _params_out(m.params, m.w0)
