"""Flat vectorizer: named columns -> labelled sparse rows.

Output (``Vectorized``):

* ``rows``: ``row_id bigint, y double, features array<struct<feature_id:bigint, value:double>>``
  with ids ascending inside each row;
* ``dictionary``: ``field int, token string, code bigint, feature_id bigint``;
* ``layout``: per field its offset and width (F small numbers on the driver).

Plan shape: one aggregation job learns every dictionary (distinct
``(field, token)``, map-side combined); one-hot fields are then looked up by
equi-joins that are broadcast when the dictionary's exact size is under the
bound and shuffled otherwise; number / time fields are plain expressions; list
fields explode, join and re-collect per row, in one shuffle and without an id.
What a plan broadcasts is bounded in sum.  Learned dictionaries encode other data
(``Vectorized.encode``), unseen tokens raising an error or being left out.
Nothing row- or feature-sized is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import epoch_to_days, list_weights, split_list, to_number
from ..session import ENTRY_OVERHEAD_BYTES, Scratch, broadcast_bytes, broadcast_rows, single_task_rows
from .dictionary import dense_ids
from .fields import IDENTITY, LIST, NUMBER, TIME, FieldSpec, split_target_inputs

HOT_SHARE = 1000        # a token with more than such a share of a field's rows is hot
SALTS = 64              # parts of a hot token in a shuffle join

ENTRY = T.StructType([T.StructField("feature_id", T.LongType()),
                      T.StructField("value", T.DoubleType())])
FEATURES = T.ArrayType(ENTRY)


@dataclass
class Block:
    """A contiguous feature-id range; ``multi`` if a row can hold several ids
    of it (list fields), which the learner must cut further."""
    name: str
    offset: int
    size: int
    multi: bool = False

    @property
    def end(self) -> int:
        return self.offset + self.size


@dataclass
class FieldLayout:
    index: int
    column: str
    kind: str
    offset: int
    size: int
    blocks: list[Block] = field(default_factory=list)


@dataclass
class Vectorized:
    rows: DataFrame
    layout: list[FieldLayout]
    dictionary: DataFrame
    dimension: int
    encoder: Callable[..., DataFrame] | None = None
    learned: "Learned | None" = None
    inputs: list[FieldSpec] = field(default_factory=list)

    def entries(self) -> DataFrame:
        """Long form ``row_id, feature_id, value`` (one row per non-zero)."""
        return self.rows.select("row_id", F.inline("features"))

    def blocks(self) -> list[Block]:
        return [b for f in self.layout for b in f.blocks]

    def extend(self, df: DataFrame) -> "Vectorized":
        """The same with the tokens of ``df`` that the dictionaries lack (``extend_dictionary``):
        a new version, whose ``rows`` are those of ``df``.  Old ids stay as they are, the new
        ones follow the last old one, so parameters fitted on an older version keep their
        meaning."""
        learned, layout, dimension = extend_dictionary(self.learned, self.layout, self.inputs, self.dimension, df)
        out = Vectorized(self.encoder(df, "error", learned), layout, dictionary_frame(df.sparkSession, learned, layout), dimension)
        out.learned, out.inputs = learned, self.inputs
        out.encoder = lambda other, unseen, known=None: self.encoder(other, unseen, known or learned)
        return out

    def encode(self, df: DataFrame, unseen: str = "error") -> DataFrame:
        """``row_id, y, features`` of other data of the same columns, by the learned
        dictionaries.  A token that they lack raises (``unseen="error"``) or has no
        entry (``"skip"``)."""
        if unseen not in ("error", "skip"):
            raise ValueError(f"unknown unseen policy {unseen!r}; error or skip")
        return self.encoder(df, unseen)


@dataclass
class Learned:
    """Dictionaries of the categorical fields (``token, code``: the id less the field's
    offset) with their exact sizes and token bytes.  ``first`` holds the sizes at version 0:
    the field's own block has so many ids, later tokens' ids lie after all fields."""
    dicts: dict[int, DataFrame]
    sizes: dict[int, int]
    nbytes: dict[int, int]
    version: int = 0
    first: dict[int, int] = field(default_factory=dict)
    hot: dict[int, list[str]] = field(default_factory=dict)     # of fields that shuffle

    def own(self, i: int) -> int:
        return self.first.get(i, self.sizes[i])

    def save(self, path: str) -> None:
        """Write the dictionaries as one Parquet table: field, token, code, version, own."""
        if not self.dicts:
            raise ValueError("no dictionary to save")
        parts = [d.select(F.lit(i).alias("field"), "token", "code", F.lit(self.version).alias("version"),
                          F.lit(self.own(i)).cast("bigint").alias("own")) for i, d in self.dicts.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str, fields: list[int]) -> "Learned":
        """The dictionaries saved at ``path``; ``fields``: the positions of all categorical
        fields (one whose dictionary is empty has no row there)."""
        saved = spark.read.parquet(path)
        rows = {r["field"]: r for r in saved.groupBy("field").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b"), F.max("version").alias("v"),
            F.max("own").alias("own")).collect()}
        return Learned({i: saved.where(F.col("field") == i).select("token", "code") for i in fields},
                       {i: int(rows[i]["n"]) if i in rows else 0 for i in fields},
                       {i: int(rows[i]["b"]) if i in rows else 0 for i in fields},
                       max((r["v"] for r in rows.values()), default=0),
                       {i: int(rows[i]["own"]) if i in rows else 0 for i in fields})


def dictionary_frame(spark, learned: Learned, layout: list[FieldLayout]) -> DataFrame:
    """``field, token, code, feature_id`` of all categorical fields."""
    out = None
    for i, d in learned.dicts.items():
        part = d.select(F.lit(i).alias("field"), "token", "code", (F.col("code") + F.lit(layout[i].offset)).alias("feature_id"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "field int, token string, code bigint, feature_id bigint")


def extend_dictionary(learned: Learned, layout: list[FieldLayout], inputs: list[FieldSpec], dimension: int,
                      df: DataFrame) -> tuple[Learned, list[FieldLayout], int]:
    """The next version of the dictionaries: the tokens of ``df`` that a field lacks (an
    anti-join) get the ids after ``dimension``, field by field in token order; each field
    that grows gets one more block there.  Returns it with the layout and the dimension."""
    cat = [(i, s) for i, s in enumerate(inputs) if s.categorical]
    base = df.select(*[F.col(s.column).alias(f"_c{i}") for i, s in enumerate(inputs)])
    scratch = Scratch(df.sparkSession, "dictionary")
    dicts, sizes, nbytes = dict(learned.dicts), dict(learned.sizes), dict(learned.nbytes)
    layout = [replace(f, blocks=list(f.blocks)) for f in layout]
    # the whole of each field's tokens is made distinct before it meets the dictionary
    for i, s in cat:
        c = F.col(f"_c{i}")
        tokens = base.select((F.explode(_tokens(s, c)) if s.kind == LIST else c.cast("string")).alias("token"))
        known = dicts[i].select("token")
        if sizes[i] <= broadcast_rows(df.sparkSession) and nbytes[i] + sizes[i] * ENTRY_OVERHEAD_BYTES <= broadcast_bytes(df.sparkSession):
            known = F.broadcast(known)
        new = scratch.write(tokens.where(F.col("token").isNotNull()).distinct().join(known, "token", "left_anti"))
        r = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b")).first()
        if not r["n"]:
            continue
        coded, _ = dense_ids(new, r["n"])
        grown = coded.select("token", (F.col("code") + F.lit(dimension - layout[i].offset)).alias("code"))
        dicts[i] = scratch.write(dicts[i].unionByName(grown))
        sizes[i], nbytes[i] = sizes[i] + int(r["n"]), nbytes[i] + int(r["b"] or 0)
        layout[i].blocks.append(Block(f"{s.column}+{learned.version + 1}", dimension, int(r["n"]), s.kind == LIST))
        dimension += int(r["n"])
    first = {i: learned.own(i) for i in dicts}
    return Learned(dicts, sizes, nbytes, learned.version + 1, first, learned.hot), layout, dimension


def within_budget(spark, sides: dict, budget: int | None = None) -> set:
    """Which of a plan's sides (name -> (rows, bytes besides the overhead)) are
    broadcast: the smallest first, while they fit the byte bound in sum."""
    left = broadcast_bytes(spark) if budget is None else budget
    out = set()
    for name, (rows, extra) in sorted(sides.items(), key=lambda kv: (kv[1][1] + kv[1][0] * ENTRY_OVERHEAD_BYTES, str(kv[0]))):
        need = extra + rows * ENTRY_OVERHEAD_BYTES
        if rows <= broadcast_rows(spark) and need <= left:
            out.add(name)
            left -= need
    return out


def _source_type(df: DataFrame, column: str) -> str:
    try:
        return df.schema[column].dataType.simpleString()
    except KeyError:
        return "string"


def _number_value(spec: FieldSpec, c: Column, dtype: str) -> Column:
    if spec.transform is not None:
        return spec.transform(c).cast("double")
    if spec.kind == TIME:
        return epoch_to_days(c, dtype)
    return to_number(c)


def _tokens(spec: FieldSpec, c: Column) -> Column:
    return split_list(c.cast("string"), spec.sep)


def assign_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give rows a stable bigint id (``zipWithIndex`` in the original): the id
    is drawn once and the table checkpointed, so re-computation after an
    executor loss sees the same ids."""
    return df.withColumn(name, F.monotonically_increasing_id()).checkpoint(eager=True)


def learn_dictionaries(base: DataFrame, cat_fields: list[tuple[int, FieldSpec]]) -> Learned:
    """Learn the dictionary of every categorical field in one aggregation; they are
    written once to the shared scratch folder."""
    spark = base.sparkSession
    if not cat_fields:
        return Learned({}, {}, {})
    parts = []
    for i, spec in cat_fields:
        c = F.col(f"_c{i}")
        tok = F.explode(_tokens(spec, c)) if spec.kind == LIST else c.cast("string")
        parts.append(base.select(F.lit(i).alias("field"), tok.alias("token")))
    allt = parts[0]
    for p in parts[1:]:
        allt = allt.unionByName(p)
    distinct = allt.where(F.col("token").isNotNull()).groupBy("field", "token").agg(F.count(F.lit(1)).alias("held")).persist()
    sizes = {i: 0 for i, _ in cat_fields}
    nbytes = {i: 0 for i, _ in cat_fields}
    rows = {}
    for r in distinct.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("b"),
                                           F.sum("held").alias("rows")).collect():
        sizes[int(r["field"])] = int(r["n"])
        nbytes[int(r["field"])] = int(r["b"] or 0)
        rows[int(r["field"])] = int(r["rows"])
    hot = hot_tokens(distinct, rows, [i for i in rows if i not in within_budget(spark, {i: (sizes[i], nbytes[i]) for i in rows})])
    limit = single_task_rows(spark)
    small = [i for i, _ in cat_fields if sizes[i] <= limit]
    scratch = Scratch(spark, "dictionary")
    dicts: dict[int, DataFrame] = {}
    if small:
        w = Window.partitionBy("field").orderBy("token")
        numbered = scratch.write(
            distinct.where(F.col("field").isin(small))
            .select("field", "token", (F.row_number().over(w) - 1).cast("bigint").alias("code")))
        for i in small:
            dicts[i] = numbered.where(F.col("field") == i).select("token", "code")
    for i, _ in cat_fields:
        if i not in small:
            coded, _ = dense_ids(distinct.where(F.col("field") == i).select("token"), sizes[i], max_single_task=limit)
            dicts[i] = scratch.write(coded)
    distinct.unpersist()
    return Learned(dicts, sizes, nbytes, hot=hot)


def hot_tokens(counted: DataFrame, rows: dict[int, int], fields: list[int]) -> dict[int, list[str]]:
    """By field the tokens that more than a ``HOT_SHARE``-th of its rows hold: fewer than
    ``HOT_SHARE`` of them, from exact counts."""
    if not fields:
        return {}
    many = F.lit(False)
    for i in fields:
        many = many | ((F.col("field") == i) & (F.col("held") * HOT_SHARE > rows[i]))
    out: dict[int, list[str]] = {}
    for r in counted.where(many).select("field", "token").collect():
        out.setdefault(int(r["field"]), []).append(r["token"])
    return {i: sorted(t) for i, t in out.items()}


def salted_join(frame: DataFrame, side: DataFrame, on: Column, token: Column, key: Column, hot: list[str]) -> DataFrame:
    """Left shuffle join ``on`` two columns.  Rows whose ``token`` is hot are spread over
    ``SALTS`` parts, and the side's rows of those keys copied to all of them, so a token
    with a third of the rows is no single task, with or without adaptive execution."""
    if not hot:
        return frame.join(side, on, "left")
    part = F.when(token.isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = side.withColumn("_part", F.explode(parts))
    return frame.withColumn("_own_part", part).join(copied, on & (F.col("_own_part") == F.col("_part")), "left").drop("_own_part", "_part")


def base_columns(df: DataFrame, specs: list[FieldSpec], row_id: str | None = None, ids: bool = True,
                 target: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``row_id, y`` and one ``_c{i}`` per input field, and the columns' types.  Without
    a ``row_id`` column, ids are drawn and fixed (``ids``) or null.  ``target=False``:
    ``y`` is null where the data have no target column (data to be scored)."""
    tgt, inputs = split_target_inputs(specs)
    dtypes = {s.column: _source_type(df, s.column) for s in specs}
    if not target and tgt.column not in df.columns:
        y = F.lit(None).cast("double")
    else:
        y = _number_value(tgt, F.col(tgt.column), dtypes[tgt.column])
    cols = [y.alias("y"), *[F.col(s.column).alias(f"_c{i}") for i, s in enumerate(inputs)]]
    if row_id is None and ids:
        return assign_row_ids(df.select(*cols)), dtypes
    key = F.col(row_id) if row_id else F.lit(None)
    return df.select(key.cast("bigint").alias("row_id"), *cols), dtypes


def standard_vectorize(df: DataFrame, specs: list[FieldSpec], row_id: str | None = None,
                       ids: bool = True) -> Vectorized:
    """Whole flat pipeline: target + ordered inputs -> sparse rows.  ``ids=False``: rows
    without a ``row_id`` column get none (their ids are null)."""
    _, inputs = split_target_inputs(specs)
    base, dtypes = base_columns(df, specs, row_id, ids)
    vec = vectorize_base(base, inputs, dtypes)

    def encode(other: DataFrame, unseen: str, learned: Learned | None = None) -> DataFrame:
        b, types = base_columns(other, specs, row_id, ids, target=False)
        return vectorize_base(b, inputs, types, learned=learned or vec.learned, unseen=unseen).rows

    vec.encoder = encode
    vec.inputs = inputs
    return vec


def vectorize_base(base: DataFrame, inputs: list[FieldSpec], dtypes: dict[str, str],
                   extra: dict[int, tuple[int, list[Block]]] | None = None,
                   substitute=None, carry: list[str] | None = None, learned: Learned | None = None,
                   unseen: str = "skip", reserved: int = 0) -> Vectorized:
    """Encode a frame holding ``row_id, y`` and one ``_c{i}`` per input field.

    ``extra[i] = (width, blocks)`` reserves ids right after field ``i``'s own
    block (side-table features, see ``relations``); ``substitute(frame,
    layout, hot tokens)`` may then replace the per-field arrays ``_a{i}`` before they are
    concatenated, and add columns, of which those in ``carry`` stay with the rows.
    ``learned``: dictionaries to use; their unseen tokens follow ``unseen``.
    ``reserved``: bytes that the plan broadcasts besides dictionaries."""
    spark = base.sparkSession
    extra = extra or {}
    given = learned is not None
    if not given:
        learned = learn_dictionaries(base, [(i, s) for i, s in enumerate(inputs) if s.categorical])
    dicts, sizes, nbytes = learned.dicts, learned.sizes, learned.nbytes
    small = within_budget(spark, {i: (sizes[i], nbytes[i]) for i in dicts}, broadcast_bytes(spark) - reserved)

    layout: list[FieldLayout] = []
    offset = 0
    for i, s in enumerate(inputs):
        size = learned.own(i) if s.categorical else 1
        blocks = [Block(s.column, offset, size, s.kind == LIST)]
        width = size
        if i in extra:
            ew, eblocks = extra[i]
            blocks += [Block(b.name, offset + size + b.offset, b.size, b.multi) for b in eblocks]
            width += ew
        layout.append(FieldLayout(i, s.column, s.kind, offset, width, blocks))
        offset += width
    dimension = offset

    dictionary = dictionary_frame(spark, learned, layout)

    enc = base
    for i, s in enumerate(inputs):
        lay = layout[i]
        c = F.col(f"_c{i}")
        policy = unseen if given else "skip"
        if s.kind == IDENTITY:
            d = dicts[i].select(F.col("token").alias(f"_k{i}"),
                                (F.col("code") + F.lit(lay.offset)).alias(f"_id{i}"))
            enc = _lookup(enc.withColumn(f"_t{i}", c.cast("string")), F.col(f"_t{i}"), d, f"_k{i}", i in small,
                          learned.hot.get(i))
            val = s.transform(F.col(f"_t{i}")).cast("double") if s.transform else F.lit(1.0)
            found = _known(F.col(f"_t{i}"), F.col(f"_id{i}"), policy, s.column)
            arr = (F.when(found.isNotNull() & F.col(f"_t{i}").isNotNull(),
                          F.array(F.struct(found.alias("feature_id"), val.alias("value"))))
                   .otherwise(F.array().cast(FEATURES)))
            enc = enc.withColumn(f"_a{i}", arr.cast(FEATURES)).drop(f"_k{i}")
        elif s.kind in (NUMBER, TIME):
            val = _number_value(s, c, dtypes.get(s.column, "string"))
            arr = (F.when(val.isNotNull(), F.array(F.struct(
                F.lit(lay.offset).cast("bigint").alias("feature_id"), val.alias("value"))))
                .otherwise(F.array().cast(FEATURES)))
            enc = enc.withColumn(f"_a{i}", arr.cast(FEATURES))
        else:  # LIST
            enc = encode_list(enc, s, f"_c{i}", f"_a{i}", dicts[i], lay.offset, i in small, policy, learned.hot.get(i))
    if substitute is not None:
        enc = substitute(enc, layout, learned.hot)
    arrays = [F.col(f"_a{i}") for i in range(len(inputs))]
    feats = F.concat(*arrays) if arrays else F.array().cast(FEATURES)
    # a sparse vector stores no zeros: a zero-valued entry is absent, so the
    # learner never treats its feature as present
    feats = F.filter(feats, lambda e: e["value"] != F.lit(0.0))
    rows = enc.select("row_id", "y", feats.cast(FEATURES).alias("features"), *(carry or []))
    vec = Vectorized(rows, layout, dictionary, dimension)
    vec.learned = learned
    return vec


def _lookup(frame: DataFrame, token: Column, dictionary: DataFrame, key: str, small: bool,
            hot: list[str] | None = None) -> DataFrame:
    """Left join with a dictionary.  Where it shuffles, null tokens get keys of their
    own, so that they do not meet in one task (a null token has no entry), and hot ones
    several parts."""
    if small:
        return frame.join(F.broadcast(dictionary), token == F.col(key), "left")
    own = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    return salted_join(frame.withColumn("_own", F.coalesce(token, own)), dictionary, F.col("_own") == F.col(key),
                       F.col("_own"), F.col(key), hot or []).drop("_own")


def _known(token: Column, feature_id: Column, policy: str, column: str) -> Column:
    if policy != "error":
        return feature_id
    message = F.concat(F.lit(f"unseen token in {column!r}: "), token)
    return F.when(token.isNotNull() & feature_id.isNull(), F.raise_error(message).cast("bigint")).otherwise(feature_id)


def encode_list(frame: DataFrame, spec: FieldSpec, column: str, out: str, dictionary: DataFrame, offset: int,
                small: bool = True, policy: str = "skip", hot: list[str] | None = None) -> DataFrame:
    """``frame`` with ``out``: the multi-hot entries of the list in ``column``, ids
    ascending.  Each of the m tokens gets 1/m (or its transform); duplicate tokens
    collapse to one entry (same value).  Rows are told apart by a number drawn here,
    so equal rows and ids do not mix; each row is shuffled once."""
    cols = frame.columns
    d = dictionary.select(F.col("token").alias("_key"), (F.col("code") + F.lit(offset)).alias("_fid"))
    made = {"_u": F.monotonically_increasing_id(), "_toks": _tokens(spec, F.col(column))}
    # the weight of a row's tokens is known before they are told apart: the list itself goes no further
    weight = F.lit(None).cast("double") if spec.transform else list_weights("_toks")
    ex = (frame.withColumns(made).withColumn("_weight", weight)
          .withColumn("_tok", F.explode_outer(F.array_distinct("_toks"))).drop("_toks"))
    j = _lookup(ex, F.col("_tok"), d, "_key", small, hot)
    val = spec.transform(F.col("_tok")).cast("double") if spec.transform else F.col("_weight")
    fid = _known(F.col("_tok"), F.col("_fid"), policy, spec.column)
    entry = F.when(fid.isNotNull() & F.col("_tok").isNotNull(), F.struct(fid.alias("feature_id"), val.alias("value")))
    # a column each, so that one nobody reads is not shuffled
    grouped = j.groupBy("_u").agg(*[F.first(c).alias(c) for c in cols], F.array_sort(F.collect_list(entry)).alias("_e"))
    return grouped.select(*cols, F.col("_e").cast(FEATURES).alias(out))


def filter_arity(raw: DataFrame, n: int, fields: str = "fields") -> DataFrame:
    """Keep rows with exactly ``n`` fields (the arity of the definition)."""
    return raw.where(F.size(fields) == n)


def fields_to_columns(raw: DataFrame, n: int, fields: str = "fields", prefix: str = "c") -> DataFrame:
    """``fields array<string>`` -> columns ``c0..c{n-1}`` (other columns kept)."""
    others = [c for c in raw.columns if c != fields]
    return raw.select(*others, *[F.col(fields)[j].alias(f"{prefix}{j}") for j in range(n)])
