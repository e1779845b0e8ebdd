"""Source, sink and preparation queries (S1-S10, P1-P17, A1-A4) with their SQL oracles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import dot_lit, sq_norm
from ..operators import linalg, prep, solvers
from ..session import scratch_path
from ..sources import delimited, inspect, libsvm, text
from . import fixtures as fx
from . import sqlgen as sg
from .registry import register, rnd

IDS = fx.LINEITEM_IDS
IDS_SQL = ", ".join(IDS)
D_PLANT = fx.sql_lineitem_design("planted")
D_BIN = fx.sql_lineitem_design("binary")
D_PM1 = fx.sql_lineitem_design("pm1")


def _feats():
    return [F.col("features")[j].alias(f"f{j}") for j in range(4)]


# ---------------------------------------------------------------- S1-S7, S10
@register("parse_dense_text",
          f"SELECT {IDS_SQL}, label, f0, f1, f2, f3, CAST(4 AS INTEGER) AS n_features FROM ({D_PLANT}) A")
def q_parse_dense_text(spark, sf_dir):
    """Rows rendered as ``label,a1,..,an`` text and parsed back."""
    lines = text.to_dense_lines(fx.lineitem_design(spark, sf_dir), n=4)
    parsed = text.parse_dense(lines, n=4)
    return parsed.select(*IDS, "label", *_feats(), F.size("features").alias("n_features"))


@register("dense_text_files", f"SELECT label, f0, f1, f2, f3 FROM ({D_PLANT}) A")
def q_dense_text_files(spark, sf_dir):
    """S1 from files: the design written as ``label,a1,..,an`` text files and read from them."""
    path = scratch_path(spark, "dense")
    text.to_dense_lines(fx.lineitem_design(spark, sf_dir).select("label", "features"), n=4).write.text(path)
    return text.read_dense_text(spark, path).select("label", *_feats())


@register("design_shape", f"SELECT count(*) AS m, CAST(4 AS INTEGER) AS n_min, CAST(4 AS INTEGER) AS n_max "
                          f"FROM lineitem")
def q_design_shape(spark, sf_dir):
    """Rows and width in one aggregation."""
    return inspect.shape_df(fx.lineitem_design(spark, sf_dir))


_C_UNPIVOT = " UNION ALL ".join(
    f"SELECT CAST({j} AS INTEGER) AS feat_id, {sg.rnd(f'sum(f{j} * label)')} AS value FROM ({D_PLANT}) A"
    for j in range(4))


@register("vector_by_index", _C_UNPIVOT)
def q_vector_by_index(spark, sf_dir):
    """S3: an n-vector (A^T b) written one value per line and read back keyed by line number."""
    mo = linalg.moments(fx.lineitem_design(spark, sf_dir), 4, with_gram=False)
    path = scratch_path(spark, "vector")
    text.write_vector_lines(linalg.vector_df(spark, mo.c, "value"), path)
    back = text.read_vector_lines(spark, path)
    return back.select(F.col("feat_id").cast("int").alias("feat_id"), rnd("value").alias("value"))


@register("indexed_lines_parts", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS feat_id, o_totalprice AS value FROM orders")
def q_indexed_lines_parts(spark, sf_dir):
    """S3: a vector of length m written as several files of unequal size, read back by line number over all files."""
    path = scratch_path(spark, "vector-parts")
    v = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    last = v.agg(F.max("o_orderkey").alias("n"))
    # unequal ranges of the key, one file each, named in key order
    part = v.join(F.broadcast(last)).select("o_orderkey", "o_totalprice", F.floor(5 * F.pow(F.col("o_orderkey") / (F.col("n") + 1), 3)).cast("int").alias("part"))
    (part.repartition(5, "part").sortWithinPartitions("part", "o_orderkey")
     .select("part", F.col("o_totalprice").cast("string").alias("value")).write.mode("overwrite").partitionBy("part").text(path))
    return text.read_vector_lines(spark, path)


@register("column_layout", " UNION ALL ".join(
    f"SELECT {IDS_SQL}, CAST({j} AS INTEGER) AS feat_id, f{j} AS value FROM ({D_PLANT}) A WHERE f{j} <> 0"
    for j in range(4)))
def q_column_layout(spark, sf_dir):
    """The row layout as COO entries ``[ids, feat_id, value]`` (zeros dropped)."""
    return linalg.to_coo(fx.lineitem_design(spark, sf_dir), IDS)


_NUMBERED = f"SELECT row_number() OVER (ORDER BY {IDS_SQL}) - 1 AS row_id, f0, f1, f2, f3 FROM ({D_PLANT}) A"


@register("column_text_entries", " UNION ALL ".join(
    f"SELECT row_id, CAST({j} AS BIGINT) AS feat_id, f{j} AS value FROM ({_NUMBERED}) B WHERE f{j} <> 0" for j in range(4)))
def q_column_text_entries(spark, sf_dir):
    """A^T as text, one matrix column per line, read back as entries keyed by line number and place in the line."""
    return text.read_column_entries(spark, fx.column_files(spark, sf_dir)[0])


@register("libsvm_roundtrip", f"SELECT label, f0, f1, f2, f3 FROM ({D_BIN}) A")
def q_libsvm_roundtrip(spark, sf_dir):
    """Write LibSVM (1-based indices), read back 0-based with a given width."""
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(fx.lineitem_design(spark, sf_dir, "binary"), path)
    back = libsvm.read_libsvm(spark, path, num_features=4)
    return back.select("label", *_feats())


@register("csv_infer_schema",
          "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, "
          "c_acctbal, c_mktsegment FROM customer")
def q_csv_infer_schema(spark, sf_dir):
    """S6: ';'-delimited file with header, types inferred on read."""
    path = scratch_path(spark, "csv")
    delimited.write_delimited(fx.table(spark, sf_dir, "customer"), path, sep=";")
    return delimited.read_delimited(spark, path, sep=";", infer=True)


_TYPE_CASE = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
              "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'FLOAT' THEN 'float' "
              "ELSE lower(data_type) END")


def _stats_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {table}" for c in columns)


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUSTOMER_NULLS = ("(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
                   "CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) c")


@register("preview_schema",
          f"SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, s.name, {_TYPE_CASE} AS type, n_null, n_distinct "
          f"FROM information_schema.columns i JOIN ({_stats_sql('part', _PART)}) s ON i.column_name = s.name WHERE table_name = 'part'")
def q_preview_schema(spark, sf_dir):
    """The schema as rows, with each column's nulls and distinct values."""
    part = fx.table(spark, sf_dir, "part").select(*_PART)
    return inspect.schema_df(spark, fx.table(spark, sf_dir, "part")).join(inspect.column_stats(part), "name")


@register("preview_rows", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def q_preview_rows(spark, sf_dir):
    """First 10 rows in key order (a preview without an order may be any rows)."""
    return inspect.preview(fx.table(spark, sf_dir, "part").orderBy("p_partkey"), 10)


# ---------------------------------------------------------------- P1-P5
def _customer_with_nulls(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return (c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("double"))
                         .otherwise(F.col("c_acctbal")))
             .withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 == 3, F.lit(None).cast("string"))
                         .otherwise(F.col("c_mktsegment"))))


@register("clean_rename",
          "SELECT c_custkey, c_nationkey, c_acctbal AS label, c_mktsegment FROM customer "
          "WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 3")
def q_clean_rename(spark, sf_dir):
    """Drop the id-like name column, drop rows with any null, rename the target."""
    return prep.clean(_customer_with_nulls(spark, sf_dir), drop=["c_name"], label="c_acctbal")


@register("column_roles",
          "SELECT column_name AS column, CASE WHEN column_name = 'c_acctbal' THEN 'label' "
          "WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS role, n_null, n_distinct "
          f"FROM information_schema.columns i JOIN ({_stats_sql(_CUSTOMER_NULLS, _CUSTOMER)}) s ON i.column_name = s.name WHERE table_name = 'customer'")
def q_column_roles(spark, sf_dir):
    """Roles from the schema (the label is excluded by exact name), with nulls and distinct values."""
    table = _customer_with_nulls(spark, sf_dir)
    roles = prep.column_roles(fx.table(spark, sf_dir, "customer").schema, "c_acctbal")
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("role", T.StringType())])
    stats = inspect.column_stats(table).withColumnRenamed("name", "column")
    return spark.createDataFrame(prep.roles_rows(roles), schema).join(stats, "column")


# ---------------------------------------------------------------- P6-P9
def _index_sql(table: str, col: str, key_sql: str, out: str, keep: bool = True) -> str:
    k = f"(SELECT count(*) FROM cnt WHERE v IS NOT NULL)"
    idx = f"CAST(coalesce(i, {k}) AS DOUBLE)" if keep else "CAST(i AS DOUBLE)"
    return (f"WITH cnt AS (SELECT {col} AS v, count(*) AS c FROM {table} WHERE {col} IS NOT NULL GROUP BY 1), "
            f"ix AS (SELECT v, row_number() OVER (ORDER BY c DESC, v) - 1 AS i FROM cnt) "
            f"SELECT {key_sql}, {idx} AS {out} FROM {table} t LEFT JOIN ix ON t.{col} = ix.v")


@register("index_categories", _index_sql("orders", "o_orderpriority", "o_orderkey", "o_orderpriority_idx"))
def q_index_categories(spark, sf_dir):
    """Frequency-descending index, ties alphabetical, null/unseen -> last bucket."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    model = prep.category_indexer(["o_orderpriority"]).fit(o)
    return model.transform(o).select("o_orderkey", "o_orderpriority_idx")


@register("index_label", _index_sql("lineitem", "l_returnflag", ", ".join(f"t.{c}" for c in IDS), "label",
                                    keep=False))
def q_index_label(spark, sf_dir):
    """String label -> index (unseen label is an error)."""
    li = fx.table(spark, sf_dir, "lineitem").select(*IDS, "l_returnflag")
    return prep.label_indexer("l_returnflag").fit(li).transform(li).select(*IDS, "label")


def _exploded_nonzero(df, key, vec):
    return (df.select(key, F.posexplode(vector_to_array(vec)).alias("pos", "value"))
            .filter(F.col("value") != 0).withColumn("pos", F.col("pos").cast("int")))


@register("one_hot_drop_last",
          "WITH q AS (" + _index_sql("orders", "o_orderpriority", "o_orderkey", "i") + ") "
          "SELECT o_orderkey, CAST(i AS INTEGER) AS pos, CAST(1.0 AS DOUBLE) AS value FROM q "
          "WHERE i < (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def q_one_hot(spark, sf_dir):
    """One-hot with dropLast -> the invalid bucket is the dropped one; non-zeros exploded."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    pipe = Pipeline(stages=[prep.category_indexer(["o_orderpriority"]), prep.one_hot(["o_orderpriority_idx"])])
    out = pipe.fit(o).transform(o)
    return _exploded_nonzero(out, "o_orderkey", "o_orderpriority_idx_vec")


@register("assemble_features",
          "WITH q AS (" + _index_sql("part", "p_type", "p_partkey, p_size, p_retailprice", "i") + ") "
          "SELECT p_partkey, CAST(0 AS INTEGER) AS pos, CAST(p_size AS DOUBLE) AS value FROM q WHERE p_size <> 0 "
          "UNION ALL SELECT p_partkey, CAST(1 AS INTEGER), p_retailprice FROM q WHERE p_retailprice <> 0 "
          "UNION ALL SELECT p_partkey, CAST(2 + i AS INTEGER), CAST(1.0 AS DOUBLE) FROM q "
          "WHERE i < (SELECT count(DISTINCT p_type) FROM part)")
def q_assemble(spark, sf_dir):
    """Numeric ++ one-hot(categorical) assembled into one vector; non-zeros exploded."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    roles = prep.ColumnRoles(["p_type"], ["p_size", "p_retailprice"], "none")
    out = Pipeline(stages=prep.feature_stages(p, roles)).fit(p).transform(p)
    return _exploded_nonzero(out, "p_partkey", "features")


# ---------------------------------------------------------------- P10-P16, J1/L5
@register("append_bias", f"SELECT {IDS_SQL}, CAST(5 AS INTEGER) AS width, f0 AS first, "
                         f"CAST(1.0 AS DOUBLE) AS last FROM ({D_PLANT}) A")
def q_append_bias(spark, sf_dir):
    df = prep.append_bias(fx.lineitem_design(spark, sf_dir))
    return df.select(*IDS, F.size("features").alias("width"), F.col("features")[0].alias("first"),
                     F.element_at("features", -1).alias("last"))


_NRM = "sqrt(" + sg.d(0.0) + " + f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3)"


@register("normalize_rows", f"SELECT {IDS_SQL}, {sg.rnd(f'label / {_NRM}')} AS label, "
          + ", ".join(f"{sg.rnd(f'f{j} / {_NRM}')} AS f{j}" for j in range(4)) + f" FROM ({D_PLANT}) A")
def q_normalize_rows(spark, sf_dir):
    """Rows scaled to unit feature norm (zero-norm rows -> null)."""
    df = prep.normalize_rows(fx.lineitem_design(spark, sf_dir), n=4)
    return df.select(*IDS, rnd("label").alias("label"), *[rnd(F.col("features")[j]).alias(f"f{j}") for j in range(4)])


_CLS_DOT = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(fx.CLS_W))
_SIG = f"({sg.d(1.0)} / ({sg.d(1.0)} + exp(-({_CLS_DOT}))))"


@register("threshold_labels", f"SELECT {IDS_SQL}, {sg.rnd(_SIG)} AS score, CASE WHEN {_SIG} < {sg.d(0.5)} "
                              f"THEN {sg.d(0.0)} ELSE {sg.d(1.0)} END AS prediction FROM ({D_PLANT}) A")
def q_threshold_labels(spark, sf_dir):
    """Sigmoid score -> class at 0.5."""
    df = fx.lineitem_design(spark, sf_dir)
    s = 1.0 / (1.0 + F.exp(-dot_lit("features", fx.CLS_W)))
    return df.select(*IDS, rnd(s).alias("score"), prep.score_to_class(s).alias("prediction"))


@register("remap_labels", f"SELECT {IDS_SQL}, CASE WHEN label <= 0 THEN {sg.d(0.0)} ELSE {sg.d(1.0)} END "
                          f"AS label FROM ({D_PM1}) A")
def q_remap_labels(spark, sf_dir):
    """-1/+1 labels -> 0/1 (after checking the class set)."""
    df = fx.lineitem_design(spark, sf_dir, "pm1")
    prep.check_binary_labels(df)
    return df.select(*IDS, prep.labels_to_01("label").alias("label"))


_SPLIT_TAIL = " UNION ALL ".join(
    f"SELECT '{'intercept' if j == 3 else 'coefficient'}' AS kind, CAST({j} AS INTEGER) AS feat_id, "
    f"{sg.rnd(f'x{j}')} AS value FROM {{FINAL}} f" for j in range(4))


@register("split_weights", sg.fista_sql(D_PLANT, 4, "l1", f"{sg.d(0.01)} * CAST(m AS DOUBLE)",
                                        f"{sg.d(1.0)} / tr", 100, tail=_SPLIT_TAIL))
def q_split_weights(spark, sf_dir):
    """A fitted weight vector with bias -> coefficients and intercept."""
    op = linalg.make_operator(fx.lineitem_design(spark, sf_dir), 4)
    res = solvers.fista(op, lam=0.01 * op.m, penalty="l1", maxit=100, step=1.0 / op.trace, line_search=False)
    coef, icpt = prep.split_weights(res.x)
    rows = [("coefficient", j, v) for j, v in enumerate(coef)] + [("intercept", len(coef), icpt)]
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("feat_id", T.IntegerType()),
                           T.StructField("value", T.DoubleType())])
    return spark.createDataFrame(rows, schema).select("kind", "feat_id", rnd("value").alias("value"))


def _split_query(pct, seed):
    def q(spark, sf_dir):
        df = fx.lineitem_design(spark, sf_dir)
        c = prep.hash_split_col("l_orderkey", pct, seed)
        return df.select(*IDS, F.when(c, "train").otherwise("test").alias("split"))
    return q


for _nm, _pct, _seed in (("hash_split_60_40", 60, 11), ("hash_split_80_20", 80, 0)):
    register(_nm, f"SELECT {IDS_SQL}, CASE WHEN (l_orderkey * 7919 + {_seed}) % 100 < {_pct} THEN 'train' "
                  f"ELSE 'test' END AS split FROM lineitem")(_split_query(_pct, _seed))


_TRUTH = " + ".join(f"f{j} * {sg.d(w)}" for j, w in enumerate(fx.PLANT_W))


@register("align_residual", f"SELECT {IDS_SQL}, {sg.rnd(f'({_TRUTH}) - label')} AS residual FROM ({D_PLANT}) A")
def q_align_residual(spark, sf_dir):
    """Residual A x - b with both operands on the same row (no join)."""
    df = fx.lineitem_design(spark, sf_dir)
    return df.select(*IDS, rnd(dot_lit("features", fx.PLANT_W) - F.col("label")).alias("residual"))


# ---------------------------------------------------------------- A1-A4
@register("vector_sum",
          "SELECT CAST(i - 1 AS INTEGER) AS feat_id, " + sg.rnd("sum(CAST(v AS DOUBLE))") + " AS value FROM "
          "(SELECT unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) e "
          "GROUP BY i")
def q_vector_sum(spark, sf_dir):
    """A2: elementwise sum of the 64-d embeddings (partial sums map-side, 64 groups)."""
    e = fx.embeddings_design(spark, sf_dir)
    return (e.select(F.posexplode("features").alias("feat_id", "v")).groupBy("feat_id")
            .agg(rnd(F.sum("v")).alias("value")).withColumn("feat_id", F.col("feat_id").cast("int")))


@register("sq_norm", f"SELECT {sg.rnd('sum(label * label)')} AS label_sq, "
                     f"{sg.rnd(f'sum({sg.d(0.0)} + f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3)')} AS features_sq, "
                     f"count(*) AS m FROM ({D_PLANT}) A")
def q_sq_norm(spark, sf_dir):
    """A1/A3: squared norms and the row count in one aggregation."""
    df = fx.lineitem_design(spark, sf_dir)
    return df.agg(rnd(F.sum(F.col("label") * F.col("label"))).alias("label_sq"),
                  rnd(F.sum(sq_norm("features"))).alias("features_sq"), F.count(F.lit(1)).alias("m"))


@register("n_classes", "SELECT 'embeddings' AS dataset, count(DISTINCT label) AS n_classes FROM embeddings "
                       f"UNION ALL SELECT 'lineitem', count(DISTINCT label) FROM ({fx.sql_lineitem_design('multi')}) A")
def q_n_classes(spark, sf_dir):
    """A4: number of classes = distinct labels."""
    a = fx.embeddings_design(spark, sf_dir).agg(F.lit("embeddings").alias("dataset"),
                                                F.countDistinct("label").alias("n_classes"))
    b = fx.lineitem_design(spark, sf_dir, "multi").agg(F.lit("lineitem").alias("dataset"),
                                                       F.countDistinct("label").alias("n_classes"))
    return a.unionByName(b)


@register("random_split_60_40", "SELECT count(*) AS n_rows, true AS disjoint, true AS near_share FROM lineitem")
def q_random_split(spark, sf_dir):
    """P15 with Spark's randomSplit (seed 11): sizes depend on partitioning, but the parts make up the
    table, share no row and have nearly the asked shares."""
    train, test = prep.random_split(fx.lineitem_design(spark, sf_dir).select(*IDS), (0.6, 0.4), seed=11)
    both = train.withColumn("t", F.lit(1)).unionByName(test.withColumn("t", F.lit(0)))
    per = both.groupBy(*IDS).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.max((F.col("t") > 0) & (F.col("t") < F.col("n"))).alias("mixed"), (F.sum("t") / F.sum("n")).alias("share")).select(
        "n_rows", (~F.col("mixed")).alias("disjoint"), (F.abs(F.col("share") - 0.6) < 0.05).alias("near_share"))


_KEY_BIG = 2 * 10 ** 15


@register("hash_split_keys", f"SELECT o_orderkey, (CAST(o_orderkey AS INTEGER)::BIGINT * 7919 + 11) % 100 < 60 AS by_int, "
          f"CAST((CAST(o_orderkey AS HUGEINT) + {_KEY_BIG}) * 7919 + 11 AS HUGEINT) % 100 < 60 AS by_big FROM orders")
def q_hash_split_keys(spark, sf_dir):
    """P15/P16 on int keys and on long keys whose product with the multiplier would overflow."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("int").alias("i"), (F.col("o_orderkey").cast("long") + _KEY_BIG).alias("b"))
    return o.select("o_orderkey", prep.hash_split_col("i", 60, 11).alias("by_int"), prep.hash_split_col("b", 60, 11).alias("by_big"))
