"""Design matrices derived from the driver tables, defined once for Spark and for SQL.

The tables carry almost no natural signal, so targets are *planted*: computed from existing
columns plus a key-hash noise term in integer arithmetic that DuckDB reproduces exactly.
Every expression below exists twice -- as a Spark Column and as SQL text -- written with
the same operation order so both engines produce bit-identical inputs.

lineitem row key: (l_orderkey, l_linenumber, l_partkey, l_extendedprice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linalg import to_coo
from ..operators.numbering import numbered
from ..session import scratch_path
from ..sources.text import write_column_lines

LINEITEM_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]

# fixed values of the planted lineitem problem
PLANT_W = [0.8, -0.5, 0.0, 0.3]          # weights on [qty/50, disc*10, tax*10, 1]
NOISE_MOD = 2000                          # noise = (hash mod 2000 / 1000 - 1) * NOISE_AMP
NOISE_AMP = 0.05
HASH_MUL = (7919, 104729, 15485863)       # multipliers of orderkey, partkey, linenumber
CLS_W = [4.0, -3.0, 2.0, -1.5]            # binary score weights (last = intercept)
CLS_NOISE = 20.0                          # noise multiplier in the class score
MULTI_CUTS = (-0.7, 0.7)                  # three-class cut points on the class score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ Spark side

def _feat_cols():
    return [F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0, F.lit(1.0)]


def _noise():
    h = (F.col("l_orderkey") * HASH_MUL[0] + F.col("l_partkey") * HASH_MUL[1]
         + F.col("l_linenumber").cast("long") * HASH_MUL[2])
    return (F.pmod(h, F.lit(NOISE_MOD)).cast("double") / 1000.0 - 1.0) * NOISE_AMP


def _planted(w):
    f = _feat_cols()
    out = f[0] * w[0]
    for j in range(1, len(w)):
        out = out + f[j] * w[j]
    return out


def _class_score():
    return _planted(CLS_W) + _noise() * CLS_NOISE


def lineitem_design(spark: SparkSession, sf_dir: str, target: str = "planted") -> DataFrame:
    """[ids..., label, features(4)] ; target 'planted' (regression), 'price' (natural),
    'binary' (0/1), 'pm1' (-1/+1), 'multi' (0/1/2), 'multi1' (1/2/3)."""
    li = table(spark, sf_dir, "lineitem")
    if target == "planted":
        lab = _planted(PLANT_W) + _noise()
    elif target == "price":
        lab = F.col("l_extendedprice") / 1e5
    elif target == "binary":
        lab = F.when(_class_score() > 0, 1.0).otherwise(0.0)
    elif target == "pm1":
        lab = F.when(_class_score() > 0, 1.0).otherwise(-1.0)
    elif target in ("multi", "multi1"):
        s = _class_score()
        lab = F.when(s < MULTI_CUTS[0], 0.0).when(s < MULTI_CUTS[1], 1.0).otherwise(2.0)
        if target == "multi1":
            lab = lab + 1.0
    else:
        raise ValueError(target)
    return li.select(*LINEITEM_IDS, lab.alias("label"), F.array(*_feat_cols()).alias("features"))


def embeddings_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[vec_id, label (0..9 as double), features (64 doubles)]."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("features"))


def column_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of the planted problem as text: A^T with one column per line, b with one number per line, rows in key order."""
    rows, _ = numbered(lineitem_design(spark, sf_dir), [F.col(c) for c in LINEITEM_IDS], "row_id", "design-rows")
    columns, b = scratch_path(spark, "columns"), scratch_path(spark, "right-hand-side")
    write_column_lines(to_coo(rows, ["row_id"], keep_zeros=True), columns)
    rows.orderBy("row_id").select(F.col("label").cast("string")).write.text(b)
    return columns, b


# ------------------------------------------------------------------ SQL side (DuckDB oracle)

SQL_FEATS = ["l_quantity / 50.0", "l_discount * 10.0", "l_tax * 10.0", "CAST(1.0 AS DOUBLE)"]
SQL_NOISE = (f"((CAST(((l_orderkey * {HASH_MUL[0]} + l_partkey * {HASH_MUL[1]} "
             f"+ CAST(l_linenumber AS BIGINT) * {HASH_MUL[2]}) % {NOISE_MOD}) AS DOUBLE) / 1000.0 - 1.0) "
             f"* {NOISE_AMP})")


def _sql_planted(w) -> str:
    out = f"({SQL_FEATS[0]}) * {w[0]!r}"
    for j in range(1, len(w)):
        out = f"({out} + ({SQL_FEATS[j]}) * {w[j]!r})"
    return out


def sql_class_score() -> str:
    return f"({_sql_planted(CLS_W)} + {SQL_NOISE} * {CLS_NOISE!r})"


def sql_label(target: str) -> str:
    if target == "planted":
        return f"({_sql_planted(PLANT_W)} + {SQL_NOISE})"
    if target == "price":
        return "(l_extendedprice / 100000.0)"
    s = sql_class_score()
    if target == "binary":
        return f"CAST(CASE WHEN {s} > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE)"
    if target == "pm1":
        return f"CAST(CASE WHEN {s} > 0 THEN 1.0 ELSE -1.0 END AS DOUBLE)"
    if target in ("multi", "multi1"):
        base = (f"CAST(CASE WHEN {s} < {MULTI_CUTS[0]!r} THEN 0.0 WHEN {s} < {MULTI_CUTS[1]!r} THEN 1.0 "
                f"ELSE 2.0 END AS DOUBLE)")
        return f"({base} + CAST(1.0 AS DOUBLE))" if target == "multi1" else base
    raise ValueError(target)


def sql_lineitem_design(target: str = "planted") -> str:
    """SELECT producing ids, label, f0..f3 (scalar columns) from lineitem."""
    feats = ", ".join(f"{e} AS f{j}" for j, e in enumerate(SQL_FEATS))
    return f"SELECT {', '.join(LINEITEM_IDS)}, {sql_label(target)} AS label, {feats} FROM lineitem"


# ------------------------------------------------------------------ tabular stand-ins

def bank_table(spark: SparkSession, sf_dir: str, with_row_key: bool = False) -> DataFrame:
    """Mixed string / numeric columns with a string label ``y`` (yes / no from the class score).
    ``with_row_key`` adds l_linenumber and l_partkey so the four lineitem key columns identify a row."""
    li = table(spark, sf_dir, "lineitem")
    extra = ["l_linenumber", "l_partkey"] if with_row_key else []
    return li.select("l_orderkey", *extra, "l_returnflag", "l_linestatus",
                     F.date_format("l_shipdate", "MMM").alias("ship_month"),
                     "l_quantity", "l_discount", "l_tax", "l_extendedprice",
                     F.when(_class_score() > 0, "yes").otherwise("no").alias("y"))


def covtype_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns and an integer label 1..3 (not 0-based, so it is re-indexed)."""
    li = table(spark, sf_dir, "lineitem")
    s = _class_score()
    lab = F.when(s < MULTI_CUTS[0], 1).when(s < MULTI_CUTS[1], 2).otherwise(3)
    return li.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber",
                     lab.alias("Cover_Type"))


# fixed values of the planted part price: 20 per size unit, 30 per character of the type name
HOUSE_SIZE_W, HOUSE_TYPE_W = 20.0, 30.0


def house_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression target with nulls injected by key; the name column is dropped like an id."""
    p = table(spark, sf_dir, "part")
    price = (F.col("p_size") * HOUSE_SIZE_W + F.length("p_type") * HOUSE_TYPE_W
             + F.pmod(F.col("p_partkey") * HASH_MUL[0], F.lit(1000)).cast("double") / 10.0)
    return p.select("p_partkey", "p_name",
                    F.when(F.col("p_partkey") % 13 == 5, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
                    .alias("p_brand"), "p_type",
                    F.when(F.col("p_partkey") % 17 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size"))
                    .alias("p_size"), "p_retailprice", price.alias("SalePrice"))


# fixed values of the planted sparse problem on the embeddings: 10 % of the 64 weights non-zero
EMB_SUPPORT = {3: 1.5, 11: -2.0, 19: 1.0, 27: -1.2, 40: 2.2, 52: -0.8}
EMB_NOISE_AMP = 0.01


def embeddings_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[vec_id, label = E w + noise(vec_id), features (64)] with a 6-sparse w."""
    e = embeddings_design(spark, sf_dir)
    f = F.col("features")
    b = None
    for j, w in EMB_SUPPORT.items():
        t = f[j] * w
        b = t if b is None else b + t
    noise = (F.pmod(F.col("vec_id") * HASH_MUL[0], F.lit(NOISE_MOD)).cast("double") / 1000.0 - 1.0) * EMB_NOISE_AMP
    return e.select("vec_id", (b + noise).alias("label"), "features")


def sql_embeddings_planted() -> str:
    """[f: DOUBLE[], label] of :func:`embeddings_planted`."""
    b = " + ".join(f"e[{j + 1}] * CAST({w!r} AS DOUBLE)" for j, w in EMB_SUPPORT.items())
    noise = f"(CAST(((vec_id * {HASH_MUL[0]}) % {NOISE_MOD}) AS DOUBLE) / 1000.0 - 1.0) * CAST({EMB_NOISE_AMP!r} AS DOUBLE)"
    return f"SELECT e AS f, {b} + {noise} AS label FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) q"
