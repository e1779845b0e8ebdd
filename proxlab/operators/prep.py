"""Feature preparation (P1-P17) on DataFrames.

Everything is a Column expression or a ``pyspark.ml`` stage, so it runs in the executors and
composes into one plan.  Category indexing collects only the vocabulary (distinct values),
guarded by ``max_categories``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import append_bias as _append_bias_col
from ..functions.vec import l2_norm

MAX_CATEGORIES = 100_000


# ---------------------------------------------------------------- P1-P3
def clean(df: DataFrame, drop: list[str] = (), label: str | None = None, how: str = "any") -> DataFrame:
    """P1 drop id columns, P2 drop rows with any null, P3 rename the target to ``label``."""
    out = df.drop(*drop) if drop else df
    out = out.na.drop(how=how)
    if label is not None and label != "label":
        out = out.withColumnRenamed(label, "label")
    return out


# ---------------------------------------------------------------- P4-P5
@dataclass(frozen=True)
class ColumnRoles:
    categorical: list[str]
    numeric: list[str]
    label: str


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType, T.BooleanType)


def column_roles(schema: T.StructType, label: str, exclude: list[str] = (),
                 exclude_substring: bool = False) -> ColumnRoles:
    """String -> categorical, numeric/bool -> numeric; P5: drop the label (exact name by default;
    ``exclude_substring=True`` reproduces a substring test).  Other types raise."""
    cat, num = [], []
    for f in schema.fields:
        name = f.name
        if name in exclude:
            continue
        if (label in name) if exclude_substring else (name == label):
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(name)
        elif isinstance(f.dataType, _NUMERIC):
            num.append(name)
        else:
            raise TypeError(f"column {name!r} has unsupported type {f.dataType.simpleString()}")
    return ColumnRoles(cat, num, label)


def roles_rows(roles: ColumnRoles) -> list[tuple[str, str]]:
    return ([(c, "categorical") for c in roles.categorical] + [(c, "numeric") for c in roles.numeric]
            + [(roles.label, "label")])


# ---------------------------------------------------------------- P6-P9
def _check_cardinality(df: DataFrame, cols: list[str], max_categories: int) -> None:
    if not cols:
        return
    r = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    big = {c: r[c] for c in cols if r[c] > max_categories}
    if big:
        raise ValueError(f"category columns exceed max_categories={max_categories}: {big}")


def category_indexer(cols: list[str], suffix: str = "_idx", handle_invalid: str = "keep") -> StringIndexer:
    """Frequency-descending index (ties alphabetical), null/unseen -> extra last bucket."""
    return StringIndexer(inputCols=cols, outputCols=[c + suffix for c in cols],
                         handleInvalid=handle_invalid, stringOrderType="frequencyDesc")


def label_indexer(col: str, out: str = "label") -> StringIndexer:
    """Label string -> index; an unseen label is an error."""
    return StringIndexer(inputCol=col, outputCol=out, handleInvalid="error", stringOrderType="frequencyDesc")


def one_hot(cols: list[str], suffix: str = "_vec", drop_last: bool = True,
            outputs: list[str] | None = None) -> OneHotEncoder:
    """One-hot with the last bucket dropped (with P6 'keep' that is the invalid bucket)."""
    return OneHotEncoder(inputCols=cols, outputCols=outputs or [c + suffix for c in cols], dropLast=drop_last,
                         handleInvalid="keep")


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    """Numeric ++ encoded columns, in that order."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error")


def feature_stages(df: DataFrame, roles: ColumnRoles, index_label: bool = False,
                   max_categories: int = MAX_CATEGORIES) -> list:
    """[label indexer] ++ indexers ++ encoders ++ assembler (the tabular pipeline prefix)."""
    _check_cardinality(df, roles.categorical + ([roles.label] if index_label else []), max_categories)
    stages = []
    if index_label:
        stages.append(label_indexer(roles.label, "label_idx"))
    idx_cols = [c + "_idx" for c in roles.categorical]
    vec_cols = [c + "_vec" for c in roles.categorical]
    if roles.categorical:
        stages.append(category_indexer(roles.categorical))
        stages.append(one_hot(idx_cols, outputs=vec_cols))
    stages.append(assembler(roles.numeric + vec_cols))
    return stages


# ---------------------------------------------------------------- P10-P14
def append_bias(df: DataFrame, features: str = "features", value: float = 1.0) -> DataFrame:
    """P10: constant 1 appended as the last feature."""
    return df.withColumn(features, _append_bias_col(features, value))


def normalize_rows(df: DataFrame, features: str = "features", label: str = "label",
                   n: int | None = None) -> DataFrame:
    """Divide features and label by ||a||_2; a zero-norm row gets nulls (not inf/NaN).

    With a known width ``n`` the norm and the division are unrolled into plain Column
    expressions (whole-stage codegen) instead of per-element lambdas; same arithmetic order."""
    f = F.col(features)
    if n is None:
        nrm = l2_norm(features)
    else:
        nrm = F.sqrt(sum((f[j] * f[j] for j in range(n)), F.lit(0.0)))
    safe = F.when(nrm > 0, nrm)
    out = df.withColumn("_norm", safe).withColumn(label, F.col(label) / F.col("_norm"))
    if n is None:
        out = out.withColumn(features, F.transform(features, lambda v: v / F.col("_norm")))
    else:
        out = out.withColumn(features, F.array(*[f[j] / F.col("_norm") for j in range(n)]))
    return out.drop("_norm")


def score_to_class(score, threshold: float = 0.5) -> Column:
    """``score < threshold`` -> 0 else 1."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < threshold, F.lit(0.0)).otherwise(F.lit(1.0))


def labels_to_01(label) -> Column:
    """-1/+1 (or 0/1) -> 0/1 via ``label <= 0 -> 0``."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c <= 0, F.lit(0.0)).otherwise(F.lit(1.0))


def check_binary_labels(df: DataFrame, label: str = "label") -> list[float]:
    """The class set must be {0,1} or {-1,1} (Q9); returns it (at most 2 values collected)."""
    vals = sorted(r[0] for r in df.select(label).distinct().limit(3).collect())
    if len(vals) > 2 or not set(vals) <= {0.0, 1.0, -1.0} or set(vals) == {-1.0, 0.0}:
        raise ValueError(f"labels {vals} are not a binary 0/1 or -1/+1 set")
    return vals


def split_weights(w) -> tuple[list[float], float]:
    """Weight vector with appended bias -> (coefficients, intercept)."""
    w = list(map(float, w))
    return w[:-1], w[-1]


# ---------------------------------------------------------------- P15-P17
def hash_split_col(key: str, train_pct: int, seed: int, mul: int = 7919) -> Column:
    """Deterministic split independent of partitioning: pmod(key*mul + seed, 100) < pct."""
    return key_hash(key, 100, seed, mul) < train_pct


def key_hash(key: str, modulus: int, seed: int, mul: int = 7919) -> Column:
    """pmod(key*mul + seed, modulus); the key is reduced first, so that no key overflows."""
    return F.pmod(F.pmod(F.col(key).cast("long"), F.lit(modulus)) * mul + seed, F.lit(modulus))


def random_split(df: DataFrame, weights=(0.6, 0.4), seed: int = 11) -> list[DataFrame]:
    """Spark's randomSplit (depends on partitioning; hash_split_col gives reproducible splits)."""
    return df.randomSplit(list(weights), seed)
