"""Evaluation (E1-E10): binary curves and areas, multiclass and regression metrics.

Binary curves need, for every distinct score s, the number of positives and negatives with
score >= s -- a global running sum.  A window ordered over the whole table would pull every
row into one task, so the scan is done in two levels:

1. ``groupBy(score)`` -> one row per distinct score with (pos, neg)  (map-side partial counts)
2. ordered buckets from quantile bounds of the distinct scores, and per-bucket totals
3. offsets = exclusive running sum of the bucket totals (at most P rows: a proven bound),
   broadcast back; within each bucket a running window adds the local counts.

The trapezoid for the point k only needs the point before it, which is the cumulative count
minus the row's own counts -- no lag across partitions is necessary.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 1_000_000


def prefix_sums(df: DataFrame, order_col: str, cols: list[str], descending: bool = True,
                num_partitions: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order_col`` order, as ``cum_<col>`` columns
    (plus the grand totals as constant ``tot_<col>`` columns).

    ``order_col`` must be unique per row (aggregate ties first).  Rows are cut into ordered
    buckets (about ``rows_per_bucket`` rows each, sized from a count) by quantile bounds of ``order_col`` (collected once, so the bucket of a row is a
    pure function of its value and any recomputation after a lost executor agrees); each
    bucket is scanned by a window partitioned on the bucket id, and the exclusive running sum
    of the bucket totals (one row per bucket: a proven bound) is broadcast back as offsets.
    """
    spark = df.sparkSession
    # the input (one row per distinct value) is scanned for its size, its cuts, its totals and the result
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if num_partitions:
        P = num_partitions
    else:
        # enough buckets that none holds more than ~rows_per_bucket rows; the bucket totals
        # (P rows) are what crosses to the driver
        rows = df.count()
        P = min(max(1, -(-rows // rows_per_bucket)), MAX_BUCKETS)
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    probs = [i / P for i in range(1, P)]
    bounds = sorted(set(df.approxQuantile(order_col, probs, 1.0 / (4 * P)))) if probs else []
    splits = [-float("inf")] + [b for b in bounds if math.isfinite(b)] + [float("inf")]
    nb = len(splits) - 1
    if nb == 1:
        bucketed = df.withColumn("_pid", F.lit(0))
    else:
        bucket = Bucketizer(splits=splits, inputCol=order_col, outputCol="_bkt", handleInvalid="keep")
        pid = (F.lit(nb - 1) - F.col("_bkt")) if descending else F.col("_bkt")
        bucketed = bucket.transform(df).withColumn("_pid", pid.cast("int")).drop("_bkt")
    totals = bucketed.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols]).collect()  # <= nb rows
    run = {c: 0 for c in cols}
    offsets = []
    for r in sorted(totals, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], *[run[c] for c in cols]))
        for c in cols:
            run[c] += r[c] or 0
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField("_pid", T.IntegerType())]
                          + [T.StructField(f"_off_{c}", types[c]) for c in cols])
    off_df = spark.createDataFrame(offsets, schema)
    w = Window.partitionBy("_pid").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select(*df.columns, "_pid", *[F.sum(c).over(w).alias(f"_loc_{c}") for c in cols])
    out = local.join(F.broadcast(off_df), "_pid")
    return out.select(*df.columns, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols],
                      *[F.lit(run[c]).cast(types[c]).alias(f"tot_{c}") for c in cols])


def unusable(score, label) -> Column:
    """Rows that no curve can use: null or NaN score or label."""
    s, y = _c(score).cast("double"), _c(label).cast("double")
    return s.isNull() | F.isnan(s) | y.isNull() | F.isnan(y)


def unusable_counts(df: DataFrame, score, label) -> DataFrame:
    """``[n_rows, n_bad_score, n_bad_label, n_used]``: what ``invalid="skip"`` leaves out."""
    s, y = _c(score).cast("double"), _c(label).cast("double")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), n(s.isNull() | F.isnan(s)).alias("n_bad_score"),
                  n(y.isNull() | F.isnan(y)).alias("n_bad_label"), n(~unusable(score, label)).alias("n_used"))


def binary_points(df: DataFrame, score, label, num_partitions: int | None = None, invalid: str = "raise") -> DataFrame:
    """One row per distinct score: ``[threshold, pos, neg, tp, fp, P, N]``
    (tp/fp = counts with score >= t; P/N = class totals).

    Null or NaN scores and labels raise; with ``invalid="skip"`` they are left out, and
    :func:`unusable_counts` says how many."""
    if invalid not in ("raise", "skip"):
        raise ValueError(f"unknown invalid={invalid!r}")
    s, bad = _c(score).cast("double"), unusable(score, label)
    rows = df.filter(~bad) if invalid == "skip" else df
    if invalid == "raise":
        s = F.when(bad, F.raise_error(F.lit("null or NaN score or label"))).otherwise(s)
    agg = (rows.select(s.alias("threshold"), _c(label).cast("double").alias("y"))
           .groupBy("threshold")
           .agg(F.sum(F.when(F.col("y") > 0.5, 1).otherwise(0)).cast("long").alias("pos"),
                F.sum(F.when(F.col("y") > 0.5, 0).otherwise(1)).cast("long").alias("neg")))
    cum = prefix_sums(agg, "threshold", ["pos", "neg"], descending=True, num_partitions=num_partitions)
    return (cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")
            .withColumnRenamed("tot_pos", "P").withColumnRenamed("tot_neg", "N"))


def binary_areas(points: DataFrame) -> DataFrame:
    """``[auc_roc, auc_pr, n_pos, n_neg]`` from :func:`binary_points` (null when one class is absent).

    ROC: (0,0) + points + (1,1), trapezoids.  PR: (0, precision of the first point) + points.
    """
    p = points
    prev_tp = F.col("tp") - F.col("pos")
    prev_fp = F.col("fp") - F.col("neg")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    prev_prec = F.when(prev_tp + prev_fp > 0, prev_tp / (prev_tp + prev_fp)).otherwise(prec)
    roc_term = F.col("neg") * (2 * F.col("tp") - F.col("pos"))
    pr_term = (F.col("pos") / F.col("P")) * (prec + prev_prec) / 2.0
    a = p.agg(F.sum(roc_term.cast("double")).alias("roc"), F.sum(pr_term).alias("pr"),
              F.first("P").alias("P"), F.first("N").alias("N"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return a.select(F.when(ok, F.col("roc") / (2.0 * F.col("P") * F.col("N"))).alias("auc_roc"),
                    F.when(ok, F.col("pr")).alias("auc_pr"),
                    F.col("P").alias("n_pos"), F.col("N").alias("n_neg"))


def threshold_metrics(points: DataFrame, beta: float = 1.0) -> DataFrame:
    """``[threshold, precision, recall, f_measure]`` per distinct score."""
    p = points
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P"))
    b2 = beta * beta
    f = F.when((prec + rec) > 0, (1 + b2) * prec * rec / (b2 * prec + rec)).otherwise(F.lit(0.0))
    return p.select("threshold", prec.alias("precision"), rec.alias("recall"), f.alias("f_measure"))


def multiclass_metrics(df: DataFrame, prediction="prediction", label="label") -> DataFrame:
    """Accuracy and label-frequency-weighted precision / recall / F1 from one confusion
    aggregation (``groupBy(label, prediction)``: at most K^2 groups)."""
    conf = (df.select(_c(label).cast("double").alias("y"), _c(prediction).cast("double").alias("p"))
            .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))
    by_label = conf.groupBy("y").agg(F.sum("n").alias("n_y"),
                                     F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy("p").agg(F.sum("n").alias("n_p"))
    k = by_label.join(by_pred, by_label["y"] == by_pred["p"], "left").select("y", "n_y", "tp", "n_p")
    prec = F.when(F.coalesce(F.col("n_p"), F.lit(0)) > 0, F.col("tp") / F.col("n_p")).otherwise(F.lit(0.0))
    rec = F.col("tp") / F.col("n_y")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    a = k.agg(F.sum("tp").alias("tp"), F.sum("n_y").alias("total"), F.sum(prec * F.col("n_y")).alias("wp"),
              F.sum(rec * F.col("n_y")).alias("wr"), F.sum(f1 * F.col("n_y")).alias("wf"))
    t = F.col("total")
    return a.select((F.col("tp") / t).alias("accuracy"), (F.col("wp") / t).alias("weighted_precision"),
                    (F.col("wr") / t).alias("weighted_recall"), (F.col("wf") / t).alias("weighted_f1"))


def regression_metrics(df: DataFrame, prediction="prediction", label="label") -> DataFrame:
    """Rmse, mse, mae, r2 (1 - SS_err / SS_tot) in one aggregation."""
    e = _c(prediction) - _c(label)
    a = df.agg(F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.count(F.lit(1)).alias("n"),
               F.var_pop(_c(label)).alias("var_y"))
    return a.select(F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sse") / F.col("n")).alias("mse"),
                    (F.col("sae") / F.col("n")).alias("mae"),
                    (1.0 - F.col("sse") / (F.col("var_y") * F.col("n"))).alias("r2"))


def pr_curve(points: DataFrame) -> DataFrame:
    """E2 curve: ``[recall, precision]`` per distinct score plus the leading (0, first precision)."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P"))
    curve = points.select(rec.alias("recall"), prec.alias("precision"))
    first = (points.filter((F.col("tp") - F.col("pos") == 0) & (F.col("fp") - F.col("neg") == 0))
             .select(F.lit(0.0).alias("recall"), prec.alias("precision")))
    return first.unionByName(curve)
