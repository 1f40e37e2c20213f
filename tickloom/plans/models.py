"""Tabular models through pyspark.ml and batch scoring with any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.plans import metrics
from tickloom.session import durable, stored


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def fit_trees(train: DataFrame, features: Sequence[str], *, label: str = "y_log_return", time: str = "anchor_ts",
              tail: float = 0.1, rounds: int = 50, depth: int = 5, rate: float = 0.05, seed: int = 0):
    """Boosted trees with the latest ``tail`` of the train rows held out for early stopping.

    The cut is an instant, found from per-instant counts.
    """
    from pyspark.ml.regression import GBTRegressor

    from tickloom.plans.conformal import chronological_parts

    rows = chronological_parts(train.drop("part").withColumn("_one", F.lit(0)), by=["_one"], time=time, frac=1 - tail)
    data = _assemble(rows.withColumn("is_val", F.col("part") == "test"), features).select("features", label, "is_val")
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
                        validationIndicatorCol="is_val").fit(data)


def fit_predict(parts: DataFrame, features: Sequence[str], **kw) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Test rows with ``prediction``, and the fifty most important features."""
    parts = durable(parts)  # many passes follow: derive the matrix once
    model = fit_trees(parts.filter("part = 'train'"), features, **kw)
    scored = model.transform(_assemble(parts.filter("part = 'test'"), features)).drop("features")
    imp = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return scored, imp[:50]


def fold_metrics(scored: DataFrame, *, label: str = "y_log_return", time: str = "anchor_ts") -> DataFrame:
    """Rank IC and decile spread of the predictions (one row)."""
    ic = metrics.ic_summary(metrics.rank_ic_by_group(scored, [time], "prediction", label)).withColumn("_j", F.lit(0))
    sp = metrics.decile_spread_bps(scored, [time], "prediction", label).select("spread_bps", F.lit(0).alias("_j"))
    return ic.join(sp, "_j").drop("_j")


def win_probability(train: DataFrame, test: DataFrame, features: Sequence[str], win: Column, *, kind: str = "lr", seed: int = 0) -> DataFrame:
    """Test rows with ``prob`` of the win condition; scaled logistic regression or boosted trees."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    data = _assemble(train.withColumn("win", win.cast("double")), features)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data)
    est = (GBTClassifier(featuresCol="scaled", labelCol="win", maxIter=50, maxDepth=3, stepSize=0.1, seed=seed) if kind == "gbm"
           else LogisticRegression(featuresCol="scaled", labelCol="win", maxIter=500, regParam=0.0))
    model = est.fit(scaler.transform(data))
    out = model.transform(scaler.transform(_assemble(test, features)))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")


BLOCK = "lo double, hi double, s double, n double, part int"


def _pooled(blocks: DataFrame, parts: int) -> DataFrame:
    """Range-partition blocks and pool adjacent violators inside each part."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        for batch in batches:
            for lo, hi, s, n in zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "s", "n")]):
                while out and out[-1][2] * n >= s * out[-1][3]:
                    lo, s, n = out[-1][0], s + out[-1][2], n + out[-1][3]
                    out.pop()
                out.append((lo, hi, s, n))
        for i in range(0, len(out), 100_000):
            cols = list(zip(*out[i:i + 100_000]))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.float64()) for c in cols], pa.array([part] * len(cols[0]), pa.int32())],
                                             ["lo", "hi", "s", "n", "part"])

    return blocks.select("lo", "hi", "s", "n").repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(run, BLOCK)


def isotonic_blocks(train: DataFrame, *, pred: str, win: Column, part_rows: int = 500_000) -> DataFrame:
    """Blocks (``lo``, ``hi``, ``s`` wins of ``n`` rows) of the least-squares monotone fit, by distributed pooling.

    Equal predictions are summed first. Parts of at most about ``part_rows`` blocks are pooled each by itself; the blocks
    that are left are cut anew, at other places, until no two neighbours violate the order. Pooling in any order ends in
    the same blocks, so the result equals that of one pass. Only counts reach the driver. Rows whose prediction or
    outcome is null or NaN are left out.
    """
    rows = train.select(F.col(pred).cast("double").alias("lo"), win.cast("double").alias("y")).filter("lo IS NOT NULL AND NOT isnan(lo) AND y IS NOT NULL")
    # -0.0 and 0.0 are one prediction
    blocks = stored(rows.groupBy((F.col("lo") + 0.0).alias("lo")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("n")).select(
        "lo", F.col("lo").alias("hi"), "s", "n"), "isotonic")
    left, turn = blocks.count(), 0
    while True:
        # i / p and j / (p + 1) never meet: every other round cuts between the borders of the last
        parts = -(-left // part_rows) or 1
        blocks = stored(_pooled(blocks, parts + turn % 2 if parts > 1 else 1), "isotonic")
        left, turn = blocks.count(), turn + 1
        edge = blocks.groupBy("part").agg(F.min_by(F.col("s") / F.col("n"), "lo").alias("first"), F.max_by(F.col("s") / F.col("n"), "lo").alias("last"))
        clash = edge.withColumn("before", F.lag("last").over(Window.orderBy("part"))).filter(F.col("before") >= F.col("first"))
        if parts == 1 or clash.isEmpty():
            return blocks.drop("part")


def isotonic(train: DataFrame, test: DataFrame, *, pred: str, win: Column, part_rows: int = 500_000) -> DataFrame:
    """Test rows with a monotone calibrated ``prob``: linear between blocks, clipped to the fitted range.

    Distinct test predictions and blocks share range parts; what a part needs of its neighbours is one
    block on each side. Without a usable train row, or for a null or NaN prediction, ``prob`` is null.
    """
    blocks = isotonic_blocks(train, pred=pred, win=win, part_rows=part_rows)
    x = F.col(pred).cast("double") + 0.0
    ask = test.select(x.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").distinct().withColumn("b", F.lit(None).cast("struct<lo:double,hi:double,p:double>"))
    known = blocks.select(F.col("lo").alias("x"), F.struct("lo", "hi", (F.col("s") / F.col("n")).alias("p")).alias("b"))
    both = stored(ask.unionByName(known).repartitionByRange("x").withColumn("part", F.spark_partition_id()), "isotonic")
    order = Window.orderBy("part")  # one row a part
    edge = both.groupBy("part").agg(F.min("b").alias("first"), F.max("b").alias("last"))
    edge = edge.select("part", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                       F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # a block stands before the equal prediction it starts at
    w = Window.partitionBy("part").orderBy("x", F.col("b").isNull())
    back = Window.partitionBy("part").orderBy(F.desc("x"), F.desc(F.col("b").isNull())).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumns({"at": F.last("b", True).over(w), "next": F.last("b", True).over(back)})
    near = near.filter("b IS NULL").join(edge, "part").select("x", F.coalesce("at", "before").alias("at"), F.coalesce("next", "after").alias("next"))
    step = (F.col("x") - F.col("at.hi")) / (F.col("next.lo") - F.col("at.hi"))
    prob = (F.when(F.col("at").isNull(), F.col("next.p")).when((F.col("x") <= F.col("at.hi")) | F.col("next").isNull(), F.col("at.p"))
            .otherwise(F.col("at.p") + step * (F.col("next.p") - F.col("at.p"))))
    fitted = near.select(F.col("x").alias("_x"), prob.alias("prob"))
    return test.withColumn("_x", x).join(fitted, "_x", "left").drop("_x")


def brier(scored: DataFrame, win: Column, by: Sequence[str] = ()) -> DataFrame:
    e = F.col("prob") - win.cast("double")
    return scored.groupBy(*by).agg(F.avg(e * e).alias("brier"), F.count(F.lit(1)).alias("n"))


def score_batches(rows: DataFrame, predict: Callable[["object"], "object"], horizons: Sequence[str], *, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long predictions from any batch model.

    ``predict`` takes a pandas batch of ``columns`` and returns one column per horizon;
    ``rows`` also carries ``labels``/``label_valid`` arrays in horizon order, and only
    valid labels come out.
    """
    from pyspark.sql import types as T

    keep = [*keys, "labels", "label_valid"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("_preds", T.ArrayType(T.DoubleType()))])
    cols = list(columns)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            out = pdf[keep].copy()
            out["_preds"] = list(np.asarray(predict(pdf[cols]), dtype="float64"))
            yield out

    done = rows.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)
    names = F.array(*[F.lit(h) for h in horizons])
    each = F.explode(F.arrays_zip(names.alias("horizon"), F.col("_preds").alias("pred_lr"), F.col("labels").alias("real_lr"), F.col("label_valid").alias("ok")))
    return done.select(*keys, each.alias("x")).select(*keys, "x.*").filter("ok").drop("ok")
