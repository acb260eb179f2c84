"""Features, episode splits, training, evaluation and batch inference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.operators.asof import asof
from dnslens.operators.scans import bounded_windows

if TYPE_CHECKING:
    from pyspark.ml import PipelineModel


def features(
    t: DataFrame,
    keys: Sequence[str],
    col: str,
    lags: Sequence[int] = (1, 2, 3),
    spans: Sequence[int] = (5, 20),
    t_us: str = "t_us",
    cell_us: int = 3_600_000_000,
) -> DataFrame:
    """Lagged values and rolling mean and maximum of the rows *before* the current one."""
    def exprs(w):
        out = {f"lag_{n}": F.lag(col, n).over(w) for n in lags}
        for n in spans:
            past = w.rowsBetween(-n, -1)
            out[f"avg_{n}"] = F.avg(col).over(past)
            out[f"max_{n}"] = F.max(col).over(past)
        return out

    return bounded_windows(t, keys, t_us, max([*lags, *spans]), exprs, cell=cell_us)


def build_dataset(
    rates: DataFrame,
    keys: Sequence[str],
    col: str,
    lags: Sequence[int] = (1, 2, 3),
    spans: Sequence[int] = (6,),
    t_us: str = "t_us",
    cell_us: int = 3_600_000_000,
    baselines: Sequence[str] = (),
) -> DataFrame:
    """Features per row and ``label``: the value of the next window of the same key.

    ``keys`` contains ``episode_id``, so neither features nor labels cross episodes. Rows
    without a full history or without a next window are left out. ``baselines`` are columns
    kept as they were at the row (``b_<name>``), to be compared with but not learned from.
    """
    # The label is a look ahead by one row; shifting by one turns it into a look back.
    def exprs(w):
        out = {f"f_lag_{n}": F.lag(col, n + 1).over(w) for n in lags}
        out["f_now"] = F.lag(col, 1).over(w)
        out["at_us"] = F.lag(t_us, 1).over(w)
        out.update({f"b_{c}": F.lag(c, 1).over(w) for c in baselines})
        for n in spans:
            past = w.rowsBetween(-(n + 1), -2)
            out[f"f_avg_{n}"] = F.avg(col).over(past)
            out[f"f_max_{n}"] = F.max(col).over(past)
        return out

    names = [f"f_lag_{n}" for n in lags] + ["f_now"] + [f"f_{k}_{n}" for n in spans for k in ("avg", "max")]
    wide = bounded_windows(rates, keys, t_us, max([*lags, *spans]) + 1, exprs, cell=cell_us)
    passed = [c for c in rates.columns if c not in (col, t_us, *keys, *baselines)] + [f"b_{c}" for c in baselines]
    return wide.select(*keys, *passed, F.col("at_us").alias(t_us), *names, F.col(col).alias("label")).dropna(
        subset=[*names, "label"]
    )


def feature_names(t: DataFrame) -> list[str]:
    return sorted(c for c in t.columns if c.startswith("f_"))


def write_dataset(t: DataFrame, path: str) -> None:
    """Store a dataset partitioned by episode."""
    t.repartition("episode_id").write.mode("overwrite").partitionBy("episode_id").parquet(path)


def split_episodes(
    t: DataFrame, seed: int, shares: tuple[float, float] = (0.7, 0.15), held_out: Sequence[str] = ()
) -> DataFrame:
    """Add ``split`` by episode: train, val or test; held-out fault types are always test.

    The choice depends on (seed, episode) only, so an episode never falls in two splits.
    """
    from dnslens.functions.hashing import uniform

    u = uniform(seed, F.col("episode_id"), 0)
    split = (
        F.when(u < shares[0], F.lit("train")).when(u < shares[0] + shares[1], F.lit("val")).otherwise(F.lit("test"))
    )
    if held_out:
        split = F.when(F.col("fault_type").isin(*held_out), F.lit("test")).otherwise(split)
    return t.withColumn("split", split)


def train(t: DataFrame, algo: str = "linear", seed: int = 7):
    """Fit a regressor on the training split; returns a pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    assembler = VectorAssembler(inputCols=feature_names(t), outputCol="features")
    if algo == "linear":
        model = LinearRegression(featuresCol="features", labelCol="label", predictionCol="predicted_us", regParam=0.1)
    elif algo == "gbt":
        model = GBTRegressor(
            featuresCol="features", labelCol="label", predictionCol="predicted_us", seed=seed, maxIter=20, maxDepth=4
        )
    else:
        raise ValueError(f"unknown algorithm {algo!r}")
    return Pipeline(stages=[assembler, model]).fit(t.filter("split = 'train'"))


def predict(model, t: DataFrame) -> DataFrame:
    """Batch inference: adds ``predicted_us``; also usable per micro-batch."""
    return model.transform(t).drop("features")


class Predictor(Protocol):
    """Adds ``predicted_us`` to rows of features. Score and sinks never ask which one it is."""

    def predict(self, t: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Fitted:
    """A trained pipeline."""

    model: PipelineModel

    def predict(self, t: DataFrame) -> DataFrame:
        return predict(self.model, t)


@dataclass(frozen=True)
class TrailingMean:
    """Mean of the last ``span`` values of each key, the present one included (binned input)."""

    keys: Sequence[str]
    col: str
    t_us: str
    cell: int
    span: int = 3

    def predict(self, t: DataFrame) -> DataFrame:
        def exprs(w):
            return {"predicted_us": F.avg(self.col).over(w.rowsBetween(1 - self.span, 0))}

        return bounded_windows(t, self.keys, self.t_us, self.span, exprs, cell=self.cell)


def with_estimates(
    t: DataFrame, published: DataFrame, keys: Sequence[str], t_us: str, issued_us: str, fallback: str, *, cell_us: int
) -> DataFrame:
    """Add ``predicted_us``: the last prediction published for the key by then, ``fallback`` before the first.

    Of predictions with the same key and instant the greatest counts.
    """
    rows = published.groupBy(*keys, issued_us).agg(F.max("predicted_us").alias("predicted_us"))
    found = asof(t, rows, t_us, issued_us, ["predicted_us"], keys, cell_us=cell_us)
    return found.withColumn("predicted_us", F.coalesce("predicted_us", fallback))


def evaluate(pred: DataFrame) -> DataFrame:
    """Mean absolute error by split of the model and its baselines.

    Persistence predicts the current value; the decayed average takes part where the
    dataset carries it (``b_ewma``). The test split is reported, never tuned on.
    """
    from dnslens.operators.experiments import mae_report

    t = pred.withColumnsRenamed({"predicted_us": "model", "f_now": "persistence", "b_ewma": "ewma"})
    names = [c for c in ("model", "persistence", "ewma") if c in t.columns]
    return mae_report(t, "label", names, ["split"])


def dataset_hash(t: DataFrame) -> DataFrame:
    """One row: an order-free hash of all rows and their number."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(t.columns)]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("decimal(20,0)")
    total = F.sum(part)
    return t.agg(F.lower(F.hex(F.pmod(total, F.lit(2**48)).cast("long"))).alias("dataset_hash"), F.count("*").alias("rows"))


def model_card(t: DataFrame, pred: DataFrame, seed: int, algo: str) -> DataFrame:
    """The model card as one JSON document in a one-row frame."""
    metrics = evaluate(pred).agg(F.collect_list(F.struct("split", "predictor", "mae")).alias("metrics"))
    head = dataset_hash(t).withColumns(
        {
            "seed": F.lit(seed),
            "algorithm": F.lit(algo),
            "feature_schema": F.array(*[F.lit(f) for f in feature_names(t)]),
        }
    )
    # Both sides are single rows; the constant key only lines them up.
    both = head.withColumn("one", F.lit(1)).join(metrics.withColumn("one", F.lit(1)), "one")
    return both.select(
        F.to_json(F.struct("seed", "algorithm", "dataset_hash", "rows", "feature_schema", "metrics")).alias("card")
    )
