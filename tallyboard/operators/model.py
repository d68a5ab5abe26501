"""Score forecasts with spark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

from tallyboard.functions import scoring
from tallyboard.operators.evaluate import regression_metrics
from tallyboard.session import stage

TARGETS = ("homeTeamScore", "awayTeamScore")
NOT_FEATURES = (*TARGETS, "lastPeriod")


def feature_columns(df: DataFrame) -> list[str]:
    """Sorted names of all columns but the targets."""
    return sorted(c for c in df.columns if c not in NOT_FEATURES)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _indexer(columns: Sequence[str], suffix: str) -> StringIndexer:
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}{suffix}" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )


def _require_bounded(df: DataFrame, columns: Sequence[str], limit: int) -> None:
    """Refuse columns whose labels are too many for a fitted pipeline, which holds them in one place."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if counts[c] > limit]
    if wide:
        raise ValueError(f"more than {limit} distinct labels in {wide}; drop these columns first")


def _codes(df: DataFrame, column: str) -> DataFrame:
    """label, code: the distinct values of a column numbered from 0 in order.

    Labels are range-partitioned, numbered within each part, and moved on by the
    sizes of the parts before it, so none of it is in one place.
    """
    labels = df.select(F.col(column).alias("label")).where(F.col("label").isNotNull()).distinct()
    # Written out, so that a label's part is settled.
    labels = stage(labels.repartitionByRange("label").withColumn("_part", F.spark_partition_id()), "labels")
    parts = labels.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("label")) - 1
    return labels.withColumn("_place", within).join(offsets, "_part").select(
        "label", (F.col("_place") + F.col("_offset")).alias("code")
    )


def encode_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordinal codes of columns by sorted value, as `<column>Code`; nulls come last."""
    out = df
    for column in columns:
        codes = _codes(df, column)
        missing = codes.agg(F.count(F.lit(1)).alias("n")).scalar()
        codes = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        out = out.join(codes, out[column] == F.col("_label"), "left").withColumn(
            f"{column}Code", F.coalesce("_code", missing).cast("double")
        ).drop("_label", "_code")
    return out


def forecaster(
    df: DataFrame,
    n_trees: int = 100,
    max_depth: int = 10,
    seed: int | None = 42,
    feature_subset: str = "all",
    bootstrap: bool = True,
) -> Pipeline:
    """Unfitted pipeline from a feature set to one predicted score per side.

    Every split looks at all features by default. `max_depth` goes up to 30, the
    library's limit; a forest of depth 0 without bootstrap predicts the mean.

    Dates become day numbers. A missing feature gets the value -1, below every
    real value of these features, so a tree can send it its own way.
    """
    names = feature_columns(df)
    texts = [c for c in text_columns(df) if c in names]
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> str:
        if c in texts:
            return f"`{c}_code` AS `{c}_x`"
        value = f"unix_date(`{c}`)" if isinstance(kinds[c], DateType) else f"`{c}`"
        return f"coalesce(CAST({value} AS DOUBLE), -1.0D) AS `{c}_x`"

    stages = [
        _indexer(texts, "_code"),
        SQLTransformer(statement=f"SELECT *, {', '.join(number(c) for c in names)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_x" for c in names], outputCol="features"),
    ]
    for target in TARGETS:
        forest = RandomForestRegressor(
            featuresCol="features",
            labelCol=target,
            predictionCol=f"{target}_predicted",
            numTrees=n_trees,
            maxDepth=max_depth,
            featureSubsetStrategy=feature_subset,
            bootstrap=bootstrap,
        )
        stages.append(forest if seed is None else forest.setSeed(seed))
    return Pipeline(stages=stages)


def _scored(df: DataFrame) -> DataFrame:
    return df.where(F.col(TARGETS[0]).isNotNull() & F.col(TARGETS[1]).isNotNull())


def _fitted(features: DataFrame, seeds: Sequence[int | None], max_labels: int = 100_000, **forest) -> list[PipelineModel]:
    """A fitted forecaster for each seed. All forests read the same vectors, which are made and stored once."""
    texts = text_columns(features.select(*feature_columns(features)))
    _require_bounded(features, texts, max_labels)
    known, n = _scored(features), len(TARGETS)
    coded = Pipeline(stages=forecaster(features, **forest).getStages()[:-n]).fit(known)
    rows = stage(coded.transform(known).select("features", *TARGETS), "vectors")
    return [
        PipelineModel([*coded.stages, *[f.fit(rows) for f in forecaster(features, seed=seed, **forest).getStages()[-n:]]])
        for seed in seeds
    ]


def train_scores(features: DataFrame, max_labels: int = 100_000, **forest) -> PipelineModel:
    """Fit the forecaster on the played games. Save it with `model.write().save(path)`.

    `forest` goes to `forecaster`. The fitted pipeline holds the distinct labels of
    the text columns; a column with more than `max_labels` is refused, and can be
    encoded by `encode_columns` first.
    """
    return _fitted(features, [forest.pop("seed", 42)], max_labels, **forest)[0]


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The rows of a feature set with both predicted scores."""
    out = model.transform(features)
    return out.select(*features.columns, *[f"{t}_predicted" for t in TARGETS])


def call_result(predicted: DataFrame) -> DataFrame:
    """Scores and period of forecast games: a narrow margin is overtime, a tie goes home."""
    home, away = (F.col(f"{t}_predicted") for t in TARGETS)
    return predicted.withColumns(
        {
            "homeTeamScore": scoring.break_tie(home, away),
            "awayTeamScore": away,
            "lastPeriod": scoring.call_period(home, away),
        }
    ).drop(*[f"{t}_predicted" for t in TARGETS])


def score_games(features: DataFrame, model: PipelineModel) -> DataFrame:
    """The feature set with forecasts in the place of missing results."""
    is_open = F.col("homeTeamScore").isNull() | F.col("lastPeriod").isNull()
    forecast = call_result(predict(model, features.where(is_open)))
    return features.where(~is_open).unionByName(forecast)


def holdout_metrics(features: DataFrame, season: str, runs: int = 1, seed: int | None = 42, **forest) -> DataFrame:
    """Error, R² and outcome accuracy on one season of models fitted on the others.

    The plain mean over `runs` forests, whose seeds count up from `seed`.
    """
    known, unseen = features.where(F.col("seasonName") != season), _scored(features.where(F.col("seasonName") == season))
    every = None
    for model in _fitted(known, [None if seed is None else seed + i for i in range(runs)], **forest):
        one = regression_metrics(predict(model, unseen), targets=[(t, f"{t}_predicted") for t in TARGETS])
        every = one if every is None else every.union(one)
    return every.agg(*[F.avg(c).cast(t).alias(c) for c, t in every.dtypes])
