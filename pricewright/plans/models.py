"""Forecast queries over the full weekly panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.columns import settled
from pricewright.operators import forecast, kernels, sampling
from pricewright.plans.market_panels import BBOX, CVR, PANEL_SQL, columns_of, market_panel
from pricewright.plans.registry import query
from pricewright.sources.steps import stored

#: Columns that are the target or come of it.
OUTCOMES = {"buybox_pct", "units", "sessions", "revenue", "implied_price", "oi_price", "listing_price", "raw_price", "rank_value", "cvr"}
CATEGORIES = ("brand", "product_type", "has_aplus")


def _features(of: str) -> list[str]:
    return ["brand", *[c for c, _ in columns_of(of) if c not in OUTCOMES]]


def _bucket(*keys: Column) -> Column:
    """A place in 10 000 by a hash of the row's keys, which is the same however the rows are dealt out."""
    return F.crc32(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")) % 10_000


def _split_panel(panel: DataFrame, y: Column, name: str) -> DataFrame:
    """The panel with a model for each region, its target in 0..1, and 40 % of the rows held out."""
    target = F.least(F.greatest(y.cast("double"), F.lit(0.0)), F.lit(1.0))
    test = _bucket(F.col("brand"), F.col("region"), F.col("week"), F.lit("0")) < 4000
    return stored(panel.withColumns({"model": F.col("region").cast("string"), "y": target, "test": test}).where("y is not null"), name)


def _scored(rows: DataFrame, columns: list[str], half: DataFrame | None = None) -> DataFrame:
    """Rank on all columns, keep the best of each region, refit under constraints, and score on what is held out."""
    models = forecast.refitted_models(rows.where("not test"), columns, CATEGORIES, rounds=100)
    guesses = forecast.guessed(rows.where("test"), models).withColumn("guess", F.least(F.greatest("guess", F.lit(0.0)), F.lit(1.0)))
    limit = None
    if half is not None:
        guesses, limit = guesses.join(half, "model"), F.col("half")
    chosen = rows.sparkSession.createDataFrame([(m, ",".join(f.columns)) for m, f in models.items()], "model string, columns string")
    found = forecast.evaluated(stored(guesses, "guesses"), limit).join(chosen, "model")
    return found.select(F.col("model").cast("int").alias("region"), "n", "r2", "mse", "mae", "auc", "columns")


def _with_share(panel: DataFrame) -> DataFrame:
    return panel.withColumn("buybox_pred", forecast.chained_share(F.col("price"), F.col("bb_price"), F.col("lowest_price")))


@query("featured_model")
def featured_model(spark: SparkSession, d: str) -> DataFrame:
    """A forecast of the featured-offer share for each region, with its holdout scores."""
    rows = _split_panel(market_panel(spark, d), F.col("buybox_pct") / 100, "featured-panel")
    return _scored(rows, _features(BBOX))


@query("cvr_model")
def cvr_model(spark: SparkSession, d: str) -> DataFrame:
    """A forecast of conversion for each region, on weeks with sales and as many without, with the share by rule as a feature."""
    panel = _with_share(market_panel(spark, d, ())).withColumn("key", F.concat_ws("|", "brand", "region", "week"))
    panel = panel.select("key", "region", "week", "units", "cvr", *_features(CVR), "buybox_pred")
    balanced = sampling.undersampled(stored(panel, "cvr-panel"), F.col("units") > 0, "key", "cvr")
    rows = _split_panel(balanced.drop("key"), F.col("cvr"), "cvr-rows")
    half = rows.groupBy("model").agg(F.percentile_approx("y", 0.5, 10_000).alias("half"))
    return _scored(rows, [*_features(CVR), "buybox_pred"], half)


@query("chained_share", PANEL_SQL + """ SELECT brand, region, week, round(1 / (1 + exp(-greatest(-30, least(30,
  -1.45 - 12 * coalesce((price - bb_price) / nullif(bb_price, 0), 0) - 4 * coalesce((price - lowest_price) / nullif(lowest_price, 0), 0) + 0.5 + 0.5 + 0.45)))) + 1e-9, 6) AS buybox_pred FROM panel""")
def chained_share(spark: SparkSession, d: str) -> DataFrame:
    """The share by the stated rule for every week, as the conversion models read it."""
    return _with_share(market_panel(spark, d, ())).select("brand", "region", "week", settled(F.col("buybox_pred")).alias("buybox_pred"))


#: Splits that the two predictors are compared on.
TRIALS = 10


@query("paired_trials")
def paired_trials(spark: SparkSession, d: str) -> DataFrame:
    """Means and spreads of two predictors' errors over ten splits of the panel: the brand's mean, and boosted trees."""
    columns = ["price_vs_bb", "price_vs_lowest", "offer_count", "frac_oos", "price"]
    panel = market_panel(spark, d, ()).select("brand", "region", "week", *columns, F.least(F.greatest(F.col("buybox_pct") / 100, F.lit(0.0)), F.lit(1.0)).alias("y"))
    trial = F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1)))
    rows = stored(panel.where("y is not null"), "trial-panel").withColumn("trial", trial).withColumn("model", F.col("trial").cast("string"))
    rows = rows.withColumn("test", _bucket(F.col("brand"), F.col("region"), F.col("week"), F.col("trial")) < 3000)
    train, test = rows.where("not test"), rows.where("test")
    chosen = {str(k): ["brand", *columns] for k in range(TRIALS)}
    trees = forecast.guessed(test, forecast.fitted_models(train, chosen, ("brand",), forecast.SIGNS, rounds=40, depth=3))
    whole = train.groupBy("model").agg(F.avg("y").alias("all"))
    means = train.groupBy("model", "brand").agg(F.avg("y").alias("own"))
    plain = test.join(means, ["model", "brand"], "left").join(whole, "model").select("model", "y", F.coalesce("own", "all").alias("guess"))
    out = None
    for method, guesses in (("mean", plain), ("trees", trees)):
        found = forecast.evaluated(guesses).select(F.lit(method).alias("method"), "mae", "r2")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("method").agg(F.avg("mae").alias("mae"), F.stddev("mae").alias("mae_spread"), F.avg("r2").alias("r2"), F.count("*").alias("n"))


#: Parts in a partition of those that models of Spark ML are fitted on; a forest holds some hundred numbers for each.
PARTS = 50_000


def _dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows by hash of the key in partitions of about ``most``, in order, however few files they come from."""
    return rows.repartition(max(1, -(-rows.count() // most)), key).sortWithinPartitions(key)


@query("linear_and_forest")
def linear_and_forest(spark: SparkSession, d: str) -> DataFrame:
    """An elastic net with cross-validated penalties and a random forest by Spark ML, and a kernel regression, for part prices.

    All work on partitions of all parts; their holdout is a hash of the key.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from pricewright.sources.tables import table

    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_brand", "p_type", F.col("p_retailprice").alias("label"))
    rows = sampling.split(_dealt(part, "p_partkey", PARTS), "p_partkey", 0.3)
    train, test = rows.where("train"), rows.where("not train")
    steps = [
        StringIndexer(inputCols=["p_brand", "p_type"], outputCols=["b", "t"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["b", "t"], outputCols=["bv", "tv"]),
        VectorAssembler(inputCols=["size", "bv", "tv"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features"),
    ]
    net = LinearRegression(maxIter=50)
    grid = ParamGridBuilder().addGrid(net.regParam, [0.01, 0.1, 1.0]).addGrid(net.elasticNetParam, [0.1, 0.5, 0.9]).build()
    measure = RegressionEvaluator(metricName="rmse")
    made = {
        "elastic net": CrossValidator(estimator=Pipeline(stages=[*steps, net]), estimatorParamMaps=grid, evaluator=measure, numFolds=3, seed=0, parallelism=4),
        "forest": Pipeline(stages=[*steps, RandomForestRegressor(numTrees=100, maxDepth=8, seed=0)]),
    }
    out = None
    for name, estimator in made.items():
        guess = estimator.fit(train).transform(test).select(F.lit(name).alias("method"), "label", "prediction")
        out = guess if out is None else out.unionByName(guess)
    lift = Pipeline(stages=steps).fit(train)
    wide = lambda part: lift.transform(part).select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    kernel = kernels.fit(stored(wide(train), "kernel-rows"), gamma=0.02, ridge=1e-4, epsilon=5.0)
    guess = kernels.predicted(wide(test), kernel).select(F.lit("kernel").alias("method"), F.col("y").alias("label"), F.col("guess").alias("prediction"))
    out = out.unionByName(guess)
    err = F.col("prediction") - F.col("label")
    return out.groupBy("method").agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
