"""Base rate and limit learned from a table of priced applicants (Spark ML)."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain import fixed_values as fv

TARGETS = {"base_rate": "ml_base_rate_pct", "base_limit": "ml_base_limit_cr"}


def impute(ratios: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Fill missing ratios, and add whole columns that are absent, with sector medians."""
    medians = medians or fv.RATIO_MEDIANS
    fill = {
        name: F.coalesce(F.col(name).cast("double"), F.lit(m)) if name in ratios.columns else F.lit(m)
        for name, m in medians.items()}
    return ratios.withColumns(fill)


def proxy_ratios(gst: DataFrame) -> DataFrame:
    """Compliance and leverage proxies from the tax feed."""
    return gst.select(
        "applicant_id",
        F.when(F.col("filing_consistency") == "Regular", 95.0).otherwise(70.0).alias("gst_compliance_pct"),
        F.round(3.0 + F.coalesce("mismatch_pct", F.lit(0.0)) * 0.05, 2).alias("leverage_ratio"))


def fit_base_terms(
    train: DataFrame, trees: int = 120, depth: int = 8, least_leaf: int = 10, seed: int = 42,
) -> PipelineModel:
    """Standardised ratios into one random forest per target; the forests grow side by side, so that neither waits on the other's last task."""
    features = list(fv.RATIO_MEDIANS)
    rows = impute(train).select(*features, *TARGETS)
    scaler = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
    ]).fit(rows)
    scaled = scaler.transform(rows)
    forests = [
        RandomForestRegressor(
            featuresCol="_scaled", labelCol=label, predictionCol=out, numTrees=trees, maxDepth=depth,
            minInstancesPerNode=least_leaf, featureSubsetStrategy="all", seed=seed)
        for label, out in TARGETS.items()]
    with ThreadPool(len(forests)) as pool:
        grown = pool.map(inheritable_thread_target(train.sparkSession)(lambda forest: forest.fit(scaled)), forests)
    return PipelineModel(stages=[*scaler.stages, *grown])


def predict_base_terms(model: PipelineModel | None, ratios: DataFrame) -> DataFrame:
    """Predicted terms per applicant; without a model, the house defaults."""
    filled = impute(ratios)
    if model is None:
        return filled.select(
            "applicant_id", F.lit(fv.BASE_RATE_PCT).alias("ml_base_rate_pct"),
            F.lit(fv.BASE_LIMIT_CR).alias("ml_base_limit_cr"), F.lit("fallback_no_model").alias("model_status"))
    return model.transform(filled).select(
        "applicant_id", *[F.round(c, 2).alias(c) for c in TARGETS.values()], F.lit("predicted").alias("model_status"))


# --- Kept models ---------------------------------------------------------------------
KEPT = "fingerprint STRING, rows BIGINT, trees INT, depth INT, least_leaf INT, seed INT, rmse_base_rate DOUBLE, rmse_base_limit DOUBLE, saved_at TIMESTAMP"


def fingerprint(train: DataFrame) -> tuple[str, int]:
    """A number for the training rows, whatever their order, and how many they are."""
    columns = [*fv.RATIO_MEDIANS, *TARGETS]
    row = impute(train).select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(1), *columns).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.bit_xor("g").alias("g")).first()
    return f"{row.n:x}-{(int(row.h or 0)) % 2**64:016x}-{(row.g or 0) % 2**64:016x}", row.n


def held_out_error(train: DataFrame, folds: int = 5, **options) -> dict[str, float]:
    """Root mean squared error per target on a fold of rows, by hash, that the forest did not see."""
    split = impute(train).withColumn("_fold", F.pmod(F.xxhash64(*fv.RATIO_MEDIANS), F.lit(folds)))
    model = fit_base_terms(split.filter("_fold <> 0"), **options)
    missed = model.transform(split.filter("_fold = 0")).agg(*[
        F.sqrt(F.avg((F.col(label) - F.col(out)) ** 2)).alias(label) for label, out in TARGETS.items()]).first()
    return missed.asDict()


def keep_base_terms(train: DataFrame, path: str, trees: int = 120, depth: int = 8, least_leaf: int = 10, seed: int = 42) -> str:
    """Fit, and keep the model under ``path`` beside what it was learnt from; returns its version.

    A version is the fingerprint of the rows and the settings: the same training overwrites itself,
    any other one stands beside it. The error is that of a fold that a second forest did not see.
    """
    spark, options = train.sparkSession, {"trees": trees, "depth": depth, "least_leaf": least_leaf, "seed": seed}
    mark, rows = fingerprint(train)
    version = f"{mark}-{trees}-{depth}-{least_leaf}-{seed}"
    missed = held_out_error(train, **options)
    fit_base_terms(train, **options).write().overwrite().save(f"{path}/models/{version}")
    kept = spark.range(1).select(
        F.lit(mark).alias("fingerprint"), F.lit(rows).cast("bigint").alias("rows"),
        *[F.lit(value).alias(name) for name, value in options.items()],
        *[F.lit(missed[label]).cast("double").alias(f"rmse_{label}") for label in TARGETS], F.current_timestamp().alias("saved_at"))
    kept.write.mode("overwrite").parquet(f"{path}/versions/version={version}")
    return version


def kept_versions(spark: SparkSession, path: str) -> DataFrame:
    """All kept models of a path with their settings, errors and fingerprints."""
    return spark.read.schema(f"{KEPT}, version STRING").parquet(f"{path}/versions")


def load_base_terms(spark: SparkSession, path: str, version: str | None = None) -> PipelineModel:
    """A kept model; without a version, the one saved last."""
    if version is None:
        version = kept_versions(spark, path).orderBy(F.desc("saved_at"), "version").first().version
    return PipelineModel.load(f"{path}/models/{version}")
