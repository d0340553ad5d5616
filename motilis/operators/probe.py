"""Linear probes over frozen features, and detector statistics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import exact_quantiles, written


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and targets of frames labelled ok, by id: frame_id, features, y. An empty set is an error."""
    rows = features.join(labels.filter("status = 'ok'").select("frame_id", F.col("manipulation").cast("int").alias("y")), "frame_id")
    if not rows.limit(1).count():
        raise ValueError("no frame has both features and a label")
    return rows.select("frame_id", "features", "y")


def fit(rows: DataFrame, width: int, iterations: int = 1000) -> LogisticRegressionModel:
    """L2 logistic regression with unit strength; one width and two classes are required."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if seen.k != 2 or (seen.a, seen.b) != (width, width):
        raise ValueError(f"a probe needs two classes and features of width {width}")
    data = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"))
    return LogisticRegression(regParam=1.0 / seen.n, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9).fit(data)


class Probe:
    """A fitted linear head with what it was fitted to: features of one backbone and width, one target."""

    def __init__(self, weights: list[float], bias: float, backbone: str, target: str) -> None:
        self.weights, self.bias, self.backbone, self.target = weights, bias, backbone, target

    def score(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """rows with score and predicted (score above 0); both null where the features are null, hold a null or have another width."""
        x = F.col(features).cast("array<double>")
        score = F.when(F.size(x) == len(self.weights), logit(x, self.weights, self.bias))
        return rows.withColumn("score", score).withColumn("predicted", (F.col("score") > 0).cast("int"))


def save_probe(model: LogisticRegressionModel, spark: SparkSession, path: str, backbone: str, target: str, report: dict[str, float]) -> None:
    """The model as a Spark ML model, and beside it, written last, what it was fitted to and how it did. What is there is replaced."""
    model.write().overwrite().save(f"{path}/model")
    told = [(backbone, target, model.numFeatures, {k: float(v) for k, v in report.items()})]
    spark.createDataFrame(told, "backbone string, target string, width int, report map<string,double>").coalesce(1).write.mode("overwrite").json(f"{path}/fitted_to")


def load_probe(spark: SparkSession, path: str, backbone: str, target: str) -> Probe:
    """The saved probe; one fitted to other features or for another target is refused, since its answers would be to another question."""
    told = spark.read.schema("backbone string, target string, width int, report map<string,double>").json(f"{path}/fitted_to").first()
    if told is None or (told.backbone, told.target) != (backbone, target):
        raise ValueError(f"the probe at {path} was fitted to {told and told.backbone} for {told and told.target}, not to {backbone} for {target}")
    model = LogisticRegressionModel.load(f"{path}/model")
    if model.numFeatures != told.width:
        raise ValueError(f"the probe at {path} has {model.numFeatures} weights and was saved with {told.width}")
    return Probe(model.coefficients.tolist(), float(model.intercept), backbone, target)


def train_probe(features: DataFrame, labels: DataFrame, path: str, backbone: str, target: str, width: int, n_folds: int = 5) -> dict[str, float]:
    """Fit a probe on all frames that have features and a label, save it, and return its fidelity on folds it did not see.

    One that does not beat the majority's share is an error, and nothing is saved."""
    rows = written(training_set(features, labels))
    report = beats_majority(cross_validated_fidelity(rows, width, n_folds)).first().asDict()
    if not report.pop("passes"):
        raise ValueError(f"accuracy {report['accuracy']:.4f} does not beat the majority's {report['majority']:.4f}")
    save_probe(fit(rows, width), rows.sparkSession, path, backbone, target, report)
    return report


def logit(features: Column, weights: list[float], bias: float) -> Column:
    """Score as a dot product of arrays, in generated code."""
    return F.aggregate(F.zip_with(features, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


def folds(rows: DataFrame, n: int = 5) -> DataFrame:
    """Stratified folds: rank by id within a class, modulo n."""
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy("y").orderBy("frame_id")) - 1) % n)


def fidelity(predictions: DataFrame) -> DataFrame:
    """accuracy, majority, balanced_accuracy, prevalence, predicted_prevalence over y, predicted."""
    y, p = F.col("y"), F.col("predicted")
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y == p).cast("int")).alias("accuracy"),
        F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"),
        ((F.avg(F.when(y == 1, p)) + F.avg(F.when(y == 0, 1 - p))) / 2).alias("balanced_accuracy"),
        F.avg(y).alias("prevalence"),
        F.avg(p).alias("predicted_prevalence"),
    )


def cross_validated_fidelity(rows: DataFrame, width: int, n: int = 5) -> DataFrame:
    """Fidelity of predictions by models that did not see their rows."""
    dealt, out = folds(rows, n).cache(), None
    for k in range(n):
        model = fit(dealt.filter(F.col("fold") != k), width)
        part = dealt.filter(F.col("fold") == k).select("y", (logit(F.col("features").cast("array<double>"), model.coefficients.tolist(), model.intercept) > 0).cast("int").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return fidelity(out)


def beats_majority(scores: DataFrame) -> DataFrame:
    return scores.withColumn("passes", F.col("accuracy") > F.col("majority"))


def detector_stats(frames: DataFrame, seconds: float, projected: int) -> DataFrame:
    """frames_per_s, box coverage, width percentiles (exact), hours for `projected` frames, and whether no box was found at all. frames: width (null without a box)."""
    names = ("p10", "p50", "p90", "p100")
    found = exact_quantiles(frames, "width", [0.1, 0.5, 0.9, 1.0]).select(*(F.col(f"q{i}").alias(n) for i, n in enumerate(names)))
    totals = frames.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / seconds).alias("frames_per_s"), F.try_divide(F.count("width"), F.count(F.lit(1))).alias("box_coverage"), (projected / (F.count(F.lit(1)) / seconds) / 3600).alias("projected_hours"), (F.count("width") == 0).alias("no_box"))
    return totals.crossJoin(found).select("n", "frames_per_s", "box_coverage", *names, "projected_hours", "no_box")  # a row each
