"""Calibrators as pyspark.ml stages: fit on labelled rows, save, load, transform, in a Pipeline.

An estimator fits one of the library's models per group; the model is a small table beside its settings, kept as Parquet
in the saved stage, and transform() joins it to the rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions import scoring as S
from gaugework.operators import calibration, gramian, trees

KINDS = ("bias", "line", "linear", "ridge", "tree", "cutpoints", "gates")


class _Settings(Params):
    kind = Param(Params._dummy(), "kind", "one of " + ", ".join(KINDS), TypeConverters.toString)
    by = Param(Params._dummy(), "by", "columns of the groups that have a model each", TypeConverters.toListString)
    features = Param(Params._dummy(), "features", "feature columns; the first is the raw score", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "column of the human score, or of the label for cutpoints and gates", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "weight column; empty: every row counts 1", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "column of the prediction", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "levels of splits of a tree", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "rows, or weight, of a leaf at least", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "penalty of ridge", TypeConverters.toFloat)
    low = Param(Params._dummy(), "low", "least prediction", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "greatest prediction", TypeConverters.toFloat)

    def _default(self) -> None:
        self._setDefault(kind="line", by=[], features=["judge_raw"], target="human", weight="", output="prediction", depth=2, least=2.0, alpha=1.0, low=1.0, high=5.0)

    def _of(self, name: str):
        return self.getOrDefault(getattr(self, name))


class Calibrator(Estimator, _Settings, DefaultParamsReadable, MLWritable):
    """Fits a model of its kind; rows with a null feature or target take no part.

    bias: the mean residual of the score; line: least squares on the score; linear, ridge: on all features; tree: a regression
    tree by levels; cutpoints (one group): two cuts of the score to labels; gates (one group): a gate for each of two scores.
    """

    @keyword_only
    def __init__(self, **settings) -> None:
        super().__init__()
        self._default()
        self._set(**self._input_kwargs)
        if self._of("kind") not in KINDS:
            raise ValueError(f"kind is {self._of('kind')}; known: {', '.join(KINDS)}")

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    def _fit(self, rows: DataFrame) -> CalibratorModel:
        kind, by, features, target = (self._of(n) for n in ("kind", "by", "features", "target"))
        weight = self._of("weight") or None
        if kind in ("cutpoints", "gates") and by:
            raise ValueError(f"{kind} are fitted to one group; by is {by}")
        if kind == "bias":
            w = F.lit(1.0) if weight is None else F.col(weight)
            good = rows.dropna(subset=[features[0], target])
            table = good.groupBy(*by).agg((F.sum(w * (F.col(target) - F.col(features[0]))) / F.sum(w)).alias("bias")).where("bias is not null")
        elif kind in ("line", "linear"):
            table = gramian.linear(rows, by, features[:1] if kind == "line" else features, target, weight)
        elif kind == "ridge":
            table = gramian.ridge(rows, by, features, target, self._of("alpha"), weight)
        elif kind == "tree":
            table = trees.histogram_tree(rows, by, features, target, weight, self._of("depth"), self._of("least"))
        elif kind == "cutpoints":
            table = calibration.fit_cutpoints(rows.withColumn("target", F.col(target)), features[0])
        else:
            table = calibration.fit_gates(rows.withColumn("target", F.col(target)), *features[:2])
        model = CalibratorModel(table)
        return self._copyValues(model)


class CalibratorModel(Model, _Settings, MLReadable, MLWritable):
    """transform(): rows with the prediction; a row whose group has no model, or with a null feature, keeps its raw score (a label: null)."""

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self._default()
        self.table = table

    def _transform(self, rows: DataFrame) -> DataFrame:
        kind, by, features, output = (self._of(n) for n in ("kind", "by", "features", "output"))
        base = F.col(features[0])
        if kind == "tree":
            found = trees.predict(rows, self.table, by, features, self._of("depth"))
            value: Column = F.col("prediction")
        elif kind in ("cutpoints", "gates"):
            names = ("low", "high") if kind == "cutpoints" else ("presence_cut", "completeness_cut")
            cuts = self.table.select(*(F.col(n).alias(f"_m{i}") for i, n in enumerate(names)))
            found = rows.join(F.broadcast(cuts), F.lit(True), "left")  # one row
            label = S.label_by_cutpoints(base, F.col("_m0"), F.col("_m1")) if kind == "cutpoints" else S.label_by_gates(base, F.col(features[1]), F.col("_m0"), F.col("_m1"))
            return found.select(*(F.col(c) for c in rows.columns if c != output), F.when(F.col("_m0").isNotNull(), label).alias(output))
        else:
            columns = ["bias"] if kind == "bias" else ["intercept", "coefficients"]
            model = self.table.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"_m_{c}") for c in columns))
            same = F.lit(True)
            for i, c in enumerate(by):
                same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
            found = rows.join(model if by else F.broadcast(model), same, "left")  # without groups the model is one row
            if kind == "bias":
                value = base + F.col("_m_bias")
            else:
                used = features[:1] if kind == "line" else features
                value = F.col("_m_intercept") + sum((F.col("_m_coefficients")[i] * F.col(f) for i, f in enumerate(used)), F.lit(0.0))
        kept = F.greatest(F.lit(self._of("low")), F.least(F.lit(self._of("high")), value))
        answer = F.coalesce(F.when(value.isNotNull(), kept), base.cast("double"))
        return found.select(*(F.col(c) for c in rows.columns if c != output), answer.alias(output))

    def metadata(self) -> dict:
        """The settings and the number of the table's rows."""
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)} | {"rows": self.table.count()}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CalibratorModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> CalibratorModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = CalibratorModel(spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
