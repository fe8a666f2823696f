"""A pyspark.ml Estimator and Model for imputation, usable in a Pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, MissingColumnError
from gapwise.functions import nullity
from gapwise.operators import donors, models
from gapwise.operators.fill import STRATEGIES, apply_fill, fill_values
from gapwise.operators.validate import validate_strategy

ALL = ("mean", "median", "mode", "knn", "mice", "pmm", "rf", "gb", "hotdeck", "logreg", "polyreg", "polr")
#: They learn from the rows they fill, so they can't be fitted on one frame and applied to another.
TRANSDUCTIVE = ("logreg", "polyreg", "polr")


class _Options(Params):
    strategy = Param(Params._dummy(), "strategy", "one of " + ", ".join(ALL), TypeConverters.toString)
    rowId = Param(Params._dummy(), "rowId", "key column, for all but mean, median and mode", TypeConverters.toString)
    neighbors = Param(Params._dummy(), "neighbors", "donors of knn and pmm", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "euclidean", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "rounds of mice and pmm", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)
    hotdeck = Param(Params._dummy(), "hotdeck", "random", TypeConverters.toString)


class MissingImputer(Estimator, _Options):
    """Learns from the frame given to ``fit``; ``transform`` never learns from the frame it fills."""

    @keyword_only
    def __init__(self, *, strategy="mean", rowId=None, neighbors=5, metric="euclidean", maxIter=10, seed=0, hotdeck="random"):
        super().__init__()
        self._setDefault(strategy="mean", neighbors=5, metric="euclidean", maxIter=10, seed=0, hotdeck="random")
        self.setParams(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setParams(self, **params):
        if "strategy" in params:
            validate_strategy(params["strategy"], ALL, example="mean")
        return self._set(**params)

    def _fit(self, df: DataFrame) -> MissingImputerModel:
        get = self.getOrDefault
        strategy = get("strategy")
        if strategy in TRANSDUCTIVE or (strategy == "knn" and get("metric") == "mixed") or (strategy == "hotdeck" and get("hotdeck") != "random"):
            raise NotImplementedError(f"{strategy} would learn from the rows it fills; use its function")
        if strategy not in STRATEGIES and not self.isDefined("rowId"):
            raise ConfigurationError("rowId", None, f"is needed by {strategy}")
        row_id = get("rowId") if self.isDefined("rowId") else None
        columns = [c for c in df.columns if c != row_id]
        values = fill_values(df, strategy if strategy in STRATEGIES else "mean", columns)
        keep = None if strategy in STRATEGIES else nullity.canonical(df)
        return self._copyValues(MissingImputerModel(df.columns, values, keep))


class MissingImputerModel(Model, _Options):
    """Fill values, and the training rows where the strategy draws on them."""

    def __init__(self, columns: list[str], values: dict[str, object], train: DataFrame | None):
        super().__init__()
        self._setDefault(strategy="mean", neighbors=5, metric="euclidean", maxIter=10, seed=0, hotdeck="random")
        self.feature_names, self.values, self.train = list(columns), values, train

    def get_feature_names_out(self) -> list[str]:
        return list(self.feature_names)

    def _transform(self, df: DataFrame) -> DataFrame:
        if absent := [c for c in self.feature_names if c not in df.columns]:
            raise MissingColumnError(absent, df.columns)
        if extra := [c for c in df.columns if c not in self.feature_names]:
            raise ConfigurationError("columns", extra, "weren't in the training frame")
        df = df.select(*[nullity.column(c) for c in self.feature_names])
        get = self.getOrDefault
        strategy = get("strategy")
        if strategy in STRATEGIES:
            return apply_fill(df, self.values)
        row_id = get("rowId")
        if strategy == "knn":
            return donors.impute_knn(df, row_id, get("neighbors"), get("metric"), donors=self.train)
        if strategy == "hotdeck":
            return donors.impute_hotdeck_random(df, row_id, get("seed"), donors=self.train)
        return self._by_model(df, row_id, strategy)

    def _by_model(self, df: DataFrame, row_id: str, strategy: str) -> DataFrame:
        """Models fitted on the training rows alone: each column on the others, missing features at the training mean; trees tell a category's levels apart as classes."""
        columns = [c for c in self.feature_names if c != row_id]
        levels = donors.categories(self.train, [c for c in columns if not nullity.is_numeric(df, c)])
        means = self.train.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(donors.encoded(self.train, columns, levels))]).first()

        def coded(frame: DataFrame) -> DataFrame:
            made = donors.encoded(frame, columns, levels)
            marks = [nullity.miss(frame, c).alias(f"m{i}") for i, c in enumerate(columns)]
            full = [F.coalesce(v, F.lit(means[f"a{i}"])).alias(f"v{i}") for i, v in enumerate(made)]
            return frame.select(nullity.column(row_id).alias("__id"), *marks, *full)

        known, asked, out = coded(self.train), coded(df), df
        for t, c in enumerate(columns):
            used = [i for i in range(len(columns)) if i != t]
            rows = known.where(~F.col(f"m{t}"))
            if strategy in ("rf", "gb"):
                pack = VectorAssembler(inputCols=[f"v{i}" for i in used], outputCol="features")
                if len(levels.get(c, ())) == 1:
                    scored = asked.select("__id", f"m{t}", F.lit(0.0).alias("__p"))
                else:
                    trees = models.tree(strategy, len(levels.get(c, ())), self.getOrDefault("seed"), f"v{t}", {})
                    scored = trees.fit(pack.transform(rows)).transform(pack.transform(asked)).select("__id", f"m{t}", "__p")
            else:
                n, m = models.gram(rows, [F.col(f"v{i}") for i in used], F.col(f"v{t}"))[()]
                w, _, _ = models.bayesian_ridge(n, m)
                line = sum((F.lit(float(b)) * F.col(f"v{i}") for b, i in zip(w[1:], used, strict=True)), F.lit(float(w[0])))
                scored = asked.select("__id", f"m{t}", line.alias("__p"))
                if strategy == "pmm" and c not in levels:
                    near = models.nearest_scores(scored.where(f"m{t}").select(F.col("__id").alias("id"), F.col("__p").alias("score")), rows.select(F.col("__id").alias("donor"), line.alias("score"), F.col(f"v{t}").alias("value")), 1)
                    scored = near.select(F.col("id").alias("__id"), F.lit(True).alias(f"m{t}"), F.col("value").alias("__p"))
            fill = scored.where(f"m{t}").select("__id", "__p")
            made = F.col("__p")
            if c in levels:
                place = F.greatest(F.lit(0), F.least(F.bround("__p"), F.lit(len(levels[c]) - 1))).cast("int")
                made = F.get(F.array(*[F.lit(x) for x in levels[c]]), place)
            old = nullity.value(df, c) if c in levels else nullity.value(df, c).cast("double")
            out = out.join(fill, out[row_id] == fill["__id"], "left").withColumn(c, F.coalesce(old, made)).drop("__id", "__p")
        return out.select(*[nullity.column(c) for c in self.feature_names])
