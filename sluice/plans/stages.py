"""The fitted transforms as stages of ``pyspark.ml``: they stand in pipelines, take part in parameter grids and
cross-validation, and are saved and loaded with the pipeline.

Each estimator has its settings as ``Params`` and becomes a ``Step`` when it is fitted; a ``Step`` holds the same state
as the transform of ``operators.transforms`` that it wraps, and works on tables and streams alike.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import correlate, profile, transforms
from ..operators.transforms import Chain, Fitted


def _param(name: str, doc: str, of=TypeConverters.identity) -> Param:  # noqa: ANN001
    return Param(Params._dummy(), name, doc, of)


class Step(Model, MLReadable, MLWritable):
    """A fitted stage: one transform or several in a row."""

    def __init__(self, chain: Chain | None = None):
        super().__init__()
        self.chain = chain or Chain([])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.chain.transform(dataset)

    def write(self) -> MLWriter:
        return _StepWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StepReader()


class _StepWriter(MLWriter):
    def __init__(self, step: Step):
        super().__init__()
        self.step = step

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.step, path, self.sparkSession)
        self.step.chain.save(self.sparkSession, f"{path}/chain")


class _StepReader(MLReader):
    def load(self, path: str) -> Step:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return Step(Chain.load(self.sparkSession, f"{path}/chain"))._resetUid(metadata["uid"])


def pipeline(chain: Chain, *models: Model) -> PipelineModel:
    """A preparation and the models behind it as one fitted pipeline."""
    return PipelineModel([*[Step(Chain([s])) for s in chain.steps], *models])


class _Fits(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """What the estimators share: settings by name, and a fit that gives a ``Step``."""

    def __init__(self, **given):  # noqa: ANN003
        super().__init__()
        self._setDefault(**self._defaults)
        self._set(**given)

    _defaults: dict = {}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> Step:
        return Step(Chain(self._steps(dataset)))._resetUid(self.uid)

    def _of(self, name: str):  # noqa: ANN202
        return self.getOrDefault(name)


class ColumnImputer(_Fits, HasInputCols):
    """Nulls become the mean, median, mode (the smallest of the most frequent) or a constant, ``fill``."""

    strategy = _param("strategy", "mean, median, mode or constant", TypeConverters.toString)
    fill = _param("fill", "the constant")
    _defaults = {"strategy": "median"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        names = self.getInputCols()
        return [transforms.fit_impute(df, names, self._of("strategy"), dict.fromkeys(names, self._of("fill")) if self.isDefined("fill") else None)]


class NeighbourImputer(_Fits, HasInputCols):
    """Nulls of ``fillCols`` (all ``inputCols``, if not given) become means over the nearest training rows."""

    keyCol = _param("keyCol", "column that tells rows apart", TypeConverters.toString)
    fillCols = _param("fillCols", "columns to be filled", TypeConverters.toListString)
    k = _param("k", "how many neighbours", TypeConverters.toInt)
    weights = _param("weights", "distance or uniform", TypeConverters.toString)
    _defaults = {"k": 5, "weights": "distance"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        fill = self._of("fillCols") if self.isDefined("fillCols") else None
        return [transforms.fit_impute_neighbours(df, self._of("keyCol"), self.getInputCols(), fill, self._of("k"), self._of("weights"))]


class MissingIndicators(_Fits, HasInputCols):
    """A 0/1 column ``missingindicator_<name>`` for each column that has nulls when fitted."""

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_indicators(df, self.getInputCols())]


class OutlierCapper(_Fits, HasInputCols):
    """Values beyond the quartiles by more than ``k`` interquartile ranges become the bound."""

    k = _param("k", "interquartile ranges beyond the quartiles", TypeConverters.toFloat)
    _defaults = {"k": 2.5}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_cap(df, self.getInputCols(), self._of("k"))]


class SelectivePowers(_Fits, HasInputCols):
    """Yeo-Johnson powers for those columns whose skewness is above ``skewness``; the others stay."""

    skewness = _param("skewness", "columns above it are bent", TypeConverters.toFloat)
    _defaults = {"skewness": 0.75}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        bent = [r["column"] for r in profile.skewed(df, self.getInputCols(), self._of("skewness")).select("column").collect()]
        return [transforms.fit_power(df, [c for c in self.getInputCols() if c in bent])]


class ColumnScaler(_Fits, HasInputCols):
    """standard, minmax or robust scale."""

    how = _param("how", "standard, minmax or robust", TypeConverters.toString)
    _defaults = {"how": "standard"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_scale(df, self.getInputCols(), self._of("how"))]


class RareGrouper(_Fits, HasInputCols):
    """Values with less than ``share`` of the rows become one."""

    share = _param("share", "least share of the rows", TypeConverters.toFloat)
    _defaults = {"share": 0.01}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_rare(df, self.getInputCols(), self._of("share"))]


class IndicatorColumns(_Fits, HasInputCols):
    """A 0/1 column for each value, of which there may be ``most``."""

    dropFirst = _param("dropFirst", "without the first value", TypeConverters.toBoolean)
    most = _param("most", "most values of a column", TypeConverters.toInt)
    _defaults = {"dropFirst": False, "most": 1000}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_one_hot(df, self.getInputCols(), self._of("dropFirst"), self._of("most"))]


class OrdinalCodes(_Fits, HasInputCols):
    """Codes from 0 in sorted order; -1 for null and for values unknown when fitted."""

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_ordinal(df, self.getInputCols())]


class DateFeatures(_Fits, HasInputCols):
    """What a family of models (tree, linear or distance) gets from each date."""

    family = _param("family", "tree, linear or distance", TypeConverters.toString)
    _defaults = {"family": "tree"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_dates(df, self.getInputCols(), self._of("family"))]


class VarianceFilter(_Fits, HasInputCols):
    """Columns whose variance is not above ``least`` go."""

    least = _param("least", "variance that stays above it", TypeConverters.toFloat)
    _defaults = {"least": 0.01}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_variance(df, self.getInputCols(), self._of("least"))]


class ColumnDropper(_Fits, HasInputCols):
    """The columns go."""

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_drop(self.getInputCols())]


class TextVectorizer(_Fits, HasInputCols):
    """Each text becomes its term weights, a vector ``<name>_tfidf``."""

    keyCol = _param("keyCol", "column that tells rows apart", TypeConverters.toString)
    least = _param("least", "rows that a term must be in", TypeConverters.toInt)
    most = _param("most", "share of the rows that a term may be in", TypeConverters.toFloat)
    features = _param("features", "size of the vocabulary", TypeConverters.toInt)
    _defaults = {"least": 2, "most": 0.95, "features": 5000}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        return [transforms.fit_text(df, self._of("keyCol"), self.getInputCols(), self._of("least"), self._of("most"), self._of("features"))]


class DerivedFeatures(_Fits, HasInputCols, HasLabelCol):
    """Differences and ratios of pairs with a correlation of ``limit`` and more, and what a family of models drops of them."""

    family = _param("family", "tree, linear, distance or other", TypeConverters.toString)
    limit = _param("limit", "least size of the correlation", TypeConverters.toFloat)
    _defaults = {"family": "linear", "limit": 0.9}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        pairs = correlate.pair_report(df, self.getInputCols(), self._of("limit"))
        actions = correlate.pair_actions(df.columns, pairs, self._of("family"), self.getLabelCol())
        return [transforms.fit_derive([(c, what, a, b) for what, c, a, b in actions if what != "drop"]), transforms.fit_drop([c for what, c, _, _ in actions if what == "drop"])]


class Projection(_Fits, HasInputCols, HasOutputCol):
    """The first principal components that hold ``variance`` (or singular directions, uncentred), as an array."""

    variance = _param("variance", "share of the variance to be held", TypeConverters.toFloat)
    most = _param("most", "most components", TypeConverters.toInt)
    centre = _param("centre", "shift columns to mean 0", TypeConverters.toBoolean)
    _defaults = {"variance": 0.95, "centre": True, "outputCol": "components"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        most = self._of("most") if self.isDefined("most") else None
        return [transforms.fit_projection(df, self.getInputCols(), self._of("variance"), most, self._of("centre"), self.getOutputCol())]


class FeatureVector(_Fits, HasInputCols, HasOutputCol):
    """The columns as one vector; nulls count as 0.

    A name that is no longer among the columns stands for those that took its place: numbers, vectors and arrays whose
    names begin with it and an underscore, as they were when this stage was fitted.
    """

    _defaults = {"outputCol": "features"}

    def _steps(self, df: DataFrame) -> list[Fitted]:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        usable = [c for c, t in kinds.items() if isinstance(t, (T.NumericType, T.BooleanType, T.ArrayType, VectorUDT))]
        chosen: list[str] = []
        for name in self.getInputCols():
            chosen += [name] if name in kinds else [c for c in usable if c.startswith(f"{name}_")]
        return [transforms.fit_vector(list(dict.fromkeys(chosen)), self.getOutputCol())]
