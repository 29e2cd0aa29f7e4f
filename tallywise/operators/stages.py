"""ML stages of our own, saved inside a ``PipelineModel`` like the built-in ones."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tallywise.operators.tfidf import row_terms


class RowTerms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The terms of a text by one analyzer; a null text has none."""

    analyzer = Param(Params._dummy(), "analyzer", "word or char_wb", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str = "terms", analyzer: str = "word"):
        super().__init__()
        self._setDefault(outputCol="terms", analyzer="word")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(f"`{self.getInputCol()}`"), F.lit(""))
        return dataset.withColumn(self.getOutputCol(), row_terms(text, self.getOrDefault(self.analyzer)))


class ScoredLabel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``label_{m}``, ``confidence_{m}`` and ``probability_{m}`` from what model m adds."""

    model = Param(Params._dummy(), "model", "name of the model", TypeConverters.toString)
    labels = Param(Params._dummy(), "labels", "labels by their code", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, model: str | None = None, labels: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, probs = self.getOrDefault(self.model), vector_to_array("probability")
        return dataset.withColumns({
            f"label_{name}": F.element_at(F.lit(self.getOrDefault(self.labels)), (F.col("prediction") + 1).cast("int")),
            f"confidence_{name}": F.array_max(probs), f"probability_{name}": probs}).drop("rawPrediction", "probability", "prediction")
