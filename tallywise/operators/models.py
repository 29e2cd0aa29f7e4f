"""Per-source classifiers on Spark ML: features, training, evaluation, prediction."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.constants import MAX_DF, MAX_FEATURES, MIN_CATEGORY_SAMPLES, MIN_DF, REQUIRED_COMPONENT, SPLIT_SEED
from tallywise.operators.scores import (average_precision, class_report, class_weights, macro_average,
                                        report_averages, roc_auc)
from tallywise.operators.stages import RowTerms, ScoredLabel
from tallywise.operators.tfidf import encode_labels, fit_vocabulary, indexed_terms, stratified_split, vector_stages
from tallywise.operators.validate import keep_frequent
from tallywise.operators.vote import mean_confidence, majority_vote

log = logging.getLogger(__name__)

MODEL_NAMES = ["logistic", "forest", "bayes"]
PART_BYTES = 128 * 1024 * 1024  # of the vectors in one partition
ROW_BYTES = 200  # of a vector without terms


@dataclass
class SourceModels:
    """What one source needs to predict; every part is of bounded size and carries all it needs.

    ``features`` knows its text column and analyzer, and each model its labels.
    """

    features: PipelineModel
    models: dict[str, PipelineModel] = field(default_factory=dict)

    @property
    def labels(self) -> list[str]:
        scored = next(iter(self.models.values())).stages[-1]
        return scored.getOrDefault(scored.labels)


def make_learners(seed: int = SPLIT_SEED) -> dict:
    common = dict(featuresCol="features", labelCol="code", weightCol="weight")
    return {
        "logistic": LogisticRegression(family="multinomial", maxIter=50, regParam=1e-3, **common),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed, **common),
        "bayes": NaiveBayes(modelType="multinomial", **common),
    }


def fit_features(train: DataFrame, text: str, analyzer: str = "word",
                 min_df: int = MIN_DF, max_df: float = MAX_DF,
                 max_features: int = MAX_FEATURES) -> PipelineModel:
    """Text to TF-IDF vector, from the relational vocabulary.

    Only the vocabulary, at most ``max_features`` terms, reaches the driver.
    """
    vocab = fit_vocabulary(train, text, analyzer, min_df=min_df, max_df=max_df, max_features=max_features)
    return PipelineModel([RowTerms(inputCol=text, analyzer=analyzer), *vector_stages(indexed_terms(vocab))])


def featurise(df: DataFrame, text: str | None, features: PipelineModel) -> DataFrame:
    """Add the feature vector row by row; no shuffle. Without ``text`` the column of the training is read."""
    read = {features.stages[0].inputCol: text} if text else {}
    return features.transform(df, read).drop("terms", "term_counts", "scaled")


def prepare(df: DataFrame, row: str, text: str, label: str,
            min_samples: int = MIN_CATEGORY_SAMPLES, seed: int = SPLIT_SEED) -> DataFrame:
    """Rows of frequent labels with their code and test mark; a null label is ``Other``."""
    named = df.select(row, text, F.coalesce(F.col(label), F.lit("Other")).alias(label))
    kept = keep_frequent(named, label, min_samples, few=True)
    coded = kept.join(F.broadcast(encode_labels(kept, label)), label)
    return stratified_split(coded, row, label, seed=seed)


def spread(df: DataFrame, text: str, analyzer: str = "word", terms: int = 0) -> DataFrame:
    """Rows dealt out so that the vectors of a partition take about ``PART_BYTES``; few rows stay where they are.

    A table compresses far better than its vectors, so the size of its files says little about them, and
    a forest keeps four bytes of a row for each of the ``terms`` of the vocabulary.
    """
    per_char = 4 if analyzer == "word" else 36  # a term takes 12 bytes
    size = df.agg(F.sum(ROW_BYTES + 4 * terms + per_char * F.coalesce(F.length(text), F.lit(0)))).first()[0] or 0
    return deal(df, size)


def deal(df: DataFrame, size: int) -> DataFrame:
    """Rows in partitions of ``PART_BYTES`` if they take ``size`` bytes in all and so need more tasks than run at once."""
    parts = dealt_parts(df.sparkSession, size)
    return df.repartition(parts) if parts else df


def dealt_parts(spark: SparkSession, size: int) -> int:
    """Partitions of ``PART_BYTES`` for ``size`` bytes; 0 where no more tasks are needed than run at once."""
    parts = ceil(size / PART_BYTES)
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def label_list(prepared: DataFrame, label: str) -> list[str]:
    """Labels by code; one row per class comes to the driver."""
    return [r[label] for r in prepared.select(label, "code").distinct().orderBy("code").collect()]


def train(prepared: DataFrame, text: str, label: str, analyzer: str = "word",
          learners: dict | None = None, **limits) -> SourceModels:
    """Fit the features and every learner on the train part, with balanced weights.

    A learner that fails is reported and left out.
    """
    plain = prepared.where(~F.col("is_test")).select(text, "code")
    features = fit_features(spread(plain, text, analyzer), text, analyzer, **limits)
    train_rows = spread(plain, text, analyzer, len(features.stages[1].vocabulary))
    weights = class_weights(plain, "code").select("code", "weight")
    ready = featurise(train_rows, text, features).join(F.broadcast(weights), "code").select(
        "code", "weight", "features")
    labels = label_list(prepared, label)
    out = SourceModels(features)
    ready.persist()
    try:
        for name, learner in (learners or make_learners()).items():
            try:
                out.models[name] = PipelineModel([learner.fit(ready), ScoredLabel(model=name, labels=labels)])
            except Exception as e:  # one learner must not stop the others
                log.warning("training %s failed: %s", name, e)
    finally:
        ready.unpersist()
    if not out.models:
        raise ValueError("no model could be trained")
    return out


def model_columns(df: DataFrame, text: str | None, source: SourceModels) -> DataFrame:
    """Add ``label_{m}``, ``confidence_{m}`` and ``probability_{m}`` of each model.

    A model that cannot score is reported and left out; none left is an error.
    """
    out, used = featurise(df, text, source.features), 0
    for name, model in source.models.items():
        try:
            out, used = model.transform(out), used + 1
        except Exception as e:  # one model must not stop the others
            log.warning("model %s cannot predict: %s", name, e)
    if not used:
        raise ValueError("no model can predict")
    return out.drop("features")


def predict(df: DataFrame, text: str | None, source: SourceModels) -> DataFrame:
    """Add the voted category and the mean confidence of the models."""
    out = model_columns(df, text, source)
    names = [n for n in source.models if f"label_{n}" in out.columns]
    return out.withColumns({
        "predicted_category": majority_vote([F.col(f"label_{n}") for n in names]),
        "confidence": mean_confidence([F.col(f"confidence_{n}") for n in names]),
    }).drop(*[f"{kind}_{n}" for n in names for kind in ("label", "confidence", "probability")])


def predict_by_source(df: DataFrame, text: str, models: dict[str, SourceModels]) -> DataFrame:
    """Route rows to their source's models; rows of other sources get nulls.

    Each row keeps its own columns, so a file that mixes sources stays aligned.
    """
    source = F.col("transaction_source")
    rest = df.where(source.isNull() | ~source.isin(list(models)))
    out = rest.withColumns({"predicted_category": F.lit(None).cast("string"),
                            "confidence": F.lit(None).cast("double")})
    for name, parts in models.items():
        out = out.unionByName(predict(df.where(source == name), text, parts))
    return out


def evaluate(scored: DataFrame, truth: str, name: str, labels: list[str]) -> DataFrame:
    """One row of metrics of one model on held-out rows."""
    report = class_report(scored, truth, f"label_{name}")
    long = scored.select(truth, F.posexplode(f"probability_{name}").alias("k", "score")).select(
        F.element_at(F.lit(labels), F.col("k") + 1).alias("label"), "score",
        (F.element_at(F.lit(labels), F.col("k") + 1) == F.col(truth)).alias("positive"))
    roc = macro_average(roc_auc(long, "label", "positive", "score"), "roc_auc")
    # a class absent from the held-out rows has no precision to average
    pr = macro_average(average_precision(long, "label", "positive", "score"), "pr_auc")
    return report_averages(report).select(
        F.lit(name).alias("model"), "accuracy", "macro_f1", "weighted_f1", "support",
        roc.select("roc_auc").scalar().alias("roc_auc"),
        pr.select("pr_auc").scalar().alias("pr_auc"))


def save_models(source: SourceModels, path: str) -> dict[str, str]:
    """Write the features and models under a shared path; returns their locations."""
    places = {REQUIRED_COMPONENT: f"{path}/features"}
    source.features.write().overwrite().save(places[REQUIRED_COMPONENT])
    for name, model in source.models.items():
        places[name] = f"{path}/{name}"
        model.write().overwrite().save(places[name])
    return places


def load_models(places: dict[str, str]) -> SourceModels:
    """Load saved parts, which need nothing else to predict.

    A model that cannot be loaded is reported and left out; none left is an error.
    """
    out = SourceModels(PipelineModel.load(places[REQUIRED_COMPONENT]))
    for name, place in places.items():
        if name != REQUIRED_COMPONENT:
            try:
                out.models[name] = PipelineModel.load(place)
            except Exception as e:  # one model must not stop the others
                log.warning("model %s cannot be loaded: %s", name, e)
    if not out.models:
        raise ValueError("no model could be loaded")
    return out
