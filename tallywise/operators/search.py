"""Model search: successive halving over learners and their settings, judged on folds."""

from __future__ import annotations

import logging
from contextlib import nullcontext
from dataclasses import dataclass
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, functions as F

from tallywise.constants import SPLIT_SEED
from tallywise.operators.models import SourceModels, featurise, fit_features, label_list, make_learners, spread, dealt_parts, ROW_BYTES
from tallywise.operators.scores import class_weights
from tallywise.operators.stages import ScoredLabel
from tallywise.session import materialise, read_in, shuffles_dropped

log = logging.getLogger(__name__)

FOLDS = 5
SURVIVE = 3  # one candidate in three goes on
PREDICTIONS = "round int, candidate string, fold int, code int, predicted double"


@dataclass
class Found:
    """Outcome of a search. ``source`` holds the winner, fitted on the whole training part.

    ``predictions`` has one line per round, candidate and judged row, and ``scores`` follows from it.
    """

    winner: str
    source: SourceModels
    predictions: DataFrame
    scores: DataFrame


def make_candidates(seed: int = SPLIT_SEED) -> dict[str, Estimator]:
    """Every learner with three settings; names are ``learner`` and a number."""
    settings = {"logistic": [{"regParam": r} for r in (1e-4, 1e-3, 1e-2)],
                "forest": [{"numTrees": n, "maxDepth": d} for n, d in ((10, 5), (20, 8), (30, 10))],
                "bayes": [{"smoothing": s} for s in (0.1, 0.5, 1.0)]}
    out = {}
    for name, choices in settings.items():
        for i, choice in enumerate(choices):
            learner = make_learners(seed)[name]
            out[f"{name}_{i}"] = learner.copy({learner.getParam(k): v for k, v in choice.items()})
    return out


def with_folds(df: DataFrame, row: str, folds: int = FOLDS, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``fold`` and ``place``, a row's position in [0, 1) of a seeded order, both from its hash.

    Nothing is shuffled, the same row always gets the same values, and rows with ``place < s`` lie
    within those of every larger ``s``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:search:"), F.coalesce(F.col(row).cast("string"), F.lit(""))))
    number = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return df.withColumns({"fold": (number(1) % folds).cast("int"), "place": number(9) / F.lit(float(2**32))})


def round_plan(candidates: int, budget: float, survive: int = SURVIVE) -> list[tuple[int, float]]:
    """``(candidates, share of the training rows)`` of each round.

    ``budget`` counts fits on all training rows. Every round gets an equal part of it, so few candidates
    see many rows; no share exceeds one.
    """
    counts, n = [], candidates
    while True:
        counts.append(n)
        n = ceil(n / survive)
        if n == 1:
            break
    return [(n, min(1.0, budget / (len(counts) * n))) for n in counts]


def macro_scores(predictions: DataFrame) -> DataFrame:
    """``(round, candidate, n_rows, accuracy, macro_f1)``: averages over the classes in truth or prediction."""
    by = ["round", "candidate"]
    cells = predictions.groupBy(*by, "code", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("code") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("code").cast("double").alias("class"), F.col("n").alias("true"), none.alias("given"), hit.alias("correct")),
        F.struct(F.col("predicted").alias("class"), none.alias("true"), F.col("n").alias("given"), none.alias("correct")))).alias("s"))
    classes = sides.groupBy(*by, "s.class").agg(*[F.sum(f"s.{c}").alias(c) for c in ("true", "given", "correct")])
    return classes.groupBy(*by).agg(
        F.sum("true").alias("n_rows"), (F.sum("correct") / F.sum("true")).alias("accuracy"),
        F.avg(2 * F.col("correct") / (F.col("true") + F.col("given"))).alias("macro_f1"))


def halving(prepared: DataFrame, row: str, text: str, label: str, analyzer: str = "word",
            candidates: dict[str, Estimator] | None = None, budget: float = 6.0, folds: int = FOLDS,
            survive: int = SURVIVE, threads: int = 4, seed: int = SPLIT_SEED, **limits) -> Found:
    """Search all candidates and fit the winner on the whole training part.

    Each round fits the candidates left on their share of the rows outside one fold and judges them by
    macro F1 on that whole fold. The next round takes the next fold, so luck on one does not last. A
    candidate that fails is reported and goes out. Equal scores go by the smaller name. Vectors are made
    and written once; the driver gets the scores of a round, one line per candidate.
    """
    options = dict(candidates or make_candidates(seed))
    if len(options) < 1 or folds < 2:
        raise ValueError("a search needs a candidate and at least two folds")
    with shuffles_dropped(prepared.sparkSession):  # no plan of the search runs twice
        return _searched(prepared, row, text, label, analyzer, options, budget, folds, survive, threads, seed, limits)


def _searched(prepared: DataFrame, row: str, text: str, label: str, analyzer: str, options: dict[str, Estimator],
              budget: float, folds: int, survive: int, threads: int, seed: int, limits: dict) -> Found:
    spark = prepared.sparkSession
    plain = prepared.where(~F.col("is_test"))
    features = fit_features(spread(plain, text, analyzer), text, analyzer, **limits)
    train_rows = spread(plain, text, analyzer)
    weights = class_weights(plain, "code").select("code", "weight")
    ready = with_folds(featurise(train_rows, text, features), row, folds, seed).join(F.broadcast(weights), "code")
    # dealt out once, when they are written, and not again for every fit
    dealt = dealt_parts(spark, plain.count() * (ROW_BYTES + 4 * len(features.stages[1].vocabulary)))
    ready = ready.select("code", "weight", "features", "fold", "place")
    ready = materialise(spark, ready.repartition(dealt) if dealt else ready, "search")

    def tried(job: tuple[int, str, float]) -> DataFrame | None:
        number, name, share = job
        held = number % folds
        try:
            model = options[name].fit(ready.where((F.col("fold") != held) & (F.col("place") < share)))
            given = model.transform(ready.where(F.col("fold") == held))
            return materialise(spark, given.select(
                F.lit(number).alias("round"), F.lit(name).alias("candidate"), "fold", F.col("code").cast("int").alias("code"),
                F.col("prediction").alias("predicted")), "judged")
        except Exception as e:  # one candidate must not stop the others
            log.warning("candidate %s failed: %s", name, e)
            return None

    left, parts, plan = sorted(options), [], round_plan(len(options), budget, survive)
    with read_in(spark, dealt) if dealt else nullcontext(), ThreadPool(min(threads, len(left))) as pool:
        for number, (_, share) in enumerate(plan):
            judged = [p for p in pool.map(inheritable_thread_target(spark)(tried), [(number, n, share) for n in left]) if p is not None]
            if not judged:
                raise ValueError("no candidate could be trained and judged")
            parts += judged
            scores = macro_scores(union(judged)).select("candidate", "macro_f1").collect()
            ranked = sorted(scores, key=lambda s: (-s.macro_f1, s.candidate))
            left = sorted(s.candidate for s in ranked[:plan[number + 1][0] if number + 1 < len(plan) else 1])
        winner = left[0]
        fitted = options[winner].fit(ready)
    learner = winner.rsplit("_", 1)[0]
    source = SourceModels(features, {learner: PipelineModel(
        [fitted, ScoredLabel(model=learner, labels=label_list(prepared, label))])})
    predictions = union(parts)
    shares = F.element_at(F.lit([s for _, s in plan]), F.col("round") + 1)
    scores = macro_scores(predictions).withColumn("share", shares)
    return Found(winner, source, predictions, scores)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
