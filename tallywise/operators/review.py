"""Review queue, corrections and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import REVIEW_CONFIDENCE
from tallywise.functions.dates import lenient_date, strip
from tallywise.functions.money import lenient_number
from tallywise.operators.ordered import positions

MONEY_COLUMNS = ["Amount (Negated)", "Amount", "confidence"]


def review_queue(df: DataFrame, below: float = REVIEW_CONFIDENCE) -> DataFrame:
    return df.where(F.col("confidence") < below)


def last_requests(requests: DataFrame, key: str, label: str, seq: str) -> DataFrame:
    """The last usable request per row, and how many usable ones there were."""
    usable = requests.where(F.col(key).isNotNull() & (F.col(label) != ""))
    return usable.groupBy(key).agg(F.max_by(label, seq).alias(label),
                                   F.count(F.lit(1)).alias("requests"))


def apply_corrections(df: DataFrame, requests: DataFrame, key: str, target: str,
                      label: str = "new_category", seq: str = "seq") -> DataFrame:
    """Set the corrected label and full confidence; other rows stay as they are.

    ``requests`` on the result counts the requests applied to the row. Ids that
    match no row change nothing.
    """
    last = last_requests(requests, key, label, seq)
    return (df.join(last, key, "left")
            .withColumns({target: F.coalesce(label, target),
                          "confidence": F.when(F.col(label).isNotNull(), F.lit(1.0))
                                         .otherwise(F.col("confidence")),
                          "requests": F.coalesce("requests", F.lit(0).cast("long"))})
            .drop(label))


def apply_review(df: DataFrame, answers: DataFrame, key: str, target: str,
                 below: float = REVIEW_CONFIDENCE) -> DataFrame:
    """Corrections that only reach low-confidence rows; a blank answer keeps."""
    given = answers.where(strip(F.col("answer")) != "").groupBy(key).agg(
        F.max_by("answer", "seq").alias("answer"))
    take = F.col("answer").isNotNull() & (F.col("confidence") < below)
    return (df.join(given, key, "left")
            .withColumns({target: F.when(take, strip(F.col("answer"))).otherwise(F.col(target)),
                          "confidence": F.when(take, F.lit(1.0)).otherwise(F.col("confidence"))})
            .drop("answer"))


def changed_labels(df: DataFrame, edited: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Rows whose stripped new label is not blank and differs from the prediction."""
    fresh = strip(F.col(new))
    return (df.select(key, old).join(edited.select(key, fresh.alias(new)), key)
            .where((F.col(new) != "") & F.coalesce(F.col(new) != F.col(old), F.lit(True))))


def audit(predicted: DataFrame, corrected: DataFrame, key: str) -> DataFrame:
    """Predicted against corrected label per row; ``check`` as Correct / Not Correct."""
    return predicted.join(corrected, key).withColumn(
        "check", F.when(F.col("predicted_category") == F.col("category"), "Correct")
        .otherwise("Not Correct"))


def search_categories(dictionary: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """First dictionary entries that contain the text in any case."""
    hit = F.contains(F.lower(F.col("category")), F.lit(text.lower()))
    return dictionary.where(hit).orderBy("category").limit(limit)


def sort_key(column: str) -> Column:
    """Sort key by the kind of column: number, date or lower-case text."""
    c = F.col(f"`{column}`")
    if column in MONEY_COLUMNS:
        return F.coalesce(lenient_number(c), F.lit(0.0))
    if column == "Date":
        return lenient_date(c)
    return F.lower(c.cast("string"))


def sort_order(column: str, row_order: str, descending: bool = False) -> list[Column]:
    """Order of the stable sort by one column; missing values are smallest."""
    key = sort_key(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col(row_order).asc_nulls_first()]


def sort_rows(df: DataFrame, column: str, row_order: str, descending: bool = False) -> DataFrame:
    """Type-aware stable sort of review rows."""
    return df.orderBy(*sort_order(column, row_order, descending))


def sorted_positions(df: DataFrame, column: str, row_order: str, descending: bool = False, name: str = "position") -> DataFrame:
    """The same order as a position column, so that any page of it is a filter."""
    return positions(df, sort_order(column, row_order, descending), name)


def preview(df: DataFrame, row_order: str, n: int = 20) -> DataFrame:
    return df.orderBy(row_order).limit(n)
