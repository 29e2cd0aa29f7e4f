"""Running balances and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.operators.ordered import Buckets, running_sums


def running_balance(df: DataFrame, account: str, bucket: Buckets, order: list[str],
                    money_out: str, money_in: str, opening: Column,
                    name: str = "calculated_balance") -> DataFrame:
    """Opening balance minus money out plus money in, in file order per account.

    ``bucket`` follows the order (month and day, or blocks of row numbers), so
    that even one account with most of the rows is spread over many tasks.
    """
    summed = running_sums(df, [account], bucket, [F.col(c) for c in order],
                          {"_moved": F.col(money_in) - F.col(money_out)})
    return summed.withColumn(name, opening + F.col("_moved")).drop("_moved")


def reconcile(df: DataFrame, stated: str, calculated: str = "calculated_balance") -> DataFrame:
    """Difference between stated and calculated balance where one was stated."""
    return (df.where(F.col(stated).isNotNull())
            .withColumn("diff", F.col(stated) - F.col(calculated))
            .withColumn("off", F.col("diff") != 0))
