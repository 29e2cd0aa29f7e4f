"""Running balances, registry views, retention and prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.operators import balance, ordered, registry as reg
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, text_of_map

MOVES = """moves AS (SELECT o_orderkey, o_custkey AS account, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderstatus = 'P' AS paid_in FROM orders),
bal AS (SELECT *, 1000 + SUM(CASE WHEN paid_in THEN p ELSE -p END) OVER (PARTITION BY account ORDER BY o_orderdate, o_orderkey
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS calculated FROM moves)"""


def balances(spark, d):
    p = F.col("o_totalprice").cast("decimal(18,2)")
    paid_in = F.col("o_orderstatus") == "P"
    zero = F.lit(0).cast("decimal(18,2)")
    moves = b.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("account"), "o_orderdate",
        F.when(paid_in, zero).otherwise(p).alias("out"), F.when(paid_in, p).otherwise(zero).alias("in"))
    return balance.running_balance(moves, "account", [F.year("o_orderdate") * 12 + F.month("o_orderdate"), F.col("o_orderdate"), b.key_block("o_orderkey")],
                                   ["o_orderdate", "o_orderkey"], "out", "in", F.lit(1000).cast("decimal(18,2)"), "calculated")


@query("g01_running_balance", f"WITH {MOVES} SELECT o_orderkey, account, CAST(calculated AS DOUBLE) AS calculated FROM bal")
def running_balance(spark, d):
    return balances(spark, d).select("o_orderkey", "account", "calculated")


@query("g02_reconciliation", f"""WITH {MOVES}, s AS (SELECT *, calculated + CASE WHEN o_orderkey % 70 = 0 THEN 5 ELSE 0 END AS balance FROM bal WHERE o_orderkey % 35 = 0)
SELECT o_orderkey, CAST(balance AS DOUBLE) AS balance, CAST(balance - calculated AS DOUBLE) AS diff, balance <> calculated AS off FROM s""")
def reconciliation(spark, d):
    k = F.col("o_orderkey")
    stated = F.when(k % 35 == 0, F.col("calculated") + F.when(k % 70 == 0, 5).otherwise(0))
    r = balance.reconcile(balances(spark, d).withColumn("balance", stated), "balance", "calculated")
    return r.select("o_orderkey", "balance", "diff", "off")


@query("g03_latest_versions", f"""WITH {b.REGISTRY}, l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY version DESC) AS k FROM entries)
SELECT model, version, 'local=' || location AS locations, 'accuracy=' || accuracy || ';macro_f1=' || macro_f1 AS metrics, training_data, status, strftime(ts, '%Y-%m-%d') AS ts FROM l WHERE k = 1""")
def latest_versions(spark, d):
    e = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    return e.select("model", "version", text_of_map(F.col("locations")).alias("locations"),
                    text_of_map(F.col("metrics")).alias("metrics"), "training_data", "status",
                    F.col("ts").cast("date").alias("ts"))


@query("g03_version_list", f"""WITH {b.REGISTRY} SELECT model, COUNT(DISTINCT version) AS versions, MIN(version) AS first_version, MAX(version) AS last_version FROM entries GROUP BY 1""")
def version_list(spark, d):
    return reg.version_list(reg.current_entries(b.registry_events(spark, d)))


@query("g03_entry_at_version", f"""WITH {b.REGISTRY} SELECT model, version, training_data FROM entries WHERE model = 'household_forest' AND version = 9
UNION ALL (SELECT model, version, training_data FROM entries WHERE model = 'household_logistic' ORDER BY version DESC LIMIT 1)""")
def entry_at_version(spark, d):
    e = reg.current_entries(b.registry_events(spark, d))
    cols = ["model", "version", "training_data"]
    return reg.entry_at(e, "household_forest", 9).select(*cols).union(reg.entry_at(e, "household_logistic").select(*cols))


@query("g06_old_versions", f"""WITH {b.REGISTRY}, l AS (SELECT model, version, ROW_NUMBER() OVER (PARTITION BY model ORDER BY version DESC) AS k FROM entries)
SELECT model, version FROM l WHERE k > 3""")
def old_versions(spark, d):
    return reg.old_versions(reg.current_entries(b.registry_events(spark, d)), 3).select("model", "version")


@query("g06_old_prediction_files", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS modified FROM orders WHERE o_orderdate < DATE '2001-08-01' - 30""")
def old_files(spark, d):
    f = b.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("modified"))
    return reg.older_than(f, "modified", F.lit("2001-08-01").cast("date"))


@query("g05_sample_prefix", f"""WITH {b.NUMBERED} SELECT file, o_orderkey, row_no + 1 AS pos FROM numbered WHERE row_no < 10""")
def sample_prefix(spark, d):
    o = b.table(spark, d, "orders").withColumnRenamed("o_custkey", "file")
    return ordered.first_rows(o, ["file"], [F.col("o_orderdate"), F.col("o_orderkey")], 10, "pos").select("file", "o_orderkey", "pos")


@query("k12_status_change", f"""WITH {b.REGISTRY} SELECT model, version, CASE WHEN version % 10 = 0 THEN 'archived' ELSE status END AS status, training_data FROM entries""")
def status_change(spark, d):
    ev = b.registry_events(spark, d)
    many = ev.where("version % 10 = 0").select("model", "version").distinct()
    absent = many.where("version = 10").withColumn("version", F.col("version") + 990)
    changes = many.union(absent).select("model", "version", F.lit("archived").alias("status"),
                                        F.lit(10**12).alias("seq"))
    after = reg.status_change(ev, changes, F.lit("2025-01-01").cast("timestamp"))
    return reg.current_entries(after).select("model", "version", "status", "training_data")
