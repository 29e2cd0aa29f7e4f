"""File drop and quality monitor as streams: repeats, half-done work, late rows."""

import datetime as dt
import os
import random
import statistics

from pyspark.sql import functions as F

from tallywise.streaming import inbox as drop, monitor


def rule(rows):
    return rows.withColumns({"predicted_category": F.lower("description"), "confidence": F.lit(0.9)})


def listing(spark, folder):
    rows = [(f"file:{folder}/{n}", (folder / n).stat().st_size) for n in sorted(os.listdir(folder)) if (folder / n).is_file()]
    return spark.createDataFrame(rows, "path string, length long")


def test_batches_are_done_once(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    rows = "".join(f'2025-01-{i:02},"milk, grocery rent {i}",{i}.50,\n' for i in range(1, 13))
    (box / "house + kitty 100% [1].csv").write_text("Date,Item,Out,In\n" + rows + 'soon,"x",1,\n2025-02-01,"no money",,\n')
    (box / "notes.csv").write_text("a,b\n1,2\n")
    (box / "empty.csv").write_text("")
    (box / "scan.pdf").write_text("x")
    (box / "book.xlsx").write_text("x")
    assert drop.committed(spark, out).count() == 0
    first = listing(spark, box)
    drop.process_batch(spark, first, 0, out, rule)
    seen = {r.name: (r.status, r.row_count, r.issues[:1]) for r in drop.read_table(spark, out, "files").collect()}
    assert seen["house + kitty 100% [1].csv"] == ("accepted", 14, []) and seen["scan.pdf"] == ("rejected", 0, ["unknown extension"])
    assert seen["book.xlsx"][2] == ["not a text file"] and seen["empty.csv"][0] == "rejected" and seen["notes.csv"][1] == 1
    stage = drop.read_table(spark, out, "stage")
    assert stage.count() == 12 and stage.agg(F.sum("amount_out")).first()[0] == sum(range(1, 13)) + 6
    assert {(r.source, r.period, r.stage) for r in stage.collect()} == {("household", "2025-01", "predictions")}
    entry = drop.committed(spark, out).drop("done_at").collect()
    assert [(r.files, r.rejected, r.rows_read, r.rows_kept, r.batch) for r in entry] == [(5, 4, 15, 12, 0)]
    assert drop.read_table(spark, out, "metrics").first().batch_size == 12

    def again(rows):
        raise AssertionError("a finished batch was done again")

    drop.process_batch(spark, first, 0, out, again)

    def fails(rows):
        raise RuntimeError("lost")

    (box / "more.csv").write_text("Date,Item,Out,In\n" + rows)
    try:
        drop.process_batch(spark, listing(spark, box), 1, out, fails)
    except RuntimeError:
        pass
    assert drop.read_table(spark, out, "stage").count() == 12 and drop.read_table(spark, out, "files").count() == 5
    drop.process_batch(spark, listing(spark, box).where("path like '%more%'"), 1, out, rule)
    assert drop.read_table(spark, out, "stage").count() == 24 and drop.committed(spark, out).count() == 2


def test_stream_takes_new_files_only(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    rows = "".join(f"2025-01-{i:02},Shop {i},{i}.50,card\n" for i in range(1, 13))
    for n in ("a", "b"):
        (box / f"visa {n}.csv").write_text("Date,Merchant,Amount,Card\n" + rows)
        drop.run_inbox(spark, str(box), out, str(tmp_path / "cp"), rule).awaitTermination()
    assert drop.read_table(spark, out, "stage").count() == 24
    assert [r.files for r in drop.committed(spark, out).orderBy("batch").collect()] == [1, 1]


def plain(rows):
    out = {}
    for ts, source, c in rows:
        out.setdefault((ts[:10], source), []).append(c)
    return {k: (len(v), statistics.median([c for c in v if c is not None]) if any(c is not None for c in v) else None) for k, v in out.items()}


def test_monitor_over_batches(spark, tmp_path):
    r = random.Random(1)
    src, out = tmp_path / "src", str(tmp_path / "out")
    kind = "ts timestamp, transaction_source string, confidence double"

    def arrive(rows):
        df = spark.createDataFrame([(dt.datetime.fromisoformat(t), s, c) for t, s, c in rows], kind)
        df.coalesce(1).write.mode("append").parquet(str(src))
        q = monitor.run_daily_quality(spark.readStream.schema(kind).parquet(str(src)), out, str(tmp_path / "cp"))
        q.awaitTermination()
        return q

    def batch(day, n):
        return [(f"2025-01-{day:02} {r.randrange(24):02}:00:00", r.choice(["household", None]),
                 r.choice([None, r.random(), r.random(), 0.0, 1.0, 0.5])) for _ in range(n)]

    rows = []
    for day, n in ((1, 301), (1, 150), (2, 77), (5, 200)):
        more = batch(day, n)
        rows += more
        q = arrive(more)
    late = arrive([("2025-01-01 01:00:00", "household", 0.9)])  # its day has been released
    table = monitor.daily_quality(monitor.latest_counts(spark, out))
    got = {(x.day, x.transaction_source): (x.batch_size, x.median) for x in table.collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for k, (size, median) in want.items():
        assert got[k][0] == size and abs(got[k][1] - median) < 1e-12
    live = [p["stateOperators"][0]["numRowsTotal"] for p in late.recentProgress][-1]
    days = spark.read.parquet(out).where("day = '2025-01-05'").select("transaction_source", "confidence").distinct().count()
    assert live == days and q.exception() is None


def test_counted_median_of_odd_values(spark):
    rows = [("a", -2.0, 1), ("a", 3.0, 1), ("b", 1.0, 5), ("b", 7.5, 5), ("c", None, 4), ("d", 0.0004, 1), ("d", 0.0006, 1), (None, 0.25, 3)]
    got = monitor.counted_median(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "n").collect()
    assert {x.k: x.median for x in got} == {"a": 0.5, "b": 4.25, "d": 0.0005, None: 0.25}


def test_large_layouts_take_several_files(spark, sf, monkeypatch):
    from tallywise.plans import streams
    rows = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 10 < 6").groupBy(F.expr("o_orderkey % 10 % 5")).count().collect()
    wanted = {r[0]: r[1] for r in rows}
    monkeypatch.setattr(streams, "FILE_BYTES", 4000)
    monkeypatch.setattr(drop.files, "UPLOAD_MAX_BYTES", 6000)  # one file for each layout would be refused
    out = streams.inbox_results(spark, sf)
    found = drop.read_table(spark, out, "files").where("status = 'accepted'").withColumn("k", F.regexp_extract("file", r"layout=(\d)", 1))
    got = {int(r.k): (r.n, r.files) for r in found.groupBy("k").agg(F.sum("row_count").alias("n"), F.count("*").alias("files")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: wanted[k] for k in (0, 1, 2)} and all(f > 1 for _, f in got.values())
    assert drop.read_table(spark, out, "files").where("array_contains(issues, 'too large')").isEmpty()
    kept = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 10 in (0, 1, 2, 5) and o_orderkey % 7 <> 0").count()
    assert drop.read_table(spark, out, "stage").count() == kept


def test_inbox_of_refused_files_has_an_empty_stage(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    (box / "scan.pdf").write_text("x")
    drop.process_batch(spark, listing(spark, box), 0, out, rule)
    stage = drop.read_table(spark, out, "stage")
    assert stage.count() == 0 and {"source", "period", "stage", "predicted_category"} <= set(stage.columns)
