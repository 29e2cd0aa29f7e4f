"""Files on disk: grids, detection end to end, sinks and manifests."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tallywise.operators import detect
from tallywise.operators.schema import resolve_grid_columns
from tallywise.sources import files, grids, sinks


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    d = tmp_path_factory.mktemp("inbox")
    good = ["Date,Description,Out,In"] + [f'{i}/1/2025,"grocery, run {i}",{i}.50,' for i in range(1, 11)]
    (d / "House Kitty Transactions - Cash 2025-01.csv").write_text("\n".join(good) + "\n")
    small = ["Date,Merchant,Amount"] + [f"2025-01-0{i},Shop,{i}" for i in range(1, 10)]
    (d / "visa statement card.csv").write_text("\n".join(small) + "\n")
    bad = ["When,What,Much"] + ["x,y,z"] * 12
    (d / "notes.csv").write_text("\n".join(bad) + "\n")
    half = ["Date,Item,Cost"] + [f"2025-01-01,{'milk' if i % 2 else ''},{'abc' if i < 3 else i}" for i in range(10)]
    (d / "household expenses half.csv").write_text("\n".join(half) + "\n")
    return d


def test_detection_end_to_end(spark, inbox):
    grid = files.scan_grid(spark, str(inbox)).cache()
    assert grid.groupBy("file").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.count_distinct("row_no").alias("n")).where(
        "a <> 0 or b + 1 <> n").count() == 0
    cols, rows = grids.header_cells(grid), grids.body_cells(grid)
    m = files.manifest(spark, [str(inbox)])
    listed = m.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "name", "size")
    known = grid.select("file").distinct()
    by_name = known.withColumn("name", F.url_decode(F.substring_index("file", "/", -1))).join(listed, "name").select("file", "name", "size")
    got = {r["name"]: r for r in detect.detect_files(by_name, cols, rows).collect()}
    house = got["House Kitty Transactions - Cash 2025-01.csv"]
    assert house.is_valid and house.source == "household" and house.row_count == 10
    assert house.detected_columns == {"amount": "out_in_pair", "amount_in": "In", "amount_out": "Out", "date": "Date", "description": "Description"}
    assert got["visa statement card.csv"].issues == ["too few rows: 9"]
    assert any(i.startswith("missing columns") for i in got["notes.csv"].issues) and got["notes.csv"].confidence == 0.5
    # half-filled text is still allowed; seven numbers in ten are too few
    assert got["household expenses half.csv"].issues == ["not numeric: Cost"]


def test_header_and_quotes(spark, inbox):
    grid = files.scan_grid(spark, str(inbox))
    rows = grids.body_cells(grid).where(F.contains("file", F.lit("Kitty"))).orderBy("row_no").collect()
    assert rows[0].cells["Description"] == "grocery, run 1" and rows[0].cells["In"] is None and len(rows) == 10


def by_rules(text):
    """(line number, cells) of every record that isn't blank, from the standard reader."""
    out, reader, last = [], csv.reader(io.StringIO(text, newline="")), 0
    for cells in reader:
        if cells:
            out.append((last, [c or None for c in cells]))
        last = reader.line_num
    return out


@pytest.mark.parametrize("split", [30, 1 << 20])
def test_records_over_splits(spark, tmp_path, split):
    r = random.Random(split)
    texts = {}
    for n in range(25):
        rows = []
        for _ in range(r.randint(1, 40)):
            cells = [r.choice(["", "a", "b c", 'say "hi"', "x,y", "two\nlines", '"', "\n\n", "\u00e9\u4e2d", 'end"\n"start', ",\n,"])
                     for _ in range(r.randint(1, 22))]
            rows.append(cells)
        buffer = io.StringIO(newline="")
        writer = csv.writer(buffer, lineterminator="\n")
        for cells in rows:
            buffer.write("\n" * r.choice([0, 0, 0, 1, 2]))
            writer.writerow(cells)
        texts[f"f{n}.csv"] = buffer.getvalue()
        (tmp_path / f"f{n}.csv").write_text(texts[f"f{n}.csv"], newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.scan_grid(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for row in got:
        found.setdefault(row.file.rsplit("/", 1)[1], []).append((row.row_no, row.cells))
    for name, text in texts.items():
        # a lone empty cell is written as two quotes and read as a row of one null
        assert sorted(found.get(name, []), key=lambda x: x[0]) == by_rules(text), name


def test_unclosed_quotes_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffDate,Note\n1,"open, and\n2,x\n3,5 pipe\n')
    (tmp_path / "b.csv").write_text('Date,Note\r\n1,"a"b,c\r\n\r\n2,"ok\n fine"\n3,"never\n4,z\n')
    got = {(r.file[-5:], r.row_no): r.cells for r in files.scan_grid(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", 0): ["Date", "Note"], ("a.csv", 1): ["1", '"open', " and"], ("a.csv", 2): ["2", "x"], ("a.csv", 3): ["3", "5 pipe"],
                   ("b.csv", 0): ["Date", "Note"], ("b.csv", 1): ["1", '"a"b', "c"], ("b.csv", 3): ["2", "ok\n fine"],
                   ("b.csv", 5): ["3", '"never'], ("b.csv", 6): ["4", "z"]}


def test_names_of_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nx,,x,x.1,x\n1,2,3,4,5,6\n1\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    (tmp_path / "c.csv").write_text("a,c,b\n3,4,5\n")
    grid = files.scan_grid(spark, str(tmp_path / "a.csv"))
    names = ["x", "Unnamed: 1", "x.1#2", "x.1", "x.2"]
    assert [r.column for r in grids.header_cells(grid).orderBy("ordinal").collect()] == names
    rows = grids.body_cells(grid).orderBy("row_no").collect()
    assert rows[0].cells == dict(zip([*names, "Unnamed: 5"], "123456")) and rows[1].cells == {**dict.fromkeys(names), "x": "1"}
    mixed = files.scan_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "c.csv")])
    assert sorted(((r.a, r.b, r.c) for r in mixed.collect()), key=str) == [("2", "1", None), ("3", "5", "4")]


def test_grid_column_choice():
    assert resolve_grid_columns(["Posting_Date", "x", "y"]) == {"date": "Posting_Date", "description": "x", "amount": "y"}
    assert resolve_grid_columns(["Value", "Item", "DATE"]) == {"date": "DATE", "description": "Item", "amount": "Value"}
    with pytest.raises(ValueError):
        resolve_grid_columns(["a", "b"])


def test_registry_json(spark, tmp_path):
    doc = {"models": {"m": {str(v): {"locations": {"local": f"p{v}"}, "metrics": {"f": v / 10}, "training_data": "t",
                                     "timestamp": "2025-01-01T00:00:00", "status": "active"} for v in (9, 10)}}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    from tallywise.operators.registry import empty_registry, latest_versions, old_versions
    e = files.scan_registry(spark, str(tmp_path))
    assert latest_versions(e).first().version == 10
    assert [r.version for r in old_versions(e, 1).collect()] == [9]
    assert empty_registry(spark).count() == 0


def test_dictionary(spark, tmp_path):
    words = spark.createDataFrame([("b:c",), ("a",), ("b",)], "category string")
    sinks.write_dictionary(words, str(tmp_path / "d"))
    assert sorted(r.category for r in files.scan_dictionary(spark, str(tmp_path / "d")).collect()) == ["a", "b", "b:c"]
    (tmp_path / "empty.txt").write_text("  \n\n")
    with pytest.raises(ValueError):
        files.scan_dictionary(spark, str(tmp_path / "empty.txt"))


def test_stage_partitions_prune(spark, tmp_path):
    rows = spark.createDataFrame([(1, "household", "2025-01", "predictions"), (2, "credit_card", "2025-02", "corrected")],
                                 "id int, source string, period string, stage string")
    sinks.write_stage(rows, str(tmp_path / "s"))
    one = spark.read.parquet(str(tmp_path / "s")).where("source = 'household' and stage = 'predictions'")
    assert [r.id for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(source" in one._jdf.queryExecution().toString()


def test_statement_files_are_cut_and_keep_all_rows(spark, sf, monkeypatch):
    from tallywise.plans import file_scans
    whole = file_scans.named_cells(spark, sf)
    monkeypatch.setattr(file_scans, "ROWS_PER_FILE", 30)
    cut = file_scans.named_cells(spark, sf)
    assert len(set(r[0] for r in spark.read.text(file_scans.statement_files(spark, sf, 30)).select("_metadata.file_path").distinct().collect())) > 5
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty() and whole.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
