"""Uploads in several splits, with and without line breaks in fields."""

import csv
import io
import random

import pytest

from stockloom.operators.cleanse import MALFORMED
from stockloom.sources import files


def text_of(rows, header=("product_id", "price", "note"), end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerows([header, *rows])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def made(n, breaks, seed=3):
    rng = random.Random(seed)
    notes = ["plain", 'a "quoted" word', "x, y", *(["two\nlines", "\n\nthree\n", "broken " * 60 + "\n" + "long " * 120] if breaks else [])]
    return [(f"P{i}", str(rng.randint(1, 99)), rng.choice(notes)) for i in range(n)]


@pytest.mark.parametrize("breaks", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_splits(spark, small_splits, tmp_path, breaks, end):
    rows = made(200, breaks)
    (tmp_path / "a.csv").write_text(text_of(rows, end=end), newline="")
    got = files.read_bulk_csv(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    found = got.collect()
    assert sorted((r.product_id, r.price, r.note) for r in found) == sorted((a, b, c.strip(" ")) for a, b, c in rows)
    assert not any(r[MALFORMED] for r in found)


def test_mixed_headers_malformed_rows_and_a_broken_header(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text(text_of(made(40, True)) + 'P900,1\nP901,1,n,more\n\nP902,5,"in\ntwo"\n')
    (tmp_path / "b.csv").write_text(text_of([("7", "Q1")], ("price", "product_id")))
    (tmp_path / "c.csv").write_text('"no\nte",product_id\n"v",R1\n')
    got = files.read_bulk_csv(spark, str(tmp_path))
    bad = {r.product_id: r[MALFORMED] for r in got.filter(f"{MALFORMED} is not null").collect()}
    assert bad == {"P900": "P900,1", "P901": "P901,1,n,more"}
    by_id = {r.product_id: r for r in got.collect()}
    assert len(by_id) == got.count() == 45
    assert (by_id["P902"].note, by_id["Q1"].price, by_id["Q1"].note, by_id["R1"]["no\nte"]) == ("in\ntwo", "7", None, "v")


def test_folder_without_lines(spark, tmp_path):
    assert files.read_bulk_csv(spark, str(tmp_path)).collect() == []
    (tmp_path / "a.csv").write_text("")
    assert files.read_bulk_csv(spark, str(tmp_path)).columns == [MALFORMED]
    (tmp_path / "b.csv").write_text("price,note\n")
    assert files.read_bulk_csv(spark, str(tmp_path)).columns == ["price", "note", MALFORMED]
