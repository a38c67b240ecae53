"""Scans with bounds and parameters, header lines by place, and table functions."""

from __future__ import annotations

import datetime

import pytest

from pricewright.functions import table_functions
from pricewright.sources import tables


def test_parameters_are_bound_as_literals():
    query = "SELECT * FROM t WHERE a = :name AND b > :low AND c = ':name' AND d = x::text AND e = :day"
    got = tables.bound(query, name="O'Neil :low", low=3, day=datetime.date(2024, 5, 1))
    assert got == "SELECT * FROM t WHERE a = 'O''Neil :low' AND b > 3 AND c = ':name' AND d = x::text AND e = '2024-05-01'"
    assert [tables.sql_literal(v) for v in (None, True, 1.5)] == ["NULL", "1", "1.5"]
    for bad in (float("nan"), "a\x00b", object()):
        with pytest.raises(ValueError):
            tables.sql_literal(bad)
    with pytest.raises(KeyError):
        tables.bound("SELECT :missing")


def test_a_database_is_read_in_parts_with_parameters(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/prices;create=true"
    rows = spark.createDataFrame([(i, f"p{i % 3}", float(i)) for i in range(40)], "id int, name string, price double")
    rows.write.format("jdbc").options(url=url, dbtable="prices", createTableColumnTypes="name VARCHAR(20)").save()
    found = tables.jdbc(spark, url, 'SELECT * FROM prices WHERE "name" = :name', {"name": "p1"}, split=("id", 0, 40, 4))
    assert sorted(r.id for r in found.collect()) == list(range(1, 40, 3))
    plan = found.where("price > 10")._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=4" in plan and "price" in plan[plan.index("PushedFilters") :]
    assert tables.jdbc(spark, url, "SELECT * FROM prices", rows=5).count() == 5


def test_header_lines_go_by_their_place(spark, tmp_path):
    folder = tmp_path / "sheet"
    folder.mkdir()
    head = "size,,weight\nw,h,g\n"
    body = "1,2,3\nsize,,weight\nw,h,g\n" + "".join(f"{i},{i + 1},x\n" for i in range(3000))
    (folder / "part-0000.csv").write_text(head + body)
    (folder / "part-0001.csv").write_text("w,h,g\n7,8,9\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tables.two_row_csv(spark, str(folder))
            rows = sorted(tuple(r) for r in got.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got.columns == ["size__w", "size__h", "weight__g"]
        expected = [("1", "2", "3"), ("size", None, "weight"), ("w", "h", "g"), ("w", "h", "g"), ("7", "8", "9"), *[(str(i), str(i + 1), "x") for i in range(3000)]]
        assert sorted(rows, key=str) == sorted(expected, key=str)
    assert tables.two_row_csv(spark, str(folder), 10).count() == 10
    (tmp_path / "short.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tables.two_row_csv(spark, str(tmp_path / "short.csv"))


def test_sheets_unfold_in_sql(spark):
    table_functions.register(spark)
    sheets = spark.createDataFrame(
        [(1, '[{"key":"a","value":"x"},{"key":"b","value":"y"},{"key":"a","value":"z"}]'), (2, "not json"), (3, None), (4, '[{"key":"c"},"stray",{"key":"n","value":5}]')],
        "id int, sheet string",
    )
    rows = spark.sql("SELECT id, feature, value FROM {sheets}, LATERAL kv(sheet, 'f_')", sheets=sheets).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "f_a", "z"), (1, "f_b", "y"), (4, "f_c", None), (4, "f_n", "5")], key=str)
    texts = spark.createDataFrame([(1, "one\n \nthree"), (2, None)], "id int, text string")
    rows = spark.sql("SELECT * FROM {texts}, LATERAL paragraphs(text)", texts=texts).collect()
    assert [(r.place, r.section, r.value) for r in rows] == [(1, "paragraph_1", "one"), (3, "paragraph_3", "three")]
