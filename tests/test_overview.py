"""Catalogues, timelines and usage on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tracelens.operators import catalog
from tracelens.operators.catalog import Dated


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "id long, s string")
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        (df.write.option("header", True).option("escape", '"') if fmt == "csv" else df.write).format(fmt).save(path)
        assert sorted((r.id, r.s) for r in catalog.read_table(spark, path, fmt, "id long, s string").collect()) == [(1, 'a "b"\nc'), (2, None)]
    with pytest.raises(ValueError, match="no reader"):
        catalog.read_table(spark, str(tmp_path), "docx")


def test_timeline_takes_the_time_of_the_row_then_of_the_id(spark):
    rows = spark.createDataFrame([(1, 5, "T2401020304055"), (2, None, "T2401020304055"), (3, None, "none"), (4, 9, None)], "id long, ms long, ref string")
    c = F.col
    line = catalog.unified_timeline({"a": Dated(rows, c("id"), c("ms"), c("ref"), embedded=c("ref")), "b": Dated(rows, c("id"), c("ms"), c("ref"), newest=1)})
    assert {(r.source, r.ref, r.ms, r.dated_by) for r in line.collect()} == {("a", "1", 5, "row"), ("a", "2", 1704164645000, "id"), ("a", "4", 9, "row"), ("b", "4", 9, "row")}
    assert {r.source: (r.n, r.n_by_id) for r in catalog.timeline_counts(line).collect()} == {"a": (3, 1), "b": (1, 0)}


def test_views_and_search(spark):
    tables = {"people": spark.createDataFrame([(1, "Ann"), (2, "Bob ANN")], "id long, name string"), "none": spark.createDataFrame([], "x string")}
    names = catalog.build_indexes(tables)
    assert names == ["idx_people", "idx_none"] and spark.table("idx_people").count() == 2
    found = {r.table: (r.n, r.sample) for r in catalog.search_everywhere(tables, "ann", 1).collect()}
    assert found == {"people": (2, ['{"id":1,"name":"Ann"}']), "none": (0, [])}
    assert {r.table: (r.n_rows, r.covered) for r in catalog.table_inventory(tables, ["people"]).collect()} == {"people": (2, True), "none": (0, False)}
