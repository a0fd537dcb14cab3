"""Every query against its SQL in DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioflow.operators import scoring
from folioflow.plans import queries as plans
from folioflow.plans import views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return str(v) if not isinstance(v, (int, bool, type(None), str)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    rel = duck.sql(plans.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_html_nodes_have_paths(spark):
    out = plans.QUERIES["html_nodes"](spark, DATA)
    assert out.where("parent >= 0 and not contains(path, '/')").count() == 0 < out.count()


def test_parts_of_elements_follow_the_tables_size(spark):
    few, many = (views.elements(spark, DATA, part_bytes=n).withColumn("part", F.spark_partition_id()).cache() for n in (1 << 30, 5_000))
    assert few.select("part").distinct().count() == 4 < 20 < many.select("part").distinct().count()
    assert many.select("slide", "part").distinct().count() == many.select("slide").distinct().count()
    assert few.drop("part").exceptAll(many.drop("part")).isEmpty() and few.count() == many.count()


def test_accessibility_reads_elements_twice(spark):
    plan = plans.QUERIES["accessibility"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2
    kind = "slide int, id string, type string, text string, h double, alt string, role string, font_size double, description string"
    rows = [
        (1, "heading", "text", "a", 0.1, None, None, 9.0, None), (1, "i", "image", None, 1.0, "", None, None, None), (1, "j", "image", None, 1.0, None, "decorative", None, None),
        (2, None, "text", "a", 0.1, None, None, None, None), (2, "c", "chart", None, 1.0, None, None, 1.0, " "), (2, "d", "chart", None, 1.0, None, None, 1.0, None),
        (3, "t", "text", " ", 1.0, None, None, 10.0, None), (4, None, None, None, None, None, None, None, None), (9, "x", "image", None, None, None, None, None, None),
    ]
    out = scoring.accessibility(spark.createDataFrame(rows, kind), spark.range(1, 6).selectExpr("cast(id as int) slide"), "slide")
    none = [(n, None, "warning", k) for n in (3, 4, 5) for k in ("no-text", "no-title")]
    own = [(1, "heading", "warning", "small-text"), (1, "i", "error", "image-alt"), (2, None, "warning", "no-title"), (2, "d", "warning", "chart-description"), (9, "x", "error", "image-alt")]
    assert out.columns == ["slide", "id", "severity", "kind"] and sorted(map(tuple, out.collect()), key=str) == sorted(none + own, key=str)


def test_every_centroid_counts(spark, tmp_path):
    many = spark.range(10_100).selectExpr("id AS vec_id", "cast(id AS int) AS label", "array(cast(id AS float)) AS embedding")
    many.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = plans.QUERIES["nearest_centroid"](spark, str(tmp_path)).where("vec_id % 10 = 0")
    assert out.where("nearest = vec_id and dist = 0").count() == 1010


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
