"""Element views over the driver's tables. Geometry is derived by integer arithmetic, in eighths, so that it is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(spark: SparkSession, df: DataFrame, part_bytes: int) -> int:
    """A partition for each `part_bytes` of the table's files (the planner's statistics), the session's cores at least."""
    return max(spark.sparkContext.defaultParallelism, -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // part_bytes))


def elements(spark: SparkSession, sf_dir: str, part_bytes: int = 8 << 20) -> DataFrame:
    """(slide, ord, id, type, role, ...) from lineitem; line numbers are not unique in an order, so their largest keys count. A slide's
    rows lie together, in as many partitions as the table's size asks for, so that a task's share doesn't grow with the table."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey").repartition(by_size(spark, li, part_bytes), "slide")
    g = rows.groupBy("slide", "ord").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    e = F.expr
    return g.select(
        "slide", "ord", "p", "s", F.concat(F.lit("el-"), "slide", F.lit("-"), "ord").alias("id"),
        e("(p % 107) / 8D").alias("x"), e("((s * 7 + ord * 5) % 60) / 8D").alias("y"), e("(1 + p % 31) / 8D").alias("w"), e("(1 + s % 11) / 8D").alias("h"),
        e("element_at(array('text', 'shape', 'image', 'line'), cast((p + ord) % 4 + 1 as int))").alias("type"),
        e("element_at(array('title', 'Body', 'caption', 'background', cast(null as string), cast(null as string)), cast(p % 6 + 1 as int))").alias("role"),
        e("element_at(array('{typography.card-metric}', '{typography.footnote}', cast(null as string), cast(null as string)), cast(s % 4 + 1 as int))").alias("typography"),
        e("cast(6 + p % 30 as double)").alias("font_size"), e("(24 + s % 24) / 32D").alias("line_height"),
    )


E_SQL = """e AS (SELECT slide, ord, p, s, 'el-' || slide || '-' || ord AS id,
  (p % 107) / 8::DOUBLE AS x, ((s * 7 + ord * 5) % 60) / 8::DOUBLE AS y, (1 + p % 31) / 8::DOUBLE AS w, (1 + s % 11) / 8::DOUBLE AS h,
  CASE (p + ord) % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'shape' WHEN 2 THEN 'image' ELSE 'line' END AS type,
  CASE p % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'Body' WHEN 2 THEN 'caption' WHEN 3 THEN 'background' END AS role,
  CASE s % 4 WHEN 0 THEN '{typography.card-metric}' WHEN 1 THEN '{typography.footnote}' END AS typography,
  CAST(6 + p % 30 AS DOUBLE) AS font_size, (24 + s % 24) / 32::DOUBLE AS line_height
  FROM (SELECT l_orderkey AS slide, l_linenumber AS ord, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2))"""


def with_styles(e: DataFrame) -> DataFrame:
    """Elements with texts, names and styles, some of which break rules; all by integer arithmetic."""
    x = F.expr
    return e.withColumns({
        "id": x("concat(element_at(array('card', 'panel', 'kpi', 'connector', 'backdrop'), cast(s % 5 + 1 as int)), '-', slide, '-', ord)"),
        "text": x("element_at(array('PLAIN', 'Some text', '标题 synergy', cast(null as string), concat('a', unhex('F09F9880'))), cast(p % 5 + 1 as int))"),
        "fill": x("element_at(array('#FFFFFF', 'linear-gradient(red, blue)', 'rounded.md'), cast(s % 3 + 1 as int))"),
        "stroke": x("if(p % 4 = 0, 'none', '1px')"), "shadow": x("if(s % 3 = 0, cast(null as string), 'soft')"),
        "shape": x("element_at(array('rect', 'ellipse', 'star'), cast(p % 3 + 1 as int))"),
        "src": x("if(s % 4 = 0, 'http://x/y.png', 'y.png')"), "font_family": x("concat('Font', p % 5, ', serif')"),
    })


ST_SQL = """st AS (SELECT slide, ord, p, s, x, y, w, h, type, role, typography, font_size, line_height,
  CASE s % 5 WHEN 0 THEN 'card' WHEN 1 THEN 'panel' WHEN 2 THEN 'kpi' WHEN 3 THEN 'connector' ELSE 'backdrop' END || '-' || slide || '-' || ord AS id,
  CASE p % 5 WHEN 0 THEN 'PLAIN' WHEN 1 THEN 'Some text' WHEN 2 THEN '标题 synergy' WHEN 4 THEN 'a😀' END AS text,
  CASE s % 3 WHEN 0 THEN '#FFFFFF' WHEN 1 THEN 'linear-gradient(red, blue)' ELSE 'rounded.md' END AS fill, CASE WHEN p % 4 = 0 THEN 'none' ELSE '1px' END AS stroke, CASE WHEN s % 3 = 0 THEN NULL ELSE 'soft' END AS shadow,
  CASE p % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'ellipse' ELSE 'star' END AS shape, CASE WHEN s % 4 = 0 THEN 'http://x/y.png' ELSE 'y.png' END AS src, 'Font' || p % 5 AS font FROM e)"""


def colour(n: Column) -> Column:
    """Six hexadecimal digits of a number."""
    return F.lpad(F.hex(n.cast("long")), 6, "0")


def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", colour((k % 64 * 4 + 1) * 65536 + k % 16 * 4096 + k % 8 * 32).alias("hex"))


def nation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("ord"), F.col("n_name").alias("token"), colour((n * 2 * 4 + 1) * 65536 + n * 2 % 16 * 4096 + n * 2 % 8 * 32).alias("hex"))


PC_SQL = "pc AS (SELECT p_partkey, p_brand, p_size, (p_partkey % 64 * 4 + 1) AS r, p_partkey % 16 * 16 AS g, p_partkey % 8 * 32 AS b FROM part)"
NT_SQL = "nt AS (SELECT n_nationkey AS ord, n_name AS token, (n_nationkey * 2 * 4 + 1) AS r, n_nationkey * 2 % 16 * 16 AS g, n_nationkey * 2 % 8 * 32 AS b FROM nation)"
