"""Operators bound to the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks, marks, matching, ordered, pages, preflight, scoring, structure, validation
from ..sources import readers, sinks
from .views import E_SQL, NT_SQL, PC_SQL, ST_SQL, colour, elements, nation_tokens, part_colours, table, with_styles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def up(expr: str, digits: int = 4) -> str:
    """Half-up rounding in SQL."""
    return f"(floor(({expr}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"


OUT_SQL = "(least(x, x + w) < -0.005::DOUBLE OR least(y, y + h) < -0.005::DOUBLE OR greatest(x, x + w) > 13.333::DOUBLE + 0.005::DOUBLE OR greatest(y, y + h) > 7.5::DOUBLE + 0.005::DOUBLE)"
AREA = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
HOLDS = "(({1}.x >= {0}.x - 0.01::DOUBLE) AND ({1}.y >= {0}.y - 0.01::DOUBLE) AND ({1}.x + {1}.w <= {0}.x + {0}.w + 0.01::DOUBLE) AND ({1}.y + {1}.h <= {0}.y + {0}.h + 0.01::DOUBLE))"
ROLE_SQL = """er AS (SELECT *, CASE WHEN role IS NOT NULL THEN lower(role) WHEN typography = '{typography.card-metric}' THEN 'metric'
  WHEN typography = '{typography.footnote}' THEN 'caption' WHEN font_size >= 32 THEN 'metric' WHEN font_size >= 18 THEN 'title' ELSE 'body' END AS rb FROM e)"""


def values(rules: dict[str, tuple[float, float]]) -> str:
    return "(VALUES " + ", ".join(f"('{r}', {a}::DOUBLE, {b}::DOUBLE)" for r, (a, b) in rules.items()) + ") AS r(role, c, w)"


def with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).withColumn("role_bucket", C.layout_role(F.col("role"), F.col("typography"), F.col("id"), F.col("font_size")))


@query(f"""WITH {E_SQL}, {ST_SQL}, o AS (SELECT *, type = 'shape' AND (id LIKE 'card%' OR id LIKE 'panel%') AS surface FROM st WHERE type <> 'line' AND coalesce(role, '') <> 'background' AND id NOT LIKE 'backdrop%')
SELECT a.slide, a.ord AS a_ord, b.ord AS b_ord, {up(f"{AREA} / least(a.w * a.h, b.w * b.h)")} AS ratio
FROM o a JOIN o b ON a.slide = b.slide AND a.ord < b.ord
WHERE NOT (a.surface AND {HOLDS.format("a", "b")}) AND NOT (b.surface AND {HOLDS.format("b", "a")}) AND {AREA} / least(a.w * a.h, b.w * b.h) > 0.05::DOUBLE""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01, P11, F06"""
    return checks.overlap_pairs(with_styles(elements(spark, sf_dir)), ["slide"]).select("slide", "a_ord", "b_ord", "ratio")


@query(f"WITH {E_SQL} SELECT slide, ord, (x < 0 OR y < 0 OR w <= 0 OR h <= 0 OR x + w > 13.333::DOUBLE OR y + h > 7.5::DOUBLE) AS strict FROM e WHERE {OUT_SQL}")
def bounds_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01, F02"""
    return checks.bounds(elements(spark, sf_dir)).select("slide", "ord", "strict")


@query(f"""WITH {E_SQL}, {ROLE_SQL}, m AS (
SELECT slide, ord, rb, 'font-size' AS metric, font_size AS v, c, r.w AS k FROM er JOIN {values(C.FONT_SIZE_RULES)} ON r.role = CASE WHEN rb IN ('background') THEN 'body' ELSE rb END
UNION ALL SELECT slide, ord, rb, 'line-height', line_height, c, r.w FROM er JOIN {values(C.LINE_HEIGHT_RULES)} ON r.role = CASE WHEN rb IN ('background') THEN 'body' ELSE rb END)
SELECT slide, ord, rb AS role_bucket, metric, v AS value, CASE WHEN v < c THEN 'critical' ELSE 'warning' END AS severity FROM m WHERE v < c OR v < k""")
def role_threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules in one pass."""
    row = lambda metric, v, rules: F.struct(F.lit(metric).alias("metric"), F.col(v).alias("value"), preflight.severity(F.col(v), rules, F.col("role_bucket")).alias("severity"))
    found = F.array(row("font-size", "font_size", C.FONT_SIZE_RULES), row("line-height", "line_height", C.LINE_HEIGHT_RULES))
    return with_roles(spark, sf_dir).select("slide", "ord", "role_bucket", F.inline(F.filter(found, lambda x: x["severity"].isNotNull())))


@query(f"""WITH {E_SQL} SELECT ord, count(*) AS n, style_role FROM (SELECT *, CASE WHEN role IS NOT NULL THEN CASE WHEN lower(role) IN ('title', 'caption') THEN lower(role) ELSE 'body' END
WHEN typography IS NOT NULL THEN CASE WHEN typography LIKE '%footnote%' THEN 'caption' ELSE 'body' END
WHEN font_size >= 24 THEN 'title' WHEN font_size >= 16 THEN 'heading' WHEN font_size <= 10 THEN 'caption' ELSE 'body' END AS style_role FROM e) GROUP BY ord, style_role""")
def style_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P05"""
    role = C.style_role(F.col("role"), F.col("typography"), F.col("id"), F.col("font_size"))
    return elements(spark, sf_dir).groupBy("ord", role.alias("style_role")).agg(F.count("*").alias("n"))


GAP = "sqrt(pow(greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)), 2) + pow(greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)), 2))"


@query(f"""WITH {E_SQL}, {ST_SQL}, k AS (SELECT * FROM st WHERE type = 'shape' AND id LIKE 'card%')
SELECT a.slide, a.ord AS a_ord, b.ord AS b_ord, {up(GAP)} AS gap FROM k a JOIN k b ON a.slide = b.slide AND a.ord < b.ord WHERE (a.x + a.w <= b.x OR b.x + b.w <= a.x OR a.y + a.h <= b.y OR b.y + b.h <= a.y) AND {GAP} < 0.5::DOUBLE""")
def card_spacing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02, P11"""
    return checks.spacing_pairs(with_styles(elements(spark, sf_dir)), ["slide"]).select("slide", "a_ord", "b_ord", "gap")


def touch_sql(px: str, py: str, r: str) -> str:
    s = "0.08::DOUBLE"
    return f"({px} >= {r}.x - {s} AND {px} <= {r}.x + {r}.w + {s} AND {py} >= {r}.y - {s} AND {py} <= {r}.y + {r}.h + {s} AND least(abs({px} - {r}.x), abs({px} - ({r}.x + {r}.w)), abs({py} - {r}.y), abs({py} - ({r}.y + {r}.h))) <= {s})"


END = "CASE WHEN p % 7 = 0 THEN NULL ELSE 'el-' || slide || '-' || ((ord + {}) % 5) END"
LINE_SQL = f"""c AS (SELECT slide, ord, p, s, type, x, y, w, h, CASE WHEN s % 5 = 3 AND p % 7 = 0 THEN 'arrow' ELSE 'el-' || slide || '-' || (ord % 5) END AS id, {END.format(4)} AS source_id, {END.format(1)} AS target_id FROM e),
b AS (SELECT slide, id, arg_max({{'x': x, 'y': y, 'w': w, 'h': h}}, ord) AS r FROM c GROUP BY 1, 2),
j AS (SELECT l.*, s.r AS s_, t.r AS t_ FROM c l LEFT JOIN b s ON s.slide = l.slide AND s.id = l.source_id LEFT JOIN b t ON t.slide = l.slide AND t.id = l.target_id WHERE l.type = 'line')"""
MID = "(({1}.x + {1}.w / 2) - ({0}.x + {0}.w / 2))", "(({1}.y + {1}.h / 2) - ({0}.y + {0}.h / 2))"


def anchor_sql(a: str, b: str) -> tuple[str, str]:
    dx, dy = (m.format(a, b) for m in MID)
    flat = f"abs({dx}) > abs({dy})"
    return f"CASE WHEN {flat} THEN CASE WHEN {dx} >= 0 THEN {a}.x + {a}.w ELSE {a}.x END ELSE {a}.x + {a}.w / 2 END", f"CASE WHEN {flat} THEN {a}.y + {a}.h / 2 ELSE CASE WHEN {dy} >= 0 THEN {a}.y + {a}.h ELSE {a}.y END END"


@query(f"""WITH {E_SQL}, {LINE_SQL}, k AS (SELECT *, CASE WHEN source_id IS NULL AND target_id IS NULL THEN CASE WHEN id = 'arrow' THEN 'unverified' ELSE 'plain' END WHEN s_ IS NULL THEN 'missing-source' WHEN t_ IS NULL THEN 'missing-target'
WHEN NOT {touch_sql("x", "y", "s_")} OR NOT {touch_sql("(x + w)", "(y + h)", "t_")} THEN 'detached' ELSE 'attached' END AS status FROM j)
SELECT slide, ord, status, CASE WHEN status = 'unverified' THEN 'warning' WHEN status NOT IN ('attached', 'plain') THEN 'critical' END AS severity, CASE WHEN status = 'missing-source' THEN source_id WHEN status IN ('missing-target', 'detached') THEN target_id END AS related,
CASE WHEN status = 'detached' THEN {up(anchor_sql("s_", "t_")[0])} END AS to_x, CASE WHEN status = 'detached' THEN {up(anchor_sql("s_", "t_")[1])} END AS to_y, CASE WHEN status = 'detached' THEN {up(f"({anchor_sql('t_', 's_')[0]}) - ({anchor_sql('s_', 't_')[0]})")} END AS to_w FROM k""")
def connector_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids repeat in longer slides, so that the last wins."""
    e = elements(spark, sf_dir)
    end = lambda step: F.when(F.col("p") % 7 != 0, F.concat(F.lit("el-"), "slide", F.lit("-"), (F.col("ord") + step) % 5))
    e = e.withColumns({"id": F.when((F.col("s") % 5 == 3) & (F.col("p") % 7 == 0), "arrow").otherwise(F.concat(F.lit("el-"), "slide", F.lit("-"), F.col("ord") % 5)), "source_id": end(4), "target_id": end(1)})
    to = lambda c: C.half_up(F.col(f"suggestion.{c}"), 4).alias(f"to_{c}")
    return checks.connectors(e, ["slide"]).select("slide", "ord", "status", "severity", "related", to("x"), to("y"), to("w"))


def lin(c: str, cut: str) -> str:
    return f"(CASE WHEN {c} / 255::DOUBLE <= {cut}::DOUBLE THEN {c} / 255::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def lum(n: str) -> str:
    r, g, b = (lin(f"(({n}) // {d} % 256)", "0.03928") for d in (65536, 256, 1))
    return f"({r} * 0.2126::DOUBLE + {g} * 0.7152::DOUBLE + {b} * 0.0722::DOUBLE)"


@query(f"""WITH c AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'title' ELSE 'chip' END AS role_bucket, {lum("p_partkey * 7919 % 16777216")} AS f, {lum("p_partkey * 104729 % 16777216")} AS g FROM part),
k AS (SELECT *, (greatest(f, g) + 0.05::DOUBLE) / (least(f, g) + 0.05::DOUBLE) AS v FROM c)
SELECT p_partkey, role_bucket, {up("v")} AS contrast, CASE WHEN v < 3 THEN 'critical' ELSE 'warning' END AS severity FROM k WHERE v < CASE WHEN role_bucket = 'title' THEN 3.0 ELSE 4.5 END""")
def contrast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08, P10, F03"""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "body").when(F.col("p_size") % 3 == 1, "title").otherwise("chip").alias("role_bucket"), C.hex_colour(F.concat(F.lit(" #"), colour(k * 7919 % 16777216))).alias("fg"), colour(k * 104729 % 16777216).alias("bg"))
    found = checks.threshold_checks(p.withColumn("v", C.contrast(F.col("fg"), F.col("bg"))), "v", "contrast", C.CONTRAST_RULES)
    return found.select("p_partkey", "role_bucket", C.half_up(F.col("v"), 4).alias("contrast"), "severity")


def lab_sql(t: str) -> str:
    r, g, b = (lin(f"{t}.{c}", "0.04045") for c in "rgb")
    f = lambda v: f"(CASE WHEN {v} > {216 / 24389!r}::DOUBLE THEN cbrt({v}) ELSE ({24389 / 27!r}::DOUBLE * {v} + 16) / 116 END)"
    x, y, z = (f(f"({v})") for v in (f"({r} * 0.4124564::DOUBLE + {g} * 0.3575761::DOUBLE + {b} * 0.1804375::DOUBLE) / 0.95047::DOUBLE", f"{r} * 0.2126729::DOUBLE + {g} * 0.7151522::DOUBLE + {b} * 0.072175::DOUBLE", f"({r} * 0.0193339::DOUBLE + {g} * 0.119192::DOUBLE + {b} * 0.9503041::DOUBLE) / 1.08883::DOUBLE"))
    return f"{y} * 116 - 16 AS l, ({x} - {y}) * 500 AS a, ({y} - {z}) * 200 AS bb"


NEAR_SQL = f"""{PC_SQL}, {NT_SQL}, pl AS (SELECT p_partkey, p_brand, r, g, b, {lab_sql("pc")} FROM pc), tl AS (SELECT ord, token, r AS tr, g AS tg, b AS tb, {lab_sql("nt")} FROM nt),
d AS (SELECT p_partkey, p_brand, token, ord, (r = tr AND g = tg AND b = tb) AS same, sqrt((pl.l - tl.l) * (pl.l - tl.l) + (pl.a - tl.a) * (pl.a - tl.a) + (pl.bb - tl.bb) * (pl.bb - tl.bb)) AS delta FROM pl CROSS JOIN tl),
best AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY delta, ord) AS n, max(CASE WHEN same THEN ord END) OVER (PARTITION BY p_partkey) AS exact_ord FROM d)"""


@query(f"WITH {NEAR_SQL} SELECT p_partkey, token, {up('delta')} AS delta, delta <= 8 AS matched FROM best WHERE n = 1")
def nearest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09, J06"""
    near = matching.nearest_token(part_colours(spark, sf_dir), nation_tokens(spark, sf_dir), "hex")
    return near.select("p_partkey", "token", C.half_up(F.col("delta"), 4).alias("delta"), "matched")


@query(f"WITH {NEAR_SQL} SELECT p_brand, {up('avg(CASE WHEN delta <= 8 THEN 1 - delta / 8 ELSE 0 END)')} AS resolver_match, {up('avg(CASE WHEN exact_ord IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)')} AS exact_match FROM best WHERE n = 1 GROUP BY 1")
def palette_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07, G13, G14"""
    tokens = nation_tokens(spark, sf_dir)
    near = matching.exact_token(matching.nearest_token(part_colours(spark, sf_dir), tokens, "hex"), tokens, "hex")
    return scoring.palette_match(near, ["p_brand"])


@query(f"""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM v GROUP BY 1, 2),
d AS (SELECT vec_id, c.label, sqrt(sum((v.v - c.m) * (v.v - c.m))) AS dist FROM v JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, label AS nearest, {up("dist")} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS n FROM d) WHERE n = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06 on vectors: the centroids of a label's vectors are tokens; there is one for each label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).withColumnRenamed("label", "nearest")
    dist = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = e.crossJoin(matching.small(centres)).groupBy("vec_id").agg(F.min(F.struct(dist.alias("dist"), "nearest")).alias("m"))
    return best.select("vec_id", "m.nearest", C.half_up(F.col("m.dist"), 4).alias("dist"))


FIND_SQL = f"""{E_SQL}, {ROLE_SQL}, f AS (SELECT slide, ord, 'bounds' AS kind, 'critical' AS severity FROM e WHERE {OUT_SQL}
UNION ALL SELECT slide, ord, 'font-too-small', CASE WHEN font_size < c THEN 'critical' ELSE 'warning' END FROM er JOIN {values(C.FONT_SIZE_RULES)} ON r.role = CASE WHEN rb IN ('background') THEN 'body' ELSE rb END WHERE font_size < c OR font_size < r.w)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and font sizes, in one pass."""
    row = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"))
    both = F.array(row("bounds", F.when(C.Rect().outside(), "critical")), row("font-too-small", preflight.severity(F.col("font_size"), C.FONT_SIZE_RULES, F.col("role_bucket"))))
    return with_roles(spark, sf_dir).select("slide", "ord", F.inline(F.filter(both, lambda x: x["severity"].isNotNull())))


@query(f"""WITH {FIND_SQL} SELECT slide, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning, bool_or(severity = 'critical') AS blocked,
CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS worst FROM f GROUP BY 1""")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01"""
    return scoring.check_summary(found(spark, sf_dir), "slide")


@query(f"WITH {FIND_SQL} SELECT k.kind, count(f.slide) AS n, CASE WHEN count(f.slide) = 0 THEN 'none' WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS worst FROM (VALUES ('bounds'), ('overlap'), ('font-too-small')) AS k(kind) LEFT JOIN f ON f.kind = k.kind GROUP BY 1")
def quality_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21"""
    return scoring.quality_cells(found(spark, sf_dir), ["bounds", "overlap", "font-too-small"])


COUNT_SQL = f"{E_SQL}, k AS (SELECT slide, count(*) FILTER (type = 'text') AS text, count(*) FILTER (type IN ('shape', 'line')) AS shape, count(*) FILTER (type = 'image') AS image, count(*) FILTER (type = 'line') AS line FROM e GROUP BY 1)"
LEVEL_SQL = f"""{COUNT_SQL}, lv AS (SELECT *, CASE WHEN image > 0 AND text = 0 THEN 1 WHEN image = 0 AND text > 0 THEN 5 WHEN text > 0 AND shape > 0 THEN 4 WHEN text > 0 THEN 3 ELSE 2 END::BIGINT AS level_render,
CASE WHEN text > 0 AND shape > 0 AND image = 0 THEN 5 WHEN text > 0 AND shape > 0 THEN 4 WHEN text > 0 AND image > 0 THEN 3 WHEN shape > 0 THEN 2 ELSE 1 END::BIGINT AS level_report FROM k)"""


@query(f"WITH {LEVEL_SQL} SELECT * FROM lv")
def type_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02, P22, P23"""
    return scoring.levels(scoring.type_counters(elements(spark, sf_dir), ["slide"])).select("slide", "text", "shape", "image", "line", "level_render", "level_report")


@query(f"""WITH {LEVEL_SQL}, {ST_SQL}, o AS (SELECT slide, count(*) FILTER (type = 'shape' AND shape = 'star') AS odd, count(*) FILTER (type = 'image' AND src LIKE 'http%') AS remote FROM st GROUP BY 1),
d AS (SELECT o_custkey, min(level_render) AS level, sum(image)::BIGINT AS rasterized, (sum(image) > 0)::BIGINT + (sum(odd) > 0)::BIGINT + (sum(remote) > 0)::BIGINT + (o_custkey % 3 > 0)::BIGINT AS n_issues FROM lv JOIN o USING (slide) JOIN orders ON o_orderkey = slide GROUP BY o_custkey)
SELECT *, CASE WHEN n_issues = 0 THEN 'low' WHEN n_issues <= 2 THEN 'medium' ELSE 'high' END AS risk FROM d""")
def deck_editability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are a deck; its number tells the design's font."""
    lv = scoring.levels(scoring.type_counters(with_styles(elements(spark, sf_dir)), ["slide"]))
    orders = table(spark, sf_dir, "orders")
    fonts = orders.select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, "Arial").otherwise(F.concat(F.lit("Font"), F.col("o_custkey") % 3)).alias("font"))
    decks = scoring.deck_editability(lv.join(orders.select(F.col("o_orderkey").alias("slide"), "o_custkey"), "slide"), "o_custkey", fonts)
    return decks.select("o_custkey", "level", "rasterized", "n_issues", "risk")


SCORE_SQL = f"""{FIND_SQL}, k AS (SELECT slide, count(*) AS n, count(*) FILTER (type = 'text') AS text, count(*) FILTER (type = 'image') AS image FROM e GROUP BY 1),
i AS (SELECT slide, sum(CASE WHEN severity = 'critical' THEN 18 ELSE 10 END) AS penalty, bool_or(kind = 'bounds') AS off FROM f GROUP BY 1),
sc AS (SELECT k.slide, greatest(0, 100 - coalesce(penalty, 0))::BIGINT AS score, CASE WHEN text > 0 THEN 85 ELSE 45 END::BIGINT AS hierarchy, CASE WHEN coalesce(off, false) THEN 55 ELSE 88 END::BIGINT AS alignment,
CASE WHEN n > 14 THEN 65 ELSE 85 END::BIGINT AS density, CASE WHEN image > 0 THEN 78 ELSE 95 END::BIGINT AS editability FROM k LEFT JOIN i ON i.slide = k.slide)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = found(spark, sf_dir).withColumn("severity", F.when(F.col("severity") == "critical", "high").otherwise("medium"))
    return scoring.slide_scores(issues, scoring.type_counters(elements(spark, sf_dir), ["slide"]), "slide")


@query(f"WITH {SCORE_SQL} SELECT * FROM sc")
def slide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04"""
    return scored(spark, sf_dir)


@query(f"WITH {SCORE_SQL} SELECT o_custkey, count(*) AS n_slides, {up('avg(score)', 0)}::BIGINT AS deck_score FROM sc JOIN orders ON o_orderkey = slide GROUP BY 1")
def deck_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04, J15"""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"), "o_custkey")
    return scoring.deck_scores(scored(spark, sf_dir).join(orders, "slide"), "o_custkey")


@query("""SELECT p_partkey, CASE WHEN d > 1 THEN least(greatest(floor((d - 1) * 3.5 + 0.5), 0), 30)::DOUBLE ELSE 0 END AS alignment,
CASE WHEN m < 0.85::DOUBLE THEN least(greatest(floor((0.85::DOUBLE - m) * 200 + 0.5), 0), 30)::DOUBLE ELSE 0 END AS design_system_fit, CASE WHEN f > 0 THEN least(f * 8, 30)::DOUBLE ELSE 0 END AS compatibility
FROM (SELECT p_partkey, p_size / 4::DOUBLE AS d, (p_partkey % 33) / 32::DOUBLE AS m, p_partkey % 6 AS f FROM part)""")
def report_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G05"""
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(scoring.adjustments(F.col("p_size") / 4.0, F.col("p_partkey") % 33 / 32.0, F.col("p_partkey") % 6))))


TRIAD_SQL = "SELECT slide, floor(y * 4 + 0.5) / 4 AS y_bucket, count(*) AS n FROM e WHERE type = 'shape' GROUP BY 1, 2 HAVING count(*) >= 3"


@query(f"WITH {E_SQL} {TRIAD_SQL}")
def y_bucket_triads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G09"""
    return scoring.y_buckets(elements(spark, sf_dir).where("type = 'shape'"), ["slide"])


RHYTHM_SQL = """SELECT slide, count(*) AS n_gaps, min(gap) AS gap FROM (SELECT slide, floor((y - lag(y) OVER (PARTITION BY slide ORDER BY y)) * 1000 + 0.5) / 1000 AS gap FROM e) WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT gap) = 1"""


@query(f"WITH {E_SQL} {RHYTHM_SQL}")
def vertical_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01"""
    return ordered.even_gaps(elements(spark, sf_dir), "slide", "y")


ROLE5 = "CASE WHEN role IS NOT NULL THEN CASE WHEN lower(role) IN ('title', 'caption') THEN lower(role) ELSE 'body' END WHEN typography IS NOT NULL THEN CASE WHEN typography LIKE '%footnote%' THEN 'caption' ELSE 'body' END WHEN font_size >= 24 THEN 'title' WHEN font_size >= 16 THEN 'heading' WHEN font_size <= 10 THEN 'caption' WHEN id LIKE 'kpi%' THEN 'metric' ELSE 'body' END"
FLAGS = {"font_family_dedup": 20, "emoji_as_icon": 15, "css_gradient": 15, "all_caps_stroke_shadow": 10, "rhetoric_on_cjk": 10, "rounded_token_variance": 20, "icon_circle_triad": 15, "kpi_sandwich": 10, "vertical_rhythm_variance": 10}


@query(f"""WITH {E_SQL}, {ST_SQL}, q AS (SELECT *, {ROLE5} AS r5, floor(y * 4 + 0.5) AS yb FROM st), r AS ({RHYTHM_SQL}),
tr AS (SELECT DISTINCT slide FROM (SELECT slide, yb FROM q WHERE type = 'shape' AND shape = 'ellipse' GROUP BY 1, 2 HAVING count(*) >= 3)), kp AS (SELECT DISTINCT slide FROM (SELECT slide, yb FROM q WHERE r5 = 'metric' GROUP BY 1, 2 HAVING count(*) >= 3)),
g AS (SELECT slide, count(DISTINCT font) > 3 AS font_family_dedup, bool_or(p % 5 = 4) AS emoji_as_icon, bool_or(s % 3 = 1) AS css_gradient, bool_or(p % 5 = 0 AND p % 4 <> 0 AND s % 3 <> 0) AS all_caps_stroke_shadow, bool_or(r5 IN ('title', 'subtitle') AND p % 5 = 2) AS rhetoric_on_cjk, bool_or(type = 'shape' AND s % 3 = 2) AS rounded_token_variance FROM q GROUP BY 1),
w AS (SELECT g.*, tr.slide IS NOT NULL AS icon_circle_triad, kp.slide IS NOT NULL AS kpi_sandwich, r.slide IS NOT NULL AS vertical_rhythm_variance FROM g LEFT JOIN tr ON tr.slide = g.slide LEFT JOIN kp ON kp.slide = g.slide LEFT JOIN r ON r.slide = g.slide)
SELECT *, least(100, {" + ".join(f"{k}::INT * {v}" for k, v in FLAGS.items())})::BIGINT AS risk FROM w""")
def style_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine signals in one grouping."""
    return scoring.risk_score(scoring.style_flags(with_styles(elements(spark, sf_dir)), ["slide"]))


@query("SELECT doc_id, regexp_matches(text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F1FF}]') AS emoji, regexp_matches(text, '[A-Z]') AND text = upper(text) AND doc_id % 2 = 1 AND doc_id % 3 > 0 AS shouts, regexp_matches(lower(text), '(linear|radial|conic)-gradient\\s*\\(') AS gradient FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(128512) WHEN doc_id % 4 = 1 THEN upper(lang) WHEN doc_id % 4 = 2 THEN text || ' LINEAR-gradient (' ELSE text END AS text FROM documents)")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, P18"""
    k, t = F.col("doc_id"), F.col("text")
    text = F.when(k % 4 == 0, F.concat(t, F.lit("\U0001F600"))).when(k % 4 == 1, F.upper("lang")).when(k % 4 == 2, F.concat(t, F.lit(" LINEAR-gradient ("))).otherwise(t)
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    t = F.col("text")
    return d.select("doc_id", C.has_emoji(t).alias("emoji"), C.shouts(t, F.when(k % 2 == 1, "1px").otherwise("none"), F.when(k % 3 > 0, "soft")).alias("shouts"), C.has_gradient(t).alias("gradient"))


@query("""SELECT doc_id, (length(text) * (8 + doc_id % 12)::DOUBLE * 0.55::DOUBLE * (CASE WHEN doc_id % 3 = 0 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN doc_id % 5 = 0 THEN 0.95::DOUBLE ELSE 1 END) / 72)
> (4 + doc_id % 5) * greatest(1, (1 + doc_id % 70)::DOUBLE / ((8 + doc_id % 12)::DOUBLE / 72 * 1.25::DOUBLE)) AS overflows FROM documents""")
def text_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in code points."""
    k = F.col("doc_id")
    flag = C.text_overflows(F.col("text"), (k % 12 + 8).cast("double"), (k % 5 + 4).cast("double"), (k % 70 + 1).cast("double"), k % 3 == 0, k % 5 == 0, F.lit(1.25))
    return table(spark, sf_dir, "documents").select("doc_id", flag.alias("overflows"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT doc_id, sum(greatest(1, ceil(length(line) * 12::DOUBLE * 0.55::DOUBLE * 1::DOUBLE / 72 / (2 + doc_id % 9)::DOUBLE))) AS n FROM p GROUP BY 1)
SELECT doc_id, {up("greatest(12::DOUBLE / 72 * 1.35::DOUBLE, n * (12::DOUBLE / 72) * 1.35::DOUBLE + 0.05::DOUBLE)")} AS height FROM l""")
def wrapped_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15"""
    height = C.wrapped_height(F.col("text"), (F.col("doc_id") % 9 + 2).cast("double"), F.lit(12.0), F.lit(1.35), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", C.half_up(height, 4).alias("height"))


NORM = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B\\x{00A0}]+', ' ', 'g'))"


@query(f"WITH b AS (SELECT item_id, {NORM} AS block FROM benchmark), d AS (SELECT {NORM} AS body FROM documents) SELECT item_id FROM b WHERE block <> '' AND NOT EXISTS (SELECT 1 FROM d WHERE contains(body, block))")
def content_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, J11"""
    return matching.uncovered(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id")


@query("SELECT page_id, tag, count(DISTINCT t) AS n FROM (SELECT page_id, 'h1' AS tag, trim(unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1))) AS t FROM pages UNION ALL SELECT page_id, 'li', trim(unnest(regexp_extract_all(html, '<li>([^<]*)</li>', 1))) FROM pages) GROUP BY 1, 2")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, U02 over text blocks that a pattern defines."""
    p = table(spark, sf_dir, "pages")
    parts = [p.select("page_id", F.lit(t).alias("tag"), F.explode(F.regexp_extract_all("html", F.lit(f"<{t}>([^<]*)</{t}>"), F.lit(1))).alias("t")) for t in ("h1", "li")]
    return parts[0].unionByName(parts[1]).groupBy("page_id", "tag").agg(F.countDistinct(F.trim("t")).alias("n"))


@query()
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05, J03's ancestor paths: rows only, as SQL has no HTML parser."""
    nodes = readers.html_nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.select("page_id", "ord", "tag", "path", "parent", F.length("text").alias("n_chars"))


@query("SELECT regexp_matches(lower(url), '^https?://') AS remote, starts_with(lower(url), 'https') AS secure, count(*) AS n FROM pages GROUP BY 1, 2")
def url_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14"""
    return table(spark, sf_dir, "pages").groupBy(C.is_remote(F.col("url")).alias("remote"), F.startswith(F.lower("url"), F.lit("https")).alias("secure")).agg(F.count("*").alias("n"))


@query(f"""WITH {E_SQL}, r AS (SELECT *, CASE WHEN y < 3.75 THEN '0' ELSE '1' END || '-' || CASE WHEN x < 6 THEN '0' ELSE '1' END AS region FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY slide, region, type = 'image' ORDER BY ord) AS k FROM r) SELECT slide, ord, region, type FROM n WHERE type = 'image' OR k = 1""")
def first_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21, W11"""
    return ordered.first_per_region(elements(spark, sf_dir), "slide", 12.0).select("slide", "ord", "region", "type")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) > 4 AS many FROM conversations)
SELECT conv_id, turn, CASE WHEN many THEN n // 4 ELSE 0 END AS page, (CASE WHEN many THEN n % 4 ELSE n END) // 2 AS row, (CASE WHEN many THEN n % 4 ELSE n END) % 2 AS col FROM c""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07, W08"""
    return ordered.paginate(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, turn, (1 + length(text) % 9) / 8::DOUBLE AS h FROM conversations)
SELECT conv_id, turn, coalesce(sum(h + 0.125::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5::DOUBLE AS top,
sum(h) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS kept FROM c""")
def cursor_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W09, W10"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.length("text") % 9 + 1) / 8.0).alias("h"))
    return ordered.overflow_pages(ordered.cursor(c, "conv_id", "turn", "h", 0.125, 0.5), "conv_id", "turn", "h", 2.0).select("conv_id", "turn", "top", "kept")


@query("""WITH c AS (SELECT conv_id, (1 + length(text) % 9) / 4::DOUBLE AS h FROM conversations) SELECT conv_id, least(greatest(max(h), 1.55::DOUBLE), 2::DOUBLE) AS card_height FROM c GROUP BY 1""")
def card_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G23"""
    c = table(spark, sf_dir, "conversations").select("conv_id", ((F.length("text") % 9 + 1) / 4.0).alias("h"))
    return ordered.card_height(c, "conv_id", "h", 2.0)


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, value AS head, 1 AS seg FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.n, CASE WHEN abs(o.value - f.head) > 36 THEN o.value ELSE f.head END, f.seg + CASE WHEN abs(o.value - f.head) > 36 THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1),
s AS (SELECT user_id, seg, min(n) - 1 AS start, count(*) AS n FROM f GROUP BY 1, 2), m AS (SELECT *, sum(CASE WHEN seg = 1 OR n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seg) - 1 AS segment FROM s)
SELECT user_id, segment::BIGINT AS segment, min(start)::BIGINT AS start, sum(n)::BIGINT AS n FROM m WHERE segment < 5 GROUP BY 1, 2""")
def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02, W03"""
    return ordered.segments(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("""WITH c AS (SELECT user_id, event_type, floor(value / 24)::BIGINT AS bucket, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, bucket, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def dominant_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16"""
    return scoring.dominant_bucket(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


MONTHS = "m AS (SELECT o_orderpriority AS series, year(o_orderdate) * 12 + month(o_orderdate) AS label, count(*) AS v FROM orders GROUP BY 1, 2)"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("label")).agg(F.count("*").alias("v"))


@query(f"""WITH {MONTHS}, k AS (SELECT series, label, {up("(v - least(0, min(v) OVER (PARTITION BY series))) / (greatest(1, max(v) OVER (PARTITION BY series)) - least(0, min(v) OVER (PARTITION BY series)))::DOUBLE")} AS v0 FROM m)
SELECT * FROM (SELECT series, label, v0, lead(v0) OVER (PARTITION BY series ORDER BY label) AS v1 FROM k) WHERE v1 IS NOT NULL""")
def sparkline_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04, W06"""
    return ordered.line_pieces(months(spark, sf_dir), ["series"], "label", "v").select("series", "label", "v0", "v1")


@query(f"WITH {MONTHS} SELECT label, series, coalesce(sum(v) OVER (PARTITION BY label ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS baseline, (sum(v) OVER (PARTITION BY label))::BIGINT AS total FROM m")
def stacked_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05, G22"""
    m = ordered.stacked(months(spark, sf_dir), ["label"], "series", "v")
    return m.select("label", "series", "baseline", F.sum("v").over(W.partitionBy("label")).alias("total"))


@query(f"WITH {MONTHS} SELECT label, series, {up('v * 100.0::DOUBLE / (sum(v) OVER (PARTITION BY label))', 0)}::BIGINT AS share FROM m")
def pie_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22"""
    return ordered.shares(months(spark, sf_dir), ["label"], "v").select("label", "series", "share")


@query("SELECT DISTINCT series, label, value::DOUBLE AS value FROM (SELECT n_regionkey AS label, 'nations' AS series, count(*) AS value FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'letters', sum(length(n_name)) FROM nation GROUP BY 1)")
def chart_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a grouped bar chart with a label for each region."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").cast("double").alias("a"), F.sum(F.length("n_name")).cast("double").alias("b"))
    point = F.struct(F.col("n_regionkey").alias("label"), F.lit(None).cast("double").alias("value"), F.create_map(F.lit("nations"), "a", F.lit("letters"), "b").alias("series"))
    chart = n.groupBy().agg(F.collect_list(point).alias("data"))
    return marks.chart_marks(chart.select(F.lit("chart").alias("id"), F.lit("groupedBar").alias("kind"), "data")).select("series", "label", "value")


POINTS = """pt AS (SELECT user_id, event_type AS label, count(*)::DOUBLE AS n, floor(sum(value)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS k, 1::DOUBLE AS x, user_id % 5 / 8::DOUBLE AS y, (4 + user_id % 3)::DOUBLE AS w, 2::DOUBLE AS h FROM events GROUP BY user_id, event_type),
q AS (SELECT *, greatest(1, max(n + v) OVER u) AS most, greatest(1, max(n) OVER u) AS top, least(0, min(n) OVER u) AS low, least(0.12::DOUBLE, w / (k * 4)) AS gap, 0.32::DOUBLE AS lh, 0.26::DOUBLE AS vh, h - 0.68::DOUBLE AS ch FROM pt WINDOW u AS (PARTITION BY user_id)),
a AS (SELECT *, greatest(0.08::DOUBLE, (w - gap * (k - 1)) / k) AS bw, least(0.4::DOUBLE, h / k) AS rh, least(1.2::DOUBLE, w * 0.22::DOUBLE) AS lw, greatest(0.8::DOUBLE, (w - 0.2::DOUBLE * (k - 1)) / k) AS cw, lead(n) OVER (PARTITION BY user_id ORDER BY i) AS nn,
greatest(0.02::DOUBLE, n / most * ch) AS s1, greatest(0.02::DOUBLE, v / most * ch) AS s2 FROM q)"""
CHART_PARTS = """SELECT user_id, 3 * i AS part, 'shape' AS type, x + i * (bw + gap) AS x, y + vh + ch - s1 AS y, bw AS w, s1 AS h, NULL AS text FROM a WHERE user_id % 4 = 0
UNION ALL SELECT user_id, 3 * i + 1, 'shape', x + i * (bw + gap), y + vh + ch - s1 - s2, bw, s2, NULL FROM a WHERE user_id % 4 = 0
UNION ALL SELECT user_id, 3 * i + 2, 'text', x + i * (bw + gap), y + vh + ch + 0.05::DOUBLE, bw, lh, label FROM a WHERE user_id % 4 = 0
UNION ALL SELECT user_id, 3 * k + 2 * j, 'shape', x + j, y + h - 0.24::DOUBLE + 0.04::DOUBLE, 0.12::DOUBLE, 0.12::DOUBLE, NULL FROM a, (VALUES (0), (1)) AS t(j) WHERE user_id % 4 = 0 AND i = 0
UNION ALL SELECT user_id, 3 * k + 2 * j + 1, 'text', x + j + 0.16::DOUBLE, y + h - 0.24::DOUBLE, 0.8::DOUBLE, 0.2::DOUBLE, CASE j WHEN 0 THEN 'n' ELSE 'v' END FROM a, (VALUES (0), (1)) AS t(j) WHERE user_id % 4 = 0 AND i = 0
UNION ALL SELECT user_id, 3 * i, 'text', x, y + i * (rh + 0.08::DOUBLE), lw - 0.08::DOUBLE, rh, label FROM a WHERE user_id % 4 = 1
UNION ALL SELECT user_id, 3 * i + 1, 'shape', x + lw, y + i * (rh + 0.08::DOUBLE), greatest(0.05::DOUBLE, n / top * (w - lw)), rh, NULL FROM a WHERE user_id % 4 = 1
UNION ALL SELECT user_id, 3 * i + 2, 'text', x + lw + greatest(0.05::DOUBLE, n / top * (w - lw)) + 0.05::DOUBLE, y + i * (rh + 0.08::DOUBLE), 0.6::DOUBLE, rh, n::BIGINT::VARCHAR FROM a WHERE user_id % 4 = 1
UNION ALL SELECT user_id, 4 * i, 'shape', x + i * (cw + 0.2::DOUBLE), y, cw, h, NULL FROM a WHERE user_id % 4 = 2
UNION ALL SELECT user_id, 4 * i + 1, 'shape', x + i * (cw + 0.2::DOUBLE), y, 0.08::DOUBLE, h, NULL FROM a WHERE user_id % 4 = 2
UNION ALL SELECT user_id, 4 * i + 2, 'text', x + i * (cw + 0.2::DOUBLE) + 0.2::DOUBLE, y + 0.1::DOUBLE, cw - 0.3::DOUBLE, h * 0.55::DOUBLE, n::BIGINT::VARCHAR FROM a WHERE user_id % 4 = 2
UNION ALL SELECT user_id, 4 * i + 3, 'text', x + i * (cw + 0.2::DOUBLE) + 0.2::DOUBLE, y + h * 0.6::DOUBLE, cw - 0.3::DOUBLE, h * 0.3::DOUBLE, label FROM a WHERE user_id % 4 = 2
UNION ALL SELECT user_id, i, 'line', x + i * (w / (k - 1)), y + h - (n - low) / greatest(1, top - low) * h, w / (k - 1), (n - nn) / greatest(1, top - low) * h, NULL FROM a WHERE user_id % 4 = 3 AND nn IS NOT NULL
UNION ALL SELECT user_id, i, 'text', x + w - 0.6::DOUBLE, y, 0.6::DOUBLE, 0.24::DOUBLE, n::BIGINT::VARCHAR FROM a WHERE user_id % 4 = 3 AND nn IS NULL AND k > 1"""


@query(f"WITH {POINTS}, z AS ({CHART_PARTS}) SELECT user_id, part::INT AS part, type, {', '.join(f'{up(c, 6)} AS {c}' for c in 'xywh')}, text FROM z")
def chart_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart for each user, of a kind by its number, with a point for each type of event: all parts with their places."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"), F.floor(F.sum("value")).cast("double").alias("v"))
    point = F.struct(F.col("event_type").alias("label"), F.col("n").alias("value"), F.create_map(F.lit("n"), "n", F.lit("v"), "v").alias("series"))
    sort = lambda a, b: F.when(a["label"] < b["label"], -1).otherwise(1)
    charts = n.groupBy("user_id").agg(F.array_sort(F.collect_list(point), sort).alias("data"))
    kind = F.element_at(F.array(*map(F.lit, ("stackedBar", "horizontalBar", "kpiGroup", "sparkline"))), (F.col("user_id") % 4 + 1).cast("int"))
    charts = charts.select("user_id", F.col("user_id").cast("string").alias("id"), F.lit("chart").alias("type"), kind.alias("kind"), F.lit(1.0).alias("x"), (F.col("user_id") % 5 / 8.0).alias("y"), (F.col("user_id") % 3 + 4).cast("double").alias("w"), F.lit(2.0).alias("h"), "data")
    return marks.expanded(charts, ["user_id"]).select("user_id", "part", "type", *[C.half_up(F.col(c), 6).alias(c) for c in "xywh"], "text")


DIAGRAM = """l AS (SELECT r_name AS label, row_number() OVER (ORDER BY r_name) - 1 AS k, (SELECT count(*) FROM region) AS n FROM region), nd AS (SELECT r_name AS label, n_name AS node, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS m, count(*) OVER (PARTITION BY r_name) AS many FROM nation JOIN region ON r_regionkey = n_regionkey),
g AS (SELECT *, (5 - 0.16::DOUBLE * (n - 1)) / n AS tall FROM l), t AS (SELECT *, 1 + k * (tall + 0.16::DOUBLE) AS top FROM g), j AS (SELECT t.*, node, m, (11 - 2.6::DOUBLE - 0.12::DOUBLE * (many - 1)) / many AS wide FROM t JOIN nd USING (label)),
c AS (SELECT n_name AS label, row_number() OVER (ORDER BY n_name) - 1 AS k, (SELECT count(*) FROM nation) AS n FROM nation)"""
DIAGRAM_PARTS = """SELECT 'd__layer-' || k AS id, 'shape' AS type, 1::DOUBLE AS x, top AS y, 11::DOUBLE AS w, tall AS h, NULL AS text FROM t UNION ALL SELECT 'd__layer-label-' || k, 'text', 1.2::DOUBLE, top + 0.1::DOUBLE, 2, 0.32::DOUBLE, label FROM t
UNION ALL SELECT 'd__node-' || k || '-' || m, 'shape', 3.3::DOUBLE + m * (wide + 0.12::DOUBLE), top + 0.18::DOUBLE, wide, tall - 0.36::DOUBLE, NULL FROM j UNION ALL SELECT 'd__node-label-' || k || '-' || m, 'text', 3.38::DOUBLE + m * (wide + 0.12::DOUBLE), top + 0.28::DOUBLE, wide - 0.16::DOUBLE, tall - 0.56::DOUBLE, node FROM j
UNION ALL SELECT 'd__connector-' || k, 'line', 6.5::DOUBLE, top + tall, 0, 0.16::DOUBLE, NULL FROM t WHERE k < n - 1
UNION ALL SELECT 'm__col-' || k, 'text', 2.5::DOUBLE + k * (9.5::DOUBLE / n), 1, 9.5::DOUBLE / n, 0.45::DOUBLE, label FROM c UNION ALL SELECT 'm__row-' || k, 'text', 1, 1.45::DOUBLE + k * (4.55::DOUBLE / n), 1.5::DOUBLE, 4.55::DOUBLE / n, label FROM l
UNION ALL SELECT 'm__cell-' || l.k || '-' || c.k, 'shape', 2.5::DOUBLE + c.k * (9.5::DOUBLE / c.n), 1.45::DOUBLE + l.k * (4.55::DOUBLE / l.n), 9.5::DOUBLE / c.n, 4.55::DOUBLE / l.n, NULL FROM l, c"""


@query(f"WITH {DIAGRAM}, z AS ({DIAGRAM_PARTS}) SELECT id, type, {', '.join(f'{up(c, 6)} AS {c}' for c in 'xywh')}, text FROM z")
def diagram_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as layers with their nations, and regions by nations as a matrix."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    layer = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nodes"))
    one = layer.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("r_name").alias("label"), "nodes"))).alias("layers"))
    box = {"x": 1.0, "y": 1.0, "w": 11.0, "h": 5.0}
    d = one.select(F.explode(F.array(F.struct(F.lit("d").alias("id"), F.lit("capabilityStack").alias("kind")), F.struct(F.lit("m").alias("id"), F.lit("matrixMap").alias("kind")))).alias("i"), "layers")
    d = d.select("i.*", F.lit("diagram").alias("type"), "layers", F.transform("layers", lambda x: x["label"]).alias("rows"), F.array_sort(F.flatten(F.transform("layers", lambda x: x["nodes"]))).alias("columns"), *[F.lit(v).alias(k) for k, v in box.items()])
    return marks.expanded(d, []).select("id", "type", *[C.half_up(F.col(c), 6).alias(c) for c in "xywh"], "text")


CONF = "(s * 13 + ord * 7) % 101"


@query(f"WITH {E_SQL} SELECT slide, ord, {up(f'{CONF} / 100::DOUBLE')} AS confidence, CASE WHEN {up(f'{CONF} / 100::DOUBLE')} >= 0.7::DOUBLE THEN 'editable' ELSE 'cropped' END AS kind FROM e WHERE type = 'text'")
def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27, P28"""
    e = elements(spark, sf_dir).where("type = 'text'").withColumn("confidence", C.ocr_confidence(F.expr(CONF).cast("string")))
    return e.select("slide", "ord", "confidence", C.ocr_kind(F.col("confidence")).alias("kind"))


@query(f"WITH {E_SQL} SELECT ord, count(*) AS n, {up(f'avg(CASE WHEN {CONF} / 100::DOUBLE >= 0.7::DOUBLE THEN 1::DOUBLE ELSE 0 END)')} AS clearance, avg(CASE WHEN {CONF} / 100::DOUBLE >= 0.7::DOUBLE THEN 1::DOUBLE ELSE 0 END) >= 0.9 AS meets FROM e GROUP BY 1")
def ocr_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20"""
    return scoring.clearance(elements(spark, sf_dir).withColumn("confidence", F.expr(CONF) / 100.0), ["ord"])


@query(f"""WITH {E_SQL}, p AS (SELECT b.slide, b.ord AS block, c.ord AS cand, b.x + b.w / 2 AS cx, b.y + b.h / 2 AS cy, c.x, c.y, c.w, c.h FROM e b LEFT JOIN e c ON c.slide = b.slide AND c.type IN ('shape', 'image') WHERE b.type = 'text'),
q AS (SELECT *, NOT (cx >= x AND cx <= x + w AND cy >= y AND cy <= y + h) AS outside, (cx - (x + w / 2)) * (cx - (x + w / 2)) + (cy - (y + h / 2)) * (cy - (y + h / 2)) AS far FROM p)
SELECT slide, block, cand AS candidate, NOT outside AS contained FROM (SELECT *, row_number() OVER (PARTITION BY slide, block ORDER BY outside, CASE WHEN outside THEN far ELSE 0 END, cand) AS k FROM q) WHERE k = 1""")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08"""
    e = elements(spark, sf_dir)
    return matching.block_candidates(e.where("type = 'text'"), e.where("type in ('shape', 'image')"), "slide")


@query(f"""WITH {E_SQL}, d AS (SELECT slide, ord, kind FROM (SELECT slide, ord, CASE WHEN p % 2 = 0 THEN 'editable' ELSE 'shape' END AS kind, row_number() OVER (PARTITION BY slide ORDER BY ord) AS k FROM e) WHERE k <= 2),
f AS (SELECT slide, kind FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY ord DESC) AS k FROM d) WHERE k = 1) SELECT o_orderkey AS slide, coalesce(f.kind, 'cropped') AS kind FROM orders LEFT JOIN f ON f.slide = o_orderkey""")
def first_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision that was made first (the second element's, here) decides; orders without one are cropped."""
    e = elements(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("slide").orderBy("ord"))).where("k <= 2")
    decisions = e.select("slide", F.when(F.col("p") % 2 == 0, "editable").otherwise("shape").alias("kind"), (-F.col("ord")).alias("decision_ord"))
    return matching.first_decision(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide")), decisions, ["slide"])


@query("SELECT doc_id, quality * 100 AS expected, least(100, n_chars // 40) AS score, abs(least(100, n_chars // 40) - quality * 100) <= 20 AS within FROM documents JOIN labels USING (doc_id)")
def band_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21"""
    s = table(spark, sf_dir, "documents").select("doc_id", F.expr("least(100L, n_chars div 40)").alias("score"))
    a = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 100).alias("expected"))
    return matching.agreement(s, a, "doc_id").select("doc_id", "expected", "score", "within")


@query(f"SELECT toxic, {up('avg(CASE WHEN abs(least(100, n_chars // 40) - quality * 100) <= 20 THEN 1::DOUBLE ELSE 0 END)')} AS agreement FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agreement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25"""
    within = band_agreement(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return within.groupBy("toxic").agg(C.half_up(F.avg(F.col("within").cast("double")), 4).alias("agreement"))


@query(f"""WITH {SCORE_SQL}, d AS (SELECT o_custkey, {up('avg(score)', 0)}::BIGINT AS v, count(*) AS n FROM sc JOIN orders ON o_orderkey = slide GROUP BY 1),
b AS (SELECT 1 + v % 5 AS level, n / 8::DOUBLE AS drift, (v % 33) / 32::DOUBLE AS palette, CASE v % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'warning' WHEN 2 THEN 'blocked' END AS safety, 100 - v AS risk, v >= 20 AS passed FROM d)
SELECT count(*) AS n_decks, {", ".join(f"count(*) FILTER (level = {k}) AS level_{k}" for k in range(1, 6))}, {", ".join(f"count(*) FILTER (safety = '{k}') AS safety_{k}" for k in ("clean", "warning", "blocked"))}, count(*) FILTER (safety IS NULL) AS safety_unknown,
{up("avg(drift)")} AS avg_drift, {up("avg(palette)")} AS avg_palette, {up("avg(risk)")} AS avg_risk, count(*) FILTER (passed) AS n_passed, bool_and(passed) AS all_passed FROM b""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, G19"""
    v = F.col("deck_score")
    decks = deck_scores(spark, sf_dir).select((v % 5 + 1).alias("level"), (F.col("n_slides") / 8.0).alias("drift"), (v % 33 / 32.0).alias("palette"), F.when(v % 4 == 0, "clean").when(v % 4 == 1, "warning").when(v % 4 == 2, "blocked").alias("safety"), (100 - v).alias("risk"), (v >= 20).alias("passed"))
    return scoring.batch_report(decks)


@query(f"SELECT slide, {up('coalesce(avg(sqrt(dx * dx + dy * dy)), 0)', 3)} AS drift FROM (WITH {E_SQL} SELECT slide, (p % 9 - 4) / 8::DOUBLE AS dx, (s % 7 - 3) / 8::DOUBLE AS dy FROM e) GROUP BY 1")
def mean_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11"""
    return scoring.mean_drift(elements(spark, sf_dir).select("slide", F.expr("(p % 9 - 4) / 8D").alias("dx"), F.expr("(s % 7 - 3) / 8D").alias("dy")), ["slide"])


@query(f"""WITH {LEVEL_SQL}, fk AS (SELECT slide, level_render AS v, CASE slide % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'image' ELSE 'other' END AS input, greatest(CASE WHEN slide % 3 = 1 THEN 3 ELSE 4 END, CASE WHEN slide % 11 = 0 THEN 5 ELSE 0 END)::DOUBLE AS floor FROM lv)
SELECT slide, floor, floor - v AS gap, CASE WHEN slide % 5 = 0 OR input = 'image' THEN 'source' ELSE 'pipeline' END AS cause, CASE WHEN slide % 5 = 0 OR input = 'image' THEN 'with-justification' ELSE 'false' END AS satisfied FROM fk WHERE v < floor""")
def floor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12"""
    k = F.col("slide")
    kind = F.when(k % 3 == 0, "html").when(k % 3 == 1, "image").otherwise("other")
    bad = scoring.floor_violation(F.col("level_render"), kind, F.when(k % 11 == 0, 5), k % 5 == 0)
    return type_counters(spark, sf_dir).select("slide", bad.alias("v")).where("v is not null").select("slide", "v.*")


DUP = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query("SELECT l_orderkey, l_linenumber, l_partkey, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12"""
    return ordered.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, CASE WHEN n = 1 THEN l_linenumber::VARCHAR ELSE l_linenumber || '-' || n END AS new_id FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem)""")
def renamed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13, P33"""
    r = ordered.renamed(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_partkey", "l_suppkey", "l_shipdate"], ["l_orderkey"])
    return r.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "new_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, U03"""
    return matching.missing_slots(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14"""
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return matching.known_only(table(spark, sf_dir, "orders"), known, "o_orderkey").select("o_orderkey", "o_orderstatus")


REG = """r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'doc-' || doc_id END AS id, CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'report' WHEN 'de' THEN NULL ELSE 'odd' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'ftp://' || source ELSE 'https://' || source END AS url FROM documents),
i AS (SELECT doc_id, 'error' AS severity, 'source-id-required' AS code FROM r WHERE id = '' UNION ALL SELECT doc_id, 'error', 'source-kind-required' FROM r WHERE kind IS NULL UNION ALL SELECT doc_id, 'warning', 'source-kind-unknown' FROM r WHERE kind = 'odd' UNION ALL SELECT doc_id, 'error', 'source-url-invalid' FROM r WHERE url LIKE 'ftp%')"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("doc-"), k)).alias("id"), F.when(F.col("lang") == "en", "web").when(F.col("lang") == "fr", "report").when(F.col("lang") == "de", None).otherwise("odd").alias("kind"), F.concat(F.when(k % 3 == 0, "ftp://").otherwise("https://"), "source").alias("url"), F.when(k % 2 == 0, "embedded").otherwise("reference").alias("final_use"))


@query(f"WITH {REG} SELECT r.id, severity, code FROM i JOIN r USING (doc_id)")
def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11"""
    return scoring.registry_issues(registry(spark, sf_dir), ["web", "report"])


@query(f"WITH {REG} SELECT (SELECT count(*) FROM r) AS n_sources, (SELECT count(*) FROM r WHERE doc_id % 2 = 0) AS n_embedded, count(*) AS n_issues, count(*) FILTER (severity = 'error') = 0 AS valid FROM i")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G18"""
    r = registry(spark, sf_dir)
    return scoring.registry_summary(scoring.registry_issues(r, ["web", "report"]), r)


ACC = f"""{E_SQL}, a AS (SELECT slide, severity FROM (
SELECT o_orderkey AS slide, 'warning' AS severity FROM orders WHERE o_orderkey NOT IN (SELECT slide FROM e WHERE type = 'text')
UNION ALL SELECT o_orderkey, 'warning' FROM orders WHERE o_orderkey NOT IN (SELECT slide FROM e WHERE type = 'text' AND h >= 0.45)
UNION ALL SELECT slide, 'error' FROM e WHERE type = 'image' AND p % 2 = 1 UNION ALL SELECT slide, 'warning' FROM e WHERE type = 'text' AND font_size < 10))"""


@query(f"WITH {ACC} SELECT slide, count(*) AS n_issues, CASE WHEN bool_or(severity = 'error') THEN 'review' ELSE 'warning' END AS status FROM a GROUP BY 1")
def accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12"""
    e = elements(spark, sf_dir).withColumns({"text": F.col("id"), "alt": F.when(F.col("p") % 2 == 0, "alt"), "description": F.lit("")})
    slides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"))
    return scoring.accessibility_status(scoring.accessibility(e, slides, "slide"), "slide")


@query("""WITH f AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), o AS (SELECT conv_id, turn, role, CASE WHEN k > 1 THEN 3 WHEN role = 'assistant' THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS r FROM f)
SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r, turn) AS place FROM o) WHERE place <= 3""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T02"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("ord"))
    return ordered.representatives(c, "conv_id", ["assistant", "user"]).select("conv_id", "turn", "role", "place")


@query("SELECT p_name, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator."""
    return ordered.ranked(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 50).select("p_name", "p_partkey", "p_retailprice")


@query(f"""WITH {FIND_SQL}, q AS (SELECT slide, ord, kind, e.x, e.y, e.w, e.h FROM f JOIN e USING (slide, ord))
SELECT slide, ord, 'move' AS operation, CASE WHEN x > 6 THEN x / 2 END AS to_x, CASE WHEN y > 3 THEN y / 2 END AS to_y, NULL::DOUBLE AS to_w, NULL AS style, NULL AS suggestion_kind FROM q WHERE kind = 'bounds' AND (x > 6 OR y > 3)
UNION ALL SELECT slide, ord, 'resize', NULL, NULL, w / 2, NULL, NULL FROM q WHERE kind = 'bounds' AND w > 2 UNION ALL SELECT slide, ord, 'updateStyle', NULL, NULL, NULL, '{{"fontSize":"12"}}', kind FROM q WHERE kind = 'font-too-small'
UNION ALL SELECT slide, ord, 'increaseSpacing', NULL, NULL, NULL, NULL, 'card-spacing-tight' FROM e WHERE s % 6 = 0""")
def patch_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X04"""
    e = elements(spark, sf_dir)
    f = found(spark, sf_dir).join(e.select("slide", "ord", *"xywh", "s"), ["slide", "ord"])
    more = e.select("slide", "ord", F.explode(F.array(F.lit("overlap"), F.when(F.col("s") % 6 == 0, "card-spacing-tight").otherwise("other"))).alias("kind"), F.lit("warning").alias("severity"), *"xywh", "s")
    half = lambda c, least: F.when(F.col(c) > least, F.col(c) / 2).alias(c)
    f = f.unionByName(more).select("slide", "ord", F.col("ord").cast("string").alias("element_id"), "kind", F.struct(half("x", 6), half("y", 3), half("w", 2), F.lit(None).cast("double").alias("h")).alias("suggestion"))
    p, c = matching.patches_for(f), "changes."
    return p.select("slide", "ord", "operation", *[F.col(f"{c}{k}").alias(f"to_{k}") for k in "xyw"], F.to_json(f"{c}style").alias("style"), F.col(f"{c}suggestion_kind").alias("suggestion_kind"))


def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches in order: every raw line item moves, restyles or removes what it names, or asks for what can't be done; keys that no
    element has are left over."""
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    ord_ = (F.col("l_linenumber") + F.when(n % 5 == 0, 1).otherwise(0)).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), ord_.alias("ord"), k, n).distinct()
    operation = F.when(k % 13 == 0, "removeElement").when(k % 7 == 0, "adjustStyle").when(k % 17 == 0, "paint").otherwise("move")
    changes = F.struct(F.expr("(l_partkey % 50) / 8D").alias("x"), F.when(n % 2 == 0, F.expr("(l_suppkey % 40) / 8D")).alias("y"), F.create_map(F.lit("size"), (k % 30).cast("string")).alias("style"))
    return rows.select("slide", "ord", (k * 1000 + n).alias("patch_ord"), operation.alias("operation"), changes.alias("changes"))


PATCH = f"""{E_SQL}, pt AS (SELECT DISTINCT l_orderkey AS slide, l_linenumber + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS ord, l_partkey * 1000 + l_suppkey AS po, CASE WHEN l_partkey % 13 = 0 THEN 'removeElement' WHEN l_partkey % 7 = 0 THEN 'adjustStyle' WHEN l_partkey % 17 = 0 THEN 'paint' ELSE 'move' END AS op,
(l_partkey % 50) / 8::DOUBLE AS x, CASE WHEN l_suppkey % 2 = 0 THEN (l_suppkey % 40) / 8::DOUBLE END AS y, (l_partkey % 30)::VARCHAR AS z FROM lineitem),
pr AS (SELECT *, coalesce(bool_or(op = 'removeElement') OVER (PARTITION BY slide, ord ORDER BY po ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM pt),
fo AS (SELECT slide, ord, arg_max(x, po) FILTER (op = 'move') AS x, arg_max(y, po) FILTER (op = 'move' AND y IS NOT NULL) AS y, arg_max(z, po) FILTER (op = 'adjustStyle') AS z, bool_or(op = 'removeElement') AS gone FROM pt GROUP BY 1, 2)"""


@query(f"WITH {PATCH} SELECT e.slide, e.ord, coalesce(fo.x, e.x) AS x, coalesce(fo.y, e.y) AS y, 'big' AS own, coalesce(z, '10') AS size FROM e LEFT JOIN fo ON fo.slide = e.slide AND fo.ord = e.ord WHERE NOT coalesce(gone, false)")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17"""
    e = elements(spark, sf_dir).withColumn("style", F.create_map(F.lit("own"), F.lit("big"), F.lit("size"), F.lit("10")))
    new = matching.apply_patches(e, patch_rows(spark, sf_dir), ["slide", "ord"])[0]
    return new.select("slide", "ord", "x", "y", F.col("style")["own"].alias("own"), F.col("style")["size"].alias("size"))


@query(f"WITH {PATCH} SELECT pr.slide, pr.ord, po AS patch_ord, CASE WHEN op = 'paint' THEN 'unsupported operation' WHEN e.slide IS NULL THEN 'missing element' ELSE 'removed before' END AS error FROM pr LEFT JOIN e ON e.slide = pr.slide AND e.ord = pr.ord WHERE op = 'paint' OR e.slide IS NULL OR late")
def patch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17"""
    return matching.apply_patches(elements(spark, sf_dir), patch_rows(spark, sf_dir), ["slide", "ord"])[1].select("slide", "ord", "patch_ord", "error")


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("k."), "n_nationkey").alias("path"), F.col("n_name").alias("value"))


@query("SELECT event_id, coalesce(n_name, CASE WHEN event_type = 'click' THEN event_type ELSE '{k.' || user_id % 40 || '}' END) AS resolved FROM events LEFT JOIN nation ON event_type <> 'click' AND n_nationkey = user_id % 40")
def token_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01"""
    ref = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.concat(F.lit("{k."), F.col("user_id") % 40, F.lit("}")))
    e = table(spark, sf_dir, "events").select("event_id", ref.alias("raw"))
    return matching.deref(e, "raw", nation_paths(spark, sf_dir)).select("event_id", "resolved")


@query("SELECT event_id, 'k.' || user_id % 40 AS path FROM events WHERE user_id % 40 NOT IN (SELECT n_nationkey FROM nation)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03"""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("a {k."), F.col("user_id") % 40, F.lit("} b")).alias("raw"))
    return matching.dangling(e, "raw", nation_paths(spark, sf_dir)).select("event_id", "path")


@query("""SELECT event_id, row_number() OVER w AS attempt, bool_or(value > 90) OVER w AS accepted FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def attempt_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14"""
    e = table(spark, sf_dir, "events").withColumn("run", F.concat_ws("|", "user_id", "event_type"))
    return ordered.attempts(e, "run", ["ts", "event_id"], F.col("value") > 90).select("event_id", "attempt", "accepted")


EVENT_SCHEMA = {
    "type": "object",
    "required": ["event_type", "value"],
    "properties": {"event_type": {"type": "string", "enum": ["click", "view", "purchase"], "minLength": 5}, "value": {"type": "number", "minimum": 1, "exclusiveMinimum": 2, "maximum": 99}, "user_id": {"type": "integer", "not": {"const": 7}}},
    "if": {"properties": {"event_type": {"const": "click"}}},
    "then": {"properties": {"value": {"maximum": 50}}},
}


@query("""SELECT event_id, concat_ws(', ', CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN '$.event_type: enum' END, CASE WHEN length(event_type) < 5 THEN '$.event_type: minLength' END, CASE WHEN value < 1 THEN '$.value: minimum' END, CASE WHEN value > 99 THEN '$.value: maximum' END,
CASE WHEN value <= 2 THEN '$.value: exclusiveMinimum' END, CASE WHEN user_id = 7 THEN '$.user_id: not' END, CASE WHEN event_type = 'click' AND value > 50 THEN '$.value: maximum' END) AS violations FROM events""")
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10"""
    e = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "value", "user_id").alias("e"))
    return validation.violations(e, EVENT_SCHEMA, "e").select("event_id", F.array_join("violations", ", ").alias("violations"))


IMG = f"""v AS (SELECT *, row_number() OVER (PARTITION BY label % 2 = 0, label // 2 ORDER BY vec_id) AS rank FROM embeddings), p AS (SELECT a.label // 2 AS pair, a.rank, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM v a JOIN v b ON a.label // 2 = b.label // 2 AND a.rank = b.rank AND a.label % 2 = 0 AND b.label % 2 = 1),
s AS (SELECT pair, rank, avg(abs(x - y) * 64) AS m, min(abs(x - y) * 64) AS lo, max(abs(x - y) * 64) AS hi FROM p GROUP BY 1, 2)"""


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("label div 2").alias("pair"), (F.col("label") % 2).alias("side"), "embedding")
    z = matching.zipped(e.where("side = 0"), e.where("side = 1"), "vec_id", ["pair"])
    pixels = z.select("pair", "rank", F.explode(F.arrays_zip(F.col("a.embedding").alias("x"), F.col("b.embedding").alias("y"))).alias("q"))
    return scoring.diff_stats(pixels.select("pair", "rank", (F.col("q.x").cast("double") * 64).alias("a"), (F.col("q.y").cast("double") * 64).alias("b")), ["pair", "rank"])


@query(f"WITH {IMG} SELECT pair, rank, {up('m')} AS mean_diff, {up('lo')} AS min_diff, {up('hi')} AS max_diff, CASE WHEN m < 12 THEN 'close' WHEN m < 40 THEN 'moderate' ELSE 'divergent' END AS verdict FROM s")
def image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, J19, G17, P25"""
    return image_pairs(spark, sf_dir)


@query(f"WITH {IMG} SELECT CASE WHEN bool_or(m >= 40) THEN 'failed' WHEN bool_or(m >= 12) THEN 'review' ELSE 'passed' END AS status FROM s")
def comparison_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24"""
    return scoring.comparison_status(image_pairs(spark, sf_dir))


@query(f"WITH {FIND_SQL}, u AS (SELECT slide, ord, kind, severity, 'layout' AS source FROM f UNION ALL SELECT slide, ord, 'connector', 'info', 'lines' FROM e WHERE type = 'line') SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END::INT AS severity_rank FROM u")
def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01, T03"""
    lines = elements(spark, sf_dir).where("type = 'line'").select("slide", "ord", F.lit("connector").alias("kind"), F.lit("info").alias("severity"))
    u = ordered.findings({"layout": found(spark, sf_dir), "lines": lines})
    return u.withColumn("severity_rank", C.severity_rank(F.col("severity"))).orderBy("severity_rank", "slide", "ord", "kind")


FONT_SQL = "f AS (SELECT DISTINCT trim(unnest(string_split(p_brand || ', ' || p_type || ', serif', ','))) AS font FROM part)"


@query(f"WITH {FONT_SQL} SELECT font, font LIKE 'Brand%' AND right(font, 1) IN ('1', '2') AS available FROM f WHERE font <> 'serif'")
def font_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, U02, J13"""
    p = table(spark, sf_dir, "part")
    used = p.select(F.explode(C.families(F.concat_ws(", ", F.concat(F.lit("'"), "p_brand", F.lit("'")), "p_type", F.lit("serif")))).alias("font")).distinct()
    there = p.where("p_brand rlike '[12]$'").select(F.col("p_brand").alias("font"))
    return matching.with_presence(used, there, "font")


@query(f"""WITH {E_SQL}, m AS (SELECT slide, ord, x + 1 AS x, y, w, CASE WHEN s % 3 = 0 THEN NULL ELSE h END AS h FROM e WHERE p % 2 = 0)
SELECT e.slide, e.ord, CASE WHEN m.h IS NOT NULL THEN m.x ELSE e.x END AS x, e.h FROM e LEFT JOIN m ON m.slide = e.slide AND m.ord = e.ord""")
def merge_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J05"""
    e = elements(spark, sf_dir)
    m = e.where("p % 2 = 0").select("slide", F.col("ord"), (F.col("x") + 1).alias("x"), "y", "w", F.when(F.col("s") % 3 != 0, F.col("h")).alias("h"))
    keyed = m.withColumnRenamed("ord", "el").withColumn("ord", F.lit(0))
    return matching.merge_measured(e.withColumnRenamed("ord", "el"), keyed, ["slide", "el"]).select("slide", F.col("el").alias("ord"), "x", "h")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name AS src, p_name IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey")
def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10"""
    a = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("src"), F.col("p_size").alias("ord"))
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("asset_id"))
    return matching.resolve_assets(e, a).select("l_orderkey", "l_linenumber", "l_partkey", "src", "missing")


@query(f"WITH {SCORE_SQL} SELECT sc.slide, coalesce(o.v, score) AS score FROM sc LEFT JOIN (SELECT o_orderkey, (o_custkey % 101)::BIGINT AS v FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = slide")
def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16"""
    ext = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("slide"), (F.col("o_custkey") % 101).alias("score"))
    return matching.overridden(scored(spark, sf_dir).select("slide", "score"), ext, "slide", "score")


@query(f"""WITH {E_SQL}, m AS (SELECT * FROM e WHERE p % 2 = 0), u AS (SELECT slide, ord, y, h, true AS measured FROM m UNION ALL SELECT slide, ord, y, h, false FROM e WHERE p % 2 = 1)
SELECT slide, ord, measured, greatest(0.55::DOUBLE, coalesce(max(CASE WHEN measured THEN y + h END) OVER (PARTITION BY slide), 0)) + 0.15::DOUBLE AS cursor FROM u""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22"""
    e = elements(spark, sf_dir).select("slide", "ord", "id", "y", "h", "p")
    return matching.hybrid_merge(e.where("p % 2 = 0"), e, "id").select("slide", "ord", "measured", "cursor")


X06 = """o AS (SELECT o_orderkey AS slide_id, o_orderstatus AS st, o_orderpriority AS idea, o_orderkey % 4 AS n, o_custkey % 2 = 0 AS head FROM orders),
q AS (SELECT slide_id, 0 AS ord, 'headline' AS id, 'text' AS type, 0.7::DOUBLE AS x, 0.5::DOUBLE AS y, 11.8::DOUBLE AS w, 0.7::DOUBLE AS h, CASE WHEN head THEN 'Head' ELSE idea END AS text, CASE WHEN n = 0 THEN 38 ELSE 28 END AS font_size, NULL AS fill FROM o
UNION ALL SELECT slide_id, 1, 'subtitle', 'text', 0.75, 1.35, 7.2, 0.45, 'why', 17, NULL FROM o WHERE st = 'F' UNION ALL SELECT slide_id, 2, 'accent-bar', 'shape', 0.75, 6.45, 3.4, 0.08, NULL, NULL, '#2563EB' FROM o WHERE st = 'F'
UNION ALL SELECT slide_id, 1, slide_id || '-diagram', 'diagram', 0.8, 1.4, 11.7, 5.2, NULL, NULL, NULL FROM o WHERE st = 'O' UNION ALL SELECT slide_id, 2, 'main-idea', 'text', 0.75, 6.7, 11.8, 0.4, idea, 12, NULL FROM o WHERE st = 'O'
UNION ALL SELECT slide_id, 1, 'main-idea', 'text', 0.75, 1.25, 5.1, 1.1, idea, 16, NULL FROM o WHERE st NOT IN ('F', 'O') UNION ALL SELECT slide_id, 2, 'content-panel', 'shape', 6.2, 1.25, 6.0, 4.9, NULL, NULL, '#EEEEEE' FROM o WHERE st NOT IN ('F', 'O'))"""


@query(f"WITH {X06} SELECT slide_id, ord, id, type, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, text, font_size::DOUBLE AS font_size, fill FROM q")
def compiled_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X06"""
    st, text = F.col("o_orderstatus"), lambda k, v: F.create_map(F.lit(k), F.lit(v))
    slots = F.when(F.col("o_custkey") % 2 == 0, text("headline", "Head")).otherwise(F.create_map().cast("map<string,string>"))
    specs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slide_id"), (F.col("o_orderkey") % 4).alias("slide_ord"), F.when(st == "F", "cover").otherwise("body").alias("layout_type"), F.lit("why").alias("intent"), F.col("o_orderpriority").alias("main_idea"), slots.alias("slots"), F.lit(None).cast("array<struct<label:string,nodes:array<string>>>").alias("layers"), text("surface", "#EEEEEE").alias("palette"), (st == "O").alias("layered"))
    return ordered.compiled_slides(specs).select(F.col("slide_id").cast("long").alias("slide_id"), "ord", "id", "type", *"xywh", "text", "font_size", "fill")


@query("SELECT d.direction_id, d.\"primary\", r_regionkey, r_name FROM region CROSS JOIN (VALUES ('direction-001', '#1D4ED8'), ('direction-002', '#35D0FF'), ('direction-003', '#0F766E')) AS d(direction_id, \"primary\")")
def direction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08, P33"""
    return ordered.directions(table(spark, sf_dir, "region").select("r_regionkey", "r_name")).select("direction_id", "primary", "r_regionkey", "r_name")


@query("""SELECT o_custkey, '{"a":' || count(*) || ',"z":[' || to_json(map_from_entries(list_sort(list({k: o_orderpriority, v: {b: n, c: o_custkey}}))))::VARCHAR || ']}' AS doc FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def sorted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order at every depth."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    inner = F.struct(F.col("o_custkey").alias("c"), F.col("n").alias("b"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", inner))).alias("m"), F.count("*").alias("n"))
    doc = m.select("o_custkey", F.struct(F.array("m").alias("z"), F.col("n").alias("a")).alias("doc"))
    return doc.select("o_custkey", C.sorted_json(F.col("doc"), doc.schema["doc"].dataType).alias("doc"))


@query("SELECT conv_id, list_sort(list(DISTINCT role || '.md'))::VARCHAR AS files, list_sort(list_filter(['assistant.md', 'system.md', 'user.md'], lambda x: NOT list_contains(list(DISTINCT role || '.md'), x)))::VARCHAR AS missing FROM conversations GROUP BY 1")
def package_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K03"""
    files = table(spark, sf_dir, "conversations").select("conv_id", F.concat("role", F.lit(".md")).alias("name"))
    required = spark.createDataFrame([("user.md",), ("assistant.md",), ("system.md",)], "name string")
    index = sinks.package_index(files, required, "conv_id")
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]")).alias(c)
    return index.select("conv_id", shown("files"), shown("missing"))


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS manifest, max(CASE WHEN turn = 3 THEN role END) AS final, CASE WHEN count(*) FILTER (turn = 3) > 0 THEN 'ready' ELSE 'draft' END AS status FROM conversations GROUP BY 1")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04"""
    name = F.when(F.col("turn") == 0, "deck.manifest.json").when(F.col("turn") == 3, "deck.pptx").otherwise("other")
    files = table(spark, sf_dir, "conversations").select("conv_id", name.alias("name"), F.col("role").alias("path"))
    return sinks.run_index(files, "conv_id").select("conv_id", "manifest", "final", "status")


@query(f"WITH {E_SQL} SELECT slide, ord, {up('(p % 1280) / 1280::DOUBLE * 13.333::DOUBLE', 3)} AS x_in FROM e")
def measured_inches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06"""
    return elements(spark, sf_dir).select("slide", "ord", C.to_inches(F.col("p") % 1280, F.lit(1280), F.lit(13.333)).alias("x_in"))


@query("SELECT p_partkey, greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(least(x + w, 80) - greatest(x, 0), 0) AS w, greatest(least(y + h, 40) - greatest(y, 0), 0) AS h FROM (SELECT p_partkey, p_partkey % 107 - 20 AS x, p_partkey % 61 - 10 AS y, p_partkey % 31 AS w, p_partkey % 17 AS h FROM part)")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07"""
    k = F.col("p_partkey")
    box = C.px_box_clamped(k % 107 - 20, k % 61 - 10, k % 31, k % 17, F.lit(80), F.lit(40))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query(f"WITH {E_SQL} SELECT slide, ord, (p % 50 > 42 OR s % 20 > 17) AS overflows, w * (p % 13 - (x + w)) + h * (s % 7 - (y + h)) AS dot FROM e")
def node_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12"""
    x, y, w, h, p, s = (F.col(c) for c in "xywhps")
    return elements(spark, sf_dir).select("slide", "ord", C.box_overflow(p % 50, s % 20, F.lit(40), F.lit(15)).alias("overflows"), C.direction_dot(x, y, x + w, y + h, p % 13, s % 7).alias("dot"))


@query("""SELECT p_partkey, CASE WHEN v IS NULL THEN 'warn' WHEN v >= 4 THEN 'pass' WHEN v = 3 THEN 'warn' ELSE 'fail' END AS level, CASE WHEN p_partkey % 5 <= 1 THEN 'pass' WHEN p_partkey % 5 <= 3 THEN 'warn' ELSE 'fail' END AS drift,
CASE WHEN p_partkey % 100 >= 85 THEN 'pass' WHEN p_partkey % 100 >= 70 THEN 'warn' ELSE 'fail' END AS palette, CASE WHEN p_partkey % 97 >= 75 THEN 'fail' WHEN p_partkey % 97 >= 40 THEN 'warn' ELSE 'pass' END AS slop,
CASE WHEN p_partkey % 4 > 2 THEN 'fail' WHEN p_partkey % 3 > 0 THEN 'warn' ELSE 'pass' END AS bounds, CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'warn' END AS safety, CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'warn' END AS floor
FROM (SELECT p_partkey, nullif(p_size % 6, 0) AS v FROM part)""")
def reading_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24"""
    k, v = F.col("p_partkey"), F.nullif(F.col("p_size") % 6, F.lit(0))
    of = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % 4 + 1).cast("int"))
    more = [C.kind_tone(F.when(k % 4 > 2, 1).otherwise(0), k % 3).alias("bounds"), C.safety_tone(of("passed", "violated-blocked", "violated-with-flag", None)).alias("safety"), C.floor_tone(of("true", "false", "with-justification", None)).alias("floor")]
    return table(spark, sf_dir, "part").select("p_partkey", C.tone(v, k % 5, k % 100 / 100, k % 97).alias("t"), *more).select("p_partkey", "t.*", "bounds", "safety", "floor")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 OR p_size % 7 = 1 THEN 'business-neutral' WHEN p_partkey % 5 = 2 OR p_size % 7 = 2 THEN 'dark-tech' ELSE 'business-neutral' END AS suggestion FROM part")
def palette_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26, U04"""
    of = lambda v, a, b: F.when(v == 1, a).when(v == 2, b).otherwise("#ffffff")
    palette = F.array(of(F.col("p_partkey") % 5, "#3b82f6", "#111827"), of(F.col("p_size") % 7, "#1D4ED8", "#0f172a"))
    return table(spark, sf_dir, "part").select("p_partkey", C.suggest_design(palette).alias("suggestion"))


@query("""SELECT p_partkey, CASE r WHEN 'cover' THEN 'hero' WHEN 'architecture' THEN 'architecture-layered' WHEN 'process' THEN 'process-flow' WHEN 'metrics' THEN 'metrics-dashboard' WHEN 'comparison' THEN 'comparison-matrix' WHEN 'roadmap' THEN 'roadmap' ELSE 'executive-summary' END AS layout,
CASE g WHEN 'headline' THEN 'textBlock' WHEN 'metric' THEN 'metric' WHEN 'diagram' THEN 'semanticDiagram' WHEN 'chart' THEN 'nativeChart' ELSE 'card' END AS component, CASE k WHEN 'font-size' THEN 'font-too-small' WHEN 'odd' THEN 'bounds' ELSE k END AS kind
FROM (SELECT p_partkey, list_extract(['cover', 'architecture', 'process', 'metrics', 'comparison', 'roadmap', 'summary', 'odd', ''], p_partkey % 9 + 1) AS r, list_extract(['headline', 'metric', 'diagram', 'chart', 'body'], p_partkey % 5 + 1) AS g, list_extract(['bounds', 'overlap', 'font-size', 'text-overflow', 'odd'], p_size % 5 + 1) AS k FROM part)""")
def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29, P30"""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    k = F.col("p_partkey")
    role = pick(("cover", "architecture", "process", "metrics", "comparison", "roadmap", "summary", "odd", ""), k)
    kind = C.mapped(pick(("bounds", "overlap", "font-size", "text-overflow", "odd"), F.col("p_size")), preflight.KINDS, "bounds")
    return table(spark, sf_dir, "part").select("p_partkey", C.layout_pattern(F.lit(""), role).alias("layout"), C.component_type(pick(("headline", "metric", "diagram", "chart", "body"), k)).alias("component"), kind.alias("kind"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 40 > 0 AND p_size / (p_partkey % 40)::DOUBLE >= 1.6::DOUBLE")
def wide_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P32"""
    return table(spark, sf_dir, "part").where(C.is_wide(F.col("p_size"), F.col("p_partkey") % 40)).select("p_partkey")


@query(f"WITH {E_SQL}, {ROLE_SQL} SELECT slide, ord, rb AS role_bucket FROM er WHERE rb IN ('body', 'caption') AND s % 4 > CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END")
def tight_letter_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hundredths of an em, with text in two scripts."""
    e = with_roles(spark, sf_dir).withColumns({"text": F.when(F.col("p") % 5 == 0, "标题").otherwise("title"), "letter_spacing": F.col("s") % 4 / -100})
    return checks.letter_spacing(e).select("slide", "ord", "role_bucket")


@query("SELECT c_custkey, ord, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS ord, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def last_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a component of its customer's slide."""
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    return matching.first_match(table(spark, sf_dir, "customer").select("c_custkey"), parts, "c_custkey", last=True)


@query("SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def first_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator; Spark keeps five rows of a key in each task before the exchange."""
    n = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", n.alias("n")).where("n <= 5")


CRITIC = """k AS (SELECT slide, ord, 'el-' || slide || '-' || ord AS id, CASE (p + ord) % 4 WHEN 0 THEN 'chart' WHEN 1 THEN 'shape' WHEN 2 THEN 'diagram' ELSE 'line' END AS t, w * 5 AS w, h * 6 AS h, role, p, s FROM e)"""


@query(f"""WITH {E_SQL}, {CRITIC} SELECT slide, ord, 'dominant-empty-container' AS issue, 'medium' AS severity FROM k WHERE t = 'shape' AND w * h / (13.333::DOUBLE * 7.5::DOUBLE) >= 0.7::DOUBLE AND role IS NULL
UNION ALL SELECT slide, ord, 'chart-label-density', 'medium' FROM k WHERE t = 'chart' AND p % 12 > greatest(1, floor(w / 0.45::DOUBLE)) UNION ALL SELECT slide, ord, t || '-description', 'medium' FROM k WHERE t IN ('chart', 'diagram') AND s % 2 = 1
UNION ALL SELECT slide, ord, 'diagram-empty-layers', 'high' FROM k WHERE t = 'diagram' AND p % 2 = 0 AND s % 3 < 2""")
def critic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07, F08"""
    p, s_ = F.col("p"), F.col("s")
    layer = F.array(F.struct(F.lit("l").alias("label"), F.array(F.lit("n")).alias("nodes")))
    e = elements(spark, sf_dir).withColumns({
        "type": F.element_at(F.array(*map(F.lit, ("chart", "shape", "diagram", "line"))), ((p + F.col("ord")) % 4 + 1).cast("int")), "w": F.col("w") * 5, "h": F.col("h") * 6, "text": F.lit(""),
        "data": F.array_repeat(F.lit(1), (p % 12).cast("int")), "description": F.when(s_ % 2 == 0, "said"), "kind": F.when(p % 2 == 0, "swimlane").otherwise("matrixMap"),
        "layers": F.when(s_ % 3 == 1, F.slice(layer, 1, 0)), "lanes": F.when(s_ % 3 == 2, layer),
    })
    return checks.critic_rules(e, ["slide"]).select("slide", "ord", "issue", "severity")


@query("""SELECT p_partkey, coalesce(CASE WHEN t = 'blob' THEN 'unsupported element type' END, CASE WHEN id = '' THEN 'element id is required' END, CASE WHEN x IS NULL THEN 'x must be numeric' END, CASE WHEN x IS NOT NULL AND w <= 0 THEN 'w and h must be positive' END, CASE WHEN w > 0 AND x + w > 13.333::DOUBLE THEN 'outside slide bounds' END,
CASE WHEN t = 'text' AND p_size % 2 = 0 THEN 'text is required' WHEN t = 'shape' AND p_size % 2 = 0 THEN 'unsupported shape' WHEN t = 'image' AND p_size % 2 = 0 THEN 'src is required' WHEN t = 'image' AND p_size % 3 = 0 THEN 'remote src must be downloaded before validation: http://x' WHEN t = 'table' AND p_size % 2 = 0 THEN 'rows are required' WHEN t = 'icon' AND p_size % 2 = 0 THEN 'unsupported icon name'
WHEN t = 'chart' AND p_size % 2 = 0 THEN 'chart.kind must be one of bar, groupedBar, horizontalBar, kpiGroup, line, pie, sparkline, stackedBar' WHEN t = 'chart' AND p_size % 3 = 0 THEN 'chart.data is required' WHEN t = 'chart' AND p_size % 5 = 0 THEN 'chart.data[0].label is required' WHEN t = 'chart' AND p_size % 7 = 0 THEN 'chart.data[0].value must be numeric'
WHEN t = 'diagram' AND p_size % 2 = 0 THEN 'diagram layers are required' WHEN t = 'diagram' AND p_size % 3 = 0 THEN 'diagram layer 0 label is required' WHEN t = 'cropped-asset' AND p_size % 2 = 0 THEN 'cropped-asset requires src or assets.id' WHEN t = 'cropped-asset' AND p_size % 3 = 0 THEN 'cropped-asset crop w and h must be positive' END) AS first_violation
FROM (SELECT p_partkey, p_size, list_extract(['text', 'shape', 'image', 'table', 'line', 'chart', 'icon', 'diagram', 'cropped-asset', 'blob'], p_partkey % 10 + 1) AS t, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'e' END AS id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 14 END::DOUBLE AS x, (p_partkey % 3 - 0.5::DOUBLE) AS w FROM part)""")
def element_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rule that a checker which stops at the first would name."""
    k, n = F.col("p_partkey"), F.col("p_size")
    even, third = n % 2 == 0, n % 3 == 0
    label = F.when(n % 5 != 0, "a")
    point = F.struct(label.alias("label"), F.when(n % 7 != 0, 1.0).alias("value"), F.lit(None).cast("map<string,double>").alias("series"))
    layer = F.struct(F.when(~third, "a").alias("label"), F.array(F.lit("n")).alias("nodes"))
    e = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.array(*map(F.lit, (*structure.TYPES[:4], "line", "chart", "icon", "diagram", "cropped-asset", "blob"))), (k % 10 + 1).cast("int")).alias("type"), F.when(k % 23 == 0, "").otherwise("e").alias("id"),
        F.when(k % 19 != 0, (k % 14).cast("double")).alias("x"), F.lit(0.0).alias("y"), (k % 3 - 0.5).alias("w"), F.lit(1.0).alias("h"), F.when(~even, "t").alias("text"), F.when(even, "star").otherwise("rect").alias("shape"),
        F.when(~even, F.when(third & (k % 10 == 2), "http://x").otherwise("a.png")).alias("src"), F.when(k % 10 == 5, F.when(even, "odd").otherwise("bar")).otherwise("swimlane").alias("kind"), F.when(even, "star").otherwise("x").alias("name"), F.when(~even, F.array(F.lit("r"))).alias("rows"),
        F.when(~third, F.array(point)).alias("data"), F.when(~even, F.array(layer)).alias("layers"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(third, 0.0).otherwise(1.0).alias("w"), F.lit(1.0).alias("h")).alias("crop"),
    )
    return structure.element_issues(e).select("p_partkey", "first_violation")


@query("""SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 5 = 0 THEN 'storyboard.title must be a non-empty string' END, CASE WHEN o_orderkey % 7 = 0 THEN 'storyboard.audience must be a non-empty string' END, CASE WHEN o_orderkey % 11 = 0 THEN 'storyboard.slides must not be empty' END,
CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 3 = 0 THEN 'storyboard.slides[0].id must be a non-empty string' END, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 4 = 0 THEN 'storyboard.slides[0].contentBlocks must be an array' END) AS violations FROM orders""")
def storyboard_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13"""
    k = F.col("o_orderkey")
    slide = F.struct(F.when(k % 3 != 0, "s").alias("id"), F.lit("r").alias("role"), F.lit("m").alias("message"), F.when(k % 4 != 0, F.array(F.lit("b"))).alias("contentBlocks"))
    board = F.struct(F.when(k % 5 == 0, " ").otherwise("t").alias("title"), F.when(k % 7 != 0, "a").alias("audience"), F.lit("g").alias("goal"), F.lit("en").alias("language"), F.when(k % 11 == 0, F.slice(F.array(slide), 1, 0)).otherwise(F.array(slide)).alias("slides"))
    rows = structure.storyboard_issues(table(spark, sf_dir, "orders").select("o_orderkey", board.alias("board")), "board")
    return rows.select("o_orderkey", F.array_join("violations", "|").alias("violations"))


PX = f"{AREA} * 10000"


@query(f"""WITH {E_SQL}, {ST_SQL}, n AS (SELECT * FROM st WHERE id NOT LIKE 'connector%'), sl AS (SELECT DISTINCT slide, 1280 + slide % 5 AS sw FROM e),
i AS (SELECT slide, 'slide-size-mismatch' AS kind FROM sl WHERE sw > 1282 UNION ALL SELECT n.slide, 'slide-bounds' FROM n JOIN sl USING (slide) WHERE (x + w) * 100 > sw + 2 OR (y + h) * 100 > 722 UNION ALL SELECT slide, CASE WHEN s % 2 = 0 THEN 'content-clipped' ELSE 'text-overflow' END FROM n WHERE text IS NOT NULL AND p % 5 > 2 UNION ALL SELECT slide, 'asset-not-ready' FROM n WHERE type = 'image' AND p % 3 = 0
UNION ALL SELECT a.slide, 'overlap' FROM n a JOIN n b ON a.slide = b.slide AND a.ord < b.ord WHERE coalesce(a.role, '') <> 'background' AND coalesce(b.role, '') <> 'background' AND {PX} > 4 AND {PX} / greatest(1, least(a.w * a.h, b.w * b.h) * 10000) > 0.01::DOUBLE AND (a.id LIKE 'card%' AND b.id LIKE 'card%' OR a.text IS NOT NULL OR b.text IS NOT NULL OR {PX} / greatest(1, least(a.w * a.h, b.w * b.h) * 10000) > 0.05::DOUBLE))
SELECT slide, kind, count(*) AS n FROM i GROUP BY 1, 2""")
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as measured nodes of pages, a hundred pixels an inch."""
    e = with_styles(elements(spark, sf_dir)).where("id not like 'connector%'")
    p = F.col("p")
    nodes = e.withColumns({c: F.col(c) * 100 for c in "xywh"}).withColumns({
        "path": F.col("ord").cast("string"), "scroll_w": F.col("w") + p % 5, "scroll_h": F.col("h"), "client_w": F.col("w"), "client_h": F.col("h"), "clipped": F.col("s") % 2 == 0,
        "image_ready": F.when(F.col("type") == "image", p % 3 != 0), "card": F.col("id").like("card%"), "seen": F.lit(True),
    })
    slides = elements(spark, sf_dir).select("slide").distinct().select("slide", (F.col("slide") % 5 + 1280).cast("double").alias("w"), F.lit(720.0).alias("h"))
    return pages.audit(nodes, slides, "slide").groupBy("slide", "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, n_name AS resolved FROM events JOIN nation ON n_nationkey = user_id % 25")
def token_deref_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token is known here; an unknown one raises."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{k."), F.col("user_id") % 25, F.lit("}")).alias("raw"))
    return matching.deref(e, "raw", nation_paths(spark, sf_dir), strict=True).select("event_id", "resolved")


@query("SELECT p_partkey, '#' || lower(printf('%06X', p_partkey * 4097 % 16777216)) || ', #abc' || CASE WHEN p_partkey % 2 = 0 THEN ', #12345678' ELSE '' END AS colours FROM part")
def inline_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: of style attributes, each colour once, in order."""
    k = F.col("p_partkey")
    first = colour(k * 4097 % 16777216)
    html = F.concat(F.lit("<p style=\"color:#"), first, F.lit("; background: #ABC\">#999999<b style='fill:#"), first, F.when(k % 2 == 0, "; stroke:#12345678").otherwise(""), F.lit("'></b></p>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.inline_colours(html), ", ").alias("colours"))


@query("""WITH m AS (SELECT l_orderkey AS slide, count(*) FILTER (l_partkey % 7 = 0) AS markers, count(*) FILTER (l_suppkey % 9 = 0) AS containers, max(CASE WHEN l_partkey % 11 = 0 THEN 'known' WHEN l_partkey % 13 = 0 THEN 'a-none' END) AS a FROM lineitem GROUP BY 1)
SELECT slide, markers, containers, CASE WHEN a = 'known' AND markers > 0 THEN 'measured' WHEN markers > 0 AND containers > 0 THEN 'hybrid' WHEN markers > 0 THEN 'measured' ELSE 'auto-layout' END AS mode FROM m""")
def layout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a slide's nodes."""
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    pair = lambda test, key, value: F.when(test, F.struct(F.lit(key).alias("k"), value.alias("v")))
    attrs = F.map_from_entries(F.array_compact(F.array(pair(k % 7 == 0, "data-pptx-kind", F.lit("text")), pair(n % 9 == 0, "class", F.lit("big cards")), pair((k % 11 == 0) | (k % 13 == 0), "data-archetype", F.when(k % 11 == 0, "known").otherwise("a-none")))))
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), attrs.alias("attrs"))
    return scoring.layout_modes(nodes, "slide", spark.createDataFrame([("known",)], "archetype string")).select("slide", "markers", "containers", "mode")


@query("""SELECT doc_id, printf('slide-%03d', row_number() OVER w) || '-' || doc_id AS slide_id, first_value(lang) OVER w AS deck_design, first_value(n_chars) OVER w AS deck_size FROM documents WINDOW w AS (PARTITION BY source ORDER BY '/d/' || lang || '/' || doc_id || '.png')""")
def merged_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as the images of a deck."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("/d/"), "lang", F.lit("/"), "doc_id", F.lit(".png")).alias("path"), F.col("lang").alias("design"), F.col("n_chars").alias("size"))
    return ordered.merged_slides(d, "source").select("doc_id", "slide_id", "deck_design", "deck_size")


BAND = "b AS (SELECT user_id, n AS band, list_extract(['header', 'content', 'footer', 'section', 'section'], n) AS label, (n - 1) * 1.5::DOUBLE AS y, (event_id % 9 + 2) / 8::DOUBLE AS h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), "event_id", n.alias("band")).where("band <= 5")
    label = F.element_at(F.array(*map(F.lit, ("header", "content", "footer", "section", "section"))), F.col("band"))
    box = {"in_x": F.lit(0.0), "in_y": (F.col("band") - 1) * 1.5, "in_w": F.lit(13.333), "in_h": (F.col("event_id") % 9 + 2) / 8.0}
    return b.withColumns({"label": label} | box | {c: F.col("band").cast("double") for c in "xywh"})


@query(f"""WITH {BAND} SELECT user_id AS image_id, 'band-' || band || '-background' AS id, 'native-shape' AS editable_as, 0.72::DOUBLE AS confidence, {up("y")} AS y FROM b
UNION ALL SELECT user_id, 'band-' || band || CASE label WHEN 'header' THEN '-title-text' ELSE '-content-group' END, CASE label WHEN 'header' THEN 'native-text' ELSE 'native-shape' END, CASE label WHEN 'header' THEN 0.58::DOUBLE ELSE 0.52::DOUBLE END, {up("y")} FROM b WHERE label <> 'footer'""")
def band_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first five events are the bands of an image."""
    c = ordered.band_candidates(bands(spark, sf_dir))
    return c.select("image_id", "id", "editable_as", F.col("confidence").cast("double").alias("confidence"), C.half_up(F.col("inch_box.y"), 4).alias("y"))


@query(f"""WITH {BAND}, k AS (SELECT user_id AS image_id, 'title-placeholder' AS id, 0.7::DOUBLE AS x, {up("y + 0.05::DOUBLE")} AS y, 11.933::DOUBLE AS w, {up("least(0.9::DOUBLE, h - 0.1::DOUBLE)")} AS h FROM b WHERE band = 1
UNION ALL SELECT user_id, 'card-left-placeholder', 0.7::DOUBLE, {up("y + 0.1::DOUBLE")}, 5.8665::DOUBLE, {up("least(2.2::DOUBLE, h - 0.2::DOUBLE)")} FROM b WHERE band = 2
UNION ALL SELECT user_id, 'card-left-text-placeholder', 0.95::DOUBLE, {up("y + 0.25::DOUBLE")}, 5.4665::DOUBLE, 0.5::DOUBLE FROM b WHERE band = 2) SELECT image_id, id, x, y, w, h FROM k""")
def image_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X05"""
    return ordered.skeleton(bands(spark, sf_dir), 13.333).select("image_id", "id", *"xywh")
