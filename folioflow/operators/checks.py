"""Layout checks over element tables: rules, pairs within a slide, connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import marks

CELL, MANY = 2.0, 64  # inches of a cell of the overlap grid; cells over which an element counts as wide


def near_pairs(elements: DataFrame, keys: list[str], cols: list[str], reach: float = 0.0, cell: float = CELL) -> DataFrame:
    """(keys, a, b): pairs of elements (structs of ord, x, y, w, h and `cols`), a.ord < b.ord, that touch or are at most `reach`
    apart in either direction, and some that are not: the caller judges. Elements without a place have no pairs.

    Pairs are looked for in cells, so a slide with very many elements is not one run of all pairs; a pair counts in the cell of its
    common top left corner only. What covers more than MANY cells, or has a negative extent, is held against all others of its slide.
    """
    r, pad, cell = C.Rect(), reach * 0.501 + (1e-6 if reach else 0.0), max(cell, 4 * reach)
    at = lambda v: F.floor(v / cell)
    left, top, right, bottom = at(r.x - pad), at(r.y - pad), at(r.right + pad), at(r.bottom + pad)
    wide = (r.w < 0) | (r.h < 0) | ((right - left + 1) * (bottom - top + 1) > MANY)
    cells = F.flatten(F.transform(F.sequence(left, right), lambda cx: F.transform(F.sequence(top, bottom), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    e = elements.where(" and ".join(f"{c} is not null" for c in "xywh")).withColumn("wide", wide)
    box = F.struct("ord", *"xywh", *[c for c in cols if c not in ("ord", *"xywh")])
    dealt = e.where("not wide").select(*keys, box.alias("a"), F.inline(cells))
    a, b = C.Rect("a"), C.Rect("b")
    home = (at(F.greatest(a.x, b.x) - pad) == F.col("cx")) & (at(F.greatest(a.y, b.y) - pad) == F.col("cy"))
    near = dealt.join(dealt.withColumnRenamed("a", "b"), [*keys, "cx", "cy"]).where((F.col("a.ord") < F.col("b.ord")) & home).select(*keys, "a", "b")
    one, all_ = e.where("wide").select(*keys, box.alias("a")), e.select(*keys, box.alias("b"), "wide")
    big = one.join(all_, keys).where((F.col("a.ord") != F.col("b.ord")) & (~F.col("wide") | (F.col("a.ord") < F.col("b.ord"))))
    first = F.col("a.ord") < F.col("b.ord")
    return near.unionByName(big.select(*keys, F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")))


CARD, SURFACE = "card", "card|panel|container|surface"  # fixed values


def named_like(pattern: str, *cols: str) -> Column:
    """A shape whose id or other names hold one of some words."""
    return (F.col("type") == "shape") & F.lower(F.concat_ws(" ", *cols)).rlike(pattern)


def pair_columns(keys: list[str], **measure: Column) -> list[Column]:
    ids = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("ord", "id") for side in "ab"]
    return [*[F.col(k) for k in keys], *ids, *[C.half_up(v, 4).alias(name) for name, v in measure.items()]]


def overlap_pairs(elements: DataFrame, keys: list[str]) -> DataFrame:
    """What lies within a container's surface overlaps it on purpose; what is within anything else doesn't."""
    own = ["component"] if "component" in elements.columns else []
    keep = (F.col("type") != "line") & ~C.is_decoration(F.col("role"), F.col("id")) & (F.col("w") > 0) & (F.col("h") > 0)
    e = elements.where(keep).withColumn("surface", named_like(SURFACE, "id", "role", *own))
    a, b = C.Rect("a"), C.Rect("b")
    meant = (F.col("a.surface") & a.contains(b)) | (F.col("b.surface") & b.contains(a))
    hit = a.meets(b) & ~meant & (a.share(b) > C.OVERLAP_SHARE)
    return near_pairs(e, keys, ["id", "surface"]).where(hit).select(*pair_columns(keys, ratio=a.share(b)))


def spacing_pairs(elements: DataFrame, keys: list[str], spacing: float = 0.5) -> DataFrame:
    """Cards (shapes named so) that don't overlap and are nearer than `spacing`; a spacing over 2 is in points."""
    least = spacing / 72 if spacing > 2 else spacing
    own = ["component"] if "component" in elements.columns else []
    a, b = C.Rect("a"), C.Rect("b")
    cards = elements.where(named_like(CARD, "id", *own))
    return near_pairs(cards, keys, ["id"], least).where(~a.meets(b) & (a.gap(b) < least)).select(*pair_columns(keys, gap=a.gap(b)))


def bounds(elements: DataFrame) -> DataFrame:
    """F01 rows with whether F02 rejects them too."""
    r = C.Rect()
    return elements.where(r.outside()).withColumn("strict", r.outside_strict())


def rules_table(elements: DataFrame, rules: dict[str, tuple[float, float]], metric: str) -> DataFrame:
    rows = [(role, metric, *cut) for role, cut in rules.items()]
    return elements.sparkSession.createDataFrame(rows, "rule_role string, metric string, critical double, warning double")


def threshold_checks(elements: DataFrame, value: str, metric: str, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """`elements` have `role_bucket`; roles without a rule use body's. The rule table has as many rows as there are roles."""
    bucket = F.when(F.col("role_bucket").isin(*rules), F.col("role_bucket")).otherwise("body")
    joined = elements.withColumn("rule_role", bucket).join(F.broadcast(rules_table(elements, rules, metric)), "rule_role")
    v = F.col(value)
    return joined.withColumn("severity", F.when(v < F.col("critical"), "critical").when(v < F.col("warning"), "warning")).where("severity is not null")


def letter_spacing(elements: DataFrame) -> DataFrame:
    """F04"""
    least = F.when(F.col("text").rlike(C.CJK), -0.02).otherwise(-0.01)
    return elements.where(F.col("role_bucket").isin("body", "caption") & (F.col("letter_spacing") < least))


def connectors(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (source_id, target_id) with `status`, `severity`, the `related` id and a `suggestion`.

    Ends are found by id in the slide; of duplicate ids the last wins. Lines without either id are judged only if they are named
    connector or arrow: their ends can't be verified (warning). A missing or untouched end is critical; with both ends there, the
    line between the facing sides is suggested.
    """
    boxes = elements.where(F.coalesce("id", F.lit("")) != "").groupBy(*keys, "id").agg(F.max_by(F.struct("x", "y", "w", "h"), "ord").alias("box"))
    lines = elements.where("type = 'line'")
    ends = [boxes.select(*keys, F.col("id").alias(f"{end}_id"), F.col("box").alias(end)) for end in ("source", "target")]
    both = lines.join(ends[0], [*keys, "source_id"], "left").join(ends[1], [*keys, "target_id"], "left")
    s, t = C.Rect("source"), C.Rect("target")
    start, stop = s.touched_by(F.col("x"), F.col("y")), t.touched_by(F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    bare = (F.coalesce("source_id", F.lit("")) == "") & (F.coalesce("target_id", F.lit("")) == "")
    status = F.when(bare & F.coalesce(F.lower("id").rlike("connector|arrow"), F.lit(False)), "unverified").when(bare, "plain")
    status = status.when(F.col("source").isNull(), "missing-source").when(F.col("target").isNull(), "missing-target").when(~start | ~stop, "detached").otherwise("attached")
    a, b = s.anchor_toward(t), t.anchor_toward(s)
    line = F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("w"), (b["y"] - a["y"]).alias("h"))
    out = both.withColumn("status", status)
    return out.select("*", F.when(F.col("status") == "unverified", "warning").when(~F.col("status").isin("attached", "plain"), "critical").alias("severity"), F.when(F.col("status") == "missing-source", F.col("source_id")).when(F.col("status").isin("missing-target", "detached"), F.col("target_id")).alias("related"), F.when(F.col("status") == "detached", line).alias("suggestion"))


def critic_rules(elements: DataFrame, keys: list[str], width: float = C.SLIDE_W, height: float = C.SLIDE_H) -> DataFrame:
    """(keys, ord, id, issue, severity) of dominant empty containers, crowded chart labels, missing descriptions and
    layered diagrams without layers."""
    c, r = F.col, C.Rect()
    bare = (F.coalesce(c("text"), F.lit("")) == "") & (F.coalesce(c("role"), F.lit("")) == "") & ~F.coalesce(F.lower("id").rlike("background|backdrop|canvas"), F.lit(False))
    plain = F.coalesce("description", F.lit("")) == ""
    layers = F.coalesce("layers", "lanes")
    row = lambda test, issue, severity: F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array(
        row((c("type") == "shape") & (r.w * r.h / max(1.0, width * height) >= 0.7) & bare, "dominant-empty-container", "medium"),
        row((c("type") == "chart") & (F.coalesce(F.size("data"), F.lit(0)) > F.greatest(F.lit(1), F.floor(r.w / 0.45))), "chart-label-density", "medium"),
        row((c("type") == "chart") & plain, "chart-description", "medium"),
        row((c("type") == "diagram") & plain, "diagram-description", "medium"),
        row((c("type") == "diagram") & c("kind").isin(*marks.LAYERED) & (layers.isNull() | (F.size(layers) <= 0)), "diagram-empty-layers", "high"),
    )
    return elements.select(*keys, "ord", "id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def critic_repairs(issues: DataFrame) -> DataFrame:
    """What the critic would do: adds `action`, null where there is no repair."""
    action = F.when(F.col("issue") == "bounds", "resize").when(F.col("issue") == "dominant-empty-container", "removeElement").when(F.col("issue") == "font-size", "updateStyle")
    return issues.withColumn("action", action)
