"""Rules over measured page nodes (what a browser reports of a page, as a table): F16, J03, W12.

`nodes` have the slide's key, `ord`, and the columns of NODE; those a table lacks are null. Places are relative to the slide. `path`
is the node's place in the tree, so an ancestor's path is a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .checks import near_pairs

# Fixed values of the page rules.
CANVAS, SLACK, REACH = (1280.0, 720.0), 2.0, 8.0
NODE = {
    "id": "string", "path": "string", "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "scroll_w": "double", "scroll_h": "double", "client_w": "double", "client_h": "double", "clipped": "boolean", "vector": "boolean",
    "image_ready": "boolean", "role": "string", "class": "string", "hidden": "boolean", "card": "boolean", "seen": "boolean", "connector": "boolean", "source_id": "string", "target_id": "string", "pptx_id": "string", "pptx_kind": "string",
    "start_x": "double", "start_y": "double", "end_x": "double", "end_y": "double", "marker_start": "string", "marker_end": "string",
}

CELL = 200.0  # pixels of a cell in which overlaps are looked for


def complete(nodes: DataFrame) -> DataFrame:
    return nodes.select("*", *[F.lit(None).cast(t).alias(c) for c, t in NODE.items() if c not in nodes.columns])


def yes(v: Column | str) -> Column:
    return F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(False))


def is_connector() -> Column:
    return yes("connector") | (F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def is_decoration() -> Column:
    return yes("hidden") | F.lower(F.concat_ws(" ", "role", "class")).rlike("decoration|background|ornament|accent-rule")


def canvas_issues(slides: DataFrame, key: str) -> DataFrame:
    """F16: slides (key, w, h) that are not drawn at the canvas' size."""
    off = (F.abs(F.col("w") - CANVAS[0]) > SLACK) | (F.abs(F.col("h") - CANVAS[1]) > SLACK)
    return slides.where(off).select(key, F.lit("slide-size-mismatch").alias("kind"))


def node_issues(nodes: DataFrame, slides: DataFrame, key: str) -> DataFrame:
    """F16: (key, ord, id, kind) of nodes without size, outside the slide, with too much text, or with images that didn't load."""
    n = complete(nodes).join(slides.select(key, F.col("w").alias("slide_w"), F.col("h").alias("slide_h")), key)
    c, r = F.col, C.Rect()
    flat = F.when(is_connector(), (r.w <= SLACK) & (r.h <= SLACK)).otherwise((r.w <= SLACK) | (r.h <= SLACK))
    off = (r.x < -SLACK) | (r.y < -SLACK) | (r.right > c("slide_w") + SLACK) | (r.bottom > c("slide_h") + SLACK)
    over = (F.coalesce(F.trim("text"), F.lit("")) != "") & ~yes("vector") & yes(C.box_overflow(c("scroll_w"), c("scroll_h"), c("client_w"), c("client_h"), SLACK))
    rest = F.array(F.when(off, "slide-bounds"), F.when(over & yes("clipped"), "content-clipped").when(over, "text-overflow"), F.when(~c("image_ready"), "asset-not-ready"))
    kinds = F.when(flat, F.array(F.lit("zero-size"))).otherwise(F.filter(rest, lambda x: x.isNotNull()))
    return n.select(key, "ord", "id", F.explode(kinds).alias("kind"))


def overlaps(nodes: DataFrame, key: str) -> DataFrame:
    """Pairs of nodes, neither within the other, over 4 square pixels and 1 %, that matter: two cards, or one has text, or both
    are seen where they overlap and it is over 5 %. Decoration and connectors are left out."""
    n = complete(nodes).where(~is_decoration() & ~is_connector()).withColumn("says", F.coalesce(F.trim("text"), F.lit("")) != "")
    a, b = C.Rect("a"), C.Rect("b")
    kin = F.startswith(F.col("b.path"), F.concat(F.col("a.path"), F.lit("/"))) | F.startswith(F.col("a.path"), F.concat(F.col("b.path"), F.lit("/")))
    share = a.overlap(b) / F.greatest(F.lit(1.0), F.least(a.w * a.h, b.w * b.h))
    both = lambda c: yes(F.col(f"a.{c}")) & yes(F.col(f"b.{c}"))
    matters = both("card") | F.col("a.says") | F.col("b.says") | (both("seen") & (share > 0.05))
    hit = near_pairs(n, [key], ["path", "card", "seen", "says"], cell=CELL).where(a.meets(b) & (a.overlap(b) > 4) & (share > 0.01) & ~yes(kin) & matters)
    return hit.select(key, F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), C.half_up(share, 4).alias("ratio"))


def connector_issues(nodes: DataFrame, key: str) -> DataFrame:
    """F16: (key, ord, id, kind). Ends are looked up by pptx id or id on all slides, the first in order wins; a connector without
    geometry, or that is no vector line, can't be checked further."""
    n = complete(nodes)
    names = F.array_distinct(F.filter(F.array("pptx_id", "id"), lambda x: F.coalesce(x, F.lit("")) != ""))
    place = n.select(F.explode(names).alias("name"), F.struct(key, "ord").alias("at"), F.struct(*"xywh").alias("box")).groupBy("name").agg(F.min_by("box", "at").alias("box"))
    lines = n.where(is_connector())
    for end in ("source", "target"):
        lines = lines.join(place.select(F.col("name").alias(f"{end}_id"), F.col("box").alias(end)), f"{end}_id", "left")
    c, t = F.col, C.Rect("target")
    plain = F.coalesce("pptx_id", F.lit("")).isin("") | ~yes(c("pptx_kind") == "line")
    drawn = yes("vector")
    known = c("source").isNotNull() & c("target").isNotNull() & c("start_x").isNotNull() & c("end_x").isNotNull()
    touches = C.Rect("source").touched_by(c("start_x"), c("start_y"), REACH) & t.touched_by(c("end_x"), c("end_y"), REACH)
    none = lambda v: F.coalesce(F.nullif(F.col(v), F.lit("")), F.lit("none")) == "none"
    dot = C.direction_dot(c("start_x"), c("start_y"), c("end_x"), c("end_y"), t.x + t.w / 2, t.y + t.h / 2)
    away = (~none("marker_start") & none("marker_end")) | (dot < -1)
    kinds = F.array(
        F.when(plain, "connector-unsupported"),
        F.when(~drawn, "connector-unsupported").when(~known, "connector-detached").when(~touches, "connector-detached"),
        F.when(drawn & known & none("marker_start") & none("marker_end"), "connector-marker-missing"),
        F.when(drawn & known & away, "connector-direction"),
    )
    return lines.select(key, "ord", "id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def duplicate_ids(nodes: DataFrame, key: str) -> DataFrame:
    """A row for each occurrence of an id (or pptx id) that comes twice or more on any slides."""
    names = F.array_distinct(F.filter(F.array("pptx_id", "id"), lambda x: F.coalesce(x, F.lit("")) != ""))
    each = complete(nodes).select(key, "ord", F.explode(names).alias("id"))
    twice = each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(twice, "id").select(key, "ord", "id", F.lit("duplicate-id").alias("kind"), "n")


def audit(nodes: DataFrame, slides: DataFrame, key: str) -> DataFrame:
    """All of it as one table (key, ord, id, kind); every finding is critical."""
    over = overlaps(nodes, key).select(key, F.col("a_ord").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit("overlap").alias("kind"))
    canvas = canvas_issues(slides, key).select(key, F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("id"), "kind")
    out = canvas.unionByName(node_issues(nodes, slides, key)).unionByName(over).unionByName(connector_issues(nodes, key))
    return out.unionByName(duplicate_ids(nodes, key).drop("n"))
