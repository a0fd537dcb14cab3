"""Structural rules of manifests, storyboards, directions and slide specifications (F09, F13), as ordered arrays of messages.

A table of nested rows gets `violations` (all that are broken, in the order in which a checker that stops at the first would meet
them) and `first_violation`. Nulls stand for what is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import marks

# Fixed values of the manifest's rules.
TYPES = ("text", "shape", "image", "table", "line", "chart", "icon", "diagram", "cropped-asset")
SHAPES, ICONS = ("rect", "roundRect", "ellipse"), ("check", "x", "info", "arrow-right")
CHART_KINDS, DIAGRAM_KINDS = ("bar", "line", "pie", *marks.CHARTS), (*marks.LAYERED, "matrixMap")
MODES = ("strict", "balanced", "creative", "inspired")
FIELDS = {
    "type": "string", "id": "string", "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "shape": "string", "src": "string", "asset_id": "string", "kind": "string", "name": "string", "rows": "array<string>", "columns": "array<string>",
    "crop": "struct<x:double,y:double,w:double,h:double>", "data": "array<struct<label:string,value:double,series:map<string,double>>>", "layers": "array<struct<label:string,nodes:array<string>>>", "lanes": "array<struct<label:string,nodes:array<string>>>",
}


def blank(v: Column) -> Column:
    return F.coalesce(F.trim(v), F.lit("")) == ""


def absent(v: Column) -> Column:
    return v.isNull() | (F.size(v) <= 0)


def message(broken: Column, *text: str | Column) -> Column:
    """Array of one message, or of none."""
    said = F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text])
    return F.when(F.coalesce(broken, F.lit(False)), F.array(said)).otherwise(F.array().cast("array<string>"))


def within(items: Column, rules) -> Column:
    """Messages of all items, in order; rules(item, index) gives an array."""
    return F.coalesce(F.flatten(F.transform(items, rules)), F.array().cast("array<string>"))


def when(test: Column, messages: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), messages).otherwise(F.array().cast("array<string>"))


def local_file(src: Column, what: str, there: Column | None) -> list[Column]:
    out = [message(blank(src), f"{what}src is required"), message(src.rlike("^https?://"), f"{what}remote src must be downloaded before validation: ", F.coalesce(src, F.lit("")))]
    return out if there is None else [*out, message(~blank(src) & ~src.rlike("^https?://") & ~there, f"{what}file missing: ", F.coalesce(src, F.lit("")))]


def element_rules(width: float, height: float, assets: Column | None, there) -> Column:
    """assets: map of asset ids to sources; there(src): whether a file exists, if that is known."""
    c, is_ = F.col, lambda *t: F.col("type").isin(*t)
    numeric = F.lit(True)
    for k in "xywh":
        numeric = numeric & c(k).isNotNull() & ~F.isnan(k)
    found = F.try_element_at(assets, c("asset_id")) if assets is not None else F.lit(None).cast("string")
    linked = is_("cropped-asset") & blank(c("src")) & ~blank(c("asset_id"))
    exists = (lambda v: there(v)) if there else (lambda v: None)

    def point(d: Column, k: Column) -> Column:
        at = ("chart.data[", k, "]")
        series = F.coalesce(F.flatten(F.transform(F.map_entries(d["series"]), lambda e: F.concat(message(blank(e["key"]), *at, ".series keys must be non-empty strings"), message(e["value"].isNull(), *at, ".series.", e["key"], " must be numeric")))), F.array().cast("array<string>"))
        return F.concat(message(F.coalesce(d["label"], F.lit("")) == "", *at, ".label is required"), message(d["series"].isNotNull() & (F.size(d["series"]) == 0), *at, ".series must be a non-empty object"), series, message(d["series"].isNull() & d["value"].isNull(), *at, ".value must be numeric"))

    def layer(item: Column, k: Column) -> Column:
        return F.concat(message(F.coalesce(item["label"], F.lit("")) == "", "diagram layer ", k, " label is required"), message(item["nodes"].isNull(), "diagram layer ", k, " nodes must be an array"))

    layers = F.coalesce("layers", "lanes")
    rules = [
        message(~is_(*TYPES) | c("type").isNull(), "unsupported element type"),
        message(F.coalesce("id", F.lit("")) == "", "element id is required"),
        *[message(c(k).isNull() | F.isnan(k), f"{k} must be numeric") for k in "xywh"],
        message(numeric & ((c("w") <= 0) | (c("h") <= 0)), "w and h must be positive"),
        message(numeric & (c("w") > 0) & (c("h") > 0) & C.Rect().outside_strict(width, height), "outside slide bounds"),
        message(is_("text") & c("text").isNull(), "text is required"),
        message(is_("shape") & (~c("shape").isin(*SHAPES) | c("shape").isNull()), "unsupported shape"),
        *[when(is_("image"), m) for m in local_file(c("src"), "", exists(c("src")))],
        *[when(is_("cropped-asset") & ~blank(c("src")), m) for m in local_file(c("src"), "", exists(c("src")))],
        message(is_("cropped-asset") & blank(c("src")) & blank(c("asset_id")), "cropped-asset requires src or assets.id"),
        message(linked & found.isNull(), "cropped-asset assets.id not found in manifest.assets"),
        *[when(linked & found.isNotNull(), m) for m in local_file(found, "", exists(found))],
        *[message(is_("cropped-asset") & c("crop").isNotNull() & c("crop")[k].isNull(), f"cropped-asset crop.{k} must be numeric") for k in "xywh"],
        message(is_("cropped-asset") & ((c("crop")["w"] <= 0) | (c("crop")["h"] <= 0)), "cropped-asset crop w and h must be positive"),
        message(is_("table") & c("rows").isNull(), "rows are required"),
        message(is_("chart") & (~c("kind").isin(*CHART_KINDS) | c("kind").isNull()), f"chart.kind must be one of {', '.join(sorted(CHART_KINDS))}"),
        message(is_("chart") & absent(c("data")), "chart.data is required"),
        when(is_("chart"), within(c("data"), point)),
        message(is_("icon") & (~c("name").isin(*ICONS) | c("name").isNull()), "unsupported icon name"),
        message(is_("diagram") & (~c("kind").isin(*DIAGRAM_KINDS) | c("kind").isNull()), f"diagram.kind must be one of {', '.join(sorted(DIAGRAM_KINDS))}"),
        message(is_("diagram") & c("kind").isin(*marks.LAYERED) & absent(layers), "diagram layers are required"),
        when(is_("diagram") & c("kind").isin(*marks.LAYERED), within(layers, layer)),
        message(is_("diagram") & (c("kind") == "matrixMap") & absent(c("rows")), "matrixMap rows are required"),
        message(is_("diagram") & (c("kind") == "matrixMap") & absent(c("columns")), "matrixMap columns are required"),
    ]
    return F.concat(*rules)


def judged(rows: DataFrame, violations: Column) -> DataFrame:
    return rows.withColumn("violations", violations).withColumn("first_violation", F.try_element_at("violations", F.lit(1)))


def element_issues(elements: DataFrame, width: float = C.SLIDE_W, height: float = C.SLIDE_H, assets: str | None = None, there=None) -> DataFrame:
    """every element with its violations. `assets`: a column, map of the deck's assets; repeated ids are W12's matter."""
    e = elements.select("*", *[F.lit(None).cast(t).alias(c) for c, t in FIELDS.items() if c not in elements.columns])
    return judged(e, element_rules(width, height, F.col(assets) if assets else None, there))


def colour_or_token(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^\{.*\}$") | v.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))


def deck_issues(decks: DataFrame) -> DataFrame:
    """F09 of a deck as readers.manifests gives it: its design system, size, assets and slides."""
    d, size = F.col("designSystem"), F.col("deck.size")
    ids = F.transform("slides", lambda s: s["id"])

    def slide(s: Column, k: Column) -> Column:
        b, own = s["background"], F.coalesce(s["id"], F.lit("null"))
        again = F.array_contains(F.slice(ids, 1, k), s["id"])
        return F.concat(
            message(~F.coalesce(F.startswith(s["id"], F.lit("slide-")), F.lit(False)), "slide.id must start with slide-"),
            message(again, "duplicate slide id: ", own),
            message(b.isNull(), own, ": background must be an object"),
            message(b.isNotNull() & ~F.coalesce(b["type"].isin("solid", "image"), F.lit(False)), own, ": unsupported background type"),
            message((b["type"] == "solid") & ~colour_or_token(b["color"]), own, ": solid background requires #RRGGBB color or token"),
            message((b["type"] == "image") & (blank(b["src"]) | b["src"].rlike("^https?://")), own, ": a local src is required"),
        )

    rules = [
        message(d.isNull(), "designSystem must be an object"),
        message(d.isNotNull() & ~F.coalesce(d["mode"].isin(*MODES), F.lit(False)), "designSystem.mode must be strict, balanced, creative, or inspired"),
        message(d.isNotNull() & (F.coalesce(d["source"], F.lit("")) == ""), "designSystem.source is required"),
        message(~F.coalesce(F.col("version") == "0.1.1", F.lit(False)), "version must be 0.1.1"),
        message(size.isNull(), "deck.size must be an object"),
        message(size.isNotNull() & ~F.coalesce(size["unit"] == "in", F.lit(False)), "deck.size.unit must be in"),
        *[message(size.isNotNull() & ~F.coalesce(size[k] > 0, F.lit(False)), f"deck.size.{k} must be positive") for k in ("width", "height")],
        within(F.col("assets"), lambda a, _: F.concat(message(F.coalesce(a["id"], F.lit("")) == "", "asset.id is required"), message(blank(a["src"]), "asset/", F.coalesce(a["id"], F.lit("")), ": src is required"))),
        message(absent(F.col("slides")), "slides must be a non-empty array"),
        within(F.col("slides"), slide),
    ]
    return judged(decks, F.concat(*rules))


def strings(root: Column, path: str | list, names: list[str]) -> list[Column]:
    at = [path] if isinstance(path, str) else path
    return [message(blank(root[n]), *at, f".{n} must be a non-empty string") for n in names]


def storyboard_issues(rows: DataFrame, col: str) -> DataFrame:
    """struct<title, audience, goal, language, slides array<struct<id, role, message, contentBlocks array>>>."""
    v = F.col(col)
    slide = lambda s, k: F.concat(*strings(s, ["storyboard.slides[", k, "]"], ["id", "role", "message"]), message(s["contentBlocks"].isNull(), "storyboard.slides[", k, "].contentBlocks must be an array"))
    inner = F.concat(*strings(v, "storyboard", ["title", "audience", "goal", "language"]), message(v["slides"].isNull(), "storyboard.slides must be an array"), message(F.size(v["slides"]) == 0, "storyboard.slides must not be empty"), within(v["slides"], slide))
    return judged(rows, F.when(v.isNull(), F.array(F.lit("storyboard must be an object"))).otherwise(inner))


def direction_issues(rows: DataFrame, col: str) -> DataFrame:
    """struct<style, tone array, palette struct, typography struct<title, body>, layoutStrategy, avoid array>."""
    v, at = F.col(col), "designDirection"
    object_ = lambda name, names: F.when(v[name].isNull(), F.array(F.lit(f"{at}.{name} must be an object"))).otherwise(F.concat(*strings(v[name], f"{at}.{name}", names)))
    inner = F.concat(*strings(v, at, ["style"]), message(v["tone"].isNull(), f"{at}.tone must be an array"), object_("palette", ["background", "surface", "primary", "accent", "text"]), object_("typography", ["title", "body"]), *strings(v, at, ["layoutStrategy"]), message(v["avoid"].isNull(), f"{at}.avoid must be an array"))
    return judged(rows, F.when(v.isNull(), F.array(F.lit(f"{at} must be an object"))).otherwise(inner))


def spec_issues(rows: DataFrame, col: str) -> DataFrame:
    """struct<slides array<struct<id, layoutType, intent, mainIdea, visualPlan struct<focalPoint, density, visualWeight map>,
    contentSlots array, editableTarget double>>>."""
    v, at = F.col(col), "slideDesignSpecs"

    def slide(s: Column, k: Column) -> Column:
        here, plan = [f"{at}.slides[", k, "]"], s["visualPlan"]
        of_plan = F.when(plan.isNull(), message(F.lit(True), *here, ".visualPlan must be an object")).otherwise(F.concat(*[message(blank(plan[n]), *here, f".visualPlan.{n} must be a non-empty string") for n in ("focalPoint", "density")], message(plan["visualWeight"].isNull(), *here, ".visualPlan.visualWeight must be an object")))
        return F.concat(*strings(s, here, ["id", "layoutType", "intent", "mainIdea"]), of_plan, message(s["contentSlots"].isNull(), *here, ".contentSlots must be an array"), message(s["editableTarget"].isNull() | F.isnan(s["editableTarget"]), *here, ".editableTarget must be a finite number"))

    inner = F.concat(message(v["slides"].isNull(), f"{at}.slides must be an array"), message(F.size(v["slides"]) == 0, f"{at}.slides must not be empty"), within(v["slides"], slide))
    return judged(rows, F.when(v.isNull(), F.array(F.lit(f"{at} must be an object"))).otherwise(inner))
