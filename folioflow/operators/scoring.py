"""Aggregations: counts, levels, scores, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Signal weights of the style-risk score.
SIGNAL_WEIGHTS = {"font_family_dedup": 20, "emoji_as_icon": 15, "css_gradient": 15, "all_caps_stroke_shadow": 10, "rhetoric_on_cjk": 10, "rounded_token_variance": 20, "icon_circle_triad": 15, "kpi_sandwich": 10, "vertical_rhythm_variance": 10}
#: Least editability by kind of input.
EDITABILITY_FLOOR = {"html": 4, "image": 3, "design-first": 4, "unknown": 4}


def count_if(c: Column, name: str) -> Column:
    return F.count_if(c).alias(name)


def check_summary(checks: DataFrame, key: str) -> DataFrame:
    """G01"""
    worst = F.min(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2))
    return checks.groupBy(key).agg(count_if(F.col("severity") == "critical", "n_critical"), count_if(F.col("severity") == "warning", "n_warning"), F.bool_or(F.col("severity") == "critical").alias("blocked"), F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), worst + 1).alias("worst"))


def quality_cells(checks: DataFrame, kinds: list[str]) -> DataFrame:
    """A row for each kind, found or not."""
    fixed = checks.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    found = checks.groupBy("kind").agg(F.count("*").alias("n"), F.min(C.severity_rank(F.when(F.col("severity") == "critical", "error").otherwise(F.col("severity")))).alias("r"))
    return F.broadcast(fixed).join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("r").isNull(), "none").when(F.col("r") == 0, "critical").when(F.col("r") == 1, "warning").otherwise("info").alias("worst"))


#: Fonts that most machines have, and shapes that every program draws alike.
PORTABLE_FONTS = ("Arial", "Calibri", "Aptos", "Microsoft YaHei", "SimSun", "Noto Sans SC")
PLAIN_SHAPES = ("rect", "roundRect", "ellipse")


def type_counters(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Lines count as shapes too, and cropped assets as images too. With columns `shape` and `src` also unusual shapes and
    remote images are counted."""
    names = {"text": ("text",), "shape": ("shape", "line"), "image": ("image", "cropped-asset"), "line": ("line",), "table": ("table",), "chart": ("chart",), "cropped_asset": ("cropped-asset",)}
    more = []
    if "shape" in elements.columns:
        more.append(count_if((F.col("type") == "shape") & ~F.coalesce(F.col("shape").isin(*PLAIN_SHAPES), F.lit(False)), "odd_shapes"))
    if "src" in elements.columns:
        more.append(count_if((F.col("type") == "image") & C.is_remote(F.col("src")), "remote_images"))
    return elements.groupBy(*keys).agg(F.count("*").alias("n_elements"), *[count_if(F.col("type").isin(*t), n) for n, t in names.items()], *more)


def levels(counters: DataFrame) -> DataFrame:
    args = [F.col(c) for c in ("text", "shape", "image", "table", "cropped_asset")]
    return counters.withColumn("level_render", C.level_render(*args).cast("long")).withColumn("level_report", C.level_report(*args).cast("long"))


def deck_editability(levelled: DataFrame, deck: str, fonts: DataFrame | None = None) -> DataFrame:
    """The least level, and a risk by the number of kinds of issue: fonts that aren't portable (fonts: (deck, font) of the
    design's typography), remote images, unusual shapes, raster objects."""
    total = lambda c: F.sum(c) if c in levelled.columns else F.lit(0)
    raster = F.sum(F.col("image") + F.col("cropped_asset"))
    out = levelled.groupBy(deck).agg(F.min("level_render").alias("level"), raster.alias("rasterized"), total("remote_images").alias("remote_images"), total("odd_shapes").alias("odd_shapes"))
    if fonts is not None:
        odd = fonts.where(~F.col("font").isin(*PORTABLE_FONTS)).groupBy(deck).agg(F.array_sort(F.collect_set("font")).alias("odd_fonts"))
        out = out.join(odd, deck, "left")
    else:
        out = out.withColumn("odd_fonts", F.lit(None).cast("array<string>"))
    out = out.withColumn("odd_fonts", F.coalesce("odd_fonts", F.array().cast("array<string>")))
    issues = sum(((F.col(c) > 0).cast("int") for c in ("remote_images", "odd_shapes", "rasterized")), (F.size("odd_fonts") > 0).cast("int"))
    return out.withColumn("n_issues", issues.cast("long")).withColumn("risk", F.when(F.col("n_issues") == 0, "low").when(F.col("n_issues") <= 2, "medium").otherwise("high"))


def slide_scores(issues: DataFrame, counters: DataFrame, key: str) -> DataFrame:
    """Issues (key, severity, kind)."""
    lost = issues.groupBy(key).agg(F.sum(F.when(F.col("severity") == "high", 18).otherwise(10)).alias("penalty"), F.bool_or(F.col("kind") == "bounds").alias("off"))
    total = F.col("n_elements")
    out = counters.join(lost, key, "left")
    return out.select(key, F.greatest(F.lit(0), 100 - F.coalesce("penalty", F.lit(0))).cast("long").alias("score"), F.when(F.col("text") > 0, 85).otherwise(45).cast("long").alias("hierarchy"), F.when(F.coalesce("off", F.lit(False)), 55).otherwise(88).cast("long").alias("alignment"), F.when(total > 14, 65).otherwise(85).cast("long").alias("density"), F.when(F.col("image") > 0, 78).otherwise(95).cast("long").alias("editability"))


def deck_scores(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.count("*").alias("n_slides"), C.half_up(F.avg("score")).cast("long").alias("deck_score"))


def adjustments(drift: Column, palette: Column, fallbacks: Column) -> Column:
    """G05"""
    return F.struct(
        F.when(drift > 1, C.clamp(C.half_up((drift - 1) * 3.5), 0, 30)).otherwise(0.0).alias("alignment"),
        F.when(palette < 0.85, C.clamp(C.half_up((F.lit(0.85) - palette) * 200), 0, 30)).otherwise(0.0).alias("design_system_fit"),
        F.when(fallbacks > 0, C.clamp(fallbacks * 8.0, 0, 30)).otherwise(0.0).alias("compatibility"),
    )


def risk_score(flags: DataFrame) -> DataFrame:
    """The sum of the weights of the set flags, 100 at most."""
    total = sum((F.when(F.col(s), w).otherwise(0) for s, w in SIGNAL_WEIGHTS.items() if s in flags.columns), F.lit(0))
    return flags.withColumn("risk", F.least(F.lit(100), total).cast("long"))


def style_flags(elements: DataFrame, keys: list[str], token_fonts: Column | None = None) -> DataFrame:
    """The nine signals of each group, in one grouping. Elements have (type, id, role, typography,
    font_size, y, text, shape) and, where they have them, font_family, fill, background, stroke, shadow, border_radius, radius and
    component. `token_fonts`: families of the design."""
    has = lambda c: F.col(c) if c in elements.columns else F.lit(None).cast("string")
    role = C.style_role(F.col("role"), F.col("typography"), F.col("id"), F.col("font_size"))
    height = C.half_up(F.coalesce("y", F.lit(0.0)) * 4) / 4
    e = elements.select(
        *keys, F.coalesce("y", F.lit(0.0)).alias("y"), height.alias("bucket"), C.families(has("font_family")).alias("families"), F.coalesce(C.has_emoji(has("text")), F.lit(False)).alias("emoji"),
        reduce(lambda x, c: x | F.coalesce(C.has_gradient(has(c)), F.lit(False)), ("fill", "background", "background_image"), F.lit(False)).alias("gradient"),
        C.shouts(has("text"), has("stroke"), has("shadow")).alias("shouts"), C.bolted_rhetoric(role, has("text")).alias("rhetoric"),
        F.when(F.col("type") == "shape", C.radius_token(has("border_radius"), has("radius"), has("component"), has("fill"))).alias("rounded"),
        ((F.col("type") == "shape") & F.coalesce(F.lower(has("shape")).isin("ellipse", "circle", "oval"), F.lit(False))).alias("circle"), (role == "metric").alias("metric"),
    )
    whole = e.groupBy(*keys).agg(
        F.array_distinct(F.flatten(F.collect_set("families"))).alias("fonts"), *[F.bool_or(c).alias(c) for c in ("emoji", "gradient", "shouts", "rhetoric")],
        F.count_distinct("rounded").alias("radii"), F.collect_list(F.when(F.col("circle"), F.col("bucket"))).alias("circles"), F.collect_list(F.when(F.col("metric"), F.col("bucket"))).alias("metrics"), F.array_sort(F.collect_list("y")).alias("ys"),
    )
    row = lambda c: F.exists(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda x: x == v)) >= 3)
    gaps = F.filter(F.transform(F.slice("ys", 1, F.size("ys") - 1), lambda v, n: C.half_up(F.element_at("ys", n + 2) - v, 3)), lambda g: g > 0)
    fonts = F.array_distinct(F.concat("fonts", token_fonts)) if token_fonts is not None else F.col("fonts")
    return whole.select(
        *keys, (F.size(fonts) > 3).alias("font_family_dedup"), F.col("emoji").alias("emoji_as_icon"), F.col("gradient").alias("css_gradient"), F.col("shouts").alias("all_caps_stroke_shadow"), F.col("rhetoric").alias("rhetoric_on_cjk"),
        (F.col("radii") == 1).alias("rounded_token_variance"), row(F.col("circles")).alias("icon_circle_triad"), row(F.col("metrics")).alias("kpi_sandwich"),
        F.when(F.size("ys") < 3, False).otherwise((F.size(gaps) >= 2) & (F.size(F.array_distinct(gaps)) == 1)).alias("vertical_rhythm_variance"),
    )


def y_buckets(elements: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Groups of elements at one height (quarter inches)."""
    return elements.withColumn("y_bucket", C.half_up(F.col("y") * 4) / 4).groupBy(*keys, "y_bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def single_radius(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with at most one radius."""
    return cards.groupBy(*keys).agg(F.countDistinct("radius").alias("n")).where("n <= 1")


def floor_violation(level: Column, kind: Column, own_floor: Column, source_caused: Column, allow_source: bool = True) -> Column:
    """The floor is the larger of the default and the deck's own (a positive number); below it, who caused it, and whether that
    satisfies: an image, or a source that says so, is an excuse if these are allowed."""
    own = F.when(F.coalesce(own_floor, F.lit(0)) > 0, own_floor).otherwise(0)
    least = F.greatest(C.mapped(kind, {k: str(v) for k, v in EDITABILITY_FLOOR.items()}, "4").cast("double"), own.cast("double"))
    source = F.coalesce(source_caused, F.lit(False)) | (kind == "image")
    excused = "with-justification" if allow_source else "false"
    return F.when(level < least, F.struct(least.alias("floor"), (least - level).alias("gap"), F.when(source, "source").otherwise("pipeline").alias("cause"), F.when(source, excused).otherwise("false").alias("satisfied")))


def palette_match(items: DataFrame, keys: list[str], threshold: float = 8.0) -> DataFrame:
    """G13 (mean confidence) and G14 (exact share): two measures, on purpose. items: matched, delta, exact."""
    sure = F.when(F.col("matched"), 1 - F.col("delta") / threshold).otherwise(0.0)
    return items.groupBy(*keys).agg(C.half_up(F.avg(sure), 4).alias("resolver_match"), C.half_up(F.avg(F.col("exact").isNotNull().cast("double")), 4).alias("exact_match"))


def mean_drift(rows: DataFrame, keys: list[str]) -> DataFrame:
    """0 where there is nothing to measure, else three digits."""
    return rows.groupBy(*keys).agg(C.half_up(F.coalesce(F.avg(F.hypot("dx", "dy")), F.lit(0.0)), 3).alias("drift"))


def batch_report(decks: DataFrame) -> DataFrame:
    """Decks (level, drift, palette, safety, risk, passed)."""
    named = [count_if(F.col("level") == k, f"level_{k}") for k in range(1, 6)]
    safety = [count_if(F.col("safety") == k, f"safety_{k}") for k in ("clean", "warning", "blocked")] + [count_if(F.col("safety").isNull(), "safety_unknown")]
    return decks.agg(F.count("*").alias("n_decks"), *named, *safety, C.half_up(F.avg("drift"), 4).alias("avg_drift"), C.half_up(F.avg("palette"), 4).alias("avg_palette"), C.half_up(F.avg("risk"), 4).alias("avg_risk"), count_if(F.col("passed"), "n_passed"), F.bool_and("passed").alias("all_passed"))


def dominant_bucket(rows: DataFrame, keys: list[str], value: str, ord_: str, width: float = 24) -> DataFrame:
    """The most frequent bucket, of equals the one seen first."""
    counted = rows.groupBy(*keys, F.floor(F.col(value) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min(ord_).alias("first"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("back"), "bucket")).alias("m"))
    return best.select(*keys, F.col("m.bucket").alias("bucket"), F.col("m.n").alias("n"))


def clearance(blocks: DataFrame, keys: list[str], least: float = 0.7, target: float = 0.9) -> DataFrame:
    """G20"""
    share = F.avg((F.col("confidence") >= least).cast("double"))
    return blocks.groupBy(*keys).agg(F.count("*").alias("n"), C.half_up(share, 4).alias("clearance"), (share >= target).alias("meets"))


def diff_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (channel, a, b)."""
    d = F.abs(F.col("a") - F.col("b"))
    out = pixels.groupBy(*keys).agg(F.avg(d).alias("mean"), F.min(d).alias("low"), F.max(d).alias("high"))
    return out.select(*keys, C.half_up(F.col("mean"), 4).alias("mean_diff"), C.half_up(F.col("low"), 4).alias("min_diff"), C.half_up(F.col("high"), 4).alias("max_diff"), C.diff_verdict(F.col("mean")).alias("verdict"))


def comparison_status(verdicts: DataFrame) -> DataFrame:
    """G24"""
    return verdicts.agg(F.when(F.bool_or(F.col("verdict") == "divergent"), "failed").when(F.bool_or(F.col("verdict") == "moderate"), "review").otherwise("passed").alias("status"))


def issue(severity: str, code: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))


def registry_issues(sources: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, severity, code) of a source registry."""
    found = F.array(
        F.when(F.coalesce("id", F.lit("")) == "", issue("error", "source-id-required")),
        F.when(F.coalesce("kind", F.lit("")) == "", issue("error", "source-kind-required")),
        F.when((F.coalesce("kind", F.lit("")) != "") & ~F.col("kind").isin(*kinds), issue("warning", "source-kind-unknown")),
        F.when((F.coalesce("url", F.lit("")) != "") & ~F.col("url").rlike("^https?://"), issue("error", "source-url-invalid")),
    )
    return sources.select("id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def asset_issues(assets: DataFrame) -> DataFrame:
    """(id, severity, code) of an asset registry."""
    status = F.coalesce("license_status", F.lit(""))
    e = lambda code: issue("error", code)
    found = F.array(
        F.when(F.coalesce("id", F.lit("")) == "", e("asset-id-required")),
        F.when(F.coalesce("local_path", F.lit("")) == "", e("asset-local-path-required")),
        F.when(~status.isin("allowed", "allowed-with-attribution", "user-provided", "public-domain", "unknown"), e("asset-license-status-invalid")),
        F.when((F.col("final_use") == "embedded") & (F.coalesce("url", F.lit("")) != "") & (status == "unknown"), e("asset-license-blocked")),
    )
    return assets.select("id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def registry_summary(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """G18"""
    return sources.agg(F.count("*").alias("n_sources"), F.count_if(F.col("final_use") == "embedded").alias("n_embedded")).crossJoin(issues.agg(F.count("*").alias("n_issues"), (F.count_if(F.col("severity") == "error") == 0).alias("valid")))


def accessibility(elements: DataFrame, slides: DataFrame, key: str) -> DataFrame:
    """(key, id, severity, kind)."""
    text = (F.col("type") == "text") & (F.coalesce(F.trim("text"), F.lit("")) != "")
    per = elements.groupBy(key).agg(F.bool_or(text).alias("readable"), F.bool_or(text & (F.coalesce(F.lower("id").rlike("title|heading|headline"), F.lit(False)) | (F.col("h") >= 0.45))).alias("titled"))
    whole = slides.select(key).join(per, key, "left")
    found = lambda kind, severity, wrong: F.when(wrong, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind")))
    of = lambda *each: F.inline(F.filter(F.array(*each), lambda x: x.isNotNull()))
    no = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    out = whole.select(key, F.lit(None).cast("string").alias("id"), of(found("no-text", "warning", ~F.coalesce("readable", F.lit(False))), found("no-title", "warning", ~F.coalesce("titled", F.lit(False)))))
    image = (F.col("type") == "image") & no("alt") & (F.coalesce("role", F.lit("")) != "decorative")
    small, chart = (F.col("type") == "text") & (F.col("font_size") < 10), (F.col("type") == "chart") & no("description")
    return out.unionByName(elements.select(key, "id", of(found("image-alt", "error", image), found("small-text", "warning", small), found("chart-description", "warning", chart))))


def accessibility_status(issues: DataFrame, key: str) -> DataFrame:
    return issues.groupBy(key).agg(F.count("*").alias("n_issues"), F.when(F.bool_or(F.col("severity") == "error"), "review").otherwise("warning").alias("status"))


def layout_modes(nodes: DataFrame, key: str, known: DataFrame | None = None, force: str | None = None) -> DataFrame:
    """By the numbers of marked nodes (data-pptx-kind or -type) and of containers (cards, card-grid, data-cards) among a slide's
    nodes. `known`: (archetype) names that resolve. nodes (key, attrs)."""
    a = F.col("attrs")
    marked = F.map_contains_key(a, "data-pptx-kind") | F.map_contains_key(a, "data-pptx-type")
    boxes = F.coalesce(a["class"].rlike(r"(^|\s)(cards|card-grid)(\s|$)"), F.lit(False)) | F.map_contains_key(a, "data-cards")
    n = nodes.groupBy(key).agg(F.count_if(marked).alias("markers"), F.count_if(boxes).alias("containers"), F.max(a["data-archetype"]).alias("archetype"))
    if known is not None:
        n = n.join(known.select("archetype", F.lit(True).alias("there")), "archetype", "left").withColumn("archetype", F.when(F.col("there"), F.col("archetype")))
    return n.select(key, "markers", "containers", "archetype", C.layout_mode(F.col("markers"), F.col("containers"), F.col("archetype"), force).alias("mode"))
