"""Column functions: geometry, colour, text fit, roles, levels. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the layout rules.
TOLERANCE_IN = 0.005
OVERLAP_SHARE = 0.05
SLIDE_W, SLIDE_H = 13.333, 7.5
FONT_SIZE_RULES = {"body": (10.0, 11.0), "caption": (8.0, 10.0), "card-title": (12.0, 14.0), "card-metric": (20.0, 28.0), "title": (16.0, 18.0), "heading": (16.0, 18.0), "metric": (24.0, 32.0)}
LINE_HEIGHT_RULES = {"body": (1.0, 1.35), "caption": (1.0, 1.35), "card-title": (1.0, 1.15), "card-metric": (0.9, 1.0), "title": (0.95, 1.1), "heading": (0.95, 1.1), "metric": (0.9, 1.0)}
CONTRAST_RULES = {"body": (3.0, 4.5), "caption": (3.0, 4.5), "title": (3.0, 3.0), "heading": (3.0, 3.0), "metric": (3.0, 3.0)}
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
CJK = "[\\x{3000}-\\x{303F}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F1FF}]"


def half_up(v: Column, digits: int = 0) -> Column:
    """Rounds .5 towards +infinity, as floor(x + 0.5) does; P06."""
    scale = float(10**digits)
    return F.floor(v * scale + 0.5).cast("double") / scale


def number(v: Column, fallback: float = 0.0) -> Column:
    """Non-numbers, NaN and infinities become the fallback."""
    d = v.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(fallback)).otherwise(d)


def to_inches(px: Column, viewport: Column, inches: Column) -> Column:
    return half_up(px / viewport * inches, 3)


def px_box_clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box cut to its image."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.least(x + w, width) - left, F.lit(0)).alias("w"), F.greatest(F.least(y + h, height) - top, F.lit(0)).alias("h"))


class Rect:
    """x, y, w, h columns of one side of a pair."""

    def __init__(self, side: str = ""):
        dot = f"{side}." if side else ""
        self.x, self.y, self.w, self.h = (F.col(f"{dot}{c}") for c in "xywh")
        self.right, self.bottom = self.x + self.w, self.y + self.h

    def overlap(self, o: Rect) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.right, o.right) - F.greatest(self.x, o.x)) * F.greatest(F.lit(0.0), F.least(self.bottom, o.bottom) - F.greatest(self.y, o.y))

    def share(self, o: Rect) -> Column:
        """Overlap over the smaller area; 0 where that is 0."""
        return F.coalesce(F.try_divide(self.overlap(o), F.least(self.w * self.h, o.w * o.h)), F.lit(0.0))

    def gap(self, o: Rect) -> Column:
        dx = F.greatest(F.lit(0.0), F.greatest(self.x, o.x) - F.least(self.right, o.right))
        dy = F.greatest(F.lit(0.0), F.greatest(self.y, o.y) - F.least(self.bottom, o.bottom))
        return F.hypot(dx, dy)

    def meets(self, o: Rect) -> Column:
        """They share more than an edge."""
        return (self.x < o.right) & (o.x < self.right) & (self.y < o.bottom) & (o.y < self.bottom)

    def contains(self, o: Rect, slack: float = 0.01) -> Column:
        return (o.x >= self.x - slack) & (o.y >= self.y - slack) & (o.right <= self.right + slack) & (o.bottom <= self.bottom + slack)

    def outside(self, width: float = SLIDE_W, height: float = SLIDE_H, slack: float = TOLERANCE_IN, line: Column | None = None) -> Column:
        """lines may have negative extents (`line`: whether it is one; unknown: any may)."""
        ends = [(F.least(a, b), F.greatest(a, b), a, b) for a, b in ((self.x, self.right), (self.y, self.bottom))]
        low, high = ([e[k] if line is None else F.when(line, e[k]).otherwise(e[k + 2]) for e in ends] for k in (0, 1))
        return (low[0] < -slack) | (low[1] < -slack) | (high[0] > width + slack) | (high[1] > height + slack)

    def outside_strict(self, width: float = SLIDE_W, height: float = SLIDE_H) -> Column:
        """no tolerance, extents must be positive."""
        return (self.x < 0) | (self.y < 0) | (self.w <= 0) | (self.h <= 0) | (self.right > width) | (self.bottom > height)

    def touched_by(self, px: Column, py: Column, slack: float = 0.08) -> Column:
        """The point lies on the boundary, give or take `slack`."""
        inside = (px >= self.x - slack) & (px <= self.right + slack) & (py >= self.y - slack) & (py <= self.bottom + slack)
        return inside & (F.least(F.abs(px - self.x), F.abs(px - self.right), F.abs(py - self.y), F.abs(py - self.bottom)) <= slack)

    def anchor_toward(self, o: Rect) -> Column:
        """Middle of the side that faces the other rectangle."""
        dx, dy = (o.x + o.w / 2) - (self.x + self.w / 2), (o.y + o.h / 2) - (self.y + self.h / 2)
        flat = F.abs(dx) > F.abs(dy)
        px = F.when(flat, F.when(dx >= 0, self.right).otherwise(self.x)).otherwise(self.x + self.w / 2)
        py = F.when(flat, self.y + self.h / 2).otherwise(F.when(dy >= 0, self.bottom).otherwise(self.y))
        return F.struct(px.alias("x"), py.alias("y"))

    def region(self, width: float, height: float = SLIDE_H) -> Column:
        """P21: 'row-column' of a 2 x 2 grid."""
        return F.concat(F.when(self.y < height / 2, "0").otherwise("1"), F.lit("-"), F.when(self.x < width / 2, "0").otherwise("1"))


def box_overflow(scroll_w: Column, scroll_h: Column, client_w: Column, client_h: Column, slack: float = 2.0) -> Column:
    return (scroll_w > client_w + slack) | (scroll_h > client_h + slack)


def direction_dot(sx: Column, sy: Column, ex: Column, ey: Column, tx: Column, ty: Column) -> Column:
    return (ex - sx) * (tx - ex) + (ey - sy) * (ty - ey)


def hex_colour(v: Column) -> Column:
    """P10: 'RRGGBB' in upper case, null if it is no colour."""
    return F.upper(F.nullif(F.regexp_extract(F.trim(v), "^#?([0-9a-fA-F]{6})$", 1), F.lit("")))


def channels(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, k, 2), 16, 10).cast("double") for k in (1, 3, 5)]


def _linear(c: Column, cut: float) -> Column:
    v = c / 255
    return F.when(v <= cut, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(hex_: Column) -> Column:
    r, g, b = (_linear(c, 0.03928) for c in channels(hex_))
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


def lab(hex_: Column) -> Column:
    """CIE L*a*b* (D65) as a struct."""
    r, g, b = (_linear(c, 0.04045) for c in channels(hex_))
    xyz = ((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047, r * 0.2126729 + g * 0.7151522 + b * 0.072175, (r * 0.0193339 + g * 0.119192 + b * 0.9503041) / 1.08883)
    x, y, z = (F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz)
    return F.struct((y * 116 - 16).alias("l"), ((x - y) * 500).alias("a"), ((y - z) * 200).alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"])))


def _role_by_name(v: Column, body: bool) -> Column:
    v = F.lower(v)
    out = F.when(v.rlike("metric|kpi|stat|big-number"), "metric").when(v.rlike("subtitle"), "body").when(v.rlike("title|hero|headline"), "title").when(v.rlike("heading"), "heading").when(v.rlike("caption|footnote|note"), "caption")
    return out.when(v.rlike("body"), "body") if body else out


def layout_role(role: Column, typography: Column, id_: Column, font_size: Column) -> Column:
    """Explicit role, typography token, id pattern, font size, else body."""
    token = F.nullif(F.regexp_extract(F.trim(typography), r"^\{([^}]+)\}$", 1), F.lit(""))
    by_size = F.when(font_size >= 32, "metric").when(font_size >= 18, "title").when(font_size > 0, "body")
    return F.coalesce(F.nullif(F.lower(F.trim(role)), F.lit("")), _role_by_name(token, True), _role_by_name(id_, False), by_size, F.lit("body"))


def _normal_role(v: Column) -> Column:
    v = F.lower(F.trim(v))
    return F.when(v.isin("metric", "kpi"), "metric").when(v.isin("title", "hero"), "title").when(v.isin("subtitle", "sub"), "subtitle").when(v.isin("heading", "h1", "h2", "h3"), "heading").when(v.isin("caption", "footnote"), "caption").otherwise("body")


def style_role(role: Column, typography: Column, id_: Column, font_size: Column) -> Column:
    """Another order and other thresholds than layout_role, on purpose."""
    token = F.regexp_extract(F.regexp_replace(typography, r"[{}\s]", ""), r"typography\.(.+)$", 1)
    v = F.lower(F.coalesce(id_, F.lit("")))
    by_id = F.when(v.rlike("(^|[-_])(metric|kpi|stat|big-?number)([-_]|$)"), "metric").when(v.rlike("(^|[-_])(title|hero|headline)([-_]|$)"), "title").when(v.rlike("(^|[-_])(subtitle|sub|eyebrow|kicker)([-_]|$)"), "subtitle").when(v.rlike("(^|[-_])(caption|footnote|note)([-_]|$)"), "caption").otherwise("body")
    by_size = F.when(font_size >= 24, "title").when(font_size >= 16, "heading").when(font_size <= 10, "caption")
    return F.when(F.trim(role) != "", _normal_role(role)).when(typography.isNotNull(), _normal_role(token)).otherwise(F.coalesce(by_size, by_id))


def is_decoration(role: Column, id_: Column) -> Column:
    """F06"""
    return F.coalesce(F.lower(role).isin("background", "backdrop", "canvas"), F.lit(False)) | F.coalesce(F.lower(id_).rlike("background|backdrop|canvas"), F.lit(False))


def text_overflows(text: Column, font_size: Column, w: Column, h: Column, bold: Column, italic: Column, line_height: Column) -> Column:
    """P14, F05. Lengths are code points."""
    weight = F.when(bold, 1.1).otherwise(1.0) * F.when(italic, 0.95).otherwise(1.0) * F.when(text.rlike(CJK), 1.7).otherwise(1.0)
    need = F.length(text) * font_size * 0.55 * weight / 72
    room = w * F.greatest(F.lit(1.0), F.try_divide(h, font_size / 72 * line_height))
    return (text != "") & (w > 0) & (h > 0) & (need > room)


def wrapped_height(text: Column, width: Column, font_size: Column, line_height: Column, bold: Column) -> Column:
    """P15"""
    factor = F.when(bold, 1.1).otherwise(1.0) * F.when(text.rlike("[\\x{3000}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]"), 1.7).otherwise(1.0)
    room = F.greatest(F.lit(0.25), width)
    # the factor goes with the sum: in the function it would be told from the whole text again for each line
    begin = F.struct(F.lit(0.0).alias("n"), factor.alias("f"))
    lines = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n", -1), begin, lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(1.0), F.ceil(F.length(p) * font_size * 0.55 * acc["f"] / 72 / room).cast("double"))).alias("n"), acc["f"].alias("f")), lambda acc: acc["n"])
    return F.greatest(font_size / 72 * line_height, lines * (font_size / 72) * line_height + 0.05)


def normal_space(v: Column) -> Column:
    """Single spaces, the most, are no match, so only what changes is written anew."""
    return F.trim(F.regexp_replace(v, f" {SPACE}+|[{SPACE}&&[^ ]]{SPACE}*", " "))


def without_bullet(v: Column) -> Column:
    """A bullet that begins the text, and the space after it, before space is normalised."""
    return normal_space(F.regexp_replace(v, "^[\u2022\u00b7-]" + SPACE + "*", ""))


def has_emoji(v: Column) -> Column:
    return v.rlike(EMOJI)


def all_caps(v: Column) -> Column:
    """Needs a letter A-Z."""
    return v.rlike("[A-Z]") & (v == F.upper(v))


def shouts(text: Column, stroke: Column, shadow: Column) -> Column:
    """All capitals with both a stroke and a shadow; "none" and "" are neither."""
    is_set = lambda v: F.coalesce((v != "none") & (v != ""), F.lit(False))
    return F.coalesce(all_caps(text), F.lit(False)) & is_set(stroke) & is_set(shadow)


#: English phrases that are often bolted onto Chinese titles.
RHETORIC = ("the future of", "unlock the power of", "elevate your", "in today's world", "in the age of", "next-generation", "next gen", "world-class", "best-in-class", "cutting-edge", "revolutionary", "transform your", "supercharge", "game-changing", "delight your", "innovative solutions", "synergy", "leverage", "paradigm shift", "disrupt")


def bolted_rhetoric(role: Column, text: Column) -> Column:
    """A title or subtitle with Chinese characters and one of the phrases."""
    return F.coalesce(role.isin("title", "subtitle") & text.rlike("[\\x{4E00}-\\x{9FFF}]") & text.rlike(rf"(?i)\b({'|'.join(RHETORIC)})\b"), F.lit(False))


#: The named radii.
RADII = ("none", "sm", "md", "lg", "xl", "full")


def radius_token(*styles: Column) -> Column:
    """The first named radius in some style values (border radius, radius, component, fill), else a border radius in figures."""
    named = [F.nullif(F.regexp_extract(v, rf"(rounded\.(?:{'|'.join(RADII)}))", 1), F.lit("")) for v in styles]
    figures = F.when(F.trim(styles[0]).rlike(r"^\d"), F.trim(styles[0]))
    return F.coalesce(*named, figures)


def has_gradient(v: Column) -> Column:
    return v.rlike(r"(?i)(linear|radial|conic)-gradient\s*\(")


def families(v: Column) -> Column:
    """Font families of a list, without quotes and generic names."""
    names = F.transform(F.split(v, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(names, lambda x: (x != "") & ~F.lower(x).isin("serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui"))


def inline_colours(html: Column) -> Column:
    """P20: first 16 distinct colours of style attributes, lower case."""
    styles = F.array_join(F.regexp_extract_all(html, F.lit("style\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1)), " ")
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(styles, F.lit("#[0-9a-fA-F]{3,8}"), F.lit(0)), F.lower)), 1, 16)


def level_render(text: Column, shape: Column, image: Column, table: Column, cropped: Column) -> Column:
    """P22"""
    raster, native = image + cropped, shape + table
    return F.when((raster > 0) & (text == 0), 1).when((raster == 0) & (text > 0), 5).when((text > 0) & (native > 0), 4).when(text > 0, 3).otherwise(2)


def level_report(text: Column, shape: Column, image: Column, table: Column, cropped: Column) -> Column:
    """Disagrees with level_render on text only, and on shapes with images but no text."""
    raster, native = image + cropped, shape + table
    return F.when((text > 0) & (native > 0) & (raster == 0), 5).when((text > 0) & (native > 0), 4).when((text > 0) & (raster > 0), 3).when(native > 0, 2).otherwise(1)


def tone(level: Column, drift: Column, palette: Column, slop: Column) -> Column:
    """A tone for each reading, pass, warn or fail; null readings warn."""
    of = lambda v, good, fair: F.when(v.isNull(), "warn").when(good, "pass").when(fair, "warn").otherwise("fail")
    return F.struct(
        of(level, level >= 4, level == 3).alias("level"),
        of(drift, drift <= 1, drift <= 3).alias("drift"),
        of(palette, palette >= 0.85, palette >= 0.7).alias("palette"),
        of(slop, slop < 40, slop < 75).alias("slop"),
    )


def kind_tone(n_critical: Column, n_warning: Column) -> Column:
    """Of the findings of one kind."""
    return F.when(n_critical > 0, "fail").when(n_warning > 0, "warn").otherwise("pass")


def safety_tone(status: Column) -> Column:
    return F.when(status == "passed", "pass").when(status == "violated-blocked", "fail").otherwise("warn")


def floor_tone(satisfied: Column) -> Column:
    """`satisfied`: true, with-justification or false, as text."""
    return F.when(satisfied.isNull() | (satisfied == "with-justification"), "warn").when(satisfied == "true", "pass").otherwise("fail")


def diff_verdict(mean: Column) -> Column:
    """P25"""
    return F.when(mean < 12, "close").when(mean < 40, "moderate").otherwise("divergent")


def suggest(palette: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule whose colours meet the palette."""
    out = F.lit(default)
    for name, colours in reversed(rules):
        out = F.when(F.arrays_overlap(palette, F.array(*map(F.lit, colours))), name).otherwise(out)
    return out


#: Design systems by the colours that tell of them, the first that meets the palette.
DESIGNS = (("business-neutral", ("#2563EB", "#1D4ED8", "#3B82F6")), ("dark-tech", ("#0F172A", "#111827", "#1E293B")))


def suggest_design(palette: Column) -> Column:
    """Of colours as #RRGGBB."""
    return suggest(F.transform(palette, F.upper), DESIGNS, "business-neutral")


#: Layout patterns by slide role, and component types by region role.
ROLE_LAYOUTS = {"cover": "hero", "architecture": "architecture-layered", "process": "process-flow", "metrics": "metrics-dashboard", "comparison": "comparison-matrix", "roadmap": "roadmap", "summary": "executive-summary"}
ROLE_COMPONENTS = {"headline": "textBlock", "metric": "metric", "diagram": "semanticDiagram", "chart": "nativeChart"}


def layout_pattern(slide_role: Column, role: Column) -> Column:
    """Of the slide role, else the role, else summary."""
    own = F.coalesce(F.nullif(slide_role, F.lit("")), F.nullif(role, F.lit("")), F.lit("summary"))
    return mapped(own, ROLE_LAYOUTS, "executive-summary")


def component_type(region_role: Column) -> Column:
    """P29"""
    return mapped(region_role, ROLE_COMPONENTS, "card")


def layout_mode(markers: Column, containers: Column, archetype: Column, force: str | None = None) -> Column:
    """Measured, auto-layout or hybrid. A known archetype decides for measured where there are markers."""
    if force:
        return F.lit(force)
    both = (markers > 0) & (containers > 0)
    return F.when(archetype.isNotNull() & (markers > 0), "measured").when(both, "hybrid").when(markers > 0, "measured").otherwise("auto-layout")


def ocr_kind(confidence: Column, least: float = 0.7) -> Column:
    """P27"""
    return F.when(confidence >= least, "editable").otherwise("cropped")


def ocr_confidence(raw: Column) -> Column:
    """0-100 to 0-1."""
    return half_up(raw.try_cast("double") / 100, 4)


def mapped(v: Column, pairs: Mapping[str, str], default: str) -> Column:
    """P29, P30"""
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), v), F.lit(default))


def numbered(prefix: str, n: Column) -> Column:
    """P33"""
    return F.format_string(f"{prefix}-%03d", n)


def severity_rank(v: Column) -> Column:
    """T03"""
    return F.when(v == "error", 0).when(v == "warning", 1).when(v == "info", 2).otherwise(3)


def is_remote(src: Column) -> Column:
    """F14"""
    return F.lower(src).rlike("^https?://")


def is_wide(width: Column, height: Column, least: float = 1.6) -> Column:
    """P32"""
    return F.coalesce(F.try_divide(width, height) >= least, F.lit(False))


def key_sorted(v: Column, kind: T.DataType) -> Column:
    """Fields of structs and keys of maps in order, at every depth; arrays keep theirs."""
    if isinstance(kind, T.StructType):
        return F.when(v.isNotNull(), F.struct(*[key_sorted(v[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(v, lambda x: key_sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        entries = F.array_sort(F.map_entries(v), order)
        return F.map_from_arrays(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: key_sorted(e["value"], kind.valueType)))
    return v


def sorted_json(v: Column, kind: T.DataType) -> Column:
    """A struct, map or array as JSON with all keys in order."""
    return F.to_json(key_sorted(v, kind))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))
