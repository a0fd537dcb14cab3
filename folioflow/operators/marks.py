"""Charts and diagrams as the primitive elements they are drawn with.

All geometry is one array expression for each element, so an element needs no join and no shuffle; `flattened` explodes it.
Elements have (type, id, kind, x, y, w, h, data, layers, lanes, rows, columns) and the style columns of STYLE; those a table lacks
are null. Parts have the columns of PART.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed values of the chart and diagram rules.
PALETTE = ("#36C5F0", "#7CFFB2", "#FFB86C", "#FF6B9A")
CHARTS = ("stackedBar", "groupedBar", "horizontalBar", "kpiGroup", "sparkline")
LAYERED = ("layeredArchitecture", "capabilityStack", "compilerPipeline", "swimlane")
STYLE = {"palette": "array<string>", "color": "string", "show_values": "boolean", "show_legend": "boolean", "end_label": "boolean", "label_color": "string", "card_color": "string", "value_color": "string", "line_width": "double"}
INPUT = {"kind": "string", "data": "array<struct<label:string,value:double,series:map<string,double>>>", "layers": "array<struct<label:string,nodes:array<string>>>", "lanes": "array<struct<label:string,nodes:array<string>>>", "rows": "array<string>", "columns": "array<string>"} | STYLE
PART = {
    "type": "string", "shape": "string", "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "fill": "string", "border": "string", "color": "string",
    "align": "string", "bold": "boolean", "font_size": "double", "line_width": "double", "source_id": "string", "target_id": "string",
}
NAMED = f"struct<id:string,{','.join(f'{k}:{t}' for k, t in PART.items())}>"


def part(type_: str, x: Column, y: Column, w: Column, h: Column, **more: Column) -> Column:
    own = {"type": F.lit(type_), "x": x, "y": y, "w": w, "h": h} | more
    return F.struct(*[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in PART.items()])


def named(id_: Column, p: Column) -> Column:
    return F.struct(id_.alias("id"), *[p[k].alias(k) for k in PART]).cast(NAMED)


def none() -> Column:
    return F.array().cast(f"array<struct<{','.join(f'{k}:{t}' for k, t in PART.items())}>>")


def shown(v: Column) -> Column:
    """A number as text: whole ones without a point."""
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))


def with_inputs(elements: DataFrame) -> DataFrame:
    return elements.select("*", *[F.lit(None).cast(t).alias(c) for c, t in INPUT.items() if c not in elements.columns])


def _box() -> list[Column]:
    return [F.col(c) for c in "xywh"]


def _data() -> Column:
    own = F.transform("data", lambda d: F.struct(d["label"].cast("string").alias("label"), d["value"].cast("double").alias("value"), d["series"].cast("map<string,double>").alias("series")))
    return F.coalesce(own, F.array().cast(INPUT["data"]))


def _palette() -> Column:
    own = F.when(F.size("palette") > 0, F.col("palette")).when(F.coalesce("color", F.lit("")) != "", F.array("color"))
    return F.coalesce(own, F.array(*map(F.lit, PALETTE)))


def _tint(index: Column) -> Column:
    return F.element_at(_palette(), (index % F.size(_palette()) + 1).cast("int"))


def _value(point: Column) -> Column:
    return F.coalesce(F.nanvl(point["value"], F.lit(0.0)), F.lit(0.0))


def _of(point: Column, name: Column) -> Column:
    v = F.try_element_at(point["series"], name)
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def _label(point: Column) -> Column:
    return F.coalesce(point["label"], F.lit(""))


def stacked_bars() -> Column:
    """Bars of stacked segments with labels, then a legend. Series are in the order of their first appearance."""
    x, y, w, h = _box()
    n = F.greatest(F.size(_data()), F.lit(1)).cast("double")
    names = F.array_distinct(F.flatten(F.transform(_data(), lambda d: F.coalesce(F.map_keys(d["series"]), F.array().cast("array<string>")))))
    total = lambda d: F.aggregate(names, F.lit(0.0), lambda acc, s: acc + _of(d, s))
    most = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(_data(), total)), F.lit(1.0)))
    gap = F.least(F.lit(0.12), w / (n * 4))
    label_h = F.least(F.lit(0.32), h * 0.18)
    value_h = F.when(F.coalesce("show_values", F.lit(True)), F.least(F.lit(0.26), h * 0.14)).otherwise(0.0)
    chart_h = F.greatest(F.lit(0.2), h - label_h - value_h - 0.1)
    bar_w = F.greatest(F.lit(0.08), (w - gap * (n - 1)) / n)
    base = y + value_h + chart_h

    def bar(d: Column, k: Column) -> Column:
        left, positive = x + k * (bar_w + gap), total(d) >= 0

        def segment(acc: Column, s: Column) -> Column:
            tall = F.when(positive, F.greatest(F.lit(0.02), _of(d, s) / most * chart_h)).otherwise(0.02)
            tint = _tint(F.array_position(names, s) - 1)
            return F.struct((acc["y"] - tall).alias("y"), F.concat(acc["out"], F.array(part("shape", left, acc["y"] - tall, bar_w, tall, shape=F.lit("rect"), fill=tint, border=tint))).alias("out"))

        segments = F.aggregate(names, F.struct(base.alias("y"), none().alias("out")), segment, lambda acc: acc["out"])
        return F.concat(segments, F.array(part("text", left, base + 0.05, bar_w, label_h, text=_label(d), align=F.lit("center"), color=F.col("label_color"))))

    legend_y = y + h - F.least(F.lit(0.24), label_h)

    def entry(s: Column, k: Column) -> Column:
        box = part("shape", x + k, legend_y + 0.04, F.lit(0.12), F.lit(0.12), shape=F.lit("rect"), fill=_tint(k), border=_tint(k))
        return F.array(box, part("text", x + k + 0.16, legend_y, F.lit(0.8), F.lit(0.2), text=s, align=F.lit("left"), color=F.col("label_color")))

    legend = F.when(F.coalesce("show_legend", F.lit(True)), F.flatten(F.transform(names, entry))).otherwise(none())
    return F.concat(F.flatten(F.transform(_data(), bar)), legend)


def horizontal_bars() -> Column:
    x, y, w, h = _box()
    most = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(_data(), _value)), F.lit(1.0)))
    tall = F.greatest(F.lit(0.18), F.least(F.lit(0.4), h / F.greatest(F.size(_data()), F.lit(1))))
    label_w = F.least(F.lit(1.2), w * 0.22)
    left, room = x + label_w, F.greatest(F.lit(0.4), w - label_w)

    def bar(d: Column, k: Column) -> Column:
        wide, top = F.greatest(F.lit(0.05), _value(d) / most * room), y + k * (tall + 0.08)
        label = part("text", x, top, label_w - 0.08, tall, text=_label(d), align=F.lit("right"), color=F.col("label_color"))
        box = part("shape", left, top, wide, tall, shape=F.lit("rect"), fill=_tint(k), border=_tint(k))
        value = part("text", left + wide + 0.05, top, F.lit(0.6), tall, text=shown(_value(d)), align=F.lit("left"), color=F.col("label_color"))
        return F.when(F.coalesce("show_values", F.lit(True)), F.array(label, box, value)).otherwise(F.array(label, box))

    return F.flatten(F.transform(_data(), bar))


def kpi_cards() -> Column:
    x, y, w, h = _box()
    n = F.size(_data())
    wide = F.greatest(F.lit(0.8), (w - 0.2 * F.greatest(n - 1, F.lit(0))) / F.greatest(n, F.lit(1)))

    def card(d: Column, k: Column) -> Column:
        left, tint = x + k * (wide + 0.2), _tint(k)
        return F.array(
            part("shape", left, y, wide, h, shape=F.lit("roundRect"), fill=F.coalesce("card_color", F.lit("#FFFFFF")), border=tint),
            part("shape", left, y, F.lit(0.08), h, shape=F.lit("rect"), fill=tint, border=tint),
            part("text", left + 0.2, y + 0.1, wide - 0.3, h * 0.55, text=F.coalesce(shown(d["value"]), F.lit("")), align=F.lit("left"), font_size=F.greatest(F.lit(14.0), h * 12), bold=F.lit(True), color=F.coalesce("value_color", tint)),
            part("text", left + 0.2, y + h * 0.6, wide - 0.3, h * 0.3, text=_label(d), align=F.lit("left"), color=F.col("label_color")),
        )

    return F.flatten(F.transform(_data(), card))


def sparkline() -> Column:
    """Pieces between neighbours, scaled from the least value or 0 to the largest or 1; under two points there is nothing."""
    x, y, w, h = _box()
    values = F.transform(_data(), _value)
    low, high = F.least(F.array_min(values), F.lit(0.0)), F.greatest(F.array_max(values), F.lit(1.0))
    step, span, tint = w / (F.size(values) - 1), F.greatest(F.lit(1.0), high - low), F.element_at(_palette(), 1)
    place = lambda v: y + h - (v - low) / span * h
    pieces = F.transform(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda v, k: part("line", x + k * step, place(v), step, place(F.element_at(values, k + 2)) - place(v), color=tint, line_width=F.coalesce("line_width", F.lit(1.5))))
    last = part("text", x + w - 0.6, y, F.lit(0.6), F.lit(0.24), text=shown(F.try_element_at(values, F.lit(-1))), align=F.lit("right"), color=tint)
    return F.when(F.size(values) < 2, none()).when(F.coalesce("end_label", F.lit(True)), F.concat(pieces, F.array(last))).otherwise(pieces)


def chart_parts() -> Column:
    """Parts of the kinds that are expanded, numbered in one row; null for others, which are drawn as they are."""
    k = F.col("kind")
    found = F.when(k.isin("stackedBar", "groupedBar"), stacked_bars()).when(k == "horizontalBar", horizontal_bars()).when(k == "kpiGroup", kpi_cards()).when(k == "sparkline", sparkline())
    return F.transform(found, lambda p, n: named(F.concat(F.col("id"), F.lit("__"), p["type"], F.lit("-"), n), p))


def layered(layers: Column) -> Column:
    x, y, w, h = _box()
    n = F.size(layers)
    tall = (h - 0.16 * F.greatest(n - 1, F.lit(0))) / F.greatest(n, F.lit(1))
    own = lambda *suffix: F.concat(F.col("id"), F.lit("__"), *suffix)

    def layer(item: Column, k: Column) -> Column:
        top, nodes = y + k * (tall + 0.16), F.coalesce(item["nodes"], F.array().cast("array<string>"))
        many = F.size(nodes)
        wide = (w - 2.6 - 0.12 * F.greatest(many - 1, F.lit(0))) / F.greatest(many, F.lit(1))

        def node(text: Column, m: Column) -> Column:
            left = x + 2.3 + m * (wide + 0.12)
            box = part("shape", left, top + 0.18, wide, tall - 0.36, shape=F.lit("roundRect"), fill=F.lit("#FFFFFF"), border=F.lit("#A8B7D3"))
            label = part("text", left + 0.08, top + 0.28, wide - 0.16, tall - 0.56, text=F.coalesce(text, F.lit("")), color=F.lit("#172033"), font_size=F.lit(10.0), align=F.lit("center"))
            return F.array(named(own(F.lit("node-"), k, F.lit("-"), m), box), named(own(F.lit("node-label-"), k, F.lit("-"), m), label))

        head = F.array(
            named(own(F.lit("layer-"), k), part("shape", x, top, w, tall, shape=F.lit("roundRect"), fill=F.lit("#F3F7FF"), border=F.lit("#8FB3FF"))),
            named(own(F.lit("layer-label-"), k), part("text", x + 0.2, top + 0.1, F.lit(2.0), F.lit(0.32), text=F.coalesce(item["label"], F.lit("")), bold=F.lit(True), color=F.lit("#172033"))),
        )
        line = part("line", x + w / 2, top + tall, F.lit(0.0), F.lit(0.16), color=F.lit("#667085"), line_width=F.lit(1.0), source_id=own(F.lit("layer-"), k), target_id=own(F.lit("layer-"), k + 1))
        tail = F.when(k < n - 1, F.array(named(own(F.lit("connector-"), k), line))).otherwise(F.array().cast(f"array<{NAMED}>"))
        return F.concat(head, F.flatten(F.transform(nodes, node)), tail)

    return F.flatten(F.transform(layers, layer))


def matrix() -> Column:
    """Column labels, then for each row its label and cells."""
    x, y, w, h = _box()
    rows, cols = (F.coalesce(c, F.array().cast("array<string>")) for c in ("rows", "columns"))
    label_w, head_h = F.least(F.lit(1.5), w * 0.22), F.least(F.lit(0.45), h * 0.16)
    wide, tall = (w - label_w) / F.greatest(F.size(cols), F.lit(1)), (h - head_h) / F.greatest(F.size(rows), F.lit(1))
    own = lambda *suffix: F.concat(F.col("id"), F.lit("__"), *suffix)
    top = F.transform(cols, lambda c, k: named(own(F.lit("col-"), k), part("text", x + label_w + k * wide, y, wide, head_h, text=F.coalesce(c, F.lit("")), bold=F.lit(True), align=F.lit("center"))))

    def row(label: Column, r: Column) -> Column:
        at = y + head_h + r * tall
        cells = F.transform(cols, lambda _, k: named(own(F.lit("cell-"), r, F.lit("-"), k), part("shape", x + label_w + k * wide, at, wide, tall, shape=F.lit("roundRect"), fill=F.lit("#FFFFFF"), border=F.lit("#D0D7E2"))))
        return F.concat(F.array(named(own(F.lit("row-"), r), part("text", x, at, label_w, tall, text=F.coalesce(label, F.lit("")), bold=F.lit(True)))), cells)

    return F.concat(top, F.flatten(F.transform(rows, row)))


def diagram_parts() -> Column:
    """Layered kinds (swimlanes use their lanes, or layers) and matrices; other kinds raise."""
    empty = F.array().cast(INPUT["layers"])
    layers = F.when(F.col("kind") == "swimlane", F.coalesce("lanes", "layers", empty)).otherwise(F.coalesce("layers", empty))
    unknown = F.raise_error(F.concat(F.lit("unsupported diagram kind: "), F.coalesce("kind", F.lit("null")))).cast(f"array<{NAMED}>")
    return F.when(F.col("kind").isin(*LAYERED), layered(layers)).when(F.col("kind") == "matrixMap", matrix()).otherwise(unknown)


def expanded(elements: DataFrame, keep: list[str]) -> DataFrame:
    """Charts and diagrams only: (keep, parent id, part number, parts); charts drawn as they are have none."""
    e = with_inputs(elements).where(F.col("type").isin("chart", "diagram"))
    parts = F.when(F.col("type") == "chart", chart_parts()).otherwise(diagram_parts())
    return e.select(*keep, F.col("id").alias("parent"), F.posexplode(parts).alias("part", "p")).select(*keep, "parent", "part", "p.*")


def flattened(elements: DataFrame, keep: list[str]) -> DataFrame:
    """Every element, charts and diagrams replaced by their parts: (keep, ord, part, id and the columns of PART). `part` is 0
    for what stands as it is. elements have `ord` and the columns of PART, or those they lack are null."""
    e = with_inputs(elements)
    e = e.select("*", *[F.lit(None).cast(t).alias(c) for c, t in PART.items() if c not in e.columns])
    self_ = F.array(F.struct(F.col("id").cast("string").alias("id"), *[F.col(c).cast(t).alias(c) for c, t in PART.items()]).cast(NAMED))
    parts = F.when((F.col("type") == "chart") & F.col("kind").isin(*CHARTS), chart_parts()).when(F.col("type") == "diagram", diagram_parts()).otherwise(self_)
    return e.select(*keep, "ord", F.posexplode(parts).alias("part", "p")).select(*keep, "ord", "part", "p.*")


def chart_marks(charts: DataFrame) -> DataFrame:
    """The values that a chart shows: one row for each point and series (`value` where a point has no series)."""
    points = with_inputs(charts).select("id", "kind", F.posexplode("data").alias("ord", "d"))
    series = F.coalesce(F.col("d.series"), F.create_map(F.lit("value"), F.coalesce("d.value", F.lit(0.0))))
    return points.select("id", "kind", "ord", F.col("d.label").alias("label"), F.explode(series).alias("series", "value")).withColumn("value", C.number(F.col("value")))
