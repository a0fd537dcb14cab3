"""Layout rules case by case."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import columns as C
from folioflow.operators import checks, marks, matching, ordered, pages, preflight, scoring, structure, validation

FIELDS = "s int, ord int, id string, type string, role string, x double, y double, w double, h double, text string, font_size double, component string, source_id string, target_id string"


def rows(spark, *elements):
    base = {"s": 1, "type": "shape", "w": 1.0, "h": 1.0, "x": 0.0, "y": 0.0}
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple((base | {"ord": n, "id": f"e{n}"} | e).get(k) for k in names) for n, e in enumerate(elements)], FIELDS)


def pairs(df):
    return {(r.a_ord, r.b_ord) for r in df.collect()}


def box(x, y, w, h, **more):
    return {"x": float(x), "y": float(y), "w": float(w), "h": float(h)} | more


def test_overlaps(spark):
    e = rows(
        spark, box(1, 1, 4, 3, id="card-a"), box(1.5, 1.5, 1, 1, type="text", text="in"), box(1, 1, 4, 3, id="plain"), box(1.5, 1.5, 1, 1, type="text"), box(0, 0, 13, 7, id="my-Backdrop"), box(0, 0, 13, 7, role="canvas"),
        box(1, 1, 3, 3, type="line"), box(8, 1, 1, 1), box(8.96, 1, 1, 1), box(9, 3, 1, 1), box(10, 3, 1, 1), box(0, 5, 13.3, 2, component="{components.panel}"), box(12, 5.5, 1, 1, type="text"),
    )
    # the card holds what lies within it; a plain shape that holds a text overlaps it; 4 % of overlap and a common edge are none
    assert pairs(checks.overlap_pairs(e, ["s"])) == {(1, 2), (1, 3), (2, 3)}
    many = [box((n * 37) % 12, (n * 17) % 7, 0.3 + n % 3, 0.3 + n % 2, s=n % 2) for n in range(120)] + [box(-100, -100, 300, 300, s=0)]
    df = rows(spark, *many)
    plain = {(i, j) for i in range(len(many)) for j in range(i + 1, len(many)) if many[i].get("s") == many[j].get("s") and (lambda a, b: max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])) > 0.05 * min(a["w"] * a["h"], b["w"] * b["h"]))(many[i], many[j])}
    assert pairs(checks.overlap_pairs(df, ["s"])) == plain and len(plain) > 200


def test_card_spacing(spark):
    e = rows(spark, box(0, 0, 1, 1, id="card-1"), box(1.2, 0, 1, 1, component="Card"), box(2.3, 0, 1, 1, id="box"), box(0.5, 0, 1, 1, id="x-card", type="text"), box(0, 1, 1, 1, id="card-2"))
    assert pairs(checks.spacing_pairs(e, ["s"])) == {(0, 1), (0, 4), (1, 4)}
    assert pairs(checks.spacing_pairs(e, ["s"], 13.0)) == {(0, 4)}  # points: 0.18 inch
    many = [box((n * 37) % 120 / 8, (n * 17) % 70 / 8, 0.3 + n % 3, (0.3 + n % 2) * (-1 if n == 7 else 1), s=n % 2, id=f"card-{n}") for n in range(150)] + [box(-100, -100, 90, 99.9, s=0, id="card-wide"), {"s": 0, "x": None, "id": "card-none"}]
    last = lambda b, c, d: b[c] + b[d]

    def near(a, b):
        if a["s"] != b["s"] or None in (a["x"], b["x"]):
            return False
        apart = [max(a[c], b[c]) - min(last(a, c, d), last(b, c, d)) for c, d in ("xw", "yh")]
        meets = all(a[c] < last(b, c, d) and b[c] < last(a, c, d) for c, d in ("xw", "yh"))
        return not meets and math.hypot(*(max(0.0, v) for v in apart)) < 0.5

    plain = {(i, j) for i in range(len(many)) for j in range(i + 1, len(many)) if near(many[i], many[j])}
    assert pairs(checks.spacing_pairs(rows(spark, *many), ["s"])) == plain and len(plain) > 150


def test_connectors(spark):
    a, b = box(0, 0, 2, 2, id="a"), box(5, 0, 2, 2, id="b")
    line = lambda x, y, w, h, **m: box(x, y, w, h, type="line", **m)
    e = rows(
        spark, box(9, 9, 1, 1, id="a"), a, b, box(0, 4, 2, 2, id="c"), line(2, 1, 3, 0, source_id="a", target_id="b", id="ok"), line(3, 1, 1, 0, source_id="a", target_id="b", id="loose"), line(2, 1, 3, 0, source_id="a", target_id="zz", id="no"),
        line(0, 0, 1, 0, id="my-Arrow"), line(0, 0, 1, 0, id="rule"), line(0, 0, 0, 0, source_id="a", target_id="c", id="down"), line(1, 1, 1, 1, source_id="yy", target_id="b", id="none"),
    )
    got = {r.id: r for r in checks.connectors(e, ["s"]).collect()}
    assert {k: (r.status, r.severity, r.related) for k, r in got.items()} == {
        "ok": ("attached", None, None), "loose": ("detached", "critical", "b"), "no": ("missing-target", "critical", "zz"), "my-Arrow": ("unverified", "warning", None), "rule": ("plain", None, None), "down": ("detached", "critical", "c"), "none": ("missing-source", "critical", "yy"),
    }
    assert tuple(got["loose"].suggestion) == (2.0, 1.0, 3.0, 0.0) and tuple(got["down"].suggestion) == (1.0, 2.0, 0.0, 2.0)


def test_diagonal_neighbours_anchor_vertically(spark):
    e = rows(spark, box(0, 0, 1, 1, id="a"), box(3, 3, 1, 1, id="b"), box(0, 0, 9, 9, type="line", source_id="a", target_id="b", id="l"))
    assert tuple(checks.connectors(e, ["s"]).first().suggestion) == (0.5, 1.0, 3.0, 2.0)


def test_bounds_of_lines(spark):
    e = rows(spark, box(2, 2, -1, 0, type="line"), box(0.5, 0, -1, 0, type="line"), box(1, 1, -1, 1), box(-0.004, 0, 1, 1), box(-0.006, 0, 1, 1))
    line = F.col("type") == "line"
    assert [r.o for r in e.orderBy("ord").select(C.Rect().outside(line=line).alias("o")).collect()] == [False, True, False, False, True]


def test_preflight_modes(spark):
    e = rows(
        spark, box(13, 0, 1, 1, id="off", type="text", text="a", font_size=8.0), box(0, 0, 0.2, 0.2, id="full", type="text", text="a long text that has no room", font_size=20.0), box(0, 0, 0.2, 0.2, id="twin", type="text", text="b"),
        box(3, 3, 1, 1, id="card-1"), box(4.1, 3, 1, 1, id="card-2"), box(5, 5, 1, 0, id="arrow-1", type="line"), box(7, 3, 2, 1, id="small-caption", type="text", text="c", font_size=9.0),
    )
    got = {(r.element_id, r.related_element_id, r.kind, r.severity) for r in preflight.preflight(e, ["s"]).collect()}
    assert got == {
        ("off", None, "bounds", "critical"), ("off", None, "font-too-small", "critical"), ("full", None, "text-overflow", "critical"), ("full", "twin", "overlap", "critical"),
        ("card-1", "card-2", "card-spacing-tight", "warning"), ("arrow-1", None, "connector-detached", "warning"), ("small-caption", None, "font-too-small", "warning"),
    }
    assert {(r.element_id, r.kind, r.severity) for r in preflight.preflight(e, ["s"], "replica").collect()} == {("off", "bounds", "critical"), ("full", "text-overflow", "warning")}
    with pytest.raises(ValueError):
        preflight.preflight(e, ["s"], "other")


def test_preflight_styles(spark):
    e = rows(spark, box(0, 0, 3, 1, type="text", text="t", id="body-1", font_size=12.0), box(0, 2, 3, 1, type="text", text="标", id="body-2", font_size=12.0), box(0, 4, 3, 1, type="text", text="t", id="title", font_size=20.0))
    e = e.withColumns({"line_height": F.when(F.col("ord") == 0, 0.9).otherwise(1.2), "letter_spacing": F.lit(-0.015), "color": F.when(F.col("ord") == 0, "#777777").otherwise("#000"), "background": F.lit("FFFFFF")})
    got = {(r.element_id, r.kind, r.severity) for r in preflight.preflight(e, ["s"]).collect()}
    assert got == {("body-1", "line-height-too-tight", "critical"), ("body-2", "line-height-too-tight", "warning"), ("body-1", "contrast-fail", "warning"), ("body-1", "letter-spacing-too-tight", "warning")}


def chart(spark, kind, data, **style):
    cols = {"palette": "array<string>", "show_values": "boolean", "show_legend": "boolean", "end_label": "boolean", "label_color": "string", "card_color": "string", "value_color": "string", "line_width": "double"}
    row = (1, 0, "c", "chart", kind, 1.0, 1.0, 4.0, 2.0, data, *[style.get(k) for k in cols])
    return spark.createDataFrame([row], f"s int, ord int, id string, type string, kind string, x double, y double, w double, h double, data array<struct<label:string,value:double,series:map<string,double>>>, {', '.join(f'{k} {t}' for k, t in cols.items())}")


def parts(df):
    return marks.flattened(df, ["s"]).orderBy("part").collect()


def test_charts(spark):
    p = parts(chart(spark, "kpiGroup", [("A", 12.0, None), (None, 1.5, None), ("C", None, None)], value_color="#123456"))
    assert [(x.id, x.type) for x in p[:4]] == [("c__shape-0", "shape"), ("c__shape-1", "shape"), ("c__text-2", "text"), ("c__text-3", "text")] and len(p) == 12
    assert [x.text for x in p if x.type == "text"] == ["12", "A", "1.5", "", "", "C"] and p[2].bold and p[2].font_size == 24 and p[2].color == "#123456" and p[1].fill == "#36C5F0" and p[5].fill == "#7CFFB2"
    p = parts(chart(spark, "sparkline", [("a", 1.0, None), ("b", 3.0, None), ("c", -1.0, None)]))
    assert [x.type for x in p] == ["line", "line", "text"] and p[2].text == "-1" and (p[0].x, p[0].y, p[0].w, p[0].h) == (1, 2, 2, -1) and p[1].h == 2 and p[0].line_width == 1.5
    assert parts(chart(spark, "sparkline", [("a", 1.0, None)])) == []
    p = parts(chart(spark, "horizontalBar", [("a", 2.0, None), ("b", float("nan"), None)], show_values=False))
    assert [x.type for x in p] == ["text", "shape"] * 2 and p[1].w == pytest.approx(4 - 0.88) and p[3].w == 0.05
    p = parts(chart(spark, "groupedBar", [("a", None, {"u": 1.0}), ("b", None, {"v": 3.0, "u": 1.0})], show_legend=False, palette=["#1", "#2"]))
    assert [x.fill for x in p] == ["#1", "#2", None] * 2 and p[0].shape == "rect" and p[1].h == 0.02 and p[4].y + p[4].h == pytest.approx(p[3].y)
    assert [x.id for x in parts(chart(spark, "pie", [("a", 1.0, None)]))] == ["c"] == [x.id for x in parts(chart(spark, None, None))]


def diagram(spark, kind, layers=None, lanes=None, rows_=None, columns=None):
    cols = "s int, ord int, id string, type string, kind string, x double, y double, w double, h double, layers array<struct<label:string,nodes:array<string>>>, lanes array<struct<label:string,nodes:array<string>>>, rows array<string>, columns array<string>"
    return spark.createDataFrame([(1, 0, "d", "diagram", kind, 0.0, 0.0, 10.0, 4.0, layers, lanes, rows_, columns)], cols)


def test_diagrams(spark):
    p = parts(diagram(spark, "layeredArchitecture", [("L", ["a", None]), ("M", None)]))
    assert [x.id for x in p] == ["d__layer-0", "d__layer-label-0", "d__node-0-0", "d__node-label-0-0", "d__node-0-1", "d__node-label-0-1", "d__connector-0", "d__layer-1", "d__layer-label-1"]
    line = p[6]
    assert (line.source_id, line.target_id, line.x, line.y, line.h) == ("d__layer-0", "d__layer-1", 5.0, 1.92, 0.16) and p[5].text == ""
    assert checks.connectors(spark.createDataFrame(p), ["s"]).first().status == "attached"
    assert [x.text for x in parts(diagram(spark, "swimlane", [("no", [])], [("lane", ["n"])])) if x.type == "text"] == ["lane", "n"]
    assert [x.text for x in parts(diagram(spark, "swimlane", [("L", [])])) if x.type == "text"] == ["L"] and parts(diagram(spark, "capabilityStack")) == []
    p = parts(diagram(spark, "matrixMap", rows_=["r"], columns=["a", "b"]))
    assert [x.id for x in p] == ["d__col-0", "d__col-1", "d__row-0", "d__cell-0-0", "d__cell-0-1"] and (p[4].x, p[4].y) == (5.75, 0.45)
    for kind in ("layered", "architecture", None):
        with pytest.raises(Exception, match="unsupported diagram kind"):
            parts(diagram(spark, kind))


def test_patches(spark):
    cols = "slide string, element_id string, kind string, suggestion struct<x:double,y:double,w:double,h:double>, padding string, style map<string,string>"
    s = lambda **v: tuple(v.get(k) for k in "xywh")
    data = [
        ("s", "a", "bounds", s(x=1.0, w=2.0), None, None), ("s", "b", "bounds", None, None, None), ("s", "c", "connector-detached", s(y=3.0), None, None), ("s", "d", "font-too-small", None, None, {"color": "#1"}), ("s", "e", "card-spacing-tight", None, "spacing.lg", None),
        ("s", "f", "card-spacing-tight", None, "0.75in", None), ("s", "g", "text-overflow", None, None, None), ("s", "h", "line-height-too-tight", None, None, {"lineHeight": "1.5", "w": "1"}), ("s", "i", "overlap", s(x=1.0), None, None), ("s", None, "contrast-fail", None, None, None), ("s", "j", "contrast-fail", None, None, None),
    ]
    got = [(r.element_id, r.operation, {k: v for k, v in r.changes.asDict().items() if v is not None}) for r in matching.patches_for(spark.createDataFrame(data, cols)).collect()]
    kind = lambda k: {"suggestion_kind": k}
    assert got == [
        ("a", "move", {"x": 1.0}), ("a", "resize", {"w": 2.0}), ("c", "move", {"y": 3.0}), ("d", "updateStyle", {"style": {"fontSize": "12"}} | kind("font-too-small")), ("e", "increaseSpacing", {"padding": "spacing.lg", "inches": 1.0} | kind("card-spacing-tight")),
        ("f", "increaseSpacing", {"padding": "0.75in", "inches": 0.75} | kind("card-spacing-tight")), ("g", "reduceDensity", kind("text-overflow")), ("h", "adjustStyle", {"style": {"lineHeight": "1.5", "w": "1"}} | kind("line-height-too-tight")), ("j", "adjustStyle", {"style": {"color": "#000000"}} | kind("contrast-fail")),
    ]


def test_patches_are_applied_in_order(spark):
    e = spark.createDataFrame([("s", "a", 1.0, 1.0, 1.0, 1.0, "old", {"padding": "0.6"}), ("s", "b", 1.0, 1.0, 1.0, 1.0, None, None), ("s", "c", 5.0, 5.0, 5.0, 5.0, "c", None)], "slide string, id string, x double, y double, w double, h double, text string, style map<string,string>")
    p = [
        ("s", "a", 1, "move", (2.0, None, 9.0, None, None, None)), ("s", "a", 2, "move", (None, 3.0, None, None, None, None)), ("s", "a", 3, "resize", (9.0, None, 4.0, None, None, None)), ("s", "a", 4, "updateText", (None, None, None, None, "new", None)),
        ("s", "a", 5, "increaseSpacing", (None, None, None, None, None, "spacing.md")), ("s", "a", 6, "reduceDensity", (None,) * 6), ("s", "b", 1, "removeElement", (None,) * 6), ("s", "b", 2, "move", (2.0,) + (None,) * 5), ("s", "zz", 1, "move", (2.0,) + (None,) * 5), ("s", "c", 1, "paint", (None,) * 6), ("s", "c", 2, "updateText", (None,) * 6), ("s", "c", 3, "increaseSpacing", (None, None, None, None, None, "2in")),
    ]
    patches = spark.createDataFrame(p, "slide string, id string, patch_ord int, operation string, changes struct<x:double,y:double,w:double,h:double,text:string,padding:string>")
    new, errors = matching.apply_patches(e, patches, ["slide", "id"])
    got = {r.id: r for r in new.collect()}
    assert set(got) == {"a", "c"} and (got["a"].x, got["a"].y, got["a"].w, got["a"].h, got["a"].text, got["a"].style) == (2.0, 3.0, 4.0, 1.0, "new", {"padding": "0.6"})
    assert (got["c"].x, got["c"].text, got["c"].style) == (5.0, "c", {"padding": "2.0"}) and new.columns == e.columns
    assert {(r.id, r.patch_ord, r.error) for r in errors.collect()} == {("b", 2, "removed before"), ("zz", 1, "missing element"), ("c", 1, "unsupported operation"), ("c", 2, "updateText requires a text")}


def test_repair_loop_and_gates(spark):
    e = spark.createDataFrame([(n, float(n * 4)) for n in range(6)], "id int, x double")

    def audit(df):
        return df.select("id", F.when(F.col("x") > 10, "critical").otherwise("ok").alias("severity"), (F.col("x") > 10).alias("repairable"))

    def repair(df, found):
        bad = found.where("severity = 'critical'").select("id", F.lit(True).alias("bad"))
        return df.join(bad, "id", "left").select("id", F.when(F.col("bad"), F.col("x") - 5).otherwise(F.col("x")).alias("x"))

    out, passes, left = validation.repair_loop(e, audit, repair)
    assert (passes, left) == (2, 0) and out.where("x > 10").count() == 0
    assert validation.repair_loop(e, audit, repair, 1)[1:] == (1, 2)
    assert validation.repair_loop(e, lambda d: audit(d).withColumn("repairable", F.lit(False)), repair)[1:] == (0, 3)
    with pytest.raises(ValueError):
        validation.gate(audit(e))
    assert validation.gate(audit(e), strict=False) == {"critical": 3, "blocked": True} and validation.gate(audit(e.where("x < 9")))["blocked"] is False
    assert validation.coverage_gate(e.where("false"), 4) == 1.0 and validation.coverage_gate(e.where("false"), 0) == 1.0
    with pytest.raises(ValueError, match="0.3333"):
        validation.coverage_gate(e.limit(2), 3)


def test_style_signals(spark):
    cols = "s int, id string, type string, role string, typography string, font_size double, y double, text string, shape string, fill string, stroke string, shadow string, border_radius string, font_family string"
    e = [
        (1, "a", "text", "title", None, None, 1.0, "标题 Synergy", None, None, None, None, None, "'A', serif"), (1, "b", "text", None, None, 12.0, 2.0, "☀ sun", None, None, None, None, None, "B, C"), (1, "c", "text", None, None, 12.0, 3.0, "LOUD", None, "x", "1px", "soft", None, "D"),
        (2, "a", "shape", None, None, None, 1.0, None, "circle", "radial-gradient (", None, None, "{rounded.md}", None), (2, "b", "shape", None, None, None, 1.1, None, "oval", None, None, None, "rounded.md", None), (2, "c", "shape", None, None, None, 0.9, None, "ellipse", None, None, None, None, None),
        (3, "kpi-1", "text", None, None, None, 1.0, "LOUD", None, None, "none", "x", None, None), (3, "kpi-2", "text", None, None, 12.0, 1.0, "synergy", None, None, None, None, None, None), (3, "x", "text", "kpi", None, None, 1.0, "标题 only", None, None, None, None, None, None), (3, "s", "shape", None, None, None, 5.0, None, "rect", None, None, None, "4px", None), (3, "t", "shape", None, None, None, 9.0, None, "rect", None, None, None, "8px", None),
    ]
    out = scoring.risk_score(scoring.style_flags(spark.createDataFrame(e, cols), ["s"])).collect()
    flags = {r.s: {k for k, v in r.asDict().items() if v is True} for r in out}
    assert flags == {
        1: {"font_family_dedup", "emoji_as_icon", "all_caps_stroke_shadow", "rhetoric_on_cjk", "vertical_rhythm_variance"}, 2: {"css_gradient", "rounded_token_variance", "icon_circle_triad", "vertical_rhythm_variance"}, 3: {"kpi_sandwich", "vertical_rhythm_variance"},
    }
    assert {r.s: r.risk for r in out} == {1: 65, 2: 60, 3: 20}


def test_page_connectors_and_ids(spark):
    cols = "slide int, ord int, id string, pptx_id string, x double, y double, w double, h double, connector boolean, vector boolean, source_id string, target_id string, pptx_kind string, start_x double, start_y double, end_x double, end_y double, marker_start string, marker_end string, hidden boolean"
    line = lambda n, *ends, kind="line", vector=True, src="a", dst="b", ms="none", me="url(#m)": (1, n, f"l{n}", f"p{n}", 0.0, 0.0, 50.0, 0.0, True, vector, src, dst, kind, *(ends or (None,) * 4), ms, me, None)
    shape = lambda n, id_, x: (1, n, id_, None, x, 0.0, 100.0, 100.0, None, None, None, None, None, None, None, None, None, None, None, None)
    nodes = spark.createDataFrame([
        shape(0, "a", 0.0), shape(1, "b", 300.0), shape(2, "b", 900.0), line(3, 100.0, 50.0, 300.0, 50.0), line(4, 150.0, 50.0, 300.0, 50.0), line(5, 100.0, 50.0, 300.0, 50.0, me=None), line(6, 100.0, 50.0, 300.0, 50.0, ms="url", me="none"),
        line(7, 300.0, 50.0, 100.0, 50.0, src="b", dst="b"), line(8, src="a", dst="b"), line(9, 100.0, 50.0, 300.0, 50.0, dst="zz"), line(10, vector=False, kind=None), line(11, 300.0, 50.0, 100.0, 50.0, src="b", dst="a"), line(12, 400.0, 50.0, 302.0, 50.0, src="b", dst="b"),
    ], cols)
    got = {(r.ord, r.kind) for r in pages.connector_issues(nodes, "slide").collect()}
    assert got == {(4, "connector-detached"), (5, "connector-marker-missing"), (6, "connector-direction"), (7, "connector-detached"), (7, "connector-direction"), (8, "connector-detached"), (9, "connector-detached"), (10, "connector-unsupported"), (12, "connector-direction")}
    assert {(r.ord, r.id, r.n) for r in pages.duplicate_ids(nodes, "slide").collect()} == {(1, "b", 2), (2, "b", 2)}


def test_node_rules(spark):
    cols = "slide int, ord int, id string, path string, x double, y double, w double, h double, text string, role string, hidden boolean, card boolean, seen boolean"
    n = [
        (1, 0, "flat", "0", 10.0, 10.0, 1.0, 50.0, None, None, None, None, None), (1, 1, "p", "1", 100.0, 100.0, 200.0, 100.0, None, None, None, None, None), (1, 2, "c", "1/2", 110.0, 110.0, 50.0, 50.0, "t", None, None, None, None), (1, 3, "d", "3", 100.0, 100.0, 200.0, 100.0, None, "accent-rule", None, None, None),
        (1, 4, "e", "4", 120.0, 120.0, 50.0, 50.0, None, None, None, None, None), (1, 5, "f", "5", 1200.0, 600.0, 90.0, 50.0, None, None, None, None, None), (1, 6, "h", "6", 110.0, 110.0, 50.0, 50.0, "t", None, True, None, None),
    ]
    nodes, slides = spark.createDataFrame(n, cols), spark.createDataFrame([(1, 1280.0, 720.0), (2, 1283.0, 720.0)], "slide int, w double, h double")
    assert {(r.id, r.kind) for r in pages.node_issues(nodes, slides, "slide").collect()} == {("flat", "zero-size"), ("f", "slide-bounds")}
    assert pairs(pages.overlaps(nodes, "slide")) == {(2, 4)}
    assert [r.slide for r in pages.canvas_issues(slides, "slide").collect()] == [2]
    assert pages.audit(nodes, slides, "slide").count() == 4


def test_specifications(spark):
    d = spark.createDataFrame([(("s", ["t"], ("a", "b", "c", "d", "e"), ("t", "b"), "l", ["x"]),), (("", None, ("a", None, "c", "d", "e"), None, "l", None),), (None,)], "v struct<style:string,tone:array<string>,palette:struct<background:string,surface:string,primary:string,accent:string,text:string>,typography:struct<title:string,body:string>,layoutStrategy:string,avoid:array<string>>")
    got = [r.violations for r in structure.direction_issues(d, "v").collect()]
    assert got == [[], ["designDirection.style must be a non-empty string", "designDirection.tone must be an array", "designDirection.palette.surface must be a non-empty string", "designDirection.typography must be an object", "designDirection.avoid must be an array"], ["designDirection must be an object"]]
    s = spark.createDataFrame([(([("i", "l", "w", "m", ("f", "d", {"a": 1.0}), ["c"], 4.0), ("i", None, "w", "m", None, None, float("nan"))],),), (([],),), ((None,),)], "v struct<slides:array<struct<id:string,layoutType:string,intent:string,mainIdea:string,visualPlan:struct<focalPoint:string,density:string,visualWeight:map<string,double>>,contentSlots:array<string>,editableTarget:double>>>")
    at = "slideDesignSpecs.slides"
    assert [r.violations for r in structure.spec_issues(s, "v").collect()] == [
        [f"{at}[1].layoutType must be a non-empty string", f"{at}[1].visualPlan must be an object", f"{at}[1].contentSlots must be an array", f"{at}[1].editableTarget must be a finite number"], [f"{at} must not be empty"], [f"{at} must be an array"],
    ]


def test_element_structure(spark):
    cols = "type string, id string, x double, y double, w double, h double, kind string, src string, asset_id string, assets map<string,string>, data array<struct<label:string,value:double,series:map<string,double>>>, rows array<string>, columns array<string>"
    base = ("e", 0.0, 0.0, 1.0, 1.0)
    rows_ = [
        ("chart", *base, "sparkline", None, None, None, [("a", None, {}), ("", None, None)], None, None), ("diagram", *base, "matrixMap", None, None, None, None, [], ["c"]), ("cropped-asset", *base, None, None, "k", {"k": "f.png"}, None, None, None), ("cropped-asset", *base, None, None, "q", {"k": "f.png"}, None, None, None),
        ("line", "e", 0.0, 0.0, -1.0, 1.0, None, None, None, None, None, None, None), ("cropped-asset", *base, None, None, "k", {"k": "http://f"}, None, None, None), ("chart", *base, "bar", None, None, None, [("a", None, {"s": None})], None, None),
    ]
    got = [r.violations for r in structure.element_issues(spark.createDataFrame(rows_, cols), assets="assets", there=lambda src: src != "f.png").collect()]
    assert got == [
        ["chart.data[0].series must be a non-empty object", "chart.data[1].label is required", "chart.data[1].value must be numeric"], ["matrixMap rows are required"], ["file missing: f.png"], ["cropped-asset assets.id not found in manifest.assets"],
        ["w and h must be positive"], ["remote src must be downloaded before validation: http://f"], ["chart.data[0].series.s must be numeric"],
    ]


def test_text_rules(spark):
    d = spark.createDataFrame([("•  a 　 b",), ("- x",), ("a - b",), (None,)], "t string")
    assert [r.v for r in d.select(C.without_bullet(F.col("t")).alias("v")).collect()] == ["a b", "x", "a - b", None]
    m = spark.createDataFrame([(3, 0, "a"), (3, 2, None), (0, 2, "a"), (0, 0, None), (1, 1, "a"), (1, 0, None)], "m int, c int, a string")
    assert [r.v for r in m.select(C.layout_mode(F.col("m"), F.col("c"), F.col("a")).alias("v")).collect()] == ["measured", "hybrid", "auto-layout", "auto-layout", "measured", "measured"]
    assert m.select(C.layout_mode(F.col("m"), F.col("c"), F.col("a"), "hybrid").alias("v")).distinct().count() == 1


def plain_segments(values, shortest, keep):
    runs, head = [], 0.0
    for k, v in enumerate(values):
        if not runs or abs(v - head) > 36:
            runs.append([k, 0])
            head = v
        runs[-1][1] += 1
    out = []
    for start, n in runs:
        if out and n < shortest:
            out[-1][1] += n
        else:
            out.append([start, n])
    return [(k, *x) for k, x in enumerate(out[:keep])]


@pytest.mark.parametrize("shortest", [1, 2, 7])
def test_segments_of_groups_over_many_ranges(spark, shortest):
    r, nan = random.Random(shortest), float("nan")
    groups = {
        "hot": [r.choice([0.0, 30.0, 60.0, 90.0]) + r.random() for _ in range(3000)], "rising": [float(n) for n in range(900)], "still": [5.0] * 700, "calm": [r.choice([10.0, 12.0, 60.0] if n % 50 == 0 else [10.0, 30.0]) for n in range(2000)],
        "late": [1.0] * 600 + [99.0, 1.0] * 3 + [99.0] * 900, "holes": [nan if n % 3 else n % 100 * 1.0 for n in range(300)], "unknown": [nan, 1.0, 80.0, 1.0], "one": [3.0], None: [1.0, 50.0, 50.0],
    }
    data = [(k, n, None if v != v and n % 2 else v) for k, vs in groups.items() for n, v in enumerate(vs)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "k string, at int, v double")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {}
        for x in ordered.segments(df, "k", ["at"], "v", shortest=shortest).collect():
            got.setdefault(x.k, []).append((x.segment, x.start, x.n))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_segments(v, shortest, 5) for k, v in groups.items()}
    assert ordered.segments(df.where("false"), "k", ["at"], "v").count() == 0
