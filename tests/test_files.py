"""Readers and writers on small files."""

import json
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import marks, preflight, structure
from folioflow.sources import readers, sinks
from folioflow.streaming import bounds_stream


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if mode == "wb":
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def element(**more):
    return {"type": "text", "id": "t", "x": 1, "y": 1, "w": 2, "h": 1, "text": "a"} | more


def deck(elements, **more):
    return {"version": "0.1.1", "designSystem": {"source": "D.md", "mode": "strict"}, "deck": {"title": "T", "size": {"width": 13.333, "height": 7.5, "unit": "in"}}, "assets": [], "slides": [{"id": "slide-001", "background": {"type": "solid", "color": "#FFFFFF"}, "elements": elements}]} | more


@pytest.fixture
def decks(spark, tmp_path):
    chart = element(type="chart", id="c", kind="stackedBar", data=[{"label": "a", "series": {"z": 1, "b": "3"}}, {"label": "b", "value": "many"}], style={"showLegend": False, "palette": ["#111111"]})
    write(tmp_path / "d/good.json", "﻿" + json.dumps(deck([element(x="oops", style={"fontSize": 9, "fontWeight": 700}), element(id="u", y=2.5), chart])))
    write(tmp_path / "d/odd.json", json.dumps(deck([element(headers="no list"), element(id="u", x={"a": 1})])))
    write(tmp_path / "d/bad.json", '{"version": ')
    write(tmp_path / "d/list.json", "[1]")
    return readers.manifests(spark, str(tmp_path / "d"))


def named(rows, key="deck_id"):
    return {r[key].rsplit("/", 1)[-1]: r for r in rows}


def test_decks_survive_wrong_values(decks):
    by = named(decks.collect())
    assert (by["bad.json"].error, by["list.json"].error, by["good.json"].error, by["odd.json"].error) == ("invalid json", "not an object", None, None)
    assert by["odd.json"].mistyped and not by["good.json"].mistyped and by["good.json"].deck.size.width == 13.333
    assert sorted(named(readers.rejects(decks).collect())) == ["bad.json", "list.json"]
    e = {(r.deck_id.rsplit("/", 1)[-1], r.id): r for r in readers.elements(decks).collect()}
    assert e["good.json", "t"].x == 0 and e["good.json", "t"].y == 1 and e["good.json", "u"].y == 2.5 and e["good.json", "t"].font_size == 9 and e["good.json", "t"].bold
    assert e["odd.json", "t"].headers is None and e["odd.json", "u"].x == 0 and e["odd.json", "u"].w == 2
    data = e["good.json", "c"].data
    assert data[0].series == {"z": 1, "b": 3} and data[1].value == 0 and e["good.json", "c"].show_legend is False and e["good.json", "c"].palette == ["#111111"]


def test_deck_to_findings(decks):
    e = marks.flattened(readers.elements(decks), ["deck_id", "slide_id"])
    assert {r.id for r in e.where("type = 'shape'").collect()} == {f"c__shape-{n}" for n in (0, 1, 3, 4)}
    raw = readers.elements(decks).select("deck_id", "slide_id", "ord", "id", "type", *"xywh", "text", "font_size", "bold")
    found = {(r.deck_id.rsplit("/", 1)[-1], r.element_id, r.kind) for r in preflight.preflight(raw, ["deck_id", "slide_id"]).collect()}
    assert ("good.json", "t", "font-too-small") in found and ("odd.json", "t", "overlap") in found and ("good.json", "u", "overlap") not in found


def test_deck_rules(spark, tmp_path):
    bad = deck([], version="1", designSystem={"mode": "wild"}, assets=[{"src": "a"}], slides=[{"id": "s", "background": {"type": "solid", "color": "red"}}, {"id": "slide-1", "background": {"type": "image", "src": "http://x"}}, {"id": "slide-1"}])
    write(tmp_path / "a.json", json.dumps(bad))
    write(tmp_path / "b.json", json.dumps(deck([element()])))
    write(tmp_path / "c.json", json.dumps(deck([], slides=[])))
    got = named(structure.deck_issues(readers.manifests(spark, str(tmp_path))).collect())
    assert got["b.json"].violations == [] and got["b.json"].first_violation is None and got["c.json"].violations == ["slides must be a non-empty array"]
    assert got["a.json"].violations == [
        "designSystem.mode must be strict, balanced, creative, or inspired", "designSystem.source is required", "version must be 0.1.1", "asset.id is required", "slide.id must start with slide-",
        "s: solid background requires #RRGGBB color or token", "slide-1: a local src is required", "duplicate slide id: slide-1", "slide-1: background must be an object",
    ]


def test_front_matter(spark, tmp_path):
    text = "---\nname: x\ncolors:\n  primary: \"#0A0B0C\" # note\n  two: '#FFFFFF'\nrounded: {sm: 2, md: 4}\nfonts: [A, \"B\"]\nsteps:\n  - one\n  - id: s\n    note: n\n---\nintro\n## One\n\nbody ## no heading\n### sub\n## Two\nold\n## Two\nnew\n"
    write(tmp_path / "a.md", text)
    write(tmp_path / "b.md", "no front\n## One\nx")
    write(tmp_path / "c.md", "---\nname: x\n")
    f = readers.front_matter(spark, str(tmp_path))
    by = named(f.collect(), "file")
    assert by["a.md"].sections == {"One": "body ## no heading\n### sub", "Two": "new"} and by["a.md"].error is None
    assert by["b.md"].error == "must begin with front matter" and by["c.md"].error == "front matter is not closed"
    own = f.where("file like '%a.md'")
    tokens = {r.path: r.value for r in readers.flat_tokens(own).collect()}
    assert tokens == {"name": "x", "colors.primary": "#0A0B0C", "colors.two": "#FFFFFF", "rounded.sm": "2", "rounded.md": "4", "fonts.0": "A", "fonts.1": "B", "steps.0": "one", "steps.1.id": "s", "steps.1.note": "n"}
    assert own.select(readers.front_colours(F.col("front")).alias("c")).first().c == {"primary": "#0A0B0C", "two": "#FFFFFF"}


def test_html(spark):
    page = """<div class="pptx-slide"><h1>A</h1><table id="a"><thead><tr><th>h1</th><th> h
      2</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><th>no</th></tr></tbody><tbody><tr><td>other</td></tr></tbody></table></div>
      <section data-slide><table id="b"><tr><td>p</td><td>q</td></tr><tr><td>r</td></tr></table><table id="c"></table></section>"""
    nodes = readers.html_nodes(spark.createDataFrame([(1, page), (2, "<p>plain</p>"), (3, None)], "k long, html string"), "k", "html")
    assert {(r.k, r.tag) for r in readers.slide_nodes(nodes, "k").collect()} == {(1, "div"), (1, "section"), (2, "p")}
    t = [(r.headers, r.rows) for r in readers.html_tables(nodes, "k").orderBy("table").collect()]
    assert t == [(["h1", "h 2"], [["1", "2"]]), (["p", "q"], [["r"]])]
    many = "<table>" + "".join(f"<tr><td>{n}</td></tr>" for n in range(300)) + "</table>"
    rows = readers.html_tables(readers.html_nodes(spark.createDataFrame([(1, many)], "k long, html string"), "k", "html"), "k").first()
    assert rows.headers == ["0"] and len(rows.rows) == 299


def test_html_nodes_are_sent_in_runs(spark):
    class Pages:
        dtypes = [("k", "bigint"), ("html", "string")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    deep = "<p class='a'>" * 300 + "x" * 1000
    batch = pa.RecordBatch.from_pydict({"k": pa.array([2**53 + 1, None, 3]), "html": [deep, "", deep]})
    runs = list(readers.html_nodes(Pages(), "k", "html", limit=50_000)(iter([batch])))
    assert sum(r.num_rows for r in runs) == 600 and len(runs) > 10 and max(r.nbytes for r in runs) < 100_000
    own = spark.createDataFrame([(2**53 + 1, deep), (None, "<br>"), (3, None)], "k long, html string").coalesce(1)
    rows = sorted(readers.html_nodes(own, "k", "html").collect(), key=lambda r: (r.k is None, r.ord))
    assert [(r.k, r.ord, r.parent, r.attrs, r.path, r.text) for r in rows[:300]] == [(2**53 + 1, n, n - 1, {"class": "a"}, "/".join(map(str, range(n + 1))), "x" * 1000) for n in range(300)]
    assert [tuple(r) for r in rows[300:]] == [(None, 0, "br", {}, "0", -1, "")]


def test_measurements(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"elements": [{"id": "x", "x": 1.5, "y": 2, "w": 3, "h": 4}, {"id": "y", "x": 0}]}))
    assert [(r.id, r.x) for r in readers.measurements(spark, str(tmp_path)).orderBy("ord").collect()] == [("x", 1.5), ("y", 0)]
    write(tmp_path / "a.json", json.dumps({"elements": [{"id": "x"}, {"id": "x"}]}))
    with pytest.raises(Exception, match="duplicate id x"):
        readers.measurements(spark, str(tmp_path)).collect()


def test_images_and_listing(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII5B", 13, b"IHDR", 640, 480, 8, 6, 0, 0, 0)
    write(tmp_path / "a.png", png, "wb")
    write(tmp_path / "b.jpg", b"\xff\xd8", "wb")
    write(tmp_path / "c.txt", "x")
    out = named(readers.images(spark, str(tmp_path)).collect(), "path")
    assert sorted(out) == ["a.png", "b.jpg"] and (out["a.png"]["size"].width, out["a.png"]["size"].orientation) == (640, "landscape") and out["b.jpg"]["size"] is None
    assert [r.path.rsplit("/")[-1] for r in readers.listing(spark, str(tmp_path), "*.txt").collect()] == ["c.txt"]


def test_ocr_words(spark, tmp_path):
    head = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")
    rows = ["5 1 1 1 1 1 10 20 30 8 91.5 Word", "5 1 1 1 1 2 10 20 30 8 -1 gone", "4 1 1 1 1 0 1 1 1 1 99 line", "5 1 1 1 1 3 10 20 0 8 90 flat", '5 1 1 1 1 4 1 2 3 4 80 "quoted']
    write(tmp_path / "o.tsv", "\n".join([head, *(r.replace(" ", "\t") for r in rows)]))
    assert [(r.text, r.x, r.conf) for r in readers.ocr_words(spark, str(tmp_path)).collect()] == [("Word", 10, 91.5), ('"quoted', 1, 80)]


def test_zip_parts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        for name in ("ppt/slides/slide1.xml", "ppt/slides/slide2.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml"):
            z.writestr(name, "<x/>")
        z.writestr("ppt/theme/theme1.xml", "".join(f'<a:srgbClr val="{n:06x}"/>' for n in range(10, 30)) + '<a:sysClr lastClr="FFFFFF"/>')
    write(tmp_path / "b.pptx", b"not a zip file", "wb")
    parts = readers.zip_parts(spark, str(tmp_path))
    by = named(readers.template_summary(parts).collect(), "file")
    assert (by["a.pptx"].slides, by["a.pptx"].layouts, by["a.pptx"].status) == (2, 1, "ok") and by["a.pptx"].colours == [f"#{n:06X}" for n in range(10, 22)]
    assert by["b.pptx"].status == "error" and by["b.pptx"].error
    assert {r.n for r in readers.part_counts(parts, "ppt/slides/slide", ".xml").collect()} == {0, 2}


def test_annotations_fonts_and_archetypes(spark, tmp_path):
    write(tmp_path / "a.csv", "deckId,source,expectedSlopRisk,reviewer,annotatedAt\nd1,x,40,r,2025-01-02\n")
    r = readers.annotations(spark, str(tmp_path / "a.csv")).first()
    assert (r.deckId, r.expectedSlopRisk, str(r.annotatedAt)) == ("d1", 40, "2025-01-02")
    for name, magic in (("A.ttf", b"\0\1\0\0xx"), ("sub/B.otf", b"OTTOxx"), ("C.TTC", b"????"), ("D.txt", b"OTTO")):
        write(tmp_path / "fonts" / name, magic, "wb")
    assert {(f.name, f.format) for f in readers.font_files(spark, str(tmp_path / "fonts")).collect()} == {("A", "ttf"), ("B", "otf"), ("C", None)}
    t = lambda *rows: spark.createDataFrame(rows, "name string, body string")
    one, two = t(("a", "first")), t(("a", "second"), ("b", "other"))
    assert {(x.name, x.body) for x in readers.archetypes(one, two, t(("a", ""), ("b", "")).select("name")).collect()} == {("a", "first"), ("b", "other")}
    with pytest.raises(Exception, match="unknown archetype c"):
        readers.archetypes(one, two, t(("c", "")).select("name")).collect()


def test_page_hints(spark):
    docs = spark.createDataFrame([("a.pdf", True), ("b.pdf", False), ("c.pdf", True)], "file string, available boolean")
    pages = spark.createDataFrame([("a.pdf", 2, "p2.png", 10.00004, 5.0, "h"), ("a.pdf", 1, "p1.png", 10.0, 5.0, "h"), ("b.pdf", 1, "p.png", 1.0, 1.0, "h")], "file string, page int, image string, width_pt double, height_pt double, hints string")
    by = {r.file: r for r in readers.page_hints(docs, pages).collect()}
    assert [p.page for p in by["a.pdf"].pages] == [1, 2] and by["a.pdf"].pages[1].width_pt == 10.0
    assert (by["b.pdf"].status, by["b.pdf"].page_count, by["b.pdf"].pages) == ("deferred", 0, []) and (by["c.pdf"].status, by["c.pdf"].page_count) == ("ok", 0)


def test_palette(spark):
    rows = [(1, [255] * 6 + [0] * 2 + [0] * 2, [0] * 6 + [255] * 2 + [0] * 2, [0] * 8 + [255] * 2), (2, [], [], []), (3, [7], [7], [7])]
    out = readers.palette(spark.createDataFrame(rows, "image_id long, r array<int>, g array<int>, b array<int>"), 3).collect()
    assert [(r.hex, r.share) for r in out if r.image_id == 1] == [("FF0000", 0.6), ("00FF00", 0.2), ("0000FF", 0.2)] or {(r.hex, r.share) for r in out if r.image_id == 1} == {("FF0000", 0.6), ("00FF00", 0.2), ("0000FF", 0.2)}
    assert [(r.hex, r.share) for r in out if r.image_id == 3] == [("070707", 1.0)] and not [r for r in out if r.image_id == 2]


def test_json_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame([({"b": 1, "a": 2}, ("x", [("q", 1), ("p", 2)]), None)], "z map<string,int>, m struct<k:string,a:array<struct<y:string,b:int>>>, n string")
    assert sinks.json_lines(df).first().value == '{"m":{"a":[{"b":1,"y":"q"},{"b":2,"y":"p"}],"k":"x"},"z":{"a":2,"b":1}}'
    sinks.write_json(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_report(spark):
    cols = "k int, input_type string, input_source string, level long, n_slides long, drift double, fonts array<struct<element:string,requested:string,fallback:string>>, rasterized array<struct<slide:string,element:string,share:double,reason:string,recoverable:boolean>>, slop long, signals array<struct<id:string,weight:long,count:long>>, safety string, floor long, source_causes array<string>, preview_status string, preview_slides long"
    rows = [(1, "html", "a.html", 4, 3, 1.25, [("e", "X", "Arial")], [("s", "e", 0.256, "photo", True)], 35, [("css-gradient", 15, 2), ("emoji", 0, 0)], "passed", 4, ["raster"], "ok", 3), (2, "image", "b.png", 3, None, None, None, None, None, None, None, None, None, None, None)]
    by = {r.k: r.report.split("\n") for r in sinks.markdown(spark.createDataFrame(rows, cols), "k").collect()}
    assert [x[3:] for x in by[1] if x.startswith("## ")] == ["Summary", *sinks.SECTIONS] == [x[3:] for x in by[2] if x.startswith("## ")]
    for line in ("- Slide count: 3", "- Average drift: 1.25 px", "- e: X -> Arial", "- s/e: 25.6% — photo (recoverable)", "- slopRisk: 35/100 (0 = clean, 100 = pure slop)", "- css-gradient: weight 15, count 2", "- Source-causal: raster", "- Preview diff ok across 3 slides."):
        assert line in by[1]
    assert not any("emoji" in x for x in by[1]) and by[2].count("_not measured_") == 4 and "- Floor level: 3" in by[2] and "- No floor violations." in by[2]
    assert sinks.markdown(spark.createDataFrame([rows[1], rows[1]], cols), "k").count() == 2


def test_blocked_summary(spark, tmp_path):
    s = spark.createDataFrame([("a", True, 2), ("b", False, 0)], "manifest string, blocked boolean, critical int")
    with pytest.raises(ValueError, match="blocked"):
        sinks.blocked_summary(s, str(tmp_path / "x"))
    assert json.loads(spark.read.text(str(tmp_path / "x")).first().value) == {"blocked": True, "blockedBy": "layout-safety", "critical": 2, "manifest": "a", "status": "blocked"}
    assert sinks.blocked_summary(s, str(tmp_path / "y"), hard=False) == 1 and sinks.blocked_summary(s.where("not blocked"), str(tmp_path / "z")) == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("in", 1.0, 1.0, 1.0, 1.0), ("out", 13.0, 1.0, 1.0, 1.0)], "id string, x double, y double, w double, h double")
    rows.write.parquet(str(tmp_path / "in"))
    q = bounds_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("off").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and [r.id for r in spark.table("off").collect()] == ["out"]
    with pytest.raises(ValueError):
        bounds_stream(rows)
