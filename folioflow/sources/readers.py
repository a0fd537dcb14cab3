"""Readers that turn page-document files into tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

POINT = "struct<label:string,value:string,series:map<string,string>,color:string>"
LAYER = "struct<label:string,nodes:array<string>>"
ELEMENT = f"struct<type:string,id:string,x:string,y:string,w:string,h:string,text:string,shape:string,src:string,kind:string,name:string,role:string,headers:array<string>,rows:string,columns:array<string>,description:string,alt:string,data:array<{POINT}>,layers:array<{LAYER}>,lanes:array<{LAYER}>,style:map<string,string>>"
MANIFEST = f"version string, designSystem struct<source:string,name:string,mode:string>, deck struct<title:string,language:string,size:struct<preset:string,width:string,height:string,unit:string>>, assets array<struct<id:string,src:string>>, slides array<struct<id:string,type:string,title:string,notes:string,background:struct<type:string,color:string,src:string>,elements:array<{ELEMENT}>>>, _corrupt_record string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A file is a deck; a byte-order mark is dropped. `error` says of a file that it is no JSON object; of a deck with a
    value of another kind than expected, `mistyped` is true, the value is null, and all else is read. Numbers are read as text and
    turned into numbers by `elements`, so "oops" for a coordinate is 0, not the end of the deck."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("deck_id"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    json = F.try_parse_json("value")
    parsed = text.select("deck_id", "value", F.when(json.isNull(), "invalid json").when(~F.schema_of_variant(json).startswith("OBJECT"), "not an object").alias("error"))
    parsed = parsed.withColumn("d", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    size = F.struct(F.col("d.deck.size.preset").alias("preset"), F.col("d.deck.size.width").try_cast("double").alias("width"), F.col("d.deck.size.height").try_cast("double").alias("height"), F.col("d.deck.size.unit").alias("unit"))
    deck = F.when(F.col("d.deck").isNotNull(), F.struct("d.deck.title", "d.deck.language", F.when(F.col("d.deck.size").isNotNull(), size).alias("size")))
    return parsed.select("deck_id", "error", (F.col("error").isNull() & F.col("d._corrupt_record").isNotNull()).alias("mistyped"), "d.version", "d.designSystem", deck.alias("deck"), "d.assets", "d.slides")


def rejects(decks: DataFrame) -> DataFrame:
    """(deck_id, error) of files that can't be read."""
    return decks.where("error is not null").select("deck_id", "error")


def slides(decks: DataFrame) -> DataFrame:
    s = decks.where("error is null").select("deck_id", F.posexplode("slides").alias("slide_ord", "s"))
    return s.select("deck_id", "slide_ord", F.col("s.id").alias("slide_id"), "s.type", "s.title", "s.notes", F.col("s.background.type").alias("bg_type"), F.col("s.background.color").alias("bg_color"), F.col("s.background.src").alias("bg_src"), "s.elements")


def elements(decks: DataFrame) -> DataFrame:
    """One row for each element; geometry and chart values that are no numbers are 0 (null where a point has no value)."""
    e = slides(decks).select("deck_id", "slide_ord", "slide_id", F.posexplode("elements").alias("ord", "e"))
    data = F.transform("e.data", lambda d: F.struct(d["label"].alias("label"), F.when(d["value"].isNotNull(), C.number(d["value"])).alias("value"), F.transform_values(d["series"], lambda _, v: C.number(v)).alias("series"), d["color"].alias("color")))
    rows = F.from_json("e.rows", "array<string>")
    style = lambda k: F.try_element_at("e.style", F.lit(k))
    named = {"typography": "typography", "color": "color", "component": "component", "font_family": "fontFamily", "fill": "fill", "background": "background", "stroke": "stroke", "shadow": "shadow", "border_radius": "borderRadius", "radius": "radius", "source_id": "sourceId", "target_id": "targetId", "label_color": "labelColor"}
    numbers = {"font_size": "fontSize", "line_height": "lineHeight", "letter_spacing": "letterSpacing"}
    weight = style("fontWeight")
    return e.select(
        "deck_id", "slide_ord", "slide_id", "ord", F.col("e.id").alias("id"), "e.type", *[C.number(F.col(f"e.{c}")).alias(c) for c in "xywh"],
        *[F.col(f"e.{c}").alias(c) for c in ("text", "shape", "src", "kind", "name", "role", "headers", "columns", "description", "alt", "layers", "lanes", "style")], rows.alias("rows"), data.alias("data"),
        *[style(k).alias(n) for n, k in named.items()], *[style(k).try_cast("double").alias(n) for n, k in numbers.items()],
        ((style("bold") == "true") | (weight == "bold") | (weight.try_cast("double") >= 700)).alias("bold"), ((style("italic") == "true") | (style("fontStyle") == "italic")).alias("italic"),
        *[style(k).try_cast("boolean").alias(n) for n, k in (("show_values", "showValues"), ("show_legend", "showLegend"), ("end_label", "endLabel"))], F.from_json(style("palette"), "array<string>").alias("palette"),
    )


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Batch files, which may begin with a byte-order mark."""
    kind = "jobs array<struct<id:string,manifest:string,outputDir:string,mode:string,allowLayoutViolation:boolean>>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    return text.select(F.posexplode(F.from_json("value", kind)["jobs"]).alias("ord", "j")).select("ord", "j.*")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(file, front, sections map of '## ' headings, error). A heading that comes again replaces the section before."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    return text.select("file", *matter(F.col("value")))


def matter(value: Column) -> list[Column]:
    opened = F.startswith(value, F.lit("---\n"))
    close = F.locate("\n---", value, 5)
    good = opened & (close > 0)
    front = F.when(good, F.substring(value, F.lit(5), close - 5)).otherwise("")
    body = F.when(good, F.regexp_replace(F.substring(value, close + 4, F.length(value)), "^\n", "")).otherwise(value)
    parts = F.split(body, r"(?m)^##[ \t\n]+(?=.)", -1)
    pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(F.trim(F.substring_index(x, "\n", 1)).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    sections = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    return [front.alias("front"), sections.alias("sections"), F.when(~opened, "must begin with front matter").when(close == 0, "front matter is not closed").alias("error")]


def front_colours(front: Column) -> Column:
    """The stdlib subset: name -> colour of the `colors:` block."""
    block = F.regexp_extract(front, r"(?m)^colors:[ \t]*\n((?:[ \t]+.*\n?)+)", 1)
    line = r"(?m)^[ \t]+([A-Za-z0-9_-]+):[ \t]*[\"']?(#[0-9a-fA-F]{6})"
    return F.map_from_arrays(F.regexp_extract_all(block, F.lit(line), F.lit(1)), F.regexp_extract_all(block, F.lit(line), F.lit(2)))


def _scalar(v: str) -> str:
    return v.strip().strip("\"'")


def _leaves(front: str) -> Iterator[tuple[str, str]]:
    """(path, value) of nested maps and lists; list items are numbered. Flow lists and maps may stand on one line."""
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}

    def leaf(path: str, value: str) -> Iterator[tuple[str, str]]:
        value = value.strip()
        if value[:1] + value[-1:] in ("[]", "{}") and len(value) > 1:
            for n, item in enumerate(x for x in value[1:-1].split(",") if x.strip()):
                name, colon, rest = item.partition(":")
                yield from leaf(f"{path}.{_scalar(name)}", rest) if value[0] == "{" and colon else leaf(f"{path}.{n}", item)
        else:
            yield path, _scalar(value)

    for line in front.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, text = len(bare) - len(bare.lstrip()), bare.strip()
        while stack and stack[-1][0] >= depth + text.startswith("- "):
            stack.pop()
        at = ".".join(n for _, n in stack)
        if text.startswith("- ") or text == "-":
            n = counts[at] = counts.get(at, -1) + 1
            stack.append((depth + 1, str(n)))
            at, text, depth = f"{at}.{n}", text[1:].strip(), depth + 2
            if ":" not in text or text[:1] in "\"'[{":
                yield from leaf(at, text)
                continue
        name, colon, value = text.partition(":")
        if not colon:
            continue
        path = f"{at}.{_scalar(name)}" if at else _scalar(name)
        if value.strip():
            yield from leaf(path, value)
        else:
            stack.append((depth, _scalar(name)))


def flat_tokens(fronts: DataFrame) -> DataFrame:
    """(file, path, value) of YAML front matter; lists have their places as names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file, path, value) for file, front in zip(pdf["file"], pdf["front"], strict=True) for path, value in _leaves(front or "")]
            yield pd.DataFrame(rows, columns=["file", "path", "value"])

    return fronts.select("file", "front").mapInPandas(run, "file string, path string, value string")


class _Nodes(HTMLParser):
    """Nodes in order, as [tag, attrs, parent, start, end]: a node's text is that part of the page's text."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []
        self.open: list[int] = []
        self.data: list[str] = []
        self.at = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1] if self.open else -1
        self.rows.append([tag, {k: v or "" for k, v in attrs}, parent, self.at, self.at])
        if tag not in self.VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][0] == tag:
                self.end(k)
                break

    def handle_data(self, data: str) -> None:
        self.data.append(data)
        self.at += len(data)

    def end(self, k: int) -> None:
        for n in self.open[k:]:
            self.rows[n][4] = self.at
        del self.open[k:]

    def nodes(self) -> Iterator[tuple[int, str, list[tuple[str, str]], str, int, str]]:
        """One at a time, as paths and texts of nested nodes can be far longer than their page."""
        self.end(0)
        text, path, ends = "".join(self.data), "", [0] * len(self.rows)  # path: of the node before; ends: where a node's own path ends in it
        for n, (tag, attrs, parent, start, end) in enumerate(self.rows):
            path = f"{path[: ends[parent]]}/{n}" if parent >= 0 else str(n)
            ends[n] = len(path)
            yield n, tag, list(attrs.items()), path, parent, text[start:end]


NODE = pa.schema({"ord": pa.int64(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "path": pa.string(), "parent": pa.int64(), "text": pa.string()})


def html_nodes(pages: DataFrame, id_: str, html: str, limit: int = 1 << 20) -> DataFrame:
    """(id, ord, tag, attrs, path, parent, text); a node's text holds that of its descendants. Nodes are sent on in runs of about
    `limit` characters, so that a worker holds a page and a run, however many nodes a batch of pages has."""
    kind = dict(pages.dtypes)[id_]

    def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *own], [id_, *NODE.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for k, source in enumerate(batch.column(1)):
                parser = _Nodes()
                parser.feed(source.as_py() or "")
                parser.close()
                for row in parser.nodes():
                    at.append(k)
                    rows.append(row)
                    size += 100 + len(row[3]) + len(row[5]) + sum(len(a) + len(b) for a, b in row[2])
                    if size >= limit:
                        yield made(batch, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield made(batch, at, rows)

    return pages.select(id_, html).mapInArrow(run, f"{id_} {kind}, ord long, tag string, attrs map<string,string>, path string, parent long, text string")


def slide_nodes(nodes: DataFrame, id_: str) -> DataFrame:
    """Nodes marked as slides, or each page's first node where none is."""
    marked = F.coalesce(F.col("attrs")["class"].rlike(r"(^|\s)pptx-slide(\s|$)"), F.lit(False)) | F.map_contains_key("attrs", "data-slide")
    n = nodes.withColumn("marked", marked)
    any_ = n.groupBy(id_).agg(F.bool_or("marked").alias("has"))
    return n.join(any_, id_).where(F.col("marked") | (~F.col("has") & (F.col("ord") == 0))).drop("has")


def html_tables(nodes: DataFrame, id_: str) -> DataFrame:
    """(table, headers, rows). Headers are the header cells of the table's head, or its plain cells; rows are those of the first
    body, or of the whole table, with their plain cells; without headers the first row is taken for them.

    A cell finds its row, head, body and table among the prefixes of its path, by hash joins.
    """
    n = nodes.select(id_, "ord", "tag", "path", C.normal_space(F.col("text")).alias("text"))
    steps = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    cells = n.where("tag in ('td', 'th') and contains(path, '/')").select(id_, "ord", "tag", "text", F.explode(up).alias("over"))
    boxes = n.where("tag in ('tr', 'thead', 'tbody', 'table')").select(id_, F.col("path").alias("over"), F.col("tag").alias("box"), F.col("ord").alias("box_ord"))
    near = lambda tag: F.max(F.when(F.col("box") == tag, F.col("box_ord"))).alias(tag)
    placed = cells.join(boxes, [id_, "over"]).groupBy(id_, "ord", "tag", "text").agg(*[near(t) for t in ("tr", "thead", "tbody", "table")]).where("`table` is not null")
    body = F.min("tbody").over(W.partitionBy(id_, "table"))
    placed = placed.withColumn("body", body)
    cell = F.struct("ord", "tag", "text")
    head = F.array_sort(F.collect_list(F.when(F.col("thead").isNotNull(), cell)))
    rows = F.array_sort(F.collect_list(F.when((F.col("tag") == "td") & F.col("tr").isNotNull() & (F.col("body").isNull() | (F.col("tbody") == F.col("body"))), F.struct("tr", cell.alias("c")))))
    t = placed.groupBy(id_, "table").agg(head.alias("head"), rows.alias("cells"))
    wanted = F.when(F.exists("head", lambda c: c["tag"] == "th"), "th").otherwise("td")
    headers = F.transform(F.filter("head", lambda c: c["tag"] == wanted), lambda c: c["text"])
    order = F.array_distinct(F.transform("cells", lambda c: c["tr"]))
    lines = F.transform(order, lambda r: F.transform(F.filter("cells", lambda c: c["tr"] == r), lambda c: c["c"]["text"]))
    t = t.select(id_, "table", headers.alias("own"), lines.alias("lines"))
    return t.select(id_, "table", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce(F.try_element_at("lines", F.lit(1)), F.array().cast("array<string>"))).alias("headers"), F.when(F.size("own") > 0, F.col("lines")).otherwise(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("rows"))


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measured elements; an id that comes twice in a file raises."""
    kind = "elements array<struct<id:string,slideId:string,kind:string,x:double,y:double,w:double,h:double>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("d"))
    e = text.select("file", F.posexplode("d.elements").alias("ord", "e")).select("file", "ord", "e.*")
    n = e.groupBy("file", "id").count().where("count > 1").select("file", "id", F.lit(True).alias("twice"))
    fail = F.when(F.col("twice"), F.raise_error(F.concat(F.lit("duplicate id "), "id")).cast("string")).otherwise(F.col("id"))
    return e.join(n, ["file", "id"], "left").withColumn("id", fail).drop("twice")


def png_size(content: Column) -> Column:
    """Width and height from the header of a PNG, null for other bytes."""
    at = lambda k: F.conv(F.hex(F.substring(content, k, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(at(17).alias("width"), at(21).alias("height"), F.when(at(17) >= at(21), "landscape").otherwise("portrait").alias("orientation")))


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """S07, S11"""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", png_size(F.col("content")).alias("size"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """S11"""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").orderBy("path")


OCR = T.StructType([T.StructField(c, T.StringType()) for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")])


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """S09"""
    raw = spark.read.csv(path, sep="\t", header=True, schema=OCR, quote="")
    n = lambda c: F.col(c).try_cast("double")
    return raw.where((n("level") == 5) & (F.trim("text") != "") & (n("conf") >= 0) & (n("width") > 0) & (n("height") > 0)).select(n("left").alias("x"), n("top").alias("y"), n("width").alias("w"), n("height").alias("h"), n("conf").alias("conf"), F.trim("text").alias("text"))


def zip_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, colours, error): the parts of zipped documents; colours of theme parts, the first 12. A file that is no zip
    archive gives one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        own = []
                        for name in z.namelist():
                            theme = name.startswith("ppt/theme/theme") and name.endswith(".xml")
                            found = re.findall(r'<a:srgbClr val="([0-9A-Fa-f]{6})"', z.read(name).decode("utf-8", "replace")) if theme else []
                            own.append((file, name, [f"#{c.upper()}" for c in found[:12]], None))
                        rows += own
                except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zlib.error) as e:
                    rows.append((file, None, [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["file", "name", "colours", "error"])

    return files.mapInPandas(run, "file string, name string, colours array<string>, error string")


def template_summary(parts: DataFrame) -> DataFrame:
    """Counts of slides, layouts, masters and themes of each file, its first theme's colours, and whether it needs a look."""
    n = lambda folder: F.count_if(F.startswith("name", F.lit(f"ppt/{folder}")) & F.endswith("name", F.lit(".xml")))
    out = parts.groupBy("file").agg(n("slides/slide").alias("slides"), n("slideLayouts/slideLayout").alias("layouts"), n("slideMasters/slideMaster").alias("masters"), n("theme/theme").alias("themes"), F.min_by("colours", F.when(F.startswith("name", F.lit("ppt/theme/theme")), F.col("name"))).alias("colours"), F.max("error").alias("error"))
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "error").when((F.col("masters") == 0) | (F.col("layouts") == 0), "review").otherwise("ok"))


def part_counts(parts: DataFrame, prefix: str, suffix: str) -> DataFrame:
    return parts.groupBy("file").agg(F.count_if(F.startswith("name", F.lit(prefix)) & F.endswith("name", F.lit(suffix))).alias("n"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """S12"""
    return spark.read.csv(path, header=True, schema="deckId string, source string, expectedSlopRisk int, reviewer string, annotatedAt date")


def font_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, format) of font files by extension; the format is told by the first bytes, null if they are no font's. Names
    inside fonts need a font reader; the file's name stands in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(ttf|otf|ttc)$"))
    magic = F.hex(F.substring("content", 1, 4))
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("name"), F.when(magic == "00010000", "ttf").when(magic == "4F54544F", "otf").when(magic == "74746366", "ttc").alias("format"))


def page_hints(documents: DataFrame, pages: DataFrame, key: str = "file") -> DataFrame:
    """What an external decoder found of each document's pages: (key, status, page_count, pages). Documents (key, page engine
    available or not) without an engine are deferred, without pages. pages (key, page, image, width_pt, height_pt, hints)."""
    own = F.struct("page", "image", F.round("width_pt", 4).alias("width_pt"), F.round("height_pt", 4).alias("height_pt"), "hints")
    found = pages.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("pages"))
    out = documents.join(found, key, "left")
    ok = F.coalesce("available", F.lit(False))
    listed = F.when(ok, F.coalesce("pages", F.filter(F.array(*[F.lit(None).cast(found.schema["pages"].dataType.elementType)]), lambda x: x.isNotNull())))
    return out.select(key, F.when(ok, "ok").otherwise("deferred").alias("status"), F.when(ok, F.size(listed)).otherwise(0).cast("long").alias("page_count"), F.coalesce(listed, F.filter("pages", lambda x: F.lit(False))).alias("pages"))


def archetypes(first: DataFrame, fallback: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first root's entry, else the fallback's; an unknown name raises. (name, body) tables, wanted (name)."""
    a, b = first.select("name", F.col("body").alias("__a")), fallback.select("name", F.col("body").alias("__b"))
    none = F.raise_error(F.concat(F.lit("unknown archetype "), "name")).cast("string")
    return wanted.join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce("__a", "__b", none).alias("body"))


def palette(images_: DataFrame, k: int = 8) -> DataFrame:
    """Median cut to k colours. images (image_id, r, g, b arrays of pixels): (image_id, hex, share), largest first."""

    def cut(pixels: list[tuple[int, int, int]], n: int) -> list[list[tuple[int, int, int]]]:
        boxes = [pixels]
        while len(boxes) < n:
            box = max((b for b in boxes if len(set(b)) > 1), key=len, default=None)
            if box is None:
                break
            wide = max(range(3), key=lambda c: max(p[c] for p in box) - min(p[c] for p in box))
            rest = sorted(box, key=lambda p: p[wide])
            at = len(rest) // 2
            while 0 < at < len(rest) and rest[at][wide] == rest[at - 1][wide]:
                at -= 1
            at = at or next(i for i, p in enumerate(rest) if p[wide] != rest[0][wide])
            boxes.remove(box)
            boxes += [rest[:at], rest[at:]]
        return boxes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for image, r, g, b in pdf.itertuples(index=False):
                pixels = list(zip(map(int, r), map(int, g), map(int, b), strict=True))
                boxes = sorted(cut(pixels, k), key=len, reverse=True) if pixels else []
                for ord_, box in enumerate(boxes):
                    mean = [round(sum(p[c] for p in box) / len(box)) for c in range(3)]
                    rows.append((image, ord_, "{:02X}{:02X}{:02X}".format(*mean), len(box) / len(pixels)))
            yield pd.DataFrame(rows, columns=["image_id", "ord", "hex", "share"])

    return images_.select("image_id", "r", "g", "b").mapInPandas(run, "image_id long, ord long, hex string, share double")
