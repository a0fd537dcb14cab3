"""Operators that follow an order: gaps, runs, pages, cursors, ranks, expansion of charts and diagrams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def even_gaps(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Groups whose positive gaps (3 digits), two or more, are all the same."""
    gap = C.half_up(F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(value)), 3)
    return rows.withColumn("gap", gap).where("gap > 0").groupBy(key).agg(F.count("*").alias("n_gaps"), F.countDistinct("gap").alias("d"), F.min("gap").alias("gap")).where("n_gaps >= 2 and d = 1").drop("d")


class Stretch:
    """What consecutive rows of one group do to a segment that began before them, for any value it may have begun with.

    The first row that ends such a segment is over `threshold` away from its value, so it is a new largest or least value; a chain
    of segments begins at each of these. Chains that end a segment at the same row have one future and go on as one.
    """

    def __init__(self, threshold: float, shortest: int, keep: int):
        self.threshold, self.shortest, self.keep = threshold, shortest, keep
        self.n, self.low, self.high = 0, float("inf"), float("-inf")
        self.value: list[float] = []  # of the rows at which chains begin
        self.at: list[int] = []
        self.starts: list[list[int]] = []  # of each chain's segments of `shortest` rows or more, `keep` + 1 of them
        self.open: dict[int, tuple[float, list[int], list[int]]] = {}  # start of the segment -> its value, chains, those that want its start

    def add(self, v: float) -> None:
        n, cut = self.n, [k for k, (head, _, _) in self.open.items() if abs(v - head) > self.threshold]
        chains, want = [], []
        for k in cut:
            _, mine, wanting = self.open.pop(k)
            for c in wanting if n - k >= self.shortest else ():
                self.starts[c].append(k)
            chains += mine
            want += [c for c in wanting if len(self.starts[c]) <= self.keep]
        if n == 0 or v > self.high or v < self.low:
            chains.append(len(self.at))
            want.append(len(self.at))
            self.value.append(v)
            self.at.append(n)
            self.starts.append([])
            self.low, self.high = min(self.low, v), max(self.high, v)
        if chains:
            self.open[n] = (v, chains, want)
        self.n += 1

    def row(self) -> dict:
        last = {c: (k, head) for k, (head, chains, _) in self.open.items() for c in chains}
        each = [last[c] for c in range(len(self.at))]
        return {"n": self.n, "value": self.value, "at": self.at, "starts": self.starts, "last": [k for k, _ in each], "head": [h for _, h in each]}


STRETCH = "part int, n long, value array<double>, at array<long>, starts array<array<long>>, last array<long>, head array<double>"


def segments(rows: DataFrame, key: str, order: list[str], value: str, threshold: float = 36, shortest: int = 2, keep: int = 5) -> DataFrame:
    """A segment ends where a value is over `threshold` away from the segment's first value (so neighbours are not
    enough). Segments under `shortest` rows join the one before, the first never does; `keep` segments are labelled. A null or NaN
    value ends no segment, and one that begins with it goes on to the end.

    Rows are dealt by ranges of (key, order), so that a group of any size is spread; each range is told by its new extremes (see
    Stretch), a few dozen for values without a trend, at worst a row each, and a group's ranges are then followed in order.
    """
    kind = dict(rows.dtypes)[key]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, now, done = TaskContext.get().partitionId(), None, None, []
        types = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("value", pa.list_(pa.float64())), ("at", pa.list_(pa.int64())), ("starts", pa.list_(pa.list_(pa.int64()))), ("last", pa.list_(pa.int64())), ("head", pa.list_(pa.float64()))])

        def out() -> pa.RecordBatch:
            names, told = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, key_type), *pa.RecordBatch.from_pylist(told, schema=types).columns], names=[key, *types.names])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or k != own:
                    if now is not None:
                        done.append((own, {"part": part} | now.row()))
                        if len(done) >= 1000:
                            yield out()
                    own, now = k, Stretch(threshold, shortest, keep)
                now.add(float("nan") if v is None else v)
        if now is not None:
            done.append((own, {"part": part} | now.row()))
            yield out()

    def starts_of(parts: list[dict]) -> tuple[list[int], int]:
        total, start, head, found = 0, 0, 0.0, [0]
        for s in parts:
            ends = [k for k, v in enumerate(s["value"]) if abs(v - head) > threshold][:1] if total else [0]
            for c in ends:
                if start and total + s["at"][c] - start >= shortest:
                    found.append(start)
                found += [total + k for k in s["starts"][c] if total + k]
                start, head = total + s["last"][c], s["head"][c]
            total += s["n"]
        if start and total - start >= shortest:
            found.append(start)
        return found, total

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, parts in enumerate(batch.column(1).to_pylist()):
                starts, total = starts_of(parts)
                for n, (a, b) in enumerate(zip(starts[:keep], [*starts, total][1:], strict=False)):
                    row.append(k)
                    found.append((n, a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array([f[c] for f in found], pa.int64()) for c in range(3))], names=[key, "segment", "start", "n"])

    dealt = rows.select(key, *order, F.col(value).cast("double").alias("__v")).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    told = dealt.select(key, "__v").mapInArrow(tell, f"`{key}` {kind}, {STRETCH}")
    ranges = F.array_sort(F.collect_list(F.struct(*[c for c in told.columns if c != key])))  # as many as there are ranges, at most
    return told.groupBy(key).agg(ranges.alias("parts")).mapInArrow(follow, f"`{key}` {kind}, segment long, start long, n long")


def line_pieces(points: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """Consecutive points as pieces, scaled to 0..1 in the group (guarded where all are equal)."""
    w = W.partitionBy(*keys)
    low, high = F.least(F.lit(0.0), F.min(value).over(w)), F.greatest(F.lit(1.0), F.max(value).over(w))
    scaled = (F.col(value) - low) / (high - low)
    here = points.withColumn("v0", C.half_up(scaled, 4))
    return here.withColumn("v1", F.lead("v0").over(w.orderBy(ord_))).where("v1 is not null")


def stacked(rows: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """Where each bar of a stack begins."""
    w = W.partitionBy(*keys).orderBy(ord_).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("baseline", F.coalesce(F.sum(value).over(w), F.lit(0)))


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentages; a total of 0 counts as 1."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return rows.withColumn("share", C.half_up(F.col(value) * 100.0 / F.when(total == 0, 1).otherwise(total)).cast("long"))


def paginate(rows: DataFrame, key: str, ord_: str, size: int = 4, cols: int = 2) -> DataFrame:
    """Pages of `size` where there are more than that, and a place in the grid."""
    w = W.partitionBy(key)
    n = F.row_number().over(w.orderBy(ord_)) - 1
    many = F.count("*").over(w) > size
    on = F.when(many, n % size).otherwise(n)
    return rows.select("*", F.when(many, F.floor(n / size)).otherwise(0).cast("long").alias("page"), F.floor(on / cols).cast("long").alias("row"), (on % cols).cast("long").alias("col"))


def overflow_pages(rows: DataFrame, key: str, ord_: str, height: str, room: float) -> DataFrame:
    """What overflows the room goes, the first row always stays."""
    w = W.partitionBy(key).orderBy(ord_)
    used = F.sum(height).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("kept", (used <= room) | (F.row_number().over(w) == 1))


def cursor(rows: DataFrame, key: str, ord_: str, height: str, gap: float, top: float = 0.0) -> DataFrame:
    """W10"""
    w = W.partitionBy(key).orderBy(ord_).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(F.col(height) + gap).over(w), F.lit(0.0)) + top)


def card_height(rows: DataFrame, key: str, height: str, room: float) -> DataFrame:
    """G23"""
    return rows.groupBy(key).agg(F.least(F.greatest(F.max(height), F.lit(1.55)), F.lit(room)).alias("card_height"))


def first_per_region(elements: DataFrame, key: str, width: float) -> DataFrame:
    """Images always; of the others the first of each quarter of the slide."""
    region = C.Rect().region(width)
    first = F.row_number().over(W.partitionBy(key, "region", F.col("type") == "image").orderBy("ord")) == 1
    return elements.withColumn("region", region).withColumn("__first", first).where((F.col("type") == "image") | F.col("__first")).drop("__first")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each occurrence."""
    return rows.withColumn("n", F.count("*").over(W.partitionBy(*keys))).where("n > 1")


def renamed(rows: DataFrame, id_: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The n-th occurrence of an id, from the second on, gets -n."""
    n = F.row_number().over(W.partitionBy(*(by or []), id_).orderBy(*order))
    return rows.withColumn("new_id", F.when(n == 1, F.col(id_).cast("string")).otherwise(F.concat(F.col(id_).cast("string"), F.lit("-"), n)))


def attempts(runs: DataFrame, key: str, order: list[str], accepted: Column) -> DataFrame:
    """A counter over runs, and an acceptance that sticks."""
    w = W.partitionBy(key).orderBy(*order)
    return runs.withColumn("attempt", F.row_number().over(w).cast("long")).withColumn("accepted", F.coalesce(F.last(F.when(accepted, True), ignorenulls=True).over(w), F.lit(False)))


def representatives(slides: DataFrame, key: str, roles: list[str], limit: int = 3) -> DataFrame:
    """The first slide of each preferred role, in the roles' order, then others in document order; `limit` of each key."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, roles)), F.coalesce("role", F.lit(""))), F.lit(0)), F.lit(len(roles) + 1))
    first = F.row_number().over(W.partitionBy(key, "role").orderBy("ord")) == 1
    order = F.when(first, rank).otherwise(len(roles) + 1)
    place = F.row_number().over(W.partitionBy(key).orderBy("__order", "ord"))
    return slides.withColumn("__order", order).withColumn("place", place.cast("long")).where(F.col("place") <= limit).drop("__order")


def ranked(rows: DataFrame, total: str, id_: str, k: int | None = None) -> DataFrame:
    """T01, T04, T06"""
    out = rows.orderBy(F.desc(total), F.asc(id_))
    return out.limit(k) if k else out


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings with the detector that made them."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _box(name: str, inches: bool = False) -> Column:
    return F.struct(*[F.col(f"{'in_' if inches else ''}{c}").alias(c) for c in "xywh"]).alias(name)


def band_candidates(bands: DataFrame) -> DataFrame:
    """A background for each band, and one more for headers, contents and sections. bands (image_id, band from 1, label, x, y,
    w, h, in_x, in_y, in_w, in_h)."""
    id_ = F.concat(F.lit("band-"), "band")
    one = lambda suffix, type_, as_, sure: F.struct(F.concat(id_, F.lit(suffix)).alias("id"), F.lit(type_).alias("type"), F.lit(as_).alias("editable_as"), F.lit(sure).alias("confidence"))
    more = F.when(F.col("label") == "header", one("-title-text", "title-text", "native-text", 0.58)).when(F.col("label").isin("content", "section"), one("-content-group", "content-group", "native-shape", 0.52))
    parts = F.filter(F.array(one("-background", "background-band", "native-shape", 0.72), more), lambda x: x.isNotNull())
    return bands.select("image_id", "band", id_.alias("source_region"), F.posexplode(parts).alias("ord", "c"), _box("pixel_box"), _box("inch_box", True)).select("image_id", "band", "ord", "source_region", "c.*", "pixel_box", "inch_box")


def skeleton(bands: DataFrame, width: float) -> DataFrame:
    """Placeholders of an image's slide: a title for each header, a card with its text for a second band of content, a title at
    its usual place where neither is."""
    r4 = lambda v: C.half_up(v, 4)
    half = (width - 1.6) / 2
    place = lambda id_, type_, x, y, w, h: F.struct(F.lit(id_).alias("id"), F.lit(type_).alias("type"), *[r4(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])
    x, y, w, h = (F.col(f"in_{c}") for c in "xywh")
    title = place("title-placeholder", "text", F.greatest(F.lit(0.7), x + 0.05), y + 0.05, F.least(F.lit(width - 1.4), w - 0.1), F.least(F.lit(0.9), h - 0.1))
    card = [place("card-left-placeholder", "shape", 0.7, y + 0.1, half, F.least(F.lit(2.2), h - 0.2)), place("card-left-text-placeholder", "text", 0.95, y + 0.25, half - 0.4, 0.5)]
    parts = F.when(F.col("label") == "header", F.array(title)).when(F.col("label").isin("content", "section") & (F.col("band") == 2), F.array(*card)).otherwise(F.array().cast("array<struct<id:string,type:string,x:double,y:double,w:double,h:double>>"))
    own = bands.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("band", parts.alias("p")))), lambda b: b["p"])).alias("all"))
    usual = F.array(place("title-placeholder", "text", 0.7, 0.6, 11.8, 0.8))
    return own.select("image_id", F.posexplode(F.when(F.size("all") > 0, F.col("all")).otherwise(usual)).alias("ord", "e")).select("image_id", "ord", "e.*")


#: Colours of a slide whose direction has none.
COLOURS = {"background": "#FFFFFF", "text": "#111827", "primary": "#2563EB", "surface": "#F3F4F6"}


def compiled_slides(specs: DataFrame) -> DataFrame:
    """The elements of each slide specification: (slide_id, ord, id, type, kind, shape, x, y, w, h, text, font_size, bold, color,
    fill, border, layers).

    specs (slide_id, slide_ord, layout_type, intent, main_idea, slots map<string,string>, layers array<struct<label, nodes>>,
    palette map<string,string>, layered boolean). The first slide's headline is larger; `layered` slides get a diagram.
    """
    slot = lambda name, other: F.coalesce(F.try_element_at("slots", F.lit(name)), other)
    tint = lambda name, other=None: F.coalesce(F.try_element_at("palette", F.lit(name)), other if other is not None else F.lit(COLOURS[name]))
    layers = "array<struct<label:string,nodes:array<string>>>"
    fields = {"id": "string", "type": "string", "kind": "string", "shape": "string", "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "font_size": "double", "bold": "boolean", "color": "string", "fill": "string", "border": "string", "layers": layers}

    def one(type_: str, id_: Column, box: tuple, **more: Column) -> Column:
        own = {"type": F.lit(type_), "id": id_} | {k: F.lit(float(v)) for k, v in zip("xywh", box, strict=True)} | more
        return F.struct(*[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])

    text, primary = tint("text"), tint("primary")
    headline = one("text", F.lit("headline"), (0.7, 0.5, 11.8, 0.7), text=slot("headline", F.col("main_idea")), font_size=F.when(F.col("slide_ord") == 0, 38).otherwise(28), bold=F.lit(True), color=text)
    cover = [one("text", F.lit("subtitle"), (0.75, 1.35, 7.2, 0.45), text=slot("subtitle", F.col("intent")), font_size=F.lit(17), color=text), one("shape", F.lit("accent-bar"), (0.75, 6.45, 3.4, 0.08), shape=F.lit("roundRect"), fill=primary, border=primary)]
    plain = [one("text", F.lit("main-idea"), (0.75, 1.25, 5.1, 1.1), text=F.col("main_idea"), font_size=F.lit(16), color=text), one("shape", F.lit("content-panel"), (6.2, 1.25, 6.0, 4.9), shape=F.lit("roundRect"), fill=tint("surface"), border=primary)]
    deep = [one("diagram", F.concat("slide_id", F.lit("-diagram")), (0.8, 1.4, 11.7, 5.2), kind=F.lit("layeredArchitecture"), layers=F.coalesce("layers", F.array().cast(layers)), color=primary), one("text", F.lit("main-idea"), (0.75, 6.7, 11.8, 0.4), text=F.col("main_idea"), font_size=F.lit(12), color=tint("accent", primary))]
    parts = F.when(F.coalesce("layered", F.lit(False)), F.array(headline, *deep)).when(F.col("layout_type") == "cover", F.array(headline, *cover)).otherwise(F.array(headline, *plain))
    return specs.select("slide_id", F.posexplode(parts).alias("ord", "e")).select("slide_id", "ord", "e.*")


#: The three design directions that are offered.
DIRECTIONS = (
    ("direction-001", "Conservative Business", "#F7F9FC", "#FFFFFF", "#1D4ED8", "#14B8A6", "#172033"),
    ("direction-002", "Premium Tech Roadshow", "#07111F", "#101C2E", "#35D0FF", "#7CFFB2", "#E8F1FF"),
    ("direction-003", "Editorial Technical", "#FBFAF7", "#FFFFFF", "#0F766E", "#F59E0B", "#1F2937"),
)


def directions(scorecards: DataFrame) -> DataFrame:
    """The fixed candidates, in order, with each scorecard."""
    fields = ("direction_id", "label", "background", "surface", "primary", "accent", "text")
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, d, strict=True)]) for d in DIRECTIONS])
    return scorecards.select("*", F.inline(rows))


def merged_slides(images: DataFrame, deck: str) -> DataFrame:
    """The images of a deck as its slides, in the order of their files, with new ids; the first design and size hold for all."""
    w = W.partitionBy(deck).orderBy("path")
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return images.select("*", F.concat(C.numbered("slide", F.row_number().over(w)), F.lit("-"), stem).alias("slide_id"), F.first("design").over(w).alias("deck_design"), F.first("size").over(w).alias("deck_size"))
