"""Joins that look things up: nearest tokens, containment, merges, set differences, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only what the planner's statistics say is small, without running a job; beyond that the planner chooses."""
    return F.broadcast(df) if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most else df


def nearest_token(items: DataFrame, tokens: DataFrame, by: str, threshold: float = 8.0) -> DataFrame:
    """The token with the least colour distance, the first of equals. tokens (ord, token, hex) are few.

    Colours are matched once for each distinct one, then joined back.
    """
    point = tokens.select("ord", "token", C.lab(F.col("hex")).alias("q"))
    colours = items.select(by).where(F.col(by).isNotNull()).distinct().select(by, C.lab(F.col(by)).alias("p"))
    best = colours.crossJoin(small(point)).groupBy(by).agg(F.min(F.struct(C.delta_e(F.col("p"), F.col("q")).alias("delta"), "ord", "token")).alias("m"))
    near = best.select(by, "m.token", "m.delta", (F.col("m.delta") <= threshold).alias("matched"))
    return items.join(near, by, "left")


def exact_token(items: DataFrame, tokens: DataFrame, by: str) -> DataFrame:
    """Of tokens with one colour the last wins."""
    return items.join(tokens.groupBy("hex").agg(F.max_by("token", "ord").alias("exact")).withColumnRenamed("hex", by), by, "left")


def deref(rows: DataFrame, col: str, tokens: DataFrame, strict: bool = False) -> DataFrame:
    """Adds `resolved`. Lenient: an unknown path stays as it is; strict: it raises."""
    path = F.nullif(F.regexp_extract(F.trim(F.col(col)), r"^\{([^{}]+)\}$", 1), F.lit(""))
    out = rows.withColumn("__path", path).join(tokens.select(F.col("path").alias("__path"), F.col("value").alias("__value")), "__path", "left")
    missing = F.raise_error(F.concat(F.lit("unknown token "), "__path")).cast("string") if strict else F.col(col)
    return out.withColumn("resolved", F.when(F.col("__path").isNull(), F.col(col)).when(F.col("__value").isNull(), missing).otherwise(F.col("__value"))).drop("__path", "__value")


def dangling(rows: DataFrame, col: str, tokens: DataFrame) -> DataFrame:
    """References without a token."""
    refs = rows.withColumn("path", F.explode(F.regexp_extract_all(F.col(col), F.lit(r"\{([^{}]+)\}"), F.lit(1))))
    return refs.join(tokens.select("path").distinct(), "path", "left_anti")


def merge_measured(elements: DataFrame, measured: DataFrame, key: list[str]) -> DataFrame:
    """X, y, w, h replaced where all four measured values are finite; of duplicate measurements the last wins."""
    last = measured.groupBy(*key).agg(F.max_by(F.struct(*"xywh"), "ord").alias("m"))
    ok = F.lit(True)
    for c in "xywh":
        v = F.col(f"m.{c}")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = elements.join(last, key, "left")
    return out.select(*[F.when(ok, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) if c in "xywh" else F.col(c) for c in elements.columns])


def block_candidates(blocks: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The first candidate that contains a block's centre, else the nearest centre, the first of equals."""
    b, c = blocks.alias("b"), candidates.alias("c")
    cx, cy, r = F.col("b.x") + F.col("b.w") / 2, F.col("b.y") + F.col("b.h") / 2, C.Rect("c")
    inside = (cx >= r.x) & (cx <= r.right) & (cy >= r.y) & (cy <= r.bottom)
    dx, dy = cx - (r.x + r.w / 2), cy - (r.y + r.h / 2)
    rank = F.struct((~inside).alias("out"), F.when(inside, F.lit(0.0)).otherwise(dx * dx + dy * dy).alias("far"), F.col("c.ord").alias("ord"))
    joined = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "left")
    return joined.groupBy(F.col(f"b.{key}").alias(key), F.col("b.ord").alias("block")).agg(F.min(F.when(F.col("c.ord").isNotNull(), rank)).alias("m")).select(key, "block", F.col("m.ord").alias("candidate"), (~F.col("m.out")).alias("contained"))


def first_decision(candidates: DataFrame, decisions: DataFrame, key: list[str], kind: str = "kind", default: str = "cropped") -> DataFrame:
    """The first decision of each candidate; none: the default."""
    first = decisions.groupBy(*key).agg(F.min_by(kind, "decision_ord").alias("__kind"))
    return candidates.join(first, key, "left").withColumn(kind, F.coalesce("__kind", F.lit(default))).drop("__kind")


def resolve_assets(elements: DataFrame, assets: DataFrame, last_wins: bool = True) -> DataFrame:
    """Adds `src` and `missing`; the validator lets the last duplicate win, the renderer the first."""
    pick = F.max_by if last_wins else F.min_by
    one = assets.groupBy("asset_id").agg(pick("src", "ord").alias("src"))
    return elements.join(one, "asset_id", "left").withColumn("missing", F.col("asset_id").isNotNull() & F.col("src").isNull())


def uncovered(blocks: DataFrame, texts: DataFrame, block_id: str) -> DataFrame:
    """Blocks (id, text) that no text contains, after white space is normalised.

    Blocks of five words or more share their second to fourth word with every text that contains them. That shingle is the join
    key; it goes with the text's hash, and only texts with a wanted shingle are read again and compared (a text with another's hash
    is compared in vain, no more). Shorter blocks are compared with all texts.
    """
    b = blocks.select(block_id, C.normal_space(F.col("text")).alias("block")).where("block <> ''")
    words = F.split("block", " ")
    keyed = b.withColumn("shingle", F.when(F.size(words) >= 5, F.xxhash64(*[F.xxhash64(F.get(words, F.lit(k))) for k in (1, 2, 3)])))
    t = texts.select(C.normal_space(F.col("text")).alias("body")).withColumn("__t", F.xxhash64("body"))
    own = t.select("__t", F.transform(F.split("body", " "), lambda w: F.xxhash64(w)).alias("own"))  # a column: inside the function below, the split would be repeated
    rest = lambda k: F.slice("own", k + 1, F.greatest(F.size("own") - k, F.lit(0)))
    three = F.transform(F.arrays_zip(F.col("own").alias("a"), rest(1).alias("b"), rest(2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    shingles = own.select("__t", F.explode(three).alias("shingle"))
    wanted = small(keyed.where("shingle is not null"))
    pairs = shingles.join(wanted.select("shingle", block_id, "block"), "shingle").select("__t", block_id, "block").distinct()
    hit = t.join(pairs, "__t").where(F.contains("body", "block")).select(block_id)
    short = keyed.where("shingle is null")
    hit = hit.union(t.join(small(short), F.contains("body", "block")).select(block_id))
    return b.select(block_id).join(hit.distinct(), block_id, "left_anti")


def missing_slots(required: DataFrame, provided: DataFrame, key: list[str]) -> DataFrame:
    """J12, U03"""
    return required.select(*key).distinct().join(provided.select(*key).distinct(), key, "left_anti")


def with_presence(referenced: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Adds `available`."""
    return referenced.join(available.select(key).distinct().withColumn("__there", F.lit(True)), key, "left").withColumn("available", F.coalesce("__there", F.lit(False))).drop("__there")


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """J14"""
    return rows.join(known.select(key), key, "left_semi")


def first_match(left: DataFrame, right: DataFrame, key: str, ord_: str = "ord", last: bool = False) -> DataFrame:
    """One right row for each key, the first or last in order."""
    cols = [c for c in right.columns if c != key]
    pick = F.max_by if last else F.min_by
    return left.join(right.groupBy(key).agg(pick(F.struct(*cols), ord_).alias("__r")), key, "left").select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in cols if c not in left.columns])


def overridden(computed: DataFrame, external: DataFrame, key: str, value: str) -> DataFrame:
    """J16"""
    return computed.join(external.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def zipped(reference: DataFrame, candidate: DataFrame, order: str, key: list[str] | None = None) -> DataFrame:
    """Rows of equal rank; ranks are counted inside `key`."""
    w = W.partitionBy(*(key or [])).orderBy(order)
    a, b = (df.select("*", F.row_number().over(w).alias("rank")) for df in (reference, candidate))
    return a.alias("a").join(b.alias("b"), [*(key or []), "rank"])


def hybrid_merge(measured: DataFrame, auto: DataFrame, key: str) -> DataFrame:
    """Measured elements, and automatic ones that are not measured; with where the cursor starts."""
    rest = auto.join(measured.select(key), key, "left_anti")
    cursor = F.greatest(F.lit(0.55), F.coalesce(F.max(F.when(F.col("measured"), F.col("y") + F.col("h"))).over(W.partitionBy("slide")), F.lit(0.0))) + 0.15
    return measured.withColumn("measured", F.lit(True)).unionByName(rest.withColumn("measured", F.lit(False))).withColumn("cursor", cursor)


def agreement(scores: DataFrame, annotations: DataFrame, key: str, band: float = 20) -> DataFrame:
    """J21"""
    return scores.join(annotations, key).withColumn("within", F.abs(F.col("score") - F.col("expected")) <= band)


# Fixed values of the repair rules.
SPACING = {"spacing.xs": 0.125, "spacing.sm": 0.25, "spacing.md": 0.5, "spacing.lg": 1.0, "spacing.xl": 1.5}
DEFAULT_STYLE = {"font-too-small": ("updateStyle", "fontSize", "12"), "line-height-too-tight": ("adjustStyle", "lineHeight", "1.4"), "letter-spacing-too-tight": ("adjustStyle", "letterSpacing", "0"), "contrast-fail": ("adjustStyle", "color", "#000000")}
OPERATIONS = ("move", "resize", "updateStyle", "updateText", "removeElement", "increaseSpacing", "reduceDensity", "adjustStyle")
CHANGES = "struct<x:double,y:double,w:double,h:double,text:string,padding:string,inches:double,style:map<string,string>,suggestion_kind:string>"


def spacing_inches(token: Column) -> Column:
    """A named spacing, else the number that the text begins with, else half an inch."""
    named = F.element_at(F.create_map(*[F.lit(x) for pair in SPACING.items() for x in pair]), token)
    return F.coalesce(named, F.regexp_extract(token, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.5))


def overlaid(had: Column, new: Column) -> Column:
    """A map with another's entries before its own."""
    return F.map_concat(F.map_filter(had, lambda k, _: ~F.map_contains_key(new, k)), new)


def patches_for(checks: DataFrame) -> DataFrame:
    """A check (element_id, kind, suggestion struct<x, y, w, h>) gives none, one or two patches (operation, changes).

    Bounds and connectors move and resize to what is suggested, if anything is; overlaps and unknown kinds have no patch. `padding`
    and `style`, where the table has them, are suggestions that go before the defaults.
    """
    kind, s = F.col("kind"), F.col("suggestion")
    padding = F.coalesce("padding", F.lit("spacing.md")) if "padding" in checks.columns else F.lit("spacing.md")

    def patch(operation: str, **changes: Column) -> Column:
        fields = [x.split(":")[0] for x in CHANGES.replace("map<string,string>", "map")[7:-1].split(",")]
        kinds = {"text": "string", "padding": "string", "style": "map<string,string>", "suggestion_kind": "string"}
        return F.struct(F.lit(operation).alias("operation"), F.struct(*[changes.get(f, F.lit(None)).cast(kinds.get(f, "double")).alias(f) for f in fields]).alias("changes"))

    placed = kind.isin("bounds", "connector-detached")
    found = [
        F.when(placed & (s["x"].isNotNull() | s["y"].isNotNull()), patch("move", x=s["x"], y=s["y"])),
        F.when(placed & (s["w"].isNotNull() | s["h"].isNotNull()), patch("resize", w=s["w"], h=s["h"])),
        F.when(kind == "card-spacing-tight", patch("increaseSpacing", padding=padding, inches=spacing_inches(padding), suggestion_kind=kind)),
        F.when(kind == "text-overflow", patch("reduceDensity", suggestion_kind=kind)),
    ]
    for name, (operation, key, value) in DEFAULT_STYLE.items():
        style = F.create_map(F.lit(key), F.lit(value))
        if "style" in checks.columns and operation == "adjustStyle":
            given = F.coalesce("style", F.create_map().cast("map<string,string>"))
            style = overlaid(style, given)
        found.append(F.when(kind == name, patch(operation, style=style, suggestion_kind=kind)))
    rows = checks.where(F.coalesce("element_id", F.lit("")) != "")
    return rows.select("*", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def apply_patches(elements: DataFrame, patches: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(patched elements, patches that can't be applied, with `error`). Elements have x, y, w, h, and text and style
    (map<string,string>) where these are patched; patches (key, patch_ord, operation, changes struct of what they change).

    Patches fold in order: moves and resizes set what they give, styles are merged key by key (`style` of the changes, for both
    style operations), padding only grows, and nothing can be done to an element after it was removed.
    """
    own = [c for c in (*"xywh", "text", "style") if c in elements.columns]
    known = set(patches.schema["changes"].dataType.fieldNames())
    kinds = {c: "double" for c in "xywh"} | {"text": "string", "padding": "string", "style": "map<string,string>"}
    changes = F.struct(*[(F.col("changes")[c] if c in known else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    first = lambda a, b: F.when(a["patch_ord"] < b["patch_ord"], -1).when(a["patch_ord"] > b["patch_ord"], 1).otherwise(0)
    folded = patches.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("patch_ord", "operation", changes.alias("c"))), first).alias("steps"))
    steps = F.coalesce("steps", F.array().cast(folded.schema["steps"].dataType))
    blank = F.create_map().cast("map<string,string>")

    def step(acc: Column, p: Column) -> Column:
        c, op = p["c"], p["operation"]
        live = ~acc["gone"]
        out = []
        for name in own:
            at = acc[name]
            if name in "xywh":
                out.append(F.when(live & (op == ("move" if name in "xy" else "resize")), F.coalesce(c[name], at)).otherwise(at).alias(name))
            elif name == "text":
                out.append(F.when(live & (op == "updateText"), F.coalesce(c["text"], at)).otherwise(at).alias(name))
            else:
                had, new = F.coalesce(at, blank), F.coalesce(c["style"], blank)
                merged = overlaid(had, new)
                pad = F.greatest(F.coalesce(F.try_element_at(had, F.lit("padding")).try_cast("double"), F.lit(0.0)), F.coalesce(F.regexp_extract(c["padding"], r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.5)))
                padded = F.map_concat(F.map_filter(had, lambda k, _: k != "padding"), F.create_map(F.lit("padding"), pad.cast("string")))
                out.append(F.when(live & op.isin("updateStyle", "adjustStyle"), merged).when(live & (op == "increaseSpacing"), padded).otherwise(at).alias(name))
        return F.struct(*out, (acc["gone"] | (op == "removeElement")).alias("gone"))

    joined = elements.join(folded, key, "left")
    begin = F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in own], F.lit(False).alias("gone"))
    done = joined.withColumn("steps", F.aggregate(steps, begin, step))
    new = done.where("not steps.gone").select(*[F.col(f"steps.{c}").alias(c) if c in own else F.col(c) for c in elements.columns])

    there = elements.select(*key).distinct().withColumn("there", F.lit(True))
    before = F.max(F.when(F.col("operation") == "removeElement", 1).otherwise(0)).over(W.partitionBy(*key).orderBy("patch_ord").rowsBetween(W.unboundedPreceding, -1))
    judged = patches.join(there, key, "left").withColumn("removed", F.coalesce(before, F.lit(0)) > 0)
    error = F.when(~F.col("operation").isin(*OPERATIONS) | F.col("operation").isNull(), "unsupported operation").when(F.col("there").isNull(), "missing element").when(F.col("removed"), "removed before")
    if "text" in known:
        error = error.when((F.col("operation") == "updateText") & F.col("changes.text").isNull(), "updateText requires a text")
    return new, judged.withColumn("error", error).where("error is not null").drop("there", "removed")


def sequential(col: str, order: list[Column], by: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))
