"""Writers of reports and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import marks


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON with all keys in order, at every depth; arrays keep their order."""
    return df.select(C.sorted_json(F.struct("*"), df.schema).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """K06"""
    json_lines(df).write.mode("overwrite").text(path)


#: The report's sections, in order.
SECTIONS = ("inputSource", "editabilityLevel", "coordinateDriftPx", "fontFallback", "paletteMatch", "rasterizedRegions", "layoutSafety", "editabilityFloor", "slopRisk", "previewDiff")
NOT_MEASURED = "_not measured_"
REPORT = {
    "input_type": "string", "input_source": "string", "level": "bigint", "n_slides": "bigint", "drift": "double", "palette": "double", "safety": "string", "floor": "bigint", "pipeline_causes": "array<string>", "source_causes": "array<string>", "slop": "bigint",
    "fonts": "array<struct<element:string,requested:string,fallback:string>>", "rasterized": "array<struct<slide:string,element:string,share:double,reason:string,recoverable:boolean>>", "signals": "array<struct<id:string,weight:bigint,count:bigint>>",
    "preview_status": "string", "preview_slides": "bigint",
}


def markdown(reports: DataFrame, key: str) -> DataFrame:
    """One text for each report: a summary, then the ten sections in their order. Columns as in REPORT; what a table lacks, or
    what is null, is not measured. A key that comes twice gives two texts."""
    r = reports.select("*", *[F.lit(None).cast(t).alias(c) for c, t in REPORT.items() if c not in reports.columns])
    lines = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else F.coalesce(v.cast("string"), F.lit("")) for v in x])
    c = F.col
    measured = lambda v, line: F.when(v.isNull(), lines(NOT_MEASURED)).otherwise(lines(line))
    full = lambda v: F.coalesce(F.size(v) > 0, F.lit(False))
    number = lambda v: marks.shown(v)
    floor = F.array_compact(F.array(said("- Floor level: ", F.coalesce("floor", "level")), F.when(~full("pipeline_causes") & ~full("source_causes"), "- No floor violations."), F.when(full("pipeline_causes"), said("- Pipeline-causal: ", F.array_join("pipeline_causes", ", "))), F.when(full("source_causes"), said("- Source-causal: ", F.array_join("source_causes", ", ")))))
    signals = F.transform(F.filter(F.coalesce("signals", F.array().cast(REPORT["signals"])), lambda s: s["weight"] > 0), lambda s: said("- ", s["id"], ": weight ", s["weight"], ", count ", s["count"]))
    region = lambda x: said("- ", x["slide"], "/", x["element"], ": ", F.format_string("%.1f", x["share"] * 100), "% — ", x["reason"], F.when(x["recoverable"], " (recoverable)").otherwise(""))
    bodies = {
        "inputSource": lines(said("- Input type: ", c("input_type")), said("- Input source: ", c("input_source"))),
        "editabilityLevel": lines(said("- Editability level: ", c("level"))),
        "coordinateDriftPx": measured(c("drift"), said("- Average drift: ", number(c("drift")), " px")),
        "fontFallback": F.when(full("fonts"), F.transform("fonts", lambda x: said("- ", x["element"], ": ", x["requested"], " -> ", x["fallback"]))).otherwise(lines("- No font fallbacks detected.")),
        "paletteMatch": measured(c("palette"), said("- Average palette match: ", number(c("palette")))),
        "rasterizedRegions": F.when(full("rasterized"), F.transform("rasterized", region)).otherwise(lines("- No rasterized regions.")),
        "layoutSafety": measured(c("safety"), said("- Layout safety: ", c("safety"))),
        "editabilityFloor": floor,
        "slopRisk": F.when(c("slop").isNull(), lines(NOT_MEASURED)).otherwise(F.concat(lines(said("- slopRisk: ", c("slop"), "/100 (0 = clean, 100 = pure slop)")), signals)),
        "previewDiff": F.when(F.coalesce("preview_status", F.lit("deferred")) == "deferred", lines("- Preview diff deferred (LibreOffice not available).")).when(F.coalesce("preview_slides", F.lit(0)) == 0, lines("- Preview diff ok; no per-slide data.")).otherwise(lines(said("- Preview diff ok across ", c("preview_slides"), " slides."))),
    }
    head = F.array_compact(F.array(F.lit("# Consistency Report"), F.lit(""), F.lit("## Summary"), F.lit(""), said("- Input type: ", c("input_type")), said("- Input source: ", c("input_source")), said("- Editability: Level ", c("level")), F.when(c("n_slides").isNotNull(), said("- Slide count: ", c("n_slides"))), F.lit("")))
    parts = [F.concat(lines(f"## {s}", ""), bodies[s], lines("")) for s in SECTIONS]
    return r.select(key, F.array_join(F.concat(head, *parts), "\n").alias("report"))


def package_index(files: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Sorted files and missing required names. files (key, name), required (name)."""
    have = files.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("files"))
    need = required.agg(F.array_sort(F.collect_set("name")).alias("need"))
    return have.crossJoin(F.broadcast(need)).select(key, "files", F.array_except("need", "files").alias("missing"))


def run_index(files: DataFrame, key: str, final: str = "deck.pptx") -> DataFrame:
    """Which artefacts a run has; ready if and only if the final one is there."""
    has = lambda name: F.max(F.when(F.col("name") == name, F.col("path")))
    return files.groupBy(key).agg(has("deck.manifest.json").alias("manifest"), has("preview.png").alias("preview"), has(final).alias("final"), F.when(has(final).isNotNull(), "ready").otherwise("draft").alias("status"))


def blocked_summary(summary: DataFrame, path: str, hard: bool = True) -> int:
    """Writes what is blocked, with status and cause, and raises if the gate is hard; else says how many."""
    blocked = summary.where("blocked").withColumns({"status": F.lit("blocked"), "blockedBy": F.lit("layout-safety")})
    n = blocked.count()
    if n:
        write_json(blocked, path)
        if hard:
            raise ValueError(f"blocked at layout-safety: {n}")
    return n
