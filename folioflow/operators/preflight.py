"""The layout-safety plan: all checks of a deck's elements in one table of findings, for the creative and the replica mode.

`elements` have the slide's keys, `ord`, and the columns of COLUMNS; those a table lacks are null. Charts and diagrams are to be
flattened before (marks.flattened). Rules on one element are one array expression, so they take one scan; overlaps, card spacing and
connectors join on the slide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .checks import connectors, overlap_pairs, spacing_pairs

COLUMNS = {
    "id": "string", "type": "string", "role": "string", "x": "double", "y": "double", "w": "double", "h": "double", "text": "string", "typography": "string", "font_size": "double", "line_height": "double", "letter_spacing": "double",
    "bold": "boolean", "italic": "boolean", "color": "string", "background": "string", "component": "string", "source_id": "string", "target_id": "string", "typography_size": "double", "typography_line_height": "double",
}
#: Names of the checks inside, and in reports; any other is reported as bounds.
KINDS = {"bounds": "bounds", "overlap": "overlap", "font-size": "font-too-small", "line-height-too-tight": "line-height-too-tight", "text-overflow": "text-overflow", "card-spacing-tight": "card-spacing-tight", "connector-detached": "connector-detached", "contrast-fail": "contrast-fail", "letter-spacing-too-tight": "letter-spacing-too-tight"}


def complete(elements: DataFrame) -> DataFrame:
    return elements.select("*", *[F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c not in elements.columns])


def severity(value: Column, rules: dict[str, tuple[float, float]], role: Column) -> Column:
    """Of a role's two thresholds (body's for roles without any); null where neither is missed."""
    of = lambda k: reduce(lambda out, r: F.when(role == r[0], r[1][k]).otherwise(out), rules.items(), F.lit(rules["body"][k]))
    return F.when(value < of(0), "critical").when(value < of(1), "warning")


def own_checks(mode: str, width: float = C.SLIDE_W, height: float = C.SLIDE_H) -> Column:
    """Array of (kind, severity) of one element."""
    c = F.col
    text, line = c("type") == "text", c("type") == "line"
    role = C.layout_role(c("role"), c("typography"), c("id"), c("font_size"))
    size = F.coalesce("font_size", "typography_size", F.lit(16.0))
    spacing = F.coalesce("line_height", "typography_line_height")
    over = text & C.text_overflows(F.coalesce("text", F.lit("")), size, c("w"), c("h"), F.coalesce("bold", F.lit(False)), F.coalesce("italic", F.lit(False)), F.coalesce(spacing, F.lit(1.2)))
    found = [("bounds", F.when(C.Rect().outside(width, height, line=line), "critical"))]
    if mode == "replica":  # I02: a faithful copy is held against its bounds only
        found.append(("text-overflow", F.when(over, "warning")))
    else:
        found += [
            ("font-size", F.when(text, severity(size, C.FONT_SIZE_RULES, role))),
            ("line-height-too-tight", F.when(text, severity(spacing, C.LINE_HEIGHT_RULES, role))),
            ("text-overflow", F.when(over, "critical")),
            ("contrast-fail", F.when(text, severity(C.contrast(C.hex_colour(c("color")), C.hex_colour(c("background"))), C.CONTRAST_RULES, role))),
            ("letter-spacing-too-tight", F.when(text & role.isin("body", "caption") & (c("letter_spacing") < F.when(c("text").rlike(C.CJK), -0.02).otherwise(-0.01)), "warning")),
        ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("type"), s.alias("severity")) for k, s in found]), lambda x: x["severity"].isNotNull())


def preflight(elements: DataFrame, keys: list[str], mode: str = "creative", spacing: float = 0.5, width: float = C.SLIDE_W, height: float = C.SLIDE_H) -> DataFrame:
    """(keys, ord, element_id, related_element_id, kind, severity, suggestion). F05, I02, P30, U01."""
    if mode not in ("creative", "replica"):
        raise ValueError(f"unknown mode {mode}")
    e = complete(elements)
    none = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("suggestion")
    out = e.select(*keys, "ord", F.col("id").alias("element_id"), F.lit(None).cast("string").alias("related_element_id"), none, F.explode(own_checks(mode, width, height)).alias("c")).select(*keys, "ord", "element_id", "related_element_id", "c.type", "c.severity", "suggestion")
    if mode == "creative":
        row = lambda df, kind, level: df.select(*keys, F.col("a_ord").alias("ord"), F.col("a_id").alias("element_id"), F.col("b_id").alias("related_element_id"), F.lit(kind).alias("type"), F.lit(level).alias("severity"), none)
        out = out.unionByName(row(overlap_pairs(e, keys), "overlap", "critical")).unionByName(row(spacing_pairs(e, keys, spacing), "card-spacing-tight", "warning"))
        bad = connectors(e, keys).where("severity is not null")
        out = out.unionByName(bad.select(*keys, "ord", F.col("id").alias("element_id"), F.col("related").alias("related_element_id"), F.lit("connector-detached").alias("type"), "severity", "suggestion"))
    return out.select(*keys, "ord", "element_id", F.nullif("related_element_id", F.lit("")).alias("related_element_id"), C.mapped(F.col("type"), KINDS, "bounds").alias("kind"), "severity", "suggestion")
