"""JSON-schema subset as Column predicates (F10), assertions (F13, F15, I03) and the bounded repair loop."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"string": ("string",), "number": ("double", "float", "bigint", "int", "decimal"), "integer": ("bigint", "int", "double"), "boolean": ("boolean",), "array": ("array",), "object": ("struct", "map")}


def compiled(schema: dict[str, Any], value: Column, kind: Any, path: str = "$") -> list[tuple[str, Column]]:
    """(path and rule, predicate that is true where it is broken). `kind`: the Spark type of the value. Absent is null."""
    out: list[tuple[str, Column]] = []
    there = value.isNotNull()
    name = kind.typeName()
    add = lambda rule, broken: out.append((f"{path}: {rule}", there & broken))
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = any(name in [*TYPES.get(t, ()), *(["long", "integer"] if t in ("number", "integer") else [])] for t in wanted)
        if not fits:
            add("type", F.lit(True))
        elif wanted == ["integer"] and name in ("double", "float"):
            add("type", value != F.floor(value))
    if "enum" in schema:
        add("enum", ~value.isin(*schema["enum"]))
    if "const" in schema:
        add("const", value != F.lit(schema["const"]))
    if name == "string":
        if "minLength" in schema:
            add("minLength", F.length(value) < schema["minLength"])
        if "pattern" in schema:
            add("pattern", ~value.rlike(schema["pattern"]))
        if schema.get("format") == "date-time":
            add("format", F.try_to_timestamp(value).isNull())
    for rule, broken in (("minimum", lambda v: value < v), ("maximum", lambda v: value > v), ("exclusiveMinimum", lambda v: value <= v)):
        if rule in schema:
            add(rule, broken(schema[rule]))
    if name == "array":
        if "minItems" in schema:
            add("minItems", F.size(value) < schema["minItems"])
        if "items" in schema:
            for rule, _ in compiled(schema["items"], F.lit(None).cast(kind.elementType), kind.elementType, f"{path}[]"):
                add(rule, F.exists(value, lambda x, rule=rule: F.coalesce(dict(compiled(schema["items"], x, kind.elementType, f"{path}[]"))[rule], F.lit(False))))
    if name == "struct":
        own = {f.name: f.dataType for f in kind.fields}
        for field in schema.get("required", []):
            out.append((f"{path}.{field}: required", there & (value[field].isNull() if field in own else F.lit(True))))
        for field, sub in schema.get("properties", {}).items():
            if field in own:
                out += [(r, there & b) for r, b in compiled(sub, value[field], own[field], f"{path}.{field}")]
        if schema.get("additionalProperties") is False:
            for field in own:
                if field not in schema.get("properties", {}):
                    out.append((f"{path}.{field}: additional", there & value[field].isNotNull()))

    def broken(sub: dict[str, Any]) -> Column:
        rules = compiled(sub, value, kind, path)
        return F.coalesce(any_of([b for _, b in rules]), F.lit(False))

    for sub in schema.get("allOf", []):
        out += compiled(sub, value, kind, path)
    if "anyOf" in schema:
        bad = F.lit(True)
        for sub in schema["anyOf"]:
            bad = bad & broken(sub)
        add("anyOf", bad)
    if "not" in schema:
        add("not", ~broken(schema["not"]))
    if "if" in schema:
        holds = ~broken(schema["if"])
        for branch, on in (("then", holds), ("else", ~holds)):
            if branch in schema:
                out += [(r, on & b) for r, b in compiled(schema[branch], value, kind, path)]
    return out


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def violations(df: DataFrame, schema: dict[str, Any], col: str) -> DataFrame:
    """Adds `violations`, the broken rules in the schema's order. The schema is compiled once, on the driver."""
    rules = compiled(schema, F.col(col), df.schema[col].dataType)
    found = F.array(*[F.when(b, F.lit(r)) for r, b in rules]) if rules else F.array().cast("array<string>")
    return df.withColumn("violations", F.filter(found, lambda x: x.isNotNull()))


def gate(checks: DataFrame, strict: bool = True) -> dict[str, int | bool]:
    """Counts one row on the driver; raises if strict and anything is critical."""
    n = checks.agg(F.count_if(F.col("severity") == "critical")).first()[0]
    if n and strict:
        raise ValueError(f"{n} critical findings")
    return {"critical": n, "blocked": bool(n)}


def coverage_gate(found: DataFrame, total: int) -> float:
    """the share of covered blocks must be 1; found: the uncovered ones."""
    missing = found.count()
    share = 1.0 if not total else int((1 - missing / total) * 10_000 + 0.5) / 10_000
    if missing:
        raise ValueError(f"coverage {share}: {missing} blocks are missing")
    return share


def repair_loop(elements: DataFrame, audit: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame, DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, int, int]:
    """Audits and repairs until nothing is critical or repairable, `most` times. Each pass is cut by checkpoint().

    Returns (elements, passes, critical findings left)."""
    for n in range(most + 1):
        checks = audit(elements)
        left, fixable = checks.agg(F.count_if(F.col("severity") == "critical"), F.count_if(F.col("repairable"))).first()
        if not left or not fixable or n == most:
            return elements, n, left
        elements = repair(elements, checks).checkpoint()
    return elements, most, left
