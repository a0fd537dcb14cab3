"""Incremental secret scanning over content-addressed versions, in DataFrame functions only.

Every historical version of every path is a row. Texts are addressed by their SHA-256 ("blob"); only pairs of blob and rule
version that the ledger lacks are scanned, each blob once however many paths and versions hold it; findings are joined back
to all rows by blob. The grouping by blob keeps one text for each blob and map task before the shuffle. The join back carries
hashes and findings only; rows are dealt by blob and one of `SALTS` numbers that their keys hash to, and the few blobs with
findings are repeated for each, so that the rows of one blob are spread.

Matches are leftmost and non-overlapping per rule; starts and ends are code points. They come from the texts between the
matches (split) and the matches themselves, whose lengths add up to positions.

Defined results: a null text counts as empty and has no findings; the row is kept. Repeated rows give repeated rows; ledger rows
of one blob and rule version count once. A blob that the ledger has not seen has null findings, one without secrets has an empty
array. An empty table gives an empty table. Extra columns are ignored (`redact` keeps them, whatever their names). Findings at one
place under several rules are all kept, in the order of start, then of the rules. Very long texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_VERSION, SALTS = "1", 16


@dataclass(frozen=True)
class Rule:
    """`hint`: strings (lower case) of which a text with a match contains one; `least`: code points that group `sized` needs."""

    name: str
    pattern: str
    base: bool = False
    hints: tuple[str, ...] = ()
    fold: bool = False
    sized: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules as they are defined, in their order; the others are the method's own.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, True, ("passw", "secret", "token", "api"), True, 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", True, ("AKIA",)),
    Rule("hex", "[0-9a-f]{32,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY",)),
)
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end) of one rule's matches."""
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.sized)) if rule.sized else found
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("own"), F.transform(sized, lambda x: F.length(x)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["own"]
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(x["part"] >= rule.least, F.array(one)).otherwise(none)).alias("out"))

    out = F.aggregate(steps, start, step, lambda acc: acc["out"])
    where = F.lit(True)
    if rule.hints:
        seen = F.lower(text) if rule.fold else text
        where = F.lit(False)
        for hint in rule.hints:
            where = where | seen.contains(hint)
    return F.when(where & text.rlike(rule.pattern), out).otherwise(none)


def scan(blobs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `findings`, sorted by start, then rule."""
    return blobs.withColumn("findings", F.array_sort(F.flatten(F.array(*[spans(F.col(text), rule, n) for n, rule in enumerate(rules)]))))


def addressed(versions: DataFrame, text_col: str = "text") -> Column:
    return F.sha2(F.coalesce(versions[text_col].cast("string"), F.lit("")).cast("binary"), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(blob, rule_version, text): one row for each blob that the ledger has not seen under this rule version."""
    rows = versions.select(addressed(versions, text_col).alias("blob"), F.coalesce(versions[text_col].cast("string"), F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        rows = rows.join(known, "blob", "left_anti")
    return rows.groupBy("blob").agg(F.any_value("text").alias("text")).select("blob", F.lit(rule_version).alias("rule_version"), "text")


def ledger_entries(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """What to append to the ledger: (blob, rule_version, findings), blobs without findings included, as they count as seen."""
    return scan(unseen(versions, ledger, text_col, rule_version), rules=rules).select("blob", "rule_version", "findings")


def _salted(rows: DataFrame, salt: Column, found: DataFrame) -> DataFrame:
    """rows (with their blob) and `findings` of theirs; found: (blob, findings), one row for each blob."""
    dealt = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
    every = found.select(F.col("blob").alias("own"), "findings", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("own_salt"))
    return dealt.join(every, (F.col("blob") == F.col("own")) & (F.col("salt") == F.col("own_salt")), "left").drop("own", "own_salt", "salt")


def join_back(versions: DataFrame, ledger: DataFrame, keys: list[str], text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The findings of every version of every path: `keys`, blob, findings (null if the ledger has not seen the blob)."""
    rows = versions.select(F.struct(*keys).alias("key"), addressed(versions, text_col).alias("blob"))
    own = ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.max("findings").alias("findings"))
    out = _salted(rows, F.xxhash64("key"), own)
    return out.select("key.*", "blob", "findings")


def written(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A run with an empty ledger, as one row of counts and spans for each document. Here no blob is unseen, so those without
    findings needn't be joined."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = join_back(rows, ledger_entries(rows).where(F.size("findings") > 0), ["doc_id"])
    found = found.withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")))
    bases = [n for n, r in enumerate(RULES) if r.base]
    base = F.filter("findings", lambda x: x["rank"].isin(bases))
    count = lambda n: F.size(F.filter("findings", lambda x: x["rank"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{RULES[n].name}") for n in bases], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))


def redacted(text: Column, findings: Column) -> Column:
    """The text with every stretch that findings cover replaced by [SECRET]; overlapping findings make one stretch."""
    joined = F.aggregate(
        findings,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(joined, start, lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[SECRET]")).alias("out")), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(findings) > 0, cut).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced in the text; null texts stay null. Each blob is scanned once; only findings
    are joined, and rows are cut by their own text."""
    plain = [docs[c] for c, kind in docs.dtypes if c != text_col and "map<" not in kind] or [F.lit(0)]  # maps have no hash
    rows = docs.select(F.struct("*").alias("row"), addressed(docs, text_col).alias("blob"), F.xxhash64(*plain).alias("spread"))
    found = scan(unseen(docs, None, text_col)).where(F.size("findings") > 0).select("blob", "findings")
    out = _salted(rows, F.col("spread"), found)
    text = F.col("row")[text_col].cast("string")
    clean = F.when(F.col("findings").isNull(), text).otherwise(redacted(text, F.col("findings")))
    return out.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
