"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bloom_lm,
    bpe_transducer,
    importance_resampling,
    media_avi,
    phrase_automata,
    qgram_decontam,
    rendezvous_shards,
    secret_ledger,
    simhash_neardup,
    suffix_dedup,
)
from .common import table


def op1_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_digest(table(spark, sf_dir, "documents"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.digest(table(spark, sf_dir, "documents"))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digest(table(spark, sf_dir, "documents"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous_shards.digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op8_qgram_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.digest(table(spark, sf_dir, "documents"))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.removed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_media_avi, op2_secret_ledger, op3_bloom_lm, op4_importance_resampling, op5_bpe_transducer, op6_rendezvous_shards, op7_suffix_dedup, op8_qgram_decontam, op9_simhash_neardup, op10_phrase_automata)
    return {f.__name__: f for f in found}


def _spans_sql(rule: secret_ledger.Rule, rank: int) -> str:
    """Rows (doc_id, s, rank, kind, e, n): matches of one rule, whose places add up from the texts between them; n: the length that
    counts."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, list_sum(list_transform(parts[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS s, {rank} AS rank, '{rule.name}' AS kind, length(found[i]) AS own, length(sized[i]) AS n FROM (
  SELECT doc_id, parts, found, sized, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {rule.sized}) AS sized FROM d))
  WHERE length(sized[i]) >= {rule.least}"""


def _ledger_sql() -> str:
    rules = secret_ledger.RULES
    bases = [r for r in rules if r.base]
    every = " UNION ALL ".join(_spans_sql(r, n) for n, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in bases)
    named = "kind || ':' || s::BIGINT || ':' || (s + own)::BIGINT"
    base = ", ".join(f"'{r.name}'" for r in bases)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({every})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({named}, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({named}, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id"""


PHRASES_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT d.doc_id, x.i, w[x.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) AS x),
o AS (SELECT k.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""


SUBSTRINGS_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
x1 AS (SELECT doc_id, unnest(b) AS v, unnest(range(1, len(b) + 1)) AS i FROM d WHERE len(b) >= 50),
x2 AS (SELECT doc_id, i, v || lead(v) OVER w AS v2 FROM x1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)), x4 AS (SELECT doc_id, i, v2, v2 || lead(v2, 2) OVER w AS v4 FROM x2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
x8 AS (SELECT doc_id, i, v2, v4 || lead(v4, 4) OVER w AS v8 FROM x4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)), x16 AS (SELECT doc_id, i, v2, v8 || lead(v8, 8) OVER w AS v16 FROM x8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
x32 AS (SELECT doc_id, i, v2, v16, v16 || lead(v16, 16) OVER w AS v32 FROM x16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, h FROM (SELECT doc_id, i, md5_number(v32 || lead(v16, 32) OVER w || lead(v2, 48) OVER w) AS h FROM x32 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE h IS NOT NULL),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE least < doc_id),
n AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM r),
g AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n) GROUP BY 1, 2),
k AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS prior FROM g),
o AS (SELECT k.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(array_to_string(b[prior:a - 1], ''), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || array_to_string(b[coalesce(tail, 1):], ''))) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Three of the operators can be said in SQL that ends; ids are distinct in the driver's tables."""
    return {"op2_secret_ledger": _ledger_sql(), "op7_suffix_dedup": SUBSTRINGS_SQL, "op10_phrase_automata": PHRASES_SQL}
