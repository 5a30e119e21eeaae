"""Quality rules compiled into one Spark projection, without user functions.

``RULES`` is a threshold table over measures of one document; ``verdict`` turns it into a boolean
column. All measures are integers and every ratio is compared by cross-multiplication, so no rule
depends on floating point. No shuffle: each document is judged in its own row.

Repeated 3-word windows are found in the row: windows are hashed, the hash (33 bits) and the position
(31 bits) share one long, and sorting those longs brings equal windows together. Windows whose
hashes meet are compared again as words, so hash collisions change nothing.

Defined cases: a null text counts as empty; a document without words has all measures 0, fails the
base rule and is not kept; repeated rows are judged one by one; a null ``doc_id`` is kept as it is;
other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages, lower case as written (fixed values).
STOP_WORDS = (
    "the and of to in is for with by that this on are be was as at from have has it or an not they which "
    "le la les de du des et un une en que qui dans pour par sur avec au aux il elle est "
    "der die das und den dem ein eine zu mit von auf ist im nicht sich auch es werden "
    "el los las y que en una por con para del se su al lo como"
).split()

#: Rule, measure, of what, least and most in thousandths (None: no bound).
RULES = (
    ("mean word length", "word_chars", "n_words", 2000, 15000),
    ("symbols to words", "n_symbols", "n_words", None, 100),
    ("stop words", "n_stop_words", "n_words", 30, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 500),
    ("repeated words", "n_repeat_words", "n_words", None, 500),
    ("lines that end in an ellipsis", "n_ellipsis_lines", "n_lines", None, 500),
)
LEAST_WORDS = 50

_POSITION = (1 << 31) - 1


def _repeat_words(words: str = "__words", hashes: str = "__hashes") -> list[tuple[str, Column]]:
    """Steps, one projection each, that end in ``n_repeat_words``."""
    keys = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))),
    ).otherwise(F.array().cast("array<bigint>"))

    def met(rows: str, same, position) -> Column:
        pairs = F.zip_with(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda a, b: F.when(same(a, b), F.array(position(a), position(b))).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.flatten(pairs))

    near = met("__keys", lambda a, b: a.bitwiseXOR(b) <= F.lit(_POSITION), lambda a: a.bitwiseAND(F.lit(_POSITION)).cast("int"))
    near = F.when(F.size("__keys") > 1, near).otherwise(F.array().cast("array<int>"))
    exact = F.sort_array(F.transform("__near", lambda p: F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("t"), p.alias("p"))))
    sure = F.when(F.size("__exact") > 1, F.sort_array(met("__exact", lambda a, b: a["t"] == b["t"], lambda a: a["p"]))).otherwise(F.array().cast("array<int>"))
    spread = F.zip_with("__sure", F.slice("__sure", 2, F.greatest(F.size("__sure"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return [("__keys", keys), ("__near", near), ("__exact", exact), ("__sure", sure), ("n_repeat_words", F.aggregate(spread, F.lit(0), lambda s, x: s + x).cast("long"))]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of integer measures for each document."""
    t = F.col("__text")
    out = docs.select("doc_id", text_of(text).alias("__text"))
    out = out.select(
        "doc_id",
        F.filter(F.split(t, BLANK_RUN), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0).alias("__lines"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("__words")
    out = out.select(
        "doc_id",
        "n_symbols",
        "__words",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("__words", i + 1), F.get("__words", i + 2))).alias("__hashes"),
    )
    for name, value in _repeat_words():
        out = out.withColumn(name, value)
    return out.drop("__words", "__hashes", "__keys", "__near", "__exact", "__sure")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """All rules hold; each is two integer comparisons."""
    held = []
    for _, measure, of, least, most in rules:
        if least is not None:
            held.append(1000 * F.col(measure) >= least * F.col(of))
        if most is not None:
            held.append(1000 * F.col(measure) <= most * F.col(of))
    return reduce(lambda a, b: a & b, held)


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    return measures(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def sql() -> str:
    """The same result in SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = []
    for _, measure, of, least, most in RULES:
        if least is not None:
            rules.append(f"1000 * {measure} >= {least} * {of}")
        if most is not None:
            rules.append(f"1000 * {measure} <= {most} * {of}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM p),
cnt AS (SELECT doc_id, i, a, CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, a, b, c) END AS n FROM tri),
cov AS (SELECT doc_id, a, CASE WHEN n > 1 OR coalesce(lag(n, 1) OVER (PARTITION BY doc_id ORDER BY i), 0) > 1 OR coalesce(lag(n, 2) OVER (PARTITION BY doc_id ORDER BY i), 0) > 1 THEN 1 ELSE 0 END AS covered FROM cnt),
ww AS (SELECT doc_id, count(*) AS n_words, sum(length(a)) AS word_chars, sum(covered) AS n_repeat_words, sum(CASE WHEN a IN ({stop}) THEN 1 ELSE 0 END) AS n_stop_words FROM cov GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
l1 AS (SELECT doc_id, l, rtrim(l) AS r FROM l0 WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
ll AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN right(r, 3) = '...' OR right(r, 1) = '…' THEN 1 ELSE 0 END) AS n_ellipsis_lines FROM l1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM d LEFT JOIN ww ON d.doc_id = ww.doc_id LEFT JOIN ll ON d.doc_id = ll.doc_id),
j AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {' AND '.join(rules)}) AS kept
FROM j
"""
