"""Host-level quality rules, in DataFrame functions only.

Documents are measured row by row (no text leaves its task), rule failures are
aggregated by domain, each domain's failure rate is shrunk with a beta prior
fitted to all domains, and the domain verdicts are joined back.

Defined results for odd input: a null text counts as empty (0 words, fails the
base rule); a null domain is the domain ''; repeated rows are judged one by one
and all stay; an empty table gives an empty result; texts of any length are
measured whole; ties of words and lines are by their bytes; only the named id,
text and domain columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.graph import checkpoint
from quarrylight.llm.skew import hot_join

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule thresholds, as integer ratios so that every engine decides alike.
SYMBOLS_PER_WORD = (1, 4)
DUP_LINES_PER_LINE = (1, 2)
MEAN_WORD_CHARS = (2, 20)
#: A domain is rejected when its shrunken failure rate, less two posterior
#: standard deviations, is over this.
MAX_HOST_RATE = 0.5


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source", whole: bool = False) -> DataFrame:
    """Per document: id (or, as ``_id``, the whole row), domain and the counts the rules need."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    base = docs.select(
        (F.struct(*docs.columns) if whole else F.col(id_col)).alias("_id"),
        F.coalesce(F.col(domain_col).cast("string"), F.lit("")).alias("_domain"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1)).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR)).alias("_lines"),
        F.char_length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    hashed = base.select(
        "_id",
        "_domain",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return hashed.select("*", F.when(repeats, _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words")).drop("_windows")


def _covered(windows: Column) -> Column:
    """How many words lie in a window whose hash occurs more than once."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one-element arrays bind a value to a name, so that it is computed once
    repeated = F.flatten(
        F.transform(
            F.array(pairs),
            lambda s: F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])),
                lambda x: x["i"],
            ),
        )
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sort_array(repeated),
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def rule_failed(measured: DataFrame) -> DataFrame:
    """Adds base_failed and rule_failed to :func:`measures`."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = (
        base_failed
        | (SYMBOLS_PER_WORD[1] * F.col("n_symbols") > SYMBOLS_PER_WORD[0] * F.col("n_words"))
        | (DUP_LINES_PER_LINE[1] * F.col("n_dup_lines") > DUP_LINES_PER_LINE[0] * F.col("n_lines"))
        | (F.col("word_chars") < MEAN_WORD_CHARS[0] * F.col("n_words"))
        | (F.col("word_chars") > MEAN_WORD_CHARS[1] * F.col("n_words"))
    )
    return measured.withColumns({"base_failed": base_failed, "rule_failed": failed})


def domains(flagged: DataFrame) -> DataFrame:
    """(_domain, n, f): documents and failures of each domain."""
    return flagged.groupBy("_domain").agg(F.count("*").alias("n"), F.count_if("rule_failed").alias("f"))


def judge(flagged: DataFrame, hosts: DataFrame) -> DataFrame:
    """Adds host_failed and kept to the rows, by the rates of their domains."""
    verdicts, total = host_verdicts(hosts)
    return hot_join(flagged, verdicts, ["_domain"], "n", total, F.monotonically_increasing_id()).withColumn("kept", ~F.col("rule_failed") & ~F.col("host_failed"))


def host_verdicts(hosts: DataFrame) -> tuple[DataFrame, int]:
    """(_domain, n, f) to (_domain, n, host_failed), and the sum of n.

    The beta prior is fitted by moments: mean of all documents, variance of the
    domains' rates weighted by their documents, concentration within 1 to 10000.
    """
    rate = F.col("f") / F.col("n")
    total, failed, squares = hosts.agg(F.sum("n"), F.sum("f"), F.sum(F.col("f") * rate)).first()
    mean = (failed or 0) / max(total or 0, 1)
    variance = max((squares or 0.0) / max(total or 0, 1) - mean * mean, 1e-9)
    size = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e4)
    post = (F.col("f") + mean * size) / (F.col("n") + size)
    spread = F.sqrt(post * (1 - post) / (F.col("n") + size + 1))
    return hosts.select("_domain", "n", (post - 2 * spread > MAX_HOST_RATE).alias("host_failed")), total or 0


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "source") -> DataFrame:
    """One row per document with its measures and verdicts."""
    # a few numbers a document, read twice: for the domains' totals and for the verdicts
    flagged = checkpoint(rule_failed(measures(docs, id_col, text_col, domain_col)))
    return judge(flagged, domains(flagged)).select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule_failed",
        "host_failed",
    )


def passing(docs: DataFrame, text_col: str = "text", domain_col: str = "source") -> DataFrame:
    """The documents, whole, that the rules keep, each row by its own verdict.

    Rows are measured twice, for the domains' totals and with the row at hand, so
    that no text is shuffled to meet its verdict.
    """
    hosts = checkpoint(domains(rule_failed(measures(docs, text_col, text_col, domain_col))))
    return judge(rule_failed(measures(docs, text_col, text_col, domain_col, whole=True)), hosts).filter("kept").select("_id.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, host, len(ws) AS n_words,
    len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover c USING (rid)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), r AS (
  SELECT *, (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS rule_failed FROM b
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS f FROM r GROUP BY host
), p AS (
  SELECT sum(f) / sum(n)::DOUBLE AS mean, greatest(sum(f * (f / n::DOUBLE)) / sum(n) - (sum(f) / sum(n)::DOUBLE) ** 2, 1e-9) AS variance FROM h
), q AS (
  SELECT mean, least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1e4) AS k FROM p
), v AS (
  SELECT host, (f + mean * k) / (n + k) AS post, n + k + 1 AS size FROM h, q
), hv AS (
  SELECT host, (post - 2 * sqrt(post * (1 - post) / size) > 0.5) AS host_failed FROM v
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  (NOT rule_failed AND NOT host_failed) AS kept, rule_failed, host_failed
FROM r JOIN hv USING (host)
"""
