"""URL filters: explicit host/path rules, then rules mined by FP-growth.

Urls become transactions of tokens.  Spark's FP-growth finds the combinations
that at least ``min_pages`` bad urls share; a rule's confidence is then counted
over all urls that hold its tokens, found through the rarest one, and those with
``min_confidence`` or more are kept, without any that contains a kept one.  Kept
rules are stored under their rarest token (an inverted index) and matched by an
equi-join on that token.

Where no labels are given, the urls that an explicit rule blocks are the bad
ones, and all others, also those that no rule names, count as good: a token has
to be bad wherever it occurs.  Tokens that the explicit rules are made of say
nothing but the rule, and are left out.

Defined results for odd input: a null url or one without ``://`` has host and
path '' and is allowed; ties between explicit rules of one length go to the
first listed; repeated rows, ids and urls all stay; urls of any length are read
whole; with too few labelled urls, or none, no rule is mined; an empty table
gives an empty result; only the id and url columns are read, so further ones
(``host``, ``rule``, ``mined``) never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.graph import checkpoint
from quarrylight.llm.skew import hot_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (rule, verdict); a rule is a host and a path prefix.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
BAD = "=bad"
#: Up to so many explicit rules are one literal in the plan; more are joined.
INLINE_RULES = 256


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both '' without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, the last two and three labels together, path segments, query parts."""
    labels = F.filter(F.split(host, r"\.", -1), lambda x: x != "")
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    parts = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), tail(2)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(labels) >= 3, F.array(F.concat(F.lit("d:"), tail(3)))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.split(path, "/", -1), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.filter(F.split(query, "&", -1), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x)),
    )
    return F.array_distinct(parts)


def explicit_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` to rows with host and path; null where no rule fits."""
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    parts = [(r, v, r.partition("/")[0], "/" + r.partition("/")[2]) for r, v in sorted(rules, key=lambda x: -len(x[0]))]
    if len(parts) <= INLINE_RULES:
        listed = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for r, v, h, p in parts))
        fits = F.filter(listed, lambda x: ((F.col("host") == x["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), x["h"]))) & F.startswith(F.col("path"), x["p"]))
        return pages.withColumn("_fit", F.get(fits, F.lit(0))).withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.verdict")}).drop("_fit")
    table = pages.sparkSession.createDataFrame([(*x, -i) for i, x in enumerate(parts)], "rule string, rule_verdict string, _h string, _p string, _rank int")
    listed = table.groupBy("_h").agg(F.collect_list(F.struct("_rank", "_p", "rule", "rule_verdict")).alias("_rules"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sites = pages.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("_n"))
    named = sites.select("host", "path", F.explode(suffixes).alias("_h"))
    sizes = named.groupBy("_h").agg(F.count("*").alias("_size")).join(listed, "_h")
    total = sites.agg(F.sum("_n")).first()[0] or 0
    fits = lambda: F.array_max(F.filter("_rules", lambda x: F.startswith(F.col("path"), x["_p"])))
    found = hot_join(named, sizes, ["_h"], "_size", total, F.col("path"), "inner").select("host", "path", fits().alias("_fit")).filter("_fit is not null")
    best = found.groupBy("host", "path").agg(F.max("_fit").alias("_fit")).join(sites, ["host", "path"])
    return hot_join(pages, best, ["host", "path"], "_n", total, F.monotonically_increasing_id()).withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.rule_verdict")}).drop("_fit", "_n")


def made_of(rules: list[tuple[str, str]]) -> list[str]:
    """The tokens that explicit rules are made of."""
    out = set()
    for rule, _ in rules:
        host, _, path = rule.partition("/")
        labels = [x for x in host.translate(str.maketrans(UPPER, LOWER)).split(".") if x]
        out |= {f"h:{x}" for x in labels} | {f"d:{'.'.join(labels[-n:])}" for n in (2, 3) if len(labels) >= n} | {f"p:{x}" for x in path.split("/") if x}
    return sorted(out)


def mine_rules(labelled: DataFrame, min_pages: int = 20, min_confidence: float = 0.9, leave_out: list[str] | None = None) -> DataFrame:
    """(tokens array<string>, bad boolean) to mined rules (antecedent, anchor).

    At least ``min_pages`` bad urls must hold a rule's tokens, and
    ``min_confidence`` of all urls that do must be bad.
    """
    own = F.array_except("tokens", F.array(*map(F.lit, leave_out))) if leave_out else F.col("tokens")
    # read several times below; what is lost is computed again
    labelled = labelled.select(own.alias("tokens"), "bad").persist()
    counted = labelled.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits"))
    tokens = counted.filter(F.col("hits") >= min_pages).withColumn("sure", F.col("hits") >= min_confidence * F.col("freq")).persist()
    single = tokens.filter("sure").select(F.array("token").alias("antecedent"), F.col("token").alias("anchor"))
    # only tokens of enough bad urls can be in a combination, and one with a sure token in it adds nothing
    rules = checkpoint(single.unionByName(_combinations(labelled, tokens.filter("not sure").select("token", "freq", "hits"), min_pages, min_confidence)))
    tokens.unpersist()
    labelled.unpersist()
    return rules


def _combinations(labelled: DataFrame, useful: DataFrame, min_pages: int, min_confidence: float) -> DataFrame:
    """The rules of two or more of the ``useful`` tokens (token, freq, hits)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    none = spark.createDataFrame([], "antecedent array<string>, anchor string")
    total = useful.agg(F.sum("hits")).first()[0]
    if not total:
        return none
    numbered = labelled.filter("bad").select(F.monotonically_increasing_id().alias("url"), F.explode("tokens").alias("token"))
    kept = hot_join(numbered, useful, ["token"], "hits", total, F.col("url"), "inner")
    items = kept.groupBy("url").agg(F.sort_array(F.collect_list("token")).alias("items")).select("items").persist()  # a url's own tokens
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min(min_pages / items.count(), 1.0), minConfidence=1.0, numPartitions=parts).fit(items)
    sets = checkpoint(model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= min_pages)).select(F.sort_array("items").alias("antecedent"), F.col("freq").alias("hits")))
    items.unpersist()
    rarest = sets.select("antecedent", F.explode("antecedent").alias("token")).join(useful, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    several = sets.join(rarest, "antecedent")
    held = matches(labelled.select(F.monotonically_increasing_id().alias("url"), "tokens"), several.select("antecedent", "anchor"))
    if held is None:
        return none
    counted = held.groupBy("rule").agg(F.count("*").alias("freq")).join(several.withColumnRenamed("antecedent", "rule"), "rule")
    sure = checkpoint(counted.filter(F.col("hits") >= min_confidence * F.col("freq")).select(F.col("rule").alias("antecedent"), "anchor"))
    # of rules that hold each other's tokens the smallest say it all
    nested = matches(sure.select(F.col("antecedent").alias("url"), F.col("antecedent").alias("tokens")), sure)
    if nested is None:
        return none
    redundant = nested.filter(F.size("rule") < F.size("url")).select(F.col("url").alias("antecedent")).distinct()
    return sure.join(redundant, "antecedent", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame | None:
    """(url, rule): urls of (url, tokens), each once, that hold every token of a rule (antecedent, anchor), found through its anchor; None where no url holds any anchor."""
    index = rules.groupBy("anchor").agg(F.collect_list("antecedent").alias("_rules"))
    dealt = urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
    sizes = checkpoint(dealt.groupBy("anchor").agg(F.count("*").alias("_size")).join(index, "anchor"))
    total = sizes.agg(F.sum("_size")).first()[0]
    if not total:
        return None
    held = hot_join(dealt, sizes, ["anchor"], "_size", total, F.xxhash64("url"), "inner")
    return held.select("url", F.explode(F.filter("_rules", lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0)).alias("rule"))


def _split(df: DataFrame) -> DataFrame:
    host, path = host_path(F.col("url"))
    return df.withColumns({"host": host, "path": path})


def _tokens() -> Column:
    return url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")


def url_filters(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: list[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    min_pages: int = 20,
    min_confidence: float = 0.9,
) -> DataFrame:
    """pages (id, url) and labelled (url, bad boolean) to one verdict per page.

    The explicit rule that fits decides; else a mined rule that matches blocks;
    else the page is allowed.  Without ``labelled`` the explicit rules' own
    verdicts are the labels, and urls that no rule names count as good.
    """
    judged = explicit_rule(_split(pages.select(F.col(id_col).alias("page_id"), "url")), rules)
    if labelled is None:
        examples = judged.filter(F.col("host") != "").select("host", "path", "url", F.coalesce(F.col("rule_verdict") == "block", F.lit(False)).alias("bad"))
    else:
        examples = _split(labelled.filter(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("url", "bad"))
    mined = mine_rules(examples.select(_tokens(), "bad"), min_pages, min_confidence, made_of(rules) if labelled is None else None)
    # a url is matched once, however many rows have it
    urls = judged.filter(F.col("rule").isNull() & (F.col("host") != "")).groupBy("url", "host", "path").agg(F.count("*").alias("_n"))
    found = matches(urls.select("url", _tokens()), mined)
    hit = mined.select(F.col("anchor").alias("url")).limit(0) if found is None else found.select("url").distinct()
    blocked = checkpoint(urls.select("url", "_n").join(hit, "url", "left_semi").withColumn("mined", F.lit(True)))
    total = blocked.agg(F.sum("_n")).first()[0] or 0
    return hot_join(judged, blocked, ["url"], "_n", total, F.monotonically_increasing_id()).select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("mined"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.coalesce("mined", F.lit(False)).alias("mined"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the labels are the verdicts of the explicit rules, for the table of labels says nothing about urls."""
    return url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
