"""URL filter: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

The trees are trained on URLs that the rules label, on at most ``train_rows`` of them (those with the smallest
hash of the URL, so the choice does not depend on partitions).  Suffix statistics cover all rows.  Everything is
SQL functions and the DataFrame API of ``pyspark.ml``, which runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens",
            "parameters", "escapes", "fragment", "secure", "host_entropy", "path_entropy", "longest_label",
            "suffix_block_rate", "suffix_log_rows", "domain_block_rate", "domain_log_rows"]


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else null."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def entropy(text: Column) -> Column:
    """Bits per character, from the distinct characters of the string."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda acc, c: acc + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(df: DataFrame) -> DataFrame:
    """Add the features that a URL shows by itself (needs url, host, path)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    ratio = lambda text: F.when(F.length(text) > 0, _count(text, "[0-9]") / F.length(text)).otherwise(0.0)
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "host_labels": _count(host, r"[^.]+"), "depth": _count(path, "[^/]+"),
        "digit_ratio": ratio(url), "host_digit_ratio": ratio(host), "hyphens": _count(host, "-"),
        "parameters": _count(asked, "[^&]+"), "escapes": _count(url, "%[0-9A-Fa-f]{2}"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https:")).cast("double"),
        "host_entropy": entropy(host), "path_entropy": entropy(path),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)).cast("double")})


def with_site_rates(df: DataFrame, pseudo: float = 20.0) -> DataFrame:
    """Add block rates of the last label and the last two labels of the host, over all rows.

    Rates are shrunk to the overall rate by ``pseudo`` rows; a row without a rule counts as half blocked.
    """
    df = df.withColumns({"suffix": F.regexp_extract("host", r"([^.]*)$", 1), "domain": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)})
    blocked = F.when(F.col("action") == "block", 1.0).when(F.col("action") == "allow", 0.0).otherwise(0.5)
    overall = df.agg(F.coalesce(F.avg(blocked), F.lit(0.5)).alias("r")).scalar()
    for key in ("suffix", "domain"):
        rates = df.groupBy(key).agg(F.sum(blocked).alias("b"), F.count(F.lit(1)).alias("n")).select(
            key, ((F.col("b") + overall * pseudo) / (F.col("n") + pseudo)).alias(f"{key}_block_rate"),
            F.log1p(F.col("n").cast("double")).alias(f"{key}_log_rows"))
        df = df.join(rates, key)
    return df


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = 20_000, rounds: int = 12,
          depth: int = 4, seed: int = 11) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_probability) for every row of ``pages``.

    The verdict is the longest fitting rule's, else that of the trees.  Where the rules label no row, or give one
    verdict only, there is nothing to train on: other rows then get that one verdict, or ``allow``.  A null URL has
    empty host and path; repeated rows are judged each; other columns are ignored.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns(dict(zip(("host", "path"), parse(F.col("url")))))
    rows = rows.withColumns(dict(zip(("rule", "action"), longest_rule(F.col("host"), F.col("path"), rules))))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(lexical(with_site_rates(rows)))
    sample = (ready.where("action IS NOT NULL").withColumn("label", (F.col("action") == "block").cast("double"))
              .select("label", "features", F.xxhash64("url", "page_id").alias("h")).orderBy("h").limit(train_rows)
              .select("label", "features").cache())
    try:
        labels = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(labels) < 2:
            only = F.lit("block" if labels and 1.0 in labels else "allow")
            scored = ready.withColumn("p", (only == "block").cast("double"))
        else:
            model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.2).fit(sample)
            scored = model.transform(ready).withColumn("p", vector_to_array("probability")[1])
    finally:
        sample.unpersist()
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce(
        "action", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.col("p").alias("block_probability"))
