"""URL filters by association rules.

FP-growth mines combinations of URL tokens that go with a label; rules of enough support and confidence, and
more confident than every shorter rule they contain, are kept and found for a URL by an inverted index on each
rule's rarest token. Given host and path rules come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.text import ascii_lower
from doseframe.session import staged

# Least share and number of the labelled rows that a combination occurs in, least confidence of a rule. The
# share is 0: a number of rows that does not grow with the table, so that rare hosts get rules at every size.
SUPPORT, LEAST_ROWS, CONFIDENCE = 0.0, 20, 0.5
BAD, GOOD = "label=block", "label=allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(before, r"(?s)^([^/]*)", 1)
    return ascii_lower(host), F.substring(before, F.length(host) + 1, F.length(before))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of (verdict, host, path) rules that fits, else null.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted: scheme, whole host, host labels, path segments and query names; runs
    of digits count as one kind. A URL without a host has none."""
    plain = lambda c: F.regexp_replace(ascii_lower(c), "[0-9]+", "0")
    scheme = F.array(F.concat(F.lit("s:"), ascii_lower(F.substring_index(url, "://", 1))))
    labels = F.transform(F.split(plain(host), r"\."), lambda x: F.concat(F.lit("l:"), x))
    segments = F.transform(F.split(plain(path), "[/._-]"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), plain(F.substring_index(x, "=", 1))))
    tokens = F.concat(scheme, F.array(F.concat(F.lit("h:"), plain(host))), labels, segments, names)
    tokens = F.filter(tokens, lambda x: F.length(x) > 2)
    return F.when((host != "") & url.isNotNull(), F.array_sort(F.array_distinct(tokens))).otherwise(F.array().cast("array<string>"))


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows of tokens (array) and bad (boolean).

    A rule stays when no other with a part of its tokens, and no rule without tokens (the verdict's share of
    all rows), is as confident. A combination occurs in LEAST_ROWS rows at least, so few rows give no rules.
    """
    labelled = F.concat(F.col("tokens"), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD)))
    items = staged(rows.where("bad is not null").select(labelled.alias("items"), "bad"), "items")
    spark = items.sparkSession
    counts = {r["bad"]: r["n"] for r in items.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if not counts:
        return spark.createDataFrame([], schema)
    support = min(1.0, max(support, LEAST_ROWS / sum(counts.values())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].isin(BAD, GOOD)).where(
        ~F.array_contains("antecedent", BAD) & ~F.array_contains("antecedent", GOOD)
    )
    verdict = F.when(F.col("consequent")[0] == BAD, "block").otherwise("allow")
    found = staged(found.select(F.array_sort("antecedent").alias("antecedent"), verdict.alias("verdict"), "confidence", "support"), "rules")
    share = F.when(F.col("verdict") == "block", counts.get(True, 0) / sum(counts.values())).otherwise(counts.get(False, 0) / sum(counts.values()))
    found = found.where(F.col("confidence") > share)
    # A rule's subsets are looked up through their first tokens.
    small = found.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    small = small.withColumn("token", F.col("part")[0])
    wide = found.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    worse = wide.join(small, "token").where(
        (F.col("verdict") == F.col("v")) & (F.size("part") < F.size("antecedent")) & (F.col("c") >= F.col("confidence"))
        & F.forall("part", lambda x: F.array_contains("antecedent", x))
    ).select("antecedent", "verdict").distinct()
    return found.join(worse, ["antecedent", "verdict"], "left_anti")


def match(rows: DataFrame, key: str, rules: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, verdict, antecedent, confidence) of the most confident rule of each row's tokens; no row without one.

    `weights` has token and n, how often a token occurs: a rule stands in the index under its rarest token.
    """
    parts = rules.select("*", F.explode("antecedent").alias("token")).join(weights, "token")
    index = parts.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    hits = rows.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = hits.where(F.forall("antecedent", lambda x: F.array_contains("tokens", x)))
    # Of equally confident rules: more support, then block before allow, then the first by its tokens.
    order = F.struct("confidence", "support", F.col("verdict") == "block", F.concat_ws(" ", "antecedent"))
    best = hits.groupBy(key).agg(F.max_by(F.struct("verdict", "antecedent", "confidence"), order).alias("b"))
    return best.select(key, "b.verdict", "b.antecedent", "b.confidence")


def judge(
    pages: DataFrame, key: str, url: str, labels: DataFrame, given: list[tuple[str, str, str]],
    support: float = SUPPORT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """One row per page: the key, host, path, rule, verdict, mined, confidence. `labels` has the key and bad.

    The longest given rule that fits decides; else the most confident mined rule, else the verdict is allow.
    Null URLs and URLs without `://` have an empty host and path and no tokens. Of a key's repeated labels
    the bad one counts; null keys and labels take no part in mining. Pages that repeat a key are judged
    each by its own URL.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()).drop("url"), "urls")
    known = labels.select(F.col(key).alias("key"), "bad").where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    rules = staged(mine(rows.join(known, "key").select("tokens", "bad"), support, confidence), "rules")
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    needed = rules.select(F.explode("antecedent").alias("token")).distinct()
    # URLs of one set of tokens are matched once.
    kinds = staged(rows.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("rid").alias("kind")), "kinds")
    found = staged(match(kinds, "kind", rules, counts.join(needed, "token", "left_semi")), "matches")
    named = kinds.join(found, "kind").select("tokens", F.col("verdict").alias("mined_verdict"), F.col("antecedent").alias("mined"), "confidence")
    rule = given_rule(F.col("host"), F.col("path"), given)
    return rows.join(named, "tokens", "left").withColumn("given", rule).select(
        F.col("key").alias(key), "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined", "confidence",
    )
