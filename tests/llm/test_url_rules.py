"""URL parts and given rules by hand, mined rules against brute force, odd inputs."""

from itertools import combinations

from pyspark.sql import functions as F

from doseframe.llm import url_rules
from doseframe.llm.queries import GIVEN_RULES, QUERIES

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("HTTP://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("x://com/", "com", "/", "com/"), ("x://a.com?q=/en/", "a.com", "", None),
    ("x://b.net/es/#a://c", "b.net", "/es/", "net/es/"), ("x://b.net#/fr/", "b.net", "", None), ("x://badnet/fr/", "badnet", "/fr/", None),
    ("x://É.net/fr/a/b", "É.net", "/fr/a/b", "net/fr/"), ("x://notexample.com/en/", "notexample.com", "/en/", "com/"), ("a://b://c/d", "b:", "//c/d", None),
]


def test_parts_and_given_rules(spark):
    df = spark.createDataFrame([(i, c[0], "q") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_rules.judge(df, "page_id", "url", labels, GIVEN_RULES).collect()}
    verdicts = {n + p: v for v, n, p in GIVEN_RULES}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdicts.get(rule, "allow")), CASES[i]
    assert url_rules.judge(df.limit(0), "page_id", "url", labels, GIVEN_RULES).count() == 0


def test_mined_rules_are_those_of_all_combinations(spark):
    rows = []
    for i in range(400):
        tokens = [t for t, n in (("a", 2), ("b", 3), ("c", 5), ("d", 7)) if i % n == 0] + ["z"]
        rows.append((tokens, i % 6 == 0 or i % 35 == 0))
    got = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.01, 0.6).collect()}
    found = {}
    for n in range(1, 6):
        for part in combinations("abcdz", n):
            hit = [bad for t, bad in rows if set(part) <= set(t)]
            for verdict, k in (("block", sum(hit)), ("allow", len(hit) - sum(hit))):
                if k >= 20 and k / len(hit) >= 0.6:
                    found[part, verdict] = k / len(hit)
    share = sum(bad for _, bad in rows) / len(rows)
    base = {"block": share, "allow": 1 - share}
    found = {k: c for k, c in found.items() if c > base[k[1]]}
    kept = {k: c for k, c in found.items() if not any(v == k[1] and set(p) < set(k[0]) and d >= c for (p, v), d in found.items())}
    assert got.keys() == kept.keys() and all(abs(got[k] - kept[k]) < 1e-9 for k in got)


def test_unseen_urls_follow_the_rules(spark):
    urls = [(i, f"https://{'spam' if i % 3 == 0 else 'good'}{i}.host{i % 5}.org/{'buy' if i % 3 == 0 else 'read'}/{i}", "t") for i in range(300)]
    df = spark.createDataFrame(urls + [(301, "https://x.org/buy/1", "t"), (301, "https://x.org/read/1", "t"), (None, "https://x.org/buy/2", "t")], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 300, 2)] + [(None, True), (4, None)], "page_id long, bad boolean")
    got = url_rules.judge(df, "page_id", "url", labels, []).select("page_id", "path", "verdict").collect()
    assert len(got) == 303
    assert all(r.verdict == ("block" if "buy" in r.path else "allow") for r in got)


def test_a_rare_bad_host_gets_a_rule_at_every_size(spark):
    """30 bad pages of one host among 12,000 labelled ones (a quarter of a percent)."""
    urls = [(i, f"https://{'worst.net' if i < 30 else f'fine{chr(97 + i % 20)}.org'}/a{chr(97 + i % 7)}/x") for i in range(12000)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 30) for i in range(12000)], "page_id long, bad boolean")
    got = url_rules.judge(df, "page_id", "url", labels, []).select("page_id", "verdict").collect()
    assert len(got) == 12000 and all((r.verdict == "block") == (r.page_id < 30) for r in got)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op1_url_rules"](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert got.where(~F.col("verdict").isin("allow", "block")).count() == 0
