import random

from lodeseek.llm import url_rules
from lodeseek.llm.registry import URL_RULES


def expected(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (r[0] == "" or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


ODD = [
    None, "", "no scheme", "http://", "http:///x", "http://EXAMPLE.com/en/a?b#c", "https://www.example.com/en/", "http://example.com/e", "http://a.b.net/fr/x", "http://net/es/",
    "http://xnet/es/", "http://example.com.evil.org/en/", "http://example.com:80/en/1", "a://b://c/en/", "http://example.com?x=/en/", "http://com/", "http://.com/", "http://com./", "x\n://example.com/en/\ny",
]


def check(spark, urls, rules, **kw):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rules_frame(spark, rules), "page_id", **kw).collect()}
    assert got == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_contract_rules_on_odd_urls(spark):
    check(spark, ODD, URL_RULES)
    check(spark, ODD * 4, URL_RULES)


def test_random_nested_rules(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "a-b", "c"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(0, 2)))
    rules = sorted({(host(rng.randint(1, 4)), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host(rng.randint(1, 5))}{path()}" for _ in range(400)]
    check(spark, urls, rules)
    check(spark, urls[:100], [*rules, ("", "/x", "block")])


def test_no_rules_and_no_urls(spark):
    check(spark, ODD, [])
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(df, url_rules.rules_frame(spark, URL_RULES), "page_id").collect() == []


def test_plan_is_native_and_does_not_shuffle_pages(spark, sf):
    from lodeseek.llm.registry import op3_url_rules

    plan = op3_url_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan and "CartesianProduct" not in plan


def test_many_rules_over_few_hosts_in_many_slices(spark):
    """More rules than urls, most on two hosts, nested in hosts and paths; a third of the urls have one key; no slice holds all."""
    rng = random.Random(8)
    path = lambda: "/" + "".join(rng.choice("ab/é\U0010ffff") for _ in range(rng.randint(0, 9)))
    rules = {(rng.choice(["shop.example", "eu.shop.example", "example", ""]), path()): rng.choice(["allow", "block"]) for _ in range(20_000)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{rng.choice(['shop.example', 'eu.shop.example', 'a.eu.shop.example', 'other.org'])}{path()}" for _ in range(600)] + ["http://shop.example/ab/"] * 300
    by = {(h, p): v for h, p, v in rules}

    def want(url):
        host, p, *_ = expected(url, [])
        fit = [(len(h) + n, len(h), by[h, p[:n]] == "block", h, p[:n]) for h in ("", "example", "shop.example", "eu.shop.example") if h == "" or host == h or host.endswith("." + h) for n in range(len(p) + 1) if (h, p[:n]) in by]
        best = max(fit, default=None)
        return (host, p, best[3] + best[4], by[best[3], best[4]]) if best else (host, p, None, "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rules_frame(spark, rules), "page_id").collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    from pyspark.sql import functions as F

    points = df.select(F.col("page_id").alias("uid"), url_rules._rule_key(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("key"))
    ends = url_rules._path_ends(url_rules.rules_frame(spark, rules))
    swept = url_rules.swept(points, ends, ["key"])
    assert swept.count() == len(urls)
