"""URL filters as a sort-merge range join, in DataFrame operations only.

A host becomes a key of its labels in reverse, each followed by a dot: `www.example.com` is `com.example.www.`. The
hosts under a rule's host are then the keys from `com.example.` up to, not including, `com.example/`, as `/` follows
`.`. Both ends of each interval are merged with the keys of the urls into one sorted sweep. Intervals are nested or
apart, so what is active behind an end is a stack: an opening end holds the stack of its host, a closing one the stack
of the host around it. A url takes the stack of the last end before it.

Each host in a url's stack, joined to the url's path, then is a point of a second sweep, over host and path. Its
intervals are the paths that begin with a rule's; an opening end holds its rule, a closing one the rule around it, so the
last end before a point is the longest rule of that host that fits. The longest over the stack wins. The rule around
another is found by sweeps as well: the depth of each end is a running sum of opens and closes, and what a closing end
falls back to is the last rule opened at the depth that it leaves behind.

A sweep deals its rows out by ranges of the key, with ends before points and then by row, so one key's points may fill
any number of ranges; it is written once, and read with its range. The state at the start of a range is that of the
last end in the ranges before it, a row for each. No page content is shuffled.

Defined results: a null url, or one without `://`, has an empty host and path and meets only rules of an empty host;
without a rule the verdict is the default; of two rules of equal length, the one with the longer host wins, then block;
rules repeated in host and path count once, as block if any blocks; rules whose host no url can have never fit; very
long urls are taken whole; repeated rows each get their row; empty tables give an empty result, or the default for
every url; the url table's other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_before, ranged, running, so_far, written

ALLOW, BLOCK = "allow", "block"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES_SCHEMA = "host string, path string, verdict string"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def host_of(url: Column) -> Column:
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(part, _UPPER, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")), "UTF-8")


def _rule_key(host: Column, path: Column) -> Column:
    return F.encode(F.concat(host, F.lit("/"), path), "UTF-8")


def _behind(key: Column) -> Column:
    """Greater than all keys that begin with this one: no UTF-8 holds the byte FF."""
    return F.concat(key, F.lit(b"\xff"))


def swept(points: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """points(*key, uid, ...) with the state of the last of ends(*key, state) at or before their key; null where there is none."""
    order = [*key, "kind", "uid"]
    both = points.withColumn("kind", F.lit(1)).unionByName(ends.select(*key, "state", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("uid")), allowMissingColumns=True)
    rows = ranged(both, order)
    last = rows.where("kind = 0").groupBy("part").agg(F.max_by("state", F.struct(*key)).alias("state"))
    # a row for each range
    carried = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(last), "part", "left").select("part", parts_before(F.last("state", ignorenulls=True)).alias("carried"))
    known = rows.withColumn("state", F.last("state", ignorenulls=True).over(so_far(order))).where("kind = 1").join(F.broadcast(carried), "part")
    return known.withColumn("state", F.coalesce("state", "carried")).drop("part", "kind", "carried", *key)


def _host_ends(rules: DataFrame) -> DataFrame:
    """Both ends of each ruled host's interval, with the stack of ruled hosts behind them, the innermost first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = hosts.select("host", F.posexplode(F.array_append(up, F.lit(""))).alias("up", "over"))
    above = above.join(hosts.select(F.col("host").alias("over")), "over").groupBy("host", "over").agg(F.min("up").alias("up"))
    stacks = above.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("up", "over"))), lambda s: s["over"]).alias("stack"))
    named = stacks.where("host <> ''").withColumn("key", key_of(F.col("host")))
    opened = named.select("key", F.struct("stack").alias("state"))
    # the closing key: the last byte of the opening one, a dot, becomes a slash
    closed = named.select(F.expr("concat(substring(key, 1, octet_length(key) - 1), X'2F')").alias("key"), F.struct(F.expr("slice(stack, 2, size(stack))").alias("stack")).alias("state"))
    whole = stacks.where("host = ''").select(F.lit(b"").alias("key"), F.struct("stack").alias("state"))
    return opened.union(closed).union(whole)


def _path_ends(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval of paths, with the rule behind them: itself, or the next shorter one of its host."""
    key = _rule_key(F.col("host"), F.col("path"))
    rule = F.struct("path", "verdict").alias("state")
    both = rules.select(key.alias("key"), rule, F.lit(1).alias("step")).union(rules.select(_behind(key).alias("key"), rule, F.lit(-1).alias("step")))
    # no two ends have the same key, but for closing ones with nothing between them: the longest closes first
    order = ["key", "size"]
    deep = running(both.withColumn("size", -F.length("state.path")), order, {"depth": "step"})
    opened = deep.where("step = 1")
    closed = deep.where("step = -1").select("depth", "key", F.monotonically_increasing_id().alias("uid"), F.col("key").alias("at"), F.col("size").alias("rest"))
    # a rule that stands around another was the last one opened at its depth
    around = swept(closed.where("depth > 0"), opened.select("depth", "key", "state"), ["depth", "key"]).select(F.col("at").alias("key"), "state", "rest")
    outmost = closed.where("depth = 0").select(F.col("at").alias("key"), F.lit(None).cast(opened.schema["state"].dataType).alias("state"), "rest")
    # of closing ends of one key the last one counts, the shortest rule's
    ends = around.unionByName(outmost).groupBy("key").agg(F.max_by("state", "rest").alias("state"))
    empty = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"))
    return opened.select("key", "state").union(ends.select("key", F.coalesce("state", empty).alias("state")))


def judge(urls: DataFrame, rules: DataFrame, *keep: str, url: str = "url", default: str = ALLOW) -> DataFrame:
    """keep columns, host, path, rule and verdict of every url, by the longest rule that fits.

    rules(host, path, verdict): a rule fits its host and the hosts below it where the path starts with the rule's."""
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where(~F.col("host").rlike("[/?#]") & ~F.col("path").rlike("[?#]"))
    rules = rules.groupBy("host", "path").agg(F.max_by("verdict", F.struct((F.col("verdict") == BLOCK).alias("strict"), "verdict")).alias("verdict"))
    given = urls.select(F.struct(*keep).alias("keep"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # written, so that every later reading gives a row the same number
    given = written(given.withColumn("uid", F.monotonically_increasing_id()), "urls")
    stacked = swept(given.select("uid", "host", "path", key_of(F.col("host")).alias("key")), _host_ends(rules), ["key"])
    points = stacked.select("uid", "path", F.explode("state.stack").alias("of")).select("uid", F.col("of"), _rule_key(F.col("of"), F.col("path")).alias("key"))
    fit = swept(points, _path_ends(rules), ["key"]).where(F.col("state.path").isNotNull())
    size = F.length("of") + F.length("state.path")
    best = fit.groupBy("uid").agg(F.max(F.struct(size.alias("size"), F.length("of").alias("of_host"), F.concat("of", "state.path").alias("rule"), F.col("state.verdict").alias("verdict"))).alias("best"))
    out = given.join(best, "uid", "left")
    return out.select("keep.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
