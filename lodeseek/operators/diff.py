"""Line-by-line differences and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import lines_of

MOST_LINES = 800


def positional(pairs: DataFrame, before: str, after: str, *key: str, most: int = MOST_LINES) -> DataFrame:
    """A row for each line of a positional diff: line i against line i, removed lines before added ones.

    The two header lines count, and beyond most lines one row says that the rest is left out."""
    a, b = lines_of(F.col(before)), lines_of(F.col(after))
    both = pairs.select(*key, F.arrays_zip(a.alias("a"), b.alias("b")).alias("both"))

    def emitted(x: Column) -> Column:
        row = lambda mark, text: F.struct(F.lit(mark).alias("mark"), text.alias("line"))
        changed = F.filter(F.array(F.when(x["a"].isNotNull(), row("-", x["a"])), F.when(x["b"].isNotNull(), row("+", x["b"]))), lambda r: r.isNotNull())
        return F.when(x["a"].eqNullSafe(x["b"]), F.array(row(" ", x["a"]))).otherwise(changed)

    header = F.array(F.struct(F.lit("---").alias("mark"), F.lit("before").alias("line")), F.struct(F.lit("+++").alias("mark"), F.lit("after").alias("line")))
    rows = F.concat(header, F.flatten(F.transform("both", emitted)))
    over = F.array(F.struct(F.lit("...").alias("mark"), F.lit("truncated").alias("line")))
    shown = both.select(*key, rows.alias("rows")).select(*key, F.when(F.size("rows") > most, F.concat(F.slice("rows", 1, most), over)).otherwise(F.col("rows")).alias("rows"))
    return shown.select(*key, F.posexplode("rows").alias("no", "row")).select(*key, F.col("no").cast("int").alias("no"), "row.mark", "row.line")


def highlights(hits: DataFrame, lines: DataFrame, *key: str) -> DataFrame:
    """For each line(key, line_no) that a hit covers, the byte range to mark: of the first such hit; a null end is the line's.

    Hits are spread over the lines they cover, so that the interval join is an equality join."""
    covered = hits.withColumn("line_no", F.explode(F.sequence("line_start", "line_end")))
    first, last = F.col("line_no") == F.col("line_start"), F.col("line_no") == F.col("line_end")
    marks = covered.select(*key, "line_no", "line_start", "col_start", F.when(first, F.col("col_start")).otherwise(0).alias("from_col"), F.when(last, F.col("col_end")).alias("to_col"))
    best = marks.groupBy(*key, "line_no").agg(F.min_by(F.struct("from_col", "to_col"), F.struct("line_start", "col_start")).alias("mark"))
    return lines.join(best, [*key, "line_no"]).select(*lines.columns, "mark.from_col", "mark.to_col")


def as_of(uses: DataFrame, declarations: DataFrame, key: list[str]) -> DataFrame:
    """For each use(key, name, start), the type of the last declaration(key, name, decl_end, decl_type) before it; null without one.

    Both are merged in the order of place and the last declared type is carried along: one sort, no pairs."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*key, "name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = [c for c in uses.columns if c not in (*key, "name", "start")]
    u = uses.select(*key, "name", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("start"), *rest).alias("use"), F.lit(None).cast("string").alias("decl_type"))
    d = declarations.select(*key, "name", F.col("decl_end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(u.schema["use"].dataType).alias("use"), "decl_type")
    merged = u.union(d).withColumn("type", F.last("decl_type", ignorenulls=True).over(w))
    return merged.where("kind = 0").select(*key, "name", "use.*", "type")


def innermost(points: DataFrame, scopes: DataFrame, key: list[str]) -> DataFrame:
    """For each point(key, at, ...) the innermost of the nested scopes(key, scope_start, scope_end, scope) around it, both ends included; null outside.

    A sweep over opens, points and closes in the order of place. The depth is a running sum, and the scope that a point
    at a depth stands in is the last one that was opened to that depth: no row is paired with another, so the output is
    the points. Points and scopes without a place or key are in no scope; of equal scopes either may be told."""
    from pyspark.sql.window import Window

    rest = [c for c in points.columns if c not in (*key, "at")]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    p = points.select(*key, F.col("at").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.lit(0).alias("__step"), F.col("at").alias("__given"), row.alias("__row"), F.lit(None).cast(scopes.schema["scope"].dataType).alias("scope"))
    nothing = (F.lit(None).cast(p.schema["__given"].dataType).alias("__given"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"))
    size = (F.col("scope_end") - F.col("scope_start")).cast("long")
    proper = scopes.where(size >= 0)
    # at one place outer scopes open first and inner ones close first, with the points between
    opens = proper.select(*key, F.col("scope_start").cast("long").alias("__at"), F.lit(0).alias("__kind"), (-size).alias("__tie"), F.lit(1).alias("__step"), *nothing, "scope")
    closes = proper.select(*key, F.col("scope_end").cast("long").alias("__at"), F.lit(2).alias("__kind"), size.alias("__tie"), F.lit(-1).alias("__step"), *nothing, F.lit(None).cast(scopes.schema["scope"].dataType).alias("scope"))
    order = ("__at", "__kind", "__tie")
    so_far = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = p.unionByName(opens).unionByName(closes).withColumn("__depth", F.sum("__step").over(so_far(key)))
    # a close leaves its depth: it belongs to the one above, where it changes nothing
    told = deep.where("__kind < 2").withColumn("__scope", F.last(F.when(F.col("__kind") == 0, F.struct("scope")), ignorenulls=True).over(so_far([*key, "__depth"])))
    inside = (F.col("__depth") > 0) & F.col("__at").isNotNull()
    for k in key:
        inside &= F.col(k).isNotNull()
    return told.where("__kind = 1").select(*key, F.col("__given").alias("at"), *[F.col(f"__row.{c}").alias(c) for c in rest], F.when(inside, F.col("__scope.scope")).alias("scope"))
