"""Projection, recoding, missing values and scaling of feature tables.

Helper columns have names that the table at hand doesn't use, so tables may have columns of any names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from bramble.sources.shared import written


def label_last(df: DataFrame, label: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != label), label)


def halves(df: DataFrame, label: str) -> tuple[list[str], list[str]]:
    """The features before and from the middle column on."""
    features = [c for c in df.columns if c != label]
    middle = len(df.columns) // 2
    return features[:middle], features[middle:]


def recoded(column: Column, to: Mapping) -> Column:
    """Values by the mapping; others pass."""
    pairs = [x for k, v in to.items() for x in (F.lit(str(k)), F.lit(str(v)))]
    text = column.cast("string")
    return F.coalesce(F.element_at(F.create_map(*pairs), text), text)


def number(column: Column) -> Column:
    """A number, null where the text isn't one."""
    return column.try_cast("double")


def whole(column: Column) -> Column:
    return column.cast("double").cast("int")


def blank_as(column: Column, mark: str = "NA") -> Column:
    text = column.cast("string")
    return F.when(text.isNull() | text.isin("", " "), F.lit(mark)).otherwise(text)


def unused(df: DataFrame, name: str, *others: str) -> str:
    """name, with as many underscores before it as it takes for df not to have such a column, nor the others to be it."""
    while name in (*df.columns, *others):
        name = "_" + name
    return name


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df without the columns of a drop-list; those it doesn't have are passed over."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns))


def running(df: DataFrame, order: str, add: Column, name: str) -> DataFrame:
    """df with the sum of `add` over all rows before a row in the order of a column without equal values.

    Rows are dealt by ranges of the order, written, and summed within each; the totals of ranges are few.
    """
    part, before = unused(df, "range", name), unused(df, "before", name)
    spread = written(df.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()), "ranges")
    rest = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = spread.groupBy(part).agg(F.sum(add).alias(before)).select(part, F.coalesce(F.sum(before).over(rest), F.lit(0)).alias(before))
    own = F.coalesce(F.sum(add).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn(name, own).join(F.broadcast(totals), part).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def ordinals(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number of the value among the distinct values in text order, from 0; null is -1.

    The distinct values are numbered apart from the rows, by ranges, so no window runs over a table.
    """
    value, number = unused(df, "value"), unused(df, "number")
    values = df.select(F.col(column).cast("string").alias(value)).filter(F.col(value).isNotNull()).distinct()
    numbered = running(values, value, F.lit(1), number)
    joined = df.withColumn(value, F.col(column).cast("string")).join(numbered, value, "left")
    return joined.withColumn(name, F.coalesce(number, F.lit(-1))).drop(*{value, number} - {name}).select(*df.columns, *([] if name in df.columns else [name]))


def encoded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every text column but those kept replaced by its ordinals; numbers pass."""
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType) and f.name not in keep:
            df = ordinals(df, f.name, f.name)
    return df


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def digitized(x: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges are at or below x."""
    return reduce(lambda a, b: a + b, (F.when(x >= e, 1).otherwise(0) for e in edges))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with a column q0, q1, ... for each share: the exact quantile, between two values by their distance.

    Found among the running counts of the distinct values, so no task holds more than its range of them.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    placed = running(counts, "x", F.col("n"), "before")
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("x")))
    wide = placed.crossJoin(F.broadcast(placed.agg(F.sum("n").alias("all"))))  # one row
    place = [F.lit(float(s)) * (F.col("all") - 1) for s in shares]
    ends = wide.groupBy("all").agg(*(at(f(p)).alias(f"{c}{k}") for k, p in enumerate(place) for c, f in (("lo", F.floor), ("hi", F.ceil))))
    return ends.select(*((F.col(f"lo{k}") + (p - F.floor(p)) * (F.col(f"hi{k}") - F.col(f"lo{k}"))).alias(f"q{k}") for k, p in enumerate(place)))


def filled(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Nulls replaced by the column's mean, median, mode (the smallest of equal ones) or zero."""
    if how == "zero":
        return df.fillna(0, list(columns))
    fill = {c: unused(df, f"fill_{c}") for c in columns}
    if how == "mean":
        ones = [df.agg(*(F.avg(c).alias(fill[c]) for c in columns))]
    elif how == "median":
        ones = [quantiles(df, c, [0.5]).withColumnRenamed("q0", fill[c]) for c in columns]
    else:
        n = unused(df, "n")
        of = lambda c: df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(n))
        ones = [of(c).agg(F.min_by(c, F.struct((-F.col(n)).alias("a"), F.col(c).alias("b"))).alias(fill[c])) for c in columns]
    wide = reduce(lambda a, one: a.join(F.broadcast(one), how="left"), ones, df)  # one row each, none of a column without values
    return wide.select(*(F.coalesce(c, fill[c]).alias(c) if c in columns else F.col(c) for c in df.columns))


def scaled(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """minmax (constant: null), minmax0 (constant: 0), zscore (population spread, constant: 0)."""
    pick = {"minmax": (F.min, F.max), "minmax0": (F.min, F.max), "zscore": (F.avg, F.stddev_pop)}[how]
    one = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in zip("ab", pick, strict=True)))

    def out(c: str) -> Column:
        x, a, b = F.col(c).cast("double"), F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if how == "zscore":
            return (x - a) / F.when(b == 0, 1.0).otherwise(b)
        y = (x - a) / F.when(b > a, b - a)
        return y if how == "minmax" else F.when(b == a, F.when(x.isNotNull(), 0.0)).otherwise(y)

    wide = df.crossJoin(F.broadcast(one))  # one row
    return wide.select(*(out(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def stretched(df: DataFrame, key: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values of each key's rows mapped so that two of its percentiles become 0 and 1, clipped."""
    ends = df.groupBy(key).agg(F.percentile(value, F.lit(low)).alias("_a"), F.percentile(value, F.lit(high)).alias("_b"))
    y = (F.col(value) - F.col("_a")) / F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a"))
    return df.join(ends, key).withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(y, F.lit(0.0))))).drop("_a", "_b")


def first_match(rows: DataFrame, rules: DataFrame, antecedent: Sequence[str], label: str, order: str) -> DataFrame:
    """Rows with the label of the first rule that has the same antecedent, 0 where none has."""
    first = rules.groupBy(*antecedent).agg(F.min_by(label, order).alias(label))
    return rows.join(first, list(antecedent), "left").withColumn(label, F.coalesce(label, F.lit(0)))


def matched(rows: DataFrame, rules: DataFrame, antecedent: Sequence[str], label: str, order: str) -> DataFrame:
    """first_match without the rows that no rule has."""
    first = rules.groupBy(*antecedent).agg(F.min_by(label, order).alias(label))
    return rows.join(first, list(antecedent))


def without_conflicts(rules: DataFrame, antecedent: Sequence[str], label: str) -> DataFrame:
    """Rules whose antecedent has one label only."""
    one = rules.groupBy(*antecedent).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a = _b").drop("_a", "_b")
    return rules.join(one, list(antecedent), "left_semi")


def reduced(rules: DataFrame, antecedent: Sequence[str], label: str, weight: str, order: str) -> DataFrame:
    """One rule per antecedent: the label of its smallest weight, the first of equal ones."""
    return rules.groupBy(*antecedent).agg(F.min_by(label, F.struct(weight, order)).alias(label), F.min(weight).alias(weight))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the number of each row, from 0, in the order of a column without equal values."""
    return running(df, order, F.lit(1), name)


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of both side by side, the n-th with the n-th of the declared orders; the columns of a, then b's that a lacks.

    Tables of different lengths are zipped as far as the shorter one goes.
    """
    n = unused(a, unused(b, "place"))
    more = [c for c in b.columns if c not in a.columns]
    right = numbered(b, order_b, n).select(n, *more)
    return numbered(a, order_a, n).join(right, n).select(*a.columns, *more)


def overwritten(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with columns taken from the rows of `other` with the same key; null where there is none."""
    fresh = {c: unused(df, f"new_{c}") for c in columns}
    right = other.select(key, *(F.col(c).alias(fresh[c]) for c in columns))
    return df.join(right, key, "left").select(*(F.col(fresh[c]).alias(c) if c in fresh else F.col(c) for c in df.columns))


def neighbours(df: DataFrame, order: str, k: int, columns: Sequence[str]) -> DataFrame:
    """(order, other, same): pairs of ids at most k apart, and how many columns agree; a range join by buckets of ids."""
    a = df.select(F.col(order).alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns)).withColumn("slot", F.floor(F.col("a") / k))
    b = df.select(F.col(order).alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    b = b.withColumn("slot", F.explode(F.array(*(F.floor(F.col("b") / k) + i for i in (-1, 0, 1)))))
    same = reduce(lambda x, y: x + y, (F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1).otherwise(0) for c in columns))
    return a.join(b, "slot").filter((F.abs(F.col("a") - F.col("b")) <= k) & (F.col("a") != F.col("b"))).select(F.col("a").alias(order), F.col("b").alias("other"), same.alias("same"))
