"""Registered queries over the driver's tables, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.functions import membership as mf
from bramble.operators import balance, evaluation, graph, images, induction, rasters, selection, table
from bramble.plans import scenario
from bramble.session import table as read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns))


# ---- projection, recoding, encoding


@_query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '2' ELSE o_orderpriority END AS priority FROM orders")
def recode_dict(spark, d):
    return read(spark, d, "orders").select("o_orderkey", table.recoded(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2}).alias("priority"))


@_query("SELECT c_custkey, dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS code FROM customer")
def ordinal_encode(spark, d):
    return table.ordinals(read(spark, d, "customer"), "c_nationkey", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@_query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1 + CAST(o_orderkey % 2 AS INTEGER)) AS DOUBLE) AS n FROM orders")
def numeric_coerce(spark, d):
    return read(spark, d, "orders").select("o_orderkey", table.number(F.expr("substr(o_orderpriority, 1, 1 + int(o_orderkey % 2))")).alias("n"))


@_query("SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS price FROM part")
def whole_cast(spark, d):
    return read(spark, d, "part").select("p_partkey", table.whole(F.col("p_retailprice")).alias("price"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NA' WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderstatus END AS status FROM orders")
def blank_as_na(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", table.blank_as(raw).alias("status"))


@_query("SELECT p_partkey, CASE WHEN p_size < 0 THEN 0 ELSE LEAST(p_size // 16, 15) + 1 END AS bin FROM part")
def digitize(spark, d):
    return read(spark, d, "part").select("p_partkey", table.digitized(F.col("p_size"), range(0, 256, 16)).cast("int").alias("bin"))


@_query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity >= 45")
def threshold_distinct(spark, d):
    return read(spark, d, "lineitem").filter("l_quantity >= 45").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@_query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def keep_and_label_last(spark, d):
    return table.label_last(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice"), "o_orderstatus")


# ---- missing values and scaling

_HOLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"


def _holed(spark, d):
    gap = F.col("o_orderkey") % 7 == 0
    return read(spark, d, "orders").select("o_orderkey", F.when(~gap, F.col("o_totalprice")).alias("price"), F.when(~gap, F.col("o_orderpriority")).alias("priority"))


for _how, _sql in (("mean", "avg(price)"), ("median", "median(price)"), ("zero", "0")):
    _one = "0" if _how == "zero" else f"(SELECT {_sql} FROM {_HOLED})"
    ORACLES[f"impute_{_how}"] = f"SELECT o_orderkey, round(coalesce(price, {_one}), 4) AS price FROM {_HOLED}"
    QUERIES[f"impute_{_how}"] = lambda spark, d, how=_how: rounded(table.filled(_holed(spark, d), ["price"], how).select("o_orderkey", "price"), "price", places=4)


@_query(f"SELECT o_orderkey, coalesce(priority, (SELECT priority FROM {_HOLED} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM {_HOLED}")
def impute_mode(spark, d):
    return table.filled(_holed(spark, d), ["priority"], "mode").select("o_orderkey", "priority")


_SCALES = {
    "minmax": "(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())",
    "minmax0": "(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())",
    "zscore": "(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()",
}
for _how, _sql in _SCALES.items():
    ORACLES[f"scale_{_how}"] = f"SELECT p_partkey, round({_sql}, 6) AS price FROM part"
    QUERIES[f"scale_{_how}"] = lambda spark, d, how=_how: rounded(table.scaled(read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), ["price"], how), "price")


@_query("WITH e AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.02) AS a, quantile_cont(l_quantity, 0.98) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, round(sum(greatest(0, least(1, (l_quantity - a) / (b - a)))), 4) AS total FROM lineitem JOIN e USING (l_returnflag) GROUP BY 1")
def contrast_stretch(spark, d):
    s = table.stretched(read(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")
    return s.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("total"))


@_query("SELECT min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms, count(DISTINCT l_quantity) AS kinds FROM lineitem")
def column_summary(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").agg(F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.avg(q), 6).alias("mean"), F.round(F.var_pop(q), 6).alias("variance"), F.round(F.stddev_pop(q), 6).alias("deviation"), F.round(F.sqrt(F.avg(q * q)), 6).alias("rms"), F.count_distinct(q).alias("kinds"))


# ---- joins and rule tables over orders

_OB = "(SELECT o_orderkey AS rid, CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) + 1 AS f0, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS f1, CAST(month(o_orderdate) AS INTEGER) AS f2, CAST((quarter(o_orderdate) + 1) % 2 AS INTEGER) + 1 AS f3, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS label FROM orders)"
OB = ["f0", "f1", "f2", "f3"]


def ob(spark, d):
    """Rules from orders, with their key."""
    o = read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("rid"), (F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int") + 1).alias("f0"), F.substring("o_orderpriority", 1, 1).cast("int").alias("f1"),
        F.month("o_orderdate").cast("int").alias("f2"), ((F.quarter("o_orderdate") + 1) % 2 + 1).cast("int").alias("f3"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("label"),
    )


_KEYS = ", ".join(OB)


@_query(f"WITH ob AS {_OB}, first AS (SELECT {_KEYS}, arg_min(label, rid) AS predicted FROM ob WHERE rid % 10 < 7 GROUP BY ALL) SELECT rid, ob.label AS truth, coalesce(predicted, 0) AS label FROM ob LEFT JOIN first USING ({_KEYS}) WHERE rid % 10 >= 7")
def rule_predict(spark, d):
    rules = ob(spark, d)
    asked = rules.filter("rid % 10 >= 7").withColumn("truth", F.col("label")).drop("label")
    return table.first_match(asked, rules.filter("rid % 10 < 7"), OB, "label", "rid").select("rid", "truth", "label")


@_query(f"WITH ob AS (SELECT ob.*, o_custkey FROM {_OB} ob JOIN orders ON rid = o_orderkey) SELECT rid, {_KEYS}, o_custkey, label FROM ob JOIN (SELECT {_KEYS}, o_custkey FROM ob GROUP BY ALL HAVING min(label) = max(label)) USING ({_KEYS}, o_custkey)")
def conflict_free_rules(spark, d):
    rules = ob(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), "o_custkey"), "rid")
    return table.without_conflicts(rules, [*OB, "o_custkey"], "label").select("rid", *OB, "o_custkey", "label")


@_query(f"WITH ob AS (SELECT *, (rid % 97) / 97.0 AS w FROM {_OB}) SELECT {_KEYS}, label, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY w, rid) AS k FROM ob) WHERE k = 1")
def rule_reduce(spark, d):
    return rounded(table.reduced(ob(spark, d).withColumn("w", F.col("rid") % 97 / 97.0), OB, "label", "w", "rid").select(*OB, "label", "w"), "w")


@_query(f"WITH ob AS {_OB} SELECT a.rid, b.rid AS other, " + " + ".join(f"CAST(a.{c} = b.{c} AS INTEGER)" for c in OB) + " AS same FROM ob a JOIN ob b ON b.rid BETWEEN a.rid - 2 AND a.rid + 2 AND a.rid <> b.rid")
def neighbour_pairs(spark, d):
    return table.neighbours(ob(spark, d), "rid", 2, OB)


@_query(f"WITH ob AS {_OB} SELECT a.rid, b.rid AS other, round(CASE WHEN a.label <> b.label THEN -1.0 ELSE (1 + " + " + ".join(f"CAST(a.{c} = b.{c} AS INTEGER)" for c in OB) + ") / 5.0 END, 6) AS similarity FROM ob a JOIN ob b ON b.rid = a.rid + 1")
def rule_similarity(spark, d):
    a = ob(spark, d)
    b = a.select((F.col("rid") - 1).alias("rid"), F.col("rid").alias("other"), *(F.col(c).alias(f"b_{c}") for c in [*OB, "label"]))
    s = graph.similarity([F.col(c) for c in OB], [F.col(f"b_{c}") for c in OB], F.col("label"), F.col("b_label"))
    return a.join(b, "rid").select("rid", "other", F.round(s, 6).alias("similarity"))


@_query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_joins(spark, d):
    c, n, r = (read(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@_query(f"WITH ob AS {_OB} SELECT label, count(*) AS n FROM (SELECT label FROM ob WHERE rid % 10 < 7 UNION ALL SELECT label FROM ob WHERE rid % 10 >= 7) GROUP BY label")
def class_counts(spark, d):
    a = ob(spark, d)
    return a.filter("rid % 10 < 7").select("label").unionByName(a.filter("rid % 10 >= 7").select("label")).groupBy("label").agg(F.count("*").alias("n"))


# ---- scores of features

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CLASS = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"


def _items(spark, d):
    f = F.col("l_returnflag")
    return read(spark, d, "lineitem").select(*_NUMBERS, F.when(f == "A", 1).when(f == "N", 2).otherwise(3).alias("label"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, {_CLASS}), 6) AS corr FROM lineitem" for c in _NUMBERS))
def corr_label(spark, d):
    return rounded(selection.label_correlation(_items(spark, d), _NUMBERS, "label"), "corr")


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in combinations(_NUMBERS, 2)))
def corr_matrix_long(spark, d):
    return rounded(selection.correlations(_items(spark, d), _NUMBERS), "corr")


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM lineitem HAVING abs(corr({a}, {b})) > 0.001" for a, b in combinations(_NUMBERS, 2)))
def redundant_pairs(spark, d):
    return selection.correlations(_items(spark, d), _NUMBERS).filter("abs(corr) > 0.001").select("a", "b")


@_query("WITH a AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rb FROM part) SELECT round(corr(ra, rb), 6) AS rho FROM a")
def spearman(spark, d):
    return rounded(selection.spearman(read(spark, d, "part"), "p_size", "p_retailprice"), "rho")


def _anova_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(((sum(s*s/n) - sum(s)*sum(s)/sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s*s/n)) / (sum(n) - count(*))), 4) AS f FROM (SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum({c}*{c}) AS q FROM lineitem GROUP BY 1)"


@_query(" UNION ALL ".join(map(_anova_sql, _NUMBERS)))
def anova_f(spark, d):
    return rounded(selection.anova_f(_items(spark, d), _NUMBERS, "label"), "f", places=4)


@_query("SELECT feature FROM (" + " UNION ALL ".join(map(_anova_sql, _NUMBERS)) + ") ORDER BY f DESC, feature LIMIT 2")
def topk_features(spark, d):
    return selection.top(rounded(selection.anova_f(_items(spark, d), _NUMBERS, "label"), "f", places=4), "f", 2).select("feature")


_DISCRETE = ["l_discount", "l_tax", "l_quantity"]


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nx * ny))), 8) AS mi FROM (SELECT DISTINCT {c}, l_returnflag, CAST(count(*) OVER (PARTITION BY {c}, l_returnflag) AS DOUBLE) AS n, CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) AS nx, CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS ny, CAST(count(*) OVER () AS DOUBLE) AS t FROM lineitem)" for c in _DISCRETE))
def binned_mi(spark, d):
    return rounded(selection.binned_information(_items(spark, d), _DISCRETE, "label"), "mi", places=8)


@_query()
def neighbour_mi(spark, d):
    return selection.neighbour_information(read(spark, d, "part").withColumn("big", (F.col("p_size") > 25).cast("int")), ["p_retailprice", "p_size"], "big")


@_query()
def rf_importance(spark, d):
    return spark.createDataFrame(selection.forest_importance(_items(spark, d), _NUMBERS, "label"), "feature string, importance double")


@_query()
def filter_multimodal(spark, d):
    kept = selection.filter_multimodal(_items(spark, d), _NUMBERS[:2], _NUMBERS[2:], "label", 1, 1)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "rank int, feature string")


@_query()
def hadamard_fusion(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))
    return selection.hadamard(p, ["a", "c"], ["b"], ["p_partkey"], dim=3)


@_query()
def tensor_fusion(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))
    return rounded(selection.tensor(p, ["a", "c"], ["b", "a"], ["p_partkey"], rank=2), "svd0", "svd1", places=4)


@_query()
def pca_scores(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))
    return rounded(selection.principal(p, ["a", "b", "c"], ["p_partkey"], 2), "pc0", "pc1", places=4)


# ---- memberships and induction

_CENTRES = [5.0, 15.0, 25.0, 35.0, 45.0]
_AT = "[" + ", ".join(map(str, _CENTRES)) + "]"
_SIGMA = (45.0 - 5.0) / 2.3548200450309493
_MEMBER = {
    "gauss": (mf.gauss, "exp(-power(x - 25, 2) / (2 * 100))"),
    "exponential": (mf.exponential, "exp(-abs(x - 25) / 10)"),
    "sigmoid": (mf.sigmoid, "1 / (1 + exp(-(x - 25) / 10))"),
    "triangle": (mf.triangle, "CASE WHEN x < 15 OR x > 35 THEN 0 WHEN x <= 25 THEN (x - 15) / 10 ELSE (35 - x) / 10 END"),
    "trapezoid": (mf.trapezoid, "CASE WHEN x < 5 OR x > 45 THEN 0 WHEN x < 15 THEN (x - 5) / 10 WHEN x <= 35 THEN 1 ELSE (45 - x) / 10 END"),
}
for _name, (_f, _sql) in _MEMBER.items():
    ORACLES[f"member_{_name}"] = f"SELECT x, round(max({_sql}), 6) AS y, count(*) AS n FROM (SELECT l_quantity AS x FROM lineitem) GROUP BY x"
    QUERIES[f"member_{_name}"] = lambda spark, d, f=_f: rounded(read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n")).withColumn("y", f(F.col("x"), F.lit(25.0), F.lit(10.0))).select("x", "y", "n"), "y")


@_query("WITH s AS (SELECT n_regionkey, (max(n_nationkey) - min(n_nationkey)) / 1000.0 / (2 * sqrt(2 * ln(2))) AS raw FROM nation GROUP BY 1) SELECT n_regionkey, round(raw * power(10, greatest(0, ceil(-log10(raw)))), 6) AS sigma FROM s")
def sigma_from_centers(spark, d):
    g = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey") / 1000.0).alias("c"))
    return rounded(g.select("n_regionkey", mf.spread(F.col("c")).alias("sigma")), "sigma")


_NEAREST = "CASE WHEN x <= 10 THEN 1 WHEN x <= 20 THEN 2 WHEN x <= 30 THEN 3 WHEN x <= 40 THEN 4 ELSE 5 END"


@_query(f"SELECT bin, count(*) AS n FROM (SELECT {_NEAREST} AS bin FROM (SELECT l_quantity AS x FROM lineitem)) GROUP BY bin")
def nearest_center_bins(spark, d):
    b = induction.binned(read(spark, d, "lineitem").select(F.col("l_quantity").alias("bin")), {"bin": _CENTRES})
    return b.groupBy("bin").agg(F.count("*").alias("n"))


@_query(f"SELECT x, round(exp(-power(x - (10 * {_NEAREST} - 5), 2) / (2 * power({_SIGMA}, 2))), 6) AS strength FROM (SELECT DISTINCT l_quantity AS x FROM lineitem)")
def rule_strength(spark, d):
    return rounded(induction.strengths(read(spark, d, "lineitem").select(F.col("l_quantity").alias("x")).distinct(), {"x": _CENTRES}), "strength")


@_query(f"WITH ob AS {_OB} SELECT rid, CASE f0 WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' ELSE 'Very High' END AS f0, CASE f3 WHEN 1 THEN 'Low' ELSE 'High' END AS f3, label FROM ob")
def rule_language(spark, d):
    return induction.in_terms(ob(spark, d).select("rid", "f0", "f3", "label"), {"f0": 5, "f3": 2})


@_query()
def fcm_centers(spark, d):
    c = induction.centres_of(read(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), {"p_size": 5, "p_retailprice": 3})
    return c.select("feature", F.posexplode("centres").alias("k", "centre")).withColumn("centre", F.round("centre", 6))


@_query()
def kmeans_bins(spark, d):
    return induction.kmeans_bins(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", 3, "bin")


@_query()
def induced_rules(spark, d):
    """The whole way from numbers to labels of the held-out rows."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 3 + 1).cast("int").alias("label"))
    centres = induction.as_lists(induction.centres_of(p, {"p_size": 5, "p_retailprice": 3}))
    train, test = balance.split(p, "p_partkey", 70, 1)
    return induction.predicted(test.drop("label"), induction.binned(train, centres), centres, "label", "p_partkey")


# ---- the rule graph over lineitem

RB = ["f0", "f1", "f2", "f3", "f4"]
_RB = f"(SELECT CAST(ceil(l_quantity / 10) AS INTEGER) AS f0, CAST(round(l_discount * 100) AS INTEGER) // 3 + 1 AS f1, CAST(round(l_tax * 100) AS INTEGER) // 2 + 1 AS f2, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS f3, CAST(least(floor(l_extendedprice / 21000), 4) AS INTEGER) + 1 AS f4, {_CLASS} AS label, l_orderkey % 10 < 7 AS base FROM lineitem)"
_QUADS, _TRIPLES = list(combinations(RB, 4)), list(combinations(range(5), 3))
_WITH = (
    f"WITH rb AS {_RB}, kinds AS (SELECT f0, f1, f2, f3, f4, label, count(*) AS mult FROM rb WHERE base GROUP BY ALL), ante AS (SELECT f0, f1, f2, f3, f4, sum(mult) AS mult FROM kinds GROUP BY ALL), "
    + "shared AS (SELECT f0, f1, f2, f3, f4, CAST(" + " + ".join(f"sum(mult) OVER (PARTITION BY {', '.join(q)})" for q in _QUADS) + " AS BIGINT) AS s FROM ante), "
    + "m AS (" + " UNION ALL ".join(f"SELECT {i} AS feature, f{i} AS bin, label, CAST(sum(mult) AS BIGINT) AS m FROM kinds GROUP BY f{i}, label" for i in range(5)) + "), "
    + "wide AS (SELECT kinds.*, s, " + ", ".join(f"m{i}.m AS m{i}" for i in range(5)) + " FROM kinds JOIN shared USING (f0, f1, f2, f3, f4) " + " ".join(f"JOIN m m{i} ON m{i}.feature = {i} AND m{i}.bin = kinds.f{i} AND m{i}.label = kinds.label" for i in range(5)) + "), "
    + "b AS (" + " UNION ALL ".join(f"SELECT f0, f1, f2, f3, f4, label, mult, {t} AS t, f{x} AS v0, f{y} AS v1, f{z} AS v2, CAST(s AS HUGEINT) * least(m{x}, m{y}, m{z}) AS b FROM wide" for t, (x, y, z) in enumerate(_TRIPLES)) + "), "
    + "c AS (SELECT t, v0, v1, v2, label, sum(b * mult) AS c FROM b GROUP BY ALL), "
    + "keys AS (SELECT t, count(*) AS keys FROM (SELECT DISTINCT t, v0, v1, v2 FROM c) GROUP BY t), ends AS (SELECT t, label, CASE WHEN count(*) < any_value(keys) THEN 0 ELSE min(c) END AS lo, max(c) AS hi FROM c JOIN keys USING (t) GROUP BY t, label), "
    + "n AS (SELECT t, v0, v1, v2, label, CASE WHEN hi > lo THEN CAST(c - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) END AS score FROM c JOIN ends USING (t, label)), "
    + "asked AS (SELECT f0, f1, f2, f3, f4, label AS truth, count(*) AS mult FROM rb WHERE NOT base GROUP BY ALL), q AS (SELECT DISTINCT f0, f1, f2, f3, f4 FROM asked), "
    + "qt AS (" + " UNION ALL ".join(f"SELECT f0, f1, f2, f3, f4, {t} AS t, f{x} AS v0, f{y} AS v1, f{z} AS v2 FROM q" for t, (x, y, z) in enumerate(_TRIPLES)) + "), "
    + "d AS (SELECT f0, f1, f2, f3, f4, label, CASE WHEN count(*) < 10 THEN greatest(max(coalesce(score, 0)), 0) ELSE max(coalesce(score, 0)) END + CASE WHEN count(*) < 10 THEN least(min(coalesce(score, 0)), 0) ELSE min(coalesce(score, 0)) END AS d FROM qt JOIN n USING (t, v0, v1, v2) GROUP BY ALL), "
    + "best AS (SELECT f0, f1, f2, f3, f4, arg_max(label, d * 1e6 - label * 1e-9) AS unused, max(d) AS top, sum(d) AS al FROM d GROUP BY ALL), pick AS (SELECT best.f0, best.f1, best.f2, best.f3, best.f4, min(d.label) AS predicted, any_value(top) AS top, any_value(al) AS al FROM best JOIN d ON d.f0 = best.f0 AND d.f1 = best.f1 AND d.f2 = best.f2 AND d.f3 = best.f3 AND d.f4 = best.f4 AND d.d = best.top GROUP BY best.f0, best.f1, best.f2, best.f3, best.f4), "
    + "told AS (SELECT asked.*, CASE WHEN coalesce(al, 0) = 0 THEN 1 ELSE predicted END AS predicted, CASE WHEN coalesce(al, 0) = 0 THEN 0 ELSE top / al END AS confidence FROM asked LEFT JOIN pick USING (f0, f1, f2, f3, f4)) "
)


def rb(spark, d, label=None):
    """Rules from lineitem: five bins, a label, and whether a row is of the base."""
    c = F.col
    f = c("l_returnflag")
    return read(spark, d, "lineitem").select(
        F.ceil(c("l_quantity") / 10).cast("int").alias("f0"), F.expr("int(round(l_discount * 100)) div 3 + 1").cast("int").alias("f1"), F.expr("int(round(l_tax * 100)) div 2 + 1").cast("int").alias("f2"),
        F.when(c("l_linestatus") == "F", 1).otherwise(2).alias("f3"), (F.least(F.floor(c("l_extendedprice") / 21000), F.lit(4)).cast("int") + 1).alias("f4"),
        (F.when(f == "A", 1).when(f == "N", 2).otherwise(3) if label is None else label).alias("label"), (c("l_orderkey") % 10 < 7).alias("base"),
    )


def _kinds(spark, d):
    return graph.checked(rb(spark, d).filter("base"), RB, "label")


def _asked(spark, d):
    return rb(spark, d).filter("not base").groupBy(*RB, F.col("label").alias("truth")).agg(F.count("*").alias("mult"))


def _told(spark, d, **how):
    scores = graph.normalized(graph.model(_kinds(spark, d), RB, "label"), "label")
    return graph.inferred(_asked(spark, d), scores, RB, "label", **how)


def _v():
    return [F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)]


@_query(_WITH + "SELECT f0, f1, f2, f3, f4, s FROM shared")
def graph_a_sum(spark, d):
    return graph.shared(_kinds(spark, d), RB)


@_query(_WITH + "SELECT feature, bin, label, m FROM m")
def graph_m(spark, d):
    return graph.memberships(_kinds(spark, d), RB, "label")


@_query(_WITH + "SELECT f0, f1, f2, f3, f4, label, mult, t, v0, v1, v2, CAST(b AS DOUBLE) AS b FROM b")
def graph_b(spark, d):
    return graph.triples(_kinds(spark, d), RB, "label").select(*RB, "label", "mult", "t", *_v(), F.col("b").cast("double").alias("b"))


@_query(_WITH + "SELECT t, v0, v1, v2, label, CAST(c AS DOUBLE) AS c FROM c")
def graph_c(spark, d):
    return graph.model(_kinds(spark, d), RB, "label").select("t", *_v(), "label", F.col("c").cast("double").alias("c"))


@_query(_WITH + "SELECT t, v0, v1, v2, label, round(score, 6) AS score FROM n")
def graph_c_norm(spark, d):
    return graph.normalized(graph.model(_kinds(spark, d), RB, "label"), "label").select("t", *_v(), "label", F.round("score", 6).alias("score"))


@_query(_WITH + "SELECT f0, f1, f2, f3, f4, truth, mult, predicted, round(confidence, 6) AS confidence FROM told")
def graph_infer(spark, d):
    return rounded(_told(spark, d), "confidence").select(*RB, "truth", "mult", "predicted", "confidence")


@_query()
def graph_infer_averaged(spark, d):
    return rounded(_told(spark, d, variant="averaged"), "confidence")


@_query(_WITH + "SELECT asked.*, CASE WHEN coalesce(d1, 0) = 0 AND coalesce(al, 0) = 0 THEN 1 WHEN d1 > 9 * d2 THEN 1 ELSE 2 END AS predicted FROM asked LEFT JOIN (SELECT f0, f1, f2, f3, f4, coalesce(sum(d) FILTER (label = 1), 0) AS d1, coalesce(sum(d) FILTER (label = 2), 0) AS d2, sum(d) AS al FROM d GROUP BY ALL) USING (f0, f1, f2, f3, f4)")
def graph_infer_biased(spark, d):
    return _told(spark, d, bias=9.0).select(*RB, "truth", "mult", "predicted")


@_query()
def graph_sampling(spark, d):
    return graph.sampled(ob(spark, d), OB, "label", "rid", 20, 0.2, 1)


@_query(f"WITH ob AS {_OB} SELECT count(*) AS n FROM ob WHERE label IN (1, 2, 3)")
def label_check(spark, d):
    return graph.checked(ob(spark, d), OB, "label").agg(F.sum("mult").alias("n"))


# ---- evaluation


@_query(_WITH + "SELECT truth, predicted, CAST(sum(mult) AS BIGINT) AS n FROM told GROUP BY ALL")
def confusion(spark, d):
    return evaluation.confusion(_told(spark, d), "truth", "predicted", "mult")


@_query(_WITH + "SELECT round(100.0 * sum(CASE WHEN truth = predicted THEN mult ELSE 0 END) / sum(mult), 2) AS accuracy FROM told")
def accuracy(spark, d):
    return evaluation.accuracy(_told(spark, d), "truth", "predicted", "mult")


_PER = (
    "per AS (SELECT label, coalesce(p, 0) AS precision, coalesce(r, 0) AS recall FROM (SELECT predicted AS label, round(100.0 * sum(CASE WHEN truth = predicted THEN mult ELSE 0 END) / sum(mult), 2) AS p FROM told GROUP BY 1) "
    "FULL JOIN (SELECT truth AS label, round(100.0 * sum(CASE WHEN truth = predicted THEN mult ELSE 0 END) / sum(mult), 2) AS r FROM told GROUP BY 1) USING (label)) "
)


@_query(_WITH.rstrip() + ", " + _PER + "SELECT label, precision, recall FROM per")
def precision_recall(spark, d):
    return evaluation.per_label(_told(spark, d), "truth", "predicted", "mult")


@_query(_WITH.rstrip() + ", " + _PER + "SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 4) AS f1 FROM per")
def precision_recall_macro(spark, d):
    return rounded(evaluation.macro(_told(spark, d), "truth", "predicted", "mult"), "precision", "recall", "f1", places=4)


@_query(_WITH + "SELECT round(confidence, 1) AS confidence, CAST(sum(mult) AS BIGINT) AS n FROM told GROUP BY 1")
def confidence_hist(spark, d):
    return evaluation.confidence_counts(_told(spark, d), "confidence", "mult", places=1)




@_query(
    "WITH x AS (SELECT n_regionkey AS a, k AS b, CAST(n_nationkey * 7 % 11 + k AS DOUBLE) AS v FROM nation, range(3) t(k)), cell AS (SELECT a, b, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY ALL), "
    "t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS c, count(*) AS k FROM cell), ta AS (SELECT sum(s * s / n) AS c, count(*) AS k FROM (SELECT a, sum(n) AS n, sum(s) AS s FROM cell GROUP BY a)), tb AS (SELECT sum(s * s / n) AS c, count(*) AS k FROM (SELECT b, sum(n) AS n, sum(s) AS s FROM cell GROUP BY b)) "
    "SELECT 'a' AS source, round(ta.c - t.s * t.s / t.n, 6) AS ss, CAST(ta.k - 1 AS BIGINT) AS df FROM t, ta UNION ALL SELECT 'b', round(tb.c - t.s * t.s / t.n, 6), CAST(tb.k - 1 AS BIGINT) FROM t, tb "
    "UNION ALL SELECT 'interaction', round(t.c - ta.c - tb.c + t.s * t.s / t.n, 6) + 0.0, CAST((ta.k - 1) * (tb.k - 1) AS BIGINT) FROM t, ta, tb UNION ALL SELECT 'residual', round(t.q - t.c, 6), CAST(t.n - t.k AS BIGINT) FROM t"
)
def anova_two_way_ss(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("b"), F.col("n_nationkey").alias("k"))
    rows = evaluation.two_way_sums(n.withColumn("v", (F.col("k") * 7 % 11 + F.col("b")).cast("double")), "v", "a", "b")
    return spark.createDataFrame([(r["source"], round(r["ss"], 6) + 0.0, r["df"]) for r in rows], "source string, ss double, df long")


@_query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS deviation FROM customer GROUP BY 1")
def group_summary(spark, d):
    return rounded(evaluation.summary(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "mean", "deviation")


@_query()
def tukey_pairs(spark, d):
    return spark.createDataFrame(evaluation.tukey(read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "group1 string, group2 string, meandiff double, p_adj double, reject boolean")


# ---- images: embeddings seen as 8 x 8 grids of 16 levels

_PX = "(SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(least(greatest(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.4) * 20), 0), 15) AS INTEGER) AS v FROM embeddings, range(64) t(i))"


def pixels(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.4) * 20), F.lit(0)), F.lit(15)).cast("int")
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("v"))


_STEPS = "(VALUES (0, 0, 1), (45, 1, 1), (90, 1, 0), (135, 1, -1)) s(angle, dy, dx)"
_PAIRS = f"px AS {_PX}, one AS (SELECT a.image_id, angle, a.v AS i, b.v AS j FROM px a, {_STEPS}, px b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx), cc AS (SELECT image_id, angle, i, j, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT image_id, angle, j, i FROM one) GROUP BY ALL)"


@_query(f"WITH {_PAIRS} SELECT image_id, angle, i, j, n FROM cc")
def glcm_counts(spark, d):
    return images.cooccurrence(pixels(spark, d))


@_query(f"WITH {_PAIRS} SELECT image_id, angle, i, j, count(*) AS n FROM one GROUP BY ALL")
def glcm_asymmetric(spark, d):
    return images.cooccurrence(pixels(spark, d), symmetric=False)


@_query(
    f"WITH {_PAIRS}, t AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER w AS p, CAST(sum(n * i) OVER w AS DOUBLE) / sum(n) OVER w AS mi, CAST(sum(n * j) OVER w AS DOUBLE) / sum(n) OVER w AS mj FROM cc WINDOW w AS (PARTITION BY image_id, angle)), "
    "f AS (SELECT image_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, sum(p * (i - mi) * (i - mi)) AS vi, sum(p * (j - mj) * (j - mj)) AS vj, sum(p * (i - mi) * (j - mj)) AS cov FROM t GROUP BY ALL) "
    "SELECT image_id, round(avg(contrast), 6) AS contrast, round(avg(dissimilarity), 6) AS dissimilarity, round(avg(homogeneity), 6) AS homogeneity, round(avg(sqrt(asm)), 6) AS energy, round(avg(CASE WHEN vi < 1e-15 OR vj < 1e-15 THEN 1 ELSE cov / sqrt(vi * vj) END), 6) AS correlation, round(avg(asm), 6) AS asm FROM f GROUP BY image_id"
)
def glcm_features(spark, d):
    return rounded(images.texture(images.cooccurrence(pixels(spark, d))), "contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")


@_query(
    f"WITH px AS {_PX}, h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT image_id, v, CAST(sum(n) OVER o AS DOUBLE) AS n0, CAST(sum(n * v) OVER o AS DOUBLE) AS s0, CAST(sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * v) OVER w AS DOUBLE) AS s1 FROM h WINDOW w AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY v)), "
    "b AS (SELECT image_id, v, round(n0 * (n1 - n0) * power(s0 / n0 - (s1 - s0) / (n1 - n0), 2) / (n1 * n1), 9) AS g FROM c WHERE n0 < n1) SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g DESC, v) AS k FROM b) WHERE k = 1"
)
def otsu_threshold(spark, d):
    return images.otsu(pixels(spark, d))


@_query(f"WITH px AS {_PX} SELECT image_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS deviation, round(sqrt(avg(v * v)), 6) AS rms FROM px GROUP BY image_id")
def pixel_moments(spark, d):
    return rounded(images.moments(pixels(spark, d)), "mean", "variance", "deviation", "rms")


# ---- splits and balance


_SLOT = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) % {n}"


@_query(f"SELECT o_orderkey, {_SLOT.format(seed=42, n=5)} AS fold FROM orders")
def kfold_assign(spark, d):
    return balance.folds(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@_query(f"SELECT o_orderkey, CASE WHEN {_SLOT.format(seed=17, n=100)} < 70 THEN 'train' ELSE 'test' END AS part FROM orders")
def hash_split(spark, d):
    a, b = balance.split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 70, 17)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


_DANGER = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey * 37 % 101 AS DOUBLE) AS y, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS label FROM part)"


def _points(spark, d):
    return read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") * 37 % 101).cast("double").alias("y"), F.when(F.col("p_size") % 5 == 0, 2).otherwise(1).alias("label"))


@_query(f"WITH pt AS {_DANGER}, near AS (SELECT q.p_partkey, n.label, row_number() OVER (PARTITION BY q.p_partkey ORDER BY (q.x - n.x) * (q.x - n.x) + (q.y - n.y) * (q.y - n.y), n.p_partkey) AS k FROM pt q JOIN pt n ON q.p_partkey <> n.p_partkey WHERE q.label = 2) SELECT p_partkey, count(*) FILTER (label <> 2) AS foreign_rows FROM near WHERE k <= 10 GROUP BY 1 HAVING count(*) FILTER (label <> 2) BETWEEN 5 AND 9")
def knn_danger_set(spark, d):
    return balance.danger(_points(spark, d), "p_partkey", ["x", "y"], "label", 2)


@_query()
def smote_rows(spark, d):
    return balance.borderline(_points(spark, d), "p_partkey", ["x", "y"], "label", 2)


# ---- whole images, long runs


def _rastered(spark, d, step):
    p = pixels(spark, d).withColumn("v", F.col("v") * 16)
    return rounded(rasters.to_pixels(rasters.each(rasters.from_pixels(p), step)), "v")


for _name, _step in (
    ("image_resize", lambda a: rasters.resized(a, 16, 16)), ("image_sharpen", rasters.sharpened), ("image_equalize", lambda a: rasters.equalized(rasters.resized(a, 64, 64))),
    ("image_darkest", rasters.darkest), ("image_hair_removal", lambda a: rasters.without_hairs(a, 3)), ("image_denoise", lambda a: rasters.denoised(a, 10.0, 3, 5)),
):
    QUERIES[_name] = lambda spark, d, step=_step: _rastered(spark, d, step)


@_query(f"WITH px AS {_PX}, h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT image_id, v, CAST(sum(n) OVER o AS DOUBLE) AS n0, CAST(sum(n * v) OVER o AS DOUBLE) AS s0, CAST(sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * v) OVER w AS DOUBLE) AS s1 FROM h WINDOW w AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY v)), b AS (SELECT image_id, v, round(n0 * (n1 - n0) * power(s0 / n0 - (s1 - s0) / (n1 - n0), 2) / (n1 * n1), 9) AS g FROM c WHERE n0 < n1), th AS (SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g DESC, v) AS k FROM b) WHERE k = 1) SELECT image_id, y, x, CASE WHEN v > threshold THEN v ELSE 0 END AS v FROM px JOIN th USING (image_id)")
def masked_pixels(spark, d):
    return images.masked(pixels(spark, d))


@_query()
def wrapper_selection(spark, d):
    size, price, key = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey")
    part = read(spark, d, "part").select(size.alias("size"), (key * 37 % 101).cast("double").alias("grey"), (size % 7).alias("week"), price.alias("price"), (key % 17).cast("double").alias("shelf"), ((size + price / 100) % 5).alias("mixed"), ((size > 25) != (price > 1500)).cast("int").alias("label"))
    kept = selection.forward_wrapper(part, ["size", "grey", "week"], ["price", "shelf", "mixed"], "label")
    return spark.createDataFrame(list(enumerate(kept)), "rank int, feature string")


@_query()
def sampled_graph_runs(spark, d):
    rules = ob(spark, d)
    runs = scenario.sampled_runs(rules.filter("rid % 10 < 7"), rules.filter("rid % 10 >= 7"), OB, "label", "rid")
    return spark.createDataFrame([(str(r["turn"]), float(r["accuracy"])) for r in runs], "turn string, accuracy double")


@_query()
def anova_two_way(spark, d):
    c = read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return spark.createDataFrame([(r["source"], r["ss"], r["df"], r["f"], r["p"]) for r in evaluation.two_way(c, "o_totalprice", "o_orderstatus", "o_orderpriority")], "source string, ss double, df long, f double, p double")
