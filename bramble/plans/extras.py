"""More registered queries: sources and sinks, keyed forms of positional steps, older kernels, whole ways from files to figures."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.functions import membership as mf
from bramble.functions import recodes
from bramble.operators import balance, evaluation, graph, images, induction, rasters, selection, table
from bramble.plans import catalogue, scenario
from bramble.plans.catalogue import _CLASS, _DISCRETE, _NUMBERS, _OB, _PX, _TRIPLES, _WITH, OB, RB, _anova_sql, _items, ob, pixels, rb, rounded
from bramble.session import table as read
from bramble.sources import files, pictures
from bramble.sources.shared import fresh_path
from bramble.streaming.scorer import appended, scored_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- sources and sinks, through the shared folder


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    path = fresh_path(spark, "nation-csv")
    files.write_csv(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@_query("SELECT r_regionkey, r_name FROM region")
def headerless_text(spark, d):
    path = fresh_path(spark, "region-text")
    read(spark, d, "region").select("r_regionkey", "r_name").write.csv(path, header=False)
    return files.read_csv(spark, path, "r_regionkey long, r_name string", header=False)


@_query("SELECT c_custkey, c_mktsegment FROM customer")
def stray_index_dropped(spark, d):
    path = fresh_path(spark, "customer-csv")
    c = read(spark, d, "customer").select((F.col("c_custkey") - 1).alias("Unnamed: 0"), "c_custkey", "c_mktsegment")
    files.write_csv(c, path)
    return table.without(files.read_csv(spark, path, "`Unnamed: 0` long, c_custkey long, c_mktsegment string"), ["Unnamed: 0", "index"])


@_query("SELECT method, metric, value FROM (SELECT 'mean' AS method, 'quantity' AS metric, round(avg(l_quantity), 6) AS value FROM lineitem UNION ALL SELECT 'mean', 'discount', round(avg(l_discount), 6) FROM lineitem)")
def metric_log(spark, d):
    path = fresh_path(spark, "log")
    for c in ("quantity", "discount"):
        files.append_metrics(read(spark, d, "lineitem").agg(F.round(F.avg(f"l_{c}"), 6).alias("value")).select(F.lit("mean").alias("method"), F.lit(c).alias("metric"), "value"), path)
    return spark.read.parquet(path)


@_query(_WITH + "SELECT 'M' AS part, CAST(feature AS VARCHAR) AS key, label, CAST(m AS DOUBLE) AS weight FROM m UNION ALL SELECT 'C', concat_ws('|', t, v0, v1, v2), label, CAST(c AS DOUBLE) FROM c UNION ALL SELECT 'A', concat_ws('|', f0, f1, f2, f3, f4), 0, CAST(s AS DOUBLE) FROM shared")
def model_folder(spark, d):
    """The graph's weights saved as a folder of tables, and read again."""
    kinds, path = graph.checked(rb(spark, d).filter("base"), RB, "label"), fresh_path(spark, "model")
    files.save_model({"A": graph.shared(kinds, RB), "M": graph.memberships(kinds, RB, "label"), "C": graph.model(kinds, RB, "label")}, path)
    m = files.load_model(spark, path, ["A", "M", "C"])
    weight = lambda c: F.col(c).cast("double").alias("weight")
    out = m["M"].select(F.lit("M").alias("part"), F.col("feature").cast("string").alias("key"), "label", weight("m"))
    out = out.unionByName(m["C"].select(F.lit("C").alias("part"), F.concat_ws("|", F.col("t").cast("string"), F.transform("v", lambda x: x.cast("string"))).alias("key"), "label", weight("c")))
    return out.unionByName(m["A"].select(F.lit("A").alias("part"), F.concat_ws("|", *(F.col(c).cast("string") for c in RB)).alias("key"), F.lit(0).alias("label"), weight("s")))


_ABC = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(p_partkey % 17 AS DOUBLE) AS c FROM part)"
_SQUARES = "round({}, 3)".format(" + ".join(f"power({c} - avg({c}) OVER (), 2)" for c in "abc"))


def _abc(spark, d):
    return read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 17).cast("double").alias("c"))


def _norm(columns):
    return F.round(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)), 3)


@_query(f"SELECT p_partkey, {_SQUARES} AS squares FROM {_ABC}")
def pca_model(spark, d):
    """All components of a saved model turn the rows only: their lengths stay."""
    path = fresh_path(spark, "model")
    files.save_model({"components": selection.components_of(_abc(spark, d), ["a", "b", "c"], 3)}, path)
    model = files.load_model(spark, path, ["components"])["components"]
    return selection.projected(_abc(spark, d), model, ["p_partkey"]).select("p_partkey", _norm(["pc0", "pc1", "pc2"]).alias("squares"))


@_query(f"SELECT p_partkey, {_SQUARES} AS squares FROM {_ABC}")
def joined_scores(spark, d):
    """Scores of two tables side by side by their key."""
    one = selection.principal(_abc(spark, d), ["a", "b"], ["p_partkey"], 2)
    other = selection.principal(_abc(spark, d), ["c"], ["p_partkey"], 1).withColumnRenamed("pc0", "other0")
    return one.join(other, "p_partkey").select("p_partkey", _norm(["pc0", "pc1", "other0"]).alias("squares"))


@_query("SELECT o_orderkey, label FROM (SELECT rid AS o_orderkey, coalesce(p, 0) AS label FROM (SELECT rid, f0, f1, f2, f3 FROM " + _OB + " WHERE rid % 10 >= 7) LEFT JOIN (SELECT f0, f1, f2, f3, arg_min(label, rid) AS p FROM " + _OB + " WHERE rid % 10 < 7 GROUP BY ALL) USING (f0, f1, f2, f3))")
def stream_scored(spark, d):
    """Rules on a stream of rows, appended to a table by micro-batches and read when all are through."""
    rows, out = fresh_path(spark, "asked"), fresh_path(spark, "told")
    base, centres = ob(spark, d), {c: [float(k) for k in range(1, 13)] for c in OB}
    base.filter("rid % 10 >= 7").drop("label").write.parquet(rows)
    rules = base.filter("rid % 10 < 7")
    stream = scored_stream(spark.readStream.schema(base.drop("label").schema).parquet(rows), rules, centres, "label", "rid")
    appended(stream, out, fresh_path(spark, "offsets"))
    return spark.read.parquet(out).select(F.col("rid").alias("o_orderkey"), "label")


# ---- columns and codes


@_query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def drop_list(spark, d):
    s = read(spark, d, "supplier")
    return table.without(s, [c for c in s.columns if c not in ("s_suppkey", "s_nationkey", "s_acctbal")])


@_query("SELECT 'first' AS half, 'o_orderkey' AS feature UNION ALL SELECT 'first', 'o_custkey' UNION ALL SELECT 'second', 'o_totalprice' UNION ALL SELECT 'second', 'o_orderpriority'")
def positional_halves(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    halves = table.halves(o, "o_orderstatus")
    return spark.createDataFrame([(n, c) for n, half in zip(("first", "second"), halves, strict=True) for c in half], "half string, feature string")


def _case(column: str, to: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in to.items()) + f" ELSE {column} END"


@_query(
    "WITH x AS (SELECT n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'UNK' ELSE 'maybe' END AS itch, CASE n_nationkey % 2 WHEN 0 THEN 'FEMALE' ELSE 'MALE' END AS gender FROM nation) "
    f"SELECT n_nationkey, {_case('n_name', recodes.COUNTRY)} AS country, {_case('itch', recodes.ANSWER)} AS itch, {_case('itch', recodes.ANSWER_FUSED)} AS fused, {_case('gender', recodes.GENDER)} AS gender FROM x"
)
def recode_tables(spark, d):
    k = F.col("n_nationkey")
    itch = F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "UNK").otherwise("maybe")
    gender = F.when(k % 2 == 0, "FEMALE").otherwise("MALE")
    return read(spark, d, "nation").select("n_nationkey", table.recoded(F.col("n_name"), recodes.COUNTRY).alias("country"), table.recoded(itch, recodes.ANSWER).alias("itch"), table.recoded(itch, recodes.ANSWER_FUSED).alias("fused"), table.recoded(gender, recodes.GENDER).alias("gender"))


@_query("WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE NULL END AS n FROM orders) SELECT o_orderkey, round(coalesce(CAST(n AS DOUBLE), (SELECT avg(CAST(n AS DOUBLE)) FROM x)), 6) AS itch FROM x")
def case_hazard(spark, d):
    """'no' is not 'No': the table doesn't know it, it is no number, and so it becomes the mean."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "No").when(k % 3 == 1, "Yes").otherwise("no")
    x = read(spark, d, "orders").select("o_orderkey", table.number(table.recoded(raw, {"No": 0, "Yes": 1})).alias("itch"))
    return rounded(table.filled(x, ["itch"], "mean"), "itch")


@_query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment, c_nationkey FROM customer")
def encode_text_columns(spark, d):
    return table.encoded(read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")).withColumn("c_mktsegment", F.col("c_mktsegment").cast("long"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY c_custkey % 5 = 0 ORDER BY c_mktsegment) - 1 AS BIGINT) END AS code FROM customer")
def category_codes(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("value"))
    return table.ordinals(c, "value", "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_columns(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return o.select(*table.numeric(o))


@_query(f"SELECT rid, CASE f0 WHEN 1 THEN 'tiny' WHEN 2 THEN 'small' WHEN 3 THEN 'large' END AS f0 FROM {_OB}")
def explicit_terms(spark, d):
    return ob(spark, d).select("rid", mf.term_of(F.col("f0"), ["tiny", "small", "large"]).alias("f0"))


@_query("SELECT 'l_quantity' AS feature, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem")
def global_ranges(spark, d):
    return induction.ranges(read(spark, d, "lineitem"), ["l_quantity", "l_tax"])


# ---- joins by place, said by keys


@_query("SELECT c_custkey, c_name, s_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) USING (k)")
def positional_zip(spark, d):
    c, s = read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "supplier").select("s_suppkey", "s_name")
    return table.zipped(c, s, "c_custkey", "s_suppkey").select("c_custkey", "c_name", "s_name")


@_query("SELECT o_orderkey, o_totalprice, coalesce(c_nationkey, -1) AS o_custkey FROM (SELECT o_orderkey, o_totalprice FROM orders) LEFT JOIN (SELECT c_custkey AS o_orderkey, c_nationkey FROM customer) USING (o_orderkey)")
def aligned_overwrite(spark, d):
    other = read(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_nationkey").alias("o_custkey"))
    out = table.overwritten(read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), other, "o_orderkey", ["o_custkey"])
    return out.fillna(-1, ["o_custkey"])


@_query(f"WITH ob AS {_OB} SELECT rid, ob.label AS truth, p AS label FROM ob JOIN (SELECT f0, f1, f2, f3, arg_min(label, rid) AS p FROM ob WHERE rid % 10 < 2 GROUP BY ALL) USING (f0, f1, f2, f3) WHERE rid % 10 >= 7")
def matched_only(spark, d):
    rules = ob(spark, d)
    asked = rules.filter("rid % 10 >= 7").withColumn("truth", F.col("label")).drop("label")
    return table.matched(asked, rules.filter("rid % 10 < 2"), OB, "label", "rid").select("rid", "truth", "label")


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity + 2 * l_tax + 4 * l_discount, 6) AS checksum FROM lineitem")
def horizontal_concat(spark, d):
    """Two arrays of features as one."""
    both = F.concat(F.array("l_quantity"), F.array("l_tax", "l_discount"))
    checksum = F.aggregate(F.transform(both, lambda x, i: x * F.pow(F.lit(2), i)), F.lit(0.0), lambda a, x: a + x)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(checksum, 6).alias("checksum"))


# ---- counts, scores and orders


@_query("SELECT feature, CAST(least(n, 3) AS INTEGER) AS three, CAST(CASE WHEN n IN (2, 3) THEN n ELSE 5 END AS INTEGER) AS five FROM (SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem)")
def adaptive_clusters(spark, d):
    l, c = read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"]
    return induction.adaptive_clusters(l, c).withColumnRenamed("k", "three").join(induction.adaptive_clusters(l, c, "five").withColumnRenamed("k", "five"), "feature")


@_query(f"SELECT count(DISTINCT label) AS n FROM {_OB}")
def class_total(spark, d):
    a = ob(spark, d)
    return spark.createDataFrame([(graph.classes(a.filter("rid % 10 < 7"), a.filter("rid % 10 >= 7"), label="label"),)], "n long")


@_query("SELECT feature, round(c, 6) AS corr FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {_CLASS}) AS c FROM lineitem" for c in _NUMBERS) + ") WHERE abs(c) > 0.002")
def corr_above(spark, d):
    return rounded(selection.above(selection.label_correlation(_items(spark, d), _NUMBERS, "label"), "corr", 0.002), "corr")


def _mi_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT DISTINCT {c}, l_returnflag, CAST(count(*) OVER (PARTITION BY {c}, l_returnflag) AS DOUBLE) AS n, CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) AS nx, CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS ny, CAST(count(*) OVER () AS DOUBLE) AS t FROM lineitem)"


@_query("SELECT feature, round(mi, 8) AS mi FROM (" + " UNION ALL ".join(map(_mi_sql, _DISCRETE)) + ") ORDER BY mi DESC LIMIT 2")
def select_by_information(spark, d):
    return rounded(selection.top(selection.informative(_items(spark, d), _DISCRETE, "label", bins=64), "mi", 2), "mi", places=8)


@_query("SELECT feature, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS place FROM (SELECT feature, list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], feature) AS place FROM (" + " UNION ALL ".join(map(_anova_sql, _NUMBERS)) + ") ORDER BY f DESC, feature LIMIT 2)")
def topk_in_column_order(spark, d):
    best = selection.top(rounded(selection.anova_f(_items(spark, d), _NUMBERS, "label"), "f", places=4), "f", 2)
    return spark.createDataFrame([(c, k) for k, c in enumerate(selection.in_column_order(best, _NUMBERS))], "feature string, place int")


@_query(
    "WITH x AS (SELECT c_mktsegment AS method, c_nationkey % 2 AS k, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY ALL) "
    "SELECT a.method, round(a.m, 4) AS mean_1, round(a.s, 4) AS deviation_1, round(b.m, 4) AS mean_2, round(b.s, 4) AS deviation_2, round(sqrt(a.s * a.s + b.s * b.s), 4) AS combined FROM x a JOIN x b ON a.method = b.method AND a.k = 0 AND b.k = 1"
)
def combined_spread(spark, d):
    c = read(spark, d, "customer").withColumn("metric", F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd"))
    out = evaluation.combined_spread(c, "c_acctbal", "c_mktsegment", "metric", ("even", "odd"))
    return rounded(out.withColumnRenamed("c_mktsegment", "method"), "mean_1", "deviation_1", "mean_2", "deviation_2", "combined", places=4)


@_query("SELECT o_orderkey, o_orderstatus FROM orders")
def shuffled_rows(spark, d):
    return balance.shuffled(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


_SLOT = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT) % {n}"


@_query(f"SELECT o_orderkey, {_SLOT.format(key='o_orderkey', seed=1, n=100)} < 70 AS trains, {_SLOT.format(key='o_orderkey', seed=2, n=100)} < 30 AS tests FROM orders")
def overlapping_split(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    a, b = balance.overlapping(o, "o_orderkey", 70)
    out = o.join(a.withColumn("trains", F.lit(True)), "o_orderkey", "left").join(b.withColumn("tests", F.lit(True)), "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("trains", F.lit(False)).alias("trains"), F.coalesce("tests", F.lit(False)).alias("tests"))


_F_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END"


@_query(
    f"WITH x AS (SELECT o_orderpriority AS a, {_F_STATUS} AS b, CAST(o_totalprice AS DOUBLE) AS v FROM orders), ga AS (SELECT *, v - avg(v) OVER (PARTITION BY a) AS va, b - avg(b) OVER (PARTITION BY a) AS ba, v - avg(v) OVER (PARTITION BY b) AS vb, v - avg(v) OVER (PARTITION BY a, b) AS vc FROM x), "
    "r AS (SELECT sum(va * va) AS rss_a, sum(vb * vb) AS rss_b, sum(va * ba) * sum(va * ba) / sum(ba * ba) AS b_after_a, sum(vc * vc) AS rest, count(*) AS n, count(DISTINCT a) AS ka FROM ga), t AS (SELECT *, rss_a - b_after_a AS rss_ab FROM r) "
    "SELECT 'a' AS source, round((rss_b - rss_ab) / 1e6, 3) AS ss, ka - 1 AS df, round((rss_b - rss_ab) / (ka - 1) / (rest / (n - 2 * ka)), 5) AS f FROM t UNION ALL SELECT 'b', round(b_after_a / 1e6, 3), 1, round(b_after_a / (rest / (n - 2 * ka)), 5) FROM t "
    "UNION ALL SELECT 'interaction', round((rss_ab - rest) / 1e6, 3), ka - 1, round((rss_ab - rest) / (ka - 1) / (rest / (n - 2 * ka)), 5) FROM t UNION ALL SELECT 'residual', round(rest / 1e6, 3), n - 2 * ka, NULL FROM t"
)
def anova_unbalanced(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), (F.col("o_orderstatus") == "F").alias("b"), F.col("o_totalprice").cast("double").alias("v"))
    rows = [(r["source"], round(r["ss"] / 1e6, 3), r["df"], None if r["f"] is None else round(r["f"], 5)) for r in evaluation.two_way(o, "v", "a", "b")]
    return spark.createDataFrame(rows, "source string, ss double, df long, f double")


@_query("WITH g AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 6) AS meandiff FROM g a JOIN g b ON a.g < b.g")
def tukey_differences(spark, d):
    rows = evaluation.tukey(read(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(r["group1"], r["group2"], round(r["meandiff"], 6)) for r in rows], "group1 string, group2 string, meandiff double")


# ---- induction


def _fcm_sql(table_: str, column: str, k: int) -> str:
    """Fuzzy c-means over a column's histogram by recursion; the turn that ends it is not taken over."""
    c = [f"c{i}" for i in range(k)]
    start = ", ".join(f"min(x) + (max(x) - min(x)) * {i} / {k - 1} AS c{i}" for i in range(k))
    w = [f"power(greatest(abs(x - c{i}), 2.220446049250313e-16), -2)" for i in range(k)]
    return (
        f"(WITH RECURSIVE h AS (SELECT CAST({column} AS DOUBLE) AS x, count(*) AS n FROM {table_} GROUP BY 1), it AS (SELECT 0 AS i, {start}, CAST(0 AS DOUBLE) AS old, CAST(0 AS DOUBLE) AS obj, true AS going FROM h UNION ALL "
        f"SELECT i + 1, {', '.join(f'CASE WHEN abs(new - obj) < 0.01 THEN c{i} ELSE n{i} END' for i in range(k))}, obj, new, abs(new - obj) >= 0.01 FROM (SELECT i, {', '.join(c)}, {', '.join(f'n{i}' for i in range(k))}, obj, sum({' + '.join(f'u{i} * power(x - n{i}, 2)' for i in range(k))}) AS new FROM ("
        f"SELECT *, {', '.join(f'sum(u{i} * x) OVER () / (sum(u{i}) OVER () + 2.220446049250313e-16) AS n{i}' for i in range(k))} FROM (SELECT i, {', '.join(c)}, obj, x, {', '.join(f'n * power(w{i} / ({chr(43).join(f'w{j}' for j in range(k))}), 2) AS u{i}' for i in range(k))} FROM ("
        f"SELECT it.*, x, n, {', '.join(f'{w[i]} AS w{i}' for i in range(k))} FROM it, h WHERE i < 200 AND going))) GROUP BY ALL)) "
        f"SELECT unnest([{', '.join(f'{{{chr(39)}k{chr(39)}: {i}, {chr(39)}c{chr(39)}: c{i}}}' for i in range(k))}]) AS e FROM it ORDER BY i DESC LIMIT {k})"
    )


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, e.k AS k, round(e.c, 4) AS centre FROM {_fcm_sql('part', c, k)}" for c, k in (("p_size", 5), ("p_retailprice", 3))))
def fuzzy_centres(spark, d):
    c = induction.centres_of(read(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), {"p_size": 5, "p_retailprice": 3})
    return c.select("feature", F.posexplode("centres").alias("k", "centre")).withColumn("centre", F.round("centre", 4))


_FIS = {"p_size": [5.0, 25.0, 45.0], "p_retailprice": [1000.0, 1400.0, 1800.0]}


def _bin(x: str, centres: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN abs({x} - {c}) <= least({', '.join(f'abs({x} - {o})' for o in centres)}) THEN {k}" for k, c in enumerate(centres, 1)) + " END"


def _gauss(x: str, centres: list[float]) -> str:
    sigma = (max(centres) - min(centres)) / (2 * np.sqrt(2 * np.log(2)))
    sigma *= 10 ** max(0, int(np.ceil(-np.log10(sigma))))
    return f"exp(-power({x} - CASE {_bin(x, centres)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(centres, 1)) + f" END, 2) / (2 * power(CAST({float(sigma)!r} AS DOUBLE), 2)))"


_GAUSS = {c: _gauss(c, v) for c, v in _FIS.items()}


@_query(f"SELECT p_partkey, {_bin('p_size', _FIS['p_size'])} AS p_size, {_bin('p_retailprice', _FIS['p_retailprice'])} AS p_retailprice, CAST(p_partkey % 3 + 1 AS INTEGER) AS label, round(least({_GAUSS['p_size']}, {_GAUSS['p_retailprice']}), 6) AS strength FROM part")
def generated_rules(spark, d):
    """A rule for each row: bins of two features, the bin of the label by its own clusters, and the lesser membership."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 3 + 1).cast("int").alias("label"))
    label_centres = induction.as_lists(induction.centres_of(p, {"label": 3}))["label"]
    return rounded(induction.rules_of(p, _FIS, "label", label_centres, "p_partkey"), "strength")


@_query(
    f"WITH b AS (SELECT p_partkey, {_bin('p_size', _FIS['p_size'])} AS x, {_bin('p_retailprice', _FIS['p_retailprice'])} AS y, CAST(p_partkey % 3 + 1 AS INTEGER) AS label FROM part), r AS (SELECT x, y, arg_min(label, p_partkey) AS p FROM b WHERE {_SLOT.format(key='p_partkey', seed=1, n=100)} < 70 GROUP BY ALL) "
    f"SELECT p_partkey, coalesce(p, 0) AS label FROM b LEFT JOIN r USING (x, y) WHERE {_SLOT.format(key='p_partkey', seed=1, n=100)} >= 70"
)
def fuzzy_predict(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_partkey") % 3 + 1).cast("int").alias("label"))
    train, test = balance.split(p, "p_partkey", 70, 1)
    return induction.predicted(test.drop("label"), induction.binned(train, _FIS), _FIS, "label", "p_partkey").select("p_partkey", "label")


# ---- other kernels of the rule graph


def _kinds(spark, d):
    return graph.checked(rb(spark, d).filter("base"), RB, "label")


@_query(
    _WITH + ", z AS (SELECT t, label, sum(CAST(c AS DOUBLE)) / any_value(keys) AS mean, sqrt(greatest(sum(CAST(c AS DOUBLE) * CAST(c AS DOUBLE)) / any_value(keys) - power(sum(CAST(c AS DOUBLE)) / any_value(keys), 2), 0)) AS spread FROM c JOIN keys USING (t) GROUP BY t, label) "
    "SELECT t, v0, v1, v2, label, round(CASE WHEN spread > 0 THEN (CAST(c AS DOUBLE) - mean) / spread ELSE 0 END, 5) AS score FROM c JOIN z USING (t, label)"
)
def graph_c_zscore(spark, d):
    out = graph.standardized(graph.model(_kinds(spark, d), RB, "label"), "label")
    return out.select("t", *(F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)), "label", F.round("score", 5).alias("score"))


_AVERAGED = (
    _WITH + ", total AS (SELECT CAST(sum(mult) AS DOUBLE) AS n FROM kinds), agree AS (SELECT f0, f1, f2, f3, f4, [" + ", ".join(f"sum(mult) OVER (PARTITION BY {', '.join(q)})" for q in combinations(RB, 4)) + "] AS q FROM ante), "
    "ab AS (" + " UNION ALL ".join(
        f"SELECT {t} AS t, w.f{x} AS v0, w.f{y} AS v1, w.f{z} AS v2, label, mult, (" + (" + ".join(f"q[{k + 1}]" for k in near) or "0") + f") / CAST({max(1, len(near))} AS DOUBLE) / n * least(m{x}, m{y}, m{z}) / n AS b FROM wide w JOIN agree USING (f0, f1, f2, f3, f4), total"
        for t, ((x, y, z), near) in enumerate(zip(_TRIPLES, graph._nearby(5), strict=True))
    ) + "), ac AS (SELECT t, v0, v1, v2, label, sum(b * mult) / sum(mult) AS score FROM ab GROUP BY ALL), "
    "ad AS (SELECT f0, f1, f2, f3, f4, label, coalesce(sum(score) / nullif(count(*) FILTER (score <> 0), 0), 0) AS d FROM qt JOIN ac USING (t, v0, v1, v2) GROUP BY ALL), often AS (SELECT label, sum(mult) AS often FROM kinds GROUP BY label), "
    "front AS (SELECT f0, f1, f2, f3, f4, max(d) AS top, sum(d) AS al FROM ad GROUP BY ALL), tied AS (SELECT f0, f1, f2, f3, f4, label, often, top, al FROM ad JOIN front USING (f0, f1, f2, f3, f4) JOIN often USING (label) WHERE abs(d - top) < 1e-9), "
    "chosen AS (SELECT f0, f1, f2, f3, f4, any_value(top) AS top, any_value(al) AS al, count(*) AS n, arg_max(label, often * 1000 - label) AS predicted FROM tied GROUP BY ALL), common AS (SELECT arg_max(label, often * 1000 - label) AS label FROM often) "
)


@_query(_AVERAGED + "SELECT asked.*, CASE WHEN coalesce(top, 0) = 0 THEN (SELECT label FROM common) ELSE chosen.predicted END AS predicted, round(CASE WHEN coalesce(top, 0) = 0 THEN 0 WHEN (CASE WHEN al > 0.001 THEN top / al ELSE 0 END) < 0.2 AND n = 1 THEN 0.2 WHEN al > 0.001 THEN top / al ELSE 0 END, 6) AS confidence FROM asked LEFT JOIN chosen USING (f0, f1, f2, f3, f4)")
def graph_averaged_kernel(spark, d):
    kinds = _kinds(spark, d)
    asked = rb(spark, d).filter("not base").groupBy(*RB, F.col("label").alias("truth")).agg(F.count("*").alias("mult"))
    told = graph.inferred_averaged(asked, kinds, graph.averaged_model(kinds, RB, "label"), RB, "label")
    return rounded(told, "confidence").select(*RB, "truth", "mult", "predicted", "confidence")


_SIX = "CAST(l_linenumber % 6 AS INTEGER) + 1"


@_query(_WITH.replace(_CLASS, _SIX) + "SELECT f0, f1, f2, f3, f4, truth, mult, predicted, round(confidence, 6) AS confidence FROM told")
def graph_six_labels(spark, d):
    rules = catalogue.rb(spark, d, label=(F.col("l_linenumber") % 6 + 1).cast("int"))
    kinds = graph.checked(rules.filter("base"), RB, "label")
    asked = rules.filter("not base").groupBy(*RB, F.col("label").alias("truth")).agg(F.count("*").alias("mult"))
    told = graph.inferred(asked, graph.normalized(graph.model(kinds, RB, "label"), "label"), RB, "label")
    return rounded(told, "confidence").select(*RB, "truth", "mult", "predicted", "confidence")


@_query(
    _WITH + ", total AS (SELECT CAST(sum(mult) AS DOUBLE) AS n FROM kinds), t3 AS (SELECT f0, f1, f2, f3, f4, " + " + ".join(f"sum(mult) OVER (PARTITION BY {', '.join(q)})" for q in combinations(RB, 3)) + " AS s FROM ante) "
    + " UNION ALL ".join(f"SELECT f0, f1, f2, f3, f4, label, mult, {p} AS p, round(t3.s / n * least(m{i}, m{j}) / n, 6) AS b FROM wide JOIN t3 USING (f0, f1, f2, f3, f4), total" for p, (i, j) in enumerate(combinations(range(5), 2)))
)
def graph_pair_weights(spark, d):
    return rounded(graph.pair_weights(rb(spark, d).filter("base"), RB, "label"), "b")


_RING = ["label", *RB]


@_query(
    _WITH + ", total AS (SELECT CAST(sum(mult) AS DOUBLE) AS n FROM kinds), " + ", ".join(f"s{i} AS (SELECT {c}, sum(mult) / any_value(n) AS s{i} FROM kinds, total GROUP BY {c})" for i, c in enumerate(_RING))
    + ", rings AS (SELECT kinds.*, " + " + ".join(f"s{i} * s{(i + 1) % 6}" for i in range(6)) + " AS weight FROM kinds " + " ".join(f"JOIN s{i} USING ({c})" for i, c in enumerate(_RING)) + ") "
    "SELECT f0, f1, f2, f3, f4, label, mult, round(weight, 6) AS weight FROM rings WHERE weight > (SELECT sum(weight * mult) / sum(mult) FROM rings)"
)
def rules_above_mean(spark, d):
    return rounded(graph.common_neighbours(rb(spark, d).filter("base"), RB, "label"), "weight").select(*RB, "label", "mult", "weight")


# ---- runs


@_query()
def random_graph_runs(spark, d):
    rules = ob(spark, d)
    runs = scenario.random_runs(rules.filter("rid % 10 < 7"), rules.filter("rid % 10 >= 7"), OB, "label", "rid")
    return spark.createDataFrame([(str(r["turn"]), float(r["accuracy"]), float(r["sampling_seconds"]), float(r["graph_seconds"])) for r in runs], "turn string, accuracy double, sampling_seconds double, graph_seconds double")


@_query()
def parameter_grid(spark, d):
    rules = ob(spark, d)
    runs = scenario.grid(rules.filter("rid % 10 < 7"), rules.filter("rid % 10 >= 7"), OB, "label", "rid", scenario.GRID)
    return spark.createDataFrame([(float(r["percent"]), float(r["e"]), float(r["accuracy"]), float(r["accuracy_deviation"])) for r in runs], "percent double, e double, accuracy double, deviation double")


# ---- images, from files on


def _picture_folders(spark, d) -> list[str]:
    """The embeddings as pictures in two folders, PNG in one and portable maps in the other."""
    p = pixels(spark, d).withColumn("v", F.col("v") * 16)
    grey = rasters.from_pixels(p)

    def coded(batches, write):
        import pyarrow as pa

        for b in batches:
            out = [write(np.asarray(x, np.uint8).reshape(h, w, 1)) for x, h, w in zip(b.column("data").to_pylist(), b.column("height").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("image_id").cast(pa.string()), pa.array(out, pa.binary())], ["image_id", "content"])

    folders = [fresh_path(spark, "pictures") for _ in range(2)]
    for k, (folder, write, suffix) in enumerate(zip(folders, (pictures.as_png, pictures.as_portable), (".png", ".pgm"), strict=True)):
        own = grey.filter(F.col("image_id") % 2 == k).mapInArrow(lambda batches, write=write: coded(batches, write), "image_id string, content binary")
        files.write_files(own, folder, suffix)
    return folders


_PX16 = f"(SELECT image_id, y, x, v * 16 AS v FROM {_PX})"
_OTSU = (
    "h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL), cum AS (SELECT image_id, v, CAST(sum(n) OVER o AS DOUBLE) AS n0, CAST(sum(n * v) OVER o AS DOUBLE) AS s0, CAST(sum(n) OVER w AS DOUBLE) AS n1, CAST(sum(n * v) OVER w AS DOUBLE) AS s1 FROM h WINDOW w AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY v)), "
    "btw AS (SELECT image_id, v, round(n0 * (n1 - n0) * power(s0 / n0 - (s1 - s0) / (n1 - n0), 2) / (n1 * n1), 9) AS g FROM cum WHERE n0 < n1), cut AS (SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY g DESC, v) AS k FROM btw) WHERE k = 1)"
)


@_query(
    f"WITH px AS {_PX16}, {_OTSU}, mk AS (SELECT image_id, y, x, px.v, CASE WHEN px.v > threshold THEN px.v ELSE 0 END AS g, px.v > threshold AS m FROM px JOIN cut USING (image_id)), "
    f"one AS (SELECT a.image_id, angle, a.g AS i, b.g AS j FROM mk a, {catalogue._STEPS}, mk b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx), cc AS (SELECT image_id, angle, i, j, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT image_id, angle, j, i FROM one) GROUP BY ALL), "
    "p AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER w AS p, CAST(sum(n * i) OVER w AS DOUBLE) / sum(n) OVER w AS mi, CAST(sum(n * j) OVER w AS DOUBLE) / sum(n) OVER w AS mj FROM cc WINDOW w AS (PARTITION BY image_id, angle)), "
    "f AS (SELECT image_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, sum(p * (i - mi) * (i - mi)) AS vi, sum(p * (j - mj) * (j - mj)) AS vj, sum(p * (i - mi) * (j - mj)) AS cov FROM p GROUP BY ALL), "
    "tx AS (SELECT image_id, round(avg(contrast), 5) AS contrast, round(avg(dissimilarity), 5) AS dissimilarity, round(avg(homogeneity), 5) AS homogeneity, round(avg(sqrt(asm)), 5) AS energy, round(avg(CASE WHEN vi < 1e-15 OR vj < 1e-15 THEN 1 ELSE cov / sqrt(vi * vj) END), 5) AS correlation, round(avg(asm), 5) AS asm FROM f GROUP BY image_id), "
    "mo AS (SELECT image_id, round(avg(v), 5) AS mean, round(var_pop(v), 5) AS variance, round(stddev_pop(v), 5) AS deviation, round(sqrt(avg(v * v)), 5) AS rms FROM mk WHERE NOT m GROUP BY image_id) SELECT CAST(image_id AS VARCHAR) AS image_id, * EXCLUDE image_id FROM tx JOIN mo USING (image_id)"
)
def picture_features(spark, d):
    """From folders of image files to a table of features: listed, decoded, masked, described, written in one go."""
    found = files.images(spark, _picture_folders(spark, d))
    out, path = images.described(pictures.pixels(pictures.rasters(found))), fresh_path(spark, "features")
    out.write.parquet(path)
    return rounded(spark.read.parquet(path), *images.FEATURES["all"], places=5)


@_query(f"SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(sum(v) AS BIGINT) AS total FROM {_PX16} GROUP BY image_id")
def decoded_pictures(spark, d):
    r = pictures.rasters(files.images(spark, _picture_folders(spark, d)))
    total = pictures.pixels(r).groupBy("image_id").agg(F.sum("v").alias("total"))
    return r.select("image_id", "height", "width").join(total, "image_id")


@_query(f"WITH px AS {_PX}, one AS (SELECT a.image_id, angle, a.v AS i, b.v AS j FROM px a, {catalogue._STEPS}, px b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx), cc AS (SELECT image_id, angle, i * 17 AS i, j * 17 AS j, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT image_id, angle, j, i FROM one) GROUP BY ALL) SELECT image_id, angle, i, j, round(n / sum(n) OVER (PARTITION BY image_id, angle), 8) AS p FROM cc")
def glcm_normed(spark, d):
    """At 256 levels, as shares."""
    return rounded(images.normed(images.cooccurrence(pixels(spark, d).withColumn("v", F.col("v") * 17))), "p", places=8)


@_query(f"WITH px AS (SELECT image_id, y, x, CAST(least(v * 17 // 16 + 1, 17) AS INTEGER) - CASE WHEN v * 17 >= 255 THEN 0 ELSE 0 END + CASE WHEN v * 17 >= 255 THEN 1 ELSE 0 END AS v FROM {_PX}) SELECT a.image_id, angle, a.v AS i, b.v AS j, count(*) AS n FROM px a, {catalogue._STEPS}, px b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL")
def glcm_levels(spark, d):
    """Values by 17 edges, the last of them 255, counted one way."""
    p = images.levelled(pixels(spark, d).withColumn("v", F.col("v") * 17), [*range(0, 256, 16), 255])
    return images.cooccurrence(p, symmetric=False)


_BLUR = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}


def _mirror(x: str) -> str:
    return f"(7 - abs(7 - abs({x})))"


@_query(
    f"WITH raw AS {_PX16}, w AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {x * y})" for a, x in _BLUR.items() for b, y in _BLUR.items()) + ") t(dy, dx, k)), "
    f"px AS (SELECT p.image_id, p.y, p.x, CAST(floor(sum(k * q.v) / 256.0 + 0.5) AS INTEGER) AS v FROM raw p, w, raw q WHERE q.image_id = p.image_id AND q.y = {_mirror('p.y + dy')} AND q.x = {_mirror('p.x + dx')} GROUP BY ALL), {_OTSU} SELECT image_id, threshold FROM cut"
)
def otsu_of_blurred(spark, d):
    p = rasters.each(rasters.from_pixels(pixels(spark, d).withColumn("v", F.col("v") * 16)), rasters.blurred_by_five)
    return images.otsu(rasters.to_pixels(p).withColumn("v", F.col("v").cast("int")))


@_query()
def combined_mask(spark, d):
    p = pixels(spark, d).withColumn("v", F.col("v") * 16)
    return images.both_masks(p, rasters.to_pixels(rasters.each(rasters.from_pixels(p), rasters.darkest)))


def _coloured(step):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """A step over colour rasters of 24 x 24: the sum of each channel's bytes."""
        wide = rasters.coloured(rasters.each(rasters.from_pixels(pixels(spark, d).withColumn("v", F.col("v") * 16)), lambda a: rasters.resized(a, 24, 24)))
        return rasters.channel_sums(rasters.each_colour(wide, step))

    return run


for _name, _step in (
    ("colour_equalize", rasters.equalized_light), ("colour_segments", rasters.darkest_colour), ("colour_hair_removal", rasters.without_hairs_in_colour), ("colour_denoise", lambda a: rasters.denoised_colour(a, 10.0, 3, 5)),
):
    QUERIES[_name] = _coloured(_step)
