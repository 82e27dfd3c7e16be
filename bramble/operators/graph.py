"""The rule graph: weights of rules by what they share, and inference over them.

A rule has bins f0.., a label and how often it occurs (`mult`). All weights are whole numbers, sums by value tuples:
shared(antecedent) counts agreements on four features, M(feature, bin, label) occurrences, B = shared * the least M of
a feature triple, C(triple, bins, label) the sum of B over occurrences. Nothing compares rules pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bramble.sources.shared import written

WIDE = "decimal(38,0)"


def _tuples(features: Sequence[str], k: int) -> Column:
    """All k-subsets of the features, in order, as (t: number of the subset, v: their bins)."""
    return F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(F.col(c).cast("int") for c in some)).alias("v")) for t, some in enumerate(combinations(features, k)))))


def checked(rules: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The rules, one row for each kind with its `mult`; labels must start at 1 and there must be four features.

    Kinds are far fewer than rules and all weights are made of them, so they are written, and the rules read once.
    """
    if len(features) < 4:
        raise ValueError("the rule graph needs four features or more")
    out = rules.groupBy(*features, label).agg(F.count("*").alias("mult"))
    return written(out.withColumn(label, F.when(F.col(label) >= 1, F.col(label)).otherwise(F.raise_error(F.lit("labels start at 1")).cast("int"))), "kinds")


def classes(*rules: DataFrame, label: str) -> int:
    """How many labels there are in these tables together."""
    return reduce(DataFrame.unionByName, (r.select(label) for r in rules)).filter(F.col(label).isNotNull()).distinct().count()


def shared(kinds: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per antecedent: the sum, over all rules, of how many four-feature subsets agree."""
    quads = kinds.select(*features, "mult", _tuples(features, 4).alias("q"))
    counts = quads.groupBy("q").agg(F.sum("mult").alias("n"))
    own = kinds.select(*features).distinct().select(*features, _tuples(features, 4).alias("q"))
    return own.join(counts, "q").groupBy(*features).agg(F.sum("n").alias("s"))


def memberships(kinds: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M: (feature, bin, label, m)."""
    long = kinds.select(label, "mult", F.posexplode(F.array(*(F.col(c).cast("int") for c in features))).alias("feature", "bin"))
    return long.groupBy("feature", "bin", label).agg(F.sum("mult").alias("m"))


def triples(kinds: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """B: (antecedent, label, mult, t, v, b) for every kind of rule and feature triple."""
    m = memberships(kinds, features, label)
    wide = kinds.join(shared(kinds, features), list(features))
    for i, c in enumerate(features):
        own = m.filter(F.col("feature") == i).select(F.col("bin").alias(c), label, F.col("m").alias(f"_m{i}"))
        wide = wide.join(own, [c, label])
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(F.col(features[i]).cast("int") for i in some)).alias("v"), F.least(*(F.col(f"_m{i}") for i in some)).alias("m")) for t, some in enumerate(combinations(range(len(features)), 3)))))
    out = wide.select(*features, label, "mult", "s", each.alias("x"))
    return out.select(*features, label, "mult", F.col("x.t").alias("t"), F.col("x.v").alias("v"), (F.col("s").cast(WIDE) * F.col("x.m")).cast(WIDE).alias("b"))


def model(kinds: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """C: (t, v, label, c)."""
    return triples(kinds, features, label).groupBy("t", "v", label).agg(F.sum((F.col("b") * F.col("mult")).cast(WIDE)).cast(WIDE).alias("c"))


def normalized(c: DataFrame, label: str) -> DataFrame:
    """C scaled by the least and largest value of its triple and label over all rules; keys without the label count as 0.

    A triple and label with one value everywhere has none after scaling; its score is null, which inference takes as 0.
    """
    c = written(c, "weights")
    keys = c.select("t", "v").distinct().groupBy("t").agg(F.count("*").alias("keys"))
    ends = c.groupBy("t", label).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("have")).join(keys, "t")
    ends = ends.select("t", label, F.when(F.col("have") < F.col("keys"), F.lit(0).cast(WIDE)).otherwise(F.col("lo")).alias("lo"), "hi")
    x = (F.col("c") - F.col("lo")).cast("double") / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")).cast("double"))
    return c.join(ends, ["t", label]).select("t", "v", label, x.alias("score"))


def standardized(c: DataFrame, label: str) -> DataFrame:
    """C less the mean of its triple and label over all keys, in population deviations; keys without the label count as 0,
    a triple and label without spread has 0 everywhere."""
    c = written(c.select("t", "v", label, F.col("c").cast("double").alias("c")), "weights")
    keys = c.select("t", "v").distinct().groupBy("t").agg(F.count("*").alias("keys"))
    sums = c.groupBy("t", label).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).join(keys, "t")
    mean = F.col("s") / F.col("keys")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("keys") - mean * mean, F.lit(0.0)))
    ends = sums.select("t", label, mean.alias("mean"), spread.alias("spread"))
    return c.join(ends, ["t", label]).select("t", "v", label, F.when(F.col("spread") > 0, (F.col("c") - F.col("mean")) / F.col("spread")).otherwise(0.0).alias("score"))


def _nearby(n: int) -> list[list[int]]:
    """For each triple of n features, the places in the list of four-feature subsets that the averaged kernel takes for it:
    one for every other feature, counted back from the triple's own place."""
    size, out = len(list(combinations(range(n), 4))), []
    for place, (a, b, c) in enumerate(combinations(range(n), 3)):
        back = [0 if d > c else 1 if d > b else 2 if d > a else 3 for d in range(n) if d not in (a, b, c)]
        out.append([place - x for x in back if 0 <= place - x < size])
    return out


def averaged_model(kinds: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(t, v, label, score) by the averaged kernel: B is the mean of a few agreements on four features times the least M
    of the triple, both as shares of all rules, and the score the mean of B over the rules that have the key and label."""
    total = kinds.agg(F.sum("mult").alias("n")).first()["n"] or 1
    quads = kinds.select(*features, "mult", _tuples(features, 4).alias("q"))
    counts = quads.groupBy("q").agg(F.sum("mult").alias("n"))
    own = kinds.select(*features).distinct().select(*features, _tuples(features, 4).alias("q")).join(counts, "q")
    own = own.groupBy(*features).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("q.t").alias("t"), "n"))), lambda x: x["n"]).alias("agree"))
    wide = kinds.join(own, list(features))
    m = memberships(kinds, features, label)
    for i, c in enumerate(features):
        wide = wide.join(m.filter(F.col("feature") == i).select(F.col("bin").alias(c), label, F.col("m").alias(f"_m{i}")), [c, label])
    each = []
    for t, (some, near) in enumerate(zip(combinations(range(len(features)), 3), _nearby(len(features)), strict=True)):
        mean = sum((F.get("agree", F.lit(k)) for k in near), F.lit(0)) / len(near) / total if near else F.lit(0.0)
        each.append(F.struct(F.lit(t).alias("t"), F.array(*(F.col(features[i]).cast("int") for i in some)).alias("v"), (mean * F.least(*(F.col(f"_m{i}") for i in some)) / total).alias("b")))
    long = wide.select(label, "mult", F.explode(F.array(*each)).alias("x"))
    score = F.sum(F.col("x.b") * F.col("mult")) / F.sum("mult")
    return long.groupBy(F.col("x.t").alias("t"), F.col("x.v").alias("v"), label).agg(score.alias("score"))


def inferred_averaged(asked: DataFrame, kinds: DataFrame, scores: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """asked with `predicted` and `confidence` by the averaged kernel: the class with the largest mean of its scores above
    0, equal ones (to 1e-9) by the frequency of the class, then the first; its share of all classes' means, 0 where they are
    next to nothing, and 0.2 at least where the class is alone in front. Unmatched rows get the most frequent class."""
    often = kinds.groupBy(label).agg(F.sum("mult").alias("often"))
    d = degrees(asked, scores, features, label, "averaged").join(F.broadcast(often), label)  # a row for each class
    front = d.groupBy(*features).agg(F.max("d").alias("top"), F.sum("d").alias("all"))
    tied = F.abs(F.col("d") - F.col("top")) < 1e-9
    best = F.max_by(label, F.struct("often", (-F.col(label)).alias("k")))
    top = d.join(front, list(features)).filter(tied).groupBy(*features, "top", "all").agg(best.alias("predicted"), F.count("*").alias("n"))
    common = often.agg(best.alias("common"))
    out = asked.join(top, list(features), "left").join(F.broadcast(common), how="left")  # one row
    share = F.when(F.col("all") > 0.001, F.col("top") / F.col("all")).otherwise(0.0)
    floor = F.when((share < 0.2) & (F.col("n") == 1), 0.2).otherwise(share)
    none = F.coalesce("top", F.lit(0.0)) == 0
    return out.withColumns({"predicted": F.when(none, F.col("common")).otherwise(F.col("predicted")), "confidence": F.when(none, 0.0).otherwise(floor)}).drop("top", "all", "n", "common")


def pair_weights(rules: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The older weights: (antecedent, label, mult, p, b) for each pair p of features, b: the sum of the row's agreements on
    three features times the less frequent of its two (bin, label), both as shares of all rules."""
    kinds = checked(rules, features, label)
    total = kinds.agg(F.sum("mult").alias("n")).first()["n"] or 1
    long = kinds.select(*features, "mult", _tuples(features, 3).alias("q"))
    counts = long.groupBy("q").agg(F.sum("mult").alias("n"))
    own = kinds.select(*features).distinct().select(*features, _tuples(features, 3).alias("q")).join(counts, "q")
    wide = kinds.join(own.groupBy(*features).agg(F.sum("n").alias("s")), list(features))
    m = memberships(kinds, features, label)
    for i, c in enumerate(features):
        wide = wide.join(m.filter(F.col("feature") == i).select(F.col("bin").alias(c), label, F.col("m").alias(f"_m{i}")), [c, label])
    pairs = [F.struct(F.lit(p).alias("p"), (F.col("s") / total * F.least(f"_m{i}", f"_m{j}") / total).alias("b")) for p, (i, j) in enumerate(combinations(range(len(features)), 2))]
    return wide.select(*features, label, "mult", F.explode(F.array(*pairs)).alias("x")).select(*features, label, "mult", "x.p", "x.b")


def common_neighbours(rules: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rules whose weight is above the mean: the sum, over the label and all features in a ring, of the product of the
    shares that a value and its neighbour's have among all rules."""
    kinds = checked(rules, features, label)
    total = kinds.agg(F.sum("mult").alias("n")).first()["n"] or 1
    ring, wide = [label, *features], kinds
    for i, c in enumerate(ring):
        share = kinds.groupBy(c).agg((F.sum("mult") / total).alias(f"_s{i}"))
        wide = wide.join(share, c)
    weight = sum((F.col(f"_s{i}") * F.col(f"_s{(i + 1) % len(ring)}") for i in range(len(ring))), F.lit(0.0))
    wide = wide.select(*kinds.columns, weight.alias("weight"))
    mean = wide.agg((F.sum(F.col("weight") * F.col("mult")) / F.sum("mult")).alias("_mean"))
    return wide.join(F.broadcast(mean)).filter(F.col("weight") > F.col("_mean")).drop("_mean")  # one row


def degrees(asked: DataFrame, scores: DataFrame, features: Sequence[str], label: str, variant: str = "ends") -> DataFrame:
    """(antecedent, label, d): per class, largest plus smallest score of all triples (0 where unmatched), or their mean."""
    n = len(list(combinations(features, 3)))
    kinds = asked.select(*features).distinct().select(*features, _tuples(features, 3).alias("x")).select(*features, "x.*")
    score = F.coalesce("score", F.lit(0.0))
    found = kinds.join(scores, ["t", "v"]).groupBy(*features, label)
    if variant == "averaged":
        return found.agg(F.coalesce(F.sum(score) / F.nullif(F.count(F.when(score != 0, 1)), F.lit(0)), F.lit(0.0)).alias("d"))
    ends = found.agg(F.max(score).alias("hi"), F.min(score).alias("lo"), F.count("*").alias("n"))
    hi, lo = (F.when(F.col("n") < n, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c, f in (("hi", F.greatest), ("lo", F.least)))
    return ends.select(*features, label, (hi + lo).alias("d"))


def inferred(asked: DataFrame, scores: DataFrame, features: Sequence[str], label: str, variant: str = "ends", bias: float | None = None) -> DataFrame:
    """asked with `predicted` (the first class of the largest degree, 1 where all are 0) and `confidence`.

    bias: for two classes, class 1 only if its degree is above bias times that of class 2.
    """
    d = degrees(asked, scores, features, label, variant)
    best = F.max_by(label, F.struct(F.col("d"), (-F.col(label)).alias("k")))
    if bias is not None:
        of = lambda k: F.coalesce(F.sum(F.when(F.col(label) == k, F.col("d"))), F.lit(0.0))
        best = F.when(of(1) > bias * of(2), 1).otherwise(2)
    top = d.groupBy(*features).agg(best.alias("predicted"), F.max("d").alias("top"), F.sum("d").alias("all"))
    out = asked.join(top, list(features), "left")
    none = F.coalesce("all", F.lit(0.0)) == 0
    return out.withColumns({"predicted": F.when(none, 1).otherwise(F.col("predicted")), "confidence": F.when(none, 0.0).otherwise(F.col("top") / F.col("all"))}).drop("top", "all")


def similarity(a: Sequence[Column], b: Sequence[Column], label_a: Column, label_b: Column) -> Column:
    """-1 for other labels, else the share of equal values, the label among them."""
    same = reduce(lambda x, y: x + y, (F.when(p == q, 1).otherwise(0) for p, q in zip(a, b, strict=True)))
    return F.when(label_a != label_b, -1.0).otherwise((same + 1) / (len(a) + 1))


def sampled(rules: DataFrame, features: Sequence[str], label: str, order: str, percent: float, e: float, seed: int, k: int = 2, part: int = 5000) -> DataFrame:
    """A diverse sample: rules are drawn by seeded hash; a draw, then the up to k rows before and after it in `order`
    that are less than 1 - e similar to it, join if they are less than 1 - e similar to all that joined before.

    A row's place is that of the first draw that offers it, a kind of rule has the place of its first row; only kinds
    are compared. The first `part` kinds are settled on the driver, those still free of conflict with the sample come
    next, so the sample is that of one long pass at any size of `part`. It is of model size and passes the driver; the
    draws end when no kind is left, so it may be smaller than asked.
    """
    columns = [*features, label]

    def alike(a: str, b: str) -> Column:
        same = reduce(lambda x, y: x + y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")).cast("int") for c in features))
        return F.col(f"{a}.{label}").eqNullSafe(F.col(f"{b}.{label}")) & ((same + 1) / (len(features) + 1) >= 1 - e)

    spread = rules.select(F.struct(*rules.columns).alias("rule"), F.col(order).alias("_o")).repartitionByRange("_o").withColumn("_p", F.spark_partition_id()).persist()
    before, total = {}, 0
    for r in spread.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # one row for each partition
        before[r["_p"]], total = total, total + r["n"]
    want = int(total * percent / 100)
    if not want:
        spread.unpersist()
        return rules.limit(0)
    start = F.element_at(F.create_map(*(F.lit(x) for item in before.items() for x in item)), F.col("_p"))
    place = start + F.row_number().over(Window.partitionBy("_p").orderBy("_o", F.struct(*(F.col(f"rule.{c}") for c in columns))))
    rows = spread.select("rule", place.cast("long").alias("_i"), F.xxhash64("_o", F.lit(seed)).alias("_h"))
    draws = rows.select(F.struct(*(F.col(f"rule.{c}").alias(c) for c in columns)).alias("drawn"), "_h", F.posexplode(F.sequence(F.col("_i") - k, F.col("_i") + k)).alias("_far", "_i"))
    offers = rows.drop("_h").join(draws.withColumn("_far", F.abs(F.col("_far") - k)), "_i").filter((F.col("_far") == 0) | ~alike("rule", "drawn"))
    at = F.struct("_h", "_far", "_i")
    rest = offers.groupBy(*(F.col(f"rule.{c}").alias(f"_{c}") for c in columns)).agg(F.min(at).alias("at"), F.min_by("rule", at).alias("rule")).select("at", "rule").persist()

    kept = []
    while True:
        batch = rest.orderBy("at").limit(part).collect()
        new, seen = [], {}
        for r in batch:
            if len(kept) + len(new) == want:
                break
            values = np.array([r["rule"][c] for c in features], object)
            old = seen.setdefault(r["rule"][label], [])
            if not old or (((np.array(old, object) == values).sum(1) + 1) / (len(features) + 1) < 1 - e).all():
                old.append(values)
                new.append(r["rule"])
        kept += new
        if len(batch) < part or len(kept) == want:
            break
        taken = F.broadcast(rules.sparkSession.createDataFrame(new, rules.schema)).alias("taken")  # `part` rows at most
        last = F.struct(*(F.lit(x).cast("long") for x in batch[-1]["at"]))
        last = F.struct(last["col1"].alias("_h"), last["col2"].cast("int").alias("_far"), last["col3"].alias("_i"))
        after = rest.filter(F.col("at") > last).join(taken, alike("rule", "taken"), "left_anti").persist()
        after.count()
        rest.unpersist()
        rest = after
    rest.unpersist()
    spread.unpersist()
    return rules.sparkSession.createDataFrame(kept, rules.schema)
