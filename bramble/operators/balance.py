"""Splits, folds and borderline oversampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from bramble.sources.shared import file_system, fresh_path, written

from .table import running, unused

#: Queries that are held against rows at a time, and rows of a cell, against which they are held at a time.
QUERIES, ROWS = 512, 2048
#: Cells, and tasks of queries, at most; larger tables have larger ones. Rows of cells that a task keeps at hand.
CELLS, TASKS, HELD = 4096, 1024, 500_000


def _slot(key: str, seed: int, n: int):
    """A number below n by a hash of the key and the seed, the same on every engine: the first eight digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n))


def share(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """Rows by a hash of their key: the same rows on every run and at every partitioning."""
    return df.filter(_slot(key, seed, 100) < percent)


def split(df: DataFrame, key: str, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts without common rows."""
    of = _slot(key, seed, 100)
    return df.filter(of < percent), df.filter(of >= percent)


def overlapping(df: DataFrame, key: str, percent: int, seeds: tuple[int, int] = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """Training and test rows drawn apart from each other, so that some rows are in both, as the published runs do it:
    `percent` of the rows to learn from, the rest's share to test on."""
    return share(df, key, percent, seeds[0]), share(df, key, 100 - percent, seeds[1])


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order by a hash of their key, the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def folds(df: DataFrame, key: str, k: int, name: str = "fold", seed: int = 42) -> DataFrame:
    return df.withColumn(name, _slot(key, seed, k))


def _borders(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree that splits space at medians of points: (column, value, node below value, node from it on); leaves have column -1."""
    tree = [(-1, 0.0, 0, 0)]
    todo = [(0, points, cells)]
    while todo:
        node, own, n = todo.pop()
        wide = np.ptp(own, axis=0) if len(own) else np.zeros(1)
        if n < 2 or not wide.max() > 0:
            continue
        c = int(wide.argmax())
        x = np.sort(own[:, c])
        at = x[len(x) // 2] if x[len(x) // 2] > x[0] else x[np.searchsorted(x, x[0], "right")]
        tree[node] = (c, float(at), len(tree), len(tree) + 1)
        todo += [(len(tree), own[own[:, c] < at], n // 2), (len(tree) + 1, own[own[:, c] >= at], n - n // 2)]
        tree += [(-1, 0.0, 0, 0)] * 2
    return tree


def _points(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([np.asarray(c) for c in batch.columns[first:]])


def _in_cells(batches: Iterator[pa.RecordBatch], tree: list) -> Iterator[pa.RecordBatch]:
    """Rows (key, coordinates) with their cells before them."""
    column, value, low, high = (np.array(x) for x in zip(*tree, strict=True))
    for b in batches:
        at, node = _points(b, 1), np.zeros(len(b), np.int64)
        while (inner := np.flatnonzero(column[node] >= 0)).size:
            own = node[inner]
            node[inner] = np.where(at[inner, column[own]] < value[own], low[own], high[own])
        yield pa.RecordBatch.from_arrays([pa.array(node), *b.columns], ["cell", *b.schema.names])


def _near(batches: Iterator[pa.RecordBatch], path: str, cells: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of every query (cell, key, coordinates): of the nearest cell, then of all cells whose box isn't
    farther than what was found. Queries in one place are one search, for one row more, as each leaves out itself."""
    fs, root = file_system(path)
    held: dict[int, tuple] = {}

    def rows_of(c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if c not in held:
            while held and sum(len(x[0]) for x in held.values()) > HELD:
                held.pop(next(iter(held)))
            t = pa.dataset.dataset(f"{root}/cell={cells[c]}", filesystem=fs, format="parquet").to_table()
            own = _points(t, 1)
            held[c] = t.column(0).combine_chunks().to_numpy(zero_copy_only=False), own, own[:, low.shape[1]] if own.shape[1] > low.shape[1] else np.zeros(len(own))
        return held[c]

    def of_block(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = 0.0
        for j in range(at.shape[1]):  # rounded as the distances are, so no box is farther than its rows
            step = at[:, j, None] - np.clip(at[:, j, None], low[:, j], high[:, j])
            bound = bound + step * step
        d, names, marks = np.full((len(at), width), np.inf), None, np.zeros((len(at), width))

        def hold(q: np.ndarray, c: int) -> None:
            nonlocal names
            keys, points, marked = rows_of(c)
            if names is None:
                names = np.full((len(at), width), keys[0], keys.dtype)
            for i in range(0, len(keys), ROWS):
                some, far = keys[i : i + ROWS], 0.0
                for j in range(at.shape[1]):
                    step = at[q, j, None] - points[None, i : i + ROWS, j]
                    far = far + step * step
                far, others = np.concatenate((d[q], far), 1), np.concatenate((names[q], np.broadcast_to(some, (len(q), len(some)))), 1)
                theirs = np.concatenate((marks[q], np.broadcast_to(marked[i : i + ROWS], (len(q), len(some)))), 1)
                # All up to the last distance, so that equal ones are told apart by their keys.
                last = np.partition(far, width - 1, axis=1)[:, width - 1]
                upto = int((far <= last[:, None]).sum(1).max())
                if upto < far.shape[1]:
                    order = np.argpartition(far, upto - 1, axis=1)[:, :upto]
                    far, others, theirs = (np.take_along_axis(x, order, 1) for x in (far, others, theirs))
                order = np.lexsort((others, far), axis=1)[:, :width]
                d[q], names[q], marks[q] = (np.take_along_axis(x, order, 1) for x in (far, others, theirs))

        first = bound.argmin(1)
        for c in np.unique(first):
            hold(np.flatnonzero(first == c), c)
        closest = bound.min(0)
        for c in np.argsort(closest, kind="stable"):
            if closest[c] > d[:, -1].max():
                break
            q = np.flatnonzero((bound[:, c] <= d[:, -1]) & (first != c))
            if q.size:
                hold(q, c)
        return d, names, marks

    for b in batches:
        keys, points = b.column(1).to_numpy(zero_copy_only=False), _points(b, 2)
        _, at, which = np.unique(points, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(at)  # places as they come, those of a cell side by side
        which = np.argsort(order)[which.ravel()]
        found = [of_block(points[at[order[i : i + QUERIES]]], k + 1) for i in range(0, len(order), QUERIES)]
        d, names, marks = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (None, None, None)
        for i in range(0, len(keys), QUERIES):
            own, at = keys[i : i + QUERIES], which[i : i + QUERIES]
            near, others, theirs, width = d[at], names[at], marks[at], k + 1
            while True:
                other = np.isfinite(near) & (others != own[:, None])
                if not (np.isfinite(near).all(1) & (other.sum(1) < k)).any():
                    break
                width *= 2  # a key that rows share takes more of the places than one
                near, others, theirs = of_block(points[i : i + QUERIES], width)
            q, j = np.nonzero(other & (np.cumsum(other, axis=1) <= k))
            kind = b.column(1).type
            yield pa.RecordBatch.from_arrays([pa.array(own[q], kind), pa.array(others[q, j], kind), pa.array(near[q, j]), pa.array(theirs[q, j])], ["key", "other", "d", "mark"])


def nearest(queries: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], k: int, mark: Column | None = None) -> DataFrame:
    """(key, other, d, rank, mark): the k nearest other rows by squared distance, equal ones by their keys, for a stated query
    set against all rows; mark: a number of each of these, 0 if none is asked for. Rows without a key or a finite coordinate are left out.

    Of the rows in one place only those of the k + 1 first keys can be among the nearest, and only they are kept. They are
    written by cells of space; every task reads those cells that can hold nearest rows of its queries. A few rows set the
    cells' borders, all rows are in cells.
    """
    spark, names = queries.sparkSession, [f"x{i}" for i in range(len(columns))]
    finite = " and ".join(f"abs({x}) < double('infinity')" for x in names)
    whole = lambda df, *more: df.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)), *more).dropna().filter(finite)
    place = F.dense_rank().over(Window.partitionBy(*names).orderBy("key"))
    asked = written(whole(queries), "queries")
    kind, m = asked.schema["key"].dataType.simpleString(), asked.count()
    index = written(whole(rows, (F.lit(0.0) if mark is None else mark.cast("double")).alias("mark")).withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"), "rows") if m else asked
    n, tasks = index.count(), min(TASKS, m // (4 * QUERIES) + 1)
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, other {kind}, d double, rank int, mark double")
    cells = min(CELLS, n // ROWS + 1)
    some = index.filter(F.pmod(F.xxhash64("key"), F.lit(n)) < 16 * cells).select(*names).limit(64 * cells).toArrow()  # 16 a cell
    run, schema = partial(_in_cells, tree=_borders(_points(some, 0), cells)), f"cell long, key {kind}, {', '.join(f'{x} double' for x in names)}"
    path = fresh_path(spark, "cells")
    index.mapInArrow(run, f"{schema}, mark double").repartition("cell").write.partitionBy("cell").parquet(path)
    boxes = spark.read.parquet(path).groupBy(F.col("cell").cast("long").alias("cell")).agg(*(F.min(x).alias(f"low_{x}") for x in names), *(F.max(x).alias(f"high_{x}") for x in names))
    boxes = _points(boxes.toArrow(), 0)  # CELLS rows at most
    low, high = boxes[:, 1 : 1 + len(names)], boxes[:, 1 + len(names) :]
    asked = asked.mapInArrow(run, schema).repartitionByRange(tasks, "cell", *names, "key").sortWithinPartitions("cell", *names)
    pairs = asked.mapInArrow(partial(_near, path=path, cells=boxes[:, 0].astype(np.int64), low=low, high=high, k=k), f"key {kind}, other {kind}, d double, mark double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("d", "other"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("key").alias(key), "other", "d", "rank", "mark")


def danger(df: DataFrame, key: str, columns: Sequence[str], label: str, minority: int, m: int = 10) -> DataFrame:
    """Minority rows at the border: half or more, but not all, of their m nearest rows are of other classes."""
    own = df.filter(F.col(label) == minority)
    near = nearest(own, df, key, columns, m, F.when(F.col(label) != minority, 1).otherwise(0))
    n = near.groupBy(key).agg(F.sum("mark").cast("long").alias("foreign_rows"))
    return n.filter((F.col("foreign_rows") >= m / 2) & (F.col("foreign_rows") < m))


def borderline(df: DataFrame, key: str, columns: Sequence[str], label: str, minority: int, wanted: int | None = None, k: int = 5, m: int = 10, seed: int = 42) -> DataFrame:
    """df with `wanted` more minority rows between border rows and their nearest minority rows; new keys are negative, below
    any that there are, or, where keys are text, made-0, made-1 and so on.

    Without `wanted` the minority is filled up to the largest class.
    """
    if wanted is None:
        sizes = {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}  # one row for each class
        wanted = max(sizes.values(), default=0) - sizes.get(minority, 0)
    if wanted <= 0:
        return df
    own = df.filter(F.col(label) == minority)
    border = own.join(danger(df, key, columns, label, minority, m).select(key), key, "left_semi")
    pairs = nearest(border, own, key, columns, k).drop("mark").withColumn("_h", F.xxhash64(key, "other", F.lit(seed))).persist()
    n = pairs.count()
    if not n:
        return df
    # Every pair is used wanted // n times and the first wanted % n by hash once more.
    part = F.pmod("_h", F.lit(1024))
    full, more, below = wanted // n, wanted % n, 0
    for last, size in sorted(map(tuple, pairs.groupBy(part.alias("p")).agg(F.count("*")).collect())):  # 1024 rows at most
        if below + size >= more:
            break
        below += size
    extra = pairs.filter(part < last).unionByName(pairs.filter(part == last).orderBy("_h", key, "other").limit(more - below)).withColumn("copy", F.lit(full + 1).cast("long"))
    made = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(full).cast("long")))).unionByName(extra) if full else extra
    gap = F.pmod(F.xxhash64(key, "other", "copy", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    a, b = own.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns)), own.select(F.col(key).alias("other"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    new = made.join(a, key).join(b, "other").withColumn("_g", gap)
    # Numbered in the order of what they are made of; a key type without room for them is an error.
    which, number = unused(new, "which"), unused(new, "number")
    new = running(new.withColumn(which, F.concat_ws("|", F.col(key), F.col("other"), F.col("copy"))), which, F.lit(1), number)
    kind = df.schema[key].dataType
    if isinstance(kind, NumericType):
        below = df.agg(F.least(F.min(key), F.lit(0)).alias("least")).first()["least"]
        row = (F.lit(below) - 1 - F.col(number)).cast(kind)
    else:
        row = F.concat(F.lit("made-"), F.col(number).cast("string"))
    value = {c: F.col(f"_a_{c}") + F.col("_g") * (F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in columns} | {label: F.lit(minority).cast(df.schema[label].dataType), key: row}
    return df.unionByName(new.select(*((value[c] if c in value else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns)))
