"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters shingles over a universe of `universe`
places, the second, a fixed permutation pi of that universe, is read from each place on for K steps round the circle
(coordinate k is the smallest pi[(place - k) mod universe]). The K values of one shingle lie side by side in the
table, so a signature is a minimum over rows of a sliding view of it.

Exact copies first become one class, known by a 128-bit digest of the shingle set. Classes that share a band are
candidates. A band bucket is dealt over SALTS sub-buckets by a hash of the member: members are held against the first
one of their sub-bucket, these against the first one of the bucket, and then, in a few turns, members against one by
chance of their sub-bucket that is in another component. Members of one component need no further look. What is left
in buckets with several components is held against each other, again only across components: in buckets of up to PAIRED
members all of them, in larger ones where two sets share one of their rarest shingles early enough (the prefix and the
position filter, which lose no pair); sizes and parity sketches have to allow it, too. The rows of a common shingle are
dealt over as many keys as their number asks for. So a bucket of n near copies costs a few n pairs, no row meets more
than its share of a bucket in one task, and no link between members of different components of a bucket is left out.
With 24 bands of 4 coordinates a pair at similarity 0.8 is missed with a chance of 3 in a million.

A set with nearly as many shingles as the universe has places looks like any other such set to the signature: it costs
candidates, never links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, blocks, dropped, mixed, tidy, written


@dataclass(frozen=True)
class NearCopies:
    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    universe_bits: int = 20
    #: Rounds in which a member of each bucket, by chance, is held against the other components' members.
    turns: int = 1


class Signer:
    def __init__(self, rule: NearCopies) -> None:
        self.rule, self.hasher = rule, Rolling(11)
        size, k = 1 << rule.universe_bits, rule.bands * rule.rows
        pi = np.random.Generator(np.random.PCG64(12)).permutation(size).astype(np.uint32)
        # Read backwards, so that the steps (place - k) are consecutive.
        wide = np.concatenate((pi[::-1], pi[::-1][: k - 1]))
        self.view = np.lib.stride_tricks.sliding_window_view(wide, k)
        self.mask = np.uint64(size - 1)

    def sets(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, sorted distinct shingle hashes) of every text; a text of fewer words is one shingle, of none is empty."""
        n = self.rule.words
        for first, end, data, offsets in blocks(texts):
            words, _, _, row = self.hasher.words(data, offsets, lower=True)
            runs = self.hasher.runs(words, n)
            for k in range(end - first):
                a, b = int(row[k]), int(row[k + 1])
                if b - a >= n:
                    yield first + k, np.unique(runs[a : b - n + 1])
                elif b > a:
                    yield first + k, self.hasher.runs(words[a:b], b - a)
                else:
                    yield first + k, np.zeros(0, np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minima of K circular shifts; long sets in slices, so that memory stays bounded."""
        at = (mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)) & self.mask).astype(np.int64)
        low = None
        for k in range(0, len(at), 4096):
            part = self.view[at[k : k + 4096]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.astype(np.uint64).reshape(len(signatures), self.rule.bands, self.rule.rows)
        out = np.broadcast_to(np.arange(self.rule.bands, dtype=np.uint64), s.shape[:2]).copy()
        for r in range(self.rule.rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
        return out


#: Sub-buckets of a band.
SALTS = 64
#: A key is common if more than one row in so many has it.
COMMON = 1000
#: Buckets with up to so many members have few pairs, which are tried without a look at their shingles.
PAIRED = 64

_SIGNERS: dict[NearCopies, Signer] = {}


def _signer(rule: NearCopies) -> Signer:
    if rule not in _SIGNERS:
        _SIGNERS[rule] = Signer(rule)
    return _SIGNERS[rule]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@tidy
def _sign(batches: Iterator[pa.RecordBatch], rule: NearCopies) -> Iterator[pa.RecordBatch]:
    signer = _signer(rule)
    for batch in batches:
        size, digest, low = [], [], []
        for _, shingles in signer.sets(batch.column(1)):
            size.append(len(shingles))
            digest.append(_digest(shingles) if len(shingles) else None)
            low.append(signer.signature(shingles) if len(shingles) else np.zeros(rule.bands * rule.rows, np.uint32))
        low = np.array(low, np.uint32).reshape(-1, rule.bands * rule.rows)
        bands = signer.bands(low).view(np.int64)
        full = np.array(size, bool)
        lengths = np.where(full, rule.bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(bands[full].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])


@tidy
def _full_sets(batches: Iterator[pa.RecordBatch], rule: NearCopies) -> Iterator[pa.RecordBatch]:
    signer = _signer(rule)
    for batch in batches:
        rows, sets = [], []
        for row, shingles in signer.sets(batch.column(1)):
            rows.append(row)
            sets.append(shingles.view(np.int64))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), lists], ["node", "shingles"])


def _sets_of(nodes: DataFrame, docs: DataFrame, rule: NearCopies) -> DataFrame:
    """nodes: a written table of doc_ids, so that its size tells whether it can go to the texts or they have to come to it."""
    texts = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return texts.mapInArrow(partial(_full_sets, rule=rule), "node long, shingles array<long>").distinct()


def beside(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with few: one row a key, m: how many rows of `many` have it, which may be any share of them.

    Keys with more than one row in COMMON are less than COMMON in number and go to the rows, without any shuffle; the
    others are joined as Spark sees fit, and none of them makes a task large.
    """
    n = many.count()
    common = few.filter(F.col("m") * COMMON > n).drop("m").collect()  # less than COMMON rows
    if not common:
        return many.join(few.drop("m"), key, how)
    common = F.broadcast(many.sparkSession.createDataFrame(common, few.drop("m").schema))
    keys = common.select(key)
    whole = many.join(common, key, "inner" if how == "left" else how)
    return whole.unionByName(many.join(keys, key, "left_anti").join(few.drop("m").join(keys, key, "left_anti"), key, how))


#: Counters of how common a shingle is among the texts that are left: a power of two, as many as there are shingles, in
#: these bounds (12 MB at most). Any order would be right, this one is quick.
_RARITY = 1 << 18, 1 << 20


#: Bits of the small parity sketch that goes with the first members of a set, so that most pairs end where they meet; its
#: words' columns.
_FEW_BITS = 512
_FEW = [f"o{k}" for k in range(_FEW_BITS // 64)]
#: Counters that travel together.
_SLICE = 1 << 12


@tidy
def _counted(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """How often a task's members fall to each counter: a row for each slice of counters, those that are 0 left out."""
    seen = np.zeros(counters, np.int64)
    for batch in batches:
        lists = batch.column("shingles")
        np.add.at(seen, np.asarray(lists.flatten()) & (counters - 1), 1)
    at = np.flatnonzero(seen)
    slices, begin = np.unique(at // _SLICE, return_index=True)
    parts = np.split(at, begin[1:]) if len(at) else []
    slots = [(x % _SLICE).astype(np.uint16).tobytes() for x in parts]
    counts = [np.minimum(seen[x], 2**31 - 1).astype(np.int32).tobytes() for x in parts]
    yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], ["slice", "slots", "counts"])


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_SLICE, np.int64)
    for slots, counts in zip(table.column("slots"), table.column("counts"), strict=True):
        total[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.int32)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def _rarities(sets: DataFrame, counters: int) -> np.ndarray:
    """How many of all sets' members fall to each counter. Tasks count their own, so what travels are their counters."""
    sent = sets.select("shingles").mapInArrow(partial(_counted, counters=counters), "slice int, slots binary, counts binary")
    rarity = np.zeros(counters, np.int32)
    for row in sent.groupBy("slice").applyInArrow(_summed, "slice int, counts binary").toArrow().to_pylist():
        rarity[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], np.int32)
    return rarity


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], rule: NearCopies, rarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The first members of each set, rarest first, of which two sets this similar share one at least, the size of the set,
    how many of its members come before, and the words of a parity sketch of it."""
    for batch in batches:
        lists = batch.column("shingles")
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        keys, sizes, bits = [], [], np.zeros((len(batch), _FEW_BITS), np.uint8)
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = values[a:b]
            n = len(own)
            bits[k] = np.bincount((mixed(own.view(np.uint64)) % np.uint64(_FEW_BITS)).astype(np.int64), minlength=_FEW_BITS) & 1
            order = np.lexsort((own, rarity[own & (len(rarity) - 1)]))
            keys.append(own[order[: n - -(-n * rule.percent // 100) + 1]])
            sizes.append(len(keys[-1]))
        nodes, totals = np.repeat(np.asarray(batch.column("node")), sizes), np.repeat(np.diff(offsets), sizes).astype(np.int64)
        before = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes] or [np.zeros(0, np.int64)])
        odd = [pa.array(np.repeat(x, sizes)) for x in np.ascontiguousarray(np.packbits(bits, axis=1).view(np.int64).T)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(totals), pa.array(before), *odd], ["node", "key", "n", "before", *_FEW])


#: Bits of a parity sketch: every member turns one bit over, so two sketches differ in no more bits than their sets
#: differ in members, which rules pairs out without ever losing one.
_ODD_BITS = 2048


@tidy
def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("shingles")
        values, offsets = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        bits = np.zeros((len(batch), _ODD_BITS), np.uint8)
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            bits[k] = np.bincount((mixed(values[a:b]) % np.uint64(_ODD_BITS)).astype(np.int64), minlength=_ODD_BITS) & 1
        words = pa.array(np.packbits(bits, axis=1).view(np.int64).ravel())
        odd = pa.FixedSizeListArray.from_arrays(words, _ODD_BITS // 64).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(offsets).astype(np.int64)), odd], ["node", "n", "odd"])


@tidy
def _alike(batches: Iterator[pa.RecordBatch], rule: NearCopies) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches don't tell their sets apart."""
    for batch in batches:
        bits = lambda c: np.asarray(batch.column(c).flatten()).view(np.uint64).reshape(len(batch), _ODD_BITS // 64)
        differ = np.bitwise_count(bits("oa") ^ bits("ob")).sum(1, dtype=np.int64)
        total = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
        yield batch.select(["a", "b"]).filter(pa.array((100 + rule.percent) * differ <= (100 - rule.percent) * total))


def _verified(pairs: DataFrame, pool: DataFrame, rule: NearCopies) -> DataFrame:
    """The pairs (a, b) of documents that are similar enough, by their full sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(pool.join(ends, "node", "left_semi"), "near-sets")
    both = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("shingles", "sa"), "a")
    both = both.join(sets.withColumnRenamed("node", "b").withColumnRenamed("shingles", "sb"), "b")
    same, total = F.size(F.array_intersect("sa", "sb")).cast("long"), (F.size("sa") + F.size("sb")).cast("long")
    return both.filter(100 * same >= rule.percent * (total - same)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(label, root): the smallest node reachable over links (a, b), for every node with a link to another one.

    Each round replaces every label by the smallest one next to it, followed to its end by pointer jumping, and
    contracts the links to pairs of different labels; when none is left, all is joined. Labels only ever fall.
    """
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).filter("x <> y").distinct(), "edges")
    moved = None
    while not edges.isEmpty():
        either = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = written(either.groupBy("x").agg(F.min("y").alias("p")).select("x", F.least("x", "p").alias("p")), "parents")
        while True:  # the parents' parents, until every one is its own; a root, which may have any share of the rows, stays
            up = parent.filter("x <> p").select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = written(up.join(parent.groupBy("p").agg(F.count("*").alias("m")), "p"), "parents")
            if up.isEmpty():
                break
            higher = written(beside(parent, up, "p", "left").select("x", F.coalesce("q", "p").alias("p")), "parents")
            dropped(parent)
            dropped(up)
            parent = higher
        step = parent.select(F.col("x").alias("label"), F.col("p").alias("root"))
        if moved is None:
            moved = step
        else:
            again = step.select(F.col("label").alias("root"), F.col("root").alias("next"))
            further = moved.join(again, "root", "left").select("label", F.coalesce("next", "root").alias("root"))
            moved = written(further.unionByName(step.join(moved.select("label"), "label", "left_anti")), "roots")
        new = lambda c: step.select(F.col("label").alias(c), F.col("root").alias(f"r{c}"))
        fewer = written(edges.join(new("x"), "x").join(new("y"), "y").select(F.col("rx").alias("x"), F.col("ry").alias("y")).filter("x <> y").distinct(), "edges")
        dropped(edges)
        edges = fewer
    return edges.select(F.col("x").alias("label"), F.col("y").alias("root")) if moved is None else moved


def _by_prefix(left: DataFrame, pool: DataFrame, rule: NearCopies) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, l) with different l, with all whose sets are similar enough among them."""
    sets = written(pool.join(left.select("node"), "node", "left_semi"), "left-sets")
    total = sets.agg(F.sum(F.size("shingles")).alias("n")).first()["n"]
    counters = 1 << int(np.clip(int(total - 1).bit_length(), *(x.bit_length() - 1 for x in _RARITY)))
    rarity = _rarities(sets, counters)
    keyed = sets.mapInArrow(partial(_prefixes, rule=rule, rarity=rarity), "node long, key long, n long, before long, " + ", ".join(f"{x} long" for x in _FEW)).distinct()
    keyed = written(keyed.join(left, "node"), "keyed")
    sizes = keyed.groupBy("key", "l").agg(F.count("*").alias("m")).groupBy("key")
    mixed_keys = sizes.agg(F.max(F.struct("m", "l")).alias("top"), F.count("*").alias("labels"), F.sum("m").alias("m")).filter("labels > 1")
    mixed_keys = written(mixed_keys.select("key", F.col("top.l").alias("lt"), F.ceil(F.col("m") / 256).alias("parts"), "m"), "mixed")
    # Only what is outside a key's largest component meets the others, so a large component costs no pairs of its own;
    # the others are dealt over the key's parts, and each one outside goes to all of them.
    keyed = written(beside(keyed, mixed_keys, "key"), "keyed")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    side = lambda c: (F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("n", "before", "l", *_FEW)))
    apart = keyed.filter("l <> lt").select("key", every, *side("a"))
    rest = keyed.select("key", F.pmod(F.xxhash64("node"), "parts").alias("part"), *side("b"))
    # Sets share no more than what is left of either from the first member on that they have in common.
    fits = f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb) and {100 + rule.percent} * least(na - beforea, nb - beforeb) >= {rule.percent} * (na + nb)"
    # And their sketches differ in no more bits than the sets may in members.
    fits += f" and {100 + rule.percent} * ({' + '.join(f'bit_count({x}a ^ {x}b)' for x in _FEW)}) <= {100 - rule.percent} * (na + nb)"
    return apart.join(rest, ["key", "part"]).filter(f"la <> lb and {fits}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, rule: NearCopies = NearCopies()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    component_id is the smallest doc_id reachable over links, the row's own included; kept rows are those that have it.
    A text without words (null, empty) has no shingles and is linked with nothing. Rows that share a doc_id are one
    document to the links, and get one row each. A row without doc_id is linked with nothing, has no component and is
    kept. A similarity right at the limit is a link. Texts of any length are taken whole. An empty table gives no rows.
    Columns other than doc_id and text are not used.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = written(docs.mapInArrow(partial(_sign, rule=rule), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")
    real = signed.filter("doc_id is not null and digest is not null")
    # A class of equal sets goes by its smallest doc_id, and one row of it carries its bands.
    classes = written(real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.count("*").alias("m")), "classes")
    carriers = real.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    carriers = carriers.groupBy("digest", F.col("doc_id").alias("node")).agg(F.first("bands").alias("bands"))
    bands = written(carriers.select("node", F.explode("bands").alias("band")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "bands")
    leads = bands.groupBy("band", "salt").agg(F.min("node").alias("lead"), F.count("*").alias("n"))
    leads = leads.groupBy("band").agg(F.min("lead").alias("first"), F.sum("n").alias("n"), F.collect_list(F.struct("salt", "lead")).alias("leads")).filter("n > 1")  # SALTS at most
    leads = written(leads.select("band", "first", F.explode("leads").alias("of")).select("band", "first", "of.*"), "leads")
    members = written(bands.join(leads, ["band", "salt"]).select("band", "salt", "first", "lead", "node").distinct(), "members")
    # The full sets of all that share a band with another text, made once, and their sketches. Sizes and sketches rule
    # out most candidates, and never a pair that is similar enough.
    nodes = written(members.select("node").distinct(), "candidates")
    pool = written(_sets_of(nodes, docs, rule), "sets")
    odd = written(pool.mapInArrow(_odd, "node long, n long, odd array<long>"), "sketches")
    sized = f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb)"
    marks = lambda c: odd.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    marked = lambda pairs: pairs.distinct().join(marks("a"), "a").join(marks("b"), "b").filter(sized).select("a", "na", "oa", "b", "nb", "ob")
    sifted = lambda pairs: marked(pairs).mapInArrow(partial(_alike, rule=rule), "a long, b long").distinct()
    in_sub = members.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    of_leads = members.filter("lead = node and first <> lead").select(F.col("first").alias("a"), F.col("lead").alias("b"))
    tried = written(sifted(in_sub.unionByName(of_leads)), "pairs")
    links = written(_verified(tried, pool, rule), "links")
    # A doc_id with several texts joins their classes.
    several = real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("m"))
    several = written(several.filter("low <> high").select("doc_id", "m"), "several")
    own = beside(real.select("doc_id", "digest"), several, "doc_id").distinct().join(classes, "digest")
    own = written(own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "own-links")
    found = written(components(links.unionByName(own)), "components")

    label = lambda df, c, to: df.join(found.select(F.col("label").alias(c), F.col("root").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    placed, turn = None, 0
    while True:
        # Only buckets whose members are not all in one component need a further look.
        placed = written(label(members if placed is None else placed.drop("l"), "node", "l"), "placed")
        several_labels = written(placed.groupBy("band").agg(F.min("l").alias("low"), F.max("l").alias("high"), F.count("*").alias("m")).filter("low <> high").select("band", "m"), "mixed")
        placed = written(beside(placed, several_labels, "band", "left_semi"), "placed")
        turn += 1
        if turn > rule.turns or placed.isEmpty():
            break
        # In each turn another member, by chance, is held against all of its sub-bucket that are not in its component.
        lead = placed.groupBy("band", "salt").agg(F.min_by(F.struct("node", "l"), F.xxhash64("node", "band", F.lit(turn))).alias("lead"))
        more = placed.join(lead.withColumnRenamed("lead", "other"), ["band", "salt"]).filter("l <> other.l").select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))
        more = written(sifted(more).join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        tried = written(tried.unionByName(more), "tried")
        links = written(links.unionByName(_verified(more, pool, rule)), "links")
        found = written(components(links.unionByName(own)), "components")

    # What is left: unlinked texts that share a band all the same, for a passage they have in common, say. Small buckets
    # have few pairs. In large ones, two sets this similar share a member among the first few in any one order; with rare
    # shingles first, common passages drop out.
    if not placed.isEmpty():
        sizes = written(placed.groupBy("band").agg(F.count("*").alias("m")), "sizes")
        few = beside(placed, sizes.filter(F.col("m") <= PAIRED), "band").select("band", F.col("node").alias("a"), F.col("l").alias("la"))
        pairs = few.join(few.select("band", F.col("a").alias("b"), F.col("la").alias("lb")), "band").filter("a < b and la <> lb").select("a", "b")
        left = written(beside(placed, sizes.filter(F.col("m") > PAIRED), "band").select("node", "l").distinct(), "left")
        if not left.isEmpty():
            pairs = pairs.unionByName(_by_prefix(left, pool, rule))
        pairs = written(pairs.distinct(), "pairs")
        more = written(sifted(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        if not more.isEmpty():
            links = written(links.unionByName(_verified(more, pool, rule)), "links")
            found = written(components(links.unionByName(own)), "components")

    # Only classes of several rows, or with links, say more of a row than it does itself.
    labels = label(classes, "node", "component").filter("node <> last or component <> node").select("digest", "component", "m")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = beside(out, written(labels, "labels"), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
