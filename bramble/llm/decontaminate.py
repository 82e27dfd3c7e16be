"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

The index is an inverted file over the items, postings in item order, cut into blocks that know their largest weight.
Weights are divided by the item's own threshold, so "above threshold" is a score of 1 for every item. A passage is
a window of `passage` words, one every `stride`; an item of up to `stride` words lies whole within a passage wherever it
stands, and a longer one's threshold falls to the share that a passage must hold of it.

Words are runs of letters and digits, so signs stuck to a word don't hide it. A passage is dropped for a range of items
if its distinct terms can't reach 1 with their largest weights in that range (for all passages and ranges of a block of
text at once, in numpy); what is left runs block-max WAND on the range: lists advance to the pivot whose list maxima
reach 1, and past whole blocks whose maxima don't. Everything that reaches 1 is retrieved, there is no top-k. A retrieved pair
counts if the text around the passage holds at least `overlap` percent of the five-word shingles of both the item's
question and its answer (the last sentence, or the last third of the words if there is one sentence only).

Items are indexed by shards of about `shard_chars` characters, each built by a task from its items and written to the
shared folder; document frequencies and the mean length are those of all items, so scores don't depend on the shards. A
searching task takes its texts `HELD` bytes at a time through one shard after the other: one scan of the texts, one
index in memory, nothing on the driver.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, Rolling, blocks, file_system, fresh_path, put_file, rows_kept, tidy, total_chars, ways, written


@dataclass(frozen=True)
class Rule:
    passage: int = 128
    stride: int = 64
    share: float = 0.6
    overlap: int = 80
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    posting_block: int = 32
    ranges: int = 64
    shard_chars: int = 4_000_000


#: Bytes of texts that a task takes through the shards at a time.
HELD = 48_000_000
_HASHER = Rolling(31)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def parts(text: str) -> tuple[str, str]:
    """An item's question and answer."""
    sentences = [x for x in _SENTENCE_END.split(text.strip()) if x]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = max(1, len(words) - len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hash(texts: list[str]) -> list[np.ndarray]:
    out = []
    for first, end, data, offsets in blocks(pa.array(texts, pa.string())):
        words, _, _, row = _HASHER.words(data, offsets, lower=True, gap=SIGNS)
        out += [words[row[k] : row[k + 1]] for k in range(end - first)]
    return out


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(_HASHER.runs(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Corpus:
    """What weights need to know of all items: their number, their mean length, and how many have a term."""

    items: int
    mean: float
    having: dict[int, int]


class Index:
    """An inverted index of items; `of`: the corpus that they are a part of, themselves if it is not given."""

    def __init__(self, items: list[tuple[int | None, str]], rule: Rule, of: Corpus | None = None) -> None:
        self.rule, self.item_ids = rule, [i for i, _ in items]
        words = _hash([t for _, t in items])
        self.lengths = [len(w) for w in words]
        halves = [parts(t) for _, t in items]
        self.question, self.answer = ([_shingles(w, rule.shingle) for w in _hash(list(h))] for h in zip(*halves, strict=True))
        #: Shingles of a part shorter than `shingle` words have that part's length.
        self.sizes = [tuple(min(rule.shingle, len(w)) for w in pair) for pair in zip(*(_hash(list(h)) for h in zip(*halves, strict=True)), strict=True)]
        postings: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            for t, n in zip(*np.unique(w, return_counts=True), strict=True):
                postings.setdefault(int(t), []).append((k, int(n)))
        self.terms = np.array(sorted(postings), np.uint64)
        of = of or Corpus(len(items), sum(self.lengths) / max(1, len(items)), {t: len(x) for t, x in postings.items()})
        mean = max(1.0, of.mean)
        weight, own = {}, np.zeros(len(items))
        for t, found in postings.items():
            idf = np.log1p((of.items - of.having[t] + 0.5) / (of.having[t] + 0.5))
            for k, n in found:
                weight[t, k] = idf * n * (rule.k1 + 1) / (n + rule.k1 * (1 - rule.b + rule.b * self.lengths[k] / mean))
                own[k] += weight[t, k]
        held = np.minimum(1.0, rule.stride / np.maximum(1, np.array(self.lengths)))
        threshold = np.maximum(rule.share * own * held, 1e-9)
        self.lists = []
        for t in self.terms.tolist():
            at = [k for k, _ in postings[t]]
            w = [weight[t, k] / threshold[k] for k in at]
            size = rule.posting_block
            self.lists.append((at, w, max(w), [max(w[i : i + size]) for i in range(0, len(w), size)]))
        #: The largest weight of each term in each range of items.
        self.range = max(1, -(-len(items) // rule.ranges))
        self.most = np.zeros((len(self.lists), -(-len(items) // self.range)), np.float32)
        for t, (at, w, _, _) in enumerate(self.lists):
            np.maximum.at(self.most[t], np.array(at) // self.range, np.array(w, np.float32))

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def retrieve(self, terms: list[int], first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """Every item of first..end-1 with a score of 1 or more for these distinct terms, by block-max WAND."""
        size, end = self.rule.posting_block, len(self.item_ids) if end is None else min(end, len(self.item_ids))
        lists = [self.lists[t] for t in terms]
        at = [bisect_left(x[0], first) for x in lists]
        head = [x[0][k] if k < len(x[0]) else end for x, k in zip(lists, at, strict=True)]
        out = []
        near = 1 - 1e-9
        while True:
            order = sorted((i for i in range(len(lists)) if head[i] < end), key=head.__getitem__)
            bound, pivot = 0.0, -1
            for k, i in enumerate(order):
                bound += lists[i][2]
                if bound >= near:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = head[order[pivot]]
            while pivot + 1 < len(order) and head[order[pivot + 1]] == item:
                pivot += 1
            block_bound, skip_to = 0.0, end
            for i in order[: pivot + 1]:
                ids = lists[i][0]
                p = bisect_left(ids, item, at[i])
                if p < len(ids):
                    block_bound += lists[i][3][p // size]
                    last = min(len(ids), (p // size + 1) * size) - 1
                    skip_to = min(skip_to, ids[last] + 1)
            if block_bound < near:  # no item up to the first block's end can reach 1
                if pivot + 1 < len(order):
                    skip_to = min(skip_to, head[order[pivot + 1]])
                target = max(skip_to, item + 1)
            else:
                score = 0.0
                for i in order[: pivot + 1]:
                    ids = lists[i][0]
                    p = bisect_left(ids, item, at[i])
                    if p < len(ids) and ids[p] == item:
                        score += lists[i][1][p]
                if score >= near:
                    out.append((item, score))
                target = item + 1
            for i in order[: pivot + 1]:
                ids = lists[i][0]
                at[i] = bisect_left(ids, target, at[i])
                head[i] = ids[at[i]] if at[i] < len(ids) else end


def _overlap(part: np.ndarray, size: int, region: np.ndarray) -> float:
    if not len(part):
        return 100.0
    return 100.0 * float(np.isin(part, _HASHER.runs(region, size)).sum()) / len(part)


def _above(index: Index, pairs: np.ndarray, passage: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of all that reach 1; pairs: passage * number of terms + term, sorted."""
    n_terms = len(index.terms)
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    step = max(1, 4_000_000 // index.most.shape[1] // max(1, len(pairs) // max(1, len(starts))))
    for k in range(0, len(starts), step):
        own = starts[k : k + step]
        end = int(starts[k + step]) if k + step < len(starts) else len(pairs)
        some = pairs[own[0] : end] % n_terms
        bound = np.add.reduceat(index.most[some], own - own[0], axis=0)
        for j, r in np.argwhere(bound >= 1 - 1e-5):
            a, b = int(own[j]), int(own[j + 1]) if j + 1 < len(own) else end
            for item, score in index.retrieve((pairs[a:b] % n_terms).tolist(), r * index.range, (r + 1) * index.range):
                yield int(passage[a]), item, score


def _held(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, item, first word, score, overlap of question and answer) of all passages that hold an item."""
    rule, n_terms = index.rule, len(index.terms)
    for first, end, data, offsets in blocks(texts):
        words, _, _, row = _HASHER.words(data, offsets, lower=True, gap=SIGNS)
        if not len(words) or not n_terms:
            continue
        # Strides are numbered through the block of text; passage p is stride p and the next one of the same text.
        counts = np.diff(row)
        strides = -(-counts // rule.stride)
        base = np.concatenate(([0], np.cumsum(strides)))
        owner = np.repeat(np.arange(end - first), counts)
        stride = base[owner] + (np.arange(len(words)) - row[owner]) // rule.stride
        term = index.term_of(words)
        known = np.flatnonzero(term >= 0)
        s, t, o = stride[known], term[known], owner[known]
        before = s > base[o]
        pairs = np.unique(np.concatenate((s * n_terms + t, (s[before] - 1) * n_terms + t[before])))
        passage = pairs // n_terms
        for p, item, score in _above(index, pairs, passage):
            k = int(np.searchsorted(base, p, "right")) - 1
            at = int(row[k]) + (p - int(base[k])) * rule.stride
            longest = index.lengths[item]
            region = words[max(int(row[k]), at - longest) : min(int(row[k + 1]), at + rule.passage + longest)]
            sizes = index.sizes[item]
            q = _overlap(index.question[item], sizes[0], region)
            a = _overlap(index.answer[item], sizes[1], region)
            if q >= rule.overlap and a >= rule.overlap:
                yield first + k, item, at - int(row[k]), score, q, a


_LOADED: dict[tuple[str, int], Index] = {}


def _shard(folder: str, number: int) -> Index:
    """A shard of the index; a worker keeps the last one."""
    key = folder, number
    if key not in _LOADED:
        _LOADED.clear()
        fs, root = file_system(folder)
        with fs.open_input_stream(f"{root}/items-{number:08d}", compression=None) as f:
            _LOADED[key] = pickle.loads(f.read())
    return _LOADED[key]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


_HITS = "doc_id long, item_id long, word long, score double, question_overlap double, answer_overlap double"


@tidy
def _search(batches: Iterator[pa.RecordBatch], folder: str, shards: list[int]) -> Iterator[pa.RecordBatch]:
    for held in _groups(batches):
        for number in shards:
            index = _shard(folder, number)
            for batch in held:
                rows = list(_held(index, batch.column(1)))
                if rows:
                    at, item, place, score, q, a = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([index.item_ids[i] for i in item], pa.int64()), pa.array(place, pa.int64()), pa.array(score), pa.array(q), pa.array(a)], [x.split()[0] for x in _HITS.split(", ")])


@tidy
def _keep(batches: Iterator[pa.RecordBatch], text: str, folder: str, shards: list[int]) -> Iterator[pa.RecordBatch]:
    for held in _groups(batches):
        texts = [pa.compute.fill_null(b.column(text), "") for b in held]
        stay = [np.ones(len(b), bool) for b in held]
        for number in shards:
            index = _shard(folder, number)
            for column, own in zip(texts, stay, strict=True):
                for row, *_ in _held(index, column):
                    own[row] = False
        for b, own in zip(held, stay, strict=True):
            yield b.filter(pa.array(own))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = _hash(b.column("text").to_pylist())
        terms = pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array([len(w) for w in words], pa.int64()), terms], ["shard", "length", "terms"])


def _build(key, items: pa.Table, having: pa.Table, folder: str, rule: Rule, n: int, mean: float) -> pa.Table:
    number = key[0].as_py()
    own = sorted(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    of = Corpus(n, mean, dict(zip(having.column("term").to_numpy().view(np.uint64).tolist(), having.column("n").to_pylist(), strict=True)))
    put_file(folder, f"items-{number:08d}", [pickle.dumps(Index(own, rule, of))])
    return pa.table({"shard": pa.array([number], pa.int32())})


def indexed(items: DataFrame, rule: Rule = Rule()) -> tuple[str, list[int]]:
    """(folder, shards) of an index of all items with a word, those without item_id included, equal rows once.

    Shards grow in number with the items, not in size; an item is never cut.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).distinct()
    n_shards = ways(total_chars(items), rule.shard_chars, least=1)
    items = written(items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n_shards)).cast("int")), "items")
    folder = fresh_path(items.sparkSession, "index")
    terms = written(items.mapInArrow(_terms, "shard int, length long, terms array<long>"), "terms")
    size = terms.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    one = terms.select("shard", F.explode("terms").alias("term"))
    having = one.distinct().join(one.groupBy("term").agg(F.count("*").alias("n")), "term")
    n, mean = size["n"], size["mean"] or 0.0
    built = items.groupBy("shard").cogroup(having.groupBy("shard")).applyInArrow(lambda key, t, u: _build(key, t, u, folder, rule, n, mean), "shard int")
    return folder, sorted(r["shard"] for r in written(built, "shards").collect())


def hits(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, item_id, word, score, question_overlap, answer_overlap): passages, by first word, that hold an item.

    Neighbouring passages that both hold an item give a row each, repeated rows of docs one row set each, and so do items
    with equal texts. Null or empty texts hold nothing; items without a word are held by nothing; one without item_id is
    searched for like any other. A score right at the threshold counts. Texts of any length are searched whole. No items
    or no docs: no rows. Columns other than doc_id and text, item_id and text are not used.
    """
    folder, shards = indexed(items, rule)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(partial(_search, folder=folder, shards=shards), _HITS)


def contaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, item_id, passages, score, question_overlap, answer_overlap): best figures of each document and item.

    Rows without doc_id are one document here, and so are items without item_id.
    """
    best = [F.round(F.max(c), 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return hits(docs, items, rule).groupBy("doc_id", "item_id").agg(F.countDistinct("word").alias("passages"), *best)


def clean(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, all columns as they are, whose own text holds no item, with or without doc_id."""
    folder, shards = indexed(items, rule)
    return rows_kept(docs, partial(_keep, folder=folder, shards=shards))
