"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: of its characters over the classes small letter, capital, digit, gap, symbol and
rest, and of its words over the common words of its language and "any other word". Both are compared with the
language's own histograms by the Jensen-Shannon distance (square root of the divergence to base 2, from 0 to 1).

The references are counted from all texts, one for each language that has at least `reference_words` words; it depends on
the texts of its language alone. A text of a language with fewer has nothing to be held against and passes by the base
rules. A word is common if it makes at least `word_share` of a language's words, so a language has at most 1/word_share
common words, held by 64-bit hashes. A language whose common words make less than `least_common` of its words (one that
is written without gaps, say) says nothing by them, and its texts are judged by their characters.

The limit of the word distance comes with the reference: `lack_share` of the distance that a text with none of its
common words has, and `max_word_distance` at most.

A text is one row from the scan to the result: no text or word array is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

CLASSES = ("small", "capital", "digit", "gap", "symbol", "rest")
SYMBOLS = r"[#*$%&|<>]"
GAP = r"[\x20\x09-\x0D]"
#: Common words are looked up in slots by their hash, and a word's number is slot * _SLOT + its place there.
_SLOTS, _SLOT = 64, 4096
#: So many references are broadcast (at most 4 kB each); more are joined by shuffling, each language over _SALTS keys.
_FEW, _SALTS = 2048, 32


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    word_share: float = 1 / 250
    reference_words: int = 2000
    least_common: float = 0.1
    #: Least words for which the word histogram, and least characters for which the class histogram, is judged.
    guard_words: int = 50
    guard_chars: int = 200
    max_class_distance: float = 0.3
    max_word_distance: float = 0.4
    lack_share: float = 0.9


def _language() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def _without(column: str, pattern: str) -> Column:
    return F.regexp_replace(column, f"{pattern}+", "")


def _words() -> Column:
    return F.split("text", f"{GAP}+")


def _with_classes(d: DataFrame) -> DataFrame:
    """d with the number of the text's characters, and of those of each class but the last.

    Small letters are taken out first and gaps then, so the rarer classes are looked for in what little is left.
    """
    n = lambda c: F.length(c).cast("long")
    d = d.withColumns({"n_chars_all": n("text"), "no_small": _without("text", r"\p{Ll}")})
    d = d.withColumns({"small": F.col("n_chars_all") - n("no_small"), "no_gap": _without("no_small", GAP)})
    others = {c: n("no_gap") - n(_without("no_gap", p)) for c, p in (("capital", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("symbol", SYMBOLS))}
    return d.withColumns({"gap": n("no_small") - n("no_gap"), **others}).drop("no_small", "no_gap")


def _rest() -> Column:
    return F.col("n_chars_all") - sum((F.col(c) for c in CLASSES[1:-1]), F.col(CLASSES[0]))


def counted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with the lengths and counts of their texts (null: no words) and their words' hashes."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = _with_classes(d.withColumn("words", F.transform(F.array_remove(_words(), ""), lambda w: F.xxhash64(w))))
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
        # Windows of three words by a 64-bit hash of theirs.
        "windows": F.when(F.size("words") >= 3, F.transform(F.slice("words", F.lit(1), F.size("words") - 2), lambda h, i: F.xxhash64(h, F.get("words", i + 1), F.get("words", i + 2)))),
    })
    d = d.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_chars": F.col("n_chars_all") - F.col("gap"),
        "n_symbols": F.col("symbol"),
        "ranked": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("lines", "windows")
    twice = F.filter("ranked", lambda x, k: (x["h"] == F.get("ranked", k - 1)["h"]) | (x["h"] == F.get("ranked", k + 1)["h"]))
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ranked")
    d = d.withColumn("covered", F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3)))))
    return d.withColumns({
        "n_repeat_words": F.coalesce(F.aggregate("covered", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "rest": _rest(),
    }).drop("starts", "covered")


def references(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row for each reference: language, its class shares, its common words by slots, their shares and the word limit."""
    d = docs.select(_language().alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    words = d.select("language", F.explode(_words()).alias("word")).filter("word <> ''").select("language", F.xxhash64("word").alias("word"))
    counts = written(words.groupBy("language", "word").agg(F.count("*").alias("n")), "word-counts")
    sizes = written(counts.groupBy("language").agg(F.sum("n").alias("of")).filter(F.col("of") >= rules.reference_words), "languages")
    # Words of one language are as many keys as it has words; only the few that can be common meet its size.
    likely = counts.filter(F.col("n") >= rules.word_share * rules.reference_words)
    common = likely.join(sizes, "language").filter(F.col("n") >= rules.word_share * F.col("of")).withColumn("share", F.col("n") / F.col("of"))
    common = common.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("word", "share"))).alias("common"))  # 1/word_share at most

    chars = _with_classes(d)
    chars = written(chars.groupBy("language").agg(*(F.sum(c).alias(c) for c in ("n_chars_all", *CLASSES[:-1]))), "class-counts")
    chars = chars.join(sizes.select("language"), "language").withColumn("rest", _rest())
    shares = chars.select("language", F.array(*((F.col(c) / F.col("n_chars_all")) for c in CLASSES)).alias("class_shares"))
    out = shares.join(common, "language", "left")
    total = F.aggregate("common", F.lit(0.0), lambda a, x: a + x["share"])
    lacking = F.sqrt((total + _part(F.lit(1.0), 1 - total)) / 2)
    slot = lambda k: F.filter("common", lambda x: F.pmod(x["word"], F.lit(_SLOTS)) == k)
    slots = F.transform(F.sequence(F.lit(0), F.lit(_SLOTS - 1)), slot)
    limit = F.when(total >= rules.least_common, F.least(F.lit(rules.max_word_distance), rules.lack_share * lacking))
    return out.select("language", "class_shares", slots.alias("slots"), total.alias("common_share"), limit.alias("word_limit"))


def _part(p: Column, q: Column) -> Column:
    """What a class adds to twice the divergence of shares p and q."""
    log = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return log(p) + log(q)


def _beside(d: DataFrame, refs: DataFrame) -> DataFrame:
    """Each row with its language's reference, if there is one."""
    if refs.count() <= _FEW:
        return d.join(F.broadcast(refs), "language", "left")
    salt = F.pmod(F.xxhash64("doc_id", "n_chars_all", "word_chars"), F.lit(_SALTS))
    wide = refs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return d.withColumn("salt", salt).join(wide, ["language", "salt"], "left").drop("salt")


def divergent(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs (doc_id, text and lang are used) with their counts, both distances and the verdict.

    Null text or lang: an empty text, an unnamed language. Empty text: no words, base_failed. Repeated rows are
    judged one by one, and so do equal distances and limits pass. A text of any length is one row. A language without a
    reference has null distances. An empty table gives no rows. Columns other than doc_id, text and lang are left out.
    """
    docs = docs.select("doc_id", "text", "lang")
    refs = written(references(docs, rules), "references")
    refs = refs.select("language", "class_shares", "common_share", "word_limit", F.transform("slots", lambda s: s["word"]).alias("slot_words"), F.transform("slots", lambda s: s["share"]).alias("slot_shares"))
    d = counted(docs).withColumn("language", _language()).drop("text", "lang")
    d = _beside(d, refs)

    def number(h: Column) -> Column:
        slot = F.pmod(h, F.lit(_SLOTS))
        place = F.array_position(F.get("slot_words", slot.cast("int")), h)
        return F.when(place > 0, slot * _SLOT + place - 1)

    d = d.withColumn("found", F.sort_array(F.array_compact(F.transform("words", number)))).drop("words")
    last = F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.get("found", i + 1).isNull() | (F.get("found", i) != F.get("found", i + 1)))
    d = d.withColumn("ends", F.when(F.size("found") > 0, last))
    n = F.nullif(F.col("n_words").cast("double"), F.lit(0.0))
    share = lambda k: F.get(F.get("slot_shares", F.floor(k / _SLOT).cast("int")), (k % _SLOT).cast("int"))
    hits = F.transform("ends", lambda e, k: F.struct(share(F.get("found", e)).alias("q"), ((e - F.coalesce(F.get("ends", k - 1), F.lit(-1))) / n).alias("p")))
    d = d.withColumn("hits", F.coalesce(hits, F.array().cast("array<struct<q:double,p:double>>"))).drop("ends")
    in_text = F.aggregate("hits", F.lit(0.0), lambda a, x: a + _part(x["p"], x["q"]))
    seen = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["q"])
    d = d.withColumns({"in_text": in_text, "unseen": F.col("common_share") - seen, "other_p": 1 - F.size("found") / n, "other_q": 1 - F.col("common_share")})
    # A common word that the text lacks adds its share: q * log2(2q / q).
    words = (F.col("in_text") + F.col("unseen") + _part(F.col("other_p"), F.col("other_q"))) / 2
    classes = sum((_part(F.col(c) / F.nullif("n_chars_all", F.lit(0)), F.get("class_shares", F.lit(k))) for k, c in enumerate(CLASSES)), F.lit(0.0)) / 2
    distance = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    d = d.withColumns({
        "class_distance": F.when((F.col("n_chars_all") >= rules.guard_chars) & (F.col("n_chars_all") > 0) & F.col("class_shares").isNotNull(), distance(classes)),
        "word_distance": F.when((F.col("n_words") >= rules.guard_words) & (F.col("n_words") > 0) & F.col("word_limit").isNotNull(), distance(words)),
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    })
    verdict = (F.coalesce("class_distance", F.lit(0.0)) <= rules.max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce("word_limit", F.lit(1.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & verdict)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
