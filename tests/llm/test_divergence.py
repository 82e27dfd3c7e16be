"""Verdicts that depend on a text's own language alone, and the registered query against its SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bramble.llm import divergence, oracles

R = random.Random(5)
COMMON = {"aa": ["the", "of", "and", "to"], "bb": ["der", "und", "zu", "von"]}
SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def _text(of: str, n: int = 300) -> str:
    return " ".join(R.choice(COMMON[of]) if R.random() < 0.2 else "".join(R.choice("abcdefgh") for _ in range(7)) for _ in range(n))


ROWS = [(i, _text(of), of) for i, of in enumerate(("aa", "bb") * 60)]
WIDE = [(5000 + i, " ".join("".join(chr(0x4E00 + R.randrange(900)) for _ in range(5)) for _ in range(100)), "zh") for i in range(3)]


def _kept(spark, rows) -> dict:
    return {(x["doc_id"], x["text"]): tuple(x[c] for c in COLUMNS) for x in divergence.divergent(spark.createDataFrame(rows, SCHEMA)).join(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), "doc_id").collect()}


def test_other_languages_change_nothing(spark):
    alone, together = _kept(spark, ROWS[::2]), _kept(spark, ROWS + WIDE)
    assert all(together[k] == v for k, v in alone.items())
    assert all(together[k, t][7] and together[k, t][8] is None for k, t, _ in WIDE)  # too few words for a reference
    many = [(6000 + i, " ".join("".join(chr(0x4E00 + R.randrange(900)) for _ in range(5)) for _ in range(100)), "zh") for i in range(30)]
    got = _kept(spark, ROWS + many)
    assert all(got[k, t][7] and got[k, t][8] < 0.05 and got[k, t][9] is None for k, t, _ in many)  # no word is common there
    assert not _kept(spark, [*ROWS, (7000, WIDE[0][1], "aa")])[7000, WIDE[0][1]][7]


def test_many_references_are_joined_alike(spark, monkeypatch):
    few = _kept(spark, ROWS)
    monkeypatch.setattr(divergence, "_FEW", 0)
    assert _kept(spark, ROWS) == few


def test_against_sql(spark):
    """Nulls, empty and odd texts, repeated lines, a text of 2 MB, repeated rows, ties, clashing columns."""
    odd = [(900, None, "aa"), (901, "", None), (902, " \n\t\x0b\n", "bb"), (903, "a b c a b c\nx x\nx x\n\n## a", "aa"), (None, _text("aa"), "aa"), (904, "É<é>|$%&* 12 ٣ ǅ 中文 " * 30, "aa"), (905, "one two three four five six\n" * 9, "bb"), (906, _text("aa", 250_000), "aa")]
    rows = [*ROWS, *WIDE, *odd, odd[4], ROWS[0]]
    df = spark.createDataFrame([(*r, 1, "w", 2.0) for r in rows], f"{SCHEMA}, language int, words string, share double")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in divergence.divergent(df).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang").toPandas())
    wanted = sorted((tuple(r) for r in con.execute(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, * EXCLUDE doc_id FROM ({oracles.DIVERGENCE})").fetchall()), key=repr)
    assert len(got) == len(rows)
    for a, b in zip(got, wanted, strict=True):
        assert a[:8] == b[:8] and a[8:] == pytest.approx(b[8:], abs=2e-6)


def test_a_text_of_another_language(spark):
    rows = [*ROWS, (1000, _text("bb"), "aa"), (1001, _text("aa"), "bb")]
    got = {x["doc_id"]: x for x in divergence.divergent(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(x["kept"] for i, x in got.items() if i < 1000)
    for i in (1000, 1001):
        assert not got[i]["kept"] and not got[i]["base_failed"] and got[i]["word_distance"] < divergence.Rules().max_word_distance


def test_no_python_in_the_plan(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    plan = divergence.divergent(spark.read.parquet(f"{d}/documents.parquet").filter(F.length("text") >= 0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
