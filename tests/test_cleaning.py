"""Cleaning as one pass over a list of lines: the same text as its steps one after the other, and each step's work done once."""

import random

import pytest
from pyspark.sql import functions as F

from marl.functions import text
from marl.operators import clean

NOISE = ("تابعنا", "ab.", "SHARE")


def step_by_step(c, cfg):
    noise, _ = cfg.lists()
    folded = F.regexp_replace(F.translate(clean.strip_markup(F.coalesce(F.col(c), F.lit(""))), text.lexicon.LETTERS, text.lexicon.FOLDED_LETTERS), text.DIACRITICS, "")
    body = text.let(clean.noise_lines_removed(folded, noise), lambda t: text.let(clean.script_sections(t, cfg.script, cfg.line_chars, cfg.line_ratio), lambda s: F.when(s == "", t).otherwise(s)))
    tidy = text.strip(F.regexp_replace(F.regexp_replace(clean.lines_deduplicated(body), "[ \\t]+", " "), "\\n{3,}", "\n\n"))
    valid = lambda t: (F.length(t) >= cfg.least_chars) & (text.script_ratio(t, cfg.script) >= cfg.least_ratio)
    return text.let(tidy, lambda t: F.when(valid(t), t).otherwise(F.lit("")))


@pytest.mark.parametrize("script", [text.ARABIC, text.LATIN])
def test_cleaning_is_its_steps(spark, script):
    pick = random.Random(5)
    parts = ["word ", "كلمة ", "أإآ ", "مُـةٌ", "\t \t", "  ", "\n", "\n\n\n", "\r\n", " ", "\x1c", "　", "123456 ", "....", "\nab.\n", "\nshare\n", "\nتابعنا\n", "<b>", "é😀 ", "a long run of plain words ", "جملة طويلة من الكلمات "]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randrange(0, 60)))) for i in range(1500)] + [(-1, None), (-2, ""), (-3, "\n\n")]
    cfg = clean.CleanConfig(script=script, least_chars=20, noise=NOISE)
    df = spark.createDataFrame(rows, "i long, x string").select("i", clean.clean_content("x", cfg).alias("a"), step_by_step("x", cfg).alias("b"))
    found = df.collect()
    assert [r.i for r in found if r.a != r.b] == [] and len({r.a for r in found}) > 300


def test_texts_are_cut_into_lines_once(spark):
    plan = spark.createDataFrame([("a",)], "x string").select(clean.clean_content("x").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # before: three times, joined and cut anew after each step


def test_a_share_of_a_script(spark):
    rows = [("",), ("a",), ("1",), ("1" * 9 + "a",), ("a" + "1" * 9,), ("1" * 6 + "a",), ("😀" * 5 + "a",), ("aé" * 3,), (None,)]
    for least in (0.1, 0.15, 0.5, 1.0):
        same = text.reaches("x", text.LATIN, least).eqNullSafe(text.script_ratio("x", text.LATIN) >= least)
        assert spark.createDataFrame(rows, "x string").where(~same).count() == 0


def test_sentences_end_at_blanks_after_stops(spark):
    pick = random.Random(7)
    rows = [("".join(pick.choice("ab. !؟\n　\x1c\t") for _ in range(60)),) for _ in range(500)]
    before = F.filter(F.transform(F.split("x", f"(?<=[.!؟])[{text.SPACE}]+"), text.strip), lambda s: F.length(s) > 1)
    assert spark.createDataFrame(rows, "x string").where(text.split_sentences("x", 1) != before).count() == 0


@pytest.mark.parametrize("script", [text.ARABIC, text.LATIN, "\\p{IsLatin}"])
def test_texts_by_batches_are_cleaned_and_cut_as_by_expressions(spark, script):
    pick = random.Random(11)
    parts = ["word ", "كلمة ", "أإآ ", "مُـةٌ", "\t \t", "  ", "\n", "\n\n\n", "\r\n", "\x1c", "　", "123456 ", "....", "! ", "؟ ", "end. ", ".\n", "\nab.\n", "\nshare\n", "\nتابعنا\n", "<b>", "é😀 ", "@ x@y ", " http://a/b ", "[صفحة ٣]", "a long run of plain words. ", "جملة طويلة من الكلمات. "]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.randrange(0, 120))), i % 3) for i in range(800)] + [(-1, None, 0), (-2, "", 1), (-3, "\n\n", 2), (None, "a long run of plain words. " * 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `some.thing` int")
    cleaning = clean.CleanConfig(script=script, least_chars=20, noise=NOISE)
    for chunking in (clean.ChunkConfig(), clean.ChunkConfig(60, 25), clean.ChunkConfig(40, 40), clean.ChunkConfig(30, 0)):
        expected = clean.chunk_documents(clean.clean_documents(df.withColumnRenamed("some.thing", "some"), cleaning).drop("text", "quality", "hash"), chunking).collect()
        found = clean.chunk_texts(df, cleaning, chunking) if "p{" not in script else clean.chunk_texts(df.withColumnRenamed("some.thing", "some"), cleaning, chunking)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, expected))) and len(expected) > 300
        assert [f.dataType for f in found.schema] == [f.dataType for f in spark.createDataFrame(expected[:1], found.schema).schema]
