"""License scans against plain sets and phrase search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marl.llm import licenses as li


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, cfg):
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        places = [(i, label) for phrase, label in cfg.phrases for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        found = []
        for at in range(0, len(w), cfg.stride):
            own = set(w[at : at + 2 * cfg.stride])
            for label, t in cfg.templates:
                t = set(words_of(t))
                if t and len(own & t) >= cfg.least(len(t)):
                    found.append((label, len(own & t) / len(t)))
        base = sorted({x for _, x in places})
        at = [i for i, _ in places]
        score = 1.0 if places else max((x for _, x in found), default=0.0)
        out.append((doc_id, len(w), len(places), min(at, default=None), max(at, default=None), base, sorted({*base, *(x for x, _ in found)}), score))
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    pool = sorted({x for _, t in li.TEMPLATES for x in words_of(t)} | {"zeta", "été", "non", "ΑΒ", "cc", "by"})
    rows = []
    for i in range(n):
        parts = [" ".join(r.choices(pool, k=r.randrange(30))) for _ in range(r.randrange(4))]
        for _ in range(r.randrange(3)):
            own = r.choice([*li.TEMPLATES, *((x, p) for p, x in li.PHRASES)])[1].split()
            if r.random() < 0.4:
                own[r.randrange(len(own))] = "edit"
            parts.insert(r.randrange(len(parts) + 1), r.choice([" ", "\n", ", "]).join(own).title())
        rows.append((r.choice([i, None]), "; ".join(parts)))
    long = "x " * 40_000 + "Licensed under\nthe MIT license " + "y " * 500 + "cc-by"
    return rows + [(1, None), (2, ""), (2, ""), (3, "...!"), (4, "All RIGHTS-reserved. all rights reserved"), (5, long), rows[0], rows[0]]


#: Phrases that begin alike, and templates of one, of equal and of no words.
ODD = li.LicenseConfig(0.7, 8, (("cc by", "cc-by"), ("cc by nc", "cc-by-nc"), ("by", "by")), (("one", "zeta"), ("a", "the mit license"), ("b", "license the MIT"), ("none", "..."), ("long", "this work is licensed under the terms")))


@pytest.mark.parametrize("cfg", [li.LicenseConfig(), ODD])
def test_against_plain_sets(spark, cfg):
    rows = made(3, 150)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, label int, text_key string").repartition(3)
    got = [tuple(r) for r in li.scan(docs, cfg).collect()]
    assert sorted(got, key=repr) == plain(rows, cfg) and sum(bool(r[6]) for r in got) > 30


def test_blocks_that_match(spark):
    cfg = li.LicenseConfig(stride=8)
    text = "a b c d e f released under the mit license g h"
    got = sorted(tuple(r) for r in li.matches(spark.createDataFrame([(7, text)], "doc_id long, text string"), cfg).drop("text_key").collect())
    assert got == [(7, 0, 13, "mit", 1.0)]


def test_empty_table_and_bounds(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert li.scan(nothing).collect() == []
    with pytest.raises(ValueError):
        li.word_sets(li.LicenseConfig(templates=(("a", " ".join(map(str, range(li.MOST_TEMPLATE_WORDS + 1)))),)))


def test_no_python(spark):
    plan = li.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string").where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")
