"""The audit against exact arithmetic over plain counts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from marl.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, ranks=200):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(items[: None if part == "pair" else ranks], 1)]
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "été", "ÉTÉ", "x y", "İ", "ab", "a", "b", "aa", "zz-top", "don't", "𝒳", " ", "ñandú"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, r.choice([" ", "  ", "\n", ", ", "1"]).join(r.choices(words, k=r.randrange(40))), r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s0", "s1", "s2", None, ""])) for i in range(n)]
    return rows + [(None, None, "xx", "a"), (None, "", "xx", "b"), (1, "the the", "yy", "only"), (5, "ab " * 5000, "en", "s1"), *[rows[0]] * 4, *[(9, "rare rare", "zz", "s")] * 3]


@pytest.mark.parametrize("group_bytes", [600, 1 << 20])
def test_against_exact_arithmetic(spark, group_bytes):
    rows = made(7, 120)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, gid int, term int").repartition(3)
    got = sorted(tuple(r) for r in dv.audit(docs, dv.AuditConfig(group_bytes=group_bytes)).collect())
    assert got == plain(rows)


def test_ranks_are_cut(spark):
    rows = made(8, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in dv.audit(docs, dv.AuditConfig(ranks=3, least_documents=2)).collect())
    assert got == plain(rows, 2, 3)


def test_empty_table(spark):
    assert dv.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_shares_of_large_counts(spark):
    one = spark.createDataFrame([(3 * 10**15, 9 * 10**15, 7)], "n long, total long, kept long")
    from pyspark.sql import functions as F

    assert one.select(dv.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (3 * 10**15 + 1) // (9 * 10**15 + 7)
