import random

import pytest
from pyspark.sql import functions as F

from marl.llm import chat, common, decontaminate

from .test_pipeline import words_of
from .test_similar import roots

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant"), (1, 2, "assistant", "<|<\\|<\\\\|< |\\<|"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "é🎉\n\n"), (3, 0, None, None), (None, 5, "assistant", "x"), (None, 5, "assistant", "x"),
    (4, 1, "assistant", "late"), (4, 0, "user", "early"), (5, None, "us\ner<|\\n", "odd role \\"), (7, 0, "a\x01\x01b\\\\n\\b", "controls \x01\x02"), (8, 0, "<|im_start|>\n", "\x01"), (6, 0, "user", "q" * 200000), (6, 1, "assistant", "<|" * 50000),
]


def told(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def test_conversations_are_read_back_as_they_were(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.read_back(chat.format_conversations(df))
    got = {r.conv_id: r for r in out.collect()}
    want = told(ROWS)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert got[conv].formatted.count("<|im_start|>") == len(turns) == got[conv].formatted.count("<|im_end|>")
    assert {c: got[c].valid for c in (1, 2, 3, 4, 6)} == {1: True, 2: False, 3: False, 4: True, 6: True}
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<|\\n\nab\x01") for _ in range(rng.randrange(30))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"), chat._unescape_role(chat._escape_role(F.col("t"))).alias("r"), chat._escape_role(F.col("t")).alias("er")).collect()
    assert all("<|" not in r.e and r.b == r.t and r.r == r.t and "\n" not in r.er and "<|" not in r.er for r in rows)


def contamination_model(text, items, n=13):
    words, hit, named = words_of(text), [False] * len(words_of(text)), set()
    for item_id, item in items:
        own = words_of(item)
        k = min(n, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit[i : i + k] = [True] * k
                named.add(str(item_id))
    return len(words), sum(hit), sorted(named)


@pytest.mark.parametrize("held", [decontaminate.BROADCAST_BYTES, 4000])
def test_contamination_against_brute_force(spark, held):
    rng = random.Random(6)
    vocabulary = ["a", "B", "c1", "É", "é", "zz", "ß", "日本"]
    prose = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([5, 13, 14, 30, 3, 12])] + [(6, None), (7, "!!"), (8, items_like := "one two three"), (8, items_like), (9, items_like)]
    texts = [None, "", "...", "one, TWO; three!", *[prose(rng.randrange(0, 120)) for _ in range(40)]]
    texts += [prose(40) + " " + items[3][1] + " " + prose(40), items[1][1].lower(), items[0][1] * 2, "x " * 90000 + items[2][1]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, "another text of four"), (5, texts[5]), (None, items[3][1])]
    df = spark.createDataFrame([(*d, 0, "w") for d in docs], "doc_id long, text string, at int, w string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(df, bench, broadcast_bytes=held).collect()), key=repr)
    want = []
    for i, t in docs:
        n, hit, named = contamination_model(t, items)
        want.append((i, n, hit, named, hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)
    kept = decontaminate.decontaminate(df, bench)
    clean = {(i, t) for i, t in docs if not (lambda m: m[1] > 0 and 20 * m[1] >= m[0])(contamination_model(t, items))}
    assert kept.columns == df.columns and {(r.doc_id, r.text) for r in kept.collect()} == clean


@pytest.mark.parametrize("size", range(1, 14))
def test_window_hashes_tell_windows_apart(spark, size):
    rng = random.Random(size)
    rows = [([rng.choice("ab") for _ in range(n)],) for n in (0, 1, size - 1, size, size + 1, 40)]
    hashed = spark.createDataFrame(rows, "w array<string>").select("w", decontaminate.window_hashes(F.col("w"), size).alias("h")).collect()
    known = {}
    for r in hashed:
        windows = [tuple(r.w[i : i + size]) for i in range(len(r.w) - size + 1)]
        assert len(r.h) == len(windows)
        for w, h in zip(windows, r.h):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_empty_benchmark_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


@pytest.mark.parametrize("small", [0, common.SMALL_ROWS])
def test_components_of_links(spark, small):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 640)] + [(900, i) for i in range(901, 1200)] + [(7, 7)]
    want = roots(1200, pairs)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(7), small).collect()}
    assert got == {i: want[i] for i in range(1200) if want[i] != i}
    assert common.connected_components(spark.createDataFrame([], "u long, v long"), small).collect() == []

