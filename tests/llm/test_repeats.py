import random
import re
from hashlib import sha256

import numpy as np
import pytest

from marl.llm import fmindex, suffixes
from marl.llm.repeats import RepeatConfig, classes_of, remove_repeats
from marl.llm.text import gather


def brute(rows, size, units_of):
    """Flags of removed units by row, straight from the definition."""
    least = {}
    split = [units_of(t or "") for _, t in rows]
    for (i, _), u in zip(rows, split):
        for a in range(len(u) - size + 1):
            w = tuple(u[a : a + size])
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, _), u in zip(rows, split):
        flags = [False] * len(u)
        for a in range(len(u) - size + 1):
            if least[tuple(u[a : a + size])] < i:
                flags[a : a + size] = [True] * size
        out.append(flags)
    return split, out


def corpus(rng, n=120):
    words = ["the", "of", "and", "é", "ing", "zu", "wh", "x", "thereof", "ß!", "12", "a,b"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([40, 49, 50, 51, 70, 130]))) for _ in range(8)]
    gaps = [" ", "\n", "  ", "\t", " \x0b", "\x0c"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            kind = rng.random()
            if kind < 0.5:
                text = rng.choice(passages)
                if rng.random() < 0.4:
                    own = text.split(" ")
                    own[rng.randrange(len(own))] = "edit"
                    text = " ".join(own)
                if rng.random() < 0.3:
                    text = text[rng.randrange(30) :]
                parts.append(text)
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
        rows.append((i * 3 - 50, rng.choice(gaps).join(parts)))
    rows += [(9000 + i, rows[5][1]) for i in range(40)]
    rows += [(7000, "In. " * 900), (7001, "In. " * 300), (7002, None), (7003, ""), (7004, "aa " * 700 + "b"), (7005, "q" * 49), (7006, "q" * 49), (7007, "q" * 50), (7008, "q" * 50), (rows[3][0], rows[3][1]), (rows[3][0], rows[4][1]), (7000, rows[6][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [8192, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed, hot):
    rows = corpus(random.Random(seed))
    split, flags = brute(rows, 50, lambda t: list(t.encode()))
    want = []
    for (i, t), u, f in zip(rows, split, flags):
        spans = sum(1 for a, b in zip([False, *f], f) if b and not a)
        want.append((i, len(u), sum(f), spans, sha256(bytes(x for x, gone in zip(u, f) if not gone)).hexdigest()))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gid int").repartition(4)
    cfg = RepeatConfig(window=50, gram=24, unit="byte", group_bytes=20000, shard_bytes=9000, hot=hot)
    got = suffixes.digests(docs, cfg)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    kept = {(r.doc_id, sha256(bytes(r.kept)).hexdigest()) for r in suffixes.dedup_bytes(docs, cfg).collect()}
    assert kept == {(w[0], w[4]) for w in want}


@pytest.mark.parametrize("hot", [8192, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_brute_force(spark, seed, hot):
    rows = corpus(random.Random(seed))
    split, flags = brute(rows, 50, lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    want = [(i, len(u), sum(f), sha256(" ".join(x for x, gone in zip(u, f) if not gone).encode()).hexdigest()) for (i, t), u, f in zip(rows, split, flags)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, kept string").repartition(4)
    cfg = RepeatConfig(window=50, gram=10, unit="word", group_bytes=20000, shard_bytes=9000, hot=hot)
    assert sorted(tuple(r) for r in fmindex.digests(docs, cfg).collect()) == sorted(want)
    cut = fmindex.dedup_words(docs, cfg)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    expected = sorted(((i, t if not any(f) else " ".join(x for x, gone in zip(u, f) if not gone)) for (i, t), u, f in zip(rows, split, flags)), key=repr)
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == expected


def test_odd_tables(spark):
    one = "w%d " * 60 % tuple(range(60))
    docs = spark.createDataFrame([(None, one), (None, one), (5, one)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in fmindex.digests(docs).collect()), key=repr)
    assert got == sorted([(None, 60), (None, 60), (5, 0)], key=repr)
    assert fmindex.digests(docs.limit(0)).collect() == [] and suffixes.digests(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in suffixes.digests(nothing).collect()] == [(1, 0, 0, 0)]


def test_suffix_order_and_collisions():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[500:900] = text[1500:1900]
    text[2000:2300] = text[1500:1800]
    starts = np.arange(len(text) - 50)
    found = suffixes.Suffixes(text, starts, 50)
    raw = text.tobytes()
    assert found.order().tolist() == sorted(range(len(starts)), key=lambda i: (raw[i : i + 50], i))
    # segments whose hashes collide are told apart
    data = np.frombuffer(b"aaabbbaaabbb", np.uint8)
    at, n = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3])
    classes, reps = classes_of(data, at, n, np.zeros(4, np.uint64), np.array([4, 3, 2, 1]))
    heads = [data[at[reps[c]] : at[reps[c]] + 3].tobytes() for c in classes]
    assert heads == [b"aaa", b"bbb", b"aaa", b"bbb"]


def test_suffix_sort_needs_no_hash_and_no_room_for_the_text():
    import tracemalloc

    rng = np.random.default_rng(4)
    for limit in (1, 5, 8, 9, 16, 23, 50):
        for letters in (1, 2, 256):
            text = rng.integers(0, letters, 900).astype(np.uint8)
            text[100:300] = text[500:700]
            starts = rng.integers(0, len(text) - limit + 1, 400)
            raw = text.tobytes()
            want = sorted(range(len(starts)), key=lambda i: (raw[starts[i] : starts[i] + limit], i))
            order, new = suffixes.Suffixes(text, starts, limit).classes()
            assert order.tolist() == want
            assert new.tolist() == [True] + [raw[starts[a] : starts[a] + limit] != raw[starts[b] : starts[b] + limit] for b, a in zip(want, want[1:])]
    # what is held follows from the windows: a place of the text that starts none costs nothing
    text, n = rng.integers(97, 123, 4_000_000).astype(np.uint8), 1000
    tracemalloc.start()
    suffixes.resolve(text, np.arange(n) * 4000, np.full(n, 4000), np.ones(n, np.int64), np.arange(n), np.arange(n))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_gather_lays_stretches_end_to_end():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    for most, n in ((1, 0), (1, 9), (3, 70_000), (60, 5000), (400, 1000), (100_000, 8)):
        lengths = rng.integers(0, most, n)
        starts = rng.integers(0, len(data) - most, n)
        assert gather(data, starts, lengths).tobytes() == b"".join(data[a : a + m].tobytes() for a, m in zip(starts, lengths))


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fmindex.FMIndex(text, 8)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        a = int(rng.integers(0, 390))
        pattern = text[a : a + n]
        low, high = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
        assert int(high[0] - low[0]) == len(places)


def test_nothing_but_the_resolver_removes(spark):
    rows = corpus(random.Random(7), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    silent = lambda text, starts, lengths, windows, ids, highest: np.full(int(windows.sum()), np.iinfo(np.int64).max)
    for module, made, least in ((suffixes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", 1000), (fmindex, "n_words long, n_removed long, kept_sha256 string", 300)):
        cfg = RepeatConfig(**{**module.CONFIG.__dict__, "group_bytes": 9000, "shard_bytes": 5000})
        total = lambda resolver: sum(r.made_n_removed for r in remove_repeats(docs, resolver, module._digests, made, cfg).collect())  # noqa: B023, E731
        assert total(silent) == 0 and total(module.resolve) > least


def test_long_runs_and_long_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(80000))
    rows = [(9, "In. " * 80000), (4, "In. " * 6000 + "end"), (7, long), (8, word() + long[100000:180000] + word()), (5, "q" * 30000), (6, "q" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for module, units, join in ((suffixes, lambda t: [t.encode()[i : i + 1] for i in range(len(t.encode()))], b""), (fmindex, lambda t: [w.encode() for w in t.split()], b" ")):
        least, split = {}, {i: units(t) for i, t in rows}
        text = {i: join.join(u) for i, u in split.items()}
        edges = {i: np.concatenate([[0], np.cumsum([len(x) + len(join) for x in u])]) for i, u in split.items()}
        cut = lambda i, a: text[i][edges[i][a] : edges[i][a + 50] - len(join)]  # noqa: B023, E731
        for i, u in split.items():
            for a in range(len(u) - 49):
                w = cut(i, a)
                least[w] = min(least.get(w, i), i)
        want = []
        for i, u in split.items():
            edge = np.zeros(len(u) + 1, int)
            for a in range(len(u) - 49):
                if least[cut(i, a)] < i:
                    edge[a] += 1
                    edge[a + 50] -= 1
            want.append((i, int((np.cumsum(edge[:-1]) > 0).sum()), sha256(join.join(x for x, gone in zip(u, np.cumsum(edge[:-1]) > 0) if not gone)).hexdigest()))
        assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in module.digests(docs).collect()) == sorted(want)


def _plain_statistics(parts, ids, below, depth):
    """(match, least id of a match of full depth) by comparing every place with every other one of a smaller id."""
    match, least = [], []
    for p, limit in zip(parts, below):
        for i in range(len(p)):
            best, low = 0, -1
            for other, own in zip(parts, ids):
                if own >= limit:
                    continue
                for j in range(len(other)):
                    n = 0
                    while n < depth and i + n < len(p) and j + n < len(other) and p[i + n] == other[j + n]:
                        n += 1
                    best = max(best, n)
                    if n == depth:
                        low = own if low < 0 else min(low, own)
            match.append(best)
            least.append(low)
    return match, least


@pytest.mark.parametrize("seed, symbols, depth", [(2, 4, 7), (3, 3, 5), (4, 9, 6), (5, 2, 12), (6, 300, 9)])
def test_statistics_are_lengths_of_matches_with_smaller_ids(seed, symbols, depth):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(1, symbols, n) for n in (9, 30, 5, 30, 12, 40, 1, 25)]
    parts[3][4:20] = parts[1][10:26]
    parts[5][:12] = parts[4]
    laid = np.concatenate([np.append(p, 0) for p in parts])
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ids = np.array([4, 3, 9, 1, 2, 7, 5, 6])
    below = ids + np.array([0, 0, 3, 0, 0, 0, 2, 0])
    index = fmindex.FMIndex(laid, depth, np.repeat(ids, lengths + 1))
    match, least = index.statistics(laid, starts, lengths, below)
    want = _plain_statistics([p.tolist() for p in parts], ids, below, depth)
    assert match.tolist() == want[0] and least.tolist() == want[1]
    assert any(0 < m < depth for m in match[9:]) and (match[lengths[:3].sum() : lengths[:4].sum()] == 0).all()  # matches fall short; the smallest id has none


def test_no_answer_without_the_wavelet_matrix(monkeypatch):
    words = [f"w{i % 70}" for i in range(140)]
    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    half = len(" ".join(words[:70]))
    starts, lengths = np.array([0, half + 1]), np.array([half, len(text) - half - 1])
    asked = (text, starts, lengths, np.array([21, 21]), np.array([3, 8]), np.array([3, 8]))
    assert fmindex.resolve(*asked).tolist() == [3] * 42
    monkeypatch.setattr(fmindex.WaveletMatrix, "descend", lambda self, symbols, place: np.zeros(np.shape(place), np.int64))
    assert fmindex.resolve(*asked).tolist() == [3] * 21 + [8] * 21


def test_least_of_ranges():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1000, 777)
    low = rng.integers(0, 777, 3000)
    high = np.minimum(777, low + 1 + (rng.random(3000) ** 4 * 776).astype(int))
    table = fmindex.LeastId(values)
    assert table.kinds[table.of(low, high)].tolist() == [values[a:b].min() for a, b in zip(low, high)]
