import numpy as np
import pytest
import xxhash

from marl.llm import caps, simhash


def roots(n, pairs):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        at[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", "  \t", "a b", "A B", "x", "one two three four", "ONE two\x0bthree four", "É é ü   z y w", "w " * 500, "the same text once more again", "the same text once more again"]


def test_fingerprint_is_the_plain_one():
    for t in TEXTS:
        assert simhash.fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 == plain_fingerprint(t)


def test_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base[:30].tolist() + [base[0]] * 60:
        for _ in range(4):
            x = int(f)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 4])
    keys = []
    for at, width in simhash.SEGMENTS:
        part = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            keys.append((part & ~np.uint64(1 << bit)) | np.uint64((at + bit) << 22))
    u, v = simhash.links_of(np.concatenate(keys).astype(np.int64), np.tile(fps.view(np.int64), 64), 4)
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    pairs = [(at[i], at[j]) for i, j in zip(u.tolist(), v.tolist())]
    assert all(bin(int(fps[i] ^ fps[j])).count("1") <= 4 for i, j in pairs)
    assert roots(len(fps), pairs) == want


def test_large_groups_of_one_variant():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 40, dtype=np.uint64) << np.uint64(22)
    fps = [int(b) for b in base for _ in range(12)]
    for k in range(len(fps)):
        for b in rng.choice(np.arange(22, 62), int(rng.integers(0, 4)), replace=False):
            fps[k] ^= 1 << int(b)
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 4])
    u, v = simhash.links_of(np.zeros(len(fps), np.int64), fps.view(np.int64), 4)  # all share the first segment without its first bit
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    assert roots(len(fps), [(at[i], at[j]) for i, j in zip(u.tolist(), v.tolist())]) == want and len(set(want)) > 20


def test_components_on_rows(spark):
    texts = TEXTS + [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" if i != 7 else "q" for i in range(300))]
    rows = [(i + 5, t, "x") for i, t in enumerate(texts)] + [(5, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.components(docs).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for t in texts]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert {(r.doc_id, r.component_id) for r in got} == {(i + 5, want[i] + 5) for i in range(len(fps))}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w + 5 for w in want}
    assert simhash.components(docs.limit(0)).collect() == []


def test_rows_without_or_with_one_id(spark):
    long = [f"w{i}" for i in range(400)]
    change = lambda *at: " ".join("q" if i in at else w for i, w in enumerate(long))
    texts = [change(), change(3), change(3, 200), change(3, 200, 350)]
    fps = [plain_fingerprint(t) for t in texts]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (4, texts[3]), (4, "something else entirely here"), (9, "something else entirely here"), (None, None), (8, "very long " * 60000)]
    want = roots(4, [(i, j) for i in range(4) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    ids = [None, None, 7, 4]
    least = {r: min((x for x, w in zip(ids, want) if w == r and x is not None), default=None) for r in set(want)}
    got = sorted(((r.doc_id, r.component_id) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == sorted([*((ids[i], least[want[i]]) for i in range(4)), (4, 4), (9, 4), (None, None), (8, 8)], key=repr)
    kept = {(r.doc_id, r.text) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (4, "something else entirely here") in kept and (9, "something else entirely here") not in kept
    one = spark.createDataFrame([(1, texts[0]), (5, texts[0]), (5, "quite another text of id five")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash.near_dedup(one).collect()} == {(1, texts[0]), (5, "quite another text of id five")}


@pytest.mark.parametrize("cell", [caps.CELL, 30])
def test_embeddings_against_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 64))
    near = base[rng.integers(0, 20, 250)]
    near = near / np.linalg.norm(near, axis=1, keepdims=True) + rng.standard_normal((250, 64)) * rng.uniform(0, 0.07, (250, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:40]]))]
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0] * 63 + [None]), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in caps.near_duplicates(df, cell=cell).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(len(x), list(zip(*(k.tolist() for k in np.nonzero(near)))))
    linked, there = sum(got[i].n_links for i in range(len(x))), int(near.sum())
    assert there > 1000 and 0.99 * there <= linked <= there
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) > 0.99
    for i in (9001, 9002, 9003, 9004, 9005, 9008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[9007].n_links, got[9007].component_id, got[9007].kept) == (1, 9006, False)
    assert caps.near_duplicates(df.limit(0)).collect() == []


def test_large_group_of_near_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(16)
    near = (one / np.linalg.norm(one) + rng.standard_normal((300, 16)) * 0.01).tolist()
    rows = [(i, v, "x", 1) for i, v in enumerate(near)] + [(None, near[5], "x", 1), (None, near[5], "y", 1), (7, [-x for x in near[0]], "z", 1), (7, near[7], "q", 1), (None, None, "q", 1)]
    far = rng.standard_normal(16)
    rows += [(None, (far - (far @ one) / (one @ one) * one).tolist(), "far", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, links int")
    got = caps.near_duplicates(df, cell=64)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    each = 300 + 2 + 1 - 1  # others of the group, repeated rows counted
    want = [(i, each, 0, i == 0) for i in range(300)] + [(None, each, 0, False)] * 2 + [(7, 0, 7, True), (7, each, 0, False), (None, 0, None, False), (None, 0, None, False)]
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("words", [32, 64, 200, 620])
@pytest.mark.parametrize("cos", [0.9, 0.93])
def test_recall_of_filters(cos, words):
    rng = np.random.default_rng(11)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b = cos * a + np.sqrt(1 - cos**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    cfg = caps.CapFilters(words=words)
    one, two = (dict() for _ in range(2))
    for side, x in ((one, a), (two, b)):
        for r, d in zip(*(k.tolist() for k in caps.decode(x, cfg))):
            side.setdefault(r, set()).add(d)
    assert np.mean([bool(one[i] & two[i]) for i in range(4000)]) > 0.98
