import itertools

import numpy as np

from marl.llm import quality, toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 2, 6, 1]
    texts = np.concatenate([[0], np.cumsum(lengths)])
    unary, pair = rng.normal(size=(texts[-1], 2)) * 3, rng.normal(size=(2, 2)) * 2
    good, joint, log_z = quality.marginals(unary, pair, texts, each := rng.uniform(0.5, 2, len(lengths)))
    want, wanted_joint = [], np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(texts[:-1], texts[1:])):
        total, ones, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(unary[a + i, s] for i, s in enumerate(labels)) + sum(pair[s, t] for s, t in zip(labels, labels[1:])))
            total += p
            ones += p * np.array(labels)
            for s, t in zip(labels, labels[1:]):
                pairs[s, t] += p
        want.extend(ones / total)
        wanted_joint += each[k] * pairs / total
        assert np.isclose(log_z[k], np.log(total))
    assert np.allclose(good, want) and np.allclose(joint, wanted_joint)


def test_gradient_of_the_field_is_that_of_its_loss():
    rng = np.random.default_rng(5)
    places = np.concatenate([[0], np.cumsum([1, 5, 2, 9, 3])])
    x, y, theta = rng.normal(size=(places[-1], 4)), np.array([1.0, 0, 1, 1, 0]), rng.normal(size=8)
    _, g = quality.loss(theta, x, y, places, 0.01)
    for k in range(8):
        step = np.eye(8)[k] * 1e-6
        numeric = (quality.loss(theta + step, x, y, places, 0.01)[0] - quality.loss(theta - step, x, y, places, 0.01)[0]) / 2e-6
        assert np.isclose(g[k], numeric, atol=1e-6)


def test_gradient_of_the_counterfactual_loss():
    rng = np.random.default_rng(6)
    cfg = toxicity.ToxicityConfig(ridge=0.01, counterfactual=3.0)
    at = toxicity.loss(np.array([1.0, 0, 1]), [[0, 2], [], [1]], [([0], [1, 3], 5), ([2], [], 1)], 4, cfg)
    w = rng.normal(size=5)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert np.isclose(at(w)[1][k], (at(w + step)[0] - at(w - step)[0]) / 2e-6, atol=1e-6)
    change = np.array([w[1] + w[3] - w[0], -w[2]])
    plain = toxicity.loss(np.array([1.0, 0, 1]), [[0, 2], [], [1]], [], 4, cfg)
    assert np.isclose(at(w)[0] - plain(w)[0], 3.0 * (5 * change[0] ** 2 + change[1] ** 2) / 6)


def test_lines_are_those_of_split():
    texts = [b"", b"a\n", b"\n\n", b"one\ntwo\n\nthree", b"x", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, stops, counts = quality.lines_of(data, offsets)
    got = [data[a:b].tobytes() for a, b in zip(starts, stops)]
    assert got == [line for t in texts for line in t.split(b"\n")]
    assert np.diff(counts).tolist() == [t.count(b"\n") + 1 for t in texts]


def test_batches_do_not_change_scores():
    rng = np.random.default_rng(2)
    clean = [("\n".join("The quick brown fox jumps over it, and runs." for _ in range(rng.integers(1, 9)))).encode() for _ in range(60)]
    junk = [("\n".join("BUY!! %%% NOW!! $$$ ### &&&" for _ in range(rng.integers(1, 9)))).encode() for _ in range(60)]
    model = quality.fit(clean + junk, np.array([1] * 60 + [0] * 60))
    texts = [*clean[:5], b"", *junk[:5], b"\n", clean[0] + b"\n" + junk[0]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = model.score(data, offsets)
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(whole, alone)
    assert (whole[:5] > 0.5).all() and (whole[6:11] < 0.5).all() and ((whole >= 0) & (whole <= 1)).all()


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Fine text.", "z"), (3, "Fine text.", "z"), (None, "w " * 50000, None)], "doc_id long, text string, score string")
    none = quality.fit_sample(spark.createDataFrame([], "doc_id long, text string, y int"))
    rows = quality.score(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality.score(docs.limit(0), none).collect() == []


def bias_sample(spark, groups=("women", "men")):
    """Half of the toxic texts show it by their words; the others only by which group they name, in a biased sample."""
    rows = []
    for i in range(400):
        group, shown = groups[i % 2], i % 5 == 0
        bad = shown or i % 20 < (12 if i % 2 == 0 else 4)
        rows.append((i, f"We met some {group} there. {'You idiot fool' if shown else 'A fine day'}.", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_counterfactuals_take_the_weight_off_identity_terms(spark):
    sample = bias_sample(spark)
    plain = toxicity.fit(sample, toxicity.ToxicityConfig(counterfactual=0.0, least_odds=1.2))
    fair = toxicity.fit(sample, toxicity.ToxicityConfig(counterfactual=50.0, least_odds=1.2))
    assert plain.pairs == fair.pairs == 400 * 4  # each sentence once with each other term of the group
    assert toxicity.score_gap(sample, plain) > 0.2 and toxicity.score_gap(sample, fair) < 0.2 * toxicity.score_gap(sample, plain)
    docs = spark.createDataFrame([(1, "women are here"), (2, "you idiot fool"), (3, None), (4, ""), (4, "men " * 60000)], "doc_id long, text string")
    got = {(r.doc_id, r.score < 0.5) for r in toxicity.score(docs, fair).collect()}
    assert got == {(1, True), (2, False), (3, True), (4, True)}


def test_identity_terms_are_found_in_the_sample(spark):
    sample = bias_sample(spark, ("zorps", "blips"))
    cfg = toxicity.ToxicityConfig(least_odds=4.5, neutral_share=0.6, neutral_odds=4.5, beginnings=(), counterfactual=50.0)
    fair = toxicity.fit(sample, cfg)
    assert fair.exchanges == {"blips": ["zorps"], "zorps": ["blips"]} and fair.pairs == 400
    plain = toxicity.fit(sample, toxicity.ToxicityConfig(**{**cfg.__dict__, "counterfactual": 0.0}))
    assert plain.exchanges == fair.exchanges
    assert toxicity.score_gap(sample, fair) < 0.2 * toxicity.score_gap(sample, plain)


def test_toxicity_without_labels_and_in_a_filter(spark):
    empty = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, y int"))
    docs = spark.createDataFrame([(1, "a b", "y"), (2, None, None), (2, None, None)], "doc_id long, text string, score string")
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    model = toxicity.ToxicityModel({"idiot": 5.0}, -2.0, toxicity.ToxicityConfig())
    more = docs.union(spark.createDataFrame([(3, "An IDIOT.", "q")], docs.schema))
    kept = toxicity.drop_toxic(more, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    assert toxicity.drop_toxic(docs.limit(0), model).collect() == []


def test_held_out_rows_are_not_fitted_on(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    ids = [r.doc_id for r in toxicity.labelled_sample(docs, labels, "toxic", 5, 0, 1000).collect()]
    assert sorted(ids) == [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert toxicity.labelled_sample(docs, labels, "toxic", 5, 0, 7).count() == 7


def test_samples_are_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i % 5, "é" * (i % 50)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] * 3, "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 5, 7, 1000).collect()
    assert len(rows) == len({tuple(r) for r in rows}) == 50  # ten texts for each id, repeated rows once
    assert toxicity.labelled_sample(docs, labels, "toxic", 5, 7, 8).count() == 8
    some = toxicity.labelled_sample(docs, labels, "toxic", 5, 7, 1000, 700).collect()
    assert 0 < sum(len(r.text.encode()) for r in some) <= 700


def test_a_text_of_very_many_lines(spark):
    model = quality.fit([b"Fine prose, it is.\nMore of it."] * 20 + [b"%%% $$$\n### !!!"] * 20, np.array([1] * 20 + [0] * 20))
    docs = spark.createDataFrame([(1, "Fine prose, it is.\n" * 60000), (2, "%%% $$$\n" * 60000), (3, "\n" * 60000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got[1] > 0.5 > got[2] and 0 <= got[3] <= 1


def test_repeated_and_tied_samples_give_one_model(spark):
    rows = [(i, "fine words here" if i % 2 else "junk %%%", i % 2) for i in range(40)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one = quality.fit_sample(toxicity.labelled_sample(docs.repartition(3), labels, "quality", 3, 1, 20))
    two = quality.fit_sample(toxicity.labelled_sample(docs.union(docs).repartition(5), labels.repartition(4), "quality", 3, 1, 20))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_ties_at_the_cut_of_features_and_texts_without_blanks(spark):
    rows = [(i, "alphabad betabad gammabad" if i % 2 else "plain", i % 2) for i in range(40)] + [(50, "alphabadbetabad", 1), (51, "一二三" * 50, 0)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    cfg = toxicity.ToxicityConfig(evidence=2, beginnings=(), neutral=0)
    model = toxicity.fit(sample, cfg)
    assert set(model.weights) == {"alphabad", "betabad"}  # three features tie, names decide
    docs = spark.createDataFrame([(1, "alphabad"), (2, "alphabadbetabad" * 2000), (3, "一二三" * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def plain_line_features(line):
    words = line.split()
    size, n = len(line), len(words)
    share = lambda members: sum(bool(members(c)) for c in line) / max(size, 1)
    prose, blank = b".,;:?'\"-()", b" \t\r\x0b\x0c"
    other = lambda c: c < 0x80 and not chr(c).isalnum() and c not in prose and c not in blank
    again, beside, single = n - len(set(words)), sum(a == b for a, b in zip(words, words[1:])), sum(len(w) == 1 for w in words)
    own = [1.0, *(4 * share(m) for m in (lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in prose, other)), share(lambda c: c >= 0x80)]
    own += [x / max(n, 1) for x in (again, beside, single)]
    own += [np.log1p(size) / 5, np.log1p(n) / 3, size / max(n, 1) / 10, float(line[-1:] in (b".", b"!", b"?") and size > 0)]
    return [min(x, 4.0) for x in own]


def plain_quality(text, model):
    """Scores from the definition: features of three lines, every labelling of the lines in turn, means by length, a logistic curve."""
    lines = text.split(b"\n")
    own = [plain_line_features(x) for x in lines]
    none = [0.0] * len(own[0])
    z = [float(np.dot(model.weights, own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none))) for i in range(len(own))]
    total, good = 0.0, np.zeros(len(lines))
    for labels in itertools.product((0, 1), repeat=len(lines)):
        p = np.exp(sum(z[i] / 2 if s else -z[i] / 2 for i, s in enumerate(labels)) + sum(model.pair[s, t] for s, t in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    weight = np.array([len(x) + 1 for x in lines])
    share = np.clip((good / total * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.bias)))


def test_quality_scores_against_a_plain_version(spark):
    rng = np.random.default_rng(12)
    pool = ["The", "old", "river", "été", "x", "x", "runs.", "NOW!!", "$$$", "42", "a,b", "##", "(so)", "\x7f", "ß"]
    line = lambda: " ".join(rng.choice(pool, rng.integers(0, 9)).tolist())
    texts = ["\n".join(line() for _ in range(rng.integers(1, 8))) for _ in range(60)] + ["", "\n", " ", "a\tb\x0bc", "The end.\n\n\nNOW!!"]
    model = quality.fit([t.encode() for t in texts], np.array([int("$" not in t and "NOW" not in t) for t in texts]))
    data, offsets = np.frombuffer("\n".join(texts).encode(), np.uint8), np.array([0, len("\n".join(texts).encode())])
    x, size, _ = quality.line_features(data, offsets)
    assert np.allclose(x, [plain_line_features(row) for row in data.tobytes().split(b"\n")]) and size.sum() + len(x) - 1 == len(data)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(np.isclose(got[i], plain_quality(t.encode(), model), atol=1e-9) for i, t in enumerate(texts)) and len({round(s, 3) for s in got.values()}) > 10


def test_toxicity_of_the_production_settings_against_a_plain_version(spark):
    import re

    rng = np.random.default_rng(13)
    calm, foul = ["river", "harvest", "été", "women", "men", "que", "des", "lantern", "Ground"], ["scoundrel", "idiotic", "vermin"]
    rows = []
    for i in range(400):
        bad = i % 3 == 0
        words = rng.choice(calm, 12).tolist() + ([str(rng.choice(foul))] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ". " + " ".join(rng.choice(calm, 5).tolist()) + ("" if i % 7 else "\nIDIOTS no_more 3x"), int(bad)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    cfg = toxicity.ToxicityConfig()  # as registered
    model = toxicity.fit(sample, cfg)
    unfair = toxicity.fit(sample, toxicity.ToxicityConfig(counterfactual=0.0))
    assert model.pairs > 0 and model.exchanges and toxicity.score_gap(sample, model) <= toxicity.score_gap(sample, unfair)

    def plain(text):
        found = set()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found |= {w, *(f"{w[:n]}*" for n in cfg.beginnings if len(w) >= n)}
        return 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(t, 0.0) for t in found))))

    texts = [t for _, t, _ in rows[:60]] + [None, "", "Scoundrels, scoundrel!", "VERMIN_vermin", "women men", "un été " * 500]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(np.isclose(got[i], plain(t), atol=1e-6) for i, t in enumerate(texts))
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][2]) for i in range(60)]) > 0.95


def test_links_of_the_drivers_own_vectors(spark):
    """The driver's vectors hold no pair at 0.9: each third one gets a near copy, some at 0.9 or more and some below."""
    import os

    import pytest

    from marl.llm import caps

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are not there")
    own = np.array([r.embedding for r in spark.read.parquet(path).orderBy("vec_id").collect()], np.float64)
    rng = np.random.default_rng(14)
    near = own[::3] + rng.standard_normal(own[::3].shape) * rng.uniform(0.02, 0.09, (len(own[::3]), 1))
    every = np.concatenate([own, near])
    df = spark.createDataFrame(list(enumerate(every.tolist())), "vec_id long, embedding array<double>")
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.vec_id: r.n_links for r in caps.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(every))])
    assert links.sum() > 100 and (~links[len(own) :].any(axis=1)).sum() > 10
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.97 * links.sum()
