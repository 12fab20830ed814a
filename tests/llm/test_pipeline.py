import os
import random
import re
from hashlib import sha256

import public_tokenizers
import tiktoken

import corpus_pipeline
from marl.llm import bpe
from marl.llm.settings import vocabulary_path
from marl.shared import folder

from .test_repeats import brute
from .test_similar import plain_fingerprint, roots


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, items):
    words = words_of(text)
    hit = [False] * len(words)
    for item in items:
        own = words_of(item)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    return any(hit) and 20 * sum(hit) >= len(words)


def test_against_plain_versions(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [a + b for a in ("ka", "ro", "té", "mi", "su", "nd") for b in ("", "la", "ter", "ing", "on", "x", "ssa")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, items = prose(70), [prose(20), prose(6), prose(40), ""]
    texts = [prose(rng.randrange(20, 200)) for _ in range(60)]
    texts += [texts[0], texts[1] + " end", prose(30) + "\n" + passage + " " + prose(30), prose(50) + " " + passage, prose(10) + " " + items[0], prose(300) + " " + items[2], items[1], prose(2000) + " " + items[0]]
    bad = set(range(70, 110))
    texts += [prose(5)] * (70 - len(texts))
    texts += [prose(20) + " nasty scoundrel " + prose(9) for _ in bad]
    texts += [None, "", "  \n ", prose(12000)]
    rows = list(enumerate(texts))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    labels = [(i, 1, int(i in bad)) for i in range(110)]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    kept = [(i, t) for i, t in rows if i not in bad]
    fps = [plain_fingerprint(t) for _, t in kept]
    group = roots(len(kept), [(a, b) for a in range(len(kept)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    kept = [r for k, r in enumerate(kept) if group[k] == k]
    split, flags = brute(kept, 50, lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    kept = [(i, " ".join(w for w, f in zip(u, fl) if not f) if any(fl) else t) for (i, t), u, fl in zip(kept, split, flags)]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(vocabulary_path()).ranks, special_tokens={})
    want = [(i, enc.encode_ordinary(t or ""), sha256((t or "").encode()).hexdigest()) for i, t in kept]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in got) == sorted(want)
    assert any(any(f) for f in flags) and len(want) < len(rows) - len(bad)


def test_stages_keep_columns(spark, tmp_path):
    names = "fp long, gid int, _id long, _key int, key string, part int, w string, h long, own int, copy int, gone_doc_id int, _place int, score double, score_ double"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    more = [None] * len(names.split(", "))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a b", None, "s", 3, 4, 5, *more[2:]), (2, None, "en", None, None, 1, 2, *more[2:]), (None, "c d e", "en", None, 5, 1, 2, *more[2:]), (None, None, None, None, None, *more)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert (out.columns, out.count()) == (docs.columns, 4), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


def test_folders_of_earlier_stages_are_removed(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = folder(spark).removeprefix("file://")
    stages = [n for n, _ in corpus_pipeline.STAGES]
    before = {x for x in os.listdir(shared) if x.split("-")[0] in stages}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    left = {x for x in os.listdir(shared) if x.split("-")[0] in stages} - before
    assert [x.split("-")[0] for x in left] == ["benchmark_decontamination"]
