import base64
import random
import time
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from marl.llm import bpe
from marl.llm.text import as_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "a", " ", "  ", "\n", " \n x", "it's 'tis ''s 'RE 're'll I'd'dd don't'", "a  b   c\n\n d\t", "É é 12½ ٣٤ 中文 문자 🎉🎉 é", "x" * 700, "!?! 's 'l 'v '", " " * 50 + "q", " x   y ", "naïve 'sailor", "%'s x's's", "'", "'r", "n't 've\n've \n'll"]


def encoding(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def noise(rng):
    alphabet = ["a", "B", "é", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", " ", "1", "½", "!", "%", "中", "🎉", "s", "t", "ve", "é", "_"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))


def test_boundaries_equal_the_pattern():
    rng = random.Random(4)
    texts = TEXTS + [noise(rng) for _ in range(3000)]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    begins = np.unique(np.cumsum([0] + [len(t) for t in texts[:-1]]))
    flags = bpe.boundaries(points, begins)
    at = 0
    for t in texts:
        want = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]
        assert np.flatnonzero(flags[at : at + len(t)]).tolist() == want, repr(t)
        at += len(t)


def test_merging_equals_the_library():
    vocab = bpe.vocabulary(PATH)
    enc, rng = encoding(vocab), random.Random(9)
    for _ in range(400):
        piece = "".join(rng.choice("aeiouthrnsßéñ中") for _ in range(rng.choice([1, 2, 5, 9, 40, 600]))).encode()
        assert list(vocab.merge(piece)) == enc._core_bpe.encode_single_piece(piece)
    many = ["".join(rng.choice("aeiouthrnsßéñ中 '") for _ in range(rng.randrange(1, 15))).encode() for _ in range(3000)]
    assert [list(x) for x in vocab.merge_many(many)] == [enc._core_bpe.encode_single_piece(p) for p in many]


def test_rows(spark):
    vocab = bpe.vocabulary(PATH)
    enc, rng = encoding(vocab), random.Random(5)
    texts = [None, *TEXTS, *[noise(rng) for _ in range(50)], "long " * 30000, *TEXTS[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in as_bytes(docs).mapInArrow(bpe.encode_decode(PATH), bpe.DIGEST).collect()}
    full = {r.doc_id: r for r in as_bytes(docs).mapInArrow(bpe.encode_decode(PATH, ids=True, digest=False), bpe.TOKENS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        raw = (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest()), repr(t)
        assert got[i].decoded_sha256 == sha256(raw).hexdigest()
        assert full[i].ids == ids and vocab.decode(full[i].ids) == raw
        assert all(raw[s:].startswith(vocab.pieces[x]) for s, x in zip(full[i].starts[:200], ids))
    assert as_bytes(docs.limit(0)).mapInArrow(bpe.encode_decode(PATH), bpe.DIGEST).collect() == []


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "ab", "a", "aeiouthrnsßéñ中", "日本語中文字漢", " \n"])
def test_long_slices(alphabet):
    vocab, rng = bpe.vocabulary(PATH), random.Random(7)
    enc = encoding(vocab)
    for n in (1, 2, 3, 8, 70, 600, 3000, 3000, 3000):
        piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        assert list(vocab.merge_long(piece)) == enc._core_bpe.encode_single_piece(piece)


def test_a_slice_of_a_megabyte():
    vocab, rng = bpe.vocabulary(PATH), random.Random(8)
    vocab.pairs  # noqa: B018
    for piece in (bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=1 << 20)), b"ab" * (1 << 19)):
        began = time.perf_counter()
        found = vocab.merge_long(piece)
        assert time.perf_counter() - began < 20 and list(found) == encoding(vocab)._core_bpe.encode_single_piece(piece)


def test_pairs_that_make_a_lower_pair_wait_for_it(tmp_path):
    """A vocabulary whose longer tokens may rank below the pieces they are made of."""
    rng = random.Random(1)
    for trial in range(40):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(25)}
        listed = [bytes([i]) for i in range(256)] + rng.sample(sorted(tokens), len(tokens))
        path = tmp_path / f"{trial}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(listed)))
        vocab = bpe.Vocabulary(str(path))
        for _ in range(20):
            piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))).encode()
            assert vocab.merge_long(piece) == vocab.merge(piece)


def test_a_task_gives_back_what_its_worker_has_kept():
    import pyarrow as pa

    from marl.llm import text
    from marl.llm.settings import vocabulary_path

    row = pa.RecordBatch.from_pydict({"doc_id": [1], "t": pa.array([b"some words"], pa.binary())})
    text.PrefixHash(np.zeros(300_000, np.uint8))
    task = bpe.encode_decode(vocabulary_path())(iter([row]))
    assert text._powers
    assert next(task)["n_tokens"].to_pylist()[0] > 0
    assert not text._powers
    text.PrefixHash(np.zeros(300_000, np.uint8))
    text.give_back()
    assert not text._powers
