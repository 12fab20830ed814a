"""The registered queries of the subpackage over the smallest driver tables: against their SQL, or against a plain version."""

import os
import shutil
import zlib
from hashlib import sha256

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from marl.llm import bpe, queries
from marl.llm.settings import vocabulary_path

from .test_similar import plain_fingerprint, roots

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(r[columns.index(c)] for c in got.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and want


def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_simhash_against_a_plain_version(spark, duck):
    docs = documents(duck)
    fps = [plain_fingerprint(t) for _, t in docs]
    at = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = {}
    for (i, _), r in zip(docs, at):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(docs, fps, at))
    got = queries.op6_simhash_near_dedup(spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and sorted(map(tuple, got.collect())) == want


def test_encoding_against_the_library(spark, duck):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(vocabulary_path()).ranks, special_tokens={})
    want = []
    for i, t in documents(duck):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op8_byte_bpe(spark, SF).collect())) == sorted(want)


@pytest.mark.parametrize("name, fold", [("op1_quality", (3, 1)), ("op7_toxicity", (5, 0))])
def test_scores_of_whole_tables(spark, duck, name, fold):
    label = name.split("_")[1].replace("toxicity", "toxic")
    rows = queries.queries()[name](spark, SF).collect()
    again = {r.doc_id: r.score for r in queries.queries()[name](spark, SF).collect()}
    told = dict(duck.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in documents(duck))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and again[r.doc_id] == r.score for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    known = [(r.predicted, told[r.doc_id]) for r in rows if not r.held_out and r.doc_id in told]
    assert sum(p == y for p, y in known) > 0.9 * len(known)


def test_labels_of_held_out_documents_change_nothing(spark, tmp_path):
    shutil.copy(f"{SF}/documents.parquet", f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, column, fold in (("op1_quality", "quality", (3, 1)), ("op7_toxicity", "toxic", (5, 0))):
        turned = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % {fold[0]} = {fold[1]}, 1 - {column}, {column}) as {column}")
        turned.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        want = {r.doc_id: r.score for r in queries.queries()[name](spark, SF).collect()}
        assert {r.doc_id: r.score for r in queries.queries()[name](spark, str(tmp_path)).collect()} == want


def test_pipeline_is_registered(spark):
    assert queries.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.run(spark, SF).count() > 0
