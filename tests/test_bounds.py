"""What a task holds follows from constants of the code, not from how long the rows of a batch are."""

import tracemalloc

import numpy as np
import pyarrow as pa

from marl.operators import dense, fusion, lexical, postings
from marl.shared import pieces
from marl.sources import html


def peak(run) -> float:
    """MB that Python and numpy hold at most while run() goes on."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pieces_take_all_rows_in_order():
    assert list(pieces(np.array([3, 0, 9, 1, 1, 0]), 4)) == [(0, 2), (2, 3), (3, 6)]
    assert list(pieces(np.array([], np.int64), 4)) == []
    assert list(pieces(np.array([5, 5]), 10)) == [(0, 2)]


def _texts(rows: int, words: int) -> pa.RecordBatch:
    numbers = np.random.default_rng(1).integers(0, 800, rows * words)
    terms = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * words, pa.int32()), pa.array([f"w{i}" for i in range(800)]).take(pa.array(numbers)))
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int64)), pa.array(np.arange(rows)), terms], ["corpus_id", "passage_id", "terms"])


def test_words_are_counted_in_parts(monkeypatch):
    batch = _texts(3000, 1000)
    assert peak(lambda: [None for _ in lexical._counted(iter([batch]))]) < 40
    small = _texts(50, 20)
    told = lambda: [(r["passage_id"], r["size"], sorted(zip(r["terms"], r["counts"]))) for b in lexical._counted(iter([small])) for r in b.to_pylist()]
    whole = told()
    monkeypatch.setattr(lexical, "WORDS", 30)
    assert told() == whole and len(whole) == 50


def test_passages_are_scored_in_parts(monkeypatch):
    n, each = 100, 100
    block = pa.table({"corpus_id": np.zeros(n * each, np.int64), "question_id": np.repeat(np.arange(n), each), "term": [f"w{(7 * q + 3 * t) % 800}" for q in range(n) for t in range(each)], "weight": np.linspace(0.5, 2, n * each), "mean_size": np.full(n * each, 300.0)})
    run = lexical._scored(block, 5, 6, lexical.Bm25Config(), pa.int64())
    known = list(lexical._counted(iter([_texts(1500, 500)])))
    batch = pa.Table.from_batches(known).combine_chunks().to_batches()[0]
    assert peak(lambda: list(run(iter([batch])))) < 100
    found = pa.Table.from_batches(run(iter([batch])))
    monkeypatch.setattr(lexical, "PAIRS", 1000)
    monkeypatch.setattr(lexical, "WORDS", 5000)
    assert pa.Table.from_batches(run(iter([batch]))) == found and found.num_rows == n * 5


def test_products_are_made_in_parts():
    rng = np.random.default_rng(2)
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    block = pa.table({"question_id": np.arange(1000), "corpus_id": np.zeros(1000, np.int64), "v": lists(rng.normal(size=(1000, 16)))})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(9000)), pa.array(np.zeros(9000, np.int64)), lists(rng.normal(size=(9000, 16)))], ["passage_id", "corpus_id", "v"])
    run = dense._products(block, 20, 6, pa.int64())
    assert peak(lambda: list(run(iter([batch])))) < 60


def test_pages_are_read_in_parts():
    page = f"<p>{'word ' * (html.BYTES // 20)}</p>"
    batch = pa.RecordBatch.from_arrays([pa.array([page, None] * 20), pa.array(range(40))], ["html", "page_id"])
    made = list(html._extracted(["page_id", "title", "content"], False)(iter([batch])))
    assert len(made) > 4 and pa.Table.from_batches(made)["page_id"].to_pylist() == list(range(40))
    assert peak(lambda: [None for _ in html._extracted(["page_id", "title", "content"], False)(iter([batch]))]) < 12


def test_scores_of_sources_are_rounded_as_in_sql(spark):
    """Halves are those of the product by 10,000."""
    import duckdb

    scores = [round(i / 10_000 + 0.00005, 6) for i in range(0, 120_000, 7)]
    hits = spark.createDataFrame(list(enumerate(scores)), "question_id long, score double").selectExpr("*", "1 as rank", "'' as title", "'' as url")
    found = {r.question_id: r.sources[0].score for r in fusion.sources(hits).collect()}
    told = duckdb.execute("select round_even(x, 4) from (select unnest(?::double[]) as x)", [scores]).fetchall()
    assert [found[i] for i in range(len(scores))] == [x for x, in told]


def test_blocks_give_the_best_hits_of_each_question_alone():
    """Of a block that all questions want, a task gives k hits a question, not all that score; questions that don't want it get none."""
    post = lambda ids: [{"passage_id": i, "impact": 1.0 + i % 7 / 7} for i in ids]
    lists = pa.table({"corpus_id": np.zeros(30, np.int64), "term": [f"t{i}" for i in range(30)], "posts": [post(range(i, 100)) for i in range(30)]})
    weights = pa.table({"corpus_id": np.zeros(1200, np.int64), "question_id": np.repeat(np.arange(40), 30), "term": [f"t{i}" for i in range(30)] * 40, "weight": np.linspace(1, 2, 1200)})
    pairs = pa.table({"question_id": list(range(39)), "floor": pa.array([None] * 38 + [1e9])})
    found = postings._scored(weights, 3, 6, (pa.int64(), pa.int64(), pa.float64()))((0,), lists, pairs).to_pydict()
    assert sorted(set(found["question_id"])) == list(range(38)) and len(found["score"]) < 38 * 20
    for q in (0, 37):
        score = {p: round(sum(weights["weight"][q * 30 + t].as_py() * (1 + p % 7 / 7) for t in range(30) if p >= t), 6) for p in range(100)}
        got = {p: s for i, p, s in zip(*found.values()) if i == q}
        least = sorted(score.values())[-3]
        assert got == {p: s for p, s in score.items() if s >= least}


def test_vectors_of_documents_meet_no_texts(spark):
    from marl.plans import pipeline

    chunks = spark.createDataFrame([(1, "1_0", "red apple"), (1, "1_1", "green pear"), (2, "2_0", "blue plum"), (3, "3_0", "no vector")], "doc_id long, chunk_id string, chunk_text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, "red plum", [0.0, 1.0])], "question_id long, question string, embedding array<double>")
    for strategy in ("dense", "hybrid"):
        found = pipeline.hits(asked, chunks, strategy=strategy, vectors=vectors)
        assert found.collect() == pipeline.hits(asked, chunks.join(vectors, "doc_id", "left"), strategy=strategy).collect()
    plan = pipeline.hits(asked, chunks, strategy="dense", vectors=vectors)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Project" in line or "Exchange" in line]
    assert exchanges and not any("chunk_text" in line for line in exchanges)
