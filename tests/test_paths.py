"""Pages to answers, chunks, running totals, pruned searches and streams: against plain versions, with nulls and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from marl.functions import text
from marl.operators import cells, clean, dedup, dense, fusion, lexical, postings, running, urls
from marl.plans import pipeline
from marl.plans.registry import LATIN_ANSWER
from marl.shared import fresh_path, unused
from marl.streaming import state, status


def pack(sentences, chars, overlap):
    chunks, held, size = [], [], 0
    for s in sentences:
        if held and size + len(s) > chars:
            chunks.append(" ".join(held))
            n = size = 0
            while n < len(held) and size + len(held[-n - 1]) <= overlap:
                n += 1
                size += len(held[-n])
            held = held[len(held) - n :]
        held.append(s)
        size += len(s)
    return [*chunks, " ".join(held)] if held else chunks


@pytest.mark.parametrize("chars, overlap", [(750, 120), (50, 30), (20, 20), (10, 40)])
def test_chunks_equal_a_sequential_fold(spark, chars, overlap):
    r = random.Random(chars)
    rows = [(i, ["".join(r.choice("abé") for _ in range(r.choice([6, 7, 12, 30, 49, 50, 51, 200, 760]))) for _ in range(r.choice([0, 1, 2, 5, 40, 300]))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id int, s array<string>")
    got = {x.id: x.c and [(c.chunk_index, c.chunk_total, c.chunk_text) for c in x.c] for x in df.select("id", clean.packed_sentences(F.col("s"), clean.ChunkConfig(chars, overlap)).alias("c")).collect()}
    for i, s in rows:
        want = pack(s or [], chars, overlap)
        assert (got[i] or []) == [(k, len(want), t) for k, t in enumerate(want)]


def test_chunks_keep_ids_of_any_type_and_all_columns(spark):
    docs = spark.createDataFrame([("a", "First sentence. Second sentence.", "u", 7, "mine"), (None, "Third sentence.", None, 8, "m"), ("b", "", "v", 9, "n")], "doc_id string, content string, url string, corpus_id int, chunk_total string")
    found = clean.chunk_documents(docs.withColumn("_chunks", F.lit(1)).withColumn("_chunk", F.lit(2)), clean.ChunkConfig(20, 0))
    assert found.schema["doc_id"].dataType.simpleString() == "string" and "MapInArrow" not in found._jdf.queryExecution().toString()
    rows = sorted(((r.doc_id, r.chunk_id, r.chunk_index, r.chunk_total, r.chunk_text, r.url, r.corpus_id, r["_chunks"], r["_chunk"]) for r in found.collect()), key=repr)
    assert rows == sorted([("a", "a_0", 0, 2, "First sentence.", "u", 7, 1, 2), ("a", "a_1", 1, 2, "Second sentence.", "u", 7, 1, 2), (None, None, 0, 1, "Third sentence.", None, 8, 1, 2)], key=repr)


PAGE = "<html><head><title>{t}</title></head><body><article><p>{b}</p></article></body></html>"


def pages(spark, corpora=None):
    words = "river mountain kernel battery harvest orbit lantern copper violin glacier".split()
    rows = []
    for i, w in enumerate(words):
        body = " ".join(f"The {w} of the region number {k} was described by people who studied the {w} {w}a{k} {w}b{k} {w}c{k} for a long time." for k in range(8))
        rows.append((i, f"HTTPS://www.example.com/{w};x?q={i}#top", PAGE.format(t=f"On {w}", b=body)))
    rows += [(50, "https://example.com/copy", rows[0][2]), (51, "https://example.net/blocked", rows[1][2]), (52, None, rows[2][2]), (53, "https://example.org/none", None), (54, "https://example.org/short", "<p>short</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df if corpora is None else df.withColumn("corpus_id", F.col("page_id") % corpora)


def test_a_page_can_be_answered_from(spark):
    questions = spark.createDataFrame([(1, "who studied the violin"), (2, "zzz qqq"), (3, None)], "question_id long, question string")
    rows = {r.question_id: r for r in pipeline.answer_pages(questions, pages(spark).withColumn("lang", F.lit("en")), LATIN_ANSWER).collect()}
    assert set(rows) == {1, 2, 3} and "violin" in rows[1].context and rows[1].fallback is None and 1 <= rows[1].n_hits <= 4
    first = rows[1].sources[0]
    assert (first.rank, first.title, first.url, first.source, first.type) == (1, "On violin", "https://www.example.com/violin?q=8", "example.com", "web")
    assert rows[2].fallback == rows[3].fallback == pipeline.NO_EVIDENCE and rows[2].sources is None


def test_an_index_for_each_search(spark):
    questions = spark.createDataFrame([(1, "who studied the violin", 0), (2, "who studied the violin", 1)], "question_id long, question string, corpus_id long")
    rows = {r.question_id: r for r in pipeline.answer_pages(questions, pages(spark, 2), LATIN_ANSWER).collect()}
    assert "violin" in rows[1].context and "violin" not in rows[2].context
    # a page that two searches found is a document of both
    both = pages(spark).withColumn("corpus_id", F.lit(0)).union(pages(spark).withColumn("corpus_id", F.lit(1)))
    assert sorted(map(tuple, pipeline.ingest_pages(both, LATIN_ANSWER).groupBy("corpus_id").count().collect())) == [(0, 10), (1, 10)]


def test_counters_are_those_of_the_run(spark):
    counters = pipeline.Counters()
    assert pipeline.ingest_pages(pages(spark), LATIN_ANSWER, counters).count() == 10
    told = counters.counts()
    assert {k: told[k] for k in ("pages", "without_url", "allowed", "empty", "valid", "documents")} == {"pages": 15, "without_url": 1, "allowed": 13, "empty": 2, "valid": 11, "documents": 10}


def test_searches_leave_out_what_has_no_id_or_corpus(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 1), (2, "alpha", None), (None, "alpha", 1), (3, None, 1), (4, "gamma delta", 1), (5, "delta", 1)], "id long, t string, c long")
    asked = spark.createDataFrame([(1, "alpha", 1), (None, "alpha", 1), (2, "alpha", None), (3, None, 1)], "question_id long, question string, corpus_id long")
    passages = lexical.passages(docs, "id", "t", "c")
    want = [(1, 1)]
    assert [(r.question_id, r.passage_id) for r in lexical.search(asked, lexical.index(passages), 3).collect()] == want
    assert [(r.question_id, r.passage_id) for r in postings.search(asked, postings.build(passages), 3).hits.collect()] == want
    named = docs.withColumn("c", F.concat(F.lit("c"), "c")), asked.withColumn("corpus_id", F.concat(F.lit("c"), "corpus_id"))
    assert [(r.question_id, r.passage_id) for r in lexical.search(named[1], lexical.index(lexical.passages(named[0], "id", "t", "c")), 3).collect()] == want
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, None]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.0, 0.0])], "vec_id long, embedding array<double>")
    want = [(1, 1, 1.0), (1, 7, 0.0), (7, 1, 0.0), (7, 7, 0.0)]
    two = vectors.where("vec_id in (1, 2, 3, 4, 5, 7)")
    assert sorted((r.question_id, r.passage_id, r.score) for r in dense.search(two, vectors, 5).collect()) == want
    assert sorted((r.question_id, r.passage_id, r.score) for r in cells.search(two, cells.build(vectors), 5).hits.collect()) == want
    empty = vectors.limit(0)
    assert cells.search(two, cells.build(empty), 5).hits.collect() == [] and dense.search(empty, vectors, 5).collect() == []


def test_blocks_of_questions_change_nothing(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=12))) for i in range(80)], "id long, t string")
    asked = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(30)], "question_id long, question string")
    known = lexical.index(lexical.passages(docs, "id", "t"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, parts = lexical.search(asked, known, 5), lexical.search(asked, known, 5, cfg=lexical.Bm25Config(block=30))
    assert rows(whole) == rows(parts) and len(rows(whole)) == 150
    # the plan holds no block: what each one found is read from where it was written
    assert "MapInArrow" not in parts._jdf.queryExecution().analyzed().toString()


def test_pruned_searches_skip_blocks_and_lose_nothing(spark):
    r = random.Random(6)
    common = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(common, k=30) + ([f"rare{i % 40}"] * (1 + i % 3) if i % 5 == 0 else []))) for i in range(1200)]
    passages = lexical.passages(spark.createDataFrame(docs, "id long, t string"), "id", "t")
    asked = spark.createDataFrame([(i, f"rare{i} w1 w2") for i in range(0, 40, 5)] + [(99, "w3 w4"), (100, "nothing")], "question_id long, question string")
    found = postings.search(asked, postings.build(passages, block_rows=16), 3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found.hits) == rows(lexical.search(asked, lexical.index(passages), 3))
    skipped, n = found.skipped()
    assert skipped > n / 4, (skipped, n)
    vectors = [(i, [r.gauss(10 * (i % 12 == k), 0.3) for k in range(12)]) for i in range(2400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    path = fresh_path(spark, "kept")
    cells.build(df, path=path, each=100)
    found = cells.search(df.where("vec_id % 100 = 0"), cells.read(spark, path), 5)
    assert rows(found.hits) == rows(dense.search(df.where("vec_id % 100 = 0"), df, 5))
    skipped, n = found.skipped()
    assert skipped > n / 2, (skipped, n)


def test_running_totals_of_a_hot_group(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, r.randrange(5)) for i in r.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("_part", F.lit("x"))
    got = {(x.g, x.i): (x.total, x["_part"]) for x in running.running_totals(df, ["g"], ["i"], {"total": F.col("v")}, each=100).collect()}
    for g in ("hot", "a", None):
        total = 0
        for _, i, v in sorted(x for x in rows if x[0] == g):
            total += v
            assert got[g, i] == (total, "x")
    assert len(got) == 900 and running.running_totals(df.limit(0), ["g"], ["i"], {"total": F.col("v")}).collect() == []
    pages_ = spark.createDataFrame([(i, f"https://{'big' if i % 10 else 'small'}.com/{i}") for i in range(300)], "pos long, url string")
    waves = urls.fetch_waves(pages_, each=20).groupBy("host").agg(F.max("wave").alias("w"), F.count("*").alias("n")).collect()
    assert sorted((x.host, x.w, x.n) for x in waves) == [("big.com", 33, 270), ("small.com", 3, 30)]


def test_packed_groups_equal_packed_hits(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice(["", " ", None, "same", "x" * r.randrange(1, 40)])) for i in range(400)]
    df = spark.createDataFrame(rows, "q long, i long, t string").withColumns({"total": F.lit(1), "_digest": F.lit(2), "_copy": F.lit(3)})
    rows_of = lambda d: sorted(map(repr, d.collect()))
    one, two = fusion.packed_hits(df, "q", ["i"], "t", 300), fusion.packed_groups(df, "q", ["i"], "t", 300, each=20)
    assert rows_of(one) == rows_of(two.select(*one.columns)) and one.columns == df.columns and one.count() > 20


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8)], "id long, t string, _n int, _fp int").withColumns({"_place": F.lit(1), "_fingerprint": F.lit(2)})
    assert [tuple(r) for r in dedup.first_copies(df, text.md5_text("t"), "id").collect()] == [(1, "a", 5, 6, 1, 2)]
    known = df.where("id = 9").select(F.lit("x").alias("fingerprint"))
    assert dedup.not_seen(df, text.md5_text("t"), known).columns == df.columns
    hits = df.select(F.lit(1).alias("question_id"), F.col("id").alias("passage_id"), F.lit(0.5).alias("score"), F.col("id").alias("rank"), "t", "_n", "_place", F.lit("u").alias("url"))
    assert [r["_n"] for r in fusion.citations(hits, "question_id", ["rank"], "url").collect()] == [5]
    assert set(fusion.rerank(hits, F.lit(1.0)).columns) == set(hits.columns)
    assert unused(df, "N") == "_N_"


def test_robots_of_a_host_with_many_rules(spark):
    rules = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "big.com").otherwise(F.concat(F.lit("h"), F.col("id") % 50, F.lit(".com"))).alias("host"), F.concat(F.lit("/Dir"), "id").alias("prefix"))
    rules = rules.union(spark.createDataFrame([("all.com", "/"), ("big.com", ""), (None, "/x"), ("big.com", "/dir7")], "host string, prefix string"))
    rows = [(1, "https://big.com/dir4/x"), (2, "https://big.com/dir2"), (3, "https://big.com/dir7777"), (4, "https://all.com"), (5, "https://none.com/dir4"), (6, None), (7, "https://BIG.com/DIR4")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("mine"), "_host": F.lit(1), "_path": F.lit(2)})
    found = urls.allowed_by_robots(df, rules)
    assert sorted(r.page_id for r in found.collect()) == [2, 5, 6] and found.columns == df.columns
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_values_live_and_expire(spark):
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00+00:00"
    rows = [("a", at(0)), ("a", at(1)), ("a", at(5)), ("b", at(0)), ("b", at(30)), ("c", at(70)), (None, at(3)), ("d", None)]
    df = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    stream = state.replay(df, "ts", "6 hours", fresh_path(spark, "replay"))
    told = state.run_once(state.lives(stream, "k", "ts", 7200, "1 hour"), fresh_path(spark, "stream"))
    hour = lambda ms: ms // 3_600_000 - 19723 * 24
    got = sorted((r.k, hour(r.at_ms), r.what) for r in told.collect())
    assert got == sorted([("a", 0, "miss"), ("a", 1, "hit"), ("a", 1, "expired"), ("a", 5, "miss"), ("a", 5, "expired"), ("b", 0, "miss"), ("b", 0, "expired"), ("b", 30, "miss"), ("b", 30, "expired"), ("c", 70, "miss")])


def test_what_a_stream_tells_of_itself(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 {i:02d}:30:00") for i in range(6)], "k long, ts string").withColumn("ts", F.to_timestamp("ts"))
    stream = state.replay(df, "ts", "2 hours", fresh_path(spark, "replay"))
    heard = []
    found, told = status.watched(spark, lambda: state.run_once(state.unseen(stream, "k", "ts", "1 hour"), fresh_path(spark, "stream"), "told_of"))
    rows = [r for r in told.rows if told.rows[0][1] == r[1]]
    assert rows[0][0] == "start" and rows[-1][0] == "end" and rows[-1][7] is None and {r[2] for r in rows} == {"told_of"}
    progress = [r for r in rows if r[0] == "progress"]
    assert len(progress) >= 3 and sum(r[4] for r in progress) == 6 and max(r[5] for r in progress) >= 1 and any(r[6] and r[6] > "2024" for r in progress)
    assert told.table(spark).where("event = 'progress'").count() == len(progress) and found.count() == 6
    status.Status(2, heard.append)._add("start", "x", None, None, None, None, None, None)
    assert heard
