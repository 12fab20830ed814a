"""Literal fixtures with expected values written by hand or by a plain-Python model."""

import random
import time
import unicodedata
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from marl.functions import lexicon, text
from marl.operators import clean, dedup, dense, fusion, lexical, understand, urls
from marl.plans import pipeline
from marl.sources import html, pdf
from marl.streaming import state


def values(spark, expression, items, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]


def test_strip_and_lines_are_those_of_python(spark):
    items = ["", "  a b\t\n", " x ", "a\r\nb\x0bc d", "　"]
    assert values(spark, text.strip("x"), items) == [x.strip() for x in items]
    assert values(spark, text.lines("x"), items[3:4]) == [[s.strip() for s in items[3].splitlines()]]
    assert values(spark, text.squeeze("x"), items) == [" ".join(x.split()) for x in items]


def test_ratio_counts_code_points(spark):
    items = ["", "كتاب", "كتab", "🎉ك"]
    assert values(spark, text.script_ratio("x"), items) == [0, 1, 0.5, 0.5]
    assert values(spark, text.is_script_heavy("x", 0.5), items) == [False, True, True, True]


def test_letters_and_normal_form(spark):
    items = ["أحمد إلى آخر ٱسم", "مُؤَسَّسَة", "شيء ئ ى", "plain", unicodedata.normalize("NFD", "é أ")]
    model = lambda t: "".join(c for c in unicodedata.normalize("NFC", t).translate(str.maketrans(lexicon.LETTERS, lexicon.FOLDED_LETTERS)) if not ("ً" <= c <= "ٟ" or c == "ٰ"))
    assert values(spark, text.fold_letters(text.nfc("x")), items) == [model(t) for t in items]


def test_question_normalisation(spark):
    items = ["  الصَّفُّ الأوّل!؟ ٣ Ab-c  ", "نهـــر", None, "a_b c½"]
    assert values(spark, text.normalize_question("x"), items) == ["الصف الاول ؟ 3 ab c", "نهر", "", "a_b c½"]


def test_tokens_split_at_diacritics(spark):
    assert values(spark, text.tokens("x"), ["كِتاب Ab_1, c"]) == [["ك", "تاب", "ab_1", "c"]]


def test_sentences_and_paragraphs(spark):
    assert values(spark, text.split_sentences("x"), ["One is here. Two? no stop! كيف حالك؟ abcde. abcdef. x"]) == [["One is here.", "Two? no stop!", "كيف حالك؟", "abcde.", "abcdef."]]
    long = "w" * 50
    assert values(spark, text.split_paragraphs("x"), [f"short. {long}. {long}\n{long[:49]}"]) == [[long + ".", long]]


def test_hashes(spark):
    assert values(spark, text.document_id(F.lit("u"), "x"), ["é" * 600]) == [sha256(("u" + "é" * 500).encode()).hexdigest()]
    assert values(spark, text.pipeline_key("x"), ["", " Ab ", None]) == ["empty", sha256(b"ab").hexdigest(), "empty"]
    assert values(spark, text.analyzer_key("x"), [" Ab "]) == [md5(b"ab").hexdigest()]
    assert values(spark, text.log_line("x"), ["a\nb\t" + "c" * 400]) == ["a b " + "c" * 296]


def test_markup_noise_and_lines(spark):
    assert values(spark, text.squeeze(clean.strip_markup("x")), ["<b>a</b> http://x.y/z me@x.org [صفحة 12] b"]) == ["a b"]
    noise, _ = clean.CleanConfig().lists()
    folded = "الرئيسية".translate(str.maketrans(lexicon.LETTERS, lexicon.FOLDED_LETTERS))
    assert values(spark, clean.noise_lines_removed("x", noise), [f" {folded} \nكتاب\n\nتابعنا\nتابعنا هنا"]) == ["كتاب\nتابعنا هنا"]
    assert values(spark, clean.noise_lines_removed("x", list(lexicon.NOISE_LINES)), [f"{folded}\na"]) == [f"{folded}\na"]
    assert values(spark, clean.lines_deduplicated("x"), ["b\na \n\n b\na"]) == ["b\na"]
    assert values(spark, clean.blocks_deduplicated("x"), ["x\n\ny\n\nx\n\n\n\nz"]) == ["x\n\ny\n\nz"]


def test_cleaned_documents(spark):
    good = "درس في العلوم عن الخلية والطاقة وما يتصل بها من ظواهر كثيرة جدا"
    rows = [(1, f"<p>{good}</p>\n{good}\n{good} ثم سطر آخر طويل بما يكفي"), (2, "short"), (3, None), (4, "latin letters only " * 20)]
    got = {r.doc_id: r for r in clean.clean_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].content.count("\n") == 1 and got[1].quality == 0.3 and got[1].hash == md5(got[1].content.encode()).hexdigest()
    assert all((got[i].content, got[i].quality, got[i].hash) == ("", 0.0, None) for i in (2, 3, 4))


def test_quality_is_rounded_half_even(spark):
    word = "درس "
    assert values(spark, clean.quality_score("x"), [word * 400, "x" * 2000, ""]) == [0.7, 0.4, 0.0]


def test_chunks_cover_sentences_in_order(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(6):
        cfg = clean.ChunkConfig(rng.randrange(5, 60), rng.randrange(0, 20))
        lists = [[f"s{i}" + "x" * rng.randrange(0, 30) for i in range(rng.randrange(0, 25))] for _ in range(50)]
        rows = spark.createDataFrame([(l,) for l in lists], "s array<string>").coalesce(1).select("s", clean.packed_sentences(F.col("s"), cfg).alias("c")).collect()
        cases += [(cfg, r.s, [c.chunk_text for c in r.c]) for r in rows]
    assert len(cases) == 300
    for cfg, sentences, emitted in cases:
        at = 0
        for n, chunk in enumerate(emitted):
            own = chunk.split(" ")
            start = sentences.index(own[0])
            assert sentences[start : start + len(own)] == own
            carried = sentences[start:at]
            assert sum(map(len, carried)) <= cfg.overlap and (n == 0 or start <= at)
            if start > 0 and n:  # no longer run would have fitted, within the chunk before
                before = emitted[n - 1].split(" ")
                assert len(carried) == len(before) or sum(map(len, carried)) + len(before[-len(carried) - 1]) > cfg.overlap
            at = start + len(own)
            assert sum(map(len, own)) <= cfg.chars or len(own) == 1 or sum(map(len, own[: len(carried) + 1])) > cfg.chars
        assert at == len(sentences)


def test_chunk_rows(spark):
    body = " ".join(f"Sentence number {i} of this little text." for i in range(60))
    rows = clean.chunk_documents(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, content string"), clean.ChunkConfig(300, 80)).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == [f"1_{i}" for i in range(len(rows))] and {r.chunk_total for r in rows} == {len(rows)}
    assert all(r.characters == len(r.chunk_text) and r.chunk_text for r in rows)


def test_first_copies(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "")], "doc_id int, text string")
    assert sorted(r.doc_id for r in dedup.first_copies(rows, dedup.document_prefix(10), "doc_id").collect()) == [1, 2, 4]
    known = spark.createDataFrame([(sha256(b"b").hexdigest(),)], "fingerprint string")
    assert sorted(r.doc_id for r in dedup.not_seen(rows, dedup.document_prefix(10), known).collect()) == [1, 3, 4, 5]


def test_urls(spark):
    items = ["example.com", "HTTP://WWW.Example.COM/A?b=C#d", "  https://x.org;p ", "", None, "https://a.b:80/x;y?z"]
    assert values(spark, urls.normalize_url("x"), items) == ["https://example.com/", "http://www.example.com/A?b=C", "https://x.org;p/", "", "", "https://a.b:80/x?z"]
    cfg = urls.DomainConfig()
    hosts = ["https://moe.gov.eg/x", "https://a.ekb.eg/", "https://notekb.eg/", "https://m.facebook.com/", "https://www.wikipedia.org/", "nothing"]
    assert values(spark, urls.is_allowed("x", cfg), hosts) == [True, True, False, False, True, False]
    assert values(spark, urls.is_allowed("x", urls.DomainConfig(dot=False)), hosts) == [True, True, True, False, True, False]
    assert values(spark, urls.credibility("x", cfg), hosts) == [1.0, 0.95, 0.3, 0.3, 0.65, 0.3]
    assert values(spark, urls.priority_class("x", cfg), ["https://youm7.com", "http://x/?moe.gov.eg", "http://z"]) == [2, 0, 1]
    assert values(spark, urls.document_type(F.lit(None), "x"), ["http://a/B.PDF", "http://a/"]) == ["pdf", None]
    assert values(spark, urls.document_type("x", F.lit("http://a/")), ["text/html; charset=x", "Application/PDF", "image/png"]) == ["web", "pdf", None]


def test_fetch_list_and_robots(spark):
    rows = [(1, p, f"http://{h}/{p}") for p, h in enumerate(["youm7.com", "a.com", "ekb.eg"] * 10)]
    got = urls.fetch_list(spark.createDataFrame(rows, "query int, pos int, url string")).orderBy("rank").collect()
    assert [r.pos for r in got] == [*range(2, 30, 3), *range(1, 30, 3)]
    pages = spark.createDataFrame([("https://www.a.com/Private/x",), ("https://a.com/p",), ("https://b.com/private",), ("https://c.com",)], "url string")
    rules = spark.createDataFrame([("a.com", "/private"), ("c.com", "/"), ("b.com", "")], "host string, prefix string")
    assert sorted(r.url for r in urls.allowed_by_robots(pages, rules).collect()) == ["https://a.com/p", "https://b.com/private"]


def test_candidates(spark):
    rows = [(1, 1, 0, "ekb.eg/a"), (1, 0, 5, "https://EKB.eg/a#x"), (1, 0, 9, "https://x.com/"), (1, 2, 0, "https://moe.gov.eg"), (2, 0, 0, "https://ekb.eg/a")]
    got = urls.candidates(spark.createDataFrame(rows, "query int, search_pos int, pos int, url string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "https://ekb.eg/a"), (1, 1, "https://moe.gov.eg/"), (2, 0, "https://ekb.eg/a")]


def test_fallback_answers(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    hits = spark.createDataFrame([(1, 5), (2, 6)], "question_id int, passage_id int")
    context = spark.createDataFrame([(1, "text"), (2, "")], "question_id int, context string")
    got = {r.question_id: (r.n_hits, r.fallback) for r in pipeline.with_fallback(questions, hits, context).collect()}
    assert got == {1: (1, None), 2: (1, pipeline.NO_CONTEXT), 3: (0, pipeline.NO_EVIDENCE)}


def test_html():
    long = "A paragraph that is clearly longer than fifty characters in all."
    page = f"<html><head><title> T  t </title><meta name=Description content='about'><style>p{{}}</style></head><body><nav><p>{long}</p></nav><article><p>{long}<br>more</p><script>x</script><p>short</p></article><div>{long}</div></body></html>"
    assert html.extract(page) == ("T t", f"T t about {long} more short {long} more")
    assert html.extract(page, once=True) == ("T t", f"T t about {long} more short")
    assert html.extract(None) == ("", "") and html.extract("<p>unclosed <p>" + long)[1].count(long) == 2


def test_grades():
    found = lexicon.GRADES
    assert len(found) == 12 and sum(map(len, found.values())) == 85
    assert found["الأول الإعدادي"][:2] == ["اول اعدادي", "اول الاعدادي"] and "الثانوية العامة" in found["الثالث الثانوي"]


@pytest.fixture(scope="module")
def analyzed(spark):
    asked = [
        (1, "اشرح درس الجهاز الهضمي للصف الثاني الاعدادي"),
        (2, "ملخص علوم خامس ابتدائي ترم 1"),
        (3, "احسب قوة في مسألة فيزياء ٣ ثانوي 2025"),
        (4, ""),
        (5, "ما آخر اخبار اليوم"),
        (6, "كتب كتب قلم و في قلم كتب"),
    ]
    rows = spark.createDataFrame(asked, "question_id long, question string")
    fold = {r.question_id: r for r in understand.analyze(rows).collect()}
    plain = {r.question_id: r for r in understand.analyze(rows, understand.AnalyzerConfig(fold=False)).collect()}
    return fold, plain


def test_questions(analyzed):
    fold, plain = analyzed
    assert (fold[1].intent, fold[1].grade, fold[1].stage) == ("explanation", "الثاني الإعدادي", "preparatory")
    assert fold[1].topic.startswith("الجهاز الهضمي") and fold[1].expanded_keywords[0] == f"شرح {fold[1].topic}"
    assert (fold[2].intent, fold[2].subject, fold[2].grade, fold[2].term) == ("summary", "علوم", "الخامس الابتدائي", "الترم الأول")
    assert plain[2].grade is None and plain[2].subject == "علوم"
    assert (fold[3].intent, fold[3].subject, fold[3].year, fold[3].grade) == ("solution", "فيزياء", "2025", "الثالث الثانوي")
    assert fold[3].source_category == "curriculum" and fold[3].source_priority[0] == "moe.gov.eg"
    assert (fold[4].intent, fold[4].intent_confidence, fold[4].topic, fold[4].keywords, fold[4].confidence.total) == ("general", 0.0, None, [], 0.0)
    assert fold[5].needs_live_search and fold[5].source_category == "news"
    assert fold[6].keywords[:2] == ["كتب", "قلم"]
    assert fold[1].search_query.startswith("اشرح درس") and not fold[3].needs_live_search
    assert all(0 <= r.confidence.total <= 1 and len(r.keywords) <= 12 for r in fold.values())


def test_example_sentences_find_themselves(spark):
    rows = [(i, s) for i, s in enumerate(x for v in lexicon.INTENT_EXAMPLES.values() for x in v)]
    cfg = understand.AnalyzerConfig(clear_vote=99.0)
    questions = spark.createDataFrame(rows, "question_id long, question string").withColumn("normalized", text.normalize_question("question"))
    own = [k for k, v in lexicon.INTENT_EXAMPLES.items() for _ in v]
    questions = questions.withColumn("found", understand.patterns_of(cfg).find(F.col("normalized")))
    got = understand.similar_intent(questions.withColumn("vote", understand.best_vote(F.col("found"))), cfg).collect()
    assert len(got) == len(own) and all(abs(r.similarity - 1) < 1e-6 and r.like == own[r.question_id] for r in got)


def bm25_model(question, docs, k1=1.5, b=0.75, floor=0.25):
    import math
    import re

    split = [re.findall(r"\w+", d.lower()) for d in docs]
    n, mean = len(docs), sum(map(len, split)) / len(docs)
    df = {}
    for d in split:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    base = sum(raw.values()) / len(raw)
    idf = {t: floor * base if r < 0 else r for t, r in raw.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in re.findall(r"\w+", question.lower())) for d in split]


def test_bm25_equals_the_formula(spark, tmp_path):
    docs = ["the cat sat on the mat", "dogs and cats", "", "the the the", "a bird sat", "mat mat cat"]
    asked = ["cat mat mat", "the bird", "zebra", ""]
    indexed = lexical.index(lexical.passages(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(3), "doc_id", "text"), f"{tmp_path}/index")
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    for cfg in (lexical.Bm25Config(), lexical.Bm25Config(block=2)):
        got = {(r.question_id, r.passage_id): (r.score, r.rank) for r in lexical.search(questions, lexical.read_index(spark, f"{tmp_path}/index"), 10, None, cfg).collect()}
        for i, q in enumerate(asked):
            want = bm25_model(q, docs)
            for j, score in enumerate(want):
                assert abs(got.get((i, j), (0.0,))[0] - max(score, 0)) < 1e-9
            order = sorted((-s, j) for j, s in enumerate(want) if s > 0)
            assert [got[i, j][1] for _, j in order] == list(range(1, len(order) + 1))
    top = lexical.search(questions, indexed, 1).collect()
    assert {r.question_id for r in top} == {0, 1} and all(r.score > 0 for r in top)
    assert lexical.search(questions.limit(0), indexed, 3).collect() == [] and lexical.search(questions, indexed.limit(0), 3).collect() == []


def test_bm25_keeps_corpora_apart(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "e"]
    corpora = {c: [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))] for c in range(6)}
    rows = [(c, f"{c}-{j}", t) for c, texts in corpora.items() for j, t in enumerate(texts)]
    asked = [(f"q{c}", " ".join(rng.choice(words) for _ in range(3)), c) for c in range(7)]
    indexed = lexical.index(lexical.passages(spark.createDataFrame(rows, "c int, id string, text string").repartition(4), "id", "text", "c"))
    got = {(r.question_id, r.passage_id): r.score for r in lexical.search(spark.createDataFrame(asked, "question_id string, question string, corpus_id int"), indexed, 20, 9).collect()}
    want = {(q, f"{c}-{j}"): round(s, 9) for q, t, c in asked if c in corpora for j, s in enumerate(bm25_model(t, corpora[c])) if round(s, 9) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


@pytest.mark.parametrize("held", [dense.BLOCK_BYTES, 100])
def test_dense_search_equals_brute_force(spark, held):
    rng = random.Random(2)
    vectors = [(i, [float(rng.randrange(-4, 5)) for _ in range(6)]) for i in range(90)] + [(900, None), (901, [1.0, 2.0]), (902, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    for unit in (False, True):
        got = {}
        for r in dense.search(df.where("vec_id % 10 = 0"), df, 5, normalize=unit, block_bytes=held).collect():
            got.setdefault(r.question_id, []).append((r.rank, r.passage_id, r.score))
        length = lambda v: (sum(a * a for a in v) ** 0.5 or 1.0) if unit else 1.0  # noqa: B023, E731
        for q, v in vectors[:90:10]:
            want = sorted((-round(sum(a * b for a, b in zip(v, w)) / length(v) / length(w), 6), i) for i, w in vectors if w and len(w) == 6)[:5]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert dense.search(df.limit(0), df, 5).collect() == [] and dense.search(df, df.limit(0), 5).collect() == []


HITS = "question_id int, passage_id int, score double, rank int"


def test_fusion(spark):
    one = spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 2.0, 2), (1, 12, 0.0, 3), (2, 5, 9.0, 1)], HITS)
    two = spark.createDataFrame([(1, 11, 0.9, 1), (1, 13, 0.1, 2), (3, 8, 1.0, 1), (3, 9, 1.0, 2)], HITS)
    got = {(r.question_id, r.passage_id): (r.score, r.rank) for r in fusion.fuse(one, two).collect()}
    assert got[(1, 11)] == (0.825, 1) and got[(1, 10)] == (0.35, 2) and got[(1, 12)] == (0.0, 3) and got[(1, 13)] == (0.0, 4)
    assert got[(2, 5)] == (0.0, 1) and got[(3, 8)] == (0.0, 1) and got[(3, 9)] == (0.0, 2)
    assert fusion.fuse(one.limit(0), two.limit(0)).collect() == []


def test_context_budget_breaks_and_skips_copies(spark):
    rows = [(1, 1, "a" * 6), (1, 2, "a" * 6), (1, 3, " "), (1, 4, "b" * 5), (1, 5, "c")]
    packed = fusion.packed_hits(spark.createDataFrame(rows, "q int, rank int, t string"), "q", ["rank"], "t", 10)
    assert [r["rank"] for r in packed.collect()] == [1]
    got = fusion.contexts(fusion.packed_hits(spark.createDataFrame(rows, "q int, rank int, t string"), "q", ["rank"], "t", 12), "q", ["rank"], "t").first()
    assert (got.n_texts, got.context) == (3, "aaaaaa\n\n---\n\nbbbbb\n\n---\n\nc")


def test_blocks_citations_and_sources(spark):
    rows = [(1, 1, "u", "t", " a  b\x00 ", 0.12345), (1, 2, "u", "t", "", 0.1), (1, 3, "v", None, "c", 0.05), (1, 9, "w", "t", "late", 0.01)]
    hits = spark.createDataFrame(rows, "question_id int, rank int, url string, title string, text string, score double")
    blocks = {r["rank"]: r.block for r in fusion.numbered_blocks(hits, "question_id", "rank", "url", "title", "text").collect()}
    assert set(blocks) == {1, 3} and blocks[1] == "\n[1]\nالمصدر:\nu\nالعنوان:\nt\nالمحتوى:\na b\n"
    assert [r["rank"] for r in fusion.citations(hits, "question_id", ["rank"], "url").orderBy("rank").collect()] == [1, 3, 9]
    assert [s.score for s in fusion.sources(hits).first().sources] == [0.1234, 0.1, 0.05, 0.01]


def test_event_lines(spark):
    token = lambda t: f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}'
    lines = [token("a"), "", ": comment", "data: {broken", 'data: {"choices":[]}', token("b"), "data: [DONE]", token("late")]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, token("z"))], "stream_id int, pos int, line string")
    assert {r.stream_id: r.answer for r in state.stream_text(rows).collect()} == {1: "ab", 2: "z"}
    assert values(spark, state.answer_of("x"), ['{"choices":[{"message":{"content":" yes "}}]}', "{}", None]) == ["yes", "", ""]


def test_latest_within(spark):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00', 1), (1, timestamp'2024-01-01 10:30:00', 2), (2, timestamp'2024-01-01 09:00:00', 3) as t(k, ts, id)")
    assert [r.id for r in state.latest_within(rows, "k", "ts", "id", 3600).collect()] == [2]
    assert sorted(r.id for r in state.latest_within(rows, "k", "ts", "id", 7200, "2024-01-01 10:59:00").collect()) == [2, 3]


def test_stream_deduplication(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, cast(id % 3 as string) as fingerprint from range(30)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, fingerprint string").parquet(f"{tmp_path}/in")
    done = state.run_once(state.unseen(stream, "fingerprint", "ts", "1 hour"), f"{tmp_path}/out")
    assert sorted(r.fingerprint for r in done.collect()) == ["0", "1", "2"]


def parts_of_a_stream(spark, path, rows, schema):
    """A stream that reads one part a micro-batch, in order."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if i + 1 < len(rows) else 0)  # files are read in the order of their times
    made = spark.read.parquet(path).schema
    return spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    day = "2024-01-01"
    rows = [[(f"{day} 10:00:00", "a"), (f"{day} 10:01:00", "a")], [(f"{day} 10:30:00", "a"), (f"{day} 13:00:00", "b")], [(f"{day} 13:10:00", "b")], [(f"{day} 13:20:00", "a")]]
    stream = parts_of_a_stream(spark, f"{tmp_path}/in", rows, "ts string, fingerprint string")
    done = state.run_once(state.unseen(stream, "fingerprint", "ts", "1 hour"), f"{tmp_path}/out").collect()
    assert sorted((r.fingerprint, r.ts.hour) for r in done) == [("a", 10), ("a", 13), ("b", 13)]  # the first a had been forgotten


def test_answers_grow_with_their_streams(spark, tmp_path):
    token = lambda t: f'data: {{"choices":[{{"delta":{{"content":"{t}"}}}}]}}'
    day = "2024-01-01"
    rows = [
        [(f"{day} 10:00:00", 1, 1, token("b")), (f"{day} 10:00:00", 1, 0, token("a")), (f"{day} 10:00:00", 2, 0, token("z"))],
        [(f"{day} 10:00:05", 1, 2, token("c")), (f"{day} 10:00:05", 1, 3, "data: [DONE]"), (f"{day} 10:00:05", 1, 4, token("late")), (f"{day} 10:00:05", 2, 1, "data: {broken")],
        [(f"{day} 10:00:09", 2, 2, token("y"))],
    ]
    stream = parts_of_a_stream(spark, f"{tmp_path}/in", rows, "ts string, stream_id int, pos int, line string")
    seen = []
    query = state.growing_text(stream).writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert [(r.answer, r.done) for r in seen if r.stream_id == 1] == [("ab", False), ("abc", True)]
    assert [(r.answer, r.done) for r in seen if r.stream_id == 2] == [("z", False), ("zy", False)]


def test_first_copies_keeps_one_row_of_each(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (2, "a", "q"), (2, "b", "r"), (3, "b", "s"), (3, "c", "t"), (3, "c", "u"), (4, None, "v")], "id int, t string, _x string")
    got = sorted((r.id, r.t) for r in dedup.first_copies(rows, F.col("t"), "id").where("t is not null").collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")] and dedup.first_copies(rows, F.col("t"), "id").count() == 4
    chunks = spark.createDataFrame([(10, 2, "10_2", "x"), (9, 0, "9_0", "x"), (9, 11, "9_11", "y"), (9, 2, "9_2", "y")], "doc_id int, chunk_index int, chunk_id string, t string")
    assert {r.chunk_id for r in dedup.first_copies(chunks, F.col("t"), "doc_id", "chunk_index").collect()} == {"9_0", "9_2"}


def test_robots_files_and_waves(spark):
    files = spark.createDataFrame([("h", "Disallow: /early\nUser-agent: *\nDISALLOW: /A\ndisallow:\nuser-agent: x\ndisallow: /no"), ("g", None)], "host string, body string")
    assert [(r.host, r.prefix) for r in urls.robots_rules(files).collect()] == [("h", "/a")]
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.com/{i}") for i in range(10)], "pos int, url string")
    assert sorted((r.pos, r.wave) for r in urls.fetch_waves(pages, 2).collect()) == [(i, i // 4) for i in range(10)]


def test_pdf_pages(spark):
    files = spark.createDataFrame([(1, ["a  b", "", None, "c"], "https://moe.gov.eg/x.pdf"), (2, None, "u"), (3, [], "u")], "id int, pages array<string>, url string")
    got = {r.id: (r.content, r.document_type, r.source_score, r.content_hash is None) for r in pdf.extract_pdfs(files).collect()}
    assert got == {1: ("a b c", "pdf", 1.0, False), 2: ("", "pdf", 0.3, True), 3: ("", "pdf", 0.3, True)}


def test_whole_pipeline_finds_the_passage(spark):
    docs = [(i, " ".join(f"Filler sentence {j} of text {i} about nothing." for j in range(30))) for i in range(6)]
    docs[3] = (3, docs[3][1] + " The zebra crossed the quiet river at dawn. " + docs[3][1])
    questions = spark.createDataFrame([(1, "where did the zebra cross the river")], "question_id long, question string")
    cfg = pipeline.AnswerConfig(cleaning=clean.CleanConfig(script=text.LATIN))
    chunks = pipeline.chunk_table(spark.createDataFrame(docs, "doc_id long, text string"), cfg)
    got = pipeline.answer_context(questions, chunks, cfg).first()
    zebra = F.when(F.contains("chunk_text", F.lit("zebra")), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0)))
    seen, asked = chunks.withColumn("embedding", zebra), questions.withColumn("embedding", F.array(F.lit(2.0), F.lit(0.0)))
    for strategy in ("bm25", "dense", "hybrid"):
        best = pipeline.hits(asked, seen, cfg, strategy).where("rank = 1").join(chunks, F.col("passage_id") == F.col("chunk_id")).first()
        assert "zebra" in best.chunk_text
    with pytest.raises(ValueError):
        pipeline.hits(asked, seen, cfg, "none")
    assert "zebra" in got.context.split("\n\n---\n\n")[0] and got.n_texts <= 4 and len(got.context) <= 12_100
    sent = spark.createDataFrame([("q?", "c")], "question string, context string").select(pipeline.payload("question", "context", "s").alias("p")).first().p
    assert '"role":"user"' in sent and "q?" in sent


def test_weights_of_example_ngrams():
    import math

    assert understand.word_grams("ab") == [" a", "ab", "b ", " ab", "ab ", " ab "] and understand.word_grams("c") == [" c", "c ", " c "]
    idf, weights = understand.example_weights()
    sentences = [lexicon.fold(s) for v in lexicon.INTENT_EXAMPLES.values() for s in v]
    grams = [understand.word_grams(s) for s in sentences]
    for gram, value in idf:
        holding = sum(gram in g for g in grams)
        assert holding and math.isclose(value, math.log((1 + len(grams)) / (1 + holding)) + 1)
    by = {}
    for i, _, gram, w in weights:
        by.setdefault(i, {})[gram] = w
    known = dict(idf)
    for i, own in by.items():
        raw = {g: grams[i].count(g) * known[g] for g in set(grams[i])}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert own.keys() == raw.keys() and all(math.isclose(own[g], raw[g] / norm) for g in raw)


def test_folding_by_hand():
    assert lexicon.fold("أإآٱ ىئ ؤ ة ٣ مُـدٌ AB") == "اااا يي و ه 3 مد ab"
    assert len(lexicon.LETTERS) == len(lexicon.FOLDED_LETTERS) and len(lexicon.INDIC_DIGITS) == len(lexicon.ASCII_DIGITS) == 10


def test_one_automaton_finds_what_each_pattern_would(spark):
    rng = random.Random(3)
    tables = {"a": {"x": ["ab", "b", "abab"], "y": ["b", "bc"]}, "b": {"z": ["ab c", "ca"], "w": ["aba"]}}
    patterns = understand.plain_patterns(**tables)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randrange(12))),) for _ in range(200)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string").withColumn("found", patterns.find(F.col("t")))
    for r in df.select("t", "found", *(patterns.keys(n, F.col("found")).alias(f"k_{n}") for n in tables), patterns.first_key("a", F.col("found")).alias("first"), patterns.any("b", F.col("found")).alias("any")).collect():
        met = {n: [k for k, ways in table.items() if any(p in (r.t or "") for p in ways)] for n, table in tables.items()}
        assert (r.k_a, r.k_b, r.first, r["any"]) == (met["a"], met["b"], next(iter(met["a"]), None), bool(met["b"])), r
        assert r.found == [i for i, (_, _, p, _) in enumerate(patterns.listed) if p in (r.t or "")]
    none = understand.plain_patterns(a={})
    assert [x.found for x in spark.createDataFrame([("ab",)], "t string").select(none.find(F.col("t")).alias("found")).collect()] == [[]]
    weighed = understand.Patterns({"v": {"one": [("ab", 1.5), ("b", 2.0)], "two": [("zz", 1.0)]}})
    v = spark.createDataFrame([("abab",)], "t string").select(weighed.votes("v", weighed.find(F.col("t"))).alias("v")).first().v
    assert [(x.intent, x.at, x.score) for x in v] == [("one", 0, 3.5), ("two", -1, 0.0)]
