"""Question analysis: one chain of expressions gives every question its intent, subject, level, topic, keywords, search
strings and confidence. All patterns of all dictionaries are looked for by one automaton in one pass of a question; the
comparison with example sentences is the only join, with a fixed table of their n-grams."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..shared import unused


@dataclass(frozen=True)
class AnalyzerConfig:
    """fold: fold the patterns of the dictionaries as questions are folded; without it, those with folded letters never match."""

    keywords: int = 12
    topic_words: int = 6
    word_chars: int = 2
    expanded: int = 8
    clear_vote: float = 1.5
    similar: float = 0.35
    fold: bool = True

    def of(self, patterns: dict) -> dict:
        return lexicon.folded(patterns) if self.fold else patterns

    def words(self, words: list[str]) -> list[str]:
        return list(dict.fromkeys([*words, *map(lexicon.fold, words)])) if self.fold else words


@functools.cache
def _automaton(patterns: tuple[str, ...]):
    """An automaton that tells the places of all patterns that end at a letter; a pattern may be listed several times. Made once by a worker."""
    from ahocorasick import Automaton

    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        places.setdefault(p, []).append(i)
    found = Automaton()
    for p, own in places.items():
        found.add_word(p, own)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Patterns:
    """The patterns of several dictionaries one after the other: of each dictionary its keys, and of each pattern the place of its key and its
    weight. What is found in a text is the ascending list of patterns that occur in it."""

    tables: dict[str, dict[str, list[tuple[str, float]]]]

    @functools.cached_property
    def listed(self) -> list[tuple[str, int, str, float]]:
        """(dictionary, place of the key, pattern, weight) by number."""
        return [(name, k, p, w) for name, table in self.tables.items() for k, ways in enumerate(table.values()) for p, w in ways]

    def find(self, c: Column) -> Column:
        """array<int>: the numbers of all patterns that a text contains."""
        patterns = tuple(p for _, _, p, _ in self.listed)

        @F.pandas_udf("array<int>")
        def numbers(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            met = _automaton(patterns) if patterns else None
            for batch in texts:
                yield pd.Series([[] if t is None or met is None else sorted({n for _, own in met.iter(t) for n in own}) for t in batch], dtype=object)

        return numbers(c)

    def of(self, name: str, found: Column) -> Column:
        """What was found of one dictionary."""
        own = [i for i, x in enumerate(self.listed) if x[0] == name]
        return F.filter(found, lambda n: (n >= own[0]) & (n <= own[-1])) if own else F.array().cast("array<int>")

    def keys(self, name: str, found: Column) -> Column:
        """The keys of one dictionary of which a pattern was found, in its order."""
        place, names = F.lit([k for _, k, _, _ in self.listed]), F.lit(list(self.tables[name]))
        return F.transform(F.array_distinct(F.transform(self.of(name, found), lambda n: F.get(place, n))), lambda k: F.get(names, k))

    def first_key(self, name: str, found: Column) -> Column:
        return F.get(self.keys(name, found), F.lit(0))

    def any(self, name: str, found: Column) -> Column:
        return F.size(self.of(name, found)) > 0

    def votes(self, name: str, found: Column) -> Column:
        """array<struct<score, at, intent>>: what the patterns of each key add up to; at counts down."""
        place, weight = F.lit([k for _, k, _, _ in self.listed]), F.lit([float(w) for _, _, _, w in self.listed])
        keys = F.array(*[F.struct(F.lit(-k).alias("at"), F.lit(x).alias("intent")) for k, x in enumerate(self.tables[name])])

        def vote(own: Column, e: Column) -> Column:
            total = F.aggregate(F.filter(own, lambda n: F.get(place, n) == -e["at"]), F.lit(0.0), lambda acc, n: acc + F.get(weight, n))
            return F.struct(total.alias("score"), e["at"].alias("at"), e["intent"].alias("intent"))

        return text.let(self.of(name, found), lambda own: F.transform(keys, lambda e: vote(own, e)))


def plain_patterns(**tables: dict[str, list[str]]) -> Patterns:
    """Dictionaries of patterns without weights, as they are."""
    return Patterns({name: {k: [(p, 1.0) for p in dict.fromkeys(v)] for k, v in table.items()} for name, table in tables.items()})


@functools.cache
def patterns_of(cfg: AnalyzerConfig = AnalyzerConfig()) -> Patterns:
    """All dictionaries that questions are analysed by."""
    plain = plain_patterns(
        subject=cfg.of(lexicon.SUBJECTS), stage=cfg.of(lexicon.STAGES), grade=cfg.of(lexicon.GRADES), term=cfg.of(lexicon.TERMS), live={"live": cfg.words(lexicon.LIVE_SIGNALS)}
    )
    return Patterns({"intent": cfg.of(lexicon.INTENTS), **plain.tables})


def best_vote(found: Column, cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """struct<score, at, intent>: the highest vote, the first intent of equals."""
    return F.array_max(patterns_of(cfg).votes("intent", found))


def word_grams(sentence: str, low: int = 2, high: int = 4) -> list[str]:
    """Character n-grams within words padded by blanks; a padded word shorter than n is its own n-gram once."""
    found = []
    for word in sentence.split():
        padded = f" {word} "
        for n in range(low, high + 1):
            found += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
            if len(padded) <= n:
                break
    return found


def example_weights() -> tuple[list[tuple[str, float]], list[tuple[int, str, str, float]]]:
    """(gram, idf) and (example, intent, gram, unit weight) of the example sentences: smoothed idf, unit length."""
    examples = [(intent, Counter(word_grams(_question(s)))) for intent, sentences in lexicon.INTENT_EXAMPLES.items() for s in sentences]
    df = Counter(g for _, c in examples for g in c)
    idf = {g: math.log((1 + len(examples)) / (1 + n)) + 1 for g, n in df.items()}
    rows = []
    for i, (intent, counts) in enumerate(examples):
        norm = math.sqrt(sum((n * idf[g]) ** 2 for g, n in counts.items()))
        rows += [(i, intent, g, n * idf[g] / norm) for g, n in sorted(counts.items())]
    return sorted(idf.items()), rows


def _question(sentence: str) -> str:
    """What normalize_question makes of the example sentences, which hold letters and blanks only."""
    return " ".join(lexicon.fold(sentence).split())


def similar_intent(questions: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """(question_id, like, similarity): the intent of the most similar example sentence, for questions without a clear vote (vote.score).

    Two small tables are broadcast: the n-grams of the fixed example sentences with their idf, and with their unit weights."""
    spark = questions.sparkSession
    idf, weights = example_weights()
    known = F.broadcast(spark.createDataFrame(idf, "gram string, idf double"))
    examples = F.broadcast(spark.createDataFrame(weights, "example int, like string, gram string, w double"))
    padded = F.transform(F.filter(F.split("normalized", " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        # a padded word has three letters at least; one shorter than n + 1 has no n-grams beyond the first n that covers it
        sizes = F.filter(F.lit([2, 3, 4]), lambda n: (n == 2) | (F.length(w) >= n))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    unclear = questions.where(F.col("vote.score") < cfg.clear_vote).select("question_id", F.explode(F.flatten(F.transform(padded, grams))).alias("gram"))
    # n-grams that no example has weigh nothing: they go before anything is exchanged
    own = unclear.join(known, "gram").groupBy("question_id", "gram").agg((F.count("*") * F.first("idf")).alias("w0"))
    listed = own.groupBy("question_id").agg(F.sqrt(F.sum(F.col("w0") * F.col("w0"))).alias("norm"), F.collect_list(F.struct("gram", "w0")).alias("l"))
    parts = listed.select("question_id", "norm", F.explode("l").alias("g")).select("question_id", "norm", "g.gram", "g.w0").join(examples, "gram")
    cosine = parts.groupBy("question_id", "norm", "example", "like").agg(F.sum(F.col("w0") * F.col("w")).alias("dot"))
    best = F.max(F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("similarity"), (-F.col("example")).alias("at"), "like"))
    return cosine.groupBy("question_id").agg(best.alias("b")).select("question_id", F.col("b.like").alias("like"), F.col("b.similarity").alias("similarity"))


def detect_intent(questions: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig(), met: str = "found") -> DataFrame:
    """questions (question_id, normalized, ...) with intent and intent_confidence; met: the column of what patterns_of(cfg).find() found."""
    # one exchange, by which all that follows is grouped and joined; a stated number of tasks, as questions are small and their work isn't
    tasks = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    voted = questions.repartition(tasks, "question_id").withColumn("vote", best_vote(F.col(met), cfg))
    joined = voted.join(similar_intent(voted, cfg), "question_id", "left")
    vote, intent = F.col("vote.score"), F.col("vote.intent")
    by_vote = text.two_places(F.least(vote / 4.0, F.lit(1.0)))
    close = F.col("similarity") >= cfg.similar
    return (
        joined.withColumn("intent", F.when(vote >= cfg.clear_vote, intent).when(close, F.col("like")).when(vote > 0, intent).otherwise("general"))
        .withColumn("intent_confidence", F.when(vote >= cfg.clear_vote, by_vote).when(close, text.two_places(F.col("similarity"))).when(vote > 0, by_vote).otherwise(0.0))
        .drop("vote", "like", "similarity")
    )


def topic(c: Column, found: Column, cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """The first words left after grade names and function words are taken out; null if there are none. Names are taken out one after the
    other, since one that is gone can bring another about; where none stands at the beginning, none ever will."""
    names = F.lit([p for v in cfg.of(lexicon.GRADES).values() for p in v])
    stop = cfg.words(lexicon.TOPIC_STOP_WORDS)
    bare = F.when(patterns_of(cfg).any("grade", found), F.aggregate(names, c, lambda acc, p: F.replace(acc, p, F.lit("")))).otherwise(c)
    words = F.filter(F.split(bare, f"[{text.SPACE}]+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return text.let(words, lambda l: F.when(F.size(l) > 0, F.array_join(F.slice(l, 1, cfg.topic_words), " ")))


def keywords(c: Column, cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """The most frequent words that are not stop words; of equals the one that comes first."""
    stop = cfg.words(lexicon.STOP_WORDS)

    def counted(words: Column) -> Column:
        each = F.transform(
            F.array_distinct(words),
            lambda w, i: F.struct((F.size(F.filter(words, lambda x: x != w)) - F.size(words)).alias("n"), i.alias("at"), w.alias("w")),
        )
        return F.transform(F.slice(F.array_sort(each), 1, cfg.keywords), lambda x: x["w"])

    return text.let(F.filter(F.split(c, " "), lambda w: (F.length(w) >= cfg.word_chars) & ~w.isin(stop)), counted)


def year(c: Column) -> Column:
    found = F.regexp_extract(c, "20[0-9]{2}", 0)
    return F.when(found != "", found)


def source_category(grade: Column, stage: Column, term: Column, intent: Column, subject: Column) -> Column:
    return F.when(grade.isNotNull() | stage.isNotNull() | term.isNotNull() | (intent == "curriculum"), "curriculum").when(intent == "news", "news").when(subject.isNotNull(), "education").otherwise("general")


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*[x.cast("string") for x in items]))


def _by_key(key: Column, table: dict[str, list[str]]) -> Column:
    found = F.array().cast("array<string>")
    for k, v in table.items():
        if v:
            found = F.when(key == k, F.array(*map(F.lit, v))).otherwise(found)
    return found


def expansions(cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    t, s, g, i = (F.col(x) for x in ("topic", "subject", "grade", "intent"))
    with_topic = F.array(t)
    for intent, words in lexicon.EXPANSIONS.items():
        with_topic = F.when(i == intent, F.array(*[F.concat(F.lit(f"{w} "), t) for w in words])).otherwise(with_topic)
    own = F.when(t.isNotNull(), with_topic).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(own, _strings(s, F.concat(s, F.lit(" "), g))), 1, cfg.expanded)


def rewritten() -> Column:
    t, s, g, st, i, y, tm = (F.col(x) for x in ("topic", "subject", "grade", "stage", "intent", "year", "term"))
    lead = lambda intent: F.concat(F.lit(f"{lexicon.REWRITES[intent]} "), t)
    own = (
        F.when(i.isin("explanation", "summary"), _strings(lead("explanation"), s))
        .when(i == "solution", _strings(lead("solution")))
        .when(i == "definition", _strings(lead("definition")))
        .when(i == "comparison", _strings(lead("comparison"), s))
        .when(i == "exam", _strings(s, F.coalesce(g, st), F.lit(lexicon.EXAM_PHRASE), F.coalesce(y, F.lit(lexicon.EXAM_YEAR))))
        .otherwise(F.array().cast("array<string>"))
    )
    more = lambda parts: F.filter(F.slice("expanded_keywords", 1, 4), lambda k: ~F.array_contains(parts, k))
    whole = text.let(own, lambda parts: F.array_join(F.concat(parts, more(parts), _strings(g, tm)), " "))
    return F.coalesce(F.nullif(whole, F.lit("")), F.col("search_query"))


def confidence(cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """struct of the parts and their sum, at most 1, to two places."""
    part = lambda name, share: F.when(F.col(name).isNotNull(), share).otherwise(0.0)
    parts = {
        "subject_score": part("subject", 0.25),
        "grade_score": part("grade", 0.20),
        "stage_score": part("stage", 0.10),
        "topic_score": part("topic", 0.20),
        "intent_score": F.least(F.col("intent_confidence") * 0.15, F.lit(0.15)),
        "keyword_score": F.least(F.size("keywords") / float(cfg.keywords) * 0.10, F.lit(0.10)),
    }
    total = sum(parts.values(), F.lit(0.0))
    exact = text.two_places(F.least(total, F.lit(1.0)))
    return F.struct(*[v.alias(k) for k, v in parts.items()], exact.alias("total"))


def analyze(questions: DataFrame, cfg: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """questions (question_id, question) with all that is known of them."""
    patterns, name = patterns_of(cfg), unused(questions, "met")
    n, met = F.col("normalized"), F.col(name)
    found = detect_intent(questions.withColumn("normalized", text.normalize_question("question")).withColumn(name, patterns.find(n)), cfg, name)
    found = (
        found.withColumns({c: patterns.first_key(c, met) for c in ("subject", "stage", "grade", "term")})
        .withColumn("needs_live_search", patterns.any("live", met))
        .withColumn("year", year(n))
        .withColumn("topic", topic(n, met, cfg))
        .drop(name)
        .withColumn("keywords", F.slice(F.array_distinct(F.concat(keywords(n, cfg), _strings(F.col("subject"), F.col("grade"), F.col("topic")))), 1, cfg.keywords))
        .withColumn("expanded_keywords", expansions(cfg))
        .withColumn("source_category", source_category(*(F.col(c) for c in ("grade", "stage", "term", "intent", "subject"))))
        .withColumn("source_priority", _by_key(F.col("source_category"), lexicon.SOURCES))
    )
    parts = F.concat(_strings(*(F.col(c) for c in ("question", "topic", "subject", "grade", "term", "year"))), _by_key(F.col("source_category"), lexicon.SUFFIXES))
    found = found.withColumn("search_query", F.array_join(F.array_distinct(parts), " ")).withColumn("rewritten_query", rewritten())
    return found.withColumn("confidence", confidence(cfg))


def metadata(analyzed: DataFrame) -> DataFrame:
    """The twelve fields of an analysis that callers of a pipeline see."""
    return analyzed.select(
        "question_id", F.col("question").alias("query"), "normalized", "intent", "subject", "stage", "grade", "topic", "keywords", "search_query", "source_category",
        F.col("needs_live_search").alias("live_search"), F.col("confidence.total").alias("confidence"),
    )


def answer_style(intent: Column) -> Column:
    found = F.lit("general")
    for k, v in lexicon.STYLES.items():
        found = F.when(intent == k, v).otherwise(found)
    return found


def search_strings(analyzed: DataFrame) -> DataFrame:
    """(question_id, pos, search): all strings to search for, in order, each once."""
    q, t, s, g = (F.col(c) for c in ("search_query", "topic", "subject", "grade"))
    with_topic = [F.concat(t, F.lit(f" {x}")) for x in lexicon.TOPIC_SEARCHES]
    more = [F.concat(s, F.lit(" "), t, F.lit(f" {lexicon.SUBJECT_TOPIC_SEARCH}")), F.concat(s, F.lit(" "), g, F.lit(f" {lexicon.SUBJECT_GRADE_SEARCH}"))]
    by_keyword = F.transform("keywords", lambda k: F.concat(k, F.lit(f" {lexicon.KEYWORD_SEARCH}")))
    first = F.filter(F.transform(F.concat(_strings(q, *with_topic, *more), by_keyword), text.strip), lambda x: x != "")
    last = F.array(*[F.concat(q, F.lit(f" {x}")) for x in lexicon.QUERY_SEARCHES])
    return analyzed.select("question_id", F.posexplode(F.array_distinct(F.concat(first, last))).alias("pos", "search"))


def engine_queries(strings: DataFrame) -> DataFrame:
    """What goes to the search engine for each string."""
    return strings.withColumn("search", F.concat("search", F.lit(f" {lexicon.SEARCH_SUFFIX}")))


def paragraph_relevance(paragraph: Column, topic_: Column, subject: Column, grade: Column, words: Column) -> Column:
    p = F.lower(paragraph)
    part = lambda c, share: F.when(c.isNotNull() & (c != "") & F.contains(p, F.lower(c)), share).otherwise(0.0)
    hits = F.size(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda k: F.contains(p, F.lower(k))))
    return F.least(part(topic_, 0.40) + part(subject, 0.20) + part(grade, 0.20) + F.least(hits * 0.05, F.lit(0.20)), F.lit(1.0))


def _ranked_paragraphs(documents: DataFrame, metas: DataFrame, on: str, key: str, column: str, k: int, empty: bool) -> DataFrame:
    each = (F.posexplode_outer if empty else F.posexplode)(F.col("_p")).alias("pos", "paragraph")
    split = documents.select(key, on, text.split_paragraphs(column).alias("_p")).withColumn("paragraph_count", F.size("_p"))
    rows = split.select(key, on, "paragraph_count", each).join(metas, on)
    relevance = F.round(paragraph_relevance(F.col("paragraph"), F.col("topic"), F.col("subject"), F.col("grade"), F.col("keywords")), 6)
    rows = rows.withColumn("relevance", F.when(F.col("paragraph").isNull(), 0.0).otherwise(relevance))
    order = Window.partitionBy(key, "query_id").orderBy(F.desc("relevance"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_paragraphs(documents: DataFrame, metas: DataFrame, on: str, key: str = "doc_id", column: str = "text", k: int = 25) -> DataFrame:
    """(key, query_id, pos, relevance, paragraph, rank): the k most relevant paragraphs of each document for each question it is
    paired with by `on`; ties in the order of the document."""
    return _ranked_paragraphs(documents, metas, on, key, column, k, False).select(key, "query_id", "pos", "relevance", "paragraph", "rank")


def ranked_content(documents: DataFrame, metas: DataFrame, on: str, key: str = "doc_id", column: str = "text", k: int = 25) -> DataFrame:
    """(key, query_id, content, paragraph_count, selected_paragraphs, top_relevance): each document cut down to its k most relevant
    paragraphs, in order of relevance. A document without paragraphs is empty, with relevance 0."""
    rows = _ranked_paragraphs(documents, metas, on, key, column, k, True)
    listed = F.array_sort(F.collect_list(F.when(F.col("paragraph").isNotNull(), F.struct("rank", "paragraph"))))
    found = rows.groupBy(key, "query_id").agg(listed.alias("_l"), F.max("paragraph_count").alias("paragraph_count"), F.max("relevance").alias("top_relevance"))
    content = F.array_join(F.transform("_l", lambda x: x["paragraph"]), "\n\n")
    return found.select(key, "query_id", content.alias("content"), "paragraph_count", F.size("_l").alias("selected_paragraphs"), "top_relevance")
