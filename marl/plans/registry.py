"""Registered queries of the library over the driver's tables, and their SQL twins.

The documents hold no Arabic text, so cleaning runs twice: over the documents with Latin letters as the script, and over
their transliteration with the default script. Questions are the user turns of all conversations and a few Arabic ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells, clean, dedup, dense, fusion, lexical, postings, understand, urls
from ..sources import html, pdf
from ..streaming import state
from . import pipeline, twins
from ..shared import cut, fresh_path, spread

LATIN_CLEAN = clean.CleanConfig(script=text.LATIN, noise=("as.", "von.", "les.", "es.", "of."), education=("the ", "and ", " que ", " des ", " und "), fold=False)
LATIN_ANSWER = pipeline.AnswerConfig(cleaning=LATIN_CLEAN, domains=urls.DomainConfig(credibility=(("example.com", 0.9), ("example.org", 0.6)), blocked=("example.net",), first=("example.org",), last=("example.net",)))
DOMAINS = LATIN_ANSWER.domains
TRANSLITERATION = ("abcdefghijklmnopqrstuvwxyzéèêàüöäßñíóçôâû", "ابتثجحخدذرزسشصضطظعغفقكلمنهأإآىؤئةٱوىؤئةآإ")
QUESTIONS = [
    (-1, "اشرح لي درس التفاعل الكيميائي للصف الثاني الثانوي"),
    (-2, "لخص الفصل الأول من كتاب العلوم، الترم الثاني"),
    (-3, "احسب سرعة السيارة في مسألة الفيزياء"),
    (-4, "ما هو تعريف الخليّة الحيّة؟"),
    (-5, "قارن بين الثورة الفرنسية والثورة الأمريكية"),
    (-6, "نموذج امتحان رياضيات ٣ ثانوي 2024"),
    (-7, "منهج أول ابتدائي ترم 1"),
    (-8, "آخر أخبار وزارة التربية اليوم 2026"),
    (-9, "خطوات زراعة القطن في مصر"),
    (-10, "why does python programming need grammar"),
    (-11, ""),
    (-12, "مُلَخَّصٌ عن نهر النـــيل"),
    (-13, "أريد مثال على الجملة الاسمية"),
    (-14, "اريد اريد كتب كتب كتب تاريخ حضارة مصر القديمة وتاريخ الفراعنة في الثانوية العامة"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.translate(F.lower("text"), *TRANSLITERATION))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    return turns.union(spark.createDataFrame(QUESTIONS, "question_id long, question string"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


_LABELS = understand.lexicon.BLOCK_LABELS
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, ranked: bool = False):
    """Registers a function under its name, with its SQL; ranked: the result has a column rank, an INTEGER as in Spark."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({sql})" if ranked else sql
        return f

    return register


def _cleaned(final: str, source: str = "documents", latin: bool = True, chunks: bool = False) -> str:
    script, cfg = (twins.LATIN, LATIN_CLEAN) if latin else (twins.ARABIC, clean.CleanConfig())
    noise, words = cfg.lists()
    head = "" if latin else f"ar AS (SELECT doc_id, translate(lower(text), '{TRANSLITERATION[0]}', '{TRANSLITERATION[1]}') AS text FROM documents),"
    more = f", {twins.chunked()}" if chunks else ""
    return f"WITH {'RECURSIVE ' if chunks else ''}{head} {twins.cleaned(source if latin else 'ar', script, tuple(noise), tuple(words))}{more} {final}"


def _analyzed(final: str) -> str:
    return f"WITH {twins.analysis(QUESTIONS)} {final}"


# Text and documents


@query(f"SELECT doc_id, round({twins.ratio('text', twins.LATIN)}, 6) AS latin_ratio, round({twins.ratio('text', twins.ARABIC)}, 6) AS arabic_ratio FROM documents")
def script_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(text.script_ratio("text", text.LATIN), 6).alias("latin_ratio"), F.round(text.script_ratio("text"), 6).alias("arabic_ratio"))


@query(f"SELECT lang, count(*) AS documents FROM documents WHERE length(text) >= 80 AND {twins.ratio('text', twins.LATIN)} >= 0.7 GROUP BY lang")
def script_heavy_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.is_valid_document("text", text.LATIN, 0.7)).groupBy("lang").agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, md5({twins.fold_letters('t')}) AS folded_md5, length({twins.fold_letters('t')}) AS folded_chars FROM (SELECT doc_id, translate(lower(text), '{TRANSLITERATION[0]}', '{TRANSLITERATION[1]}') AS t FROM documents)")
def normalize_letters(spark, sf_dir):
    folded = text.fold_letters(text.nfc("text"))
    return transliterated(spark, sf_dir).select("doc_id", text.md5_text(folded).alias("folded_md5"), F.length(folded).cast("long").alias("folded_chars"))


@query(f"SELECT question_id, {twins.normalize_question('question')} AS normalized FROM (WITH {twins.questions(QUESTIONS)} SELECT * FROM questions)")
def normalize_questions(spark, sf_dir):
    return asked(spark, sf_dir).select("question_id", text.normalize_question("question").alias("normalized"))


@query(f"SELECT question_id, {twins.squeeze(f"regexp_replace(question, '[{chr(92)}x{{064B}}-{chr(92)}x{{0652}}{chr(92)}x{{0640}}]', '', 'g')")} AS stemmed FROM (WITH {twins.questions(QUESTIONS)} SELECT * FROM questions)")
def stem_questions(spark, sf_dir):
    return asked(spark, sf_dir).select("question_id", text.stem("question").alias("stemmed"))


@query("SELECT doc_id, substr(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), chr(9), ' '), 1, 300) AS line FROM documents")
def log_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.log_line("text").alias("line"))


@query(f"SELECT doc_id, md5({twins.noise_removed('text', LATIN_CLEAN.noise)}) AS kept_md5 FROM documents")
def noise_line_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.md5_text(clean.noise_lines_removed("text", list(LATIN_CLEAN.noise))).alias("kept_md5"))


_LINES = f"list_filter({twins.lines('text')}, lambda l: l <> '')"


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len({twins.distinct('l')}) AS BIGINT) AS n_kept, md5(array_to_string({twins.distinct('l')}, chr(10))) AS kept_md5 FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def line_dedup(spark, sf_dir):
    own = F.filter(text.lines("text"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(own).cast("long").alias("n_lines"), F.size(F.array_distinct(own)).cast("long").alias("n_kept"), text.md5_text(clean.lines_deduplicated("text")).alias("kept_md5")
    )


@query(f"""SELECT doc_id, md5(array_to_string({twins.distinct('b')}, chr(10) || chr(10))) AS kept_md5, CAST(len({twins.distinct('b')}) AS BIGINT) AS n_blocks FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: {twins.strip('x')}), lambda x: x <> '') AS b FROM documents)""")
def block_dedup(spark, sf_dir):
    spread = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "\\n", "\n\n"))
    kept = clean.blocks_deduplicated("text")
    return spread.select("doc_id", text.md5_text(kept).alias("kept_md5"), F.when(kept == "", 0).otherwise(F.size(F.split(kept, "\\n\\n"))).cast("long").alias("n_blocks"))


@query(f"SELECT doc_id, md5({twins.sections('text', twins.LATIN)}) AS kept_md5 FROM documents")
def script_sections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.md5_text(clean.script_sections("text", text.LATIN)).alias("kept_md5"))


@query(f"SELECT doc_id, {twins.quality('text', twins.LATIN, LATIN_CLEAN.education)} AS quality FROM documents")
def quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.quality_score("text", text.LATIN, list(LATIN_CLEAN.education)).alias("quality"))


@query(_cleaned("SELECT doc_id, quality, hash, length(content) AS n_chars FROM cleaned"))
def clean_documents(spark, sf_dir):
    return clean.clean_documents(table(spark, sf_dir, "documents"), LATIN_CLEAN).select("doc_id", "quality", "hash", F.length("content").cast("long").alias("n_chars"))


@query(_cleaned("SELECT doc_id, quality, hash, length(content) AS n_chars FROM cleaned", latin=False))
def clean_documents_ar(spark, sf_dir):
    return clean.clean_documents(transliterated(spark, sf_dir)).select("doc_id", "quality", "hash", F.length("content").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, length(text) BETWEEN 250 AND 600000 AND length(text) - length(regexp_replace(text, '[{twins.LATIN}{twins.ARABIC}]', '', 'g')) >= 100 AS valid FROM documents")
def validate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_valid_content("text").alias("valid"))


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {twins.sentences('text')} AS s FROM documents))")
def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(f"SELECT lang, CAST(sum(len(s)) AS BIGINT) AS sentences, max(list_max(list_transform(s, lambda x: length(x)))) AS longest FROM (SELECT lang, {twins.sentences('text')} AS s FROM documents) GROUP BY lang")
def sentence_stats(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("lang", text.split_sentences("text").alias("s"))
    return s.groupBy("lang").agg(F.sum(F.size("s")).alias("sentences"), F.max(F.array_max(F.transform("s", lambda x: F.length(x)))).cast("long").alias("longest"))


@query(_cleaned("SELECT doc_id, concat(doc_id, '_', chunk_index) AS chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_total, length(chunk_text) AS characters, md5(chunk_text) AS chunk_md5 FROM chunks", chunks=True))
def chunk_documents(spark, sf_dir):
    chunks = clean.chunk_documents(clean.clean_documents(table(spark, sf_dir, "documents"), LATIN_CLEAN))
    return chunks.select("doc_id", "chunk_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "chunk_total", "characters")), text.md5_text("chunk_text").alias("chunk_md5"))


@query(_cleaned("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, max(length(chunk_text)) AS longest, round(avg(length(chunk_text)), 6) AS mean_chars FROM chunks", latin=False, chunks=True))
def chunk_stats(spark, sf_dir):
    chunks = clean.chunk_documents(clean.clean_documents(transliterated(spark, sf_dir)))
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max("characters").cast("long").alias("longest"), F.round(F.avg("characters"), 6).alias("mean_chars"))


# Deduplication


def _prefix(chars: int) -> str:
    return f"SELECT sha256(substr(coalesce(text, ''), 1, {chars})) AS fingerprint, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1"


@query(_prefix(1000))
def dedup_prefix1000(spark, sf_dir):
    return dedup.fingerprint_groups(table(spark, sf_dir, "documents"), dedup.document_prefix(1000), "doc_id")


@query(_prefix(15_000))
def dedup_prefix15000(spark, sf_dir):
    return dedup.fingerprint_groups(table(spark, sf_dir, "documents"), dedup.document_prefix(15_000), "doc_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(substr(coalesce(text, ''), 1, 1000)) ORDER BY doc_id) = 1")
def dedup_documents(spark, sf_dir):
    return dedup.first_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), dedup.document_prefix(1000), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE sha256(substr(coalesce(text, ''), 1, 15000)) NOT IN (SELECT sha256(substr(coalesce(text, ''), 1, 15000)) FROM documents WHERE lang = 'en')")
def dedup_against_known(spark, sf_dir):
    d, fp = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), dedup.document_prefix(15_000)
    return dedup.not_seen(d, fp, d.where("lang = 'en'").select(fp.alias("fingerprint"))).select("doc_id")


@query(_cleaned("SELECT md5(chunk_text) AS fingerprint, first(concat(doc_id, '_', chunk_index) ORDER BY doc_id, chunk_index) AS first, count(*) AS copies FROM chunks GROUP BY 1", chunks=True))
def dedup_chunks(spark, sf_dir):
    return dedup.fingerprint_groups(clean.chunk_documents(clean.clean_documents(table(spark, sf_dir, "documents"), LATIN_CLEAN)), dedup.chunk_hash(), "chunk_id", "doc_id", "chunk_index")


@query(f"SELECT doc_id, sha256(concat(source, substr(text, 1, 500))) AS document_id, sha256(substr(text, 1, 15000)) AS content_hash, md5(text) AS document_hash, CASE WHEN text = '' THEN 'empty' ELSE sha256(lower({twins.strip('text')})) END AS pipeline_key, md5(lower({twins.strip('text')})) AS analyzer_key FROM documents")
def document_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.document_id("source", "text").alias("document_id"),
        text.sha256_text("text", 15_000).alias("content_hash"),
        text.md5_text("text").alias("document_hash"),
        text.pipeline_key("text").alias("pipeline_key"),
        text.analyzer_key("text").alias("analyzer_key"),
    )


# URLs and pages

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_HOST = f"regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^www\\.', '')"


def _under(domain: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}'))"


_ALLOWED = f"host <> '' AND NOT ({' OR '.join(map(_under, DOMAINS.blocked))}) AND ({' OR '.join(_under(d) for d, _ in DOMAINS.credibility)})"
_HOSTED = f"(SELECT *, {_HOST} AS host FROM pages)"


@query(f"""SELECT page_id, lower(regexp_extract(url, '{_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{_PARTS}', 2)) ||
  coalesce(nullif(regexp_replace(regexp_extract(url, '{_PARTS}', 3), ';[^/]*$', ''), ''), '/') || regexp_extract(url, '{_PARTS}', 4) AS url FROM pages""")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


@query(f"SELECT page_id, host, {_ALLOWED} AS allowed FROM {_HOSTED}")
def domain_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.is_allowed("url", DOMAINS).alias("allowed"))


@query(f"SELECT page_id, CAST(CASE {' '.join(f'WHEN {_under(d)} THEN {s}' for d, s in DOMAINS.credibility)} ELSE {DOMAINS.unknown} END AS DOUBLE) AS score FROM {_HOSTED}")
def source_credibility(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.credibility("url", DOMAINS).alias("score"))


@query(f"""SELECT CAST(page_id % 7 AS BIGINT) AS query, page_id AS pos, url, class, row_number() OVER (PARTITION BY page_id % 7 ORDER BY class, page_id, url) AS rank FROM (
  SELECT *, CASE WHEN {' OR '.join(f"contains(lower(url), '{d}')" for d in DOMAINS.first)} THEN 0 WHEN {' OR '.join(f"contains(lower(url), '{d}')" for d in DOMAINS.last)} THEN 2 ELSE 1 END AS class FROM pages) QUALIFY rank <= 20""", ranked=True)
def url_priority_top20(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("query"), F.col("page_id").alias("pos"), "url")
    return urls.fetch_list(rows, DOMAINS)


@query(f"""WITH r AS (SELECT CAST(page_id % 5 AS BIGINT) AS query, CAST(page_id % 3 AS BIGINT) AS search_pos, page_id AS pos, lower(regexp_extract(url, '{_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{_PARTS}', 2)) ||
  coalesce(nullif(regexp_replace(regexp_extract(url, '{_PARTS}', 3), ';[^/]*$', ''), ''), '/') || regexp_extract(url, '{_PARTS}', 4) AS url FROM pages)
  SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY search_pos, pos, url) - 1 AS BIGINT) AS pos, url FROM (
  SELECT * FROM (SELECT *, {_HOST} AS host FROM r) WHERE {_ALLOWED} QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY search_pos, pos) = 1)""")
def search_candidates(spark, sf_dir):
    results = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query"), (F.col("page_id") % 3).alias("search_pos"), F.col("page_id").alias("pos"), "url")
    return urls.candidates(results, DOMAINS).withColumn("pos", F.col("pos").cast("long"))


ROBOTS = [("example.com", "/en/"), ("example.net", "/fr/1"), ("example.org", "/")]


@query(f"""SELECT page_id FROM (SELECT page_id, {_HOST} AS host, lower(coalesce(nullif(regexp_extract(url, '{_PARTS}', 3), ''), '/')) AS path FROM pages) p
  WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{h}', '{p}')" for h, p in ROBOTS)}) AS r(h, prefix) WHERE regexp_replace(host, '^[^.]+\\.(.*\\..*)$', '\\1') = h AND starts_with(path, prefix))""")
def robots_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "//(?:www\\.)?[^./]+\\.([^/]*\\.[^/]*)", "//$1").alias("url"))
    return urls.allowed_by_robots(pages, spark.createDataFrame(ROBOTS, "host string, prefix string")).select("page_id")


ROBOTS_FILES = [
    ("example.com", "User-agent: one\nDisallow: /en/\n\nUser-Agent: *\nDisallow: /fr/\nDisallow:\nAllow: /x\n"),
    ("example.net", "# nothing for all\nuser-agent: other\ndisallow: /\n"),
    ("example.org", "USER-AGENT: *\r\n  DISALLOW: /De/  \r\nUser-agent: two\r\nDisallow: /es/\r\nuser-agent: * # again\r\ndisallow: /es/1\r\n"),
    ("empty.com", None),
]


@query(f"""WITH files AS (SELECT * FROM (VALUES {', '.join(f"('{h}', {'NULL' if b is None else twins.q(b)})" for h, b in ROBOTS_FILES)}) AS f(host, body)),
  line AS (SELECT host, {twins.strip('l[i]')} AS line, i FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT host, string_split_regex(lower(coalesce(body, '')), '{twins.BREAK}') AS l FROM files))),
  inside AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, 'user-agent') THEN contains(line, '*') END IGNORE NULLS) OVER (PARTITION BY host ORDER BY i), false) AS inside FROM line),
  rules AS (SELECT DISTINCT host, {twins.strip("substr(line, 10)")} AS prefix FROM inside WHERE inside AND starts_with(line, 'disallow:') AND {twins.strip("substr(line, 10)")} <> '')
  SELECT page_id FROM (SELECT page_id, {_HOST} AS host, lower(coalesce(nullif(regexp_extract(url, '{_PARTS}', 3), ''), '/')) AS path FROM pages) p
  WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE regexp_replace(p.host, '^[^.]+\\.(.*\\..*)$', '\\1') = r.host AND starts_with(p.path, r.prefix))""")
def robots_sections(spark, sf_dir):
    """Rules read from robots files: only their sections for all agents count."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "//(?:www\\.)?[^./]+\\.([^/]*\\.[^/]*)", "//$1").alias("url"))
    rules = urls.robots_rules(spark.createDataFrame(ROBOTS_FILES, "host string, body string"))
    return urls.allowed_by_robots(pages, rules).select("page_id")


@query(f"SELECT page_id, host, CAST(floor((row_number() OVER (PARTITION BY host ORDER BY page_id, url) - 1) / 8) AS BIGINT) AS wave FROM (SELECT page_id, url, {_HOST} AS host FROM pages)")
def fetch_waves(spark, sf_dir):
    return urls.fetch_waves(table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("pos"), "url")).select("page_id", "host", "wave")


@query(f"""SELECT doc_id, {twins.squeeze("array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))")} AS content, 'pdf' AS document_type, 0.9::DOUBLE AS source_score,
  CASE WHEN {twins.squeeze("text")} <> '' THEN sha256(substr({twins.squeeze("array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))")}, 1, 15000)) END AS content_hash FROM documents""")
def pdf_text(spark, sf_dir):
    """Documents as decoded files, each line a page."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pages"), F.concat(F.lit("https://example.com/"), "doc_id", F.lit(".pdf")).alias("url"))
    return pdf.extract_pdfs(files, cfg=DOMAINS).drop("url")


@query("SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN starts_with(lower(html), '<!doctype html') THEN 'web' END AS kind FROM pages")
def document_type(spark, sf_dir):
    kind = F.when(F.startswith(F.lower("html"), F.lit("<!doctype html")), "text/html; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", urls.document_type(kind, "url").alias("kind"))


@query(f"WITH {twins.extracted()} SELECT page_id, url, title, content FROM extracted")
def html_extract(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_VALID = f"length(content) BETWEEN 250 AND 600000 AND length(content) - length(regexp_replace(content, '[{twins.LATIN}{twins.ARABIC}]', '', 'g')) >= 100"


@query(f"WITH {twins.extracted()} SELECT page_id, length(content) AS n_chars, {_VALID} AS valid FROM (SELECT page_id, outer_content AS content FROM extracted)")
def validate_pages(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"), once=True).select("page_id", F.length("content").cast("long").alias("n_chars"), text.is_valid_content("content").alias("valid"))


_NORMAL = f"""lower(regexp_extract(url, '{_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{_PARTS}', 2)) ||
  coalesce(nullif(regexp_replace(regexp_extract(url, '{_PARTS}', 3), ';[^/]*$', ''), ''), '/') || regexp_extract(url, '{_PARTS}', 4)"""


@query(f"""WITH allowed AS (SELECT * FROM (SELECT page_id, url, html, {_HOST} AS host FROM (SELECT page_id, html, {_NORMAL} AS url FROM pages)) WHERE {_ALLOWED}), {twins.extracted('allowed')},
  one AS (SELECT * FROM (SELECT page_id, url, title, content FROM extracted) WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY sha256(substr(content, 1, 1000)) ORDER BY page_id) = 1),
  told AS (SELECT *, {_HOST} AS host, sha256(url || substr(content, 1, 500)) AS doc_id, sha256(substr(content, 1, 15000)) AS content_hash, length(content) AS content_length, regexp_extract(url, '{_PARTS}', 2) AS source FROM one),
  scored AS (SELECT *, CAST(CASE {' '.join(f'WHEN {_under(d)} THEN {v}' for d, v in DOMAINS.credibility)} ELSE {DOMAINS.unknown} END AS DOUBLE) AS source_score FROM told)
  SELECT page_id, doc_id, url, title, source_score, content_hash, CAST(content_length AS INTEGER) AS content_length, content, md5(url || '|' || source || '|web|' || source_score || '|' || content_hash || '|all pages|' || title || '|' || content_length || '|0.0') AS metadata_md5 FROM scored""")
def ingest_pages(spark, sf_dir):
    ingested = pipeline.ingest_pages(table(spark, sf_dir, "pages"), LATIN_ANSWER)
    told = pipeline.final_metadata(ingested.withColumn("query", F.lit("all pages")), "query", 0.0).drop("query")
    fields = ("source_url", "source", "document_type", "source_score", "content_hash", "query", "title", "content_length", "created_at")
    return told.withColumn("metadata_md5", text.md5_text(F.concat_ws("|", *(F.col(f"metadata.{x}").cast("string") for x in fields)))).drop("metadata")


# Questions


@query(_analyzed("SELECT question_id, intent, round(score, 6) AS votes FROM v WHERE score > 0"))
def intent_votes(spark, sf_dir):
    patterns = understand.patterns_of()
    n = asked(spark, sf_dir).withColumn("found", patterns.find(text.normalize_question("question")))
    return n.select("question_id", F.explode(patterns.votes("intent", F.col("found"))).alias("v")).select("question_id", "v.intent", F.round("v.score", 6).alias("votes")).where("votes > 0")


def _analysis_query(name: str, columns: list[str], sql: str | None = None):
    def run(spark, sf_dir):
        return understand.analyze(asked(spark, sf_dir)).select("question_id", *columns)

    run.__name__ = name
    return query(_analyzed(sql or f"SELECT question_id, {', '.join(columns)} FROM analyzed"))(run)


_analysis_query("intent_detect", ["intent", "intent_confidence"])
_analysis_query("subject_detect", ["subject"])
_analysis_query("grade_detect", ["grade", "stage"])
_analysis_query("term_year", ["term", "year"])
_analysis_query("topic_extract", ["topic"])
_analysis_query("keyword_top12", ["keywords"])
_analysis_query("query_expand", ["expanded_keywords"])
_analysis_query("query_rewrite", ["search_query", "rewritten_query"])
_analysis_query("source_category", ["source_category", "source_priority", "needs_live_search"])


@query(_analyzed("SELECT question_id, confidence FROM analyzed"))
def query_confidence(spark, sf_dir):
    return understand.analyze(asked(spark, sf_dir)).select("question_id", F.col("confidence.total").alias("confidence"))


@query(
    _analyzed(f"""SELECT question_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS search FROM (SELECT question_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT question_id, {twins.distinct('raw')} AS l FROM (SELECT question_id, list_concat(list_filter(list_transform(list_concat(
    {twins.strings('search_query', *(f"topic || ' {x}'" for x in ('شرح', 'منهج مصر', 'كتاب الوزارة', 'بنك المعرفة المصري')), "subject || ' ' || topic || ' شرح'", "subject || ' ' || grade || ' وزارة التربية والتعليم'")},
    list_transform(keywords, lambda k: k || ' شرح تعليمي')), lambda x: {twins.strip('x')}), lambda x: x <> ''),
    [{', '.join(f"search_query || ' {x}'" for x in ('شرح درس', 'منهج وزارة التربية والتعليم', 'بنك المعرفة المصري', 'علوم'))}]) AS raw FROM analyzed)))""")
)
def search_query_explode(spark, sf_dir):
    return understand.search_strings(understand.analyze(asked(spark, sf_dir))).select("question_id", F.col("pos").cast("long").alias("pos"), "search")


@query(_analyzed(f"SELECT question_id, CASE intent {' '.join(f'WHEN {twins.q(k)} THEN {twins.q(v)}' for k, v in understand.lexicon.STYLES.items())} ELSE 'general' END AS style FROM analyzed"))
def answer_style(spark, sf_dir):
    return understand.analyze(asked(spark, sf_dir)).select("question_id", understand.answer_style(F.col("intent")).alias("style"))


@query(_analyzed("SELECT question_id, question AS query, normalized, intent, subject, stage, grade, topic, keywords, search_query, source_category, needs_live_search AS live_search, confidence FROM analyzed"))
def pipeline_metadata(spark, sf_dir):
    return understand.metadata(understand.analyze(asked(spark, sf_dir)))


@query(f"""WITH {twins.questions(QUESTIONS)}, n AS (SELECT question_id, {twins.normalize_question('question')} AS normalized FROM questions)
  SELECT question_id, {twins.strings(*(twins.first_key('normalized', {k: v}) for k, v in understand.AnalyzerConfig().of(understand.lexicon.SUBJECTS).items()))} AS subjects FROM n""")
def subjects_all(spark, sf_dir):
    patterns = understand.patterns_of()
    n = asked(spark, sf_dir).withColumn("found", patterns.find(text.normalize_question("question")))
    return n.select("question_id", patterns.keys("subject", F.col("found")).alias("subjects"))


@query(f"""WITH {twins.questions(QUESTIONS)}, n AS (SELECT question_id, {twins.normalize_question('question')} AS normalized FROM questions)
  SELECT question_id, {twins.first_key('normalized', understand.lexicon.GRADES)} AS grade, {twins.first_key('normalized', understand.lexicon.STAGES)} AS stage, {twins.first_key('normalized', understand.lexicon.SUBJECTS)} AS subject FROM n""")
def detect_with_plain_patterns(spark, sf_dir):
    """Dictionaries as they are written: patterns with letters that questions fold never match."""
    known = understand.lexicon
    patterns = understand.plain_patterns(grade=known.GRADES, stage=known.STAGES, subject=known.SUBJECTS)
    n = asked(spark, sf_dir).withColumn("found", patterns.find(text.normalize_question("question")))
    return n.select("question_id", *(patterns.first_key(c, F.col("found")).alias(c) for c in ("grade", "stage", "subject")))


METAS = [
    ("en", 1, "and the", "with", "that", ["ing", "tion", "ble", "ly", "of"]),
    ("fr", 2, "de la", "que", "une", ["eau", "tion", "ment"]),
    ("de", 3, "und der", "nicht", "eine", ["ung", "keit"]),
    ("es", 4, "de los", "que", None, ["mente", "ción"]),
]


@query(f"""WITH metas AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}, '{c}', '{d}', {'NULL' if e is None else twins.q(e)}, {f!r})" for a, b, c, d, e, f in METAS)}) AS t(lang, query_id, topic, subject, grade, keywords)),
p AS (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, {twins.paragraphs('text')} AS l FROM documents)),
s AS (SELECT doc_id, query_id, i - 1 AS pos, round(least((CASE WHEN contains(lower(l[i]), topic) THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(l[i]), subject) THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN grade IS NOT NULL AND contains(lower(l[i]), grade) THEN 0.2::DOUBLE ELSE 0 END)
  + least(len(list_filter(keywords, lambda k: contains(lower(l[i]), k))) * 0.05::DOUBLE, 0.2::DOUBLE), 1.0), 6) AS relevance, md5(l[i]) AS paragraph_md5 FROM p JOIN metas USING (lang))
SELECT doc_id, query_id, CAST(pos AS BIGINT) AS pos, relevance, paragraph_md5, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY relevance DESC, pos) AS rank FROM s QUALIFY rank <= 25""", ranked=True)
def paragraph_top25(spark, sf_dir):
    metas = spark.createDataFrame(METAS, "lang string, query_id int, topic string, subject string, grade string, keywords array<string>")
    best = understand.best_paragraphs(table(spark, sf_dir, "documents"), F.broadcast(metas), "lang")
    return best.select("doc_id", "query_id", F.col("pos").cast("long").alias("pos"), "relevance", text.md5_text("paragraph").alias("paragraph_md5"), "rank")


@query(f"""WITH metas AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}, '{c}', '{d}', {'NULL' if e is None else twins.q(e)}, {f!r})" for a, b, c, d, e, f in METAS)}) AS t(lang, query_id, topic, subject, grade, keywords)),
d AS (SELECT doc_id, lang, {twins.paragraphs('text')} AS l FROM documents),
p AS (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM d),
s AS (SELECT doc_id, query_id, i, l[i] AS paragraph, round(least((CASE WHEN contains(lower(l[i]), topic) THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(l[i]), subject) THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN grade IS NOT NULL AND contains(lower(l[i]), grade) THEN 0.2::DOUBLE ELSE 0 END)
  + least(len(list_filter(keywords, lambda k: contains(lower(l[i]), k))) * 0.05::DOUBLE, 0.2::DOUBLE), 1.0), 6) AS relevance FROM p JOIN metas USING (lang)),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, query_id ORDER BY relevance DESC, i) <= 25),
c AS (SELECT doc_id, query_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY relevance DESC, i) AS content, count(*) AS n, max(relevance) AS top FROM r GROUP BY ALL)
SELECT d.doc_id, metas.query_id, md5(coalesce(content, '')) AS content_md5, CAST(len(l) AS BIGINT) AS paragraph_count, coalesce(n, 0) AS selected_paragraphs, coalesce(top, 0.0::DOUBLE) AS top_relevance
FROM d JOIN metas USING (lang) LEFT JOIN c ON c.doc_id = d.doc_id AND c.query_id = metas.query_id""")
def rank_content(spark, sf_dir):
    metas = spark.createDataFrame(METAS, "lang string, query_id int, topic string, subject string, grade string, keywords array<string>")
    found = understand.ranked_content(table(spark, sf_dir, "documents"), F.broadcast(metas), "lang")
    return found.select("doc_id", "query_id", text.md5_text("content").alias("content_md5"), F.col("paragraph_count").cast("long").alias("paragraph_count"), F.col("selected_paragraphs").cast("long").alias("selected_paragraphs"), "top_relevance")


# Retrieval

_ITEMS = "asked_items AS (SELECT item_id AS question_id, text AS question FROM benchmark)"


def _bm25(final: str, k: int = 20, more: str = "") -> str:
    return f"WITH {_ITEMS}, {twins.bm25('documents', 'doc_id', 'text', 'asked_items', k)}{more} {final}"


def _index(spark, sf_dir) -> DataFrame:
    return lexical.index(lexical.passages(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _lexical(spark, sf_dir, k: int) -> DataFrame:
    return lexical.search(items(spark, sf_dir), _index(spark, sf_dir), k)


@query(_bm25("SELECT term, df, round(idf, 6) AS idf FROM idf"))
def bm25_idf(spark, sf_dir):
    return lexical.inverse_frequencies(_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_bm25("SELECT * FROM hits"), ranked=True)
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, 20)


@query(
    f"""WITH asked AS (SELECT conv_id, question_id, question FROM (SELECT conv_id, conv_id * 100000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL)),
  docs AS MATERIALIZED (SELECT conv_id, turn, {twins.tokens('text')} AS terms FROM conversations WHERE role = 'assistant'),
  post AS MATERIALIZED (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(terms) AS term FROM docs) GROUP BY ALL),
  many AS MATERIALIZED (SELECT conv_id, count(*) AS n, avg(len(terms)) AS mean_size FROM docs GROUP BY conv_id),
  raw AS MATERIALIZED (SELECT conv_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT conv_id, term, count(*) AS df FROM post GROUP BY ALL) JOIN many USING (conv_id)),
  idf AS MATERIALIZED (SELECT conv_id, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY conv_id) ELSE raw END AS idf FROM raw),
  terms AS (SELECT conv_id, question_id, term, count(*) AS times FROM (SELECT conv_id, question_id, unnest({twins.tokens('question')}) AS term FROM asked) GROUP BY ALL),
  scored AS (SELECT question_id, turn AS passage_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.terms) / mean_size))), 6) AS score
    FROM terms JOIN idf USING (conv_id, term) JOIN post USING (conv_id, term) JOIN docs d USING (conv_id, turn) JOIN many USING (conv_id) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 3""", ranked=True)
def bm25_by_corpus(spark, sf_dir):
    """Each conversation's questions over that conversation's answers only: statistics of its own for every corpus."""
    said = table(spark, sf_dir, "conversations")
    known = lexical.index(lexical.passages(said.where("role = 'assistant'"), "turn", "text", "conv_id"))
    own = said.where("role = 'user' and text is not null").select((F.col("conv_id") * 100000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), F.col("conv_id").alias("corpus_id"))
    return lexical.search(own, known, 3)


def _dense(where: str, k: int) -> str:
    return f"""dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM (
  SELECT a.vec_id AS question_id, b.vec_id AS passage_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE {where}) QUALIFY rank <= {k})"""


@query(f"WITH {_dense('a.vec_id % 50 = 0', 20)} SELECT * FROM dense", ranked=True)
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return dense.search(e.where("vec_id % 50 = 0"), e, 20)


_COSINE = """dense AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM (
  SELECT a.id AS question_id, b.id AS passage_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS score FROM ASKED a, KNOWN b) QUALIFY rank <= LIMIT_K)"""


@query(f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
  w AS (SELECT * FROM v WHERE id % 50 = 0), {_COSINE.replace('ASKED', 'w').replace('KNOWN', 'v').replace('LIMIT_K', '20')} SELECT * FROM dense""", ranked=True)
def dense_cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return dense.search(e.where("vec_id % 50 = 0"), e, 20, normalize=True)


@query(
    _bm25(
        """SELECT question_id, passage_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, l_rank NULLS LAST, d_rank NULLS LAST, passage_id) AS rank FROM (
  SELECT question_id, passage_id, round(sum(part), 6) AS score, min(l_rank) AS l_rank, min(d_rank) AS d_rank FROM (
    SELECT question_id, passage_id, 0.35::DOUBLE * (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS part, rank AS l_rank, NULL AS d_rank FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY question_id))
    UNION ALL SELECT question_id, passage_id, 0.65::DOUBLE * (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, NULL, rank FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WINDOW w AS (PARTITION BY question_id))) GROUP BY ALL) QUALIFY rank <= 20""",
        60,
        ", " + _dense("a.vec_id IN (SELECT item_id FROM benchmark)", 60),
    ), ranked=True)
def hybrid_topk(spark, sf_dir):
    """Vectors and documents share numbers only by convention: a synthetic pairing of vec_id with doc_id, and of item_id with the query's vector."""
    e, cfg = table(spark, sf_dir, "embeddings"), fusion.HybridConfig()
    wanted = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return fusion.fuse(_lexical(spark, sf_dir, cfg.k * cfg.over_fetch), dense.search(wanted, e, cfg.k * cfg.over_fetch), cfg)


@query(
    _bm25(
        f"""SELECT question_id, passage_id, overlap AS score, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank, passage_id) AS rank FROM (
  SELECT h.*, round(len(list_intersect(list_distinct({twins.tokens('question')}), list_distinct(terms))) / len(list_distinct({twins.tokens('question')}))::DOUBLE, 6) AS overlap FROM hits h JOIN docs USING (passage_id) JOIN asked_items USING (question_id)) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank, passage_id) <= 4"""
    ), ranked=True)
def rerank_top4(spark, sf_dir):
    hits = pipeline.met(cut(_lexical(spark, sf_dir, 20)), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text")).join(items(spark, sf_dir), "question_id")
    return fusion.rerank(hits, lexical.token_overlap("question", "text")).select("question_id", "passage_id", "score", "rank")


@query(_bm25(f"""SELECT b.question_id, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN {twins.q(pipeline.NO_EVIDENCE)} WHEN coalesce(packed, 0) = 0 THEN {twins.q(pipeline.NO_CONTEXT)} END AS fallback
  FROM asked_items b LEFT JOIN (SELECT question_id, count(*) AS n FROM hits GROUP BY question_id) USING (question_id)
  LEFT JOIN (SELECT question_id, count(*) AS packed FROM (SELECT question_id, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM (
    SELECT question_id, rank, text FROM hits JOIN documents ON passage_id = doc_id WHERE question_id % 3 <> 1 AND {twins.strip('text')} <> '' QUALIFY row_number() OVER (PARTITION BY question_id, md5(text) ORDER BY rank) = 1)) WHERE total <= 12000 GROUP BY question_id) USING (question_id)"""))
def answer_fallback(spark, sf_dir):
    """All hits of every question are packed; those of every third question are blank, so that it is left without a context."""
    hits = cut(_lexical(spark, sf_dir, 20))
    texts = pipeline.met(hits, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text"))
    texts = texts.withColumn("text", F.when(F.col("question_id") % 3 == 1, F.lit(" \n ")).otherwise(F.col("text")))
    context = fusion.contexts(fusion.packed_hits(texts, "question_id", ["rank"], "text"), "question_id", ["rank"], "text")
    return pipeline.with_fallback(items(spark, sf_dir), hits, context).select("question_id", "n_hits", "fallback")


_PACKED = f"""packed AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS total FROM (
  SELECT * FROM conversations WHERE coalesce({twins.strip('text')}, '') <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) = 1) QUALIFY total <= BUDGET)"""


@query(f"WITH {_PACKED.replace('BUDGET', '3000')} SELECT conv_id, count(*) AS n_texts, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS context_md5 FROM packed GROUP BY conv_id")
def context_pack(spark, sf_dir):
    packed = fusion.packed_hits(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 3000)
    return fusion.contexts(packed, "conv_id", ["turn"], "text").select("conv_id", F.col("n_texts").cast("long").alias("n_texts"), text.md5_text("context").alias("context_md5"))


@query(f"""WITH packed AS (SELECT *, sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM (
  SELECT * FROM documents WHERE coalesce({twins.strip('text')}, '') <> '' QUALIFY row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) = 1) QUALIFY total <= 12000)
  SELECT lang, count(*) AS n_texts, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS context_md5 FROM packed GROUP BY lang""")
def context_pack_default(spark, sf_dir):
    """The documents of each language as the hits of one question, within the default budget."""
    packed = fusion.packed_groups(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), "lang", ["doc_id"], "text")
    return fusion.contexts(packed, "lang", ["doc_id"], "text").select("lang", F.col("n_texts").cast("long").alias("n_texts"), text.md5_text("context").alias("context_md5"))


@query(
    _bm25(
        f"""SELECT question_id, rank, block_md5 FROM (SELECT question_id, rank, md5(block) AS block_md5, sum(length(block)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM (
  SELECT question_id, rank, chr(10) || '[' || rank || ']' || chr(10) || '{_LABELS[0]}' || chr(10) || source || chr(10) || '{_LABELS[1]}' || chr(10) || lang || chr(10) || '{_LABELS[2]}' || chr(10) || {twins.squeeze('text')} || chr(10) AS block
  FROM hits JOIN documents ON passage_id = doc_id WHERE rank <= 5 AND {twins.squeeze('text')} <> '')) WHERE total <= 12000"""
    ), ranked=True)
def context_blocks(spark, sf_dir):
    hits = pipeline.met(cut(_lexical(spark, sf_dir, 20)), table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "passage_id"))
    return fusion.numbered_blocks(hits, "question_id", "rank", "source", "lang", "text").select("question_id", "rank", text.md5_text("block").alias("block_md5"))


@query(_bm25("SELECT question_id, source AS url, min(rank) AS rank FROM hits JOIN documents ON passage_id = doc_id GROUP BY ALL"), ranked=True)
def citations(spark, sf_dir):
    hits = pipeline.met(cut(_lexical(spark, sf_dir, 20)), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("url")))
    return fusion.citations(hits, "question_id", ["rank"], "url").select("question_id", "url", "rank")


@query(_bm25("SELECT question_id, count(*) AS n_sources, md5(string_agg(concat_ws('|', rank, passage_id, printf('%.4f', round_even(score, 4))), ';' ORDER BY rank)) AS sources_md5 FROM hits GROUP BY question_id"))
def answer_sources(spark, sf_dir):
    hits = _lexical(spark, sf_dir, 20).withColumns({"title": F.lit(""), "url": F.col("passage_id").cast("string")})
    entries = F.transform("sources", lambda s: F.concat_ws("|", s["rank"].cast("string"), s["url"], F.format_string("%.4f", s["score"])))
    return fusion.sources(hits).select("question_id", F.size("sources").cast("long").alias("n_sources"), text.md5_text(F.array_join(entries, ";")).alias("sources_md5"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS answer_md5, count(*) AS n_messages FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id")
def llm_stream_parse(spark, sf_dir):
    """Assistant turns written as event lines of a stream, parsed back."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    said = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    rows = turns.select("conv_id", (F.col("turn") * 2).alias("pos"), said.alias("line"))
    more = turns.select("conv_id", (F.col("turn") * 2 + 1).alias("pos"), F.lit("data: {broken").alias("line"))
    end = turns.groupBy("conv_id").agg((F.max("turn") * 2 + 2).alias("pos")).withColumn("line", F.lit("data: [DONE]"))
    late = end.select("conv_id", F.col("pos") + 1, F.lit('data: {"choices":[{"delta":{"content":"late"}}]}'))
    answers = state.stream_text(rows.union(more).union(end).union(late), by="conv_id")
    return answers.join(turns.groupBy("conv_id").agg(F.count("*").alias("n_messages")), "conv_id").select("conv_id", text.md5_text("answer").alias("answer_md5"), "n_messages")


@query("SELECT conv_id, turn, md5('Context:' || chr(10) || 'evidence ' || turn || chr(10) || chr(10) || 'Question:' || chr(10) || text) AS message_md5, 'Answer from the context and cite it.' AS system, 1200 AS tokens FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def prompt_payload(spark, sf_dir):
    """Requests as JSON, read back field by field."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").withColumn("context", F.concat(F.lit("evidence "), "turn"))
    sent = turns.withColumn("payload", pipeline.payload("text", "context", "Answer from the context and cite it."))
    told = F.from_json("payload", "max_tokens int, messages array<struct<role: string, content: string>>")
    back = sent.withColumn("told", told).withColumn("user", F.filter("told.messages", lambda m: m["role"] == "user")[0]["content"])
    return back.select("conv_id", "turn", text.md5_text("user").alias("message_md5"), F.filter("told.messages", lambda m: m["role"] == "system")[0]["content"].alias("system"), F.col("told.max_tokens").alias("tokens"))


@query(f"SELECT conv_id, turn, trim(text) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL UNION ALL SELECT conv_id, -1, '' FROM (SELECT DISTINCT conv_id FROM conversations)")
def answer_extract(spark, sf_dir):
    """Answers taken out of responses that are not streamed, and out of ones that hold none."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    response = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    none = table(spark, sf_dir, "conversations").select("conv_id", F.lit(-1).cast("long").alias("turn")).distinct().withColumn("response", F.lit('{"error": 1}'))
    return said.select("conv_id", F.col("turn").cast("long").alias("turn"), response.alias("response")).unionByName(none).select("conv_id", "turn", state.answer_of("response").alias("answer"))


# State and metrics


@query("SELECT user_id, event_id, value FROM (SELECT *, max(ts) OVER () AS last FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE ts > last - INTERVAL 36000 SECOND")
def chunk_cache_ttl(spark, sf_dir):
    return state.latest_within(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 36_000).select("user_id", "event_id", "value")


@query("""WITH m AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  e AS (SELECT user_id, max(ts) AS last, count(*) FILTER (before IS NOT NULL AND ts - before < INTERVAL 36000 SECOND) AS hits, count(*) AS n FROM m GROUP BY user_id)
  SELECT count(*) AS entries, count(*) FILTER (last > now - INTERVAL 36000 SECOND) AS live, count(*) FILTER (last <= now - INTERVAL 36000 SECOND) AS expired, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n - hits) AS BIGINT) AS misses
  FROM e, (SELECT max(ts) AS now FROM events)""")
def cache_stats(spark, sf_dir):
    return state.cache_stats(table(spark, sf_dir, "events"), "user_id", "ts", 36_000)


@query("SELECT DISTINCT sha256(concat(user_id, '|', event_type)) AS fingerprint FROM events")
def stream_dedup_events(spark, sf_dir):
    """The events as a stream of files, without rows whose user and type have been seen (the delay covers the table)."""
    events = state.read_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), text.sha256_text(F.concat_ws("|", "user_id", "event_type")).alias("fingerprint"))
    return state.run_once(state.unseen(events, "fingerprint", "ts", "36500 days"), fresh_path(spark, "stream")).select("fingerprint")


@query(f"""SELECT count(*) AS documents, count(DISTINCT sha256(substr(coalesce(text, ''), 1, 1000))) AS unique_documents, count(*) FILTER (length(text) < 250) AS too_short,
  count(*) FILTER (length(text) >= 80 AND {twins.ratio('text', twins.LATIN)} >= 0.15) AS valid, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents""")
def pipeline_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.count("*").alias("documents"),
        F.count_distinct(dedup.document_prefix(1000)).alias("unique_documents"),
        F.count_if(F.length("text") < 250).alias("too_short"),
        F.count_if(text.is_valid_document("text", text.LATIN)).alias("valid"),
        F.sum(F.length("text")).alias("characters"),
    )


def _report() -> str:
    allowed = f"({_ALLOWED})"
    robots = "NOT EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{h}', '{p}')" for h, p in ROBOTS) + ") AS r(h, prefix) WHERE regexp_replace(host, '^[^.]+\\.(.*\\..*)$', '\\1') = h AND starts_with(path, prefix))"
    valid = f"(length(html) BETWEEN 250 AND 600000 AND length(html) - length(regexp_replace(html, '[{twins.LATIN}{twins.ARABIC}]', '', 'g')) >= 100)"
    flags = f"SELECT {allowed} AS a, {robots} AS r, page_id % 3 = 0 AS c, html IS NOT NULL AND html <> '' AND page_id % 7 <> 0 AS f, coalesce({valid}, false) AS v FROM p"
    return f"""WITH p AS (SELECT *, {_HOST} AS host, lower(coalesce(nullif(regexp_extract(url, '{_PARTS}', 3), ''), '/')) AS path FROM pages), x AS ({flags})
  SELECT count(*) FILTER (v AND f AND a AND r) AS documents, count(*) FILTER (a AND r AND NOT c AND f) AS fetch_success, count(*) FILTER (a AND r AND NOT c AND NOT f) AS errors, count(*) FILTER (a AND r AND c) AS cache_hits,
  count(*) FILTER (NOT a) AS blocked, count(*) FILTER (a AND NOT r) AS robots_blocked, count(*) AS search_results FROM x"""


@query(_report())
def collection_report(spark, sf_dir):
    """The counts of a collection run, in which every third page is cached and every seventh can't be fetched."""
    pages = table(spark, sf_dir, "pages").withColumn("stem", F.regexp_replace("url", "//(?:www\\.)?[^./]+\\.([^/]*\\.[^/]*)", "//$1"))
    free = urls.allowed_by_robots(pages.select("page_id", F.col("stem").alias("url")), spark.createDataFrame(ROBOTS, "host string, prefix string")).select("page_id", F.lit(True).alias("free"))
    marked = pages.join(free, "page_id", "left").select(
        urls.is_allowed("url", DOMAINS).alias("allowed"),
        F.coalesce("free", F.lit(False)).alias("robots_allowed"),
        (F.col("page_id") % 3 == 0).alias("cached"),
        ((F.coalesce("html", F.lit("")) != "") & (F.col("page_id") % 7 != 0)).alias("fetched"),
        F.coalesce(text.is_valid_content("html"), F.lit(False)).alias("collected"),
    )
    return pipeline.collection_report(marked)


def _answers() -> str:
    uniq = f"uniq AS MATERIALIZED (SELECT doc_id, concat(doc_id, '_', chunk_index) AS chunk_id, chunk_text FROM chunks QUALIFY row_number() OVER (PARTITION BY md5({twins.strip('chunk_text')}) ORDER BY doc_id, chunk_index) = 1)"
    bm25 = twins.bm25("uniq", "chunk_id", "chunk_text", "asked_items", 60)
    norm = "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"
    vectors = f"""known AS MATERIALIZED (SELECT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS e, {norm} AS norm FROM uniq JOIN embeddings ON doc_id = vec_id),
  wanted AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, {norm} AS norm FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"""
    dense_ = _COSINE.replace("ASKED", "wanted").replace("KNOWN", "known").replace("LIMIT_K", "60")
    part = "SELECT question_id, passage_id, {w}::DOUBLE * (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS part, {l} AS l_rank, {d} AS d_rank FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM {t} WINDOW w AS (PARTITION BY question_id))"
    both = part.format(w=0.35, l="rank", d="NULL", t="hits") + " UNION ALL " + part.format(w=0.65, l="NULL", d="rank", t="dense")
    fused = f"""fused AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, l_rank NULLS LAST, d_rank NULLS LAST, passage_id) AS rank FROM (
  SELECT question_id, passage_id, round(sum(part), 6) AS score, min(l_rank) AS l_rank, min(d_rank) AS d_rank FROM ({both}) GROUP BY ALL) QUALIFY rank <= 20)"""
    own = f"list_distinct({twins.tokens('question')})"
    overlap = f"round(CASE WHEN len({own}) > 0 THEN len(list_intersect({own}, list_distinct({twins.tokens('chunk_text')}))) / len({own})::DOUBLE ELSE 0 END, 6)"
    reranked = f"""best AS (SELECT question_id, chunk_text, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, hit, passage_id) AS rank FROM (
  SELECT question_id, passage_id, f.rank AS hit, chunk_text, {overlap} AS overlap FROM fused f JOIN uniq ON passage_id = chunk_id JOIN asked_items USING (question_id)) QUALIFY rank <= 4),
  packed AS (SELECT *, sum(length(chunk_text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM best WHERE {twins.strip('chunk_text')} <> '' QUALIFY total <= 12000)"""
    final = "SELECT question_id, CAST(count(*) AS INTEGER) AS n_texts, string_agg(chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM packed GROUP BY question_id"
    return _cleaned(f", {_ITEMS}, {uniq}, {bm25}, {vectors}, {dense_}, {fused}, {reranked} {final}", chunks=True)


@query(_answers())
def answer_context(spark, sf_dir):
    """Flagship: benchmark texts as questions, lexical and dense evidence from the chunks of all documents, contexts with their size.

    The driver's vectors are paired with documents (whose chunks share them) and questions by number: a synthetic association."""
    e = table(spark, sf_dir, "embeddings")
    chunks = pipeline.chunk_table(table(spark, sf_dir, "documents"), LATIN_ANSWER)
    questions = items(spark, sf_dir).join(e.select(F.col("vec_id").alias("question_id"), "embedding"), "question_id", "left")
    return pipeline.answer_context(questions, chunks, LATIN_ANSWER, "hybrid", e.select(F.col("vec_id").alias("doc_id"), "embedding"))


def _pages_answers(page_corpus: str, item_corpus: str) -> str:
    script, (noise, words) = twins.LATIN, LATIN_CLEAN.lists()
    own = f"list_distinct({twins.tokens('question')})"
    overlap = f"round(CASE WHEN len({own}) > 0 THEN len(list_intersect({own}, list_distinct({twins.tokens('chunk_text')}))) / len({own})::DOUBLE ELSE 0 END, 6)"
    return f"""WITH RECURSIVE allowed AS (SELECT * FROM (SELECT page_id, url, html, {_HOST} AS host FROM (SELECT page_id, html, {_NORMAL} AS url FROM pages)) WHERE {_ALLOWED}), {twins.extracted('allowed')},
  one AS (SELECT *, {page_corpus} AS corpus FROM extracted WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY {page_corpus}, sha256(substr(content, 1, 1000)) ORDER BY page_id) = 1),
  ingested AS MATERIALIZED (SELECT corpus, concat(corpus, '/', sha256(url || substr(content, 1, 500))) AS doc_id, url, title, content AS text FROM one),
  {twins.cleaned('ingested', script, tuple(noise), tuple(words))}, {twins.chunked()},
  uniq AS MATERIALIZED (SELECT corpus, concat(doc_id, '_', chunk_index) AS passage_id, url, title, chunk_text, {twins.tokens('chunk_text')} AS terms FROM chunks JOIN ingested USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY corpus, md5({twins.strip('chunk_text')}) ORDER BY doc_id, chunk_index) = 1),
  asked_items AS (SELECT item_id AS question_id, text AS question, {item_corpus} AS corpus FROM benchmark),
  {twins.bm25_in_corpora('uniq', 'asked_items', 20)},
  best AS (SELECT * FROM (SELECT question_id, passage_id, url, title, chunk_text, overlap, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, rank, passage_id) AS rank FROM (
    SELECT h.*, u.url, u.title, u.chunk_text, {overlap} AS overlap FROM hits h JOIN uniq u USING (passage_id) JOIN asked_items USING (question_id))) WHERE rank <= 4),
  packed AS (SELECT *, sum(length(chunk_text)) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM best WHERE {twins.strip('chunk_text')} <> '' QUALIFY total <= 12000),
  context AS (SELECT question_id, md5(string_agg(chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM packed GROUP BY question_id),
  cited AS (SELECT question_id, count(*) AS n_sources, md5(string_agg(concat_ws('|', rank, title, url, {_HOST}, 'web', printf('%.4f', round_even(overlap, 4))), ';' ORDER BY rank)) AS sources_md5 FROM (
    SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY question_id, url ORDER BY rank) = 1) GROUP BY question_id)
  SELECT question_id, coalesce(n, 0) AS n_hits, coalesce(context_md5, md5('')) AS context_md5, n_sources, sources_md5, CASE WHEN n IS NULL THEN {twins.q(pipeline.NO_EVIDENCE)} WHEN context_md5 IS NULL THEN {twins.q(pipeline.NO_CONTEXT)} END AS fallback
  FROM asked_items LEFT JOIN (SELECT question_id, count(*) AS n FROM best GROUP BY question_id) USING (question_id) LEFT JOIN context USING (question_id) LEFT JOIN cited USING (question_id)"""


def _told_pages(found: DataFrame) -> DataFrame:
    entries = F.transform("sources", lambda s: F.concat_ws("|", s["rank"].cast("string"), s["title"], s["url"], s["source"], s["type"], F.format_string("%.4f", s["score"])))
    return found.select("question_id", "n_hits", text.md5_text("context").alias("context_md5"), F.when(F.col("sources").isNotNull(), F.size("sources")).cast("long").alias("n_sources"), text.md5_text(F.array_join(entries, ";")).alias("sources_md5"), "fallback")


@query(_pages_answers("0", "0"))
def answer_pages(spark, sf_dir):
    """From pages as they were fetched to contexts with their sources: benchmark texts as questions over one corpus of all pages."""
    return _told_pages(pipeline.answer_pages(items(spark, sf_dir), table(spark, sf_dir, "pages"), LATIN_ANSWER))


@query(_pages_answers("page_id % 7", "item_id % 7"))
def answer_pages_by_corpus(spark, sf_dir):
    """The same with seven searches: a question sees the pages of its own search only, and their statistics."""
    asked_ = items(spark, sf_dir).withColumn("corpus_id", F.col("question_id") % 7)
    return _told_pages(pipeline.answer_pages(asked_, table(spark, sf_dir, "pages").withColumn("corpus_id", F.col("page_id") % 7), LATIN_ANSWER))


# Pruned searches, streams with state, and counters


@query(_bm25("SELECT * FROM hits"), ranked=True)
def bm25_pruned_topk(spark, sf_dir):
    """The rows of bm25_topk from an inverted index of which only blocks that can hold a hit are read."""
    return postings.search(items(spark, sf_dir), postings.build(lexical.passages(table(spark, sf_dir, "documents"), "doc_id", "text")), 20).hits


@query(f"WITH {_dense('a.vec_id % 50 = 0', 20)} SELECT * FROM dense", ranked=True)
def dense_cells_topk(spark, sf_dir):
    """The rows of dense_topk from a persisted index of cells of which only those that can hold a hit are read."""
    e = table(spark, sf_dir, "embeddings")
    return cells.search(e.where("vec_id % 50 = 0"), cells.build(e), 20).hits


@query("""WITH b AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / 432000) AS BIGINT) AS slice FROM events GROUP BY ALL),
  n AS (SELECT slice, row_number() OVER (ORDER BY slice) AS batch FROM (SELECT DISTINCT slice FROM b)),
  k AS (SELECT user_id, event_type, batch FROM b JOIN n USING (slice)),
  told AS (SELECT user_id, event_type, min(batch) AS batch FROM k GROUP BY ALL),
  later AS (SELECT t.user_id, t.event_type, min(k.batch) AS batch FROM told t JOIN k USING (user_id, event_type) WHERE k.batch > t.batch + 3 GROUP BY ALL)
  SELECT sha256(concat(user_id, '|', event_type)) AS fingerprint, CAST(n.slice * 432000 AS BIGINT) AS at FROM (SELECT * FROM told UNION ALL SELECT * FROM later) JOIN n USING (batch)""")
def stream_unseen_events(spark, sf_dir):
    """The events in micro-batches of five days, each dated by its first day: a user's kind of event is told again once its state is gone, which
    is when the watermark, five days behind, has passed its five days."""
    events = table(spark, sf_dir, "events").select(F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 432_000) * 432_000).alias("ts"), text.sha256_text(F.concat_ws("|", "user_id", "event_type")).alias("fingerprint"))
    stream = state.replay(events, "ts", "5 days", fresh_path(spark, "replay"))
    return state.run_once(state.unseen(stream, "fingerprint", "ts", "5 days"), fresh_path(spark, "stream")).select("fingerprint", F.unix_seconds("ts").alias("at"))


@query("""WITH m AS (SELECT user_id, epoch_ms(ts) AS ms, lag(epoch_ms(ts)) OVER w AS before, lead(epoch_ms(ts)) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  x AS (SELECT user_id, CASE WHEN ms - before < 36000000 THEN 'hit' ELSE 'miss' END AS what FROM m
    UNION ALL SELECT user_id, 'expired' FROM m, (SELECT max(epoch_ms(ts)) AS last FROM events) WHERE after - ms >= 36000000 OR (after IS NULL AND ms + 36000000 <= last - 3600000))
  SELECT user_id, what, count(*) AS n FROM x GROUP BY ALL""")
def stream_lives(spark, sf_dir):
    """Requests of users, as micro-batches of five days, that find their value alive or not; values live for ten hours after the last request."""
    stream = state.replay(table(spark, sf_dir, "events").select("user_id", "ts"), "ts", "5 days", fresh_path(spark, "replay"))
    told = state.run_once(state.lives(stream, "user_id", "ts", 36_000, "1 hour"), fresh_path(spark, "stream"))
    return told.groupBy("user_id", "what").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT page_id, html, {_NORMAL} AS url FROM pages), allowed AS (SELECT * FROM (SELECT *, {_HOST} AS host FROM p) WHERE {_ALLOWED}), {twins.extracted('allowed')},
  valid AS (SELECT * FROM extracted WHERE {_VALID})
  SELECT (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM p WHERE url = '') AS without_url, (SELECT count(*) FROM allowed) AS allowed, (SELECT CAST(sum(length(content)) AS BIGINT) FROM extracted) AS characters,
    (SELECT count(*) FROM extracted WHERE content = '') AS empty, (SELECT count(*) FROM valid) AS valid, (SELECT count(DISTINCT sha256(substr(content, 1, 1000))) FROM valid) AS documents""")
def ingest_counters(spark, sf_dir):
    """What became of all pages, counted by the run that ingests them."""
    counters = pipeline.Counters()
    pipeline.ingest_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), LATIN_ANSWER, counters).write.format("noop").mode("overwrite").save()
    counts = counters.counts()
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


