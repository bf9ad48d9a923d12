"""Registered queries of the document-compliance operators, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import readability as R
from quillspark.functions import similarity as S
from quillspark.functions import text as X
from quillspark.functions import vector as V
from quillspark.operators import chunks, retrieval, search, structure
from quillspark.rules import engine
from quillspark.rules.model import Config
from quillspark.sources import corpus, models

from . import ledger, specimens  # noqa: F401
from .registry import QUERIES, SQL, query, table  # noqa: F401

def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_paragraphs(table(spark, sf_dir, "documents"))


PARAGRAPHS = "p AS (SELECT doc_id, unnest(range(len(l)))::INT AS block_index, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
SQUEEZE = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}\\x0B]+', ' ', 'g'), ' ')"
COUNT = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"
MONTHS = X.MONTHS


@query(
    f"""WITH {PARAGRAPHS},
v AS (SELECT doc_id, block_index, regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:v|ver|version|rev|revision|draft)\\.?\\s*[:#]?\\s*(\\d+(?:\\.\\d+){{0,3}})\\b', 1) AS v FROM p)
SELECT doc_id, count(*)::BIGINT AS n_paragraphs, sum(len(v))::BIGINT AS n_versions, coalesce(string_agg(CASE WHEN len(v) > 0 THEN array_to_string(v, ',') END, ',' ORDER BY block_index), '') AS versions,
       sum(len(v)) > 0 AS passed FROM v GROUP BY doc_id"""
)
def version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions stated anywhere in a document, in order (rule 4's scan)."""
    rows = paragraphs(spark, sf_dir).withColumn("v", X.find_versions(F.col("text")))
    hits = F.collect_list(F.when(F.size("v") > 0, F.struct("block_index", F.array_join("v", ",").alias("s"))))
    listed = F.array_join(F.transform(F.array_sort(hits), lambda h: h["s"]), ",")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.size("v")).cast("long").alias("n_versions"), listed.alias("versions"), (F.sum(F.size("v")) > 0).alias("passed"))


@query(
    """WITH f AS (SELECT d.source, l.quality = 1 AS passed, CASE WHEN l.toxic = 1 THEN 'error' ELSE 'warning' END AS severity FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*)::BIGINT AS total, count_if(passed)::BIGINT AS passed, count_if(NOT passed)::BIGINT AS failed, count_if(passed IS NULL)::BIGINT AS not_evaluated,
       count_if(NOT passed AND severity = 'error')::BIGINT AS errors, count_if(NOT passed AND severity = 'warning')::BIGINT AS warnings FROM f GROUP BY source"""
)
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued verdict counts of a source: labelled quality as the verdict, unlabelled documents not evaluated."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    severity = F.when(F.col("toxic") == 1, F.lit("error")).otherwise(F.lit("warning"))
    found = docs.join(labels, "doc_id", "left").select("source", (F.col("quality") == 1).alias("passed"), severity.alias("severity"))
    return structure.verdict_summary(found, ["source"])


@query(
    """SELECT page_id, regexp_replace(coalesce(url, ''), '\\.[A-Za-z0-9]{1,5}$', '') AS stem,
       replace(lower(trim(regexp_replace(coalesce(url, ''), '[\\s\\x0B._\\-/\\\\]+', ' ', 'g'), ' ')), 'ß', 'ss') AS key FROM pages"""
)
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-name stem and comparison key of every url (F1, F2)."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_extension(F.col("url")).alias("stem"), X.normalize_key(F.col("url")).alias("key"))


@query(
    f"""WITH {PARAGRAPHS}, s AS (SELECT doc_id, block_index, text, {SQUEEZE.format('text')} AS s FROM p)
SELECT doc_id, block_index, CASE WHEN s = '' THEN '(empty paragraph)' WHEN length(s) > 90 THEN '“' || rtrim(substr(s, 1, 89)) || '…”' ELSE '“' || s || '”' END AS snippet,
       ({COUNT.format('s')})::BIGINT AS n_words, (({COUNT.format('s')} * 4 + 2) // 3)::BIGINT AS n_tokens FROM s"""
)
def paragraph_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippet, word count and token estimate of every paragraph."""
    x = F.col("text")
    return paragraphs(spark, sf_dir).select("doc_id", "block_index", X.snippet(x).alias("snippet"), X.word_count(x).alias("n_words"), X.estimate_tokens(x).alias("n_tokens"))


PLAIN = "trim(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), ' ')"
DIGITS = "list_sort(list_distinct(list_transform(regexp_extract_all({0}, '\\d+'), lambda r: CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END)))"


@query(
    f"""WITH t AS (SELECT page_id, coalesce(url, '') AS url, {PLAIN.format("regexp_extract(coalesce(html, ''), '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title FROM pages),
d AS (SELECT *, {DIGITS.format('url')} AS a, {DIGITS.format('title')} AS b FROM t)
SELECT page_id, title, array_to_string(a, ',') AS url_digits, array_to_string(b, ',') AS title_digits, len(a) > 0 AND len(b) > 0 AND a <> b AS conflict FROM d"""
)
def digit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do a page's url and title hold different numbers?"""
    rows = corpus.page_titles(table(spark, sf_dir, "pages"))
    u, t = F.coalesce("url", F.lit("")), F.col("title")
    return rows.select("page_id", "title", F.array_join(X.digit_set(u), ",").alias("url_digits"), F.array_join(X.digit_set(t), ",").alias("title_digits"), X.digits_conflict(u, t).alias("conflict"))


@query(
    f"""WITH h AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)(<h[1-6]\\b[^>]*>.*?)</h[1-6]>', 1) AS t FROM pages),
r AS (SELECT page_id, unnest(range(len(t)))::BIGINT AS ord, unnest(t) AS tag FROM h)
SELECT page_id, ord, substr(tag, 3, 1)::BIGINT AS level, {PLAIN.format('tag')} AS text FROM r"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared headings of every page."""
    return corpus.page_headings(table(spark, sf_dir, "pages"))


TURNS = "t AS (SELECT conv_id AS doc_id, turn AS block_index, text, CASE WHEN role = 'user' THEN (turn // 2) % 3 + 1 END AS level FROM conversations)"


@query(
    f"""WITH {TURNS} SELECT doc_id, block_index, level, (row_number() OVER w - 1)::BIGINT AS flow_pos,
       max(CASE WHEN level IS NOT NULL THEN block_index END) OVER (w ROWS UNBOUNDED PRECEDING) AS section FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)"""
)
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow position and nearest heading at or before, of every turn."""
    rows = structure.flow_positions(corpus.turns(table(spark, sf_dir, "conversations")))
    return structure.with_section(rows).select("doc_id", "block_index", "level", "flow_pos", "section")


@query(
    f"""WITH {TURNS}, r AS (SELECT h.doc_id, h.block_index, h.level, (SELECT min(n.block_index) FROM t n WHERE n.doc_id = h.doc_id AND n.block_index > h.block_index AND n.level <= h.level) AS until FROM t h WHERE h.level IS NOT NULL)
SELECT r.doc_id, r.block_index AS heading, r.level, r.until, count(b.block_index)::BIGINT AS n_blocks FROM r LEFT JOIN t b ON b.doc_id = r.doc_id AND b.block_index > r.block_index AND (r.until IS NULL OR b.block_index < r.until)
GROUP BY ALL"""
)
def blocks_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks strictly between a heading and the next of its or a higher level."""
    rows = corpus.turns(table(spark, sf_dir, "conversations"))
    ranges = structure.heading_ranges(rows, 3)
    held = structure.between(ranges, rows).groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n_blocks"))
    out = ranges.withColumnRenamed("block_index", "heading").join(held, ["doc_id", "heading"], "left")
    return out.select("doc_id", "heading", "level", "until", F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))


@query(
    """WITH t AS (SELECT conv_id AS doc_id, turn AS block_index, role = 'user' AS a, regexp_matches(coalesce(text, ''), '\\d|!|\\?|;') AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
n AS (SELECT s.doc_id, s.block_index, s.pos, p.pos AS near, row_number() OVER (PARTITION BY s.doc_id, s.block_index ORDER BY abs(p.pos - s.pos), p.pos) AS k FROM t s JOIN t p ON p.doc_id = s.doc_id AND abs(p.pos - s.pos) <= 4 AND p.g WHERE s.a)
SELECT t.doc_id, t.block_index, t.pos::BIGINT AS flow_pos, n.near::BIGINT AS nearest FROM t LEFT JOIN n ON t.doc_id = n.doc_id AND t.block_index = n.block_index AND n.k = 1 WHERE t.a"""
)
def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user turn the closest turn with a digit or mark within four positions."""
    rows = corpus.turns(table(spark, sf_dir, "conversations"))
    return structure.nearest_within(rows, F.col("level").isNotNull(), F.coalesce("text", F.lit("")).rlike(r"\d|!|\?|;"), 4)


@query(
    """WITH s AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS cents, min(event_id) AS f FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, f) AS n FROM s) SELECT user_id, event_type, cents FROM k WHERE n = 1"""
)
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type with the most value, of every user; ties go to the one seen first (A1)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.expr("floor(value * 100 + 0.5)").cast("long").alias("cents"))
    return structure.weighted_mode(rows, ["user_id"], "event_type", "cents", "event_id")


@query("SELECT event_id, user_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), false) AS earlier FROM events WHERE ts IS NOT NULL")
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose date is before the previous one's."""
    return structure.out_of_order(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "event_id", "ts").drop("ts")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write of each key wins (U4s)."""
    rows = table(spark, sf_dir, "events")
    return structure.latest(rows, ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id", "value")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ins_ord"), "embedding", "label")


DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"
COSINE = f"{DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}))"


@query(
    f"""WITH q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, b FROM embeddings, q),
c AS (SELECT id, {COSINE} AS score FROM s) SELECT id, round(score, 9) AS score FROM c ORDER BY c.score DESC, id LIMIT 10"""
)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the first one (O3): a top-k report."""
    store = _store(spark, sf_dir)
    first = store.orderBy("id").select("embedding").first()
    return search.top_k(store, F.array(*[F.lit(float(x)) for x in first[0]]), 10).select("id", F.round("score", 9).alias("score"))


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, embedding::DOUBLE[] AS a, b FROM embeddings, q),
c AS (SELECT query_id, id, {COSINE} AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) SELECT query_id, rank, id, round(score, 9) AS score FROM r WHERE rank <= 5"""
)
def cosine_top_k_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against the whole store, five answers each."""
    store = _store(spark, sf_dir)
    asked = store.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_each(store, asked, 5).withColumn("score", F.round("score", 9))


@query("SELECT label, count(*)::BIGINT AS n, count_if(len(embedding) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 AND len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0)::BIGINT AS n_valid FROM embeddings GROUP BY label")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right dimension, finite and not zero (P20)."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.is_valid(F.col("embedding"), 64)).alias("n_valid"))


VOWEL = f"[{R.VOWELS}]"


@query(
    f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::BIGINT AS n_sentences,
  list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '{VOWEL}+')) - CASE WHEN regexp_matches(x, '[^{R.VOWELS}]e$') AND len(regexp_extract_all(x, '{VOWEL}+')) > 1 THEN 1 ELSE 0 END, 1)) AS y FROM w),
c AS (SELECT *, coalesce(list_sum(y), 0)::BIGINT AS n_syllables, len(list_filter(y, lambda v: v >= 3))::BIGINT AS n_complex FROM s)
SELECT doc_id, n_words, n_sentences, n_syllables, n_complex, CASE WHEN n_words > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (n_words / n_sentences) - 84.6::DOUBLE * (n_syllables / n_words), 6) END AS flesch,
  CASE WHEN n_words > 0 THEN round(0.4::DOUBLE * (n_words / n_sentences + 100.0::DOUBLE * (n_complex / n_words)), 6) END AS fog FROM c"""
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flesch reading ease and Gunning fog of every document (F-R, rule 12)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", R.sentences(F.col("text")).alias("n_sentences"), F.transform(R.words(F.col("text")), R.syllables).alias("y"))
    rows = rows.withColumns({"n_words": F.size("y").cast("long"), "n_syllables": F.aggregate("y", F.lit(0).cast("long"), lambda s, v: s + v), "n_complex": F.size(F.filter("y", lambda v: v >= 3)).cast("long")})
    w, s = F.col("n_words"), F.col("n_sentences")
    some = lambda x: F.when(w > 0, F.round(x, 6))
    return rows.select("doc_id", "n_words", "n_sentences", "n_syllables", "n_complex", some(R.flesch(w, s, F.col("n_syllables"))).alias("flesch"), some(R.fog(w, s, F.col("n_complex"))).alias("fog"))


@query(
    f"""WITH {PARAGRAPHS}, w AS (SELECT doc_id, block_index, string_split({SQUEEZE.format('text')}, ' ') AS w FROM p WHERE {SQUEEZE.format('text')} <> ''),
k AS (SELECT doc_id, block_index, w, unnest(range((len(w) - 1) // 375 + 1)) AS piece FROM w)
SELECT doc_id, block_index, piece, md5(array_to_string(w[piece * 375 + 1 : piece * 375 + 375], ' ')) AS text_md5, len(w[piece * 375 + 1 : piece * 375 + 375])::BIGINT AS n_words FROM k"""
)
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs cut at 375 words, the most that 500 estimated tokens hold."""
    return chunks.word_pieces(paragraphs(spark, sf_dir)).select("doc_id", "block_index", "piece", F.md5("text").alias("text_md5"), X.word_count(F.col("text")).alias("n_words"))


@query(
    f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, block_index, regexp_extract_all(text, '\\b\\d{{4}}[/\\-.]\\d{{1,2}}[/\\-.]\\d{{1,2}}\\b') AS a, regexp_extract_all(text, '\\b\\d{{1,2}}[/\\-.]\\d{{1,2}}[/\\-.]\\d{{2,4}}\\b') AS b,
 regexp_extract_all(text, '(?i)\\b\\d{{1,2}}\\s+(?:{MONTHS})\\.?,?\\s+\\d{{2,4}}\\b') AS c, regexp_extract_all(text, '(?i)\\b(?:{MONTHS})\\.?\\s+\\d{{1,2}},?\\s+\\d{{2,4}}\\b') AS e, text FROM p),
u AS (SELECT doc_id, block_index, list_distinct(list_concat(a, b, c, e)) AS f, text FROM d)
SELECT doc_id, block_index, array_to_string(list_transform(list_sort(list_transform(f, lambda s: {{'at': strpos(text, s), 's': s}})), lambda x: x.s), '|') AS dates FROM u"""
)
def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-like strings of every paragraph."""
    return paragraphs(spark, sf_dir).select("doc_id", "block_index", F.array_join(X.date_strings(F.col("text")), "|").alias("dates"))


@query(
    """SELECT source, lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars, avg(n_chars)::DOUBLE AS mean_chars, grouping(source, lang)::BIGINT AS level
FROM documents GROUP BY ROLLUP (source, lang)"""
)
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by source and language, with totals."""
    rows = table(spark, sf_dir, "documents").rollup("source", "lang")
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.avg("n_chars").alias("mean_chars"), F.grouping_id("source", "lang").cast("long").alias("level"))


@query()
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised title against first heading and url of every page."""
    rows = corpus.page_titles(table(spark, sf_dir, "pages"))
    title, heading, name = X.normalize_title(F.col("title")), X.normalize_title(F.col("heading")), X.normalize_filename(F.col("url"))
    rows = rows.select("page_id", title.alias("title"), heading.alias("heading"), name.alias("name"))
    return rows.select("page_id", "title", "heading", S.similarity("title", "heading").alias("heading_score"), S.similarity("title", "name").alias("name_score"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval chunks of all conversations: user turns are headings."""
    rows = corpus.turns(table(spark, sf_dir, "conversations"))
    w = Window.partitionBy("doc_id").orderBy("block_index")
    clean = rows.withColumn("text", X.squeeze(F.col("text"))).filter("text <> ''").withColumn("ord", F.row_number().over(w))
    records = clean.select("doc_id", "ord", "text", "block_index", F.format_string("Paragraph %d", "block_index").alias("location"), F.lit("paragraph").alias("kind"), "level", F.lit(None).cast("long").alias("table_index"))
    return chunks.chunk_records(records)


@query(
    """SELECT page_id AS doc_id, 10 AS rule_id, n > 0 AS passed, concat('Sections: ', n) AS message
FROM (SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?is)<h[1-6]\\b[^>]*>\\s*[^<\\s].*?</h[1-6]>')) AS n FROM pages)"""
)
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule 10 over all pages: is there any heading."""
    found = engine.evaluate(models.page_model(table(spark, sf_dir, "pages")), Config(), [10])
    return found.select("doc_id", "rule_id", "passed", "message")


@query(
    """WITH f AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<footer\\b[^>]*>(.*?)</footer>', 1), lambda x: true) AS f FROM pages),
t AS (SELECT page_id, list_transform(f, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS t FROM f),
h AS (SELECT page_id, t, len(list_filter(t, lambda x: regexp_matches(x, '\\b[A-Z]{2,}[-_/][A-Z0-9]+(?:[-_/][A-Z0-9]+)*\\b'))) > 0 AS id,
  len(list_filter(t, lambda x: regexp_matches(lower(x), 'confidential|internal use only|proprietary|restricted'))) > 0 AS mark,
  len(list_filter(t, lambda x: regexp_matches(x, '(?i)\\bpage\\s+\\d+\\b') OR regexp_matches(x, '(?m)^[ \\t]*[-–]?[ \\t]*\\d{1,4}[ \\t]*[-–]?[ \\t]*$'))) > 0 AS typed FROM t)
SELECT page_id AS doc_id, 11 AS rule_id, false AS passed FROM h UNION ALL SELECT page_id, 13, id OR mark OR typed FROM h"""
)
def page_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules 11 and 13 over all pages: page fields and details of footers."""
    return engine.evaluate(models.page_model(table(spark, sf_dir, "pages")), Config(), [11, 13]).select("doc_id", "rule_id", "passed")


@query()
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen rules over all pages."""
    return engine.evaluate(models.page_model(table(spark, sf_dir, "pages")))


@query()
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts of all thirteen rules for every document."""
    return engine.summary(engine.evaluate(models.text_model(table(spark, sf_dir, "documents"))))


@query()
def rule_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a judge would get for each rule and conversation: top chunks by hashed embeddings."""
    rows = document_chunks(spark, sf_dir).withColumn("source", F.col("doc_id").cast("string")).withColumn("embedding", retrieval.hashed_embedding(F.col("text")))
    asked = retrieval.questions(spark).withColumn("embedding", retrieval.hashed_embedding(F.col("question"))).drop("question")
    return retrieval.context(retrieval.retrieve(rows, asked), ["doc_id", "rule_id"])
