"""Registered queries of the thirteen rules and their parts over documents made of ``events``, with DuckDB SQL of the same results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates as D
from quillspark.functions import text as X
from quillspark.operators import structure
from quillspark.rules import engine
from quillspark.rules.checker import word_checker
from quillspark.rules.model import Config, Model
from quillspark.sources import models

from .registry import query, table

CONFIG = Config(now=datetime(2026, 12, 1), required_sections=("Purpose", "Revision History"), checker=word_checker({"teh": ["the"]}))

#: The same documents in SQL: users, e (events in order), p (paragraphs outside tables), c (cells), f (all paragraphs in flow).
MODEL = """e AS (SELECT user_id AS u, event_id, ts, event_type AS y, value AS v, (props->>'$.k')::INT AS k,
  10 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, strftime(ts, '%d %b %Y') AS day FROM events),
users AS (SELECT DISTINCT u FROM e),
p AS (SELECT u, b, k, y, CASE WHEN y = 'click' THEN k % 3 + 1 END AS level, CASE y WHEN 'click' THEN CASE k WHEN 5 THEN 'Revision History' WHEN 1 THEN '1. Purpose' ELSE 'Section ' || k END
  WHEN 'view' THEN CASE WHEN k % 10 = 0 THEN 'This is version 2.' || k || ' of the record.' WHEN k = 3 THEN 'Author: Kim West' WHEN k = 13 THEN 'The team reads teh record again each week.' ELSE 'The team keeps the record of step ' || k || ' and reads it again each week.' END
  ELSE CASE WHEN k % 5 = 0 THEN 'Approved by:' WHEN k % 2 = 0 THEN 'Approved by: Sam Lake ' || day ELSE 'Approved by: Sam Lake' END END AS text FROM e WHERE y NOT IN ('purchase', 'signup')),
r AS (SELECT u, CASE y WHEN 'purchase' THEN 0 ELSE 1 END AS t, n AS r, b AS spot, CASE y WHEN 'purchase' THEN ['1.' || n, CASE WHEN v > 95 THEN 'not yet' WHEN v < 1 THEN strftime(ts, '%d %b') || ' 2030' ELSE day END, CASE WHEN k % 2 = 0 THEN 'Robin Field' ELSE 'user' END, 'change ' || k]
  ELSE [CASE WHEN k % 2 = 1 THEN 'Sam Lake' ELSE '' END, 'Officer', CASE WHEN k % 3 > 0 THEN day ELSE '' END] END AS x FROM e WHERE y IN ('purchase', 'signup')
  UNION ALL SELECT u, CASE y WHEN 'purchase' THEN 0 ELSE 1 END, 0, b - 5, CASE WHEN y = 'signup' THEN ['Name', 'Role', 'Date'] WHEN u % 7 = 0 THEN ['Item', 'Name', 'Note', 'Value'] ELSE ['Version', 'Date', 'Author', 'Description'] END FROM e WHERE y IN ('purchase', 'signup') AND n = 1),
c AS (SELECT u, t, r, spot, unnest(range(len(x)))::INT AS c, unnest(x) AS text FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY b) - 1 AS pos FROM (SELECT u, b, text, level, y, k, NULL::INT AS t, NULL::INT AS r, NULL::INT AS c FROM p UNION ALL SELECT u, spot + c, text, NULL, NULL, NULL, t, r, c FROM c)),
rev AS (SELECT DISTINCT u FROM r WHERE t = 0 AND u % 7 <> 0)"""
TAIL = "SELECT users.u AS doc_id, {} AS passed{} FROM users"


def events_model(spark: SparkSession, sf_dir: str) -> Model:
    return models.event_model(table(spark, sf_dir, "events"))


def one_rule(number: int, name: str, doc: str, ctes: str, passed: str, joins: str = "", message: str = "") -> None:
    """Registers a rule's verdicts, with its message where SQL spells it out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine.evaluate(events_model(spark, sf_dir), CONFIG, [number]).select("doc_id", "passed", *["message"] * bool(message))

    run.__name__, run.__doc__ = f"rule_{number:02d}_{name}", doc
    query(f"WITH {MODEL}, {ctes} {TAIL.format(passed, f', {message} AS message' if message else '')} {joins}")(run)


one_rule(1, "title", "Title and file name (R1): a title that is the file name's passes, one with another number doesn't.",
         "t AS (SELECT u, 'Account ' || u || CASE WHEN u % 5 = 0 THEN ' v2.10' ELSE '' END AS file, CASE u % 3 WHEN 0 THEN 'Account ' || u WHEN 1 THEN 'Account ' || (u + 1) END AS title FROM users)",
         "coalesce(lower(t.title) = lower(regexp_replace(t.file, ' v[0-9.]+$', '')), false)", "JOIN t USING (u)")
one_rule(2, "author", "Author (R2): properties, lines among the first 25 paragraphs, the author column of the revision table.",
         "l AS (SELECT DISTINCT u FROM f WHERE pos < 25 AND text LIKE 'Author: %'), a AS (SELECT DISTINCT u FROM c JOIN rev USING (u) WHERE t = 0 AND c = 2 AND r > 0 AND text <> 'user')",
         "users.u % 4 = 1 OR l.u IS NOT NULL OR a.u IS NOT NULL", "LEFT JOIN l USING (u) LEFT JOIN a USING (u)")
one_rule(3, "revision_dates", "Revision dates (R3): all are dates, none in the future, none before the one above.",
         """d AS (SELECT u, r, text, try_strptime(text, '%d %b %Y') AS day FROM c JOIN rev USING (u) WHERE t = 0 AND c = 1 AND r > 0),
w AS (SELECT u, r, day < lag(day) OVER (PARTITION BY u ORDER BY r) AS early FROM d WHERE day IS NOT NULL),
o AS (SELECT u, count_if(day IS NULL OR day > TIMESTAMP '2026-12-02' OR coalesce(early, false)) AS bad FROM d LEFT JOIN w USING (u, r) GROUP BY u)""",
         "coalesce(o.bad = 0, false)", "LEFT JOIN o USING (u)", "CASE WHEN o.bad IS NULL THEN 'No revision dates are recorded.' WHEN o.bad > 0 THEN o.bad || ' revision dates have problems.' ELSE 'Revision dates are in order.' END")
one_rule(4, "version", "Version (R4): the file name's is stated, or there is one at all.",
         "s AS (SELECT u, list(DISTINCT regexp_extract(text, 'version (2\\.\\d+)', 1)) AS v FROM p WHERE text LIKE 'This is version%' GROUP BY u)",
         "CASE WHEN users.u % 5 = 0 THEN coalesce(list_contains(s.v, '2.10'), false) ELSE s.u IS NOT NULL OR rev.u IS NOT NULL END", "LEFT JOIN s USING (u) LEFT JOIN rev USING (u)")
one_rule(5, "revision_section", "Revision history (R5): a filled table beneath the heading; without a heading the revision table.",
         """h AS (SELECT u, min(b) AS spot, arg_min(level, b) AS level FROM p WHERE y = 'click' AND k = 5 GROUP BY u), n AS (SELECT h.u, min(p.b) AS until FROM h JOIN p ON p.u = h.u AND p.y = 'click' AND p.b > h.spot AND p.level <= h.level GROUP BY h.u),
b AS (SELECT h.u, bool_or(m.spot > h.spot AND (n.until IS NULL OR m.spot < n.until)) AS below FROM h LEFT JOIN n USING (u) LEFT JOIN (SELECT u, t, min(spot) - 1 AS spot FROM r WHERE r = 0 GROUP BY u, t) m ON m.u = h.u GROUP BY h.u)""",
         "CASE WHEN b.u IS NOT NULL THEN coalesce(b.below, false) ELSE rev.u IS NOT NULL END", "LEFT JOIN b USING (u) LEFT JOIN rev USING (u)")
one_rule(6, "signatures", "Signature blocks (R6): lines with more than their label, filled names of signature tables.",
         "s AS (SELECT u, count(*) AS n FROM (SELECT u FROM p WHERE y = 'error' AND k % 5 > 0 UNION ALL SELECT u FROM c WHERE t = 1 AND r > 0 AND c = 0 AND text <> '') GROUP BY u)", "s.u IS NOT NULL", "LEFT JOIN s USING (u)",
         "coalesce('Signature blocks: ' || s.n, 'There is no signature block.')")
SIGNED = """d AS (SELECT f.*, regexp_extract(text, '\\d{2} [A-Z][a-z]{2} \\d{4}') AS day, t = 0 AND u IN (SELECT u FROM rev) AS past FROM f),
a AS (SELECT u, pos, t, r FROM d WHERE y = 'error' UNION ALL SELECT u, pos, t, r FROM d WHERE t = 1 AND r > 0 AND c = 0 AND text <> ''),
g AS (SELECT a.u, a.pos, bool_or(d.day <> '' AND (d.pos = a.pos OR (d.t = a.t AND d.r = a.r) OR (abs(d.pos - a.pos) <= 4 AND NOT coalesce(d.past, false)))) AS dated FROM a JOIN d ON d.u = a.u GROUP BY a.u, a.pos),
s AS (SELECT u, count(*) AS n, count_if(dated) AS dated FROM g GROUP BY u)"""
one_rule(7, "signature_dates", "Signature dates (R7): each block has a date in its text, its row, or within four paragraphs outside the revision table (J6, J7, W3).", SIGNED, "coalesce(s.n = s.dated, false)", "LEFT JOIN s USING (u)",
         "coalesce(s.dated || ' of ' || s.n || ' signature blocks have a date near them.', 'There is no signature block to be dated.')")
one_rule(8, "formatting", "Formatting (R8): body text from the first heading on has the usual size (A1, A2, P4, F18).",
         """h AS (SELECT u, min(b) AS start FROM p WHERE y = 'click' GROUP BY u), w AS (SELECT p.*, CASE WHEN y = 'view' AND k = 7 THEN 14.0 ELSE 11.0 END AS size FROM p LEFT JOIN h USING (u) WHERE y <> 'click' AND (h.start IS NULL OR b >= h.start) AND len(string_split(text, ' ')) >= 3),
z AS (SELECT u, arg_max(size, (chars, -first)) AS usual FROM (SELECT u, size, sum(length(text)) AS chars, min(b) AS first FROM w GROUP BY u, size) GROUP BY u), q AS (SELECT u, count(*) AS n, count_if(abs(size - usual) > 0.5) AS odd FROM w JOIN z USING (u) GROUP BY u)""",
         "coalesce(q.n >= 3 AND q.odd = 0, false)", "LEFT JOIN q USING (u)", "CASE WHEN q.n >= 3 THEN q.odd || ' of ' || q.n || ' paragraphs differ from the usual style.' ELSE 'There is too little body text to compare.' END")
one_rule(9, "language", "Language (R9) with the sample checker: no known misspelling in paragraphs of four words and more (P6, P15, O4).",
         "q AS (SELECT u, count_if(text LIKE '% teh %') AS typos FROM p WHERE y <> 'click' AND len(string_split(text, ' ')) >= 4 GROUP BY u)", "coalesce(q.typos = 0, false)", "LEFT JOIN q USING (u)",
         "coalesce('Language issues: ' || least(q.typos, 50), 'No paragraph is long enough to check.')")
one_rule(10, "sections", "Required sections (R10, J10): by the whole key or by its beginning, numbers left out.",
         "q AS (SELECT u, list_filter(['Purpose', 'Revision History'], lambda x: NOT list_contains(heads, x)) AS missing FROM (SELECT users.u, list(regexp_replace(text, '^1[.] ', '')) AS heads FROM users LEFT JOIN p ON p.u = users.u AND y = 'click' GROUP BY users.u))",
         "len(q.missing) = 0", "JOIN q USING (u)", "CASE WHEN len(q.missing) = 0 THEN 'All required sections are there.' ELSE 'Missing sections: ' || array_to_string(q.missing, ', ') END")
one_rule(11, "page_numbers", "Page numbers (R11, P13, P14): a field, and none typed in.",
         "q AS (SELECT u, CASE u % 4 WHEN 1 THEN 'QA-SOP-' || u || ' Confidential' WHEN 2 THEN 'Page 3' WHEN 3 THEN 'kept by the office' END AS foot, u % 4 = 1 AS page FROM users)",
         "q.foot IS NOT NULL AND q.page AND NOT (NOT q.page AND regexp_matches(q.foot, '(?i)\\bpage\\s+\\d+\\b'))", "JOIN q USING (u)")
SYLLABLES = "greatest(len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^aeiouy]e$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)"
one_rule(12, "readability", "Readability (R12, P5, A9): enough words, Flesch and fog within the limits.",
         f"""w AS (SELECT u, regexp_extract_all(lower(text), '[a-z]+') AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM p WHERE y <> 'click' AND len(string_split(text, ' ')) >= 3),
y AS (SELECT u, s, len(w) AS n, list_sum(list_transform(w, lambda x: {SYLLABLES})) AS y, len(list_filter(w, lambda x: {SYLLABLES} >= 3)) AS h FROM w),
q AS (SELECT u, sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s, sum(y)::DOUBLE AS y, sum(h)::DOUBLE AS h FROM y GROUP BY u)""",
         "coalesce(q.n >= 50 AND round(206.835 - 1.015 * (q.n / q.s) - 84.6 * (q.y / q.n), 1) >= 30 AND round(0.4 * (q.n / q.s + 100 * (q.h / q.n)), 1) <= 18, false)", "LEFT JOIN q USING (u)")
one_rule(13, "footer_details", "Footer details (R13, A10): a document number, a marking or a page number in a footer.",
         "q AS (SELECT u, CASE u % 4 WHEN 1 THEN 'QA-SOP-' || u || ' Confidential' WHEN 2 THEN 'Page 3' WHEN 3 THEN 'kept by the office' END AS foot FROM users)",
         "coalesce(regexp_matches(q.foot, '[A-Z]{2,}-[A-Z0-9]+') OR contains(lower(q.foot), 'confidential') OR regexp_matches(q.foot, '(?i)page \\d+'), false)", "JOIN q USING (u)")


@query(f"""WITH {MODEL}, n AS (SELECT u, count(*) AS paragraphs, count_if(text <> '') AS filled, count_if(level IS NOT NULL) AS headings FROM f GROUP BY u), t AS (SELECT u, count(*) AS tables, max(r) AS longest FROM (SELECT u, t, max(r) + 1 AS r FROM r GROUP BY u, t) GROUP BY u)
SELECT users.u AS doc_id, n.paragraphs::BIGINT AS n_paragraphs, n.filled::BIGINT AS n_filled, n.headings::BIGINT AS n_headings, coalesce(t.tables, 0)::BIGINT AS n_tables, coalesce(t.longest, 0)::BIGINT AS longest_table, (users.u % 4 > 0)::BIGINT AS n_footers, (users.u % 4 = 1)::BIGINT AS n_fields
FROM users JOIN n USING (u) LEFT JOIN t USING (u)""")
def extraction_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document holds (A6): an aggregate per child table."""
    return structure.digest(events_model(spark, sf_dir)).select("doc_id", "n_paragraphs", "n_filled", "n_headings", "n_tables", "longest_table", "n_footers", "n_fields")


@query(f"""WITH {MODEL} SELECT u AS doc_id, t AS table_index, count(*)::BIGINT AS n_rows, max(CASE WHEN r = 0 THEN len(x) END)::BIGINT AS n_columns, max(CASE WHEN r = 0 THEN array_to_string(x, ' | ') END) AS first_row FROM r GROUP BY u, t""")
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and header of each table."""
    return structure.table_shapes(events_model(spark, sf_dir).cells)


@query(f"""WITH {MODEL} SELECT u AS doc_id, b AS block_index, pos::BIGINT AS flow_pos, CASE WHEN length(text) > 20 THEN rtrim(substr(text, 1, 19)) || '…' ELSE text END AS shown FROM f WHERE pos < 20""")
def paragraph_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 paragraphs of each document, cut (O5, P23): a report whose limit is its purpose."""
    return structure.first_paragraphs(events_model(spark, sf_dir).flow(), 20, 20)


@query(f"""WITH {MODEL}, s AS (SELECT u, b, y, text, max(CASE WHEN level IS NOT NULL THEN b END) OVER (PARTITION BY u ORDER BY b ROWS UNBOUNDED PRECEDING) AS h FROM p)
SELECT s.u AS doc_id, s.b AS block_index, 'Paragraph ' || s.b || CASE WHEN p.text IS NULL THEN '' ELSE ', under “' || p.text || '”' END || ' — “' || s.text || '”' AS place FROM s LEFT JOIN p ON p.u = s.u AND p.b = s.h WHERE s.y = 'error'""")
def signature_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where signature lines stand: location, section and snippet (F-H, J2, F14, P7)."""
    m = events_model(spark, sf_dir)
    rows = structure.with_section_text(m.paragraphs.filter("not in_table")).filter("level is null and text like 'Approved by%'")
    return rows.select("doc_id", "block_index", X.locator(F.col("location"), F.col("section_text"), F.col("text")).alias("place"))


@query("""SELECT p_partkey, 'sop ' || p_partkey || ' ' || lower(p_name) AS key, 'Scope of ' || p_name AS heading, [p_size || '.1', p_size || '.10'] AS versions, p_size || '.10' AS newest, CASE WHEN p_size % 2 = 0 THEN p_size || '.2' END AS cell,
  TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_size % 28) AS day, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b and c' END AS listed, 'Kim West' AS person FROM part""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, headings, versions, dates and lists spelled from parts, taken apart again."""
    n, name = F.col("p_size"), F.col("p_name")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    found = X.find_versions(text("Version ", n, ".1 and rev. ", n, ".10"))
    day = text(n % 28 + 1, " January 2024")
    listed = F.when(n % 3 == 0, F.array(F.lit("a"))).when(n % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    newest = F.array_max(F.transform(found, lambda v: F.struct(X.version_key(v).alias("k"), v.alias("v"))))["v"]
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", X.normalize_filename(text("SOP-", F.col("p_partkey"), " ", name, " v", n, ".1 filled (2).docx")).alias("key"), X.strip_leading_number(text(n, ".2 Scope of ", name)).alias("heading"), found.alias("versions"), newest.alias("newest"),
        X.version_cell(F.when(n % 2 == 0, text("v", n, ".2")).otherwise("about 3")).alias("cell"), D.parse_date(day).alias("day"), X.phrase(listed).alias("listed"), X.person_name(F.lit("Kim West / QA")).alias("person"),
    )
    return rows


@query(f"""WITH {MODEL}, h AS (SELECT u, b, text FROM p WHERE y = 'click'),
o AS (SELECT p.u, p.b, p.text, 'Paragraph ' || p.b AS spot, max(h.b) AS hb FROM p LEFT JOIN h ON h.u = p.u AND h.b <= p.b WHERE p.y = 'error' AND p.k % 5 > 0 GROUP BY ALL),
l AS (SELECT o.u, list(o.spot || CASE WHEN h.text IS NULL THEN '' ELSE ', under “' || h.text || '”' END || ' — “' || o.text || '”' ORDER BY o.b) AS s, list(o.spot ORDER BY o.b) AS spots FROM o LEFT JOIN h ON h.u = o.u AND h.b = o.hb GROUP BY o.u),
n AS (SELECT u, list('Table 2, row ' || (r + 1) || ': ' || text ORDER BY r) AS s, list('Table 2, row ' || (r + 1) ORDER BY r) AS spots FROM c WHERE t = 1 AND r > 0 AND c = 0 AND text <> '' GROUP BY u),
d AS (SELECT u, r, text, try_strptime(text, '%d %b %Y') AS day FROM c JOIN rev USING (u) WHERE t = 0 AND c = 1 AND r > 0), w AS (SELECT u, r, day < lag(day) OVER (PARTITION BY u ORDER BY r) AS early FROM d WHERE day IS NOT NULL),
g AS (SELECT u, list(CASE WHEN day IS NULL THEN 'not a date: ' WHEN day > TIMESTAMP '2026-12-02' THEN 'in the future: ' WHEN early THEN 'out of order: ' ELSE '' END || text ORDER BY r) AS s FROM d LEFT JOIN w USING (u, r) GROUP BY u),
k AS (SELECT e.u, min(e.b) - 6 AS block FROM e JOIN rev USING (u) WHERE y = 'purchase' GROUP BY e.u), kh AS (SELECT k.u, arg_max(h.text, h.b) AS head FROM k LEFT JOIN h ON h.u = k.u AND h.b <= k.block GROUP BY k.u),
q AS (SELECT u, list(text ORDER BY b) AS s, max(CASE WHEN text = '1. Purpose' THEN b END) AS x, max(CASE WHEN text = 'Revision History' THEN b END) AS z FROM h GROUP BY u),
z AS (SELECT u, CASE u % 4 WHEN 1 THEN 'QA-SOP-' || u || ' Confidential' WHEN 2 THEN 'Page 3' WHEN 3 THEN 'kept by the office' END AS foot FROM users)
SELECT users.u AS doc_id, 3::INT AS rule_id, coalesce(g.s, []) AS evidence, CASE WHEN g.u IS NULL THEN [] ELSE ['Table 1' || CASE WHEN kh.head IS NULL THEN '' ELSE ', under “' || kh.head || '”' END] END AS locations FROM users LEFT JOIN g USING (u) LEFT JOIN kh USING (u)
UNION ALL SELECT users.u, 6, list_concat(coalesce(l.s, []), coalesce(n.s, [])), list_concat(coalesce(l.spots, []), coalesce(n.spots, [])) FROM users LEFT JOIN l USING (u) LEFT JOIN n USING (u)
UNION ALL SELECT users.u, 10, coalesce(q.s, []), list_filter(['Paragraph ' || q.x, 'Paragraph ' || q.z], lambda x: x IS NOT NULL) FROM users LEFT JOIN q USING (u)
UNION ALL SELECT u, 11, CASE WHEN foot IS NULL THEN [] ELSE ['Footer, section 1: ' || CASE u % 4 WHEN 1 THEN 'page field' WHEN 2 THEN 'typed number in “Page 3”' ELSE 'no page number' END] END, CASE WHEN u % 4 IN (1, 2) THEN ['Footer, section 1'] ELSE [] END FROM z
UNION ALL SELECT u, 13, CASE WHEN foot IS NULL THEN [] ELSE ['Footer, section 1: ' || foot] END, CASE WHEN foot IS NULL THEN [] ELSE ['Footer, section 1'] END FROM z""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules 3, 6, 10, 11 and 13 saw and where: ordered lists, with sections, snippets and notes (A5, A12, F-H, F14, O1)."""
    return engine.evaluate(events_model(spark, sf_dir), CONFIG, [3, 6, 10, 11, 13]).select("doc_id", "rule_id", "evidence", "locations")
