"""Text functions and structure on fixed lines in Arabic and English, and on the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import legal
from evidra.functions import text as t
from evidra.functions.references import article_reference
from evidra.operators import structure, windows
from evidra.operators.search import resolve_instrument
from evidra.plans.retrieval import table

WORDS = ["والقانون", "بالاستيراد", "الرخص", "كالمستورد", "للوزير", "مستوردات", "مستوردون", "وزارة", "وثيقه", "رخصه", "الى", "licenses", "class", "gas", "permits", "ها", "عربيه", "كتابها"]
SAMPLES = {
    1: "المادة ٥ من قانون الاستيراد رقم ۱۲", 2: "Article 5 of the Import Law", 3: "رخصة import permit رخصة", 4: "12", 5: "أ إ آ «نص»؛ ؟٪", 6: "االستيراد والتصدير", 7: "(cid:12) bad � layer", 8: "نص١نص عادي",
}
ASKED = {
    1: "المادة 13 من نظام الرخص", 2: "Article 011 of the Licensing Bylaw 2004", 3: "what does article 3 and article 4 say", 4: "no reference here", 5: "المادة ٦٣ مكرر من قانون الزراعة", 6: "para. 7 of Annex on goods trade agreement",
}
TITLES = {"law-a": "قانون الزراعة رقم 13", "bylaw-b": "Licensing Bylaw 2004", "bylaw-c": "نظام الرخص نظام", "treaty-d": "Trade agreement Annex on goods", "law-e": "Trade law"}
LINES = [
    (1, 1, "Preface"), (1, 2, "CHAPTER One"), (1, 3, "Article 1 Terms"), (1, 4, "The following definitions apply:"), (1, 5, "Licence : a permit to import"), (1, 6, "issued by the ministry"), (1, 7, "Goods : things"),
    (1, 8, "Article 2"), (1, 9, "1. First duty"), (1, 10, "still first"), (1, 11, "2. Second duty"), (1, 12, "- هكذا اصبحت هذه المادة"), (1, 13, "old wording"), (2, 1, "Article 1"), (2, 2, "Body"), (2, 3, "PART Two"), (2, 4, "Article 3"),
]
UNITS = {1: [100, 200, 300, 500, 10, 20], 2: [450], 3: [], 4: [449, 1, 1, 451, 5]}


def _values(spark, rows, schema):
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, dict) else rows, schema)


def light_stem(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in WORDS], "word string").select("word", t.light_stem(F.col("word")).alias("stem"))


def normalize_text(spark, sf_dir):
    """All documents and the samples in the form that is matched."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_values(spark, {-k: v for k, v in SAMPLES.items()}, "doc_id long, text string"))
    return own.select("doc_id", F.sha2(t.fold(F.col("text")), 256).alias("sha"), F.length(t.normalize_digits(F.col("text"))).cast("long").alias("chars"))


def detect_language(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_values(spark, {-k: v for k, v in SAMPLES.items()}, "doc_id long, text string"))
    return own.select("doc_id", t.detect_language(F.col("text")).alias("language"))


def text_quality(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_values(spark, {-k: v for k, v in SAMPLES.items()}, "doc_id long, text string"))
    return own.select("doc_id", t.text_quality(F.col("text")).alias("q")).select("doc_id", "q.*")


def article_references(spark, sf_dir):
    return _values(spark, ASKED, "query_id long, query string").select("query_id", article_reference(F.col("query")).alias("r")).where("r is not null").select("query_id", "r.*")


def resolved_instruments(spark, sf_dir):
    asked = _values(spark, ASKED, "query_id long, query string").select("query_id", article_reference(F.col("query"))["remainder"].alias("text")).where("text is not null")
    titles = _values(spark, TITLES, "document_id string, title string").select("document_id", t.tokenize(t.fold(F.col("title"))).alias("tokens"))
    return resolve_instrument(asked.select("query_id", t.tokenize(t.fold(F.col("text"))).alias("tokens")), titles)


def word_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.inline(windows.word_windows(F.col("text"), 40, 10)))
    return docs.select("doc_id", "index", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("words"))


def _laws(spark):
    """The fixed lines as documents of one page."""
    lines = spark.createDataFrame(LINES, "doc_id long, pos long, line string").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    page = F.struct(F.lit(1).alias("page"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    tables = F.array().cast("array<struct<page:int,rows:array<array<string>>>>")
    return lines.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("0" * 64).alias("sha256"), F.lit("T").alias("title"), F.lit("en").alias("language"), F.array(page).alias("pages"), tables.alias("tables"))


def _documents(spark, sf_dir):
    page = F.struct(F.lit(1).alias("page"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array(page).alias("pages"))


def heading_carry_forward(spark, sf_dir):
    """The segments of documents, with the section and the article that are carried to their lines."""
    own = structure.structured(_laws(spark)).select("doc_id", F.posexplode("segments").alias("place", "s"))
    return own.select("doc_id", F.col("place").cast("long").alias("place"), F.col("s.number").alias("article"), F.col("s.section").alias("section"), F.size("s.lines").cast("long").alias("lines"))


def clause_groups(spark, sf_dir):
    """The lines of every document put to the clause that they belong to; those before the first are its lead."""
    cut = structure.cut_at(structure.lines_of(F.col("pages")), lambda x, i: legal.is_clause(x["text"]))
    own = _documents(spark, sf_dir).select("doc_id", cut.alias("c"))
    sizes = F.filter(F.concat(F.array(F.size("c.lead")), F.transform("c.groups", F.size)), lambda n: n >= 0)
    return own.select("doc_id", F.posexplode(sizes).alias("clause", "lines")).select("doc_id", F.col("clause").cast("long").alias("clause"), F.col("lines").cast("long").alias("lines"))


def definition_split(spark, sf_dir):
    """The chunks of an article of definitions, one a term."""
    own = structure.chunks(_laws(spark)).where("chunk_type = 'definitions'")
    return own.select(F.col("document_id").cast("long").alias("doc_id"), F.col("definition_term").alias("term"), "part_count", F.replace("text_original", F.lit("\n"), F.lit("|")).alias("lines"))


def history_split(spark, sf_dir):
    """Lines from the first amendment note on are history, and are chunks of their own."""
    own = structure.chunks(_laws(spark)).where("parent_key is null or chunk_type = 'amendment_history'")
    return own.select(F.col("document_id").cast("long").alias("doc_id"), "key", F.replace("text_original", F.lit("\n"), F.lit("|")).alias("lines"), (F.size("caveats") > 0).alias("caveat"))


def part_numbers(spark, sf_dir):
    """Every document in windows of 60 words, 10 of them shared: their place, number and text."""
    cut = structure.windowed(structure.lines_of(F.col("pages")), structure.Limits(60, 10))
    own = _documents(spark, sf_dir).select("doc_id", cut.alias("w"))
    return own.select("doc_id", F.size("w").cast("long").alias("parts"), F.posexplode("w").alias("part", "l")).select("doc_id", "parts", F.col("part").cast("long").alias("part"), F.md5(structure.joined(F.col("l"))).alias("text"))


def greedy_pack(spark, sf_dir):
    units = spark.createDataFrame(list(UNITS.items()), "doc_id long, sizes array<long>")
    return units.select("doc_id", F.posexplode(F.arrays_zip(F.col("sizes").alias("size"), windows.greedy_pack(F.col("sizes"), 450).alias("part")))).select("doc_id", F.col("pos").cast("long").alias("pos"), "col.size", "col.part")


def lines_packed(spark, sf_dir):
    """The lines of every document packed into parts of 120 words."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    sizes = F.transform(lines, t.count_tokens)
    own = table(spark, sf_dir, "documents").select("doc_id", windows.greedy_pack(sizes, 120).alias("parts"))
    return own.select("doc_id", F.size("parts").cast("long").alias("lines"), F.coalesce(F.array_max("parts") + 1, F.lit(0)).cast("long").alias("parts"))


def cleaned_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.clean_original(F.col("text")), 256).alias("sha"), t.count_tokens(F.col("text")).alias("tokens"))


QUERIES = {f.__name__: f for f in (light_stem, normalize_text, detect_language, text_quality, article_references, resolved_instruments, word_windows, heading_carry_forward, clause_groups, definition_split, history_split, part_numbers, greedy_pack, lines_packed, cleaned_text)}


def _sql(rows, names: str) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"t({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_STEM = "CASE " + " ".join(f"WHEN starts_with(w, '{p}') AND length(w) - {len(p)} >= 3 THEN substr(w, {len(p) + 1})" for p in t.PREFIXES) + " ELSE w END"
_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(b, '{s}') AND length(b) - {len(s)} >= 3 THEN left(b, length(b) - {len(s)})" for s in t.SUFFIXES) + " ELSE b END"
_ALL = _sql([(-k, v) for k, v in SAMPLES.items()], "doc_id, text") + ", every AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM t)"
_FOLD_FROM, _FOLD_TO = (t.ALEFS[i] + t.DIGITS[i] + t.POINTS[i] + "ةى"[0] * 0 for i in (0, 1))
_FROM, _TO = (_FOLD_FROM + "ةى").replace("'", "''"), (_FOLD_TO + "هي").replace("'", "''")
ORACLE = {
    "light_stem": f"WITH {_sql([(w,) for w in WORDS], 'w')}, b AS (SELECT w, {_STEM} AS b FROM t) SELECT w AS word, CASE WHEN regexp_matches(w, '^[ء-ي]+$') THEN {_SUFFIX} WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS stem FROM b",
    "normalize_text": f"""WITH {_ALL} SELECT doc_id, sha256(trim(regexp_replace(lower(translate(regexp_replace(text, '[ـؐ-ًؚ-ٰٟۖ-ۭ​-‏‪-‮⁦-⁩﻿]', '', 'g'), '{_FROM}', '{_TO}')), '[ \t ]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS sha, length(text) AS chars FROM every""",
    "detect_language": f"""WITH {_ALL}, n AS (SELECT doc_id, length(regexp_replace(text, '[^ء-يٱ-ۓ]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM every)
SELECT doc_id, CASE WHEN a + l < 3 THEN 'unknown' WHEN a / (a + l) >= 0.8 THEN 'ar' WHEN l / (a + l) >= 0.8 THEN 'en' ELSE 'mixed' END AS language FROM n""",
    "text_quality": f"""WITH {_ALL}, n AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\s ]*[؀-ۿ][^\\s ]*') AS k FROM every), c AS (
SELECT doc_id, len(k) AS n, len(list_filter(k, lambda x: regexp_matches(x, '^[وفبكل]?اال'))) AS r,
 len(list_filter(k, lambda x: regexp_matches(x, '^[ً-ٰٟ]|[ء-ي][0-9٠-٩]+[ء-ي]|[ٖ-ٟ]'))) AS m,
 len(regexp_extract_all(text, '�|\\(cid:[0-9]+\\)')) AS l, greatest(1, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS v, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS e FROM n)
SELECT doc_id, CASE WHEN e THEN 0 ELSE round(greatest(0.0, 1 - CASE WHEN n > 0 THEN r / n * 20 + m / n ELSE 0 END - l * 50 / v), 4) END::DOUBLE AS score, n::BIGINT AS arabic_tokens, r::BIGINT AS reversed_lam_alef, m::BIGINT AS malformed_tokens, l::BIGINT AS replacement_chars FROM c""",
    "article_references": r"""WITH """ + _sql(ASKED.items(), "query_id, q") + r""", n AS (SELECT *, '(?:ال)?ماد(?:ة|ه)\s*\(?\s*([0-9٠-٩]{1,3})\s*\)?\s*(مكرر)?' AS ar, '(?i)\b(?:article|art\.|paragraph|para\.)\s*([0-9]{1,3})\b' AS en FROM t),
m AS (SELECT query_id::BIGINT AS query_id, q, len(regexp_extract_all(q, '(?:ال)?ماد(?:ة|ه)\s*\(?\s*([0-9٠-٩]{1,3})\s*\)?\s*(مكرر)?')) AS na, len(regexp_extract_all(q, '(?i)\b(?:article|art\.|paragraph|para\.)\s*([0-9]{1,3})\b')) AS ne,
 regexp_extract(q, '(?:ال)?ماد(?:ة|ه)\s*\(?\s*([0-9٠-٩]{1,3})\s*\)?\s*(مكرر)?', 1) AS a1, regexp_extract(q, '(?:ال)?ماد(?:ة|ه)\s*\(?\s*([0-9٠-٩]{1,3})\s*\)?\s*(مكرر)?', 2) AS a2, regexp_extract(q, '(?i)\b(?:article|art\.|paragraph|para\.)\s*([0-9]{1,3})\b', 1) AS e1 FROM n)
SELECT query_id, CASE WHEN na = 1 THEN ltrim(translate(a1, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '0') || CASE WHEN a2 <> '' THEN ' مكرر' ELSE '' END ELSE ltrim(e1, '0') END AS article_number,
 trim(CASE WHEN na = 1 THEN regexp_replace(q, '(?:ال)?ماد(?:ة|ه)\s*\(?\s*([0-9٠-٩]{1,3})\s*\)?\s*(مكرر)?', ' ') ELSE regexp_replace(q, '(?i)\b(?:article|art\.|paragraph|para\.)\s*([0-9]{1,3})\b', ' ') END) AS remainder FROM m WHERE na + ne = 1""",
    "word_windows": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 30)) AS i FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS index, len(list_slice(w, i + 1, i + 40))::BIGINT AS n, md5(array_to_string(list_slice(w, i + 1, i + 40), ' ')) AS words FROM s WHERE i = 0 OR i - 30 + 40 < len(w)""",
    "cleaned_text": r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS sha, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents""",
    "heading_carry_forward": "WITH " + _sql(LINES, "doc_id, pos, line") + r""", h AS (SELECT *, line LIKE 'Article %' AS head, CASE WHEN regexp_matches(line, '^(CHAPTER|PART) ') THEN line END AS s FROM t),
c AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS section, sum(head::INT) OVER w AS k FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, min(CASE WHEN line LIKE '%هكذا اصبحت%' THEN pos END) OVER (PARTITION BY doc_id, k) AS note FROM c),
g AS (SELECT doc_id, k, max(CASE WHEN head THEN regexp_extract(line, '^Article ([0-9]+)', 1) END) AS article, min(pos) AS first, max(CASE WHEN head THEN section END) AS section, count(*) FILTER (s IS NULL AND (note IS NULL OR pos < note) AND (NOT head OR regexp_matches(line, '^Article [0-9]+ .'))) AS lines FROM l GROUP BY doc_id, k)
SELECT doc_id::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, article, section, lines FROM g WHERE k > 0 OR lines > 0""",
    "clause_groups": r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents), e AS (SELECT doc_id, i AS pos, x[i] AS line FROM l, unnest(range(1, len(x) + 1)) AS u(i)),
g AS (SELECT *, sum(regexp_matches(line, '(?i)^\s*(?:[ء-ي]\s?[.\-–)](?:\s|$)|[(\[]?[0-9٠-٩]{1,2}[)\]]?\s?[.\-–)]|[.\-]\s?[0-9٠-٩]{1,2}\S|\([a-z0-9]{1,4}\)|[a-z]\))')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS clause FROM e),
n AS (SELECT doc_id, clause, count(*) AS lines FROM g GROUP BY 1, 2) SELECT doc_id, clause::BIGINT AS clause, lines FROM n UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n WHERE clause = 0) AND text IS NOT NULL""",
    "definition_split": "WITH " + _sql(LINES, "doc_id, pos, line") + r""", k AS (SELECT *, sum((line LIKE 'Article %')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t),
b AS (SELECT doc_id, k, pos, regexp_replace(line, '^Article [0-9]+ *', '') AS line FROM k WHERE k > 0), d AS (SELECT * FROM b WHERE line <> '' AND (doc_id, k) IN (SELECT (doc_id, k) FROM b WHERE lower(line) LIKE '%the following definitions%')),
g AS (SELECT *, sum(regexp_matches(line, '^[^:]+:\s*\S')::INT) OVER (PARTITION BY doc_id, k ORDER BY pos) AS n FROM d)
SELECT doc_id::BIGINT AS doc_id, trim(split_part(string_agg(line, '|' ORDER BY pos) FILTER (n > 0 AND contains(line, ':')), ':', 1)) AS term, max(max(n)) OVER (PARTITION BY doc_id, k)::INT AS part_count, string_agg(line, '|' ORDER BY pos) AS lines FROM (SELECT doc_id, k, pos, line, n, greatest(n, 1) AS own FROM g) GROUP BY doc_id, k, own""",
    "history_split": "WITH " + _sql(LINES, "doc_id, pos, line") + r""", k AS (SELECT *, sum((line LIKE 'Article %')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM t WHERE NOT regexp_matches(line, '^(CHAPTER|PART) ')),
h AS (SELECT doc_id, k, pos, regexp_extract(first_value(line) OVER (PARTITION BY doc_id, k ORDER BY pos), '^Article ([0-9]+)', 1) AS n, regexp_replace(line, '^Article [0-9]+ *', '') AS line, coalesce(pos >= min(pos) FILTER (line LIKE '%هكذا اصبحت%') OVER (PARTITION BY doc_id, k), FALSE) AS past, bool_or(lower(line) LIKE '%the following definitions%') OVER (PARTITION BY doc_id, k) AS terms FROM k)
SELECT doc_id::BIGINT AS doc_id, CASE WHEN k = 0 THEN 'preamble' ELSE 'art-' || n END || CASE WHEN past THEN '.hist' ELSE '' END AS key, string_agg(line, '|' ORDER BY pos) AS lines, past AS caveat FROM h WHERE line <> '' AND NOT terms GROUP BY doc_id, k, n, past""",
    "part_numbers": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS i FROM w)
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS parts, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, md5(array_to_string(list_slice(w, i + 1, i + 60), ' ')) AS text FROM s WHERE i = 0 OR i - 50 + 60 < len(w)""",
}
