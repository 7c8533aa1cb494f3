"""Ranking measures, score separation, the rule engine and evidence on tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.operators import assessment as rules
from evidra.operators import evidence, measures
from evidra.plans.retrieval import table

KS = [1, 5, 10]
PRESETS = [
    (1, "handset", "Acme", "AX-1", "Acme Devices", "23", False, True, "doc_ax1.pdf", "sheet_ax1.pdf", "report_ax1.pdf", 25, 50),
    (2, "gateway", "Netco", "GW-3", "Netco Ltd", "19", False, False, "doc_gw3.pdf", "sheet_gw3.pdf", "report_gw3.pdf", 25, 50),
    (3, "pointer", "Mico", "WM-1", "Mico Group", "2.5", True, False, "doc_wm1.pdf", "sheet_wm1.pdf", "report_wm1.pdf", 0, 0),
]
PRESET_COLUMNS = "place int, preset_id string, brand string, model string, manufacturer string, default_eirp string, is_exempt boolean, is_phone boolean, doc_file string, datasheet_file string, report_file string, application_fee int, approval_fee int"
PRODUCTS = [(1, "handset", "", "match"), (2, "handset", "abc", "mismatch"), (3, "gateway", "24,5", "none"), (4, "pointer", None, None), (5, "unknown", "99", "match"), (6, "gateway", "-11", "match")]


def _ranked(spark, sf_dir):
    """Documents of each language as a ranking by length, labels of quality and toxicity as grades."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("unit"), F.row_number().over(order).alias("rank"), "quality", "toxic")
    return ranked, ranked.where("quality = 1").select("query_id", "unit", (1 + F.col("toxic")).alias("grade"))


def eval_metrics(spark, sf_dir):
    ranked, relevant = _ranked(spark, sf_dir)
    return measures.ranking_measures(ranked.select("query_id", "unit", "rank"), relevant, KS)


def eval_by_group(spark, sf_dir):
    """Means by direction, by each tag and over all, of the documents' lengths and labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = docs.select(F.col("n_chars").cast("double").alias("chars"), F.col("quality").cast("double").alias("quality"), F.concat("lang", F.lit("->"), F.when(F.col("toxic") == 1, "none").otherwise(F.col("lang"))).alias("direction"), F.array(F.concat(F.lit("tag:"), F.col("source"))).alias("tags"))
    return measures.mean_by_group(cases, F.concat(F.array("direction"), F.col("tags"), F.array(F.lit("all"))), ["chars", "quality"])


def score_auroc(spark, sf_dir):
    """How well length separates good from bad documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return measures.auroc(docs.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive")))


def score_separation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    return docs.agg(F.round(F.avg(F.when(good, F.col("n_chars"))), 4).alias("answerable_mean"), F.min(F.when(good, F.col("n_chars"))).alias("answerable_min"), F.round(F.avg(F.when(~good, F.col("n_chars"))), 4).alias("unanswerable_mean"), F.max(F.when(~good, F.col("n_chars"))).alias("unanswerable_max"))


def _assessed(spark):
    products = spark.createDataFrame(PRODUCTS, "product_id long, preset string, eirp string, test_report string")
    return rules.with_presets(products, spark.createDataFrame(PRESETS, PRESET_COLUMNS))


def assessment_findings(spark, sf_dir):
    found = rules.findings(_assessed(spark))
    return found.select("product_id", F.posexplode("findings")).select("product_id", F.col("pos").cast("long").alias("pos"), "col.id", "col.applies", "col.status")


def assessment_readiness(spark, sf_dir):
    return rules.readiness(rules.findings(_assessed(spark))).select("product_id", "ready", F.array_join("blocking", ",").alias("blocking"), F.array_join("to_verify", ",").alias("to_verify"), "percent")


def assessment_status_counts(spark, sf_dir):
    return rules.status_counts(rules.findings(_assessed(spark)))


def power_values(spark, sf_dir):
    """Typed powers: every balance of suppliers and some texts."""
    typed = table(spark, sf_dir, "supplier").select(F.round(F.col("s_acctbal") / 100, 1).cast("decimal(9,1)").cast("string").alias("raw")).unionByName(spark.createDataFrame([(x,) for x in ("23", " 24,5 ", "abc", "", "61", "-10", "1.", ".5")], "raw string"))
    return typed.distinct().select("raw", rules.parse_power(F.col("raw")).alias("p")).select("raw", "p.ok", "p.value", rules.milliwatts(F.col("p.value")).alias("milliwatts"))


def evidence_caveats(spark, sf_dir):
    """Caveats of every document as evidence of a source whose metadata follow from its columns."""
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("lang") == "en", "current").when(F.col("lang") == "fr", "superseded").otherwise("unknown")
    binding = F.when(F.col("source").isin("src0", "src1"), "guidance").otherwise("binding")
    method = F.element_at(F.array(*map(F.lit, ("text_layer", "ocr", "mixed", "font_recovery"))), (F.col("n_chars") % 4 + 1).cast("int"))
    review = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>"))
    told = evidence.caveats(F.array().cast("array<string>"), status, binding, method, review, F.when(F.col("lang") == "es", "machine_translation").otherwise("original"))
    return docs.select("doc_id", F.size(told).cast("long").alias("n"), F.md5(F.array_join(told, "|")).alias("caveats"))


def shared_caveats(spark, sf_dir):
    """Per source what all its documents' word lists of languages and lengths share, and how much is left."""
    docs = table(spark, sf_dir, "documents").select("source", F.array(F.lit("every"), F.col("lang"), F.when(F.col("n_chars") > 0, F.lit("long")).otherwise(F.lit("none"))).alias("c"))
    own = docs.groupBy("source").agg(F.sort_array(F.collect_set("c")).alias("lists"))
    return own.select("source", F.array_join(F.sort_array(evidence.shared_caveats(F.col("lists"))), ",").alias("shared"), F.size("lists").cast("long").alias("lists"))


QUERIES = {f.__name__: f for f in (eval_metrics, eval_by_group, score_auroc, score_separation, assessment_findings, assessment_readiness, assessment_status_counts, power_values, evidence_caveats, shared_caveats)}


def _lit(v):
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_RULES = (
    "product(product_id, preset, eirp, test_report) AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in PRODUCTS) + "), preset(place, preset_id, default_eirp, is_exempt, is_phone) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_lit, (r[0], r[1], r[5], r[6], r[7]))) + ")" for r in PRESETS) + """),
own AS (SELECT product_id, coalesce(test_report, 'none') AS report, coalesce(a.is_exempt, f.is_exempt) AS is_exempt, coalesce(a.is_phone, f.is_phone) AS is_phone,
  replace(trim(CASE WHEN coalesce(eirp, '') = '' THEN coalesce(a.default_eirp, f.default_eirp) ELSE eirp END), ',', '.') AS e FROM product LEFT JOIN preset a ON a.preset_id = preset, (SELECT * FROM preset ORDER BY place LIMIT 1) f),
told AS (SELECT *, CASE WHEN regexp_matches(e, '^-?[0-9]+([.][0-9]+)?$') THEN e::DOUBLE BETWEEN -10 AND 60 ELSE FALSE END AS ok FROM own),
finding AS (
  SELECT product_id, unnest([{'k': 0, 'id': 'exemption', 'applies': 'Exempt', 'status': 'not_applicable'}, {'k': 1, 'id': 'fees_exemption', 'applies': 'No', 'status': 'not_applicable'}, {'k': 2, 'id': 'safety_srd', 'applies': 'Yes', 'status': 'supported'}]) AS f FROM told WHERE is_exempt
  UNION ALL SELECT product_id, unnest([{'k': 0, 'id': 'doc', 'applies': 'Yes', 'status': 'supported'}, {'k': 1, 'id': 'specs', 'applies': 'Yes', 'status': 'supported'}, {'k': 2, 'id': 'standards_rf', 'applies': 'Yes', 'status': 'supported'}, {'k': 3, 'id': 'standards_emc_safety', 'applies': 'Yes', 'status': 'supported'},
    {'k': 4, 'id': 'report', 'applies': 'Yes', 'status': CASE report WHEN 'match' THEN 'supported' WHEN 'mismatch' THEN 'conflict' ELSE 'missing' END}, {'k': 5, 'id': 'eirp', 'applies': 'Yes', 'status': CASE WHEN ok THEN 'verify' ELSE 'missing' END},
    {'k': 6, 'id': CASE WHEN is_phone THEN 'imei' END, 'applies': 'Yes', 'status': 'verify'}, {'k': 7, 'id': 'fees', 'applies': 'Yes', 'status': 'verify'}]) AS f FROM told WHERE NOT is_exempt),
row_ AS (SELECT product_id::BIGINT AS product_id, (row_number() OVER (PARTITION BY product_id ORDER BY f.k) - 1)::BIGINT AS pos, f.id AS id, f.applies AS applies, f.status AS status FROM finding WHERE f.id IS NOT NULL)"""
)
_RANKED = """r AS (SELECT lang AS query_id, doc_id AS unit, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, CASE WHEN quality = 1 THEN 1 + toxic END AS grade FROM documents JOIN labels USING (doc_id)),
i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, unit) AS place FROM r WHERE grade IS NOT NULL),
ideal AS (SELECT query_id, count(*) AS n""" + "".join(f", sum(CASE WHEN place <= {k} THEN (2 ** grade - 1) / log2(place + 1) ELSE 0 END) AS i{k}" for k in KS) + " FROM i GROUP BY 1)"
_T = {k: _lit(getattr(evidence, k)) for k in ("STATUS_UNKNOWN", "SUPERSEDED", "FONT_RECOVERY", "OCR", "MIXED", "TRANSLATION")}
_CAVEATS = f"""list_filter([CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN {_T['SUPERSEDED']} ELSE {_T['STATUS_UNKNOWN']} END,
 CASE WHEN source IN ('src0', 'src1') THEN 'Source binding nature is ''guidance'', not a binding legal instrument.' END,
 CASE n_chars % 4 WHEN 1 THEN {_T['OCR']} WHEN 2 THEN {_T['MIXED']} WHEN 3 THEN {_T['FONT_RECOVERY']} END,
 CASE WHEN n_chars % 3 = 0 THEN 'Extraction of page(s) 1, 3 is flagged for human review.' END, CASE WHEN lang = 'es' THEN {_T['TRANSLATION']} END], lambda x: x IS NOT NULL)"""
_JOINED = "documents JOIN labels USING (doc_id)"
ORACLE = {
    "eval_metrics": f"WITH {_RANKED} SELECT query_id, round(coalesce(1 / min(rank) FILTER (grade IS NOT NULL), 0), 4) AS mrr" + "".join(f", round(count(*) FILTER (grade IS NOT NULL AND rank <= {k}) / any_value(n), 4) AS recall_{k}, round(count(*) FILTER (grade IS NOT NULL AND rank <= {k}) / {k}, 4) AS precision_{k}, round(coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (grade IS NOT NULL AND rank <= {k}), 0) / any_value(i{k}), 4) AS ndcg_{k}" for k in KS) + " FROM r JOIN ideal USING (query_id) GROUP BY query_id",
    "eval_by_group": f"""SELECT "group", count(*) AS cases, round(avg(n_chars::DOUBLE), 4) AS chars, round(avg(quality::DOUBLE), 4) AS quality FROM (SELECT *, unnest([lang || '->' || CASE WHEN toxic = 1 THEN 'none' ELSE lang END, 'tag:' || source, 'all']) AS "group" FROM {_JOINED}) GROUP BY 1""",
    "score_auroc": f"WITH d AS (SELECT n_chars, quality FROM {_JOINED}), p AS (SELECT n_chars AS x FROM d WHERE quality = 1), n AS (SELECT n_chars AS y FROM d WHERE quality <> 1) SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives, round(avg(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END::DOUBLE), 4) AS auroc FROM p, n",
    "score_separation": f"SELECT round(avg(n_chars) FILTER (quality = 1), 4) AS answerable_mean, min(n_chars) FILTER (quality = 1) AS answerable_min, round(avg(n_chars) FILTER (quality <> 1), 4) AS unanswerable_mean, max(n_chars) FILTER (quality <> 1) AS unanswerable_max FROM {_JOINED}",
    "assessment_findings": f"WITH {_RULES} SELECT * FROM row_",
    "assessment_readiness": f"WITH {_RULES} SELECT product_id, bool_and(status NOT IN ('missing', 'conflict')) AS ready, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (status IN ('missing', 'conflict')), '') AS blocking, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (status = 'verify'), '') AS to_verify, floor(100 * count(*) FILTER (status NOT IN ('missing', 'conflict')) / count(*) + 0.5)::BIGINT AS percent FROM row_ GROUP BY 1",
    "assessment_status_counts": f"WITH {_RULES} SELECT product_id, status, count(*) AS n FROM row_ GROUP BY 1, 2",
    "power_values": """WITH t AS (SELECT DISTINCT raw FROM (SELECT round(s_acctbal / 100, 1)::DECIMAL(9, 1)::VARCHAR AS raw FROM supplier UNION ALL SELECT unnest(['23', ' 24,5 ', 'abc', '', '61', '-10', '1.', '.5']))),
v AS (SELECT raw, CASE WHEN regexp_matches(replace(trim(raw), ',', '.'), '^-?[0-9]+([.][0-9]+)?$') THEN replace(trim(raw), ',', '.')::DOUBLE END AS v FROM t)
SELECT raw, coalesce(v BETWEEN -10 AND 60, FALSE) AS ok, CASE WHEN v BETWEEN -10 AND 60 THEN v END AS value, floor(pow(10, CASE WHEN v BETWEEN -10 AND 60 THEN v END / 10) + 0.5)::BIGINT AS milliwatts FROM v""",
    "evidence_caveats": f"WITH c AS (SELECT doc_id, {_CAVEATS} AS c FROM documents) SELECT doc_id, len(c)::BIGINT AS n, md5(array_to_string(c, '|')) AS caveats FROM c",
    "shared_caveats": """WITH l AS (SELECT DISTINCT source, lang, CASE WHEN n_chars > 0 THEN 'long' ELSE 'none' END AS s FROM documents)
SELECT source, array_to_string(list_sort(list_filter(['every', CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END], lambda x: x IS NOT NULL)), ',') AS shared, count(*) AS lists FROM l GROUP BY source""",
}
