"""A small deterministic rule engine over products: findings, readiness and their counts.

Products and presets are DataFrames; each rule is an expression, so all products are assessed in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses with their marks, and the plausible range of a power in dBm.
STATUSES = {"supported": "✓", "missing": "○", "conflict": "≠", "verify": "?", "not_applicable": "–"}
POWER = (-10, 60)
EXEMPTION = "exempt"


def parse_power(raw: Column) -> Column:
    """Struct of ok, value and error of a power as typed; an empty one is missing rather than wrong."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), ",", ".")
    number = F.when(text.rlike("^-?[0-9]+(\\.[0-9]+)?$"), text.try_cast("double"))
    ok = number.isNotNull() & number.between(*POWER)
    error = F.when(text == "", F.lit(None)).when(number.isNull(), "Enter a number in dBm, for example 23.").when(~ok, f"Expected a value between {POWER[0]} and {POWER[1]} dBm.")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, number).alias("value"), error.alias("error"))


def milliwatts(dbm: Column) -> Column:
    """Rounded half up."""
    return F.floor(F.pow(F.lit(10.0), dbm / 10) + 0.5).cast("long")


def with_presets(products: DataFrame, presets: DataFrame) -> DataFrame:
    """products (product_id, preset, eirp, test_report) with their preset's columns; an unknown preset is the first one.

    presets: place, preset_id, brand, model, manufacturer, default_eirp, is_exempt, is_phone, doc_file, datasheet_file, report_file,
    application_fee, approval_fee.
    """
    first = F.broadcast(presets.orderBy("place").limit(1).select(F.struct(*presets.columns).alias("first")))
    held = F.broadcast(presets.select(F.col("preset_id").alias("preset"), F.struct(*presets.columns).alias("own")))
    joined = products.join(held, "preset", "left").crossJoin(first)
    return joined.withColumn("p", F.coalesce("own", "first")).drop("own", "first")


def _finding(name: str, status: Column | str, evidence: Column | str, applies: str = "Yes") -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(name).alias("id"), F.lit(applies).alias("applies"), lit(status).alias("status"), lit(evidence).alias("evidence"))


def findings(assessed: DataFrame) -> DataFrame:
    """product_id and its findings (id, applies, status, evidence) in order."""
    p = lambda c: F.col(f"p.{c}")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    power = parse_power(F.when(F.coalesce("eirp", F.lit("")) == "", p("default_eirp")).otherwise(F.col("eirp")))
    report = F.coalesce("test_report", F.lit("none"))
    exempt = F.array(
        _finding("exemption", "not_applicable", say(p("brand"), " ", p("model"), " is listed as exempt."), "Exempt"),
        _finding("fees_exemption", "not_applicable", "No application is made for an exempt device, so no fee is due.", "No"),
        _finding("safety_srd", "supported", say(p("doc_file"), " confirms the short-range radio standards.")),
    )
    usual = F.array(
        _finding("doc", "supported", say(p("doc_file"), " names ", p("model"), " by ", p("manufacturer"), ".")),
        _finding("specs", "supported", say(p("datasheet_file"), " declares bands and bandwidth.")),
        _finding("standards_rf", "supported", "Radio standards are matched."),
        _finding("standards_emc_safety", "supported", say("EMC and safety standards are cited in ", p("doc_file"), ".")),
        _finding("report", F.when(report == "match", "supported").when(report == "mismatch", "conflict").otherwise("missing"), F.when(report == "match", say(p("report_file"), " covers ", p("model"), ".")).when(report == "mismatch", say("The report doesn't name ", p("model"), ".")).otherwise(say("No test report for ", p("model"), "."))),
        _finding("eirp", F.when(power["ok"], "verify").otherwise("missing"), F.when(power["ok"], say("Declared EIRP ", power["value"].cast("string"), " dBm (", milliwatts(power["value"]).cast("string"), " mW).")).otherwise("Missing declared EIRP value.")),
        F.when(p("is_phone"), _finding("imei", "verify", "No file shows whether the IMEI is registered.")),
        _finding("fees", "verify", say("Fees: ", p("application_fee").cast("string"), " + ", p("approval_fee").cast("string"), " = ", (p("application_fee") + p("approval_fee")).cast("string"), ".")),
    )
    return assessed.select("product_id", F.when(p("is_exempt"), exempt).otherwise(F.array_compact(usual)).alias("findings"))


def evidence_files(assessed: DataFrame) -> DataFrame:
    """product_id and the files that its assessment rests on."""
    p = lambda c: F.col(f"p.{c}")
    third = F.when(p("is_exempt"), "exemption_certificate.pdf").when(F.col("test_report") == "match", p("report_file")).when(F.col("test_report") == "mismatch", "other_model_report.pdf")
    return assessed.select("product_id", F.array_compact(F.array(p("doc_file"), p("datasheet_file"), third)).alias("files"))


def extracted(assessed: DataFrame) -> DataFrame:
    """product_id, field, value, source and confirmed of the data that are read from a product's files."""
    p = lambda c: F.col(f"p.{c}")
    typed = F.coalesce("eirp", F.lit("")) != ""
    power = parse_power(F.when(typed, F.col("eirp")).otherwise(p("default_eirp")))
    hand = typed & (F.trim("eirp") != p("default_eirp"))
    row = lambda name, value, source, sure: F.struct(F.lit(name).alias("field"), value.alias("value"), source.alias("source"), sure.alias("confirmed"))
    sheet = F.concat(p("datasheet_file"), F.lit(", p.2"))
    rows = F.array(
        row("brand", p("brand"), F.concat(p("datasheet_file"), F.lit(", p.1")), F.lit(True)),
        row("model", p("model"), p("doc_file"), F.lit(True)),
        row("manufacturer", p("manufacturer"), p("doc_file"), F.lit(True)),
        row("eirp", F.when(power["ok"], F.concat(power["value"].cast("string"), F.lit(" dBm"))), F.when(~power["ok"], "—").when(hand, "Entered by applicant").otherwise(sheet), power["ok"] & ~hand),
    )
    return assessed.select("product_id", F.inline(rows))


def readiness(found: DataFrame) -> DataFrame:
    """product_id, ready, blocking and to_verify (ids), and the percentage of findings that aren't open."""
    ids = lambda *s: F.transform(F.filter("findings", lambda f: f["status"].isin(*s)), lambda f: f["id"])
    blocking = ids("missing", "conflict")
    clear = F.size("findings") - F.size(blocking)
    return found.select("product_id", (F.size(blocking) == 0).alias("ready"), blocking.alias("blocking"), ids("verify").alias("to_verify"), F.floor(100 * clear / F.size("findings") + 0.5).cast("long").alias("percent"))


def status_counts(found: DataFrame) -> DataFrame:
    """product_id, status and the count of its findings; statuses without one aren't there."""
    return found.select("product_id", F.explode("findings").alias("f")).groupBy("product_id", F.col("f.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def localized(found: DataFrame, texts: DataFrame) -> DataFrame:
    """product_id, id, status and evidence, in another language where texts (id, evidence) has it."""
    each = found.select("product_id", F.inline("findings"))
    other = F.broadcast(texts.select("id", F.col("evidence").alias("other")))
    return each.join(other, "id", "left").select("product_id", "id", "status", F.coalesce("other", "evidence").alias("evidence"))
