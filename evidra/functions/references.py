"""Article references in questions and in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.text import normalize_digits, strip

# How an article is named in Arabic and in English.
ARABIC_ARTICLE = "(?:ال)?ماد(?:ة|ه)\\s*\\(?\\s*([0-9٠-٩]{1,3})\\s*\\)?\\s*(مكرر)?"
ENGLISH_ARTICLE = "(?i)\\b(?:article|art\\.|paragraph|para\\.)\\s*(\\d{1,3})\\b"
BIS = "مكرر"
INSTRUMENT_WORDS = "قانون نظام تعليمات اتفاقية قرار law bylaw regulation instructions agreement annex decision"


def article_reference(query: Column) -> Column:
    """Struct of article_number and remainder, if the query names exactly one article; null otherwise."""
    n_ar = F.regexp_count(query, F.lit(ARABIC_ARTICLE))
    n_en = F.regexp_count(query, F.lit(ENGLISH_ARTICLE))
    pattern = lambda group, which: F.regexp_extract(query, which, group)
    bare = lambda c: F.when(F.ltrim(c, F.lit("0")) == "", "0").otherwise(F.ltrim(c, F.lit("0")))
    arabic = bare(normalize_digits(pattern(1, ARABIC_ARTICLE)))
    arabic = F.when(pattern(2, ARABIC_ARTICLE) != "", F.concat(arabic, F.lit(f" {BIS}"))).otherwise(arabic)
    number = F.when(n_ar == 1, arabic).otherwise(bare(pattern(1, ENGLISH_ARTICLE)))
    rest = F.when(n_ar == 1, F.regexp_replace(query, ARABIC_ARTICLE, " ")).otherwise(F.regexp_replace(query, ENGLISH_ARTICLE, " "))
    return F.when(n_ar + n_en == 1, F.struct(number.alias("article_number"), strip(rest).alias("remainder")))
