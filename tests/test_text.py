import unicodedata

from pyspark.sql import functions as F

from evidra.functions import text as t
from evidra.functions.references import article_reference


def apply(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_clean_original(spark):
    given = ["  a \t b \r\nc‏‪d \n\n\n\n e ", "﻿", None, "x y\x0bz"]
    assert apply(spark, given, t.clean_original) == ["a b\ncd\n\ne", "", None, "x\ny\nz"]


def test_fold(spark):
    given = ["أإآٱ الْقَانُون ــــ رقم ١٢۳", "وزارة الى مصطفى", "«نص»؛ ما؟ ٥٪،", "A  B\tC", None]
    assert apply(spark, given, t.fold) == ["اااا القانون رقم 123", "وزاره الي مصطفي", '"نص"; ما? 5%,', "a b c", None]
    assert apply(spark, ["وزارة الى"], lambda c: t.fold(c, ta_marbuta=False, alef_maqsura=False)) == ["وزارة الى"]
    assert apply(spark, ["ؤئ"], t.fold) == ["ؤئ"]


def test_compatibility_forms_go_through_python(spark):
    given = ["ﻻ", "ﬁne", "plain é", "①", "قانون", None, "x²"]
    df = spark.createDataFrame(list(enumerate(given)), "k long, v string")
    got = [r["o"] for r in t.with_retrieval_text(df, "v", "o").orderBy("k").collect()]
    assert got == ["لا", "fine", "plain é", "1", "قانون", None, "x2"]


def test_stable_blocks_are_stable(spark):
    """No character of the fast path is changed by NFKC."""
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in points if unicodedata.normalize("NFKC", c) != c]
    df = spark.createDataFrame([(c,) for c in changed], "v string")
    assert df.where(F.col("v").rlike(t._STABLE)).count() == 0


def test_language(spark):
    assert apply(spark, ["قانون الاستيراد", "Import law", "قانون law", "12", "ab", "ab قانون الاستيراد والتصدير"], t.detect_language) == ["ar", "en", "mixed", "unknown", "unknown", "ar"]


def test_quality(spark):
    rows = apply(spark, ["قانون الاستيراد", "االستيراد قانون", "نص١نص قانون", "ok � text", "  ", "(cid:3)", " ".join(["كلمة"] * 80), " ".join(["كلمة", "في"] * 40), ("في، " * 6 + "كلمة " * 74).strip()], t.text_quality)
    assert [r["score"] for r in rows] == [1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    assert rows[1]["reversed_lam_alef"] == 1 and rows[2]["malformed_tokens"] == 1 and rows[3]["replacement_chars"] == 1 and rows[6]["arabic_tokens"] == 80


def test_stems(spark):
    given = ["والقانون", "بالاستيراد", "للوزير", "وزارة", "مستوردات", "ها", "licenses", "class", "gas", "tests", "ابها", "والد"]
    assert apply(spark, given, t.light_stem) == ["قان", "استيراد", "وزير", "وزارة", "مستورد", "ها", "license", "class", "gas", "test", "ابها", "والد"]


def test_tokens(spark):
    got = apply(spark, ["the licenses of 2009.11 و القانون", "", None, "a_b 12x"], lambda c: t.tokenize(t.fold(c)))
    assert got == [["license", "2009.11", "2009", "قان"], [], None, ["b", "12", "x"]]


def test_small_functions(spark):
    assert apply(spark, ["a  b\n", "", None, "  "], t.count_tokens) == [2, 0, 0, 0]
    assert apply(spark, ["63 مكرر", "٥", "A.1", "!"], t.slug) == ["63-bis", "5", "a.1", "x"]
    assert apply(spark, ["a b c", "a b"], lambda c: t.truncate_words(c, 2)) == ["a b …", "a b"]
    assert apply(spark, ["text 111111211", "text 123456789", "x 11111"], t.strip_line_noise) == ["text", "text 123456789", "x 11111"]
    assert apply(spark, ["<a href='x'>&\""], t.escape_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert apply(spark, ["https://a.b/c", "javascript:x", "/a", None], t.safe_url) == ["https://a.b/c", None, None, None]


def test_article_references(spark):
    given = ["المادة 13 من نظام الرخص", "Article 011 of the Bylaw", "articles", "article 3 and para. 4", "المادة (٦٣) مكرر من القانون", "المادة 000"]
    got = [None if r is None else tuple(r) for r in apply(spark, given, article_reference)]
    assert got == [("13", "من نظام الرخص"), ("11", "of the Bylaw"), None, None, ("63 مكرر", "من القانون"), ("0", "")]
