"""Text repair, normalisation, language and quality of Arabic and English text, as Columns.

Everything here runs in the JVM. NFKC has no built-in; ``with_retrieval_text`` sends only the rows that
NFKC would change through a vectorised Python function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets that define the results.
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]"
MARKS = "[\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06ed]"
TATWEEL = "ـ"
LINE_ENDS = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
WHITE = "[\\t-\\r\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WHITE_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Texts without any of these are folded by their case and blanks alone.
FOLDED_ELSE = "[\\u00ab\\u00bb\\u0600-\\u06ff\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]"
ALEFS = ("أإآٱ", "اااا")
DIGITS = ("".join(chr(c) for c in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA))), "0123456789" * 2)
POINTS = ("،؛؟٪«»", ",;?%\"\"")
ARABIC = "\\u0621-\\u064a\\u0671-\\u06d3"
FUNCTION_WORDS = "في من على الى إلى أن ان او أو التي الذي هذه هذا ذلك عن مع لا ما كل أي اي بين قبل بعد حيث وفق".split()
STOPWORDS = """
في من على الي عن او و ان ما لا لم لن هذا هذه ذلك تلك التي الذي الذين اللذين كل اي اذا اذ قد ثم
كما مع بين عند غير حيث بما به بها له لها منه منها فيه فيها عليه عليها هو هي هم كان كانت يكون
the a an of to in on for and or by with as at from that this these those is are be been was
were it its any such which who shall may not no under into than other
""".split()
#: Numbers with dotted parts, or runs of letters.
TOKEN = "\\p{Nd}+(?:\\.\\p{Nd}+)*|\\p{L}+"
PREFIXES = ["وال", "فال", "بال", "كال", "لل", "ال"]
SUFFIXES = ["ات", "ون", "ين", "ان", "ها", "يه", "ه", "ي"]
STEM = 3
#: Penalty of a token with a reversed ligature, and when the share of function words is looked at.
LIGATURE_WEIGHT, ENOUGH_TOKENS, LEAST_SHARE = 20.0, 80, 0.05


def strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.trim(c, F.lit(WHITE_CHARS))


def _tight(c: Column) -> Column:
    """Blanks in a row as one space; single spaces, which are most, match nothing."""
    return F.regexp_replace(c, "[ \\t\\u00a0]{2,}|[\\t\\u00a0]", " ")


def clean_original(c: Column) -> Column:
    """Without invisible characters; blanks in a line become one, lines are stripped, two blank lines or more become one."""
    inner = WHITE.replace("\\t-\\r", "\\t\\u000b-\\r")
    one_end = F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), LINE_ENDS, "\n")
    tight = F.regexp_replace(_tight(one_end), f"{inner}*\\n{inner}*", "\n")
    return strip(F.regexp_replace(tight, "\\n{3,}", "\n\n"))


def normalize_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def fold(c: Column, ta_marbuta: bool = True, alef_maqsura: bool = True) -> Column:
    """The form that is matched, of text that is NFKC already."""
    source, target = (a + b + d for a, b, d in zip(ALEFS, DIGITS, POINTS))
    if ta_marbuta:
        source, target = source + "ة", target + "ه"
    if alef_maqsura:
        source, target = source + "ى", target + "ي"
    bare = F.regexp_replace(c, f"[{INVISIBLE[1:-1]}{TATWEEL}{MARKS[1:-1]}]", "")
    out = F.when(c.rlike(FOLDED_ELSE), F.translate(bare, source, target)).otherwise(c)
    return strip(_tight(F.lower(out)))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


#: Blocks that NFKC leaves alone: ASCII, Latin letters without compatibility forms, basic Arabic letters and marks.
_STABLE = "^[\\u0000-\\u009f\\u00a1-\\u00a7\\u00a9\\u00ab-\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u0600-\\u064a\\u0660-\\u0674\\u0679-\\u06bf\\u06c1\\u06c3-\\u06d2\\u06d4-\\u06d5\\u06f0-\\u06ff\\u200b-\\u200f\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u202a-\\u202e\\u2066-\\u2069\\ufeff\\ufffd]*$"


def with_retrieval_text(df: DataFrame, column: str, out: str, **options: bool) -> DataFrame:
    """df with the matched form of a column.

    Texts that NFKC leaves alone go to Python as nulls, so df is computed once, and not in Python where ``out`` isn't read.
    """
    stable = F.coalesce(F.col(column), F.lit("")).rlike(_STABLE)
    changed = nfkc(F.when(~stable, F.col(column)))
    return df.withColumn(out, fold(F.coalesce(changed, F.col(column)), **options))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def detect_language(c: Column, least: int = 3) -> Column:
    """ar, en, mixed or unknown by the share of letters: 0.8 of one script decides."""
    arabic, latin = _count(c, f"[{ARABIC}]"), _count(c, "[A-Za-z]")
    total = arabic + latin
    return F.when(total < least, "unknown").when(arabic / total >= 0.8, "ar").when(latin / total >= 0.8, "en").otherwise("mixed")


def text_quality(c: Column) -> Column:
    """Struct of score, arabic_tokens, reversed_lam_alef, malformed_tokens and replacement_chars of a text layer."""
    runs = F.filter(F.split(c, "[\\s\\u00a0]+", -1), lambda t: t.rlike("[\\u0600-\\u06ff]"))
    alike = lambda t: F.translate(t, "أإآى", "اااي")
    known = F.array_distinct(F.transform(F.array(*map(F.lit, FUNCTION_WORDS)), alike))

    def told(tokens: Column) -> Column:
        n = F.size(tokens)
        size = lambda test: F.size(F.filter(tokens, test))
        turned = size(lambda t: t.rlike("^[\\u0648\\u0641\\u0628\\u0643\\u0644]?\\u0627\\u0627\\u0644"))
        bad = size(lambda t: t.rlike("^[\\u064b-\\u065f\\u0670]|[\\u0621-\\u064a][0-9\\u0660-\\u0669]+[\\u0621-\\u064a]|[\\u0656-\\u065f]"))
        words = size(lambda t: F.array_contains(known, alike(F.regexp_replace(t, "^[.,:;()\\[\\]،؛«»\"']+|[.,:;()\\[\\]،؛«»\"']+$", ""))))
        lost = _count(c, "\\ufffd") + _count(c, "\\(cid:\\d+\\)")
        visible = F.length(strip(c))
        penalty = F.when(n > 0, turned / n * LIGATURE_WEIGHT + bad / n).otherwise(0.0)
        penalty = penalty + F.when((n >= ENOUGH_TOKENS) & (words / n < LEAST_SHARE), 1.0).otherwise(0.0)
        penalty = penalty + lost * 50 / F.greatest(F.lit(1), visible)
        score = F.when(visible == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - penalty), 4))
        shown = lambda x: F.when(visible == 0, 0).otherwise(x).cast("long")
        return F.struct(score.alias("score"), shown(n).alias("arabic_tokens"), shown(turned).alias("reversed_lam_alef"), shown(bad).alias("malformed_tokens"), shown(lost).alias("replacement_chars"))

    # Bound as a variable of a lambda function, the text is cut into tokens once rather than for each measure.
    return F.transform(F.array(runs), told)[0]


def light_stem(c: Column) -> Column:
    """Arabic words lose one prefix, then one suffix, if three letters remain; others a final s of five letters or more.

    The shortest stem that leaves a suffix is the one with the longest suffix, which is the first of the list that fits.
    """
    bare = F.regexp_replace(c, f"^(?:{'|'.join(PREFIXES)})(?=.{{{STEM},}}$)", "")
    stem = F.regexp_replace(bare, f"^(.{{{STEM},}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    plural = (F.length(c) > 4) & c.endswith("s") & ~c.endswith("ss")
    arabic = c.between("ء", "ي\uffff") & c.rlike("^[\\u0621-\\u064a]+$")
    return F.when(arabic, stem).when(plural, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def tokenize(c: Column) -> Column:
    """The terms of a folded text: numbers (a dotted one also by its head) and stems of words that aren't stopwords."""
    raw = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    number = lambda t: t.rlike("^\\p{Nd}")
    kept = F.filter(raw, lambda t: number(t) | ~F.array_contains(stop, t))
    each = F.transform(kept, lambda t: F.when(number(t), F.when(F.contains(t, F.lit(".")), F.array(t, F.substring_index(t, ".", 1))).otherwise(F.array(t))).otherwise(F.array(light_stem(t))))
    return F.filter(F.flatten(each), lambda t: number(t) | ~F.array_contains(stop, t))


def count_tokens(c: Column) -> Column:
    """White-space words."""
    bare = strip(c)
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, f"{WHITE}+", -1))).cast("long")


def embedding_input(header: Column, text: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def strip_line_noise(c: Column) -> Column:
    """Without a trailing run of six digits or more that has two different digits at most."""
    run = F.regexp_extract(c, "([0-9]{6,})\\s*$", 1)
    few = F.size(F.array_distinct(F.filter(F.split(run, ""), lambda x: x != ""))) <= 2
    return F.when((run != "") & few, F.rtrim(F.regexp_replace(c, "[0-9]{6,}\\s*$", ""))).otherwise(c)


def slug(c: Column) -> Column:
    """The part of a key that an article number makes."""
    plain = F.lower(F.trim(F.replace(normalize_digits(c), F.lit("مكرر"), F.lit("bis"))))
    out = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9.]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "x").otherwise(out)


def truncate_words(c: Column, words: int) -> Column:
    """The first words with an ellipsis, or the text as it is if it has no more."""
    found = F.split(strip(c), f"{WHITE}+", -1)
    return F.when(F.size(found) <= words, c).otherwise(F.concat(F.array_join(F.slice(found, 1, words), " "), F.lit(" …")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_url(c: Column) -> Column:
    """Absolute http and https addresses; others are null."""
    return F.when(c.rlike("^(?i)https?://[^\\s/]+"), c)
