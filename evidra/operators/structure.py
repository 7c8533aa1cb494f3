"""Legal structure of documents and their cutting into citable chunks, as one plan that stays in the JVM.

A document's lines are an array in its row, so that structure needs no shuffle: lines are marked one by one, the marks that
are headings are numbered by a fold (an article's number depends on the one before), and segments are slices of the
lines between headings. Segments become rows, and then pieces; only equal keys of a version are told apart over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidra.functions import legal
from evidra.functions.text import LINE_ENDS, count_tokens, detect_language, normalize_digits, slug, strip, truncate_words
from evidra.operators import windows

# Names in headers, and caveats.
LABELS = {
    "article": ("المادة", "Article"),
    "paragraph": ("الفقرة", "Paragraph"),
    "preamble": ("الديباجة", "Preamble"),
    "history": ("تعديلات (نص تاريخي)", "Amendment history"),
    "table": ("جدول", "Table"),
}
INFERRED_CAVEAT = "The article number was inferred from document order because the heading number was unreadable; verify it against the source document before citing."
HISTORY_CAVEAT = "Amendment annotation from the consolidated text. Wording quoted here may be superseded and is not necessarily in force."

LINES = "array<struct<page:int,text:string>>"
HEAD = "struct<at:int,page:int,kind:string,number:string,source:string,section:string,heading:string,body:string,warning:string>"
SEGMENT = f"struct<kind:string,number:string,source:string,section:string,heading:string,warning:string,lines:{LINES},history:{LINES},title:string,defines:boolean,page:int,rows:array<array<string>>>"
PIECE = f"struct<key:string,chunk_type:string,context_header:string,lines:{LINES},parent_key:string,part_index:int,part_count:int,definition_term:string,caveats:array<string>>"


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 450
    overlap: int = 60
    table_rows: int = 25


def _typed(schema: str, **fields: Column) -> Column:
    """A struct of a type; fields that aren't given are null."""
    names = T.DataType.fromDDL(schema).fieldNames()
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(schema)


def _label(name: str) -> Column:
    arabic, english = LABELS[name]
    return F.when(F.col("language") == "en", english).otherwise(arabic)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def cut_at(items: Column, opens) -> Column:
    """Struct of ``lead`` (items before the first that opens a group) and ``groups``. opens: of an item and its index."""

    def cut(own: Column) -> Column:
        starts = F.filter(F.transform(own, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())
        return _let(starts, lambda s: F.struct(
            F.slice(own, F.lit(1), F.coalesce(F.get(s, F.lit(0)), F.size(own))).alias("lead"),
            F.transform(s, lambda a, j: F.slice(own, a + 1, F.coalesce(F.get(s, j + 1), F.size(own)) - a)).alias("groups"),
        ))

    return _let(items, cut)


def lines_of(pages: Column) -> Column:
    """The lines of all pages that aren't blank, with their page."""
    of = lambda p: F.transform(F.split(F.coalesce(p["text"], F.lit("")), LINE_ENDS, -1), lambda t: F.struct(p["page"].cast("int").alias("page"), t.alias("text")))
    return F.coalesce(F.filter(F.flatten(F.transform(pages, of)), lambda x: strip(x["text"]) != ""), F.array().cast(LINES))


def _numbered(marks: Column, style: Column) -> Column:
    """The accepted headings in order, with numbers. marks: at, page, text, m; style: arabic, article or paragraph.

    An Arabic article that can be read and is at most a few numbers ahead keeps its number, others follow the one before;
    a bis article shares it. An English paragraph counts only if its number is the next one of its section.
    """
    start = F.struct(
        F.array(_typed(HEAD, at=F.lit(-1), kind=F.lit("preamble"))).alias("heads"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("int").alias("last"), F.lit(1).alias("due"),
    )
    arabic, paragraph = style == "arabic", style == "paragraph"

    def resolve(s: Column, x: Column) -> Column:
        read, bis, last = x["m"]["read"], x["m"]["bis"], s["last"]
        ahead = read - F.coalesce(last, F.lit(0))
        fits = F.coalesce((ahead <= legal.JUMP) & (last.isNull() | (ahead > 0)), F.lit(False))
        base = F.coalesce(last, F.when(read > 0, read), F.lit(1))
        number = F.when(bis, base).when(fits, read).otherwise(F.coalesce(last, F.lit(0)) + 1)
        sure = F.when(bis, F.coalesce(read == base, F.lit(False))).otherwise(fits)
        return F.struct(number.alias("number"), sure.alias("sure"))

    def step(s: Column, x: Column) -> Column:
        m, heading = x["m"], strip(x["text"])

        def put(r: Column) -> Column:
            label = F.when(m["bis"], F.concat_ws(" ", r["number"].cast("string"), F.lit(legal.BIS))).otherwise(r["number"].cast("string"))
            lost = F.concat(F.lit("article heading '"), heading, F.lit("' on page "), x["page"].cast("string"), F.lit(": number unreadable or out of sequence; inferred as "), label)
            jump = F.concat(F.lit("article numbering jumps from "), s["last"].cast("string"), F.lit(" to "), label, F.lit(" (page "), x["page"].cast("string"), F.lit(")"))
            warning = F.when(arabic & ~m["bis"], F.when(~r["sure"], lost).when(r["number"] > s["last"] + 1, jump))
            head = _typed(
                HEAD, at=x["at"], page=x["page"], kind=F.when(paragraph, "paragraph").otherwise("article"),
                number=F.when(arabic, label).otherwise(m["told"]), source=F.when(arabic & ~r["sure"], "inferred").otherwise("parsed"),
                section=s["section"], body=F.nullif(m["body"], F.lit("")), warning=warning,
                heading=F.when(arabic & m["body"].isNotNull(), strip(F.substring(x["text"], F.lit(1), F.length(x["text"]) - F.length(m["body"])))).otherwise(heading),
            )
            is_section = m["section"].isNotNull()
            taken = ~is_section & (~paragraph | F.coalesce(m["read"] == s["due"], F.lit(False)))
            return F.struct(
                F.when(taken, F.concat(s["heads"], F.array(head))).otherwise(s["heads"]).alias("heads"), F.coalesce(m["section"], s["section"]).alias("section"),
                F.when(taken & arabic, r["number"]).otherwise(s["last"]).alias("last"),
                F.when(is_section, 1).when(taken, s["due"] + 1).otherwise(s["due"]).alias("due"),
            )

        return _let(resolve(s, x), put)

    return F.aggregate(marks, start, step, lambda s: s["heads"])


def _finished(kind: Column, head: Column, lines: Column) -> Column:
    """A segment: its lines in force, the history behind them, its title and whether it defines terms."""
    cut = F.array_position(F.transform(lines, lambda x: legal.is_amendment(x["text"])), True).cast("int")
    own = F.when(cut > 0, F.slice(lines, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(lines)
    history = F.when(cut > 0, F.slice(lines, F.greatest(cut, F.lit(1)), F.size(lines))).otherwise(F.array().cast(LINES))
    told = {c: head[c] for c in ("number", "source", "section", "heading", "warning")}
    title = lambda o: F.when(kind == "article", legal.title(F.get(o, F.lit(0))["text"]))
    return _let(own, lambda o: _typed(SEGMENT, kind=kind, **told, lines=o, history=history, title=title(o), defines=legal.defines(joined(o), kind != "preamble")))


def structured(documents: DataFrame) -> DataFrame:
    """documents (language, pages) with ``segments``, an array, and ``warnings``. A language other than en is read as Arabic."""
    english = F.col("language") == "en"
    told = documents.withColumn("__lines", lines_of(F.col("pages")))
    by_article = F.exists("__lines", lambda x: x["text"].rlike(legal.ENGLISH_ARTICLE))
    told = told.withColumn("__style", F.when(english, F.when(by_article, "article").otherwise("paragraph")).otherwise("arabic"))
    mark = lambda t: F.when(F.col("__style") == "arabic", legal.arabic_mark(t)).otherwise(legal.english_mark(t, F.col("__style") == "article"))
    told = told.withColumn("__marks", F.transform("__lines", lambda x, i: F.struct(i.cast("int").alias("at"), x["page"].alias("page"), x["text"].alias("text"), mark(x["text"]).alias("m"))))
    told = told.withColumn("__heads", _numbered(F.filter("__marks", lambda x: x["m"]["heading"] | x["m"]["section"].isNotNull()), F.col("__style")))
    plain = F.size("__heads") == 1

    def segment(h: Column, i: Column) -> Column:
        until = F.coalesce(F.get(F.col("__heads"), i + 1)["at"], F.size("__marks"))
        behind = F.filter(F.slice(F.col("__marks"), h["at"] + 2, until - h["at"] - 1), lambda x: x["m"]["section"].isNull())
        behind = F.transform(behind, lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))
        first = F.when(h["body"].isNotNull(), F.array(F.struct(h["page"].alias("page"), h["body"].alias("text")))).otherwise(F.array().cast(LINES))
        return _let(F.concat(first, behind), lambda lines: _finished(F.when(plain, "text").otherwise(h["kind"]), h, lines))

    told = told.withColumn("__all", F.transform("__heads", segment))
    kept = F.filter("__all", lambda s: (F.size(s["lines"]) > 0) | (F.size(s["history"]) > 0) | s["heading"].isNotNull())
    bare = lambda s: F.when(s["heading"].isNotNull() & (F.size(s["lines"]) == 0), F.concat(_base(s), F.lit(": heading without body text")))
    none = F.when(plain, F.array(F.lit("no headings found; document will be chunked without structure"))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(F.array_compact(F.transform("__all", lambda s: s["warning"])), none, F.array_compact(F.transform("__all", bare)))
    return told.withColumn("segments", kept).withColumn("warnings", warnings).drop("__lines", "__style", "__marks", "__heads", "__all")


def _base(s) -> Column:
    return F.concat(F.when(s["kind"] == "article", "art-").otherwise("para-"), slug(F.coalesce(s["number"], F.lit("0"))))


def windowed(lines: Column, limits: Limits) -> Column:
    """Overlapping windows of words; the words of a page within a window make one line."""
    words = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit("(?U)\\S+"), F.lit(0)), lambda w: F.struct(x["page"].alias("page"), w.alias("text")))))
    line = lambda g: F.struct(g[0]["page"].alias("page"), F.array_join(F.transform(g, lambda w: w["text"]), " ").alias("text"))

    def pages(window: Column) -> Column:
        turns = cut_at(window, lambda w, i: (i == 0) | (w["page"] != F.get(window, i - 1)["page"]))
        alone = F.size(F.array_distinct(F.transform(window, lambda w: w["page"]))) == 1
        return F.when(alone, F.array(line(window))).otherwise(F.transform(turns["groups"], line))

    return F.transform(windows.overlapping(words, limits.max_tokens, limits.overlap), lambda w: _let(w, pages))


def packed(units: Column, limits: Limits) -> Column:
    """Units (arrays of lines) put together up to the limit; a unit over it is cut into windows of its own."""
    size = lambda lines: count_tokens(joined(lines))

    def parts(numbers: Column, own: Column) -> Column:
        groups = cut_at(own, lambda u, i: (i == 0) | (F.get(numbers, i) != F.get(numbers, i - 1)))["groups"]
        return F.flatten(F.transform(F.transform(groups, F.flatten), lambda p: F.when(size(p) > limits.max_tokens, windowed(p, limits)).otherwise(F.array(p))))

    return _let(units, lambda own: _let(windows.greedy_pack(F.transform(own, size), limits.max_tokens), lambda n: parts(n, own)))


def _pieces(limits: Limits) -> Column:
    """The pieces that a segment's row is cut into, in order."""
    kind, lines, over = F.col("kind"), F.col("lines"), count_tokens(joined(F.col("lines"))) > limits.max_tokens
    base = F.when(kind == "preamble", "preamble").otherwise(_base({c: F.col(c) for c in ("kind", "number")}))
    name = F.when(kind == "preamble", _label("preamble")).otherwise(F.concat(F.when(kind == "article", _label("article")).otherwise(_label("paragraph")), F.lit(" "), F.col("number")))
    header = F.concat_ws(" | ", "doc_title", "section", name, F.nullif(F.col("title"), F.lit("")))
    whole = F.when(kind == "preamble", "preamble").otherwise("article")
    none = F.array().cast(f"array<{PIECE}>")

    def later(lead: Column) -> Column:
        told = truncate_words(joined(lead), legal.LEAD_WORDS)
        return F.when(told != "", F.concat(header, F.lit("\n"), told)).otherwise(header)

    def text(windows_: Column) -> Column:
        return F.transform(windows_, lambda w, i: _typed(PIECE, key=F.concat(F.lit("text-"), (i + 1).cast("string")), chunk_type=F.lit("text"), context_header=F.col("doc_title"), lines=w, part_index=F.lit(0), part_count=F.lit(1)))

    def parts(c: Column) -> Column:
        units = F.concat(F.filter(F.array(c["lead"]), lambda x: F.size(x) > 0), c["groups"])
        return _let(packed(units, limits), lambda all_: F.transform(all_, lambda p, i: _typed(
            PIECE, key=F.concat(base, F.lit(".p"), (i + 1).cast("string")), chunk_type=F.when(kind == "preamble", "preamble").otherwise("article_part"),
            context_header=F.when(i > 0, later(c["lead"])).otherwise(header), lines=p, parent_key=base, part_index=i, part_count=F.size(all_),
        )))

    def terms(c: Column) -> Column:
        return F.transform(c["groups"], lambda g, i: _typed(
            PIECE, key=F.concat(base, F.lit(".def-"), (i + 1).cast("string")), chunk_type=F.lit("definitions"), context_header=F.when(i > 0, later(c["lead"])).otherwise(header),
            lines=F.when(i > 0, g).otherwise(F.concat(c["lead"], g)), parent_key=base, part_index=i, part_count=F.size(c["groups"]),
            definition_term=legal.defined_term(g[0]["text"]),
        ))

    one = F.array(_typed(PIECE, key=base, chunk_type=whole, context_header=header, lines=lines, part_index=F.lit(0), part_count=F.lit(1)))
    body = F.when(F.size(lines) == 0, none).when(over, _let(cut_at(lines, lambda x, i: legal.is_clause(x["text"])), parts)).otherwise(one)
    # The first line is no term where it is the article's title.
    by_term = cut_at(lines, lambda x, i: legal.defined_term(x["text"]).isNotNull() & ((i > 0) | F.col("title").isNull()))
    own = F.when(F.col("defines") & (kind != "preamble"), _let(by_term, lambda c: F.when(F.size(c["groups"]) >= 2, terms(c)).otherwise(body))).otherwise(body)
    past = F.array(_typed(
        PIECE, key=F.concat(base, F.lit(".hist")), chunk_type=F.lit("amendment_history"), context_header=F.concat_ws(" | ", header, _label("history")),
        lines=F.col("history"), parent_key=base, part_index=F.lit(0), part_count=F.lit(1), caveats=F.array(F.lit(HISTORY_CAVEAT)),
    ))
    history = F.when((kind != "preamble") & (F.size("history") > 0), past).otherwise(none)
    return F.when(kind == "text", text(F.when(over, windowed(lines, limits)).otherwise(F.array(lines)))).otherwise(F.concat(own, history))


def _table_pieces(limits: Limits) -> Column:
    """A table's rows as Markdown, in groups that each repeat the first row; ``number`` is its place from 1."""
    rows, width = F.col("rows"), F.array_max(F.transform("rows", F.size))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    shown = F.transform(rows, lambda r: row(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = row(F.array_repeat(F.lit("---"), width))
    count = F.greatest(F.ceil((F.size(rows) - 1) / limits.table_rows).cast("int"), F.lit(1))
    key, several = F.concat(F.lit("table-"), F.col("number")), count > 1

    def piece(own: Column, i: Column) -> Column:
        text = F.array_join(F.concat(F.array(own[0], rule), F.slice(own, i * limits.table_rows + 2, F.lit(limits.table_rows))), "\n")
        return _typed(
            PIECE, key=F.when(several, F.concat(key, F.lit(".p"), (i + 1).cast("string"))).otherwise(key), chunk_type=F.lit("table"),
            context_header=F.concat(F.col("doc_title"), F.lit(" | "), _label("table"), F.lit(" "), F.col("number")),
            lines=F.array(F.struct(F.col("page").alias("page"), text.alias("text"))), parent_key=F.when(several, key), part_index=i, part_count=count,
        )

    return _let(shown, lambda own: F.transform(F.sequence(F.lit(0), count - 1), lambda i: piece(own, i)))


def chunks(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a chunk, with ``warnings`` of its version.

    documents: document_id, sha256, title, language, pages (array of page, text) and tables (array of page, rows).
    Null pages or tables are none. Chunks of a version with the same key are told apart by ``~2`` and so on.
    """
    own = structured(documents.withColumn("doc_title", F.coalesce("title", F.lit(""))))
    who = ["document_id", "sha256", "language", "doc_title", "warnings"]
    filled = F.filter(F.coalesce(F.col("tables"), F.array()), lambda t: F.size(t["rows"]) > 0)
    tables = F.transform(filled, lambda t, i: _typed(SEGMENT, kind=F.lit("table"), number=(i + 1).cast("string"), page=t["page"], rows=t["rows"]))
    units = own.select(*who, F.posexplode(F.concat("segments", tables)).alias("place", "s")).select(*who, "place", "s.*")
    made = F.when(F.col("kind") == "table", _table_pieces(limits)).otherwise(_pieces(limits))
    number = F.when(F.col("kind") != "table", F.col("number")).alias("number")
    cut = units.withColumn("pieces", made).select(*who, "place", number, "source", "section", F.col("title").alias("heading"), "pieces")
    pieces = cut.select(*[c for c in cut.columns if c != "pieces"], F.posexplode("pieces").alias("nth", "piece"))
    filled = pieces.select(*[c for c in pieces.columns if c != "piece"], "piece.*").withColumn("text_original", joined(F.col("lines")))
    return _told_apart(filled.where(strip(F.col("text_original")) != ""))


def _told_apart(pieces: DataFrame) -> DataFrame:
    """Pieces as chunks with distinct keys."""
    version = Window.partitionBy("document_id", "sha256")
    # Both windows are on one distribution, that of versions, so there is one shuffle.
    spread = pieces.repartition("document_id", "sha256")
    same = Window.partitionBy("document_id", "sha256", "key").orderBy("place", "nth")
    base, text = F.col("key"), F.col("text_original")
    ranked = spread.withColumn("copy", F.row_number().over(same))
    key = F.when(F.col("copy") > 1, F.concat_ws("~", base, F.col("copy").cast("string"))).otherwise(base)
    again = F.when(F.col("copy") > 1, F.concat(F.lit("duplicate chunk key "), base, F.lit("; disambiguated as "), key))
    told = detect_language(text)
    caveats = F.concat(F.coalesce("caveats", F.array().cast("array<string>")), F.when(F.col("source") == "inferred", F.array(F.lit(INFERRED_CAVEAT))).otherwise(F.array().cast("array<string>")))
    return ranked.withColumn("again", F.collect_list(again).over(version)).select(
        "document_id", "sha256", F.concat("document_id", F.lit("@"), F.substring("sha256", 1, 12), F.lit("#"), key).alias("chunk_id"), key.alias("key"), "chunk_type",
        normalize_digits(F.col("number")).alias("article_number"), F.col("source").alias("number_source"),
        F.when(F.col("section").isNotNull(), F.array("section")).otherwise(F.array().cast("array<string>")).alias("section_path"), "heading", "definition_term",
        F.col("lines")[0]["page"].alias("page_start"), F.element_at("lines", -1)["page"].alias("page_end"),
        F.when(told == "unknown", F.col("language")).otherwise(told).alias("language"), "text_original", "context_header", "part_index", "part_count", "parent_key",
        legal.cross_references(text).alias("cross_references"), caveats.alias("caveats"), F.sha2(text, 256).alias("content_sha256"),
        count_tokens(text).alias("token_count"), F.concat("warnings", "again").alias("warnings"),
    )
