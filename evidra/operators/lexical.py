"""Terms of texts and BM25, for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import STOPWORDS, TOKEN, light_stem


def terms(df: DataFrame, folded: Column, *keep: str) -> DataFrame:
    """The columns keep and ``term``: a row for each term of a folded text, or one with a null term if it has none.

    The same terms as functions.text.tokenize; rows rather than arrays, so that all of it is generated code and stop words are
    looked up in a hash set.
    """
    raw = df.select(*keep, F.explode_outer(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))).alias("raw"))
    read = raw.select(*keep, "raw", F.col("raw").rlike("^\\p{Nd}").alias("number"), light_stem(F.col("raw")).alias("stem"))
    word = F.when(~F.col("raw").isin(STOPWORDS) & ~F.col("stem").isin(STOPWORDS), F.col("stem"))
    told = read.select(*keep, "raw", "number", F.when(F.col("number"), F.col("raw")).otherwise(word).alias("term"))
    dotted = F.col("number") & F.contains("raw", F.lit("."))
    return told.select(*keep, F.explode(F.when(dotted, F.array(F.col("raw"), F.substring_index("raw", ".", 1))).otherwise(F.array("term"))).alias("term"))


def bm25(corpus: DataFrame, questions: DataFrame, top_k: int = 40, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, score and rank of each question's best documents.

    corpus: id, term (as terms gives them); questions: query_id, term. Statistics come from all of the corpus; allowed (id)
    only limits what may be returned. The text is read once, and terms that no question has are counted but not
    shuffled: each document sends a row for each of the questions' terms it has, and one for all others.
    """
    asked = questions.where("term is not null").select("query_id", "term").distinct()
    # The distinct terms of a batch of questions: each question has 500 characters at most.
    wanted = F.broadcast(asked.select("term", F.lit(True).alias("wanted")).dropDuplicates(["term"]))
    counted = corpus.join(wanted, "term", "left").groupBy("id", F.when(F.col("wanted"), F.col("term")).alias("term")).agg(F.count(F.col("term")).alias("tf"))
    own = Window.partitionBy("id")
    sized = counted.withColumn("length", F.sum("tf").over(own))
    by_doc = counted.groupBy("id").agg(F.sum("tf").alias("length"))
    stats = by_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    postings = sized.where("term is not null")
    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = postings.join(F.broadcast(held), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))
    weighed = rated.select("id", "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("part"))
    if allowed is not None:
        weighed = weighed.join(allowed.select("id").distinct(), "id", "left_semi")
    scores = weighed.join(F.broadcast(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scores, top_k)


def top(scores: DataFrame, k: int, *by) -> DataFrame:
    """The k best of each question, best first; ties by id."""
    order = by or (F.desc("score"), F.asc("id"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)
