"""The whole path of a corpus: registry and files to active chunks, embeddings, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.functions.text import with_retrieval_text
from evidra.operators import documents, measures, versions
from evidra.operators.dense import hashing_embedder
from evidra.operators.search import Options, search
from evidra.sources.files import Store, read_sources, write_artifacts
from evidra.sources.registry import SCHEMA

VERSIONS = "version_id long, document_id string, sha256 string, pipeline_version string, is_active boolean, failed boolean, status string"
PAGES = "array<struct<page_number:int,method:string,needs_review:boolean>>"
EMBEDDINGS = "chunk_id string, embedding array<float>, dimension int, text_sha256 string, model string"
DRAFT = "DRAFT RESULTS - computed on evaluation cases that have not been reviewed by a domain expert. They indicate relative behaviour only and must not be reported as validated retrieval quality."


def overview(sources: DataFrame, held: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every source with its active version and count of chunks, if it has one."""
    live = held.where("is_active").select("document_id", "version_id", "version_label")
    counts = chunks.groupBy("version_id").agg(F.count("chunk_id").alias("chunks"))
    own = sources.select(F.col("id").alias("document_id"), "title_original", "legal_status")
    return own.join(live, "document_id", "left").join(counts, "version_id", "left").select("document_id", "title_original", "legal_status", "version_label", F.coalesce("chunks", F.lit(0)).alias("chunks"))


class Corpus:
    def __init__(self, spark: SparkSession, root: str, dimension: int = 256):
        self.spark, self.store, self.root = spark, Store(spark, root), root
        self.dimension, self.model, self.embed = dimension, f"test/hashing-{dimension}", hashing_embedder(dimension)

    def sync(self, registry: DataFrame) -> dict[str, int]:
        """Upsert the registry into sources; counts of created and updated rows."""
        done = versions.upsert(self.store.read("sources", SCHEMA.simpleString()[7:-1]), registry, "id").persist()
        counts = {r["change"]: r["count"] for r in done.groupBy("change").count().collect()}
        self.store.write("sources", done.drop("change"))
        done.unpersist()
        return {k: counts.get(k, 0) for k in ("created", "updated")}

    def ingest(self, registry: DataFrame, folder: str, force: bool = False, only: list[str] | None = None) -> DataFrame:
        """Status of each document of the registry: created, reprocessed, reactivated, skipped, failed or missing_file."""
        if only:
            asked = self.spark.createDataFrame([(i,) for i in only], "id string")
            if unknown := sorted(r["id"] for r in versions.unknown(asked, registry, "id").collect()):
                raise ValueError(f"unknown documents: {unknown}")
            registry = registry.where(F.col("id").isin(only))
        self.sync(registry)
        read = read_sources(self.spark, folder, registry).persist()
        arrived = read.where("pages is not null")
        old = self.store.read("versions", VERSIONS).drop("status")
        # What is there with this pipeline is skipped before the heavy stages.
        same = old.where((F.col("pipeline_version") == documents.PIPELINE) & F.lit(not force)).select("document_id", "sha256")
        made = documents.chunked(arrived.join(same, ["document_id", "sha256"], "left_anti")).persist()
        fresh = documents.ingest(arrived.select("document_id", "sha256"), old, made, force=force)
        fresh = self.store.write("versions", fresh)
        documents.check_one_active(fresh)
        kept = self.store.read("chunks", f"{documents.CHUNK}, warnings array<string>, embedding_input string, text_retrieval string, version_id long")
        kept = kept.join(made.select("version_id").distinct(), "version_id", "left_anti")
        write_artifacts(made, arrived, f"{self.root}/artifacts")
        self.store.write("chunks", kept.unionByName(made), ["document_id"])
        # Else a later run over changed files would find these rows in the cache.
        made.unpersist()
        read.unpersist()
        missing = read.where("pages is null").select("document_id", F.lit("missing_file").alias("status"))
        out = fresh.where("status is not null").select("document_id", "status").unionByName(missing)
        return out

    def versions(self) -> DataFrame:
        page = F.array(F.struct(F.lit(1).alias("page_number"), F.lit("plain_text").alias("method"), F.lit(False).alias("needs_review")))
        return self.store.read("versions", VERSIONS).withColumn("version_label", F.concat(F.lit("sha256:"), F.substring("sha256", 1, 12))).withColumn("extraction_method", F.lit("plain_text")).withColumn("page_methods", page.cast(PAGES))

    def update_embeddings(self) -> dict[str, int]:
        """Embed the active chunks whose vector is missing or stale; counts of embedded and up to date."""
        live = self.store.read("chunks").join(self.versions().where("is_active").select("version_id"), "version_id", "left_semi").select("chunk_id", "embedding_input")
        held = self.store.read("embeddings", EMBEDDINGS)
        sha = F.sha2("embedding_input", 256)
        told = versions.stale(live, held.where(F.col("model") == self.model), ["chunk_id"], {"text_sha256": sha, "dimension": F.lit(self.dimension)}).persist()
        counts = {r["state"]: r["count"] for r in told.groupBy("state").count().collect()}
        todo = with_retrieval_text(told.where("state <> 'current'"), "embedding_input", "folded")
        new = todo.select("chunk_id", self.embed(F.col("folded")).alias("embedding"), F.lit(self.dimension).alias("dimension"), sha.alias("text_sha256"), F.lit(self.model).alias("model"))
        rest = held.join(new.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti")
        self.store.write("embeddings", rest.unionByName(new), ["model"])
        told.unpersist()
        return {"embedded": counts.get("missing", 0) + counts.get("stale", 0), "up_to_date": counts.get("current", 0)}

    def search(self, questions: DataFrame, options: Options | None = None) -> DataFrame:
        vectors = self.store.read("embeddings", EMBEDDINGS).where(F.col("model") == self.model).select("chunk_id", "embedding")
        return search(questions, self.store.read("chunks"), self.versions(), self.store.read("sources"), vectors, self.embed, options=options)

    def health(self) -> dict[str, int]:
        live = self.versions().where("is_active")
        return {"active_versions": live.count(), "chunks": self.store.read("chunks").join(live, "version_id", "left_semi").count()}

    def overview(self) -> DataFrame:
        """Every source with its active version and count of chunks, if it has one."""
        return overview(self.store.read("sources"), self.versions(), self.store.read("chunks"))

    def evaluate(self, cases: dict[str, DataFrame], ks: list[int] = (1, 3, 5, 10), options: Options | None = None) -> dict:
        """Measures of each case, their means by direction, tag and all, and how top scores separate answerable cases."""
        o = options or Options()
        o = Options(**{**o.__dict__, "top_k": max(*ks, 10), "context": False})
        asked = cases["cases"].withColumnRenamed("case_id", "query_id")
        items = self.search(asked.select("query_id", "query"), o).persist()
        targets = cases["targets"].withColumnRenamed("case_id", "query_id")
        whole = targets.where("article_number is null").select("query_id", "document_id", F.lit(True).alias("whole")).distinct()
        own = items.select("query_id", "position", F.col("citation.document_id").alias("document_id"), F.col("citation.article_number").alias("article"), "chunk_type").join(whole, ["query_id", "document_id"], "left")
        article = F.when(F.col("whole"), None).when(F.col("article").isNull() & (F.col("chunk_type") == "preamble"), "preamble").otherwise(F.col("article"))
        unit = lambda a: F.concat_ws("#", "document_id", a)
        units = own.select("query_id", unit(article).alias("unit"), "position").groupBy("query_id", "unit").agg(F.min("position").alias("position"))
        ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
        per_case = measures.ranking_measures(ranked, targets.select("query_id", unit(F.col("article_number")).alias("unit"), "grade"), list(ks)).persist()
        languages = targets.join(self.store.read("sources").select(F.col("id").alias("document_id"), "original_language"), "document_id").groupBy("query_id").agg(F.collect_set("original_language").alias("l"))
        target = F.when(~F.col("answerable"), "none").when(F.size("l") == 1, F.col("l")[0]).otherwise("mixed")
        named = asked.join(languages, "query_id", "left").withColumn("direction", F.concat("query_language", F.lit("->"), target))
        tags = cases["tags"].withColumnRenamed("case_id", "query_id").groupBy("query_id").agg(F.collect_set(F.concat(F.lit("tag:"), "tag")).alias("tags"))
        groups = F.concat(F.array("direction"), F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("all")))
        names = [c for c in per_case.columns if c != "query_id"]
        summary = measures.mean_by_group(per_case.join(named, "query_id").join(tags, "query_id", "left"), groups, names)
        order = [F.col("group") == "all", F.col("group").startswith("tag:"), F.col("group")]
        tops = items.groupBy("query_id").agg(*(F.round(F.max(f"signal.{k}_score"), 4).alias(k) for k in ("dense", "rerank", "lexical"))).join(asked.select("query_id", "answerable"), "query_id")
        separation = {}
        for k in ("dense", "rerank", "lexical"):
            got = measures.auroc(tops.select(F.col(k).alias("score"), F.col("answerable").alias("positive"))).first()
            if got["positives"] and got["negatives"]:
                good, bad = tops.where("answerable"), tops.where("not answerable")
                a, b = good.agg(F.round(F.avg(k), 4), F.min(k)).first(), bad.agg(F.round(F.avg(k), 4), F.max(k)).first()
                separation[k] = {"answerable_mean": a[0], "answerable_min": a[1], "unanswerable_mean": b[0], "unanswerable_max": b[1], "auroc": got["auroc"]}
        reviews = {r["review_status"]: r["count"] for r in asked.groupBy("review_status").count().collect()}
        validated = set(reviews) == {"reviewed"}
        report = {"validated": validated, "notice": None if validated else DRAFT, "review_status": reviews, "summary": {r["group"]: {k: v for k, v in r.asDict().items() if k != "group"} for r in summary.orderBy(*order).collect()}, "score_separation": separation, "cases": [r.asDict() for r in per_case.orderBy("query_id").collect()]}
        items.unpersist()
        per_case.unpersist()
        return report


def format_report(report: dict) -> str:
    """The means by group as text, and the cases without any relevant unit."""
    lines = [f"*** {report['notice']} ***"] if report["notice"] else []
    for name, row in report["summary"].items():
        lines.append(f"{name:<16} {row['cases']:>3} " + " ".join(f"{k}={v:.3f}" for k, v in row.items() if k != "cases"))
    lines += [f"top {k} score: " + ", ".join(f"{n} {v}" for n, v in s.items()) for k, s in report["score_separation"].items()]
    if misses := [c["query_id"] for c in report["cases"] if c["mrr"] == 0]:
        lines.append(f"no relevant unit retrieved for: {', '.join(misses)}")
    return "\n".join(lines)
