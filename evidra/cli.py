"""Command line: sync, ingest, embed, search, evaluate, health and overview of a corpus folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from evidra.operators.corpus import Corpus, format_report
from evidra.operators.filters import Filters
from evidra.operators.search import Options
from evidra.sources.registry import load_cases, load_registry

#: Limits of a question and of its answers.
MOST_CHARS, MOST_ITEMS = 500, 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidra", description=__doc__)
    p.add_argument("--root", required=True, help="folder of the tables")
    p.add_argument("--dimension", type=int, default=256, help="of the hashing embedder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("sync", "ingest"):
        s = sub.add_parser(name)
        s.add_argument("registry")
        if name == "ingest":
            s.add_argument("folder")
            s.add_argument("--only", nargs="*")
            s.add_argument("--force", action="store_true")
    for name in ("embed", "health", "overview"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", choices=["dense", "hybrid", "lexical"], default="dense")
    s.add_argument("--top-k", type=int, default=8)
    s.add_argument("--doc", nargs="*", default=[])
    s.add_argument("--history", action="store_true")
    s.add_argument("--no-context", action="store_true")
    s.add_argument("--json", action="store_true")
    s = sub.add_parser("evaluate")
    s.add_argument("cases")
    s.add_argument("--mode", choices=["dense", "hybrid", "lexical"], default="dense")
    s.add_argument("--out")
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    corpus = Corpus(spark, a.root, a.dimension)
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str), file=out)
    if a.command == "sync":
        say(corpus.sync(load_registry(spark, a.registry)))
    elif a.command == "ingest":
        for r in corpus.ingest(load_registry(spark, a.registry), a.folder, a.force, a.only).orderBy("document_id").collect():
            say(r.asDict())
    elif a.command == "embed":
        say(corpus.update_embeddings())
    elif a.command == "health":
        say(corpus.health())
    elif a.command == "overview":
        for r in corpus.overview().orderBy("document_id").collect():
            say(r.asDict())
    elif a.command == "search":
        question = a.query.strip()
        if not question or len(question) > MOST_CHARS:
            print(f"a question has 1 to {MOST_CHARS} characters", file=sys.stderr)
            return 2
        options = Options(mode=a.mode, top_k=max(1, min(a.top_k, MOST_ITEMS)), context=not a.no_context, filters=Filters(document_ids=a.doc, include_history=a.history))
        items = corpus.search(spark.createDataFrame([(1, question)], "query_id long, query string"), options).orderBy("position").collect()
        for r in items:
            if a.json:
                say(r.asDict(recursive=True))
            else:
                c = r["citation"]
                print(f"{r['position']}. {c['title_original']} | {c['article_number'] or '-'} | {r['relation']}\n   {r['text_original'][:200]}", file=out)
        if not items:
            print("no evidence found for this query and these filters", file=out)
    else:
        report = corpus.evaluate(load_cases(spark, a.cases), options=Options(mode=a.mode))
        print(format_report(report), file=out)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                json.dump(report, f, ensure_ascii=False, indent=2, default=str)
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("evidra").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(session, sys.argv[1:]))
