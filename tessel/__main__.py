"""Command line: python -m tessel build|query|catalogue|validate|score|describe|documents|units|export|smoke|serve ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def positive(text: str) -> int:
    if (value := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def port(text: str) -> int:
    if not 1 <= (value := int(text)) <= 65_535:
        raise argparse.ArgumentTypeError("must be between 1 and 65535")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessel")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [commands.choices.get(name) or commands.add_parser(name), *(commands.choices[name].add_argument(a) for a in args)][0]
    add("build", "corpus", "index").add_argument("--dim", type=positive, default=32)
    query = add("query", "index", "text")
    query.add_argument("--dim", type=positive, default=32)
    query.add_argument("--top", type=positive, default=10)
    add("catalogue", "index").add_argument("--dim", type=positive, default=32)
    add("validate", "corpus")
    score = add("score", "benchmark", "results")
    score.add_argument("--cutoffs", type=positive, nargs="+", default=[1, 3, 5, 10])
    add("describe").add_argument("catalogues", nargs="+")
    for name in ("documents", "units"):  # results never go beside the inputs unasked
        command = add(name)
        command.add_argument("catalogues", nargs="+")
        command.add_argument("--out", required=True)
    add("export", "benchmark", "corpus", "csv").add_argument("--limit", type=int, default=500)
    add("smoke", "index").add_argument("--dim", type=positive, default=32)
    serve = add("serve", "index")
    serve.add_argument("--dim", type=positive, default=32)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=port, default=8080)
    serve.add_argument("--max-concurrency", type=positive, default=2)
    return out


def reference_answerer(index):
    """Answers with evidence only: a plan of the request itself, without models."""
    from .operators.agent import Loop
    from .plans.answer import Retriever

    own = Retriever(index)
    loop = Loop(lambda request, before, gaps: {"task": "compare", "queries": [request]}, own.retrieve, own.pack, lambda *a: {"status": "sufficient"}, lambda *a: {}, most=0)
    return lambda r: loop.run(r["question"], r["top_k"], reference_only=True)


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    from .operators import benchmark, evaluation
    from .plans import corpus
    from .plans.index import Index, build, hash_embedder

    if args.command == "validate":
        return corpus.validate(spark, args.corpus)
    if args.command == "score":
        samples, every = benchmark.load(spark, args.benchmark), benchmark.results(spark, args.results)
        results = every.where("not failed")
        truth = samples.select(F.col("id").alias("sample_id"), F.explode("relevance").alias("r")).select("sample_id", F.col("r.evidence_id").alias("item_id"), "r.grade", "r.required")
        ranks = results.select(F.col("id").alias("sample_id"), F.posexplode("ranking").alias("rank", "item_id")).withColumn("rank", F.col("rank") + 1)
        scored = evaluation.metrics(truth, ranks, args.cutoffs, answered=results.select(F.col("id").alias("sample_id"))).join(samples.select(F.col("id").alias("sample_id"), "task", "split"), "sample_id")
        left_out = evaluation.unscored(samples.select(F.col("id").alias("sample_id")), every.select(F.col("id").alias("sample_id"), "failed")).orderBy("why", "sample_id").collect()
        means = evaluation.means(scored.withColumn("cutoff", F.col("k")), ["recall", "required_recall", "mrr", "ndcg"], ["task", "split", "cutoff"]).collect()
        return {"means": [r.asDict() for r in means], **{why: [r["sample_id"] for r in left_out if r["why"] == why] for why in ("missing", "failed", "extra")}}
    if args.command in ("describe", "documents", "units"):
        from .operators.parse import parse_units
        from .sources.catalogue import catalogue
        from .sources.documents import source_documents
        from .sources.jsonl import write_jsonl

        sources = [r.asDict() for r in catalogue(spark, args.catalogues).collect()]  # a catalogue is a short file
        if args.command == "describe":
            return {"source_count": len(sources), "sources": [{k: s[k] for k in ("doc_id", "title", "jurisdiction", "law_family", "download_mode", "target_path")} for s in sources]}
        documents = source_documents(spark, sources)
        write_jsonl(documents if args.command == "documents" else parse_units(documents), args.out)
        return {"out": args.out, "rows": spark.read.text(args.out).count()}
    if args.command == "export":
        tables = corpus.read(spark, args.corpus)
        units = tables["legal_units"].select(F.concat(F.lit("law_unit:"), "unit_id").alias("evidence_id"), "text")
        cases = tables["gdprhub_cases"].select(F.concat(F.lit("case:"), "case_id").alias("evidence_id"), F.concat_ws("\n", "facts_text", "decision_text").alias("text"))
        evidence, samples = units.unionByName(cases), benchmark.load(spark, args.benchmark)
        if lost := [r["evidence_id"] for r in benchmark.unknown_ids(samples, evidence).limit(20).collect()]:
            raise ValueError(f"not in the corpus: {', '.join(sorted(lost))}")
        return {"rows": benchmark.write_annotation_csv(spark, benchmark.annotation_rows(samples, evidence, args.limit), args.csv)}
    embed, model = hash_embedder(args.dim), f"hash-{args.dim}"
    if args.command == "build":
        return build(spark, args.corpus, args.index, embed, model, args.dim)
    index = Index(spark, args.index, embed, model)
    if args.command == "smoke":
        return {"ok": bool(reference_answerer(index)({"question": "Article 6", "top_k": 3})["evidence"]), **index.meta}
    if args.command == "serve":
        from .service import server

        with server(reference_answerer(index), args.host, args.port, index=args.index, most_at_once=args.max_concurrency) as own:
            own.serve_forever()
    if args.command == "catalogue":
        return [r.asDict(recursive=True) for r in index.catalogue().collect()]
    return [r.asDict() for r in index.evidence(index.search([("request", args.text)], limit=args.top), True).orderBy("rank").collect()]


def main() -> None:
    args = parser().parse_args()
    print(json.dumps(run(SparkSession.builder.appName("tessel").getOrCreate(), args), ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
