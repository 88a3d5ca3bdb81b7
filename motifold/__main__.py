"""Command line: ``python -m motifold load|infer|query`` (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession

from .plans.bgp import match_stats
from .plans.jobs import answer, infer_file, load_graph, open_triples
from .plans.query_text import parse_query
from .session import RECOMMENDED
from .sources.store import open_store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motifold")
    jobs = top.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("load", help="triple text to a stored graph")
    load.add_argument("source")
    load.add_argument("target")
    load.add_argument("--start", type=int, default=0, help="first node id")
    load.add_argument("--append", action="store_true", help="add to the graph that is there")
    load.add_argument("--text", action="store_true", help="also write vertex and edge lines")
    inf = jobs.add_parser("infer", help="add inferred triples to triple text")
    inf.add_argument("source")
    inf.add_argument("target")
    inf.add_argument("--prefix", required=True, help="IRI prefix of the university terms")
    query = jobs.add_parser("query", help="count the solutions of triple patterns")
    query.add_argument("source", help="triple text, or a loaded graph with --stored")
    query.add_argument("--stored", action="store_true")
    query.add_argument("--prefix", help="infer with the university rules first")
    query.add_argument("--pattern", nargs=3, action="append", default=[], metavar=("S", "P", "O"))
    query.add_argument("--query", default="", help="patterns as one text: ?x p ?y . ?y q ?z")
    query.add_argument("--stats", metavar="ROOT", help="print the counts of each stage for this variable")
    query.add_argument("--bind-data", action="store_true", help="bind attribute objects")
    query.add_argument("--rows", help="write the solutions to this folder")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    builder = SparkSession.builder.appName(f"motifold {args.job}")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    rejects = Observation("rejected lines")
    if args.job == "load":
        free = load_graph(spark, args.source, args.target, args.start, args.text, rejects, args.append)
        print("NEXT ID", free)
    elif args.job == "infer":
        infer_file(spark, args.source, args.target, args.prefix, rejects)
    else:
        patterns = [tuple(p) for p in args.pattern] + (parse_query(args.query) if args.query else [])
        if not patterns:
            raise SystemExit("give --pattern or --query")
        if args.stored:
            triples = open_store(spark, f"{args.source}/store")
        else:
            triples = open_triples(spark, args.source, args.prefix, rejects)
        if args.stats:
            for row in match_stats(triples, patterns, args.stats.removeprefix("?")).collect():
                print(row["stage"].upper(), row["n"])
        print("RESULT", answer(triples, patterns, args.rows, args.bind_data))
    if args.job != "query" or not args.stored:
        print("REJECTED LINES", rejects.get["n"])


if __name__ == "__main__":
    main()
