"""Commands: ``python -m corpusloom ingest|index|evaluate ...``; the exit code is 1 where a command fails."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import lifecycle
from corpusloom.plans.ingest import ingest
from corpusloom.runtime import path_exists
from corpusloom.service import Service
from corpusloom.sources import readers, writers
from corpusloom.sources.pdf import extract_pdf


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="files of one folder for each category to chunks")
    one.add_argument("--config", required=True, help="JSON settings with the sections ingest and chunking")
    two = commands.add_parser("index", help="chunks to an index")
    two.add_argument("--chunks", required=True)
    two.add_argument("--path", required=True)
    two.add_argument("--force-rebuild", action="store_true")
    two.add_argument("--resume", action="store_true", help="go on with a begun index, never overwrite a complete one")
    three = commands.add_parser("evaluate", help="metrics of the cases over an index")
    three.add_argument("--path", required=True)
    three.add_argument("--cases", required=True)
    three.add_argument("--out", required=True)
    three.add_argument("--k-values", default="1,3,5,10")
    return out


def raw_documents(spark: SparkSession, config: readers.Config) -> DataFrame:
    """The documents of all category folders with their metadata: sidecar first, then folder, then what the settings say of the category."""
    names = spark.createDataFrame([(c["name"], c.get("jurisdiction", "")) for c in config.categories], "name string, jurisdiction string")
    found = None
    for category in config.categories:
        folder = f"{config.raw_dir}/{category['name']}"
        rows = readers.read_documents(spark, folder, category["name"], category.get("jurisdiction", ""), extractors={"pdf": extract_pdf})
        sidecars = readers.read_sidecars(spark, folder) if path_exists(spark, folder) else readers.no_sidecars(spark)
        rows = readers.with_metadata(rows, sidecars, names)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("there are no categories")
    return found


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The command's result as a short report."""
    if args.command == "ingest":
        with open(args.config, encoding="utf-8") as f:
            config = readers.load_config(json.load(f))
        routes = {c["name"]: (c.get("strategy", config.strategy), c.get("preset")) for c in config.categories}
        chunks = ingest(raw_documents(spark, config), routes, config.use_summary, config.summary_chars, max_chars=config.max_chars)
        out = f"{config.processed_dir}/{config.chunks_file}"
        writers.write_chunks(chunks, out)
        return {"chunks": readers.count_lines(spark, out), "path": out}
    if args.command == "index":
        chunks = readers.require_unique(readers.read_chunks(spark, args.chunks))
        manifest = lifecycle.build_or_keep(chunks, args.path, resume=True) if args.resume else lifecycle.build_index(chunks, args.path, force=args.force_rebuild)
        return {"chunks": manifest.chunk_count, "path": args.path}
    report = Service(spark, args.path, spark.createDataFrame([], "chunk_id string, text string"), lambda system, user: "", readers.read_cases(spark, args.cases)).evaluate(args.k_values)
    writers.write_report(spark.range(1).select(F.lit(json.dumps(report)).alias("report")), args.out)
    return report


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        print(json.dumps(run(spark, args)))
    except Exception as error:
        print(f"{args.command} failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
