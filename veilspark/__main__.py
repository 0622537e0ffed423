"""python -m veilspark redact | ingest | query | serve"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark import ship
from veilspark.plans import retrieval
from veilspark.plans.service import Service, server
from veilspark.sources import config, documents


def _documents(spark: SparkSession, path: str):
    """The files at a path with the language of each."""
    return documents.read_documents(spark, path).withColumn("lang", retrieval.detected_language(F.col("text")))


def redact(spark: SparkSession, settings: dict, args: argparse.Namespace) -> None:
    masked = retrieval.filtered(_documents(spark, args.path))
    if args.write_file:
        documents.write_sidecars(masked, settings["redacted_path"])
        print(settings["redacted_path"])
    else:
        for row in masked.toLocalIterator():
            print(row["text"])


def ingest(spark: SparkSession, settings: dict, args: argparse.Namespace) -> None:
    added = retrieval.ingest(_documents(spark, args.path), settings["index_path"], settings["metadata_path"], int(settings["chunk_size"]), int(settings["chunk_overlap"]), redacted_path=settings["redacted_path"])
    print(f"{added} chunks of {args.path}")


def query(spark: SparkSession, settings: dict, args: argparse.Namespace) -> None:
    for hit in retrieval.query_index(spark, args.question, settings["index_path"], settings["metadata_path"], int(settings["top_k"])).collect():
        print(json.dumps(hit.asDict(), ensure_ascii=False))


def serve(spark: SparkSession, settings: dict, args: argparse.Namespace) -> None:
    server(Service(spark, settings), args.host, args.port).serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Masks, takes in and searches documents.")
    p.add_argument("--config", help="settings, as JSON or YAML")
    p.add_argument("--debug", action="store_true")
    commands = p.add_subparsers(required=True)
    for work, argument in ((redact, "path"), (ingest, "path"), (query, "question"), (serve, None)):
        c = commands.add_parser(work.__name__)
        c.set_defaults(work=work)
        if argument:
            c.add_argument(argument)
        if work is redact:
            c.add_argument("--write-file", action="store_true", help="write sidecars instead of printing")
        if work is serve:
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.WARNING)
    try:
        settings = config.load(args.config)
        spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
        ship(spark)
        args.work(spark, settings, args)
    except Exception:
        logging.exception("%s", Path(sys.argv[0]).name)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
