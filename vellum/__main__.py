"""Command line: ``python -m vellum catalog|files|sources|bulk ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.operators import store as tables
from vellum.plans import catalog
from vellum.plans.lifecycle import Store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="vellum")
    parser.add_argument("--store", required=True, help="shared folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    cards = commands.add_parser("catalog", help="cards of a catalog tree")
    cards.add_argument("root")
    cards.add_argument("--reset", action="store_true", help="forget all chunks first")
    cards.add_argument("--dry-run", action="store_true", help="count the cards, write nothing")
    cards.add_argument("--limit", type=int, default=0, help="only so many cards, in the catalog's order; 0: all")
    files = commands.add_parser("files", help="documents below a folder")
    files.add_argument("root")
    files.add_argument("--type", default="course", choices=["course", "review", "exam"])
    commands.add_parser("sources", help="a folder as the source collection").add_argument("root")
    bulk = commands.add_parser("bulk", help="catalog and documents below one root")
    bulk.add_argument("root")
    bulk.add_argument("--target", default="all", choices=["all", "courses", "reviews", "exams"])
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    """Runs a command and returns its counts, which it also prints."""
    said = arguments(argv)
    spark = spark or SparkSession.builder.appName("vellum").getOrCreate()
    held = Store(spark, said.store)
    done: dict[str, int] = {}
    if said.command == "catalog":
        cards = catalog.catalog(spark, said.root)
        if said.limit:
            cards = cards.orderBy(*catalog.ORDER).limit(said.limit)
        place = F.struct(*catalog.ORDER)
        kinds = cards.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        done = {r.document_type: r.n for r in kinds.orderBy(F.col("n").desc(), "first").collect()}  # at most 20 kinds
        if not said.dry_run:
            if said.reset:
                held.write("chunks", held.read("chunks").limit(0))
            held.upsert("chunks", tables.first_per_key(cards.withColumnRenamed("chunk_id", "id"), ["id"], catalog.ORDER).select(F.col("id").alias("chunk_id"), F.col("id").alias("sourceId"), F.lit(0).cast("long").alias("chunkIndex"), "text", "documentType", "document_type", "source"))
    elif said.command == "files":
        done = {"chunks": held.ingest_files(said.root, said.type, "command-line")}
    elif said.command == "sources":
        done = {"chunks": held.index_folder(said.root)}
    else:
        if said.target in ("all", "courses"):
            done["cards"] = held.ingest_catalog(said.root)
            done["courses"] = held.ingest_files(said.root, "course", "bulk-script", {"reviews", "exams"})
        for name, kind in (("reviews", "review"), ("exams", "exam")):
            path, fs = held._path(f"{said.root.rstrip('/')}/{name}")
            if said.target in ("all", name) and fs.exists(path):
                done[name] = held.ingest_files(f"{said.root.rstrip('/')}/{name}", kind, "bulk-script")
    for name, n in done.items():
        print(f"{name}: {n}")
    return done


if __name__ == "__main__":
    main()
