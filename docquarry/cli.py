"""Command line: ``index`` files or a topic into an index, ``search`` and ``suggest`` by JSON requests, administration."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from docquarry.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docquarry")
    p.add_argument("--config", required=True)
    p.add_argument("--root", required=True, help="folder of the indexes, shared by all executors")
    sub = p.add_subparsers(dest="mode", required=True)
    index = sub.add_parser("index").add_subparsers(dest="source", required=True)
    file = index.add_parser("file")
    file.add_argument("--index", required=True)
    file.add_argument("--url", required=True)
    file.add_argument("--recursive", action="store_true")
    kafka = index.add_parser("kafka")
    kafka.add_argument("--index", required=True)
    kafka.add_argument("--topic", required=True)
    kafka.add_argument("--brokers", required=True)
    kafka.add_argument("--offset")
    kafka.add_argument("--options", default="{}")
    kafka.add_argument("--checkpoint", required=True)
    for mode in ("search", "suggest"):
        q = sub.add_parser(mode)
        q.add_argument("--index", required=True)
        q.add_argument("--request", default="{}", help="JSON")
    delete = sub.add_parser("delete")
    delete.add_argument("--index", required=True)
    delete.add_argument("--ids", nargs="*")
    delete.add_argument("--filters", help="JSON; without ids and filters everything is deleted")
    merge = sub.add_parser("merge")
    merge.add_argument("--index", required=True)
    merge.add_argument("--files", type=int)
    copy = sub.add_parser("replicate")
    copy.add_argument("--index", required=True)
    copy.add_argument("--to", required=True)
    for mode in ("stats", "mapping"):
        sub.add_parser(mode).add_argument("--index", required=True)
    sub.add_parser("list")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine.from_yaml(spark, a.config, a.root)
    if a.mode == "list":
        print(json.dumps(engine.names()))
    elif a.mode == "index" and a.source == "file":
        i = engine.index(a.index)
        i.add_files(a.url, a.recursive)
        print(i.flush())
    elif a.mode == "index":
        from docquarry.streaming.ingest import ingest, kafka_lines

        lines = kafka_lines(spark, a.topic, a.brokers.split(","), a.offset, json.loads(a.options))
        ingest(lines, engine.index(a.index), a.checkpoint).awaitTermination()
    elif a.mode == "delete":
        i = engine.index(a.index)
        i.delete(a.ids, json.loads(a.filters) if a.filters else None)
        print(i.flush())
    elif a.mode == "merge":
        engine.index(a.index).merge(a.files)
    elif a.mode == "replicate":
        print(json.dumps(engine.index(a.index).replicate(a.to)))
    elif a.mode == "stats":
        print(json.dumps(engine.index(a.index).stats()))
    elif a.mode == "mapping":
        print(engine.index(a.index).mapping.to_json())
    else:
        print(json.dumps(getattr(engine.index(a.index), a.mode)(json.loads(a.request)), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
