"""spark-submit plumbline/cli.py validate|ingest|promote|rollback|status ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.sources.records import SCHEMAS, read_lines
from plumbline.sources.store import Store

KEYS = {"element": "element_id", "property_fact": "fact_id", "chunk": "chunk_id", "warning": "code"}


def main(args: list[str]) -> int:
    """Exit code 0 if all went well, 1 if records or an alias were refused."""
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "ingest"):
        p = sub.add_parser(name)
        p.add_argument("kind", choices=sorted(SCHEMAS))
        p.add_argument("path")
        if name == "ingest":
            p.add_argument("--root", required=True)
            p.add_argument("--alias", required=True)
            p.add_argument("--version", type=int, required=True)
    for name in ("promote", "rollback", "status"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        if name != "status":
            p.add_argument("--alias", required=True)
        if name == "promote":
            p.add_argument("--version", type=int, required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command in ("validate", "ingest"):
        rows = read_lines(spark, a.path, a.kind, [KEYS[a.kind]])
        errors = {r["error"]: r["count"] for r in rows.where("error IS NOT NULL").groupBy("error").count().collect()}
        out = {"errors": errors}
        if not errors and a.command == "ingest":
            store = Store(spark, a.root)
            name = store.create(a.alias, a.version, {"kind": a.kind})
            out |= store.replace(name, rows.select("record.*"), KEYS[a.kind], invalid=F.col(KEYS[a.kind]).isNull())
        print(json.dumps(out))
        return int(bool(errors))
    store = Store(spark, a.root)
    try:
        done = store.status() if a.command == "status" else store.rollback(a.alias) if a.command == "rollback" else store.promote(a.alias, f"{a.alias}_v{a.version}")
    except (RuntimeError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    print(json.dumps(done))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
