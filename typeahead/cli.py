"""Command line: inspect, complete, import, compact, cleanup, ingest."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .operators.complete import complete
from .plans.options import CleanupPolicy
from .sources.documents import read_json_lines
from .storage.database import Database
from .streaming.inbox import Ingestor


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="typeahead", description=__doc__)
    p.add_argument("--namespace", default="default")
    p.add_argument("--tag", action="append", default=[], metavar="K=V")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *names: [c := sub.add_parser(name), c.add_argument("url"), *[c.add_argument(n) for n in names]][0]
    add("inspect").add_argument("--json", action="store_true")
    c = add("complete", "index", "query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--contexts", nargs="*", default=[])
    c.add_argument("--json", action="store_true")
    add("import", "index", "file").add_argument("--overwrite", action="store_true")
    add("compact", "index")
    c = add("cleanup")
    c.add_argument("--keep-versions", type=int, default=10)
    c.add_argument("--older-than-seconds", type=float, default=3600)
    c = add("ingest")
    c.add_argument("--once", action="store_true")
    c.add_argument("--owner", default="cli")
    c.add_argument("--interval", type=float, default=1.0)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("typeahead").getOrCreate()
    db = Database(spark, a.url, tags=dict(t.split("=", 1) for t in a.tag))
    say = lambda x: print(x, file=out)
    if a.command == "inspect":
        m = db.latest()
        if a.json:
            say(json.dumps(m, sort_keys=True))
        else:
            say(f"version {m['version']}")
            for space, indexes in sorted(m["namespaces"].items()):
                for name, e in sorted(indexes.items()):
                    say(f"{space}/{name}: {len(e['segments'])} segments, {sum(s['documents'] for s in e['segments'])} rows, max score {e['max_score']}")
    elif a.command == "complete":
        q = spark.createDataFrame([(0, a.query, a.contexts)], "qid long, query string, contexts array<string>")
        for r in complete(db.open_index(a.index, a.namespace), q, a.limit).orderBy("rank").collect():
            say(json.dumps({"id": r.id, "key": r.key, "text": r.text, "score": r.score, "kind": r.kind}) if a.json else f"{r.score:.4f}  {r.kind:<12}  {r.text}")
    elif a.command == "import":
        txn = db.begin(a.namespace)
        (txn.overwrite if a.overwrite else txn.append)(a.index, read_json_lines(spark, a.file))
        say(f"version {txn.commit()}")
    elif a.command == "compact":
        n = 0
        while db.compact(a.index, a.namespace):
            n += 1
        say(f"{n} steps")
    elif a.command == "cleanup":
        say(json.dumps(db.cleanup(CleanupPolicy(a.keep_versions, a.older_than_seconds))))
    else:
        ingestor = Ingestor(db, a.owner)
        while True:
            say(f"{ingestor.run_once()} change sets")
            if a.once:
                ingestor.release()
                break
            time.sleep(a.interval)
    return 0


if __name__ == "__main__":
    sys.exit(main())
