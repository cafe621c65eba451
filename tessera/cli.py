"""Command line: ``python -m tessera.cli COMMAND ROOT [NAME]``; JSON on standard output.  Exit 1: a name is not resolved, 2: an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

COMMANDS = ("index", "status", "search", "context", "impact", "outline", "inspect", "refs", "structural")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("root")
    p.add_argument("name", nargs="?", default="")
    p.add_argument("--data")
    p.add_argument("--limit", type=int)
    p.add_argument("--budget", type=int, default=2048)
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--downstream", action="store_true")
    for hint in ("path", "symbol", "changed"):
        p.add_argument(f"--{hint}", action="append", default=[])
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from tessera.repo import open_repository

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.environ.get("TESSERA_PARTITIONS", "8")).getOrCreate()
    try:
        repo = open_repository(spark, a.root, a.data or os.path.join(a.root, ".tessera"))
        some = {"limit": a.limit} if a.limit is not None else {}
        hints = {"paths": a.path, "symbols": a.symbol, "changed": a.changed}
        got = {
            "index": lambda: repo.index(), "status": lambda: repo.status(), "search": lambda: repo.search(a.name, **some, **hints), "context": lambda: repo.build_context(a.name, a.budget, **hints),
            "impact": lambda: repo.impact(a.name, "downstream" if a.downstream else "upstream", a.depth, **some), "outline": lambda: repo.outline(a.name or None, **some),
            "inspect": lambda: repo.inspect(a.name, **some), "refs": lambda: repo.refs(a.name, **some), "structural": lambda: repo.structural_search(json.loads(a.name), tuple(a.path), **some),
        }[a.command]()
    except Exception as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 2
    print(json.dumps(got, ensure_ascii=False, default=str, indent=1))
    return 1 if isinstance(got, dict) and got.get("status") in ("not_found", "ambiguous") else 0


if __name__ == "__main__":
    sys.exit(main())
