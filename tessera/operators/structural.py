"""Search by syntax: rules over the parse trees of Python files, one pass over the sources.

A rule is a dict: ``kind`` (a node class such as "Call"), ``name`` (an expression that the called, declared or read name must match), ``has``
and ``inside`` (rules of a node below or above), ``not`` (a rule that must not hold).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import catalog

_KEYS = {"kind", "name", "has", "inside", "not"}


def check(rule: dict) -> None:
    if not isinstance(rule, dict) or not rule or set(rule) - _KEYS:
        raise ValueError(f"rule: a dict with some of {sorted(_KEYS)}, not {rule!r}")
    if "kind" in rule and not hasattr(ast, rule["kind"]):
        raise ValueError(f"rule: no node kind {rule['kind']!r}")
    re.compile(rule.get("name", ""))
    for k in ("has", "inside", "not"):
        if k in rule:
            check(rule[k])


def _name(node) -> str | None:
    node = node.func if isinstance(node, ast.Call) else node
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value) or ''}.{node.attr}".lstrip(".")
    return getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "arg", None)


def holds(rule: dict, node, above: tuple) -> bool:
    if "kind" in rule and type(node).__name__ != rule["kind"]:
        return False
    if "name" in rule and not (isinstance(n := _name(node), str) and re.search(rule["name"], n)):
        return False
    if "inside" in rule and not any(holds(rule["inside"], a, above[:i]) for i, a in enumerate(above)):
        return False
    if "not" in rule and holds(rule["not"], node, above):
        return False
    if "has" in rule:
        todo = [(c, (*above, node)) for c in ast.iter_child_nodes(node)]
        while todo:
            c, up = todo.pop()
            if holds(rule["has"], c, up):
                return True
            todo += [(x, (*up, c)) for x in ast.iter_child_nodes(c)]
        return False
    return True


def matches(rule: dict, data: bytes) -> list[tuple[int, int]] | None:
    """Byte spans of matching nodes in source order; None if the source cannot be parsed."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0, *(m.end() for m in re.finditer(rb"\n", data))]
    out, todo = set(), [(tree, ())]
    while todo:
        node, above = todo.pop()
        if hasattr(node, "lineno") and holds(rule, node, above):
            out.add((starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset))
        todo += [(c, (*above, node)) for c in ast.iter_child_nodes(node)]
    return sorted(out)


def search(files: DataFrame, entities: DataFrame, rule: dict, paths: tuple[str, ...] = (), limit: int = 100) -> dict:
    """Matches (path, start, end, key of the innermost symbol) in order, at most ``limit``; files that were skipped; truncation."""
    check(rule)
    wanted = files.where("dialect = 'python'")
    if paths:
        inside = F.lit(False)
        for p in paths:
            inside = inside | (F.col("path") == p.rstrip("/")) | F.col("path").startswith(p.rstrip("/") + "/")
        wanted = wanted.where(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = matches(rule, data)
                rows += [(path, None, None)] if got is None else [(path, a, e) for a, e in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "start", "end"])

    found = wanted.select("path", "data").mapInArrow(run, "path string, start long, end long")
    top = found.where("start is not null").sort("path", "start", "end").limit(limit + 1).withColumn("probe", F.concat_ws(":", "path", "start", "end"))
    rows = top.collect()
    skipped = [r.path for r in found.where("start is null").select("path").sort("path").collect()]
    probes = files.sparkSession.createDataFrame(rows[:limit], top.schema)
    spans = entities.where("category = 'symbol'").select("path", F.col("start").alias("s"), F.col("end").alias("e"), "key")
    inner = {r.probe: r.key for r in catalog.innermost(spans, probes).collect()}
    return {"matches": [{"path": r.path, "start": r.start, "end": r.end, "entity": inner.get(r.probe, f"file:{r.path}")} for r in rows[:limit]], "skipped": skipped, "truncated": len(rows) > limit}
