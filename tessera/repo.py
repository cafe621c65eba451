"""An indexed directory tree: index, search, context, impact, navigation.

``open_repository(spark, root, data)`` gives a :class:`Repository`; all results are plain values, tables are DataFrames of the current
generation (``table``).
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.derive import resolve
from tessera.operators import catalog, lexical, lookup, packing, retrieval, routing, structural, walk
from tessera.operators.staging import stage
from tessera.sources import worktree
from tessera.store import Store
from tessera.streaming import delta
from tessera.view import View

MAX_LIMIT, MAX_BUDGET, MAX_DEPTH, BLAST_ROOTS = 1000, 1 << 20, 8, 3
VERSIONS = {"capture": worktree.VERSION, "facts": resolve.VERSION, "terms": "tessera-terms-1", "walk": "tessera-walk-1", "pack": "tessera-pack-1"}


class InvalidArgument(ValueError):
    """An argument that no request takes."""


def _count(name: str, value, most: int, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise InvalidArgument(f"{name}: a whole number from {least} to {most}, not {value!r}")
    return value


def _hints(selection, paths, symbols, changed) -> retrieval.Hints:
    for name, values in (("paths", paths), ("symbols", symbols), ("changed", changed)):
        if isinstance(values, str) or not all(isinstance(v, str) and v for v in values):
            raise InvalidArgument(f"{name}: a list of texts that are not empty")
    if selection is not None:
        path, start, end = selection
        if not isinstance(path, str) or not path or not 0 <= start <= end:
            raise InvalidArgument("selection: (path, start, end) with 0 <= start <= end")
    return retrieval.Hints(selection, tuple(paths), tuple(symbols), tuple(changed))


class Deadline:
    """A judge that must answer in time; a late answer counts as none."""

    def __init__(self, judge, seconds: float = 2.0) -> None:
        self._judge, self._seconds, self.identity = judge, seconds, judge.identity

    def judge(self, candidates):
        got: list = []

        def run() -> None:
            try:
                got.append((self._judge.judge(candidates), None))
            except Exception as e:  # handed on to the caller's thread
                got.append((None, e))

        t = threading.Thread(target=run, daemon=True)
        t.start()
        t.join(self._seconds)
        if not got:
            raise TimeoutError(self.identity)
        if got[0][1] is not None:
            raise got[0][1]
        return got[0][0]


class Repository:
    def __init__(self, spark: SparkSession, root: str, data: str, exclude: tuple[str, ...] = (), judge=None, progress: Callable[[str], None] | None = None) -> None:
        self.spark, self.root, self.exclude, self.judge = spark, os.path.realpath(root), (*exclude, data), judge
        self.store, self.progress, self._lock = Store(spark, os.path.realpath(data)), progress or (lambda _: None), threading.RLock()

    # -- writing

    def index(self) -> dict:
        """Capture, derive and publish; unchanged trees are not derived again.  Facts of unchanged files are kept, names are resolved anew."""
        with self._lock, self.store.owner():
            old = self.store.current()
            before = View(self.store, old) if old else None
            self.progress("capture")
            previous = before.table("files").join(before.table("sources"), "digest").select("path", "data", "digest", "size", "stat") if before else None
            got = worktree.capture(self.spark, self.root, self.exclude, previous)
            derivation = hashlib.sha256(json.dumps(VERSIONS, sort_keys=True).encode()).hexdigest()
            if before and self.store.name(got.snapshot_id, derivation) == old:
                return {"unchanged": True, "generation": old, "added": [], "modified": [], "deleted": []}
            files = stage(got.files)
            change = delta.diff(before.table("files").select("path", "digest"), files.select("path", "digest")) if before else files.select("path", F.lit("added").alias("change"))
            changes: dict[str, list[str]] = {"added": [], "modified": [], "deleted": []}
            for r in change.where("change <> 'reused'").sort("path").collect():
                changes[r.change].append(r.path)
            self.progress("derive")
            facts = stage(resolve.facts(files, before.table("facts") if before else None))
            entities, relations = resolve.resolve(files.select("path", "digest", "size"), facts)
            wrong = catalog.violations(entities.select("key"), relations.where("target is not null or kind = 'contains'")).limit(5).collect()
            if wrong:
                raise ValueError(f"derived graph breaks its invariants: {wrong}")
            self.progress("publish")
            docs = entities.where("category <> 'repository'").select("key", F.concat_ws(" ", "name", "signature", "path").alias("text"))
            post = stage(lexical.postings(docs, "key", "text"))
            lengths = stage(lexical.lengths(post, "key"))
            blast = walk.blast_radius(entities, relations)
            dialects = facts.select("path", "dialect", "coverage", "diagnostics")
            listed = files.select("path", "digest", "size", "stat").join(dialects, "path", "left").select("path", "digest", "size", "stat", "dialect", F.coalesce("coverage", F.lit("unsupported")).alias("coverage"), "diagnostics")
            tables = {"files": (listed, (), ("path",)), "skips": (got.skips, (), ()), "sources": (files.select("digest", "data").dropDuplicates(["digest"]), (), ()), "facts": (facts, (), ()),
                      "entities": (entities, (), ("key",)), "relations": (relations, ("kind",), ()), "postings": (post, (), ("term",)), "lengths": (lengths, (), ()),
                      "stats": (lexical.stats(lengths), (), ()), "blast": (blast, (), ("key",))}
            coverage = {r.coverage: r["count"] for r in listed.groupBy("coverage").count().collect()}
            more = {"coverage": coverage, "skipped": got.skips.count(), "collisions": [r.paths for r in worktree.collisions(files).collect()]}
            name = self.store.publish(got.snapshot_id, derivation, tables, more)
            return {"unchanged": False, "generation": name, "reused": got.reused, **changes}

    def status(self) -> dict:
        return self.store.status()

    # -- reading

    def view(self) -> View:
        name = self.store.current()
        if name is None:
            raise FileNotFoundError(f"{self.store.path}: nothing indexed yet")
        return View(self.store, name)

    def table(self, name: str) -> DataFrame:
        return self.view().table(name)

    def entity(self, key: str) -> dict | None:
        return self.view().entities([key]).get(key)

    def relations(self, key: str) -> list[dict]:
        return self.view().relations(key)

    def search(self, query: str, limit: int = 20, selection=None, paths=(), symbols=(), changed=(), use_lexical: bool = True, use_structural: bool = True) -> dict:
        with self.store.pin() as name:
            view = View(self.store, name)
            got = retrieval.retrieve(view, query, _hints(selection, paths, symbols, changed), use_lexical, use_structural, _count("limit", limit, MAX_LIMIT))
            near, blast = view.entities(e.key for e in got.entries), view.blast(e.key for e in got.entries[:BLAST_ROOTS])
            return {"entries": [{**asdict(e), "entity": near.get(e.key), "blast": blast.get(e.key)} for e in got.entries], "lexical": got.channel, "issues": got.issues, "snapshot": view.manifest["snapshot_id"]}

    def build_context(self, query: str, budget: int = 2048, selection=None, paths=(), symbols=(), changed=(), use_lexical: bool = True, use_structural: bool = True) -> dict:
        """Entry points, what lies around them, and as much of their source as the budget holds: units never exceed it."""
        _count("budget", budget, MAX_BUDGET)
        with self.store.pin() as name:
            view = View(self.store, name)
            got = retrieval.retrieve(view, query, _hints(selection, paths, symbols, changed), use_lexical, use_structural)
            way = routing.route(view, [e.key for e in got.entries])
            by_key, depth = {e.key: e for e in got.entries}, {k: (d, how) for k, d, how in way.candidates}
            order = [e.key for e in got.entries] + sorted((k for k in depth if k not in by_key), key=lambda k: (depth[k][0], k))
            cut, order = len(order) > packing.POOL, order[: packing.POOL]
            outer = {k for key in order for k in packing.outer_keys(key)}
            known = view.entities([*order, *outer])
            hinted = {known[k]["path"] for k, e in by_key.items() if k in known and any(x[0] == "path" for x in e.seeds)} - {None}

            def candidate(k: str) -> packing.Candidate:
                e, seen = known[k], by_key.get(k)
                return packing.Candidate(k, e["category"], e["name"], e["path"], e["start"] or 0, e["end"] or 0, e["test"], depth.get(k, (0, ()))[0], seen.rank if seen else None, seen.score if seen else None,
                                         tuple(f"{kind}:{hint}" for kind, hint, _ in seen.seeds) if seen else (), e["path"] in hinted, tuple(depth.get(k, (0, ()))[1]))

            pool = [candidate(k) for k in order if k in known]
            parsed = [c.path for c in pool if c.category == "file" and view.files[c.path]["dialect"] == "python"]
            declared: dict[str, list[tuple[int, int]]] = {f"file:{p}": [] for p in parsed}
            for e in view.declarations(parsed, 1 << 20) if parsed else ():
                if "." not in e["key"].rpartition("#")[2]:
                    declared[f"file:{e['path']}"].append((e["start"], e["end"]))
            judge = Deadline(self.judge) if self.judge is not None else None
            items, omissions = packing.pack(pool, {k: candidate(k) for k in outer if k in known}, budget, view.source, declared, judge)
            degraded = [f"{k} packed without its body; raise the budget" for k in packing.missing_bodies(pool, items, omissions)]
            degraded += [f"lexical channel {got.channel['state']}"] if got.channel["state"] != "ran" else []
            degraded += [f"routing stopped by {way.stopped_by}"] if way.stopped_by else []
            degraded += [f"graph nodes cut at {packing.POOL}"] if cut else []
            used_paths = {i.path for i in items}
            degraded += [f"{p} is {view.files[p]['coverage']}" for p in sorted(used_paths) if view.files[p]["coverage"] != "complete"]
            return {"items": [asdict(i) for i in items], "text": "".join(i.text for i in items), "used": sum(i.units for i in items), "budget": budget, "omissions": omissions, "issues": got.issues,
                    "route": asdict(way), "degradations": degraded, "versions": VERSIONS, "blast": view.blast([e.key for e in got.entries[:BLAST_ROOTS]]), "snapshot": view.manifest["snapshot_id"]}

    def impact(self, name: str, direction: str = "upstream", depth: int = 3, limit: int = 200) -> dict:
        _count("depth", depth, MAX_DEPTH), _count("limit", limit, MAX_LIMIT)
        if direction not in ("upstream", "downstream"):
            raise InvalidArgument("direction: upstream or downstream")
        with self.store.pin() as generation:
            view = View(self.store, generation)
            key = lookup.root_of(view, name)
            root = self.spark.createDataFrame([(key,)], "key string")
            hops, stops = walk.impact_bounded(view.table("relations"), root, direction == "upstream", depth, limit)
            rows = [r.asDict() for r in hops.drop("root").sort("depth", "key").collect()]
            near = view.entities([key, *(r["key"] for r in rows)])
            return {"root": key, "hops": [{**r, "entity": near.get(r["key"])} for r in rows], "stopped_by": stops.first().stopped_by,
                    "mentions": view.mentions([near[key]["name"]]) if near[key]["category"] == "symbol" else 0}

    def outline(self, target: str | None = None, limit: int = 500) -> dict:
        with self.store.pin() as name:
            return lookup.outline(View(self.store, name), target, _count("limit", limit, MAX_LIMIT))

    def inspect(self, query: str, limit: int = 20) -> dict:
        with self.store.pin() as name:
            return lookup.inspect(View(self.store, name), query, _count("limit", limit, MAX_LIMIT))

    def refs(self, query: str, limit: int = 50) -> dict:
        with self.store.pin() as name:
            return lookup.refs(View(self.store, name), query, _count("limit", limit, MAX_LIMIT))

    def structural_search(self, rule: dict, paths: tuple[str, ...] = (), limit: int = 100) -> dict:
        with self.store.pin() as name:
            view = View(self.store, name)
            files = view.table("files").join(view.table("sources"), "digest").select("path", "data", "dialect")
            return structural.search(files, view.table("entities"), rule, paths, _count("limit", limit, MAX_LIMIT))

    # -- following changes

    def watch(self, stop: threading.Event, debounce: float = 1.0, healthy: float = 300.0, failed: float = 30.0) -> None:
        """Index whenever the tree's stat keys change, at most once a ``debounce``, and every ``healthy`` seconds in any case; after a
        failure wait ``failed`` seconds, doubled up to ``healthy``."""
        last, due, pause = None, 0.0, failed
        while not stop.is_set():
            try:
                now = worktree.listing(self.root, self.exclude)
                if now.files != last or time.monotonic() >= due:
                    self.index()
                    last, due, pause = now.files, time.monotonic() + healthy, failed
                wait = debounce
            except Exception as e:  # the watcher outlives what a single update meets
                self.progress(f"failed: {e}")
                wait, pause = pause, min(2 * pause, healthy)
            stop.wait(wait)


def open_repository(spark: SparkSession, root: str, data: str, **more) -> Repository:
    return Repository(spark, root, data, **more)


def index_repository(spark: SparkSession, root: str, data: str, **more) -> dict:
    return Repository(spark, root, data, **more).index()


def repository_status(spark: SparkSession, data: str) -> dict:
    return Store(spark, os.path.realpath(data)).status()
