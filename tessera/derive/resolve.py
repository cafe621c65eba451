"""Parsing as one pass over the files, and name resolution as joins over their facts.

Parsing is a function of one file's bytes, so facts are kept by (dialect, digest) and only new contents are parsed.  Resolution
always runs over all facts: a change in one file may change what names mean in another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X
from tessera.operators.staging import stage

VERSION = "tessera-facts-1"
#: Steps through which a re-exported name is followed.
HOPS = 32
SYMBOL = "struct<key:string,parent:string,kind:string,name:string,signature:string,start:long,end:long,test:boolean>"
USE = "struct<relation:string,source:string,text:string,keys:array<string>,dotted:string,guess:boolean,start:long,end:long>"
FACTS = f"path string, dialect string, digest string, version string, symbols array<{SYMBOL}>, uses array<{USE}>, exports array<struct<name:string,dotted:string>>, coverage string, diagnostics array<string>"
_SYMBOL = [x.split(":")[0] for x in SYMBOL[7:-1].split(",")]
_USE = [x.split(":")[0] for x in USE[7:-1].split(",")]
ENTITIES = "key string, category string, kind string, name string, signature string, path string, start long, end long, digest string, test boolean"
RELATIONS = "site long, kind string, source string, target string, text string, resolution string, basis string, path string, start long, end long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from tessera.derive import braces, python

    for b in batches:
        for i in range(0, b.num_rows, 64):
            rows = []
            for r in b.slice(i, 64).to_pylist():
                got = python.parse(r["path"], r["data"]) if r["dialect"] == "python" else braces.parse(r["path"], r["data"], r["dialect"])
                rows.append({"path": r["path"], "dialect": r["dialect"], "digest": r["digest"], "version": VERSION, "coverage": got["coverage"], "diagnostics": got["diagnostics"],
                             "symbols": [dict(zip(_SYMBOL, s, strict=True)) for s in got["symbols"]], "uses": [dict(zip(_USE, u, strict=True)) for u in got["uses"]],
                             "exports": [{"name": n, "dotted": d} for n, d in got["exports"]]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_S = pa.struct([(n, pa.int64() if n in ("start", "end") else pa.bool_() if n == "test" else pa.string()) for n in _SYMBOL])
_U = pa.struct([(n, pa.int64() if n in ("start", "end") else pa.bool_() if n == "guess" else pa.list_(pa.string()) if n == "keys" else pa.string()) for n in _USE])
_ARROW = pa.schema([("path", pa.string()), ("dialect", pa.string()), ("digest", pa.string()), ("version", pa.string()), ("symbols", pa.list_(_S)), ("uses", pa.list_(_U)),
                    ("exports", pa.list_(pa.struct([("name", pa.string()), ("dotted", pa.string())]))), ("coverage", pa.string()), ("diagnostics", pa.list_(pa.string()))])


def facts(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Facts of all files (path, data, digest) of a known dialect; those of unchanged paths in ``known`` are taken over."""
    text = F.when(F.col("path").rlike(r"\.h$") | X.dialect(F.col("path")).isNull() | X.dialect(F.col("path")).isin("bash", "sh"), F.decode(F.substring("data", 1, 65536), "iso-8859-1"))
    named = files.select("path", "data", "digest", X.dialect(F.col("path"), F.coalesce(text, F.lit(""))).alias("dialect")).where("dialect is not null")
    columns = [c.split()[0] for c in ("path", "dialect", "digest", "version", "symbols", "uses", "exports", "coverage", "diagnostics")]
    if known is None:
        return named.mapInArrow(_parse, FACTS)
    sound = known.where((F.col("version") == VERSION) & F.col("symbols").isNotNull() & F.col("uses").isNotNull())
    same = ["path", "dialect", "digest"]
    kept = sound.join(named.select(*same), same, "left_semi").select(*columns)
    return kept.unionByName(named.join(sound.select(*same), same, "left_anti").select("path", "data", "digest", "dialect").mapInArrow(_parse, FACTS))


def _modules(of: DataFrame) -> DataFrame:
    """(module, path, dialect): the names by which files are imported."""
    return of.where("dialect = 'python'").select(X.module_name(F.col("path")).alias("module"), "path").where("module is not null")


def resolve(files: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of all files (path, digest, size) and their staged facts."""
    symbols = stage(of.select("path", "dialect", "digest", F.explode("symbols").alias("s")).select("path", "dialect", "digest", "s.*"))
    modules = stage(_modules(of))
    uses = of.select("path", "dialect", F.posexplode("uses").alias("n", "u")).select("path", "dialect", "n", "u.*")
    python = _python_targets(uses.where("dialect = 'python' and size(keys) = 0 and dotted is not null"), symbols, modules, of)
    other = _other_targets(uses.where("dialect <> 'python' and size(keys) = 0 and dotted is not null"), symbols, files.select("path"))
    far = python.unionByName(other)
    found = uses.join(far, ["path", "n"], "left").withColumn("targets", F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.coalesce("found", F.array().cast("array<string>"))))
    calls_ok = F.forall("targets", lambda k: k.startswith("symbol:"))
    found = found.withColumn("targets", F.when((F.col("relation") == "calls") & ~calls_ok, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct("targets"))))
    count = F.size("targets")
    guess = F.col("guess") | F.coalesce("far_guess", F.lit(False))
    found = found.select("path", "n", "relation", "source", "text", "start", "end", "targets",
                         F.when(count == 1, "resolved").when(count > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
                         F.when(guess & (count > 0), "heuristic").when(count == 1, "resolved").otherwise("syntactic").alias("basis"))
    found = stage(found)
    row = lambda kind, source, target, path=None, start=None, end=None: [
        F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.lit(None).cast("string").alias("text"), F.lit("resolved").alias("resolution"), F.lit("syntactic").alias("basis"),
        (path if path is not None else F.lit(None).cast("string")).alias("path"), (start if start is not None else F.lit(None).cast("long")).alias("start"), (end if end is not None else F.lit(None).cast("long")).alias("end")]
    c = F.col
    file_key = F.concat(F.lit("file:"), "path")
    module_key = F.concat(F.lit("module:python:"), "module")
    parts = [
        files.select(*row("contains", F.lit("repo"), file_key)), modules.select("module").distinct().select(*row("contains", F.lit("repo"), module_key)),
        modules.select(*row("contains_logical", module_key, file_key)), symbols.select(*row("contains", c("parent"), c("key"), c("path"), c("start"), c("end"))),
        symbols.where(c("parent").startswith("file:")).join(modules, "path").select(*row("defines", module_key, c("key"), c("path"), c("start"), c("end"))),
        found.select(c("relation").alias("kind"), "source", F.explode_outer("targets").alias("target"), F.when(c("resolution") != "resolved", c("text")).alias("text"), "resolution", "basis", "path", "start", "end"),
    ]
    tests = symbols.where("test").select(c("key").alias("t"))
    proven = found.where("relation = 'calls' and resolution = 'resolved' and basis = 'resolved'").select(c("targets")[0].alias("callee"), "source", "path", "start", "end")
    inside = proven.select("*", F.explode(F.array_union(X.enclosing(c("source")), F.array("source"))).alias("t")).join(tests, "t")
    nearest = inside.groupBy("callee", "path", "start", "end").agg(F.max_by("t", F.length("t")).alias("t")).join(tests.select(c("t").alias("callee")), "callee", "left_anti")
    parts.append(nearest.select(F.lit("tested_by").alias("kind"), c("callee").alias("source"), c("t").alias("target"), F.lit(None).cast("string").alias("text"), F.lit("resolved").alias("resolution"),
                                F.lit("heuristic").alias("basis"), "path", "start", "end"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # A site is one place in the source, whatever it may mean.
    relations = every.withColumn("site", F.xxhash64("kind", "source", "path", "start", "end", F.when(c("resolution") == "resolved", c("target")))).select(*[x.split()[0] for x in RELATIONS.split(", ")])
    none = [F.lit(None).cast("string").alias("signature")]
    span = [F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("start", "long"), ("end", "long"), ("digest", "string"))]
    spark = files.sparkSession
    entities = (spark.range(1).select(F.lit("repo").alias("key"), F.lit("repository").alias("category"), F.lit("repository").alias("kind"), F.lit("repo").alias("name"), *none, *span, F.lit(False).alias("test"))
                .unionByName(files.select(file_key.alias("key"), F.lit("file").alias("category"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), *none, "path",
                                          F.lit(0).cast("long").alias("start"), c("size").alias("end"), "digest", F.lit(False).alias("test")))
                .unionByName(modules.select("module").distinct().select(module_key.alias("key"), F.lit("module").alias("category"), F.lit("module").alias("kind"), c("module").alias("name"), *none, *span, F.lit(False).alias("test")))
                .unionByName(symbols.select("key", F.lit("symbol").alias("category"), "kind", "name", "signature", "path", "start", "end", "digest", "test")))
    return stage(entities), stage(relations)


def _python_targets(uses: DataFrame, symbols: DataFrame, modules: DataFrame, of: DataFrame) -> DataFrame:
    """(path, n, found, far_guess): a dotted path means the longest module it starts with, then a name of that module, which
    may be imported there in turn, then members."""
    top = symbols.where(F.col("parent").startswith("file:")).join(modules, "path").select(F.col("module").alias("m"), F.col("name").alias("part"), F.col("key").alias("hit"))
    exports = (of.where("dialect = 'python'").select("path", F.explode("exports").alias("x")).join(modules, "path")
               .select(F.col("module").alias("m"), F.col("x.name").alias("part"), F.col("x.dotted").alias("via")))
    members = symbols.select(F.col("parent").alias("hit"), F.col("name").alias("part"), F.col("key").alias("below"))
    names = F.broadcast(modules.select(F.col("module").alias("m")).distinct()) if modules.count() < 100_000 else modules.select(F.col("module").alias("m")).distinct()
    todo = stage(uses.where("relation = 'imports' or dotted <> text or instr(dotted, '.') >= 0").where("dotted <> ''").select("path", "n", "relation", "dotted"))
    # Only imports name modules: a call's path was replaced by what its first name is imported from.
    done: list[DataFrame] = []
    for _ in range(HOPS):
        split = F.split("dotted", r"\.")
        prefixes = todo.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(split, 1, i), ".").alias("m")))).alias("p"))
        longest = prefixes.select("path", "n", "relation", "dotted", "p.k", "p.m").join(names, "m").groupBy("path", "n", "relation", "dotted").agg(F.max(F.struct("k", "m")).alias("b"))
        at = stage(longest.select("path", "n", "relation", F.col("b.m").alias("m"), F.slice(split, F.col("b.k") + 1, F.size(split)).alias("rest")))
        done.append(at.where("size(rest) = 0").select("path", "n", F.concat(F.lit("module:python:"), "m").alias("hit")))
        more = at.where("size(rest) > 0").withColumn("part", F.element_at("rest", 1))
        here = stage(more.join(top, ["m", "part"]).select("path", "n", "hit", F.slice("rest", 2, F.size("rest")).alias("rest")))
        while True:
            done.append(here.where("size(rest) = 0").select("path", "n", "hit"))
            left = here.where("size(rest) > 0").withColumn("part", F.element_at("rest", 1))
            if left.isEmpty():
                break
            here = stage(left.join(members, ["hit", "part"]).select("path", "n", F.col("below").alias("hit"), F.slice("rest", 2, F.size("rest")).alias("rest")))
        todo = stage(more.join(exports, ["m", "part"]).select("path", "n", "relation", F.concat_ws(".", F.col("via"), F.array_join(F.slice("rest", 2, F.size("rest")), ".")).alias("dotted")).withColumn("dotted", F.regexp_replace("dotted", r"\.$", "")).distinct())
        if todo.isEmpty():
            break
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.groupBy("path", "n").agg(F.collect_set("hit").alias("found")).withColumn("far_guess", F.lit(False))


def _other_targets(uses: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, n, found, far_guess): imports by path, then calls and bases by names in imported files (proven by the import) or in the same
    folder (a guess)."""
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    plain = F.replace(F.replace("dotted", F.lit("::"), F.lit("/")), F.lit("\\"), F.lit("/"))
    plain = F.when(F.col("dialect").isin("java", "csharp"), F.replace(plain, F.lit("."), F.lit("/"))).otherwise(plain)
    imports = uses.where("relation = 'imports'").select("path", "n", "dialect", folder.alias("folder"), plain.alias("want"))
    near = imports.select("path", "n", X.normal_path(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "want")).alias("base"))
    stem = F.regexp_replace("path", r"(/index)?\.[A-Za-z]+$", "")
    names = files.select("path", F.explode(F.array_distinct(F.array("path", stem))).alias("base")).select(F.col("path").alias("to"), "base")
    by_near = near.join(names, "base").select("path", "n", "to")
    # A package or namespace path names a file by its end; only one such file is taken.
    suffixes = files.select(F.col("path").alias("to"), F.explode(X.path_suffixes(stem)).alias("want"))
    by_end = imports.where("dialect in ('java', 'csharp', 'php', 'rust')").join(suffixes, "want").groupBy("path", "n").agg(F.collect_set("to").alias("t")).where("size(t) = 1").select("path", "n", F.col("t")[0].alias("to"))
    linked = stage(by_near.unionByName(by_end).distinct())
    hit = linked.select("path", "n", F.concat(F.lit("file:"), "to").alias("hit"), F.lit(False).alias("g"))
    top = symbols.where("dialect <> 'python'").where(F.col("parent").startswith("file:")).select(F.col("path").alias("to"), "name", "key")
    wanted = uses.where("relation <> 'imports'").select("path", "n", "dialect", folder.alias("folder"), F.element_at(F.split("dotted", r"\.|::|->|\\"), -1).alias("name"), F.size(F.split("dotted", r"\.|::|->|\\")).alias("deep"))
    seen = linked.select("path", "to").distinct()
    by_import = wanted.where("deep <= 2").join(seen, "path").join(top, ["to", "name"]).select("path", "n", F.col("key").alias("hit"), F.lit(False).alias("g"))
    beside = top.select(F.regexp_replace("to", "(^|/)[^/]*$", "").alias("folder"), "name", "key")
    by_folder = wanted.where("deep = 1 and dialect in ('go', 'java', 'csharp', 'php')").join(beside, ["folder", "name"]).select("path", "n", F.col("key").alias("hit"), (F.col("dialect") != "go").alias("g"))
    every = hit.unionByName(by_import).unionByName(by_folder)
    best = every.withColumn("least", F.min("g").over(W.partitionBy("path", "n"))).where("g = least")
    return best.groupBy("path", "n").agg(F.collect_set("hit").alias("found"), F.max("g").alias("far_guess"))
