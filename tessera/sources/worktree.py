"""A directory tree as tables: captured files, skips and a sealed manifest.

The walk is metadata only and runs on the driver; a captured tree is a DataFrame of (path, data, digest, size, stat).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat as S
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MAX_FILE, MAX_TOTAL, ATTEMPTS = 1 << 20, 1 << 30, 3
# Folders of version control and of our own store.
EXCLUDED = frozenset({".git", ".hg", ".jj", ".svn", ".tessera"})
VERSION = "tessera-capture-1"
FILES = "path string, data binary, digest string, size long, stat array<long>"


class CaptureConflict(RuntimeError):
    """The tree changed while it was read, or its ignore rules cannot be read."""


class CaptureLimit(RuntimeError):
    """The tree holds more than a capture may."""


def ignore_pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression over relative paths, negated, folders only) of one line of an ignore file, None for blanks and comments."""
    line = line.rstrip("\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folders = line.endswith("/")
    body = line.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1 + (len(rest) - len(rest.lstrip("*")) - 1)
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S), negated, folders


@dataclass
class Rules:
    """Ignore files by folder; the deepest file that says something decides, and in it the last line."""

    at: list[tuple[str, list]] = field(default_factory=list)

    def plus(self, folder: str, text: str) -> Rules:
        return Rules([*self.at, (folder, [p for p in map(ignore_pattern, text.splitlines()) if p])])

    def ignored(self, path: str, is_folder: bool) -> bool:
        for folder, patterns in reversed(self.at):
            own = path[len(folder) + 1 :] if folder else path
            for expression, negated, folders in reversed(patterns):
                if (is_folder or not folders) and expression.match(own):
                    return not negated
        return False


@dataclass
class Listing:
    files: dict[str, tuple[int, ...]] = field(default_factory=dict)
    skips: list[tuple[str, str]] = field(default_factory=list)
    ignores: list[tuple[str, str]] = field(default_factory=list)


def _stat(s: os.stat_result) -> tuple[int, ...]:
    return s.st_mode, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, s.st_ctime_ns


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def listing(root: str, exclude: tuple[str, ...] = ()) -> Listing:
    """Files with their stat keys, what is skipped and why; links are never followed."""
    out, left = Listing(), [("", Rules())]
    out_of = {(x.st_dev, x.st_ino) for x in (os.stat(p) for p in exclude if os.path.exists(p))}
    while left:
        folder, rules = left.pop()
        at = os.path.join(root, folder)
        try:
            names = sorted(os.listdir(at))
        except OSError:
            out.skips.append((folder, "unreadable"))
            continue
        ignore = os.path.join(at, ".gitignore")
        if ".gitignore" in names and S.S_ISREG(os.lstat(ignore).st_mode):
            try:
                with open(ignore, "rb") as f:
                    data = f.read(MAX_FILE + 1)
                if len(data) > MAX_FILE:
                    raise CaptureLimit(f"{ignore}: more than {MAX_FILE} bytes")
                rules = rules.plus(folder, data.decode())
            except (OSError, UnicodeDecodeError) as e:
                raise CaptureConflict(f"{ignore}: {e}") from e
            out.ignores.append((f"{folder}/.gitignore".lstrip("/"), digest(data)))
        for name in names:
            path = f"{folder}/{name}" if folder else name
            if name in EXCLUDED:
                continue
            try:
                path.encode()
            except UnicodeEncodeError:
                out.skips.append((os.fsencode(path).decode("utf-8", "backslashreplace"), "invalid_name"))
                continue
            try:
                s = os.lstat(os.path.join(root, path))
            except OSError:
                out.skips.append((path, "unreadable"))
                continue
            is_folder = S.S_ISDIR(s.st_mode)
            if is_folder and (s.st_dev, s.st_ino) in out_of or rules.ignored(path, is_folder):
                continue
            if is_folder:
                left.append((path, rules))
            elif S.S_ISLNK(s.st_mode):
                out.skips.append((path, "symlink"))
            elif not S.S_ISREG(s.st_mode):
                out.skips.append((path, "special"))
            elif s.st_size > MAX_FILE:
                out.skips.append((path, "too_large"))
            else:
                out.files[path] = _stat(s)
    out.skips.sort()
    out.ignores.sort()
    return out


@dataclass
class Capture:
    files: DataFrame
    skips: DataFrame
    snapshot_id: str
    reused: int


def capture(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), previous: DataFrame | None = None) -> Capture:
    """The tree as it is at one moment: listed, read and listed again, up to ``ATTEMPTS`` times.  Files whose stat key is the same in
    ``previous`` are not read again."""
    known = {r.path: tuple(r.stat) for r in previous.select("path", "stat").collect()} if previous is not None else {}
    for _ in range(ATTEMPTS):
        before, rows, total, steady = listing(root, exclude), [], 0, True
        total = sum(s[1] for s in before.files.values())
        if total > MAX_TOTAL:
            raise CaptureLimit(f"{root}: {total} bytes, more than {MAX_TOTAL}")
        kept = {p for p, s in before.files.items() if known.get(p) == s}
        for path, key in before.files.items():
            if path in kept:
                continue
            try:
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                    steady &= _stat(os.fstat(f.fileno())) == key
            except OSError:
                before.skips.append((path, "unreadable"))
                continue
            rows.append((path, data, digest(data), len(data), list(key)))
        if steady and listing(root, exclude).files == before.files:
            files = spark.createDataFrame(rows, FILES)
            if kept:
                files = files.unionByName(previous.join(spark.createDataFrame([(p,) for p in kept], "path string"), "path", "left_semi").select("path", "data", "digest", "size", "stat"))
            return Capture(files, spark.createDataFrame(sorted(before.skips), "path string, reason string"), seal(files, before), len(kept))
    raise CaptureConflict(f"{root}: changed during {ATTEMPTS} captures")


def seal(files: DataFrame, found: Listing) -> str:
    """One digest over the version, the bounds, all paths with their digests, skips and ignore files."""
    pairs = sorted((r.path, r.digest) for r in files.select("path", "digest").collect())
    text = json.dumps([VERSION, MAX_FILE, sorted(EXCLUDED), pairs, sorted(found.skips), found.ignores], ensure_ascii=False, separators=(",", ":"))
    return digest(text.encode())


def collisions(files: DataFrame) -> DataFrame:
    """Paths that differ in case alone."""
    return files.groupBy(F.lower("path").alias("folded")).agg(F.sort_array(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def within_total(files: DataFrame, total: int = MAX_TOTAL, by: str | None = None) -> DataFrame:
    """Files in path order while their sizes add up to at most ``total`` (in each ``by`` group)."""
    w = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy("path")
    return files.withColumn("run", F.sum("size").over(w)).where(F.col("run") <= total).drop("run")


def ignored(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``files`` (path) with ``ignored``, as one expression: rules are (folder, text of its ignore file).  A file in an ignored
    folder is ignored whatever deeper rules say."""
    folders = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda i: F.struct(F.array_join(F.slice(folders, 1, i), "/").alias("p"), (i < F.size(folders)).alias("folder")))

    def one(x):
        out = F.lit(False)
        for folder, text in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
            prefix = f"{folder}/" if folder else ""
            own = F.substring(x["p"], len(prefix) + 1, 1 << 30)
            for expression, negated, only in (p for p in map(ignore_pattern, text.splitlines()) if p):
                hit = x["p"].startswith(prefix) & own.rlike("^(?s:" + expression.pattern.replace(r"\Z", "") + ")$") & (x["folder"] if only else F.lit(True))
                out = F.when(hit, F.lit(not negated)).otherwise(out)
        return out

    return files.withColumn("ignored", F.exists(every, one))


def manifest(files: DataFrame, name: str) -> DataFrame:
    """(path, folder, text) of the manifests of a name, such as go.mod or package.json."""
    return files.where((F.col("path") == name) | F.col("path").endswith("/" + name)).select(
        "path", F.regexp_replace("path", "(^|/)[^/]*$", "").alias("folder"), F.decode("data", "utf-8").alias("text"))
