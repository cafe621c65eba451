"""Code-aware text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of an identifier: capitals not before a small letter, capitalised words, digits.
PART = r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))


def word_terms(word: Column) -> Column:
    """Terms of one word: its lower-case parts of two characters or more, then the joined parts if there are several."""
    parts = F.regexp_extract_all(word, F.lit(PART), F.lit(1))
    small = F.filter(F.transform(parts, F.lower), lambda p: F.length(p) > 1)
    return F.concat(small, F.when(F.size(parts) > 1, F.array(F.lower(F.array_join(parts, "")))).otherwise(F.array().cast("array<string>")))


def terms(text: Column) -> Column:
    return F.flatten(F.transform(words(text), word_terms))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): texts move once, to where the rows of a key lie together; words are counted row by row, so no table of words is held."""
    near = df.where(F.col(text).isNotNull()).select(key, F.col(text).cast("string").alias("text")).repartition(key).sortWithinPartitions(key)
    kind = df.schema[key].dataType.simpleString()
    return near.mapInArrow(_counts(key), f"`{key}` {kind}, term string, tf long")


def _counts(key: str, rows: int = 100_000, kept: int = 100_000):
    """Postings of texts (key, text) that are in key order; yields tables of some ``rows`` and remembers the terms of ``kept`` words."""
    pattern = PART

    def run(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        words, parts = re.compile(r"[A-Za-z0-9_]+").findall, re.compile(pattern).findall
        known: dict[str, list[str]] = {}

        def terms_of(word):
            if (out := known.get(word)) is None:
                ps = parts(word)
                out = [p.lower() for p in ps if len(p) > 1] + (["".join(ps).lower()] if len(ps) > 1 else [])
                if len(known) >= kept:
                    known.clear()
                known[word] = out
            return out

        def tally(counted):
            out: dict[str, int] = {}
            for word, c in counted.items():
                for term in terms_of(word):
                    out[term] = out.get(term, 0) + c
            return out

        keys, sizes, terms, tfs, held, of = [], [], [], [], None, None

        def put():
            out = tally(held)
            keys.append(of), sizes.append(len(out)), terms.extend(out), tfs.extend(out.values())

        def table(kind):
            columns = [pa.array(keys, kind).take(pa.array(np.repeat(np.arange(len(keys)), sizes))), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())]
            for x in (keys, sizes, terms, tfs):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=[key, "term", "tf"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held is not None and k == of:
                    held.update(words(t.as_py()))
                    continue
                if held is not None:
                    put()
                held, of = Counter(words(t.as_py())), k
                if len(terms) >= rows:
                    yield table(kind)
        if held is not None:
            put()
            yield table(kind)

    return run


def units(text: Column) -> Column:
    """Budget units: a quarter of each word's length, rounded up, and one for each newline and other visible symbol."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    long = F.aggregate(runs, F.lit(0).cast("long"), lambda a, w: a + F.floor((F.length(w) + 3) / 4))
    return long + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.size(F.regexp_extract_all(text, F.lit(r"([^\p{L}\p{N}_\s])"), F.lit(1)))


def tails(name: Column) -> Column:
    """The name and what follows each of its ``.`` and ``::``, so that suffix matching is an equi-join."""
    parts = F.split(name, r"(?<=\.)|(?<=::)")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "")))


def path_suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """Enclosing directories, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


# Directories and file names that hold tests.
TEST_DIRS = ("test", "tests", "__tests__", "testing")
TEST_FILE = r"^test_[^/]*\.py$|^conftest\.py$|_test\.(py|go)$|\.(test|spec)\.[cm]?[jt]sx?$"


def is_test_path(path: Column) -> Column:
    """Whether a path lies in a test directory or is named like a test file."""
    parts = F.split(path, "/")
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS)))
    return inside | F.element_at(parts, -1).rlike(TEST_FILE)


# Suffix -> dialect, with regard to case.
DIALECTS = {
    "python": ("py",), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "go": ("go",), "rust": ("rs",), "java": ("java",),
    "csharp": ("cs",), "php": ("php", "phtml"), "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "c++", "hh", "hpp", "hxx", "h++", "ipp", "tpp", "inl"),
    "bash": ("bash", "bashrc", "bash_profile", "bash_login", "bash_logout", "bats"), "sh": ("sh",),
}
#: Syntax in a header that only C++ has.
CPP_SIGN = r"(?m)^\s*(template\s*<|namespace\s+\w+|class\s+\w+[^;]*\{|(public|private|protected)\s*:|using\s+\w+)"


def dialect(path: Column, text: Column | None = None) -> Column:
    """The dialect that parses a path; with the text, a header may be C++ and a first line may name a shell."""
    by_suffix = {s: d for d, suffixes in DIALECTS.items() for s in suffixes}
    suffix = F.regexp_extract(path, r"\.([A-Za-z_+]+)$", 1)
    out = F.element_at(F.create_map(*[F.lit(x) for kv in by_suffix.items() for x in kv]), suffix)
    if text is None:
        return out
    first = F.substring_index(text, "\n", 1)
    shell = F.regexp_extract(first, r"^#!\s*\S*?/?(?:env\s+(?:-\S+\s+)*)?(bash|dash|ksh|sh)\b", 1)
    return (F.when((suffix == "h") & text.rlike(CPP_SIGN), "cpp")
            .when(shell == "bash", F.when(out.isNull() | out.isin("bash", "sh"), "bash").otherwise(out))
            .when(shell != "", F.when(out.isNull() | out.isin("bash", "sh"), "sh").otherwise(out)).otherwise(out))


def line_starts(text: Column) -> Column:
    """0-based character offsets of the starts of all lines."""
    lens = F.transform(F.split(text, "\n"), lambda x: F.length(x) + 1)
    return F.slice(F.aggregate(lens, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))), 1, F.size(lens))


def char_to_byte(text: Column, at: Column) -> Column:
    """Bytes before a 0-based character of a text."""
    return F.octet_length(F.substring(text, F.lit(1), at))


def line_of(starts: Column, at: Column) -> Column:
    """1-based line of an offset, given the offsets of all lines."""
    return F.size(F.filter(starts, lambda s: s <= at))


def evidence(line: Column, limit: int = 160) -> Column:
    """A line's text without the blanks around it, cut to ``limit`` characters."""
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def display(key: Column) -> Column:
    """What a key is shown as: a symbol's path inside its file, or what follows the first colon."""
    return F.when(key.startswith("symbol:"), F.substring_index(key, "#", -1)).otherwise(F.regexp_replace(key, r"^[^:]*:", ""))


def enclosing(key: Column) -> Column:
    """Keys of a symbol's enclosing declarations, the outermost first."""
    parts = F.split(F.substring_index(key, "#", -1), r"\.")
    file = F.regexp_extract(key, r"^(.*)#", 1)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(file, F.lit("#"), F.array_join(F.slice(parts, 1, i), ".")))
    return F.when(key.startswith("symbol:") & (F.size(parts) > 1), many).otherwise(F.array().cast("array<string>"))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path, null if a part is no identifier; a package is named by its folder."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/")
    fine = F.forall(parts, lambda x: x.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))
    return F.when(path.endswith(".py") & fine, F.array_join(parts, "."))


def relevance(category: Column, seeded: Column, rank: Column, depth: Column, test: Column, test_weight: float = 1.0) -> Column:
    """Value of a candidate for packing: containers 0.2, seeds 0.9, lexical hits by rank, routed ones by depth; tests
    may weigh less, but a value that passes the floor stays at it."""
    file = (category == "file") & ~seeded & rank.isNull()
    base = F.when(rank.isNotNull(), F.greatest(F.lit(0.5), 0.85 - 0.025 * (rank - 1))).when(depth == 1, 0.45).otherwise(0.3)
    weighted = base * F.when(test, test_weight).otherwise(1.0)
    return (F.when(~category.isin("symbol", "file") | file, 0.2).when(seeded, 0.9)
            .when(base >= 0.4, F.greatest(weighted, F.lit(0.4))).otherwise(weighted))


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON of named values in the order of their names, nulls included."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def without_comments(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    bare = F.regexp_replace(text, r'("(?:[^"\\\\]|\\\\.)*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    return F.regexp_replace(bare, r'("(?:[^"\\\\]|\\\\.)*")|,(?=\s*[}\]])', "$1")


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without ``.`` parts, with ``a/..`` pairs taken out; null if it leads outside."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(
        (x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.when(F.coalesce(F.try_element_at(walked, F.lit(1)), F.lit("")) != "..", F.array_join(walked, "/"))
