"""Quality classifier: a sparse rule ensemble.

Statistics of a text are Spark expressions.  Boosted shallow trees are grown on a bounded
sample of labelled rows, every path from a root becomes a conjunctive rule, a lasso logistic
regression weights the rules (most become 0), and the rest is compiled into one Spark
column expression, so scoring is a single scan without Python.

Only rows whose crc32(id as text) mod 5 is not 0 are learnt from.  ``SAMPLE`` bounds the rows that
reach the driver; scoring covers all rows.

Defined results: null and empty text: the score of all-zero statistics; a text of any length is counted whole; null id: not held out; labels of
one kind only, or none: a constant score (their mean, or 0.5); an id labelled twice counts twice, and a label counts once for each row of
its id; repeated rows stay; an empty table gives an empty table; other columns are passed on, except those with a result's name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from at most: those with the smallest hashes of their ids.
SAMPLE = 8_000
TREES, DEPTH, BINS, RATE = 12, 3, 32, 0.5
LASSO, STEPS = 2e-4, 200
FOLDS, THRESHOLD = 5, 0.3


def statistics(text: str = "text") -> dict[str, Column]:
    """Name -> expression over a text column; all are 0 for an empty text.  Single characters are counted by literal
    replacement, ranges of characters by what a regular expression leaves."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))

    def count(chars: str) -> Column:
        left = t
        for c in chars:
            left = F.replace(left, F.lit(c), F.lit(""))
        return F.length(t) - F.length(left)

    def within(chars: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{chars}]+", ""))

    words = F.split(t, " ")
    lines = F.split(t, "\n")
    empty = F.length(t) == 0
    got = {
        "log_words": F.log(F.size(words).cast("double")),
        "word_length": F.length(t) / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_a_line": F.log1p(F.size(words) / F.size(lines)),
        "capitals": within("A-Z") / n,
        "digits": within("0-9") / n,
        "marks": count("!?") / n,
        "symbols": within("#$%&*+/@~^_") / n,
        "brackets": within("<>{}=()\\[\\]") / n,
        "bars": count("|") / n,
        "stops": count(".,") / n,
        "beyond_ascii": (F.octet_length(t) - F.length(t)) / n,
    }
    return {k: F.when(empty, 0.0).otherwise(v.cast("double")) for k, v in got.items()}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
    """One regression tree of depth ``DEPTH`` on gradients: its paths as tuples of (feature, cut, above), and its values."""
    rules, value = [], np.zeros(len(x))

    def node(at: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        value[at] = g[at].sum() / (h[at].sum() + 1.0)
        if len(path) == DEPTH or len(at) < 40:
            return
        best = (1e-6, -1, -1)
        base = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for f, e in enumerate(edges):
            m = len(e) + 1
            gs, hs = (np.cumsum(np.bincount(x[at, f], w[at], m))[:-1] for w in (g, h))
            c = np.cumsum(np.bincount(x[at, f], minlength=m))[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - base
            gain[(c < 15) | (c > len(at) - 15)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f >= 0:
            above = x[at, f] > k
            node(at[~above], (*path, (f, float(edges[f][k]), False)))
            node(at[above], (*path, (f, float(edges[f][k]), True)))

    node(np.arange(len(x)), ())
    return rules, value


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) of statistics x and labels y (0 or 1)."""
    if not len(y):
        return 0.0, []
    mean = float(y.mean())
    if mean in (0.0, 1.0):
        return math.log((mean + 1e-3) / (1 - mean + 1e-3)), []
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    score = np.full(len(y), math.log(mean / (1 - mean)))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        found, value = _grow(binned, edges, y - p, p * (1 - p))
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in found))
        score += RATE * value
    names = list(rules)
    z = np.stack([np.all([(x[:, f] > c) == up for f, c, up in r], 0) for r in names], 1).astype(float) if names else np.zeros((len(y), 0))
    mid = z.mean(0)
    z0 = np.column_stack([np.ones(len(y)), z - mid])
    w = np.zeros(z0.shape[1])
    v, t = w.copy(), 1.0
    step = 4 * len(y) / float(np.linalg.eigvalsh(z0.T @ z0)[-1])
    for _ in range(STEPS):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(z0 @ v, -40, 40)))
        new = v - step * (z0.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * LASSO, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    kept = [(r, float(a)) for r, a in zip(names, w[1:], strict=True) if abs(a) > 1e-6]
    return float(w[0] - w[1:] @ mid), kept


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> tuple[float, list[tuple[tuple, float]]]:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y")).sort(F.xxhash64("_id"), "_y").limit(sample))
    stats = statistics("_t")
    # A label whose id many rows share could bring more rows than the sample: the first by hash are learnt from.
    rows = (documents.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
            .join(F.broadcast(chosen), "_id")  # at most `sample` rows of two numbers
            .select(F.xxhash64("_id", "_y").alias("_h"), F.xxhash64("_t").alias("_g"), "_id", "_y", *[c.alias(k) for k, c in stats.items()])
            .sort("_h", "_g").limit(sample).drop("_h", "_g").collect())
    rows.sort(key=lambda r: (r[0], r[1], *r[2:]))
    return fit(np.array([r[2:] for r in rows], float).reshape(len(rows), len(stats)), np.array([r[1] for r in rows], float))


def compiled(model: tuple[float, list[tuple[tuple, float]]], columns: list[str]) -> Column:
    """The model as one column expression over named statistics."""
    intercept, rules = model
    total: Column = F.lit(intercept)
    for rule, weight in rules:
        test = None
        for f, cut, above in rule:
            one = F.col(columns[f]) > cut if above else F.col(columns[f]) <= cut
            test = one if test is None else test & one
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(documents: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with score double: higher means label 1 is likelier."""
    keep = [c for c in (documents.columns if keep is None else keep) if c != "score"]
    stats = statistics(text)
    with_stats = documents.select(*keep, *[c.alias(f"_s_{k}") for k, c in stats.items()])
    return with_stats.select(*keep, compiled(model, [f"_s_{k}" for k in stats]).alias("score"))


def accepted(documents: DataFrame, model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``.

    A filter on the score would be pushed below the statistics, and each rule would then compute its own again;
    a row number that the filter reads keeps it above them."""
    stats = statistics(text)
    with_stats = documents.select(*documents.columns, *[c.alias(f"_s_{k}") for k, c in stats.items()], F.monotonically_increasing_id().alias("_s_row"))
    return with_stats.where((compiled(model, [f"_s_{k}" for k in stats]) >= threshold) & (F.col("_s_row") >= 0)).select(*documents.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
