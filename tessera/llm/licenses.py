"""Fuzzy search for short licence notices.

A notice is a row of segments: some may hold errors, up to a number for each; the words that tell one licence from another
(versions, "nc", "sa", "lesser") must be there as they are.  A notice that may hold k errors in all is cut into k + 1 pieces; by
the pigeonhole principle one piece is left as it is.  An automaton finds all pieces in one run over the words of a text,
and only around them the regex library matches the notice with bounded edits and reports the span.  Of spans that overlap,
the one with the best score stays (of equals the longer, then the first label).
Exact phrases (``BASE``) are reported as well.  One scan, no shuffle.

Defined results: null or empty text: no words, no places, score 0; a text of any length is searched
whole, in time that grows with its length; ties are settled as said above; repeated rows stay; an empty table gives an empty table; other columns are
passed on, except those with a result's name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: phrase -> label
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_CC = [(f"cc-{name}-4.0", (("licensed under cc", 2), f" {name.replace('-', ' ')} 4 0")) for name in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")]
#: (label, segments in lower-case words: (text, edits allowed), or text that must be there as it is)
NOTICES = (
    ("apache-2.0", (("licensed under the apache license version", 4), " 2 0")),
    ("mit", (("released under the", 2), " mit", (" license", 1))),
    ("mit", (("permission is hereby granted free of charge to any person obtaining a copy", 7),)),
    ("gpl-2.0", (("licensed under the gnu", 2), " general", (" public license version", 3), " 2")),
    ("gpl-3.0", (("licensed under the gnu", 2), " general", (" public license version", 3), " 3")),
    ("gpl", (("you can redistribute it and or modify it under the terms of the gnu", 6), " general")),
    ("lgpl", (("licensed under the gnu", 2), " lesser", (" general public license", 3))),
    ("agpl", (("licensed under the gnu", 2), " affero", (" general public license", 3))),
    *_CC,
    ("cc0-1.0", ("cc0 1 0", (" universal public domain dedication", 4))),
    ("bsd", (("redistribution and use in source and binary forms with or without modification", 7),)),
    ("mpl-2.0", (("subject to the terms of the mozilla public license v", 5), " 2 0")),
    ("isc", (("permission to use copy modify and or distribute this software for any purpose", 7),)),
    ("unlicense", (("this is free and unencumbered software released into the public domain", 7),)),
    ("all-rights-reserved", (("all rights reserved", 1),)),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPACE = np.uint8(32)
SCHEMA = ("n_words long, base array<struct<label:string,word:long>>, "
          "spans array<struct<label:string,first_word:long,last_word:long,errors:int,score:double>>")


def pattern(segments) -> str:
    """The bounded-error expression of a notice; it starts and ends at words' edges."""
    out = ""
    for x in segments:
        text, k = (x, 0) if isinstance(x, str) else x
        text = regex.escape(text, literal_spaces=True)
        out += f"(?:{text}){{e<={k}}}" if k else text
    return rf"(?e)(?<![^ ]){out}(?![^ ])"


class Notices:
    def __init__(self, notices=NOTICES, base=BASE) -> None:
        self.base = [(f" {p} ", label) for p, label in base.items()]
        # label, text without errors, errors in all
        self.notices = [(label, "".join(x if isinstance(x, str) else x[0] for x in s), sum(0 if isinstance(x, str) else x[1] for x in s)) for label, s in notices]
        self.pattern = [regex.compile(pattern(s)) for _, s in notices]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.notices):
            for j in range(k + 1):
                a, b = j * len(text) // (k + 1), (j + 1) * len(text) // (k + 1)
                where.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for piece, at in where.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()

    def _spans(self, line: str) -> list[tuple[int, int, int, int]]:
        """(first character, last + 1, notice, errors) of all notices, each from left to right."""
        done = [0] * len(self.notices)  # how far each notice's matches, and windows without one, reach
        tried: list[tuple[int, int]] = [(0, 0)] * len(self.notices)
        out = []
        for end, (size, uses) in self.seeds.iter(line):
            for n, a in uses:
                _, notice, k = self.notices[n]
                begin = end + 1 - size - a
                low, high = max(done[n], begin - k - 1), min(begin + len(notice) + k + 1, len(line))
                if high - low < len(notice) - k or tried[n][0] <= low and high <= tried[n][1]:
                    continue
                tried[n] = low, high
                # One character more on each side, so that the edges of words are seen.
                for m in self.pattern[n].finditer(line, low, min(high + 1, len(line))):
                    out.append((m.start(), m.end(), n, sum(m.fuzzy_counts)))
                    done[n] = m.end()
        return out

    def find(self, text: bytes) -> tuple[int, list[dict], list[dict]]:
        """(words, exact phrases, fuzzy spans) of a text."""
        words = _WORD.findall(text.lower())
        raw = b" ".join(words)
        line = raw.decode("latin-1")
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == _SPACE)
        word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  the number of the word at a place of the line
        padded = f" {line} "
        base = []
        for phrase, label in self.base:
            at = padded.find(phrase)
            while at >= 0:
                base.append({"label": label, "word": word(at)})
                at = padded.find(phrase, at + 1)
        spans, taken = [], []
        for s, e, n, errors in sorted(self._spans(line), key=lambda x: (x[3] / len(self.notices[x[2]][1]), x[0] - x[1], self.notices[x[2]][0])):
            at = bisect.bisect_left(taken, (s, e))
            if at < len(taken) and taken[at][0] < e or at and taken[at - 1][1] > s:
                continue
            taken.insert(at, (s, e))
            label, notice, _ = self.notices[n]
            spans.append({"label": label, "first_word": word(s), "last_word": word(e), "errors": errors, "score": 1 - errors / len(notice)})
        return len(words), sorted(base, key=lambda x: (x["word"], x["label"])), sorted(spans, key=lambda x: (x["first_word"], x["label"]))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_words, base (label and first word of each exact phrase) and spans (label, first and
    last word, errors and score of each notice)."""
    made = ("n_words", "base", "spans")
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, *made)]
    chosen = df.select(*keep, F.col(text).cast("string").alias(text))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Notices().find
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                got = [find((x or "").encode("utf-8", "surrogatepass")) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(j) for j in range(len(keep))]
                    + [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], base_type), pa.array([g[2] for g in got], span_type)],
                    [*keep, *made])

    return chosen.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base = F.transform("base", lambda x: x["label"])
    words = F.transform("base", lambda x: x["word"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        "spans")
