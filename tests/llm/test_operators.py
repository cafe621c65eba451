"""Operators against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, licenses, piece_bpe, quality, range_join, rollups, shards, suffix_dedup, warc
from tessera.llm.shared import components

MODEL = public_tokenizers.path("piece_bpe_32k.model")
R = random.Random(3)
VOCAB = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 7))) for _ in range(60)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


BASE = prose(120)
EDITED = " ".join(w if i % 60 else "zz" for i, w in enumerate(BASE.split()))
TEXTS = [None, "", " ", "one", "One TWO", BASE, BASE, EDITED, BASE + " " + prose(40), "x " * 900, prose(3000) + " " + BASE, prose(30), "Released under the MIT License.\n" + prose(20), "漢字 é\n\tß"]
ROWS = [(i, t, "n", i) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that results use as well."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_words string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit", [None, 7])
def test_components(spark, limit):
    edges = [(R.randint(0, 300), R.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), limit).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in label.items() if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_join(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 8))
    x[20:30] = x[10:20] + g.normal(size=(10, 8)) * 0.05
    x[30] = x[31]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [1.0, None]), (64, [1.0, 0.0]), (65, [2.0, 0.0]), (66, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = [(i, j) for i in ok for j in ok if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.95]
    for i, _ in near:
        want[i] += 1
    for _ in range(70):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join.link(df).collect()}
    assert got == {i: (want[i], label[i], label[i] == i) for i in want}
    assert range_join.link(df.where("false")).count() == 0


def test_range_join_scaled_copies(spark, monkeypatch):
    """Copies of one direction at other lengths, whose units differ in the last bits, are a third of the pivots."""
    monkeypatch.setattr(range_join, "PER_PIVOT", 8)
    rng = np.random.default_rng(11)
    far, hot = rng.normal(size=(1000, 64)), rng.normal(size=64) * rng.uniform(0.1, 9, (500, 1))
    v = rng.permutation(np.concatenate([far, hot])).astype(np.float32)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join.link(df).collect()}
    assert got == {i: (int(n.sum()), min([i, *np.flatnonzero(n).tolist()])) for i, n in enumerate(near)}


def test_range_join_across_cells(spark, monkeypatch):
    """Links inside a cell of several blocks and runs, and between cells, each counted at both ends."""
    monkeypatch.setattr(range_join, "BLOCK", 1)
    monkeypatch.setattr(range_join, "RUN", 64)
    rng = np.random.default_rng(12)
    v = rng.permutation(np.concatenate([rng.normal(size=(1000, 3)), rng.normal(size=3) + rng.normal(size=(600, 3)) * 0.1]))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join.link(df).collect()}
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(v)).min(1))
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(n.sum()), int(label[i])) for i, n in enumerate(near)}


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].n_words for i in range(len(TEXTS))] == [len(words(t)) for t in TEXTS]
    assert got[12].base[0].label == "mit" and got[12].base[0].word == 3 and got[12].spans[0].label == "mit" and got[12].spans[0].errors == 0
    n, base, spans = licenses.Notices().find(b"Licenced under teh Apache License, Version 2.0 and MIT License mit license")
    assert [(b["label"], b["word"]) for b in base] == [("apache", 3), ("mit", 9), ("mit", 11)] and ("apache-2.0", 3) in [(s["label"], s["errors"]) for s in spans]
    _, _, spans = licenses.Notices().find(b"released under teh MIT license and then x released under the MIT license")
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in spans if s["label"] == "mit"] == [(0, 4, 2), (8, 12, 0)]
    for text, want in {"Licensed under CC BY-SA 4.0": ["cc-by-sa-4.0"], "licensed under cc by nd 4.0.": ["cc-by-nd-4.0"], "Licensed under CC BY 3.0": [], "lisensed under CC BY 4.0": ["cc-by-4.0"],
                       "Licensed under the GNU General Public License version 2": ["gpl-2.0"], "Licensed under the Apache License, Version 1.1": [],
                       "licensed under the gnu lesser general public license version 3": ["lgpl"], "licensed under the gnu general public licence, version 3": ["gpl-3.0"],
                       "Licensed under CC BY-NC 4.0 ": ["cc-by-nc-4.0"], "released under the bit license": []}.items():
        assert [s["label"] for s in licenses.Notices().find(text.encode())[2]] == want, text
    assert licenses.scan(empty).count() == 0


def _edited(t):
    t = list(t)
    for _ in range(R.randint(0, 5)):
        i = R.randrange(len(t))
        t[i : i + R.randint(0, 1)] = R.choice(["x", " ", "", "é", "ab"])
    return "".join(t)


def test_licenses_brute_force():
    """Each notice against its expression over the whole line, without seeds; exact phrases against every word."""
    import regex

    every = licenses.Notices()
    whole = ["".join(x if isinstance(x, str) else x[0] for x in s) for _, s in licenses.NOTICES]
    for _ in range(150):
        text = " ".join(R.choice([lambda: _edited(R.choice(whole)), lambda: prose(R.randint(1, 12)), lambda: R.choice(["MIT license", "apache  License", "general public license"])])() for _ in range(6))
        w = words(text)
        n, base, _ = every.find(text.encode())
        want = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert n == len(w) and [(b["word"], b["label"]) for b in base] == sorted(want)
        line = " ".join(w).encode().decode("latin-1")
        got = every._spans(line)
        for k, (_, s) in enumerate(licenses.NOTICES):
            found = [m.span() for m in regex.finditer(licenses.pattern(s), line)]
            mine = [x[:2] for x in got if x[2] == k]
            assert len(found) == len(mine) and all(a[0] < b[1] and b[0] < a[1] for a, b in zip(found, mine, strict=True)), (line, k)


def test_licenses_long_texts():
    """Time grows with the length of a text of phrases."""
    import time

    took = []
    for n in (4_000, 16_000):
        text = b"released under the mit license and licensed under cc by 4 0 " * n
        began = time.perf_counter()
        assert len(licenses.Notices().find(text)[2]) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_warc(spark):
    page = "<html><head><title> A &amp; B </title><script>no()</script></head><body><p>x<br>y <a href='/l?q=1&amp;r=2'>z</a><!-- c --></body>"
    df = spark.createDataFrame([(1, "http://h.test/a/", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    derived = warc.derive(warc.responses_of(df))
    got = {r.page_id: r for r in derived.collect()}
    assert got[1].title == "A & B" and got[1].links == ["http://h.test/l?q=1&r=2"] and got[1].text == "x\ny z" and got[1].status == 200
    assert got[2].text == "" and got[2].n_links == 0 and got[1].refers_to == got[1].record_id
    made = [(dict(h), b) for r in warc.records(warc.responses_of(df.where("page_id = 1"))).collect() for h, b in warc.parse(bytes(r.record))]
    assert [h["WARC-Type"] for h, _ in made] == ["metadata", "conversion"] and all(h["WARC-Refers-To"] == got[1].record_id for h, _ in made)
    assert all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in made) and made[1][1].decode() == "x\ny z"


def test_warc_round_trip(spark, tmp_path):
    """A file of responses, with repeated headers, a gzip and a chunked body, read, derived, written and parsed again."""
    import gzip as gz
    import json

    def response(n, extra, body):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + extra + b"\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{n}>\r\nWARC-Target-URI: http://h.test/{n}\r\nX-A: 1\r\nX-A: 2\r\nWARC-Date: 2024-01-0{n}T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    long = prose(200_000)
    pages = [response(1, b"Content-Encoding: gzip\r\n", gz.compress(b"<title>t</title><p>zipped")), response(2, b"Transfer-Encoding: chunked\r\n", b"4\r\n<p>a\r\n3\r\n bc\r\n0\r\n\r\n"),
             response(3, b"", f"<p>{long}".encode()), response(4, b"Content-Encoding: gzip\r\n", b"<p>not zipped"), response(5, b"", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gz.compress, pages)))
    (tmp_path / "b.warc").write_bytes(b"".join(pages[:2]))
    got = warc.records(warc.read(spark, str(tmp_path))).sort("uri", "kind").collect()
    texts = [(r.uri[-1], bytes(next(warc.parse(bytes(r.record)))[1]).decode()) for r in got if r.kind == "conversion"]
    assert texts == [("1", "zipped"), ("1", "zipped"), ("2", "a bc"), ("2", "a bc"), ("3", " ".join(long.split())), ("4", "not zipped"), ("5", "")]
    meta = json.loads(next(warc.parse(bytes(got[1].record)))[1]) if got[1].kind == "metadata" else json.loads(next(warc.parse(bytes(got[2].record)))[1])
    assert meta["Envelope"]["WARC-Header-Metadata"]["X-A"] == ["1", "2"] and meta["Envelope"]["WARC-Header-Metadata"]["WARC-Type"] == "response"
    assert all(r.refers_to == f"<urn:x:{r.uri[-1]}>" for r in got) and len({r.derived_id for r in got}) == 10


def test_warc_query(spark):
    """The query over all pages of the smallest tables, against digests and links worked out from the records alone."""
    got = warc.op3(spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert sorted((r.page_id, r.kind) for r in got) == sorted((p.page_id, k) for p in pages for k in ("conversion", "metadata"))
    url = {p.page_id: p.url for p in pages}
    for r in got:
        (h, block), = warc.parse(bytes(r.record))
        h = dict(h)
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Target-URI"] == url[r.page_id] and h["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert r.kind == "metadata" or b"<p" not in block and b"<div" not in block
    empty = warc.responses_of(spark.createDataFrame([], "page_id long, url string, html string, kind string"))
    assert warc.records(empty).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontamination(spark, docs, empty, limit):
    items = [("1", " ".join(BASE.split()[10:40])), ("2", "one"), ("3", ""), ("4", None), ("5", " ".join(BASE.split()[10:20]).upper()), ("6", prose(15))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, bench, limit=limit).collect()}
    for i, t in enumerate(TEXTS):
        w, hit, found = words(t), set(), set()
        for n, x in items:
            v = words(x)
            m = min(10, len(v))
            for s in range(len(v) - m + 1) if m else ():
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[s : s + m]:
                        hit.update(range(p, p + m))
                        found.add(n)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found)), i
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontamination_without_item_id(spark, docs, limit):
    """Passages of items without an id are hit; only named items are given."""
    bench = spark.createDataFrame([(None, " ".join(BASE.split()[10:40])), (None, prose(15)), ("5", " ".join(BASE.split()[60:80]))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.scan(docs, bench, limit=limit).collect()}
    assert (got[5].n_hit, got[5].runs, got[5].items) == (50, [10, 40, 60, 80], ["5"])


def test_decontamination_repeated_items(spark):
    """Equal rows of the benchmark, however many, reach the driver once."""
    bench = spark.createDataFrame([("5", prose(30))] * 500 + [("6", None)] * 500 + [(None, "x")] * 500, "item_id string, text string")
    got = list(decontaminate.chunks(bench, "item_id", "text", 1 << 20))
    assert len(got) == 1 and len(got[0]) == 3


def test_quality(spark):
    rows = [(i, ("GOOD!! " if i % 3 == 0 else "calm words, ") * (i % 7 + 3)) for i in range(600)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 600").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id", "left").withColumn("h", quality.held_out("doc_id")).collect()
    held = [r for r in got if r.h and r.quality is not None]
    assert len(got) == 602 and len(held) > 60 and all((r.score >= 0.3) == bool(r.quality) for r in held) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs, quality.learn(docs, labels.where("false"))).where("score <> 0.5").count() == 0


def test_quality_statistics(spark):
    """Statistics against counts in Python, on nulls, empty, long and odd texts, with clashing columns and repeats."""
    texts = [*TEXTS, "ABC XYZ 0123456789 [x](y) {z} <a> #$%&*+/@~^_ !? |", "Z" * 50_000 + " 9" * 50_000, "a\n\na b"]
    rows = [(i, t, "s", 1.0) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    stats = quality.statistics("text")
    for r in df.select("text", *[c.alias(k) for k, c in stats.items()]).collect():
        t = r.text or ""
        n, w, lines = max(len(t), 1), t.split(" "), t.split("\n")
        share = lambda p: len(re.findall(p, t)) / n
        want = {"log_words": np.log(len(w)), "word_length": len(t) / len(w), "distinct_words": len(set(w)) / len(w), "distinct_lines": len(set(lines)) / len(lines),
                "words_a_line": np.log1p(len(w) / len(lines)), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "marks": share("[!?]"), "symbols": share(r"[#$%&*+/@~^_]"),
                "brackets": share(r"[<>{}=()\[\]]"), "bars": share(r"\|"), "stops": share("[.,]"), "beyond_ascii": (len(t.encode()) - len(t)) / n}
        for k in stats:
            assert abs(r[k] - (want[k] if t else 0)) < 1e-9, (k, t[:40])
    model = (0.1, [(((0, 1.5, True),), 0.7), (((5, 0.01, False), (6, 0.5, True)), -2.0)])
    names = list(stats)
    got = quality.score(df, model).withColumn("a", stats[names[0]]).withColumn("b", stats[names[5]]).withColumn("c", stats[names[6]]).collect()
    assert len(got) == len(rows)
    for r in got:
        x = 0.1 + 0.7 * (r.a > 1.5) - 2.0 * (r.b <= 0.01 and r.c > 0.5)
        assert abs(r.score - 1 / (1 + np.exp(-x))) < 1e-12
    assert quality.accepted(df, model, 0.6).count() == sum(r.score >= 0.6 for r in got) and quality.score(df.where("false"), model).count() == 0


def test_quality_query(spark):
    """Every document once, held out by its checksum, and held-out labels told apart better than by their rate."""
    import zlib

    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op5(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and got[r.doc_id].held_out]
    right = np.mean([got[r.doc_id].predicted == r.quality for r in labels])
    assert right > 0.95, right


@pytest.mark.parametrize(("length", "array", "piece"), [(60, None, None), (60, 1, 4), (400, 2000, None)])
def test_suffix_dedup(docs, empty, length, array, piece):
    """Against the set of all windows; small arrays cut hot runs into pieces, and hot pieces into windows."""
    raw = [(t or "").encode() for t in TEXTS]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.remove(docs, length, array=array, piece=piece).collect()}
    for n, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        assert (got[n].n_bytes, got[n].n_removed, got[n].n_spans, bytes(got[n].kept)) == (len(t), int(gone.sum()), spans, kept), n
        assert got[n].kept_sha256 == hashlib.sha256(kept).hexdigest() and (got[n].kept_text or "") == kept.decode("utf-8", "ignore")
    assert suffix_dedup.remove(empty, length).count() == 0


def test_suffix_dedup_rows_of_hot_runs(spark, small):
    """Single windows of a hot run go back to its places as one row a place; texts without a period, so a run is shorter than ``length``."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(40))
    texts = [f"{' '.join(word() for _ in range(9))} {shared[: 150 + i]} {' '.join(word() for _ in range(9))}" for i in range(24)] * 2
    out = suffix_dedup.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60, array=1, piece=4)
    got = {x.doc_id: x for x in out.collect()}
    raw = [t.encode() for t in texts]
    windows = Counter(t[i : i + 60] for t in raw for i in range(len(t) - 59))
    for n, t in enumerate(raw):
        gone = {i + k for i in range(len(t) - 59) if windows[t[i : i + 60]] > 1 for k in range(60)}
        assert bytes(got[n].kept) == bytes(b for i, b in enumerate(t) if i not in gone)
    places = sum(len(suffix_dedup.runs(np.frombuffer(t, np.uint8), 60, suffix_dedup.gram_of(60))[0]) for t in raw)
    todo, made = [out._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
        if "Join" in node.nodeName() and "name#" in node.leftKeys().toString():
            made.append(node.metrics().apply("numOutputRows").value())
    assert len(made) == 1 and 0 < made[0] <= places, (made, places)


def test_suffix_dedup_other_splits(spark, tmp_path):
    """Files that the last scan splits otherwise than the first ones."""
    long = [prose(400) for _ in range(40)]
    rows = [(i, f"{t} {BASE}" if i % 9 == 0 else t) for i, t in enumerate(long)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).mode("append").parquet(f"{tmp_path}/d")
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove(spark.read.parquet(f"{tmp_path}/d"), 60).collect()}
    assert sum(n > 0 for n, _ in want.values()) >= 5
    out = suffix_dedup.remove(spark.read.parquet(f"{tmp_path}/d"), 60, scanned=True)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want


@pytest.mark.parametrize("names", [1 << 18, 3])
def test_suffix_array(names, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "NAMES", names)
    for t in [b"banana", b"aaaaaa", b"ab" * 40, b"\0a" * 9 + b"\0", b"abcabcabcab", bytes(R.choice(b"ab") for _ in range(300)), bytes(range(255, -1, -1))]:
        sa = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), len(t) + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_pieces(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL).withColumn("ids", piece_bpe.ids()).collect()}
    for i, t in enumerate(TEXTS):
        want = [1, *sp.encode(t or ""), 2]
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].decoded == got[i].text == sp.decode(want)
    table = piece_bpe.PrefixTable(MODEL)
    for _ in range(1500):
        t = "".join(R.choice(["a", "A", "th", "ing", " ", "  ", "\n", "é", "漢", "▁", "<s>", "😀", "1", chr(R.randint(1, 0xD7FF))]) for _ in range(R.randint(0, 25)))
        packed, back = table.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == [1, *sp.encode(t), 2] and back.decode() == sp.decode(sp.encode(t))
    assert piece_bpe.encode(empty, MODEL).count() == 0


def test_rollups(spark, tmp_path):
    s = rollups.Rollups(spark, f"file://{tmp_path}/r")
    row = "seq long, op string, doc_id long, version string, source string, lang string, n_tokens long"
    one = spark.createDataFrame([(0, "insert", i, "v", "s" if i % 2 else None, "en", 10 + i) for i in range(6)] + [(0, "insert", None, "v", "s", "en", 5)], row)
    two = spark.createDataFrame([(0, "delete", 1, "v", None, None, None), (0, "revise", 2, "v", "t", "en", 50), (1, "delete", 3, "v", "s", "en", 0), (2, "insert", 3, "v", "s", "en", 7), (0, "delete", 99, "v", "s", "en", 1)], row)
    assert s.totals().count() == 0 and s.apply("1", one) and s.apply("2", two) and not s.apply("2", two)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in s.totals().collect()}
    assert got == {(None, "en", "v"): (2, 24), ("s", "en", "v"): (2, 22), ("t", "en", "v"): (1, 50)} and s.commits() == ["1", "2"]
    assert s.apply("3", two.where("false")) and {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in s.totals().collect()} == got


def test_rollups_brute_force(spark, tmp_path):
    """Random batches with null versions and groups, repeats, ties and unknown ops, against a dictionary."""
    s = rollups.Rollups(spark, f"file://{tmp_path}/r")
    rng, state = random.Random(8), {}
    schema = "seq long, op string, doc_id long, version string, source string, lang string, n_tokens long, docs string, gone string"
    for n in range(4):
        rows = [(rng.randint(0, 3), rng.choice(["insert", "delete", "revise", "drop", None]), rng.choice([None, *range(12)]), rng.choice([None, "v"]), rng.choice([None, "s", "t"]),
                 rng.choice([None, "en"]), rng.choice([None, *range(5)]), "x", "y") for _ in range(40)]
        s.apply(str(n), spark.createDataFrame(rows, schema).repartition(3))
        low = lambda x: (x is not None, x)
        best = {}
        for seq, op, doc, version, source, lang, tokens, *_ in rows:
            if doc is not None and op in ("insert", "delete", "revise"):
                c = ((seq, tokens or 0, op, low(source), low(lang)), op, source, lang, tokens or 0)
                best[doc, version] = max(best.get((doc, version), c), c, key=lambda x: x[0])
        for k, (_, op, *what) in best.items():
            state.pop(k, None)
            if op != "delete":
                state[k] = tuple(what)
        want = {}
        for (_, version), (source, lang, tokens) in state.items():
            d, t = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = d + 1, t + tokens
        assert {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in s.totals().collect()} == want
        assert {(r.doc_id, r.version): (r.source, r.lang, r.n_tokens) for r in s.ledger().collect()} == state


def test_rollups_two_writers(spark, tmp_path):
    """A writer that commits while another one works: the other fails, loses nothing and succeeds again."""
    row = "seq long, op string, doc_id long, version string, source string, lang string, n_tokens long"
    first, second = (rollups.Rollups(spark, f"file://{tmp_path}/r") for _ in range(2))
    batch = lambda i: spark.createDataFrame([(0, "insert", i, "v", "s", "en", 1), (0, "insert", 9, "v", "s", "en", i)], row)
    assert first.apply("0", batch(0))
    mark = second._mark
    second._mark = lambda *a: (first.apply("1", batch(1)), mark(*a))
    with pytest.raises(RuntimeError):
        second.apply("2", batch(2))
    second._mark = mark
    assert second.apply("2", batch(2)) and first.commits() == ["0", "1", "2"]
    assert [(r.docs, r.tokens) for r in first.totals().collect()] == [(4, 5)] and sorted(r.doc_id for r in first.ledger().collect()) == [0, 1, 2, 9]
    open(f"{tmp_path}/r/commits/000000003", "w").close()
    with pytest.raises(RuntimeError):
        first.apply("3", batch(3))
    first.recover()
    assert first.apply("3", batch(3))


def test_rollups_query(spark):
    """The query against counts of tiktoken and a plain recount."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    encode = rollups._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    groups, want = {}, {}
    for d in docs:
        groups.setdefault(d.text or "", []).append(d)
    for t, same in groups.items():
        d = min(same, key=lambda x: x.doc_id)
        n, k = want.get((d.source, d.lang), (0, 0))
        want[d.source, d.lang] = n + 1, k + len(encode(t)) + (len(same) > 1)
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in rollups.op8(spark, sf).collect()}
    assert got == want


def test_tokens(spark):
    import base64

    df = rollups.count_tokens(spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a) for a, _ in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert b" world" in ranks and {r.doc_id: r.n_tokens for r in df.collect()} == {1: 2, 2: 0}


def test_shards(spark, empty):
    rows = [(i, None if i == 5 else "same" * 50 if i % 3 == 0 else prose(R.randint(0, 40))) for i in range(3000)] + [(7, "x")] * 4 + [(None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shards.shard(df).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    per = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert all(p == list(range(len(p))) for p in per) and max(sizes) - min(sizes) < 0.02 * sum(sizes)
    import zlib

    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(zlib.crc32((t or "").encode()))
    for r in got:
        assert r.text_crc32 in text[r.doc_id] and r.law == "bytes"
    assert shards.shard(empty).count() == 0 and [r.slot for r in shards.shard(df.limit(1)).collect()] == [0]
    small = spark.createDataFrame([(i, "pair" + str(i // 2)) for i in range(4000)], "doc_id long, text string")
    for whole, most in ((shards.WHOLE, 1), (0.0, 2)):  # two equal texts part only where every row is dealt by its own place
        per = {}
        for r in shards.shard(small, whole=whole).collect():
            per.setdefault(r.text_crc32, set()).add(r.shard)
        assert max(map(len, per.values())) <= most and {x for v in per.values() for x in v} == set(range(8))


@pytest.mark.parametrize(("k", "t", "block"), [(3, Fraction(9, 10), 768), (5, Fraction(4, 5), 3)])
def test_jaccard(spark, docs, empty, k, t, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = list(TEXTS)
    for _ in range(12):
        w = BASE.split()
        for _ in range(R.randint(0, 4)):
            w[R.randrange(len(w))] = "q"
        rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sets = []
    for x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and Fraction(len(a & b), len(a | b)) >= t:
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, k, t).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    if block == 3:
        assert jaccard_join.join(empty, k, t).count() == 0 and jaccard_join.deduplicate(docs, k, t).count() == len(set(label[: len(TEXTS)]))
