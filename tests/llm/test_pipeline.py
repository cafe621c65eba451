"""The pipeline's stages against results worked out without them, and on awkward documents."""

import hashlib
import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tessera.llm import quality
from tessera.llm.shared import stage

SF = "/root/testdata/sf0.001"
LENGTH = P.REPEAT_BYTES


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near(docs):
    """Ids that stay of groups linked by Jaccard >= 0.8 of five-word shingles."""
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return {i for i in ids if top(i) == i}


def without_repeats(docs):
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = {}
    for t in raw.values():
        for k in range(len(t) - LENGTH + 1):
            seen[t[k : k + LENGTH]] = seen.get(t[k : k + LENGTH], 0) + 1
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = True
        out[i] = None if docs[i] is None else np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def clean(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for t in bench:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(m, set()).add(tuple(w[k : k + m]))
    hit = lambda w: any(tuple(w[k : k + m]) in s for m, s in windows.items() for k in range(len(w) - m + 1))
    return {i for i, t in docs.items() if not hit(words(t))}


def test_stages(spark):
    """Each stage over all that its predecessor kept; columns stay, and decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    table = lambda df: {r.doc_id: r.text for r in df.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = dict(P.STAGES)
    before = table(docs)
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [{r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}]
    for name, rule in [("quality classifier", None), ("n-gram jaccard join", near), ("suffix-array dedup", without_repeats), ("benchmark decontamination", lambda d: clean(d, bench))]:
        docs = stage(steps[name](spark, docs, SF))
        after = table(docs)
        assert docs.columns == columns and docs.count() == len(after) and 0 < len(after) <= len(before), name
        if name == "suffix-array dedup":
            assert after == rule(before)
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        else:
            assert set(after) == (rule(before) if rule else want[0]) and all(after[i] == before[i] for i in after), name
        before = after
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in steps["sentencepiece encoding"](spark, docs, SF).collect()}
    assert set(last) == set(before)
    for i, t in before.items():
        ids = [sp.bos_id(), *sp.encode(t or ""), sp.eos_id()]
        assert np.frombuffer(last[i].ids, "<u4").tolist() == ids and last[i].n_tokens == len(ids)
        assert last[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_awkward_documents(spark, tmp_path):
    """Nulls in all columns, repeats, genuine replacement characters and columns that have results' names."""
    same = "The same long passage stands here, é and again \ufffd. " * 8
    rows = [(1, None, None, None, None, "k", "n", None), (2, "", "en", "s", 0, None, None, "i"), (3, "A \ufffd genuine sign. " + same, "en", "s", 9, "k", "n", "i"),
            (4, "Other words come first, " + same + " then an end.", "en", "s", 9, "k", "n", "i"), (None, "calm words of no id, " * 5, "en", "s", 9, "k", "n", "i")]
    spark.createDataFrame(rows + rows[3:4], "doc_id long, text string, lang string, source string, n_chars int, kept string, n_words string, items string").coalesce(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for name, step in P.STAGES[1:4]:
        docs = stage(step(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_words", "items"] and dict(docs.dtypes)["kept"] == "string", name
        assert {r.kept for r in docs.collect()} <= {"k", None} and {r.n_words for r in docs.collect()} <= {"n", None}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got[3].startswith("A \ufffd genuine sign") and got[1] is None and None in got
    assert P.STAGES[4][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("number", range(5))
def test_empty_documents(spark, tmp_path, number):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/d")
    assert P.STAGES[number][1](spark, spark.read.parquet(f"{tmp_path}/d"), SF).count() == 0
