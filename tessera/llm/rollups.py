"""Delta-maintained token counts by source, language and tokenizer version.

A store is a log of committed batches.  Each batch holds its entries (what each changed document counts for from then on, or that it is
gone) and signed additive totals.  A batch of inserts, deletes and revised counts is joined with the latest earlier entries
of the documents it names, so that a delete takes off just what was added and a revision adds the difference; totals are
sums over committed batches only.  A batch writes as much as it changes; nothing else is written again.

A batch is written under a name of its own and takes effect by the exclusive creation of the marker with the next number,
which names it.  Of two writers that saw the same log one creates the marker and the other fails with nothing changed; the
same batch again is a no-op; a batch that fails before its marker leaves nothing that counts.  A marker that stays empty (its
writer died while it wrote a few bytes) stops later batches until ``recover`` takes it away.

Defined results: of several changes to one document and version in a batch the one with the highest sequence number
holds (ties: the larger count, then the greater op); deleting what is not there, a null id, and an op other than insert, delete and revise change
nothing; an insert of a known document is a revision, a revision of an unknown one an insert; a null count is 0; null source, lang or version is a
group of its own; an empty batch commits with empty totals; groups that fall to zero documents are not reported; other columns of the changes are not used.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import shared_dir, stage

_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long"
_ENTRY = f"{_LEDGER}, gone boolean, number long"
_DELTA = "source string, lang string, version string, docs long, tokens long"
_encodings: dict[str, object] = {}


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens long; null text: 0 tokens."""
    keep = [c for c in df.columns if c not in (text, "n_tokens")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            n = np.fromiter((len(encode(x.as_py() or "")) for x in b.column(len(keep))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n)], [*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


class Rollups:
    """A store under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> list[dict]:
        d = self._at(f"{self.path}/commits")
        if not self._fs.exists(d):
            return []
        out = []
        for name in sorted(x.getPath().getName() for x in self._fs.listStatus(d)):
            if name[:1] == ".":
                continue
            stream = self._fs.open(self._at(f"{self.path}/commits/{name}"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if not text:
                raise RuntimeError(f"marker {name} is empty: another writer commits now, or died; see recover()")
            out.append(json.loads(text))
        return out

    def recover(self) -> None:
        """Takes an empty last marker away; only for when its writer is known to be dead."""
        d = self._at(f"{self.path}/commits")
        for x in self._fs.listStatus(d) if self._fs.exists(d) else ():
            if not x.getLen() and x.getPath().getName()[:1] != ".":
                self._fs.delete(x.getPath(), False)

    def _mark(self, number: int, batch: str, folder: str) -> None:
        jvm = self.spark.sparkContext._jvm
        try:
            out = self._fs.create(self._at(f"{self.path}/commits/{number:09d}"), False)  # fails where the number is taken
        except Exception as e:
            if self._fs.exists(self._at(f"{self.path}/commits/{number:09d}")):
                raise RuntimeError(f"batch {batch}: another writer committed at the same time") from e
            raise
        try:
            jvm.org.apache.commons.io.IOUtils.write(json.dumps({"batch": batch, "folder": folder}), out, "UTF-8")
        finally:
            out.close()

    def commits(self) -> list[str]:
        """Names of committed batches, in order of commit."""
        return [m["batch"] for m in self._markers()]

    def _entries(self, markers: list[dict]) -> DataFrame:
        if not markers:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(*[f"{self.path}/batches/{m['folder']}/entries" for m in markers])

    @staticmethod
    def _latest(entries: DataFrame) -> DataFrame:
        last = F.max(F.struct("number", "gone", "source", "lang", "n_tokens")).alias("e")
        return entries.groupBy("doc_id", "version").agg(last).where("not e.gone").select("doc_id", "version", "e.source", "e.lang", "e.n_tokens")

    def ledger(self) -> DataFrame:
        """What each document counts for now."""
        return self._latest(self._entries(self._markers()))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit changes (seq long, op 'insert', 'delete' or 'revise', doc_id, version, source, lang, n_tokens); False if
        the batch was committed before.  Raises RuntimeError if another writer commits meanwhile: apply it again then."""
        done = self._markers()
        if any(m["batch"] == batch for m in done):
            return False
        number = len(done)
        one = (changes.where("doc_id is not null and op in ('insert', 'delete', 'revise')")
               .select(F.col("doc_id").cast("long").alias("i"), F.col("version").alias("v"), F.struct(
                   "seq", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), "op", "source", "lang").alias("c"))
               .groupBy("i", "v").agg(F.max("c").alias("c")))
        one = stage(one)  # read twice below
        same = lambda d: (d["doc_id"] == one["i"]) & d["version"].eqNullSafe(one["v"])
        past = self._entries(done)
        old = self._latest(past.join(one, same(past), "left_semi")).select("doc_id", "version", F.struct("source", "lang", "n_tokens").alias("o"))
        gone = F.col("c.op") == "delete"
        new = F.when(~gone, F.struct("c.source", "c.lang", "c.n_tokens"))
        both = one.join(old, same(old), "left").where(F.col("o").isNotNull() | ~gone).select("i", "v", "o", new.alias("n"), gone.alias("gone"))
        folder = f"{number:09d}-{uuid.uuid4().hex}"
        base = f"{self.path}/batches/{folder}"
        both.write.parquet(f"{base}/joined")
        both = self.spark.read.schema(both.schema).parquet(f"{base}/joined")
        both.select(F.col("i").alias("doc_id"), F.col("v").alias("version"), "n.source", "n.lang", "n.n_tokens", "gone", F.lit(number).cast("long").alias("number")).write.parquet(f"{base}/entries")
        signed = both.select("v", F.explode(F.array(
            F.struct(F.col("o").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("n").alias("x"), F.lit(1).alias("sign")))).alias("y")).where("y.x is not null")
        (signed.groupBy("y.x.source", "y.x.lang", "v").agg(F.sum("y.sign").alias("docs"), F.sum(F.col("y.x.n_tokens") * F.col("y.sign")).alias("tokens"))
         .select("source", "lang", F.col("v").alias("version"), "docs", "tokens").write.parquet(f"{base}/delta"))
        self._fs.delete(self._at(f"{base}/joined"), True)
        self._fs.mkdirs(self._at(f"{self.path}/commits"))
        self._mark(number, batch, folder)
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs long, tokens long of all committed batches."""
        done = self._markers()
        if not done:
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/batches/{m['folder']}/delta" for m in done])
        return deltas.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents inserted (twice, to no further effect), then exact copies deleted and the counts of
    the documents that have copies revised by the begin token they get as representatives."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Rollups(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")
    counted = count_tokens(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    version = F.lit("byte_bpe_50k").alias("version")
    store.apply("insert", counted.select(F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), "doc_id", version, "source", "lang", "n_tokens"))
    named = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = named.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # At most 1,000 texts have more than a thousandth of all rows each; their rows meet them by broadcast, so no task gets a hot text.
    named = stage(named)
    first = stage(first)
    hot = F.broadcast(first.where(F.col("n") * 1000 > named.count()))
    both = named.join(hot, "h").unionByName(named.join(hot.select("h"), "h", "left_anti").join(first, "h"))
    held = both.select("doc_id", F.when(F.col("doc_id") == F.col("first"), "revise").otherwise("delete").alias("op"))
    known = store.ledger().join(held, "doc_id")
    changes = known.select(F.lit(1).cast("long").alias("seq"), "op", "doc_id", "version", "source", "lang", (F.col("n_tokens") + 1).alias("n_tokens"))
    store.apply("copies", changes)
    store.apply("copies", changes)
    return store.totals()
