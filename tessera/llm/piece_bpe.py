"""SentencePiece BPE without its encoder: a prefix table of last tokens, read backwards.

For BPE the last token of every prefix of a text is unique: it is the one vocabulary entry that ends
there and is compatible with the last token of the prefix before it.  Two tokens are compatible if
encoding their joined text gives just these two.  An Aho-Corasick automaton lists the entries that
end at each character; following the table from the end gives the ids.  The library only reads
the vocabulary file.

Entries never hold a word mark after another character, so a text falls apart before each run of marks, and each
distinct part of up to ``LONGEST`` characters is encoded once and remembered (at most ``REMEMBERED``; this only saves time).  If a
vocabulary does hold such entries, whole texts are encoded.

Defined results: null or empty text: only the begin and end ids; characters outside the vocabulary:
their UTF-8 byte tokens; repeated rows: each gets its own row; an empty table: an empty table; any
other column is passed on, and a column that has the name of a result is replaced.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import HELD, tidy

MARK = "▁"
#: Parts of texts that a worker remembers, the longest of them (characters), and pairs of tokens: about 100 MB in all.
REMEMBERED, LONGEST = 200_000, 48
PAIRS = 400_000
#: Texts whose normal form shows whether a vocabulary is read as here: spaces become marks, one mark comes first, all else stays.
PROBES = ("", "a", " a  b ", "\ta\n", "Å ﬁ ① Ａ é", "▁a", "A")


class PrefixTable:
    """Encoder and decoder of one SentencePiece BPE vocabulary file."""

    def __init__(self, model_path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for text in PROBES:
            if sp.normalize(text) != (MARK + text.replace(" ", MARK) if text else ""):
                raise ValueError(f"{model_path}: its normaliser changes {text!r}; only vocabularies with a first mark and no other normal form are read")
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_id: dict[int, int] = {}
        self.id_byte: dict[int, int] = {}
        self.piece: list[str] = [sp.id_to_piece(i) for i in range(n)]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.score: dict[str, float] = {}
        self.automaton = ahocorasick.Automaton()
        whole = False
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.id_byte[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p] = sp.get_score(i)
                self.automaton.add_word(p, (i, len(p)))
                whole |= bool(re.search(f"[^{MARK}]{MARK}", p))
        self.automaton.make_automaton()
        self.parts = re.compile(".+" if whole else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL).findall
        self.pair: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.size = [len(p) for p in self.piece]
        self.plain = [p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p in self.piece]
        self.special = {*self.id_byte, *self.silent, self.unknown}
        self.number = {p: i for i, p in enumerate(self.piece) if p in self.score}
        self.rank = [-self.score.get(p, 0.0) for p in self.piece]
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.odd: set[int] = set()
        self.encoded = _Memory(self._remember)

    def _merge(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored neighbours, the leftmost of equals, until none can be."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                v = self.score.get(s[k] + s[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _split(self, t: int) -> tuple[int, int] | None:
        """The two tokens that are joined last when ``t`` is built; None for a character.  A token is
        listed in ``odd`` if its parts do not come by score before it, or scores may tie."""
        if t in self.splits:
            return self.splits[t]
        s = list(self.piece[t])
        got = None
        while len(s) > 1:
            v, k = max(((self.score.get(s[k] + s[k + 1], -1e300), -k) for k in range(len(s) - 1)))
            if v == -1e300:
                break
            got = (s[-k], s[-k + 1])
            s[-k : -k + 2] = ["".join(got)]
        if len(s) > 1 or MARK * 2 in self.piece[t]:
            self.odd.add(t)
            got = None
        pair = None
        if got:
            pair = (self.number.get(got[0], -1), self.number.get(got[1], -1))
            for x in pair:
                if x < 0 or len(self.piece[x]) > 1 and (self._split(x) is None or x in self.odd or self.rank[x] >= self.rank[t]):
                    self.odd.add(t)
        self.splits[t] = pair
        return pair

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of the two.  Their last merges are undone, the later
        one first; at each state the two neighbours at the border must not merge before the next undone merge
        (of equal merges the leftmost comes first)."""
        if len(self.pair) >= PAIRS:
            self.pair.clear()
        self._split(a), self._split(b)
        if a in self.odd or b in self.odd:
            ok = self._merge(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        else:
            ok, x, y, limit, right = True, a, b, 1e300, False
            while True:
                joined = self.number.get(self.piece[x] + self.piece[y])
                if joined is not None and (self.rank[joined] < limit or right and self.rank[joined] == limit):
                    ok = False
                    break
                one, two = self._split(x), self._split(y)
                if one is None and two is None:
                    break
                if two is None or one is not None and self.rank[x] > self.rank[y]:
                    limit, right, x = self.rank[x], False, one[1]
                else:
                    limit, right, y = self.rank[y], True, two[0]
        self.pair[a << 32 | b] = ok
        return ok

    def _stands(self, t: int) -> bool:
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = self._merge(self.piece[t]) == [self.piece[t]]
        return ok

    def part_ids(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        last: list[int] = [-1] * (len(text) + 1)
        pair = self.pair
        for at, (t, n) in self.automaton.iter(text):
            at += 1
            if last[at] >= 0:  # the last token is unique
                continue
            p = last[at - n] if at > n else -1
            if p < 0:  # the start, or a character outside the vocabulary
                ok = self._stands(t)
            else:
                ok = pair.get(p << 32 | t)
                if ok is None:
                    ok = self._compatible(p, t)
            if ok:
                last[at] = t
        out: list[int] = []
        i, size = len(text), self.size
        while i:
            t = last[i]
            if t < 0:
                raw = text[i - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_id.get(x, self.unknown) for x in reversed(raw)] if self.byte_id else [self.unknown]
                i -= 1
            else:
                out.append(t)
                i -= size[t]
        out.reverse()
        return out

    def _remember(self, part: str) -> tuple[bytes, bytes]:
        ids = self.part_ids(part)
        plain = self.plain
        back = b"".join([plain[i] for i in ids]) if not self.special.intersection(ids) else self._surface(ids)
        got = np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes(), back
        if len(part) <= LONGEST:
            if len(self.encoded) >= REMEMBERED:
                self.encoded.clear()
            self.encoded[part] = got
        return got

    def _surface(self, ids: list[int]) -> bytes:
        """UTF-8 of ids, with spaces for marks; runs of byte tokens that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                    except UnicodeDecodeError:
                        continue
                    del raw[:n]
                    break
                else:
                    out.append("�")
                    del raw[:1]
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.piece[i].replace(MARK, " "))
        return "".join(out).encode("utf-8", "surrogatepass")

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids with begin and end as little-endian 32-bit integers, UTF-8 of the decoded text)."""
        edge = np.array([self.begin, self.end], "<u4").tobytes()
        if not text:
            return edge, b""
        rows = [*map(self.encoded.__getitem__, self.parts(MARK + text.replace(" ", MARK)))]
        back = b"".join([x[1] for x in rows])
        return b"".join([edge[:4], *[x[0] for x in rows], edge[4:]]), back[1:] if back[:1] == b" " else back

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control tokens are silent and the first mark is dropped."""
        text = self._surface([int(i) for i in ids]).decode("utf-8", "surrogatepass")
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.piece[first].startswith(MARK) else text


class _Memory(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        return self.make(key)


_tables: dict[str, PrefixTable] = {}
HELD["pieces"] = _tables.clear


def table(model_path: str) -> PrefixTable:
    if model_path not in _tables:
        _tables[model_path] = PrefixTable(model_path)
    return _tables[model_path]


def encode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all other columns than the text) with n_tokens long, packed binary (ids,
    little-endian 32 bits) and decoded string.  One scan, no shuffle."""
    made = ("n_tokens", "packed", "decoded")
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, *made)]
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [t.encode(x or "") for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(j) for j in range(len(keep))]
                    + [pa.array([len(x) // 4 for x, _ in rows], pa.int64()), pa.array([x for x, _ in rows], pa.binary()), pa.array([y.decode("utf-8", "replace") for _, y in rows], pa.string())],
                    schema.names)

    return df.select(*keep, text).mapInArrow(tidy(run, "pieces"), schema)


def decode(df: DataFrame, model_path: str, packed: str = "packed") -> DataFrame:
    """``df`` with text string, decoded from packed ids; a null stays null."""

    @F.pandas_udf("string")
    def back(s):
        t = table(model_path)
        return s.map(lambda x: None if x is None else t.decode(np.frombuffer(x, "<u4").tolist()))

    return df.withColumn("text", back(F.col(packed)))


def ids(packed: str = "packed"):
    """The ids of packed bytes as an array column, made by Spark's own functions."""
    h = F.hex(F.col(packed))
    return F.transform(
        F.sequence(F.lit(0), (F.octet_length(F.col(packed)) / 4 - 1).cast("int")),
        lambda i: F.conv(F.concat(*[h.substr(i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("int"))


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
