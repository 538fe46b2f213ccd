"""Token ids in a binary format of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level j holds, packed, chunk j of
every id that has one, a bitmap that tells which of these go on, and a rank directory
(set bits before each block of 512 bits). Token i is read by following ranks from
level to level: no block is decoded.

A table of texts becomes segments of at most about ``SEGMENT`` ids, in ascending id
order; a text's ids never cross segments, and a text longer than that is a segment of
its own. Segments are rows of Parquet files (one binary column holds the format), so
any store that Spark writes will do and lost tasks are repeated by Spark's committer.

Null texts are empty; each text ends with the end id. Null ids come first; rows of
equal ids stand together, by their text inside a range; repeated rows are all written. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as k
from .tokencount import byte_alphabet

SEGMENT = 1 << 19
BLOCK = 512
MAGIC = b"QDAC1\0"


def encode(ids: np.ndarray) -> bytes:
    """The format: magic, number of ids, levels, then for each level its length, chunks,
    bitmap and rank directory."""
    rest = ids.astype(np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits, ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels))]
    for n, *parts in levels:
        out += [struct.pack("<Q", n), *parts]
    return b"".join(out)


class Reader:
    """Random access to a coded sequence; views of ``blob``, nothing is decoded ahead."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a sequence of directly addressable codes")
        self.n, count = struct.unpack_from("<QB", blob, len(MAGIC))
        at, self.levels = len(MAGIC) + 9, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", blob, at)
            chunks = np.frombuffer(blob, np.uint8, n, at + 8)
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(blob, "<u4", -(-n // BLOCK) + 1, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * j
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1: on each level one rank for the start, then a run."""
        out, where = np.zeros(hi - lo, np.uint32), np.arange(hi - lo)
        for j, (chunks, bits, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * j)
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].astype(bool)
            block = lo // BLOCK
            lead = np.unpackbits(bits[block * BLOCK // 8 : (lo + 7) >> 3], bitorder="little")[: lo - block * BLOCK]
            lo = int(ranks[block]) + int(lead.sum())
            hi = lo + int(more.sum())
            where = where[more]
        return out


class _Runs(dict):
    """Ids of runs; one that is absent is learnt."""

    def __missing__(self, run: bytes) -> bytes:
        self[run] = found = self.learn(run)
        return found


class Encoder:
    """Ids of whole texts with a file of the tokenizers library.

    The vocabulary's normaliser and splitter never look across ASCII white space, so a
    text is encoded as its white-space runs. Each distinct run goes through the library
    once while it stays in a bounded cache: runs of Latin letters by the library's model,
    others by its whole chain. Both short cuts are taken only if probes show that they give
    what the plain call (``direct``) gives; texts with a special token take the plain call."""

    #: Runs kept; as many again are kept from before the last turn-over.
    CACHE = 500_000
    _LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    _PROBES = ("Ab c", "ab", "ÀçÉ", "straße", "Ñandú", "x", "qwertyuiopasdfghjklzxcvbnm")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[bytes, bytes] = {}
        self._fresh()
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        joined = lambda t: [i for w in t.split() for i in self.direct(w).tolist()]
        probes = [*self._PROBES, "it's, l'eau. 3.14! x"]
        self.by_word = all(self.direct(p).tolist() == joined(p) == self.direct(p.lower()).tolist() for p in probes) and not self.direct(" \n").size
        self.by_model = self.by_word and all(self._letters(w) == self.direct(w).tobytes() for p in self._PROBES for w in p.split())
        # a mark at a word's end must not change how the word is cut
        self.by_stem = self.by_word and all(self.direct(w + m).tolist() == self.direct(w).tolist() + self.direct(m).tolist() for p in self._PROBES for w in p.split() for m in (",", ".,", "?!"))

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _model(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a run of Latin letters, as bytes."""
        raw = word.lower().encode()
        return self._model(raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.alphabet))

    def _learn(self, run: bytes) -> bytes:
        if (known := self.old.get(run)) is not None:
            return known
        if self.by_model and run.isalpha() and run.islower():
            return self._model(run.decode())
        word = run.decode()
        if self.by_model and self._LETTERS.fullmatch(word):
            return self._letters(word)
        if self.by_stem:
            stem = word.rstrip(".,;:!?")
            if stem != word and stem and self._LETTERS.fullmatch(stem[-1]):
                return self.cache[stem.encode()] + self.cache[word[len(stem) :].encode()]
        return self.direct(word).tobytes()

    def _fresh(self) -> None:
        self.cache = _Runs()
        self.cache.learn = self._learn

    def texts(self, column: pa.Array) -> list[bytes]:
        """Texts of a column for ``many``. Where the vocabulary drops white space, a blank goes
        before each comma or full stop between an ASCII letter and white space (or the text's
        end): it changes no id, and a word is then one run with and without its mark."""
        data, offsets = k.buffers(column)
        if self.by_stem and len(data):
            after = np.ones(len(data), bool)
            after[:-1] = _SPACE[data[1:]]
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            at = np.flatnonzero(_MARK[data] & after)
            at = at[(at > 0) & _ALPHA[data[at - 1]]]
            at = at[offsets[np.searchsorted(offsets, at, "right") - 1] != at]
            data, offsets = np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)
        raw, ends = data.tobytes(), offsets.tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.cache) > self.CACHE:
            self.old = dict(self.cache)
            self._fresh()
        get, out = self.cache.__getitem__, []
        for raw in texts:
            if not self.by_word or b"<|" in raw and any(s in raw for s in self.special):
                out.append(self.direct(raw.decode()))
                continue
            # lowering A-Z ahead is the same where no character can combine with another
            plain = raw.isascii() or int(np.frombuffer(raw, np.uint8).max()) < 0xCC
            out.append(np.frombuffer(b"".join(map(get, (raw.lower() if plain else raw).split())), np.uint32))
        return out


_SPACE, _MARK, _ALPHA = (np.isin(np.arange(256), list(s)) for s in (b" \t\n\x0b\x0c\r", b",.", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One for each worker process and definition; its cache lives on between tasks."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


_SEGMENTS = "part int, segment int, n_docs long, n_tokens long, doc_ids array<{id}>, lengths array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write the segments to ``path``, parts in ascending id order.
    Only the raw texts are shuffled, once, by ranges of the id."""
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    last = np.array([end_id], np.uint32)
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches):
        coder, part, segment = encoder(sent.value), TaskContext.get().partitionId(), 0
        ids, codes, size = [], [], 0

        def row():
            arrays = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)]), pa.array([size])]
            arrays += [pa.array([ids], pa.list_(id_type)), pa.array([[len(c) for c in codes]], pa.list_(pa.int64())), pa.array([encode(np.concatenate(codes))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "segment", "n_docs", "n_tokens", "doc_ids", "lengths", "payload"])

        for b in batches:
            _, offsets = k.buffers(b.column(1))
            for lo, hi, _, _ in k.pieces(np.zeros(0, np.uint8), offsets):
                some = b.slice(lo, hi - lo)
                for i, c in zip(some.column(0).to_pylist(), coder.many(coder.texts(some.column(1))), strict=True):
                    ids.append(i)
                    codes.append(np.concatenate((c, last)))
                    size += len(codes[-1])
                    if size >= SEGMENT:
                        yield row()
                        segment += 1
                        ids, codes, size = [], [], 0
        if ids:
            yield row()

    ordered.mapInArrow(run, _SEGMENTS.format(id=kind)).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """By text, from the files: id, start (ids before it), n_tokens, ids_crc32. Starts are
    prefix sums over parts and segments, which are few; no ids pass through a shuffle."""
    files = spark.read.parquet(path)
    schema = files.select(F.explode("doc_ids").alias(id_column)).schema
    heads = files.select("part", "segment", "n_tokens")
    inside = heads.select("part", "segment", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")).alias("base"))
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part")
    # one row for each written part: as many as there were tasks
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    bases = inside.join(parts, "part").select("part", "segment", (F.col("base") + F.col("ahead")).alias("base"))
    out = schema.add("part", "integer").add("segment", "integer").add("local", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("doc_ids")[i].values
                n = np.asarray(b.column("lengths")[i].values, np.int64)
                reader = Reader(b.column("payload")[i].as_buffer().to_pybytes())
                ends = np.cumsum(n)
                ids_all = reader.slice(0, len(reader))
                crc = [crc32(ids_all[hi - m : hi]) for hi, m in zip(ends.tolist(), n.tolist(), strict=True)]
                whole = lambda name: pa.array(np.full(len(n), b.column(name)[i].as_py(), np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids, whole("part"), whole("segment"), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=out.names)

    rows = files.select("part", "segment", "doc_ids", "lengths", "payload").mapInArrow(run, out)
    return rows.join(bases, ["part", "segment"]).select(id_column, (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
