"""Packing by lexical retrieval.

Documents that use the same rare words go into the same training sequences. Terms are token ids,
so their document frequencies, counted over all documents, are a table of the vocabulary's size.
Each document is led by its three terms of largest BM25 weight; documents are sorted by them in
ranges, which puts related ones near each other, and consecutive runs of about ``SHARD`` tokens
are the shards of the inverted index. In a shard, the first unused document is a seed: the index
returns its unused neighbours by BM25 (over the seed's ``QUERY`` terms of largest weight), which fill
the seed's window greedily, best first; those that fit go in whole, and the best of the others is cut at the window's
end and its rest is the next seed. Where no neighbour is left, the next document of the shard goes in.

A window that a shard leaves open is filled from the next one of the same range. What a range leaves open
at its end is cut into sequences whose lengths are powers of two, so no sequence is padded. A document longer than a
window fills windows of its own first. A document's tokens move twice: to the table of encoded
texts and to its range; a task holds one shard, or one document if it is longer.

Null and empty texts are documents of one token, the end id. Equal documents are told apart by
their place in the table of encoded texts, so copies, however many, spread over ranges; repeated
rows and null ids are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as k
from .bytebpe import encoder
from .shared import saved, sized_parts

WINDOW = 2048
K1, B = 1.2, 0.75
#: Terms of a seed by which its neighbours are sought.
QUERY = 24
#: Tokens of a shard; a document counts for so many more.
SHARD, EACH = 1 << 20, 16
#: Tokens of a range.
RANGE = 16 << 20
#: Neighbours that are put in order at first.
FIRST = 256
LEADS = 3
#: Bytes of pieces in one batch.
OUT = 4 << 20


def kind_of(definition: str, end_id: int) -> np.dtype:
    """Type that holds all ids."""
    parts = json.loads(definition)
    top = max([end_id, *parts["model"]["vocab"].values(), *(t["id"] for t in parts["added_tokens"])])
    return np.dtype("<u2" if top < 1 << 16 else "<u4")


def encoded(docs: DataFrame, definition: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, of ``kind_of``) of every document, the end id last."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(definition), kind_of(definition, end_id)

    def run(batches):
        coder, last = encoder(sent.value), np.array([end_id], kind)
        for b in batches:
            _, offsets = k.buffers(b.column(1))
            for lo, hi, _, _ in k.pieces(np.zeros(0, np.uint8), offsets, OUT):
                some = b.slice(lo, hi - lo)
                ids = [np.concatenate((x.astype(kind), last)) for x in coder.many(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def terms_of(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) by document, then term."""
    wide = 8 * ids.dtype.itemsize
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = owner << np.uint64(wide) | ids.astype(np.uint64)
    key = np.sort(key.astype(np.uint32)) if wide == 16 and len(offsets) <= 1 << 16 else np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    key = key[first]
    return (key >> key.dtype.type(wide)).astype(np.int64), (key & key.dtype.type((1 << wide) - 1)).astype(ids.dtype), np.diff(np.append(first, len(ids)))


def _batches(batches, kind: np.dtype, column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``limit`` bytes of ids, with these and their offsets in ids."""
    for b in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        for lo, hi, _, o in k.pieces(np.zeros(0, np.uint8), offsets, limit):
            some = b.slice(lo, hi - lo)
            yield some, np.frombuffer(b"".join(some.column(column).to_pylist()), kind), o // kind.itemsize


def frequencies(rows: DataFrame, kind: np.dtype) -> np.ndarray:
    """Documents that have each term, by term. At most the vocabulary's ids come to the driver."""
    top = 1 << 16

    def run(batches):
        found = np.zeros(top, np.int64)
        for _, ids, offsets in _batches(batches, kind, 0, OUT):
            _, term, _ = terms_of(ids, offsets)
            some = np.bincount(term)
            if len(some) > len(found):
                found = np.concatenate((found, np.zeros(len(some) - len(found), np.int64)))
            found[: len(some)] += some
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(found[term])], names=["term", "df"])

    table = rows.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = table["term"].to_numpy(), table["df"].to_numpy()
    out = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int64)
    out[term] = df
    return out


class Weights:
    """BM25 weights of terms in documents, by the counts of a whole corpus."""

    def __init__(self, df: np.ndarray, docs: int, tokens: int):
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(tokens / max(docs, 1), 1.0)

    def __call__(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of terms that occur ``count`` times in documents of ``length`` tokens."""
        return self.idf[term] * (count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


def leads(ids: np.ndarray, offsets: np.ndarray, weights: Weights) -> np.ndarray:
    """Of each document the ``LEADS`` terms of largest weight (ties: the smallest), -1 where it has fewer."""
    doc, term, count = terms_of(ids, offsets)
    w = weights(term, count, np.diff(offsets)[doc])
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    out = np.full((LEADS, len(offsets) - 1), -1, np.int32)
    for lead in out:
        best = np.maximum.reduceat(w, first)
        at = np.flatnonzero(w == best[doc])
        at = at[np.searchsorted(at, first)]
        lead[:] = np.where(best >= 0, term[at].astype(np.int32), -1)
        w[at] = -1
    return out


class Index:
    """An inverted index of some documents."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, weights: Weights):
        doc, self.term, count = terms_of(ids, offsets)
        self.weight = weights(self.term, count, np.diff(offsets)[doc])
        self.first = np.searchsorted(doc, np.arange(len(offsets)))
        order = np.argsort(self.term, kind="stable")
        self.docs, self.weights = doc[order], self.weight[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.term, minlength=len(weights.idf)))))

    def query(self, doc: int) -> np.ndarray:
        """The terms by which a document's neighbours are sought."""
        mine = slice(self.first[doc], self.first[doc + 1])
        term, w = self.term[mine], self.weight[mine]
        return term[np.argpartition(-w, QUERY)[:QUERY]] if len(term) > QUERY else term

    def scores(self, query: np.ndarray, n: int) -> np.ndarray:
        """BM25 of ``n`` documents for the terms of a query."""
        ranges = [slice(a, b) for a, b in zip(self.start[query].tolist(), self.start[query.astype(np.int64) + 1].tolist(), strict=True)]
        if not ranges:
            return np.zeros(n)
        return np.bincount(np.concatenate([self.docs[r] for r in ranges]), np.concatenate([self.weights[r] for r in ranges]), n)

    def neighbours(self, query: np.ndarray, used: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score (ties: the first); those that share no term are none."""
        scores = self.scores(query, len(used))
        found = np.flatnonzero((scores > 0) & ~used)
        if len(found) > FIRST:
            least = np.partition(scores[found], -FIRST)[-FIRST]
            best = found[scores[found] >= least]
            yield from best[np.argsort(-scores[best], kind="stable")].tolist()
            found = found[scores[found] < least]
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()


#: A sequence: (number of the document, first token, tokens) of each piece.
Sequence = list[tuple[int, int, int]]


class Packer:
    """Packs documents as they come, shard by shard, into full windows; one window stays open
    between shards. Documents are numbered from 0."""

    def __init__(self, weights: Weights, window: int = WINDOW):
        self.weights, self.window = weights, window
        self.open: Sequence = []
        self.query = np.zeros(0, np.int64)
        self.room, self.base = window, 0

    def _put(self, doc: int, start: int, length: int) -> bool:
        """Whether the window is full now."""
        self.open.append((self.base + doc, start, length))
        self.room -= length
        return not self.room

    def _close(self) -> Sequence:
        done, self.open, self.room = self.open, [], self.window
        return done

    def shard(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[Sequence]:
        """Full windows of the documents of a shard and of what was open before it."""
        index, sizes, n = Index(ids, offsets, self.weights), np.diff(offsets).tolist(), len(offsets) - 1
        used, at, cut = np.zeros(n, bool), 0, None
        while True:
            if not self.open:
                # a document that was cut goes on; else the first that is unused
                seed, start = cut or (-1, 0)
                if cut is None:
                    while at < n and used[at]:
                        at += 1
                    if at == n:
                        break
                    seed, used[at] = at, True
                cut = None
                while sizes[seed] - start >= self.window:
                    self._put(seed, start, self.window)
                    start += self.window
                    yield self._close()
                if start == sizes[seed]:
                    continue
                self.query = index.query(seed)
                self._put(seed, start, sizes[seed] - start)
            full, best = False, None
            for d in index.neighbours(self.query, used):
                if sizes[d] <= self.room:
                    used[d] = True
                    if full := self._put(d, 0, sizes[d]):
                        break
                elif best is None:
                    best = d
            while not full:
                if best is None:
                    while at < n and used[at]:
                        at += 1
                    if at == n:
                        break
                    best = at
                used[best] = True
                start = min(self.room, sizes[best])
                full = self._put(best, 0, start)
                if start < sizes[best]:
                    cut = best, start
                best = None
            if not full:
                break
            yield self._close()
        self.base += n

    def rest(self) -> Iterator[Sequence]:
        """What is open, in sequences whose lengths are powers of two."""
        left, pieces = sum(p[2] for p in self.open), self.open[::-1]
        self._close()
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            out: Sequence = []
            while size:
                doc, start, length = pieces.pop()
                take = min(size, length)
                out.append((doc, start, take))
                size -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            yield out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_encoded(rows: DataFrame, kind: np.dtype, window: int = WINDOW) -> DataFrame:
    """Pieces of ``rows`` (doc_id, n_tokens, ids; a written table): ``PIECES``, ids as little-endian 32-bit integers."""
    docs, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    weights = rows.sparkSession.sparkContext.broadcast(Weights(frequencies(rows, kind), docs, tokens))
    keys = [f"lead{i}" for i in range(LEADS)]

    def lead(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b, ids, offsets in _batches(batches, kind, 1, OUT):
            n = b.num_rows
            # equal texts stay together, equal rows can still be told apart
            crc = pa.array([zlib.crc32(ids[x:y]) for x, y in zip(offsets, offsets[1:], strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, leads(ids, offsets, weights.value)), crc, pa.array((part << 40) + row + np.arange(n))], names=["doc_id", "ids", *keys, "crc", "row"])
            row += n

    def pack(batches):
        part, number = TaskContext.get().partitionId() << 40, 0
        packer = Packer(weights.value, window)
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        out, size = [], 0

        def emit():
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        def write(sequences):
            nonlocal out, size, number
            for sequence in sequences:
                offset = 0
                for doc, start, length in sequence:
                    doc_id, ids = held[doc]
                    out.append((doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), part + number, offset))
                    offset += length
                size, number = size + 4 * offset, number + 1
                if size >= OUT:
                    yield emit()
                    out, size = [], 0

        def shard(some):
            base = packer.base
            ids = np.concatenate([x for _, x in some])
            offsets = np.concatenate(([0], np.cumsum([len(x) for _, x in some])))
            held.update({base + i: x for i, x in enumerate(some)})
            yield from write(packer.shard(ids, offsets))
            keep = {p[0] for p in packer.open}
            for d in [d for d in held if d not in keep]:
                del held[d]

        some, tokens = [], 0
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some.append((doc_id, np.frombuffer(raw, kind)))
                tokens += len(some[-1][1]) + EACH
                if tokens >= SHARD:
                    yield from shard(some)
                    some, tokens = [], 0
        if some:
            yield from shard(some)
        yield from write(packer.rest())
        if out:
            yield emit()

    led = rows.select("doc_id", "ids").mapInArrow(lead, "doc_id long, ids binary, " + ", ".join(f"{c} int" for c in keys) + ", crc long, row long")
    order = [*keys, "crc", "doc_id", "row"]
    ranges = led.repartitionByRange(sized_parts(tokens, RANGE), *order).sortWithinPartitions(*order)
    return ranges.select("doc_id", "ids").mapInArrow(pack, PIECES)


def pack_by_retrieval(docs: DataFrame, definition: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents of ``docs`` (doc_id, text) in sequences of at most ``window`` tokens, a power of two."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    return pack_encoded(saved(encoded(docs, definition, end_id), "encoded"), kind_of(definition, end_id), window)


def digest(pieces: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
