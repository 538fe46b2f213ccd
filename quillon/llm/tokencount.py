"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries failure links and, for each node, the number of
pieces popped on failing (both computed once), so the greedy longest-match length of
a word takes one pass over its bytes and no piece is ever built. Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a word that cannot be matched counts as one
unknown piece. Equal words of a run of texts are matched once.

Null and empty texts have no words; rows are independent, so repeated rows, ties and
null ids need no rule; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as k

#: Longer words are matched one by one, not side by side with the others.
LONG = 96
PIECE = 8 << 20


class Automaton:
    """``starts`` are pieces that may begin a word, ``inner`` those that may follow
    (the same set by default); both as bytes."""

    def __init__(self, starts: Iterable[bytes], inner: Iterable[bytes] | None = None):
        edges: dict[int, int] = {}
        parent, symbol, final = [-1, -1], [-1, -1], [False, False]
        self.root, self.next_root = 0, 0 if inner is None else 1
        for root, pieces in ((0, starts), (1, inner or ())):
            for piece in pieces:
                node = root
                for b in piece:
                    key = node << 8 | b
                    if (child := edges.get(key)) is None:
                        child = edges[key] = len(parent)
                        parent.append(node)
                        symbol.append(b)
                        final.append(False)
                    node = child
                final[node] = final[node] or node > 1
        depth = [0, 0]
        for v in range(2, len(parent)):
            depth.append(depth[parent[v]] + 1)
        link, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(2, len(parent)), key=depth.__getitem__):
            if final[v]:
                link[v], popped[v] = self.next_root, 1
                continue
            z, count = link[parent[v]], popped[parent[v]]
            while z >= 0 and (z << 8 | symbol[v]) not in edges:
                count += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z << 8 | symbol[v]], count
        self.edges = edges
        self.keys = np.array(sorted(edges), np.int64)
        self.children = np.array([edges[x] for x in self.keys.tolist()], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    def __getstate__(self):
        return self.__dict__ | {"edges": None}

    def __setstate__(self, state):
        self.__dict__ = state
        self.edges = dict(zip(self.keys.tolist(), self.children.tolist(), strict=True))

    def count(self, word: bytes) -> int:
        """Pieces of one word; -1 if it cannot be matched."""
        node, n, edges, link, popped = self.root, 0, self.edges, self.link, self.popped
        for b in word:
            while (child := edges.get(node << 8 | b)) is None:
                z = int(link[node])
                if z < 0:
                    return -1
                n += int(popped[node])
                node = z
            node = child
        while node not in (self.root, self.next_root):
            if link[node] < 0:
                return -1
            n += int(popped[node])
            node = int(link[node])
        return n

    def _child(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = nodes << 8 | symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``count`` of each byte range, all ranges side by side."""
        length = ends - starts
        out, node = np.zeros(len(starts), np.int64), np.full(len(starts), self.root)
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = self.count(data[starts[i] : ends[i]].tobytes())
        short = np.flatnonzero((length > 0) & (length <= LONG)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            out[length > 0] = -1
        order = short[np.argsort(-length[short], kind="stable")]
        ascending = -length[order]
        for p in range(int(length[order[0]]) if len(order) else 0):
            live = order[: np.searchsorted(ascending, -p, "left")]
            live = live[out[live] >= 0]
            sym = data[starts[live] + p].astype(np.int64)
            while len(live):
                child = self._child(node[live], sym)
                good = child >= 0
                node[live[good]] = child[good]
                live, sym = live[~good], sym[~good]
                z = self.link[node[live]]
                dead = z < 0
                out[live[dead]] = -1
                live, sym, z = live[~dead], sym[~dead], z[~dead]
                out[live] += self.popped[node[live]]
                node[live] = z
        live = order[out[order] >= 0]
        while len(live := live[(node[live] != self.root) & (node[live] != self.next_root)]):
            z = self.link[node[live]]
            out[live[z < 0]] = -1
            live, z = live[z >= 0], z[z >= 0]
            out[live] += self.popped[node[live]]
            node[live] = z
        return out


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(path: str) -> set[bytes]:
    """Pieces of a byte-level vocabulary file as bytes, word ends taken off."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    alphabet, end = byte_alphabet(), model.get("end_of_word_suffix") or ""
    out = set()
    for token in model["vocab"]:
        token = token.removesuffix(end) if end else token
        if token and all(c in alphabet for c in token):
            out.add(bytes(alphabet[c] for c in token))
    return out


def _rows(automaton: Automaton, column: pa.Array) -> list[np.ndarray]:
    data, offsets = k.buffers(column)
    parts = []
    for _, _, d, o in k.pieces(data, offsets, PIECE):
        d = k.lower(d)
        words, n = k.Words(d, o), len(o) - 1
        _, first, back = np.unique(k.Prefix(d)(words.starts, words.ends), return_index=True, return_inverse=True)
        each = automaton.counts(d, words.starts[first], words.ends[first])[back]
        owner = np.repeat(np.arange(n), words.counts)
        unknown = np.bincount(owner[each < 0], minlength=n)
        total = np.bincount(owner, np.maximum(each, 0), minlength=n) + unknown
        parts.append(np.stack([words.counts, total.astype(np.int64), unknown, np.diff(o)]).astype(np.int64))
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, np.int64)] * 4


def token_counts(docs: DataFrame, automaton: Automaton, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, n_words, n_pieces, n_unknown and n_bytes of each text. The automaton is as
    large as its vocabulary, whatever the table, and goes out once to each executor."""
    rows = docs.select(id_column, text)
    schema = rows.select(id_column).schema
    for c in ("n_words", "n_pieces", "n_unknown", "n_bytes"):
        schema = schema.add(c, "long")
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, _rows(sent.value, b.column(1)))], names=schema.names)

    return rows.mapInArrow(run, schema)
