"""MinHash near-duplicate join by chosen paths, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles of five words. Documents
whose sets agree in size, sum and a mixed xor (two 64-bit fingerprints) count as equal and
are one class, stood for by its smallest id; all other links are confirmed on full sets.
Representatives get ``K`` minwise tokens. Independent trees branch them recursively: a node
chooses coordinates by its own hash (1 / threshold of them on average) and a document follows
the branch of its token there, so similar documents share leaves. Nodes of at most ``LIMIT``
documents are compared exhaustively by their tokens; in a node that is larger still after
``DEPTH`` levels, or that its branches hardly split, documents outside its largest component
are compared with all. Trees are as many as
a pair at the threshold needs to meet with probability ``RECALL``, at any depth.

What is asked for are components, so pairs already in one component need no test, and a leaf
gives out a forest over its components, never its pairs. A forest of what tokens show as
similar, tree after tree, names the documents whose sets are needed. Its links are confirmed on
full sets; so are, in a second round, links that its false ones have hidden. At last, in each
leaf, all members that still have a similar partner in another component are tested against
each other: their sets meet in the leaf, at most ``HELD`` bytes of them (or two sets) at a time.

Empty and null texts have the empty set and are linked with nothing; documents of fewer than
five words have one shingle. Null ids take no part: their component is null and they are
kept. Rows that repeat an id are one document with the sets of all its rows. Other columns are
ignored. A text is read whole: a task holds a few times its bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as k
from .shared import discard, saved, sent, sized_parts

K = 128
RECALL = 0.995
LIMIT = 512
DEPTH = 10
#: Leaf rows of a task.
TASK_ROWS = 10_000
#: Links that a task contracts.
EDGES = 500_000
#: Bytes of sets that meet in a task at a time.
HELD = 8 << 20
#: Standard deviations below the threshold at which an estimate still counts.
SLACK = 4.0
_U = np.uint64
_COORD = k.mix(np.arange(1, 2 * K + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BRANCH = np.arange(1, 102, dtype=np.uint64) * _U(0x632BE59BD9B4E019)
_XOR, _MUL = (_COORD[:K] >> _U(32)).astype(np.uint32)[:, None], ((_COORD[K:] >> _U(32)).astype(np.uint32) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """``K`` minwise tokens of a set of hashes."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(out, ((x[a : a + 4096] ^ _XOR) * _MUL).min(axis=1), out=out)
    return out


def sets_of(column: pa.Array, width: int = 5):
    """(first text, one past the last, their sets) for runs of texts."""
    data, offsets = k.buffers(column)
    for lo, hi, d, o in k.pieces(data, offsets):
        yield lo, hi, k.shingle_sets(d, o, width)


def profiles(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n, two fingerprints of the set, its tokens."""
    schema = "doc_id long, n long, f1 long, f2 long, tokens binary"

    def run(batches):
        for b in batches:
            n, f1, f2, tokens = [], [], [], []
            for s in (s for _, _, some in sets_of(b.column(1), width) for s in some):
                n.append(len(s))
                f1.append(s.sum(dtype=np.uint64))
                f2.append(np.bitwise_xor.reduce(k.mix(s)) if len(s) else _U(0))
                tokens.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(tokens, pa.binary())], names=["doc_id", "n", "f1", "f2", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    _, _, data = column.buffers()
    return np.frombuffer(data, kind)[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def branches(threshold: float) -> list[float]:
    """Probabilities of a node's branches, 1 / threshold of them on average: whole ones are
    certain, the rest is one more by chance. So similar documents keep one common branch a level."""
    whole = int(1 / threshold)
    return [1.0] * whole + ([1 / threshold - whole] if 1 / threshold > whole else [])


def shared_leaf(threshold: float, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold is in one leaf of a tree after ``depth`` levels."""
    q = 1.0
    for _ in range(depth):
        q = 1 - float(np.prod([1 - p * threshold * q for p in branches(threshold)]))
    return q


def trees_for(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Independent trees after which a pair at the threshold has met with probability ``recall``,
    though all its nodes be split ``depth`` times."""
    miss = 1 - shared_leaf(threshold, depth)
    return 1 if miss <= 0 else max(1, int(np.ceil(np.log(1 - recall) / np.log(miss))))


def _children(node: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the branches that rows at ``node`` follow, chosen by the node's hash."""
    rows, out = [], []
    for j, chance in enumerate(branches(threshold)):
        pick = k.mix(node + _BRANCH[j])
        at = np.arange(len(node)) if chance == 1 else np.flatnonzero((pick >> _U(11)).astype(np.float64) / 2**53 < chance)
        value = tokens[at, (k.mix(pick[at]) % _U(K)).astype(np.int64)].astype(np.uint64)
        rows.append(at)
        out.append(k.mix(pick[at] ^ (value * _U(0x9FB21C651E98DF25) + _U(j))))
    return np.concatenate(rows), np.concatenate(out)


def _branches(reps: DataFrame, threshold: float, trees: int, parents: DataFrame | None = None) -> DataFrame:
    """(rep, tree, node, up, size) of the next level: of all representatives, or of those at
    ``parents`` (rep, tree, node, c); ``up`` is the node above and ``size`` its documents."""
    roots = k.mix(np.arange(1, trees + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
    first = parents is None
    rows = reps.select("rep", "tokens") if first else sent(parents, 32).join(reps.select("rep", "tokens"), "rep").select("rep", "tokens", "tree", "node", "c")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep, tokens = b.column(0).to_numpy(), _matrix(b.column(1), 4 * K, np.uint8).copy().view(np.uint32)
            if first:
                parts = [(np.full(len(rep), t, np.int32), np.full(len(rep), r), np.zeros(len(rep), np.int64)) for t, r in enumerate(roots)]
            else:
                parts = [(b.column(2).to_numpy(), b.column(3).to_numpy().view(np.uint64), b.column(4).to_numpy())]
            for tree, above, size in parts:
                at, node = _children(above, tokens, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(tree[at]), pa.array(node.view(np.int64)), pa.array(above[at].view(np.int64)), pa.array(size[at])], names=["rep", "tree", "node", "up", "size"])

    return rows.mapInArrow(run, "rep long, tree int, node long, up long, size long")


def leaves(reps: DataFrame, threshold: float, trees: int, limit: int = LIMIT, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """(node, tree, c, rep, n, sketch), its rows, and how many of these are in dense nodes: those
    of more than ``limit`` documents (c) after ``depth`` levels, or of which a branch keeps a share
    of at least the threshold. Members of such a node are mostly similar, so with 1 / threshold
    branches a level its rows would only grow."""
    found, now, old, left, dense = [], None, [], 0, 0
    names = ("rep", "tree", "node", "c")
    for level in range(depth):
        kids = saved(_branches(reps, threshold, trees, now), "branches", len(branches(threshold)) * left or None)
        # tables of their own, so that the joins can part a node of many documents
        counts = saved(kids.groupBy("node", "up", "size").agg(F.count("*").alias("c")).where("c > 1"), "counts", kids.count())
        old += [kids, counts]
        if level:
            whole = saved(counts.where(F.col("c") >= threshold * F.col("size")).select("up").distinct(), "whole", counts.count())
            stays = now.join(sent(whole.withColumnRenamed("up", "node"), 16), "node", "left_semi").select(*names)
            found.append(stays)
            dense += stays.count()
            kids = kids.join(sent(whole, 16), "up", "left_anti")
            old.append(whole)
        sized = saved(kids.select("rep", "tree", "node").join(sent(counts.select("node", "c"), 16), "node").select(*names), "nodes", len(branches(threshold)) * left or None)
        old.append(sized)
        now = sized.where(F.col("c") > limit)
        left = now.count()
        if level == depth - 1:
            dense += left
        found.append(sized if level == depth - 1 else sized.where(F.col("c") <= limit))
        if not left:
            break
    rows = reduce(DataFrame.unionByName, found).join(reps.select("rep", "n", "tokens"), "rep")

    def run(batches):
        for b in batches:
            if b.num_rows:
                low = np.ascontiguousarray(_matrix(b.column(5), 4 * K, np.uint8).copy().view(np.uint32).astype(np.uint8))
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(0, (b.num_rows + 1) * K, K, dtype=np.int32)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], packed], names=["node", "tree", "c", "rep", "n", "sketch"])

    out = saved(rows.select("node", "tree", "c", "rep", "n", "tokens").mapInArrow(run, "node long, tree int, c long, rep long, n long, sketch binary"), "leaves", rows.count(), 20_000)
    discard(*old)
    return out, out.count(), dense


def dealt(rows: DataFrame, limit: int, dense: bool, groups: int | None = None) -> DataFrame:
    """Leaf rows with ``comp`` to what is compared: node, block, side, rep, n, sketch, comp. Side
    -1: all of the block with all. A dense node is dealt by its components. Members of the one
    with most documents need no comparison with each other, so all others, in groups of about
    ``limit`` (side 0), meet all members, in blocks of about ``limit`` (side 1). ``groups``
    bounds the groups; the rest are left to a later round, when most have found a component."""
    names = ("node", "block", "side", "rep", "n", "sketch", "comp")
    small = rows.where(F.col("c") <= limit).withColumns({"block": F.lit(0), "side": F.lit(-1)}).select(*names)
    if not dense:
        return small
    many = rows.where(F.col("c") > limit)
    sums = many.groupBy("node", "comp").agg(F.count("*").alias("m")).groupBy("node")
    sums = saved(sums.agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), (F.sum("m") - F.max("m")).alias("s")).where("s > 0"), "tops")
    parts, blocks = F.ceil(F.col("s") / limit).cast("int"), F.ceil(F.col("c") / limit).cast("int")
    many = many.join(sent(sums, 32), "node").withColumns({"parts__": parts, "blocks__": blocks})
    used = F.col("parts__") if groups is None else F.least("parts__", F.lit(groups))
    number = lambda salt, of: F.pmod(F.xxhash64("node", "rep", F.lit(salt)), of).cast("int")
    lead = many.where(F.col("comp") != F.col("top")).withColumn("g__", number(1, F.col("parts__"))).where(F.col("g__") < used)
    lead = lead.withColumns({"b__": F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1)), "side": F.lit(0)})
    rest = many.withColumns({"g__": F.explode(F.sequence(F.lit(0), used - 1)), "b__": number(2, F.col("blocks__")), "side": F.lit(1)})
    both = lead.unionByName(rest, allowMissingColumns=True).withColumn("block", (F.col("g__") * F.col("blocks__") + F.col("b__") + 1).cast("int"))
    return small.unionByName(both.select(*names))


def _similar(n, sketch, comp, side, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of one leaf, by row number, that their tokens show to be similar and that
    are not of one component, and their equal tokens."""
    m, cross = len(n), bool((side >= 0).any())
    out = []
    step = max(1, (1 << 22) // (m * K))
    for a in range(0, m - 1, step):
        i = np.arange(a, min(m, a + step))
        same = (sketch[i][:, None, :] == sketch[None, a:, :]).sum(axis=2, dtype=np.int16)
        ii, jj = np.nonzero(same >= least)
        e, ii, jj = same[ii, jj], ii + a, jj + a
        keep = (jj > ii) & (comp[ii] != comp[jj]) & (np.minimum(n[ii], n[jj]) >= threshold * np.maximum(n[ii], n[jj]) - 1e-9)
        if cross:
            keep &= side[ii] != side[jj]
        out.append((ii[keep], jj[keep], e[keep]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3


def _forest(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of those pairs (i, j), taken in their order, that join two components; at most as
    many as there are components."""
    _, label = np.unique(comp, return_inverse=True)
    root = np.arange(label.max(initial=-1) + 1)
    chosen, left = [], np.arange(len(i))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    while len(left):
        for p in left[:1024].tolist():
            x, y = find(label[i[p]]), find(label[j[p]])
            if x != y:
                root[max(x, y)] = min(x, y)
                chosen.append(p)
        left = left[1024:]
        while not np.array_equal(up := root[root], root):
            root[:] = up
        left = left[root[label[i[left]]] != root[label[j[left]]]]
    return np.array(chosen, np.int64)


def _least(threshold: float) -> int:
    """Equal tokens below which a pair at the threshold is not to be expected."""
    return max(1, int(np.ceil(K * (threshold - SLACK * np.sqrt(threshold * (1 - threshold) / K)))))


def _by_leaf(batches, columns, work):
    """Feed whole leaves of sorted batches to ``work`` (a list of columns, of which the first
    three name a leaf); a leaf that a batch cuts is held until it is whole."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = columns(batch)
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in held[:3]])))
        if cut:
            yield from work([x[:cut] for x in held])
            held = [x[cut:].copy() for x in held]
    if held is not None:
        yield from work(held)


def _cuts(*names):
    at = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in names])) + 1
    return zip([0, *at.tolist()], [*at.tolist(), len(names[0])], strict=True)


def _leaf_tasks(rows: DataFrame, threshold: float, count: int, take, schema: str) -> DataFrame:
    """``take`` (leaf columns, i, j, equal tokens) of each leaf's similar pairs."""
    least = _least(threshold)
    rows = rows.withColumn("part", F.lit(0)).select("node", "block", "part", "side", "rep", "n", "sketch", "comp")
    rows = rows.repartition(sized_parts(count, TASK_ROWS), "node", "block").sortWithinPartitions("node", "block", "rep")

    def columns(batch):
        return [batch.column(i).to_numpy() for i in range(6)] + [_matrix(batch.column(6), K, np.uint8), batch.column(7).to_numpy()]

    def work(cols):
        node, block, part, side, rep, n, sketch, comp = cols
        found = []
        for lo, hi in _cuts(node, block):
            if hi - lo > 1 and (comp[lo:hi] != comp[lo]).any():
                i, j, e = _similar(n[lo:hi], sketch[lo:hi], comp[lo:hi], side[lo:hi], threshold, least)
                if len(i):
                    found.append(take([c[lo:hi] for c in (node, block, rep, n, comp)], i, j, e))
        if found:
            yield from batch_of([np.concatenate(x) for x in zip(*found, strict=True)])

    def batch_of(arrays):
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(lambda batches: _by_leaf(batches, columns, work), schema)


def candidates(rows: DataFrame, threshold: float, count: int) -> DataFrame:
    """Pairs (a, b), a < b: in each block a forest of its similar pairs over its components, most
    similar pairs first. So there are fewer of them than documents in the block."""

    def take(leaf, i, j, e):
        _, _, rep, _, comp = leaf
        order = np.lexsort((j, i, -e))
        chosen = order[_forest(comp, i[order], j[order])]
        x, y = rep[i[chosen]], rep[j[chosen]]
        return np.minimum(x, y), np.maximum(x, y)

    return _leaf_tasks(rows, threshold, count, take, "a long, b long").where("a <> b").distinct()


def unresolved(rows: DataFrame, threshold: float, count: int, held: int = HELD) -> DataFrame:
    """node, block, part, side, rep, n, comp: the members of blocks that have a similar partner in
    another component. Where the sets of a block's members are larger than ``held`` bytes, they
    are cut into runs by size, and each two runs whose sizes allow a link are a part of their own."""

    def take(leaf, i, j, e):
        node, block, rep, n, comp = leaf
        at = np.unique(np.concatenate((i, j)))
        at = at[np.argsort(n[at], kind="stable")]
        run = (np.cumsum(8 * n[at]) - 8 * n[at]) // held
        rows, parts, sides = [], [], []
        runs = np.unique(run).tolist()
        for p, x in enumerate(runs):
            for y in runs[p:]:
                a, b = at[run == x], at[run == y]
                if x == y:
                    some, side = a, np.full(len(a), -1)
                elif n[a].max() >= threshold * n[b].min() - 1e-9:
                    some, side = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
                else:
                    continue
                if len(some) > 1:
                    rows.append(some)
                    sides.append(side)
                    parts.append(np.full(len(some), len(parts)))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        part, side = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (parts, sides))
        return node[at], block[at], part, side, rep[at], n[at], comp[at]

    return _leaf_tasks(rows, threshold, count, take, "node long, block int, part int, side int, rep long, n long, comp long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def exhaust(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from testing all pairs of each block's members on their
    full sets. Only links that join two components within the block are given out."""
    room = members.agg(F.sum("n")).first()[0] or 0
    rows = members.drop("n").join(sets.withColumnRenamed("id", "rep"), "rep").select("node", "block", "part", "side", "rep", "comp", "shingles")
    rows = rows.repartition(sized_parts(8 * room, HELD), "node", "block", "part").sortWithinPartitions("node", "block", "part", "rep")

    def columns(batch):
        shingles = np.empty(batch.num_rows, object)
        shingles[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(6)]
        return [batch.column(i).to_numpy() for i in range(6)] + [shingles]

    def links(cols):
        node, block, part, side, rep, comp, shingles = cols
        found = []
        for lo, hi in _cuts(node, block, part):
            if hi - lo < 2:
                continue
            some = list(shingles[lo:hi])
            n, common = np.array([len(s) for s in some]), _common(some)
            i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1))
            chosen = _forest(comp[lo:hi], i, j)
            found.append(np.stack([rep[lo:hi][i[chosen]], rep[lo:hi][j[chosen]]]))
        if found:
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(lambda batches: _by_leaf(batches, columns, links), "a long, b long")


def shingle_table(docs: DataFrame, ids: DataFrame, width: int = 5) -> DataFrame:
    """(id, shingles) of the documents listed in ``ids`` (column id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sent(ids, 16), "id", "left_semi")

    def run(batches):
        for b in batches:
            for lo, hi, some in sets_of(b.column(1), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in some], pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, linked) with the verdict of their full sets."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id it reaches) of the ends of some links."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        # a root follows its smallest neighbour, then all follow their root's root
        np.minimum.at(new, label, new.copy())
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def components(links: DataFrame, each: int = EDGES) -> DataFrame:
    """(id, comp): the smallest id that each end of the saved links (a, b) reaches. Tasks of about
    ``each`` links contract their own; where there is more than one, what they leave is joined by
    minima of neighbours and jumps to the label's label, until nothing changes."""
    parts = sized_parts(links.count(), each)

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, comp = _smallest(*map(np.concatenate, zip(*held, strict=True)))
            for lo in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 100_000]), pa.array(comp[lo : lo + 100_000])], names=["id", "comp"])

    stars = saved(links.coalesce(parts).mapInArrow(run, "id long, comp long"), "stars")
    if parts == 1:
        return stars
    both = stars.select(F.col("id").alias("u"), F.col("comp").alias("v")).unionByName(stars.select(F.col("comp").alias("u"), F.col("id").alias("v")))
    edges = saved(both.distinct(), "edges", 2 * stars.count())
    n = edges.count()
    labels = saved(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l")), "labels", n)
    while True:
        seen = labels.select(F.col("u").alias("v"), F.col("l").alias("lv"))
        near = edges.join(seen, "v").groupBy("u").agg(F.min("lv").alias("m"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = labels.join(near, "u").join(jump, "l", "left")
        new = saved(new.select("u", F.least("l", "m", F.coalesce("ll", "l")).alias("l"), (F.least("l", "m", F.coalesce("ll", "l")) < F.col("l")).alias("moved")), "labels", n)
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(edges, stars)
            return labels.select(F.col("u").alias("id"), F.col("l").alias("comp"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, trees: int | None = None, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document. Linked are documents with
    100 * intersection >= ``percent`` * union of their sets. ``trees``: as many as RECALL needs."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    threshold = percent / 100
    n = docs.count()
    # small splits are read together; splits of the usual size hold more rows than this
    found = saved(profiles(docs, width), "profiles", n, 5_000)
    named = found.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = saved(named.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", "f1", "f2", F.coalesce("rep", "doc_id").alias("rep")), "members", n)
    others = members.where("rep <> doc_id").select("doc_id", "n", "f1", "f2")
    reps = saved(named.join(others, ["doc_id", "n", "f1", "f2"], "left_anti").select(F.col("doc_id").alias("rep"), "n", "f1", "f2", "tokens").dropDuplicates(["rep", "n", "f1", "f2"]), "reps", n, 20_000)
    rows, m, dense = leaves(reps, threshold, trees or trees_for(threshold, depth=depth), limit, depth)
    labels = _resolve(docs, rows, m, dense, n, percent, width, limit)
    discard(rows, reps)
    # rows that repeat an id with other texts: their classes meet in that id
    out = found.select("doc_id", "n", "f1", "f2").join(members.where("rep <> doc_id").distinct(), ["doc_id", "n", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if labels is not None:
        out = out.join(sent(labels.withColumnRenamed("id", "rep"), 16), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    else:
        out = out.withColumn("component_id", F.col("rep"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.coalesce(sized_parts(n, 50_000))


def _resolve(docs: DataFrame, rows: DataFrame, m: int, dense: int, n: int, percent: int, width: int, limit: int) -> DataFrame | None:
    """(id, comp) of the representatives that have links, from the ``m`` rows of the leaves."""
    threshold = percent / 100

    def with_components(labels, some=rows):
        if labels is None:
            return some.withColumn("comp", F.col("rep"))
        named = some.join(sent(labels.select(F.col("id").alias("rep"), F.col("comp").alias("c__")), 16), "rep", "left")
        return named.withColumn("comp", F.coalesce("c__", "rep")).drop("c__")

    def proposed(labels, some, groups=1):
        return saved(candidates(dealt(with_components(labels, some), limit, dense > 0, groups), threshold, m), "pairs", m, 20_000)

    # a forest of what tokens show as similar: a tree alone, then the others, then dense nodes
    # in full, each among the components so far; it names every document that needs its set
    forest = labels = None
    rounds = [(rows.where("tree = 0"), 1), (rows.where("tree > 0"), 1)] + [(rows.where(F.col("c") > limit), None)] * (dense > 0)
    for some, groups in rounds:
        new = proposed(labels, some, groups)
        if new.limit(1).count():
            forest = new if forest is None else forest.unionByName(new)
            labels = components(forest)
    if forest is None:
        return None
    p = forest.count()
    ids = saved(forest.select(F.col("a").alias("id")).unionByName(forest.select(F.col("b").alias("id"))).distinct(), "ids", 2 * p)
    sets = saved(shingle_table(docs, ids, width), "sets", n, 5_000)
    # the same on full sets: links of the forest, then links that false ones of it have hidden
    links = saved(confirm(forest, sets, percent).where("linked").select("a", "b"), "links", p, 2_000)
    labels = components(links)
    more = proposed(labels, rows)
    links = links.unionByName(saved(confirm(more, sets, percent).where("linked").select("a", "b"), "links", more.count(), 2_000))
    labels = components(links)
    # at last all members of leaves that still have a similar partner in another component
    left = saved(unresolved(dealt(with_components(labels), limit, dense > 0), threshold, m), "unresolved", m, 20_000)
    rest = saved(exhaust(left, sets, percent), "links", left.count(), 500)
    if rest.limit(1).count():
        labels = components(links.unionByName(rest))
    discard(sets, left)
    return labels


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT DISTINCT u AS s, u AS t FROM e UNION SELECT r.s, e.v FROM r JOIN e ON e.u = r.t),
c AS (SELECT s, min(t) AS m FROM r GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.s = d.doc_id
"""
