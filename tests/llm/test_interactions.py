"""Spelling variants, filter audit and retrieval packing: brute force and awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import audit, bytebpe, kernel, queries, retrieval, spelling

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()
LIBRARY = Tokenizer.from_str(DEFINITION)
#: Names that operators use inside.
CLASH = ["word", "n", "rank", "part", "mask", "digest", "crc", "row", "ids", "lead0", "form", "best", "source_"]
SCHEMA = "doc_id long, text string, source string"


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# op11


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, ls in links.items():
        best = min(ls, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return out


def variant_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_brute(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choices("abcé", k=rng.randrange(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÉÎÕÜß", "ABCabcABC", "a×b÷cdÿ"]
    words = ["mnopqrst"] * 220 + ["mnopqrsu"] * 36 + ["mnopqrvu"] * 6
    for b in bases:
        count = rng.choice([5, 30, 200])
        words += [b] * count
        for _ in range(4):
            i = rng.randrange(len(b))
            v = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice("abcé") + b[i:], b[:i] + rng.choice("abcé") + b[i + 1 :]])
            words += [v] * rng.choice([4, 5, 6, 40])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : (i + 1) * 40])) for i in range(-(-len(words) // 40))]
    rows += [(None, "abcdefg " * 9), (3, None), (4, ""), (5, "12 short a b"), (6, "ghijkl,mnopqr-ghijklĀghijkl " * 5), (7, "x" * 300_000), (7, "ghijkl " * 3), (7, "ghijkl " * 3)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    got = variant_rows(spelling.spelling_variants(clashing(df)))
    want = brute_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(f for _, f, *_ in want) and any(f and f != r for _, f, r, *_ in want)
    assert variant_rows(spelling.spelling_variants(df.where("false"))) == []


def test_variants_of_a_very_long_word(spark):
    """Memberships of a word are linear in it: five letters in each of 200,000 places would not fit as strings."""
    long = "ab" * 100_000
    rows = [(i, f"{long} {long[:-1]}c" if i < 40 else f"{long}q") for i in range(46)]
    got = {r[0]: r[1:] for r in variant_rows(spelling.spelling_variants(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)))}
    assert got[long + "q"][0] == long and got[long + "q"][3] == 1
    assert got[long][3] >= 2 and got[long][0] is None


def test_paths_of_forms(spark):
    words = [("abcdefgh"[: 6 + 0] + "x" * i, 5 * 6**i) for i in range(8)]
    got = {r[0]: r for r in variant_rows(spelling.variants(spark.createDataFrame(words, "word string, n long")))}
    assert all(r[2] == words[-1][0] for r in got.values()) and got[words[0][0]][1] == words[1][0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBé×zÿ÷ \n1日", max_size=30), max_size=6))
def test_runs(texts):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    starts, ends, letters = spelling.runs(data, offsets)
    raw = data.tobytes()
    want = [w for t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == want and letters.tolist() == list(map(len, want))
    seeds = np.arange(len(starts)).astype(np.uint32)
    assert spelling.crcs(data, starts, ends, seeds).tolist() == [zlib.crc32(w.encode(), i) for i, w in enumerate(want)]


# op12


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[j] == 1} for j in (0, 1))
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        parts[s or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, some in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = some
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                failing = sum(f in d[0] for d in some)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in some), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {key: tuple(v) for key, v in out.items()}


def test_audit_brute(spark):
    rng = random.Random(2)
    prose = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    texts = [None, "", " \n", prose(49, 900), prose(50, 900), prose(60, 9), prose(70, 900).upper(), "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, prose(55, 900) + " |", "é" * 80 + "ABCDE", prose(40_000, 50_000), "日本 " * 60]
    rows = [(i, t, rng.choice([None, "", "s1", "s2"])) for i, t in enumerate(texts * 4)]
    rows += [(None, texts[4], "s1"), (None, texts[4], "s1"), (900, texts[5], "s1"), (900, texts[5], "s1"), (-5, texts[5], "s2"), (901, "only", None)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 60, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(clashing(df).drop("part").withColumn("part", F.lit(1)), marks).collect()}
    assert got == brute_audit(rows, labels)
    assert audit.audit(df.where("false"), marks).count() == 0
    assert audit.audit(df, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_hot_rows_counts_before_it_joins(spark):
    text = "word " * 10
    df = spark.range(20_000).select(F.when(F.col("id") < 7_000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    marks = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    got = audit.audit(df, marks).where("filter_order = 'EABCD'").orderBy("step").collect()
    copies = df.where("text like 'word%'")
    assert got[0]["removed"] == copies.count() - copies.where("doc_id = 5").count()
    assert got[1]["kept"] == 0 and got[1]["good_lost"] == 7_000


# op13


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "日", "ª", "²", " ", " ", "<|endoftext|>", "ß", "×", "\r", "_", "😀", "ll", "'ll", "'re", "\x0b", "\x00", "\x7f", "\x85", "word" * 8]


def test_encoder_equals_library():
    rng = random.Random(11)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(0, 14))) for _ in range(30_000)] + [None, "x" * 100_000, "don't we'll THEY'RE 'sun ''s"]
    got = bytebpe.encoder(DEFINITION).many(pa.array(texts, pa.string()))
    want = LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_encoder_forgets():
    coder = bytebpe.Encoder(DEFINITION)
    coder.POOL, coder.KEEP = 50, 3
    texts = [f"some{i} words{i * 7} “{i}” é" for i in range(300)]
    for _ in range(2):
        for i in range(0, 300, 30):
            assert [g.tolist() for g in coder.many(pa.array(texts[i : i + 30]))] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[i : i + 30]]


def check_pieces(rows, pieces, window=2048):
    """Every id of every row in one piece; windows gapless; returns tokens of padding."""
    by_doc, by_sequence, texts = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(library_ids(t))
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, some in by_doc.items():
        if len(texts[i]) > 1:
            # rows that repeat an id cannot be told apart
            assert sum(p["length"] for p in some) == sum(map(len, texts[i]))
            continue
        ids, at = texts[i][0], 0
        for p in sorted(some, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    padding = 0
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_retrieval_packing_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    pieces = queries.QUERIES["op13_retrieval_packing"](spark, SMALL).collect()
    assert check_pieces(rows, pieces) == 0


def test_retrieval_packing_awkward_rows(spark):
    rows = [(None, "no id", None), (1, None, "a"), (2, "", None), (3, "word " * 30_000, None), (4, "x" * 50_000, None), (5, "<|endoftext|> a", None), (6, "same text here", None), (7, "same text here", None), (8, "one", None), (8, "two more words", None), (8, "one", None)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    again = [retrieval.digest(retrieval.pack_by_retrieval(df, DEFINITION, 1)).collect() for _ in range(2)]
    assert check_pieces([(i, t) for i, t, _ in rows], again[0]) == 0
    assert sorted(map(str, again[0])) == sorted(map(str, again[1]))
    assert retrieval.pack_by_retrieval(df.where("false"), DEFINITION, 1).count() == 0
    with pytest.raises(ValueError):
        retrieval.pack_by_retrieval(df, DEFINITION, 1, window=1000)


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, rng.integers(1, 60)).astype("<u2") for _ in range(50)]
    offsets = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=40)
    weights = retrieval.Weights(df, 50, int(offsets[-1]))
    index = retrieval.Index(np.concatenate(texts), offsets, weights)
    query = index.query(7)
    assert len(query) == min(retrieval.QUERY, len(set(texts[7].tolist())))
    mean = offsets[-1] / 50
    want = [sum(np.log(1 + (50 - df[q] + 0.5) / (df[q] + 0.5)) * (c := int((t == q).sum())) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean)) for q in query.tolist()) for t in texts]
    assert np.allclose(index.scores(query, 50), want, rtol=1e-4)
    used = np.zeros(50, bool)
    used[::3] = True
    order = list(index.neighbours(query, used))
    assert order == sorted(order, key=lambda d: (-round(want[d], 3), d)) or [round(want[d], 2) for d in order] == sorted((round(want[d], 2) for d in order), reverse=True)
    assert set(order) == {d for d in range(50) if not used[d] and want[d] > 0}


def test_neighbours_beyond_the_first_are_whole():
    ids = np.concatenate([np.array([5, 6 + i % 3, 1], "<u2") for i in range(1000)])
    offsets = np.arange(0, 3001, 3)
    weights = retrieval.Weights(np.bincount(ids, minlength=10), 1000, 3000)
    index = retrieval.Index(ids, offsets, weights)
    found = list(index.neighbours(index.query(0), np.arange(1000) == 0))
    assert sorted(found) == list(range(1, 1000)) and found[:333] == list(range(3, 1000, 3))


def test_windows_hold_documents_of_a_topic(spark):
    """Documents of 40 topics with words of their own: windows hold far fewer topics than by chance."""
    rng = random.Random(9)
    common = [f"the{i}" for i in range(200)]
    topics = [[f"{chr(97 + t % 26)}{chr(97 + t // 26)}{''.join(rng.choices('aeioukrst', k=5))}" for _ in range(40)] for t in range(40)]
    rows = [(i, " ".join(rng.choices(common, k=60) + rng.choices(topics[i % 40], k=40)), None) for i in range(1200)]
    pieces = retrieval.digest(retrieval.pack_by_retrieval(spark.createDataFrame(rows, SCHEMA), DEFINITION, 1)).collect()
    check_pieces([(i, t) for i, t, _ in rows], pieces)
    windows = defaultdict(set)
    for p in pieces:
        windows[p["sequence_id"]].add(p["doc_id"])
    own = [max(Counter(d % 40 for d in w).values()) / len(w) for w in windows.values() if len(w) > 3]
    assert sum(own) / len(own) > 0.6


def test_packer_cuts_and_carries():
    weights = retrieval.Weights(np.full(50, 2), 10, 100)
    packer, sizes = retrieval.Packer(weights, window=8), [3, 20, 4, 1, 7]
    ids = np.arange(sum(sizes), dtype="<u2") % 50
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = list(packer.shard(ids, offsets)) + list(packer.shard(ids, offsets))
    assert all(sum(p[2] for p in s) == 8 for s in out)
    out += list(packer.rest())
    assert [sum(p[2] for p in s) for s in out[-3:]] and all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in out)
    seen = defaultdict(list)
    for s in out:
        for doc, start, n in s:
            seen[doc].append((start, n))
    for doc in range(10):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == sizes[doc % 5]


def test_pieces_carry_ids(spark):
    rows = [(1, "a few words of a text", None), (2, "b " * 5000, None)]
    pieces = retrieval.pack_by_retrieval(spark.createDataFrame(rows, SCHEMA), DEFINITION, 1).collect()
    for i, t, _ in rows:
        parts = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist() == library_ids(t)
