"""Operators of the training-data pipeline: brute force, round trips and awkward rows."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SMALL  # noqa: E402
from oracle import same  # noqa: E402

from quillon.llm import chat, hilbert, kernel, minhash, mixing, packing, quality, queries, shared, tokenbin, tokencount, topk, warc  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")
WORDS = [f"w{i}" for i in range(400)]
#: Names that operators use inside.
CLASH = ["size", "rep", "n", "rank", "shard", "slot", "sid", "part", "block", "row", "start", "target", "kept", "curve", "cell__", "group__", "host", "bad", "score", "at__", "digest", "bytes"]


def make_texts(seed=1):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    base = prose(120)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", "   \n\t ", "one", "one two three four", "One TWO three four", base, base, base.upper(), " ".join(near), prose(90), prose(5000), "é" * 10 + " #*$ <a|b>\n\ndup\ndup\n dup\n", "a b c a b c a b c " * 20, "日本語 テスト " * 40]
    return texts + [prose(rng.randrange(1, 200)) for _ in range(30)]


def docs(spark, texts=None, clash=False, ids=None):
    texts = make_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    data = [(i, t, ["en", None, "de"][j % 3], [None, "s1", "s2", "s10"][j % 4], len(t or "")) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


# kernel


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x1c.日", max_size=12) | st.none(), max_size=8))
def test_kernel_words(texts):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    w = kernel.Words(data, offsets)
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in words(t)] and w.counts.tolist() == [len(words(t)) for t in texts]
    h = kernel.Prefix(data)(w.starts, w.ends)
    assert len(set(h.tolist())) == len(set(got))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=40) | st.none(), max_size=6))
def test_quality_features(texts):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    got = list(zip(*[x.tolist() for x in quality.features(data, offsets)], strict=True)) if texts else []
    assert got == [brute_features(t) for t in texts]


def brute_features(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    hit = {i + j for i, g in enumerate(tri) if count[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


# op1


def test_near_duplicates_brute(spark):
    texts = make_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, texts, clash=True)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert got[7][1] == got[8][1] == got[9][1] == 6 and got[5][1] == 4


@pytest.mark.parametrize("limit, depth", [(512, 10), (8, 2)])
def test_near_copies_in_a_large_group(spark, limit, depth):
    """Copies of one text that differ from each other by about the threshold, in chains too; small
    limits send the group through deep levels and blocks."""
    rng = random.Random(4)
    base = rng.choices(WORDS, k=150)
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choices(WORDS, k=60)) for _ in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), limit=limit, depth=depth).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts))).items()}


def test_near_duplicates_awkward(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    got = [tuple(r) for r in minhash.near_duplicates(docs(spark, ["a b c d e f"] * 3, ids=[None, 5, 5])).orderBy("doc_id").collect()]
    assert got == [(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True)]
    assert minhash.near_duplicates(docs(spark, [None, ""])).where("kept AND n_shingles = 0").count() == 2


def test_near_copies_of_equally_long_texts_of_one_id(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.sample(WORDS, 60)) for _ in range(4)]
    assert len({len(shingles(t)) for t in texts}) == 1
    copies = [t.rsplit(" ", 1)[0] + " changed" for t in texts]
    got = minhash.near_duplicates(docs(spark, texts + copies, ids=[5] * 4 + [6, 7, 8, 9])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True)] * 4 + [(i, 5, False) for i in (6, 7, 8, 9)]


def test_trees_follow_from_recall():
    assert minhash.trees_for(0.85) == 10 and minhash.trees_for(1.0) == 1
    for t in (0.3, 0.5, 0.8, 0.9):
        n = minhash.trees_for(t)
        assert (1 - minhash.shared_leaf(t)) ** n <= 1 - minhash.RECALL < (1 - minhash.shared_leaf(t)) ** (n - 1)
        assert abs(sum(minhash.branches(t)) - 1 / t) < 1e-12


@pytest.mark.parametrize("percent", [0, 101])
def test_near_duplicates_percent(spark, percent):
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs(spark, ["a"]), percent=percent)


def test_near_duplicates_of_low_similarity(spark):
    """At 40 percent a node has two branches and a chance of a third."""
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        t = rng.choices(WORDS, k=100)
        texts += [" ".join(t), " ".join(t[:70] + rng.choices(WORDS, k=30)), " ".join(t[30:] + rng.choices(WORDS, k=30))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), percent=40).collect()}
    want = {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 40).items()}
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    assert sum(want[i] != i for i in want) > 20 and all(want[got[i]] == want[i] for i in got)


def near_group(size, seed=6):
    rng = random.Random(seed)
    base = rng.choices(WORDS, k=150)
    out = []
    for i in range(size):
        t = list(base)
        t[rng.randrange(150)] = f"x{i}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("limit, depth", [(512, 10), (32, 3)])
def test_candidates_are_fewer_than_members(spark, limit, depth):
    """A group of near copies gives out a forest for each block, not its pairs; a dense node gives
    its members once for each group of others, not once for each block."""
    found = minhash.profiles(docs(spark, near_group(300)))
    reps = shared.saved(found.select(F.col("doc_id").alias("rep"), "n", "f1", "f2", "tokens"), "reps")
    rows, n, dense = minhash.leaves(reps, 0.85, 2, limit, depth)
    rows = rows.withColumn("comp", F.col("rep"))
    assert n == rows.count() and dense == (rows.where(F.col("c") > limit).count() if depth == 3 else 0)
    dealt = minhash.dealt(rows, limit, dense > 0, 1)
    assert dealt.where("side = 0").count() <= 2.5 * dense + 4 * limit and dealt.where("side = 1").count() == dense
    assert 0 < minhash.candidates(dealt, 0.85, n).count() < dealt.count()
    one = minhash.dealt(rows.withColumn("comp", F.lit(0)), limit, dense > 0)
    assert one.where("side >= 0").count() == 0


def test_sets_meet_in_parts(spark):
    """Where sets are larger than what may meet at a time, runs of them meet in turn."""
    texts = near_group(40, 7)
    found = minhash.profiles(docs(spark, texts))
    reps = shared.saved(found.select(F.col("doc_id").alias("rep"), "n", "f1", "f2", "tokens"), "reps")
    rows, n, dense = minhash.leaves(reps, 0.85, 1)
    sets = minhash.shingle_table(docs(spark, texts), reps.select(F.col("rep").alias("id")))
    blocks = minhash.dealt(rows.withColumn("comp", F.col("rep")), 512, dense > 0)
    ends = []
    for held in (1 << 20, 5_000):
        left = shared.saved(minhash.unresolved(blocks, 0.85, n, held), "left")
        links = shared.saved(minhash.exhaust(left, sets, 85), "links")
        ends.append({(r["id"], r["comp"]) for r in minhash.components(links).collect()})
        parts = left.select("part").distinct().count()
        assert parts == 1 if held > 5_000 else parts > 3
    assert ends[0] == ends[1] and len(ends[0]) > 30


@pytest.mark.parametrize("each", [10, 10**6])
def test_components(spark, each):
    """Long chains, stars and random links, in one task and in many."""
    rng = random.Random(21)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(150)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    rng.shuffle(links)
    df = shared.saved(spark.createDataFrame(links, "a long, b long").repartition(12), "links")
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    assert {r["id"]: r["comp"] for r in minhash.components(df, each).collect()} == {x: find(x) for x in root}


def test_forest():
    rng = np.random.default_rng(3)
    comp = rng.integers(0, 40, 60)
    i, j = np.nonzero(np.triu(rng.random((60, 60)) < 0.5, 1))
    at = minhash._forest(comp, i, j)
    assert len(at) == len(set(comp.tolist())) - 1
    assert len(minhash._forest(comp, i[:0], j[:0])) == 0 == len(minhash._forest(np.zeros(60, int), i, j))


def test_very_long_near_copies(spark):
    """Two texts of 3 MB that differ in a hundred words, and one of half of them."""
    rng = random.Random(9)
    t = [f"v{rng.randrange(10**6)}" for _ in range(400_000)]
    other = list(t)
    for _ in range(100):
        other[rng.randrange(len(t))] = "changed"
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, [" ".join(t), " ".join(other), " ".join(t[:200_000]), "short"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}



def test_signature_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate((x[:900], rng.integers(0, 2**63, 100).astype(np.uint64)))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - 900 / 1100) < 0.12


# op2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool: x", "User", "###", ""]), st.text(alphabet="\\#</turn> ab:\n", max_size=20)), max_size=4))
def test_chat_text_is_reversible(turns):
    text = "".join(chat.formatted(r, t) for r, t in turns)
    assert chat.read_formatted(text) == turns


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("tokens"), F.lit(2).alias("n_chars"))


def test_chat_digest(spark):
    definition = chat.definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    tricky = "### User: \\</turn> <|endoftext|> \\\\ é日\n"
    rows = [(1, 1, "assistant", tricky), (1, 0, "user", None), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 0, None, "x"), (2, 1, "critic", ""), (None, 0, "user", "lost")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(conversation(spark, rows), definition), definition).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha(f"user\n\nassistant\n{tricky}\nassistant\nb\nassistant\nb\n")
    assert got[1]["loss_sha256"] == sha(tricky + "bb") and got[1]["loss_chars"] == len(tricky) + 2
    assert got[2]["turns_sha256"] == sha("\nx\ncritic\n\n") and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert got[1]["formatted_chars"] == sum(len(chat.formatted(r, t or "")) for c, _, r, t in rows if c == 1)
    assert chat.read_back(chat.format_turns(conversation(spark, []), definition), definition).count() == 0


def test_chat_orders_equal_turns_by_their_text(spark):
    """Against the query's SQL: turns that share turn and role, with texts that escapes would reorder."""
    import duckdb

    definition = chat.definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["b", "", "\\", "###", "##", "#", "[", "</turn>", "<", "é", "日", "a\\b", "a###", "aZ", None, "same prefix " * 20 + "2", "same prefix " * 20 + "1"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 1, "assistant", t) for t in reversed(texts)] + [(2, 5, "assistant", t) for t in texts]
    df = conversation(spark, rows)
    got = chat.read_back(chat.format_turns(chat.with_probe(df), definition), definition).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    want = con.execute(chat.ORACLE).df()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows_of = lambda t: sorted(map(tuple, t[columns].values.tolist()))
    assert rows_of(got) == rows_of(want)


def test_chat_offsets_and_masks(spark):
    definition = chat.definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    turns = chat.format_turns(conversation(spark, [(1, i, ["user", "assistant"][i % 2], f"text {i}") for i in range(6)]), definition).orderBy("turn").collect()
    at = 0
    for r in turns:
        assert r["token_offset"] == at and len(r["tokens"]) == 4 * r["n_tokens"]
        assert (r["loss_end"] > r["loss_start"]) == (r["role"] == "assistant")
        at += r["n_tokens"]


def test_masks_by_prefix_sums():
    lengths, bears = np.array([[1, 4, 1], [2, 0, 1], [1, 3, 1]]), np.array([[0, 1, 0], [0, 0, 0], [0, 1, 1]], bool)
    starts, ends = chat.loss_spans(lengths, bears)
    assert starts.tolist() == [1, 0, 1] and ends.tolist() == [5, 0, 5]
    assert chat.mask_of(np.array([1, 4, 4]), np.array([3, 4, 6]), 7).tolist() == [False, True, True, False, True, True, False]


def test_chat_mask_of_a_conversation(spark):
    """The mask over a conversation's whole stream of ids leaves just its assistant texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    definition = chat.definition_of(path)
    rows = [(1, i, ["user", "assistant", "tool"][i % 3], f"some text {i} </turn>") for i in range(7)]
    turns = chat.format_turns(conversation(spark, rows), definition).orderBy("token_offset").collect()
    stream = np.concatenate([np.frombuffer(r["tokens"], "<u4") for r in turns])
    mask = chat.mask_of(np.array([r["mask_start"] for r in turns]), np.array([r["mask_end"] for r in turns]), len(stream))
    assert chat.Codec(definition).decode(stream[mask]) == "".join(t for _, _, r, t in rows if r == "assistant")


def test_chat_of_very_long_texts(spark):
    definition = chat.definition_of(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(WORDS[i % 400] for i in range(400_000)) + " ### User: </turn>"
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(conversation(spark, [(1, 0, "user", "a"), (1, 1, "assistant", text), (2, 0, "assistant", "")]), definition), definition).collect()}
    assert len(text) > 1 << 20 and got[1]["loss_chars"] == len(text) and got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


# op3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    r = tokenbin.Reader(tokenbin.encode(ids))
    assert len(r) == len(ids) and r.slice(0, len(ids)).tolist() == ids.tolist()
    for i in range(0, len(ids), 97):
        assert r[i] == ids[i] and r.slice(i, min(i + 50, len(ids))).tolist() == ids[i : i + 50].tolist()
    with pytest.raises(IndexError):
        r[len(ids)]


def word_bpe():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


AWKWARD = ["Ab'S don't I'LL ẍ H̱ İI K K b 　 c<|endoftext|>d", "", "\x01 a", "日本語 テスト。Ω Σ. ΑΣ", "a\x85b \x1c c", "x.́ y ÉÀß,", "٣.٤, 5.", "<|x|> it's, l'eau. 3.14!"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abÉß'. ,1é́Ωx\n<|>", max_size=30))
def test_encoder_equals_library(text):
    e = tokenbin.encoder(word_bpe())
    assert e.by_word and e.by_model and e.by_stem
    some = [text, *AWKWARD, "a, b. c.", ".", "a.", ", a,", "d,.", "é, x ,y z,w"]
    for t in some:
        assert e.many([t.encode()])[0].tolist() == e.direct(t).tolist()
    for got, t in zip(e.many(e.texts(pa.array([*some, None]))), [*some, ""], strict=True):
        assert got.tolist() == e.direct(t).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_encoder_of_another_vocabulary(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        e = tokenbin.Encoder(f.read())
    for t in ["a  b", "Hello World\n\nx", *AWKWARD]:
        assert e.many([t.encode()])[0].tolist() == e.direct(t).tolist()


def test_encoder_cache_turns_over():
    e = tokenbin.Encoder(word_bpe())
    e.CACHE = 50
    for t in make_texts():
        assert e.many([(t or "").encode()])[0].tolist() == e.direct(t or "").tolist()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "SEGMENT", 300)
    texts = make_texts() + AWKWARD
    ids = [7 * i % 101 for i in range(len(texts))]
    path = shared.fresh_dir(spark, "t")
    tokenbin.write_tokens(docs(spark, texts, clash=True, ids=ids), path, word_bpe(), 1)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.read_tokens(spark, path).collect()}
    e, at, want = tokenbin.encoder(word_bpe()), 0, {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        tokens = [*e.direct(t or "").tolist(), 1]
        want[i] = (at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        at += len(tokens)
    assert got == want


def test_token_files_awkward(spark):
    path = shared.fresh_dir(spark, "t")
    tokenbin.write_tokens(docs(spark, []), path, word_bpe(), 1)
    assert tokenbin.read_tokens(spark, path).count() == 0
    path = shared.fresh_dir(spark, "t")
    tokenbin.write_tokens(docs(spark, ["b", "a", "a"], ids=[None, 3, 3]), path, word_bpe(), 1)
    assert [(r[0], r[1]) for r in tokenbin.read_tokens(spark, path).orderBy("start").collect()] == [(None, 0), (3, 2), (3, 4)]


# op4


def brute_topk(rows, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in {(i, tuple(v)) for i, v in ok if i is not None and i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv) and i is not None)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1000.0, 3e4])
def test_topk_brute(spark, scale):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 8)) * rng.lognormal(0, 1.5, (700, 1))
    v[300:350] = v[0]
    rows = [(i, (x * scale).tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1100, []), (1200, [1.0, None] * 4), (1300, [float("nan")] * 8), (1400, [1.0, 2.0]), (1500, [0.5, 0.5]), (1600, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("score"), F.lit(1).alias("id"))
    for block, sample in ((200, 50), (1 << 20, 5), (1 << 20, 10_000)):
        assert {tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0, block_bytes=block, sample=sample).collect()} == brute_topk(rows, 10)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_topk_pruning_is_exact(spread):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16)
    v = np.floor(1024 * (centre + rng.normal(size=(6000, 16)) * 0.2) * rng.lognormal(0, spread, (6000, 1)))
    ids = np.arange(6000)
    s = topk.Search(ids[::500], v[::500], 10)
    for a in range(0, 6000, 2500):
        s.show(ids[a : a + 2500], v[a : a + 2500])
    assert s.skipped if spread == 1.0 else s.pruned
    for j, i in enumerate(ids[::500]):
        p = (v @ v[i]).astype(np.int64)
        p[i] = -(2**62)
        assert s.found[j].tolist() == np.lexsort((ids, -p))[:10].tolist()


def test_topk_prunes_on_the_given_table(spark):
    """Vectors of one length, far apart: thresholds of a sample let coordinates prune most rows."""
    rows = topk.usable(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id", "embedding").collect()
    ((ids, v),) = topk._grouped(rows).values()
    at = ids % 100 == 0
    least = topk.floors(ids[at], v[at], ids[::2], v[::2], 10)
    s = topk.Search(ids[at], v[at], 10, least)
    s.show(ids, v)
    assert s.skipped + s.pruned + s.verified == at.sum() * len(ids) and s.verified < 0.5 * at.sum() * len(ids)
    for j, i in enumerate(ids[at]):
        p = (v @ v[ids == i][0]).astype(np.int64)
        p[ids == i] = -(2**62)
        assert least[j] <= s.score[j][-1] and s.found[j].tolist() == ids[np.lexsort((ids, -p))[:10]].tolist()


def test_topk_skips_short_buckets():
    rng = np.random.default_rng(4)
    v = np.floor(1024 * rng.normal(size=(5000, 16)) * rng.lognormal(0, 1, (5000, 1)))
    ids = np.arange(5000)
    s = topk.Search(ids[::500], v[::500], 10, topk.floors(ids[::500], v[::500], ids[::4], v[::4], 10))
    s.show(ids, v)
    assert s.skipped + s.pruned + s.verified == 50_000 and s.skipped > 10_000 and s.verified < 10_000


def test_topk_of_equal_rows_and_null_ids(spark):
    rows = [(100, [1.0, 2.0])] * 30 + [(None, [3.0, 1.0])] * 30 + [(7, [0.5, 0.5]), (200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    # nulls score 5 * 2**20 as well, but lose ties to ids
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, 1, 200, 5 << 20)] + [(100, i, None, 5 << 20) for i in range(2, 11)] + [(200, i, 100, 5 << 20) for i in range(1, 11)]


def test_topk_of_few(spark):
    df = spark.createDataFrame([(100, [1.0]), (200, [2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, F.col("id") % 100 == 0).count() == 2
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


# op5


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**60))
def test_permutation(n, seed):
    image = mixing.permute(np.arange(n), n, seed)
    assert sorted(image.tolist()) == list(range(n))
    assert mixing.unpermute(image, n, seed).tolist() == list(range(n))


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def brute_taken(rows, targets, seed, block):
    """Words by hand: lay out each source, walk its slots one by one."""
    order = sorted((s for s in targets if s is not None)) + [None] * (None in targets)
    out = []
    for sid, s in enumerate(order):
        line = rows[s]
        n, blocks = len(line), -(-len(line) // block)
        left, slot = min(round(targets[s]), 2 * n), 0
        while left > 0:
            b = int(mixing.permute(np.array([slot % blocks]), blocks, mixing.pass_seed(seed, sid, slot // blocks))[0])
            take = line[b * block : (b + 1) * block][:left]
            out += take
            left -= len(take)
            slot += 1
    return Counter(out)


@pytest.mark.parametrize("even", [True, False])
def test_mix_brute(spark, even):
    d = docs(spark, [" ".join(WORDS[: 40 + i % 7]) for i in range(48)] if even else None, clash=True)
    rows = mixing.mix(d, seed=5, block=8).collect()
    by_id = {r["doc_id"]: r for r in rows}
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    size = {r["doc_id"]: len(words(r["text"])) for r in d.collect()}
    sizes = Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    targets = brute_targets(sizes)
    for i, r in by_id.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[source[i]] and r["target"] == pytest.approx(targets[source[i]]) and r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert abs(sum(by_id[i]["taken"] for i in by_id if source[i] == s) - targets[s]) <= 0.5
    # the layout of a source, read off the operator's own places
    sz = shared.saved(mixing.with_size(d.select("doc_id", "source", "text")), "s")
    src = shared.saved(mixing.targets(sz), "t")
    lines = defaultdict(dict)
    for r in mixing._placed(sz, src).collect():
        for k in range(r["size"]):
            lines[source[r["doc_id"]]][r["start"] + k] = r["doc_id"]
    flat = {s: [lines[s][k] for k in range(sizes[s])] for s in sizes}
    want = brute_taken(flat, {s: targets[s] for s in sizes}, 5, 8)
    assert {i: by_id[i]["taken"] for i in by_id} == {i: want.get(i, 0) for i in by_id}
    assert not even or any(targets[s] < sizes[s] for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7), seed=5, block=8).collect()}
    assert again == {i: r["taken"] for i, r in by_id.items()}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 500), st.floats(0, 1), st.integers(1, 40), st.integers(0, 99))
def test_plan_gives_the_words_wanted(size, share, block, seed):
    want = round(2 * size * share)
    n, last = mixing.plan_source(3, size, want, seed, block)
    blocks, got = -(-size // block), 0
    for j in range(n):
        b = int(mixing.permute(np.array([j % blocks]), blocks, mixing.pass_seed(seed, 3, j // blocks))[0])
        got += last if j == n - 1 else min(block, size - b * block)
    assert got == want


def test_mix_shards_hold_every_slot(spark):
    """Every slot of every source stands at one place; shards have the same number of slots, and the
    counts of a source in them are those of a draw without replacement."""
    d = docs(spark, [" ".join(WORDS[: 100 + i % 50]) for i in range(400)])
    src = shared.saved(mixing.targets(shared.saved(mixing.with_size(d.select("doc_id", "source", "text")), "s")), "t")
    drawn, slots = mixing.draws(src, block=8)
    of = {r["sid"]: r for r in drawn.collect()}
    assert slots == sum(r["n_slots"] for r in of.values()) and all(r["first"] == sum(of[i]["n_slots"] for i in range(s)) for s, r in of.items())
    rows = mixing.slot_blocks(drawn, slots, block=8, shard_slots=100)
    assert sorted((r["shard"], r["place"]) for r in rows.collect()) == [(i // 100, i % 100) for i in range(slots)]
    assert Counter(r["sid"] for r in rows.collect()) == {s: r["n_slots"] for s, r in of.items()}
    counts = {(r["shard"], r["sid"]): r["slots"] for r in mixing.shard_counts(rows).collect()}
    for s, r in of.items():
        share, full = r["n_slots"] / slots, slots // 100
        spread = np.array([counts.get((i, s), 0) for i in range(full)])
        assert abs(spread.mean() - 100 * share) < 2 and 0.5 < spread.std() / np.sqrt(100 * share * (1 - share) * (1 - 100 / slots)) < 1.6


def test_mix_of_very_long_texts_and_null_ids(spark):
    """A text over 1 MB, and many equal rows without an id."""
    long = " ".join(WORDS * 700)
    d = docs(spark, [long, *["a b c d e"] * 200], ids=[1] + [None] * 200)
    rows = mixing.mix(d, block=16).collect()
    assert len(long) > 1 << 20 and len(rows) == 201 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == 1.5 * sum(r["size"] for r in rows)
    out = mixing.mixed_documents(d, block=16).collect()
    assert sum(len(words(r["text"])) for r in out) == sum(r["taken"] for r in rows)


def test_mixed_documents(spark):
    d = docs(spark, clash=True)
    out = mixing.mixed_documents(d, block=8)
    assert out.schema.names == d.schema.names
    taken = Counter()
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += len(words(r["text"]))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(d, block=8).collect() if r["taken"]}
    # the two lay documents out in their own order: totals agree, and so do bounds
    assert sum(taken.values()) == sum(want.values()) and all(taken[r["doc_id"]] <= 2 * len(words(r["text"])) for r in d.collect() if r["text"])
    originals = {r["doc_id"]: r["text"] for r in d.collect()}
    assert any(r["text"] == originals[r["doc_id"]] for r in out.collect())


def test_mix_awkward(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    assert mixing.mixed_documents(docs(spark, [None, ""])).count() == 0
    rows = mixing.mix(docs(spark, ["a b c d"] * 4, ids=[1, 1, 1, 1]), block=2).collect()
    assert len(rows) == 4 and all(r["taken"] <= 8 for r in rows)
    twice = mixing.mixed_documents(docs(spark, ["a b c d"] * 8, ids=[1] * 8), block=2)
    assert sum(len(words(r["text"])) for r in twice.collect()) == 48


# op6


def brute_pieces(word, starts, inner):
    at, n = 0, 0
    while at < len(word):
        pool = starts if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8), st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8), st.lists(st.binary(min_size=1, max_size=120).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6), st.booleans())
def test_automaton(starts, inner, some, shared_set):
    inner = starts if shared_set else inner
    a = tokencount.Automaton(starts, None if shared_set else inner)
    data = np.frombuffer(b"".join(some), np.uint8)
    ends = np.cumsum([len(w) for w in some])
    got = a.counts(data, ends - [len(w) for w in some], ends)
    want = [brute_pieces(w, starts, inner) for w in some]
    assert got.tolist() == want == [a.count(w) for w in some]


def test_token_counts(spark):
    pieces = tokencount.pieces_of(public_tokenizers.path("word_bpe_49k.json"))
    assert all(bytes([b]) in pieces for b in range(256))
    a = tokencount.Automaton(sorted(pieces))
    texts = [*make_texts(), "x" * 5000]
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs(spark, texts, clash=True), a).collect()}
    low = lambda w: w.encode().lower()
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i]["n_words"] == len(w) and got[i]["n_unknown"] == 0 and got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["n_pieces"] == sum(brute_pieces(low(x), pieces, pieces) for x in w)
    assert tokencount.token_counts(docs(spark, []), a).count() == 0


# op7


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.indices([2**bits] * dims).reshape(dims, -1).T
    h = hilbert.curve(grid, bits)
    path = grid[np.argsort(h)]
    assert sorted(h.tolist()) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    texts = make_texts() * 2
    rows = hilbert.digest(docs(spark, texts, clash=True)).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert by[i]["size"] == len(raw) + 8 and by[i]["text_crc32"] == zlib.crc32(raw) and by[i]["grown_shard"] is None
    order = {r["doc_id"]: n for n, r in enumerate(sorted(rows, key=lambda r: (r["shard"], r["slot"])))}
    for t in set(texts):
        at = sorted(order[i] for i, x in enumerate(texts) if (x or "") == (t or ""))
        assert at[-1] - at[0] == len(at) - 1


def test_shards_by_hand(spark):
    """Levels, groups, order and cuts worked out apart from the operator."""
    rng = random.Random(11)
    data = [(i, "x" * rng.randrange(0, 900) + str(i % 90), rng.choice(["en", "de", None]), rng.choice([None, "s1", "s2", "s3", "s7"])) for i in range(500)]
    rows = hilbert.digest(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), shards=7).collect()
    rank = lambda at: {v: r for r, v in enumerate(sorted({x[at] or "" for x in data}))}
    lang, source = rank(2), rank(3)
    points = [(source[s or ""], lang[g or ""], len(t) + 8) for _, t, g, s in data]
    levels = []
    for d in range(3):
        values = sorted(p[d] for p in points)
        cuts = {values[max(-(-i * len(values) // 16) - 1, 0)] for i in range(1, 16)}
        levels.append([sum(p[d] > c for c in cuts) for p in points])
    index = hilbert.curve(np.array(levels).T, 4)
    lead = {}
    for (i, t, _, _), h in zip(data, index.tolist(), strict=True):
        lead[t] = min(lead.get(t, (i, h)), (i, h))
    shard = {r["doc_id"]: r["shard"] for r in rows}
    # of curve indices that groups share only the sums are known: hashes part them
    at = sorted((lead[t][1], i) for i, t, _, _ in data)
    sums = Counter(h for h, _ in at)
    for h, n in sums.items():
        lo = sum(m for g, m in sums.items() if g < h)
        got = sorted(shard[i] for g, i in at if g == h)
        assert got == sorted((lo + r) * 7 // len(data) for r in range(n))


def test_sharded_files_are_pruned(spark):
    rng = random.Random(13)
    data = [(i, "x" * (rng.randrange(10, 20) ** 2) + f" {i:04d}", rng.choice(["en", "de", "fr", "es"]), f"s{rng.randrange(8)}", "mine", i) for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, shard__ string, curve long")
    path = shared.fresh_dir(spark, "shards")
    hilbert.sharded(df, path, 64)
    files = spark.read.parquet(path)
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in hilbert.digest(df, 64).collect()}
    back = files.collect()
    assert {r["doc_id"]: (r["shard__"], r["slot__"]) for r in back} == want and all((r["doc_id"], r["text"], r["lang"], r["source"], r["curve"]) == (x := data[r["doc_id"]])[:4] + (x[5],) for r in back)
    boxes = shared.saved(hilbert.manifest(files), "boxes")
    assert boxes.agg(F.sum("rows")).first()[0] == 4000
    for name, of, some in (("source", lambda r: r["source"] == "s3", {"source": "s3"}), ("lang", lambda r: r["lang"] == "de", {"lang": "de"}), ("size", lambda r: len(r["text"]) >= 300, {"sizes": (308, 10**6)})):
        named = {r[0] for r in hilbert.matching(boxes, **some).collect()}
        assert {r["shard__"] for r in back if of(r)} <= named and len(named) <= 45, name
    hilbert.sharded(df.limit(0), shared.fresh_dir(spark, "shards"), 64)


def test_shards_awkward(spark):
    assert hilbert.digest(docs(spark, [])).count() == 0
    got = hilbert.digest(docs(spark, ["a"] * 5, ids=[None, 1, 1, 2, 3])).collect()
    assert len(got) == 5 and len({r["shard"] for r in got}) == 5 and {r["slot"] for r in got} == {0}


def test_shards_follow_sources_with_a_common_prefix(spark):
    data = [(i, f"text {i:04d}", "en", f"https://host-{'abcd'[i % 4]}.org") for i in range(960)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    sources = defaultdict(set)
    for r in hilbert.digest(df).collect():
        sources[r["shard"]].add(data[r["doc_id"]][3])
    assert len(sources) == 24 and all(len(x) == 1 for x in sources.values())


# op8


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit("x").alias("digest"), F.lit("y").alias("original"))


def archived(spark, df, split):
    return warc.read_archives(warc.write_archives(df, shared.fresh_dir(spark, "w")), split=split)


@pytest.mark.parametrize("split", [64, 1000, 1 << 23])
def test_warc_round_trip(spark, split):
    magic = b"\x1f\x8b\x08".decode("latin-1")
    big = "é<p>" * 400
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, None, "s"), (4, "u", "s"), (5, "u5", None), (6, "u6", magic * 500 + "WARC/1.1\r\n\r\n"), (None, "u7", big), (9, "u9", os.urandom(3000).hex())]
    back = archived(spark, pages(spark, rows), split)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.digest(back).collect()}
    assert back.count() == len(rows) and len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 2
        assert got[i] == (len(raw), warc.sha1(raw), "revisit" if again else "response", 2 if again else None)
    texts = {r["page_id"]: r["payload"] for r in back.collect()}
    assert bytes(texts["6"]).decode() == rows[5][2] and texts["1"] is None


def test_warc_awkward(spark):
    assert warc.digest(archived(spark, pages(spark, []), 1000)).count() == 0
    got = warc.digest(archived(spark, pages(spark, [(1, "u", "z" * 2000)] * 3), 1000)).collect()
    assert len(got) == 3 and {r["record_type"] for r in got} == {"response"}


def members(spark, path):
    """Header lines and blocks of all records, inflated apart from the operator's reader."""
    out = []
    for name in sorted(os.listdir(path.removeprefix("file://"))):
        raw = open(f"{path.removeprefix('file://')}/{name}", "rb").read()
        while raw:
            z = zlib.decompressobj(31)
            whole, raw = z.decompress(raw), z.unused_data
            head, _, rest = whole.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = [tuple(x.split(": ", 1)) for x in lines]
            n = int(dict(fields)["Content-Length"])
            assert version == "WARC/1.1" and rest[n:] == b"\r\n\r\n" and len({a for a, _ in fields}) == len(fields)
            out.append((dict(fields), rest[:n]))
    return out


def test_warc_records_are_valid(spark):
    """Mandatory fields, unique record ids (rows repeat ids), revisits that refer to a response of
    the same payload, HTTP blocks; files of failed attempts are gone."""
    big = "é<p>" * 400
    rows = [(1, "u1", big), (2, "u2", big), (2, "u2", big), (3, None, "s"), (3, None, "s"), (None, "u", big), (4, "u4", None)]
    path = shared.fresh_dir(spark, "w")
    written = warc.write_archives(pages(spark, rows).repartition(3), path)
    records = members(spark, path)
    assert len(records) == len(rows) and len({f["WARC-Record-ID"] for f, _ in records}) == len(rows)
    by_id = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    for f, block in records:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
        assert f["WARC-Type"] in ("response", "revisit") and f["Content-Type"] == warc.HTTP and block.startswith(b"HTTP/1.1 200 OK\r\n")
        body = block.partition(b"\r\n\r\n")[2]
        if f["WARC-Type"] == "revisit":
            target, other = by_id[f["WARC-Refers-To"]]
            assert f["WARC-Profile"] == warc.PROFILE and not body and target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and target["Quillon-Page-ID"] == f["Quillon-Refers-To-Page"] == "2"
        else:
            assert f["WARC-Payload-Digest"] == f"sha1:{hashlib.sha1(body).hexdigest()}" and "WARC-Refers-To" not in f
    assert sum(f["WARC-Type"] == "revisit" for f, _ in records) == 2
    folder = path.removeprefix("file://")
    run = os.listdir(folder)[0].split("-")[0]
    open(f"{folder}/{run}-000000-999.warc.gz", "wb").close()
    warc._drop_others(spark, path, run, written)
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["file"]) for r in written.collect())


def test_warc_of_large_payloads(spark):
    """Payloads above the reader's range, buffers and batches."""
    rows = [(i, f"u{i}", os.urandom(3_000_000).hex() if i % 2 else "z" * 6_000_000) for i in range(4)]
    back = archived(spark, pages(spark, rows), 1 << 20)
    assert {r["page_id"]: tuple(r)[1:] for r in warc.digest(back).collect()} == {i: (6_000_000, warc.sha1(t.encode()), "revisit" if i == 0 else "response", 2 if i == 0 else None) for i, _, t in rows}


@pytest.mark.parametrize("split", [1000, 1 << 23])
def test_warc_long_urls(spark, split):
    """Headers beyond any buffer: urls of 70,000 and 200,000 characters, repetitive or not."""
    rows = [(1, "https://h/" + "a" * 70_000, "x"), (2, "data:," + "b" * 200_000, "y" * 2000), (3, "data:," + os.urandom(100_000).hex(), "y" * 2000), (4, "u", "z")]
    written = warc.write_archives(pages(spark, rows), shared.fresh_dir(spark, "w"))
    back = warc.read_archives(written, split=split)
    assert {r["page_id"]: r["url"] for r in back.collect()} == {str(i): url for i, url, _ in rows}
    got = {r["page_id"]: tuple(r)[1:] for r in warc.complete(warc.digest(back), written).collect()}
    assert got == {i: (len(t), warc.sha1(t.encode()), "revisit" if i == 2 else "response", 3 if i == 2 else None) for i, _, t in rows}
    with pytest.raises(ValueError, match="3 records read of 4 written"):
        warc.complete(warc.digest(back).where("page_id <> 1"), written)


# op9


def test_host_rules(spark):
    texts = make_texts()
    got = {r["doc_id"]: r for r in quality.host_rules(docs(spark, texts, clash=True)).collect()}
    for i, t in enumerate(texts):
        f = brute_features(t)
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert tuple(got[i])[1:6] == f and got[i]["base_failed"] is failed and got[i]["kept"] is (not failed)
    kept = quality.keep_documents(docs(spark, texts, clash=True))
    assert kept.schema.names == docs(spark, texts, clash=True).schema.names
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert quality.host_rules(docs(spark, [])).count() == 0 and quality.keep_documents(docs(spark, [])).count() == 0


def test_host_verdict_rejects_a_bad_host(spark):
    good = " ".join(WORDS[:120])
    data = [(i, "short" if i % 50 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 10 else "short", f"h{i % 40}") for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = quality.host_rules(df).collect()
    assert not any(r["kept"] for r in rows if r["doc_id"] < 400) and all(r["kept"] for r in rows if r["doc_id"] >= 1000 and not r["base_failed"])
    v = {r["host"]: r for r in quality.host_verdicts(df.withColumn("f", F.col("text") == "short"), "source", "f").collect()}
    assert v["bad"]["rate"] < v["bad"]["f"] / v["bad"]["n"] and not v["bad"]["host_ok"]


def test_host_verdict_of_plausible_data(spark):
    """Hosts of many rates: the one that fails ten times as likely as the rest goes, with its good
    documents; a tiny host that failed twice, and large hosts of usual rates, stay."""
    good = " ".join(WORDS[:120])
    rng = random.Random(3)
    rates = {f"h{i}": rng.uniform(0.03, 0.2) for i in range(15)} | {"spam": 0.8, "large": 0.06}
    data = [(h, rng.random() < p) for h, p in rates.items() for _ in range(1500 if h == "large" else 100)] + [("tiny", True), ("tiny", True), (None, False)]
    df = spark.createDataFrame([(None if i % 97 == 0 else i // 2, "short" if bad else good, h) for i, (h, bad) in enumerate(data)], "doc_id long, text string, source string")
    verdicts = {r["host"]: r for r in quality.host_verdicts(df.withColumn("bad", F.col("text") == "short"), "source", "bad").collect()}
    assert [h for h, r in verdicts.items() if not r["host_ok"]] == ["spam"] and all(r["lower"] < r["rate"] for r in verdicts.values())
    rows = quality.host_rules(df).collect()
    assert len(rows) == len(data) and sum(not r["base_failed"] and not r["kept"] for r in rows) == sum(h == "spam" and not bad for h, bad in data) > 5
    kept = Counter(r["source"] for r in quality.keep_documents(df).collect())
    assert kept == Counter(h for h, bad in data if not bad and h != "spam")


def test_quality_of_very_long_texts(spark):
    text = "\n".join(" ".join(WORDS[i % 300 : i % 300 + 40]) for i in range(9_000))
    (row,) = quality.host_rules(docs(spark, [text])).collect()
    assert len(text) > 1 << 20 and tuple(row)[1:6] == brute_features(text)


# op10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40))
def test_pack(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, length, used = packing.pack(sizes, (10, 20, 40))
    total = Counter()
    for b, s in zip(bins, sizes, strict=True):
        total[b] += s
    assert [total[b] for b in range(len(length))] == used and all(u <= c and all(x < u for x in (10, 20, 40) if x < c) for u, c in zip(used, length, strict=True))
    for opening in (10, 20, 40):
        _, _, other = packing._fill(sizes, (10, 20, 40), opening)
        assert sum(packing.cost(c) for c in length) <= sum(packing.cost(min(c for c in (10, 20, 40) if c >= u)) for u in other)


def test_best_fit_by_hand():
    # 7 opens a bin; 5 another; 3 fills the first best, 4 goes to the second
    bins, _, _ = packing._fill([7, 5, 4, 3], (10,), 10)
    assert bins == [0, 1, 1, 0]
    assert packing._fill([7, 5, 3], (10,), 10)[0] == [0, 1, 0]


def test_bins_open_at_the_least_cost():
    # 9 + 9 + 2 fill 20 at 36 / 20 a word, better than 26 / 9 of 10 alone and 56 / 22 of 40
    left = Counter([9, 2, 2])
    mask = sum(1 << s for s in left)
    assert [packing.contents(c, 9, left, mask) for c in (10, 20, 40)] == [9, 20, 22]
    _, capacity, used = packing._fill([9, 9, 2, 2], (10, 20, 40), None)
    assert capacity == [20, 10] and used == [20, 2]


def test_joint_lengths_beat_each_single_opening():
    rng = random.Random(2)
    total = lambda used: sum(packing.cost(min(c for c in packing.LENGTHS if c >= u)) for u in used)
    better = 0
    for _ in range(30):
        sizes = sorted((rng.choice([rng.randrange(1, 300), rng.randrange(300, 1100), rng.randrange(1500, 4000)]) for _ in range(60)), reverse=True)
        own = total(packing._fill(sizes, packing.LENGTHS, None)[2])
        fixed = [total(packing._fill(sizes, packing.LENGTHS, c)[2]) for c in packing.LENGTHS]
        better += own < min(fixed)
        assert total(packing.pack(sizes)[2]) == min(own, *fixed)
    assert better



def brute_fill(sizes, lengths, opening):
    bins, rest = [], []
    for s in sizes:
        open_ = [(r, -b) for b, r in enumerate(rest) if r >= s]
        if open_:
            b = -min(open_)[1]
        else:
            b = len(rest)
            rest.append(min((c for c in lengths if c >= max(s, opening)), key=packing.cost))
        bins.append(b)
        rest[b] -= s
    return sorted(rest)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=30), st.sampled_from([10, 20, 40]))
def test_fill_is_best_fit(sizes, opening):
    sizes = sorted(sizes, reverse=True)
    _, capacity, used = packing._fill(sizes, (10, 20, 40), opening)
    assert sorted(c - u for c, u in zip(capacity, used, strict=True)) == brute_fill(sizes, (10, 20, 40), opening)


def test_pack_sizes_splits_rows_that_are_alike(spark):
    sizes = shared.saved(spark.range(9_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size")), "sizes")
    packed = packing.pack_sizes(sizes, group=1_000)
    groups = [r[1] for r in packed.groupBy(F.substring_index("bin_id", "-", 1)).count().collect()]
    assert sum(groups) == 9_000 and len(groups) == 9 and max(groups) < 1_500


def test_keep_documents_counts_once(spark):
    """Rejected rows are written without their texts, kept ones with all columns."""
    df = docs(spark, clash=True)
    got = {r["doc_id"]: r.asDict() for r in quality.keep_documents(df).collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.host_rules(df).collect()}
    rows = {r["doc_id"]: r.asDict() for r in df.collect()}
    assert got == {i: r for i, r in rows.items() if verdict[i]} and 0 < len(got) < len(rows)


def test_pack_documents(spark):
    texts = [*make_texts(), " ".join(WORDS * 30)]
    out = packing.pack_documents(docs(spark, texts, clash=True)).collect()
    for i, t in enumerate(texts):
        mine = sorted((r["start"], r["size"]) for r in out if r["doc_id"] == i)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) == len(words(t))
    for b in {r["bin_id"] for r in out}:
        mine = sorted((r["bin_offset"], r["size"]) for r in out if r["bin_id"] == b)
        assert sum(n for _, n in mine) == next(r["bin_used"] for r in out if r["bin_id"] == b) <= next(r["capacity"] for r in out if r["bin_id"] == b)
        at = 0
        for o, n in mine:
            assert o == at or n == 0
            at = max(at, o + n)
    assert packing.pack_documents(docs(spark, [])).count() == 0
    assert packing.pack_documents(docs(spark, [None, "a", "a"], ids=[None, 1, 1])).count() == 3


# pipeline


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs_.collect()}
    clean = {i for i, r in rows.items() for f in [brute_features(r["text"])] if not (f[0] < 50 or 100 * f[4] > 50 * f[0])}
    comp = brute_components([(i, rows[i]["text"]) for i in sorted(clean)], 80)
    firsts = {c for _, c in comp.values()}
    now, seen = docs_, []
    for name, stage in corpus_pipeline.STAGES:
        now = shared.saved(stage(spark, now, SMALL), name.replace(" ", "-"))
        seen.append(now)
    assert {r["doc_id"] for r in seen[0].collect()} == clean
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(firsts)
    assert all(s.schema.names == docs_.schema.names for s in seen[:3])
    sizes = Counter()
    for i in firsts:
        sizes[rows[i]["source"]] += len(words(rows[i]["text"]))
    got = Counter()
    for r in seen[2].collect():
        got[r["source"]] += len(words(r["text"]))
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= 0.5
    assert sum(r["size"] for r in seen[3].collect()) == sum(got.values())
    ran = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r["doc_id"], r["start"], r["size"], r["capacity"]) for r in df.collect())
    assert key(ran) == key(seen[3])


def test_pipeline_stages_awkward(spark):
    import corpus_pipeline

    good = " ".join(WORDS[:80])
    odd = docs(spark, [good, good, None, "", good + " more"], ids=[4, 4, None, 2, None]).select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (odd, odd.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = shared.saved(stage(spark, now, SMALL), "s")
    assert now.count() == 0
    once = corpus_pipeline.near_duplicates(spark, odd, SMALL)
    assert sorted(str(r["doc_id"]) for r in once.collect()) == ["2", "4", "None", "None"]


def test_pipeline_stages_with_other_columns(spark):
    """Columns that operators use inside, long texts, and many rows of one id go through."""
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    texts = [prose(200_000), *(prose(90) for _ in range(30)), *["same " + prose(80)] * 3]
    now = docs(spark, texts, clash=True, ids=[*range(31), 40, 40, 40])
    names, n = now.columns, [34, 32]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = shared.saved(stage(spark, now, SMALL), "s")
        assert i == 3 or now.columns == names
        assert i > 1 or now.count() == n[i]
    assert len(texts[0]) > 1 << 20 and now.where("doc_id = 0").count() > 40
