"""Chat formatting at token level.

Each turn is assembled from segments that are encoded apart: a reserved id for its role,
the text, a reserved end id. Reserved ids lie above the vocabulary, so no text can make
one. In the formatted text the marks are strings; where a text holds a control string (or
the escape character) it is escaped by a backslash, and reading back undoes that. Prefix sums
of the lengths of segments and of turns give their places, so a turn is one row however long
its conversation is; the loss mask is the prefix sum of the marks where loss segments begin
and end. A task holds the turns of a batch; a text is encoded whole, however long.

Turns are ordered by (turn, role, text), nulls first. Null texts are empty; null and
unknown roles get a mark that carries their name. Repeated rows are turns of their own.
A null conversation id is a conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as k
from .bytebpe import Encoder

ROLES = ("system", "user", "assistant")
END = "</turn>"
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_OPENED = re.compile(r"### (@?)((?:[^\\:]|\\.)*): ", re.S)
_CLOSED = re.compile(r"(?:\\(?:\\|###|</turn>)|(?!</turn>)[^\\])*", re.S)


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def mark(role: str | None) -> str:
    """Opening mark of a turn; roles other than the known ones stand behind an @, as they are."""
    if role in ROLES:
        return f"### {role.title()}: "
    return f"### @{escape(role or '').replace(':', chr(92) + ':')}: "


def formatted(role: str | None, text: str) -> str:
    return f"{mark(role)}{escape(text)} {END}\n"


def read_formatted(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        head = _OPENED.match(text, at)
        body = _CLOSED.match(text, head.end())
        role = unescape(head[2].replace("\\:", ":")) if head[1] else head[2].lower()
        out.append((role, unescape(body[0][:-1])))
        at = body.end() + len(END) + 1
    return out


class Codec:
    """Segments to ids and back. The library's own special strings are plain text here."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        # a task has one core; the library's own threads only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.encoder = Encoder(definition, plain_special=True)
        top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.role_ids = {r: top + i for i, r in enumerate(ROLES)}
        self.other_id, self.name_end_id, self.end_id = top + 3, top + 4, top + 5
        self.first_reserved = top

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids.astype(np.uint32) for ids in self.encoder.many(pa.array(texts, pa.string()))]

    def head(self, role: str | None) -> np.ndarray:
        """Ids before the text of a turn."""
        if role in self.role_ids:
            return np.array([self.role_ids[role]], np.uint32)
        return np.array([self.other_id, *self.tokenizer.encode(role or "", add_special_tokens=False).ids, self.name_end_id], np.uint32)

    def segments(self, role: str | None, text: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
        """The segments of a turn and which of them bear loss."""
        return [self.head(role), text, np.array([self.end_id], np.uint32)], [False, role == LOSS_ROLE, False]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def decode_all(self, ids) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def read(self, ids: np.ndarray) -> tuple[str, np.ndarray]:
        """Role and text ids of a turn."""
        names = {v: r for r, v in self.role_ids.items()}
        if int(ids[0]) in names:
            return names[int(ids[0])], ids[1:-1]
        cut = int(np.flatnonzero(ids == self.name_end_id)[0])
        return self.decode(ids[1:cut]), ids[cut + 1 : -1]


def loss_spans(lengths: np.ndarray, bears: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the loss in each row of segment ``lengths``, from their prefix sums; 0, 0
    where no segment ``bears`` any. The segments that do are neighbours."""
    ends = np.cumsum(lengths, axis=1)
    some, first, last = bears.any(axis=1), bears.argmax(axis=1), bears.shape[1] - 1 - bears[:, ::-1].argmax(axis=1)
    row = np.arange(len(lengths))
    return np.where(some, (ends - lengths)[row, first], 0), np.where(some, ends[row, last], 0)


def mask_of(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The mask of ``n`` places that are inside the spans, as the prefix sum of marks at their ends."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


_codecs: dict[int, Codec] = {}


def codec(definition: str) -> Codec:
    key = hash(definition)
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def format_turns(conversations: DataFrame, definition: str, prefix: bool = True) -> DataFrame:
    """A row for each turn: conv_id, turn, tokens (little-endian 32-bit ids), loss_start and
    loss_end (ids of the turn under the loss mask), formatted; with ``prefix`` also token_offset,
    char_offset and the mask's mask_start and mask_end in its conversation, by prefix sums."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    sent = conversations.sparkSession.sparkContext.broadcast(definition)
    schema = "conv_id long, turn long, role string, tokens binary, loss_start int, loss_end int, n_tokens long, n_chars long, formatted string, body int"

    def run(batches):
        coder = codec(sent.value)
        for b in batches:
            _, offsets = k.buffers(b.column(3))
            for lo, hi, _, _ in k.pieces(np.zeros(0, np.uint8), offsets):
                some = b.slice(lo, hi - lo)
                roles, texts = some.column(2).to_pylist(), some.column(3).to_pylist()
                parts, bears = zip(*(coder.segments(r, ids) for r, ids in zip(roles, coder.encode(texts), strict=True)), strict=True)
                starts, ends = loss_spans(np.array([[len(x) for x in p] for p in parts]), np.array(bears))
                tokens = [np.concatenate(p) for p in parts]
                shown = [formatted(r, t) for r, t in zip(roles, texts, strict=True)]
                arrays = [*some.columns[:3], pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary()), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array([len(t) for t in tokens]), pa.array([len(s) for s in shown]), pa.array(shown), pa.array([len(mark(r)) for r in roles], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "tokens", "loss_start", "loss_end", "n_tokens", "n_chars", "formatted", "body"])

    out = rows.mapInArrow(run, schema)
    if prefix:
        # the text by which equal turns and roles are ordered is read from the formatted one, after the shuffle
        body = F.expr(f"substring(formatted, body + 1, n_chars - body - {len(END) + 2})")
        out = out.repartition("conv_id").withColumn("text_order", F.regexp_replace(body, _UNESCAPE.pattern, "$1"))
        before = Window.partitionBy("conv_id").orderBy("turn", "role", "text_order").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({"token_offset": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "char_offset": F.coalesce(F.sum("n_chars").over(before), F.lit(0))})
        out = out.withColumns({"mask_start": F.col("token_offset") + F.col("loss_start"), "mask_end": F.col("token_offset") + F.col("loss_end")})
    return out.drop("text_order", "body")


def read_back(turns: DataFrame, definition: str, clustered: bool = False) -> DataFrame:
    """The digest of each conversation from the ids of its turns. Rows come sorted and are
    folded one by one: a task holds one turn, however long a conversation is. ``clustered``:
    the rows come straight from ``format_turns``, whose window has dealt them by conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    sent = turns.sparkSession.sparkContext.broadcast(definition)
    ordered = turns.select("conv_id", "token_offset", "tokens", "mask_start", "mask_end", "formatted")
    ordered = (ordered if clustered else ordered.repartition("conv_id")).sortWithinPartitions("conv_id", "token_offset")

    def run(batches):
        coder, now, started = codec(sent.value), None, False
        state = None

        def row():
            conv, n, all_, chars, loss, shown = state
            return [conv], [n], [all_.hexdigest()], [chars], [loss.hexdigest()], [shown]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i][0] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        done = []
        for b in batches:
            if not b.num_rows:
                continue
            offset, ids = b.column(1).to_numpy(), [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
            at = np.cumsum([0, *map(len, ids)])
            # places in the conversation to places in the batch
            lo, hi = (b.column(i).to_numpy() - offset + at[:-1] for i in (3, 4))
            mask = mask_of(lo, hi, int(at[-1]))
            roles, inner = zip(*map(coder.read, ids), strict=True)
            texts = coder.decode_all(inner)
            for i, (conv, shown) in enumerate(zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if not started or conv != now:
                    if started:
                        done.append(row())
                    now, started = conv, True
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ((_, again),) = read_formatted(shown)
                if again != texts[i]:
                    raise ValueError(f"conversation {conv}: the formatted text and the ids of a turn disagree")
                state[1] += 1
                state[2].update(f"{roles[i]}\n{texts[i]}\n".encode())
                masked = ids[i][mask[at[i] : at[i + 1]]]
                if len(masked):
                    # most often the mask is the text, which need not be decoded again
                    text = texts[i] if np.array_equal(masked, inner[i]) else coder.decode(masked)
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(shown)
            if len(done) > 10_000:
                yield emit(done)
                done = []
        if started:
            done.append(row())
        if done:
            yield emit(done)

    return ordered.mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7, whose texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def definition_of(path: str) -> str:
    return json.dumps(json.load(open(path, encoding="utf-8")))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(t, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS x FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + length(role) + 6 + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
