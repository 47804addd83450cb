"""Chat formatting by token-level assembly.

Turns are encoded one by one and never as part of a longer string, so no merge crosses a
turn. Control strings are not spelled out in tokens: each is a reserved id past the
vocabulary, spliced between the encoded texts. A text that contains a control string
(or the escape mark) is escaped first, so reading the ids back can tell them apart and
undo it. The loss mask of a segment covers the assistant's text and nothing else; the
place of a segment in its conversation is a prefix sum of token counts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.bytebpe import open_bpe
from spanframe.llm.common import partitions
from spanframe.llm.registry import query, table

#: Control strings, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
ESCAPE = "\\"
#: First reserved id; the vocabulary ends below it.
RESERVED = 50_300
_OPENING = {"user": (0, 2), "assistant": (), "system": (0, 4)}
_CLOSING = {"user": (3,), "assistant": (1,), "system": (5,)}
_FIND = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROLS)))
_BACK = re.compile(re.escape(ESCAPE) + r"(\d)")


def escape(text: str) -> str:
    """Puts an escape and a digit in place of the first character of each control string or escape mark."""
    digit = {c: str(i + 1) for i, c in enumerate(CONTROLS)} | {ESCAPE: "0"}
    return _FIND.sub(lambda m: ESCAPE + digit[m[0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: ESCAPE if m[1] == "0" else CONTROLS[int(m[1]) - 1][0], text)


def _splice(role: str, text: str, bpe) -> tuple[bytes, int, int]:
    """Ids of a turn, loss start and end in tokens."""
    body = bpe.encode(escape(text))
    known = role in _OPENING
    head, tail = (_OPENING[role], _CLOSING[role]) if known else ((6,), (1,))
    ids = b"".join((RESERVED + i).to_bytes(4, "little") for i in head)
    if not known:  # any other role is named: [ROLE]name[/ROLE]text</s>
        ids += bpe.encode(escape(role)) + (RESERVED + 7).to_bytes(4, "little")
    start = len(ids) // 4
    ids += body
    end = len(ids) // 4
    ids += b"".join((RESERVED + i).to_bytes(4, "little") for i in tail)
    return ids, start, (end if role == "assistant" else start)


def encode_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", folder: str | None = None) -> DataFrame:
    """(conv, turn, ids, loss_start, loss_end, n_tokens) per row; each row by itself, so a
    long conversation or a common text is no burden to one task."""
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv, turn)]

    def run(batches):
        bpe = open_bpe(folder)
        for b in batches:
            parts = [_splice(r.as_py() or "", t.as_py() or "", bpe) for r, t in zip(b.column(2), b.column(3))]
            ids, lo, hi = (list(x) for x in zip(*parts)) if parts else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                 pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=["conv", "turn", "ids", "loss_start", "loss_end", "n_tokens"])

    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, ids binary, loss_start int, loss_end int, n_tokens bigint")


def in_order(segments: DataFrame) -> DataFrame:
    """Segments of a conversation together and in order. Rows of one turn number order by their
    ids, so equal rows are interchangeable. Sorting spills; no conversation is held in memory."""
    return segments.repartition(partitions(segments.sparkSession), "conv").sortWithinPartitions("conv", "turn", "ids")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per turn: conv, turn, ids, token_start, loss_start, loss_end.

    ``token_start`` is the segment's place in its conversation and the loss span is
    absolute there; both are prefix sums over the turns before. Joining the ids of a
    conversation in order gives its formatted tokens. A null role is the empty role, a
    null text the empty text; a null conversation id is a conversation of its own; a
    null turn comes first; an empty table gives no rows; other columns are not read.
    """
    segments = in_order(encode_turns(turns, conv, turn, role, text, folder))
    fields = segments.schema

    def run(batches):
        last, at = object(), 0
        for b in batches:
            starts = []
            for c, n in zip(b.column("conv").to_pylist(), b.column("n_tokens").to_pylist()):
                if c != last:
                    last, at = c, 0
                starts.append(at)
                at += n
            place = np.asarray(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("turn"), b.column("ids"), pa.array(place, pa.int64()),
                 pa.array(place + b.column("loss_start").to_numpy(), pa.int64()), pa.array(place + b.column("loss_end").to_numpy(), pa.int64())],
                names=["conv", "turn", "ids", "token_start", "loss_start", "loss_end"])

    c, t = (fields[x].dataType.simpleString() for x in ("conv", "turn"))
    return segments.mapInArrow(run, f"conv {c}, turn {t}, ids binary, token_start bigint, loss_start bigint, loss_end bigint")


def _read_segment(ids: np.ndarray, pieces: list[bytes]) -> tuple[str, str, int]:
    """Role, text and formatted characters of a segment, from its ids alone."""
    marks = np.flatnonzero(ids >= RESERVED)
    kinds = (ids[marks] - RESERVED).tolist()
    bounds = zip([0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])
    held = [b"".join([pieces[i] for i in ids[a:b].tolist()]).decode() for a, b in bounds]  # still escaped
    chars = sum(map(len, held)) + sum(len(CONTROLS[k]) for k in kinds)
    if kinds[0] == 6:
        return unescape(held[1]), unescape(held[2]), chars
    if kinds[0] == 0:
        return ("user" if kinds[1] == 2 else "system"), unescape(held[2]), chars
    return "assistant", unescape(held[0]), chars


def read_back(formatted: DataFrame, folder: str | None = None) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Read from the ids and spans only: roles from the reserved ids, texts by decoding what
    lies between them, the loss text from the loss spans, characters from the texts as they
    stand, still escaped, and the control strings of the reserved ids. Digests run along the sorted
    rows and hold one segment at a time.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    rows = formatted.repartition(partitions(formatted.sparkSession), "conv").sortWithinPartitions("conv", "token_start")

    def run(batches):
        bpe = open_bpe(folder)
        pieces = bpe.decoder()
        last, state, done = None, None, []

        def close():
            turns, n, loss, loss_n, chars = state
            done.append((last, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        for b in batches:
            for c, raw, at, lo, hi in zip(*(b.column(x).to_pylist() for x in ("conv", "ids", "token_start", "loss_start", "loss_end"))):
                if state is None or c != last:
                    if state is not None:
                        close()
                    last, state = c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = np.frombuffer(raw, "<u4")
                role, text, chars = _read_segment(ids, pieces)
                state[0].update(f"{role}\n{text}\n".encode())
                state[1] += 1
                learnt = unescape(b"".join([pieces[i] for i in ids[lo - at : hi - at].tolist()]).decode())
                state[2].update(learnt.encode())
                state[3] += len(learnt)
                state[4] += chars
            yield flush(done, kind)
            done = []
        if state is not None:
            close()
            yield flush(done, kind)

    def flush(rows, kind):
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [_ARROW.get(kind, pa.string()), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _chars(column: str) -> str:
    escaped = f"replace({column}, '\\', '\\0')"
    for i, c in enumerate(CONTROLS):
        escaped = f"replace({escaped}, '{c}', '\\{i + 1}{c[1:]}')"
    return f"length({escaped})"


_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({_chars('text')} + case role when 'user' then 16 when 'assistant' then 4 when 'system' then 14 else 17 + {_chars('role')} end) as bigint) as formatted_chars
from t group by conv_id
"""


@query("op10_chat_formatting", _SQL)
def op10_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    planted = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_chats(turns)).withColumnRenamed("conv", "conv_id")
