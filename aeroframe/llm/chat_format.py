"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts a backslash becomes two and ``<|`` becomes ``<\\|`` (in roles a newline
becomes ``\\n``), so no control string can come from a text, and reading back is
exact.

A conversation is cut into turn-aligned spans by the prefix sums of its turns'
tokens: a turn's span is the number of whole half capacities before it, and a
turn longer than half the capacity has a span of its own. Half a capacity plus a
turn of half a capacity at most keeps a span within the capacity, which is the
budget less the system turn and the room for history; only a single turn that is
longer than that exceeds it. A window is the conversation's system turn, then up
to ``history_turns`` turns that stand before the span and fit the room for
history, then the span. The loss covers the assistant texts of the span;
repeated turns, assistant ones too, are masked, so each assistant text is a
target once.

Prefix sums are taken in two levels, over blocks of turns and inside a block, and
windows are built span by span, so a conversation with a third of all rows is
shared by many tasks; nothing larger than a window is gathered.

Defined results: null text or role is empty; turns are ordered by turn (null
last), role and text, repeated rows are repeated turns; rows without a
conversation id are one conversation with a null id; a turn longer than the budget
is a window of its own, whole; columns other than conversation, turn, role and text
play no part, whatever their names; an empty table gives an empty table. The digest
of a conversation is one hash over all its turns in order, which one task computes.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

BUDGET = 2048
HISTORY_TOKENS, HISTORY_TURNS = 256, 2
BLOCK_TURNS = 64
OVERHEAD = 5
NO_ID = -(2**63)
START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_tokens(rows: DataFrame) -> DataFrame:
    """Adds ``tokens``: the byte-level BPE length of the escaped text, plus the template's."""
    from .bpe import default_vocabulary, loaded

    path, pattern = default_vocabulary()
    at = rows.columns.index("text")

    @tidy
    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            n = [len(bpe.encode(escape(t))) // 4 + OVERHEAD for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "tokens"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType())]))


def placed(rows: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Adds pos (from 0), start (tokens before it), part and long (its span), by two-level prefix sums."""
    in_order = [F.col("turn").asc_nulls_last(), "role", "text"]
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)).cast("long"))
    first_system = F.min(F.when(F.col("role") == "system", F.struct(F.coalesce("turn", F.lit(2**62)).alias("turn"), "text", "tokens")))
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), first_system.alias("sys"))
    over = Window.partitionBy("conv").orderBy("block")
    before, whole = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"), F.min("sys").over(whole).alias("sys")
    )
    inner = Window.partitionBy("conv", "block").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(blocks, ["conv", "block"])
    rows = rows.withColumns({"pos": F.col("n_before") + F.row_number().over(Window.partitionBy("conv", "block").orderBy(*in_order)) - 1, "start": F.col("t_before") + F.sum("tokens").over(inner) - F.col("tokens")})
    half = F.greatest(F.floor((F.lit(budget - history_tokens) - F.coalesce(F.col("sys.tokens"), F.lit(0))) / 2), F.lit(budget // 8))
    return rows.select("conv", "pos", "role", "text", "tokens", F.floor(F.col("start") / half).alias("part"), (F.col("tokens") > half).cast("int").alias("long"), F.col("sys.text").alias("sys_text"))


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per window: conv_id, window_part, window_long (their order), n_repeated turns, formatted, loss_spans (start, end in code points)."""
    from .common import materialise

    rows = turns.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = materialise(placed(turn_tokens(rows), budget, history_tokens))
    turn = F.struct("pos", "role", "text")
    own = rows.select("conv", "part", "long", F.lit(2).alias("kind"), "pos", "role", "text", "tokens", "sys_text")
    # History: the turns just before a span, counted back from it while they fit.
    spans = rows.groupBy("conv", "part", "long").agg(F.min("pos").alias("first"))
    back = spans.select("conv", "part", "long", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("back"), "first").withColumn("pos", F.col("first") - F.col("back")).where("pos >= 0")
    past = back.join(rows.select("conv", "pos", "role", "text", "tokens", "sys_text"), ["conv", "pos"])
    past = past.select("conv", "part", "long", F.lit(1).alias("kind"), "pos", "role", "text", "tokens", "sys_text")
    both = own.unionByName(past)
    packed = both.groupBy("conv", "part", "long").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "role", "text", "tokens"))).alias("turns"), F.first("sys_text").alias("sys_text"))

    def run(batches):
        for b in batches:
            n_rep, texts, loss = [], [], []
            for seen, system in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                head = [x for x in seen if x["kind"] == 1]
                body = [x for x in seen if x["kind"] == 2]
                room, kept = history_tokens, []
                for x in reversed(head):
                    room -= x["tokens"]
                    if room < 0:
                        break
                    kept.insert(0, x)
                shown = [(x["role"], x["text"], False) for x in kept] + [(x["role"], x["text"], x["role"] == "assistant") for x in body]
                n = len(kept)
                if system is not None and body[0]["pos"] > 0 and not any(r == "system" and t == system for r, t, _ in shown):
                    shown.insert(0, ("system", system, False))
                    n += 1
                out, at, spans_ = [], 0, []
                for role, text, target in shown:
                    opening, inside = f"{START}{escape(role, True)}\n", escape(text)
                    if target:
                        spans_.append({"start": at + len(opening), "end": at + len(opening) + len(inside)})
                    out.append(opening + inside + END)
                    at += len(out[-1])
                n_rep.append(n)
                texts.append("".join(out))
                loss.append(spans_)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n_rep, pa.int32()), pa.array(texts, pa.string()), pa.array(loss, kind)], ["conv", "window_part", "window_long", "n_repeated", "formatted", "loss_spans"])

    out = packed.select("conv", "part", "long", "turns", "sys_text").mapInArrow(run, "conv long, window_part long, window_long int, n_repeated int, formatted string, loss_spans array<struct<start:int,end:int>>")
    return out.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "window_part", "window_long", "n_repeated", "formatted", "loss_spans")


def read_back(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, where the text starts) of every turn of a window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in _TURN.finditer(formatted)]


def digests(wins: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows stream through in order; a task holds one window and two running digests."""
    parts = int(wins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = wins.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window_part", "window_long")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None

        def done():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

        for b in batches:
            out = []
            for conv, n_rep, text, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "n_repeated", "formatted", "loss_spans"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(text)
                for role, said, _ in read_back(text)[n_rep:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "replace"))
            if out:
                yield batch(out)
        if state is not None:
            yield batch([done()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
