"""Chat formatting by event-sourced reconstruction.

The log is dealt out by conversation and sorted by sequence; a fold turns messages, streamed deltas, edits and
regenerations into final messages, which are then rendered with turn markers. A control string inside a text is escaped
so that parsing the output gives back every text exactly. The loss mask holds the spans of the assistant's texts.

Events (a log without an event column has messages only):
message: a new message; delta: goes to the end of the target message, or of the last one; edit: takes the place of the
target's text; regenerate: takes the place of the last assistant message and drops what followed it; delete: drops the
target. target is the sequence number of the message's first event; an unknown target makes a delta or edit a message.

Edge cases: a null text or role counts as empty; a null sequence number sorts first; equal sequence numbers go by role,
then text; repeated rows are repeated messages; rows with a null conversation form one; other columns are ignored; an
empty log gives an empty table. A conversation's output is one string, so a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import shuffle_partitions

TURN, BODY, END = "<|turn|>", "\n", "<|end|>\n"
_PARSE = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PLAIN = {"l": "<", "n": "\n", "\\": "\\"}
OUTPUT_ROWS = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\l|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def render(messages: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans in code points)."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{TURN}{escape(role).replace(chr(10), '\\n')}{BODY}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(formatted)]


class Fold:
    """Final messages of one conversation, event by event."""

    def __init__(self):
        self.messages: dict[object, list] = {}

    def take(self, seq, event: str, role: str, text: str, target) -> None:
        if event == "delta":
            key = target if target in self.messages else next(reversed(self.messages), None) if target is None else None
            if key is not None and key in self.messages:
                self.messages[key][1].append(text)
                return
        elif event == "edit" and target in self.messages:
            self.messages[target][1] = [text]
            return
        elif event == "delete":
            self.messages.pop(target, None)
            return
        elif event == "regenerate":
            keys = list(self.messages)
            last = next((k for k in reversed(keys) if self.messages[k][0] == "assistant"), None)
            if last is not None:
                for k in keys[keys.index(last) :]:
                    del self.messages[k]
            role = role or "assistant"
        key = seq
        while key in self.messages:  # a tie: a message of its own
            key = (key,)
        self.messages[key] = [role, [text]]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def format_conversations(log: DataFrame, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", event_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """conversation id, formatted string, loss_spans array<struct<start,end>>."""
    kind = log.schema[conv_col].dataType.simpleString()
    rows = log.select(
        F.col(conv_col).alias("__c"), F.col(seq_col).alias("__s"), F.coalesce(F.col(role_col), F.lit("")).alias("__r"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"),
        (F.coalesce(F.col(event_col), F.lit("message")) if event_col else F.lit("message")).alias("__e"), (F.col(target_col) if target_col else F.lit(None).cast("bigint")).alias("__g"),
    )
    dealt = rows.repartition(shuffle_partitions(log.sparkSession), "__c").sortWithinPartitions("__c", "__s", "__r", "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spans_type = [conv_col, "formatted", "loss_spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        done: list[tuple] = []
        fold, key, id_type = None, None, None

        def batch_of(done):
            ids, texts, spans = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], spans_type)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, s, r, t, e, g in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if fold is None or c != key:
                    if fold is not None:
                        done.append((key, *render(fold.final())))
                        if len(done) >= OUTPUT_ROWS:
                            yield batch_of(done)
                            done = []
                    fold, key = Fold(), c
                fold.take(s, e, r, t, g)
        if fold is not None:
            done.append((key, *render(fold.final())))
        if done:
            yield batch_of(done)

    return dealt.mapInArrow(run, f"`{conv_col}` {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Reads the output back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for each conversation."""
    from cardinal.llm.columnar import map_batches

    def kernel(batch):
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        yield {conv_col: batch.column(0), **out}

    kind = formatted.schema[conv_col].dataType.simpleString()
    return map_batches(formatted, kernel, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
