"""Quality rules as a short-circuit cascade.

Word and line measures are taken of every text. The rules are then tried one after another on the documents that are
still alive; their order comes from a sample, on which each rule's cost and rejections are measured: the rule with the
most rejections for its cost goes first. The order changes the time, never the verdict.

Edge cases: a null or empty text has no words and fails the base rule; ties in the order go by rule name; repeated rows
give repeated results; only the id and the text are read; an empty table keeps the rules in their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import map_batches, mix, per_document, prefix_sums, repeated, segment_hashes, small_batches, text_column, text_slices, word_bounds

#: Documents (about) on which cost and selectivity are measured. They decide the order of the rules, nothing else.
SAMPLE_DOCUMENTS = 256
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_LETTERED = regex.compile(rb"[^\x20\x09-\x0D]*?[A-Za-z\x80-\xFF][^\x20\x09-\x0D]*")


@dataclass
class Measures:
    """One entry for each document."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def measure(raw: np.ndarray, offsets: np.ndarray) -> Measures:
    """The base measures of the documents raw[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    if not len(raw):
        return Measures(*(np.zeros(n, np.int64) for _ in range(6)))
    starts, ends = word_bounds(raw, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(owner, minlength=n).astype(np.int64)
    sums = prefix_sums(raw)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    word_chars = np.bincount(owner, heads[ends] - heads[starts], n).astype(np.int64)

    breaks = np.flatnonzero(raw == 10)
    first = np.union1d(offsets[:-1], breaks + 1)
    first = first[first < len(raw)]
    line_owner = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, first, "left")], offsets[line_owner + 1])
    worded = np.searchsorted(starts, last, "left") > np.searchsorted(starts, first, "left")
    first, last, line_owner = first[worded], last[worded], line_owner[worded]
    _, later = repeated(line_owner, segment_hashes(sums, first, last))

    repeats = np.zeros(len(starts), bool)
    if len(starts) > 2:
        w = segment_hashes(sums, starts, ends)
        inside = owner[2:] == owner[:-2]
        windows = mix(w[:-2] * np.uint64(3) + mix(w[1:-1] * np.uint64(5) + mix(w[2:])))
        at = np.flatnonzero(inside)
        twice, _ = repeated(owner[at], windows[at])
        at = at[twice]
        for k in range(3):
            repeats[at + k] = True
    return Measures(
        n_words, word_chars, per_document(_SYMBOL[raw], offsets), np.bincount(line_owner, minlength=n).astype(np.int64),
        np.bincount(line_owner[later], minlength=n).astype(np.int64), np.bincount(owner[repeats], minlength=n).astype(np.int64),
    )


@dataclass(frozen=True)
class Rule:
    """rejects(measures, rows, text_of) says for each of the rows whether it goes."""

    name: str
    rejects: Callable[[Measures, np.ndarray, Callable[[int], bytes]], np.ndarray]


def _capitals(m: Measures, rows: np.ndarray, text_of) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, row in enumerate(rows):
        text = text_of(row)
        large = len(text) - len(text.translate(None, _CAPITALS))
        out[k] = large > len(text) - len(text.translate(None, _SMALL))
    return out


def _letterless(m: Measures, rows: np.ndarray, text_of) -> np.ndarray:
    found = np.array([sum(1 for _ in _LETTERED.finditer(text_of(row))) for row in rows], np.int64)
    return 10 * (m.n_words[rows] - found) > 6 * m.n_words[rows]


RULES = (
    Rule("mean_word_length", lambda m, rows, _: (m.word_chars[rows] < 2 * m.n_words[rows]) | (m.word_chars[rows] > 25 * m.n_words[rows])),
    Rule("symbols", lambda m, rows, _: 4 * m.n_symbols[rows] > m.n_words[rows]),
    Rule("duplicate_lines", lambda m, rows, _: 2 * m.n_dup_lines[rows] > m.n_lines[rows]),
    Rule("capitals", _capitals),
    Rule("letterless_words", _letterless),
)


def base_failed(m: Measures) -> np.ndarray:
    return (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > 50 * m.n_words)


def _text_of(raw: np.ndarray, offsets: np.ndarray) -> Callable[[int], bytes]:
    return lambda row: raw[offsets[row] : offsets[row + 1]].tobytes()


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Rule names by rejections per second, measured on about SAMPLE_DOCUMENTS documents."""
    step = max(1, docs.count() // SAMPLE_DOCUMENTS)
    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).select(text_column(text_col).alias("__text"))

    def kernel(batch):
        for _, _, raw, offsets in text_slices(batch.column(0)):
            m = measure(raw, offsets)
            rows = np.flatnonzero(~base_failed(m))
            names, cost, gone = [], [], []
            for rule in rules:
                began = time.perf_counter()
                gone.append(int(rule.rejects(m, rows, _text_of(raw, offsets)).sum()))
                cost.append(time.perf_counter() - began)
                names.append(rule.name)
            yield {"rule": names, "cost": cost, "gone": gone}

    found = map_batches(sample, kernel, "rule string, cost double, gone bigint").groupBy("rule").agg(F.sum("cost"), F.sum("gone")).collect()
    value = {r[0]: r[2] / max(r[1], 1e-9) for r in found}
    return [r.name for r in sorted(rules, key=lambda r: (-value.get(r.name, 0.0), r.name))] if value else [r.name for r in rules]


def cascade(m: Measures, rules: list[Rule], text_of) -> np.ndarray:
    """Which documents pass: each rule sees only what those before it have left."""
    alive = np.flatnonzero(~base_failed(m))
    for rule in rules:
        if not len(alive):
            break
        alive = alive[~rule.rejects(m, alive, text_of)]
    kept = np.zeros(len(m.n_words), bool)
    kept[alive] = True
    return kept


def _ordered(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[x] for x in rule_order(docs, rules, id_col, text_col)]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, the base measures, base_failed and kept for each row."""
    ordered = _ordered(docs, id_col, text_col, rules)

    def kernel(batch):
        for first, end, raw, offsets in text_slices(batch.column(1)):
            m = measure(raw, offsets)
            yield {
                id_col: batch.column(0).slice(first, end - first), "n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols,
                "n_dup_lines": m.n_dup_lines, "n_repeat_words": m.n_repeat_words, "base_failed": base_failed(m), "kept": cascade(m, ordered, _text_of(raw, offsets)),
            }

    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    return map_batches(docs.select(id_col, text_column(text_col).alias("__text")), kernel, f"`{id_col}` {kind}, {columns}")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    ordered = _ordered(docs, id_col, text_col, rules)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).fill_null("") if batch.column(at).null_count else batch.column(at)
            kept = [cascade(measure(raw, offsets), ordered, _text_of(raw, offsets)) for _, _, raw, offsets in text_slices(texts)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
