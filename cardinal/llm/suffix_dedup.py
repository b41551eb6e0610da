"""Removal of long repeated byte strings between documents, with suffix arrays of shards.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Texts are UTF-8
bytes; strings never cross documents and are judged on the input.

1. Equal texts form a class; of those, all but the smallest id lose every byte (if they have `length` at least).
2. Each window of `length` bytes has an anchor: the 24-byte gram in it with the least hash. Equal windows have equal
   anchors, so anchors that occur in one class only can't hold a repeat. Anchor hashes are dealt out, packed, to find
   those that several classes share.
3. Runs of windows with the same shared anchor are cut out as segments and dealt out by anchor, packed, so that all equal
   windows meet in one shard. Each shard's suffix array is built by induced sorting; permuted common prefixes of `length`
   bytes at least join it into groups of equal windows, and each group gives its least id, hence the windows to be removed.
4. An anchor that HOT_DOCUMENTS documents have is not put into one shard: the least ids of its windows come from an
   aggregation by 128-bit window hash, with partial sums before the shuffle.
5. The removed windows go back to their documents, and each text is cut.

Edge cases: null or empty texts have no bytes; rows with a null id are kept whole and remove nothing; rows with equal ids
don't remove bytes of each other; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import by_unit, map_batches, mix, prefix_sums, segment_hashes, text_column, text_slices, unit_of, units_for
from cardinal.llm.staging import dropped, join_split, staged
from cardinal.llm.suffix_array import common_prefixes, suffix_array

GRAM = 24
#: Windows of a segment; one bit of a verdict for each.
MOST_WINDOWS = 48
SHARD_BYTES = 1 << 20
#: Bytes of text for each unit of anchors or segments; a task takes unit after unit.
UNIT_BYTES = 8 << 20
#: Anchors that more documents than this have are aggregated window by window.
HOT_DOCUMENTS = 50_000

_U = np.uint64


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first window, windows) of runs of windows with one anchor, and the prefix sums."""
    sums = prefix_sums(raw)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none, sums
    gram = min(GRAM, length)
    starts = np.arange(len(raw) - gram + 1)
    least, span, want = segment_hashes(sums, starts, starts + gram), 1, length - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = np.arange(len(least))
    doc = np.searchsorted(offsets, at, "right") - 1
    valid = at + length <= offsets[doc + 1]
    at, doc, least = at[valid], doc[valid], least[valid]
    if not len(at):
        return none, none.astype(np.uint64), none, none, sums
    fresh = np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    if count.max() > MOST_WINDOWS:
        pieces = -(-count // MOST_WINDOWS)
        extra = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = np.repeat(first, pieces) + extra * MOST_WINDOWS, np.repeat(count, pieces) - extra * MOST_WINDOWS
        count = np.minimum(left, MOST_WINDOWS)
    return doc[first], least[first], at[first], count, sums


def _joined(rows: list[tuple], kinds: tuple) -> list[np.ndarray]:
    """The packed columns after the unit, each as one array."""
    return [np.concatenate([np.frombuffer(r[k], kind) for r in rows]) for k, kind in enumerate(kinds, 1)]


def _sent(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    out = _split(part, columns)
    return pa.RecordBatch.from_arrays([pa.array(out["unit"]), *(pa.array(out[c], pa.binary()) for c in columns)], ["unit", *columns])


def _split(part: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
    """One row for each part, with the packed values of its entries."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    out: dict = {"unit": part[cuts[:-1]].astype(np.int64)}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def shared_anchors(rows: DataFrame, length: int, hot_documents: int, size: int) -> DataFrame:
    """(id, h, anchors, hot): packed anchors of a text that another text has too; hot ones apart. size: bytes of all texts."""
    units = units_for(rows.sparkSession, size, UNIT_BYTES)

    def emit(batch):
        for first, end, raw, offsets in text_slices(batch.column(2)):
            ids, h = (batch.column(k).slice(first, end - first).to_numpy(zero_copy_only=False) for k in (0, 1))
            doc, anchor, _, _, _ = anchor_runs(raw, offsets, length)
            if not len(doc):
                continue
            # Of equal texts in a slice, the one with the smallest id speaks for all; equal anchors of a text count once.
            order = np.lexsort((ids, h))
            copy = np.zeros(len(ids), bool)
            copy[order[1:]] = h[order[1:]] == h[order[:-1]]
            keep = ~copy[doc]
            doc, anchor = doc[keep], anchor[keep]
            _, once = np.unique(mix(anchor ^ mix(doc.astype(np.uint64) + _U(17))), return_index=True)
            once.sort()
            doc, anchor = doc[once], anchor[once]
            if len(doc):
                yield _split(unit_of(mix(anchor), units), {"anchors": anchor, "ids": ids[doc].astype(np.int64), "h": h[doc].astype(np.int64)})

    def meet(unit: int, packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, ids, h = _joined(packed, (np.uint64, np.int64, np.int64))
        order = np.argsort(anchor, kind="stable")
        anchor, ids, h = anchor[order], ids[order], h[order]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(first, len(anchor)))
        several = np.repeat(np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first), size)
        hot = np.repeat(size > hot_documents, size)[several]
        anchor, ids, h = anchor[several], ids[several], h[several]
        if len(anchor):
            yield _sent(unit_of(mix(ids.view(np.uint64) + _U(29)), units), {"anchors": anchor, "hot": hot, "ids": ids, "h": h})

    def gather(unit: int, packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, hot, ids, h = _joined(packed, (np.uint64, bool, np.int64, np.int64))
        order = np.lexsort((h, ids))
        anchor, hot, ids, h = anchor[order], hot[order], ids[order], h[order]
        cuts = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]))), len(ids))
        for at in range(0, len(cuts) - 1, 1024):
            ends = cuts[at : at + 1025]
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            plain, often = ([anchor[a:b][hot[a:b] == want].tobytes() for a, b in spans] for want in (False, True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]]), pa.array(h[ends[:-1]]), pa.array(plain, pa.binary()), pa.array(often, pa.binary())], ["id", "h", "anchors", "hot"])

    dealt = map_batches(rows, emit, "unit bigint, anchors binary, ids binary, h binary")
    met = by_unit(dealt, "unit", meet, "unit bigint, anchors binary, hot binary, ids binary, h binary")
    return by_unit(met, "unit", gather, "id bigint, h bigint, anchors binary, hot binary")


def _flagged(column: pa.Array, first: int, end: int) -> np.ndarray:
    """Keys of (row, anchor) for packed anchors."""
    out = []
    for row, blob in enumerate(column.slice(first, end - first).to_pylist()):
        own = np.frombuffer(blob, np.uint64)
        out.append(mix(own ^ mix(np.full(len(own), row, np.uint64) + _U(17))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _flagged_runs(batch: pa.RecordBatch, length: int, column: int) -> Iterator[tuple]:
    """Per slice: (ids, h, offsets, bytes, document, anchor, start, windows, prefix sums) of the runs whose anchor is in the column."""
    for first, end, raw, offsets in text_slices(batch.column(2)):
        flagged = _flagged(batch.column(column), first, end)
        if not len(flagged):
            continue
        ids, h = (batch.column(k).slice(first, end - first).to_numpy(zero_copy_only=False) for k in (0, 1))
        doc, anchor, start, count, sums = anchor_runs(raw, offsets, length)
        at = np.flatnonzero(np.isin(mix(anchor ^ mix(doc.astype(np.uint64) + _U(17))), flagged))
        if len(at):
            yield ids, h, offsets, raw, doc[at], anchor[at], start[at], count[at], sums


def _bodies(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start:start + size] of all, one after another."""
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _first_of(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.append(True, (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]))


def resolved(rows: DataFrame, length: int, size: int) -> DataFrame:
    """(id, h, starts, bits): packed window starts and bits of the runs that a smaller id has too. Segments go to their shard packed; of equal ones in a slice only one has its bytes. size: bytes of all texts."""
    units = units_for(rows.sparkSession, size, UNIT_BYTES)

    def emit(batch):
        for ids, h, offsets, raw, doc, anchor, start, count, sums in _flagged_runs(batch, length, 3):
            key = mix(segment_hashes(sums, start, start + count + length - 1) + _U(5))
            unit = unit_of(mix(anchor + _U(3)), units)
            order = np.lexsort((ids[doc], key, anchor, unit))
            doc, anchor, start, count, key, unit = (x[order] for x in (doc, anchor, start, count, key, unit))
            first = _first_of(anchor, key)
            out = _split(unit, {"anchors": anchor, "keys": key, "ids": ids[doc].astype(np.int64), "h": h[doc].astype(np.int64), "starts": (start - offsets[doc]).astype(np.int32), "windows": count.astype(np.uint8)})
            cuts = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
            out["bytes"] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(a, b)[first[a:b]]
                out["bytes"].append(_bodies(raw, start[at], count[at] + length - 1).tobytes())
            yield out

    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8)

    def shard(unit: int, packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        where, base = [], 0
        for row in packed:
            own = [np.frombuffer(row[k], kind) for k, kind in ((1, np.uint64), (2, np.uint64), (6, np.uint8))]
            sizes = np.where(_first_of(own[0], own[1]), own[2].astype(np.int64) + length - 1, 0)
            ends = np.cumsum(sizes)
            where.append(np.where(sizes > 0, base + ends - sizes, -1))
            base += int(ends[-1])
        where, body = np.concatenate(where), np.frombuffer(b"".join(row[7] for row in packed), np.uint8)
        anchor, key, ids, h, starts, count = _joined(packed, kinds)
        packed.clear()
        order = np.lexsort((where < 0, ids, key, anchor))  # of equal segments, the one with the least id comes first, and it has its bytes
        anchor, key, ids, h, starts, count, where = (x[order] for x in (anchor, key, ids, h, starts, count, where))
        first = np.flatnonzero(_first_of(anchor, key))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        sizes = count[first].astype(np.int64) + length - 1
        reach = np.cumsum(sizes)
        fresh = np.flatnonzero(np.append(True, anchor[first][1:] != anchor[first][:-1]))
        at = 0
        while at < len(first):
            far = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SHARD_BYTES, "right"))
            later = np.searchsorted(fresh, max(far, at + 1), "left")
            until = int(fresh[later]) if later < len(fresh) else len(first)
            least = flat_least_ids(_bodies(body, where[first[at:until]], sizes[at:until]), sizes[at:until], ids[first[at:until]], length)
            begin = np.cumsum(sizes[at:until]) - sizes[at:until]
            low, high = first[at], first[until] if until < len(first) else len(key)
            bits = np.zeros(high - low, np.int64)
            own = group[low:high] - at
            for k in range(MOST_WINDOWS):
                wide = np.flatnonzero(count[low:high] > k)
                if not len(wide):
                    break
                gone = least[begin[own[wide]] + k] < ids[low:high][wide]
                bits[wide[gone]] |= np.int64(1) << np.int64(k)
            kept = np.flatnonzero(bits) + low
            if len(kept):
                yield _sent(unit_of(mix(ids[kept].view(np.uint64) + _U(29)), units), {"ids": ids[kept], "h": h[kept], "starts": starts[kept], "bits": bits[kept - low]})
            at = until

    def gather(unit: int, packed: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from _by_text(*_joined(packed, (np.int64, np.int64, np.int32, np.int64)))

    sent = map_batches(rows, emit, "unit bigint, anchors binary, keys binary, ids binary, h binary, starts binary, windows binary, bytes binary")
    met = by_unit(sent, "unit", shard, "unit bigint, ids binary, h binary, starts binary, bits binary")
    return by_unit(met, "unit", gather, "id bigint, h bigint, starts binary, bits binary")


def _by_text(ids: np.ndarray, h: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each text, with its packed starts and bits."""
    order = np.lexsort((starts, h, ids))
    ids, h, starts, bits = ids[order], h[order], starts[order], bits[order]
    cuts = np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]))), len(ids))
    for at in range(0, len(cuts) - 1, 1024):
        ends = cuts[at : at + 1025]
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        blobs = [[x[a:b].tobytes() for a, b in spans] for x in (starts, bits)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[ends[:-1]]), pa.array(h[ends[:-1]]), *(pa.array(b, pa.binary()) for b in blobs)], ["id", "h", "starts", "bits"])


def hot_windows(rows: DataFrame, length: int) -> DataFrame:
    """(window, id, h, start) for each window of a hot anchor."""

    def kernel(batch):
        for ids, h, offsets, raw, doc, _, start, count, sums in _flagged_runs(batch, length, 4):
            more = prefix_sums(raw, again=True)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at, doc = np.repeat(start, count) + step, np.repeat(doc, count)
            for k in range(0, len(at), 1 << 15):
                a, d = at[k : k + (1 << 15)], doc[k : k + (1 << 15)]
                yield {"window": segment_hashes(sums, a, a + length).view(np.int64), "check": segment_hashes(more, a, a + length).view(np.int64), "id": ids[d], "h": h[d], "start": a - offsets[d]}

    return map_batches(rows, kernel, "window bigint, check bigint, id bigint, h bigint, start int")


def resolved_hot(rows: DataFrame, length: int) -> DataFrame:
    """The same as resolved() for hot anchors: the least id of each window is found by partial aggregation, so that no task sees all rows of a window."""
    at = hot_windows(rows, length)
    least = at.groupBy("window", "check").agg(F.min("id").alias("least"))
    gone = at.join(least, ["window", "check"]).where("id > least").select("id", "h", "start")
    packed = gone.groupBy("id", "h").agg(F.collect_list("start").alias("at"))

    def kernel(batch):
        starts = [np.array(x, np.int32) for x in batch.column(2).to_pylist()]
        yield {"id": batch.column(0), "h": batch.column(1), "starts": [x.tobytes() for x in starts], "bits": [np.ones(len(x), np.int64).tobytes() for x in starts]}

    return map_batches(packed, kernel, "id bigint, h bigint, starts binary, bits binary")


def flat_least_ids(body: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the texts (one after another, of the given sizes) at which a window starts: the least id of the texts that hold the same window."""
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(body)) + owner  # a separator follows each text
    raw = np.full(len(body) + len(size), 0xFF, np.uint8)
    raw[place] = body
    letters = np.zeros(len(raw), np.uint16)
    letters[place] = body.astype(np.uint16) + 1
    order = suffix_array(letters, 257)
    shared = common_prefixes(raw, order, length) >= length
    whole = np.zeros(len(raw), bool)
    whole[place] = np.arange(len(body)) + length <= (begin + size)[owner]
    text_of = np.zeros(len(raw), np.int64)
    text_of[place] = owner
    order = order[whole[order]]
    out = np.zeros(len(raw), np.int64)
    if len(order):
        first = np.flatnonzero(~shared[order] | (np.arange(len(order)) == 0))
        least = np.minimum.reduceat(ids[text_of[order]], first)
        out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out[place]


def removed_runs(n: int, starts: bytes | None, bits: bytes | None, copy: bool, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    if copy:
        return [(0, n)] if n >= length else []
    if not starts:
        return []
    at, bits = np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(bits, np.int64)
    row, window = np.nonzero((bits[:, None] >> np.arange(MOST_WINDOWS)) & 1)
    window = np.unique(at[row] + window)
    first = np.flatnonzero(np.append(True, window[1:] > window[:-1] + length))
    last = np.append(first[1:] - 1, len(window) - 1)
    return list(zip(window[first].tolist(), (window[last] + length).tolist(), strict=True))


def _merged(starts: DataFrame) -> DataFrame:
    """One row for each text; there are two at most."""
    both = starts.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("starts", "bits"))).alias("all"))
    join = lambda c: F.reduce(F.transform("all", lambda x: x[c]), F.lit(b""), lambda a, b: F.concat(a, b))
    return both.select("id", "h", join("starts").alias("starts"), join("bits").alias("bits"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """(id, h, text, starts, bits, copy) for each row, ready for removed_runs()."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_column(text_col)).alias("h"), text_column(text_col).alias("text"))
    digests = staged(rows.where("id is not null").select("id", "h", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("size")))
    size = digests.agg(F.sum("size")).first()[0] or 0
    least = staged(digests.groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first"))
    copies = staged(join_split(digests.select("id", "h", "d"), least, ["d"]).where("id > first").select("id", "h").distinct().withColumn("copy", F.lit(True)))
    dropped(digests, least)

    long = rows.where(f"id is not null and octet_length(text) >= {length}")
    shared = staged(shared_anchors(long, length, hot_documents, size).join(copies, ["id", "h"], "left_anti"))
    flagged = long.join(shared, ["id", "h"]).select("id", "h", "text", "anchors", "hot")
    starts = staged(resolved(flagged, length, size))
    if not shared.where("octet_length(hot) > 0").isEmpty():
        starts = starts.unionByName(staged(resolved_hot(flagged.where("octet_length(hot) > 0"), length)))
        starts = _merged(starts)
    dropped(shared)
    known = starts.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "h", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("bits"), "copy"))
    return rows.join(known, ["id", "h"], "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""

    def kernel(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, starts, bits, copy in zip(batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            raw = text.as_buffer().to_pybytes()
            runs = removed_runs(len(raw), starts, bits, bool(copy), length)
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            for name, value in zip(out, (len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()), strict=True):
                out[name].append(value)
        yield {id_col: batch.column(0), **out}

    found = find_repeats(docs, id_col, text_col, length).select("id", "text", "starts", "bits", "copy")
    return map_batches(found, kernel, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, text) with the repeated bytes removed; a character that was cut in part is replaced by U+FFFD."""

    def kernel(batch):
        texts = []
        for text, starts, bits, copy in zip(batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            raw, kept, at = text.as_buffer().to_pybytes(), [], 0
            for a, b in removed_runs(len(raw), starts, bits, bool(copy), length):
                kept.append(raw[at:a])
                at = b
            texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        yield {id_col: batch.column(0), "text": texts}

    found = find_repeats(docs, id_col, text_col, length).select("id", "text", "starts", "bits", "copy")
    return map_batches(found, kernel, f"`{id_col}` bigint, text string")
