"""Similarity join of documents by the Jaccard similarity of their word n-grams, with parity sketches.

Words are lower-cased (A-Z only) runs without ASCII white space; a document's set holds its distinct n-word shingles
(64-bit hashes), or the whole sequence as one shingle if it is shorter.

1. Documents with equal sets form a class; its smallest id stands for it. Copies are never paired with each other.
2. Per band of set sizes, the tokens are dealt by hash to b blocks and XORed there. Each token in one set only changes
   one block at most, so two linked sets, whose symmetric difference is at most D, agree in at least b - D blocks. b is
   D + 1 + z, where z is more than the empty blocks that a document is likely to have: then two linked sets share a
   block that isn't empty. Documents with more than z empty blocks also emit those. A set that can have smaller partners
   in the band below emits there too. So no link is lost.
3. A block that very many classes share (HOT_KEY) is left out for those documents whose hot and empty blocks together are
   at most z: their linked partners agree with them in another block as well. Only the rest stay in such a group.
4. Documents that agree in a block are paired with the smallest id there. Pairs have to pass the size bound, and their
   parity sketches (1024 bits or more, by size) may differ in at most D bits (the Hamming distance never exceeds the symmetric difference);
   only then are whole sets made and moved. Each document is tested against its smallest partner first; tests are exact.
   The links give components. Then the pairs left over, and those in a block, that still lie in several components are
   tested too, under the same bounds. Pairs within a component need no test for the components; links and link_counts
   verify those too.

Edge cases: null, empty or wordless texts have no shingles and link with nothing (component_id is the own id); a null id
is kept, with a null component_id; rows with equal ids are one node (if their texts differ, with the links of each), so
that keep_one keeps or drops them together; repeated rows give repeated results; other columns are ignored; an empty
table gives an empty table; ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import LOWER, by_unit, map_batches, mix, prefix_sums, repeated, segment_hashes, shuffle_partitions, text_column, text_slices, unit_of, units_for, word_bounds
from cardinal.llm.components import connected_components
from cardinal.llm.staging import BROADCAST_IDS, dropped, heavy_keys, join_split, small_enough, staged

#: Ratio of the largest to the smallest set size of a band.
BAND_RATIO = 1.4
SKETCH_BITS = 1024
#: Classes in a block from which it counts as hot.
HOT_KEY = 64
#: Entries that a unit of blocks has on average; a task takes unit after unit.
UNIT_ENTRIES = 1 << 18
#: Members held in one block of a group by a single task at a time, and tested against one leader.
GROUP_BLOCK, TEST_BLOCK = 512, 128
#: Sets of one component in a block where all links are wanted, and tokens counted at a time.
LINK_BLOCK, COLUMNS = 512, 8192

_U = np.uint64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each document's distinct shingles, in the order of documents."""
    raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(owner, minlength=len(offsets) - 1)
    if not len(starts):
        return owner, np.zeros(0, np.uint64)
    h = segment_hashes(prefix_sums(raw), starts, ends)
    parts_owner, parts_hash = [], []
    if len(h) >= words:
        window = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            window = mix(window * _U(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k])
        inside = owner[: len(window)] == owner[words - 1 :]
        parts_owner.append(owner[: len(window)][inside])
        parts_hash.append(mix(window[inside] + _U(words)))
    for row in np.flatnonzero((n > 0) & (n < words)):
        first = np.searchsorted(owner, row)
        value = h[first : first + 1].copy()
        for k in range(1, n[row]):
            value = mix(value * _U(0x9E3779B97F4A7C15) + h[first + k : first + k + 1])
        parts_owner.append(np.array([row]))
        parts_hash.append(mix(value + _U(int(n[row]))))
    owner, h = np.concatenate(parts_owner), np.concatenate(parts_hash)
    _, later = repeated(owner, h)
    owner, h = owner[~later], h[~later]
    order = np.argsort(owner, kind="stable")
    return owner[order], h[order]


def max_difference(total: int | np.ndarray, percent: int):
    """The largest symmetric difference of two linked sets whose sizes add up to total."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=4)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest size, blocks, z) of each band up to a set size."""
    least = [1]
    while least[-1] <= largest:
        least.append(max(least[-1] + 1, int(least[-1] * BAND_RATIO)))
    low, high = np.array(least[:-1]), np.array(least[1:]) - 1
    difference = max_difference(high + high * 100 // percent, percent)
    spare = []
    for d, n in zip(difference.tolist(), low.tolist(), strict=True):
        expected = (d + 1) * math.exp(-n / (d + 1)) if d else 0.0
        spare.append(math.ceil(expected + 5 * math.sqrt(expected)))
    spare = np.array(spare)
    return low, high, difference + 1 + spare, spare


def signatures(owner: np.ndarray, h: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, band, slack) of each block to be agreed on. slack: z less the document's empty blocks in the band."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int8)
    low, high, blocks, spare = bands(percent, 1 << int(n.max()).bit_length())
    own = np.searchsorted(low, n, "right") - 1
    out: list[list] = [[], [], [], []]
    for down in range(4):
        band = own - down
        taking = (n > 0) & (band >= 0)
        if down:
            taking &= high[np.maximum(band, 0)] * 100 >= n * percent
        if not taking.any():
            continue
        mask = taking[owner]
        o, x = owner[mask], h[mask]
        b = blocks[band[o]]
        place = (((x >> _U(32)) * b.astype(np.uint64)) >> _U(32)).astype(np.int64)
        at = o.astype(np.int64) * int(blocks.max() + 1) + place
        order = np.argsort(at, kind="stable")
        at, o, x, place = at[order], o[order], mix(x[order] + _U(0xABCD)), place[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        value, doc, place = np.bitwise_xor.reduceat(x, first), o[first], place[first]
        empty = blocks[np.maximum(band, 0)] - np.bincount(doc, minlength=len(n))
        slack = spare[np.maximum(band, 0)] - empty
        for row in np.flatnonzero(taking & (slack < 0)):
            missing = np.setdiff1d(np.arange(blocks[band[row]]), place[doc == row])
            value = np.append(value, np.zeros(len(missing), np.uint64))
            doc, place = np.append(doc, np.full(len(missing), row)), np.append(place, missing)
        key = mix(value ^ mix((band[doc].astype(np.uint64) << _U(40)) + place.astype(np.uint64) + _U(7)))
        for column, values in zip(out, (doc, key, band[doc].astype(np.int8), np.clip(slack[doc], -1, 127).astype(np.int8)), strict=True):
            column.append(values)
    doc, key, band, slack = (np.concatenate(x) for x in out)
    return doc, key, band, slack


def sketches(owner: np.ndarray, h: np.ndarray, rows: int) -> list[bytes | None]:
    """Packed parity sketch of each set, None for empty sets; owner is in order. A sketch has SKETCH_BITS bits, or twice the set's size rounded up to a power of two, so that long sets are told apart too."""
    n = np.bincount(owner, minlength=rows)
    bits = np.maximum(SKETCH_BITS, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    place = mix(h + _U(99)) & (bits[owner] - 1).astype(np.uint64)
    ends = np.cumsum(bits)
    out: list[bytes | None] = []
    first = 0
    while first < rows:  # about a million bits at a time
        end = max(first + 1, int(np.searchsorted(ends, ends[first] - bits[first] + (1 << 20), "right")))
        base = ends[first:end] - bits[first:end] - (ends[first] - bits[first])
        a, b = np.searchsorted(owner, (first, end))
        odd = np.bincount(base[owner[a:b] - first] + place[a:b].astype(np.int64), minlength=int(bits[first:end].sum())) & 1
        packed = np.packbits(odd.astype(np.uint8))
        out += [packed[x // 8 : (x + size) // 8].tobytes() if some else None for x, size, some in zip(base.tolist(), bits[first:end].tolist(), n[first:end].tolist(), strict=True)]
        first = end
    return out


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (last axis) of a smaller size: bits that fall together are XORed."""
    return sketch if sketch.shape[-1] == words else np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, words), axis=-2)


def sketch_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distance of each pair of sketches, at the smaller size of the two; never more than the sets' symmetric difference."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for a, b in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (left, right))
        words = min(x.shape[1], y.shape[1])
        out[at] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(1)
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_column(text_col).alias("text"))


def profiles(rows: DataFrame, words: int) -> DataFrame:
    """id, n, a 128-bit digest (p, q) of the set and its parity sketch for each row."""

    def kernel(batch):
        for first, end, raw, offsets in text_slices(batch.column(1)):
            owner, h = shingle_sets(raw, offsets, words)
            n, p, q = digests_of(owner, h, end - first)
            yield {"id": batch.column(0).slice(first, end - first), "n": n, "p": p, "q": q, "sketch": sketches(owner, h, end - first)}

    return map_batches(rows, kernel, "id bigint, n bigint, p bigint, q bigint, sketch binary")


def digests_of(owner: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, p and q of each set; owner is in order."""
    n = np.bincount(owner, minlength=rows)
    p, q = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(h):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        p[owner[at]] = np.add.reduceat(mix(h + _U(1)), at)
        q[owner[at]] = np.add.reduceat(mix(h + _U(2)), at)
    return n, p.view(np.int64), q.view(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences."""
    return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), kind), dtype=kind)


def agreements(rows: DataFrame, words: int, percent: int, entries: int) -> DataFrame:
    """(key, id, band, slack, lead, size, members) of blocks that two or more documents agree in: lead is the smallest id there, size the number of ids, members a hash of them all.

    Blocks go packed to units by key, with 48 bits of the key each; a unit has all of a key, so that nothing is shuffled by
    key again. entries: about how many blocks there are.
    """
    units = units_for(rows.sparkSession, entries, UNIT_ENTRIES)

    def emit(batch):
        for first, end, raw, offsets in text_slices(batch.column(1)):
            ids = batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, h = shingle_sets(raw, offsets, words)
            if not len(h):
                continue
            doc, key, band, slack = signatures(owner, h, np.bincount(owner, minlength=end - first), percent)
            unit = unit_of(key, units)
            doc = ids[doc]
            order = np.lexsort((doc, unit))
            unit, key, doc, band, slack = (x[order] for x in (unit, mix(key), doc, band, slack))
            cuts = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            low, high = key.astype(np.uint32), (key >> _U(32)).astype(np.uint16)
            yield {
                "unit": unit[cuts[:-1]],
                "keys": [low[a:b].tobytes() + high[a:b].tobytes() for a, b in spans],
                "ids": [_pack(doc[a:b]) for a, b in spans],
                "notes": [zstandard.compress(band[a:b].tobytes() + slack[a:b].tobytes(), 1) for a, b in spans],
            }

    def meet(unit: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, ids, bands_, slacks = [], [], [], []
        for _, packed, blob, notes in rows:
            m = len(packed) // 6
            keys.append(np.frombuffer(packed, np.uint32, m).astype(np.uint64) | np.frombuffer(packed, np.uint16, m, 4 * m).astype(np.uint64) << _U(32))
            ids.append(_unpack(blob, np.int64))
            notes = np.frombuffer(zstandard.decompress(notes), np.int8)
            bands_.append(notes[:m])
            slacks.append(notes[m:])
        key, doc, band, slack = (np.concatenate(x) for x in (keys, ids, bands_, slacks))
        order = np.lexsort((slack, doc, key))
        key, doc = key[order], doc[order]
        once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        order, key, doc = order[once], key[once], doc[once]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        members = np.add.reduceat(mix(doc.view(np.uint64) + _U(41)), at).view(np.int64)
        lead, members, size = (np.repeat(x, size) for x in (doc[at], members, size))
        several = size > 1
        whole = mix(key[several] + (_U(unit) << _U(48))).view(np.int64)
        columns = [whole, doc[several], band[order][several], slack[order][several], lead[several], size[several], members[several]]
        for at in range(0, len(whole), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], ["key", "id", "band", "slack", "lead", "size", "members"])

    dealt = map_batches(rows.where("id is not null"), emit, "unit bigint, keys binary, ids binary, notes binary")
    return by_unit(dealt, "unit", meet, "key bigint, id bigint, band byte, slack byte, lead bigint, size bigint, members bigint")


def token_sets(rows: DataFrame, words: int) -> DataFrame:
    """id, the set's digest p, and the set as packed sorted hashes."""

    def kernel(batch):
        for first, end, raw, offsets in text_slices(batch.column(1)):
            owner, h = shingle_sets(raw, offsets, words)
            cuts = np.searchsorted(owner, np.arange(end - first + 1))
            yield {"id": batch.column(0).slice(first, end - first), "p": digests_of(owner, h, end - first)[1], "tokens": [np.sort(h[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}

    return map_batches(rows, kernel, "id bigint, p bigint, tokens binary")


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the size bound and whose parity sketches are near enough; only sizes and sketches are moved for that. known: id, sketch, n. a may have very many partners."""
    left = known.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = known.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    met = join_split(pairs.select("a", "b").join(right, "b"), left, ["a"], heavy=heavy_keys(pairs, ["a"])).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def kernel(batch):
        if len(batch):
            near = sketch_distances(batch.column(2).to_pylist(), batch.column(3).to_pylist()) <= max_difference(batch.column(4).to_numpy(), percent)
            at = pa.array(np.flatnonzero(near))
            yield {"a": batch.column(0).take(at), "b": batch.column(1).take(at)}

    return map_batches(met.select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("total")), kernel, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. b's set goes to a, in salted groups of about TEST_BLOCK, and is tested as it streams by."""
    salts = F.broadcast(heavy_keys(pairs, ["a"], TEST_BLOCK).select("a", F.ceil(F.col("rows") / TEST_BLOCK).alias("salts")))  # HEAVY_KEYS rows at most
    count = F.coalesce("salts", F.lit(1)).cast("bigint")
    members = pairs.join(salts, "a", "left").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), count).alias("salt"), F.lit(1).alias("member"))
    leaders = pairs.select("a").distinct().join(salts, "a", "left").withColumn("salts", count)
    leaders = leaders.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    both = sets.join(small_enough(staged(leaders.unionByName(members)), BROADCAST_IDS // 4), "id").select("a", "salt", "member", "id", "tokens")  # each set moves once
    dealt = both.repartition(shuffle_partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member", "id")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, leaders = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, member, b, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                mine = np.frombuffer(tokens.as_buffer(), np.uint64)
                if (a, salt) != own:
                    own, leaders = (a, salt), []
                if not member:
                    leaders.append(mine.copy())
                elif any(_similar(x, mine, percent) for x in leaders):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(test, "a bigint, b bigint")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def pairs_across(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in the groups (key, id, label, n, sketch) that pass the size and sketch bounds; large groups go block against block."""
    counts = F.broadcast(heavy_keys(groups, ["key"]).select("key", F.ceil(F.col("rows") / GROUP_BLOCK).alias("g")))  # HEAVY_KEYS rows at most
    placed = groups.join(counts, "key", "left").withColumn("g", F.coalesce("g", F.lit(1)).cast("bigint")).withColumn("block", F.pmod(F.xxhash64("id"), "g"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "n", "sketch", "block")
    dealt = dealt.repartition(shuffle_partitions(groups.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def compare(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        ids, labels, n = (np.array([x[k] for x in group]) for k in (3, 4, 5))
        size = np.array([len(x[6]) // 8 for x in group])
        words = {m: np.frombuffer(b"".join(x[6] for x in group if len(x[6]) // 8 == m), np.uint64).reshape(-1, m) for m in set(size.tolist())}
        place = np.zeros(len(group), np.int64)  # among the sketches of its size
        for m in words:
            place[size == m] = np.arange((size == m).sum())
        i, j, block = group[0][1], group[0][2], np.array([x[7] for x in group])
        left, right = [], []
        for row in range(len(group) - 1):
            rest = slice(row + 1, None)
            near = (labels[rest] != labels[row]) & (100 * np.minimum(n[rest], n[row]) >= percent * np.maximum(n[rest], n[row]))
            if i != j:
                near &= block[rest] != block[row]
            at = np.flatnonzero(near) + row + 1
            if len(at):
                apart, own = np.zeros(len(at), np.int64), words[int(size[row])][place[row]]
                for m in set(size[at].tolist()):
                    of = size[at] == m
                    least = min(m, len(own))
                    apart[of] = np.bitwise_count(_folded(words[m][place[at[of]]], least) ^ _folded(own, least)).sum(1)
                at = at[apart <= max_difference(n[at] + n[row], percent)]
                left.append(np.full(len(at), ids[row]))
                right.append(ids[at])
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(group):
            a, b = compare(group)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield out(group)
                    group = []
                group.append(row)
        if group:
            yield out(group)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id for each row; linked if 100 * common >= percent * union."""
    known, _, component = _joined(docs, id_col, text_col, words, percent)
    return _with_components(known, component).withColumnRenamed("id", id_col)


def _with_components(known: DataFrame, component: DataFrame) -> DataFrame:
    return known.select("id", "n").join(component, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _copies(known: DataFrame) -> DataFrame:
    """(id, rep, p, q, n) of documents that aren't the first of their class."""
    keys = ["p", "q", "n"]
    full = known.where("n > 0 and id is not null").select("id", *keys)
    classes = staged(full.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    copies = staged(join_split(full, classes, keys).where("id != rep").select("id", "rep", *keys).distinct())
    dropped(classes)
    return copies


def _without_needless_hot(shared: DataFrame) -> DataFrame:
    """shared without the documents in hot blocks whose linked partners share another block with them."""
    hot = f"size > {HOT_KEY}"
    if shared.where(hot).isEmpty():
        return shared
    inside = shared.where(hot).select("key", "id", "band", "slack")
    few = inside.groupBy("id", "band").agg(F.count("*").alias("hot"), F.min("slack").alias("least")).where("hot <= least").select("id", "band")
    inside = staged(inside.join(few, ["id", "band"], "left_anti"))
    leads = staged(inside.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("size"), F.col("key").alias("members")).where("size > 1"))
    out = staged(shared.where(f"not ({hot})").unionByName(join_split(inside, leads, ["key"])))
    dropped(shared, inside, leads)
    return out


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The profiles of all rows, the copies (id, rep, p, q, n), and (id, component) of each id that isn't alone."""
    rows = _documents(docs, id_col, text_col)
    known = staged(profiles(rows, words))
    copies = _copies(known)
    entries = known.agg(F.sum("n")).first()[0] or 0
    several = known.where("n > 0 and id is not null").select("id", "p", "q", "n").distinct().groupBy("id").count().where("count > 1").select("id")
    several = staged(several)  # ids with several texts stand for themselves too
    needless = staged(copies.select("id").distinct().join(several, "id", "left_anti"))
    shared = staged(agreements(rows.join(small_enough(needless), "id", "left_anti"), words, percent, entries // 2))
    dropped(needless)
    shared = _without_needless_hot(shared)
    pairs = staged(shared.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    pairs = staged(plausible(pairs, known.select("id", "n", "sketch"), percent))

    # A member that many blocks put under several leaders is tested against the smallest first; mostly that settles it.
    sets = _sets_of(rows, pairs, words)
    firsts_of = staged(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = staged(verified(firsts_of, sets, percent))
    first = connected_components(links)
    dropped(links)
    label = lambda end: first.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    apart = join_split(pairs.join(label("b"), "b", "left"), label("a"), ["a"], "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b").join(firsts_of, ["a", "b"], "left_anti")

    # Blocks of three or more documents that still hold several components.
    # Blocks with the same documents are one.
    labelled = staged(shared.where("size > 2").select(F.col("members").alias("key"), "id").distinct().join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")))
    dropped(shared)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("key")
    groups = staged(join_split(labelled, staged(open_keys), ["key"]).join(known.select("id", "n", "sketch"), "id").select("key", "id", "label", "n", "sketch"))
    more = pairs_across(groups, percent).join(firsts_of, ["a", "b"], "left_anti")
    more = staged(more.unionByName(apart).distinct())
    dropped(groups, labelled)
    made = sets
    lacking = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct().join(sets.select("id").distinct(), "id", "left_anti")
    lacking = staged(lacking)
    if not lacking.isEmpty():
        made = sets.unionByName(token_sets(rows.join(small_enough(lacking), "id", "left_semi"), words).select("id", "tokens"))
    found = staged(verified(more, made, percent))
    dropped(sets, pairs, firsts_of, more, lacking)

    # The components of the first links are linked among themselves, then copies and ids with several texts.
    both = found.unionByName(several.join(copies, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    raised = both.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(raised)
    top = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    nodes = staged(top.unionByName(second.join(first.select("id"), "id", "left_anti")))
    dropped(found)
    copied = join_split(copies.select("id", "rep").join(nodes.select("id"), "id", "left_anti"), nodes.select(F.col("id").alias("rep"), "component"), ["rep"], "left")
    component = staged(nodes.unionByName(copied.select("id", F.coalesce("component", "rep").alias("component"))).distinct())
    return known, copies, component


def _sets_of(rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The token sets of all ends of the pairs."""
    needed = staged(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sets = staged(token_sets(rows.join(small_enough(needed), "id", "left_semi"), words).select("id", "tokens"))
    dropped(needed)
    return sets


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of sets, one in the left half and one in the other; if all are left, of all pairs once. Exact: common tokens are counted."""
    right = left if left.all() else ~left
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    size = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[count[token] > 1]
    token = (np.cumsum(count > 1) - 1)[token[count[token] > 1]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    common = np.zeros((len(rows), len(columns)))
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, (first, first + COLUMNS))
        has = np.zeros((len(sets), int(token[b - 1]) - first + 1), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        common += has[rows] @ has[columns].T
    near = (common > 0) & (100 * common >= percent * (size[rows][:, None] + size[columns] - common))
    i, j = np.nonzero(near)
    i, j = rows[i], columns[j]
    return (i[i < j], j[i < j]) if left.all() else (i, j)


def _links(docs: DataFrame, known: DataFrame, copies: DataFrame, component: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """All linked pairs (a, b) of class representatives. Linked ones lie in one component, so its sets are counted against each other, block against block."""
    keys = ["id", "p", "q", "n"]
    places = known.where("n > 0 and id is not null").select(*keys).distinct().join(copies.select(*keys), keys, "left_anti").join(component, "id")
    counts = staged(places.groupBy("component").agg(F.count("*").alias("members"), F.ceil(F.count("*") / LINK_BLOCK).alias("g")).where("members > 1"))
    places = staged(join_split(places, counts, ["component"]).select("component", "id", "p", "g"))
    needed = staged(places.select("id").distinct())
    sets = staged(token_sets(_documents(docs, id_col, text_col).join(small_enough(needed), "id", "left_semi"), words).dropDuplicates())
    placed = places.join(sets, ["id", "p"]).withColumn("block", F.pmod(F.xxhash64("id"), "g"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "tokens")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out(group):
            ids, left = np.array([x[3] for x in group]), np.array([x[4] == x[1] for x in group])
            if left.all() and group[0][1] != group[0][2] or not left.any():
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            i, j = linked_pairs([np.frombuffer(x[5], np.uint64) for x in group], left, percent)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pa.RecordBatch.from_arrays([pa.array(a[a < b], pa.int64()), pa.array(b[a < b], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield out(group)
                    group = []
                group.append(row)
        if group:
            yield out(group)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """a, b: every link between different sets, each set by the smallest id of its class, a < b."""
    known, copies, component = _joined(docs, id_col, text_col, words, percent)
    return _links(docs, known, copies, component, id_col, text_col, words, percent).distinct()


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, n_links for each row: how many other ids it's linked with, copies included. An id with several texts has the links of each."""
    known, copies, component = _joined(docs, id_col, text_col, words, percent)
    pairs = staged(_links(docs, known, copies, component, id_col, text_col, words, percent).distinct())
    size = copies.groupBy("rep").agg((F.count("*") + 1).alias("copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("with")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("with")))
    copies = copies.select("id", "rep")
    others = join_split(ends, size.withColumnRenamed("rep", "with"), ["with"], "left").groupBy("rep").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("others"))
    per_class = staged(size.join(others, "rep", "full").select("rep", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    own = per_class.select(F.col("rep").alias("id"), "links").unionByName(join_split(copies, per_class, ["rep"]).select("id", "links"))
    counted = own.groupBy("id").agg(F.sum("links").alias("n_links"))
    out = _with_components(known, component).join(counted, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; rows with a null id stay."""
    _, _, component = _joined(docs, id_col, text_col, words, percent)
    gone = staged(component.where("component != id").select(F.col("id").alias("__gone")).distinct())
    return docs.join(small_enough(gone), F.col(id_col).cast("bigint") == F.col("__gone"), "left_anti").select(docs.columns)
