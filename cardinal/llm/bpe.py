"""Byte-level BPE encoding and decoding.

Encoding keeps a priority queue of (merge rank, position) over a doubly linked list of symbols; entries whose symbols
have changed since are stale and skipped. Decoding concatenates the vocabulary's strings.

Edge cases: a null text counts as empty and gives no ids; a null doc_id is kept; repeated rows give repeated results;
other columns of the input are ignored; an empty table gives an empty table. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import map_batches, text_column

#: Entries of a worker's memo of encoded words; it is emptied beyond that.
MEMO_ENTRIES = 300_000
#: Longer words are not kept in the memo.
MEMO_CHARS = 40
#: An entry of the queue is one integer: the merge rank above the position of the left symbol.
POSITION_BITS = 40
POSITION = (1 << POSITION_BITS) - 1

# Code points that the regex module takes for letters or numbers, but the tokenizer's older Unicode tables do not.
_NEWER = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 "
    "A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
_WHITE = r" \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATE = "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in (x.split("-") for x in _NEWER.split()))
_OTHER = rf"[[^{_WHITE}\p{{L}}\p{{N}}]||[{_LATE}]]"
_PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_LATE}]]+| ?[\p{{N}}--[{_LATE}]]+| ?{_OTHER}+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_TWO_WHITE = regex.compile(rf"[{_WHITE}]{{2}}")
_CHUNKS = regex.compile(rf"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """Encoded chunks; a missing one is encoded on its first use."""

    def __init__(self, encode, prefix: str = ""):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode(self.prefix + chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = out
        return out


class BytePairCodec:
    """Encoder and decoder for a byte-level BPE vocabulary in the JSON format of public tokenizers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        self.lefts, self.rights, self.made = [], [], []  # by rank
        self.keys: dict[int, dict[int, int]] = {i: {} for i in vocabulary.values()}  # left, right: the rank, shifted
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.lefts.append(vocabulary[left])
            self.rights.append(vocabulary[right])
            self.made.append(vocabulary[left + right])
            self.keys[vocabulary[left]].setdefault(vocabulary[right], rank << POSITION_BITS)
        self.byte_keys = [[self.keys[a].get(b) for b in self.first] for a in self.first]
        self.packed = {i: struct.pack("<I", i) for i in vocabulary.values()}
        self.strings: dict[int, bytes] = {}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        for token, i in [*vocabulary.items(), *added.items()]:
            known = all(c in byte_of for c in token)
            self.strings[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.added = added
        self.split_added = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = _Memo(self._merge)
        self.heads, self.tails = _Memo(self._chunk), _Memo(self._chunk, " ")

    def _merge(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = [self.first[b] for b in raw]
        byte_keys = self.byte_keys
        queue = [key + i for i, (a, b) in enumerate(zip(raw, raw[1:])) if (key := byte_keys[a][b]) is not None]
        if queue:
            keys, lefts, rights, made, n = self.keys, self.lefts, self.rights, self.made, len(ids)
            heapify(queue)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while queue:
                key = heappop(queue)
                rank, i = key >> POSITION_BITS, key & POSITION
                j = after[i]
                if ids[i] != lefts[rank] or j >= n or ids[j] != rights[rank]:
                    continue  # stale: one of the two symbols has changed
                merged = made[rank]
                ids[i], ids[j] = merged, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (key := keys[merged].get(ids[k])) is not None:
                        heappush(queue, key + i)
                h = before[i]
                if h >= 0 and (key := keys[ids[h]].get(merged)) is not None:
                    heappush(queue, key + h)
        packed = self.packed
        return b"".join([packed[x] for x in ids if x >= 0])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk[chunk[0] == " " :].isalpha():
            return self._merge(chunk)  # letters are one piece
        found = _PIECES.findall(chunk)
        if len(found) == 1:
            return self._merge(chunk)
        return b"".join([self.tails[x[1:]] if x[0] == " " and len(x) > 1 else self.pieces[x] for x in found])

    def _plain(self, text: str) -> bytes:
        for memo in (self.pieces, self.heads, self.tails):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        if not text:
            return b""
        # A piece never goes on past a solid character that white space follows, so texts can be cut there.
        if _TWO_WHITE.search(text):
            return b"".join(map(self.heads.__getitem__, _CHUNKS.findall(text)))
        parts = text.split(" ")
        head = self.heads[parts[0]] if parts[0] else b""
        del parts[0]
        return head + b"".join(map(self.tails.__getitem__, parts))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_added is None or not self.split_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec for each worker process and file."""
    return BytePairCodec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row."""

    def kernel(batch):
        own = codec(path)
        yield {id_col: batch.column(0), "ids": [own.encode(t) for t in batch.column(1).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_column(text_col).alias("__text")), kernel, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of token ids; null ids count as none."""

    def kernel(batch):
        own = codec(path)
        yield {id_col: batch.column(0), "text": [own.decode(x or []) for x in batch.column(1).to_pylist()]}

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_batches(tokens.select(id_col, ids_col), kernel, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row: id, n_tokens, ids_sha256, decoded_sha256, round_trip."""

    def kernel(batch):
        own = codec(path)
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")}
        for text in batch.column(1):
            text = text.as_py()
            packed = own.encode_bytes(text)
            back = own.decode(np.frombuffer(packed, "<u4").tolist())
            out["n_tokens"].append(len(packed) // 4)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            out["round_trip"].append(back == text)
        yield {id_col: batch.column(0), **out}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return map_batches(docs.select(F.col(id_col), text_column(text_col).alias("__text")), kernel, schema)
