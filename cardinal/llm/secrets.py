"""Secret scans by a recursive decoding worklist.

The text is the first layer. Of each layer, the first and all others alike, follow further ones: the whole layer with its
URL and Unicode escapes decoded in place, the whole layer with its readable base64 runs decoded in place, and, apart, all
that a base64 run holds (its bytes, and what compressed streams in them inflate to). Each is scanned whole and followed
unless the same text was reached from the same place before; so the worklist ends at a fixpoint, cycles included.

What is found in an inner layer is mapped back, layer by layer, to a span of the whole text: an escape by its own
characters, base64 by its groups of four, compressed content by its whole run.

Kinds: assign, access and hex in the text itself, pem for private key blocks, and deep_* for what inner layers hold.
Spans are in code points, end exclusive.

Edge cases: a null or empty text has no spans and the digest of the empty string; repeated rows give repeated results;
only the id and the text are read; texts are read whole. Compressed streams are inflated to their end, all members of
them, however long, as a stream of windows of WINDOW bytes that overlap by OVERLAP: memory stays bounded, and a secret of
up to OVERLAP bytes lies whole in some window. A stream that is cut off or broken gives what comes before that.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import map_batches, small_batches, text_column

WINDOW, OVERLAP = 8 << 20, 64 << 10
#: The base patterns and the least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
_KEYWORD = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.A)
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END [A-Z ]*PRIVATE KEY-----")
_CODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#x([0-9A-Fa-f]{1,6});|((?:%[0-9A-Fa-f]{2})+)")
#: The shortest base secret (token=abcdef) has 12 bytes: 16 characters. Lines of one run may be wrapped.
MIN_BASE64 = 16
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/_-]{4,}(?=[\x20\t]*[\r\n]))(?:[\x20\t]*(?:\r\n?|\n)[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "deep_assign", "deep_access", "deep_hex", "deep_pem")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in the order of start, then kind."""
    found = []
    if _KEYWORD.search(text.lower()):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a compressed stream holds, and the members that follow it at once; until its end or a fault."""
    stream, rest = None, b""
    for chunk in chunks:
        rest += chunk
        while rest:
            if stream is None:
                if len(rest) < 3:
                    break
                stream = zlib.decompressobj(31 if rest[0] == 0x1F else 15)
            try:
                plain = stream.decompress(rest, 1 << 20)
            except zlib.error:
                return
            if plain:
                yield plain
            if stream.eof:
                rest, stream = stream.unused_data, None
                if rest[:1] not in (b"\x1f", b""):
                    return
            else:
                rest = stream.unconsumed_tail


def _from(chunks: Iterator[bytes], at: int) -> Iterator[bytes]:
    for chunk in chunks:
        if at < len(chunk):
            yield chunk[at:]
        at = max(0, at - len(chunk))


def _windows(raw: bytes, chain: tuple[int, ...]) -> Iterator[tuple[int, bytes, bool]]:
    """(start, bytes, whether that is all) of the content at the end of a chain of stream starts, each in the content before; it is inflated anew from raw, so that no content is held whole."""
    chunks = iter([raw])
    for at in chain:
        chunks = _inflated(_from(chunks, at))
    if not chain:
        yield 0, raw, True
        return
    start, held, size = 0, [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size > WINDOW:
            window = b"".join(held)
            yield start, window, False
            held = [window[-OVERLAP:]]
            start, size = start + size - OVERLAP, OVERLAP
    if size and (start == 0 or size > OVERLAP):
        yield start, b"".join(held), start == 0


def _unbase64(run: str) -> tuple[list[bytes], list[int]]:
    """The bytes of a run, read from each of its first four characters (words before it on its line or the line above shift it), and where its characters stand."""
    places = [i for i, c in enumerate(run) if not c.isspace() and c != "="]
    code = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    out = []
    for skip in range(min(4, len(code) - MIN_BASE64 + 1)):
        part = code[skip : len(code) - ((len(code) - skip) % 4 == 1)]
        out.append(binascii.a2b_base64(part + "=" * (-len(part) % 4)))
    return out, places


def _groups(text: str, raw: bytes, skip: int, places: list[int], size: int) -> Callable[[int], tuple[int, int]]:
    """Where in its run the groups of four stand that hold a character of decoded base64."""

    def at(i: int) -> tuple[int, int]:
        first, last = (i, i + 1) if len(text) == len(raw) else (len(text[:i].encode()), len(text[: i + 1].encode()))
        end = skip + -(-last // 3) * 4
        return places[skip + first // 3 * 4], places[end - 1] + 1 if end < len(places) else size

    return at


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _contents(run: str) -> Iterator[tuple[str, Callable | None]]:
    """What a base64 run may hold, as text whatever the bytes are: its bytes, with where they stand, and what compressed streams in them inflate to."""
    plain, places = _unbase64(run)
    seen = set()
    for skip, raw in enumerate(plain):
        work: list[tuple[int, ...]] = [()]
        while work:
            chain = work.pop()
            for start, window, whole in _windows(raw, chain):
                if whole:
                    if window in seen:
                        break
                    seen.add(window)
                text = _text(window)
                yield text, _groups(text, raw, skip, places, len(run)) if not chain else None
                work += [(*chain, start + m.start()) for m in _PACKED.finditer(window) if whole or m.start() < len(window) - OVERLAP or len(window) <= WINDOW]


class Layer:
    """A text, and where in its parent layer it comes from: runs (start, end, low, high, place) apart from each other and in order, between which both go on alike. place: where in low..high a character of the run comes from, None for all of it."""

    def __init__(self, text: str, parent: Layer | None = None, runs: list[tuple] | None = None):
        self.text, self.parent, self.runs = text, parent, runs or []
        self.starts = [r[0] for r in self.runs]

    def _place(self, i: int) -> tuple[int, int, bool]:
        """The span in the parent that the character comes from, and whether it was decoded."""
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1, False
        start, end, low, high, place = self.runs[k]
        if i >= end:
            return high + i - end, high + i - end + 1, False
        a, b = place(i - start) if place else (0, high - low)
        return low + a, low + b, True

    def outer(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span in the whole text of a part that isn't empty, and whether anything in it was decoded."""
        layer, decoded = self, False
        while layer.parent is not None:
            last = bisect_left(layer.starts, end) - 1
            decoded = decoded or (last >= 0 and layer.runs[last][1] > start)
            start, end = layer._place(start)[0], layer._place(end - 1)[1]
            layer = layer.parent
        return start, end, decoded

    def replaced(self, runs: list[tuple[int, int, str, Callable | None]]) -> Layer:
        """The whole layer with runs (in order, apart from each other) replaced by what they decode to."""
        parts, places, size, at = [], [], 0, 0
        for low, high, plain, place in runs:
            parts += [self.text[at:low], plain]
            size += low - at
            if plain:
                places.append((size, size + len(plain), low, high, place))
            size += len(plain)
            at = high
        return Layer("".join([*parts, self.text[at:]]), self, places)


def _escapes(text: str) -> list[tuple[int, int, str, Callable | None]]:
    """The URL and Unicode escapes of a text, each character by itself where its code can be told apart."""
    if "%" not in text and "\\" not in text and "&#" not in text:
        return []
    out: list[tuple[int, int, str, Callable | None]] = []
    for m in _CODE.finditer(text):
        if m[5]:
            raw = unquote_to_bytes(m[5])
            try:
                plain = raw.decode()
            except UnicodeDecodeError:
                out.append((*m.span(), raw.decode("utf-8", "replace"), None))
                continue
            at = m.start()
            for c in plain:
                out.append((at, at + 3 * len(c.encode()), c, None))
                at = out[-1][1]
            continue
        code = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            out.append((*m.span(), chr(code), None))
    return out


def _readable(run: str) -> tuple[str, Callable] | None:
    """A base64 run as text, if all of it is printable: only then it may take the run's place between what surrounds it."""
    plain, places = _unbase64(run)
    try:
        text = plain[0].decode() if plain else ""
    except UnicodeDecodeError:
        return None
    if text and all(c.isprintable() or c in "\t\r\n" for c in text):
        return text, _groups(text, plain[0], 0, places, len(run))
    return None


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers that follow from a layer: itself with escapes decoded, itself with readable base64 decoded, and whatever else its base64 runs hold, each apart."""
    if escapes := _escapes(layer.text):
        yield layer.replaced(escapes)
    coded = list(_BASE64.finditer(layer.text))
    readable = [(*m.span(), *plain) for m in coded if (plain := _readable(m[0]))]
    if readable:
        yield layer.replaced(readable)
    for m in coded:
        for text, place in _contents(m[0]):
            if text:
                yield Layer(text, layer, [(0, len(text), *m.span(), place)])


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, base ones included."""
    base = base_spans(text)
    spans = set(base)
    if "-----BEGIN" in text:
        spans |= {("pem", *m.span()) for m in _PEM.finditer(text)}
    seen, work = set(), [_inner(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        low, high, _ = layer.outer(0, len(layer.text))
        key = hashlib.blake2b(f"{low}:{high}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        found = base_spans(layer.text)
        if "-----BEGIN" in layer.text:
            found += [("pem", *m.span()) for m in _PEM.finditer(layer.text)]
        for kind, start, end in found:
            low, high, decoded = layer.outer(start, end)
            if decoded or not any(a <= low and high <= b for _, a, b in spans):
                spans.add((f"deep_{kind}", low, high))
        work.append(_inner(layer))
    return sorted(spans, key=_order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    out, at = [], 0
    for _, a, b in scan_text(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans for each row."""

    def kernel(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column(1):
            spans = scan_text(text.as_py())
            base = [x for x in spans if x[0] in BASE_KINDS]
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(x[0] == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        yield {id_col: batch.column(0), **out}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_column(text_col).alias("__text")), kernel, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text; chars_col, if given and there, becomes the new length. Null texts stay null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
