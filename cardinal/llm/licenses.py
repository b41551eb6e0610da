"""License scans.

An Aho-Corasick automaton reads the text's normalised words and finds notice phrases and the SPDX identifier tag; the
expression after a tag goes through a shunting-yard parser that evaluates AND, OR and WITH.

The score is how freely a text may be used, from 0 (no licence found, or all rights reserved) to 1 (public domain):
OR takes the freer side, AND and several findings take the stricter one, WITH lifts a copyleft licence half-way.

Edge cases: a null or empty text has no words, null first_word and last_word, empty labels and score 0; a broken
expression gives the labels of its known identifiers and no score, an unknown identifier the label "other"; repeated rows give repeated results; only the id and
the text are read; texts are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from cardinal.llm.columnar import map_batches, text_column

#: The phrases and labels of the base scan.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that this operator adds.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons zero": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary", "isc license": "isc", "eclipse public license": "epl", "boost software license": "bsl",
}
TAG = "spdx license identifier"
#: Licence families and how freely a text under them may be used.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "pddl": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "apache": 0.9, "zlib": 0.9, "x11": 0.9, "ncsa": 0.9, "postgresql": 0.9,
    "psf": 0.9, "wtfpl": 0.9, "upl": 0.9, "unicode": 0.9, "curl": 0.9, "hpnd": 0.9, "mulanpsl": 0.9, "libpng": 0.9, "w3c": 0.9, "afl": 0.8, "cc-by": 0.8, "ofl": 0.8, "odc-by": 0.8,
    "ms-pl": 0.8, "php": 0.8, "ruby": 0.8, "vim": 0.8, "zpl": 0.8, "openssl": 0.8, "artistic": 0.7, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5,
    "eupl": 0.5, "ms-rl": 0.5, "odbl": 0.5, "gfdl": 0.4, "osl": 0.4, "cecill": 0.3, "gpl": 0.3, "agpl": 0.2, "sspl": 0.2, "busl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0,
}
#: Identifiers that don't start with the name of their family.
SPELLINGS = {"unlicense": "public-domain", "cc-pddc": "public-domain", "0bsd": "bsd", "python": "psf"}
OTHER = "other"
_NAMES = sorted([*FREEDOM, *SPELLINGS], key=len, reverse=True)
_IDENTIFIER = re.compile(f"({'|'.join(map(re.escape, _NAMES))})(?:v?[0-9].*|[-+.].*)?", re.A)
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAGGED = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*[:=]?[ \t]*([^\r\n]*)")
_LEXEMES = re.compile(r"[()]|[0-9a-z.+-]+", re.A)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The family of a lower-case identifier: a name, alone or with a version or suffix after it; None if it is unknown."""
    found = _IDENTIFIER.fullmatch(identifier)
    return found and SPELLINGS.get(found[1], found[1])


def postfix(expression: str) -> list[str] | None:
    """The expression's lexemes in postfix order, up to the first that can't follow; None if it is broken."""
    out, stack, operand = [], [], False
    for x in _LEXEMES.findall(expression.lower()):
        if x == "(":
            if operand:
                break
            stack.append(x)
        elif x == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif x in _PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[x]:
                out.append(stack.pop())
            stack.append(x)
            operand = False
        else:
            if operand:
                break
            out.append(x)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(labels, score) of a licence expression. Unknown licences have the label OTHER and no part in the score, which is None if the expression is broken or has no known licence."""
    order, values = postfix(expression), []
    if order is None:
        return {x for x in map(family, _LEXEMES.findall(expression.lower())) if x}, None
    for x in order:
        if x not in _PRECEDENCE:
            values.append(({family(x) or OTHER}, FREEDOM.get(family(x) or "")))
            continue
        (more, right), (own, left) = values.pop(), values.pop()
        if x == "with":  # what follows is an exception, no licence
            values.append((own, None if left is None else left if left >= 0.8 else (left + 1) / 2))
        else:
            known = [v for v in (left, right) if v is not None]
            values.append((own | more, (max if x == "or" else min)(known) if known else None))
    return values[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("more", MORE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan_text(text: str) -> dict:
    words = text.encode().translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode()} "
    places, base, labels, scores, tagged = [], set(), set(), [], False
    done, index = 0, 0
    for end, (kind, label, size) in automaton().iter(line):
        start = end - size + 1
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        scores.append(FREEDOM[label])
        if kind == "base":
            index += line.count(" ", done, start) if start >= done else -line.count(" ", start, done)
            done = start
            places.append(index)
            base.add(label)
    if tagged:
        for m in _TAGGED.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text)):
            more, value = evaluate(m[1])
            labels |= more
            scores += [value] if value is not None else []
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": float(min(scores, default=0.0)),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row."""

    def kernel(batch):
        rows = [scan_text(t.as_py()) for t in batch.column(1)]
        yield {id_col: batch.column(0)} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

    kind = docs.schema[id_col].dataType.simpleString()
    columns = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_batches(docs.select(id_col, text_column(text_col).alias("__text")), kernel, f"`{id_col}` {kind}, {columns}")
