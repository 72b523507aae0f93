"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates SPDX expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of the method, by label.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
}
TAG = "spdx-license-identifier:"
#: Identifiers that permit redistribution and use without a copyleft duty; others are restrictive or unknown.
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd"}
#: SPDX identifiers in lower case, by family and version, and those that a document defines itself.
_IDENTIFIER = re.compile(
    r"(?:0bsd|aal|bsl-1\.0|curl|ftl|icu|ijg|isc|json|libpng(?:-2\.0)?|mit(?:-0|-cmu|-advertising)?|ms-pl|ms-rl|mulanpsl-[12]\.0|ncsa|openssl|postgresql|psf-2\.0|python-2\.0|ruby|sleepycat|unlicense|vim|w3c|wtfpl|x11|zlib|zpl-2\.[01]"
    r"|afl-[123]\.[012]|apache-(?:1\.[01]|2\.0)|apsl-[12]\.[012]|artistic-[12]\.0|blueoak-1\.0\.0|bsd-[1-4]-clause(?:-[a-z]+)*|cddl-1\.[01]|cecill-(?:[12]\.[01]|b|c)|cpl-1\.0|ecl-[12]\.0|epl-[12]\.0|eupl-1\.[012]|isc-veillard"
    r"|[al]?gpl-[123]\.[01](?:-only|-or-later)?|gfdl-1\.[123](?:-only|-or-later)?|lppl-1\.[0-3][ac]?|mpl-(?:1\.[01]|2\.0)(?:-no-copyleft-exception)?|odbl-1\.0|odc-by-1\.0|ofl-1\.[01]|osl-[123]\.[01]|pddl-1\.0|php-3\.01?|unicode-(?:3\.0|dfs-201[56])|upl-1\.0"
    r"|cc0-1\.0|cc-by(?:-nc)?(?:-nd|-sa)?-(?:1\.0|2\.[05]|3\.0|4\.0)(?:-[a-z]{2,3})?|(?:documentref-[0-9a-z.-]+:)?licenseref-[0-9a-z.-]+)\+?"
)
#: What may follow WITH.
_EXCEPTION = re.compile(r"[0-9a-z.+-]+-exception(?:-[0-9.]+)?|[0-9a-z.+-]+-(?:note|linking)|(?:documentref-[0-9a-z.-]+:)?additionref-[0-9a-z.-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_TAG_PHRASE = "spdx license identifier"  # the tag among normalised words
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(rb"[ \t]*((?:[Dd]ocument[Rr]ef-[0-9A-Za-z.-]+:)?[0-9A-Za-z.+-]+|[()])")


def tokens_of(expression: str) -> list[str]:
    return expression.replace("(", " ( ").replace(")", " ) ").split()


def evaluate(expression: str) -> tuple[list[str], bool] | None:
    """(identifiers, whether a permissive choice exists) of an SPDX expression; None if it is malformed or names anything unknown.

    WITH binds its exception to the licence before it and keeps that licence's class, AND needs both sides
    to be permissive, OR either one.
    """
    names: list[str | None] = []  # of all operands, in order; an exception joins the name of its licence
    out: list[tuple[int, bool]] = []  # place of the name (-1: an expression of several) and class
    stack: list[str] = []
    operand_next = True

    def apply(op: str) -> bool:
        if len(out) < 2:
            return False
        (b, right), (a, left) = out.pop(), out.pop()
        if op == "with":
            if a < 0 or b < 0 or not _IDENTIFIER.fullmatch(names[a]) or not _EXCEPTION.fullmatch(names[b]):
                return False
            names[a], names[b] = f"{names[a]} with {names[b]}", None
            out.append((a, left))
        else:
            out.append((-1, left and right if op == "and" else left or right))
        return True

    for token in tokens_of(expression.lower()):
        if token in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                if not apply(stack.pop()):
                    return None
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                if not apply(stack.pop()):
                    return None
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next or not _operand(token, bool(stack) and stack[-1] == "with"):
                return None
            out.append((len(names), token.rstrip("+") in PERMISSIVE))
            names.append(token)
            operand_next = False
    while stack:
        if stack[-1] == "(" or not apply(stack.pop()):
            return None
    if operand_next or len(out) != 1:
        return None
    return sorted({n for n in names if n}), out[0][1]


def _operand(token: str, after_with: bool) -> bool:
    return bool((_EXCEPTION if after_with else _IDENTIFIER).fullmatch(token))


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in sorted({*BASE_PHRASES, *MORE_PHRASES, _TAG_PHRASE}):
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


@functools.lru_cache(maxsize=1)
def _to_words() -> bytes:
    """Separators become spaces, A-Z become a-z; the words are runs of 0-9, a-z and bytes over 0x7F."""
    out = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


def expression_at(text: bytes, at: int) -> str:
    """The longest expression from a place on in its line, in lower case.

    It ends at the first token that cannot go on with it: another operand, anything but known identifiers, operators and
    parentheses, a full stop after an identifier, or the next tag.  Without a whole expression it is what was read.
    """
    tokens: list[str] = []
    whole, depth, operand_next = 0, 0, True
    while found := _TOKEN.match(text, at):
        token = found[1].decode("ascii").lower()
        if token + ":" == TAG and text[found.end() : found.end() + 1] == b":":
            break
        name = token.rstrip(".")
        if token in ("and", "or", "with"):
            if operand_next:
                break
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        else:
            if not operand_next or not _operand(name, tokens[-1:] == ["with"]):
                break
            operand_next = False
        tokens.append(name or token)
        if not operand_next and not depth:
            whole = len(tokens)
        at = found.end()
        if name != token:
            break
    return " ".join(tokens[:whole] or tokens)


def _places(decoded: str, starts: list[int]) -> dict[int, int]:
    """The word at each place, words counted from 0."""
    at = counted = 0
    index = {}
    for s in sorted(set(starts)):
        counted += decoded.count(" ", at, s)
        at = s
        index[s] = counted
    return index


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score and expressions of one text."""
    words = text.translate(_to_words()).split()
    decoded = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    starts: list[int] = []
    tagged: list[int] = []
    base, labels, score = set(), set(), 0.0
    for end, (phrase, _) in _automaton().iter(decoded):
        if phrase == _TAG_PHRASE:
            tagged.append(end - len(phrase) - 1)
        elif phrase in BASE_PHRASES:
            base.add(BASE_PHRASES[phrase])
            starts.append(end - len(phrase) - 1)
            score = max(score, 0.9)
        else:
            labels.add(MORE_PHRASES[phrase])
            score = max(score, 0.8)
    index = _places(decoded, starts + tagged)
    first, last = (index[min(starts)], index[max(starts)]) if starts else (None, None)
    tags = []
    if tagged:
        spans = [m.span() for m in _WORD.finditer(text)]
        for s in tagged:
            a, b = spans[index[s]][0], spans[index[s] + 2][1] + 1
            if text[a:b].lower() == TAG.encode():
                tags.append(expression_at(text, b))
    for expression in tags:
        if (value := evaluate(expression)) is not None:
            labels.update(value[0])
            labels.add("permissive" if value[1] else "restricted")
            score = 1.0
        else:
            labels.add("spdx-malformed")
            score = max(score, 0.5)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, tags


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in common.slices(batch):
            whole = data.tobytes()
            rows = [scan(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with the licence phrases and SPDX expressions of its whole text.

    A null or empty text has no words, no places and score 0.  Repeated rows each get their own result, a null
    id stays null, and columns other than the two named are not read.  Places of different phrases that
    overlap all count.  An identifier tag takes the longest expression of known identifiers (SPDX's, LicenseRef-, DocumentRef-)
    that follows it on its line; without one it gives the label spdx-malformed, whatever words follow.  No shuffle: each text is
    scanned where it is read, in time in proportion to its length.
    """
    common.small_batches(docs.sparkSession)
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return two.mapInArrow(_scan_batches, SCHEMA)
