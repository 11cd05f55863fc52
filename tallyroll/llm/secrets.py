"""Secret scans with a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over trigrams is derived that every match
satisfies: literals next to each other give strings, strings give the AND of their trigrams, alternatives an OR.
Blocks of texts are indexed (trigram -> rows, lower-cased, only trigrams that some rule asks for), a rule's postings
are intersected and united, and its expression runs over the rows left. A rule without mandatory trigrams runs over
every row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyroll.llm.common import text_slices

#: Rules in order: kind, expression, least characters of the group that must be long enough, that group.
#: The keyword letters of the first rule stand in either case.
BASE = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
     r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: A private key: the BEGIN line, header lines, and the base64 text to the END line, or without one to the last base64 line (lines
#: of 16 letters or more and a last shorter one). Line feeds may be written as escapes.
PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[ \t]*(?:\r?\n|\\n)[A-Za-z0-9-]+:[^\r\n\\]*)*"
       r"(?:(?:[A-Za-z0-9+/= \t\r\n]|\\[nr])*-----END [A-Z ]*PRIVATE KEY-----"
       r"|(?:(?:[ \t\r\n]|\\[nr])+[A-Za-z0-9+/=]{16,})+(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n\\\"']|\Z)))?)?")
#: Well-known shapes of other credentials.
ADDED = (
    ("pem", PEM, 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("live_key", r"sk_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
MOST_STRINGS, MOST_CLASS = 64, 8
MASK = "[SECRET]"


# --- queries: True (every row), an int (a trigram), ("and", ...) or ("or", ...) ---

def _all_of(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _code(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def _of_strings(strings: set[str]):
    """Satisfied by every text that holds one of the strings."""
    if any(len(s) < 3 or not s.isascii() for s in strings):
        return True
    return _any_of([_all_of(sorted({_code(s.lower().encode()[i : i + 3]) for i in range(len(s) - 2)})) for s in sorted(strings)])


def _walk(items):
    """(query, strings): strings are all that the items can match, or None when they can't be listed."""
    query, current, listed = [], {""}, True
    for op, arg in items:
        name, strings, sub = str(op), None, True
        if name == "LITERAL":
            strings = {chr(arg)}
        elif name == "IN" and str(arg[0][0]) != "NEGATE":
            found: set[str] | None = set()
            for kind, value in arg:
                chars = [value] if str(kind) == "LITERAL" else range(value[0], value[1] + 1) if str(kind) == "RANGE" else None
                if chars is None or len(found) + len(chars) > MOST_CLASS:
                    found = None
                    break
                found |= {chr(c) for c in chars}
            strings = found
        elif name == "SUBPATTERN":
            sub, strings = _walk(arg[-1])
        elif name == "BRANCH":
            ways = [_walk(x) for x in arg[1]]
            if all(s is not None for _, s in ways):
                strings = set().union(*(s for _, s in ways))
            else:
                sub = _any_of([_all_of([q, _of_strings(s) if s is not None else True]) for q, s in ways])
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            strings = {""}
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            inner_query, inner_strings = _walk(inner)
            if low == 0 and high == 1 and inner_strings is not None:
                strings = inner_strings | {""}
            elif low >= 1:
                # One round is there in any case; what follows it is not listed.
                sub = inner_query
                if inner_strings is not None and len(current) * len(inner_strings) <= MOST_STRINGS:
                    current = {a + b for a in current for b in inner_strings}
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        query += [_of_strings(current), sub]
        current, listed = (strings if strings is not None else {""}), False
    if listed:
        return True, current
    return _all_of([*query, _of_strings(current)]), None


def trigram_query(expression: str):
    """A Boolean trigram query that every text with a match satisfies; True when there is none."""
    query, strings = _walk(parser.parse(expression))
    return query if strings is None else _of_strings(strings)


def _trigrams(query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*(_trigrams(q) for q in query[1:]))


class Rules:
    """Compiled rules with their queries and the table of trigrams to index."""

    def __init__(self, rules) -> None:
        self.rules = [(kind, re.compile(x), least, group, trigram_query(x)) for kind, x, least, group in rules]
        self.order = {kind: i for i, (kind, *_) in enumerate(self.rules)}
        asked = np.array(sorted(set().union(*(_trigrams(q) for *_, q in self.rules))), np.int64)
        self.asked, self.wanted = asked, np.zeros(1 << 24, bool)
        self.wanted[asked] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Trigram -> ascending rows that hold it."""
        if len(data) < 3:
            return {}
        low = LOWER[data].astype(np.uint32)
        code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        trigram, row = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(trigram)) + 1
        return {int(trigram[a]): row[a:b] for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True) if b > a}

    def candidates(self, query, postings: dict[int, np.ndarray], everything: np.ndarray) -> np.ndarray:
        if query is True:
            return everything
        if isinstance(query, int):
            return postings.get(query, everything[:0])
        out = None
        for part in query[1:]:
            rows = self.candidates(part, postings, everything)
            if out is None:
                out = rows
            elif query[0] == "and":
                out = np.intersect1d(out, rows, assume_unique=True)
            else:
                out = np.union1d(out, rows)
            if query[0] == "and" and not len(out):
                break
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (start, rule, end) in code points, in order."""
        postings = self.postings(data, offsets)
        everything = np.arange(len(offsets) - 1)
        texts: dict[int, str] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for at, (_, expression, least, group, query) in enumerate(self.rules):
            for row in self.candidates(query, postings, everything).tolist():
                text = texts.get(row)
                if text is None:
                    text = texts[row] = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                spans = [(m.start(), at, m.end()) for m in expression.finditer(text) if m.end(group) - m.start(group) >= least]
                if spans:
                    found.setdefault(row, []).extend(spans)
        for spans in found.values():
            spans.sort()
        return found


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A class that takes every letter of a long run makes the plain form slow; runs of the least length are the same matches.
FAST = {r"[0-9a-f]+": r"[0-9a-f]{24,}"}


def _rules(rules) -> Rules:
    return Rules([(kind, FAST.get(x, x), least, group) for kind, x, least, group in rules])


def scan_secrets(docs: DataFrame, base=BASE, added=ADDED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, whole matches, ends exclusive, by start and then by rule. Null and empty
    texts have none; the digest is then that of the empty string. Repeated rows are scanned each, other columns not read.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(f"n_{kind}", T.LongType()) for kind, *_ in base],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _rules([*base, *added])
        kinds = [kind for kind, *_ in rules.rules]
        for batch in batches:
            for first, last, data, offsets in text_slices(batch):
                found = rules.scan(data, offsets)
                counts, digest, said = [[] for _ in base], [], []
                for row in range(last - first):
                    spans = found.get(row, [])
                    for k in range(len(base)):
                        counts[k].append(sum(1 for s in spans if s[1] == k))
                    own = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans if k < len(base))
                    digest.append(hashlib.sha256(own.encode()).hexdigest())
                    said.append(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array(digest, pa.string()), pa.array(said, pa.string())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, base=BASE, added=ADDED) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; n_chars, if there, follows the text. Texts without spans stay as they are."""
    n_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _rules([*base, *added])
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            changed: dict[int, str] = {}
            for first, _, data, offsets in text_slices(batch):
                for row, spans in rules.scan(data, offsets).items():
                    text, out, end = data[offsets[row] : offsets[row + 1]].tobytes().decode(), [], 0
                    for a, _, b in spans:
                        if a >= end:
                            out += [text[end:a], MASK]
                        end = max(end, b)
                    changed[first + row] = "".join(out) + text[end:]
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(column.to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
                if n_chars:
                    k = batch.schema.get_field_index("n_chars")
                    sizes = [len(changed[i]) if i in changed else n for i, n in enumerate(batch.column(k).to_pylist())]
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.column(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
