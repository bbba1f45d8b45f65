"""Secret scan: fixed patterns, and an assignment-aware parser.

The parser reads source and configuration text into pairs of a name and a literal. It stops at every
``=``, ``:``, ``:=`` and ``=>``: to the left stands the name that is assigned to, a type annotation
between them included; to the right an expression of quoted, bare and triple-quoted literals,
adjacent ones, names, parentheses and calls, joined by ``+`` or ``.``, over line breaks where the
syntax allows them, or an indented YAML block. XML elements and ``name=… value=…`` attributes are
pairs, too. Constants are propagated within a text: names stand for what they were last assigned, also
inside ``${name}``, ``{name}`` and ``%(name)s`` of quoted literals. Every literal is scored by how
sensitive the target's name is and by how much it looks like a secret; a name that only refers to a
constant leads to the literal the constant was made of.

Each run of a text is read a bounded number of times, whatever it holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracesieve.llm.common import id_and_text, map_batches

# Fixed values of the contract. ASCII: only A-Z have two cases.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KINDS = ["assign", "access", "hex", "lexed"]

OPERATOR = re.compile(r":=|=>|==+|!=|<=|>=|::|[:=]")
_PREFIX = r"[bfruBFRU]{0,2}"
LITERAL = re.compile(
    rf'''{_PREFIX}(?:"""((?:[^\\]|\\.)*?)"""|\'{{3}}((?:[^\\]|\\.)*?)\'{{3}})'''
    rf'''|{_PREFIX}"((?:[^"\\\n]|\\.)*+)"|{_PREFIX}\'((?:[^\'\\\n]|\\.)*+)\'|`([^`\n]*+)`''',
    re.DOTALL,
)
QUOTE = re.compile(r"""[bfruBFRU]{0,2}["'`]""")
NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:(?:\.|::|->)[A-Za-z_$][\w$]*+)*+", re.ASCII)
RUN = re.compile(r"""[^\s"'`,;#(){}\[\]<>&]+""")
BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*+")
SPACE = re.compile(r"\s*+")
JOINT = re.compile(r"[ \t]*+[+.][ \t]*+(?:\r?\n[ \t]*+)?+")
REFERENCE = re.compile(r"\$\{([\w.]+)\}|\{([A-Za-z_]\w*)\}|%\(([\w.]+)\)s|\$([A-Za-z_]\w*)")
# A type between a name and "=": what follows the colon, up to the operator.
TYPE = re.compile(r"[ \t]*+(?:[A-Za-z_&*?][\w.&*?|]*+(?:\[[\w.,\[\] |]*+\]|<[\w.,<> |?]*+>)?+[ \t|]*+)++(?==(?![=>]))")
ANNOTATED = re.compile(r"""([A-Za-z_$][\w$-]*)["'\]]?[ \t]*\??:[ \t]*[A-Za-z_&*?][\w.&*?|<>,\[\] \t]*$""")
TYPES = frozenset("string str String char text byte bytes const auto var let val".split())
YAML_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[ \t]*+\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>[ \t\r\n]*+([^<>]*+)</\1\s*+>")
PROPERTY = re.compile(r"""\b(?:name|key|id)[ \t]*=[ \t]*["']([^"'<>\n]{1,200})["'][ \t\r\n]+value[ \t]*=[ \t]*["']([^"'<>\n]*+)["']""")
# Functions that look a value up: their first argument is its name, not a secret.
LOOKUPS = frozenset("getenv get env environ getProperty getString lookup fetch setting config getOrDefault var param".split())
#: A bare run with more operators is a list of pairs: each value ends where the next operator stands.
RUN_OPERATORS = 8
#: Longer values are no credentials and are not propagated.
LONGEST = 4096
#: Depth of parentheses and calls.
DEPTH = 8
#: Characters before an operator that are searched for an annotated name.
BEFORE = 200
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")

# How sensitive a target is, by words of its name. Pairs count where both words stand together.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "authorization": 2, "pass": 2, "dsn": 2, "pin": 1, "key": 1,
}
SENSITIVE_PAIRS = {("api", "key"): 3, ("private", "key"): 3, ("access", "key"): 3, ("secret", "key"): 3, ("signing", "key"): 3}
STRONG = sorted(w for w, score in SENSITIVE.items() if score >= 2)
KEY_PAIR = re.compile("(?:" + "|".join(sorted({a for a, _ in SENSITIVE_PAIRS})) + ")[^a-z]*+key")
HARMLESS = {"length", "len", "count", "size", "limit", "type", "name", "field", "label", "url", "path", "file", "expires", "ttl", "id", "hint", "policy"}
FILLER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|your.*|change.?me.*|example.*|placeholder|dummy|test|todo|none|null|nil|true|false|undefined|redacted|.*<.*>.*)$")
ENOUGH = 5


def name_score(name: str) -> int:
    """0 to 3 for the last part of a dotted name; words like ``length`` make a name harmless."""
    words = [w.lower() for w in WORDS.findall(name.rpartition(".")[2] or name)]
    if words and words[-1] in HARMLESS:
        return 0
    single = max((SENSITIVE.get(w, 0) for w in words), default=0)
    return max([single, *(SENSITIVE_PAIRS.get(p, 0) for p in zip(words, words[1:]))])


def literal_score(value: str) -> int:
    """-5 to 4: length, mixture of characters and entropy; fillers and prose are not secrets."""
    if len(value) < 6 or FILLER.match(value) or "${" in value or value.count(" ") > 2:
        return -5
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    counts = Counter(value).values()
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    return (len(value) >= 8) + (len(value) >= 16) + (kinds >= 2) + (entropy >= 3)


def _target(text: str, end: int) -> tuple[str, int]:
    """The name that ends before ``end``, if any, and where it starts."""
    at = end
    while at and text[at - 1] in " \t":
        at -= 1
    if text[at - 2 : at] == "[]":
        at -= 2
    while at and text[at - 1] in "\"'`]":
        at -= 1
    stop = at
    while at and text[at - 1] in NAME_CHARS:
        at -= 1
    return text[at:stop].strip("-.$"), at


def _assigned(text: str, op: re.Match) -> str:
    """The name an operator assigns to; a type between them is passed over."""
    name, at = _target(text, op.start())
    if op.group() != "=" or not at:
        return name
    line = text[max(text.rfind("\n", 0, at) + 1, at - BEFORE) : op.start()]
    annotated = ANNOTATED.search(line) if ":" in line else None
    if annotated:
        return annotated[1]
    if name in TYPES:
        return _target(text, at)[0] or name
    return name


class _Parser:
    """Pairs of one text. Runs of bare characters and their operators are found once."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, tuple[str, tuple[int, int]]] = {}
        self.operators = list(OPERATOR.finditer(text))
        self.places = [op.start() for op in self.operators]
        # Bare runs with at least one operator in or before them, by their start.
        self.runs: list[tuple[int, int]] = []

    def run_end(self, at: int) -> int:
        """Where the bare run that has ``at`` ends; known runs are not read again."""
        if self.runs and self.runs[-1][0] <= at < self.runs[-1][1]:
            return self.runs[-1][1]
        found = RUN.match(self.text, at)
        if not found:
            return at
        self.runs.append((at, found.end()))
        return found.end()

    def bare(self, at: int) -> tuple[int, int] | None:
        """Span of the bare value at ``at``."""
        end = self.run_end(at)
        if end == at:
            return None
        k = bisect_left(self.places, at)
        if bisect_left(self.places, end) - k > RUN_OPERATORS:
            end = self.places[k]
        while end > at and self.text[end - 1] == ".":
            end -= 1
        return (at, end) if end > at else None

    def literal(self, found: re.Match) -> tuple[str, tuple[int, int]]:
        group = found.lastindex or 5
        room = LONGEST

        def known(m: re.Match) -> str:
            nonlocal room
            held = self.constants.get(next(g for g in m.groups() if g))
            if not held or len(held[0]) > room:
                return m.group()
            room -= len(held[0])
            return held[0]

        body = found.group(group) or ""
        return (REFERENCE.sub(known, body) if "{" in body or "$" in body or "%(" in body else body), found.span(group)

    def expression(self, at: int, depth: int = 0, inner: bool = False) -> tuple[list[tuple[str, tuple[int, int]]], int]:
        """(parts, end): values and spans of the literals and constants of the expression at ``at``.
        ``inner``: within parentheses, where lines may break anywhere."""
        text, parts = self.text, []
        gap = SPACE if inner else BLANKS
        while True:
            at = gap.match(text, at).end()
            quoted = LITERAL.match(text, at) if QUOTE.match(text, at) else None
            if quoted:
                parts.append(self.literal(quoted))
                at = quoted.end()
                following = gap.match(text, at).end()
                if QUOTE.match(text, following) and text[following] not in "`":
                    at = following  # adjacent literals are one
                    continue
            elif text.startswith("(", at) and depth < DEPTH:
                found, at = self.expression(at + 1, depth + 1, True)
                parts += found
                at = self.closed(at)
            else:
                named = NAME.match(text, at)
                after = named.end() if named else at
                if named and text.startswith("(", after) and depth < DEPTH:
                    found, at = self.call(named.group(), after + 1, depth + 1)
                    parts += found
                elif named and text.startswith("[", after):
                    at = after  # an index is no literal
                    break
                elif named and named.group() in self.constants:
                    parts.append(self.constants[named.group()])
                    at = after
                else:
                    if not parts and not depth and (span := self.bare(at)):
                        parts.append((text[slice(*span)], span))
                        return parts, span[1]
                    break
            joint = JOINT.match(text, at)
            if not joint:
                break
            at = joint.end()
        return parts, at

    def call(self, name: str, at: int, depth: int) -> tuple[list[tuple[str, tuple[int, int]]], int]:
        """Literals of a call's last argument that has any. What a lookup is asked for is none."""
        last: list[tuple[str, tuple[int, int]]] = []
        skip = re.split(r"\W+", name)[-1] in LOOKUPS
        while True:
            found, at = self.expression(at, depth, True)
            last = found if found and not skip else last
            skip = False
            at = SPACE.match(self.text, at).end()
            if not self.text.startswith(",", at):
                return last, self.closed(at)
            at += 1

    def closed(self, at: int) -> int:
        end = SPACE.match(self.text, at).end()
        return end + 1 if self.text.startswith(")", end) else at

    def yaml_block(self, start: int, at: int) -> tuple[str, tuple[int, int]] | None:
        """The lines after a block mark that are indented further than the key at ``start``."""
        text = self.text
        begin = text.rfind("\n", 0, start) + 1
        indent = len(text[begin:start]) - len(text[begin:start].lstrip(" -"))
        first, lines, end = 0, [], at
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            line = text[at:stop]
            if line.strip():
                depth = len(line) - len(line.lstrip(" "))
                if depth <= indent or sum(map(len, lines)) > LONGEST:
                    break
                first = first or at + depth
                end = at + len(line.rstrip())
                lines.append(line.strip())
            at = stop + 1
        return ("".join(lines), (first, end)) if lines else None

    def pairs(self) -> Iterator[tuple[str, str, tuple[int, int]]]:
        """(name, value, span) of every assignment of a literal."""
        text = self.text
        for op in self.operators:
            if op.group() not in (":", "=", ":=", "=>"):
                continue
            name = _assigned(text, op)
            if not name or (op.group() == ":" and TYPE.match(text, op.end())):
                continue
            if op.group() == ":" and YAML_BLOCK.match(text, op.end()):
                block = self.yaml_block(_target(text, op.start())[1], YAML_BLOCK.match(text, op.end()).end())
                parts = [block] if block else []
            else:
                at = BLANKS.match(text, op.end()).end()
                broken = re.match(r"\r?\n[ \t]*+", text[at : at + BEFORE]) if text[at : at + 1] in ("\r", "\n") else None
                if broken and not QUOTE.match(text, at + broken.end()):
                    continue  # only a quoted literal may stand on the next line
                parts, _ = self.expression(at + broken.end() if broken else at)
            if not parts:
                continue
            value = "".join(v for v, _ in parts)
            span = (min(s[0] for _, s in parts), max(s[1] for _, s in parts))
            if op.group() != ":" or text[op.end() : op.end() + 1] in (" ", "\t", '"', "'"):
                if len(value) <= LONGEST:
                    self.constants[name] = (value, span)
                else:
                    self.constants.pop(name, None)
            yield name, value, span
        for found in ELEMENT.finditer(text) if "</" in text else ():
            value = found.group(2).rstrip()
            yield found.group(1), value, (found.start(2), found.start(2) + len(value))
        for found in PROPERTY.finditer(text) if "value" in text else ():
            yield found.group(1), found.group(2), found.span(2)


def may_name(text: str) -> bool:
    """False only if no name in ``text`` can score 2."""
    low = text.lower()
    return any(w in low for w in STRONG) or ("key" in low and KEY_PAIR.search(low) is not None)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that are assigned, directly or through constants, to sensitive names."""
    found: set[tuple[int, int]] = set()
    if not may_name(text):
        return []
    for name, value, span in _Parser(text).pairs():
        score = name_score(name[-BEFORE:])
        if score >= 2 and score + literal_score(value) >= ENOUGH:
            found.add(span)
    return sorted(found)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    spans = []
    if "=" in text or ":" in text or "</" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
        spans += [("lexed", *s) for s in lexed(text)]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): an array of (kind, start, end) for each row; null and empty texts have none.

    Rows stay where they are, repeated rows are scanned each, other columns are not looked at."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t or "")] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["doc_id", "found"])

    return map_batches(rows, work, f"doc_id {kind}, found array<struct<kind: string, start: long, end: long>>")


