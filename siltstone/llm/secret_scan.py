"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Lexing turns a text into (name, expression) pairs.  Targets are names, quoted keys, subscripts (``cfg["name"] =``), annotated
names (``name: str =``) and elements (``<name>literal</name>``).  An expression is read operand by operand: strings with any
prefix and quotes, over lines in brackets, joined by signs or side by side; bare words; values of the next line or of a
block in YAML.  A call or a subscript is no literal.  Constants are propagated through names and joins, and every literal
that reaches a sensitive name is scored by the name and by its own form.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: A run that is too short can be passed over at once: no shorter match can begin inside a run.
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")

#: Parts of names by how surely their value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "authorization": 0.7, "client_secret": 1.0, "bearer": 0.7}
PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|your[_-]\w*|dummy|redacted|none|null|true|false|undefined|\*{3,}|x{4,}|\$\{[^{}]*\}?|\{\{[^{}]*\}{0,2}|<[^<>]*>|%\([^()]*\)?")
THRESHOLD = 0.6
#: A literal of which so much, over all of its parts, is a placeholder says nothing.
PLACEHOLDER_PART = 0.15

_MAY_HOLD = re.compile("(?i)pass|pwd|secret|token|key|credential|auth|bearer")
_SCHEME = r"(?:[Bb]earer|[Bb]asic|[Dd]igest|BEARER|BASIC|DIGEST)[ \t]+[A-Za-z0-9+/_.=~-]+"
_STRING = re.compile(r'''(?:[rRbBuUfF]{1,2}(?=["']))?(?:"""((?:[^"\\]|\\[\s\S]|"(?!""))*+)"""|\'\'\'((?:[^'\\]|\\[\s\S]|'(?!\'\'))*+)\'\'\'|`((?:[^`\\]|\\[\s\S])*+)`|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')''')
_WORD = re.compile(r"[A-Za-z0-9_./=-][A-Za-z0-9_./+=~-]*")
_SCHEME_WORD = re.compile(_SCHEME)
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
#: A name begins where a run of its characters begins, behind dashes: so each run is tried once.
_TARGET = re.compile(rf"""(?<![\w.-])-*+(?:[A-Za-z_][\w.]*+\[[ \t]*["']([^"'\n\[\]]+)["'][ \t]*\]|["']?({_NAME})["']?)[ \t]*(?::[ \t]*[A-Za-z_][\w.]*(?:\[[\w., |\[\]]*\])?(?:[ \t]*\|[ \t]*\w+)*[ \t]*(?==(?![=>])))?(:=|=>|[:=])(?![=:])""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>\s*([^<>\s](?:[^<>]*[^<>\s])?)\s*</\1\s*>")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|\|\||\?\?|~|\bor\b)(?=\s)|[ \t]*\+")
_DEFINED = re.compile(rf"""^[ \t]*#[ \t]*define[ \t]+({_NAME})[ \t]+(?=["'])|\bsetattr\([ \t]*[\w.]+[ \t]*,[ \t]*["']({_NAME})["'][ \t]*,[ \t]*(?=["'])""", re.M)
_GAP, _WIDE_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*"), re.compile(r"(?:\s|\\\r?\n|(?:#|//)[^\n]*+(?:\n|\Z))*+")
_BLANKS = re.compile(r"[ \t]*")
_NEXT_LINE = re.compile(r"\r?\n([ \t]+)(?![ \t#-])([^\n]*?)[ \t\r]*$", re.M)
_BLOCK = re.compile(rf"""^([ \t]*(?:- +)?)["']?({_NAME})["']?[ \t]*:[ \t]*[|>][0-9+-]*[ \t]*\n""", re.M)
_LINE_BEFORE = re.compile(r"[ \t]*(?:(?:export|set|const|let|var|final|-)[ \t]+)*[\"']?")
_LINE_AFTER = re.compile(r"[ \t]*[;,]?[ \t\r]*(?:#|//|$)", re.M)
_PRIVATE = re.compile(r"\s*-----BEGIN [A-Z0-9 ]*PRIVATE KEY")
_PUBLIC = re.compile(r"\s*-----BEGIN ")
_SCHEMED = re.compile(r"\s*(?:bearer|basic|digest|token)\s+(\S+)\s*", re.I)
_SENTENCE, _ENDED = re.compile(r"[.!?:;,]\s"), re.compile(r"[.!?:;,]$")


def _name_weight(name: str) -> float:
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").lower()
    parts = plain.split("_")
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(f"{a}_{b}", 0.0) for a, b in zip(parts, parts[1:], strict=False))])


class Value:
    """A literal with its span, or a join of values.  Joins share their parts, so names that are joined again and again don't
    grow; what is known of a value is put together from its parts, each of which is looked at once, as a whole."""

    __slots__ = ("parts", "text", "span", "counts", "held", "spaced", "said", "seen")

    def __init__(self, parts: list[Value] | None = None, text: str = "", span: tuple[int, int] | None = None):
        self.parts, self.text, self.span, self.counts, self.seen = parts or [], text, span, None, False
        self.held, self.spaced, self.said = 0, False, False

    def known(self) -> Value:
        """Counts of characters, how many are placeholders, and whether there are spaces and ends of sentences inside."""
        todo = [self]
        while todo:
            v = todo[-1]
            open_parts = [p for p in v.parts if p.counts is None] if v.counts is None else []
            if open_parts:
                todo += open_parts
                continue
            todo.pop()
            if v.counts is None:
                v.counts = Counter(v.text)
                v.held = sum(m.end() - m.start() for m in PLACEHOLDER.finditer(v.text))
                v.spaced, v.said = re.search(r"\s", v.text.strip()) is not None, _SENTENCE.search(v.text) is not None
                for p in v.parts:
                    v.counts.update(p.counts)
                    v.held += p.held
                    v.spaced, v.said = v.spaced or p.spaced, v.said or p.said
                # Where parts meet, a space at an end is one inside.
                v.spaced = v.spaced or any(p.last()[-1:].isspace() for p in v.parts[:-1]) or any(p.first()[:1].isspace() for p in v.parts[1:])
        return self

    def first(self) -> str:
        v = self
        while v.parts:
            v = v.parts[0]
        return v.text

    def last(self) -> str:
        v = self
        while v.parts:
            v = v.parts[-1]
        return v.text

    def spans(self) -> list[tuple[int, int]]:
        """Spans of all parts that were not given before."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if not v.seen:
                v.seen = True
                out += [v.span] if v.span else []
                todo += v.parts
        return out


def _literal_weight(value: Value) -> float:
    """How much a literal looks like a secret: one rule for all lengths, over all of its parts in any order."""
    begin = value.first()
    if _PUBLIC.match(begin):
        return 1.0 if _PRIVATE.match(begin) else 0.0
    known = value.known()
    counts, held = known.counts, known.held
    if not value.parts and (m := _SCHEMED.fullmatch(value.text)):
        counts, held = Counter(m[1]), sum(x.end() - x.start() for x in PLACEHOLDER.finditer(m[1]))
    elif known.spaced and (known.said or _ENDED.search(value.last())):
        return 0.0
    n = sum(counts.values())
    if n < 8 or held >= PLACEHOLDER_PART * n:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    said = "".join(counts)
    classes = bool(re.search("[a-z]", said)) + bool(re.search("[A-Z]", said)) + bool(re.search("[0-9]", said)) + bool(re.search("[^A-Za-z0-9]", said))
    return min(1.0, entropy / 3.0) * (1.0 if classes >= 2 else 0.6)


def _blocks(text: str) -> list[tuple[int, str, list[tuple[str, int, int, bool]]]]:
    """Block literals (``name: |`` and the deeper lines behind): place, name and the one operand."""
    out = []
    for m in _BLOCK.finditer(text):
        at, first, last, lines = m.end(), None, m.end(), []
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            line = text[at:stop]
            body = line.lstrip(" \t")
            if body.strip():
                if len(line) - len(body) <= len(m[1]):
                    break
                first = at + len(line) - len(body) if first is None else first
                last = at + len(line.rstrip())
                lines.append(body.rstrip())
            at = stop + 1
        if first is not None:
            out.append((m.start(2), m[2], [("\n".join(lines), first, last, True)]))
    return out


Operand = tuple[str, int, int, "bool | None"]


def _operand(text: str, at: int) -> tuple[Operand, int] | None:
    """The literal or word at a place, and where it ends; nothing where a call, a subscript or anything else stands there."""
    if (m := _STRING.match(text, at)) is not None:
        k = next(i for i in range(1, 6) if m[i] is not None)
        return (m[k], m.start(k), m.end(k), True), m.end()
    if (m := _SCHEME_WORD.match(text, at)) is not None:
        token = m[0].split()[-1]
        return (token, m.end() - len(token), m.end(), True), m.end()
    if (m := _WORD.match(text, at)) is not None:
        after = _GAP.match(text, m.end()).end()
        return None if text[after : after + 1] in ("(", "[") else ((m[0], m.start(), m.end(), False), m.end())
    return None


def _expression(text: str, at: int) -> tuple[list[Operand], int, int]:
    """The operands from a place on, where they end, and where the last comment between them ends.  Inside brackets they go on
    over lines; strings side by side join."""
    operands: list[Operand] = []
    depth, gap, comment = 0, _GAP, at

    def skip(at: int) -> int:
        nonlocal comment
        end = gap.match(text, at).end()
        if depth and (text.find("#", at, end) >= 0 or text.find("//", at, end) >= 0):
            comment = end
        return end

    at = skip(at)
    while text[at : at + 1] == "(":
        depth, gap = depth + 1, _WIDE_GAP
        at = skip(at + 1)
    while True:
        got = _operand(text, at)
        if got is None:
            return ([] if depth or not operands else operands), at, comment
        operands.append(got[0])
        end = got[1]
        next_ = skip(end)
        if (m := _JOIN.match(text, end)) is not None or (m := _JOIN.match(text, next_)) is not None:
            at = skip(m.end())
        elif got[0][3] and next_ > end and _STRING.match(text, next_):
            at = next_
        else:
            # A list of several values in brackets is no one literal.
            return ([] if depth and text[next_ : next_ + 1] == "," else operands), end, comment


class _Lines:
    """The line of a place, for places that only move on: each line is looked at once."""

    def __init__(self, text: str):
        self.text, self.start, self.stop, self.at = text, 0, text.find("\n"), 0
        self.facts()

    def facts(self) -> None:
        self.stop = len(self.text) if self.stop < 0 else self.stop
        self.indent = _BLANKS.match(self.text, self.start).end() - self.start
        self.before = _LINE_BEFORE.match(self.text, self.start).end()
        self.next = None

    def move(self, at: int) -> None:
        if at > self.stop:
            self.start = self.text.rfind("\n", self.stop, at) + 1
            self.stop = self.text.find("\n", at)
            self.facts()

    def next_value(self) -> re.Match | None:
        """The line behind this one, if it is deeper."""
        if self.next is None:
            stop = self.stop - 1 if self.text[self.stop - 1 : self.stop] == "\r" else self.stop
            m = _NEXT_LINE.match(self.text, stop)
            self.next = (m if m and len(m[1]) > self.indent else None,)
        return self.next[0]


def lex(text: str) -> list[tuple[str, list[Operand]]]:
    """(name, operands) of each assignment; an operand is (content, start, end, literal), its span without the quotes.

    Bare words are literal where name and word are a whole line, unless the word is itself the name of a secret.  What looks
    like an assignment inside a bare word, or a comment between operands, is part of it, so all is read once; time grows with
    the text.
    """
    pairs, lines, taken = [], _Lines(text), 0
    for m in _TARGET.finditer(text):
        if m.start(3) < taken:
            continue
        name = m[1] or m[2]
        start = m.start(1) if m[1] else m.start(2)
        lines.move(m.start(3))
        operands, end, comment = _expression(text, m.end())
        taken = max([taken, comment, *(stop for _, _, stop, literal in operands if not literal)])
        if not operands and m[3] == ":":
            after = _BLANKS.match(text, m.end()).end()
            if text[after : after + 1] in ("#", "\r", "\n") and (n := lines.next_value()) is not None:
                got = _operand(text, n.start(2))
                if got is not None and got[1] == n.end(2):
                    operands = [(*got[0][:3], got[0][3] or None)]
        elif len(operands) == 1 and operands[0][3] is False and re.fullmatch(r"[A-Za-z_.]+", operands[0][0]) and not _name_weight(operands[0][0]):
            alone = lines.before == start or (lines.before > start and _LINE_BEFORE.fullmatch(text, lines.start, start))
            if alone and _LINE_AFTER.match(text, end):
                operands = [(*operands[0][:3], None)]
        if operands:
            pairs.append((start, name, operands))
    for m in _DEFINED.finditer(text):
        got = _operand(text, m.end())
        if got is not None:
            pairs.append((m.start(m.lastindex), m[m.lastindex], [got[0]]))
    pairs += [(m.start(1), m[1], [(m[2], m.start(2), m.end(2), True)]) for m in _ELEMENT.finditer(text)]
    return [(name, operands) for _, name, operands in sorted(pairs + _blocks(text), key=lambda p: p[0])]


def sensitive_literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through constants defined before."""
    if not _MAY_HOLD.search(text):
        return []
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    for name, operands in lex(text):
        parts: list[Value] = []
        for content, start, end, literal in operands:
            if not literal and content in known:
                parts.append(known[content])
            elif literal or literal is None or not re.fullmatch(r"[A-Za-z_.]+", content):
                parts.append(Value(text=content, span=(start, end)))
        known[name] = value = parts[0] if len(parts) == 1 else Value(parts)
        if (weight := _name_weight(name)) and weight * _literal_weight(value) >= THRESHOLD:
            found.update(value.spans())
    return sorted(found)


def scan(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind number, kind, end, start of the secret itself) of every span in order."""
    out = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end(), m.start()) for m in _HEX_LONG.finditer(text)]
    out += [(a, 3, "literal", b, a) for a, b in sensitive_literals(text)]
    return sorted(out)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind, comma-joined; base_sha256 covers the
    fixed patterns.  Null texts are empty, and an empty table gives an empty result; very long texts, names and literals are
    read whole; repeated rows and null doc_ids stay; other columns, clashing names too, are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text"):
                found = scan(text.as_py() or "")
                said = [(k, f"{kind}:{start}:{end}") for start, k, kind, end, _ in found]
                counts.append([sum(k == i for k, _ in said) for i in range(4)])
                digests.append(hashlib.sha256(",".join(s for k, s in said if k < 3).encode()).hexdigest())
                spans.append(",".join(s for _, s in said))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; names before an assigned secret stay.  All columns stay as
    they are, whatever their names; null texts stay null, and an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                out, last = [], 0
                for start, end in sorted((x[4], x[3]) for x in scan(text or "")):
                    if end > last:
                        if start >= last:
                            out += [text[last:start], mark]
                        last = end
                texts.append("".join([*out, text[last:]]) if out else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return bounded(docs).mapInArrow(run, docs.schema)
