"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for name in messages %}`` ... ``{% endfor %}``, ``{% if condition %}`` ...
``{% elif %}`` ... ``{% else %}`` ... ``{% endif %}`` and ``{% generation %}`` ... ``{% endgeneration %}``.  Expressions are
string literals, names with dots, ``~`` (joins), ``|filter``, ``==``, ``!=``, ``not``, ``and`` and ``or``.  There are no
calls, no attributes of Python objects and no imports: names reach only the values they are given.  The source is parsed
into a syntax tree, constants are folded, and each node becomes a closure.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bounded

END = "</turn>"
HEAD = "### "
#: Turns are marked by HEAD, role, colon and END; what the assistant says is generated, all else is context.
TEMPLATE = """{% for m in messages %}### {{ m.role|name }}:
{% if m.role == 'assistant' %}{% generation %}{{ m.text|text }}{% endgeneration %}{% else %}{{ m.text|text }}{% endif %}</turn>
{% endfor %}"""


def escape_text(s: str) -> str:
    """A backslash before each backslash and each control string; ``unescape`` takes it away."""
    return s.replace("\\", "\\\\").replace(END, "\\" + END).replace(HEAD, "\\" + HEAD)


def escape_name(s: str) -> str:
    return s.replace("\\", "\\\\").replace(":", "\\:")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"text": escape_text, "name": escape_name, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    pass


# --- syntax tree ----------------------------------------------------------------------------------------------------


@dataclass
class Literal:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Apply:
    """An operator or filter with its operands."""

    what: str
    args: list


@dataclass
class Emit:
    value: object


@dataclass
class Loop:
    name: str
    over: object
    body: list


@dataclass
class Choice:
    branches: list[tuple[object, list]]


@dataclass
class Generation:
    body: list


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|[|~()]))""")


class _Expression:
    """Recursive descent over one expression: or, and, not, comparison, join, filter, primary."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(("text", re.sub(r"\\(.)", r"\1", m[1][1:-1])) if m[1] is not None else ("name", m[2]) if m[2] else ("op", m[3]))
            at = m.end()

    def _take(self, *wanted: tuple[str, str]) -> str | None:
        if self.tokens and self.tokens[0] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def whole(self):
        node = self._any()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def _any(self):
        node = self._all()
        while self._take(("name", "or")):
            node = Apply("or", [node, self._all()])
        return node

    def _all(self):
        node = self._not()
        while self._take(("name", "and")):
            node = Apply("and", [node, self._not()])
        return node

    def _not(self):
        return Apply("not", [self._not()]) if self._take(("name", "not")) else self._compared()

    def _compared(self):
        node = self._joined()
        if op := self._take(("op", "=="), ("op", "!=")):
            node = Apply(op, [node, self._joined()])
        return node

    def _joined(self):
        node = self._filtered()
        while self._take(("op", "~")):
            node = Apply("~", [node, self._filtered()])
        return node

    def _filtered(self):
        node = self._primary()
        while self._take(("op", "|")):
            if not self.tokens or self.tokens[0][1] not in FILTERS:
                raise TemplateError("unknown filter")
            node = Apply("|" + self.tokens.pop(0)[1], [node])
        return node

    def _primary(self):
        if self._take(("op", "(")):
            node = self._any()
            if not self._take(("op", ")")):
                raise TemplateError("missing )")
            return node
        if not self.tokens or self.tokens[0][0] == "op":
            raise TemplateError("expression expected")
        kind, value = self.tokens.pop(0)
        return Literal(value) if kind == "text" else Name(tuple(value.split(".")))


def parse(source: str) -> list:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAGS.finditer(source):
        pieces += [("text", source[at : m.start()]), ("value", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    pieces = [p for p in [*pieces, ("text", source[at:])] if p != ("text", "")]

    def block(ends: tuple[str, ...]) -> tuple[list, str]:
        out: list = []
        while pieces:
            kind, said = pieces.pop(0)
            if kind != "tag":
                out.append(Emit(Literal(said) if kind == "text" else _Expression(said).whole()))
                continue
            word, _, rest = said.partition(" ")
            if word in ends:
                return out, said
            if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                out.append(Loop(m[1], _Expression(m[2]).whole(), block(("endfor",))[0]))
            elif word == "generation":
                out.append(Generation(block(("endgeneration",))[0]))
            elif word == "if":
                branches, test = [], _Expression(rest).whole()
                while True:
                    body, end = block(("elif", "else", "endif"))
                    branches.append((test, body))
                    if end == "endif":
                        break
                    test = _Expression(end[4:]).whole() if end.startswith("elif") else Literal(True)
                out.append(Choice(branches))
            else:
                raise TemplateError(f"unknown tag {said!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return out, ""

    return block(())[0]


# --- folding --------------------------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else str(value)


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
} | {"|" + k: (lambda f: lambda a: f(_text(a)))(f) for k, f in FILTERS.items()}


def fold_expression(node):
    if isinstance(node, Apply):
        args = [fold_expression(a) for a in node.args]
        return Literal(_OPERATORS[node.what](*(a.value for a in args))) if all(isinstance(a, Literal) for a in args) else Apply(node.what, args)
    return node


def fold(nodes: list) -> list:
    """Evaluates constant expressions, drops branches that can't be taken and joins neighbouring texts."""
    out: list = []
    for node in nodes:
        match node:
            case Emit(value):
                made = [Emit(fold_expression(value))]
            case Loop(name, over, body):
                made = [Loop(name, fold_expression(over), fold(body))]
            case Generation(body):
                made = [Generation(fold(body))]
            case Choice(branches):
                left = []
                for test, body in branches:
                    test = fold_expression(test)
                    if isinstance(test, Literal) and not test.value:
                        continue
                    left.append((test, fold(body)))
                    if isinstance(test, Literal):
                        break
                made = left[0][1] if left and isinstance(left[0][0], Literal) else [Choice(left)] if left else []
        for n in made:
            if isinstance(n, Emit) and isinstance(n.value, Literal) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Literal):
                out[-1] = Emit(Literal(_text(out[-1].value.value) + _text(n.value.value)))
            else:
                out.append(n)
    return out


# --- closures -------------------------------------------------------------------------------------------------------


@dataclass
class Rendering:
    """Output so far, and the spans of it (code points) that are marked as generated."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    match node:
        case Literal(value):
            return lambda scope: value
        case Name((first, *rest)):

            def look(scope: dict):
                found = scope.get(first)
                for key in rest:
                    found = found.get(key) if isinstance(found, dict) else None
                return found

            return look
        case Apply(what, args):
            made, op = [_value(a) for a in args], _OPERATORS[what]
            if len(made) == 1:
                only = made[0]
                return lambda scope: op(only(scope))
            left, right = made
            return lambda scope: op(left(scope), right(scope))
    raise TemplateError("not an expression")


def _sequence(nodes: list) -> Callable[[dict, Rendering], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: dict, out: Rendering) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable[[dict, Rendering], None]:
    match node:
        case Emit(value):
            of = _value(value)

            def emit(scope: dict, out: Rendering) -> None:
                s = _text(of(scope))
                out.parts.append(s)
                out.size += len(s)

            return emit
        case Loop(name, over, body):
            items, inner = _value(over), _sequence(body)

            def loop(scope: dict, out: Rendering) -> None:
                for item in items(scope) or ():
                    inner({**scope, name: item}, out)

            return loop
        case Generation(body):
            inner = _sequence(body)

            def mark(scope: dict, out: Rendering) -> None:
                start = out.size
                inner(scope, out)
                out.spans.append((start, out.size))

            return mark
        case Choice(branches):
            made = [(_value(test), _sequence(body)) for test, body in branches]

            def choose(scope: dict, out: Rendering) -> None:
                for test, body in made:
                    if test(scope):
                        body(scope, out)
                        return

            return choose
    raise TemplateError("not a node")


def compile_template(source: str) -> Callable[[list[dict]], Rendering]:
    run = _sequence(fold(parse(source)))

    def render(messages: list[dict]) -> Rendering:
        out = Rendering()
        run({"messages": messages}, out)
        return out

    return render


_TURN = re.compile(r"### ((?:\\.|[^\\:])*+):\n((?:\\.|(?!</turn>)[^\\])*+)</turn>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation rendered by TEMPLATE."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


# --- on Spark -------------------------------------------------------------------------------------------------------


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation: conv_id, formatted (string), mask (array of start, end pairs in code points).

    Turns are ordered by turn, then role and text where turns tie; null turns come first; null roles and texts are empty;
    rows without conv_id are one conversation; repeated rows stay.  Other columns are dropped; an empty table gives no rows.
    Rows are dealt by conversation and sorted, and a task holds one conversation at a time, as its output is one text: so a
    conversation, with its texts and those without an id taken together, must fit into a string of Arrow (2 GB) and a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ids, texts, masks = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.int32()))], ["conv_id", "formatted", "mask"])
            for x in (ids, texts, masks):
                x.clear()
            return out

        def close(conv: int | None, turns: list[dict]) -> None:
            done = render(turns)
            ids.append(conv)
            texts.append(done.text())
            masks.append([x for span in done.spans for x in span])

        open_conv, turns, size = None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != open_conv:
                    close(open_conv, turns)
                    size += len(texts[-1])
                    turns = []
                    if size > 4_000_000:
                        yield flush()
                        size = 0
                open_conv = conv
                turns.append({"role": role or "", "text": text or ""})
        if turns:
            close(open_conv, turns)
        if ids:
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return bounded(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, formatted string, mask array<int>")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    One row for each row of ``format_conversations``: a null conv_id stays, a conversation of empty texts has turns and no
    loss; a long one is read whole; equal rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
                rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hexed("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": hexed(loss), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return bounded(formatted).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
