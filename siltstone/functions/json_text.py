"""JSON texts rewritten in one pass over their tokens, whatever their depth: a small helper for Arrow batches.

Containers are closed from the inside out, and each member or element is kept, replaced or left out by a rule as its container
takes it in.  No value is ever built, so nothing recurses and depth is bounded by memory only.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|([{}\[\]:,])|(true|false|null)|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?))')
_COLON = re.compile(r"[ \t\n\r]*:")
_BLANK = re.compile(r"[ \t\n\r]*\Z")

#: So many steps of a path are told at most: rules name places near the root, and depth costs nothing.
STEPS = 8

#: A rule gets the keys that lead to a container (None for a step through an array), the key or the number of elements kept before, the value as compact JSON, and
#: the string that it is, or None; it returns the JSON to take in, or None for nothing.
Rule = Callable[[tuple[str | None, ...], str | int, str, str | None], str | None]


class NotJson(ValueError):
    """The text is no JSON, or holds a number that JSON can't hold."""


def _number(said: str, real: bool) -> str:
    """As Python says it: integers as they are, others in their shortest form."""
    if not real:
        return str(int(said))
    value = float(said)
    if math.isinf(value):
        raise NotJson(said)
    return repr(value)


class _Open:
    """A container that is not closed yet."""

    __slots__ = ("array", "empty", "key", "parts", "path", "ready")

    def __init__(self, array: bool, path: tuple[str | None, ...]) -> None:
        self.array, self.path, self.key = array, path, None
        self.parts: dict = {}
        self.ready = True  # for a member or element; after one, for a comma
        self.empty = True  # nothing has come yet, so it may close though it is ready

    def take(self, value: str, string: str | None, rule: Rule | None) -> None:
        name = len(self.parts) if self.array else self.key
        kept = rule(self.path, name, value, string) if rule else value
        if kept is not None:
            self.parts[name] = kept
        elif not self.array:
            self.parts.pop(name, None)  # of a repeated key the last value counts
        self.key, self.ready, self.empty = None, False, False

    def text(self, ordered: bool) -> str:
        if self.array:
            return "[" + ",".join(self.parts.values()) + "]"
        members = sorted(self.parts.items()) if ordered else self.parts.items()
        return "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in members) + "}"


def rewritten(text: str, rule: Rule | None = None, *, ordered: bool = False) -> str:
    """The text as compact JSON in ASCII after ``rule``; with ``ordered`` keys are sorted, which makes equal values equal texts."""
    stack: list[_Open] = []
    done: str | None = None
    at = 0
    while done is None:
        m = _TOKEN.match(text, at)
        if not m:
            raise NotJson(text[at : at + 20])
        at = m.end()
        quoted, sign, word, number, fraction, power = m.groups()
        top = stack[-1] if stack else None
        value = string = None
        if sign in ("{", "["):
            if top and not (top.ready and (top.array or top.key is not None)):
                raise NotJson(sign)
            path = () if not top else top.path
            if top and len(path) < STEPS:
                path = (*path, None if top.array else top.key)
            stack.append(_Open(sign == "[", path))
            continue
        if sign in ("}", "]"):
            if not top or top.array != (sign == "]") or top.key is not None or (top.ready and not top.empty):
                raise NotJson(sign)
            stack.pop()
            value, top = top.text(ordered), stack[-1] if stack else None
        elif sign == ",":
            if not top or top.ready:
                raise NotJson(sign)
            top.ready = True
            continue
        elif sign == ":":
            raise NotJson(sign)
        elif quoted is not None:
            string = json.loads(quoted)
            if top and not top.array and top.key is None:
                colon = _COLON.match(text, at)
                if not colon or not top.ready:
                    raise NotJson(quoted)
                top.key, at = string, colon.end()
                continue
            value = json.dumps(string)
        else:
            value = word or _number(number, bool(fraction or power))
        if top is None:
            done = value
        elif top.ready and (top.array or top.key is not None):
            top.take(value, string, rule)
        else:
            raise NotJson(value)
    if not _BLANK.match(text, at):
        raise NotJson(text[at : at + 20])
    return done


def canonical(text: str) -> str:
    """Sorted keys, no spaces, ASCII, numbers as Python says them."""
    return rewritten(text, ordered=True)
