"""The value of a JavaScript literal as JSON, told by parsing; nothing is ever run.

``to_json`` reads one literal: strings, numbers, true, false, null, undefined, arrays and
objects of these, with signs before numbers and ``!`` before any. It writes what
``JSON.stringify`` would: the shortest digits of numbers, object keys in the order of the
language (array indices first, by value), undefined left out of objects and null in arrays.
Whatever else stands there (names, operators, calls, templates) has no value here.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

#: A function that only returns an expression, and what such an expression mustn't have.
ONLY_RETURNS = r"\bfunction\s+\w+\s*\(\s*\)[^{]*\{\s*return\s+([\s\S]*?)\s*;?\s*\}\s*$"
UNSAFE = r"[();`]|\b(?:new|this|function|class|await|yield|global|process|require|import)\b"
_RETURNS, _UNSAFE = re.compile(ONLY_RETURNS), re.compile(UNSAFE)
#: A head that the runtime understands: no types, nothing but ``export`` and ``async`` before it.
_PLAIN = re.compile(r"\s*(?:export\s+)?(?P<later>async\s+)?function\s+(?P<name>\w+)\s*\(\s*\)(?:\s|//[^\n]*\n|/\*(?:[^*]|\*(?!/))*\*/)*\{\s*return\s")
_LONE = re.compile("[\ud800-\udfff]")
#: Tokens of literals; single letters after a backslash; how deep literals may nest.
_SPACE = re.compile(r"(?:\s|\ufeff|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?")
_STRING = re.compile(r"'((?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*)'|\"((?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*)\"")
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|[\s\S]))")
_NAME = re.compile(r"[A-Za-z_$\u00aa-\uffff][\w$]*")
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}
_WORDS = {"true": True, "false": False, "null": None, "Infinity": math.inf, "NaN": math.nan}
DEEPEST = 200
UNDEFINED = object()


class NoLiteral(ValueError):
    """What stands there isn't a literal of the kind described above."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def skip(self) -> str:
        """The next character after blanks and comments."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        if self.skip() != sign:
            return False
        self.at += 1
        return True

    def token(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m is not None:
            self.at = m.end()
        return m

    def value(self):
        self.depth += 1
        if self.depth > DEEPEST:
            raise NoLiteral("too deep")
        out = self._value()
        self.depth -= 1
        return out

    def _value(self):
        c = self.skip()
        if c in ("'", '"'):
            return self.string()
        if c == "[":
            return self.array()
        if c == "{":
            return self.object()
        if c and c in "+-!":
            self.at += 1
            if self.text[self.at : self.at + 1] == c and c != "!":
                raise NoLiteral("an increment")
            own = self.value()
            if c == "!":
                return own is UNDEFINED or own is None or own is False or (isinstance(own, float) and (own == 0 or math.isnan(own))) or own == ""
            if not isinstance(own, float):
                raise NoLiteral("a sign before something else than a number")
            return -own if c == "-" else own
        if c.isdigit() or c == ".":
            return self.number()
        word = self.token(_NAME)
        if word is None or word[0] not in {*_WORDS, "undefined"}:
            raise NoLiteral("a name")
        return UNDEFINED if word[0] == "undefined" else _WORDS[word[0]]

    def number(self) -> float:
        m = self.token(_NUMBER)
        if m is None or _NAME.match(self.text, self.at) or self.text[self.at : self.at + 1].isdigit():
            raise NoLiteral("no number")
        digits = m[0].replace("_", "")
        return float(int(digits, 0)) if digits[:2].lower() in ("0x", "0o", "0b") else float(digits)

    def string(self) -> str:
        m = self.token(_STRING)
        if m is None:
            raise NoLiteral("no string")

        def plain(e: re.Match) -> str:
            code = e[1] or e[2] or e[3]
            if code is not None:
                if int(code, 16) > 0x10FFFF:
                    raise NoLiteral("no character")
                return chr(int(code, 16))
            if e[4] in "ux" or (e[4].isdigit() and (e[4] != "0" or m[0][e.end() + 1 : e.end() + 2].isdigit())):
                raise NoLiteral("an odd escape")
            return _LETTERS.get(e[4], e[4])

        return _ESCAPE.sub(plain, m[1] if m[1] is not None else m[2]).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")

    def array(self) -> list:
        self.at += 1
        out = []
        while not self.take("]"):
            if self.take(","):
                out.append(UNDEFINED)  # a hole
                continue
            out.append(self.value())
            if not self.take(","):
                if not self.take("]"):
                    raise NoLiteral("no array")
                break
        return out

    def object(self) -> dict:
        self.at += 1
        out: dict[str, object] = {}
        while not self.take("}"):
            c = self.skip()
            word = self.token(_NAME)
            key = word[0] if word else self.string() if c in ("'", '"') else number_text(self.number()) if c.isdigit() or c == "." else None
            if key is None or key == "__proto__" or not self.take(":"):
                raise NoLiteral("no property")
            out[key] = self.value()
            if not self.take(","):
                if not self.take("}"):
                    raise NoLiteral("no object")
                break
        return out


def number_text(x: float) -> str:
    """A number as the language writes it."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        text = text + "0" * (point - len(text)) if point >= len(text) else text[:point] + "." + text[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + text
    else:
        text = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def _quoted(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def _written(value) -> str:
    if value is None or value is UNDEFINED:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_text(value) if math.isfinite(value) else "null"
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    index = [k for k in value if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1]
    order = sorted(index, key=int) + [k for k in value if k not in set(index)]
    return "{" + ",".join(f"{_quoted(k)}:{_written(value[k])}" for k in order if value[k] is not UNDEFINED) + "}"


def to_json(text: str) -> str | None:
    """A literal as JSON; None where it isn't one, or undefined."""
    reader = _Reader(text)
    try:
        value = reader.value()
    except NoLiteral:
        return None
    return None if reader.skip() or value is UNDEFINED else _written(value)


def returned_json(target: str | None, symbol: str | None) -> tuple[str, str | None, str | None]:
    """(behaviour, value as JSON, what is wrong) of a function's code; see ``code.behaviour``."""
    returns = _RETURNS.search(target) if isinstance(target, str) else None
    if returns is None or _UNSAFE.search(_STRING.sub('""', returns[1])):  # what a string says is no code
        return "not_eligible", None, None
    value = to_json(returns[1])
    if value is None:
        return "not_eligible", None, None
    head = _PLAIN.match(target)
    if head is None or head.end() > returns.start(1):
        return "fail", None, "the runtime doesn't read the declaration"
    if head["name"] != symbol:
        return "fail", None, "another function's name"
    if head["later"] and value != "{}":
        return "fail", None, "a promise, not the value"
    return "pass", value, None
