"""Regular expressions written in RE2 syntax, evaluated by Spark's Java engine.

Configuration files use RE2 (``(?P<name>...)``, no look-around, no back references).  A pattern is
checked and rewritten once on the driver; executors only see literal Java patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What RE2 means by these escapes, in Java syntax (outside / inside a class).
_SPACE_CLASS = "\\t\\n\\f\\r "
_PASS_ESCAPES = set("AbBdDwWafnrtzQE")
_POSIX_CLASSES = {
    "alnum": "\\p{Alnum}",
    "alpha": "\\p{Alpha}",
    "ascii": "\\p{ASCII}",
    "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}",
    "digit": "\\p{Digit}",
    "graph": "\\p{Graph}",
    "lower": "\\p{Lower}",
    "print": "\\p{Print}",
    "punct": "\\p{Punct}",
    "space": "\\p{Space}",
    "upper": "\\p{Upper}",
    "word": "\\w",
    "xdigit": "\\p{XDigit}",
}
_MAX_REPEAT = 1000


class RegexError(ValueError):
    """The pattern is not valid RE2 syntax."""


@dataclass(frozen=True)
class Pattern:
    """A checked pattern: its original text, its Java form and its groups."""

    source: str
    java: str
    group_count: int
    names: dict[str, int] = field(default_factory=dict, compare=False, hash=False)

    def group_index(self, name: str) -> int | None:
        if name.isdigit():
            index = int(name)
            return index if index <= self.group_count else None
        return self.names.get(name)


class _Translator:
    def __init__(self, text: str):
        self.text = text
        self.pos = 0
        self.out: list[str] = []
        self.groups = 0
        self.names: dict[str, int] = {}
        self.multiline = False

    def fail(self, why: str):
        raise RegexError(f"invalid regular expression {self.text!r}: {why}")

    def peek(self, width: int = 1) -> str:
        return self.text[self.pos : self.pos + width]

    def run(self) -> Pattern:
        depth = 0
        outer_flags: list[bool] = []
        repeatable = False  # may a quantifier follow?
        quantified = False  # did a quantifier just end?
        while self.pos < len(self.text):
            char = self.peek()
            if char in "*+?" or (char == "{" and self._repeat_at()):
                if quantified:
                    self.fail("nested repetition operator")
                if not repeatable:
                    self.fail("missing argument to repetition operator")
                self._quantifier()
                repeatable, quantified = True, True
                continue
            quantified = False
            if char == "(":
                outer_flags.append(self.multiline)
                opened = self._open_group()
                if opened:
                    depth += 1
                else:
                    outer_flags.pop()
                repeatable = False
            elif char == ")":
                if depth == 0:
                    self.fail("unexpected )")
                depth -= 1
                self.multiline = outer_flags.pop()
                self._emit(")")
                repeatable = True
            elif char == "[":
                self._char_class()
                repeatable = True
            elif char == "\\":
                self._escape()
                repeatable = True
            elif char == "|":
                self._emit("|")
                repeatable = False
            elif char == "$":
                self._emit("$" if self.multiline else "\\z", 1)
                repeatable = True
            elif char in "{}":
                self._emit("\\" + char, 1)
                repeatable = True
            else:
                self._emit(char, 1)
                repeatable = True
        if depth:
            self.fail("missing closing )")
        return Pattern(self.text, "(?d)" + "".join(self.out), self.groups, self.names)

    def _emit(self, java: str, width: int = 1):
        self.out.append(java)
        self.pos += width

    def _repeat_at(self):
        return re.compile(r"\{(\d+)(,(\d*))?\}").match(self.text, self.pos)

    def _quantifier(self):
        if self.peek() == "{":
            found = self._repeat_at()
            low, high = int(found[1]), found[3]
            if low > _MAX_REPEAT or (high and (int(high) > _MAX_REPEAT or int(high) < low)):
                self.fail("invalid repeat count")
            self._emit(found[0], len(found[0]))
        else:
            self._emit(self.peek())
        if self.peek() == "?":
            self._emit("?")

    def _open_group(self) -> bool:
        if self.peek(2) != "(?":
            self.groups += 1
            self._emit("(")
            return True
        named = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>").match(self.text, self.pos)
        if named:
            if named[1] in self.names:
                self.fail(f"duplicate group name {named[1]}")
            self.groups += 1
            self.names[named[1]] = self.groups
            self._emit("(", len(named[0]))
            return True
        flags = re.compile(r"\(\?([ims]*)(-([ims]+))?([:)])").match(self.text, self.pos)
        if not flags or (not flags[1] and not flags[3] and flags[4] == ")"):
            self.fail("unsupported group syntax")
        turned_on, turned_off = flags[1], flags[3] or ""
        if "m" in turned_on:
            self.multiline = True
        if "m" in turned_off:
            self.multiline = False
        java = "(?" + turned_on.replace("i", "iu")
        java += "-" + turned_off.replace("i", "iu") if turned_off else ""
        self._emit(java + flags[4], len(flags[0]))
        return flags[4] == ":"

    def _escape(self, inside: bool = False):
        following = self.peek(2)[1:]
        if not following:
            self.fail("trailing backslash")
        if following == "s":
            self._emit(_SPACE_CLASS if inside else f"[{_SPACE_CLASS}]", 2)
        elif following == "S":
            self._emit("\\S\\x0B" if inside else f"[^{_SPACE_CLASS}]", 2)
        elif following == "v":
            self._emit("\\x0B", 2)
        elif following == "Q" and not inside:
            end = self.text.find("\\E", self.pos)
            end = len(self.text) if end < 0 else end
            literal = self.text[self.pos + 2 : end]
            self._emit("".join(_quote(c) for c in literal), end - self.pos)
            if self.peek(2) == "\\E":
                self.pos += 2
        elif following in "pP":
            found = re.compile(r"\\[pP](?:\{(\^?)(\w+)\}|(\w))").match(self.text, self.pos)
            if not found:
                self.fail("invalid character class range")
            name = found[2] or found[3]
            letter = following
            if found[1]:
                letter = "P" if following == "p" else "p"
            java = name if len(name) <= 2 else f"Is{name}"
            self._emit(f"\\{letter}{{{java}}}", len(found[0]))
        elif following == "x":
            found = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|[0-9A-Fa-f]{2})").match(
                self.text, self.pos
            )
            if not found:
                self.fail("invalid escape sequence")
            self._emit(found[0], len(found[0]))
        elif following == "0":
            found = re.compile(r"\\0[0-7]{0,2}").match(self.text, self.pos)
            self._emit("\\0" + (found[0][2:] or "0"), len(found[0]))
        elif following in _PASS_ESCAPES and not (inside and following in "AbBzQE"):
            self._emit("\\" + following, 2)
        elif following.isalnum():
            self.fail(f"invalid escape sequence \\{following}")
        else:
            self._emit(_quote(following), 2)

    def _char_class(self):
        self._emit("[")
        if self.peek() == "^":
            self._emit("^")
        first = True
        while True:
            char = self.peek()
            if not char:
                self.fail("missing closing ]")
            if char == "]" and not first:
                self._emit("]")
                return
            posix = re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.pos)
            if posix:
                if posix[2] not in _POSIX_CLASSES:
                    self.fail("invalid character class range")
                java = _POSIX_CLASSES[posix[2]]
                if posix[1]:
                    java = java.replace("\\p", "\\P").replace("\\w", "\\W")
                self._emit(java, len(posix[0]))
            elif char == "\\":
                self._escape(inside=True)
            elif char in "[]&~^" or (char == "-" and first):
                self._emit("\\" + char, 1)
            else:
                self._emit(char, 1)
            first = False


def _quote(char: str) -> str:
    return "\\" + char if not char.isalnum() and char.isascii() and not char.isspace() else char


@lru_cache(maxsize=4096)
def compile_pattern(text: str) -> Pattern:
    """Check an RE2 pattern and rewrite it for Java; raises :class:`RegexError`."""
    return _Translator(text).run()


def required_texts(text: str) -> list[str]:
    """Texts that every match of a valid RE2 pattern contains, as written; none where nothing is sure.

    Only the outermost sequence counts: what is inside of a group or class, may be left out or stands in an
    alternative is not required, and a pattern that ignores case requires nothing.
    """
    found: list[str] = []
    run: list[str] = []
    depth = position = 0

    def close() -> None:
        if run:
            found.append("".join(run))
            run.clear()

    while position < len(text):
        char = text[position]
        width, literal = 1, None
        if char == "\\":
            following = text[position + 1]
            if following == "Q":
                end = text.find("\\E", position)
                end = len(text) if end < 0 else end
                body = text[position + 2 : end]
                width, literal = min(end + 2, len(text)) - position, body
            elif following in "pPx":
                width = len(re.compile(r"\\[pPx](\{[^}]*\}|[0-9A-Fa-f]{2}|.)").match(text, position)[0])
            elif following == "0":
                width = len(re.compile(r"\\0[0-7]{0,2}").match(text, position)[0])
            else:
                width = 2
                literal = None if following.isalnum() else following
        elif char == "[":
            position = _class_end(text, position)
            width = 0
        elif char == "(":
            if re.compile(r"\(\?[ims]*i").match(text, position):
                return []
            depth += 1
        elif char == ")":
            depth -= 1
        elif char == "|" and not depth:
            return []
        elif char not in ".^$*+?{}|":
            literal = char
        elif char in "{}" and not re.compile(r"\{\d+(,\d*)?\}").match(text, position):
            literal = char
        after = position + width
        # After an opening bracket a question mark is no repetition.
        repeat = None if char == "(" else re.compile(r"[*?+]|\{(\d+)(,\d*)?\}").match(text, after)
        if literal is None or depth or repeat:
            # The repeated character alone may be left out; what was read before it stays.
            if literal and not depth and len(literal) > 1:
                run.append(literal[:-1])
            close()
            if literal and not depth and repeat and (repeat[0] == "+" or (repeat[1] and int(repeat[1]) > 0)):
                found.append(literal[-1])
            if literal and depth == 0 and not repeat:
                run.append(literal)
        else:
            run.append(literal)
        position = after if not repeat else repeat.end()
        if repeat and text[position : position + 1] == "?":
            position += 1
    close()
    return found


def _class_end(text: str, position: int) -> int:
    """The place after a character class."""
    position += 1
    if text[position : position + 1] == "^":
        position += 1
    first = True
    while text[position] != "]" or first:
        first = False
        posix = re.compile(r"\[:\^?\w+:\]").match(text, position)
        position += len(posix[0]) if posix else 2 if text[position] == "\\" else 1
    return position + 1


def anchored(text: str) -> Pattern:
    """The pattern that must match the whole text."""
    return compile_pattern(f"^(?:{text})$")


def matches(column: Column, pattern: Pattern) -> Column:
    return column.rlike(pattern.java)


def group(column: Column, pattern: Pattern, index: int) -> Column:
    """Text of a group, or an empty text; only meaningful on rows that match."""
    return F.regexp_extract(column, pattern.java, index)


_TEMPLATE = re.compile(r"\$(?:\$|(\w+)|\{(\w+)\})", re.ASCII)


def expand(template: str, column: Column, pattern: Pattern) -> Column:
    """Expand ``$1``, ``${name}`` and ``$$`` for the leftmost match in ``column``.

    A name is the longest run of word characters, and unknown groups expand to nothing.
    """
    pieces: list[Column] = []
    literal = ""
    position = 0
    for found in _TEMPLATE.finditer(template):
        literal += template[position : found.start()]
        position = found.end()
        if found[0] == "$$":
            literal += "$"
            continue
        index = pattern.group_index(found[1] or found[2])
        if index is None:
            continue
        if literal:
            pieces.append(F.lit(literal))
            literal = ""
        pieces.append(group(column, pattern, index))
    literal += template[position:]
    if literal:
        pieces.append(F.lit(literal))
    if not pieces:
        return F.lit("")
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]
