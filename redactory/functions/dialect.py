"""One pattern, two regular-expression dialects.

Patterns are written with \\b for a border between an ASCII word character and
anything else, \\m for such a border before a word character, \\M for one after
it, and \\s for ASCII white space. Java's \\b sees accented letters as word
characters, so it is spelled out there; RE2's does not. \\m and \\M cost one
look at a neighbour; use them where what follows, or precedes, is a word character.
"""

from __future__ import annotations

import re

#: Java's \w is ASCII's; one look in a table, where the class spelled out is a union of four.
_W = r"\w"
_BORDER = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
#: A border before one capital letter, which few places have: it is looked for first.
_CAPITAL = re.compile(r"\\[bm]\[A-Z\](?![*?{])")


def java(pattern: str, ignore_case: bool = False) -> str:
    """For Spark."""
    pattern = _CAPITAL.sub(lambda _: f"(?=[A-Z])(?<!{_W})[A-Z]", pattern)
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _BORDER).replace(r"\m", f"(?={_W})(?<!{_W})").replace(r"\M", f"(?!{_W})")


def re2(pattern: str, ignore_case: bool = False) -> str:
    """For SQL engines with RE2."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\m", r"\b").replace(r"\M", r"\b")


def screen(pattern: str, ignore_case: bool = False) -> str:
    """For RE2, where it has to find all that Spark finds: the vertical tab, which RE2 does not count, is white space too."""
    out, in_class, i = "", False, 0
    while i < len(pattern):
        sign = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(sign)
        if sign == r"\s":
            out += r"\s\x0B" if in_class else r"[\s\x0B]"
            continue
        if sign == "[" and not in_class:
            in_class = True
            if pattern[i : i + 1] == "^":
                sign, i = "[^", i + 1
        elif sign == "]":
            in_class = False
        out += sign
    return re2(out, ignore_case)


def quoted(text: str) -> str:
    """A standard SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
