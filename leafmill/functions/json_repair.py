"""Broken JSON made whole: fences, words around it, cut ends, missing or wrong brackets and commas, other quotes.

One pass over the text, without recursion: work grows with the length, however deep it nests.  Valid JSON stays as it is.
Otherwise the first ``{`` or ``[`` begins the value, and what stands behind its end is left out.  Then:

* a closing bracket ends what is open inside its own kind; one that nothing opened is passed over; open ends are closed;
* commas may be missing, doubled or trailing; a key before a comma has the value null, a key at a cut end is left out;
* strings stand in double, single or curly quotes; a quote ends one only before ``,`` ``:`` ``}`` ``]``, a quote, or the
  end; bare line ends and other control characters are escaped, an escape that makes no sense loses its backslash;
* bare words are true, false or null in any case (None too), numbers, or else strings; a word cut short by the end is
  the literal that it begins.

Text without a bracket gives null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERALS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null", "undefined": "null"}
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_BARE = re.compile(r"""[^\s,:{}\[\]"“”]+""")
_PLAIN = re.compile(r"""[^"'“”‘’\\\x00-\x1f]+""")
_CLOSES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_SKIPPED = re.compile(r"[\s,:]*")
_SPACE = re.compile(r"\s*")
_PAIR = {"}": "{", "]": "["}
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that begins at a quote, as JSON text, and the place behind it."""
    close = _CLOSES[text[at]]
    out, i, n = [], at + 1, len(text)
    while i < n:
        run = _PLAIN.match(text, i)
        if run:
            out.append(run[0])
            i = run.end()
            continue
        c = text[i]
        if c == "\\":
            escape = _ESCAPE.match(text, i)
            if escape:
                out.append(escape[0])
                i = escape.end()
            else:  # a quote of another kind, or a sign that needs none
                i += 1
            continue
        if c == close or c == '"' and close == "”":
            after = _SPACE.match(text, i + 1).end()
            if after == n or text[after] in ',:}]"“' or close == "'" and text[after] == "'":
                return f'"{"".join(out)}"', i + 1
        out.append(json.dumps(c, ensure_ascii=False)[1:-1])
        i += 1
    return f'"{"".join(out)}"', n


def _word(text: str, at: int) -> tuple[str, int]:
    found = _BARE.match(text, at)
    word, end = found[0], found.end()
    low = word.lower()
    if low in _LITERALS:
        return _LITERALS[low], end
    if end == len(text):
        whole = [v for k, v in _LITERALS.items() if k.startswith(low)]
        if whole:
            return whole[0], end
    number = _NUMBER.match(word)
    if number and (number.end() == len(word) or end == len(text) and re.fullmatch(r"\.|\.?[0-9]*[eE][-+]?", word[number.end() :])):
        return number[0], end
    if end == len(text) and word == "-":
        return "null", end
    return json.dumps(word, ensure_ascii=False), end


def repair(text: str | None) -> str | None:
    """Valid JSON out of a text, or null where it holds none."""
    if text is None:
        return None
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        return text
    except (ValueError, ZeroDivisionError, RecursionError):
        pass
    begin = re.search(r"[{\[]", text)
    if not begin:
        return None
    out: list[str] = []
    #: Open containers: bracket, members so far, key that waits for its value.
    stack: list[list] = []
    i, n = begin.start(), len(text)

    def put(value: str) -> None:
        if stack:
            top = stack[-1]
            if top[1]:
                out.append(", ")
            top[1] += 1
            if top[0] == "{":
                out.append(f'{top[2] if top[2] is not None else chr(34) * 2}: ')
                top[2] = None
        out.append(value)

    def close() -> None:
        out.append("}" if stack.pop()[0] == "{" else "]")

    opened = {"{": 0, "[": 0}
    while True:
        gap = _SKIPPED.match(text, i)
        if stack and stack[-1][2] is not None and "," in gap[0]:
            put("null")
        i = gap.end()
        if i >= n:
            break
        c = text[i]
        if c in "{[":
            put(c)
            stack.append([c, 0, None])
            opened[c] += 1
            i += 1
        elif c in "}]":
            i += 1
            if opened[_PAIR[c]]:
                while True:
                    kind = stack[-1][0]
                    if stack[-1][2] is not None:
                        put("null")
                    close()
                    opened[kind] -= 1
                    if kind == _PAIR[c]:
                        break
            if not stack:
                break
        else:
            value, i = _string(text, i) if c in _CLOSES else _word(text, i) if c not in "”" else ("", i + 1)
            if not value:
                continue
            if stack[-1][0] == "{" and stack[-1][2] is None:
                stack[-1][2] = value if value[0] == '"' else json.dumps(value)
            else:
                put(value)
    while stack:
        close()
    return "".join(out)


@F.pandas_udf(T.StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(repair, na_action="ignore")


def repaired_json(text: Column) -> Column:
    """Valid JSON out of a text column; nulls and texts without any give null."""
    return _repaired(text)
