"""JSON that a model or a cut-off answer left broken: found inside other text, separated, closed or cut back to what is whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLOSE = {"{": "}", "[": "]"}
SPACE = " \t\r\n"
#: A string, whole or up to the text's end, or a mark.
TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[{}\[\],]', re.S)


class Scanner:
    """Walks a text once, with a stack of the brackets that are open, and tells where each value of the outermost list begins and ends.

    A mark of the outermost list itself, commas and other text between values are passed over. Inside a string brackets mean nothing, and a backslash takes the next character along.
    """

    def __init__(self, text: str):
        self.text = text
        self.whole: list[tuple[int, int]] = []
        self.open_at: int | None = None  # where the value begins that the text ends within
        self.stack: list[str] = []
        #: Of the value that is open: ends of what is whole inside, with the brackets open there.
        self.safe: tuple[int, str] | None = None
        self.in_string = False
        self._scan()

    def _scan(self) -> None:
        begin = self.text.find("{")
        while begin != -1:
            end = self._value(begin)
            if end is None:
                self.open_at = begin
                return
            begin = self.text.find("{", end)

    def _value(self, begin: int) -> int | None:
        """The end of the object that begins here; None if the text ends within it."""
        self.stack, self.safe, self.in_string = ["{"], (begin + 1, "{"), False
        for m in TOKEN.finditer(self.text, begin + 1):
            c, at = m[0][0], m.start()
            if c == '"':
                self.in_string = not m[1]
            elif c in CLOSE:
                if c == "{" and self._follows_value(at):  # the object that is open was never closed, and ends here
                    return at
                self.stack.append(c)
                self.safe = m.end(), "".join(self.stack)
            elif c == ",":
                self.safe = at, "".join(self.stack)
            elif CLOSE[self.stack.pop()] != c:  # brackets that don't match: nothing whole begins here
                return m.end()
            elif self.stack:
                self.safe = m.end(), "".join(self.stack)
            else:
                self.whole.append((begin, m.end()))
                return m.end()
        return None

    def _follows_value(self, at: int) -> bool:
        while at and self.text[at - 1] in SPACE:
            at -= 1
        return self.text[at - 1] not in ",:[{"


def fenced(text: str) -> str:
    """What stands between fences, the part named json first; the text itself without any."""
    for fence in ("```json", "```"):
        if fence in text:
            return text.split(fence, 1)[1].split("```", 1)[0].strip()
    return text.strip()


def loaded(text: str) -> object | None:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def salvaged(text: str | None) -> str | None:
    """The object in a text: fenced or not, with other text around it. None without one."""
    bare = fenced(text or "")
    if not bare.startswith("{"):
        begin, end = bare.find("{"), bare.rfind("}") + 1
        if begin != -1 and end > begin:
            bare = bare[begin:end]
    value = loaded(bare)
    return written(value) if isinstance(value, dict) else None


def closed(text: str, scanner: Scanner) -> object | None:
    """The value that the text ends within: cut back to the last place where all was whole, or else to the end of a string, and closed. A key without a value goes."""
    if scanner.open_at is None:
        return None
    tail = text[scanner.open_at :].rstrip(SPACE)
    ends = "".join(CLOSE[c] for c in reversed(scanner.stack))
    tries = [tail + ends, tail.rstrip("\\") + '"' + ends] if scanner.in_string else [tail + ends, tail.rstrip(",") + ends]
    if scanner.safe is not None:
        at, stack = scanner.safe
        tries.append(text[scanner.open_at : at] + "".join(CLOSE[c] for c in reversed(stack)))
    return next((v for t in tries if isinstance(v := loaded(t), dict)), None)


def _objects(text: str) -> Iterator[object]:
    scanner = Scanner(text)
    found = 0
    for begin, end in scanner.whole:
        value = loaded(text[begin:end])
        if isinstance(value, dict):
            found += 1
            yield value
    if not found and (value := closed(text, scanner)) is not None:
        yield value


def repaired(text: str | None) -> list[str]:
    """The different objects of a broken list, in the order in which they come: joined ones are separated, repeats go, and one that the text ends within goes too, unless it is the only one, which is closed."""
    return list(dict.fromkeys(written(v) for v in _objects(fenced(text or ""))))


@F.pandas_udf(T.StringType())
def _salvaged(texts: pd.Series) -> pd.Series:
    return texts.map(salvaged)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def json_in(text: Column) -> Column:
    """The object in a text, as JSON with sorted keys; null if there is none that is whole. Fences and text around it go."""
    return _salvaged(text)


def json_objects(text: Column) -> Column:
    """The objects of a broken list as an array of JSON texts with sorted keys, empty without any. See `repaired`."""
    return _repaired(text)
