"""JSON objects as leaves, one object at a time.

A leaf is (path, listy, in_list, empty, kind, text): paths join keys with dots, and ``[]``
marks lists of objects; a listy path has one leaf an element, also where a list holds
scalars (``in_list``).  An empty list or object is one leaf marked ``empty``.  kind is null,
bool, num, str or other; text is a scalar as a plain string and anything else as JSON.
Objects of any depth that the parser accepts are taken apart to the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import NamedTuple

_FENCE = re.compile(r"\s*```(?:json)?\s*", re.ASCII)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]|[^"{}\[\]]++', re.DOTALL)
_STEP = {"{": (1, 0), "}": (-1, 0), "[": (0, 1), "]": (0, -1)}


class Number(str):
    """A JSON number as it is written."""

    __slots__ = ()


class Leaf(NamedTuple):
    path: str
    listy: bool
    in_list: bool
    empty: bool
    kind: str
    text: str


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number)


def parse(text: str) -> dict:
    """An object from JSON text that is one."""
    return _DECODER.decode(text)


def encode(value: object) -> str:
    """Compact JSON with keys in order, numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{encode(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def scalar(value: object) -> tuple[str, str]:
    """kind and text of a value that is taken apart no further."""
    if value is None:
        return "null", "null"
    if value is True or value is False:
        return "bool", "true" if value else "false"
    if isinstance(value, Number):
        return "num", str(value)
    if isinstance(value, str):
        return "str", value
    return "other", encode(value)


def leaf_json(leaf: Leaf) -> str:
    """A leaf's value as JSON."""
    return json.dumps(leaf.text, ensure_ascii=False) if leaf.kind == "str" else leaf.text


def _is_object_list(value: list) -> bool:
    objects = False
    for x in value:
        if isinstance(x, dict):
            objects = True
        elif x is not None:
            return False
    return objects


def flatten(value: dict) -> list[Leaf]:
    """The leaves of an object, keys in order."""
    out: list[Leaf] = []
    # reversed, so that what is pushed last and taken first comes first
    todo: list[tuple[str, bool, object]] = [(k, False, v) for k, v in sorted(value.items(), reverse=True)]
    while todo:
        path, listy, v = todo.pop()
        if type(v) is str:
            out.append(Leaf(path, listy, False, False, "str", v))
        elif type(v) is Number:
            out.append(Leaf(path, listy, False, False, "num", str(v)))
        elif isinstance(v, dict) and v:
            todo += [(f"{path}.{k}" if path else k, listy, x) for k, x in sorted(v.items(), reverse=True)]
        elif isinstance(v, list) and v and _is_object_list(v):
            todo += [(f"{path}[]", True, x) for x in reversed(v)]
        elif isinstance(v, list) and v:
            out += [Leaf(path, True, True, x in ({}, []), *scalar(x)) for x in v]
        else:
            out.append(Leaf(path, listy, False, v in ({}, []), *scalar(v)))
    return out


def strip_fences(text: str) -> str:
    """What stands between the first fence line and the next, or the text itself."""
    if "```" not in text:
        return text
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    fences = [i for i, line in enumerate(lines) if _FENCE.fullmatch(line)]
    if not fences:
        return text
    return "\n".join(lines[fences[0] + 1 : fences[1] if len(fences) > 1 else len(lines)])


def find_object(text: str | None, tail: bool = False, fences: bool = True) -> str | None:
    """The first balanced {...} of a text, or None (with ``tail``: the rest of the text).

    Braces in strings do not count.  The scan runs over tokens (strings, brackets and what
    is between them), not characters.
    """
    if text is None:
        return None
    body = strip_fences(text) if fences else text
    begin = body.find("{")
    if begin < 0:
        return None
    curly = square = 0
    for m in _TOKEN.finditer(body, begin):
        if step := _STEP.get(m[0]):
            curly, square = curly + step[0], square + step[1]
            if m[0] == "}" and not curly and not square:
                return body[begin : m.end()]
    return body[begin:] if tail else None


def unflatten(rows: Iterable[tuple[str, list[str], bool]]) -> str:
    """A JSON object from (path, JSON values, repeated).

    Lists of objects are zipped by index; a short list leaves its leaf out of later items.
    """
    quoted = lambda t: json.dumps(t, ensure_ascii=False)
    parts: list[str] = []
    lists: dict[str, list[tuple[str, list[str]]]] = {}
    for path, values, repeated in rows:
        if repeated:
            parent, _, leaf = path.partition("[].")
            lists.setdefault(parent, []).append((leaf, values))
        else:
            parts.append(f"{quoted(path)}:{values[0]}")
    for parent, columns in lists.items():
        longest = max(len(v) for _, v in columns)
        items = ("{" + ",".join(f"{quoted(leaf)}:{v[i]}" for leaf, v in columns if i < len(v)) + "}" for i in range(longest))
        parts.append(f"{quoted(parent)}:[{','.join(items)}]")
    return "{" + ",".join(parts) + "}"
