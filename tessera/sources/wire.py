"""Wire formats: protocol buffers, framed messages, JSON with bounds, XML elements, state in scripts."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

MOST_DEPTH = 64


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut short or too long")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """number, kind and value of each field of a message: numbers, and bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise ValueError("field 0")
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                raise ValueError("a field is cut short")
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is cut short")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"kind {kind}")
        yield number, kind, value


def framed(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """(whether it is a trailer, content) of messages that have a flag and a length before them."""
    at = 0
    while at < len(data):
        if at + 5 > len(data):
            raise ValueError("a frame is cut short")
        flag, size = struct.unpack_from(">BI", data, at)
        if flag & 1:
            raise ValueError("a compressed frame")
        if at + 5 + size > len(data):
            raise ValueError("a frame is cut short")
        yield bool(flag & 128), data[at + 5 : at + 5 + size]
        at += 5 + size


def parsed(text: str, depth: int = MOST_DEPTH) -> Any:
    """A JSON value; what nests deeper than that, or has something behind it, is refused."""
    level = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text):
        level += {"[": 1, "{": 1, "]": -1, "}": -1}.get(m[0], 0)
        if level > depth:
            raise ValueError("nested too deeply")
    return json.loads(text)


def looked_up(value: Any, path: str, default: Any = None) -> Any:
    """What stands at a path of names and places, a.0.b."""
    for step in path.split("."):
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return default
    return value


def state(html: str, name: str) -> Any:
    """The JSON value that a script assigns to a name, or None."""
    found = re.search(rf"{re.escape(name)}\s*=\s*", html)
    if not found:
        return None
    try:
        return json.JSONDecoder().raw_decode(html, found.end())[0]
    except ValueError:
        return None


def elements(xml: str, tag: str) -> list[tuple[dict[str, str], str]]:
    """Attributes and text of each element of a name, whatever its namespace; a document type is refused."""
    if "<!DOCTYPE" in xml.upper():
        raise ValueError("document type declared")
    local = lambda x: x.rsplit("}", 1)[-1]
    return [({local(k): v for k, v in e.attrib.items()}, "".join(e.itertext()).strip()) for e in ElementTree.fromstring(xml).iter() if local(e.tag) == tag]
