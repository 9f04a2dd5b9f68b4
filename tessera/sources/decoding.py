"""Bytes to text: encodings told apart by their marks and shapes."""

from __future__ import annotations


def _strict(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except (UnicodeDecodeError, LookupError):
        return None


def bare_utf16(data: bytes) -> str | None:
    """UTF-16 without a mark: a third of the byte pairs have a zero on the same side."""
    if len(data) < 16 or len(data) % 2:
        return None
    pairs, low, high = len(data) // 2, data[1::2].count(0), data[0::2].count(0)
    if 3 * low >= pairs and low >= high:
        return "utf-16-le"
    return "utf-16-be" if 3 * high >= pairs else None


def decode(data: bytes | None) -> tuple[str, str]:
    """(text, encoding): by mark, then UTF-8, bare UTF-16 and GB18030 as far as they are valid, else UTF-8 with replacements. Null is empty."""
    if not data:
        return "", "empty"
    if data.startswith(b"\xef\xbb\xbf"):
        if (text := _strict(data[3:], "utf-8")) is not None:
            return text, "utf-8-sig"
        data = data[3:]
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[2:].decode(name, "replace"), f"{name}-bom"
    text = _strict(data, "utf-8")
    if text is not None and "\x00" not in text:
        return text, "utf-8"
    if name := bare_utf16(data):
        wide = _strict(data, name)
        if wide is not None and "\x00" not in wide:
            return wide, name
    if (text := _strict(data, "gb18030")) is not None:
        return text, "gb18030"
    return data.decode("utf-8", "replace"), "utf-8-loose"
