"""The text of simple PDF files: pages in the order of the page tree, strings shown in content streams.

Streams may be plain or deflated, objects may stand in object streams. Strings are read as Latin-1, or as UTF-16 where they
say so; fonts with encodings of their own (two-byte glyph numbers) need an extractor of the caller's instead. A file without
a readable page has an empty text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"\bstream\r?\n", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+|/[^\s/\[\]()<>]*|\(", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A shift to the left in a line's array, in thousandths of the font's size, from which it stands for a blank.
BLANK_SHIFT = -200


def stream_of(body: bytes) -> bytes | None:
    """An object's stream, inflated; None where it has none or another filter."""
    found = _STREAM.search(body)
    if not found:
        return None
    head = body[: found.start()]
    data = body[found.end() : body.rfind(b"endstream")]
    if b"/Filter" not in head:
        return data
    if b"/FlateDecode" not in head or b"/Predictor" in head:
        return None
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return None


def objects_of(content: bytes) -> dict[int, bytes]:
    """Object number -> body, those in object streams too; a later one replaces an earlier."""
    found = {int(number): body for number, body in _OBJECT.findall(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (data := stream_of(body)) is not None:
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = [int(x) for x in data[:first].split()]
            places = [first + at for at in numbers[1::2]]
            for number, start, stop in zip(numbers[0::2], places, [*places[1:], len(data)]):
                found.setdefault(number, data[start:stop])
    return found


def references(body: bytes, key: bytes) -> list[int]:
    """The objects that ``key`` of a dictionary names, one or an array."""
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R\b)", body)
    return [int(n) for n in _REFERENCE.findall(found[1])] if found else []


def pages_of(objects: dict[int, bytes]) -> list[bytes]:
    """The page objects in order; without a page tree in the order of their numbers."""
    is_page = lambda body: re.search(rb"/Type\s*/Page\b", body) is not None
    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body]
    out, open_, seen = [], roots[:1], set()
    while open_:
        number = open_.pop(0)
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if is_page(body):
            out.append(body)
        open_ = references(body, b"Kids") + open_
    return out or [body for _, body in sorted(objects.items()) if is_page(body)]


def string_of(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = b"".join(token[1:-1].split())
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPED.get(m[1], m[1]), token[1:-1])
    return raw.decode("utf-16", "replace") if raw.startswith((b"\xfe\xff", b"\xff\xfe")) else raw.decode("latin-1")


def shown(stream: bytes) -> str:
    """The strings that a content stream shows, lines apart where the place on the page changes."""
    out: list[str] = []
    held: list[str] = []
    for token in _TOKEN.findall(stream):
        if token.startswith((b"(", b"<")) and len(token) > 1:
            held.append(string_of(token))
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            if out and not out[-1].endswith("\n"):
                out.append("\n")
            held = []
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"') and out and not out[-1].endswith("\n"):
                out.append("\n")
            out += held
            held = []
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            if held and float(token) <= BLANK_SHIFT:
                held.append(" ")
        elif token.isalpha():
            held = []
    return "".join(out).rstrip("\n")


def extract_pdf(content: bytes) -> str:
    """The pages' texts with a blank line between."""
    objects = objects_of(content)
    texts = []
    for page in pages_of(objects):
        streams = [stream_of(objects.get(n, b"")) for n in references(page, b"Contents")]
        texts.append(shown(b"\n".join(s for s in streams if s is not None)))
    return "\n\n".join(t for t in texts if t.strip())
