"""Sizes and written facts of images, from their headers. Their text is for OCR."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the formats: tags that are kept, by number.
TAGS = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x013B: "author", 0x8298: "copyright", 0x9003: "created"}
_WIDTH, _HEIGHT, _MORE = 0x0100, 0x0101, 0x8769


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _png(data: bytes) -> dict[str, str]:
    out = {}
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            out["width"], out["height"] = map(str, struct.unpack_from(">II", body))
        elif kind == b"tEXt":
            key, _, value = body.partition(b"\x00")
            out[key.decode("latin-1").lower()] = value.decode("latin-1").strip()
        elif kind == b"eXIf":
            out |= _tiff(body)
    return out


def _tiff(data: bytes) -> dict[str, str]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    todo, seen, out = [struct.unpack_from(order + "I", data, 4)[0]], set(), {}
    pages = 0
    while todo:
        at = todo.pop()
        if at in seen or not 0 < at <= len(data) - 2:
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        sized = False
        for i in range(n):
            place = at + 2 + 12 * i
            if place + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            short, long = struct.unpack_from(order + "H", data, place + 8)[0], struct.unpack_from(order + "I", data, place + 8)[0]
            if tag in (_WIDTH, _HEIGHT):
                sized = True
                out.setdefault("width" if tag == _WIDTH else "height", str(short if kind == 3 else long))
            elif tag == _MORE:
                todo.append(long)
            elif tag in TAGS and kind == 2:
                start = place + 8 if count <= 4 else long
                text = data[start : start + count].partition(b"\x00")[0].decode("utf-8", "replace").strip()
                if text:
                    out.setdefault(TAGS[tag], text)
        pages += sized
        following = at + 2 + 12 * n
        if following + 4 <= len(data):
            todo.append(struct.unpack_from(order + "I", data, following)[0])
    return out | ({"pages": str(pages)} if pages else {})


def _jpeg(data: bytes) -> dict[str, str]:
    out, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(b"Exif\x00\x00"):
            out |= {k: v for k, v in _tiff(body[6:]).items() if k not in ("width", "height", "pages")}
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            return out | {"width": str(width), "height": str(height)}
        at += 2 + size
    return out


def _webp(data: bytes) -> dict[str, str]:
    kind, body = data[12:16], data[20:]
    if kind == b"VP8X":
        size = [1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7)]
    elif kind == b"VP8L":
        bits = int.from_bytes(body[1:5], "little")
        size = [1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)]
    else:
        size = [v & 0x3FFF for v in struct.unpack_from("<HH", body, 6)]
    return {"width": str(size[0]), "height": str(size[1])}


def facts(data: bytes) -> dict[str, str]:
    """Width, height and what tags say; empty if the header is none that is known."""
    try:
        if data.startswith(b"\x89PNG"):
            return _png(data)
        if data.startswith(b"\xff\xd8"):
            return _jpeg(data)
        if data[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(data)
        if data.startswith(b"GIF8"):
            return dict(zip(("width", "height"), map(str, struct.unpack_from("<HH", data, 6)), strict=True))
        if data.startswith(b"BM"):
            width, height = struct.unpack_from("<ii", data, 18)
            return {"width": str(width), "height": str(abs(height))}
        if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
            return _webp(data)
    except (struct.error, IndexError):
        pass
    return {}


def read_image(data: bytes, out) -> None:
    found = facts(data)
    if not found:
        raise ValueError("no image header")
    out.meta |= found
