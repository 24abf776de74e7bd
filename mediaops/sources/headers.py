"""Size, transparency, orientation and page count of image files, from their headers alone."""

from __future__ import annotations

import re
import struct
import zlib
from typing import NamedTuple

#: Bytes that a walk over a file reads at a time.
WINDOW = 1 << 16


class Header(NamedTuple):
    image_type: str
    width: int
    height: int
    has_alpha: bool
    orientation: int = 1
    n_pages: int = 1


class Ranges:
    """Random access to a file (or to bytes) by windows: only those that a walk enters are read."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if isinstance(self.source, bytes):
            return self.source[at : at + n]
        if at < self.at or at + n > self.at + len(self.held):
            self.source.seek(min(at, self.size))
            self.at, self.held = at, self.source.read(max(n, WINDOW))
        return self.held[at - self.at : at - self.at + n]

    def number(self, at: int, n: int, order: str = "big") -> int:
        data = self(at, n)
        if len(data) < n:
            raise EOFError
        return int.from_bytes(data, order)


def exif_orientation(tiff: bytes) -> int | None:
    """Orientation of 1 to 8 in the first directory of a TIFF block."""
    try:
        found = next(tiff_directories(Ranges(bytes(tiff), len(tiff))), {}).get(274, 0)
    except (EOFError, struct.error):
        return None
    return found if 1 <= found <= 8 else None


def tiff_directories(r: Ranges):
    """The tags of each directory, with the first value of each tag of whole numbers."""
    order = {b"II": "little", b"MM": "big"}.get(r(0, 2))
    version = r.number(2, 2, order) if order else 0
    if version not in (42, 43):
        return
    wide = version == 43
    count, word, entry = (8, 8, 20) if wide else (2, 4, 12)
    at, seen = r.number(8 if wide else 4, word, order), set()
    while at and at not in seen:
        seen.add(at)
        tags, n = {}, r.number(at, count, order)
        for i in range(n):
            place = at + count + entry * i
            tag, kind = r.number(place, 2, order), r.number(place + 2, 2, order)
            if kind in (3, 4):
                tags[tag] = r.number(place + (12 if wide else 8), 2 if kind == 3 else 4, order)
        yield tags
        after = at + count + entry * n
        at = r.number(after, word, order) if after + word <= r.size else 0


def tiff(r: Ranges) -> Header | None:
    pages = list(tiff_directories(r))
    if not pages or 256 not in pages[0] or 257 not in pages[0]:
        return None
    t = pages[0]
    colours = {2: 3, 5: 4, 6: 3, 8: 3}.get(t.get(262, 0), 1)
    turned = t.get(274, 1)
    return Header("tiff", t[256], t[257], t.get(277, 1) > colours, turned if 1 <= turned <= 8 else 1, len(pages))


def png(r: Ranges) -> Header | None:
    width, height, colour = r.number(16, 4), r.number(20, 4), r.number(25, 1)
    at, alpha, orientation = 8, colour in (4, 6), 1
    while at + 12 <= r.size and (kind := r(at + 4, 4)) != b"IDAT":
        size = r.number(at, 4)
        alpha |= kind == b"tRNS"
        if kind == b"eXIf":
            orientation = exif_orientation(r(at + 8, size)) or 1
        at += 12 + size
    return Header("png", width, height, alpha, orientation)


def jpeg(r: Ranges) -> Header | None:
    at, orientation = 2, 1
    while at + 4 <= r.size and r(at, 1) == b"\xff":
        marker = r.number(at + 1, 1)
        if marker == 0xFF:
            at += 1
            continue
        size = r.number(at + 2, 2)
        if marker == 0xE1 and r(at + 4, 6) == b"Exif\0\0":
            orientation = exif_orientation(r(at + 10, size - 8)) or 1
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return Header("jpeg", r.number(at + 7, 2), r.number(at + 5, 2), False, orientation)
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def gif(r: Ranges) -> Header | None:
    width, height, flags = r.number(6, 2, "little"), r.number(8, 2, "little"), r.number(10, 1) if r.size > 10 else 0
    at, frames, alpha = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0, False

    def skip(at: int) -> int:
        while at < r.size and (n := r.number(at, 1)):
            at += n + 1
        return at + 1

    while at < r.size and (kind := r.number(at, 1)) in (0x21, 0x2C):
        if kind == 0x21:
            if r(at + 1, 1) == b"\xf9" and at + 3 < r.size:
                alpha |= bool(r.number(at + 3, 1) & 1)
            at = skip(at + 2)
        else:
            frames += 1
            if at + 9 >= r.size:
                break
            flags = r.number(at + 9, 1)
            at = skip(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return Header("gif", width, height, alpha, 1, max(frames, 1))


def bmp(r: Ranges) -> Header | None:
    height = r.number(22, 4, "little")
    return Header("bmp", r.number(18, 4, "little"), 2**32 - height if height >= 2**31 else height, r.number(28, 2, "little") == 32)


def webp(r: Ranges) -> Header | None:
    at, size, alpha, orientation, frames, still = 12, None, False, 1, 0, None
    while at + 8 <= r.size:
        kind, length = r(at, 4), r.number(at + 4, 4, "little")
        if kind == b"VP8X":
            size, alpha = (r.number(at + 12, 3, "little") + 1, r.number(at + 15, 3, "little") + 1), bool(r.number(at + 8, 1) & 0x10)
        elif kind == b"VP8L":
            bits = r.number(at + 9, 4, "little")
            still, alpha = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1), bool(bits >> 28 & 1) if size is None else alpha
        elif kind == b"VP8 ":
            still = r.number(at + 14, 2, "little") & 0x3FFF, r.number(at + 16, 2, "little") & 0x3FFF
        elif kind == b"ANMF":
            frames += 1
        elif kind == b"EXIF":
            data = r(at + 8, length)
            orientation = exif_orientation(data[6:] if data[:6] == b"Exif\0\0" else data) or 1
        if size is None and still:
            break
        at += 8 + length + length % 2
    size = size or still
    return Header("webp", *size, alpha, orientation, max(frames, 1)) if size else None


def boxes(r: Ranges, at: int, end: int):
    """(kind, start of body, end) of the boxes of an ISO media file between two places."""
    while at + 8 <= end:
        n, kind, body = r.number(at, 4), r(at + 4, 4), at + 8
        if n == 1:
            n, body = r.number(at + 8, 8), at + 16
        stop = end if n == 0 else at + n
        if stop < body:
            return
        yield kind, body, min(stop, end)
        at = stop


def iso(r: Ranges) -> Header | None:
    """AVIF and HEIF: the largest picture is the whole one, of which others are tiles or thumbnails."""
    brand, best, alpha, turns = r(8, 4), None, False, 0
    for kind, a, b in boxes(r, 0, r.size):
        if kind != b"meta":
            continue
        for _, c, d in ((k, c, d) for k, c, d in boxes(r, a + 4, b) if k == b"iprp"):
            for _, e, f in ((k, e, f) for k, e, f in boxes(r, c, d) if k == b"ipco"):
                for name, g, h in boxes(r, e, f):
                    if name == b"ispe":
                        size = r.number(g + 4, 4), r.number(g + 8, 4)
                        best = max(best or size, size, key=lambda s: s[0] * s[1])
                    elif name == b"auxC":
                        alpha |= b"alpha" in r(g, h - g) or b"hevc:2015:auxid:1" in r(g, h - g)
                    elif name == b"irot":
                        turns = r.number(g, 1) & 3
    if best is None:
        return None
    return Header("avif" if brand in (b"avif", b"avis") else "heif", *(best[::-1] if turns % 2 else best), alpha)


def jp2(r: Ranges) -> Header | None:
    for kind, a, b in boxes(r, 0, r.size):
        for inner, c, _ in boxes(r, a, b) if kind == b"jp2h" else ():
            if inner == b"ihdr":
                return Header("jp2", r.number(c + 4, 4), r.number(c, 4), r.number(c + 8, 2) in (2, 4))
    return None


def ico(r: Ranges) -> Header | None:
    n = r.number(4, 2, "little")
    sizes = [(r.number(6 + 16 * i, 1) or 256, r.number(7 + 16 * i, 1) or 256, r.number(12 + 16 * i, 2, "little")) for i in range(n)]
    return Header("ico", *max(sizes)[:2], max(sizes)[2] == 32, 1, n) if sizes else None


#: Pixels of a unit of length at 96 to the inch.
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}


def svg(r: Ranges) -> Header | None:
    tag = re.search(rb"<svg\b[^>]*>", r(0, WINDOW), re.S)
    if tag is None:
        return None
    given = dict(re.findall(r"""\b(width|height|viewBox)\s*=\s*["']([^"']*)["']""", tag[0].decode("utf-8", "replace")))
    lengths = [re.fullmatch(r"\s*([0-9.]+(?:[eE][+-]?[0-9]+)?)\s*([a-z]*)\s*", given.get(k, "")) for k in ("width", "height")]
    sizes = [float(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None for m in lengths]
    box = [float(x) for x in re.findall(r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?", given.get("viewBox", ""))]
    if len(box) == 4 and box[2] > 0 and box[3] > 0:
        ratio = box[2] / box[3]
        w, h = sizes
        sizes = [w if w else h * ratio if h else box[2], h if h else w / ratio if w else box[3]]
    return Header("svg", *(max(1, round(s)) for s in sizes), True) if all(sizes) else None


def enclosing(text: bytes, at: int) -> bytes:
    """The PDF dictionary that a place lies in."""
    low, depth = at, 0
    while low > 0:
        begins, ends = text.rfind(b"<<", 0, low), text.rfind(b">>", 0, low)
        low = max(begins, ends)
        if low < 0 or begins > ends and not depth:
            break
        depth += 1 if ends > begins else -1
    high, depth = at, 0
    while high < len(text):
        begins, ends = text.find(b"<<", high), text.find(b">>", high)
        if ends < 0:
            break
        high = min(x for x in (begins, ends) if x >= 0) + 2
        if high == ends + 2 and not depth:
            break
        depth += -1 if high == ends + 2 else 1
    return text[max(low, 0) : high]


def pdf(r: Ranges) -> Header | None:
    """Pages of the root of the page tree, and the first page box in points; object streams are inflated,
    of several roots (a file that was saved in steps) the last one counts."""
    data = r(0, r.size)
    parts = [data]
    for m in re.finditer(rb"/Type\s*/ObjStm\b", data):
        start = data.find(b"stream", m.end())
        try:
            parts.append(zlib.decompressobj().decompress(data[start + 6 :].lstrip(b"\r\n")))
        except zlib.error:
            continue
    roots, box = [], None
    for part in parts:
        for m in re.finditer(rb"/Type\s*/Pages\b", part):
            node = enclosing(part, m.start())
            if b"/Parent" not in node and (count := re.search(rb"/Count\s+([0-9]+)", node)):
                roots.append(int(count[1]))
        if box is None and (m := re.search(rb"/MediaBox\s*\[\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s*\]", part)):
            box = [float(x) for x in m.groups()]
    if not roots or box is None:
        return None
    return Header("pdf", round(abs(box[2] - box[0])), round(abs(box[3] - box[1])), True, 1, roots[-1])


def probe(r: Ranges) -> Header | None:
    """The header of a file; null for other kinds and broken or cut ones."""
    head = r(0, 16)
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return png(r)
        if head[:3] == b"\xff\xd8\xff":
            return jpeg(r)
        if head[:4] == b"GIF8":
            return gif(r)
        if head[:2] == b"BM":
            return bmp(r)
        if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            return tiff(r)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return webp(r)
        if head[4:8] == b"ftyp":
            return iso(r)
        if head[4:8] == b"jP  ":
            return jp2(r)
        if head[:4] == b"\0\0\1\0":
            return ico(r)
        if head[:5] == b"%PDF-":
            return pdf(r)
        return svg(r) if b"<" in head else None
    except (EOFError, struct.error):
        return None
