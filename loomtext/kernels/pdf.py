"""Text of a PDF file: plain and deflated streams, literal and hexadecimal strings, maps from codes to Unicode."""

from __future__ import annotations

import re
import time
import zlib
from dataclasses import dataclass

from loomtext.errors import InvalidInput


@dataclass(frozen=True)
class Options:
    max_bytes: int = 50 << 20
    timeout_secs: float = 30.0


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]+|\[|\]|[-+.\d]+|[A-Za-z'\"*]+[0-9]?", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        if c.isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else _LETTERS.get(c, c)

    if raw[:1] == b"(":
        return _ESCAPE.sub(one, raw[1:-1])
    digits = re.sub(rb"\s", b"", raw[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _decode(raw: bytes, codes: dict[int, str], width: int) -> str:
    if codes:
        return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def _code_map(stream: bytes) -> tuple[dict[int, str], int]:
    """From a ToUnicode stream: text by code, and bytes to a code."""
    out, width = {}, 1
    clean = lambda b: b.strip(b"<>")
    wide = lambda b: bytes.fromhex(clean(b).decode()).decode("utf-16-be", "replace")
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for a, b in re.findall(rb"(<[0-9A-Fa-f]+>)\s*(<[0-9A-Fa-f]+>)", body):
            out[int(clean(a), 16)], width = wide(b), max(1, len(clean(a)) // 2)
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"(<[0-9A-Fa-f]+>)\s*(<[0-9A-Fa-f]+>)\s*(<[0-9A-Fa-f]+>)", body):
            base, width = wide(c), max(1, len(clean(a)) // 2)
            for i in range(min(int(clean(b), 16) - int(clean(a), 16) + 1, 65_536)):
                out[int(clean(a), 16) + i] = base[:-1] + chr(min(ord(base[-1]) + i, 0x10FFFF)) if base else ""
    return out, width


def _shown(stream: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    parts, stack, codes, width = [], [], {}, 1
    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t[:1] in b"(</[]" or t[:1] in b"+-.0123456789":
            stack.append(t)
            continue
        if t == b"Tf":
            codes, width = next((fonts[x[1:]] for x in stack if x[:1] == b"/" and x[1:] in fonts), ({}, 1))
        elif t in (b"Tj", b"'", b'"', b"TJ"):
            if t in (b"'", b'"'):
                parts.append("\n")
            for x in stack:
                if x[:1] in b"(<":
                    parts.append(_decode(_literal(x), codes, width))
                elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:
                    parts.append(" ")
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            parts.append("\n")
        stack = []
    return "".join(parts)


def text(data: bytes, options: Options = Options()) -> str:
    """Text of every content stream in file order; NUL becomes U+FFFD."""
    if len(data) > options.max_bytes:
        raise InvalidInput(f"the file is larger than {options.max_bytes} bytes")
    if b"%PDF-" not in data[:1024]:
        raise InvalidInput("not a PDF file")
    until = time.monotonic() + options.timeout_secs
    heads: dict[int, bytes] = {}
    streams: dict[int, bytes] = {}
    for m in _OBJECT.finditer(data):
        if time.monotonic() > until:
            raise InvalidInput("the time for one file is over")
        end = data.find(b"endobj", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        s = _STREAM.search(body)
        heads[int(m[1])] = body[: s.start()] if s else body
        if s:
            stop = body.rfind(b"endstream")
            raw = body[s.end() : stop if stop >= 0 else len(body)]
            if b"/FlateDecode" in heads[int(m[1])]:
                try:
                    raw = zlib.decompressobj().decompress(raw, options.max_bytes + 1)
                except zlib.error:
                    continue
                if len(raw) > options.max_bytes:
                    raise InvalidInput(f"a stream inflates to more than {options.max_bytes} bytes")
            streams[int(m[1])] = raw
    if not heads:
        raise InvalidInput("the file has no objects")
    maps = {k: _code_map(streams[int(u[1])]) for k, h in heads.items() if (u := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", h)) and int(u[1]) in streams}
    fonts = {name: maps[int(n)] for h in heads.values() for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", h) if int(n) in maps}
    out = []
    for k, s in sorted(streams.items()):
        if time.monotonic() > until:
            raise InvalidInput("the time for one file is over")
        if b"BT" in s and b"beginbf" not in s:
            out.append(_shown(s, fonts))
    joined = re.sub(r"\n{2,}", "\n", "\n".join(out)).strip()
    return joined.replace("\0", "\ufffd")
