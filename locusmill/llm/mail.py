"""What a reader sees of a stored mail: its text parts with transfer encodings and markup undone, at any depth.

Every part can tell where each of its bytes comes from: the map to the stored text is made on demand, by
undoing the part once more with places. A byte made from an escape maps to the first character of the escape.

Only ASCII letters and digits matter to the callers, so everything else may become a separator; that
makes the reading independent of charsets, right or wrong.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Callable, Iterator

import numpy as np

_HEAD = re.compile(r"\r?\n[ \t]*\r?\n")
_TYPE = re.compile(r"^content-type:[ \t]*([^\s;]*)((?:[^\n]|\n[ \t])*)", re.I | re.M)
_CODED = re.compile(r"^content-transfer-encoding:[ \t]*([\w-]+)", re.I | re.M)
_BOUNDARY = re.compile(r'boundary="?([^"\r\n;]+)"?', re.I)
_WORD = re.compile(r"=\?[^?\s]*\?([QqBb])\?([^?]*)\?=")
_HIDDEN = re.compile(rb"<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(rb"</?(?:b|i|u|em|strong|span|font|a|small|big|sub|sup|tt|code|wbr|s|mark)(?:\s[^<>]*)?>", re.I)
_TAG = re.compile(rb"<[a-zA-Z/!][^<>]*>")
_ENTITY = re.compile(rb"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+[0-9]*);?")
_NOT64 = re.compile(rb"[^A-Za-z0-9+/]")


def unbase64(data: bytes) -> bytes:
    data = _NOT64.sub(b"", data)
    return binascii.a2b_base64(data[: len(data) // 4 * 4] + (data[len(data) // 4 * 4 :] + b"==")[:4] * (len(data) % 4 > 1))


def _entity(m: re.Match[bytes]) -> bytes:
    n = m[1]
    if n[:1] == b"#":
        v = int(n[2:] or b"0", 16) if n[1:2] in b"xX" else int(re.sub(rb"\D.*", b"", n[1:]) or b"0")
        return bytes([v]) if v < 128 else b"?"
    return b" "


def unmarked(html: bytes) -> bytes:
    """Text of HTML; inline tags vanish, others separate."""
    html = _TAG.sub(b" ", _INLINE.sub(b"", _HIDDEN.sub(b" ", html)))
    return _ENTITY.sub(_entity, html) if b"&" in html else html


def _ascii(text: str) -> bytes:
    return text.encode("ascii", "replace")


def _decoded_word(m: re.Match[str]) -> str:
    if m[1] in "Bb":
        return unbase64(_ascii(m[2])).decode("utf-8", "replace")
    return binascii.a2b_qp(_ascii(m[2].replace("_", " "))).decode("utf-8", "replace")


def _sub(pattern: re.Pattern, by: Callable[[re.Match], bytes | str], data, places: np.ndarray):
    """``pattern.sub`` that keeps the places: what a match becomes has the place of its first character."""
    out, at, last = [], [], 0
    for m in pattern.finditer(data):
        new = by(m)
        out += [data[last : m.start()], new]
        at += [places[last : m.start()], np.full(len(new), places[m.start()])]
        last = m.end()
    return data[:0].join([*out, data[last:]]), np.concatenate([*at, places[last:]])


_QP = re.compile(rb"=[ \t]*\r?\n|=([0-9A-Fa-f]{2})")


def _places(raw: bytes, coding: str, html: bool, start: int) -> np.ndarray:
    """The stored place of each byte that the part's reading has, and one more for its end."""
    places = np.arange(start, start + len(raw) + 1)
    data = raw
    if coding == "quoted-printable":
        data, places = _sub(_QP, lambda m: bytes.fromhex(m[1].decode()) if m[1] else b"", data, places)
        if data != (read := binascii.a2b_qp(raw)):  # broken coding: of such a part only its own place is known
            data, places = read, np.append(np.full(len(read), start), start + len(raw))
    elif coding == "base64":
        kept = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)))
        data = unbase64(raw)
        places = np.append(places[kept[np.minimum(np.arange(len(data)) * 4 // 3, len(kept) - 1)]], places[-1]) if len(data) else places[-1:]
    if html:
        end = places[-1:]
        for pattern, by in ((_HIDDEN, lambda m: b" "), (_INLINE, lambda m: b""), (_TAG, lambda m: b" "), (_ENTITY, _entity)):
            data, body = _sub(pattern, by, data, places[:-1])
            places = np.append(body, end)
    return places


def _header_places(head: str, start: int) -> np.ndarray:
    places = np.arange(start, start + len(head))
    joined, places = _sub(re.compile(r"\?=\s+=\?"), lambda m: "?==?", head, places)
    return np.append(_sub(_WORD, _decoded_word, joined, places)[1], start + len(head))


def visible(text: str) -> Iterator[tuple[bytes, Callable[[], np.ndarray]]]:
    """The header and each readable part in order: its bytes, and a function for the place in ``text`` of each byte."""
    todo = [(0, len(text), False)]  # regions still to read, the next one last; parts of a mail have no header of their own but the first lines
    while todo:
        start, end, inner = todo.pop()
        m = _HEAD.search(text, start, end)
        split, body = (m.start(), m.end()) if m else (end, end)
        if re.compile(r"[A-Za-z][\w-]*:|From ").match(text, start, end):
            head = text[start:split]
        else:
            head, body = "", start
            if inner and text.startswith(("\n", "\r\n"), start, end):
                body = start + 1
        if head and not inner:
            shown = _WORD.sub(_decoded_word, re.sub(r"\?=\s+=\?", "?==?", head))
            yield _ascii(shown), lambda head=head, start=start: _header_places(head, start)
        kind = _TYPE.search(head)
        media = kind[1].lower() if kind else "text/plain"
        if media.startswith("multipart/") and (b := _BOUNDARY.search(kind[2])):
            mark = re.compile(r"(?m)^--" + re.escape(b[1].strip()) + r"(?:--)?[ \t]*\r?$\n?")
            marks = [x.span() for x in mark.finditer(text[body:end])]
            if marks:
                cuts = [body + a for a, _ in marks] + [end]
                if marks[0][0] > 0:
                    yield _ascii(text[body : cuts[0]]), lambda a=body, z=cuts[0]: np.arange(a, z + 1)
                todo += [(body + z, cuts[i + 1], True) for i, (_, z) in reversed(list(enumerate(marks))) if cuts[i + 1] > body + z]
                continue
        if media == "message/rfc822":
            todo.append((body, end, True))
            continue
        if not media.startswith(("text/", "multipart/")):
            continue
        raw = data = _ascii(text[body:end])
        coding = _CODED.search(head)
        coding = coding[1].lower() if coding else ""
        if coding == "quoted-printable":
            data = binascii.a2b_qp(raw)
        elif coding == "base64":
            data = unbase64(raw)
        html = media == "text/html" or (media != "text/plain" and re.search(rb"<html", data, re.I) is not None)
        if html:
            data = unmarked(data)
        yield data, lambda raw=raw, coding=coding, html=html, start=body: _places(raw, coding, html, start)
