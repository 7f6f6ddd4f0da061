"""Stored mail text as one line of reading, with every place mapped back to the stored text.

Quote marks at line starts, soft line ends, quoted-printable bytes, encoded header words, markup and
entities are read through; blocks of base64 are left out. A character made from an escape maps to the
first character of the escape, all characters of an encoded word to the start of that word.
"""

from __future__ import annotations

import binascii
import html
import re
from bisect import bisect_right

_MARKS = re.compile(r"(?:[ \t]*(?:[>|]|&gt;))+[ \t]?|[ \t]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{57,}={0,2}\Z")
_ESCAPE = re.compile(
    r"=\?[\w-]+\?[QqBb]\?[^?\s]*\?=(?:[ \t]+(?==\?))?|=3D\?[\w-]+\?[QqBb]\?[^?\s]*\?=3D|(?:=[0-9A-F]{2})+|[ÂÃÄÅ][\x80-\xbf]|"
    r"<(?:/?(?:p|br|div|span|b|i|u|em|strong|td|tr|th|table|html|head|body|meta|a|li|ul|ol|font|title|pre|blockquote|h[1-6])\b)[^<>@]*>|"
    r"&(?:#\d+|#x[0-9a-fA-F]+|lt|gt|amp|nbsp|quot|apos|[a-zA-Z]{2,8});"
)
_MISREAD = re.compile(r"[ÂÃÄÅ][\x80-\xbf]")
_WORD = re.compile(r"=\?([\w-]+)\?([QqBb])\?([^?\s]*)\?=")


def _reread(text: str) -> str:
    """UTF-8 once read as Latin-1, read right."""
    return _MISREAD.sub(lambda m: m[0].encode("latin-1").decode("utf-8", "replace"), text)


def _plain(token: str) -> str:
    if token[0] in "ÂÃÄÅ":
        return _reread(token)
    if token.startswith("=3D?"):
        token = token.replace("=3D", "=")
    if token.startswith("=?"):
        charset, coding, data = _WORD.match(token).groups()
        raw = data.replace("_", " ").encode("ascii", "replace")
        try:
            raw = binascii.a2b_base64(raw + b"==") if coding in "Bb" else binascii.a2b_qp(raw)
            return raw.decode(charset, "replace")
        except (binascii.Error, LookupError):
            return " "
    if token[0] == "=":
        raw = bytes.fromhex(token.replace("=", ""))
        try:
            return _reread(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return raw.decode("latin-1")
    if token[0] == "<":
        return "\n" if re.match(r"</?(?:p|br|div|tr|li|h)", token) else ""
    return html.unescape(token).replace("\xa0", " ")


class Flat:
    """``text``: the reading; ``at(i)``: the place in the stored text of its character ``i``."""

    __slots__ = ("text", "_flat", "_stored", "_size")

    def __init__(self, stored: str):
        out: list[str] = []
        flat, place, size = [0], [0], [0]  # size: characters of the escape that a piece stands for, 0 for stored text
        n = pos = off = 0  # off: stored place minus flat place of the stored text that is being read
        soft = True

        def note(at: int, length: int) -> None:
            flat.append(n)
            place.append(at)
            size.append(length)

        for line in stored.split("\n"):
            start, pos = pos, pos + len(line) + 1
            end = len(line)
            if end and line[-1] == "\r":
                end -= 1
            i = 0
            if not soft:
                if start - 1 - n != off:
                    note(start - 1, 0)
                    off = start - 1 - n
                out.append("\n")
                n += 1
                if end and line[0] in " \t>|&" and (m := _MARKS.match(line, 0, end)):
                    i = m.end()
            soft = False
            if i >= end or end - i >= 57 and " " not in line and _BASE64.match(line, i, end):
                continue
            if "=" in line or "<" in line or "&" in line or not line.isascii() and _MISREAD.search(line):
                if line[end - 1] == "=":
                    soft, end = True, end - 1
                for m in _ESCAPE.finditer(line, i, end):
                    a, b = m.span()
                    if i < a:
                        if start + i - n != off:
                            note(start + i, 0)
                            off = start + i - n
                        out.append(line[i:a])
                        n += a - i
                    plain = _plain(m[0])
                    if plain:
                        note(start + a, b - a)
                        off = -1
                        out.append(plain)
                        n += len(plain)
                    i = b
            if i < end:
                if start + i - n != off:
                    note(start + i, 0)
                    off = start + i - n
                out.append(line[i:end] if i or end < len(line) else line)
                n += end - i
        self.text = "".join(out)
        self._flat, self._stored, self._size = flat, place, size

    def at(self, i: int) -> int:
        k = bisect_right(self._flat, i) - 1
        return self._stored[k] + (0 if self._size[k] else i - self._flat[k])

    def end(self, i: int) -> int:
        """Place after the stored characters that character ``i - 1`` stands for."""
        k = bisect_right(self._flat, i - 1) - 1
        return self._stored[k] + (self._size[k] or i - self._flat[k])
