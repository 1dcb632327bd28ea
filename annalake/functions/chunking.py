"""Per-document text helpers: paragraph packing and header lookup.

Small by design: Spark distributes the documents, these functions only walk
one text. Sizes count UTF-16 code units and the whitespace and line-end
classes are spelled out, so results do not depend on a regex dialect.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Chunking defaults, whitespace and line-end characters.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
CHARACTERS_PER_WORD = 5
PARAGRAPH_SEPARATOR = r"\n\n+"
WHITESPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_ENDS = "\n\r\u2028\u2029"

_SPACES = re.compile(f"[{WHITESPACE}]+")
_EDGES = "".join(chr(c) for c in range(0x10000) if _SPACES.fullmatch(chr(c)))
_HEADER_BODY = re.compile(f"#{{1,6}}[{WHITESPACE}]+[^{LINE_ENDS}]+")
_HEADER = re.compile(f"(?:\\A|(?<=[{LINE_ENDS}]))" + _HEADER_BODY.pattern)
_HEADER_MARK = re.compile(f"^#+[{WHITESPACE}]+")


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def trim(text: str) -> str:
    return text.strip(_EDGES)


def last_words(text: str, count: int) -> list[str]:
    """The last ``count`` whitespace-separated words, read from the end."""
    reach = 16 * count
    while count:
        words = _SPACES.split(text[-reach:])
        if len(words) > count or reach >= len(text):
            return words[-count:]
        reach *= 2
    return []


def pack_paragraphs(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separator: str = PARAGRAPH_SEPARATOR,
) -> Iterator[str]:
    """Fill chunks with whole paragraphs up to ``size``.

    A paragraph that does not fit closes the chunk; the next one starts with
    the last ``overlap / 5`` words. A paragraph longer than ``size`` stays in one
    piece.
    """
    keep = overlap // CHARACTERS_PER_WORD
    open_chunk, length = "", 0
    for paragraph in re.split(separator, text):
        added = utf16_length(paragraph)
        if open_chunk and length + added > size:
            yield trim(open_chunk)
            tail = " ".join(last_words(open_chunk, keep))
            open_chunk = f"{tail}\n\n{paragraph}"
            length = utf16_length(tail) + 2 + added
        elif open_chunk:
            open_chunk = f"{open_chunk}\n\n{paragraph}"
            length += 2 + added
        else:
            open_chunk, length = paragraph, added
    if last := trim(open_chunk):
        yield last


def _headers(text: str) -> list[re.Match]:
    return list(_HEADER.finditer(text)) if "#" in text else []


def headers_in(text: str) -> list[str]:
    """Markdown header titles in order."""
    return [_HEADER_MARK.sub("", m.group()) for m in _headers(text)]


class Sections:
    """Answers which header a chunk of one document stands under."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = _headers(text)
        self.starts = [m.start() for m in found]
        self.ends = [m.end() for m in found]
        self.titles = [m.group() for m in found]

    def before(self, chunk: str) -> str | None:
        """Last header ahead of the chunk's first occurrence, None when the
        chunk opens the document, was re-spaced by the overlap, or no header
        precedes it."""
        position = self.text.find(chunk) if self.titles else 0
        if position <= 0:
            return None
        whole = bisect_right(self.ends, position)
        if whole < len(self.starts) and self.starts[whole] < position:
            # The occurrence cuts a header line; what is left may still be one.
            cut = _HEADER_BODY.match(self.text, self.starts[whole], position)
            if cut:
                return _HEADER_MARK.sub("", cut.group())
        return _HEADER_MARK.sub("", self.titles[whole - 1]) if whole else None
