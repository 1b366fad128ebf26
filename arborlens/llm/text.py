"""Texts in a form that only their words decide."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Container, Iterator

import pyarrow as pa
import pyarrow.compute

#: Bytes of text that are worked on at once; a longer text is a portion of its own.
PORTION = 4 << 20

#: UTF-8 bytes that were read as Latin-1 or Windows-1252: a lead byte and its followers.
_BROKEN = re.compile("[\u00c2-\u00df](?:[\u0080-\u00bf]|[\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122])")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"'/\\]))")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u00ad](?:\r?\n|(?:\\r)?\\n)[ \t]*(?:[>#*/]+[ \t]*)?(?=([^\W\d_]+))")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
#: What any break by a hyphen holds; looked for first, since hardly a text has one.
_BREAKS = ("-\n", "-\r", "-\\n", "-\\r", "\u2010", "\u00ad")


def _mend(m: re.Match) -> str:
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in m[0]).decode("utf-8")
    except UnicodeError:
        return m[0]


def mended(text: str) -> str:
    """The text with letters restored that were decoded with the wrong code."""
    return _BROKEN.sub(_mend, text) if ("\u00c3" in text or "\u00c2" in text or "\u00c5" in text) else text


def unescaped(text: str) -> str:
    """The text without JSON escapes, character references and tags."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] in "nrtbf" else m[2], text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


def words(text: str | None) -> list[str]:
    """The words of a text in lower case without accents, however it is written and laid out."""
    if not text:
        return []
    text = unescaped(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", mended(text).replace("\u00ad", "")))
    return _WORD.findall(text.casefold() if not text.isascii() else text.lower())


def readings(text: str | None, known: Container[str] = ()) -> list[str | None]:
    """The text, and with words joined that a hyphen breaks at a line's end: all, and only those that give a ``known`` word.

    A break does not tell whether the hyphen belongs to the word, so neither reading replaces the other.
    """
    if not text or not any(b in text for b in _BREAKS) or not _HYPHEN.search(text):
        return [text]

    def join(m: re.Match) -> str:
        at = m.start()
        while at and text[at - 1].isalpha():
            at -= 1
        return "" if "".join(words(text[at : m.start()] + m[1])) in known else m[0]

    return list(dict.fromkeys([text, _HYPHEN.sub("", text), *([_HYPHEN.sub(join, text)] if known else [])]))


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about :data:`PORTION` bytes of a text column, so that long texts do not add up."""
    size, at = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= PORTION:
            yield batch.slice(at, i + 1 - at)
            size, at = 0, i + 1
    if at < batch.num_rows:
        yield batch.slice(at)
