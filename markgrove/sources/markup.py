"""Tolerant HTML/XML parser: one pass over the bytes of a document, no recursion, no implied tags.

The parser never fails. It yields a flat, pre-ordered list of nodes with byte
offsets. What it promises:

* offsets are byte offsets into the UTF-8 source; names are lower-cased; entities
  are left alone; whitespace-only text is kept except between top-level nodes;
* ``<x/>`` and void elements have no content; script, style, textarea and title
  hold raw text up to their own closing tag;
* an element ends at the closing tag of its own name. Any other closing tag inside
  it is consumed, becomes literal text of the element (but no node), and moves the
  end of its content. An element that is never closed ends with the document;
* a malformed opening tag is dropped and parsing resumes after the next ``>`` or
  at the next ``<``; between top-level nodes only its first character is dropped;
* ``<!...>`` that is neither comment nor doctype is a comment up to ``>`` inside an
  element; NUL is an ordinary character; of a repeated attribute the last value
  counts, once.
"""

from __future__ import annotations

import re

ELEMENT, ATTRIBUTE, TEXT, INSTRUCTION, COMMENT, DOCUMENT, DOCTYPE = 1, 2, 3, 7, 8, 9, 10

#: Elements without content, and elements whose content is raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title".split())

_SPACE = rb"[ \t\n\r]*"
_NAME = re.compile(rb"[A-Za-z0-9_:-]+")
_ATTRIBUTE = re.compile(
    _SPACE + rb"([A-Za-z0-9_:-]+)" + _SPACE + rb"(?:=" + _SPACE + rb"(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|((?:[^ \t\n\r>/]|/(?!>))*)))?"
)
#: A well-formed opening tag; possessive throughout, so that a malformed one fails at once.
_TAG = re.compile(
    rb"<([A-Za-z0-9_:-]++)((?:[ \t\n\r]*+[A-Za-z0-9_:-]++[ \t\n\r]*+(?:=[ \t\n\r]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])(?:[^ \t\n\r>/]|/(?!>))*+))?+)*+)[ \t\n\r]*+(/?+)>"
)
_SPACES = re.compile(_SPACE)
_RESYNC = re.compile(rb"[<>]")
_RAW_END = {name: re.compile(rb"</" + name.encode() + rb"(?=[> \t\n\r])", re.I) for name in RAW_TEXT}


#: A node's fields, in this order; ``attributes`` is an element's raw text of them (see ``read_attributes``); ``last`` is its last descendant, ``text_from``/``text_to`` delimit an element's text in the joined chunks.
FIELDS = ("kind", "name", "parent", "depth", "start", "end", "content_start", "content_end", "value", "attributes", "text_from", "text_to", "last")
_END, _CONTENT_END, _TEXT_FROM, _TEXT_TO, _LAST = (FIELDS.index(f) for f in ("end", "content_end", "text_from", "text_to", "last"))


def read_attributes(raw: bytes) -> dict[str, str]:
    """The attributes in the part of an opening tag after its name, in order; of repeated ones the last, at its place."""
    found: dict[str, str] = {}
    for item in _ATTRIBUTE.finditer(raw):
        name, double, single, bare = item.groups()
        key = name.decode().lower()
        found.pop(key, None)
        found[key] = (double or single or bare or b"").decode("utf-8", "replace")
    return found


def _failed_at(source: bytes, at: int, n: int) -> int:
    """Where the malformed opening tag at ``at`` stops being one."""
    found = _NAME.match(source, at + 1)
    if not found:
        return at + 1
    bad = found.end()
    while bad < n and (item := _ATTRIBUTE.match(source, bad)):
        bad = item.end()
    bad = _SPACES.match(source, bad).end()
    return bad + (source[bad : bad + 1] == b"/")


def parse(source: bytes) -> tuple[list[list], list[bytes]]:
    """All nodes of ``source`` in pre-order, the document first, and the chunks of its text."""
    rows: list[list] = []
    chunks: list[bytes] = []
    n = len(source)
    size = 0  # length of the joined text so far
    stack: list[int] = []
    names: list[bytes] = []

    def add(kind: int, name: str, start: int, end: int, value: bytes = b"", attributes: bytes | None = None, content: int = 0) -> int:
        index = len(rows)
        rows.append([kind, name, stack[-1] if stack else None, len(stack), start, end, content, content, value, attributes, size, size, index])
        return index

    def say(chunk: bytes) -> None:
        nonlocal size
        chunks.append(chunk)
        size += len(chunk)

    def close(end: int) -> None:
        index = stack.pop()
        names.pop()
        row = rows[index]
        row[_END], row[_TEXT_TO], row[_LAST] = end, size, len(rows) - 1

    stack.append(add(DOCUMENT, "#document", 0, n))
    names.append(b"")
    at = 0
    while True:
        inside = len(stack) > 1
        if not inside:
            at = _SPACES.match(source, at).end()
        if at >= n:
            break
        if source[at] != 60:  # text up to the next "<"
            end = source.find(b"<", at)
            end = n if end < 0 else end
            text = source[at:end]
            rows.append([TEXT, "#text", stack[-1], len(stack), at, end, 0, 0, text, None, size, size, len(rows)])
            if inside:
                chunks.append(text)
                size += end - at
            at = end
            continue
        mark = source[at + 1 : at + 2]
        if mark == b"/":
            if not inside:
                at += 1  # what follows the "<" is text
                continue
            found = _NAME.match(source, at + 2)
            closing = found.group() if found else b""
            rows[stack[-1]][_CONTENT_END] = at
            end = source.find(b">", at + 2 + len(closing))
            at = n if end < 0 else end + 1
            if closing.lower() == names[-1]:
                close(at)
            else:
                say(b"</" + closing + b">")
            continue
        if mark == b"!":
            if source[at : at + 9].upper() == b"<!DOCTYPE":
                end = source.find(b">", at)
                end = n if end < 0 else end + 1
                add(DOCTYPE, "#doctype", at, end, source[at:end])
            elif source.startswith(b"<!--", at):
                stop = source.find(b"-->", at + 4)
                end = stop + 3 if stop >= 0 else max(at + 4, n - 2)
                add(COMMENT, "#comment", at, end, source[at + 4 : stop if stop >= 0 else end])
            elif inside:
                stop = source.find(b">", at)
                end = n if stop < 0 else stop + 1
                add(COMMENT, "#comment", at, end, source[at + 2 : n if stop < 0 else stop])
            else:
                end = at + 1
            at = end
            continue
        if mark == b"?":
            stop = source.find(b"?>", at + 2)
            end = stop + 2 if stop >= 0 else max(at + 2, n - 1)
            add(INSTRUCTION, "#processing-instruction", at, end, source[at + 2 : stop if stop >= 0 else end])
            at = end
            continue

        tag_match = _TAG.match(source, at)
        if tag_match is None:  # malformed: drop it, and resume where its reading failed
            bad = _failed_at(source, at, n)
            if not inside:
                at = bad + 1
            elif (next_mark := _RESYNC.search(source, bad)) is None:
                at = n
            else:
                at = next_mark.start() + (next_mark.group() == b">")
            continue
        tag, attributes, closed = tag_match.groups()
        tag = tag.lower()
        at_content = tag_match.end()
        name = tag.decode()
        index = add(ELEMENT, name, at, at_content, b"", attributes, at_content)
        if closed or name in VOID:
            at = at_content
        elif name in RAW_TEXT:
            stop = _RAW_END[name].search(source, at_content)
            content_end = stop.start() if stop else n
            stack.append(index)
            names.append(tag)
            if content_end > at_content:
                add(TEXT, "#text", at_content, content_end, source[at_content:content_end])
                say(source[at_content:content_end])
            rows[index][_CONTENT_END] = content_end
            end = source.find(b">", content_end) if stop else -1
            at = n if end < 0 else end + 1
            close(at)
        else:
            stack.append(index)
            names.append(tag)
            at = at_content
    while stack:
        close(n)
    rows[0][_TEXT_FROM] = rows[0][_TEXT_TO] = 0
    return rows, chunks
