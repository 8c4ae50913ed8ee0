"""Texts cut into short segments of one kind, as the spam statistics need them."""

from __future__ import annotations

import re
from typing import NamedTuple

LEAST_WORDS = 8  # shorter lines and sentences join the next ones of their kind

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_TRACE = re.compile(r"\s*(?:at \S+ ?\(|at [\w$.<>]+\(|File \"|Traceback |Caused by|\.\.\. \d+ more|#\d+ +0x|goroutine |\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?(?:ERROR|WARN|INFO|DEBUG)\b|thread '|panicked at|\s+\d+: \S+::)")
# a line that ends in a brace or semicolon is code as well; that is asked of its last character
_CODE = re.compile(r"(?: {4,}|\t).*[;{}()=]|\s*[\w.\[\]]+\s*[:+]?=\s*\S+.*[;(]|\s*(?:import|from|def|fn|func|pub|return|const|let|var|class|#include)\b.*[;:{(]?$")
_DIGIT = re.compile(r"\d")
_URL = r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+"
_ENDS = "com|net|org|info|biz|io|dev|example|invalid|test|local|de|fr|es|uk|eu|co|me|app|shop|store|online|site|xyz|ru|cn"
_HOST = rf"(?<![\w@/.])(?:[\w-]+\.)+(?:{_ENDS})\b(?:/[^\s<>\"')\]]*)?"
_LINK = re.compile(
    rf"<a\b[^>]*>.*?</a>|!?\[(?:[^\[\]]|!?\[[^\[\]]*\]\([^()\s]*\))*\]\([^()\s]*\)|!?\[[^\[\]]*\]\[[^\]]*\]|<?{_URL}>?|{_HOST}|\[url[^\]]*\].*?\[/url\]", re.I | re.S
)
_MAYBE = re.compile(rf"<a\b|\]\(|\]\[|://|www\.|\[url|\.(?:{_ENDS})\b", re.I)  # what every link has somewhere
_TAG = re.compile(r"(?<![\w#&/])[#@][^\W\d_][\w-]*")
_HEADING = re.compile(r"#{1,6}\s+\S|[=~-]{3,}$")
_PRICE = re.compile(r"(?<![\d.])\d{1,6}[.,]\d\d(?![\d.])|[€$£¥]\s?\d|\d\s?(?:€|EUR|USD)\b")
_SEPARATOR = re.compile(r"\s[-–—/|·•>]\s|;|\t")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\s+[|·•/»-]\s+")


class Segment(NamedTuple):
    kind: str  # prose, link, tag, item (product line), head (heading), other (code, traces, tables)
    chars: int
    words: list[str]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def segments(text: str) -> list[Segment]:
    """All non-blank text, in order. A link is a segment of its own unless its line explains it
    with a sentence outside the link; the label belongs to the link."""
    out: list[Segment] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if size:
            out.append(Segment("prose", size, held[:]))
            held.clear()
            size = 0

    fenced = False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            if len(held) >= LEAST_WORDS // 2:
                flush()
            continue
        if bare[0] in "#=~-" and _HEADING.match(bare) and not fenced and not _LINK.search(bare):
            flush()
            out.append(Segment("head", len(bare), words_of(bare)))
            continue
        if not fenced and _DIGIT.search(bare) and _PRICE.search(bare) and len(_SEPARATOR.findall(bare)) >= 2 and len(_WORD.findall(bare)) <= 20 and not bare.startswith("|"):
            flush()
            out.append(Segment("item", len(bare), words_of(bare)))
            continue
        if _FENCE.match(line):
            fenced = not fenced
            flush()
            out.append(Segment("other", len(bare), []))
            continue
        if fenced or bare.startswith("|") or _TRACE.match(line) or (bare[-1] in "{};" or _CODE.match(line)) and not _LINK.search(line):
            flush()
            out.append(Segment("other", len(bare), []))
            continue
        rest, linked = line, 0
        if "." in line or "<a" in line.lower() or "](" in line:
            if _MAYBE.search(line):
                rest = _LINK.sub(" ", line)
                linked = len(bare) - len(rest.strip())
        if linked > 0:
            left = words_of(rest)
            if len(left) >= 5 or "![" in line and len(left) >= 3:
                out_kind = "explained"
            else:
                out_kind = "link"
            if out_kind == "link":
                flush()
                out.append(Segment("link", len(bare), words_of(_LABELS.sub(" ", line))))
                continue
            out.append(Segment("other", linked, []))
            bare = " ".join(rest.split())
        tags = _TAG.findall(bare)
        if len(tags) >= 3 and sum(map(len, tags)) > 0.5 * len(bare):
            flush()
            out.append(Segment("tag", len(bare), words_of(bare)))
            continue
        for piece in _SENTENCE.split(bare):
            if not piece or not piece.strip():
                continue
            held.extend(words_of(piece))
            size += len(piece.strip())
            if len(held) >= LEAST_WORDS:
                flush()
    flush()
    return out


_LABELS = re.compile(rf"{_URL}|{_HOST}|<[^>]*>|\]\([^)]*\)", re.I)
