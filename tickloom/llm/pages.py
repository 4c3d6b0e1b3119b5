"""Running page headers of paged documents."""

from __future__ import annotations

import re

CASE_NO = re.compile(r"-\d{1,3}-\d{1,6}/\d{2,4}(?!\w)")  # after up to four letters
COURT_CODE = re.compile(r"(?<!\w)[A-Za-z]{1,4}\Z")

# A header holds a case number, one page mark and at most a title, in one of three orders; blanks may pad it at will.
_PAGE = r"(?:[^\s\d]{1,14}\s*)?\d{1,5}(?:\s*[^\s\d]{0,6}\s*[^\s\d]{1,6}\s*\d{1,5})?\s*[^\s\d]{0,4}"
_TITLE = r"[^\d!?;:。।\n]*"  # no digits and no end of a sentence
_APART = r"(?:\s*[—·|,]\s*|\s{2,}|\t)"  # what parts fields that might else be prose
PADDING = re.compile(r"\s{3,}")
TITLE = re.compile(rf"{_TITLE}\Z")
PAGE_AFTER = re.compile(rf"[\s,;·|–—-]*{_PAGE}\Z")
TITLE_AND_PAGE_AFTER = re.compile(rf"{_APART}{_TITLE}[\s·|—,]{_PAGE}\Z")
PAGE_BEFORE = re.compile(rf"(?:[\[(–—-]\s*\d{{1,5}}\s*[\])–—-]{_TITLE}|{_PAGE}{_APART}(?:{_TITLE}{_APART})?)\Z")


def _is_header(head: str, tail: str) -> bool:
    """Whether what stands before and after a line's only case number makes it a header."""
    head, tail = (PADDING.sub("  ", x) for x in (head, tail))
    head, tail = head.lstrip(), tail.rstrip()
    if tail:
        return bool(TITLE.match(head) and PAGE_AFTER.match(tail)) or not head and bool(TITLE_AND_PAGE_AFTER.match(tail))
    return bool(PAGE_BEFORE.match(head))


def header_lines(text: str) -> list[tuple[int, int]]:
    """Spans (start, end without line break) of lines that are running headers.

    A header is a line of nothing but a case number, a page number beside it, and perhaps a title, however padded. A
    line with several case numbers is none.
    """
    out: list[tuple[int, int]] = []
    lo = hi = -1
    for m in CASE_NO.finditer(text):
        if m.start() < hi:  # a second number on the line
            if out and out[-1] == (lo, hi):
                out.pop()
            continue
        code = COURT_CODE.search(text[max(0, m.start() - 6) : m.start()])
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.end())
        hi = len(text) if hi < 0 else hi
        if code and _is_header(text[lo : m.start() - len(code.group())], text[m.end() : hi]):
            out.append((lo, hi))
    return out


def without_headers(text: str, fill: bool) -> str:
    """The text without running headers; with ``fill`` they become blanks, so that positions stay.

    A header between two lines of text goes with its line break, so that the cut sentence joins.
    """
    spans = header_lines(text)
    if not spans:
        return text
    parts, at = [], 0
    for lo, hi in spans:
        above = text[text.rfind("\n", 0, max(lo - 1, 0)) + 1 : max(lo - 1, 0)].strip() if lo else ""
        end = text.find("\n", hi + 1)
        below = text[hi + 1 : len(text) if end < 0 else end].strip()
        stop = hi + 1 if above and below else hi
        parts += [text[at:lo], (" " * (stop - lo)) if fill else ""]
        at = stop
    return "".join(parts) + text[at:]
