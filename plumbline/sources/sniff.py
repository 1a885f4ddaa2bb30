"""Guesses from the head of a file: encoding, delimiter, header rows, orientation. Driver side, bounded input."""

from __future__ import annotations

import codecs
import datetime
import re
from collections import Counter
from dataclasses import dataclass, field

HEAD_BYTES, LINES, ROWS, HEADER_ROWS = 1 << 20, 30, 200, 3
DELIMITERS = ",;\t|"
LABEL_WORDS = r"(?i)\b(name|date|address|phone|email|sex|gender|age|state|signature|number|no)\b"


@dataclass
class IngestReport:
    kind: str = ""
    encoding: str = ""
    delimiter: str = ""
    header_row: int = 0
    data_row: int = 0
    sheet: str = ""
    sheets: list[str] = field(default_factory=list)
    orientation: str = "normal"
    columns: int = 0
    notes: list[str] = field(default_factory=list)
    skipped_rows: list[list[str]] = field(default_factory=list)


def encoding(head: bytes) -> str:
    """By byte order mark, else UTF-8 if it decodes, else a detector's word, else Latin-1."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a cut character at the end is fine
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        found = from_bytes(head[:65536]).best()
        return found.encoding if found else "latin-1"
    except ImportError:
        return "latin-1"


def delimiter(text: str) -> str:
    """The one whose most common number of occurrences a line, times the lines that have it, is largest."""
    lines = [x for x in text.splitlines() if x.strip()][:LINES]
    best, top = ",", 0
    for d in DELIMITERS:
        counts = Counter(n for n in (x.count(d) for x in lines) if n)
        if counts:
            n, times = max(counts.items(), key=lambda x: (x[1], x[0]))
            if n * times > top:
                best, top = d, n * times
    return best


def numeric(cell: str) -> bool:
    try:
        float(re.sub("[,%$]", "", cell).strip())
        return True
    except ValueError:
        return False


def _filled(row: list[str]) -> list[str]:
    return [c for c in row if str(c).strip()]


def _share(row: list[str]) -> float:
    cells = _filled(row)
    return sum(map(numeric, cells)) / len(cells) if cells else 0.0


def data_start(grid: list[list[str]]) -> int | None:
    """The first row of at least three cells, some but not all numeric, that is followed by another such row."""
    for i, row in enumerate(grid[:-1]):
        after = grid[i + 1]
        if len(_filled(row)) >= 3 and 0.15 <= _share(row) <= 0.95 and len(_filled(after)) >= 3 and _share(after) <= 0.95:
            return i
    return None


def header_band(grid: list[list[str]], start: int) -> list[int]:
    """Rows right above the data that are wide enough to be headers: three at most."""
    width, band, i = len(_filled(grid[start])), [], start - 1
    while i >= 0 and not _filled(grid[i]):
        i -= 1
    while i >= 0 and len(band) < HEADER_ROWS and len(_filled(grid[i])) >= max(2, 0.5 * width if not band else 2) and _share(grid[i]) < 0.5:
        band.insert(0, i)
        i -= 1
    return band


def header_row(grid: list[list[str]]) -> int:
    """Of the first rows, the one that is fullest, least numeric and at least as wide as the table."""
    width = Counter(len(_filled(r)) for r in grid[:50] if _filled(r)).most_common(1)
    width = width[0][0] if width else 0
    scored = [(len(_filled(r)) / max(1, len(r)) * (1 - _share(r)) * (1.0 if len(_filled(r)) >= width else 0.4), -i) for i, r in enumerate(grid[:15])]
    return -max(scored)[1] if scored else 0


def compose(rows: list[list[str]]) -> list[str]:
    """One name a column from stacked headers: parents carried right, different labels joined by ` - `."""
    width = max(map(len, rows), default=0)
    rows = [list(r) + [""] * (width - len(r)) for r in rows]
    for r in rows[:-1]:
        last = ""
        for j, c in enumerate(r):
            last = r[j] = str(c).strip() or last
    return [" - ".join(dict.fromkeys(x for x in (str(r[j]).strip() for r in rows) if x)) for j in range(width)]


def names(raw: list[str]) -> list[str]:
    """Clean and different names: placeholders for blanks, ISO dates for Excel serials, _1 for repeats."""
    out, used = [], Counter()
    for j, h in enumerate(raw):
        h = " ".join(re.sub("[﻿​‌‍⁠]", "", str(h or "")).replace("\xa0", " ").split())
        if re.fullmatch(r"\d{5}(\.0)?", h) and 36526 <= float(h) <= 55153:
            h = (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(float(h)))).isoformat()
        if not h or re.match(r"(?i)unnamed", h):
            h = f"column_{j}_no_header"
        used[h] += 1
        while used[h] > 1 and f"{h}_{used[h] - 1}" in used:
            used[h] += 1
        name = h if used[h] == 1 else f"{h}_{used[h] - 1}"
        used[name] += name != h
        out.append(name)
    return out


def layout(grid: list[list[str]]) -> tuple[list[str], int, list[list[str]]]:
    """(names, number of the first data row, rows above the header)."""
    if not grid:
        return [], 0, []
    first = header_row(grid)
    start = data_start(grid)
    band = header_band(grid, start) if start else []
    if band and not (len(band) == 1 and first > band[0]):
        head, after, top = compose([grid[i] for i in band]), start, band[0]
    else:
        head, after, top = list(grid[first]), first + 1, first
    width = max(len(head), max((len(r) for r in grid[after : after + 50]), default=0))
    return names(list(head) + [""] * (width - len(head))), after, grid[:top]


def orientation(grid: list[list[str]]) -> str:
    """normal, transposed (labels down the first column) or form (labels and blanks instead of a table)."""
    grid = grid[:ROWS]
    if not grid:
        return "normal"
    labels = sum(bool(re.search(LABEL_WORDS, str(c))) or str(c).strip().endswith(":") for r in grid for c in _filled(r))
    blank = sum(len(_filled(r)) <= 1 for r in grid) / len(grid)
    if labels >= 2 and blank >= 0.3 and max(len(_filled(r)) for r in grid) <= 4:
        return "form"
    first, top = [r[0] for r in grid if r and str(r[0]).strip()], grid[0]
    if len(top) >= 1.3 * len(grid) and first and sum(map(numeric, first)) / len(first) < 0.1 and _share(top) < 0.35 + 0.65 * (len(grid) > 1 and _share(top[1:]) > 0.5) and len(set(first)) / len(first) > 0.8:
        return "transposed"
    return "normal"
