"""Numbers as people read them, in columns and on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def humanized(n: Column) -> Column:
    """1234 as 1.2K, 12.34M, 1.23B; below a thousand as it is."""
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.2fB", n / F.lit(1e9)))
        .when(n >= 1_000_000, F.format_string("%.2fM", n / F.lit(1e6)))
        .when(n >= 1_000, F.format_string("%.1fK", n / F.lit(1e3)))
        .otherwise(n.cast("long").cast("string"))
    )


def human(n: float) -> str:
    for least, unit, digits in ((1e9, "B", 2), (1e6, "M", 2), (1e3, "K", 1)):
        if n >= least:
            return f"{n / least:.{digits}f}{unit}"
    return f"{n:.0f}"


def text_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows under their columns; numbers to the right."""
    cells = [[f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else "" if v is None else str(v) for v in r] for r in rows]
    widths = [max(len(c), *(len(r[i]) for r in cells), 0) if cells else len(c) for i, c in enumerate(columns)]
    right = [all(isinstance(r[i], (int, float)) for r in rows) if rows else False for i in range(len(columns))]
    line = lambda r: "  ".join(x.rjust(w) if k else x.ljust(w) for x, w, k in zip(r, widths, right)).rstrip()
    return "\n".join([line(columns), *map(line, cells)])


def parsed_tables(text: str) -> dict[str, list[dict[str, str]]]:
    """The tables of a printed report by their titles, every cell as text: the way back from ``text_table``.

    Cells are told by where their column stands, so empty ones and blanks inside a cell stay as they are. What is no title with a
    line of columns below it is passed over.
    """
    out: dict[str, list[dict[str, str]]] = {}
    for block in re.split(r"\n\s*\n", text.strip("\n")):
        title, *lines = block.split("\n")
        if not lines or not lines[0].strip():
            continue
        header, rows = lines[0], lines[1:]
        wide = max(map(len, lines))
        # between columns two blanks stand in every line
        blank = [all(x[i : i + 1] in ("", " ") for x in lines) for i in range(wide)]
        spans, start = [], 0
        for i in range(wide + 1):
            ends = i == wide or (i + 1 < wide and blank[i] and blank[i + 1] and not blank[i - 1] if i else False)
            if ends:
                spans.append((start, i))
                start = i + 2
        names = [header[a:b].strip() for a, b in spans]
        out[title.strip()] = [{n: r[a:b].strip() for n, (a, b) in zip(names, spans)} for r in rows]
    return out
