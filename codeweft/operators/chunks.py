"""Overlapping chunks of source files, cut at the start of a part where possible."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import BOUNDARY

CHARS_PER_TOKEN, MAX_TOKENS, OVERLAP, LOOK_BACK = 4, 1200, 10, 20
_boundary = re.compile(BOUNDARY, re.ASCII)


def _units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def spans(text: str, max_tokens: int = MAX_TOKENS, strict: bool = False) -> list[tuple[int, int]]:
    """(first, end) line numbers, from 0, of the chunks of a text.

    A chunk ends where the next line would exceed the budget, or up to
    LOOK_BACK lines earlier where a part of the file begins or a line is blank;
    the next one repeats its last OVERLAP lines.  Lines longer than the budget
    and cuts near the start make chunks grow beyond it; ``strict`` drops the
    overlap there instead.
    """
    lines, budget = text.split("\n"), max_tokens * CHARS_PER_TOKEN
    if _units(text) <= budget:
        return [(0, len(lines))]
    sizes = [_units(x) + 1 for x in lines]
    out, start, size = [], 0, 0
    for i, cost in enumerate(sizes):
        if size + cost > budget and i > start:
            back = range(i - 1, max(start, i - LOOK_BACK) - 1, -1)
            cut = next((j for j in back if not lines[j].strip() or _boundary.match(lines[j].strip())), start)
            end = cut if cut > start else i
            out.append((start, end))
            kept = max(start, end - OVERLAP)
            start = end if strict and kept == start else kept
            size = sum(sizes[start:i]) - (i > start)
        size += cost
    return [*out, (start, len(lines))]


def chunk_files(files: DataFrame, max_tokens: int = MAX_TOKENS, strict: bool = False) -> DataFrame:
    """(project, file_path, chunk_index, total_chunks, content, start_line, end_line).

    Null contents give no chunk, an empty file one empty chunk; repeated rows of
    a file count once.
    """

    def cut(batches):
        for batch in batches:
            out = []
            for project, path, text in zip(batch["project"], batch["file_path"], batch["content"]):
                lines, parts = text.split("\n"), spans(text, max_tokens, strict)
                out += [(project, path, i, len(parts), "\n".join(lines[a:b]), a + 1, b) for i, (a, b) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["project", "file_path", "chunk_index", "total_chunks", "content", "start_line", "end_line"])

    return (
        files.where(F.col("content").isNotNull()).select("project", "file_path", "content").dropDuplicates(["project", "file_path"])
        .mapInPandas(cut, "project string, file_path string, chunk_index int, total_chunks int, content string, start_line int, end_line int")
    )
