"""Cutting oversized texts into overlapping pieces at natural boundaries.

The least number of pieces is computed, the ends are aimed at equal distances, every end snaps to the strongest boundary near its
target, and one more piece is allowed whenever a limit fails.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which, or instead of which, a text may be cut (fixed values).
BREAKS = " \t\n\r  　.,;:!?。，、；：！？"

_PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t　]*(?:\r\n?|\n)\s*| \s*")
_SENTENCE = re.compile("[.!?][\"'”’»)\\]]*[ \t 　]+|[。！？][”’」』）]*[ \t　]*|[\r\n ]+")
_WORD = re.compile(f"[{re.escape(BREAKS)}]+")
_UNBROKEN = re.compile(f"[^{re.escape(BREAKS)}]+")
KINDS = ("end", "paragraph", "sentence", "word", "hard")


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Sorted cut positions after paragraphs, sentences and words; every stronger boundary is a word boundary too."""
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text)]
    sentences = [m.end() for m in _SENTENCE.finditer(text)]
    words = sorted({m.end() for m in _WORD.finditer(text)} | set(paragraphs) | set(sentences))
    return paragraphs, sentences, words


def _nearest(places: list[int], target: int, low: int, high: int) -> int | None:
    """The place in [low, high] nearest to target; of two as near, the later."""
    at = bisect.bisect_left(places, target)
    after = next((p for p in places[at : at + 1] if low <= p <= high), None)
    before = next((p for p in places[at - 1 : at] if low <= p <= high), None) if at else None
    if before is None or after is None:
        return before if after is None else after
    return before if target - before < after - target else after


def _attempt(size: int, count: int, limit: int, overlap: int, levels: tuple[list[int], ...]) -> list[tuple[int, str]] | None:
    """Ends of `count` pieces, or None if the last piece would be over the limit."""
    even = (size + (count - 1) * overlap) / count
    slack = max(1, int(even - overlap) // 4)
    ends: list[tuple[int, str]] = []
    last = 0
    for i in range(count - 1):
        high = min(size - 1, last - overlap + limit if ends else limit)
        low = last + 1 if ends else min(overlap + 1, high)
        if low > high:  # boundaries beyond the targets used the text up before its time
            break
        target = min(high, max(low, round(even + i * (even - overlap))))
        near = (max(low, target - slack), min(high, target + slack))
        end = None
        for kind, places in zip(KINDS[1:], levels):
            end = _nearest(places, target, *near)
            if end is not None:
                break
        if end is None:
            for kind, places in zip(KINDS[1:], levels):
                end = _nearest(places, target, low, high)
                if end is not None:
                    break
        if end is None:
            end, kind = high, "hard"
        ends.append((end, kind))
        last = end
    if size - (last - overlap if ends else 0) > limit:
        return None
    return [*ends, (size, "end")]


def _greedy(size: int, limit: int, overlap: int, words: list[int]) -> list[tuple[int, str]]:
    """Ends at the last word boundary in reach: what is left should every attempt with balanced targets fail; no text is known for which one does."""
    ends, last = [], 0
    while size - max(0, last - overlap) > limit:
        high = min(size - 1, max(0, last - overlap) + limit)
        at = bisect.bisect_right(words, high) - 1
        snapped = at >= 0 and words[at] > max(last, overlap)
        last = words[at] if snapped else high
        ends.append((last, "word" if snapped else "hard"))
    return [*ends, (size, "end")]


def cut(text: str, limit: int = 800, overlap: int = 80) -> list[tuple[int, int, str]]:
    """(start, end, kind of end) of the pieces of a text; one piece if it is within the limit, none if it is empty."""
    size = len(text)
    if size <= limit:
        return [(0, size, "end")] if size else []
    levels = boundaries(text)
    step = limit - overlap
    count = 1 + -(-(size - limit) // step)
    # a boundary just behind the last end may be the only one in reach and cost a piece for each hard cut: twice the count is enough
    attempts = (_attempt(size, count + more, limit, overlap, levels) for more in range(count + 3))
    ends = next((e for e in attempts if e), None) or _greedy(size, limit, overlap, levels[2])
    out, start = [], 0
    for end, kind in ends:
        out.append((start, end, kind))
        start = max(0, end - overlap)
    return out


def longest_unbroken(text: str) -> int:
    """Length of the longest stretch without any of BREAKS."""
    return max((m.end() - m.start() for m in _UNBROKEN.finditer(text)), default=0)


PIECES = "piece_no int, start int, end int, end_kind string, unbroken int, text string"


def split_oversized(items: DataFrame, keys: list[str], text_col: str = "text", limit: int = 800, overlap: int = 80) -> DataFrame:
    """(keys, item_hash, piece_no, start, end, end_kind, unbroken, text) for every distinct text over the limit.

    start and end are code points of the whole text; every piece but the first begins with the last `overlap` characters of the
    one before it. end_kind is 'paragraph', 'sentence', 'word', 'hard' (no boundary in reach) or 'end'; unbroken is the longest
    stretch of the whole text without a boundary. item_hash tells apart several texts of one key. Null, empty and short texts give
    no pieces; equal rows give one set of pieces; an empty table gives no rows; null keys are kept; other columns are ignored.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap at least 0 and below it")
    long = (
        items.filter(F.length(text_col) > limit)
        .select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("body"))
        .distinct()
        .withColumn("item_hash", F.xxhash64("body"))
    )
    names = [f"k{i}" for i in range(len(keys))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *key, body, mark in frame.itertuples(index=False):
                run_length = longest_unbroken(body)
                rows += [(*key, mark, n, s, e, kind, run_length, body[s:e]) for n, (s, e, kind) in enumerate(cut(body, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=[*names, "item_hash", "piece_no", "start", "end", "end_kind", "unbroken", "text"])

    schema = ", ".join([*(f"{n} {long.schema[n].dataType.simpleString()}" for n in names), "item_hash bigint", PIECES])
    pieces = long.mapInPandas(run, schema)
    return pieces.withColumnsRenamed(dict(zip(names, keys)))
