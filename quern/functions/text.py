"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, and the blanks that are trimmed from a line (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANKS = "[\\s\x1c-\x1f\x85\xa0  -     　]+"
#: ASCII words, and single ideographs where no segmenter is installed (fixed value).
TOKEN_PATTERN = "[A-Za-z0-9]+|[一-鿿]"


def normalize_text(text: Column) -> Column:
    """Each line trimmed, empty lines dropped, the rest joined by one blank; runs of blanks inside a line stay. Null gives null."""
    trimmed = F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{BLANKS}", ""), f"{BLANKS}$", ""))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), " ")


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("size must be at least 1, overlap at least 0 and below size")


def windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of `size` characters that share `overlap` with the next; the last may be shorter. Empty text gives an empty array, null null."""
    check_window(size, overlap)
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).when(text.isNotNull(), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """ASCII words in lower case and single ideographs, in order; other letters separate words. Null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def is_token(word: Column) -> Column:
    """Whether a segmenter's word holds an ideograph or an ASCII letter or digit."""
    return word.rlike("[一-鿿A-Za-z0-9]")
