"""Words of several ideographs: by a word list, or as pairs of neighbours.

Both stand in for `quern.functions.text.tokens` wherever a tokenizer is taken: a model fitted with one must be used with the same.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile("[A-Za-z0-9]+|[一-鿿]+")
_LOWER = {a: a + 32 for a in range(65, 91)}


class WordList:
    """Words by their first two ideographs, the longest first."""

    def __init__(self, words: Iterable[str]):
        found: dict[str, set[str]] = defaultdict(set)
        for w in words:
            if len(w) > 1 and all("一" <= c <= "鿿" for c in w):
                found[w[:2]].add(w)
        self.by_start = {start: (frozenset(ws), tuple(sorted({len(w) for w in ws}, reverse=True))) for start, ws in found.items()}

    def split(self, run: str) -> list[str]:
        """A run of ideographs as words of the list, the longest that fits from the left, and single ideographs."""
        out, at = [], 0
        while at < len(run):
            words, sizes = self.by_start.get(run[at : at + 2], (frozenset(), ()))
            size = next((n for n in sizes if run[at : at + n] in words), 1)
            out.append(run[at : at + size])
            at += size
        return out

    def tokens(self, text: str) -> list[str]:
        out: list[str] = []
        for run in _RUN.findall(text):
            if run[0] < "\x80":
                out.append(run.translate(_LOWER))
            else:
                out += self.split(run)
        return out


def segmenter(words: Iterable[str]) -> Callable[[Column], Column]:
    """A tokenizer: ASCII words in lower case, ideographs in words of the list, the longest first, else alone. Null gives null.

    The list travels with the function, so it should be a dictionary and not grow with the data.
    """
    known = WordList(words)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else known.tokens(t))

    return lambda text: split(text)


def bigrams(text: Column) -> Column:
    """A tokenizer without a list: ASCII words in lower case, runs of ideographs as all pairs of neighbours, a lone one alone. Null gives null."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[一-鿿]+"), F.lit(0))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(x.rlike("^[一-鿿]"), pairs(x)).otherwise(F.array(F.lower(x)))))
