"""Statistics of a text that quality rules look at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesieve.llm.common import utf8

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What rules may test: the base and ratios of it, all per text.
EXTRA = ["n_lines", "n_upper", "n_digits", "n_ends", "n_distinct_words", "n_short_words"]
NAMES = [*BASE, *EXTRA]


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of five words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Rank windows by doubling: pairs, then fours, then four and the fifth word. Exact, no hash.
    span = len(words) + 1
    two = np.unique(ids[:-1] * span + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * span + two[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:n] * span + ids[4 : 4 + n], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[five] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> list[int]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split()] if words else []
    chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUATION)))
    return [
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(text) - len(text.translate(None, b"0123456789")),
        len(text) - len(text.translate(None, b".!?")),
        len(set(words)),
        sum(1 for w in words if len(w) < 3),
    ]


def _statistics_of(texts: pa.Array) -> pa.Array:
    found = [statistics(t) for t in utf8(texts)]
    columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(NAMES)
    return pa.StructArray.from_arrays(columns, NAMES)


def statistics_column(text: Column) -> Column:
    """A struct of the statistics; null and empty texts have zeros. Rows stay where they are."""
    schema = ", ".join(f"{n} long" for n in NAMES)
    return F.arrow_udf(_statistics_of, schema)(text.cast("string"))
