"""What several operators share: words of whole texts, Arrow loops, and the size check before a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import ship

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased, as a table over UTF-8 bytes.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Java's regular expression for the words `[^\x20\x09-\x0D]+`.
SPACED = r"[^\x20\x09-\x0D]+"


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and whatever is not ASCII, as UTF-8."""
    return text.encode("utf-8", "replace").translate(ALNUM).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space as UTF-8; bytes.split() knows no other white space."""
    return text.encode("utf-8", "replace").split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], rows: int = 128
) -> DataFrame:
    """Apply a function to column lists, `rows` rows at a time, so that memory follows a few documents and not a batch.

    `make` runs once a task on the executor and returns the function.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = each({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, one cheap pass, to decide whether a table may be broadcast."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def release() -> None:
    """Give freed memory back to the system; a worker that did a heavy step stays for the next one."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in counts, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Taken:
    """Spans of a text that are spoken for, as disjoint intervals in order, so that a look-up does not scan them."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def take(self, start: int, end: int) -> bool:
        """Whether the span overlaps none that is taken; if so, it is taken from now on."""
        at = bisect_right(self.ends, start)
        if at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(bisect_left(self.ends, end), end)
        return True
