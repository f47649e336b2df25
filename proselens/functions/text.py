"""Text primitives as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "[一-鿿]"
WIDE = "[一-鿿㐀-䶿豈-﫿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def han(c: Column) -> Column:
    """How many Han characters: the length of what is left without runs of others, some times faster than a match each."""
    return F.length(F.regexp_replace(c, "[^" + HAN[1:-1] + "]+", ""))


def per(c: Column) -> Column:
    """Han characters, one at least: the base of densities."""
    return F.greatest(han(c), F.lit(1))


def runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{HAN}+"), F.lit(0))


def sentences(c: Column, longer: int = 1, pattern: str = "[。！？…]+") -> Column:
    """Stripped sentences with more than `longer` characters."""
    return F.filter(F.transform(F.split(strip(c), pattern), strip), lambda s: F.length(s) > longer)


def paragraphs(c: Column, longer: int = 5) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: F.length(p) > longer)


def count_of(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


def occurrences(c: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word that isn't empty."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, word, F.lit("")))) / F.octet_length(word)).cast("int")


def words(values: dict[str, int]) -> Column:
    """Words with a number each as one constant array of structs (k: place, word, x), so that an expression over all of
    them stays small. Words hold neither quotes nor backslashes."""
    return F.expr("array(" + ", ".join(f"struct({k} as k, '{w}' as word, {x} as x)" for k, (w, x) in enumerate(values.items())) + ")")


#: Rows and bytes of text of a slice, so that what a Python process holds beside its batch does not grow with the batch.
SLICE = (256, 1 << 22)


def slices(batches):
    """Arrow batches in slices of some rows, and the slices' texts, of column 1, one by one."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n, size = 0, 0
            while at + n < b.num_rows and n < SLICE[0] and size < SLICE[1]:
                v = b.column(1)[at + n]
                size += v.as_buffer().size if v.is_valid else 0
                n += 1
            part = b.slice(at, n)
            yield part, (part.column(1)[i].as_py() for i in range(n))
            at += n


#: Kinds of code points as bits of a table: Han characters, white space (Unicode's), ends of sentences.
IS_HAN, IS_WHITE, IS_END = 1, 2, 4
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_KINDS = np.zeros(1 << 16, np.uint8)
_KINDS[0x4E00:0xA000] |= IS_HAN
_KINDS[[ord(c) for c in WHITE]] |= IS_WHITE
_KINDS[[ord(c) for c in "。！？…"]] |= IS_END


def codes(t: str) -> np.ndarray:
    """A text's code points; those beyond the first plane are 0xFFFF, which has no kind."""
    return np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 0xFFFF).astype(np.uint16)


def marked(a: np.ndarray, kind: int) -> np.ndarray:
    return (_KINDS[a] & kind) > 0


def spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of code points that have anything but white space: Han characters of each, and the places of the first
    and the last character that is left when they are stripped."""
    k = _KINDS[a]
    ends = np.flatnonzero(k & IS_END)
    starts, ends = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(a)]])
    shown = np.flatnonzero((k & (IS_WHITE | IS_END)) == 0)
    low, high = np.searchsorted(shown, starts), np.searchsorted(shown, ends)
    some = high > low
    han = np.concatenate([[0], np.cumsum((k & IS_HAN) > 0)])
    return (han[ends] - han[starts])[some], shown[low[some]], shown[high[some] - 1]


def arrow_of(fields: str) -> list[tuple[str, pa.DataType]]:
    """Names and types of fields as a schema has them: "a long, b array<string>"."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return [(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]


def rows(docs: DataFrame, fields: str, measure: Callable[[str | None], tuple]) -> DataFrame:
    """docs with further columns for text: what measure makes of each text, one after another in Arrow batches. Nothing is
    shuffled, and a task holds slices of its batches."""
    kept = [f for f in docs.schema if f.name != "text"]
    types = arrow_of(fields)

    def run(batches):
        for b, texts in slices(batches):
            made = [measure(t) for t in texts]
            cols = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(types)]
            own = [(i, n) for i, n in enumerate(b.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([b.column(i) for i, _ in own] + cols, names=[n for _, n in own] + [n for n, _ in types])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])
    first = kept[0].name
    return docs.select(first, "text", *[f.name for f in kept[1:]]).mapInArrow(run, kind)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def total_double(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def settled(d: DataFrame) -> DataFrame:
    """d with its columns computed once: a generator of one row stands above them, into which the optimiser does not
    merge what follows. Without it a nested expression would be computed anew for each element that reads it."""
    return d.select(F.inline(F.array(F.struct(*d.columns))))
