"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders.

A unit is a run of ASCII letters or any other single code point.  Cuts are
found on the UTF-8 bytes eight at a time: a text is viewed as 64-bit words,
arithmetic on whole words marks the bytes that end a unit, ``bitwise_count``
gives the marks of each word and a running sum their rank.  The k-th unit is
found by a search in the running sums and, inside its word, by a product that
sums the marks of the lower bytes.

Defined results: null and empty texts are ``plain`` and have no unit; texts
that hold one of the three signs are ``plain`` too.  A row's draw depends on
its id alone, so rows that share an id are cut at the same draw; a null id
draws as the empty id.  Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from somagrid.llm.common import text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_ONE, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_7, _8, _56 = np.uint64(7), np.uint64(8), np.uint64(56)


def _all(byte: int) -> np.uint64:
    return np.uint64(byte) * _ONE


class Marks:
    """Marked bytes of a buffer, with rank and select."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.r_[0, np.cumsum(np.bitwise_count(marks), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte position."""
        low = (np.uint64(1) << (_8 * (at & 7).astype(np.uint64))) - np.uint64(1)
        return self.before[at >> 3] + np.bitwise_count(self.marks[at >> 3] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th mark, counted from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        upto = (self.marks[word] >> _7) * _ONE  # byte j: marks in bytes 0 to j
        reached = ((upto | _HIGH) - (k - self.before[word]).astype(np.uint64) * _ONE) & _HIGH
        return word * 8 + np.bitwise_count(~reached & _HIGH)


def unit_marks(data: np.ndarray, off: np.ndarray) -> tuple[Marks, Marks]:
    """(last bytes of units, first bytes of code points) of texts that lie end to end from byte 0."""
    n = len(data)
    words = np.zeros((n + 7) // 8, "<u8")
    words.view(np.uint8)[:n] = data
    folded = words & _all(0x7F) | _all(0x20)
    letter = (folded + _all(0x80 - 0x61)) & ~(folded + _all(0x80 - 0x7B)) & ~words & _HIGH
    tail = words & ~(words << np.uint64(1)) & _HIGH

    def of_next(flags):
        return (flags >> _8) | (np.append(flags[1:], np.uint64(0)) << _56)

    ends, heads = ~of_next(tail) & ~(letter & of_next(letter)) & _HIGH, ~tail & _HIGH
    if n % 8:
        held = (np.uint64(1) << np.uint64(8 * (n % 8))) - np.uint64(1)
        ends[-1] &= held
        heads[-1] &= held
    last = off[1:][np.diff(off) > 0] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << (_8 * (last & 7).astype(np.uint64)))
    return Marks(ends), Marks(heads)


def _draw(i: int, seed: int, id_col: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` counts units; the form is ``plain``, ``psm`` or ``spm``; the lengths count code points and are null where plain."""
    signs = [PREFIX, SUFFIX, MIDDLE]

    def run(batches):
        for b in batches:
            rows = b.select(["h1", "h2", "form", "id"])
            for i, data, off in text_chunks(b, "text"):
                m = len(off) - 1
                h1, h2 = (rows.column(k).slice(i, m).to_numpy() for k in (0, 1))
                forms = rows.column(2).slice(i, m).to_pylist()
                ends, heads = unit_marks(data, off)
                low = ends.rank(off[:-1])
                n = ends.rank(off[1:]) - low
                a, c = h1 % (n + 1), h2 % (n + 1)

                def place(k):
                    out = off[:-1].copy()
                    some = k > 0
                    out[some] = ends.select((low + k)[some]) + 1
                    return out

                p, s = place(np.minimum(a, c)), place(np.maximum(a, c))
                hp, hs = heads.rank(p), heads.rank(s)
                cut = np.array([f != "plain" for f in forms], bool)
                pre, mid = hp - heads.rank(off[:-1]), hs - hp
                raw, out = data.tobytes(), []
                for k, form in enumerate(forms):
                    x, y = raw[off[k]:p[k]], raw[s[k]:off[k + 1]]
                    if form == "psm":
                        out.append(b"%b%b%b%b%b%b" % (signs[0].encode(), x, signs[1].encode(), y, signs[2].encode(), raw[p[k]:s[k]]))
                    elif form == "spm":
                        out.append(b"%b%b%b%b%b%b" % (signs[1].encode(), y, signs[0].encode(), x, signs[2].encode(), raw[p[k]:s[k]]))
                    else:
                        out.append(raw[off[k]:off[k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(3).slice(i, m), pa.array(n), rows.column(2).slice(i, m), pa.array(pre, mask=~cut), pa.array(mid, mask=~cut),
                     pa.array(out, pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    held = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when(held | (_draw(2, seed, id_col) % 100 >= PLAIN_FROM), "plain").when(_draw(3, seed, id_col) % 100 < SPM_BELOW, "spm").otherwise("psm")
    fed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), form.alias("form"), _draw(0, seed, id_col).alias("h1"), _draw(1, seed, id_col).alias("h2"))
    return fed.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from.

    Only the three signs stand in a cut output besides the text, so the parts between them are the cut's."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`transform` with digests of the output and of the text rebuilt from it."""
    out = transform(docs, seed, id_col, text_col)
    return out.select("id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
