"""Fill-in-the-middle transformation: two cuts at unit boundaries, and the parts in another order between marks.

The bytes of a batch of texts get a class each (blank, line end, letter, later byte of a letter; last of its word or
not) and the classes a wavelet matrix: a bitmap per bit of the class with counted blocks. The number of words, lines
or code points before any byte is a sum of ranks of some classes; the end of the k-th unit is found by bisection on
that number, for all texts of the batch at once. Hashes of the identifier choose the form and the cuts, so a row's
result does not depend on its neighbours, its partition or an attempt.

Defined cases: null texts count as empty; empty texts and texts that contain a mark stay plain, with null
``prefix_chars`` and ``middle_chars``. A null identifier hashes as an empty one. Repeated rows give equal rows. Other
columns are ignored. A text of any length is cut whole; a task holds one batch, about 12 bytes for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Classes of bytes: 4 for letters, 2 for a later byte of one or for a line end, 1 if the next byte is no letter.
LETTER, SECOND, LAST = 4, 2, 1
#: What is counted before a byte, as the classes whose ranks are added up.
UNITS = {"word": (LETTER | LAST, LETTER | SECOND | LAST), "line": (SECOND, SECOND | LAST)}
_LATER = (LETTER | SECOND, LETTER | SECOND | LAST)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_CUTS = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>"


def classes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of every byte of joined UTF-8 texts, which end before the positions of ends."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    letter = np.append(~blank, False)
    after = letter[1:].copy()
    after[ends[ends > 0] - 1] = False  # no word goes on in the next text
    second = ((data & 0xC0) == 0x80) | (data == 10)
    return LETTER * letter[:-1].astype(np.uint8) | SECOND * second.astype(np.uint8) | LAST * (~after).astype(np.uint8)


class Wavelet:
    """A wavelet matrix: for each bit from the highest, the bits of the symbols in the order of the bits before."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.bits, self.size, self.levels = bits, len(symbols), []
        for b in reversed(range(bits)):
            one = (symbols >> b) & 1 == 1
            packed = np.append(np.packbits(one, bitorder="little"), np.uint8(0))
            counts = np.concatenate([[0], np.cumsum(_ONES[packed], dtype=np.int64)])
            zeros = len(symbols) - int(counts[-1])
            self.levels.append((packed, counts, zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for (packed, counts, zeros), b in zip(self.levels, reversed(range(self.bits))):
            ones = [counts[x >> 3] + _ONES[packed[x >> 3] & ((1 << (x & 7)) - 1).astype(np.uint8)] for x in (low, high)]
            low, high = [zeros + x for x in ones] if symbol >> b & 1 else [low - ones[0], high - ones[1]]
        return high - low

    def counted(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def select(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position from low to high before which there are k more of the symbols than before low; k is there."""
        start, low, high = self.counted(symbols, low), low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.counted(symbols, mid) - start >= k
            low, high = np.where(enough, low, np.minimum(mid + 1, high)), np.where(enough, mid, high)
        return low


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "word") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before and between its cuts.

    The cuts stand after (hash % (units + 1)) units, the smaller of the two first. Blanks or a line without an end at
    the end of a text are a unit of their own; ``char`` takes code points as units.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base, ends = int(ends[0]), ends - ends[0]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base:base + int(ends[-1])]
    start, end = ends[:-1], ends[1:]
    index = Wavelet(classes(data, end))
    chars = lambda at: at - index.counted(_LATER, at)
    if unit == "char":
        n = chars(end) - chars(start)
        low, high = (np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0))
        return n, low, high - low
    whole = index.counted(UNITS[unit], end) - index.counted(UNITS[unit], start)
    last = np.zeros(len(end), bool)
    some = end > start
    tail = data[end[some] - 1] if some.any() else data[:0]
    last[some] = (tail == 32) | ((tail >= 9) & (tail <= 13)) if unit == "word" else tail != 10
    n = whole + last
    k = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    at = [np.where(x > whole, end, index.select(UNITS[unit], np.minimum(x, whole), start, end)) for x in k]
    prefix, middle = (chars(x) - chars(start) for x in at)
    return n, prefix, middle - prefix


def _hash(seed: int, doc_id: Column, part: int) -> Column:
    """A number of 32 bits from eight digits of the hash of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50,
              spm_percent: int = 80, unit: str = "word") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, text and output.

    percent of the rows are transformed, spm_percent of these with the suffix before the prefix.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(_CUTS)
    def cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = cuts(text, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), unit)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["n", "prefix_chars", "middle_chars"])

    h = [_hash(seed, F.col("doc_id"), k) for k in range(4)]
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "c": cut("text", h[0], h[1])})
    plain = F.col("form") == "plain"
    p, m = F.col("c.prefix_chars").cast("int"), F.col("c.middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.length("text"))
    before, after, between = (F.lit(x) for x in MARKS)
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", F.concat(before, prefix, after, suffix, between, middle)).otherwise(
        F.concat(after, suffix, before, prefix, between, middle))
    return rows.select("doc_id", F.col("c.n").alias("n"), "form", F.when(~plain, F.col("c.prefix_chars")).alias("prefix_chars"),
                       F.when(~plain, F.col("c.middle_chars")).alias("middle_chars"), "text", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of: its parts between the marks, in their old order.

    Transformed texts held no mark, and no mark can begin inside another, so the first of each is the one put in.
    """
    before, after, between = MARKS
    rest = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    until = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - 1)
    psm, spm = rest(output, before), rest(output, after)
    tail, head = rest(psm, after), rest(spm, before)
    return F.when(form == "psm", F.concat(until(psm, after), rest(tail, between), until(tail, between))).when(
        form == "spm", F.concat(until(head, between), rest(head, between), until(spm, before))).otherwise(output)


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """The transformation with digests of its output and of the text restored from it."""
    out = transform(docs, **how)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
