"""Edit-aware token counts: a segment tree of pre-token counts per document.

A document's leaves are chunks between white space, whose tokens do not depend on what is around them. Two
trees over the leaves hold characters and tokens. An edit finds its chunks by descending the tree of
characters, re-encodes only their text (the chunk before the edit included, as its last word may go on), puts
the new chunks in their leaves and updates the sums on the paths to the root. Once a leaf has more than a few
chunks the tree is built anew from the counts it has; nothing is encoded for that.

Defined cases: null texts count as empty; a document without edits keeps its counts; edits apply in order,
each to the text that the ones before left; places beyond the text are moved to its end, an end before its
start counts as the start, a null replacement is empty. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoded, load, together
from .common import pick, small_batches

#: Chunks of a leaf before the tree is built anew.
PILE = 8


class CountTree:
    """Sums of characters and tokens over the chunks of one text."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.encoded = text, 0
        self._build(chars, tokens)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """One chunk a leaf, and the sums above them."""
        self.size = 1 << max(len(chars) - 1, 0).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        for tree, values in ((self.chars, chars), (self.tokens, tokens)):
            tree[self.size:self.size + len(values)] = values
            half = self.size
            while half > 1:
                tree[half // 2:half] = tree[half:2 * half].reshape(-1, 2).sum(axis=1)
                half //= 2
        #: Leaves of several chunks, or none: characters and tokens of each chunk.
        self.piled: dict[int, list[tuple[int, int]]] = {}

    def _chunks(self, leaf: int) -> list[tuple[int, int]]:
        return self.piled.get(leaf, [(int(self.chars[leaf]), int(self.tokens[leaf]))])

    def chunk_at(self, place: int) -> tuple[int, int, int, int]:
        """The leaf that holds a character, which chunk of it, and the places where that chunk begins and ends."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        for k, (n, _) in enumerate(self._chunks(node)):
            if place < start + n:
                break
            start += n
        return node, k, start, start + n

    def _set(self, leaf: int, chunks: list[tuple[int, int]]) -> None:
        chars, tokens = (sum(c[k] for c in chunks) for k in (0, 1))
        more = chars - self.chars[leaf], tokens - self.tokens[leaf]
        self.piled.pop(leaf, None)
        if len(chunks) != 1:
            self.piled[leaf] = chunks
        while leaf:
            self.chars[leaf] += more[0]
            self.tokens[leaf] += more[1]
            leaf //= 2

    def touched(self, start: int, end: int, replacement: str) -> str:
        """Make an edit; the text of the chunks it touches, the one before it included, whose counts ``settle`` wants next."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, k, begin, _ = self.chunk_at(max(start - 1, 0)) if n else (self.size, 0, 0, 0)
        last, m, _, stop = self.chunk_at(min(end, n - 1)) if n else (first, 0, 0, 0)
        self.first, self.last = first, last
        self.before, self.after = self._chunks(first)[:k], self._chunks(last)[m + 1:]
        region = self.text[begin:start] + replacement + self.text[end:stop]
        self.text = self.text[:start] + replacement + self.text[end:]
        self.encoded += len(region)
        return region

    def settle(self, chars: list[int], tokens: list[int]) -> None:
        """Put the touched chunks' new counts in their leaves; leaves that hold too many chunks make a new tree."""
        chunks = [*self.before, *zip(chars, tokens), *self.after]
        for leaf in range(self.first, self.last):
            self._set(leaf, chunks[:1])
            chunks = chunks[1:]
        self._set(self.last, chunks)
        if len(chunks) > PILE:
            every = np.array([c for leaf in range(self.size, 2 * self.size) for c in self._chunks(leaf) if c[0]], np.int64)
            self._build(*every.reshape(-1, 2).T)


def with_edits(docs: DataFrame, edits: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Attach an edit table (doc_id, seq, start, end, replacement) as an array column ``edits`` in order of seq."""
    lists = edits.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(
        F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    return docs.join(lists, docs[id_col] == F.col("__id"), "left").drop("__id")


def edit_counts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                edits_col: str = "edits") -> DataFrame:
    """doc_id, n_leaves, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded (by the edits)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path, pattern)

        def counted(texts):
            chars, tokens, at = Encoded(table, texts).chunks()
            return [(chars[a:z], tokens[a:z]) for a, z in zip(at, at[1:])]

        for held, texts in together(batches, 1):
            ids, lists = ([x for b in held for x in b.column(k).to_pylist()] for k in (0, 2))
            lists = [e or [] for e in lists]
            trees = [CountTree(text or "", *counts) for text, counts in zip(texts, counted(texts))]
            out = [(np.count_nonzero(tree.chars[tree.size:]), int(tree.tokens[1])) for tree in trees]
            # Edits of one document follow each other; the k-th edits of all documents are encoded together.
            for k in range(max(map(len, lists), default=0)):
                turn = [(tree, edits[k]) for tree, edits in zip(trees, lists) if k < len(edits)]
                regions = [tree.touched(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["replacement"] or "")
                           for tree, e in turn]
                for (tree, _), (chars, tokens) in zip(turn, counted(regions)):
                    tree.settle(chars.tolist(), tokens.tolist())
            out = [(doc_id, *before, len(edits), int(tree.tokens[1]), len(tree.text), tree.encoded)
                   for doc_id, before, edits, tree in zip(ids, out, lists, trees)]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[
                "doc_id", "n_leaves", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded"])

    return pick(docs, doc_id=id_col, text=text_col, edits=edits_col).mapInArrow(
        run, "doc_id long, n_leaves long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long")
