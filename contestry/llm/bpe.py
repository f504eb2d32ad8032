"""Byte-level BPE encoding and decoding from a rank file.

Texts are cut into pre-tokens; the distinct pre-tokens of some megabytes of text are encoded together in
length-bucketed, padded numpy matrices. In every round each row merges its leftmost pair of minimum rank: the
rank of a pair of token ids is looked up in a hash table, the pair becomes one id and the row is compacted;
finished rows leave the matrix. Rows are independent, so a batch needs no state but the table.

Defined cases: a null text counts as empty (no ids, zero bytes); lone surrogates, which UTF-8 cannot hold,
are replaced as "?". Texts of any length are encoded whole. Repeated rows give a row each, an empty table
gives none. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import giving_back, pick, small_batches

#: Bytes of texts that are encoded together, cells of a padded matrix, and places that are spread out at once.
TOGETHER, CELLS, PLACES = 2 << 20, 1 << 20, 1 << 18
#: Rows longer than this merge all occurrences of their best pair in a round, where that gives the same ids.
LONG = 256
#: The pattern whose pre-tokens are found by array operations; others go through ``regex``.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int32).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        kinds[np.frombuffer("".join(regex.findall(f"{name}+", every)).encode("utf-32-le"), np.uint32)] = kind
    return kinds


def _spans(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of KNOWN_PATTERN; texts begin where ``first`` says, and pre-tokens leave nothing out."""
    kind = _kinds()[code]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    kind = kind[start]
    # Runs of one kind that the same text goes on after.
    goes_on = np.append(~first[start[1:]], False)
    end = np.append(start[1:], len(code))
    space = goes_on & (kind == _SPACE)
    single = code[end - 1] == ord(" ")
    # A last space goes with the run after it; another last white space stands alone.
    new[end[space] - 1] = True
    new[end[space & single]] = False
    taken = np.append(False, (space & single)[:-1])
    mark = np.flatnonzero(goes_on & (code[start] == ord("'")) & (end - start == 1) & ~taken & np.append(kind[1:] == _LETTER, False))
    if len(mark):
        q = start[mark]
        one = code[q + 1]
        room = end[mark + 1] - end[mark] >= 2
        two = np.where(room, code[np.minimum(q + 2, len(code) - 1)], 0)
        n = np.isin(one, list(map(ord, "stmd"))).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            n[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        q, n = q[n > 0], n[n > 0]
        new[q + 1] = False
        after = q + 1 + n
        new[after[after < len(code)]] = True
    return np.flatnonzero(new)


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + size[i] - 1, for each i in turn."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _slices(size: np.ndarray, most: int) -> list[slice]:
    """Neighbours of about ``most`` in all, so that what is built over their places stays small; a larger one is whole."""
    edge = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1)).tolist()
    return [slice(a, z) for a, z in zip(edge, [*edge[1:], len(size)])]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What lies at the places of ``_expand``."""
    out, at = np.empty(int(size.sum()), data.dtype), 0
    for s in _slices(size, PLACES):
        part = data[_expand(start[s], size[s])]
        out[at:at + len(part)] = part
        at += len(part)
    return out


class Encoded:
    """The pre-tokens of some texts, numbered among the distinct ones, and the ids of those."""

    def __init__(self, table: BytePairs, texts: list[str | None]):
        texts = [t or "" for t in texts]
        try:
            joined = "".join(texts)
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        except UnicodeEncodeError:
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            joined = "".join(texts)
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(chars) - chars
        if table.known_pattern and len(code):
            first = np.zeros(len(code), bool)
            first[begin[chars > 0]] = True
            start = _spans(code, first)
            size = np.diff(np.append(start, len(code)))
        else:
            at = [(b + m.start(), m.end() - m.start()) for b, t in zip(begin.tolist(), texts) for m in table.pattern.finditer(t)]
            start, size = np.array(at, np.int64).reshape(-1, 2).T
        self.code, self.start, self.size = code, start, size
        #: Pre-tokens before each text, and before the end.
        self.offsets = np.append(np.searchsorted(start, begin), len(start))
        self.chars = chars
        least, self.number = self._distinct()
        pieces = [joined[a:a + n].encode() for a, n in zip(start[least].tolist(), size[least].tolist())]
        self.ids, self.ids_start, self.n_ids = table.merge(pieces)
        self.table = table

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct pre-token, and which of them each one is."""
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        power = np.cumprod(np.full(int(self.size.max()), _BASE, np.uint64))
        parts, key = _slices(self.size, PLACES), np.empty(len(self.start), np.uint64)
        for s in parts:
            flat = _expand(self.start[s], self.size[s])
            within = flat - np.repeat(self.start[s], self.size[s])
            key[s] = np.add.reduceat((self.code[flat].astype(np.uint64) + np.uint64(1)) * power[within], np.cumsum(self.size[s]) - self.size[s])
        _, least, number = np.unique(key, return_index=True, return_inverse=True)
        # Keys only propose; the characters decide.
        first = self.start[least][number]
        if (self.size[least][number] == self.size).all() and all(
                (self.code[_expand(first[s], self.size[s])] == self.code[_expand(self.start[s], self.size[s])]).all() for s in parts):
            return least, number
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(self.code[a:a + n].tobytes(), len(known)) for a, n in zip(self.start, self.size)])
        return np.unique(number, return_index=True)[1], number

    def counts(self) -> np.ndarray:
        """Ids of each pre-token."""
        return self.n_ids[self.number]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them come before each text, and before the end."""
        n = self.counts()
        flat = _gather(self.ids, self.ids_start[self.number], n)
        return flat, np.append(0, np.cumsum(n))[self.offsets]

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and ids of the chunks between white space, and how many come before each text, and before the end.

        A chunk begins where white space begins; what stands before has no influence on its pre-tokens.
        """
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64), self.offsets
        space = _kinds()[self.code] == _SPACE
        begins = space[self.start] & ~np.append(True, space[self.start[1:] - 1])
        begins[self.offsets[:-1][self.offsets[:-1] < len(self.start)]] = True
        at = np.flatnonzero(begins)
        return np.add.reduceat(self.size, at), np.add.reduceat(self.counts(), at), np.searchsorted(at, self.offsets)


def together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[str | None]]]:
    """Batches and their texts, several at a time: distinct pre-tokens are encoded once for all of them.

    A batch of more is cut between its rows.
    """
    held, texts, n = [], [], 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for s in _slices(size, TOGETHER):
            part = batch.slice(s.start, s.stop - s.start)
            held.append(part)
            texts += part.column(column).to_pylist()
            n += int(size[s].sum())
            if n > TOGETHER:
                yield held, texts
                held, texts, n = [], [], 0
    if held:
        yield held, texts


class BytePairs:
    """A rank table and its pattern: bytes to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.known_pattern = regex.compile(pattern), pattern == KNOWN_PATTERN
        self.parts = {rank: part for part, rank in ranks.items()}
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # All splits of each token in two tokens: key of the pair -> rank of the whole.
        keys, values = [], []
        for part, rank in ranks.items():
            for k in range(1, len(part)):
                left, right = ranks.get(part[:k]), ranks.get(part[k:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int32))
        self.ranks = ranks
        # Bytes of each id, and its decimal digits with a comma, one after another.
        self.bytes_of = _packed(self.parts[k] if k in self.parts else b"" for k in range(max(self.parts) + 1))
        self.digits_of = _packed(b"%d," % k for k in range(max(self.parts) + 1))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing over a power of two; entries that collide go to the next free slot."""
        size = 1 << max(int(len(keys) * 4).bit_length(), 4)
        self.mask = np.uint64(size - 1)
        self.slots, self.value = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        self.reach, at, left = 0, self._home(keys), np.arange(len(keys))
        while len(left):
            self.reach += 1
            free = self.slots[at[left]] == -1
            slot, who = np.unique(at[left][free], return_index=True)
            placed = left[free][who]
            self.slots[slot], self.value[slot] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & int(self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & self.mask).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.ravel().astype(np.int64) << 32) | right.ravel()
        at = self._home(keys)
        slot = self.slots[at]
        out = np.where(slot == keys, self.value[at], _NONE)
        todo = np.flatnonzero((slot != keys) & (slot != -1))
        while len(todo):
            at = (at[todo] + 1 if len(at) > len(todo) else at + 1) & int(self.mask)
            slot = self.slots[at]
            hit = slot == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            more = ~hit & (slot != -1)
            todo, at = todo[more], at[more]
        return out.reshape(left.shape)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, and for each pre-token where its ids start and how many they are."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        n, start = (whole >= 0).astype(np.int64), np.cumsum(whole >= 0) - 1
        found, at = [whole[whole >= 0]], int(n.sum())
        todo = np.flatnonzero((whole < 0) & (size > 0))
        todo = todo[np.argsort(size[todo], kind="stable")]
        while len(todo):
            # A bucket: rows of like lengths, the longest at most a quarter longer than the shortest, or two cells.
            shortest = int(size[todo[0]])
            end = int(np.searchsorted(size[todo], max(shortest * 5 // 4, shortest + 2), "right"))
            end = max(1, min(end, CELLS // int(size[todo[end - 1]])))
            rows, todo = todo[:end], todo[end:]
            ids, n[rows] = self._merge_bucket(_gather(data, begin[rows], size[rows]), size[rows])
            start[rows] = at + np.cumsum(n[rows]) - n[rows]
            found.append(ids)
            at += len(ids)
        return np.concatenate(found), start, n

    def _merge_bucket(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n.copy()
        cells = np.arange(n.max())
        ids = np.full((len(n), len(cells)), -1, np.int32)
        ids[cells < n[:, None]] = self.bytes_to_id[data]
        out, size = np.full(ids.shape, -1, np.int32), n.copy()
        who = np.arange(len(n))
        ranks = self._row_ranks(ids, n)
        while len(who):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(who), np.int64)
            low = ranks[np.arange(len(who)), best] if ranks.shape[1] else np.full(len(who), _NONE, np.int32)
            done = low == _NONE
            if done.any():
                out[who[done], :ids.shape[1]] = ids[done]
                size[who[done]] = n[done]
                keep = ~done
                ids, ranks, n, who, best, low = ids[keep], ranks[keep], n[keep], who[keep], best[keep], low[keep]
                if not len(who):
                    break
            if ids.shape[1] > LONG:
                ids, n = self._close_up(ids, n, self._safe_hits(ids, ranks, low, best), low)
                ranks = self._row_ranks(ids, n)
            else:
                ids, ranks, n = self._one_merge(ids, ranks, n, best, low)
        return out[cells < size[:, None]], size

    def _one_merge(self, ids, ranks, n, best, low):
        """The pair's first cell becomes the whole and the row closes up; only the two pairs of that cell are looked up."""
        rows, width = np.arange(len(ids)), ids.shape[1]
        cells = np.arange(width)
        ids = ids[cells != best[:, None] + 1].reshape(-1, width - 1)
        ids[rows, best] = low
        n = n - 1
        ranks = ranks[cells[:-1] != best[:, None]].reshape(-1, width - 2)
        for k in (best - 1, best):
            r = np.flatnonzero((k >= 0) & (k + 1 < n))
            ranks[r, k[r]] = self.pair_ranks(ids[r, k[r]], ids[r, k[r] + 1])
        return ids, ranks, n

    def _close_up(self, ids, n, hit, low):
        """The first cell of each hit pair becomes the whole, its second goes, and the row closes up."""
        ids = np.where(hit, low[:, None], ids)
        stay = np.ones(ids.shape, bool)
        stay[:, 1:] = ~hit[:, :-1]
        n = n - hit.sum(axis=1)
        order = np.argsort(~stay, axis=1, kind="stable")[:, :n.max()]
        ids = np.take_along_axis(ids, order, axis=1)
        ids[np.arange(ids.shape[1]) >= n[:, None]] = -1
        return ids, n

    def _row_ranks(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.empty((len(ids), 0), np.int32)
        ranks = self.pair_ranks(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
        ranks[np.arange(1, ids.shape[1]) >= n[:, None]] = _NONE
        return ranks

    def _safe_hits(self, ids, ranks, low, best) -> np.ndarray:
        """Leftmost pair of each row, or all its non-overlapping occurrences if none makes a better pair.

        Merged one by one, an occurrence meets on its left what it meets in the end, and on its right either that
        or the first half of an occurrence still to be merged; neither may make a pair of a lower rank.
        """
        rows = np.arange(len(ids))
        hit = np.zeros(ids.shape, bool)
        same = ranks == low[:, None]
        # Of a run of overlapping occurrences every other one counts, from the left.
        where = np.arange(same.shape[1])
        begins = np.maximum.accumulate(np.where(~same, where, -1), axis=1)
        hit[:, :-1] = same & ((where - begins) % 2 == 1)
        merged = np.where(hit, low[:, None], ids)
        stay = np.ones(ids.shape, bool)
        stay[:, 1:] = ~hit[:, :-1]
        for r in rows:
            line = merged[r][stay[r] & (ids[r] >= 0)]
            ahead = self.pair_ranks(low[r:r + 1], ids[r, best[r]:best[r] + 1])[0] < low[r]
            if ahead or len(line) > 1 and (self.pair_ranks(line[:-1], line[1:]) < low[r]).any():
                hit[r] = False
                hit[r, best[r]] = True
        return hit

    def encode(self, text: str | None) -> list[int]:
        return Encoded(self, [text]).flat()[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids, which begin at its offset."""
        return _unpacked(self.bytes_of, ids, offsets)

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        return [x[:-1] for x in _unpacked(self.digits_of, ids, offsets)]


def _packed(values: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = list(values)
    size = np.array([len(x) for x in values])
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def _unpacked(packed, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    data, start, size = packed
    ends = np.append(0, np.cumsum(size[ids]))[offsets].tolist()
    out = _gather(data, start[ids], size[ids]).tobytes()
    return [out[a:z] for a, z in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> BytePairs:
    """A worker reads the rank file once."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return BytePairs(ranks, pattern)


def _column(held: list[pa.RecordBatch], k: int) -> pa.Array:
    return pa.concat_arrays([b.column(k) for b in held])


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path, pattern)
        for held, texts in together(batches, 1):
            ids, offsets = Encoded(table, texts).flat()
            yield pa.RecordBatch.from_arrays([
                _column(held, 0), _lists(ids, offsets), pa.array(np.diff(offsets))], names=["doc_id", "ids", "n_tokens"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(giving_back(run), "doc_id long, ids array<int>, n_tokens long")


def encode_checked(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, and ``same``: whether the ids decode to the text's bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path, pattern)
        for held, texts in together(batches, 1):
            ids, offsets = Encoded(table, texts).flat()
            same = [x == (t or "").encode("utf-8", "replace") for x, t in zip(table.decode_all(ids, offsets), texts)]
            yield pa.RecordBatch.from_arrays([
                _column(held, 0), _lists(ids, offsets), pa.array(np.diff(offsets)), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "same"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(giving_back(run), "doc_id long, ids array<int>, n_tokens long, same boolean")


def decode_documents(encoded: DataFrame, path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids back to bytes: the kept columns and ``decoded`` binary."""
    small_batches(encoded.sparkSession)
    fields = ", ".join(f"`{c}` {dict(encoded.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path, pattern)
        for batch in batches:
            decoded = [table.decode(x or ()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(decoded, pa.binary())],
                                             names=[*keep, "decoded"])

    return encoded.select(*keep, "ids").mapInArrow(giving_back(run), f"{fields}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, keeping the digests only."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path, pattern)
        for held, texts in together(batches, 1):
            ids, offsets = Encoded(table, texts).flat()
            said, back = ([hashlib.sha256(x).hexdigest() for x in side(ids, offsets)] for side in (table.decimal, table.decode_all))
            yield pa.RecordBatch.from_arrays([
                _column(held, 0), pa.array(np.diff(offsets)), pa.array(said, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(
        giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
