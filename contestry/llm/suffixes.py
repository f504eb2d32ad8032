"""Exact substring dedup over suffix order: column-wise multi-document construction per bucket.

Every string of the matching length contains an anchor: the place of the smallest hash of its short windows,
which depends on its bytes alone. So equal strings always meet under one anchor hash. The bytes of the strings
in a row that share an anchor are a cut. Three steps:

1. Anchors. A worker finds the anchors of a chunk of documents. Of each, some bytes of its hash and of its cut's
   hash go to a bucket with the doc_id and an ordinal. Where a smaller document has the same cut, the whole cut is
   a repeat. Where an anchor has different cuts in different documents, one of each is asked for. An anchor goes
   once per chunk if the chunk itself has different cuts of it, and equal cuts go once, so no anchor fills a bucket.
2. Cuts. The bytes of the cuts asked for, a small part of the text, are dealt by anchor. Cuts of an anchor that has
   very many are first dealt in random blocks, whose suffix order takes away what a smaller document of the block
   has. What is left is dealt by a longer core: half of the strings of a cut have the bytes left of the anchor in
   common, the others those on its right. Of a core that is still very common, each string is a cut of its own.
3. Suffix order. In each bucket the Burrows-Wheeler transform of the cuts is built by inserting one symbol of
   every cut a round, from the last on. Transform and common prefixes are read from and written to sequential
   files in every round, and so are the symbols. Neighbours with long enough common prefixes hold the same string.

That anchors and whole cuts are the same is decided by 64 and 48 bits of hash together; between different cuts
bytes decide. Defined cases: a null text has no bytes, texts shorter than the length lose nothing. Rows of one
doc_id never remove bytes of each other; of documents with null identifiers nothing is removed and nothing is kept
for their sake. Repeated rows give a row each.
"""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _expand
from .common import cut, giving_back, maybe_broadcast, pick, small_batches

#: Bytes of a match, bytes of an anchor.
LENGTH, ANCHOR = 50, 20
#: Anchors of a chunk, of a bucket that compares them, cuts of a construction bucket, cuts of one key from which
#: it is dealt by longer ones.
CHUNK_ANCHORS, BUCKET_ANCHORS, BUCKET_CUTS, COMMON_CUTS = 1_500_000, 250_000, 4_000, 2_000
#: Bytes whose anchors are found at once; longer texts are taken in pieces.
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_NOT_OWN, _NOBODY = np.uint32(0xFFFFFFFF), np.iinfo(np.int64).min


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _windows(b: np.ndarray) -> np.ndarray:
    """Hashes of all windows of the anchor's size, by doubling: h(2k) = h(k) * B^k + h(k) moved by k."""
    h, have, power, want, out, done = b.astype(np.uint64) + np.uint64(1), 1, _BASE, ANCHOR, None, 0
    while want:
        if want & 1:
            out = h if out is None else out[:len(out) - have] * np.uint64(power) + h[done:done + len(out) - have]
            done += have
        want >>= 1
        if want:
            h = h[:len(h) - have] * np.uint64(power) + h[have:]
            have, power = 2 * have, power**2 & 0xFFFFFFFFFFFFFFFF
    return out


class Anchors:
    """Of texts, one after another: anchor hash, cut hash, first start, starts, anchor's place, and anchors per text."""

    def __init__(self, texts: list[bytes]):
        parts: list[tuple] = []
        held, room, count = [], 0, np.zeros(len(texts), np.int64)
        for k, data in enumerate(texts):
            # A piece has the strings that start in a block.
            for at in range(0, len(data) - LENGTH + 1, _BLOCK):
                piece = data[at:at + _BLOCK + LENGTH - 1]
                held.append((k, at, piece))
                room += len(piece)
                if room > _BLOCK:
                    parts.append(self._block(held, count))
                    held, room = [], 0
        if held:
            parts.append(self._block(held, count))
        none = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.hash, self.cut, self.begin, self.starts, self.place = (np.concatenate(x) for x in (zip(*parts) if parts else zip(none)))
        self.count = count

    @staticmethod
    def _block(held: list[tuple[int, int, bytes]], count: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.array([len(x[2]) for x in held])
        first = np.cumsum(size) - size
        h = _windows(np.frombuffer(b"".join(x[2] for x in held), np.uint8))
        m = _mix(h)
        # The low bits carry the place, so that the leftmost of equal hashes is the smallest.
        low = np.uint64((1 << 20) - 1)
        least = (m & ~low) | np.arange(len(m), dtype=np.uint64)
        span, w = 1, LENGTH - ANCHOR + 1
        while span < w:
            step = min(span, w - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        starts = size - LENGTH + 1
        start, owner = _expand(first, starts), np.repeat(np.arange(len(held)), starts)
        at = (least[start] & low).astype(np.int64)
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
        n, begin, place, owner = np.diff(np.append(new, len(at))), start[new], at[new], owner[new]
        end = begin + n + LENGTH - 1
        # Five windows cover a cut of any length.
        c = _mix(h[begin] + n.astype(np.uint64))
        for other in (begin + 20, begin + 30, end - 40, end - 20):
            c = _mix(c * np.uint64(_BASE) + h[other])
        np.add.at(count, [x[0] for x in held], np.bincount(owner, minlength=len(held)))
        back = (np.array([x[1] for x in held]) - first)[owner]
        return m[place], c, begin + back, n, place + back


def _told(x: np.ndarray) -> bytes:
    """Byte planes of a column, so that those of zeros alone compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _heard(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _compared(h: np.ndarray, c: np.ndarray, doc: np.ndarray):
    """Entries whose anchor is there several times, in order of anchor, cut, doc_id; of each: whether a smaller
    document has its cut, whether its anchor has other cuts in other documents, and whether it is its anchor's first."""
    o = np.argsort(h, kind="stable")
    same = h[o][1:] == h[o][:-1]
    o = o[np.append(same, False) | np.append(False, same)] if len(o) else o
    o = o[np.lexsort((doc[o], c[o], h[o]))]
    if not len(o):
        return o, np.empty(0, bool), np.empty(0, bool), np.empty(0, bool)
    new_h = np.append(True, h[o][1:] != h[o][:-1])
    new_c = new_h | np.append(True, c[o][1:] != c[o][:-1])
    at_h, at_c = np.flatnonzero(new_h), np.flatnonzero(new_c)
    d = doc[o]
    repeat = d > np.repeat(d[at_c], np.diff(np.append(at_c, len(o))))
    several = (np.add.reduceat(new_c.astype(np.int64), at_h) > 1) & (np.minimum.reduceat(d, at_h) < np.maximum.reduceat(d, at_h))
    return o, repeat, np.repeat(several, np.diff(np.append(at_h, len(o)))), new_h


def _scan(buckets: int):
    """Rows of two kinds: a chunk's documents with what it knows by itself, and its anchors by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            ids, of, count, h, c = (np.concatenate(x) for x in zip(*held))
            # In order of doc_id, so that the doc_ids of a bucket differ little.
            o = np.argsort(ids, kind="stable")
            entries = _expand((np.cumsum(count) - count)[o], count[o])
            ids, of, count, h, c = ids[o], of[o], count[o], h[entries], c[entries] >> np.uint64(16)
            doc = np.repeat(ids, count)
            o, repeat, several, first = _compared(h, c, doc)
            covered, asked = np.zeros(len(h), bool), np.zeros(len(h), bool)
            covered[o] = repeat
            asked[o] = several & ~repeat
            mark = o[first & several]
            send = np.flatnonzero(~covered & ~asked)
            own = np.append(send, np.full(len(mark), _NOT_OWN)).astype(np.uint32)
            send, c = np.append(send, mark), np.append(c[send], np.zeros(len(mark), np.uint64))
            doc = np.append(doc[send[:len(send) - len(mark)]], np.full(len(mark), _NOBODY))
            bucket = (h[send] >> np.uint64(32)) % np.uint64(buckets)
            o = np.argsort(bucket, kind="stable")
            bucket, rest, c, doc, own = bucket[o], h[send[o]].astype(np.uint32), c[o], doc[o], own[o]
            chunk = xxhash.xxh3_64_intdigest(ids.tobytes() + of.tobytes()) >> 1
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
            rows = [(int(bucket[a]), chunk, rest[a:z].tobytes(), _told(c[a:z])[:6 * (z - a)], _told(np.diff(doc[a:z], prepend=0)),
                     _told(np.diff(own[a:z], prepend=np.uint32(0)))) for a, z in zip(cuts, [*cuts[1:], len(bucket)])]
            documents = np.rec.fromarrays([ids, of, np.cumsum(count) - count], dtype="i8,i8,i8")
            rows.append((-1 - chunk % buckets, chunk, documents.tobytes(), *(np.flatnonzero(x).astype(np.uint32).tobytes() for x in (covered, asked)), b""))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 4)],
                                              names=["bucket", "chunk", "a", "b", "c", "d"])

        n = 0
        for batch in batches:
            found = Anchors([t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), found.count, found.hash, found.cut))
            n += len(found.hash)
            if n > CHUNK_ANCHORS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


_FOUND = "chunk long, documents binary, covered binary, asked binary"


def _compare(key, table):
    """Of a bucket's anchors, by chunk, those whose cut a smaller document has and those asked for; documents' rows pass."""
    chunks = table.column("chunk").to_pylist()
    if key[0].as_py() < 0:
        return table.select(["chunk", "a", "b", "c"]).rename_columns(["chunk", "documents", "covered", "asked"])
    a, b, c, d = (table.column(x).to_pylist() for x in "abcd")
    size = [len(x) // 4 for x in a]
    rest = np.concatenate([np.frombuffer(x, np.uint32) for x in a])
    cuts = np.concatenate([_heard(x + bytes(2 * n), np.uint64) for x, n in zip(b, size)])
    doc = np.concatenate([np.cumsum(_heard(x, np.int64)) for x in c])
    own = np.concatenate([np.cumsum(_heard(x, np.uint32), dtype=np.uint32) for x in d])
    o, repeat, several, _ = _compared(rest, cuts, doc)
    chunk, own = np.repeat(np.arange(len(chunks)), size)[o], own[o]
    mine = own != _NOT_OWN
    rows = []
    for k in np.unique(chunk[mine & (repeat | several)]):
        here = mine & (chunk == k)
        rows.append((chunks[k], None, own[here & repeat].tobytes(), own[here & several & ~repeat].tobytes()))
    return pa.table({f: pa.array(x, t) for f, x, t in zip(["chunk", "documents", "covered", "asked"], list(zip(*rows)) or [[]] * 4,
                                                          [pa.int64()] + [pa.binary()] * 3)})


def _by_document(key, table):
    """A chunk's ordinals, per document and counted from its first anchor."""
    documents = next((x for x in table.column("documents").to_pylist() if x), b"")
    d = np.frombuffer(documents, "i8,i8,i8")
    sides = []
    for name in ("covered", "asked"):
        o = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(name).to_pylist()])).astype(np.int64)
        edges = np.append(np.searchsorted(o, d["f2"]), len(o))
        sides.append([(o[a:z] - s).astype(np.uint32).tobytes() for a, z, s in zip(edges, edges[1:], d["f2"])])
    rows = [(int(x["f0"]), int(x["f1"]), *found) for x, *found in zip(d, *sides) if any(found)]
    return pa.table({f: pa.array(x, t) for f, x, t in zip(["doc_id", "of", "covered", "asked"], list(zip(*rows)) or [[]] * 4,
                                                          [pa.int64()] * 2 + [pa.binary()] * 2)})


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of covered cuts, with a null key, and the cuts asked for."""
    for batch in batches:
        out: list[tuple] = []
        ids, ofs, texts, *lists = (c.to_pylist() for c in batch.columns)
        texts = [t.encode("utf-8", "replace") for t in texts]
        found = Anchors(texts)
        base = np.cumsum(found.count) - found.count
        for k, (doc_id, of, data, covered, asked) in enumerate(zip(ids, ofs, texts, *lists)):
            at = base[k] + np.frombuffer(covered, np.uint32).astype(np.int64)
            s, e = found.begin[at], found.begin[at] + found.starts[at] + LENGTH - 1
            edge = np.flatnonzero(np.append(True, s[1:] > e[:-1])) if len(s) else np.empty(0, np.int64)
            for a, z in zip(s[edge].tolist(), e[np.append(edge[1:] - 1, len(e) - 1)[:len(edge)]].tolist()):
                out.append((None, None, None, doc_id, of, a, z))
            at = base[k] + np.frombuffer(asked, np.uint32).astype(np.int64)
            for h, a, n, p in zip(found.hash[at].view(np.int64).tolist(), found.begin[at].tolist(), found.starts[at].tolist(), found.place[at].tolist()):
                out.append((h, data[a:a + n + LENGTH - 1], p - a, doc_id, of, a, None))
        columns = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            columns, [pa.int64(), pa.binary(), pa.int32()] + [pa.int64()] * 4)],
            names=["key", "bytes", "p", "doc_id", "of", "s", "e"])


def suffix_order(strings: list[bytes], length: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least the given length: string, offset, and a number that those share that begin with the same
    string of that length, in suffix order.

    Symbols are bytes plus one; the end of a string is 0 and sorts by the string's number. Every round reads the
    transform and the common prefixes from ``folder`` in sequence, inserts a symbol of every string with the common
    prefixes that it changes, and writes both again. What precedes a suffix cX in order is cY for the last Y before
    X that c precedes, and their common prefix is one longer than the least one between Y and X.
    """
    m, n = len(strings), np.array([len(s) for s in strings])
    width = int(n.max())
    column = f"{folder}/symbols"
    right = np.zeros((m, width + 1), np.uint8)
    right[np.arange(width + 1) >= (width + 1 - n)[:, None]] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    np.ascontiguousarray(right[:, ::-1].T).tofile(column)
    del right
    pos, last = np.arange(m), ""
    with open(column, "rb") as symbols:
        bwt, lcp = np.frombuffer(symbols.read(m), np.uint8), np.zeros(m, np.uint8)
        for r in range(1, width + 1):
            active = np.flatnonzero(n >= r)
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(len(bwt), np.int64)
            rank[order] = np.arange(len(bwt))
            ends = int(np.count_nonzero(bwt == 0))
            p = pos[active]
            k = rank[p]
            before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(bwt) - 1)]
            with_before, with_after = (k > 0) & (bwt[before] == bwt[p]), (k + 1 < len(bwt)) & (bwt[after] == bwt[p])
            least = _Least(lcp)
            # Ends of strings stand first, then each suffix where the transform's symbols send it.
            place = m + k - ends
            new = np.zeros(len(bwt) + len(active), bool)
            new[place] = True
            out, common = np.empty(len(new), np.uint8), np.empty(len(new), np.uint8)
            out[~new], common[~new] = bwt, lcp
            out[place] = np.frombuffer(symbols.read(m), np.uint8)[active]
            common[place] = np.where(with_before, np.minimum(least(before + 1, p) + 1, length), 0)
            common[place[with_after] + 1] = np.minimum(least(p + 1, after)[with_after] + 1, length)
            pos[active] = place
            # A new file each round: writing over the old one would wait for the disk.
            path = f"{folder}/round{r}"
            with open(path, "wb") as file:
                out.tofile(file)
                common.tofile(file)
            if last:
                os.unlink(last)
            both, last = np.fromfile(path, np.uint8), path
            bwt, lcp = both[:len(out)], both[len(out):]
    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    walk = m + rank - np.count_nonzero(bwt == 0)
    at, who, left, where = np.arange(m), [], [], []
    for r in range(1, width + 1):
        at = np.where(n >= r, walk[at], at)
        if r >= length:
            whole = np.flatnonzero(n >= r)
            who.append(whole)
            left.append(np.full(len(whole), r))
            where.append(at[whole])
    who, left, where = map(np.concatenate, (who, left, where))
    order = np.argsort(where)
    who, left, where = who[order], left[order], where[order]
    return who, n[who] - left, np.cumsum(lcp < length)[where]


class _Least:
    """Minima of ranges, both ends included, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels, span = [values], 1
        while 2 * span <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-span], self.levels[-1][span:]))
            span *= 2
        self.size = np.array([len(x) for x in self.levels])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.levels)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp(np.maximum(high - low + 1, 1).astype(np.float64))[1] - 1
        first = self.start[level]
        a, b = np.clip(low, 0, self.size[level] - 1), np.clip(high + 1 - (np.int64(1) << level), 0, self.size[level] - 1)
        return np.minimum(self.flat[first + a], self.flat[first + b])


_PLACE = "key long, bytes binary, p int, doc_id long, of long, s long, e long"


def _construct(again: bool):
    """Spans of the cuts' strings that a smaller document has too; if some go ``again``, the other strings as cuts."""
    def run(table):
        keys, doc = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
        _, code = np.unique(keys, return_inverse=True)
        lo, hi = np.full(len(code), np.iinfo(np.int64).max), np.full(len(code), _NOBODY)
        np.minimum.at(lo, code, doc)
        np.maximum.at(hi, code, doc)
        use = np.flatnonzero((lo[code] < hi[code]) | again)
        if not len(use):
            return pa.table({f: pa.nulls(0, t) for f, t in _FIELDS})
        table = table.take(pa.array(use))
        strings = table.column("bytes").to_pylist()
        doc, of, s, p, keys = (table.column(c).to_numpy() for c in ("doc_id", "of", "s", "p", "key"))
        with tempfile.TemporaryDirectory() as folder:
            who, at, group = suffix_order(strings, LENGTH, folder)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(np.minimum.reduceat(doc[who], first), np.diff(np.append(first, len(who))))
        starts = np.array([len(x) for x in strings]) - LENGTH + 1
        begin = np.cumsum(starts) - starts
        # A cell before each cut, and one after the last, keeps its runs apart from its neighbours'.
        cell = begin + np.arange(len(starts)) + 1
        bad = np.zeros(int(starts.sum()) + len(starts) + 1, np.int8)
        bad[cell[who] + at] = np.where(least < doc[who], 2, 1)
        out = []
        for kind in (2, 1) if again else (2,):
            hit = bad == kind
            edge = np.flatnonzero(hit[1:] != hit[:-1]) + 1
            a, z = edge[::2], edge[1::2]
            k = np.searchsorted(cell, a, "right") - 1
            a, z = a - cell[k], z - cell[k] + LENGTH - 1
            whole = kind == 1
            out.append(pa.table({"key": pa.array(keys[k], mask=np.full(len(k), not whole)), "bytes": pa.array(
                [strings[i][x:y] for i, x, y in zip(k, a, z)] if whole else [None] * len(k), pa.binary()),
                "p": pa.array((p[k] - a).astype(np.int32)), "doc_id": doc[k], "of": of[k], "s": s[k] + a,
                "e": pa.array(s[k] + z, mask=np.full(len(k), whole))}).cast(pa.schema(_FIELDS)))
        return pa.concat_tables(out)

    return lambda key, table: run(table)


_FIELDS = [("key", pa.int64()), ("bytes", pa.binary()), ("p", pa.int32()), ("doc_id", pa.int64()), ("of", pa.int64()), ("s", pa.int64()),
           ("e", pa.int64())]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, of, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data, runs = (text or "").encode("utf-8", "replace"), []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
            out.append((doc_id, of, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                        [{"s": a, "e": z} for a, z in runs]))
        columns = list(zip(*out)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[
            "doc_id", "of", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _free(spark) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def _apart(cuts: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame | None]:
    """Cuts of ordinary keys and cuts of very common ones, if there are any."""
    common = cut(cuts.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > COMMON_CUTS))
    n = common.count()
    if not n:
        return cuts, None
    hot = maybe_broadcast(common, n)
    return cuts.join(hot.select(key), key, "left_anti"), cuts.join(hot, key)


def _halves(cuts: DataFrame) -> DataFrame:
    """The strings of a cut by what they have in common: the anchor and the bytes right of it, or those left of it."""
    more, last = (LENGTH - ANCHOR) // 2, F.octet_length("bytes") - LENGTH
    right = F.struct(F.greatest(F.lit(0), F.col("p") - more).alias("lo"), last.alias("hi"), F.xxhash64(
        F.lit(0), F.expr(f"substring(bytes, p + 1, {ANCHOR + more})")).alias("key"))
    left = F.struct(F.lit(0).alias("lo"), F.least(last, F.col("p") - more - 1).alias("hi"), F.xxhash64(
        F.lit(1), F.expr(f"substring(bytes, p - {more}, {ANCHOR + more + 1})")).alias("key"))
    parts = cuts.select("bytes", "p", "doc_id", "of", "s", F.explode(F.array(right, left)).alias("x")).where("x.lo <= x.hi")
    return parts.select(F.col("x.key").alias("key"), F.expr(f"substring(bytes, x.lo + 1, x.hi - x.lo + {LENGTH})").alias("bytes"),
                        (F.col("p") - F.col("x.lo")).cast("int").alias("p"), "doc_id", "of", (F.col("s") + F.col("x.lo")).alias("s"))


def _string_spans(cuts: DataFrame) -> DataFrame:
    """Spans of the strings that a smaller document has, for cuts whose strings are told apart one by one."""
    strings = cuts.select("doc_id", "of", "s", "bytes", F.explode(F.sequence(
        F.lit(0), F.octet_length("bytes") - LENGTH)).alias("k")).select(
        "doc_id", "of", (F.col("s") + F.col("k")).alias("s"), F.expr(f"substring(bytes, k + 1, {LENGTH})").alias("string"))
    least = strings.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return strings.join(least, "string").where("doc_id > least").select("doc_id", "of", "s", (F.col("s") + LENGTH).alias("e"))


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed), of (hash of the text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("of", F.xxhash64("text"))
    long = docs.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    total = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(1, round(total * 2 / (LENGTH - ANCHOR + 2) / BUCKET_ANCHORS))
    packed = long.select("doc_id", "of", "text").mapInArrow(
        giving_back(_scan(buckets)), "bucket long, chunk long, a binary, b binary, c binary, d binary")
    found = cut(packed.groupBy("bucket").applyInArrow(_compare, _FOUND))
    _free(spark)
    marked = cut(found.groupBy("chunk").applyInArrow(_by_document, "doc_id long, of long, covered binary, asked binary"))
    _free(spark)
    places = cut(long.join(marked, ["doc_id", "of"]).select("doc_id", "of", "text", "covered", "asked").mapInArrow(
        giving_back(_cuts), _PLACE))
    _free(spark)
    cuts, spans = ["key", "bytes", "p", "doc_id", "of", "s"], ["doc_id", "of", "s", "e"]
    dealt, common = _apart(places.where("key is not null").select(*cuts))
    found = places.where("key is null").select(*spans)
    if common is not None:
        blocks = common.withColumn("bucket", F.xxhash64("key", F.pmod(F.xxhash64("doc_id", "s"), F.ceil(F.col("n") / BUCKET_CUTS))))
        rest = cut(blocks.select("bucket", *cuts).groupBy("bucket").applyInArrow(_construct(True), _PLACE))
        found = found.unionByName(rest.where("key is null").select(*spans))
        halves, strings = _apart(cut(_halves(rest.where("key is not null"))))
        dealt = dealt.unionByName(halves)
        if strings is not None:
            found = found.unionByName(_string_spans(strings))
    groups = max(1, places.where("key is not null").count() // BUCKET_CUTS)
    order = dealt.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("bucket"), *cuts).groupBy("bucket")
    spans = cut(found.unionByName(order.applyInArrow(_construct(False), _PLACE).select(*spans)))
    _free(spark)
    # A document has few spans, as runs of starts are one.
    per_doc = spans.groupBy("doc_id", "of").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return docs.join(per_doc, ["doc_id", "of"], "left").select("doc_id", "of", "text", "spans").mapInArrow(
        _removed, "doc_id long, of long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                  "spans array<struct<s:long,e:long>>")
