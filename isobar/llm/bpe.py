"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the tokenizer's pattern and each piece is merged on its own. Pieces repeat, so a task
keeps a cache from piece to ids, bounded in bytes (``CACHE_BYTES``) and dropped when the task ends; the new pieces of a slice are laid in matrices, one row a
piece, bucketed by length so that padding stays below half. In each round every row finds its minimum-rank
adjacent pair (the leftmost of equals), by a hashed lookup of all pairs of the matrix at once in an open-addressing table,
merges it and moves the rest of the row left; rows without a pair left are taken out, so the matrix gets
smaller. A piece of more than ``LONG`` bytes is a matrix of one row, in which a round merges the minimum-rank pair wherever it stands, from the left: these are the next rounds of that
row, taken together, unless one of them would make a pair of lower rank, and then only the first is taken.

The pair table follows from the ranks alone: a pair of tokens merges if the bytes of both joined have a rank,
which is then the rank of the pair. It is built once, on the driver, as arrays that are broadcast
(4 MB for 50,000 ranks; ``MAX_RANKS`` bounds it).

Defined results: a null or empty text has no ids; special tokens don't exist, so their strings are ordinary text;
bytes without a token are an error when the ranks are read, since then not every text could be encoded; so is a pattern whose
matches could span the chunks that texts are cut in (``check_pattern``). Texts are
processed whole. Other columns are kept; clashing names (ids and what a query derives) are replaced.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, tidy, utf8

MAX_RANKS = 1 << 20
LONG = 256
CACHE_BYTES, CACHED = 40 << 20, 64  # of a task's cache, counting 300 bytes an entry besides its text; longer chunks aren't kept
NONE = np.int32(np.iinfo(np.int32).max)

#: White space as in Unicode's White_Space: what the patterns of rank tokenizers mean by \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ranks:
    """The tokens of a rank file (base64 token, blank, rank) and the pairs that merge, as arrays."""

    def __init__(self, contents: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, contents.splitlines())}
        if len(rank) > MAX_RANKS or any(bytes([b]) not in rank for b in range(256)):
            raise ValueError(f"needs a rank for each byte, and at most {MAX_RANKS} ranks")
        self.bytes_rank = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for t, r in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(r)
        self._table(np.array(left, dtype=np.uint64), np.array(right, dtype=np.uint64), np.array(merged, dtype=np.int32))
        size = np.zeros(max(rank.values()) + 2, dtype=np.int64)
        for t, r in rank.items():
            size[r + 1] = len(t)
        self.start, self.text = np.cumsum(size), b"".join(t for _, t in sorted((r, t) for t, r in rank.items()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered at once."""
        size = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.frombuffer(self.text, dtype=np.uint8)[at].tobytes()

    def decode_each(self, pieces: list[list[int]]) -> list[bytes]:
        """The bytes of each piece's ids."""
        ids = np.fromiter(itertools.chain.from_iterable(pieces), dtype=np.int64)
        end = np.append(0, np.cumsum(self.start[ids + 1] - self.start[ids]))[np.cumsum([0, *map(len, pieces)])].tolist()
        whole = self.decode(ids)
        return [whole[a:b] for a, b in itertools.pairwise(end)]

    def _table(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left << np.uint64(32)) | right
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, 2**64 - 1, dtype=np.uint64), np.full(1 << bits, NONE, dtype=np.int32), 0
        todo, step = np.arange(len(keys)), 0
        slot = self._slot(keys)
        while len(todo):
            at = (slot[todo] + step) & self.mask
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            here = (slot[won] + step) & self.mask
            self.keys[here], self.values[here] = keys[won], merged[won]
            todo, step = np.setdiff1d(todo, won, assume_unique=True), step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge; ids below 0 are padding."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[live].astype(np.uint64) << np.uint64(32)) | right[live].astype(np.uint64)
        slot = self._slot(keys)
        for step in range(self.probes):
            at = (slot + step) & self.mask
            found = self.keys[at]
            hit = found == keys
            out[live[hit]] = self.values[at[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            if not more.any():
                break
            live, keys, slot = live[more], keys[more], slot[more]
        return out

    def merge_matrix(self, m: np.ndarray) -> list[list[int]]:
        """ids of each row of m (ids, padded with -1 at the end)."""
        out: list = [None] * len(m)
        rows = np.arange(len(m))
        rank = self.lookup(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), dtype=np.int64)
            value = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            done = value == NONE
            if done.any():
                size = (m[done] >= 0).sum(axis=1)
                for k, ids, n in zip(rows[done].tolist(), m[done].tolist(), size.tolist()):
                    out[k] = ids[:n]
                keep = ~done
                rows, m, rank, best, value = rows[keep], m[keep], rank[keep], best[keep], value[keep]
                if not len(rows):
                    break
            own, width = np.arange(len(rows)), m.shape[1]
            source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > best[:, None])
            m = np.take_along_axis(m, source, axis=1)
            m[own, best] = value
            if width > 2:
                rank = np.take_along_axis(rank, np.minimum(source[:, : width - 2], width - 2), axis=1)
                at = np.minimum(best, width - 3)
                rank[own, at] = np.where(best <= width - 3, self.lookup(m[own, at], m[own, at + 1]), rank[own, at])
                before = best > 0
                rank[own[before], best[before] - 1] = self.lookup(m[own[before], best[before] - 1], m[own[before], best[before]])
            else:
                rank = np.zeros((len(rows), 0), dtype=np.int32)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """ids of one long piece."""
        ids = self.bytes_rank[np.frombuffer(piece, dtype=np.uint8)]
        rank = self.lookup(ids[:-1], ids[1:])
        while len(rank) and (r := rank.min()) != NONE:
            at = np.flatnonzero(rank == r)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))  # of pairs that overlap, every second one
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            if len(at) > 1:  # one alone, if it makes a pair that comes before the next
                after, before = at[at < len(ids) - 2], at[at > 0]
                left = ids[before - 1].copy()
                left[np.isin(before - 2, at)] = r
                if (self.lookup(np.full(len(after), r, dtype=np.int32), ids[after + 2]) < r).any() or (self.lookup(left, np.full(len(before), r, dtype=np.int32)) < r).any():
                    at = at[:1]
            ids[at] = r
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids = ids[keep]
            at = at - np.arange(len(at))
            rank = rank[keep[1:]]  # of the pair that ends at each id that is left
            new = np.unique(np.concatenate([at[at > 0] - 1, at[at < len(ids) - 1]]))
            rank[new] = self.lookup(ids[new], ids[new + 1])
        return ids.tolist()

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """ids of each piece."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for k in np.flatnonzero(size > LONG):
            out[k] = self.merge_long(pieces[k])
        low = 1
        while low <= LONG:
            high = max(low, low * 3 // 2)
            rows = np.flatnonzero((size >= low) & (size <= min(high, LONG)))
            for part in np.array_split(rows, max(1, len(rows) * high // (1 << 18))) if len(rows) else ():
                width = int(size[part].max())
                m = np.full((len(part), width), -1, dtype=np.int32)
                m[np.arange(width)[None, :] < size[part][:, None]] = self.bytes_rank[np.frombuffer(b"".join(pieces[k] for k in part), dtype=np.uint8)]
                for k, ids in zip(part, self.merge_matrix(m) if width > 1 else m.tolist()):
                    out[k] = ids
            low = high + 1
        return out


def check_pattern(pattern: str) -> None:
    """An error if matches of the pattern can span chunks: it is tried on all runs of four of letters, digits, signs and white space."""
    import regex

    split = regex.compile(pattern).findall
    for parts in itertools.product(("word", "1", "!", "'s", " ", "\n", "\r\n", "\t"), repeat=4):
        t = "".join(parts)
        if split(t) != [p for c in Codec.CHUNKS(t) for p in ((c,) if Codec.whole(c) else split(c))]:
            raise ValueError(f"a pattern whose matches span words: {t!r}")


class Codec:
    """Encoder and decoder of whole texts, with a bounded cache of chunks.

    A chunk is white space with the run of other characters after it. No match of a pattern whose
    white-space matches leave a blank to the next word spans the end of such a run, so chunks are split on their own.
    """

    CHUNKS = staticmethod(re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall)

    @staticmethod
    def whole(chunk: str) -> bool:
        """A chunk of letters, which is one match."""
        return (chunk[1:] if chunk[0] == " " else chunk).isalpha()

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")).findall
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    def _learn(self, chunks: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Of each chunk the ids as text, their number and the bytes they decode to; short ones stay in the cache."""
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        known = self.cache
        out = {c: known[c] for c in chunks if c in known}
        parts = {c: (c,) if self.whole(c) else self.split(c) for c in chunks if c not in out}
        new = {p for ps in parts.values() for p in ps}
        pieces = {p: known[p] for p in new if p in known}
        todo = list(new.difference(pieces))
        got = self.ranks.encode_pieces([p.encode() for p in todo])
        for p, ids, raw in zip(todo, got, self.ranks.decode_each(got)):
            pieces[p] = (" ".join(map(str, ids)), len(ids), raw)
            self._keep(p, pieces[p])
        for c, ps in parts.items():
            if len(ps) == 1:
                out[c] = pieces[ps[0]]
            else:
                got = [pieces[p] for p in ps]
                out[c] = (" ".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got]))
                self._keep(c, out[c])
        return out

    def _keep(self, c: str, e: tuple[str, int, bytes]) -> None:
        if len(c) <= CACHED:
            self.cache[c] = e
            self.held += 300 + 4 * len(c)

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text its ids (decimal, joined by blanks), their number, and the bytes that they decode to."""
        collecting = gc.isenabled()
        gc.disable()  # what is made here has no cycles, and looking for them takes a third of the time
        try:
            split = list(map(self.CHUNKS, texts))
            known = self._learn({c for cs in split for c in cs})
            out = []
            for cs in split:
                got = list(map(known.__getitem__, cs))
                out.append((" ".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])))
            return out
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: list[int]) -> bytes:
        return self.ranks.decode(np.array(ids, dtype=np.int64))


def _texts(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    _, off = utf8(batch.column(column))
    for i, j in slices(off, limit):
        part = batch.slice(i, j - i)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of batch, taken from new where it has them."""
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)


def _shared(df: DataFrame, vocabulary: str, pattern: str):
    """The broadcast tables of a rank file."""
    with open(vocabulary, "rb") as f:
        ranks = Ranks(f.read())
    check_pattern(pattern)
    return df.sparkSession.sparkContext.broadcast(ranks)


def _mapped(df: DataFrame, text: str, vocabulary: str, pattern: str, new: list[T.StructField], make, keep_text: bool = True) -> DataFrame:
    shared = _shared(df, vocabulary, pattern)
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new} and (keep_text or f.name != text)]
    names = [f.name for f in kept] + [x.name for x in new]

    def run(batches):
        c = Codec(shared.value, pattern)
        for batch in batches:
            for part, texts in _texts(batch, text):
                yield with_columns(part, names, make(c, texts))

    return df.mapInArrow(tidy(run), T.StructType(kept + new))


def _ids(encoded: list[tuple[str, int, bytes]]) -> pa.Array:
    flat = np.fromstring(" ".join([e[0] for e in encoded if e[1]]), dtype=np.int32, sep=" ")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([e[1] for e in encoded])), pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (array of int), the ids of the whole text."""
    return _mapped(df, text, vocabulary, pattern, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda c, texts: {"ids": _ids(c.encode(texts))})


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary), the bytes of the ids; a null list decodes to no bytes."""
    shared = _shared(df, vocabulary, pattern)
    kept = [f for f in df.schema.fields if f.name != "decoded"]

    def run(batches):
        c = Codec(shared.value, pattern)
        for b in batches:
            yield with_columns(b, [f.name for f in kept] + ["decoded"], {"decoded": pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.binary())})

    return df.mapInArrow(tidy(run), T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


def _digests(encoded: list[tuple[str, int, bytes]]) -> dict[str, pa.Array]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {"n_tokens": pa.array([x[1] for x in encoded], pa.int64()), "ids_sha256": pa.array([sha(x[0].encode()) for x in encoded], pa.string()), "decoded_sha256": pa.array([sha(x[2]) for x in encoded], pa.string())}


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding it, in one pass."""
    return _mapped(df, text, vocabulary, pattern, _DIGESTS, lambda c, texts: _digests(c.encode(texts)), False)


def encoded(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with ids and the columns of digests, in one pass."""

    def make(c, texts):
        e = c.encode(texts)
        return _digests(e) | {"ids": _ids(e)}

    return _mapped(df, text, vocabulary, pattern, [*_DIGESTS, T.StructField("ids", T.ArrayType(T.IntegerType()))], make, False)
