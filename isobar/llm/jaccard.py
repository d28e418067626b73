"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set is that of its distinct n-word shingles. Two sets link if their Jaccard similarity is at least num / den, in integers.

PartEnum: sizes are cut in bands [l, l den / num]; linked sets lie in one band or in neighbours, and differ in at most
k = r (den - num) / num elements, r being the smaller one's band's end. For each pair of neighbouring bands, a hash deals the shingles to n1 = k / 2 + 1 + spare
parts, and each part's to 3 sub-parts. Of the parts, at least spare + 1 hold at most one differing element, so two of their sub-parts agree: each part
gives its 3 subsets of two sub-parts as signatures, and linked sets share one. A subset of few elements says little: a set leaves out its subsets of fewer than ``least``
elements, the largest number for which at most ``spare`` of its parts have such. Of two linked sets, take the one with the larger ``least``: one of the spare + 1 parts has no such
subset there, so the subset that agrees, which is as large in the other set, is left out by neither.

1. Equal sets become one class, under a 64-bit hash of the set (at 10^10 different texts, about 3 chance meetings of hashes are expected). With its class a document
   has its set's parity bitmap: about a bit for each 1 to 2 elements, flipped by each element that falls on it. The bitmaps of two sets differ in no more bits than the sets in elements.
2. Classes' signatures go to tasks by their lowest bits, packed with the class hashes in binary blocks, about 10 to 13 bytes each; the number of
   tasks follows the number of signatures. A task sorts its own and keeps the buckets, the sets of at least two classes with a signature in common. Buckets of the same classes
   count once.
3. The bitmaps meet by bucket: pairs whose bitmaps differ too much can't link, and a bucket falls apart in the groups that the other pairs hold together. So only classes that have
   a near one send their sets.
4. Both for bitmaps and for sets, buckets are dealt to cells by the smallest class of the buckets around them, so that those of a group of copies come together, in as many cells as keep to
   ``HOME_ROWS`` rows, ``HOME_PAIRS`` pairs and ``HOME_BYTES`` each, and each class goes once to each cell in which it has a bucket. A bucket of more than ``BLOCK`` classes or
   ``BLOCK_BYTES`` goes as pairs of blocks, so no bucket is too large for a task, and a cell holds about ``CELL_BYTES`` or one pair of blocks. A cell compares the classes of each bucket exactly, on the sets, with a matrix product where they are many. No pairs are written: a cell keeps
   a forest of what it has found linked, skips pairs that are in one tree already, and returns the links that joined trees.
   Before, the classes of buckets of more than ``BLOCK`` are compared with ``PIVOTS`` classes of their group each. What that links is a tree: a large bucket is cut in its largest tree and the rest, and only
   the rest is compared with all, so work is linear in a group of copies that hang together, and a group's buckets of one tree are done.
5. The components of these links are the result. A cell that is lost is computed again from the stored tables.

Sets of candidates are computed anew from their texts, one for each class, found by doc_id and the text's hash; these keys are broadcast only up to ``BROADCAST_IDS``; beyond, they are joined by a shuffle.

Defined results: A-Z are lower-cased; null texts and texts without words have an empty set, link with nothing, and are their own component; with fewer words than n the
whole sequence is the one shingle; repeated rows are one class; rows that repeat a doc_id with other texts are documents of their own; rows of null id link too; a component's id is its smallest doc_id, nulls aside; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, mix, row_sets, slices, stored, tidy, utf8
from .components import components

ENTRIES_PER_TASK, BROADCAST_IDS, FLUSH = 1 << 20, 1 << 18, 8 << 20
BLOCK, ROWS_PER_CELL, HOME_ROWS, HOME_PAIRS, MAX_DONE, PIVOTS, FEW = 1024, 4096, 1 << 13, 1 << 22, 1 << 20, 16, 64
BLOCK_BYTES, HOME_BYTES, CELL_BYTES, PAIRS_AT_ONCE = 16 << 20, 32 << 20, 16 << 20, 1 << 19
_SUBSETS = np.array([[1, 1, 0], [1, 0, 1], [0, 1, 1]], dtype=np.uint64)


def band_ends(top: int, num: int, den: int) -> np.ndarray:
    """The last sizes of the bands, up to one that holds top."""
    out, low = [0], 1
    while out[-1] < top:
        out.append(low * den // num)
        low = out[-1] + 1
    return np.array(out[1:], dtype=np.int64)


def parts(end: int, num: int, den: int) -> tuple[int, int]:
    """Number of parts, and how many more than needed, for sets whose smaller band ends at end; 0 parts if only equal sets link."""
    k = end * (den - num) // num
    need = k // 2 + 1
    spare = 1 + need // 8
    return (need + spare, spare) if k else (0, 0)


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0]) if len(s) else 0


def signatures(s: np.ndarray, num: int, den: int, ends: np.ndarray | None = None) -> np.ndarray:
    """The 64-bit signatures of a set of hashes."""
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    ends = band_ends(len(s), num, den) if ends is None else ends
    own = int(np.searchsorted(ends, len(s)))
    out = []
    for band in (own - 1, own):
        if band < 0:
            continue
        n1, spare = parts(int(ends[band]), num, den)
        if not n1:
            continue
        seed = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        h = mix(s ^ seed)
        cell = ((h >> np.uint64(33)) % np.uint64(n1 * 3)).astype(np.int64)
        total, count = np.zeros(n1 * 3, dtype=np.uint64), np.bincount(cell, minlength=n1 * 3)
        np.add.at(total, cell, mix(h + np.uint64(0xBB67AE8584CAA73B)))
        sums = (total.reshape(n1, 3) @ _SUBSETS.T).ravel()
        held = count.reshape(n1, 3) @ _SUBSETS.T.astype(np.int64)
        fewest = np.sort(held.min(axis=1))
        least = int(fewest[min(spare, n1 - 1)])
        sig = mix(sums + np.arange(n1 * 3, dtype=np.uint64) * np.uint64(0x3C6EF372FE94F82B) + seed)
        out.append(sig[held.ravel() >= least])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _batches(batches, text: str):
    for b in batches:
        data, off = utf8(b.column(text))
        for i, j in slices(off):
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def bitmap(s: np.ndarray) -> bytes:
    """The parity bitmap of a set: 64 bits, or a power of two from half its elements on."""
    width = max(64, 1 << max(0, (len(s) + 1) // 2 - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def shingle_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, cls, the hash of the set, and its bitmap (null if it is empty)."""

    def run(batches):
        for part, data, off in _batches(batches, "text"):
            sets = row_sets(data, off, n)
            cls = np.array([set_hash(s) for s in sets], dtype=np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            bits = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "th": part.column("th"), "n_shingles": size, "cls": pa.array(cls, mask=size == 0), "bits": bits})

    return _keyed(docs).mapInArrow(tidy(run), "doc_id long, th long, n_shingles long, cls long, bits binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _entries(docs: DataFrame, n: int, num: int, den: int, n_parts: int) -> DataFrame:
    """Rows (part, packed): the signatures of part (their upper 5 bytes) and the classes that have them."""

    def packed(sigs: list, owners: list):
        sig, cls = np.concatenate(sigs), np.repeat(np.array(owners, dtype=np.uint64), [len(x) for x in sigs])
        part = (sig & np.uint64(0xFFFFFF)) * np.uint64(n_parts) >> np.uint64(24)
        order = np.argsort(part, kind="stable")
        sig, cls, part = sig[order], cls[order], part[order]
        at, cut = np.unique(part, return_index=True)
        cut = np.append(cut, len(sig))
        blobs = []
        for a, b in zip(cut[:-1], cut[1:]):
            five = np.ascontiguousarray((sig[a:b] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
            known, of = np.unique(cls[a:b], return_inverse=True)
            if len(known) < 65536 and len(known) * 8 + (b - a) * 2 < (b - a) * 8:
                blobs.append(b"".join([np.int64(b - a).tobytes(), np.int64(len(known)).tobytes(), five.tobytes(), known.tobytes(), of.astype(np.uint16).tobytes()]))
            else:
                blobs.append(b"".join([np.int64(b - a).tobytes(), np.int64(0).tobytes(), five.tobytes(), cls[a:b].tobytes()]))
        return pa.RecordBatch.from_pydict({"part": at.astype(np.int32), "packed": pa.array(blobs, pa.binary())})

    def run(batches):
        ends, seen, sigs, owners, held = np.zeros(0, dtype=np.int64), set(), [], [], 0
        for _, data, off in _batches(batches, "text"):
            for s in row_sets(data, off, n):
                if not len(s):
                    continue
                cls = set_hash(s)
                if cls in seen:
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(cls)
                if not len(ends) or ends[-1] < len(s):
                    ends = band_ends(2 * len(s), num, den)
                sig = signatures(s, num, den, ends)
                if len(sig):
                    sigs.append(sig), owners.append(cls)
            held += len(data)
            if held >= FLUSH and sigs:
                yield packed(sigs, owners)
                sigs, owners, held = [], [], 0
        if sigs:
            yield packed(sigs, owners)

    return docs.select("text").mapInArrow(tidy(run), "part int, packed binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, known = np.frombuffer(blob, np.int64, 2).tolist()
    sig = np.zeros((n, 8), dtype=np.uint8)
    sig[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 16).reshape(n, 5)
    if known:
        cls = np.frombuffer(blob, np.uint64, known, 16 + 5 * n)[np.frombuffer(blob, np.uint16, n, 16 + 5 * n + 8 * known)]
    else:
        cls = np.frombuffer(blob, np.uint64, n, 16 + 5 * n)
    return sig.view(np.uint64).ravel(), cls


def _buckets(entries: DataFrame) -> DataFrame:
    """Rows (bucket, cls, size, least class) of every set of at least two classes that share a signature; equal sets of a task once."""

    def run(batches):
        sigs, clss = [], []
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("packed").to_pylist()):
                s, c = _unpacked(blob)
                sigs.append(s | (np.uint64(part) << np.uint64(40)))
                clss.append(c)
        if not sigs:
            return
        sig, cls = np.concatenate(sigs), np.concatenate(clss)
        del sigs, clss
        order = np.argsort(sig)
        sig, cls = sig[order], cls[order]
        many = np.zeros(len(sig), dtype=bool)
        same = sig[1:] == sig[:-1]
        many[1:] = same
        many[:-1] |= same
        sig, cls = sig[many], cls[many]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        if not len(sig):
            return
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[new], cls[new]
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(at, len(sig)))
        name = mix(np.add.reduceat(mix(cls), at) + size.astype(np.uint64))
        _, first = np.unique(name, return_index=True)
        first = first[size[first] > 1]
        keep = np.zeros(len(at), dtype=bool)
        keep[first] = True
        rows = np.repeat(keep, size)
        yield pa.RecordBatch.from_pydict({"bucket": np.repeat(name, size)[rows].view(np.int64), "cls": cls[rows].view(np.int64), "size": np.repeat(size, size)[rows], "least": np.repeat(cls[at], size)[rows].view(np.int64)})

    return entries.mapInArrow(tidy(run), "bucket long, cls long, size long, least long")


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def _packed(docs: DataFrame, n: int) -> DataFrame:
    """cls and its set (packed) of docs, each class once a task."""

    def run(batches):
        seen: set = set()
        for _, data, off in _batches(batches, "text"):
            new = {c: s for s in row_sets(data, off, n) if len(s) and (c := set_hash(s)) not in seen}
            seen.update(new)
            yield pa.RecordBatch.from_pydict({"cls": np.array(list(new), dtype=np.uint64).view(np.int64), "packed": pa.array([s.tobytes() for s in new.values()], pa.binary())})

    return docs.select("text").mapInArrow(tidy(run), "cls long, packed binary")


def _semi(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs that have one of the keys (doc_id, th); a null id is an id like others."""
    of = free_names(docs, ("d", "t"))
    k = _few(keys.select(F.col("doc_id").alias(of["d"]), F.col("th").alias(of["t"])))
    return docs.join(k, (F.xxhash64("text") == F.col(of["t"])) & F.col("doc_id").eqNullSafe(F.col(of["d"])), "left_semi")


class _Forest:
    """Union-find over classes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def links_of(members: list[int], sets: dict[int, np.ndarray], num: int, den: int, forest: _Forest | None, done: set) -> list[tuple[int, int]]:
    """Links that join trees of forest, of pairs of members; every pair is compared, or is in one tree, or was compared before (in done). Without a forest, all links."""
    m, out = len(members), []
    sized = [len(sets[c]) for c in members]
    if m >= 12:
        flat = np.concatenate([sets[c] for c in members])
        row = np.repeat(np.arange(m), sized)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.append(True, flat[1:] != flat[:-1])
        often = np.diff(np.append(np.flatnonzero(new), len(flat))) > 1
        code = np.cumsum(new) - 1
        keep = often[code]
        row, code = row[keep], (np.cumsum(often) - 1)[code[keep]]
        width = int(often.sum())
        if m * m * width * 2e-4 < m * (m - 1) / 2 * 12:  # microseconds: a matrix product, or pair by pair
            both = np.zeros((m, m), dtype=np.float64)
            for low in range(0, width, 4096):
                a, b = np.searchsorted(code, (low, low + 4096))
                block = np.zeros((m, min(4096, width - low)), dtype=np.float32)
                block[row[a:b], code[a:b] - low] = 1
                both += block @ block.T
            size = np.array(sized)
            x, y = np.nonzero(np.triu(den * both >= num * (size[:, None] + size[None, :] - both), 1))
            for i, j in zip(x.tolist(), y.tolist()):
                if forest is None or forest.join(members[i], members[j]):
                    out.append((members[i], members[j]))
            return out
    for i in range(m):
        x = sets[members[i]]
        for j in range(i):
            y = sets[members[j]]
            if min(len(x), len(y)) * den < num * max(len(x), len(y)) or forest is not None and forest.root(members[i]) == forest.root(members[j]):
                continue
            pair = (members[j], members[i])
            if pair in done:
                continue
            if len(done) < MAX_DONE:
                done.add(pair)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both):
                if forest is not None:
                    forest.join(*pair)
                out.append(pair)
    return out


class _Bitmaps:
    """Bitmaps of a cell's classes, as a matrix for each width; wider ones are folded."""

    def __init__(self, bits: list[bytes]):
        self.rows = [np.frombuffer(b, np.uint64) for b in bits]
        self.width = np.array([len(r) for r in self.rows])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def matrix(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each class in the matrix of the width, and the matrix."""
        if width not in self.at:
            own = np.flatnonzero(self.width >= width)
            place = np.zeros(len(self.rows), dtype=np.int64)
            place[own] = np.arange(len(own))
            self.at[width] = place, np.array([np.bitwise_xor.reduce(self.rows[k].reshape(-1, width), axis=0) for k in own])
        return self.at[width]

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of x and y differ: at most the number of elements in which their sets do."""
        out, width = np.zeros(len(x), dtype=np.int64), np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            place, m = self.matrix(w)
            at = np.flatnonzero(width == w)
            for part in np.array_split(at, len(at) * w // (1 << 21) + 1):
                out[part] = np.bitwise_count(m[place[x[part]]] ^ m[place[y[part]]]).sum(axis=1)
        return out


def _groups(m: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Groups of at least two of 0 .. m - 1 that the pairs x, y hold together."""
    if len(x) == m * (m - 1) // 2:
        return [np.arange(m)]
    top = np.arange(m)
    while True:
        low = top.copy()
        np.minimum.at(low, x, top[y])
        np.minimum.at(low, y, top[x])
        low = low[low]
        if (low == top).all():
            break
        top = low
    return [g for t in np.unique(top[np.concatenate([x, y])]) if len(g := np.flatnonzero(top == t)) > 1]


def near_groups(key: np.ndarray, cls: np.ndarray, known: np.ndarray, size: np.ndarray, bits: list[bytes], num: int, den: int) -> list[np.ndarray]:
    """Of rows (key, cls), sorted, the groups of classes of a key that pairs which may link hold together; known are the classes, sorted, with their sizes and bitmaps. Equal groups once."""
    maps, out, seen = _Bitmaps(bits), [], set()
    at = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    of = np.searchsorted(known, cls)
    width = np.diff(at)
    for part in np.split(np.arange(len(width)), np.flatnonzero(np.diff(np.cumsum(width * (width - 1) // 2) // PAIRS_AT_ONCE)) + 1):
        pairs = [np.triu_indices(width[b], 1) for b in part]
        x = np.concatenate([of[at[b] : at[b + 1]][p[0]] for b, p in zip(part, pairs)])
        y = np.concatenate([of[at[b] : at[b + 1]][p[1]] for b, p in zip(part, pairs)])
        code, back = np.unique(x * len(known) + y, return_inverse=True)
        x, y = code // len(known), code % len(known)
        fits = np.minimum(size[x], size[y]) * den >= num * np.maximum(size[x], size[y])
        fits[fits] = maps.distance(x[fits], y[fits]) * (den + num) <= (size[x[fits]] + size[y[fits]]) * (den - num)
        fits, low = fits[back], 0
        for b, (i, j) in zip(part, pairs):
            ok = fits[low : low + len(i)]
            low += len(i)
            if ok.any():
                for g in _groups(int(width[b]), i[ok], j[ok]):
                    g = cls[at[b] + g]
                    if g.tobytes() not in seen:
                        seen.add(g.tobytes())
                        out.append(g)
    return out


def _homes(members: DataFrame) -> DataFrame:
    """members with ``home``, the least class near the bucket, which the buckets of a group of copies share, and the blocks in which the bucket's rest and its tree are cut."""
    near = members.groupBy(F.col("cls").alias("c")).agg(F.min("least").alias("near"))
    cut = lambda own: F.greatest(F.ceil(F.sum(own.cast("int")) / BLOCK), F.ceil(F.sum(F.when(own, F.col("bytes"))) / BLOCK_BYTES), F.lit(0)).cast("int")
    homes = members.join(near, F.col("cls") == F.col("c")).groupBy(F.col("bucket").alias("b")).agg(F.min("near").alias("home"), F.greatest(cut(~F.col("tree")), F.lit(1)).alias("blocks"), cut(F.col("tree")).alias("trees"))
    return members.join(homes, F.col("bucket") == F.col("b")).drop("b")


def _cells(members: DataFrame, payload: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Rows (cell, key, cls, label) of members (bucket, cls, size, least, bytes, label, tree) dealt to cells, and (at, c, and the payload's other columns) of each class of a cell, once. No two blocks of a tree meet."""
    rows, total = members.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_cells = max(4 * tasks, rows // ROWS_PER_CELL, total // CELL_BYTES)
    m = _homes(members)
    own = m.groupBy("home", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("p"), F.max("bytes").alias("w"))
    splits = F.greatest(F.ceil(F.sum("n") / HOME_ROWS), F.ceil(F.sum("p") / HOME_PAIRS), F.ceil(F.sum("w") / HOME_BYTES)).cast("int")
    m = m.join(own.groupBy(F.col("home").alias("h")).agg(splits.alias("splits")), F.col("home") == F.col("h"))
    spread = F.xxhash64("cls")
    m = m.withColumn("own", F.when(F.col("tree"), F.col("blocks") + F.pmod(spread, F.greatest("trees", F.lit(1)))).otherwise(F.pmod(spread, "blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") + F.when(F.col("tree"), 0).otherwise(F.col("trees")) - 1)))
    key = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    home = F.when(F.col("blocks") + F.col("trees") > 1, F.xxhash64(key)).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("bucket"), "splits")))
    m = m.select("cls", "label", key.alias("key"), F.pmod(home, F.lit(n_cells)).cast("int").alias("cell"))
    held = m.select(F.col("cell").alias("at"), F.col("cls").alias("c")).distinct()
    return m, held.join(payload, F.col("c") == payload["cls"]).drop("cls")


def _in_trees(members: DataFrame, trees: DataFrame | None) -> DataFrame:
    """members with label, the tree that is known of a class, and whether it is in its bucket's largest tree (of buckets of more than ``FEW``). Buckets of one tree alone have nothing left to compare and go."""
    if trees is None:
        return members.withColumns({"label": F.lit(None).cast("bigint"), "tree": F.lit(False)})
    m = members.join(trees.select(F.col("node").alias("c"), F.col("component").alias("label")), F.col("cls") == F.col("c"), "left").drop("c")
    sizes = m.filter((F.col("size") > FEW) & F.col("label").isNotNull()).groupBy(F.col("bucket").alias("b"), F.col("label").alias("l")).agg(F.count("*").alias("n"))
    most = sizes.groupBy("b").agg(F.max(F.struct("n", "l")).alias("most")).select("b", F.col("most.n").alias("n"), F.col("most.l").alias("l"))
    m = m.join(most, F.col("bucket") == F.col("b"), "left").filter(F.col("n").isNull() | (F.col("n") < F.col("size")))
    return m.withColumn("tree", F.coalesce(F.col("label") == F.col("l"), F.lit(False))).drop("b", "l", "n")


def _pivot_links(docs: DataFrame, n: int, num: int, den: int, members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Links of the classes of buckets of more than ``BLOCK`` with the ``PIVOTS`` least classes of their home, and the sets of these classes; None without such buckets. Work and rows are linear in a group."""
    if not members.filter(F.col("size") > BLOCK).head(1):
        return None
    hot = stored(_homes(_in_trees(members, None)).filter(F.col("size") > BLOCK).select("home", "cls").distinct(), "hot")
    rank = F.row_number().over(Window.partitionBy("home").orderBy("cls"))
    pivots = hot.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).drop("rank")
    sets = _sets(docs, n, found, hot)
    splits = hot.join(sets.select("cls", F.length("packed").alias("bytes")), "cls").groupBy("home").agg(F.greatest(F.ceil(F.count("*") / HOME_ROWS), F.ceil(F.sum("bytes") / HOME_BYTES)).cast("int").alias("splits"))
    left = hot.join(splits, "home").select("home", F.pmod(F.xxhash64("cls"), "splits").cast("int").alias("part"), "cls").join(sets, "cls")
    right = pivots.join(splits, "home").select(F.col("home").alias("at"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("piece"), "cls").join(sets, "cls").withColumnsRenamed({"cls": "pivot", "packed": "set"})

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        unpacked = lambda t, c, p: sorted(zip(t.column(c).to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(p))), key=lambda x: x[0])
        forest, out, ends = _Forest(), [], unpacked(own, "pivot", "set")
        for c, x in unpacked(rows, "cls", "packed"):
            for z, y in ends:
                if min(len(x), len(y)) * den >= num * max(len(x), len(y)) and forest.root(c) != forest.root(z):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        forest.join(c, z)
                        out.append((c, z))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    links = stored(left.groupBy("home", "part").cogroup(right.groupBy("at", "piece")).applyInArrow(run, "u long, v long"), "pivot-links")
    discard(hot)
    return links, sets


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, cls = rows.column("key").to_numpy(), rows.column("cls").to_numpy()
    order = np.lexsort((cls, key))
    return key[order], cls[order]


def _near(members: DataFrame, bitmaps: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    """Buckets (bucket, cls, size, least) of what is left of members' by the bitmaps (cls, n_shingles, bits)."""
    m, held = _cells(members, bitmaps, tasks)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("c")
        bits = [b.as_py() for b in own.column("bits")]
        got = near_groups(*_sorted(rows), own.column("c").to_numpy(), own.column("n_shingles").to_numpy(), bits, num, den)
        n = np.array([len(g) for g in got], dtype=np.int64)
        cls = np.concatenate(got) if got else np.zeros(0, dtype=np.int64)
        name = np.array([mix(np.array([mix(g.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(g))]))[0] for g in got], dtype=np.uint64).view(np.int64)
        least = np.array([g[0] for g in got], dtype=np.int64)
        return pa.table({"bucket": np.repeat(name, n), "cls": cls, "size": np.repeat(n, n), "least": np.repeat(least, n)})

    return m.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(run, "bucket long, cls long, size long, least long")


def _links(members: DataFrame, sets: DataFrame, num: int, den: int, tasks: int, every: bool = False) -> DataFrame:
    """Links (u, v) that hold the components together, or every link, some of them several times."""
    m, held = _cells(members, sets, tasks)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        known = {c: np.frombuffer(p.as_buffer(), np.uint64) for c, p in zip(own.column("c").to_pylist(), own.column("packed"))}
        key, cls = _sorted(rows)
        forest, done, out = None if every else _Forest(), set(), []
        if forest:
            for c, label in zip(rows.column("cls").to_pylist(), rows.column("label").to_pylist()):
                if label is not None:
                    forest.join(c, label)
        for part in np.split(cls, np.flatnonzero(key[1:] != key[:-1]) + 1):
            out += links_of(part.tolist(), known, num, den, forest, done)
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return m.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(run, "u long, v long")


def _sets(docs: DataFrame, n: int, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored: cls and packed set of those classes, each once."""
    keys = found.join(classes.select("cls").distinct(), "cls", "left_semi").select("first.doc_id", "first.th")
    sets = stored(_packed(_semi(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), keys), n), "sets")
    if sets.count() > sets.select("cls").distinct().count():
        repeated, sets = sets, stored(sets.dropDuplicates(["cls"]), "sets")
        discard(repeated)
    return sets


def _candidates(docs: DataFrame, n: int, num: int, den: int, classes: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """Buckets of classes that may link, as _cells takes them, the sets of these classes, a number of tasks, and links that are known already (unless every link is asked for)."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    per_shingle = 3.4 * (den - num) / num
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * per_shingle) // ENTRIES_PER_TASK)
    members = stored(_buckets(_entries(docs, n, num, den, tasks).repartitionById(tasks, "part")).distinct(), "members")
    own = classes.join(members.select("cls").distinct(), "cls", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    found = stored(own.groupBy("cls").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "candidates")
    sized = lambda m, per: m.join(found.select("cls", (F.col("n_shingles") * per).cast("bigint").alias("bytes")), "cls")
    light = stored(sized(members, 0.125), "sized")
    known = None if every else _pivot_links(docs, n, num, den, light, found)
    links, hot = known or (None, None)
    trees = components(links) if known else None
    near = stored(_near(_in_trees(light, trees), found.select("cls", "n_shingles", "bits"), num, den, tasks).distinct(), "near")
    discard(members, light)
    sets = _sets(docs, n, found, near.join(hot, "cls", "left_anti") if known else near)
    if known:
        apart, sets = sets, stored(sets.union(hot.join(near.select("cls").distinct(), "cls", "left_semi")), "sets")
        discard(apart, hot)
    rows = stored(_in_trees(sized(near, 8).join(sets.select("cls"), "cls", "left_semi"), trees), "sized")
    discard(near, found)
    return rows, sets, tasks, links


def _labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, th, n_shingles and comp, the component's class (null without a set), of every row."""
    classes = stored(shingle_classes(docs, n), "classes")
    rows, sets, tasks, known = _candidates(docs, n, num, den, classes.filter("cls IS NOT NULL"))
    links = stored(_links(rows, sets, num, den, tasks), "links")
    discard(rows, sets)
    labels = components(links.union(known) if known else links)
    discard(links, *([known] if known else []))
    own = classes.drop("bits").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    return own.select("doc_id", "th", "n_shingles", F.coalesce("component", "cls").alias("comp"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    own = _labelled(docs, n, num, den)
    least = own.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_pairs(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The join itself: its links (left, right) between representatives, the smallest doc_ids of two classes of equal sets, each once; and the membership (doc_id, representative) of every row that has a set.

    Links between two classes only of null ids have no representatives to name them and are left out here; components have them. A group of near copies has a link for each pair of its
    classes; for groups too large for that, take jaccard_components."""
    classes = stored(shingle_classes(docs, n), "classes").filter("cls IS NOT NULL")
    rows, sets, tasks, _ = _candidates(docs, n, num, den, classes, every=True)
    known = stored(classes.groupBy("cls").agg(F.min("doc_id").alias("representative")), "representatives")
    links = _links(rows, sets, num, den, tasks, every=True).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    end = lambda name, c: known.filter("representative IS NOT NULL").select(F.col("cls").alias(c), F.col("representative").alias(name))
    pairs = links.join(end("a", "u"), "u").join(end("b", "v"), "v").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
    return pairs, classes.select("doc_id", "cls").join(known, "cls").select("doc_id", "representative")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, with the same columns, with one row of each component: that of the smallest doc_id (nulls last), then the smallest text hash, then, of rows equal in both, the first as JSON. Rows without words are kept."""
    rows = _labelled(docs, n, num, den).filter("comp IS NOT NULL").groupBy("comp", "doc_id", "th").agg(F.count("*").alias("n"))
    kept = stored(rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("first")).select("first.doc_id", "first.th", "first.n"), "kept")
    out = _semi(docs, kept.filter("n = 1")).unionByName(docs.filter(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    repeated = kept.filter("n > 1")
    if repeated.head(1):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        of = free_names(docs, ("th", "row"))
        one = _semi(docs, repeated).groupBy("doc_id", F.xxhash64("text").alias(of["th"])).agg(F.min_by(whole, F.to_json(whole)).alias(of["row"]))
        out = out.unionByName(one.select(f"{of['row']}.*"))
    return out


def components_sql(n: int, num: int, den: int) -> str:
    """The same for tables whose shared shingles can be joined: distinct sets, pairs by shared shingles, and what each set reaches."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {run}) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS cls, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT cls, n, unnest(s) AS x FROM c),
e AS (SELECT a.cls AS a, b.cls AS b FROM u a JOIN u b ON a.x = b.x AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT cls AS node, cls AS top FROM c UNION SELECT f.b, r.top FROM r JOIN f ON r.node = f.a),
t AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(t.top, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN t ON c.cls = t.node
"""
