"""Jaccard join of word-shingle sets by PartEnum signatures, and its connected components.

Equal sets are one node, named by a 64-bit digest of the set and, where two sets share that, by a second one.  Nodes are put in size bands whose
bounds grow by 1 / threshold, so that two similar sets lie in one band or in neighbouring ones, and in a band the threshold is a bound ``k``
on the number of shingles in which two sets differ.  The domain of shingles is hashed into ``n1`` partitions of three cells; in a
partition each subset of two cells gives a signature, the hash of the set's shingles in them.  If sets differ
in ``k`` shingles at most, some partition holds one difference at most, and a subset without it gives both the same signature.
Some more partitions than that needs make signatures of empty subsets unnecessary, but for sets that
have more partitions with an empty subset than there are spare ones.

Nodes that share a signature are a group; groups of the same nodes are one.  Candidates are judged inside their groups, before any components are
formed, by sketches that cannot lose a similar pair: first each node with the smallest of its group, which decides groups of two and groups of near
copies; then, in groups in which that failed and which are not connected otherwise, all nodes that are not connected yet, block by block.  The
components of what the sketches allow are families.  Only their sets travel, and are compared by their real intersection.  Where a
group or family fills several blocks, nodes outside of its largest component are compared with all its blocks.  So no link between components is
lost, no pairs are written, and a group of near copies costs as many rows as it has members.

At scale: signatures are packed in a row per batch and bucket, copies of a set in one batch travel once, and a signature that several sets of one
batch share sends the smallest of them to its bucket and the rest past it, so a signature that a third of all sets share does not fill a
task.  The number of buckets grows with the input.  Sets travel only for nodes in families, found by a bit filter of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, columns, components, release, written
from .hashing import BASE, digests, mix, powers

#: Cells of a partition.
CELLS = 3
#: Least and most bits of the sketches that travel before sets do; between them about a bit for each shingle.
SKETCH = 128, 16384
#: Documents a bucket of signatures stands for; sets that share a signature in one batch from which on only one goes to the bucket; their lanes.
BUCKET_DOCS, LOCAL, LANES = 3000, 4, 16
#: Nodes, and shingles, that are compared in one task.
BLOCK, BLOCK_SHINGLES = 2500, 2_000_000
#: Most bits of a filter of nodes or of candidates: 32 MB.
FILTER_BITS = 1 << 28
_U = np.uint64


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and how many each text has."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    b = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    blank = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    h = digests(b, starts, ends)
    limits = np.cumsum([len(p) + 1 for p in parts])
    return h, np.diff(np.r_[0, np.searchsorted(starts, limits)])


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each set): each text's distinct shingles, sorted."""
    h, counts = words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    short = counts < width
    n = h.size - width + 1
    if n > 0:
        s = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            s += mix(h[k : k + n], k + 1)
        s = mix(s)
    else:
        s = np.zeros(0, dtype=np.uint64)
    sets = []
    for a, e, few in zip(starts.tolist(), ends.tolist(), short.tolist(), strict=True):
        if not few:
            sets.append(np.unique(s[a : e - width + 1]))
        elif e > a:
            sets.append(mix(np.array([sum(int(x) for x in mix(h[a:e], 97) * powers(BASE, e - a)) & (2**64 - 1)], dtype=np.uint64), e - a))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return (np.concatenate(sets) if sets else s[:0]), np.array([x.size for x in sets], dtype=np.int64)


def set_ids(flat: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit digest of each set; 0 for empty ones."""
    total = np.r_[_U(0), np.cumsum(mix(flat, 0x5E7 + salt), dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64), 0x1D), _U(0))


def named(flat: np.ndarray, sizes: np.ndarray, clashes: np.ndarray, ids_of: Callable = set_ids) -> np.ndarray:
    """Each set's node: its digest, and where sets share that (``clashes``) a second one."""
    ids = ids_of(flat, sizes).view(np.int64)
    twice = np.isin(ids, clashes)
    if twice.any():
        ids = np.where(twice, ids_of(flat, sizes, 1).view(np.int64), ids)
    return ids


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), *SKETCH)


def sketches_of(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: a bit per hash value, flipped by each shingle that has it."""
    bits = sketch_bits(sizes)
    ends = np.cumsum(bits)
    of = np.repeat(np.arange(sizes.size), sizes)
    at = (ends - bits)[of] + (mix(flat, 0x5CE7) & (bits - 1).astype(np.uint64)[of]).astype(np.int64)
    total = int(ends[-1]) if sizes.size else 0
    data = np.packbits((np.bincount(at, minlength=total) & 1).astype(np.uint8)).tobytes()
    return [data[(e - n) // 8 : e // 8] for e, n in zip(ends.tolist(), bits.tolist(), strict=True)]


def folded(rows: list[bytes], bits: int) -> np.ndarray:
    """Sketches as a matrix of 64-bit words, all brought to ``bits``: the fewest that one has, or fewer."""
    out = np.zeros((len(rows), bits // 64), dtype=np.uint64)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        words = np.frombuffer(b"".join([rows[k] for k in at.tolist()]), dtype=np.uint64)
        out[at] = np.bitwise_xor.reduce(words.reshape(at.size, -1, bits // 64), axis=1)
    return out


def allowed(differ: np.ndarray, size: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can be similar."""
    return np.maximum(differ, np.abs(size - other)) * (num + den) <= (size + other) * (den - num)


def bands(most: int, num: int, den: int) -> np.ndarray:
    """Upper bounds of the size bands up to ``most``; threshold num / den."""
    upper, low = [0], 1
    while upper[-1] < most:
        upper.append(max(low, low * den // num))
        low = upper[-1] + 1
    return np.array(upper[1:] or [1], dtype=np.int64)


@lru_cache(maxsize=None)
def slack_of(low: int, k: int) -> int:
    """Partitions beyond those that the bound needs, for sets of ``low`` shingles or more.

    Chosen so that few sets (one in a thousand, or as few as can be) have more partitions with an empty subset than spare ones.
    """
    need = k // (CELLS - 1) + 1
    best, least = 0, 2.0
    for slack in range(max(2, need // 3) + 1):
        parts = need + slack
        mean = CELLS * parts * exp(-low / parts * (CELLS - 1) / CELLS)
        term, below = exp(-mean), 0.0
        for i in range(slack + 1):  # the Poisson distribution up to slack
            below += term
            term *= mean / (i + 1)
        if 1 - below < least - 1e-12:
            best, least = slack, 1 - below
        if least < 1e-3:
            break
    return best


def signatures(flat: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set it belongs to) of all sets."""
    if not flat.size:
        return flat, np.zeros(0, dtype=np.int64)
    upper = bands(int(sizes.max()), num, den)
    own = np.searchsorted(upper, sizes)
    bound = (den - num) * upper // num
    spare = np.array([slack_of(low, k) for low, k in zip((np.r_[0, upper[:-1]] + 1).tolist(), bound.tolist(), strict=True)], dtype=np.int64)
    sigs, sets = [], []
    for back in (0, 1):  # as the smaller one's band, and as a partner of the band below
        band = own - back
        k, slack = bound[np.maximum(band, 0)], spare[np.maximum(band, 0)]
        live = (sizes > 0) & (band >= 0) & (k > 0)
        n1 = np.where(live, k // (CELLS - 1) + 1 + slack, 0)
        offset = np.cumsum(n1 * CELLS) - n1 * CELLS
        cells = int((n1 * CELLS).sum())
        if not cells:
            continue
        el = np.repeat(live, sizes)
        of = np.repeat(np.arange(sizes.size), sizes)[el]
        h = mix(flat[el], 0xBA4D)
        part = (h >> _U(16)) % n1[of].astype(np.uint64)
        cell = offset[of] + (part * _U(CELLS) + (h & _U(0xFFFF)) % _U(CELLS)).astype(np.int64)
        value = np.zeros(cells, dtype=np.uint64)
        np.add.at(value, cell, mix(h, 0x7A1))
        count = np.bincount(cell, minlength=cells)
        value, count = value.reshape(-1, CELLS), count.reshape(-1, CELLS)
        row_set = np.repeat(np.arange(sizes.size), n1)
        part_no = np.arange(value.shape[0]) - np.repeat(offset // CELLS, n1)
        rest, left = value.sum(axis=1, dtype=np.uint64)[:, None] - value, count.sum(axis=1)[:, None] - count
        empty = left == 0
        voids = np.bincount(row_set, weights=empty.any(axis=1), minlength=sizes.size)
        use = ~empty | (voids > slack)[row_set][:, None]
        tag = (band[row_set].astype(np.uint64) << _U(40)) + (part_no.astype(np.uint64) << _U(2))
        sig = mix(rest + mix(tag[:, None] + np.arange(CELLS, dtype=np.uint64)[None, :], 0x519))
        sigs.append(sig[use])
        sets.append(np.broadcast_to(row_set[:, None], use.shape)[use])
    if not sigs:
        return flat[:0], np.zeros(0, dtype=np.int64)
    return np.concatenate(sigs), np.concatenate(sets)


def name_of(starts: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A 64-bit name of each group of nodes."""
    sizes = np.diff(np.r_[starts, node.size])
    return mix(np.add.reduceat(mix(node.view(np.uint64), 0xFA), starts) + sizes.astype(np.uint64), 0xF0).view(np.int64)


def grouped(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, node) in order, as (signature, node, start of each signature)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    if sig.size:
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[new], node[new]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if sig.size else np.zeros(0, dtype=np.int64)
    return sig, node, starts


#: Kinds of rows on their way to a bucket: entries, entries that stand for a group of their batch, such a group.
ENTRY, HUB, GROUP = 0, 1, 2


def _packed(sig: np.ndarray, node: np.ndarray, n_buckets: int, lane: int, local: int) -> list[tuple]:
    """Rows (bucket, lane, kind, nodes, times, sigs) of a batch's signatures.

    Nodes of a batch that share a signature, if they are ``local`` or more, are a group that goes into a lane of its own; the smallest stands
    for them in the bucket.
    """
    sig, node, starts = grouped(sig, node)
    sizes = np.diff(np.r_[starts, sig.size])
    large = sizes >= local
    kind = np.repeat(np.where(large, GROUP, ENTRY), sizes)
    sig, node, kind = np.r_[sig, sig[starts[large]]], np.r_[node, node[starts[large]]], np.r_[kind, np.full(large.sum(), HUB)]
    bucket = (sig % _U(n_buckets)).astype(np.int64)
    order = np.lexsort((node, kind, bucket))
    bucket, kind, node, short = bucket[order], kind[order], node[order], (sig[order] >> _U(32)).astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])]) if bucket.size else np.zeros(0, dtype=np.int64)
    out = []
    for a, e in zip(edges.tolist(), [*edges[1:].tolist(), bucket.size], strict=False):
        who, times = np.unique(node[a:e], return_counts=True)
        out.append((int(bucket[a]), lane if kind[a] == GROUP else 0, int(kind[a]), who.tobytes(), times.astype(np.uint32).tobytes(), short[a:e].tobytes()))
    return out


def _groups_of_bucket(bucket: int, kinds: list[int], nodes: list[bytes], times: list[bytes], sigs: list[bytes]) -> tuple[list[int], list[bool], list[bytes]]:
    """(family, whether other rows may belong to it, nodes) of the groups in one lane of a bucket.

    A signature of which a batch held a group names a family of several rows; other groups are named by their nodes, and equal ones are one.
    """
    ids = np.unique(np.concatenate([np.frombuffer(n, np.int64) for n in nodes]))
    both = np.empty(sum(map(len, sigs)) // 4, dtype=np.uint64)  # signature, place of the node in ids: few arrays as long as the bucket
    marked, at = [], 0
    for kind, n, t, x in zip(kinds, nodes, times, sigs, strict=True):
        sig = np.frombuffer(x, np.uint32)
        both[at : at + sig.size] = np.repeat(np.searchsorted(ids, np.frombuffer(n, np.int64)).astype(np.uint64), np.frombuffer(t, np.uint32))
        both[at : at + sig.size] |= sig.astype(np.uint64) << _U(32)
        at += sig.size
        if kind != ENTRY:
            marked.append(np.unique(sig))
    both.sort()
    # what is alone in its signature goes at once
    sig = (both >> _U(32)).astype(np.uint32)
    beside = sig[1:] == sig[:-1]
    keep = np.r_[False, beside] | np.r_[beside, False] if sig.size else np.zeros(0, dtype=bool)
    both = both[keep]
    both = both[np.r_[True, both[1:] != both[:-1]]] if both.size else both
    sig, who = (both >> _U(32)).astype(np.uint32), ids[(both & _U(0xFFFFFFFF)).astype(np.int64)]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if sig.size else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, sig.size])
    open_ = np.isin(sig[starts], np.concatenate(marked)) if marked else np.zeros(starts.size, dtype=bool)
    name = mix(sig[starts].astype(np.uint64) + (_U(bucket) << _U(32)), 0x516).view(np.int64)
    if starts.size:
        name = np.where(open_, name, name_of(starts, who))
    first = np.zeros(starts.size, dtype=bool)
    first[np.unique(name, return_index=True)[1]] = True
    take = np.flatnonzero((sizes > 1) & (open_ | first))
    return name[take].tolist(), open_[take].tolist(), [who[starts[k] : starts[k] + sizes[k]].tobytes() for k in take.tolist()]


def edge_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64), 3) + mix(b.view(np.uint64), 4))


class Sets:
    """Some nodes' sets, with parity sketches.

    Two sketches differ in at most as many bits as the sets differ in shingles, so a pair whose sketches differ in more
    than its bound cannot be similar; what passes is decided by the real intersection.
    """

    def __init__(self, items: list[np.ndarray], num: int, den: int):
        self.items, self.num, self.den = items, num, den
        self.sizes = np.array([x.size for x in items], dtype=np.int64)

    def bits(self) -> int:
        return int(sketch_bits(self.sizes).min()) if self.sizes.size else SKETCH[1]

    def sketch(self, bits: int) -> np.ndarray:
        flat = np.concatenate(self.items) if self.items else np.zeros(0, dtype=np.uint64)
        return folded(sketches_of(flat, self.sizes), bits)

    def similar(self, i: int, other: Sets, j: int) -> bool:
        both = np.intersect1d(self.items[i], other.items[j], assume_unique=True).size
        return both * self.den >= (self.items[i].size + other.items[j].size - both) * self.num

    def candidates(self, i: int, own: np.ndarray, other: Sets, theirs: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that sizes and sketches allow."""
        differ = np.bitwise_count(theirs[among] ^ own[i]).sum(axis=1, dtype=np.int64)
        return among[allowed(differ, self.sizes[i], other.sizes[among], self.num, self.den)]


class Sketches(Sets):
    """Sketches instead of sets: what they allow counts as similar."""

    def __init__(self, sizes: np.ndarray, rows: list[bytes], num: int, den: int):
        self.sizes, self.rows, self.num, self.den = sizes, rows, num, den

    def sketch(self, bits: int) -> np.ndarray:
        return folded(self.rows, bits)

    def similar(self, i: int, other: Sets, j: int) -> bool:
        return True


def load(group: pa.Table, at: np.ndarray, num: int, den: int, exact: bool) -> Sets:
    items = group.column("items").take(pa.array(at)).to_pylist()
    if exact:
        return Sets([np.frombuffer(x, np.uint64) for x in items], num, den)
    return Sketches(group.column("n_shingles").to_numpy()[at], items, num, den)


def links_of(sets: Sets, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all there are, beyond what equal ``label`` connects already."""
    n = sets.sizes.size
    root, found = np.unique(label, return_inverse=True)[1], []
    if n < 2 or not root.any():
        return found
    sketch = sets.sketch(sets.bits())
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1  # what is connected already need not be compared
        for j in sets.candidates(i, sketch, sets, sketch, rest).tolist():
            if root[j] != root[i] and sets.similar(i, sets, j):
                root[root == root[j]] = root[i]
                found.append((i, j))
    return found


def filter_bits(count: int) -> int:
    return min(FILTER_BITS, max(1 << 15, 1 << (16 * count - 1).bit_length())) if count else 1 << 15


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each of ``keys`` (column key) in a filter that the driver gets as 4 KB rows, 32 MB at most."""
    bits = filter_bits(keys.count())
    at = F.pmod(F.col("key"), F.lit(bits)) + 1
    got = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in got.toLocalIterator():
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def in_filter(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, table.size * 8)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sets_of(nodes: DataFrame, docs: DataFrame, width: int, name: Callable) -> DataFrame:
    """(node, ...) -> the same and items: the sets of ``nodes``, from one more pass over the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(nodes.select(F.col("node").alias("key"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for _, texts in chunks(batches):
            flat, sizes = shingle_sets(texts, width)
            ids = name(flat, sizes)
            ends = np.cumsum(sizes)
            first = np.zeros(ids.size, dtype=bool)
            first[np.unique(ids, return_index=True)[1]] = True
            take = np.flatnonzero(in_filter(table, ids) & (sizes > 0) & first)
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array([flat[ends[k] - sizes[k] : ends[k]].tobytes() for k in take.tolist()], pa.binary())], names=["node", "items"])

    # copies go before the join: a set that very many rows share is one row of it
    found = docs.mapInArrow(sets, "node bigint, items binary").dropDuplicates(["node"])
    return found.join(nodes, "node")


def _linked(sets: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """(key, family, node, label, n_shingles, items) -> links (a, b) that connect each family's components within each key."""

    def link(group: pa.Table) -> pa.Table:
        family, node, label = (group.column(c).to_numpy() for c in ("family", "node", "label"))
        order = np.lexsort((node, family))
        edges = np.flatnonzero(np.r_[True, np.diff(family[order]) != 0, True])
        a, b = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = order[lo:hi]
            for i, j in links_of(load(group, mine, num, den, exact), label[mine]):
                a.append(node[mine[i]])
                b.append(node[mine[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.select("key", "family", "node", "label", "n_shingles", "items").groupBy("key").applyInArrow(link, "a bigint, b bigint")


def _across(sets: DataFrame, labels: DataFrame, num: int, den: int, exact: bool) -> DataFrame | None:
    """Links between the blocks of families that fill several: None if none can be missing.

    Two nodes in different components are not both in their family's largest one, so the nodes outside of it (few, in a group
    of near copies) meet all blocks of their family.
    """
    wide = sets.where("blocks > 1").select("family", "node", "block", "blocks").join(labels.select(F.col("id").alias("node"), F.col("label").alias("found")), "node", "left")
    wide = written(wide.select("family", "node", "block", "blocks", F.coalesce("found", "node").alias("label")), "join-named", narrow=True)
    parts = wide.groupBy("family", "label").agg(F.count("*").alias("n"), F.first("blocks").alias("blocks"))
    largest = parts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.first("blocks").alias("blocks"))
    mixed = written(largest.where("top.n < all").select("family", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.n")) * F.col("blocks") / F.col("all")).cast("int").alias("lots"), F.col("blocks").alias("n_blocks")), "join-mixed", narrow=True)
    if mixed.isEmpty():
        return None
    members = wide.join(mixed, "family")
    rows = written(sets.where("blocks > 1").select("family", "node", "n_shingles", "items").join(members, ["family", "node"]), "join-members")
    lot = F.pmod(F.xxhash64("node"), F.col("lots")).cast("int")
    outside = rows.where("label <> top").select("family", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), lot.alias("lot"), "node", "label", "n_shingles", "items")
    inside = rows.select("family", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "node", "label", "n_shingles", "items")

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            x, y = (load(t, np.arange(t.num_rows), num, den, exact) for t in (left, right))
            bits = min(x.bits(), y.bits())
            own, theirs = x.sketch(bits), y.sketch(bits)
            label, node = right.column("label").to_numpy(), right.column("node").to_numpy()
            for i, (name, mine) in enumerate(zip(left.column("node").to_pylist(), left.column("label").to_pylist(), strict=True)):
                done = {mine}
                for j in x.candidates(i, own, y, theirs, np.flatnonzero(label != mine)).tolist():
                    if label[j] not in done and x.similar(i, y, j):
                        done.add(label[j])
                        a.append(name)
                        b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ("family", "block", "lot")
    return outside.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(cross, "a bigint, b bigint")


def _placed(members: DataFrame, n_keys: int) -> DataFrame:
    """(family, node, label, n_shingles) -> the same, blocks, block and key: small families share keys, large ones have a key per block."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = written(members.groupBy("family").agg(blocks.alias("blocks")), "join-sizes", narrow=True)
    placed = members.join(sizes, "family")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    key = F.when(F.col("blocks") > 1, F.xxhash64("family", block)).otherwise(F.pmod(F.xxhash64("family"), F.lit(n_keys)))
    return written(placed.select("family", "node", "label", "n_shingles", "blocks", block.alias("block"), key.alias("key")), "join-placed", narrow=True)


def _connected(sets: DataFrame, known: DataFrame | None, num: int, den: int, exact: bool) -> tuple[DataFrame, DataFrame | None]:
    """(links, labels): ``known`` links, those within blocks and those between them; the components of all of these where they are known, too."""
    links = written(_linked(sets, num, den, exact), "join-links")
    links = links if known is None else links.union(known)
    if sets.where("blocks > 1").isEmpty():
        return links, None
    labels = components(links)
    more = _across(sets, labels, num, den, exact)
    return (links, labels) if more is None else (links.union(written(more, "join-across")), None)


def _candidates(groups: DataFrame, nodes: DataFrame, n_keys: int, num: int, den: int) -> DataFrame:
    """Components (id, label) in which all nodes of each group are together that their sketches allow to be similar.

    groups: (family, open, members), nodes: (node, n_shingles, sketch), both written.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.frombuffer(m, np.int64) for m in batch.column(0).to_pylist()]
            if pairs:
                a = np.concatenate([p[1:] for p in pairs])
                b = np.repeat([p[0] for p in pairs], [p.size - 1 for p in pairs])
                one = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1])], names=["a", "b"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            least = np.minimum(*([len(x) for x in side] for side in (left, right))) if left else np.zeros(0, dtype=np.int64)
            differ = np.zeros(a.size, dtype=np.int64)
            for n in np.unique(least).tolist():
                at = np.flatnonzero(least == n)
                x, y = (folded([side[k] for k in at.tolist()], 8 * n) for side in (left, right))
                differ[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed(differ, na, nb, num, den)), pa.array(edge_names(a, b).view(np.int64))], names=["a", "b", "close", "key"])

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    edges = groups.select("members").mapInArrow(stars, "a bigint, b bigint").distinct()
    judged = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(judge, "a bigint, b bigint, close boolean, key bigint")
    judged = written(judged, "join-judged")
    close = judged.where("close").select("a", "b")
    labels = components(close)
    failed = groups.sparkSession.sparkContext.broadcast(_filter(judged.where("not close").select("key")))

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Families in which a node and the smallest one are not close; two nodes that are not are done with."""
        for batch in batches:
            found = []
            for family, open_, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                m = np.frombuffer(m, np.int64)
                if (open_ or m.size > 2) and in_filter(failed.value, edge_names(m[1:], np.repeat(m[:1], m.size - 1)).view(np.int64)).any():
                    found.append(family)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["family"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                members = [np.frombuffer(m, np.int64) for m in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(members)), [m.size for m in members]))), pa.array(np.concatenate(members))], names=["family", "node"])

    families = written(groups.select("family", "open", "members").mapInArrow(doubtful, "family bigint").distinct(), "join-doubtful", narrow=True)
    if families.isEmpty():
        return labels
    members = groups.select("family", "members").join(families, "family").mapInArrow(each, "family bigint, node bigint").distinct()
    members = members.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("family", "node", F.coalesce("label", "node").alias("label"))
    members = written(members, "join-doubts", narrow=True)
    split = members.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("family")
    members = members.join(written(split, "join-split", narrow=True), "family").join(nodes.select("node", "n_shingles"), "node")
    sets = _placed(written(members, "join-doubts", narrow=True), n_keys).join(nodes.select("node", F.col("sketch").alias("items")), "node")
    links, known = _connected(written(sets, "join-sketches"), close, num, den, exact=False)
    return components(links) if known is None else known


def similar_components(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    Documents link when intersection / union of their shingle sets is at least the threshold (numerator, denominator).  A
    text with fewer words than ``width`` has its whole sequence as one shingle; null and blank texts have no shingle
    and are a component of their own.  component_id is the smallest doc_id that links reach; null ids are never smallest,
    but get their component's id.  Repeated rows are equal sets.  An empty table gives an empty result.
    """
    num, den = threshold
    local, ids_of = LOCAL, set_ids
    rows = columns(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            flat, sizes = shingle_sets(texts, width)
            two = [pa.array(ids_of(flat, sizes, salt).view(np.int64)) for salt in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *two, pa.array(sketches_of(flat, sizes), pa.binary())], names=["doc_id", "n_shingles", "node", "second", "sketch"])

    with Scratch(docs.sparkSession) as scratch:
        table = written(rows.mapInArrow(narrow, f"doc_id {kind}, n_shingles bigint, node bigint, second bigint, sketch binary"), "join-rows")
        n_buckets = buckets or max(64, table.count() // BUCKET_DOCS)
        # different sets with one 64-bit digest: of 10**10 sets a few
        twice = table.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high")
        clashes = np.array([r["node"] for r in twice.select("node").toLocalIterator()], dtype=np.int64)
        if clashes.size:
            table = table.withColumn("node", F.when(F.col("node").isin(clashes.tolist()), F.col("second")).otherwise(F.col("node")))

        def name(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return named(flat, sizes, clashes, ids_of)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in chunks(batches):
                flat, sizes = shingle_sets(texts, width)
                ids = name(flat, sizes)
                # copies in the batch travel once
                once = np.zeros(ids.size, dtype=bool)
                once[np.unique(ids, return_index=True)[1]] = True
                sig, of = signatures(flat[np.repeat(once, sizes)], sizes[once], num, den)
                ids = ids[once]
                lane = 1 + int(mix(ids[:1].view(np.uint64))[0] % _U(LANES)) if ids.size else 1
                if out := _packed(sig, ids[of], n_buckets, lane, local):
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), *(pa.array([r[k] for r in out], pa.binary()) for k in (3, 4, 5))], names=["bucket", "lane", "kind", "nodes", "times", "sigs"])

        def meet(group: pa.Table) -> pa.Table:
            family, open_, members = _groups_of_bucket(group.column("bucket")[0].as_py(), *(group.column(c).to_pylist() for c in ("kind", "nodes", "times", "sigs")))
            release()
            return pa.table({"family": pa.array(family, pa.int64()), "open": pa.array(open_, pa.bool_()), "members": pa.array(members, pa.binary())})

        met = rows.mapInArrow(emit, "bucket bigint, lane bigint, kind bigint, nodes binary, times binary, sigs binary").groupBy("bucket", "lane").applyInArrow(meet, "family bigint, open boolean, members binary")
        # equal groups are one; the rows of a family that has several stay apart by their nodes
        tie = F.when(F.col("open"), F.xxhash64("members")).otherwise(F.lit(0))
        groups = written(met.withColumn("tie", tie).dropDuplicates(["family", "tie"]).drop("tie"), "join-groups")
        # without copies: all columns depend on the node
        nodes = written(table.select("node", "n_shingles", "sketch").where("n_shingles > 0").distinct(), "join-nodes")
        close = _candidates(groups, nodes, n_buckets, num, den)
        members = close.select(F.col("label").alias("family"), F.col("id").alias("node"), F.col("id").alias("label")).join(nodes.select("node", "n_shingles"), "node")
        sets = _sets_of(_placed(members, n_buckets), rows, width, name)
        links, labels = _connected(written(sets, "join-sets"), None, num, den, exact=True)
        labels = components(links) if labels is None else labels

        found = written(table.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label")), "join-labels")
        first = written(found.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("first")), "join-first")
        result = found.join(first, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))
        return scratch.keep(result, found, first)
