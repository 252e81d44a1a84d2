"""Exact Jaccard join of word n-gram sets with prefix trees.

A document's set is its distinct word n-grams, hashed. All sets are in one global order: n-grams that are frequent in the
corpus come last (frequency by a counting sketch over all documents, of fixed size), ties by hash. Two sets that link
must share an n-gram within the first n - ceil(s * n) + 1 of each.

1. Equal sets become one class at once (a grouped minimum), so copies cost nothing further.
2. Prefix n-grams met by two classes or more propose links. N-grams with the same members propose once. Pairs are held
   against each other by length and by parity bitmaps (the number of differing bits is at most the size of the symmetric
   difference, so no link is lost), and only a spanning forest of what passes goes on. Beyond `GROUP` members a task holds
   two blocks of at most about that size, dealt as in 3; unlike texts that share a line are not proposed, however many they are.
3. Proposals' components are where links can be. Each is a group of sets for the prefix trees. Small groups share tasks; a
   large one is cut into bands of lengths, so that only sets of the same or neighbouring bands can link, and a band into
   blocks, so that a task holds two blocks whatever the group's size. Every two blocks that can hold a link meet once.
4. A task's tree is a radix tree of one block's sets, frequent n-grams first, so that near copies share long paths. The
   other block's sets are carried down it together, each with its overlap of the path so far, which all sets below share;
   a set is left out of a subtree when the overlap and what can still come, by the lengths remaining on both sides, fall
   short. At a set's end the overlap is exact: those that link are counted, with their copies, and a spanning forest goes on.
5. Components of the links, then the least id of each; the numbers of links of all tasks, added up.

Links within one large group of unlike texts are as many as its pairs; they are counted where they are found and never
put out one by one, but the tasks of a group of B blocks a band are of the order of B * B.

Defined cases: a null or empty text, or one without words, has an empty set, links to nothing and is its own component; a
text with fewer words than n is one n-gram; rows with a null id take part, and their component is the least other id in
it or null; repeated rows are in one component, each returned, and linked with one another; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textbytes import flat, mix, prefix_hashes, runs, slice_hashes
from .workdir import Scratch, Table, freeing_shuffles, prepare

CHUNK = 1 << 18  # bytes hashed at a time, at about 60 bytes of memory each
SKETCH_BITS = 20
PIECE = 1 << 12  # sketch counters a row
HASH_BITS = 50
GROUP = 1000
BLOCK_GRAMS, BLOCK_SETS = 500_000, 8192  # of a task's block at most
SPLIT_GRAMS, SPLIT_SETS = 64_000, 128  # groups beyond either are split into blocks of these sizes
SPLITS = 16  # up to so many, and into more only where the bounds of a block ask for it
WIDE_SPLITS = 8  # the same for n-grams of over GROUP members
CELLS = 4 << 20  # of an incidence matrix

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.uint64((1 << HASH_BITS) - 1)
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def grams(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram, repeats too, and the text it is in."""
    data = _LOWER[data]
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text's start ends the word before it
    edge[bounds[bounds <= len(data)]] = True
    word = ~gap[1:-1]
    starts = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    h = slice_hashes(prefix_hashes(data), starts, ends)
    if not len(h):
        return h, owner
    count = np.bincount(owner, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    size = len(h) - n + 1
    if size > 0:
        acc = h[:size].copy()
        for k in range(1, n):
            acc = mix(acc * _A + h[k : k + size] * _B + np.uint64(k))
        inside = owner[:size] == owner[n - 1 :]
        acc, of = acc[inside], owner[:size][inside]
    else:
        acc, of = h[:0], owner[:0]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for t in short:
            x = h[first[t] : first[t] + 1].copy()
            for k in range(1, count[t]):
                x = mix(x * _A + h[first[t] + k : first[t] + k + 1] * _B + np.uint64(k))
            whole.append(mix(x + count[t : t + 1].astype(np.uint64) * _B))
        acc, of = np.concatenate([acc, *whole]), np.concatenate([of, short])
    return acc & _MASK, of


def ordered_sets(data: np.ndarray, bounds: np.ndarray, n: int, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets in global order, one behind the other, and where each begins (one more than there are texts).
    level: of each sketch counter; an n-gram is level << HASH_BITS | hash."""
    texts = len(bounds) - 1
    h, of = grams(data, bounds, n)
    if level is not None:
        h = level[h & np.uint64((1 << SKETCH_BITS) - 1)] << np.uint64(HASH_BITS) | h
    if texts == 1:
        own = np.unique(h)
        return own, np.array([0, len(own)])
    key = of.astype(np.uint64) << np.uint64(HASH_BITS + 4) | h  # runs() and the caller keep texts below 2**10
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    begin = np.searchsorted(key, np.arange(texts + 1, dtype=np.uint64) << np.uint64(HASH_BITS + 4))
    return key & np.uint64((1 << (HASH_BITS + 4)) - 1), begin


def set_keys(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    length = np.diff(begin)
    total = np.zeros(len(length), dtype=np.uint64)
    some = np.flatnonzero(length)
    if len(some):
        total[some] = np.add.reduceat(mix((sets & _MASK) + _A), begin[some])
    return mix(total + length.astype(np.uint64) * _B).view(np.int64)


def _chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in runs(bounds, CHUNK):
        for a in range(i, j, 1000):
            yield a, min(j, a + 1000)


def sketch_levels(docs: DataFrame, n: int) -> np.ndarray:
    """0 for counters that stand out of what all share by no more than chance, one more for each doubling beyond. What rare
    n-grams leave in every counter is their median; it grows with the table, its scatter only with the root, so an n-gram
    of a small share of the rows is told from rare ones in tables of any size. The table that comes to the driver has a
    fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            data, bounds = flat(batch.column(0))
            for a, b in _chunks(data, bounds):
                sets, _ = ordered_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], n, None)
                at, times = np.unique((sets & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32), return_counts=True)
                total[at] += times.astype(np.uint32)
        if total.any():
            pieces = np.minimum(total, 65535).astype("<u2").reshape(-1, PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, dtype=np.uint64)
        for x in rows["counts"].to_pylist():
            total += np.frombuffer(x, dtype="<u2")
        return pa.table([pa.array([rows["piece"][0].as_py()], pa.int32()), pa.array([total.astype("<u8").tobytes()], pa.binary())], names=["piece", "counts"])

    with freeing_shuffles(docs.sparkSession):
        found = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    total = np.zeros((1 << SKETCH_BITS) // PIECE * PIECE, dtype=np.uint64).reshape(-1, PIECE)
    for row in found:
        total[row["piece"]] = np.frombuffer(row["counts"], dtype="<u8")
    return counter_levels(total.reshape(-1))


def counter_levels(total: np.ndarray) -> np.ndarray:
    above = total.astype(float) - np.median(total)
    step = 8 + 4 * max(1.4826 * float(np.median(np.abs(above))), float(np.sqrt(np.median(total))))
    return np.minimum(np.frexp(np.maximum(above, 0) // step)[1], 15).astype(np.uint8)


def prefix_length(n: np.ndarray | int, num: int, den: int):
    return n - -(-num * n // den) + 1


def parity_bits(n: int, num: int, den: int) -> int:
    """Bits of a set's parity bitmap: enough that unlike sets of its size differ in more of them than linked ones may."""
    return 1 << max(6, int(4 * 2 * n * (den - num) // (den + num)).bit_length())


def parity(grams_of: np.ndarray, num: int, den: int) -> bytes:
    bits = parity_bits(len(grams_of), num, den)
    odd = np.bincount((mix(grams_of & _MASK) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), prefix, parity, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.astype(np.uint64)
        for batch in batches:
            data, bounds = flat(batch.column(1))
            sizes, keys, prefixes, offsets, marks = [], [], [], [0], []
            for a, b in _chunks(data, bounds):
                sets, begin = ordered_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], n, level)
                length = np.diff(begin)
                total = set_keys(sets, begin)
                upto = np.where(length > 0, prefix_length(length, num, den), 0)
                take = np.repeat(begin[:-1], upto) + np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)
                sizes.append(length)
                keys.append(total)
                prefixes.append(sets[take].view(np.int64))
                offsets.extend((offsets[-1] + np.cumsum(upto)).tolist())
                marks += [parity(sets[begin[k] : begin[k + 1]], num, den) if length[k] else None for k in range(len(length))]
            if not sizes:
                continue
            size, key = np.concatenate(sizes), np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.int64(), mask=size == 0), lists, pa.array(marks, pa.binary()), batch.column(2)], ["doc_id", "n_shingles", "key", "prefix", "parity", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, n_shingles long, key long, prefix array<long>, parity binary, text_hash long")


def needed(a, b, num: int, den: int):
    """Least overlap of linked sets of a and b n-grams."""
    return -(-num * (a + b) // (num + den))


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two parity bitmaps, the longer folded to the shorter."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size, least = max(len(x), len(y)) * 8, min(len(x), len(y)) * 8
    while size > least:
        size //= 2
        if len(x) > len(y):
            a = a >> size ^ a & (1 << size) - 1
        else:
            b = b >> size ^ b & (1 << size) - 1
    return (a ^ b).bit_count()


def passing(keys: list[int], sizes: list[int], marks: list[bytes], sides: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that lengths and parity bitmaps don't rule out, as pairs of keys. sides: all 2 for the
    pairs of one block, 0 and 1 for those between two."""
    order = sorted(range(len(keys)), key=lambda i: (sizes[i], keys[i]))
    side = np.array([sides[i] for i in order])
    bits = [np.frombuffer(marks[i], dtype=np.uint8) for i in order]
    size = np.array([sizes[i] for i in order])
    out = []
    folded: dict[int, np.ndarray] = {}  # all bitmaps no shorter than a width, folded to it
    widths = np.array([len(b) for b in bits])
    label = np.arange(len(order))
    for x in range(len(order) - 1):
        stop = int(np.searchsorted(size, size[x] * den // num, side="right"))
        others = np.arange(x + 1, stop)
        others = others[(label[others] != label[x]) & ((side[others] != side[x]) | (side[x] == 2))]
        if not len(others):
            continue
        w = int(widths[x])
        if w not in folded:
            folded[w] = np.stack([np.bitwise_xor.reduce(b.reshape(-1, w), axis=0) if len(b) >= w else np.zeros(w, np.uint8) for b in bits])
        apart = np.bitwise_count(folded[w][others] ^ bits[x]).sum(axis=1)
        both = size[others] + size[x]
        for y in others[apart <= both - 2 * needed(both, 0, num, den)].tolist():
            if label[y] != label[x]:
                out.append((keys[order[x]], keys[order[y]]))
                label[label == label[y]] = label[x]
    return out


class Node:
    """A tree node: the way to it is n-grams start to stop of the set `of`; children by their first n-gram, sets that end
    here, and the least and the most n-grams of the sets at and below it."""

    __slots__ = ("of", "start", "stop", "children", "ends", "least", "most")

    def __init__(self, of: int, start: int, stop: int, least: int, most: int):
        self.of, self.start, self.stop, self.children, self.ends, self.least, self.most = of, start, stop, {}, [], least, most


def prefix_tree(sets: list[np.ndarray], members: list[int]) -> Node:
    """Radix tree of some of the sets, each in the global order."""
    root = Node(-1, 0, 0, 1 << 62, 0)
    for i in members:
        own, node, at = sets[i], root, 0
        while True:
            node.least, node.most = min(node.least, len(own)), max(node.most, len(own))
            if at == len(own):
                node.ends.append(i)
                break
            first = int(own[at])
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = Node(i, at, len(own), len(own), len(own))
                child.ends.append(i)
                break
            path = sets[child.of][child.start : child.stop]
            length = min(len(path), len(own) - at)
            differ = np.flatnonzero(path[:length] != own[at : at + length])
            same = int(differ[0]) if len(differ) else length
            if same < len(path):
                upper = Node(child.of, child.start, child.start + same, child.least, child.most)
                child.start += same
                upper.children[int(path[same])] = child
                node.children[first] = child = upper
            node, at = child, at + same
    return root


def tree_join(sets: list[np.ndarray], copies: np.ndarray, sides: np.ndarray, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links, as pairs of positions, and each set's number of links, counting a linked set's
    copies. sides: 0 for sets of the tree, 1 for those carried down it, 2 for sets that are both; the sets are of sides 0
    and 1, or all of side 2."""
    members, asked = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    links = np.zeros(len(sets), dtype=np.int64)
    forest: list[tuple[int, int]] = []
    if not len(members) or not len(asked) or len(sets) < 2:
        return forest, links
    size = np.array([len(x) for x in sets])
    of_tree, of_asked = np.concatenate([sets[i] for i in members]), np.concatenate([sets[i] for i in asked])
    if sides[0] == 2:
        vocabulary, times = np.unique(of_tree, return_counts=True)
        vocabulary = vocabulary[times > 1]
    else:
        vocabulary = np.intersect1d(of_tree, of_asked)
    if not len(vocabulary):
        return forest, links
    at = np.minimum(np.searchsorted(vocabulary, of_tree), len(vocabulary) - 1)
    shared = vocabulary[at] == of_tree
    ids, before = at[shared], np.concatenate([[0], np.cumsum(shared)])  # shared n-grams, and how many stand before a place
    offset = np.zeros(len(sets), dtype=np.int64)
    offset[members] = np.cumsum(size[members]) - size[members]
    tree = prefix_tree(sets, members.tolist())
    label = np.arange(len(sets))
    step = max(1, CELLS // len(vocabulary))
    for begin in range(0, len(asked), step):
        part = asked[begin : begin + step]
        own = np.concatenate([sets[i] for i in part])
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        shared = vocabulary[at] == own
        holds = np.zeros((len(vocabulary), len(part)), dtype=np.uint8)
        holds[at[shared], np.repeat(np.arange(len(part)), size[part])[shared]] = 1
        upto = np.cumsum(holds, axis=0, dtype=np.int32)
        n = size[part]
        shortest, longest = -(-num * n // den), n * den // num
        stack = [(tree, 0, np.arange(len(part)), np.zeros(len(part), dtype=np.int64), upto[-1].astype(np.int64))]
        while stack:
            node, depth, alive, overlap, left = stack.pop()
            low, high = (before[offset[node.of] + x] for x in (node.start, node.stop)) if node.of >= 0 else (0, 0)
            if high > low:
                way = ids[low:high]
                overlap = overlap + (holds[way] if len(alive) == len(part) else holds[way[:, None], alive]).sum(axis=0, dtype=np.int64)
                left = upto[-1][alive] - upto[way[-1]][alive]
            depth += node.stop - node.start
            can = overlap + np.minimum(np.minimum(node.most, longest[alive]) - depth, left)
            stay = (can >= needed(n[alive], np.maximum(node.least, shortest[alive]), num, den)) & (shortest[alive] <= node.most) & (longest[alive] >= node.least)
            if not stay.all():
                alive, overlap, left = alive[stay], overlap[stay], left[stay]
            if not len(alive):
                continue
            for own_set in node.ends:
                hit = part[alive[(overlap >= needed(n[alive], depth, num, den)) & (shortest[alive] <= depth) & (longest[alive] >= depth)]]
                hit = hit[hit != own_set]
                if len(hit):
                    links[own_set] += copies[hit].sum()
                    if sides[0] != 2:
                        links[hit] += copies[own_set]
                    other, one = np.unique(label[hit], return_index=True)
                    for x, y in zip(other.tolist(), hit[one].tolist()):
                        if x != label[own_set]:
                            forest.append((own_set, y))
                            label[label == x] = label[own_set]
            stack += [(c, depth, alive, overlap, left) for c in node.children.values()]
    return forest, links


def near_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row; sets link when den * overlap >= num * union. n_links is the
    number of other rows that link to the row."""
    rows, named = labelled(docs, n, num, den)
    last = F.lit((1 << 63) - 1)
    least = Table(named.df.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    by_key = Table(named.df.join(least.df, "label").select("key", "component_id", "n_links"), "class-components")
    named.drop()
    least.drop()
    out = rows.df.select("doc_id", "n_shingles", "key").join(by_key.df, "key", "left")
    found = F.when(F.col("key").isNull(), F.col("doc_id")).when(F.col("component_id") < last, F.col("component_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def labelled(docs: DataFrame, n: int, num: int, den: int) -> tuple[Table, Table]:
    """doc_id, n_shingles, key, text_hash of every row; and key, least id, label and n_links of every set, where linked sets
    share a label."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = sketch_levels(own, n)
    signed, scratch = Table(signatures(own, levels, n, num, den), "signatures"), Scratch()
    last = F.lit((1 << 63) - 1)
    rep = F.min(F.struct(F.coalesce("doc_id", last).alias("least"), "text_hash", "n_shingles", "prefix", "parity")).alias("r")
    reps = scratch.table(signed.df.filter("key is not null").groupBy("key").agg(rep, F.count("*").alias("copies")).select("key", "copies", "r.*"), "classes")
    rows = Table(signed.df.select("doc_id", "n_shingles", "key", "text_hash"), "rows")  # the prefixes are in reps
    signed.drop()
    coarse = components(proposals(reps, num, den, scratch))
    found = verified(own, reps, coarse.df, levels, n, num, den)
    labels = components(found.df.filter("b is not null").select("a", "b"))
    counts = found.df.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    named = reps.select("key", "least", "copies").join(labels.df, F.col("key") == F.col("node"), "left").join(counts, "key", "left")
    links = F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1
    out = Table(named.select("key", "least", F.coalesce("label", "key").alias("label"), links.alias("n_links")), "labelled")
    for t in (scratch, coarse, found, labels):
        t.drop()
    return rows, out


def surplus(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_hash, kept: which rows of docs, by id and hash of the text, are not the only one to keep of their class. A
    class keeps one row: that of the least id (null after all others), then of the least text_hash. kept is true where
    that row is repeated, so that one of the repeats stays, and false for rows that all go."""
    rows, named = labelled(docs, n, num, den)
    counted = rows.df.filter("key is not null").groupBy("key", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    own = Table(counted.join(named.df.select("key", "label"), "key").select("label", "doc_id", "text_hash", "copies"), "class-rows")
    rows.drop()
    named.drop()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    first = Table(own.df.groupBy("label").agg(F.min(order).alias("first"), F.sum("copies").alias("size")).filter("size > 1"), "class-firsts")
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    return own.df.join(first.df, "label").withColumn("kept", kept).filter("not kept or copies > 1").select("doc_id", "text_hash", "kept")


def proposals(reps: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between keys, whose components hold all links."""
    tokens = reps.select("key", "n_shingles", F.explode("prefix").alias("token"))
    ends = [f(F.struct("key", "n_shingles")).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    met = tokens.groupBy("token").agg(F.count("*").alias("m"), *ends, F.bit_xor("key").alias("x")).filter("m > 1")
    fits = den * F.least("lo.n_shingles", "hi.n_shingles") >= num * F.greatest("lo.n_shingles", "hi.n_shingles")
    met = met.filter((F.col("m") > 2) | fits).select("token", "m", F.col("lo.key").alias("lo"), F.col("hi.key").alias("hi"), "x")
    groups = scratch.table(met.groupBy("m", "lo", "hi", "x").agg(F.min("token").alias("token")), "token-groups")
    marked = reps.select("key", "n_shingles", "parity")
    pairs = groups.filter("m = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    for end in ("a", "b"):
        pairs = pairs.join(marked.select(F.col("key").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("parity").alias(f"parity_{end}")), end)
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("g2"), F.lit(2).alias("side")))
    small = tokens.join(groups.filter((F.col("m") > 2) & (F.col("m") <= GROUP)).select("token"), "token").withColumn("meets", whole)
    wide = scratch.table(groups.filter(F.col("m") > GROUP).select("token"), "wide-groups")
    large = tokens.join(wide, "token").withColumn("band", band_of(F.col("n_shingles"), num, den))
    sets = F.count("*")
    blocks = F.greatest(F.least(F.ceil(sets / SPLIT_SETS), F.lit(WIDE_SPLITS)), F.ceil(sets / GROUP)).cast("long")
    bands = scratch.table(large.groupBy("token", "band").agg(blocks.alias("own")), "wide-bands")
    large = large.join(near_bands(bands, "token", scratch), ["token", "band"]).withColumn("meets", block_meetings())
    dealt = small.select("token", "key", "meets").unionByName(large.select("token", "key", "meets")).join(marked, "key")
    dealt = dealt.select("token", "key", "n_shingles", "parity", F.explode("meets").alias("m")).select("token", "key", "n_shingles", "parity", "m.g2", "m.side")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = (n - 2 * needed(n, 0, num, den)).tolist()
            stay = [differing(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(stay, pa.bool_()))

    def forest(rows: pa.Table) -> pa.Table:
        out = passing(*(rows[c].to_pylist() for c in ("key", "n_shingles", "parity", "side")), num, den)
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    schema = "a long, b long"
    passed = pairs.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(filtered, schema)
    return passed.unionByName(dealt.groupBy("token", "g2").applyInArrow(forest, schema))


def band_of(size, num: int, den: int):
    """Linked sets are at most one band apart."""
    return F.floor(F.log(size.cast("double")) / float(np.log(den / num * 1.0001))).cast("long")


def near_bands(bands: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """bands (group, band, own: its number of blocks) with the blocks of the band after it and the one ahead, null if none."""
    near = bands.alias("x")
    for name, by in (("after", 1), ("ahead", -1)):
        near = near.join(bands.select(F.col(group).alias("c"), (F.col("band") - by).alias("b"), F.col("own").alias(name)), (F.col(group) == F.col("c")) & (F.col("band") == F.col("b")), "left").drop("c", "b")
    return scratch.table(near, "near-bands")


def block_meetings():
    """Of a set, by its columns key, band, own, after and ahead: the tasks (g2) of two blocks where it is asked for, and on
    which side. Every two blocks of a band, and of a band and the next, meet once."""
    task = lambda band, kind, i, j: (((band * 2 + kind) * (1 << 20) + i) * (1 << 20) + j).cast("long")
    meet = lambda g2, side: F.struct(g2.alias("g2"), side.cast("int").alias("side"))
    i, band = F.pmod(F.xxhash64("key"), "own"), F.col("band")
    each = lambda count, body: F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), body)).otherwise(F.array().cast("array<struct<g2:long,side:int>>"))
    inner = each(F.col("own"), lambda j: meet(task(band, F.lit(0), F.least(i, j), F.greatest(i, j)), F.when(i == j, 2).when(i < j, 0).otherwise(1)))
    outer = each(F.coalesce("after", F.lit(0)), lambda j: meet(task(band, F.lit(1), i, j), F.lit(0)))
    inward = each(F.coalesce("ahead", F.lit(0)), lambda j: meet(task(band - 1, F.lit(1), j, i), F.lit(1)))
    return F.concat(inner, outer, inward)


def meetings(wanted: DataFrame, num: int, den: int, tasks: int, scratch: Scratch) -> DataFrame:
    """wanted (key, least, text_hash, copies, n_shingles, comp) with `meets`: the tasks (g1, g2) where the set is asked for,
    and on which side of the tree."""
    grams, sets = F.sum("n_shingles"), F.count("*")
    sized = wanted.groupBy("comp").agg(((grams > SPLIT_GRAMS) | (sets > SPLIT_SETS)).alias("large"), grams.alias("grams"))
    sized = scratch.table(sized, "coarse-sizes")
    total = sized.filter("not large").agg(F.sum("grams")).first()[0] or 0
    bundles = max(tasks, -(-int(total) // BLOCK_GRAMS))
    wanted = scratch.table(wanted.join(sized.select("comp", "large"), "comp").withColumn("band", F.when(F.col("large"), band_of(F.col("n_shingles"), num, den)).otherwise(0).cast("long")), "banded")
    fine = F.greatest(F.ceil(grams / SPLIT_GRAMS), F.ceil(sets / SPLIT_SETS))
    blocks = F.greatest(F.least(fine, F.lit(SPLITS)), F.ceil(grams / BLOCK_GRAMS), F.ceil(sets / BLOCK_SETS)).cast("long")
    bands = scratch.table(wanted.filter("large").groupBy("comp", "band").agg(blocks.alias("own")), "bands")
    split = wanted.filter("large").join(near_bands(bands, "comp", scratch), ["comp", "band"])
    columns = ["key", "least", "text_hash", "copies", "comp"]
    split = split.select(*columns, F.col("comp").alias("g1"), block_meetings().alias("meets"))
    whole = wanted.filter("not large").select(*columns, F.pmod(F.xxhash64("comp"), F.lit(bundles)).cast("long").alias("g1"), F.array(F.struct(F.lit(-1).cast("long").alias("g2"), F.lit(2).alias("side"))).alias("meets"))
    return whole.unionByName(split)


def verified(docs: DataFrame, reps: DataFrame, coarse: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> Table:
    """Rows a, b: links between keys, enough of them for the components of all links; and rows a, links with no b: parts of
    the number of links of a."""
    spark = docs.sparkSession
    wanted = coarse.join(reps.select("key", "least", "text_hash", "copies", "n_shingles"), F.col("node") == F.col("key")).select("key", "least", "text_hash", "copies", "n_shingles", F.col("label").alias("comp"))
    scratch = Scratch()
    dealt = Table(meetings(wanted, num, den, int(spark.conf.get("spark.sql.shuffle.partitions")), scratch), "meetings")
    scratch.drop()
    texts = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("least"), F.xxhash64("text").alias("text_hash"), "text").join(dealt.df.filter("size(meets) > 0"), ["least", "text_hash"])
    meets = "array<struct<g2:long,side:int>>"

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A set is put out once a task, however often its row is repeated; n-grams from the most frequent to the rarest."""
        level, top, seen = levels.astype(np.uint64), np.uint64((1 << (HASH_BITS + 4)) - 1), set()
        for batch in batches:
            data, bounds = flat(batch.column(1))
            got, keys = [], []
            for a, b in _chunks(data, bounds):
                sets, begin = ordered_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], n, level)
                got += [(top - sets[begin[k] : begin[k + 1]][::-1]).astype("<u8").tobytes() for k in range(len(begin) - 1)]
                keys.append(set_keys(sets, begin))
            if not keys:
                continue
            mine = []  # texts whose hash is another's too are told apart by their sets
            for own, key in zip(np.concatenate(keys).tolist(), batch.column(0).to_pylist()):
                mine.append(own == key and key not in seen)
                if mine[-1]:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(got, pa.binary())], ["key", "copies", "comp", "g1", "meets", "grams"]).filter(pa.array(mine, pa.bool_()))

    found = texts.select("key", "text", "copies", "comp", "g1", "meets").mapInArrow(as_sets, f"key long, copies long, comp long, g1 long, meets {meets}, grams binary")
    sets = Table(found, "sets")
    dealt.drop()
    spread = sets.df.select("key", "copies", "comp", "g1", F.explode("meets").alias("m"), "grams").select("key", "copies", "comp", "g1", "m.g2", "m.side", "grams")

    def linked(rows: pa.Table) -> pa.Table:
        """The groups of a task, one after the other."""
        key, comp, copies, side = (rows[c].to_numpy() for c in ("key", "comp", "copies", "side"))
        grams_of = rows["grams"].combine_chunks()
        order = np.lexsort((key, comp))
        order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order  # texts of one set
        cut = np.flatnonzero(np.concatenate([[True], comp[order][1:] != comp[order][:-1], [True]])) if len(order) else [0]
        out: list[list] = [[], [], []]
        for i, j in zip(cut[:-1], cut[1:]):
            own = order[i:j]
            forest, links = tree_join([np.frombuffer(grams_of[int(k)].as_py(), dtype="<u8") for k in own], copies[own], side[own], num, den)
            some = np.flatnonzero(links)
            out[0] += [key[own[a]] for a, _ in forest] + key[own[some]].tolist()
            out[1] += [key[own[b]] for _, b in forest] + [None] * len(some)
            out[2] += [None] * len(forest) + links[some].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])

    # ranges are even in rows, whatever the groups' sizes
    out = Table(spread.repartitionByRange("g1", "g2").groupBy("g1", "g2").applyInArrow(linked, "a long, b long, links long"), "links")
    sets.drop()
    return out


ORACLE_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d
),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE 100 * i >= 90 * (x.n + y.n - i)
),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(k, r) AS (SELECT k, k FROM d UNION SELECT reach.k, b FROM reach JOIN both_ways ON a = r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id,
  CAST(coalesce(any_value(l.n_links), 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (k) LEFT JOIN (SELECT a AS k, count(*) AS n_links FROM both_ways GROUP BY a) l USING (k)
JOIN reach USING (k) JOIN d o ON o.k = reach.r GROUP BY d.k, d.doc_id
"""
