"""Removal of byte strings of a fixed length that occur more than once, by a sorted array of suffixes.

A byte goes if some string of `length` bytes that covers it also starts anywhere else in the corpus, the same text
included; strings are judged on the input and never reach over a text's end.

Sorting every suffix of a corpus would move it many times over, so first the suffixes that can't matter leave:

1. Each string of `length` bytes has an anchor, its least-hashed `GRAM`-byte part (the leftmost, if several). Equal
   strings have equal anchors at equal places, so a string whose anchor occurs once in the corpus is unique. An anchor
   is written once for the run of strings that share it, about one for every 75 bytes, with a hash of the bytes that the
   run covers.
2. Anchors that occur once leave. Where all occurrences of an anchor have equal surroundings, all their strings repeat:
   these are settled before the sort, by a 64-bit hash of the surroundings (29 % of the occurrences of repeated anchors in
   the 0.1 tables), and so are surroundings met twice of the other anchors. What is left are anchors with unlike surroundings, around the ends of repeats; of equal surroundings one stands for all.
3. Sampled splitters over the leading tokens of the anchors' suffixes deal those surroundings into buckets, so that all
   of an anchor's stand together. In a bucket the suffixes that start in them are sorted by three-way multikey quicksort
   on their tokens (the first eight bytes, then a hash of the whole string), and neighbours are compared. Anchors at the
   ends of buckets, and with them any so frequent that it fills some, are compared across the bounds: their suffixes,
   equal ones of a bucket as one, are ranged once more, by sampled splitters over the suffixes' own tokens.
4. Repeats go back to all places with those surroundings, and from there to their texts.

Rows are known by a 64-bit hash of id and text, so a null id or a repeated row is nothing special: of equal rows one span
goes on. Of 10^9 different rows two share a hash with a chance of 3 %; such rows would take each other's spans.

Defined cases: a null text is empty and stays null in deduplicated(); texts shorter than `length` keep all bytes; two
equal rows are two places; an empty table gives no rows; other columns are kept by deduplicated() and not read by
digests().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import flat, mix, prefix_hashes, runs, slice_hashes
from .workdir import Table, prepare

LENGTH = 200
GRAM = 48
CHUNK = 1 << 19
PLACE_BITS = 20
BUCKET_ROWS = 2_000_000
HELD_ROWS = 3000

_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)

#: Every string of 200 bytes of every text by its MD5, runs of those met twice, and what is left around them.
ORACLE_SQL = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, p, md5(array_slice(b, p + 1, p + 200)) AS s FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS p FROM d)),
t AS MATERIALIZED (SELECT r, p FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
o AS (SELECT r, p, CAST(coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true) AS INT) AS opens FROM t),
g AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS g FROM o),
gone AS (SELECT r, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY r, g),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS k FROM gone),
cut AS (SELECT r, count(*) AS n, sum(z - a) AS removed, max(z) AS last, string_agg(hex(array_slice(b, k + 1, a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(h || hex(array_slice(b, last + 1, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width neighbours."""
    n = len(x)
    if n < width:
        return x[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, place in it, strings before and after (the first and last string with this anchor start so far before it),
    hash of the anchor and of what its strings cover."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    hashes = slice_hashes(prefix, at, at + gram)
    low = np.uint64(PLACE_BITS)
    least = sliding_least(hashes >> low << low | at.astype(np.uint64), length - gram + 1)
    size = np.diff(bounds)
    fit = size >= length
    step = np.zeros(n + 1, dtype=np.int8)
    np.add.at(step, bounds[:-1][fit], 1)
    np.add.at(step, bounds[1:][fit] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(step[: n - length + 1]))
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (least[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    anchor = anchor[new]
    text = np.searchsorted(bounds, anchor, side="right") - 1
    before, after = anchor - first, anchor - last
    around = mix(slice_hashes(prefix, first, last + length) + before.astype(np.uint64) * _A + after.astype(np.uint64) * _B)
    return text, anchor - bounds[text], before, after, hashes[anchor], around


def pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, text of each and where it begins there; long texts come in parts that share length - 1 bytes."""
    for i, j in runs(bounds, CHUNK):
        own = data[bounds[i] : bounds[j]]
        if j - i > 1 or len(own) <= CHUNK:
            yield own, bounds[i : j + 1] - bounds[i], np.arange(i, j), np.zeros(j - i, dtype=np.int64)
            continue
        for s in range(0, len(own) - length + 1, CHUNK):
            part = own[s : s + CHUNK + length - 1]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([s])


ANCHORS = "gram long, around long, row_key long, place long"


def packed(place: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return place << 16 | before << 8 | after


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: row_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(1))
            keys = batch.column(0).to_numpy()
            for part, own, texts, base in pieces(data, bounds, length):
                text, place, before, after, hashed, around = anchors(part, own, length, gram)
                if len(text):
                    columns = (hashed.view(np.int64), around.view(np.int64), keys[texts[text]], packed(place + base[text], before, after))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in ANCHORS.split(", ")])

    return docs.filter(F.octet_length("text") >= length).mapInArrow(run, ANCHORS)


SURROUNDINGS = "lead long, gram long, around long, before int, after int, again boolean, bytes binary"


def leading(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each start, as numbers of the same order."""
    out = np.zeros(len(start), dtype=np.uint64)
    for b in range(8):
        out = out << np.uint64(8) | data[start + b].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def surroundings(reps: DataFrame, length: int) -> DataFrame:
    """A row for each marked anchor: the bytes that its strings cover. reps: text, marks (array of gram, around, place,
    again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(0))
            marks = batch.column(1)
            owner = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
            fields = marks.flatten()
            at, before, after = unpacked(fields.field(2).to_numpy(zero_copy_only=False))
            at = at + bounds[owner]
            first, size = at - before, before - after + length
            lead = leading(data, at)
            for i, j in runs(np.concatenate([[0], np.cumsum(size)]), CHUNK):
                part = slice(i, j)
                begin = np.cumsum(size[part]) - size[part]
                own = data[np.repeat(first[part] - begin, size[part]) + np.arange(size[part].sum())]
                held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([begin, [len(own)]]).astype(np.int32)), pa.py_buffer(own)])
                columns = [pa.array(lead[part]), fields.field(0).slice(i, j - i), fields.field(1).slice(i, j - i), pa.array(before[part].astype(np.int32)), pa.array(after[part].astype(np.int32)), fields.field(3).slice(i, j - i), held]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SURROUNDINGS.split(", ")])

    return reps.mapInArrow(run, SURROUNDINGS)


def suffixes_in(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leading tokens of every string of `length` bytes in surroundings: its first eight bytes and the hash of it all; the
    row it is in and its place there."""
    data, bounds = flat(column)
    count = np.diff(bounds) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[row] + k
    return leading(data, start), slice_hashes(prefix_hashes(data), start, start + length).view(np.int64), row, k


def multikey_order(tokens: list[np.ndarray], least: int = 4096) -> np.ndarray:
    """Order of rows by their tokens, by three-way multikey quicksort: a part is split by a pivot of the token at its
    depth, and only the rows equal to the pivot go on to the next token. Parts of at most `least` rows are sorted at once."""
    out = np.arange(len(tokens[0]))
    todo = [(0, len(out), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(tokens):
            continue
        rows = out[a:b]
        if b - a <= least:
            out[a:b] = rows[np.lexsort([t[rows] for t in tokens[:depth - 1 if depth else None:-1]])]
            continue
        x = tokens[depth][rows]
        pivot = np.partition(x[:: max(1, len(x) // 63)], 31)[31] if len(x) >= 63 else x[0]
        less, same = x < pivot, x == pivot
        parts = [rows[less], rows[same], rows[~(less | same)]]
        out[a:b] = np.concatenate(parts)
        i, j = a + len(parts[0]), a + len(parts[0]) + len(parts[1])
        todo += [(a, i, depth), (i, j, depth + 1), (j, b, depth)]
    return out


WORD = 63  # strings of an anchor that one long says yes or no to


def runs_of_equals(lead: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of suffixes, where each run of equal ones begins in it, and the run of each place of it."""
    order = multikey_order([lead, whole])
    x, y = lead[order], whole[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(order)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def splitters(around_of: DataFrame, ranges: int, length: int, most: int = 2000) -> np.ndarray:
    """(lead, whole) of the suffixes that open the second and later ranges: even steps in a sample of at most 16 * most
    suffixes, from the first rows by a hash."""
    rows = around_of.orderBy(F.xxhash64("gram", "around")).limit(most).select("bytes").toArrow()
    if not len(rows) or ranges < 2:
        return np.zeros((0, 2), dtype=np.int64)
    lead, whole, _, _ = suffixes_in(rows["bytes"].combine_chunks(), length)
    step = max(1, len(lead) // (16 * most))
    order = multikey_order([lead[::step], whole[::step]])
    at = order[np.linspace(0, len(order), ranges + 1).astype(int)[1:-1]]
    return np.stack([lead[::step][at], whole[::step][at]], axis=1)


def ranges_of(lead: np.ndarray, whole: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Where sorted suffixes are cut by the splitters; equal suffixes are never parted."""
    out = []
    for x, y in split.tolist():
        i, j = np.searchsorted(lead, x, "left"), np.searchsorted(lead, x, "right")
        out.append(i + np.searchsorted(whole[i:j], y, "left"))
    return np.array([0, *out, len(lead)], dtype=np.int64)


def bits_of(row: np.ndarray, back: np.ndarray, rows: int, words: int) -> np.ndarray:
    """For each of rows surroundings, a bit for each of its strings that repeats."""
    out = np.zeros((words, rows), dtype=np.int64)
    for w in range(words):
        mine = back // WORD == w
        np.bitwise_or.at(out[w], row[mine], np.int64(1) << (back[mine] % WORD).astype(np.int64))
    return out


#: A suffix on its way to its range.
SUFFIX = np.dtype([("lead", "<i8"), ("whole", "<i8"), ("gram", "<i8"), ("around", "<i8"), ("back", "<i2"), ("again", "?")])


def near_anchor(around_of: DataFrame, buckets: int, length: int, words: int, split: np.ndarray) -> DataFrame:
    """Sampled splitters over the leading tokens of the anchors' own suffixes deal surroundings into buckets. In a bucket
    the suffixes of all surroundings are sorted and neighbours compared, some anchors at a time. The first and the last
    anchor of a bucket can go on in the next one: one of each run of their equal suffixes goes on to the range where it
    belongs among all suffixes, those of a range in one piece. Rows: gram, around and either the bits of its repeats or a
    range's suffixes."""
    ranged = around_of.repartitionByRange(buckets, "lead", "gram", "around")
    bits = [f"bits{k}" for k in range(words)]
    schema = ", ".join(["gram long, around long", *(f"{b} long" for b in bits), "range int, suffixes binary"])
    names = [c.split()[0] for c in schema.split(", ")]

    def judged(part: pa.Table, onward: bool) -> Iterator[pa.RecordBatch]:
        """Bits of the strings met again in these rows; and if the comparison goes on elsewhere, one suffix of each run of
        equals: marked as met again, or still open."""
        gram, around, before, again = (part[c].to_numpy() for c in ("gram", "around", "before", "again"))
        again = again.astype(bool)
        lead, whole, row, k = suffixes_in(part["bytes"].combine_chunks(), length)
        order, begin, run_of = runs_of_equals(lead, whole)
        size = np.diff(np.concatenate([begin, [len(order)]]))
        met = (size > 1) | np.maximum.reduceat(again[row[order]], begin)
        hit = order[met[run_of]]
        hit = hit[~again[row[hit]]]
        back = before[row] - k
        out = bits_of(row[hit], back[hit], len(gram), words)
        some = np.flatnonzero(out.any(axis=0))
        nothing = [pa.nulls(len(some), t) for t in (pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(around[some]), *(pa.array(o[some]) for o in out), *nothing], names)
        if onward:
            one = order[begin]
            held = np.empty(len(one), dtype=SUFFIX)
            for name, values in (("lead", lead[one]), ("whole", whole[one]), ("gram", gram[row[one]]), ("around", around[row[one]]), ("back", back[one]), ("again", met)):
                held[name] = values
            cut = ranges_of(held["lead"], held["whole"], split)
            full = np.flatnonzero(np.diff(cut))
            packs = pa.array([held[cut[r] : cut[r + 1]].tobytes() for r in full], pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(full), pa.int64())] * (2 + words), pa.array(full.astype(np.int32)), packs], names)

    def spread(part: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(part), HELD_ROWS):
            yield from judged(part.slice(i, HELD_ROWS), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their anchors."""
        first, held, count = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if first is None:
                first = (table["lead"][0].as_py(), table["gram"][0].as_py())
            held.append(table)
            count += len(table)
            if count < HELD_ROWS:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            gram = rows["gram"].to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[-1])  # the last anchor may go on
            if gram[last] == first[1]:  # still the first anchor: it is spread as it comes
                yield from spread(rows)
                held, count = [], 0
                continue
            opening = int(np.count_nonzero(gram[:last] == first[1]))
            yield from spread(rows.slice(0, opening))
            if last > opening:
                yield from judged(rows.slice(opening, last - opening), False)
            held, count = [rows.slice(last)], len(rows) - last
            if count >= HELD_ROWS:  # an anchor of very many surroundings
                first = (first[0], int(gram[last]))
                yield from spread(held[0])
                held, count = [], 0
        if held:
            rows = pa.concat_tables(held).combine_chunks()
            gram = rows["gram"].to_numpy()
            edge = (gram == first[1]) | (gram == gram[-1])
            yield from spread(rows.filter(pa.array(edge)))
            if not edge.all():
                yield from judged(rows.filter(pa.array(~edge)), False)

    return ranged.sortWithinPartitions("lead", "gram").mapInArrow(run, schema)


def range_repeats(packs: DataFrame, words: int) -> DataFrame:
    """gram, around and bits of the suffixes that occur again in their range; equal suffixes of all buckets meet there.
    packs: range, suffixes."""
    bits = [f"bits{k}" for k in range(words)]

    def compare(rows: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(rows["suffixes"].to_pylist()), dtype=SUFFIX)
        order, begin, run_of = runs_of_equals(held["lead"].copy(), held["whole"].copy())
        own = held[order]
        met = np.diff(np.concatenate([begin, [len(order)]])) > 1
        hit = own[met[run_of] & ~own["again"]]  # the rest is known
        classes, row = np.unique(np.stack([hit["gram"], hit["around"]], axis=1), axis=0, return_inverse=True)
        out = bits_of(row.reshape(-1), hit["back"].astype(np.int64), len(classes), words)
        return pa.table([pa.array(classes[:, 0]), pa.array(classes[:, 1]), *map(pa.array, out)], names=["gram", "around", *bits])

    schema = ", ".join(["gram long, around long", *(f"{b} long" for b in bits)])
    return packs.groupBy("range").applyInArrow(compare, schema)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> Table:
    """row_key and spans (array of start and end, in bytes) of the texts that hold repeats. docs: row_key, text."""
    spark = docs.sparkSession
    prepare(spark)
    every = Table(anchor_rows(docs, length, gram), "anchors")
    met = every.df.groupBy("gram").agg(F.count("*").alias("n"), (F.min("around") == F.max("around")).alias("alike")).filter("n > 1").select("gram", "alike")
    met = Table(met, "repeated-anchors")
    hits = Table(every.df.join(met.df, "gram"), "hits")
    every.drop()
    met.drop()
    mixed = hits.df.filter("not alike")
    classes = Table(mixed.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "place")).alias("one")).select("gram", "around", (F.col("n") > 1).alias("again"), "one.*"), "surroundings")
    # where all surroundings of an anchor are met twice there is nothing to find out
    open_ones = Table(classes.df.groupBy("gram").agg(F.bool_and("again").alias("done")).filter("not done").select("gram"), "open-anchors")
    asked = classes.df.join(open_ones.df, "gram")
    marks = Table(asked.groupBy("row_key").agg(F.collect_list(F.struct("gram", "around", "place", "again")).alias("marks")), "marked")
    # a repeated row's text is needed once
    reps = docs.join(marks.df.filter("size(marks) > 0"), "row_key").groupBy("row_key").agg(F.first("text").alias("text"), F.first("marks").alias("marks"))
    around_of = Table(surroundings(reps.select("text", "marks"), length), "surroundings-bytes")
    partitions, per_row = int(spark.conf.get("spark.sql.shuffle.partitions")), (length - gram + 1) // 2
    buckets = max(partitions, -(-around_of.df.count() * per_row // BUCKET_ROWS))
    words = [f"bits{k}" for k in range(-(-(length - gram + 1) // WORD))]
    near = Table(near_anchor(around_of.df, buckets, length, len(words), splitters(around_of.df, buckets, length)), "near-anchors")
    later = range_repeats(near.df.filter("range is not null").select("range", "suffixes"), len(words))
    verdicts = near.df.filter("range is null").select("gram", "around", *words).unionByName(later).groupBy("gram", "around").agg(*[F.bit_or(c).alias(c) for c in words])
    judged = Table(classes.df.filter("again").select("gram", "around", *[F.lit((1 << 63) - 1).alias(c) for c in words]).unionByName(verdicts), "verdicts")
    whole = hits.df.filter("alike").select("row_key", "place", *[F.lit((1 << 63) - 1).alias(c) for c in words])
    some = mixed.join(judged.df, ["gram", "around"]).select("row_key", "place", *words)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = (batch.column(k).to_numpy() for k in (0, 1))
            at, before, after = unpacked(place)
            bits = [batch.column(k).to_numpy() for k in range(2, batch.num_columns)]
            full = np.logical_and.reduce([b == (1 << 63) - 1 for b in bits])
            start, end, of = [(at - before)[full]], [(at - after + length)[full]], [np.flatnonzero(full)]
            part = np.flatnonzero(~full)
            if len(part):
                back = np.arange(WORD * len(bits))[::-1]  # strings from the first to the last start
                on = np.concatenate([(b[part][:, None] >> np.arange(WORD)) & 1 for b in bits], axis=1).astype(bool)[:, ::-1]
                on &= (back >= after[part][:, None]) & (back <= before[part][:, None])
                edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, c = np.nonzero(edge == 1)
                _, d = np.nonzero(edge == -1)
                start.append(at[part[r]] - back[c])
                end.append(at[part[r]] - back[d - 1] + length)
                of.append(part[r])
            columns = [keys[np.concatenate(of)], np.concatenate(start), np.concatenate(end)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_key", "start", "end"])

    runs_of = whole.unionByName(some).mapInArrow(spans, "row_key long, start long, end long")
    out = Table(runs_of.distinct().groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    for t in (hits, classes, open_ones, marks, around_of, near, judged):
        t.drop()
    return out


def cover(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(raw: bytes, runs_of: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs_of for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


DIGESTS = "row_key long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = own.select(row_key().alias("row_key"), "text")
    found = repeats(keyed, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n, sha = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, gone = text.as_py().encode("utf-8", "surrogatepass"), cover(spans)
                removed.append(sum(e - s for s, e in gone))
                n.append(len(gone))
                sha.append(hashlib.sha256(kept(raw, gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], [c.split()[0] for c in DIGESTS.split(", ")])

    changed = keyed.join(found.df.filter("size(spans) > 0"), "row_key").mapInArrow(run, DIGESTS)
    changed = Table(changed.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")]), "changed")
    thin = own.select("doc_id", row_key().alias("row_key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = thin.join(changed.df, "row_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The same columns and rows without repeats in text; characters of which only some bytes repeat stay. n_chars, if
    there, is counted anew."""
    columns = docs.columns
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = repeats(docs.select(key.alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), length, gram)
    spans = found.df.select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__own_key", key).join(spans, F.col("__own_key") == F.col("__row_key"), "left").select(*[docs[c] for c in columns], "__spans")
    at, counted = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def whole_chars(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for s, e in gone:
            while s < e and raw[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            if s < e:
                out.append((s, e))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns[:-1])
            texts = out[at].to_pylist()
            for k, spans_of in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans_of:
                    raw = texts[k].encode("utf-8", "surrogatepass")
                    texts[k] = kept(raw, whole_chars(raw, cover(spans_of))).decode("utf-8", "surrogatepass")
            out[at] = pa.array(texts, out[at].type)
            if counted is not None:
                out[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(out[counted].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return joined.mapInArrow(run, docs.schema)
