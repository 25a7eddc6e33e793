"""Jaccard self-join of documents on word shingles, by count vectors in R-trees.

A document is the set of its distinct shingles of SHINGLE words. The join finds every link

    PART * |A & B| >= WHOLE_PART * |A | B|      (100 and 85: similarity 0.85 or more)

and gives each document the smallest id it reaches over links.

1. One pass hashes the shingles and gives each document its set's size and id (equal sets share one, so
   exact copies are one node) and its point: the counts of its shingles by hash group, with more groups
   for longer texts. It also counts shingles over all documents in a fixed number of finer groups.
2. Two linked sets share one of their first ``n - ceil(0.85 n) + 1`` shingles in any common order. The
   order is by that count, rarest group first, so that a passage in a third of all documents is not a
   meeting point. Shingles met by one set only are dropped.
3. The sets of a meeting point are searched by an R-tree over their points with a bound that no overlap
   exceeds, the summed minima of coordinates. (Texts whose points differ in length are compared in the
   shorter one's groups, which the longer one's fold into.) Pairs that pass are candidates; a meeting point gives only
   as many as connect what all its candidates connect. Their components are the blocks: no link crosses
   them.
4. Inside a block, the R-tree is built anew over points with more groups, and what passes its bound is
   compared exactly, shingle by shingle. Pairs already connected by links found in the same task are not
   compared again: the links found connect what the complete set of links connects.

Meeting points and blocks of more than CHUNK_SETS sets are cut into chunks, and each pair of chunks is a
task of its own, so that a group with a third of all sets is not one task. One R-tree over all points
cannot narrow the search, because counts in few groups are alike for all texts of a length; meeting points
come first for that reason.

Defined results: a text without words, empty or null, has no shingles and is linked with nothing; fewer
words than SHINGLE are one shingle; a null id takes part, and a component takes its smallest id that is
not null; repeated rows are each given; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.graph import components
from signalsieve.llm.shared import WORD, cut, releasing, rows_per_batch, written
from signalsieve.llm.words import hash_words, mixed, shingles, slices, split

SHINGLE = 4
SHARE = (85, 100)
LEVELS = (5, 10)  # a document's point has 2 ** 5 to 2 ** 10 coordinates, about one to eight shingles
ORDER_BITS = 18  # hash groups whose counts order the shingles: 2 MB on the driver and in a task
SEEN_BITS = 22  # marks of document ids that are read again: 512 KB in a task
BATCH_ROWS = 1_000  # texts that a task holds at a time
SEEN_SETS = 200_000  # sets that a task remembers, so that a copy is not said twice
CHUNK_SETS = 512
SMALL_GROUP = 32  # so few sets are compared with each other without a tree
CHUNK_SHINGLES = 2_000_000
LEAF, FANOUT = 16, 8


def distinct_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sorted distinct shingle hashes, set ids) of texts."""
    starts, words = split(texts)
    starts, hashes = shingles(starts, hash_words(words), width)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(starts) - 1))]).astype(np.int64)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return sums[starts[1:]] - sums[starts[:-1]]

    ids = mixed(total(mixed(hashes)) ^ mixed(total(mixed(~hashes)) + np.diff(starts).astype(np.uint64)))
    return starts, hashes, ids.view(np.int64)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: doc_id, n, sid, th (text hash), point of every document; kind 1: group (as doc_id), its count n."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = np.zeros(1 << ORDER_BITS, np.int64)

        def rows(kind, ids, n, sid, th, points):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n), pa.array(sid), th, points],
                names=["kind", "doc_id", "n", "sid", "th", "point"])

        for batch in batches:
            for part in slices(batch, "text"):
                starts, hashes, sids = distinct_shingles(part.column("text"), width)
                groups += np.bincount((hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(groups))
                points = pa.array(packed_points(hashes, starts), pa.binary())
                yield rows(0, part.column("doc_id"), np.diff(starts), sids, part.column("th"), points)
        used = np.flatnonzero(groups)
        zeros = np.zeros(len(used), np.int64)
        yield rows(1, pa.array(used), groups[used], zeros, pa.array(zeros), pa.nulls(len(used), pa.binary()))

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return hashed.mapInArrow(run, "kind int, doc_id long, n long, sid long, th long, point binary")


def _group_counts(scanned: DataFrame) -> np.ndarray:
    """Shingles by hash group over all documents: 2 ** ORDER_BITS numbers at most."""
    counted = scanned.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[counted.column("doc_id").to_numpy()] = counted.column("n").to_numpy()
    return counts


def _postings(docs: DataFrame, width: int, share: tuple[int, int], counts: np.ndarray) -> DataFrame:
    """(key, sid): the shingles of which two linked sets share one; copies in a task say theirs once."""
    part, whole = share

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[int] = set()
        for batch in batches:
            for rows in slices(batch, "text"):
                starts, hashes, sids = distinct_shingles(rows.column("text"), width)
                sizes = np.diff(starts)
                fresh = np.zeros(len(sids), bool)
                for i, sid in enumerate(sids.tolist()):
                    fresh[i] = sid not in said
                    if len(said) < SEEN_SETS:
                        said.add(sid)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                rarity = counts[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                order = np.lexsort((hashes, rarity, doc))
                first = sizes + (-part * sizes) // whole + 1  # n - ceil(n * part / whole) + 1
                picked = (np.arange(len(doc)) - starts[:-1][doc] < first[doc]) & fresh[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[order][picked].view(np.int64)), pa.array(sids[doc[picked]])], names=["key", "sid"])

    return docs.mapInArrow(run, "key long, sid long")


def _chunked(rows: DataFrame, k: Column) -> DataFrame:
    """``rows`` with (chunk, lo, hi) for every pair of chunks that a row takes part in, of ``k`` chunks in all."""
    chunk = F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")
    columns = rows.columns
    dealt = rows.withColumn("k", k).withColumn("chunk", chunk)
    pairs = dealt.select(*columns, "chunk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    return pairs.select(*columns, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))


def _ties(postings: DataFrame, nodes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): candidates that connect, per meeting point, what all its candidates connect."""
    points = postings.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a < b").select("key")
    with rows_per_batch(postings.sparkSession, BATCH_ROWS):
        met = written(postings.join(points, "key").distinct(), "ngram-met")
    # texts that share a passage meet at many of its shingles; one of all points with the same sets is enough
    kinds = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("sid").alias("least"), F.bit_xor(F.xxhash64("sid")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"))
    kept = kinds.groupBy("m", "least", "x", "y").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("m") / CHUNK_SETS).cast("int").alias("crowd"))
    known = nodes.groupBy("sid").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    rows = _chunked(met.join(kept, "key"), F.col("crowd")).drop("crowd").join(known, "sid")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            group = _group_starts(rows)
            last = int(group[-1]) if len(group) else 0
            if last:
                yield _candidate_ties(rows.slice(0, last), share)
            rest = rows.slice(last)
        if rest is not None and rest.num_rows:
            yield _candidate_ties(rest, share)

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "sid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _group_starts(rows: pa.Table) -> np.ndarray:
    """First row of each run of equal (key, lo, hi)."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("key", "lo", "hi"):
        values = rows.column(c).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _candidate_ties(rows: pa.Table, share: tuple[int, int]) -> pa.RecordBatch:
    """Candidates within each (key, lo, hi) group of ``rows``."""
    part, whole = share
    first = _group_starts(rows)
    size = np.diff(np.append(first, rows.num_rows))
    group = np.repeat(np.arange(len(first)), size)
    sid, n, chunk, lo, hi = (rows.column(c).to_numpy() for c in ("sid", "n", "chunk", "lo", "hi"))
    points, level = rows.column("point").to_pylist(), level_of(n)
    small = (size <= SMALL_GROUP) & (lo[first] == hi[first])
    pairs = [np.empty((0, 2), np.int64)]
    # linked sets are alike in size, so their levels are the same or neighbours
    for low in np.unique(level).tolist():
        here = np.flatnonzero(small[group] & (level >= low) & (level <= low + 1))
        if not len(here):
            continue
        x = folded([points[i] for i in here.tolist()], low)
        for step in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero(group[here[:-step]] == group[here[step:]])
            i = i[np.minimum(level[here[i]], level[here[i + step]]) == low]
            a, b = here[i], here[i + step]
            near = (part + whole) * np.minimum(x[i], x[i + step]).sum(axis=1) >= part * (n[a] + n[b])
            pairs.append(np.column_stack([sid[a[near]], sid[b[near]]]))
    for g in np.flatnonzero(~small).tolist():
        at = np.arange(first[g], first[g] + size[g])
        upper, lower = sides(chunk[at])
        one = upper[0] == lower[0]
        for high in np.unique(level[at]).tolist():
            for other in (high - 1, high, high + 1):
                if one and other > high:
                    continue  # the same pairs as with the two levels exchanged
                asked, held = upper[level[at[upper]] == high], lower[level[at[lower]] == other]
                if not len(asked) or not len(held):
                    continue
                both = np.unique(np.concatenate([asked, held]))
                x = folded([points[i] for i in at[both].tolist()], min(high, other))
                pairs.append(connecting(sid[at[both]], x, n[at[both]], np.searchsorted(both, asked),
                                        np.searchsorted(both, held), share))
    found = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of a doc_id that must be read again: 2 ** SEEN_BITS of them at most."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SEEN_BITS)).cast("int")
    bits = np.zeros(1 << SEEN_BITS, bool)
    bits[ids.select(place.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def _sets(docs: DataFrame, width: int, marks: np.ndarray) -> DataFrame:
    """(sid, set) of the documents that are marked; a few more may come along."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("_bit").to_numpy()
            batch = batch.filter(pa.array((marks[bit >> 3] >> (bit & 7)) & 1 == 1))
            for rows in slices(batch, "text"):
                starts, hashes, sids = distinct_shingles(rows.column("text"), width)
                sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sids), sets], names=["sid", "set"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SEEN_BITS)).cast("int")
    return docs.select("text", place.alias("_bit")).mapInArrow(run, "sid long, set array<long>")


class RTree:
    """Points with sizes, packed into leaves of near points under nodes of their largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.concatenate(self._leaves(points, np.arange(len(points))))
        self.points, self.sizes = points[self.order], sizes[self.order]
        # levels from the leaves up: (largest coordinates, smallest size) per node
        self.levels = [self._up(self.points, self.sizes, LEAF)]
        while len(self.levels[-1][1]) > FANOUT:
            self.levels.append(self._up(*self.levels[-1], FANOUT))

    @classmethod
    def _leaves(cls, points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Splits at the middle of the widest coordinate, into full leaves, until a leaf holds the rest."""
        if len(at) <= LEAF:
            return [at]
        widest = int(np.ptp(points[at], axis=0).argmax())
        at = at[np.argsort(points[at, widest], kind="stable")]
        middle = LEAF * max(1, -(-len(at) // LEAF) // 2)
        return cls._leaves(points, at[:middle]) + cls._leaves(points, at[middle:])

    @staticmethod
    def _up(points: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.arange(0, len(points), width)
        return np.maximum.reduceat(points, first, axis=0), np.minimum.reduceat(sizes, first)

    def search(self, point: np.ndarray, size: int, share: tuple[int, int]) -> np.ndarray:
        """Places (in the order given) of the points whose sets may reach the share with this one."""
        part, whole = share

        def near(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            # overlap >= part * union / whole, and union = both sizes - overlap
            return (part + whole) * np.minimum(points, point).sum(axis=1) >= part * (size + sizes)

        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes, least = self.levels[depth]
            at = at[near(boxes[at], least[at])]
            width, below = (FANOUT, len(self.levels[depth - 1][1])) if depth else (LEAF, len(self.points))
            at = (at[:, None] * width + np.arange(width)).ravel()
            at = at[at < below]
        return self.order[at[near(self.points[at], self.sizes[at])]]


def count_vectors(flat: np.ndarray, starts: np.ndarray, groups: int) -> np.ndarray:
    """Counts of shingles by hash group."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cell = doc * groups + ((flat.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=(len(starts) - 1) * groups).reshape(-1, groups).astype(np.int32)


def level_of(sizes: np.ndarray) -> np.ndarray:
    """log2 of the number of groups of a set of this size."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 8)), *LEVELS).astype(np.int64)


def packed_points(flat: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The point of each set, in as many groups as its size asks for."""
    levels = level_of(np.diff(starts))
    out: list[bytes] = [b""] * len(levels)
    for level in np.unique(levels).tolist():
        mine = np.flatnonzero(levels == level)
        own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in mine.tolist()])
        bounds = np.concatenate([[0], np.cumsum(np.diff(starts)[mine])])
        for i, row in zip(mine.tolist(), count_vectors(own, bounds, 1 << level)):
            out[i] = row.tobytes()
    return out


def folded(points: list[bytes], level: int) -> np.ndarray:
    """Points of ``level`` or more as a matrix of 2 ** level groups: equal remainders add up."""
    rows = [np.frombuffer(p, np.int32) for p in points]
    return np.stack([r if len(r) == 1 << level else r.reshape(-1, 1 << level).sum(axis=0, dtype=np.int32) for r in rows])


def connecting(
    ids: np.ndarray, points: np.ndarray, sizes: np.ndarray, asked: np.ndarray, held: np.ndarray,
    share: tuple[int, int], verify=None,
) -> np.ndarray:
    """Pairs of ``ids`` that connect what all pairs within the bound (and, with ``verify``, truly linked) connect.

    Pairs have one of ``asked`` and one of ``held`` (places); the two are the same places or have none in
    common. ``verify(a, near)`` tells which of ``near`` are linked with ``a``.
    """
    across = asked[0] != held[0]
    tree = RTree(points[held], sizes[held])
    root = np.arange(len(sizes))
    for a in asked.tolist():
        near = held[tree.search(points[a], int(sizes[a]), share)]
        near = near[root[near] != root[a]] if across else near[(near < a) & (root[near] != root[a])]
        if verify is not None and len(near):
            near = near[verify(a, near)]
        for b in near.tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
    # as stars around the smallest id, which are the shortest way to say what is connected
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    tied = np.flatnonzero(least[root] != ids)
    return np.column_stack([least[root[tied]], ids[tied]])


def sides(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the upper and the lower chunk, the same ones where there is one chunk."""
    return np.flatnonzero(chunk == chunk.max()), np.flatnonzero(chunk == chunk.min())


def linked_pairs(
    ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, chunk: np.ndarray, share: tuple[int, int]
) -> np.ndarray:
    """Pairs of ``ids`` of sets (rows of ``flat``, ascending) that connect what all their links connect."""
    part, whole = share
    sizes = np.diff(starts)
    typical = max(1, int(np.median(sizes)))
    groups = 1 << int(np.clip(np.ceil(np.log2(max(1, typical / 4))), 3, 9))

    def verify(a: int, near: np.ndarray) -> np.ndarray:
        own = flat[starts[a] : starts[a + 1]]
        values = np.concatenate([flat[starts[b] : starts[b + 1]] for b in near.tolist()])
        same = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        ends = np.cumsum(sizes[near])
        both = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], ends[:-1]]))
        return (part + whole) * both >= part * (sizes[a] + sizes[near])

    return connecting(ids, count_vectors(flat, starts, groups), sizes, *sides(chunk), share, verify)


def _block_links(share: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        sets = table.column("set").combine_chunks()
        sets = sets if isinstance(sets, pa.ListArray) else pa.concat_arrays(sets.chunks)
        starts = sets.offsets.to_numpy().astype(np.int64)
        flat = sets.values.to_numpy()[starts[0] : starts[-1]]
        starts = starts - starts[0]
        # ascending as signed numbers within each set, whatever order they were written in
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        flat = flat[np.lexsort((flat, doc))]
        found = linked_pairs(table.column("sid").to_numpy(), flat, starts, table.column("chunk").to_numpy(), share)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return run


def _links(sets: DataFrame, members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) links between set ids. ``sets``: sid, set; ``members``: sid, block, n.

    How a block is cut is found on the narrow members; the sets move to their members and then to their
    tasks, and no more.
    """
    cuts = members.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).select(
        "block", F.greatest(F.ceil(F.col("m") / CHUNK_SETS), F.ceil(F.col("w") / CHUNK_SHINGLES)).cast("int").alias("cuts"))
    narrow = cut(members.join(cuts, "block").select("sid", "block", "cuts"))
    mine = sets.join(narrow, "sid").dropDuplicates(["sid"])
    return _chunked(mine, F.col("cuts")).drop("cuts").groupBy("block", "lo", "hi").applyInArrow(
        _block_links(share), "a long, b long")


def _grouped(docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, th, n and grp of every row: equal grp where links connect; null grp for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        scanned = written(_scan(docs, width), "ngram-scan")
    nodes = scanned.where("kind = 0").select("doc_id", "n", "sid", "th", "point")
    # made twice rather than written: hashing texts again costs less than the disk for all meeting points
    postings = _postings(docs, width, share, _group_counts(scanned))
    blocks = components(_ties(postings, nodes, share)).withColumnsRenamed({"v": "sid", "root": "block"})
    # one document stands for all with its set
    first = cut(nodes.join(blocks, "sid").groupBy("sid", "block", "n").agg(F.min("doc_id").alias("doc_id")))
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        links = cut(_links(_sets(docs, width, _marks(first)), first, share))
    roots = components(links).withColumnsRenamed({"v": "sid"})
    return nodes.join(roots, "sid", "left").select(
        "doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("grp"))


def similar(docs: DataFrame, width: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    grouped = _grouped(docs, width, share)
    # written, so that both sides of the join are plain exchanges and a large group of copies can be split
    shared = cut(grouped.where("grp IS NOT NULL").groupBy("grp").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    # empty sets meet nothing; a key of their own keeps them from being one large group
    at = F.coalesce("grp", F.xxhash64("doc_id", "th"))
    return grouped.withColumn("at", at).join(shared.withColumnRenamed("grp", "at"), "at", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one row of each connected group, that of the smallest id; all columns.

    Among rows of that id, the one with the smallest text hash stays; of rows equal in id and text, any.
    Rows without words are linked with nothing and all stay.
    """
    grouped = _grouped(docs, width, share).where("grp IS NOT NULL")
    # nulls last: an id is preferred to none
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    kept = grouped.groupBy("grp").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.th").alias("_th"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                        F.xxhash64("text").alias("_th"), "text")
    spoken = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    whole = whole.withColumn("_spoken", spoken).drop("text")
    chosen = whole.where("_spoken").join(
        kept.withColumnsRenamed({"_id": "k_id", "_th": "k_th"}),
        F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_th") == F.col("k_th")), "left_semi",
    ).dropDuplicates(["_id", "_th"])
    return chosen.select("_row.*").unionByName(whole.where("NOT _spoken").select("_row.*"))
