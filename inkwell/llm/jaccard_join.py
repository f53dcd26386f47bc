"""Exact n-gram Jaccard self-join with its components, by skipping over set relations.

A document's set holds the hashes of its distinct word shingles, in order of the hash. Equal sets
are one class from the start.

Index lists by position route sets to groups. Two linked sets of sizes in one band differ in at most
H shingles. The hash range is cut into M > H position blocks; so H differences cannot touch all of
them, and linked sets agree on some whole block. There is one list for each (band, position, block
content); lists of one class are skipped, and so is whatever shares shingles but no block, like a
passage that a third of all documents quote. (Blocks without a shingle are no evidence. A set that
has H or fewer filled blocks, which only tiny sets have, lists its empty blocks as well; two such
sets then meet there.) Each list sends its classes to the group of its least class.

Inside a group two relations between sets are used (see `Group`). Index lists are cut into blocks of
neighbouring sets, and each block has bounds: the range of its sets' sizes and the most shingles that
any of them has in each position segment of the hash range. A block whose bounds cannot reach the
links of a set is skipped unread. And the overlaps of a set follow from those of a highly similar set, its base,
by adding the lists of the shingles that are new and taking off those that are gone. A large group
is cut into parts of bounded size that meet in pairs. A pair that meets in several groups counts in
that of its least common leader.

Defined cases: null and empty texts have an empty set, are linked with nothing and are their own
component; a null doc_id counts as larger than all others, and its component is null where all its
members are; equal doc_ids are separate rows; extra columns are left out of the report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bounded_batches, buffers, components, few, give_back, mix64, partitions, shingle_sets, slices, small_side, stored

LAST = (1 << 63) - 1
#: Shingles and sets in one part of a group, about; larger groups are cut. Up to PARTS parts are made for PART_SETS sets each,
#: which spreads a large group over more tasks; beyond, a part grows to BLOCK_SETS first, as a set is sent once for each part.
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 4096
PART_SETS = 512
PARTS = 16
#: Neighbouring sets in a block of the index lists inside a group and in each of its bounds, and position segments of the hash range.
LIST_SETS = 64
BOUND_SETS = 16
SEGMENTS = 64
#: Of so many samples of a set, those that it must share with a base to be derived from it.
SAMPLES = 16
SIMILAR = 8
_U = np.uint64


class Bands:
    """Bands of set sizes, and for each the most differences of a linked pair whose smaller set is in it."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        edges = [1]
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
        edges.append(-(-edges[-1] * 100 // percent))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        self.differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        self.blocks = np.where(self.differ > 0, self.differ + 1 + self.differ // 16 + 1, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set's content."""
    with np.errstate(over="ignore"):
        return mix64(np.array([mix64(s ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(s)) for s in sets], np.uint64)).view(np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each index list that a set is in."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bands = Bands(percent, int(n.max()))
    flat = np.concatenate(sets)
    mixed = mix64(flat)
    rows, out = [], []
    own = bands.of(n)
    for step in range(len(bands.edges)):  # as the smaller set of a pair, then as the larger one of a smaller band
        key = own - step
        use = (n > 0) & (key >= 0)
        if step:  # sets of the band that are large enough to be linked with this one
            use &= -(-n * percent // 100) < bands.edges[np.maximum(key, 0) + 1]
            if not use.any():
                break
        m = np.where(use, bands.blocks[np.maximum(key, 0)], 0)
        use &= m > 0
        if not use.any():
            continue
        in_use = np.repeat(use, n)
        row = np.repeat(np.arange(len(sets)), n)[in_use]
        block = ((flat[in_use] >> _U(32)) * m[row].astype(np.uint64)) >> _U(32)
        place = (row.astype(np.uint64) << _U(32)) | block
        first = np.flatnonzero(np.diff(place, prepend=place[0] ^ _U(1)) != 0)
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mixed[in_use], first)
            at = row[first]
            where = mix64((key[at].astype(np.uint64) << _U(32)) | block[first])
            rows.append(at)
            out.append(mix64(content + where).view(np.int64))
            filled = np.bincount(at, minlength=len(sets))
            for r in np.flatnonzero(use & (filled <= bands.differ[np.maximum(key, 0)])):
                empty = np.setdiff1d(np.arange(m[r], dtype=np.uint64), block[row == r])
                rows.append(np.full(len(empty), r))
                out.append(mix64(mix64((_U(key[r]) << _U(32)) | empty) ^ _U(0xA5A5A5A5)).view(np.int64))
    return (np.concatenate(rows), np.concatenate(out)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def packed(s: np.ndarray) -> bytes:
    """A set as six bytes a shingle (its hash's upper ones), which tell the shingles of a group apart."""
    return (s >> _U(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def linked(size_a, size_b, common, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def _rank(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n in a row."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Group:
    """Sets compared with each other: index lists that are skipped by block, overlaps derived from a base's.

    The sets stand in order of their base, a base's own followers behind it, and by size. A set's base is
    the earlier one with which it shares most samples (the least hash of each of SAMPLES ranges of mixed
    hashes), at least SIMILAR; without one it is a base itself. `read` and `skipped` count blocks, `derived`
    and `counted` the sets whose overlaps follow from a base's or from all their own lists.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.read = self.skipped = self.derived = self.counted = 0
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        first = np.argsort(size, kind="stable")
        base = self._bases([sets[i] for i in first], size[first])
        by = np.argsort(base, kind="stable")
        #: number of each set among those given, in the order used here
        self.by = first[by]
        self.size, sets = size[self.by], [sets[i] for i in self.by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.base = place[base[by]]
        m = self.m = len(sets)
        flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
        shingles, number, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), self.size)
        top = int(flat.max()).bit_length() if len(flat) else 0
        segment = (flat >> np.uint64(max(top - SEGMENTS.bit_length() + 1, 0))).astype(np.int64)
        self.segments = np.bincount(owner * SEGMENTS + segment, minlength=m * SEGMENTS).reshape(m, SEGMENTS)
        shared = count[number] > 1  # a shingle of one set takes part in no overlap
        number, owner = number[shared], owner[shared]
        self.mine = np.split(number, np.searchsorted(owner, np.arange(1, m)))
        self.count = len(shingles)
        key = owner // LIST_SETS * self.count + number
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]
        self.blocks = -(-m // LIST_SETS)
        edge = np.arange(0, m, BOUND_SETS)
        if m:
            self.most = np.maximum.reduceat(self.segments, edge)
            self.least_size, self.most_size = np.minimum.reduceat(self.size, edge), np.maximum.reduceat(self.size, edge)

    @staticmethod
    def _bases(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        m = len(sets)
        if not size.sum():
            return np.arange(m)
        mixed = mix64(np.concatenate(sets))
        cell = np.repeat(np.arange(m), size) * SAMPLES + (mixed >> np.uint64(60)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        at = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sample = np.full(m * SAMPLES, np.uint32(0xFFFFFFFF))
        sample[cell[order][at]] = (np.minimum.reduceat(mixed[order], at) >> np.uint64(28)).astype(np.uint32)
        sample = sample.reshape(m, SAMPLES)
        base = np.arange(m)
        kept, which = np.empty_like(sample), np.empty(m, np.int64)
        n = 0
        for i in range(m):
            if n:
                share = (kept[:n] == sample[i]).sum(1)
                k = int(share.argmax())
                if share[k] >= SIMILAR:
                    base[i] = which[k]
                    continue
            kept[n], which[n] = sample[i], i
            n += 1
        return base

    def tally(self, shingles: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How many of the shingles each set holds, from their lists' parts in these blocks."""
        wanted = (blocks[:, None] * self.count + shingles).ravel()
        lo = np.searchsorted(self.key, wanted)
        n = np.searchsorted(self.key, wanted, "right") - lo
        return np.bincount(self.owner[np.repeat(lo, n) + _rank(n)], minlength=self.m)

    def near(self, i: int) -> np.ndarray:
        """Blocks up to that of set i which may hold a set that is linked with it."""
        n = i // LIST_SETS + 1
        k = n * LIST_SETS // BOUND_SETS
        low, high, size = self.least_size[:k], self.most_size[:k], self.size[i]
        bound = np.minimum(self.most[:k], self.segments[i]).sum(1)
        ok = (high * 100 >= size * self.percent) & (low * self.percent <= size * 100)
        ok &= bound * (100 + self.percent) >= self.percent * (size + np.maximum(low, -(-size * self.percent // 100)))
        found = np.unique(np.flatnonzero(ok) // (LIST_SETS // BOUND_SETS))
        self.read += len(found)
        self.skipped += n - len(found)
        return found

    def links(self):
        """For each set that has any, its number and those of the sets linked with it that stand before it, as given."""
        at, overlap, known = -1, None, None  # the base at work, its overlaps, and the blocks that they are known of
        for i in range(self.m):
            if not self.size[i]:
                continue
            blocks = self.near(i)
            if self.base[i] != at:
                at, overlap, known = int(self.base[i]), np.zeros(self.m, np.int64), np.zeros(self.blocks, bool)
            new = blocks[~known[blocks]]
            if len(new):
                overlap += self.tally(self.mine[at], new)
                known[new] = True
            if i == at:
                self.counted += 1
                mine = overlap
            else:
                self.derived += 1
                more = np.setdiff1d(self.mine[i], self.mine[at], assume_unique=True)
                less = np.setdiff1d(self.mine[at], self.mine[i], assume_unique=True)
                mine = overlap + self.tally(more, blocks) - self.tally(less, blocks)
            others = (blocks[:, None] * LIST_SETS + np.arange(LIST_SETS)).ravel()
            others = others[others < i]
            others = others[linked(self.size[others], self.size[i], mine[others], self.percent)]
            if len(others):
                yield int(self.by[i]), self.by[others]


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """Bits of the values that several of the lists hold: two lists share a value if they share a bit."""
    m = len(lists)
    n = np.fromiter(map(len, lists), np.int64, m)
    if not n.sum():
        return np.zeros((m, 0), np.uint64)
    _, number, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1)
    rank[several] = np.arange(len(several))
    bit, row = rank[number], np.repeat(np.arange(m), n)
    row, bit = row[bit >= 0], bit[bit >= 0]
    out = np.zeros((m, -(-len(several) // 64)), np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def compared(sets: list[np.ndarray], side: np.ndarray | None, copies: np.ndarray, before: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among sets, where they have sides only those across them: edges (a, b) of a spanning forest, and how many documents each set links with.

    Pairs that share a value of `before` were met in another group, and count there.
    """
    elsewhere = _common(before)
    degree = np.zeros(len(sets), np.int64)
    tree = np.arange(len(sets))
    a, b = [], []
    for i, found in Group(sets, percent).links():
        if side is not None:
            found = found[side[found] != side[i]]
        if elsewhere.shape[1] and len(found):
            found = found[~(elsewhere[found] & elsewhere[i]).any(1)]
        if not len(found):
            continue
        degree[i] += copies[found].sum()
        degree[found] += copies[i]
        roots, one = np.unique(tree[found], return_index=True)
        one = one[roots != tree[i]]
        if len(one):
            a += [i] * len(one)
            b += found[one].tolist()
            tree[np.isin(tree, roots)] = tree[i]
    return np.array(a, np.int64), np.array(b, np.int64), degree


def links(docs: DataFrame, words: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, mark, n, class), classes (class, copies, low doc, n) and what is linked: edges of a spanning forest
    of each group (a, a_low, b, b_low) with link counts (a, a_low, null, null, documents linked to a)."""
    bounded_batches(docs)
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text", F.xxhash64("text").alias("mark"))

    def named(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(*buffers(piece.column(1)), words)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(n), pa.array(class_of(sets), mask=n == 0)], names=["doc", "mark", "n", "class"])

    # narrow tables go to few files: each file costs its task several calls of the file system
    files = few(spark, docs.count())
    rows = stored(narrow.mapInArrow(named, "doc long, mark long, n long, class long").repartition(files), "jaccard-rows")
    classes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc").alias("low"), F.first("n").alias("n"))
    classes = stored(classes, "jaccard-classes", files)

    def listed(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(*buffers(piece.column(0)), words)
                name, one = np.unique(class_of(sets), return_index=True)  # equal sets of a piece merge here
                one = np.sort(one)
                sets = [sets[i] for i in one]
                at, sig = signatures(sets, percent)
                by = np.argsort(at, kind="stable")  # rows of one class side by side shuffle in fewer bytes
                yield pa.RecordBatch.from_arrays([pa.array(sig[by]), pa.array(class_of(sets)[at[by]])], names=["sig", "class"])

    def grouped(batches):
        """From entries in order: (least class of the list, class) of lists of several classes."""
        held_sig = held = None
        for batch in batches:
            sig, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = held_sig is None or sig[0] != held_sig
            start = np.flatnonzero(new)
            leader = np.repeat(name[start], np.diff(np.append(start, len(sig))))
            if not new[0]:  # the list goes on from the batch before
                leader = np.concatenate([np.full(len(sig) - len(leader), held), leader])
            held_sig, held = sig[-1], leader[-1]
            pairs = np.unique(np.stack([leader, name], 1)[leader != name], axis=0)
            both = np.concatenate([pairs, np.repeat(np.unique(pairs[:, :1], axis=0), 2, axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["leader", "class"])

    entries = narrow.select("text").where("text is not null").mapInArrow(listed, "sig long, class long")
    entries = entries.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "class")
    member = stored(entries.mapInArrow(grouped, "leader long, class long").distinct(), "jaccard-groups", min(partitions(spark), 4 * files))
    # groups too large for one task are cut into parts that meet in pairs
    size = member.join(classes.select(F.col("class").alias("c"), "n"), F.col("class") == F.col("c")).groupBy("leader").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    size = size.select(F.col("leader").alias("g_leader"), F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS), F.least(F.ceil(F.col("sets") / PART_SETS), F.lit(PARTS))).cast("int").alias("cuts"))
    large = small_side(stored(size.where("cuts > 1"), "jaccard-large-groups", files))
    placed = member.join(large, F.col("leader") == F.col("g_leader"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct("leader", "block", F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    # each class carries the list of its places, so that its set is sent to them and nowhere else
    placed = placed.groupBy(F.col("class").alias("t_class")).agg(F.sort_array(F.collect_list("leader")).alias("leaders"), F.flatten(F.collect_list(pair)).alias("to"))
    carried = stored(classes.join(placed, F.col("class") == F.col("t_class")).select("class", "copies", "low", "leaders", "to"), "jaccard-places", files)

    def set_rows(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(*buffers(piece.column(0)), words)
                yield pa.RecordBatch.from_arrays([pa.array(class_of(sets)), pa.array([packed(s) for s in sets], pa.binary())], names=["s_class", "shingles"])

    # the text of one document of each class that is in a group; only those are hashed again
    texts = narrow.join(small_side(carried.select(F.col("low").alias("w_doc")).distinct()), F.col("doc") == F.col("w_doc"), "left_semi").select("text")
    sets = texts.mapInArrow(set_rows, "s_class long, shingles binary")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.groupBy("s_class").agg(F.first("shingles").alias("shingles"))
    sent = sets.join(carried, F.col("class") == F.col("s_class")).select("class", "copies", "low", "leaders", "shingles", F.explode("to").alias("to"))
    # a place needs the leaders below its own only: where two sets share one, they meet there
    before = F.filter("leaders", lambda x: x < F.col("to.leader"))
    placed = sent.select("to.leader", "to.block", "to.i", "to.j", "class", "copies", "low", before.alias("before"), "shingles")

    def met(table: pa.Table) -> pa.Table:
        name, low, block, copies = (table.column(k).to_numpy() for k in ("class", "low", "block", "copies"))
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets = [unpacked(x.as_py()) for x in table.column("shingles")]
        lists = table.column("before").combine_chunks()
        before = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
        # two parts of a group meet only across; pairs within one are another task's
        a, b, degree = compared(sets, block if across else None, copies, before, percent)
        at = np.flatnonzero(degree)
        n, none = len(a), np.arange(len(a) + len(at)) >= len(a)
        columns = [np.concatenate([name[a], name[at]]), np.concatenate([low[a], low[at]]), np.concatenate([name[b], name[at]]), np.concatenate([low[b], low[at]]), np.concatenate([np.zeros(n, np.int64), degree[at]])]
        give_back()
        return pa.table([pa.array(c, pa.int64(), mask=none if k in (2, 3) else None) for k, c in enumerate(columns)], names=["a", "a_low", "b", "b_low", "n_links"])

    found = placed.groupBy("leader", "i", "j").applyInArrow(met, "a long, a_low long, b long, b_low long, n_links long")
    return rows, classes, stored(found.repartition(files), "jaccard-links")


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, mark (hash of the text), n, component, n_links of each row; LAST stands for no doc_id."""
    rows, classes, found = links(docs, words, percent)
    # a node is a class led by its least doc, so the least node of a component tells its least doc
    node = lambda x: F.struct(F.col(f"{x}_low").alias("low"), F.col(x).alias("class"))
    tree = components(found.where("b is not null").select(node("a").alias("a"), node("b").alias("b")))
    tree = tree.select(F.col("node.class").alias("t_class"), F.col("root.low").alias("component"))
    degree = found.where("b is null").groupBy(F.col("a").alias("d_class")).agg(F.sum("n_links").alias("far"))
    named = classes.join(degree, F.col("class") == F.col("d_class"), "left").join(tree, F.col("class") == F.col("t_class"), "left").where("copies > 1 or far > 0")
    named = named.select(F.col("class").alias("k_class"), F.coalesce("component", "low").alias("component"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(named, "jaccard-named", few(docs.sparkSession, classes.count()))
    out = rows.join(small_side(named), F.col("class") == F.col("k_class"), "left")
    return out.select("doc", "mark", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links (other rows that it is linked with)."""
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = _labelled(docs, words, percent)
    return out.select(back("doc").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), "n_links")


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component left, the one of the least doc_id; all columns stay.

    Rows equal in doc_id and text count as one document, and one of them stays.
    """
    files = few(docs.sparkSession, docs.count())
    found = _labelled(docs, words, percent).where("n_links > 0")
    found = stored(found, "jaccard-dedup", files)
    # of rows of the least doc_id one text is chosen, so that a component keeps one document
    leads = found.where("doc = component")
    chosen = leads.groupBy(F.col("doc").alias("c_doc")).agg(F.min("mark").alias("kept"))
    others = leads.join(chosen, F.col("doc") == F.col("c_doc")).where("mark <> kept").select("doc", "mark")
    gone = found.where("doc <> component").select("doc", "mark").union(others).distinct()
    gone = stored(gone.select(F.col("doc").alias("__jaccard_gone"), F.col("mark").alias("__jaccard_gone_mark")), "jaccard-gone", files)
    kept = docs.withColumn("__jaccard_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__jaccard_mark", F.xxhash64("text"))
    kept = kept.join(small_side(gone), (F.col("__jaccard_doc") == F.col("__jaccard_gone")) & (F.col("__jaccard_mark") == F.col("__jaccard_gone_mark")), "left_anti").drop("__jaccard_doc", "__jaccard_mark")
    twice = found.groupBy("doc", "mark").count().where("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
