"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of a test item is a seed. Where a document holds a seed, the item is aligned to the words
around it, as many as an alignment of `threshold` can reach: equal words (A-Z lower-cased) score MATCH,
others MISMATCH, a gap GAP. A copy counts as a leak if it reaches `threshold` of the score of the item
against itself. An item keeps only its rarer half of seeds, by document frequency over the whole corpus
and among the seeds that occur, if breaking all of them would cost more than a copy of `threshold` can
lose; otherwise it keeps them all. At 0.5 that bound never holds, so all seeds are looked up and nothing
is counted. A copy without SEED_WORDS words of the item in a row (every third one replaced) has no seed.

Items are sent to the executors in blocks of at most BLOCK_WORDS words; a larger benchmark takes
one pass over the corpus for each block, so what is broadcast has a fixed bound.

Defined cases: null texts and items without words match nothing; an item shorter than a seed is a
seed as a whole; repeated documents are judged row by row; equal items count once; an empty corpus
or benchmark gives no leaks and keeps every document; extra columns are kept by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bounded_batches, buffers, gram_hashes, slices, word_count, word_hashes, word_spans

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, 1
THRESHOLD = 0.5
BLOCK_WORDS = 500_000


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and where in doc it ends (exclusive)."""
    ramp = GAP * np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(doc == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps along the document
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def aligned_span(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score with the words of doc that it covers."""
    best, end = align(doc, item)
    if not best:
        return 0, 0, 0
    _, back = align(doc[:end][::-1], item[::-1])
    return best, end - back, end


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str]):
        raw, offsets = buffers(pa.array(texts, pa.string()))
        start, end, first = word_spans(raw, offsets)
        words = word_hashes(raw, start, end)
        grams, ok = gram_hashes(words, first, SEED_WORDS)
        self.ids, self.words = ids, [words[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds, owner, place = [grams[ok]], [np.repeat(np.arange(len(ids)), np.diff(first))[ok]], [(np.arange(len(words)) - np.repeat(first[:-1], np.diff(first)))[ok]]
        self.short: dict[int, list[int]] = {}  # items of fewer words than a seed, by length
        for i, w in enumerate(self.words):
            if 0 < len(w) < SEED_WORDS:
                self.short.setdefault(len(w), []).append(i)
        for n, which in self.short.items():
            for i in which:
                g, _ = gram_hashes(self.words[i], np.array([0, n]), n)
                seeds.append(g[:1] + np.uint64(n))
                owner.append(np.array([i]))
                place.append(np.array([0]))
        seeds, self.owner, self.place = (np.concatenate(x) for x in (seeds, owner, place))
        self.order(seeds, np.ones(len(seeds), bool))

    def order(self, seeds: np.ndarray, keep: np.ndarray) -> None:
        by = np.argsort(seeds[keep], kind="stable")
        self.seeds, self.owner, self.place = seeds[keep][by], self.owner[keep][by], self.place[keep][by]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words at which a seed starts, and the seeds."""
        at, seeds = [], []
        for n in (SEED_WORDS, *self.short):
            grams, ok = gram_hashes(words, first, n)
            if n < SEED_WORDS:
                grams = grams + np.uint64(n)
            found = np.flatnonzero(ok)
            found = found[self._known(grams[found])]
            at.append(found)
            seeds.append(grams[found])
        return np.concatenate(at), np.concatenate(seeds)

    def _known(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.seeds) or not len(grams):
            return np.zeros(len(grams), bool)
        bits = 20  # a small table of their top bits answers for most
        if not hasattr(self, "table"):
            self.table = np.zeros(1 << bits, bool)
            self.table[(self.seeds >> np.uint64(64 - bits)).astype(np.int64)] = True
        maybe = np.flatnonzero(self.table[(grams >> np.uint64(64 - bits)).astype(np.int64)])
        out = np.zeros(len(grams), bool)
        k = np.searchsorted(self.seeds, grams[maybe])
        out[maybe] = self.seeds[np.minimum(k, len(self.seeds) - 1)] == grams[maybe]
        return out

    def leaks(self, raw: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple]:
        """(row, item number, score, first byte, byte after) of each leak, bytes within the row."""
        start, end, first = word_spans(raw, offsets)
        words = word_hashes(raw, start, end)
        at, seeds = self.hits(words, first)
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        n = hi - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        row = np.searchsorted(first, at, "right") - 1
        item, base = self.owner[which], at - self.place[which]
        by = np.lexsort((base, item, row))
        row, item, base = row[by], item[by], base[by]
        out = []
        length = np.array([len(w) for w in self.words])
        slack = (MATCH * length[item] * (1 - threshold) / GAP).astype(np.int64) + 1  # gaps that a copy can have
        new = np.ones(len(by), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (base[1:] - base[:-1] > length[item[1:]] + 2 * slack[1:])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(by))
        best: dict[tuple[int, int], tuple] = {}
        for a, b in zip(begin.tolist(), stop.tolist()):
            r, i = int(row[a]), int(item[a])
            low = max(int(first[r]), int(base[a] - slack[a]))
            high = min(int(first[r + 1]), int(base[b - 1] + length[i] + slack[a]))
            around = words[low:high]
            if np.isin(self.words[i], around).sum() < threshold * length[i]:  # as many words match at most
                continue
            share = align(around, self.words[i])[0] / (MATCH * int(length[i]))
            if share >= threshold and share > best.get((r, i), (0,))[0]:
                _, x, y = aligned_span(around, self.words[i])
                best[r, i] = (share, int(start[low + x] - offsets[r]), int(end[low + y - 1] - offsets[r]))
        out.extend((r, i, *found) for (r, i), found in best.items())
        return out


def blocks(benchmark: DataFrame) -> list[Items]:
    """The items in blocks of BLOCK_WORDS words at most, a longer item alone."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct().withColumn("w", word_count(F.col("text"))).where("w > 0")
    order = Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("block", F.floor(F.coalesce(F.sum("w").over(order), F.lit(0)) / BLOCK_WORDS))
    out: dict[int, tuple[list, list]] = {}
    for r in items.orderBy("item_id", "text").toLocalIterator():
        ids, texts = out.setdefault(r["block"], ([], []))
        ids.append(r["item_id"])
        texts.append(r["text"])
    return [Items(*x) for x in out.values()]


def _must_hold(n_seeds: np.ndarray | int, length: np.ndarray | int, threshold: float) -> np.ndarray | bool:
    """Whether a copy of an item of so many words must hold one of n_seeds of its seeds to reach threshold.

    A gap in the item breaks SEED_WORDS - 1 seeds, a word replaced or left out SEED_WORDS, a word cut at an end one.
    """
    each = min(GAP / (SEED_WORDS - 1), (MATCH - MISMATCH) / SEED_WORDS, (MATCH + GAP) / SEED_WORDS, MATCH)
    return n_seeds * each > MATCH * length * (1 - threshold)


def _rare(docs: DataFrame, block: Items, threshold: float) -> Items:
    """Leave an item its rarer seeds, by their frequency over all documents, if each copy must hold one of them."""
    bounded_batches(docs)
    length = np.array([len(w) for w in block.words])
    if not _must_hold(np.bincount(block.owner, minlength=len(length)), length, threshold).any():
        return block
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def counted(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, offsets = buffers(piece.column(0))
                start, end, first = word_spans(raw, offsets)
                at, seeds = sent.value.hits(word_hashes(raw, start, end), first)
                row = np.searchsorted(first, at, "right") - 1
                by = np.lexsort((seeds, row))
                once = np.ones(len(by), bool)
                once[1:] = (seeds[by][1:] != seeds[by][:-1]) | (row[by][1:] != row[by][:-1])
                for seed, n in zip(*(x.tolist() for x in np.unique(seeds[by][once], return_counts=True))):
                    total[seed] = total.get(seed, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(total, np.uint64, len(total)).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["seed", "n"])

    counts = docs.select("text").mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # BLOCK_WORDS rows at most
    seeds = np.array([r["seed"] for r in counts], np.int64).view(np.uint64)
    by = np.argsort(seeds)
    seeds, n = seeds[by], np.array([r["n"] for r in counts], np.int64)[by]
    freq = np.zeros(len(block.seeds), np.int64)
    if len(seeds):
        k = np.minimum(np.searchsorted(seeds, block.seeds), len(seeds) - 1)
        freq = np.where(seeds[k] == block.seeds, n[k], 0)
    keep = np.zeros(len(freq), bool)
    keep[freq > 0] = True
    by = np.lexsort((freq, block.owner))
    by = by[freq[by] > 0]
    edge = np.flatnonzero(np.diff(block.owner[by])) + 1
    for part in np.split(by, edge):
        if len(part):
            rare = freq[part] <= freq[part[(len(part) - 1) // 2]]
            if _must_hold(int(rare.sum()), int(length[block.owner[part[0]]]), threshold):
                keep[part] = rare
    block.order(block.seeds, keep)
    block.__dict__.pop("table", None)
    sent.unpersist()
    return block


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_byte, end_byte of each document that holds a copy of an item."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, score double, start_byte long, end_byte long"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(_rare(narrow, block, threshold))

        def found(batches, sent=sent):
            for batch in batches:
                for piece in slices(batch, "text"):
                    rows = sent.value.leaks(*buffers(piece.column(1)), threshold)
                    ids = piece.column(0).to_pylist()
                    cols = [[ids[r[0]] for r in rows], [sent.value.ids[r[1]] for r in rows], *([r[k] for r in rows] for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "start_byte", "end_byte"])

        out = out.union(narrow.mapInArrow(found, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a copy of an item; nothing is shuffled."""
    spark = docs.sparkSession
    whole, k = docs, docs.columns.index("text")
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(_rare(whole, block, threshold))

        def kept(batches, sent=sent):
            for batch in batches:
                for piece in slices(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    for r in sent.value.leaks(*buffers(piece.column(k)), threshold):
                        keep[r[0]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, whole.schema)
    return docs
