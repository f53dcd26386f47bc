"""Token-ID output: ORC files of token ids in doc_id order, and a reader that proves them.

Format: one ORC file per range of doc_id, files and rows in ascending order. Columns: part and
row (place in the order), doc_id, n_tokens, inside (ids before it in its part), ids (array<int>,
integer run-length encoding), with the end id 0 after each document. Stripes can be read in
parallel; row indexes and Bloom filters on doc_id let a lookup skip stripes by metadata alone.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated
doc_ids stay separate rows, in order of their texts; extra columns are not written; an empty table
gives files without rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import bounded_batches, buffers, fresh_path, mix64, partitions, slices

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker keeps the ids of; a full cache starts anew, which changes no result.
CACHE_WORDS = 1_000_000
#: Entry of a word with white space at its edge: the tokenizer's own rules then decide the cut.
ODD = -1
MISSING = 0

_state: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """A hash table from nonzero 64-bit keys to entries, probed for many keys at once."""

    def __init__(self, size: int):
        self.count = 0
        self.mask = np.uint64((1 << int(size - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.entries = np.zeros(int(self.mask) + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, MISSING for none."""
        out = np.full(len(keys), MISSING, np.int32)
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.entries[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Add distinct keys that are not there yet; the table doubles before it is more than half full."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            used = self.keys != 0
            keys, entries = np.concatenate([self.keys[used], keys]), np.concatenate([self.entries[used], entries])
            self.__init__(4 * len(keys))
        self.count += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.entries[at] = keys[left[won]], entries[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + 1) & int(self.mask)


_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BYTE[0x20] = 0
_PLACE = mix64(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)
_FIRST = np.uint64(0x5BF03635DEADBEA7)


class Encoder:
    """Whole-text encoding through the tokenizers library, with the ids of words kept.

    The byte-level pre-tokenizer always cuts before a single space between two other characters, so
    the ids of a text are those of its space-led words in a row. Words are known by a 64-bit hash of
    their bytes. Unseen words are encoded together, as one text, whose ids are dealt to the words by
    the bytes that each id stands for. A text with a space next to other white space, or at an edge,
    is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # one character of a byte-level token stands for one byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.reset()

    def reset(self) -> None:
        self.table = Table(1 << 14)
        self.flat = np.array([END_ID], np.int32)  # entry 0 is the end of a document
        self.ends = np.array([0, 1], np.int64)

    def _add(self, words: list[str], led: np.ndarray) -> None:
        """Append the ids of new words, those that are led by a space with it."""
        ids: list = [None] * len(words)
        bare = np.flatnonzero(~led)
        for i, e in zip(bare.tolist(), self.tokenizer.encode_batch_fast([words[i] for i in bare], add_special_tokens=False)):
            ids[i] = np.array(e.ids, np.int32)
        at = np.flatnonzero(led)
        for lo in range(0, len(at), 4096):
            part = at[lo : lo + 4096]
            mine = [words[i] for i in part]
            got = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(mine)], add_special_tokens=False)[0].ids, np.int32)
            until = np.cumsum(self.bytes[got])
            wide = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in mine), np.int64, len(mine)) + 1)
            cut = np.searchsorted(until, wide, "left") + 1
            assert np.array_equal(until[cut - 1], wide), "a token crosses a word's edge"
            for i, a, b in zip(part.tolist(), [0, *cut[:-1].tolist()], cut.tolist()):
                ids[i] = got[a:b]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes with offsets) in a row, each with the end id, and where each text ends."""
        if len(self.ends) > CACHE_WORDS:
            self.reset()
        m = len(offsets) - 1
        filled = offsets[1:] > offsets[:-1]
        # words lie between single spaces; a text without any is one word
        space = np.flatnonzero(raw == 0x20)
        starts = np.zeros(len(raw) + 1, bool)
        starts[offsets[:-1][filled]] = True
        starts[space + 1] = True
        begin = np.flatnonzero(starts[:-1])
        owner = np.repeat(np.arange(m), np.diff(np.searchsorted(begin, offsets)))
        led = begin > offsets[owner]
        odd = np.zeros(m, bool)
        # a space at the very end of a text is at an edge
        closing = offsets[1:][filled] - 1
        odd[np.flatnonzero(filled)[raw[closing] == 0x20]] = True
        size = np.diff(np.append(begin, len(raw))) - 1
        last_of_text = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        size[last_of_text] += 1  # no space behind the last word of a text
        end = begin + size
        if len(begin):
            place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
            longest = int(place.max()) + 1
            weight = _PLACE if longest <= len(_PLACE) else mix64(np.arange(longest, dtype=np.uint64)) | np.uint64(1)
            with np.errstate(over="ignore"):
                key = mix64(np.add.reduceat(_BYTE[raw] * weight[place], begin) + size.astype(np.uint64)) ^ np.where(led, np.uint64(0), _FIRST)
            key[key == 0] = 1
            entry = self.table.find(key)
            new = np.flatnonzero(entry == MISSING)
            if len(new):
                fresh, at = np.unique(key[new], return_index=True)
                at = new[at]
                data = raw.tobytes()
                words = [data[a:b].decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist())]
                plain = np.array([bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words])
                numbers = np.full(len(fresh), ODD, np.int32)
                numbers[plain] = len(self.ends) - 1 + np.arange(plain.sum())
                if plain.any():
                    self._add([w for w, p in zip(words, plain.tolist()) if p], led[at][plain])
                self.table.put(fresh, numbers)
                entry[new] = self.table.find(key[new])
            odd[owner[entry == ODD]] = True
        else:
            entry = np.zeros(0, np.int32)
        flat, start, width = self.flat, self.ends[:-1], np.diff(self.ends)
        which = np.flatnonzero(odd)
        if len(which):
            data = raw.tobytes()
            texts = [data[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in which]
            whole = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, whole), np.int64, len(whole))
            start, width = np.concatenate([start, len(flat) + np.cumsum(n) - n]), np.concatenate([width, n])
            flat = np.concatenate([flat, *whole])
            keep = ~odd[owner]
            entry, owner = np.concatenate([entry[keep], len(self.ends) - 1 + np.arange(len(which))]), np.concatenate([owner[keep], which])
            by = np.argsort(owner, kind="stable")
            entry, owner = entry[by], owner[by]
        count = np.bincount(owner, minlength=m)
        entry = np.insert(entry, np.cumsum(count), 0)
        n = width[entry]
        ids = flat[np.repeat(start[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.cumsum(n)[np.cumsum(count + 1) - 1]


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


_ENCODED = "part int, row long, doc_id long, n_tokens long, inside long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Write docs (doc_id, text) as token files under path, in ascending doc_id order.

    Rows of one doc_id, and those without, are dealt by how their texts begin besides, so they are no single task.
    """
    spark = docs.sparkSession
    tokens = vocabulary_path(vocabulary)

    def encode(batches):
        from pyspark import TaskContext

        part, row, inside = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokens)
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                ids, ends = enc.encode(*buffers(piece.column(1)))
                n = np.diff(ends, prepend=0)
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), piece.column(0).cast(pa.int64()), pa.array(n), pa.array(inside + ends - n), arrays],
                    names=["part", "row", "doc_id", "n_tokens", "inside", "ids"],
                )
                row += len(n)
                inside += int(ends[-1])

    bounded_batches(docs)
    place = [F.col("doc_id").asc_nulls_first(), F.col("head").asc_nulls_first()]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.substring("text", 1, 32).alias("head")).repartitionByRange(partitions(spark), *place)
    ordered = ordered.sortWithinPartitions(place[0], F.col("text").asc_nulls_first()).drop("head")
    (
        ordered.mapInArrow(encode, _ENCODED).write.option("orc.compress", "ZSTD").option("orc.stripe.size", 16 << 20).option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ENCODED).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents (a list that the caller holds): the filter reaches the files, whose stripe and
    row-group statistics and Bloom filters on doc_id tell which row groups to read."""
    return read(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files' ids."""

    def digest(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = read(spark, path)
    rows = files.select("part", "doc_id", "inside", "ids").mapInArrow(digest, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("part").alias("p_part"), ahead.alias("ahead"))
    return rows.join(sums, F.col("part") == F.col("p_part"), "left").select("doc_id", (F.col("ahead") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def write_and_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary)
    return report(docs.sparkSession, path)
