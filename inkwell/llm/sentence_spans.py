"""Substring dedup by sliding sentence spans.

A text is cut into sentences: words up to one that ends in a mark of STOPS or that a line break follows.
What repeats are runs of several consecutive sentences (`least_sentences` of them at least, of any number
of words). Of equal runs the first (least doc_id, then first in the text) stays; every sentence that
another one covers is removed. A longer run is covered by the runs of just `least_sentences` inside it,
which repeat where it does and are first where it is at the latest; so hashing all of those, on their
lower-cased words, finds just what hashing all runs would find.

Texts without stops have sentences too: one of LONG_WORDS words or more is cut into pieces, each a
sentence of its own, after every word whose hash is the least of PIECE_WORDS neighbours in it. Equal
sentences are cut alike, and so is an equal passage of them but for PIECE_WORDS - 1 words at its edges.

Options: `least_words` asks for so many words in a run (the runs are then the shortest ones from each
sentence and, with `every_run`, to each sentence, which cover all longer ones); `stops` are the marks;
without `every_run` only runs from each sentence are hashed and long sentences stay whole.

Defined cases: a null text stays null and has no sentences; null doc_ids come last; rows of one
doc_id count as one document and keep what they share with each other, but a repeat inside one text
goes; white space after a removed sentence goes with it; an empty table gives an empty result;
columns of any name are kept, but one that is called like a column of the result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import bounded_batches, buffers, mix64, slices, stored, word_hashes, word_spans

LEAST_WORDS = 0
LEAST_SENTENCES = 3
#: Sentences of so many words are cut into pieces.
LONG_WORDS = 20
PIECE_WORDS = 8
# Marks that end a sentence, and those of other scripts, which are longer than a byte.
STOPS = ".!?"
WIDE_STOPS = "。！？।؟۔"
_BASE = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
LAST = (1 << 63) - 1


def ends_with(raw: np.ndarray, end: np.ndarray, marks: str) -> np.ndarray:
    """Whether the bytes before each end are one of the marks."""
    out = np.zeros(len(end), bool)
    for mark in marks:
        code = mark.encode()
        there = end >= len(code)
        for k, byte in enumerate(reversed(code)):
            there &= raw[np.maximum(end - 1 - k, 0)] == byte
        out |= there
    return out


def piece_ends(words: np.ndarray, last: np.ndarray, long_words: int) -> np.ndarray:
    """Last words of the sentences and, within those of long_words words or more, of their pieces."""
    begin = np.append(0, last[:-1] + 1)
    size = last + 1 - begin
    long = np.flatnonzero(size >= max(long_words, PIECE_WORDS))
    if not len(long):
        return last
    # the windows of PIECE_WORDS words of each long sentence; the last of equal least hashes counts
    n = size[long] - PIECE_WORDS + 1
    at = np.repeat(begin[long], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    best = at
    for k in range(1, PIECE_WORDS):
        best = np.where(words[at + k] <= words[best], at + k, best)
    return np.union1d(last, best)


class Cut:
    """The sentences and spans of a piece of a batch."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, least_words: int, least_sentences: int, every_run: bool = True, stops: str = STOPS):
        start, end, first = word_spans(raw, offsets)
        self.n_rows = len(offsets) - 1
        n = len(start)
        row = np.repeat(np.arange(self.n_rows), np.diff(first))
        lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        stop = np.zeros(n, bool)
        if n:
            stop = ends_with(raw, end, stops + WIDE_STOPS)
            stop[:-1] |= lines[start[1:]] > lines[end[:-1]]
            stop[first[1:][np.diff(first) > 0] - 1] = True
        #: sentences: first word, first byte, byte after (white space that follows included), row
        last = np.flatnonzero(stop)
        words = word_hashes(raw, start, end)
        if every_run and n:
            last = piece_ends(words, last, LONG_WORDS)
        self.word = np.concatenate([[0], last[:-1] + 1]) if n else np.zeros(0, np.int64)
        self.row = row[last] if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.row, np.arange(self.n_rows + 1))
        self.begin = start[self.word] if n else np.zeros(0, np.int64)
        m = len(self.word)
        self.until = np.append(self.begin[1:], len(raw)) if m else self.begin
        if m:
            edge = offsets[1:][self.row]
            self.until = np.minimum(self.until, edge)
        # spans: [lo, hi) sentences, where they fit in the row, in order of the text
        ends = np.append(self.word[1:], n) if m else self.word
        each = np.arange(m)
        reach = np.searchsorted(ends, self.word + least_words, "left") + 1
        hi = np.maximum(reach, each + least_sentences)
        ok = hi <= self.first[1:][self.row]
        self.lo, self.hi = each[ok], hi[ok]
        if every_run:
            lo = np.minimum(np.searchsorted(self.word, ends - least_words, "right") - 1, each + 1 - least_sentences)
            ok = lo >= self.first[:-1][self.row]
            ok[ok] = hi[lo[ok]] != each[ok] + 1  # else it is the span from there
            lo, hi = np.append(self.lo, lo[ok]), np.append(self.hi, each[ok] + 1)
            by = np.lexsort((hi, lo))
            self.lo, self.hi = lo[by], hi[by]
        self.first_span = np.searchsorted(self.lo, self.first)
        self.hash = np.zeros(len(self.lo), np.uint64)
        if len(self.lo):
            with np.errstate(over="ignore"):
                power = np.full(n, _BASE, np.uint64)
                power[0] = 1
                power = np.multiply.accumulate(power)
                back = np.full(n, _INVERSE, np.uint64)
                back[0] = 1
                back = np.multiply.accumulate(back)
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
                a, b = self.word[self.lo], ends[self.hi - 1]
                self.hash = mix64((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS, least_sentences: int = LEAST_SENTENCES, every_run: bool = True, stops: str = STOPS) -> DataFrame:
    """docs with the text cleaned, and span_sentences, span_removed (sentences), span_cuts (start:end in bytes, comma-joined)."""
    docs = docs.drop("span_sentences", "span_removed", "span_cuts")
    bounded_batches(docs)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("s_doc")
    narrow = docs.select(key, F.col(text_column).alias("s_text"))

    def spans(batches):
        for batch in batches:
            for piece in slices(batch, "s_text"):
                cut = Cut(*buffers(piece.column(1)), least_words, least_sentences, every_run, stops)
                ids = piece.column(0).to_numpy()[cut.row[cut.lo]]
                # a span counts once a document here: repeats within one merge before the shuffle
                h = cut.hash.view(np.int64)
                order = np.lexsort((h, ids))
                keep = np.ones(len(order), bool)
                keep[1:] = (h[order][1:] != h[order][:-1]) | (ids[order][1:] != ids[order][:-1])
                order = order[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h[order]), pa.array(ids[order])], names=["s_hash", "s_doc"])

    each = stored(narrow.mapInArrow(spans, "s_hash long, s_doc long"), "sentence-spans")
    # partial minima and maxima merge a hot span's rows before the shuffle
    repeated = each.groupBy("s_hash").agg(F.min("s_doc").alias("s_low"), F.max("s_doc").alias("s_high")).where("s_low < s_high")
    repeated = repeated.select(F.col("s_hash").alias("r_hash"), "s_low")
    gone = each.join(repeated, (F.col("s_hash") == F.col("r_hash")) & (F.col("s_doc") != F.col("s_low"))).select("s_doc", "s_hash")
    gone = gone.groupBy(F.col("s_doc").alias("__span_gone")).agg(F.collect_list("s_hash").alias("__span_hashes"))
    fields = [f.name for f in docs.schema]
    joined = docs.withColumn("__span_doc", key).join(gone, F.col("__span_doc") == F.col("__span_gone"), "left").drop("__span_doc", "__span_gone")
    schema = T.StructType([*docs.schema, T.StructField("span_sentences", T.LongType()), T.StructField("span_removed", T.LongType()), T.StructField("span_cuts", T.StringType())])
    k = fields.index(text_column)

    def cleaned(batches):
        for batch in batches:
            for piece in slices(batch, text_column):
                texts, cuts, removed = [], [], []
                raw, offsets = buffers(piece.column(k))
                cut = Cut(raw, offsets, least_words, least_sentences, every_run, stops)
                marked = piece.column(len(fields))
                null = piece.column(k).is_null().to_pylist()
                for i in range(piece.num_rows):
                    a, b = int(cut.first[i]), int(cut.first[i + 1])
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    mine = slice(int(cut.first_span[i]), int(cut.first_span[i + 1]))
                    h = cut.hash[mine]
                    later = np.ones(len(h), bool)  # a repeat inside the text, past its first
                    later[np.unique(h, return_index=True)[1]] = False
                    flagged = marked[i].as_py() if marked[i].is_valid else None
                    out = later | np.isin(h.view(np.int64), flagged) if flagged else later
                    cover = np.zeros(b - a + 1, np.int64)
                    np.add.at(cover, cut.lo[mine][out] - a, 1)
                    np.add.at(cover, cut.hi[mine][out] - a, -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    removed.append(int(covered.sum()))
                    kept, last, here = [], lo, []
                    if removed[-1]:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                            s, e = int(cut.begin[a + x]), int(cut.until[a + y - 1])
                            kept.append(raw[last:s].tobytes())
                            here.append(f"{s - lo}:{e - lo}")
                            last = e
                    kept.append(raw[last:hi].tobytes())
                    texts.append(None if null[i] else b"".join(kept).decode("utf-8", "replace"))
                    cuts.append(",".join(here))
                columns = [piece.column(j) for j in range(len(fields))]
                columns[k] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cut.first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(cuts, pa.string())], names=schema.names)

    return joined.select(*[F.col(f) for f in fields], "__span_hashes").mapInArrow(cleaned, schema)
