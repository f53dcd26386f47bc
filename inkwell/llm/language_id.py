"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores.

The model has, for each language of the training rows, log-probabilities of letter trigrams (hashed
into BUCKETS, with word edges) and the scripts that its letters use. A word's candidates are the
languages that use its script; its score for each is the sum over its letters. Viterbi with a
switching penalty labels the words, so spans of another language come out as spans; the language
that covers most letters is the document's.

The model is fitted on a bounded sample: about `sample` training documents a language, chosen by a
hash of doc_id, whole texts. Everything else covers all rows.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where
no language was learned; letters of a script that no language uses leave all candidates; repeated
rows get equal labels; null doc_ids are held out; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bounded_batches, slices, small_side, stored

SAMPLE = 2000
BUCKETS = 1 << 15
PENALTY = 8.0
SMOOTHING = 0.5
#: A language uses a script if so large a part of its letters is of it.
SCRIPT_SHARE = 0.01
NOT_CANDIDATE = -1e4
UNKNOWN = "und"
#: Code points whose letters are scored at once, and bytes of text whose words are labelled side by side.
PIECE_POINTS = 200_000
SIDE_BY_SIDE = 1_000_000

# First code points of script ranges and the script from there on (Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_tables: dict = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case where that is one code point."""
    if not _tables:
        size = sys.maxunicode + 1
        letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(size)), bool, size)
        lower = np.arange(size, dtype=np.uint32)
        for i in np.flatnonzero(letter):
            low = chr(i).lower()
            if len(low) == 1:
                lower[i] = ord(low)
        _tables["letter"], _tables["lower"] = letter, lower
    return _tables["letter"], _tables["lower"]


class Words:
    """The words with letters of some texts, and the trigram bucket of each letter."""

    def __init__(self, texts: list[str]):
        letter, lower = _letters()
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths + 1) - lengths - 1
        is_letter = letter[points]
        low = np.where(is_letter, lower[points], 0).astype(np.uint64)
        at = np.flatnonzero(is_letter)
        padded = np.zeros(len(low) + 2, np.uint64)
        padded[1:-1] = low
        with np.errstate(over="ignore"):
            h = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (h >> np.uint64(64 - 15)).astype(np.int64)
        self.script = _SCRIPT[np.searchsorted(_STARTS, points[at], "right") - 1]
        space = np.isin(points, np.array([0x20, 9, 10, 11, 12, 13, 0xA0, 0x3000], np.uint32))
        token = np.cumsum(space)[at]  # letters between two white spaces are one word
        self.first = np.flatnonzero(np.diff(token, prepend=-1)) if len(at) else np.zeros(0, np.int64)
        self.letters = np.diff(np.append(self.first, len(at)))
        self.place = at[self.first]  # the word's first letter among the joined code points
        self.last = at[np.append(self.first[1:], len(at)) - 1] + 1 if len(at) else self.place
        self.row = np.searchsorted(begin, self.place, "right") - 1
        self.begin = begin
        self.row_first = np.searchsorted(self.row, np.arange(len(texts) + 1))


def _pieces(texts: list[str], most: int = PIECE_POINTS):
    """Ranges of texts with at most so many code points in all, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32) if len(languages) else np.zeros((0, BUCKETS), np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        uses = share >= SCRIPT_SHARE
        uses[:, ~uses.any(0)] = True
        self.uses = uses

    def scores(self, words: Words) -> np.ndarray:
        """words x languages: log-likelihood, far down for languages that do not use the word's script."""
        out = np.empty((len(words.first), len(self.languages)), np.float32)
        script = words.script[words.first] if len(words.first) else words.first
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.log[k][words.bucket], words.first) if len(words.first) else 0
            out[~self.uses[k][script], k] += NOT_CANDIDATE
        return out

    def path(self, scores: np.ndarray, row_first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The language of each word, for all rows side by side, one word of each at a time."""
        n, langs = scores.shape
        label = np.zeros(n, np.int64)
        count = np.diff(row_first)
        order = np.argsort(-count, kind="stable")
        order = order[count[order] > 0]
        if not len(order):
            return label
        first, left = row_first[:-1][order], count[order]
        steps = int(left[0])
        active = np.searchsorted(-left, -np.arange(steps), "left")  # rows of more than t words
        value = scores[first].astype(np.float64)
        stay = np.ones((n, langs), bool)
        from_ = np.zeros(n, np.int16)
        final = np.empty((len(order), langs))
        for t in range(1, steps):
            a = active[t]
            if a < len(value):
                final[a : len(value)] = value[a:]
                value = value[:a]
            best = value.argmax(1)
            jump = value[np.arange(a), best] - penalty
            keeps = value >= jump[:, None]
            at = first[:a] + t
            stay[at], from_[at] = keeps, best
            value = np.where(keeps, value, jump[:, None]) + scores[at]
        final[: len(value)] = value
        state = final.argmax(1)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            at = first[:a] + t
            label[at] = state[:a]
            if t:
                state[:a] = np.where(stay[at, state[:a]], state[:a], from_[at])
        return label

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first code point, code point after, language) of each text."""
        none = (UNKNOWN, 0.0, [])
        if not self.languages:
            return [none] * len(texts)
        # letters are scored a piece at a time; only words are held for all texts
        row, letters, begin_at, end_at, scores = [], [], [], [], []
        for lo, hi in _pieces(texts):
            words = Words(texts[lo:hi])
            row.append(words.row + lo)
            letters.append(words.letters)
            begin_at.append(words.place - words.begin[words.row])
            end_at.append(words.last - words.begin[words.row])
            scores.append(self.scores(words))
            del words
        if not sum(map(len, row)):
            return [none] * len(texts)
        row, letters, begin_at, end_at, scores = (np.concatenate(x) for x in (row, letters, begin_at, end_at, scores))
        path = self.path(scores, np.searchsorted(row, np.arange(len(texts) + 1)))
        m, langs = len(texts), len(self.languages)
        cover = np.bincount(row * langs + path, letters, m * langs).reshape(m, langs)
        total = np.stack([np.bincount(row, scores[:, k], m) for k in range(langs)], 1)
        best = np.lexsort((total, cover), axis=1)[:, -1]  # most letters, ties by likelihood
        odds = np.exp(np.minimum(total - total.max(1, keepdims=True), 0))
        odds /= odds.sum(1, keepdims=True)
        cut = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        spans: list[list] = [[] for _ in texts]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(path)]):
            spans[row[a]].append((int(begin_at[a]), int(end_at[b - 1]), self.languages[path[a]]))
        out = []
        for i in range(m):
            letters = cover[i].sum()
            if not letters:
                out.append(none)
                continue
            k = int(best[i])
            share = cover[i, k] / letters
            out.append((self.languages[k], float(share * (0.5 + 0.5 * odds[i, k])), spans[i]))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out (doc_id, text, lang)."""
    bounded_batches(docs)
    train = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = train.groupBy("lang").count()
    rate = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    sizes = small_side(stored(sizes.select(F.col("lang").alias("s_lang"), rate.alias("s_rate")), "language-sizes", 1))  # a row for each value of lang
    chosen = train.join(sizes, F.col("lang") == F.col("s_lang"))
    chosen = chosen.where(F.abs(F.xxhash64("doc_id") % 1_000_003) < F.col("s_rate") * 1_000_003).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(piece.column(1).to_pylist())
                lang = np.array(piece.column(0).to_pylist(), object)
                by_letter = np.repeat(words.row, words.letters)
                for name in sorted(set(lang)):
                    mine = (lang == name)[by_letter]
                    have = total.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                    have[:BUCKETS] += np.bincount(words.bucket[mine], minlength=BUCKETS)
                    have[BUCKETS:] += np.bincount(words.script[mine], minlength=len(_NAMES))
        for name, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["lang", "feature", "n"])

    rows = chosen.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    table = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    table[[languages.index(x) for x in rows["lang"]], rows["feature"].to_numpy(np.int64)] = rows["n"]
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def label(docs: DataFrame, model: Model, spans: bool = False, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and, if asked for, lang_spans (array of start, end, lang in code points).

    A prefix keeps the new names apart from columns that docs has; one of the same name is replaced.
    """
    bounded_batches(docs)
    docs = docs.drop(f"{prefix}lang_pred", f"{prefix}score", *[f"{prefix}lang_spans"] * spans)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index("text")
    from pyspark.sql import types as T

    kinds = T.StructType([*docs.schema, T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    if spans:
        kinds = T.StructType([*kinds, T.StructField(f"{prefix}lang_spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def labelled(batches):
        for batch in batches:
            for piece in slices(batch, "text", SIDE_BY_SIDE):
                found = sent.value.label([t or "" for t in piece.column(k).to_pylist()])
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    more.append(pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], arrow_span))
                yield pa.RecordBatch.from_arrays([*piece.columns, *more], names=kinds.names)

    return docs.mapInArrow(labelled, kinds)
