"""Substring dedup over bytes: what a document of smaller doc_id holds as well goes, by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Only repeated places reach a suffix array:

1. Equal texts are one content, of its least doc_id; a later copy goes as a whole.
2. Each window of `length` bytes has as anchor the least-hashed k-mer inside it, which depends on
   the window alone, so equal windows have equal anchors. Windows in a row with one anchor form a
   run (its bytes: the run's string). Runs are dealt by the hash of their anchor.
3. Of equal runs, all but those of the least document are covered as a whole. The others are compared
   only if their anchor stands in several documents with different strings, one of which agrees in
   the bytes next to the anchor on one side (a short hash tells): their bytes are fetched and cut to the windows whose bytes before and behind the anchor another run shares. The strings
   that are left, each once, are joined into blocks and sorted by a suffix array; neighbours that
   agree in `length` bytes are one class, and the members of a class beyond its least document are
   covered.

The suffix array is built by linear grouping (see `suffix_order`). A block holds whole anchors and
about BLOCK_BYTES bytes.

Defined cases: a null text is empty; a null doc_id is larger than all others; documents with equal
doc_ids remove nothing from each other; texts shorter than `length` stay whole; spans are maximal
removed runs of the input; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bounded_batches, buffers, give_back, mix64, partitions, slices, small_side, stored
from inkwell.llm.fingerprints import _BASE, _INVERSE, _power, _sliding_min

LENGTH = 50
LAST = (1 << 63) - 1
BLOCK_BYTES = 60_000
#: Ranges of anchors for each shuffle partition; a task holds the packed runs of one range.
RANGES = 2
#: Bytes of a text that are hashed at once; pieces overlap by the windows' length.
PIECE = 1 << 18


def suffix_order(text: list[int]) -> list[int]:
    """The suffixes of text in ascending order.

    The longest Lyndon word that a suffix starts with reaches up to the next smaller suffix. First the
    suffixes are grouped by that word, in descending order of groups: when the highest group that is
    left is taken, the words of its members are complete, and each member's word is appended to that
    of its previous smaller suffix, which moves to a higher place inside its own group. The pointer to
    the previous smaller suffix is found by jumping over members of groups that are done. Then the
    order inside the groups comes from one pass: the rest of a suffix behind its word is the next
    smaller suffix, which is emitted earlier, and each emitted suffix puts those that it is the rest of
    at the next place of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # groups in ascending order, each with its members
    place = [0] * n  # of a suffix in order
    begin = [0] * n  # of a suffix: where its group begins in order
    size = [0] * n  # of the group that begins there
    first = 0
    for k, s in enumerate(order):
        if text[s] != text[order[first]]:
            first = k
        place[s] = k
        begin[s] = first
        size[first] += 1
    done = [False] * n
    smaller = list(range(-1, n - 1))  # previous smaller suffix, by jumps over what is done
    reach = list(range(1, n + 1))  # where the word of a suffix ends, so far
    end = n
    while end:
        first = begin[order[end - 1]]
        if end - first == 1:
            s = order[first]
            done[s] = True
            p = smaller[s]
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[s] = p
            end = first
            if p >= 0:
                reach[p] = reach[s]
                g = begin[p]
                if size[g] > 1:  # p moves behind the rest of its group
                    size[g] -= 1
                    k = g + size[g]
                    q, a = order[k], place[p]
                    order[a], order[k] = q, p
                    place[q], place[p] = a, k
                    begin[p] = k
                    size[k] = 1
            continue
        group = sorted(order[first:end])
        for s in group:
            done[s] = True
        copies: dict[int, int] = {}
        for s in group:
            p = smaller[s]
            while p >= 0 and done[p]:
                # a member in front has the same word, just before: it has found the owner of both already
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                copies[p] = copies.get(p, 0) + 1
                reach[p] = reach[s]
        end = first
        by_count: dict[int, list[int]] = {}
        for p, c in copies.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):  # of one group, the owners of more copies stand further behind
            moved: dict[int, int] = {}
            for p in by_count[c]:
                g = begin[p]
                m = moved[g] = moved.get(g, 0) + 1
                k = g + size[g] - m
                q, a = order[k], place[p]
                order[a], order[k] = q, p
                place[q], place[p] = a, k
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    new = g + size[g]
                    size[new] = m
                    for k in range(new, new + m):
                        begin[order[k]] = new
    rest: list[list[int]] = [[] for _ in range(n + 1)]
    for s, r in enumerate(reach):
        rest[r].append(s)
    fill = list(range(n))  # next place of the group that begins there
    out = [0] * n
    for s in rest[n]:
        g = begin[s]
        out[fill[g]] = s
        fill[g] += 1
    for k in range(n):
        for s in rest[out[k]]:
            g = begin[s]
            out[fill[g]] = s
            fill[g] += 1
    return out


def anchor_size(length: int) -> int:
    return max(1, length * 2 // 5)


def runs(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of the windows of one text: anchor hash, string hash, first byte, byte after and anchor's place of each run,
    and short hashes of the bytes just before and behind the anchor (0 where the run has too few)."""
    none = np.zeros(0, np.int64)
    found = []
    k = anchor_size(length)
    width = length - k + 1
    for lo in range(0, max(len(raw) - length + 1, 0), PIECE):
        piece = raw[lo : lo + PIECE + length - 1]
        n = len(piece)
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n - 1), out=prefix[1:])
            h = mix64((prefix[k:] - prefix[:-k]) * _power(_INVERSE, n - k))
            # the place in the low bits: of equal hashes the first is the anchor
            ranked = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
            anchor = (_sliding_min(ranked, width) & np.uint64((1 << 21) - 1)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
            last = np.append(first[1:], len(anchor)) - 1 + length
            whole = mix64((prefix[last] - prefix[first]) * _power(_INVERSE, n)[first] + (last - first).astype(np.uint64))
            at, half = anchor[first], (length - k) // 2
            inside = (at - half >= first, at + k + half <= last)
            sides = []
            for begin, ok in zip((at - half, at + k), inside):
                a = np.where(ok, begin, 0)
                side = mix64((prefix[a + half] - prefix[a]) * _power(_INVERSE, n)[a]) >> np.uint64(49) << np.uint64(1) | np.uint64(1)
                sides.append(np.where(ok, side, 0).astype(np.uint16))
        found.append((h[at].view(np.int64), whole.view(np.int64), first + lo, last + lo, at + lo, *sides))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none,) * 7


def block_spans(strings: list[bytes], doc: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string number, first byte, byte after) of what strings of smaller documents hold as well, windows in a row joined."""
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, 0) for s in strings])
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(size + 1) - size - 1
    order = np.array(suffix_order(text.tolist()), np.int64)
    owner = np.repeat(np.arange(len(strings)), size + 1)[order]
    order = order[(order - begin[owner]) + length <= size[owner]]  # suffixes with a whole window
    if not len(order):
        return []
    owner = np.searchsorted(begin, order, "right") - 1
    windows = np.lib.stride_tricks.sliding_window_view(text, length)[order]
    new = np.ones(len(order), bool)
    new[1:] = (windows[1:] != windows[:-1]).any(1)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[owner], np.flatnonzero(new))
    gone = np.sort(order[doc[owner] > least[group]])
    if not len(gone):
        return []
    cut = np.flatnonzero(np.diff(gone, prepend=-2) != 1)
    last = np.append(cut[1:], len(gone)) - 1
    who = np.searchsorted(begin, gone[cut], "right") - 1
    return list(zip(who.tolist(), (gone[cut] - begin[who]).tolist(), (gone[last] - begin[who] + length).tolist()))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, mark, text and covered (array of start, end bytes) of each row of docs (doc_id, text).

    A run has 2 * length - anchor_size(length) bytes at most, and its size is kept in a byte: longer lengths are refused.
    """
    if not 1 <= length or 2 * length - anchor_size(length) > 255:
        raise ValueError("length must be from 1 to 159")
    bounded_batches(docs)
    n = partitions(docs.sparkSession)
    ranges = n * RANGES
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    # a later copy of a content goes as a whole
    content = whole.select("doc", "mark", F.octet_length("text").alias("bytes"), F.crc32(F.col("text").cast("binary")).alias("crc")).where(F.col("bytes") >= length)
    content = stored(content, "suffix-contents")
    first = content.groupBy("mark", "bytes", "crc").agg(F.min("doc").alias("first")).select(F.col("mark").alias("f_mark"), "first")
    copies = content.join(first, F.col("mark") == F.col("f_mark")).where("doc > first")
    copies = stored(copies.select(F.col("doc").alias("c_doc"), F.col("mark").alias("c_mark"), "bytes").distinct(), "suffix-copies")
    own = whole.join(small_side(copies.select("c_doc", "c_mark")), (F.col("doc") == F.col("c_doc")) & (F.col("mark") == F.col("c_mark")), "left_anti").select("doc", "mark", "text")

    def dealt(batches):
        """The runs of a piece, packed for each range of anchors (kind 0); those that a smaller document of the piece covers apart (kind 1)."""
        for batch in batches:
            for piece in slices(batch, "text", 2_000_000):
                raw, offsets = buffers(piece.column(2))
                doc, mark = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                out = [runs(raw[a:b], length) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                row = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
                h, string, start, end, at, before, behind = (np.concatenate([x[j] for x in out]) for j in range(7))
                anchor = (mix64(h.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)  # mixed again: least hashes are small
                table = (anchor, string.view(np.uint64) >> np.uint64(16), doc[row], mark[row], start.astype(np.uint32), ((end - start) << 8 | at - start).astype(np.uint16), before.astype(np.uint16), behind.astype(np.uint16))
                order = np.lexsort((table[2], table[1], anchor))
                new = np.ones(len(order), bool)
                new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (table[1][order][1:] != table[1][order][:-1])
                least = table[2][order][np.flatnonzero(new)][np.cumsum(new) - 1]
                covered = np.zeros(len(order), bool)
                covered[order] = table[2][order] > least
                range_ = ((anchor.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                own_part = np.where(covered, ranges, range_)
                order = np.argsort(own_part, kind="stable")
                parts, first = np.unique(own_part[order], return_index=True)
                blobs = [_pack([c[i] for c in table]) for i in np.split(order, first[1:])] if len(order) else []
                to = np.where(parts == ranges, int(doc[0]) % ranges if len(doc) else 0, parts)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array((parts == ranges).astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    packed = own.mapInArrow(dealt, "part int, kind int, blob binary").repartitionById(ranges, F.col("part")).select("kind", "blob")

    def settled(batches):
        """Runs whose string a smaller document holds are covered; of anchors with several strings and documents, the others go on."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                columns = _unpack(blob.as_py())
                if kind:
                    yield _open_rows(columns, np.ones(len(columns[0]), bool))
                else:
                    held.append(columns)
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            order = np.lexsort((columns[2], columns[1], columns[0]))
            yield from _settle([c[order] for c in columns])
            del columns, order
        give_back()

    # size holds the run's bytes * 256 + the anchor's place in it
    open_ = packed.mapInArrow(settled, "anchor int, doc long, mark long, start int, size int, covered boolean")
    covered = open_.where("covered").select("doc", "mark", F.col("start").cast("long").alias("start"), (F.col("start") + F.shiftright("size", 8)).cast("long").alias("end"))
    wanted = open_.where("not covered").groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("runs"))
    wanted = wanted.select(F.col("doc").alias("w_doc"), F.col("mark").alias("w_mark"), "runs")

    def fetched(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, offsets = buffers(piece.column(2))
                data, lists = raw.tobytes(), piece.column(3)
                count = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().flatten()
                anchor, start, size = (x.to_numpy() for x in flat)
                row = np.repeat(np.arange(piece.num_rows), count)
                lo = offsets[row] + start
                got = [data[a : a + m] for a, m in zip(lo.tolist(), (size >> 8).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row)), pa.array(start), pa.array(size & 255), pa.array(got, pa.binary())], names=["anchor", "doc", "mark", "start", "place", "bytes"])

    # both joins with whole texts read this one exchange
    base = whole.select("doc", "mark", "text").repartition(n, "doc", "mark")
    strings = base.join(wanted, (F.col("doc") == F.col("w_doc")) & (F.col("mark") == F.col("w_mark"))).select("doc", "mark", "text", "runs")
    strings = strings.mapInArrow(fetched, "anchor int, doc long, mark long, start int, place int, bytes binary")
    strings = strings.repartition(n, "anchor").sortWithinPartitions("anchor")

    def sorted_blocks(batches):
        block, out, group, last, total = [], [], [], None, 0
        for batch in batches:
            for r in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if r[0] != last and group:
                    total += _trim(group, length, block, out)
                    group = []
                    if total >= BLOCK_BYTES:
                        yield _block(block, out, length)
                        block, out, total = [], [], 0
                last = r[0]
                group.append(r[1:])
        if group:
            _trim(group, length, block, out)
            yield _block(block, out, length)
        give_back()

    shared = strings.mapInArrow(sorted_blocks, "doc long, mark long, start long, end long")
    copies = copies.select(F.col("c_doc").alias("doc"), F.col("c_mark").alias("mark"), F.lit(0).cast("long").alias("start"), F.col("bytes").cast("long").alias("end"))
    every = covered.union(shared).union(copies).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    every = every.select(F.col("doc").alias("e_doc"), F.col("mark").alias("e_mark"), "covered")
    return base.join(every, (F.col("doc") == F.col("e_doc")) & (F.col("mark") == F.col("e_mark")), "left").select("doc", "text", "covered")


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns anchor, string (48 bits), doc, mark, start, size, before, behind as bytes; docs and marks, which come in runs, once a run."""
    anchor, string, doc, mark, start, size, before, behind = columns
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    wide = string.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    head = np.array([len(anchor), len(new)], np.int64)
    counts = np.diff(np.append(new, len(doc)))
    data = b"".join(np.ascontiguousarray(x).tobytes() for x in (head, doc[new], mark[new], counts, anchor, start, size, before, behind, wide))
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, k = (int(x) for x in np.frombuffer(data, np.int64, 2))
    at, out = 16, []
    for kind, count in ((np.int64, k), (np.int64, k), (np.int64, k), (np.uint32, n), (np.uint32, n), (np.uint16, n), (np.uint16, n), (np.uint16, n), (np.uint8, 6 * n)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    doc, mark, counts, anchor, start, size, before, behind, wide = out
    string = np.zeros((n, 8), np.uint8)
    string[:, :6] = wide.reshape(-1, 6)
    return [anchor, string.view("<u8").ravel(), np.repeat(doc, counts), np.repeat(mark, counts), start, size, before, behind]


def _open_rows(columns: list[np.ndarray], covered: np.ndarray) -> pa.RecordBatch:
    anchor, _, doc, mark, start, size = columns[:6]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int32)), pa.array(doc), pa.array(mark), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(covered)],
        names=["anchor", "doc", "mark", "start", "size", "covered"],
    )


def _settle(columns: list[np.ndarray]):
    anchor, string, doc = columns[:3]
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_string = new_anchor.copy()
    new_string[1:] |= string[1:] != string[:-1]
    at = np.flatnonzero(new_string)
    whole = doc > np.repeat(doc[at], np.diff(np.append(at, len(doc))))
    group = np.cumsum(new_anchor) - 1
    g = np.flatnonzero(new_anchor)
    several = (np.minimum.reduceat(doc, g) != np.maximum.reduceat(doc, g)) & (np.add.reduceat(new_string.astype(np.int64), g) > 1)
    # a window holds half of the bytes before its anchor or half of those behind: another string must share them
    near = np.zeros(len(doc), bool)
    for side in columns[6:]:
        key = anchor.astype(np.uint64) << np.uint64(16) | side
        known, count = np.unique(key[at], return_counts=True)
        near |= (side > 0) & np.isin(key, known[count > 1])
    keep = np.flatnonzero(whole | (several[group] & near))
    for lo in range(0, len(keep), 50_000):
        part = keep[lo : lo + 50_000]
        yield _open_rows([c[part] for c in columns], whole[part])


def _trim(group: list[tuple], length: int, block: list, out: list) -> int:
    """Cut the runs of one anchor (doc, mark, start, place, bytes) to the windows that others may share.

    Of equal cut strings, those beyond the least document are covered: they go to out. The distinct
    strings go to block, as (bytes, least doc, its rows). The number of bytes added is returned.
    """
    k = anchor_size(length)
    span = length - k
    sides = []
    for _, _, _, place, data in group:
        before, behind = data[:place][::-1], data[place + k : place + length]
        sides.append((int.from_bytes(before.ljust(span, b"\xff"), "big"), int.from_bytes(behind.ljust(span, b"\xff"), "big")))
    agree = [[0, 0] for _ in group]
    for side in (0, 1):
        order = sorted(range(len(group)), key=lambda i: sides[i][side])
        for i, j in zip(order, order[1:]):
            same = span - ((sides[i][side] ^ sides[j][side]).bit_length() + 7) // 8
            agree[i][side] = max(agree[i][side], same)
            agree[j][side] = max(agree[j][side], same)
    strings: dict[bytes, list[tuple]] = {}
    for (doc, mark, start, place, data), (before, behind) in zip(group, agree):
        low = max(span - behind, place - (len(data) - length))  # bytes of a window before the anchor
        high = min(before, place)
        if low <= high:
            strings.setdefault(data[place - high : place - low + length], []).append((doc, mark, start + place - high))
    total = 0
    several = len(strings) > 1
    for data, rows in strings.items():
        least = min(r[0] for r in rows)
        out.extend((doc, mark, start, start + len(data)) for doc, mark, start in rows if doc > least)
        if several:
            block.append((data, least, [r for r in rows if r[0] == least]))
            total += len(data)
    return total


def _block(block: list, out: list, length: int) -> pa.RecordBatch:
    if block:
        for i, a, b in block_spans([x[0] for x in block], np.array([x[1] for x in block], np.int64), length):
            out.extend((doc, mark, start + a, start + b) for doc, mark, start in block[i][2])
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc", "mark", "start", "end"])


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def digest(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                raw, offsets = buffers(piece.column(1))
                data, out = raw.tobytes(), []
                for i, (doc, cover) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    merged = merge([(c["start"], c["end"]) for c in cover or []])
                    kept, last = hashlib.sha256(), lo
                    for a, b in merged:
                        kept.update(data[last : lo + a])
                        last = lo + b
                    kept.update(data[last:hi])
                    out.append((None if doc == LAST else doc, hi - lo, sum(b - a for a, b in merged), len(merged), kept.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string()])], names=[x.split()[0] for x in _REPORT.split(", ")])

    return spans(docs, length).mapInArrow(digest, _REPORT)


def merge(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    out: list[list[int]] = []
    for a, b in sorted(cover):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
