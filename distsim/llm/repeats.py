"""Repeated passages by common-prefix interval trees over partitioned suffix arrays.

A byte of a document goes if a string of ``least`` bytes that covers it also starts in a
document with a smaller id. The strings are found as maximal repeats: the lcp-intervals of an
enhanced suffix array, scanned with a stack, whose occurrences differ in the byte before them.
A maximal repeat gives all its occurrences at once, so those outside its smallest document
are covered without any pair being formed.

A suffix array of a corpus does not fit one task, so suffixes are dealt by anchors. Of each
``least`` bytes in a row the ``GRAM``-byte string of smallest hash is an anchor (all of them,
if several tie), so equal strings have equal anchors and every string of that length has one.

1. Anchors' hashes, packed, are dealt to buckets; the anchors that occur in two documents or
   more are answered to their documents, about a twentieth of the bytes being anchors.
2. Of these anchors, each with up to ``least - GRAM`` bytes on either side (its context), the
   ones with equal contexts in an Arrow batch are reduced at once: documents other than the
   smallest are covered there. The rest are dealt by anchor. A task sorts the contexts, merges
   equal ones, and builds the suffix array of the contexts that share an anchor, of those
   suffixes only that can reach the length with what the neighbors in sorted order share.
   All strings that match share an anchor, so no match is split between tasks.
3. An anchor found more often than ``hot`` times, and so the passages that a large part of all
   documents holds, is dealt by single strings instead, again after reducing equal ones in
   each batch; a task then gets at most one row a batch for each such string. At most
   ``HOT_KEYS`` hashes are held back that way and sent to the tasks.

Covered spans are united by document. Bytes are compared, not their hashes; a collision of
hashes costs work, never a wrong answer.

Edges: a null text is an empty one. A row without id is left whole and takes nothing from
others. Rows that share an id are each judged alone, against smaller ids; equal rows give
equal results. Text shorter than ``least`` bytes is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_rows, stored, values

LEAST = 50
GRAM = 16
SEGMENT = 1 << 20
BUCKET_BYTES = 16 << 20
SLICE_BYTES = 16 << 20
PACKED_BYTES = 8 << 20
GROUP_DOCS = 256
HOT = 50_000
HOT_KEYS = 1_000_000
ENTRIES = 1 << 16
_PACK, _LOOSEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


# --- anchors -------------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = pick(x[:-size], x[size:]), 2 * size
    rest = width - size
    return pick(x[:-rest], x[rest:]) if rest else x


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[:len(data)] = data
    words = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k:k + (len(words) - k + 7) // 8 * 8]
        words[k::8] = part.view("<u8")[:len(words[k::8])]
    h = (words[:n] * _A) ^ (words[8:n + 8] * _B)
    h ^= h >> np.uint64(31)
    h *= _C
    h ^= h >> np.uint64(30)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors in documents laid end to end, ``ends`` their ends.

    Anchors do not cross documents. Work is done in segments, so memory is bounded whatever
    the length of a document.
    """
    width, margin = least - GRAM + 1, 2 * least
    places, keys = [], []
    for at in range(0, len(data), SEGMENT):
        lo, hi = max(0, at - margin), min(len(data), at + SEGMENT + margin)
        if hi - lo < least:
            continue
        h = _hashes(data[lo:hi])
        order = (h >> np.uint64(32)).astype(np.uint32)
        inner = ends[np.searchsorted(ends, lo, "right"):np.searchsorted(ends, hi, "left")] - lo
        for k in range(1, GRAM):
            cut = inner - k
            order[cut[(cut >= 0) & (cut < len(order))]] = np.iinfo(np.uint32).max
        low = _sliding(order, width, np.minimum)
        edge = np.zeros(width - 1, np.uint32)
        top = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
        found = np.flatnonzero((top == order) & (order != np.iinfo(np.uint32).max))
        found = found[(found + lo >= at) & (found + lo < at + SEGMENT)]
        places.append(found + lo)
        keys.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(keys)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * _B
    return keys ^ (keys >> np.uint64(32))


class _Texts:
    """The texts of an Arrow column laid end to end, without a Python object for each."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[at[0]:at[-1]] if len(at) else whole[:0]
        self.starts, self.ends = at[:-1] - at[0], at[1:] - at[0]
        self._padded = None

    def padded(self, side: int) -> np.ndarray:
        """All bytes, with ``side`` zeros at both ends, made once."""
        if self._padded is None:
            self._padded = np.pad(self.data, side)
        return self._padded

    def of(self, places: np.ndarray) -> np.ndarray:
        """Number of the text at each place."""
        return np.searchsorted(self.ends, places, "right")


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return _PACK.compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    raw = _LOOSEN.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        dtype = np.dtype(t)
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket, positions in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)


_DEALT = "kind int, bucket long, blob binary"
ANSWER, DEALT, HOT_KEY = 0, 1, 2


def _rows(kind: list, bucket: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())],
        ["kind", "bucket", "blob"])


def _sorted_out(table: pa.Table) -> tuple[list[pa.RecordBatch], list[bytes]]:
    """(rows of answers that pass through, values of the rows that are dealt)."""
    of = table.column("kind")
    kept = table.filter(pyarrow.compute.equal(of, ANSWER)).select(["kind", "bucket", "blob"])
    dealt = table.filter(pyarrow.compute.equal(of, DEALT)).column("blob").to_pylist()
    return kept.to_batches(), dealt


def _sliced(items: np.ndarray, start: np.ndarray) -> pa.Array:
    """Rows of an array as binary values, each from one start to the next."""
    data = np.ascontiguousarray(items)
    step = data.nbytes // max(len(data), 1)
    ends = np.append(start, len(data)).astype(np.int64) * step
    large = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return large.cast(pa.binary())


def _owned(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, items) of a column of binary values, each of some 32-bit numbers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    items = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.uint32)
    return np.repeat(np.arange(len(column)), np.diff(ends) // 4), items.astype(np.int64)


def _grouped(groups: int, doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Answers to documents, as one row for each group of documents."""
    key = _mixed(doc.astype(np.uint64)) % np.uint64(groups)
    order = np.lexsort((*columns[::-1], doc, key))
    which, blobs = [], []
    for part in np.split(order, _runs(key[order])[1:]) if len(order) else []:
        which.append(int(key[part[0]]))
        blobs.append(_packed(np.diff(doc[part], prepend=0), *(c[part] for c in columns)))
    return _rows([ANSWER] * len(which), which, blobs)


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, so many at a time that a column has about ``limit`` bytes."""
    ends = np.cumsum(pyarrow.compute.fill_null(pyarrow.compute.binary_length(
        batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _repeated(docs: DataFrame, least: int, buckets: int, groups: int, hot: int) -> DataFrame:
    """Rows (kind, bucket, blob): places of repeated anchors, and hashes of hot ones."""

    def gather(batches):
        for batch in (x for whole in batches for x in _slices(whole, "text", SLICE_BYTES)):
            texts = _Texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            place, key = anchors(texts.data, texts.ends, least)
            number = texts.of(place)
            place = place - texts.starts[number]
            key = _mixed(key)
            # Anchors that two documents of the batch share need no answer from others, but
            # others may from them: one row for the smallest document and one for another.
            order = np.lexsort((ids[number], key))
            start = _runs(key[order])
            size = np.diff(np.append(start, len(order)))
            first, last = ids[number[order[start]]], ids[number[order[start + size - 1]]]
            several = np.repeat(first < last, size)
            told = order[several]
            yield _grouped(groups, ids[number[told]], place[told].astype(np.uint32))
            alone = order[~several]
            shared = start[first < last]
            own = [np.ones(len(alone), np.uint32), size[first < last].astype(np.uint32)]
            at = np.concatenate([alone, order[shared]])
            count, multi = np.concatenate(own), np.repeat([0, 1], [len(alone), len(shared)])
            # In the order of the text, so that places and ids are small steps.
            back = np.argsort(at, kind="stable")
            at, count, multi = at[back], count[back], multi[back]
            which, blobs = [], []
            for b, part in _parts(_bucket(key[at], buckets)):
                row = at[part]
                doc = ids[number[row]]
                new = np.append(True, doc[1:] != doc[:-1])
                step = np.where(new, place[row], np.diff(place[row], prepend=0))
                blobs.append(_packed(key[row].astype(np.uint32), step.astype(np.int32),
                                     np.diff(doc, prepend=0), count[part],
                                     multi[part].astype(np.uint8), new.astype(np.uint8)))
                which.append(b)
            yield _rows([DEALT] * len(which), which, blobs)

    def answer(table: pa.Table) -> pa.Table:
        out, dealt = _sorted_out(table)
        fields = [[] for _ in range(5)]
        for blob in dealt:
            key, step, doc, count, multi, new = _unpacked(
                blob, np.uint32, np.int32, np.int64, np.uint32, np.uint8, np.uint8)
            # Steps start anew with each document: take off what went before it.
            place = np.cumsum(step, dtype=np.int64)
            first = np.flatnonzero(new)
            place -= np.repeat(place[first] - step[first], np.diff(np.append(first, len(new))))
            for field, x in zip(fields, (key, np.cumsum(doc), place, count, multi)):
                field.append(x)
        if not dealt:
            return pa.Table.from_batches(out)
        key, doc, place, count, multi = (np.concatenate(f) for f in fields)
        order = np.lexsort((doc, key))
        start = _runs(key[order])
        size = np.diff(np.append(start, len(order)))
        several = (doc[order[start]] < doc[order[start + size - 1]]) | (
            np.maximum.reduceat(multi[order], start) > 0)
        total = np.add.reduceat(count[order].astype(np.int64), start)
        asked = order[np.repeat(several, size)]
        asked = asked[multi[asked] == 0]
        frequent = key[order[start[total > hot]]].astype(np.uint64)
        if len(asked):
            out.append(_grouped(groups, doc[asked], place[asked].astype(np.uint32)))
        if len(frequent):
            bucket = np.uint64(table.column("bucket")[0].as_py())
            out.append(_rows([HOT_KEY], [0], [_packed(bucket << np.uint64(32) | frequent)]))
        return pa.Table.from_batches(out, _rows([], [], []).schema)

    # Answers known at once pass through the same shuffle, so that nothing is stored twice.
    dealt = docs.select("doc_id", "text").mapInArrow(gather, _DEALT)
    return stored(dealt.groupBy("bucket").applyInArrow(answer, _DEALT))


def _places(answers: DataFrame) -> DataFrame:
    """(doc_id, places) from the answers of :func:`_repeated`."""

    def gather(table: pa.Table) -> pa.Table:
        doc, place = _unpacked_all(table, np.uint32)
        order = np.lexsort((place, doc))
        doc = doc[order]
        start = _runs(doc)
        return pa.table({"doc_id": pa.array(doc[start]), "places": _sliced(place[order], start)})

    return answers.groupBy("bucket").applyInArrow(gather, "doc_id long, places binary")


def _spans(answers: DataFrame) -> DataFrame:
    """(doc_id, tag, spans), spans united."""

    def gather(table: pa.Table) -> pa.Table:
        doc, tag, start, end = _unpacked_all(table, np.int64, np.int64, np.int64)
        order = np.lexsort((end, start, tag, doc))
        doc, tag, start, end = doc[order], tag[order], start[order], end[order]
        head = _starts_of(doc, tag)
        own, a, b = _united_by(head, start, end)
        return pa.table({"doc_id": pa.array(doc[head]), "tag": pa.array(tag[head]),
                         "spans": _sliced(np.stack([a, b], axis=1), _runs(own))})

    return answers.groupBy("bucket").applyInArrow(gather, "doc_id long, tag long, spans binary")


def _unpacked_all(table: pa.Table, *types) -> list[np.ndarray]:
    """Documents and columns of all values of :func:`_grouped`."""
    parts = [_unpacked(x, np.int64, *types) for x in table.column("blob").to_pylist()]
    return [np.concatenate([np.cumsum(p[0]) for p in parts]),
            *(np.concatenate([p[k] for p in parts]) for k in range(1, len(types) + 1))]


# --- contexts ------------------------------------------------------------------------


class _Contexts:
    """Anchors with what stands around them, by row: bytes, lengths, document and place.

    ``text`` has the left part, the anchor and the right part, filled up with zeros where a
    document ends; ``left`` and ``right`` are the lengths there are.
    """

    def __init__(self, least: int, text, left, right, doc, tag, place):
        self.side, self.least = least - GRAM, least
        self.text, self.left, self.right = text, left, right
        self.doc, self.tag, self.place = doc, tag, place

    def take(self, at) -> _Contexts:
        return _Contexts(self.least, *(x[at] for x in (
            self.text, self.left, self.right, self.doc, self.tag, self.place)))

    def sort_keys(self) -> np.ndarray:
        """Anchor, right part, left part from its end, lengths: the order of the suffixes."""
        s = self.side
        full = np.empty((len(self.text), self.text.shape[1] + 2), np.uint8)
        full[:, :GRAM + s] = self.text[:, s:]
        full[:, GRAM + s:-2] = self.text[:, :s][:, ::-1]
        full[:, -2], full[:, -1] = self.left, self.right
        return full

    def spans(self, which: np.ndarray):
        """(doc, tag, start, end) of the whole contexts of some rows."""
        return (self.doc[which], self.tag[which], self.place[which] - self.left[which],
                self.place[which] + GRAM + self.right[which])


def _contexts(least: int, texts: _Texts, ids, tags, number, place) -> _Contexts:
    """Contexts of the anchors at ``place`` (in their text) of the texts ``number``."""
    side = least - GRAM
    at = texts.starts[number] + place
    left = np.minimum(place, side)
    right = np.minimum(texts.ends[number] - at - GRAM, side)
    text = np.lib.stride_tricks.sliding_window_view(texts.padded(side), GRAM + 2 * side)[at]
    for short, cols in ((left, np.arange(-side, 0)), (right, np.arange(1, side + 1))):
        some = np.flatnonzero(short < side)
        part = text[some, :side] if cols[0] < 0 else text[some, side + GRAM:]
        part = np.where(np.abs(cols)[None, :] <= short[some, None], part, 0)
        if cols[0] < 0:
            text[some, :side] = part
        else:
            text[some, side + GRAM:] = part
    return _Contexts(least, text, left.astype(np.int16), right.astype(np.int16),
                     ids[number], tags[number], place)


def _order(rows: np.ndarray) -> np.ndarray:
    """Positions of byte rows in lexicographic order."""
    rows = np.ascontiguousarray(rows)
    return np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")


def _reduced(c: _Contexts):
    """(rows still to be searched, their groups' starts, spans of all others).

    Rows come sorted, with equal contexts in a group; those outside the group's smallest
    document are covered whole, if the context is long enough.
    """
    keys = c.sort_keys()
    order = _order(keys)
    c, keys = c.take(order), keys[order]
    start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    size = np.diff(np.append(start, len(keys)))
    low = np.repeat(np.minimum.reduceat(c.doc, start), size)
    enough = c.left + c.right + GRAM >= c.least
    later = c.doc > low
    spans = c.spans(np.flatnonzero(later & enough))
    group = np.repeat(np.arange(len(start)), size)[~later]
    return c.take(np.flatnonzero(~later)), _runs(group), spans


def _shared(rows: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Longest prefix of each row of sorted byte rows that a neighbor shares.

    ``fresh`` marks the rows where another group begins; neighbors are of one group.
    """
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.where(fresh[1:], -1, common)
    return np.maximum(np.append(-1, common), np.append(common, -1))


def _intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(lcp, first, last) of the lcp-intervals of a run of suffixes, by a stack.

    ``lcp[k]`` is what suffixes k and k + 1 share.
    """
    stack: list[tuple[int, int]] = []
    for k, value in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, k
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _search(c: _Contexts, start: np.ndarray):
    """Spans of rows of :func:`_reduced` that a maximal repeat with smaller ids covers."""
    side, least = c.side, c.least
    one = c.take(start)  # one row for each context
    anchor = one.text[:, side:side + GRAM]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]).any(axis=1))
    kgram = np.cumsum(fresh) - 1
    right = np.minimum(_shared(one.text[:, side + GRAM:], fresh), one.right)
    back = np.ascontiguousarray(one.text[:, :side][:, ::-1])
    by_left = np.lexsort((_rank(back), kgram))
    left = np.empty(len(start), np.int64)
    left[by_left] = _shared(back[by_left], np.append(True, np.diff(kgram[by_left]) != 0))
    left = np.minimum(left, one.left)
    # A string with l bytes before the anchor has side - l bytes after it.
    lo, hi = np.maximum(side - right, 0), left
    count = np.where((right >= 0) & (left >= 0), np.maximum(hi - lo + 1, 0), 0)
    begin = np.full(len(start), 1 << 30)
    end = np.full(len(start), -1)
    # Whole anchors at a time, so that the suffixes that can match are in one array.
    ends = np.append(np.flatnonzero(fresh)[1:], len(start))
    total = np.cumsum(count)
    at = 0
    while at < len(start):
        base = total[at - 1] if at else 0
        k = np.searchsorted(total[ends - 1], base + ENTRIES, "right")
        first_end = np.searchsorted(ends, at, "right")
        stop = int(ends[min(max(k - 1, first_end), len(ends) - 1)])
        rows = np.repeat(np.arange(at, stop), count[at:stop])
        if len(rows):
            begins = np.cumsum(count[at:stop]) - count[at:stop]
            before = lo[rows] + np.arange(len(rows)) - np.repeat(begins, count[at:stop])
            _scan(one, rows, before.astype(np.int64), begin, end)
        at = stop
    hit = end > 0
    size = np.diff(np.append(start, len(c.doc)))
    rows = np.flatnonzero(np.repeat(hit, size))
    group = np.repeat(np.arange(len(start)), size)[rows]
    return (c.doc[rows], c.tag[rows], c.place[rows] - side + begin[group],
            c.place[rows] - side + end[group])


def _rank(rows: np.ndarray) -> np.ndarray:
    """Rank of each byte row in lexicographic order."""
    rank = np.empty(len(rows), np.int64)
    rank[_order(rows)] = np.arange(len(rows))
    return rank


def _scan(c: _Contexts, rows, before, begin, end) -> None:
    """Extend ``begin`` and ``end`` by the maximal repeats among the given suffixes.

    Suffix k starts ``before[k]`` bytes before the anchor of context ``rows[k]``.
    """
    side, least, width = c.side, c.least, c.text.shape[1]
    at = side - before
    length = (before + GRAM + c.right[rows]).astype(np.int64)
    text = np.zeros((len(rows), width), np.uint8)
    for k in np.unique(at):
        some = np.flatnonzero(at == k)
        text[some, :width - k] = c.text[rows[some], k:]
    order = _order(text)
    text, rows, at, length = text[order], rows[order], at[order], length[order]
    whole = at == side - c.left[rows]  # nothing is before it
    prior = np.where(whole, -1, c.text[rows, np.maximum(at - 1, 0)].astype(np.int64))
    doc = c.doc[rows]
    differ = text[1:] != text[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
    start = np.flatnonzero(np.append(True, lcp < least))
    stop = np.append(start[1:], len(rows))
    mixed = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
    diverse = (np.minimum.reduceat(prior, start) < np.maximum.reduceat(prior, start)) | (
        np.maximum.reduceat(whole, start))
    # If all are preceded by one byte, so are the parts of the run: none is a maximal repeat.
    for a, b in zip(start[mixed & diverse].tolist(), stop[mixed & diverse].tolist()):
        for shared, first, last in _intervals(lcp[a:b - 1].tolist()):
            part = slice(a + first, a + last + 1)
            ids, p = doc[part], prior[part]
            if p.min() >= 0 and p.min() == p.max():
                continue
            later = ids > ids.min()
            hit = rows[part][later]
            np.minimum.at(begin, hit, at[part][later])
            np.maximum.at(end, hit, at[part][later] + shared)


def _starts_of(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Starts of the runs of one document."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[:len(doc)]
    return np.flatnonzero(new)


def _united_by(head: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(number of the run, start, end) of the spans of each run, united.

    Runs are laid apart, so that one pass unites the spans of all.
    """
    number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(start))))
    a, b = united(start + (number << 40), end + (number << 40))
    own = a >> 40
    return own, a - (own << 40), b - (own << 40)


def _span_rows(groups: int, *found) -> pa.RecordBatch:
    """Covered spans as answers to their documents."""
    doc, tag, start, end = (np.concatenate([np.asarray(f[k], np.int64) for f in found])
                            for k in range(4))
    order = np.lexsort((end, start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    head = _starts_of(doc, tag)
    own, a, b = _united_by(head, start, end)
    return _grouped(groups, doc[head][own], tag[head][own], a, b)


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals given by rising starts; those that touch are one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    first = np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)
    return start[first], reach[last]


def _single_strings(c: _Contexts) -> _Contexts:
    """Each context as its strings of ``least`` bytes, one row for each."""
    side, least = c.side, c.least
    before = np.arange(side + 1)[None, :]
    fits = (before <= c.left[:, None]) & (side - before <= c.right[:, None])
    row, left = np.nonzero(fits)
    cols = np.arange(-side, GRAM + side)[None, :]
    keep = (cols >= -left[:, None]) & (cols < GRAM + side - left[:, None])
    text = np.where(keep, c.text[row], 0).astype(np.uint8)
    return _Contexts(least, text, left.astype(np.int16), (side - left).astype(np.int16),
                     c.doc[row], c.tag[row], c.place[row])


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a tag that tells rows of one id apart: 0 if no id is repeated."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    return docs.withColumn("tag", F.xxhash64("text") if has_rows(again)
                           else F.lit(0).cast("long"))


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, tag and packed (the compressed text) of each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"),
                 pa.array([_squeeze(t) for t in values(texts)], pa.binary())],
                ["doc_id", "tag", "packed"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, packed binary")


def _squeeze(text: bytes) -> bytes:
    return _PACK.compress(text)


def _loosen(packed: bytes) -> bytes:
    return _LOOSEN.decompress(packed)


def _loosened(packed: pa.Array) -> list[bytes]:
    return [_loosen(p) for p in values(packed)]


def covered_spans(docs: DataFrame, *, least: int = LEAST, hot: int | None = None,
                  buckets: int | None = None) -> DataFrame:
    """(doc_id, tag, spans) of the rows of :func:`tagged` that have spans to go.

    ``spans`` has pairs of start and end in bytes, as binary values of two longs a pair.
    """
    if least < GRAM + 8 or least - GRAM > 255:
        raise ValueError(f"least must be between {GRAM + 8} and {GRAM + 255}")
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least))
    sizes = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    size, groups = sizes[0] or 0, max(1, sizes[1] // GROUP_DOCS)
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    if hot is None:
        hot = max(HOT, size // HOT_KEYS)
    repeated = _repeated(docs, least, buckets, groups, hot)
    frequent = [_unpacked(bytes(r.blob), np.uint64)[0] for r in repeated.where(
        F.col("kind") == HOT_KEY).select("blob").toLocalIterator()]
    frequent = np.sort(np.concatenate([*frequent, np.zeros(0, np.uint64)]))

    def deal(batches):
        for batch in (x for whole in batches for x in _slices(whole, "packed", PACKED_BYTES)):
            texts = _Texts(pa.array(_loosened(batch.column("packed")), pa.large_binary()))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            place, key = anchors(texts.data, texts.ends, least)
            number = texts.of(place)
            place = place - texts.starts[number]
            row, asked = _owned(batch.column("places"))
            keep = np.isin((number << 40) + place, (row << 40) + asked)
            place, key, number = place[keep], _mixed(key[keep]), number[keep]
            for part in _pieces(number, key):
                yield from send(_contexts(least, texts, ids, tags, number[part], place[part]),
                                key[part])

    def send(c: _Contexts, key: np.ndarray):
        if not len(key):
            return
        held = _bucket(key, buckets).astype(np.uint64) << np.uint64(32)
        many = np.isin(held | (key & np.uint64(0xFFFFFFFF)), frequent)
        found = []
        for group, by_string in ((np.flatnonzero(~many), False), (np.flatnonzero(many), True)):
            if not len(group):
                continue
            rest, start, spans = _reduced(c.take(group))
            found.append(spans)
            if by_string:
                rest, start, spans = _reduced(_single_strings(rest))
                found.append(spans)
                hashes = _digest(rest.text)
            else:
                side = rest.side
                hashes = _mixed(_hashes_of(rest.text[:, side:side + GRAM]))
            which, blobs = [], []
            for b, part in _parts(_bucket(hashes, buckets)):
                which.append(b + (buckets if by_string else 0))
                x = rest.take(part)
                blobs.append(_packed(x.text.view(f"V{x.text.shape[1]}").ravel(),
                                     x.left.astype(np.uint8), x.right.astype(np.uint8), x.doc,
                                     x.tag, x.place.astype(np.int64)))
            yield _rows([DEALT] * len(which), which, blobs)
        if found:
            yield _span_rows(groups, *found)

    def search(table: pa.Table) -> pa.Table:
        width = 2 * least - GRAM
        out, dealt = _sorted_out(table)
        if not dealt:
            return pa.Table.from_batches(out)
        fields = [[] for _ in range(6)]
        for blob in dealt:
            for field, x in zip(fields, _unpacked(blob, f"V{width}", np.uint8, np.uint8, np.int64,
                                                  np.int64, np.int64)):
                field.append(x)
        text, left, right, doc, tag, place = (np.concatenate(f) for f in fields)
        c = _Contexts(least, text.view(np.uint8).reshape(-1, width), left.astype(np.int16),
                      right.astype(np.int16), doc, tag, place)
        rest, start, spans = _reduced(c)
        return pa.Table.from_batches([*out, _span_rows(groups, spans, _search(rest, start))])

    asked = _places(repeated.where(F.col("kind") == ANSWER))
    joined = squeezed(docs).join(asked, "doc_id")
    dealt = joined.select("doc_id", "tag", "packed", "places").mapInArrow(deal, _DEALT)
    return stored(_spans(dealt.groupBy("bucket").applyInArrow(search, _DEALT)))


PIECE = 1 << 15


def _pieces(number: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
    """Anchors of a batch in pieces of about ``PIECE``, equal anchors in one piece."""
    n = max(1, len(key) // PIECE)
    for _, part in _parts((key % np.uint64(n)).astype(np.int64)):
        yield part


def _hashes_of(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of ``GRAM`` bytes, as :func:`_hashes` gives."""
    words = np.ascontiguousarray(grams).view("<u8")
    h = (words[:, 0] * _A) ^ (words[:, 1] * _B)
    h ^= h >> np.uint64(31)
    h *= _C
    return h ^ (h >> np.uint64(30))


def _digest(rows: np.ndarray) -> np.ndarray:
    """A hash of each byte row."""
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _C
        h ^= h >> np.uint64(29)
    return h


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = tagged(rows)
    spans = covered_spans(rows, **options)
    joined = squeezed(rows).join(spans, ["doc_id", "tag"], "left")

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [[] for _ in range(5)]
        for text, blobs in zip(values(texts), values(spans)):
            text = _loosen(text)
            parts, a = [text], ()
            if blobs:
                a, b = np.frombuffer(blobs, np.int64).reshape(-1, 2).T
                parts = [text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)])]
            kept = b"".join(parts)
            for column, x in zip(out, (len(text), len(text) - len(kept), len(a), kept,
                                       hashlib.sha256(kept).hexdigest())):
                column.append(x)
        types = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.StructArray.from_arrays(
            [pa.array(x, t) for x, t in zip(out, types)],
            ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    found = joined.select("doc_id", cut(F.col("packed"), F.col("spans")).alias("cut"))
    return found.select("doc_id", "cut.*")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    return without_repeats(docs, **options).drop("kept")


# The same from the definition: all strings of 50 bytes.
SQL = r"""
WITH bytes AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS e FROM documents),
strings AS MATERIALIZED (
  SELECT doc_id, i, array_slice(e, i + 1, i + 50) AS s
  FROM (SELECT doc_id, e, unnest(range(0, greatest(octet_length(e) - 49, 0))) AS i FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
gone AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50
          THEN 0 ELSE 1 END AS new FROM gone)),
spans AS MATERIALIZED (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
between_ AS (
  SELECT doc_id, b AS lo, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a),
    1099511627776) AS hi FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, list(hex(array_slice(e, lo + 1, hi)) ORDER BY lo) AS parts
  FROM between_ JOIN bytes USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY 1)
SELECT doc_id, octet_length(e)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
  coalesce(k, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN k IS NULL THEN e ELSE unhex(array_to_string(parts, '')) END) AS kept_sha256
FROM bytes LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
