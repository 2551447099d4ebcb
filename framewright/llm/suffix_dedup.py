"""Removal of long repeated strings with a run-length index.

Every window of ``length`` bytes belongs to the anchor that it selects from
its own bytes, so equal windows of all documents meet at one anchor. Anchors
that one document alone has are left out. Around every other occurrence the
bytes of the windows that selected it are sent to the anchor's group; copies
are sent once for a batch. Strings that share a window agree in the half of it on
one side of the anchor; those that agree with no other string are their own
class. The rest of a group is indexed by a run-compressed
Burrows-Wheeler transform with the suffix positions at the ends of runs. From
these alone the matching statistics of the whole text are streamed: next to
which suffix every suffix stands, and how far they agree. Run heads and lengths
aren't kept, since no backward step is taken: inside a run a neighbour moves
along with its position, so positions at run ends say all. An anchor with more
strings and places than a task should hold has its windows spread over tasks
instead. Windows that agree
over their whole length are one class; what a smaller doc_id of the class has
is marked in the other documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, document_key, stored, table, width

#: Bytes of an anchor; a window has as many places for it as make up its length.
ANCHOR = 16
#: Bytes of text that an index holds, at least one anchor's.
INDEX_BYTES = 1 << 21
#: Bytes of one anchor's strings and places that a task holds; a larger group is spread over tasks by its windows.
HOT_BYTES = 1 << 25

#: Windows of a text whose anchors are chosen together, and bytes of shorter texts that are; positions in such a piece are below 2^24.
PIECE, TOGETHER = 1 << 22, 1 << 18

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position."""
    h = b.astype(np.uint64)
    n, have = len(b), 1
    while have * 2 <= size:
        step = h[: n - 2 * have + 1]
        h = step * _M1 + (h[have : n - have + 1] ^ (step >> np.uint64(29))) * _M2
        h ^= h >> np.uint64(32)
        have *= 2
    if have < size:
        h = h[: n - size + 1] * _M1 + h[size - have : n - have + 1] * _M2
        h ^= h >> np.uint64(31)
    return h[: n - size + 1]


def anchors(b: np.ndarray, length: int, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first and last window, and place of every anchor that a window of a text selects: the least gram of the window, of equal ones the first.

    A long text is taken in pieces of ``PIECE`` windows, so that what a window
    selects hangs on its own bytes wherever it stands; windows on both sides of
    a cut that select the same place are one row.
    """
    if len(b) < length:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    windows = len(b) - length + 1
    if windows <= PIECE:
        return _anchors(b, length, size)
    parts = []
    for cut in range(0, windows, PIECE):
        h, first, last, at = _anchors(b[cut : min(windows, cut + PIECE) + length - 1], length, size)
        parts.append((h, first + cut, last + cut, at + cut))
    h, first, last, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.append(True, at[1:] != at[:-1])
    return h[new], first[new], last[np.append(new[1:], True)], at[new]


def anchors_of(texts: list[bytes], length: int, size: int = ANCHOR) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors of many texts: the first text's number, then as columns the text (from that one on) and what ``anchors`` gives; short texts are taken together."""
    at = 0
    while at < len(texts):
        upto, room = at + 1, len(texts[at])
        while upto < len(texts) and room + len(texts[upto]) <= min(TOGETHER, PIECE):
            room += len(texts[upto])
            upto += 1
        if upto == at + 1 or room < length:
            for k in range(at, upto):
                h, first, last, place = anchors(np.frombuffer(texts[k], np.uint8), length, size)
                yield k, np.zeros(len(h), np.int64), h, first, last, place
        else:
            ends = np.cumsum([len(t) for t in texts[at:upto]])
            begins = np.append(0, ends[:-1])
            inside = np.zeros(room + 1, np.int8)
            # Windows that cross the end of a text are none.
            windows = np.maximum(ends - begins - length + 1, 0)
            np.add.at(inside, begins, windows > 0)
            np.subtract.at(inside, begins + windows, windows > 0)
            inside = np.cumsum(inside[:-1])[: room - length + 1].astype(bool)
            h, first, last, place = _anchors(np.frombuffer(b"".join(texts[at:upto]), np.uint8), length, size, inside)
            text = np.searchsorted(ends, first, "right")
            yield at, text, h, first - begins[text], last - begins[text], place - begins[text]
        at = upto


def _anchors(b: np.ndarray, length: int, size: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _grams(b, size)
    places = length - size + 1
    # The order is a hash's upper 40 bits; the position in the lower ones settles ties.
    key = (h * _M1 & ~np.uint64((1 << 24) - 1)) | (np.arange(len(h), dtype=np.uint64) & np.uint64((1 << 24) - 1))
    low, have = key, 1
    while have * 2 <= places:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < places:
        low = np.minimum(low[: len(low) - (places - have)], low[places - have :])
    which = np.arange(len(low)) if inside is None else np.flatnonzero(inside)
    low = low if inside is None else low[which]
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
    last = which[np.append(first[1:], len(low)) - 1] if len(first) else first
    at = (low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = which[first]
    return h[at], first, last, at


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of strings that follow each other in ``text``, each closed by a 0 that is its own symbol; bytes are 1 to 256."""
    n, known = len(text), 7
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(known):
        key <<= 9
        key[: n - k] |= np.where(to_end[: n - k] > k, text[k:], 0)
    order = np.argsort(key, kind="stable")
    starts = np.append(True, (key[order][1:] != key[order][:-1]) | (to_end[order] < known)[1:])
    rank = np.empty(n, np.int64)
    while True:
        group = np.flatnonzero(starts)
        rank[order] = np.repeat(group, np.diff(np.append(group, n)))
        tied = np.flatnonzero(~starts | ~np.append(starts[1:], True))
        if not len(tied):
            return order
        rows = order[tied]
        key = rank[rows] << 31 | rank[rows + known]
        again = np.argsort(key)
        order[tied], key = rows[again], key[again]
        starts[tied[1:]] |= key[1:] != key[:-1]
        known *= 2


class RunIndex:
    """The run-compressed transform of strings: run heads, and the suffix positions on both sides of every run's start."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        ends = self.begins + self.lengths
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        text[ends] = 0
        order = suffix_array(text, ends)
        bwt = text[order - 1]
        start = np.flatnonzero(np.append(True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)))
        self.text = text
        by_place = np.argsort(order[start], kind="stable")
        #: In text order: the suffix at a run's start, and the one at the end of the run before it (-1: none).
        self.sampled = order[start][by_place]
        self.before = np.where(start == 0, -1, order[start - 1])[by_place]

    def statistics(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position the suffix that stands before its own, and how far the two agree, streamed from the sampled run ends.

        Inside a run the neighbour moves along with the position and the
        agreement gets shorter by one; only at sampled positions are bytes
        compared, up to ``most`` of them.
        """
        n = len(self.text)
        agree = np.zeros(len(self.sampled), np.int64)
        live = np.flatnonzero(self.before >= 0)
        for k in range(most):
            a, b = self.text[self.sampled[live] + k], self.text[self.before[live] + k]
            live = live[(a == b) & (a != 0)]
            if not len(live):
                break
            agree[live] += 1
        run = np.searchsorted(self.sampled, np.arange(n), "right") - 1
        ahead = np.arange(n) - self.sampled[run]
        neighbour = np.where(self.before[run] >= 0, self.before[run] + ahead, -1)
        return neighbour, np.maximum(agree[run] - ahead, 0)


def first_owner(strings: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string, in turn, the least owner of each of its windows anywhere in the strings; and how many windows each has."""
    index = RunIndex(strings)
    neighbour, agree = index.statistics(int(index.lengths.max()))
    n = len(index.text)
    root = np.where(agree >= length, neighbour, np.arange(n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    string = np.repeat(np.arange(len(strings)), index.lengths + 1)
    least = np.full(n, np.iinfo(np.int64).max)
    each = index.lengths - length + 1
    window = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(index.begins, each)
    np.minimum.at(least, root[window], owner[string[window]])
    return least[root[window]], each


def _spans(groups: list[tuple[bytes, bytes]], length: int) -> pa.RecordBatch:
    """Marked spans of the occurrences of strings: doc, check and span (start << 24 | bytes)."""
    found: dict[bytes, list[bytes]] = {}
    for segment, places in groups:
        found.setdefault(segment, []).append(places)
    if not found:
        return _span_rows([], [], [], [])
    strings = list(found)
    blobs = [np.frombuffer(b"".join(found[s]), _PLACE) for s in strings]
    least, each = first_owner(strings, np.array([p["doc"].min() for p in blobs]), length)
    starts = np.cumsum(each) - each
    several = np.repeat(np.arange(len(strings)), [len(p) for p in blobs])
    places = np.concatenate(blobs)
    # Occurrences whose doc is over the least owner of some window.
    high = np.maximum.reduceat(least, starts)
    same = high == np.minimum.reduceat(least, starts)
    whole = same[several] & (places["doc"] > high[several])
    mixed = np.flatnonzero(~same[several])
    doc, check = [places["doc"][whole]], [places["check"][whole]]
    at, size = [places["at"][whole].astype(np.int64)], [each[several[whole]] + length - 1]
    if len(mixed):
        n = each[several[mixed]]
        which = np.repeat(mixed, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = least[starts[several[which]] + step] < places["doc"][which]
        which, step = which[hit], step[hit]
        if len(which):
            new = np.append(True, (which[1:] != which[:-1]) | (step[1:] != step[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(which)) - 1
            doc.append(places["doc"][which[first]])
            check.append(places["check"][which[first]])
            at.append(places["at"][which[first]].astype(np.int64) + step[first])
            size.append(step[last] - step[first] + length)
    return _span_rows(doc, check, at, size)


def _span_rows(doc: list, check: list, at: list, size: list) -> pa.RecordBatch:
    whole = lambda parts: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(whole(doc)), pa.array(whole(check)), pa.array(whole(at) << 24 | whole(size))], ["key", "check", "span"])


def _own_spans(groups: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Marked spans of strings (bytes, places) that are each a class of their own: all places but those of the least doc."""
    if not groups:
        return _span_rows([], [], [], [])
    places = np.frombuffer(b"".join(p for _, p in groups), _PLACE)
    n = np.array([len(p) // _PLACE.itemsize for _, p in groups])
    least = np.repeat(np.minimum.reduceat(places["doc"], np.cumsum(n) - n), n)
    size = np.repeat([k for k, _ in groups], n)
    later = places["doc"] > least
    return _span_rows([places["doc"][later]], [places["check"][later]], [places["at"][later]], [size[later]])


def meeting(group: dict[bytes, tuple[int, list[bytes]]], length: int) -> tuple[list[tuple[bytes, bytes]], list[tuple[int, bytes]]]:
    """Of an anchor's strings (with the anchor's offset and blobs of places) those that may share a window with another, and the others that have several places.

    A window is the anchor, some bytes before it and some after it: of these
    the larger part is half of them or more, so strings that share a window
    agree in that half.
    """
    half = -(-(length - ANCHOR) // 2)
    seen: dict[tuple[bool, bytes], int] = {}
    halves = []
    for segment, (lead, _) in group.items() if len(group) > 1 else ():
        after = lead + ANCHOR + half
        mine = ([(False, segment[lead - half : lead])] if lead >= half else []) + ([(True, segment[after - half : after])] if len(segment) >= after else [])
        halves.append(mine)
        for x in mine:
            seen[x] = seen.get(x, 0) + 1
    together, alone = [], []
    for k, (segment, (_, blobs)) in enumerate(group.items()):
        places = b"".join(blobs)
        if halves and any(seen[x] > 1 for x in halves[k]):
            together.append((segment, places))
        elif len(places) > _PLACE.itemsize:
            alone.append((len(segment), places))
    return together, alone


_PLACE = np.dtype([("doc", "<i8"), ("check", "<u4"), ("at", "<u4")])


def _bytes(text: str | None) -> bytes:
    return text.encode() if text else b""


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """anchor, key: each anchor of a document. One that two documents of a batch have is sent for one of them, and said to be shared for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h.view(np.int64), at + text) for at, text, h, *_ in anchors_of([_bytes(t.as_py()) for t in batch.column(1)], length)]
            h, text = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
            h, key = h[new], batch.column(0).to_numpy(zero_copy_only=False)[text[new]]
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            group = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            if not len(h):
                continue
            n = np.diff(np.append(group, len(h)))
            shared = np.repeat(key[group] != key[group + n - 1], n)
            sent = np.zeros(len(h), bool)
            sent[group] = True
            # Shared ones go to their document straight away; the first of each also stands for the batch.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[sent], h[shared]])), pa.array(np.concatenate([key[sent], key[shared]])), pa.array(np.append(np.zeros(sent.sum(), bool), np.ones(shared.sum(), bool)))], ["anchor", "key", "known"])

    return keyed.select("key", "text").mapInArrow(run, "anchor long, key long, known boolean")


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """key, anchor of every anchor that documents of two keys have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))

        def close(h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            group = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.diff(np.append(group, len(h)))
            several = np.repeat(np.minimum.reduceat(key, group) != np.maximum.reduceat(key, group), n) if len(h) else np.empty(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(h[several])], ["key", "anchor"])

        for batch in batches:
            h, key, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = known.astype(bool)
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[known]), pa.array(h[known])], ["key", "anchor"])
            h, key = np.append(kept[0], h[~known]), np.append(kept[1], key[~known])
            if not len(h):
                continue
            cut = np.searchsorted(h, h[-1])
            kept = h[cut:], key[cut:]
            yield close(h[:cut], key[:cut])
        yield close(*kept)

    parts = rows.repartition(width(rows.sparkSession), F.when(F.col("known"), F.col("key")).otherwise(F.col("anchor"))).sortWithinPartitions("known", "anchor")
    return parts.mapInArrow(run, "key long, anchor long")


def _segments(keyed: DataFrame, length: int) -> DataFrame:
    """anchor, segment, lead (the anchor's offset in it), places: the bytes of the windows around each shared anchor, once for a batch, with all places of the batch that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, bytes, int], list[tuple[int, int, int]]] = {}
            keys, texts = batch.column(0).to_pylist(), [_bytes(t.as_py()) for t in batch.column(1)]
            for at, text, h, first, last, place in anchors_of(texts, length):
                h, cuts = h.view(np.int64), np.searchsorted(text, np.arange(text[-1] + 2 if len(text) else 1))
                for k, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if low == high:
                        continue
                    data, key = texts[at + k], keys[at + k]
                    hit = low + np.flatnonzero(np.isin(h[low:high], batch.column(2)[at + k].values.to_numpy()))
                    check = zlib.crc32(data)
                    for a, f, e, lead in zip(h[hit].tolist(), first[hit].tolist(), (last[hit] + length).tolist(), (place - first)[hit].tolist(), strict=True):
                        found.setdefault((a, data[f:e], lead), []).append((key, check, f))
            if found:
                places = [np.array(p, _PLACE).tobytes() for p in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in found], pa.int64()), pa.array([s for _, s, _ in found], pa.binary()), pa.array([x for _, _, x in found], pa.int32()), pa.array(places, pa.binary())], ["anchor", "segment", "lead", "places"])

    return keyed.select("key", "text", "anchors").mapInArrow(run, "anchor long, segment binary, lead int, places binary")


def _marked(segments: DataFrame, length: int) -> DataFrame:
    """key, check, span: what is to be removed, from an index for each INDEX_BYTES of segments of whole anchors; and id, segment, places of anchors whose group is over HOT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        own: list[tuple[int, bytes]] = []
        group: dict[bytes, tuple[int, list[bytes]]] = {}
        hot: list[tuple[bytes, bytes]] = []
        size, weight, last = 0, 0, None
        number = TaskContext.get().partitionId() << 40

        def passed_on() -> pa.RecordBatch:
            nonlocal number
            rows = pa.RecordBatch.from_arrays([*(pa.nulls(len(hot), pa.int64()) for _ in range(3)), pa.array(np.arange(len(hot)) + number), pa.array([s for s, _ in hot], pa.binary()), pa.array([p for _, p in hot], pa.binary())], _MARKED)
            number += len(hot)
            hot.clear()
            return rows

        def found(spans: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*spans.columns, pa.nulls(len(spans), pa.int64()), *(pa.nulls(len(spans), pa.binary()) for _ in range(2))], _MARKED)

        for batch in batches:
            for anchor, segment, lead, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    together, alone = meeting(group, length)
                    held += together
                    own += alone
                    size += sum(len(t) + 1 + len(p) for t, p in together) + sum(len(p) for _, p in alone)
                    group, weight, last = {}, 0, anchor
                    if size >= INDEX_BYTES:
                        yield found(_spans(held, length))
                        yield found(_own_spans(own))
                        held, own, size = [], [], 0
                weight += len(segment) + len(places)
                if weight <= HOT_BYTES:
                    group.setdefault(segment, (lead, []))[1].append(places)
                    continue
                hot += [(s, p) for s, (_, blobs) in group.items() for p in blobs] + [(segment, places)]
                group = {}
                if len(hot) >= 1000:
                    yield passed_on()
            if hot:
                yield passed_on()
        together, alone = meeting(group, length)
        yield found(_spans(held + together, length))
        yield found(_own_spans(own + alone))

    parts = segments.repartition(width(segments.sparkSession), "anchor").sortWithinPartitions("anchor")
    return parts.mapInArrow(run, "key long, check long, span long, id long, segment binary, places binary")


_MARKED = ["key", "check", "span", "id", "segment", "places"]


def _hot_spans(hot: DataFrame, length: int) -> DataFrame:
    """key, check, span of the strings of hot anchors, ``hot(id, segment, places)``: their windows meet by their bytes, least keys are found by partial aggregates, and places never leave their rows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column(1).to_pylist()
            n = [len(s) - length + 1 for s in segments]
            least = [int(np.frombuffer(p, _PLACE)["doc"].min()) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)), pa.array([s[k : k + length] for s, m in zip(segments, n, strict=True) for k in range(m)], pa.binary()), pa.array(np.repeat(least, n))], ["id", "at", "window", "least"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for blob, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = np.frombuffer(blob, _PLACE)
                first = np.array([p["first"] for p in sorted(pairs, key=lambda p: p["at"])], np.int64)
                at = np.array(sorted(p["at"] for p in pairs), np.int64)
                for k, doc in enumerate(places["doc"].tolist()):
                    hit = at[first < doc]
                    if len(hit):
                        begins = hit[np.append(True, np.diff(hit) != 1)]
                        ends = hit[np.append(np.diff(hit) != 1, True)]
                        for x, v in zip(out, ([doc] * len(begins), [int(places["check"][k])] * len(begins), int(places["at"][k]) + begins, ends - begins + length), strict=True):
                            x.append(np.array(v, np.int64))
            yield _span_rows(*out)

    each = hot.select("id", "segment", "places").mapInArrow(windows, "id long, at int, window binary, least long")
    first = each.groupBy("window").agg(F.min("least").alias("first"))
    known = each.select("id", "at", "window").join(first, "window").groupBy("id").agg(F.collect_list(F.struct("at", "first")).alias("pairs"))
    return hot.select("id", "places").join(known, "id").select("places", "pairs").mapInArrow(spans, "key long, check long, span long")


def _cut(data: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data``, and the maximal removed runs."""
    start = np.sort(spans)
    begin, end = start >> 24, (start >> 24) + (start & (1 << 24) - 1)
    if not len(begin):
        return data, []
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    runs = list(zip(begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)].tolist(), strict=True))
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), runs


def remove_repeats(docs: DataFrame, length: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, kept (binary), run_starts and run_ends (byte offsets of maximal removed runs) of every row of ``docs(doc_id, text)``.

    Removed is every byte covered by a string of ``length`` bytes that also
    starts in a document with a smaller doc_id. Texts count as UTF-8; null is
    empty. Rows with the same doc_id take nothing from each other; a null
    doc_id is smaller than any other, and rows without one stand in the order of
    a hash of their texts. Texts of any length count whole. Strings are judged on the input. Other
    columns are left out, an empty table gives no row. The texts are bucketed
    by doc_id once, so that they are not shuffled again: the bucketed table
    and the intermediate ones lie in ``scratch``, which can be cleared when the
    result has been written.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    name = scratch.table("texts")
    keyed = docs.select("doc_id", "text", document_key().alias("key"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    keyed.write.bucketBy(width(spark), "key").sortBy("key").option("compression", "zstd").option("path", f"{scratch.path}/{name}").saveAsTable(name)
    keyed = spark.table(name)
    # A whole copy of a document with a smaller doc_id goes whole, and adds no string to what that one has.
    firsts = keyed.groupBy("digest").agg(F.min("key").alias("first"))
    copies = keyed.select("key", "digest").join(firsts, "digest").filter("key > first").groupBy("key").agg(F.collect_set("digest").alias("copied"))
    copies = scratch.stored(copies, "copies")
    is_copy = F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False))
    own = keyed.join(copies, "key", "left").filter(~is_copy).select("key", "text")
    shared = _shared_anchors(_anchor_rows(own, length)).groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    marked = _marked(_segments(own.join(shared, "key"), length), length)
    marked = scratch.stored(marked, "spans")
    hot = marked.filter("id is not null")
    spans = marked.filter("id is null").select("key", "check", "span")
    if not hot.isEmpty():
        spans = spans.unionByName(_hot_spans(hot, length))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("check", "span")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found, copy in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = _bytes(text.as_py())
                check = zlib.crc32(data)
                if copy and len(data) >= length:
                    rows.append((data, b"", [(0, len(data))]))
                else:
                    rows.append((data, *_cut(data, np.array([] if copy else [x["span"] for x in found or () if x["check"] == check], np.int64))))
            lists = lambda k: [[r[k] for r in row[2]] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(lists(0), pa.list_(pa.int64())), pa.array(lists(1), pa.list_(pa.int64()))], ["doc_id", "n_bytes", "kept", "run_starts", "run_ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed.join(spans, "key", "left").join(copies, "key", "left").select("doc_id", "text", "spans", is_copy.alias("copy"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, kept binary, run_starts array<bigint>, run_ends array<bigint>")


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes in all whole documents."""
    scratch = Scratch(spark, "repeats")
    found = remove_repeats(table(spark, sf_dir, "documents"), 50, scratch)
    out = found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("run_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = stored(out, "repeats")
    scratch.clear()
    return out


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS new FROM x),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
p AS (SELECT doc_id, k, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS left_from, a AS left_to FROM r),
q AS (SELECT doc_id, k, left_from, left_to, b FROM p),
l AS (SELECT doc_id, max(b) AS last, count(*) AS n_spans, sum(left_to - left_from) AS left_bytes FROM q GROUP BY doc_id),
t AS (SELECT d.doc_id, string_agg(substr(h, 2 * left_from + 1, 2 * (left_to - left_from)), '' ORDER BY left_from) AS t FROM d JOIN q USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes,
       (length(h) // 2 - length(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1)) // 2)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)
"""
