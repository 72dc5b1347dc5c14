"""Substring dedup: passages of 13 words and more that occur in an earlier document, found by FM-indexes over shards.

Shards are cut by content, so that equal windows always meet: a window belongs to its minimiser (the 5-word gram of least
hash in it), and consecutive windows with one minimiser form a segment. Per unit (some megabytes of texts):

1. units() keeps each unit's rows (compressed) and its distinct minimisers, dealt by hash range.
2. _count() finds minimisers that occur twice or more in the corpus; only their segments go on. It also names hot ones, which
   stand in HOT different segments and more: a common phrase, each time among other words.
3. _segments() sends each distinct segment of a unit once, with its smallest doc_id, to the minimiser's shard. A passage that a
   third of all documents share is one row a unit. Segments of a hot minimiser are cut into windows, each with its own shard,
   so that no phrase gathers all its surroundings in one place; equal windows still meet.
4. _match() builds a compressed FM-index (a wavelet matrix over the transform of the shard's distinct segments) and streams the
   units' segments through it: backward search finds the interval of every window of 13 words, and with it the smallest doc_id
   that holds it.
5. _apply() marks the reported intervals in the unit's texts and removes them.

Memory follows units and shards. Shards are as many as SHARD bytes of text need, and at least as many as there are shuffle
partitions. Symbols are 40-bit word hashes; equal windows are 13 equal symbols.

Defined results: a null or empty text has no words and becomes empty; texts shorter than a window only lose white space
(kept words are joined by one space); a row without doc_id is never an owner and loses nothing; rows that share a doc_id are
one document; an empty table gives an empty table; other columns pass through unless they carry the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shuffle_partitions, written
from tidemark.llm.fm_index import FMIndex, streamed
from tidemark.llm.hashing import P, Q, Words, mixed, powers, ragged, words_of

WINDOW, GRAM = FMIndex.DEPTH, 5
UNIT = 1 << 23  # bytes of text
SHARD = 1 << 24  # bytes of text for which there is a shard
HOT = 1 << 14  # different segments of one minimiser, counted by unit
_LOW, _NONE = np.uint64((1 << 40) - 1), np.uint64(2**64 - 1)
_NO_ID = np.iinfo(np.int64).max
_ROW = "unit long, part int, kind int, a binary, b binary, c binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
KEYS, TEXTS, SHARED, LAYOUT, SEGMENTS, OWNERS = range(6)


def _batch(unit: list | np.ndarray, part: list | np.ndarray, kind: int, a: list, b: list | None = None, c: list | None = None) -> pa.RecordBatch:
    n = len(a)
    blank = [None] * n
    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(part, pa.int32()), pa.array([kind] * n, pa.int32()), *(pa.array(x or blank, pa.binary()) for x in (a, b, c))], _NAMES)


def _cut(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """data cut at ends, as bytes."""
    raw, size = data.tobytes(), data.dtype.itemsize * int(np.prod(data.shape[1:], dtype=int))
    return [raw[size * a : size * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class Unit:
    """A unit's words, and the segments of its windows."""

    def __init__(self, text: pa.Array) -> None:
        self.parts: list[Words] = []
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        words = texts = 0
        for _, w in words_of(text, lower=False):
            for c, x in zip(cols, self._segments(w), strict=True):
                c.append(x)
            cols[0][-1], cols[3][-1] = cols[0][-1] + words, cols[3][-1] + texts
            self.parts.append(w)
            words, texts = words + len(w.hash), texts + w.n_texts
        #: First word, number of windows, minimiser, text and content hash of each segment.
        self.start, self.windows, self.key, self.text, self.content = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        self.key = self.key.astype(np.uint64)
        self.n_words, self.n_texts = words, texts

    def hashes(self) -> np.ndarray:
        return np.concatenate([w.hash for w in self.parts]) if self.parts else np.zeros(0, np.uint64)

    def keep(self, live: np.ndarray, hot: np.ndarray) -> None:
        """Leaves the segments `live`; those of them that are `hot` become one segment a window, with the window's own key."""
        plain, n = live & ~hot, self.windows[hot]
        start, text = ragged(self.start[hot], n), np.repeat(self.text[hot], n)
        own = _window_hashes(self.hashes(), start) if len(start) else np.zeros(0, np.uint64)
        cols = {"start": start, "windows": np.ones(len(start), np.int64), "key": own, "text": text, "content": own}
        cols = {c: np.concatenate([getattr(self, c)[plain], x]) for c, x in cols.items()}
        order = np.argsort(cols["start"], kind="stable")
        for c, x in cols.items():
            setattr(self, c, x[order])

    @staticmethod
    def _segments(w: Words) -> tuple[np.ndarray, ...]:
        n = len(w.hash) - WINDOW + 1
        at = np.flatnonzero(w.text[: max(n, 0)] == w.text[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
        grams, first = w.windows(GRAM)
        value = np.full(len(w.hash), _NONE, np.uint64)
        value[first] = mixed(grams ^ np.uint64(0x1F83D9ABFB41BD6B))
        best, place = value[:n].copy(), np.arange(n)
        for q in range(1, WINDOW - GRAM + 1):
            less = value[q : q + n] < best
            best[less] = value[q : q + n][less]
            place[less] = np.flatnonzero(less) + q
        best, place = best[at], place[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        windows = np.diff(np.append(begin, len(at)))
        start = at[begin]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * powers(P, len(w.hash)), dtype=np.uint64)])
        content = mixed((sums[start + windows + WINDOW - 1] - sums[start]) * powers(Q, len(w.hash))[start] + windows.astype(np.uint64))
        return start, windows, best[begin], w.text[start], content


def _window_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for q in range(WINDOW):
        out = out * P + hashes[at + q]
    return mixed(out)


def _parts(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def units(docs: DataFrame, n_parts: int) -> DataFrame:
    """Written: rows of kind TEXTS and KEYS for each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                held = size[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(size, held + UNIT, side="right")))
                rows = batch.slice(first, last - first)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as stream:
                    stream.write_batch(rows)
                yield _batch([unit], [0], TEXTS, [sink.getvalue().to_pybytes()])
                u = Unit(rows["text"])
                key, count = np.unique(u.key, return_counts=True)
                _, one = np.unique(u.content, return_index=True)
                kinds = np.bincount(np.searchsorted(key, u.key[one]), minlength=len(key))
                # How many segments with different words (up to 127: what one unit adds is bounded anyway), and whether there are two or more in all.
                seen = (np.minimum(kinds, 127) | ((count > 1) << 7)).astype(np.uint8)
                part = _parts(key, n_parts)
                order = np.argsort(part, kind="stable")
                some, ends = np.unique(part, return_counts=True)
                ends = np.cumsum(ends)
                yield _batch([unit] * len(some), some, KEYS, _cut(_packed(key[order] & _LOW, 5), ends), _cut(seen[order], ends))
                unit, first = unit + 1, last

    return written(docs.mapInArrow(run, _ROW))


def _count(least: int):
    def run(table: pa.Table) -> pa.Table:
        """One hash range of minimisers: those that occur twice or more go back to their units, with whether they are hot."""
        blobs = table["a"].to_pylist()
        ends = np.cumsum([len(b) // 5 for b in blobs])
        low = _unpacked(blobs, 5)
        seen = np.frombuffer(b"".join(table["b"].to_pylist()), np.uint8)
        _, at = np.unique(low, return_inverse=True)
        twice = (np.bincount(at) + np.bincount(at, seen >> 7))[at] > 1
        hot = (np.bincount(at, seen & 127) >= least)[at].astype(np.uint8)
        kept = np.concatenate([[0], np.cumsum(twice)])[ends]
        return pa.Table.from_batches([_batch(table["unit"].to_pylist(), table["part"].to_pylist(), SHARED, _cut(_packed(low[twice], 5), kept), _cut(hot[twice], kept))])

    return run


def _rows(table: pa.Table) -> pa.RecordBatch:
    with pa.ipc.open_stream(table.filter(pc.equal(table["kind"], TEXTS))["a"][0].as_py()) as stream:
        return stream.read_all().combine_chunks().to_batches()[0]


def _segments_of(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        unit, u = table["unit"][0].as_py(), Unit(rows["text"])
        shared = table.filter(pc.equal(table["kind"], SHARED))
        parts = np.repeat(shared["part"].to_numpy(), [len(b) // 5 for b in shared["a"].to_pylist()]).astype(np.uint64)
        hot = np.frombuffer(b"".join(shared["b"].to_pylist()), np.uint8) > 0
        shared = _unpacked(shared["a"].to_pylist(), 5) | (parts << np.uint64(40))
        full = (u.key & _LOW) | (_parts(u.key, n_parts).astype(np.uint64) << np.uint64(40))
        doc = rows["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        live = np.isin(full, shared) & (doc[u.text] != _NO_ID)
        u.keep(live, live & np.isin(full, shared[hot]))
        doc, part, live = doc[u.text], _parts(u.key, n_parts), np.arange(len(u.key))
        # Distinct segments by shard; each shard's row lists them in this order.
        one, first, inverse = np.unique(u.content[live], return_index=True, return_inverse=True)
        order = np.argsort(part[live][first], kind="stable")
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        pick = live[first][order]
        least = np.full(len(one), _NO_ID)
        np.minimum.at(least, place[inverse], doc[live])
        windows = u.windows[pick]
        symbols = u.hashes()[ragged(u.start[pick], windows + WINDOW - 1)] >> np.uint64(24)
        some, count = np.unique(part[pick], return_counts=True)
        ends = np.cumsum(count)
        layout = np.stack([np.diff(u.text[live], prepend=0), np.diff(u.start[live], prepend=0), place[inverse]]).astype(np.int32)
        sizes = np.stack([some, count]).astype(np.int32)
        out = [_batch([unit], [unit % n_parts], LAYOUT, [layout.tobytes()], [windows.astype(np.uint8).tobytes()], [sizes.tobytes()])]
        if len(some):
            words = np.cumsum(windows + WINDOW - 1)[ends - 1]
            out.append(_batch([unit] * len(some), some, SEGMENTS, _cut(windows.astype(np.uint8), ends), _cut(_packed(symbols, 5), words), _cut(least, ends)))
        return pa.Table.from_batches(out)

    return run


def _match(table: pa.Table) -> pa.Table:
    """One shard: an index of its distinct segments, through which the units' segments are streamed; for each of their windows the smallest doc_id that holds it. Layouts pass through."""
    layouts = table.filter(pc.equal(table["kind"], LAYOUT)).select(_NAMES)
    table = table.filter(pc.equal(table["kind"], SEGMENTS))
    if not table.num_rows:
        return layouts
    blobs = table["a"].to_pylist()
    windows = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64)
    symbols = _unpacked(table["b"].to_pylist(), 5)
    least = np.frombuffer(b"".join(table["c"].to_pylist()), np.int64)
    length = windows + WINDOW - 1
    start = np.cumsum(length) - length
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(symbols) * powers(P, len(symbols)), dtype=np.uint64)])
    content = mixed((sums[start + length] - sums[start]) * powers(Q, len(symbols))[start] + windows.astype(np.uint64))
    _, pick, inverse = np.unique(content, return_index=True, return_inverse=True)
    owner = np.full(len(pick), _NO_ID)
    np.minimum.at(owner, inverse, least)
    index = FMIndex(symbols[ragged(start[pick], length[pick])], length[pick], owner)
    out = np.concatenate([*streamed(index, symbols, length)])
    cuts = np.cumsum(windows)[np.cumsum([len(b) for b in blobs]) - 1]
    # Steps from one owner to the next, most of which are 0, compress well.
    step = np.diff(out, prepend=0)
    step[np.append(0, cuts[:-1])] = out[np.append(0, cuts[:-1])]
    return pa.concat_tables([layouts.cast(pa.Table.from_batches([_batch([], [], 0, [])]).schema), pa.Table.from_batches([_batch(table["unit"].to_pylist(), table["part"].to_pylist(), OWNERS, _cut(step, cuts))])])


def _apply_to(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        u = Unit(rows["text"])
        remove = np.zeros(u.n_words + 1, np.int64)
        layout = table.filter(pc.equal(table["kind"], LAYOUT))
        if layout.num_rows:
            text, start, place = np.frombuffer(layout["a"][0].as_py(), np.int32).reshape(3, -1).astype(np.int64)
            text, start = np.cumsum(text), np.cumsum(start)
            windows = np.frombuffer(layout["b"][0].as_py(), np.uint8).astype(np.int64)
            some, _ = np.frombuffer(layout["c"][0].as_py(), np.int32).reshape(2, -1)
            owners = table.filter(pc.equal(table["kind"], OWNERS))
            by_part = dict(zip(owners["part"].to_pylist(), owners["a"].to_pylist(), strict=True))
            owner = np.concatenate([np.cumsum(np.frombuffer(by_part[p], np.int64)) for p in some.tolist()]) if len(some) else np.zeros(0, np.int64)
            n = windows[place]
            doc = rows["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)[text]
            lost = owner[ragged((np.cumsum(windows) - windows)[place], n)] < np.repeat(doc, n)
            at = ragged(start, n)[lost]
            remove += np.bincount(at, minlength=len(remove)) - np.bincount(at + WINDOW, minlength=len(remove))
        kept = np.cumsum(remove)[:-1] == 0
        texts, counts, gone, first = [], [], [], 0
        for w in u.parts:
            k = kept[first : first + len(w.hash)]
            first += len(w.hash)
            # Each kept word with the byte after it, which becomes the space between words.
            begin, size = w.start[k], w.end[k] - w.start[k] + 1
            data = np.append(w.data, np.uint8(32))[ragged(begin, size)]
            data[np.cumsum(size) - 1] = 32
            ends = np.concatenate([[0], np.cumsum(np.bincount(w.text[k], size, w.n_texts).astype(np.int64))])
            raw = data.tobytes()
            texts += [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            counts.append(np.bincount(w.text, minlength=w.n_texts))
            gone.append(np.bincount(w.text[~k], minlength=w.n_texts))
        made = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(np.concatenate(counts)), "n_removed": pa.array(np.concatenate(gone))}
        return pa.Table.from_arrays([made.get(c, rows[c] if c in rows.schema.names else None) for c in names], names)

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text replaced by its kept words, plus n_words and n_removed. Needs doc_id and text."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(4 * shuffle_partitions(docs.sparkSession), -(-size // SHARD))
    docs = docs.select(*(c for c in docs.columns if c not in ("n_words", "n_removed")))
    parts = units(docs, n)
    texts = parts.where(F.col("kind") == TEXTS)
    shared = parts.where(F.col("kind") == KEYS).groupBy("part").applyInArrow(_count(HOT), _ROW)
    segments = texts.union(shared).groupBy("unit").applyInArrow(_segments_of(n), _ROW)
    owners = segments.groupBy("part").applyInArrow(_match, _ROW)
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return texts.union(owners).groupBy("unit").applyInArrow(_apply_to(schema.names), schema)
