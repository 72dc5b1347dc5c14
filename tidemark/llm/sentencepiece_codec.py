"""SentencePiece encoding and decoding in batched numpy.

A text becomes pre-segments between which no piece can reach (at runs of the space mark, and around characters that occur in
no longer piece). A task hashes the segments of a chunk of texts, encodes each distinct one once, and gathers the results back.
Segments of equal length advance together:

* unigram models: Viterbi. For every end position the hashes of all substrings probe the sorted piece keys at once; vectorised
  maxima over the start positions store backpointers.
* BPE models: Viterbi over scores gives other ids than the model defines, so the same batches run the model's own rule:
  every step merges, in each row, the adjacent pair with the best score (the leftmost of equals), found by probing sorted
  pair keys; a row loses one symbol a step, so the batch stays a matrix. Segments of over LONG symbols use a heap instead.

Characters that no piece holds fall back to bytes, or to the unknown id where the model has none.

The model's pieces (a vocabulary, so of bounded size) go to the tasks with the function; texts are read once and nothing is
shuffled. A chunk holds at most CHUNK characters (half as many ids) or one text, so memory follows the longest text.

Defined results: null and empty texts have no ids; ids that are null or empty decode to the empty text; control ids decode to
nothing; repeated rows are encoded alike; empty tables give empty tables; other columns pass through unless they carry the
name of the result column, which then replaces them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.hashing import P, Q, mixed, powers, ragged

MARK = "▁"
CHUNK = 1 << 20
LONG = 64
_N = 0x110000


def _hashes(codes: np.ndarray) -> np.ndarray:
    """h, so that (h[j] - h[i]) * Q**i identifies codes[i:j]."""
    terms = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * powers(P, len(codes))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: -1, 5: 4}[key & 7]
            size = varint() if size < 0 else size
            yield key >> 3, data[at : at + size]
            at += size


def _model_kind(path: str) -> tuple[str, bool]:
    """(bpe or unigram, whether a text gets a mark in front) of a model file."""
    with open(path, "rb") as f:
        fields = [*_proto(f.read())]
    trainer = dict(x for n, v in fields if n == 2 for x in _proto(v))
    normaliser = dict(x for n, v in fields if n == 3 for x in _proto(v))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
    own = any(dict(_proto(v)).get(3, 1) == 4 for n, v in fields if n == 1)
    # Fields of the normaliser: 2 a character map, 3 the mark in front, 4 trimmed white space, 5 spaces as marks; 24 of the trainer: marks as suffixes.
    refused = {"kind": kind is None, "normaliser": bool(normaliser.get(2)), "trimmed white space": normaliser.get(4, 1) == 1, "spaces that are no marks": normaliser.get(5, 1) == 0, "user-defined pieces": own, "marks as suffixes": trainer.get(24, 0) == 1}
    if any(refused.values()):
        raise ValueError(f"{path}: not handled: {', '.join(k for k, v in refused.items() if v)}")
    return kind, normaliser.get(3, 1) == 1


@dataclass
class Pieces:
    """A model's vocabulary, in arrays."""

    kind: str  # bpe or unigram
    pieces: list[str]
    scores: np.ndarray
    special: np.ndarray  # bool: control and unknown ids, which no text gives
    byte_ids: np.ndarray | None  # 256 ids, or None without byte fallback
    unknown: int = 0
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file, which says what kind it is. ValueError for what isn't handled: word and character models, normalisers, trimmed white space, user-defined pieces, the mark as a suffix."""
        import sentencepiece

        kind, dummy_prefix = _model_kind(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        is_byte = [i for i in ids if model.is_byte(i)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids])
        return cls(kind, [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids]), special, np.array(is_byte, np.int32) if is_byte else None, model.unk_id(), dummy_prefix)

    def __post_init__(self) -> None:
        plain = [i for i in range(len(self.pieces)) if not self.special[i]]
        self.char_id = np.full(_N, -1, np.int32)
        joins = np.zeros(_N, bool)
        for i in plain:
            if len(self.pieces[i]) == 1:
                self.char_id[ord(self.pieces[i])] = i
            else:
                joins[[ord(c) for c in self.pieces[i]]] = True
        self.alone = ~joins
        self.marks_inside = any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in plain))
        keys = np.array([_hashes(c := _codes(self.pieces[i]))[len(c)] for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids, self.longest = keys[order], np.array(plain, np.int32)[order], max((len(self.pieces[i]) for i in plain), default=1)
        if self.kind == "bpe":
            known = {self.pieces[i]: i for i in plain}
            size = np.int64(len(self.pieces))
            pairs = {known[p[:k]] * size + known[p[k:]]: i for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
            # Rank 0 is the best score; equal scores keep their order by id.
            ranks = np.empty(len(self.pieces), np.int32)
            ranks[np.argsort(-self.scores, kind="stable")] = np.arange(len(self.pieces))
            self.pair_keys = np.array(sorted(pairs), np.int64)
            self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
            self.ranks = ranks

    # Encoding of distinct segments

    def _merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that pairs merge into and their ranks; NONE where they don't."""
        key = a.astype(np.int64) * len(self.pieces) + b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        ids = self.pair_ids[at] if len(self.pair_keys) else np.zeros(key.shape, np.int32)
        found = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(key.shape, bool)
        return ids, np.where(found, self.ranks[ids], NONE)

    def bpe(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of equal length -> (row numbers, symbols) of each group that ended with as many symbols. Unknown symbols: -1 - code."""
        sym = self.char_id[codes]
        sym = np.where(sym < 0, -1 - codes.astype(np.int32), sym)
        rows, out_rows, out = np.arange(len(sym)), [], []
        ids, rank = self._merged(sym[:, :-1], sym[:, 1:])
        while len(sym):
            if sym.shape[1] > 1:
                best = rank.argmin(axis=1)
                live = rank[np.arange(len(sym)), best] < NONE
            else:
                live = np.zeros(len(sym), bool)
            if not live.all():
                out_rows.append(rows[~live])
                out.append(sym[~live])
                sym, rows, ids, rank = sym[live], rows[live], ids[live], rank[live]
                if not len(sym):
                    break
                best = best[live]
            n, m = sym.shape
            k, each = best[:, None], np.arange(n)
            cols = np.arange(m - 1)
            new = np.where(cols <= k, sym[:, :-1], sym[:, 1:])
            new[each, best] = ids[each, best]
            if m > 2:
                cols = cols[:-1]
                ids, rank = (np.where(cols < k, x[:, :-1], x[:, 1:]) for x in (ids, rank))
                for at in (best - 1, best):  # the pairs at either side of the merged symbol
                    ok = np.flatnonzero((at >= 0) & (at < m - 2))
                    ids[ok, at[ok]], rank[ok, at[ok]] = self._merged(new[ok, at[ok]], new[ok, at[ok] + 1])
            sym = new
        return out_rows, out

    def bpe_long(self, codes: np.ndarray) -> np.ndarray:
        """One long segment, with a heap of mergeable pairs."""
        sym = np.where(self.char_id[codes] < 0, -1 - codes.astype(np.int32), self.char_id[codes]).tolist()
        n, size = len(sym), len(self.pieces)
        known = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist(), strict=True))
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (new := known.get(sym[i] * size + sym[j])) is not None:
                heapq.heappush(heap, (int(self.ranks[new]), i, sym[i], sym[j], new))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = new, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([x for x in sym if x is not None], np.int64)

    def viterbi(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """As bpe(), by the best sum of scores; ties prefer the longer last piece. An unknown character costs 10 below the worst score."""
        n, m = codes.shape
        h = np.zeros((n, m + 1), np.uint64)
        terms = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * powers(P, m)
        np.cumsum(terms, axis=1, dtype=np.uint64, out=h[:, 1:])
        best, back, last = np.full((n, m + 1), -np.inf), np.zeros((n, m + 1), np.int32), np.zeros((n, m + 1), np.int32)
        best[:, 0], worst, inverse = 0, float(self.scores.min(initial=0)) - 10, powers(Q, m + 1)
        for end in range(1, m + 1):
            starts = np.arange(max(0, end - self.longest), end)
            key = (h[:, [end]] - h[:, starts]) * inverse[starts]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(key.shape, bool)
            ids = self.key_ids[at] if len(self.keys) else np.zeros(key.shape, np.int32)
            value = np.where(hit, best[:, starts] + self.scores[ids], -np.inf)
            unknown = ~hit[:, -1]
            value[unknown, -1] = best[unknown, end - 1] + worst
            ids = np.where(hit, ids, -1 - codes[:, [end - 1]].astype(np.int32))
            top = value.argmax(axis=1)
            each = np.arange(n)
            best[:, end], back[:, end], last[:, end] = value[each, top], starts[top], ids[each, top]
        out, left = np.zeros((n, m), np.int32), np.full(n, m, np.int32)
        used = np.zeros(n, np.int64)
        while (live := np.flatnonzero(left)).size:
            used[live] += 1
            out[live, m - used[live]] = last[live, left[live]]
            left[live] = back[live, left[live]]
        groups = [np.flatnonzero(used == k) for k in np.unique(used)]
        return groups, [out[g, m - used[g[0]] :] for g in groups]

    def _final(self, symbols: np.ndarray) -> list[int]:
        """One row of symbols with unknown characters resolved."""
        out: list[int] = []
        for s in symbols.tolist():
            if s >= 0:
                out.append(s)
            elif self.byte_ids is not None:
                out += self.byte_ids[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Starts of the pre-segments of codes; texts begin at starts."""
        mark, alone = codes == ord(MARK), self.alone[codes]
        cut = np.zeros(len(codes), bool)
        cut[starts[starts < len(codes)]] = True
        cut[1:] |= alone[1:] | alone[:-1]
        if not self.marks_inside:
            cut[1:] |= mark[1:] & ~mark[:-1]
        return np.flatnonzero(cut)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of text k are ids[offsets[k]:offsets[k + 1]]."""
        marked = [((MARK if self.dummy_prefix else "") + t.replace(" ", MARK)) if t else "" for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        codes = _codes("".join(marked))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = self.segments(codes, bounds[:-1])
        length = np.diff(np.append(begin, len(codes)))
        h = _hashes(codes)
        key = (h[begin + length] - h[begin]) * powers(Q, len(codes))[begin]
        _, first, inverse = np.unique(mixed(key + length.astype(np.uint64)), return_index=True, return_inverse=True)
        at, size = begin[first], length[first]
        owner, parts = [], []  # distinct segment of each run of ids, and the runs
        for n in np.unique(size):
            group = np.flatnonzero(size == n)
            if n > LONG and self.kind == "bpe":
                found = [(np.array([g]), self.bpe_long(codes[at[g] : at[g] + n])[None]) for g in group]
            else:
                found = []
                for k in range(0, len(group), 50_000):
                    some = group[k : k + 50_000]
                    found += [(some[r], s) for r, s in zip(*(self.bpe if self.kind == "bpe" else self.viterbi)(codes[at[some][:, None] + np.arange(n)]), strict=True)]
            for who, symbols in found:
                odd = (symbols < 0).any(axis=1)
                owner.append(np.stack([who[~odd], np.full((~odd).sum(), symbols.shape[1])]))
                parts.append(symbols[~odd].ravel())
                for g, row in zip(who[odd], symbols[odd], strict=True):
                    row = self._final(row)
                    owner.append(np.array([[g], [len(row)]]))
                    parts.append(np.array(row))
        who, count = np.concatenate(owner, axis=1)
        flat = np.concatenate(parts).astype(np.int32)
        place, n_ids = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        place[who], n_ids[who] = np.cumsum(count) - count, count
        ids = flat[ragged(place[inverse], n_ids[inverse])]
        per_segment = np.concatenate([[0], np.cumsum(n_ids[inverse])])
        return ids, per_segment[np.searchsorted(begin, bounds)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        if not hasattr(self, "_bytes"):
            raw = [b"" if self.special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
            for b, i in enumerate([] if self.byte_ids is None else self.byte_ids.tolist()):
                raw[i] = bytes([b])
            self._n_bytes = np.array([len(x) for x in raw])
            self._at, self._bytes = np.cumsum(self._n_bytes) - self._n_bytes, np.frombuffer(b"".join(raw), np.uint8)
        n = self._n_bytes[ids]
        data = self._bytes[ragged(self._at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
        texts = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return [(t[1:] if self.dummy_prefix and t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


NONE = np.iinfo(np.int32).max


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t or "") > CHUNK:
            yield slice(start, k)
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, model: Pieces, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of text."""
    keep = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text].to_pylist()
            for part in _chunks(texts):
                ids, offsets = model.encode(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], [*keep, into])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of ids."""
    keep = [c for c in encoded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[ids].fill_null([])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            first = 0
            while first < len(lists):  # rows of some ids at a time, or one row
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK // 2, side="right")) - 1)
                part = batch.slice(first, last - first)
                texts = model.decode(lists.slice(first, last - first).flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[first : last + 1] - ends[first])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(texts, pa.string())], [*keep, into])
                first = last

    return encoded.select(*keep).mapInArrow(run, T.StructType([*encoded.select(*keep).schema.fields, T.StructField(into, T.StringType())]))
