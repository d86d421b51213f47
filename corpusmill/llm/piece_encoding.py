"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

The new text of a batch is indexed by a suffix array; every piece is found in it by binary search,
which gives the range of its occurrences.  The occurrences become edges, addressed by position and
length, and the byte-pair model is relaxed over them: in each segment the best pair of neighbours
that an edge spans is joined, until none is left.  Characters that are no piece fall back to bytes.

A segment is a stretch of text inside which all neighbouring characters stand together in some
piece; no join can cross its ends, so a segment's ids do not depend on what surrounds it and are
found once.  A sum over piece scores would not do here: a BPE model joins by rank.

Null and empty texts have no ids.  Texts of any length are encoded whole, segments of any length
too: text is indexed in stretches of INDEXED characters, and beside that a segment takes four bytes a
character for each length that a piece can have.  Repeated rows are encoded each.  An empty table
gives an empty result.  A model that works otherwise (scores summed, other white space, other
normalisation) is refused when it is loaded: PROBES have to get the ids that its library gives.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, SEP = "▁", "\ud800"
#: Segments a task remembers, characters indexed at once, and segments longer than this are joined with a heap.
REMEMBERED, INDEXED, LONG = 400_000, 400_000, 48
NONE = np.int32(1 << 30)

#: Texts on which models of other kinds differ.
PROBES = ["", " ", "a  b", " Hello world.", "newworldorder unbelievably", "caf\u00e9 cafe\u0301 \ufb01 \u2460 \uff21", "\u65e5\u672c\u8a9e\U0001f389", "x\ty\nz", "12345 678", "aaaaaaaaaaaa"]

_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """The vocabulary of a model file, read with the sentencepiece library; encoding is done here."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.out: list[bytes] = []
        pieces, ids, scores = [], [], []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.out.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.out.append(p.encode())
                pieces.append(p)
                ids.append(i)
                scores.append(sp.get_score(i))
        self.ids = np.array(ids, np.int32)
        order = np.unique(-np.array(scores), return_inverse=True)[1]
        self.rank = np.full(n + 1, NONE)
        self.rank[self.ids] = order
        self.length = np.array([len(p) for p in pieces])
        self.longest = int(self.length.max())
        self.chars = np.unique(np.array([ord(c) for p in pieces for c in p], np.uint32))
        pairs = {(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), np.uint64)
        self.pairs = np.append(self.pairs, np.uint64(0xFFFFFFFFFFFFFFFF))
        code = {int(c): i + 1 for i, c in enumerate(self.chars)}
        low = np.zeros((len(pieces), self.longest), ">u2")
        for r, p in enumerate(pieces):
            low[r, : len(p)] = [code[ord(c)] for c in p]
        high = np.where(np.arange(self.longest)[None, :] < self.length[:, None], low, 0xFFFF).astype(">u2")
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{2 * self.longest}").ravel() for x in (low, high))
        self.known: dict[str, bytes] = {}
        if [np.frombuffer(x, "<u4").tolist() for x in self.encode(PROBES)] != sp.encode(PROBES):
            raise ValueError(f"{path} is no byte-pair model with byte fallback and a plain normaliser")

    # encoding -------------------------------------------------------------------------

    def codes(self, cp: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, cp), len(self.chars) - 1)
        return np.where(self.chars[at] == cp, at + 1, 0xFFFE).astype(np.uint16)

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """edge[i, n]: the piece of n characters that begins at i, or -1; the suffix array is made and searched in stretches."""
        edge = np.full((len(codes), self.longest + 1), -1, np.int32)
        for a in range(0, len(codes), INDEXED):
            own = min(INDEXED, len(codes) - a)
            at, length, ids = self._occurrences(codes[a : a + own + self.longest])
            inside = at < own
            edge[a + at[inside], length[inside]] = ids[inside]
        return edge

    def _occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and ids of all pieces in a stretch, found by binary search in its suffix array."""
        n, w = len(codes), self.longest
        padded = np.concatenate([codes, np.zeros(w, np.uint16)]).astype(">u2")
        keys = np.lib.stride_tricks.sliding_window_view(padded, w)[:n].copy()
        parts = keys.view(">u8").astype(np.uint64) if (2 * w) % 8 == 0 else None
        sa = np.lexsort(parts.T[::-1]) if parts is not None else np.argsort(keys.view(f"S{2 * w}").ravel(), kind="stable")
        ordered = keys[sa].view(f"S{2 * w}").ravel()
        lo, hi = np.searchsorted(ordered, self.low), np.searchsorted(ordered, self.high, "right")
        size = hi - lo
        at = sa[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        return at, np.repeat(self.length, size), np.repeat(self.ids, size)

    def learn(self, segments: list[str]) -> None:
        """Find the ids of segments not met before."""
        held, n = [], 0
        for s in segments:
            held.append(s)
            n += len(s) + 1
            if n >= INDEXED:
                self._relax(held)
                held, n = [], 0
        if held:
            self._relax(held)

    def _relax(self, segments: list[str]) -> None:
        cp = np.frombuffer("\0".join(segments).encode("utf-32-le"), np.uint32)
        size = np.array([len(s) for s in segments])
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        codes = self.codes(cp)
        codes[first[1:] - 1] = 0
        edge = self.edges(codes)
        begin = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        end, seg = begin + 1, np.repeat(np.arange(len(segments)), size)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        big = size[seg] > LONG
        if big.any():
            done.append(self._heaped(edge, first, size, np.flatnonzero(size > LONG)))
            begin, end, seg = begin[~big], end[~big], seg[~big]
        while len(begin):
            span = np.zeros(len(begin), np.int64)
            span[:-1] = np.where(seg[1:] == seg[:-1], end[1:] - begin[:-1], 0)
            ok = (span > 0) & (span <= self.longest)
            key = np.full(len(begin), NONE)
            key[ok] = self.rank[edge[begin[ok], span[ok]]]  # rank[-1] is NONE
            at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(key, at)
            count = np.diff(np.append(at, len(seg)))
            wide = np.repeat(best, count)
            live = wide < NONE
            done.append((begin[~live], end[~live], seg[~live]))
            hit = np.flatnonzero(live & (key == wide))
            hit = hit[np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])] if len(hit) else hit
            end[hit] = end[hit + 1]
            live[hit + 1] = False
            begin, end, seg = begin[live], end[live], seg[live]
        begin, end, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((begin, seg))
        begin, end, seg = begin[order], end[order], seg[order]
        ids = edge[begin, np.minimum(end - begin, self.longest)]
        raw, at = ids.astype("<u4").tobytes(), np.searchsorted(seg, np.arange(len(segments) + 1))
        lacking = set(seg[ids < 0].tolist())
        for i, s in enumerate(segments):
            if i in lacking:
                own: list[int] = []
                for k in range(at[i], at[i + 1]):
                    own += [int(ids[k])] if ids[k] >= 0 else self.byte_ids[np.frombuffer(chr(int(cp[begin[k]])).encode(), np.uint8)].tolist()
                self.known[s] = np.array(own, "<u4").tobytes()
            else:
                self.known[s] = raw[4 * at[i] : 4 * at[i + 1]]

    def _heaped(self, edge: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple:
        """Long segments: the same joins, best first, from a heap."""
        out: tuple[list, list, list] = ([], [], [])
        for i in which.tolist():
            base, n = int(first[i]), int(size[i])
            nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
            heap: list[tuple[int, int, int, int]] = []

            def offer(a: int, base=base, n=n, nxt=nxt, end=end, heap=heap) -> None:
                b = nxt[a]
                if b < n and end[b] - a <= self.longest and (r := int(self.rank[edge[base + a, end[b] - a]])) < NONE:
                    heapq.heappush(heap, (r, a, b, end[b]))

            for a in range(n - 1):
                offer(a)
            dead = bytearray(n)
            while heap:
                _, a, b, e = heapq.heappop(heap)
                if dead[a] or dead[b] or nxt[a] != b or end[b] != e:
                    continue
                dead[b], end[a], nxt[a] = 1, e, nxt[b]
                if nxt[a] < n:
                    prv[nxt[a]] = a
                    offer(a)
                if prv[a] >= 0:
                    offer(prv[a])
            for a in range(n):
                if not dead[a]:
                    out[0].append(base + a)
                    out[1].append(base + end[a])
                    out[2].append(i)
        return tuple(np.array(x, np.int64) for x in out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(marked)
        if not joined:
            return [b""] * len(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in marked])
        pair = cp[:-1].astype(np.uint64) << np.uint64(32) | cp[1:]
        apart = self.pairs[np.searchsorted(self.pairs, pair)] != pair
        inner = ends[:-1]
        apart[inner[(inner > 0) & (inner < len(cp))] - 1] = True
        cuts = np.flatnonzero(apart) + 1
        segments = np.insert(cp, cuts, 0xD800).tobytes().decode("utf-32-le", "surrogatepass").split(SEP)
        new = [s for s in set(segments) if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(segments))
        self.learn(new)
        ids = list(map(self.known.__getitem__, segments))
        upto = np.searchsorted(cuts, ends, "left") + 1
        upto[ends == 0] = 0
        out, begin = [], 0
        for stop, t in zip(upto.tolist(), marked, strict=True):
            out.append(b"".join(ids[begin:stop]) if t else b"")
            begin = stop if t else begin
        return out

    # decoding -------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, round_trip (decoding gives the text again) and, with keep_ids, ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                ids = m.encode(texts)
                back = [m.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                n = [len(x) // 4 for x in ids]
                out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if keep_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat))
                    names.append("ids")
                yield pa.record_batch(out, names=names)
        m.known.clear()  # workers live on

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text, text_sha256) from the ids of encode_documents; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["doc_id", "text", "text_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string, text_sha256 string")
