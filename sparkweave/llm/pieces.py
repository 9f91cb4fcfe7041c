"""SentencePiece encoding and decoding in numpy: distinct segments of equal length advance together.

A text is its own with spaces as U+2581 and one in front; no piece joins a U+2581 to a character before it, so a
text is cut into segments (spaces, then other characters) and each distinct segment of a batch is encoded once.
Hashes of substrings, from prefix sums over code points, probe the sorted hashes of the pieces.

Both kinds of model are searched by Viterbi: position after position of all segments of one length, vectorised over the
segments, each position storing a backpointer.
* Unigram models: the best sum of scores over piece lengths, a vectorised maximum.
* BPE models (as the public 32k file is): the best sum of scores is not what BPE merges give, so the lattice keeps
  only the arcs that merging could leave behind: a piece must be the merges' result for its own characters, and for
  each two neighbours no merge may cross their border before both are complete. Merging any stretch of pieces gives
  these pieces again, so the merges' result is the one path whose neighbours all join, and each position has exactly one
  such arc. Whether two pieces join follows from the order in which
  the merges complete the right edge of one and the left edge of the other, prepared once a model.
  Pieces that rank no better than a part of theirs, and those after them (in the public file, runs of spaces, which all
  rank last), are not in the lattice: their merges come after all others, and are made on its result.
The time is linear in a segment's length. Segments over LONG characters, of which few have the same length, are walked
one by one by the same rule.
Characters without a piece fall back to bytes (or the unknown id where the model has no byte pieces).

Edge cases: null and empty texts have no ids. U+2581 in a text is a space, as it is for the model; for other texts
decoding gives the text back. Repeated rows give a row each. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import codepoints, mapped, record, views

SPACE = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xBF58476D1CE4E5B9)
#: Cells of a batch of segments, and score of a character that only bytes or the unknown id can write.
CELLS = 400_000
UNKNOWN_SCORE = -1e6
#: Segments, of so many bytes at most, whose ids a worker keeps (some 200 bytes each).
MEMO, MEMO_BYTES = 300_000, 64
#: Bits of a hash beyond the ones that the first table looks at.
LEADING = np.uint64(44)
#: Characters of a segment that is encoded by itself.
LONG = 1_000


class PieceModel:
    """Pieces, scores and type of a SentencePiece model; sorted hashes of the pieces."""

    def __init__(self, pieces: list[str], scores: list[float], bpe: bool, unknown: int = 0, plain: list[bool] | None = None):
        self.pieces, self.bpe, self.unknown = pieces, bpe, unknown
        usable = [i for i, p in enumerate(pieces) if p and (plain is None or plain[i])]
        hashes = np.array([self._hash(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usable, np.int64)[order]
        self.leading = np.full(1 << 64 - int(LEADING), -1, np.int32)
        lead, first, times = np.unique(self.keys >> LEADING, return_index=True, return_counts=True)
        self.leading[lead] = first
        self.most = int(times.max(initial=0))
        self.scores = np.array(scores, np.float64)
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        byte = {p: i for i, p in enumerate(pieces)}
        self.bytes = np.array([byte.get(f"<0x{b:02X}>", -1) for b in range(256)], np.int64)
        out = []
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x") and self.bytes[int(p[3:5], 16)] == i:
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(chr(SPACE), " ").encode() if plain is None or plain[i] else b"")
        self.text = pa.array(out, pa.large_binary())
        if bpe:
            self._edges(usable)

    def _edges(self, usable: list[int]) -> None:
        """For a BPE model: which pieces merging gives back (`own`), and for each of them how its right and its left
        edge grow, from the whole piece down to one character: lengths, times (the rank of the merge that completes
        the part) and the last index. The last row stands for a character without a piece. From the time `late` on,
        a part of a piece may rank no better than the piece."""
        none, self.late = len(self.pieces), np.inf
        middle = np.zeros(none, np.int64)
        self.own = np.zeros(none + 1, bool)
        by_length: dict[int, list[int]] = {}
        for i in usable:
            by_length.setdefault(len(self.pieces[i]), []).append(i)
        edges: list[list[list[tuple[int, float]]]] = [[[(1, -np.inf)]] * (none + 1) for _ in range(2)]
        place = {self.pieces[i]: i for i in usable}
        for n in sorted(by_length):
            ids = np.array(by_length[n])
            if n == 1:
                self.own[ids] = True
                continue
            grid = np.array([[ord(c) for c in self.pieces[i]] for i in ids], np.uint32)
            begins, found, last = self._merge(grid)
            whole = (begins[:, 0] == 0) & (found[:, 0] == ids) & (found[:, 1] == -2)
            self.own[ids], middle[ids] = whole, last
            for i in ids[whole].tolist():
                text, cut, time = self.pieces[i], int(middle[i]), -float(self.scores[i])
                for side, part in ((0, text[cut:]), (1, text[:cut])):
                    rest = edges[side][place[part]] if len(part) > 1 else edges[side][none]
                    if rest[0][1] >= time:
                        self.late = min(self.late, time)
                    edges[side][i] = [(n, time), *rest]
        late = [i for i in usable if -self.scores[i] >= self.late and len(self.pieces[i]) > 1]
        self.own[late] = False
        self.late_chars = np.array(sorted({ord(c) for i in late for c in self.pieces[i]}), np.uint32)
        self.edges = []
        for side in edges:
            depth = max(map(len, side))
            length, time = np.zeros((none + 1, depth), np.int64), np.zeros((none + 1, depth))
            for i, e in enumerate(side):
                length[i, : len(e)], time[i, : len(e)] = zip(*e, strict=True)
            self.edges.append((length, time, np.array([len(e) - 1 for e in side])))

    def _joins(self, prefix: np.ndarray, power: np.ndarray, row: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces that end and begin at a place stay apart when their characters are merged. The parts at the
        border are gone through as the merges complete them (of equal ranks the left one first); a merge across it
        happens if it ranks before the next merge on both sides."""
        (l_size, l_time, l_last), (r_size, r_time, r_last) = self.edges
        out = np.ones(len(row), bool)
        live, i, j = np.arange(len(row)), l_last[left].copy(), r_last[right].copy()
        while len(live):
            a, b = left[live], right[live]
            size_a, size_b = l_size[a, i], r_size[b, j]
            end_a = np.where(i > 0, l_time[a, i - 1], np.inf)
            end_b = np.where(j > 0, r_time[b, j - 1], np.inf)
            r, m = row[live], at[live]
            x = self.find(prefix[r, m + size_b] - prefix[r, m - size_a] * power[size_a + size_b])
            time = np.where((x >= 0) & (-self.scores[x] < self.late), -self.scores[x], np.inf)
            crossed = (time < end_a) & (time <= end_b)
            out[live[crossed]] = False
            more = ~crossed & ((i > 0) | (j > 0))
            first = end_a <= end_b
            i, j, live = (i - first)[more], (j - ~first)[more], live[more]
        return out

    def _paths(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ids of the one segmentation whose neighbours all join, left-aligned; -2 beyond the end."""
        w, n = grid.shape
        prefix, power = self._prefix(grid)
        back, piece = np.zeros((w, n + 1), np.int64), np.full((w, n + 1), -1)
        for i in range(1, n + 1):
            reach = min(i, self.longest)
            ids = self.find(prefix[:, i, None] - prefix[:, i - reach : i][:, ::-1] * power[1 : reach + 1])
            back[:, i], piece[:, i] = i - 1, ids[:, 0]  # unless a longer piece joins what is before it
            row, k = np.nonzero(self.own[ids[:, 1:]])
            right, k = ids[row, k + 1], k + 2
            inner = np.flatnonzero(k < i)
            good = np.ones(len(row), bool)
            good[inner] = self._joins(prefix, power, row[inner], i - k[inner], piece[row[inner], i - k[inner]], right[inner])
            back[row[good], i], piece[row[good], i] = i - k[good], right[good]
        return self._traced(back, piece)

    def _walk(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_paths of one long segment."""
        text = grid[0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        place = {self.pieces[i]: i for i in self.ids.tolist()}
        own, joined = self.own.tolist(), {}
        back, piece = np.zeros((1, len(text) + 1), np.int64), np.full((1, len(text) + 1), -1)
        starts, found = [0] * (len(text) + 1), [-1] * (len(text) + 1)
        for i in range(1, len(text) + 1):
            for k in range(min(i, self.longest), 0, -1):
                part = text[i - k : i]
                b = place.get(part, -1)
                if k > 1:
                    if b < 0 or not own[b]:
                        continue
                    if k < i:
                        before = text[starts[i - k] : i - k]
                        good = joined.get((before, b))
                        if good is None:
                            pair = np.array([[ord(c) for c in before + part]], np.uint32)
                            zero, where = np.zeros(1, np.int64), np.array([len(before)])
                            good = joined[before, b] = bool(self._joins(*self._prefix(pair), zero, where, np.array([found[i - k]]), np.array([b]))[0])
                        if not good:
                            continue
                starts[i], found[i] = i - k, b
                break
        back[0], piece[0] = starts, found
        return self._traced(back, piece)

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(len(s))
        plain = [not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i)) for i in n]
        return cls([s.id_to_piece(i) for i in n], [s.get_score(i) for i in n], _model_type(path) == 2, s.unk_id(), plain)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + (ord(c) + 1) * int(_ODD)) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, -1 if none. A table of the hashes' leading bits tells where to look."""
        out = np.full(hashes.shape, -1)
        at = self.leading[hashes >> LEADING]
        some = np.nonzero(at >= 0)
        at, wanted = at[some], hashes[some]
        found = np.full(len(at), -1)
        for step in range(self.most):
            place = np.minimum(at + step, len(self.keys) - 1)
            same = self.keys[place] == wanted
            found[same] = self.ids[place[same]]
        out[some] = found
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and each text's first (one more than texts)."""
        codes, distinct, first = segments(texts)
        flat, off = self._remembered(distinct)
        size = np.diff(off)[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(off[:-1][codes] - ends[:-1], size) + np.arange(ends[-1])] if len(codes) else np.zeros(0, np.int64)
        return ids, ends[first]

    def _remembered(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments. A worker keeps those of MEMO segments from one batch to the next."""
        memo = self.__dict__.setdefault("memo", {})
        names = distinct.to_pylist()
        known = [memo.get(n) for n in names]
        new = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        flat, off = self.segments(*codepoints(*views(distinct.take(pa.array(new)))))
        raw, off = flat.astype(np.int32).tobytes(), 4 * off
        for i, a, b in zip(new.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            known[i] = raw[a:b]
            if len(memo) < MEMO and len(names[i]) <= MEMO_BYTES:
                memo[names[i]] = known[i]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        return np.frombuffer(b"".join(known), np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(size)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def segments(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments (code points), by groups of one length."""
        lengths = np.diff(off)
        rows: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths[lengths > 0]):
            which = np.flatnonzero(lengths == n)
            alone = n > LONG and self.bpe
            for some in np.array_split(which, len(which) if alone else max(1, -(-len(which) * int(n) // CELLS))):
                grid = points[off[some][:, None] + np.arange(n)]
                begins, ids = (self._walk if alone else self._paths if self.bpe else self._viterbi)(grid)
                if self.bpe and len(self.late_chars):
                    some_late = np.isin(grid, self.late_chars)
                    rest = np.flatnonzero((some_late[:, 1:] & some_late[:, :-1]).any(axis=1))
                    if len(rest):
                        begins[rest], ids[rest], _ = self._merge(grid[rest], begins[rest])
                parts.append(self._bytes(grid, begins, ids))
                rows.append(some)
        size = np.zeros(len(lengths), np.int64)
        for some, (_, each) in zip(rows, parts, strict=True):
            size[some] = each
        out_off = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(out_off[-1], np.int64)
        for some, (ids, each) in zip(rows, parts, strict=True):
            start = np.concatenate([[0], np.cumsum(each)])
            flat[np.repeat(out_off[some] - start[:-1], each) + np.arange(start[-1])] = ids
        return flat, out_off

    def _prefix(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, n = grid.shape
        prefix = np.zeros((w, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _BASE + (grid[:, i].astype(np.uint64) + np.uint64(1)) * _ODD
        power = np.ones(n + 1, np.uint64)
        power[1:] = _BASE
        return prefix, np.multiply.accumulate(power)

    def _viterbi(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ids of the best segmentation by sum of scores, left-aligned; -2 beyond the end."""
        w, n = grid.shape
        prefix, power = self._prefix(grid)
        best = np.full((w, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((w, n + 1), np.int64), np.full((w, n + 1), -1)
        for i in range(1, n + 1):
            reach = range(1, min(i, self.longest) + 1)
            ids = np.stack([self.find(prefix[:, i] - prefix[:, i - k] * power[k]) for k in reach], axis=1)
            score = np.stack([best[:, i - k] for k in reach], axis=1) + np.where(ids >= 0, self.scores[ids], -np.inf)
            lone = ids[:, 0] < 0
            score[lone, 0] = best[lone, i - 1] + UNKNOWN_SCORE
            pick = score.argmax(axis=1)
            best[:, i] = score[np.arange(w), pick]
            back[:, i], piece[:, i] = i - 1 - pick, ids[np.arange(w), pick]
        return self._traced(back, piece)

    @staticmethod
    def _traced(back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The path to the last position along the backpointers."""
        w, n = back.shape[0], back.shape[1] - 1
        begins, ids = np.full((w, n), n), np.full((w, n), -2)
        at, k = np.full(w, n), np.zeros(w, np.int64)
        while (live := np.flatnonzero(at > 0)).size:
            ids[live, k[live]] = piece[live, at[live]]
            at[live] = back[live, at[live]]
            begins[live, k[live]] = at[live]
            k[live] += 1
        flip = np.where(np.arange(n) < k[:, None], k[:, None] - 1 - np.arange(n), np.arange(n))
        return np.take_along_axis(begins, flip, 1), np.take_along_axis(ids, flip, 1)

    def _merge(self, grid: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ids after all merges, of characters or of symbols with the starts given, left-aligned; -2 beyond the
        end. And where the last merge of a row joined."""
        w, n = grid.shape
        prefix, power = self._prefix(grid)
        span = lambda r, a, b: prefix[r, b] - prefix[r, a] * power[b - a]
        begin = np.broadcast_to(np.arange(n + 2), (w, n + 2)).copy()  # symbol k is begin[k] .. begin[k + 1]
        if begins is not None:
            begin[:, :n] = begins
        begin[:, n:] = n
        rows = np.arange(w)
        score = np.full((w, n), -np.inf)
        if n > 1:
            a, b, c = begin[:, : n - 1], begin[:, 1:n], begin[:, 2 : n + 1]
            ids = self.find(span(rows[:, None], a, c))
            score[:, : n - 1] = np.where((ids >= 0) & (c > b), self.scores[ids], -np.inf)
        live = rows[score.max(axis=1) > -np.inf] if n > 1 else rows[:0]
        columns, last = np.arange(n + 2), np.zeros(w, np.int64)
        while live.size:
            c = score[live].argmax(axis=1)
            last[live] = begin[live, c + 1]
            shift = np.minimum(columns + (columns > c[:, None]), n + 1)
            begin[live] = np.take_along_axis(begin[live], shift, 1)
            moved = np.minimum(columns[:n] + (columns[:n] > c[:, None]), n - 1)
            score[live] = np.take_along_axis(score[live], moved, 1)
            score[live, n - 1] = -np.inf
            for k in (c - 1, c):  # the pairs beside the merged symbol
                good = k >= 0
                r, q = live[good], k[good]
                a, b, middle = begin[r, q], begin[r, np.minimum(q + 2, n + 1)], begin[r, q + 1]
                there = (b > middle) & (middle > a) & (b - a <= self.longest)
                ids = np.where(there, self.find(span(r, a, b)), -1)
                score[r, q] = np.where(ids >= 0, self.scores[ids], -np.inf)
            live = live[score[live].max(axis=1) > -np.inf]
        a, b = begin[:, :n], begin[:, 1 : n + 1]
        used = b > a
        ids = np.where(used, self.find(span(rows[:, None], a, b)), -2)
        return np.where(used, a, n), ids, last

    def _bytes(self, grid: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end with bytes for what has no piece, and how many each row has."""
        row, col = np.nonzero(ids != -2)
        flat = ids[row, col]
        lone = np.flatnonzero(flat == -1)
        if not len(lone):
            return flat, np.bincount(row, minlength=len(grid))
        if (self.bytes < 0).any():
            flat[lone] = self.unknown
            return flat, np.bincount(row, minlength=len(grid))
        chars = grid[row[lone], begins[row[lone], col[lone]]].astype("<u4")
        raw = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        each = np.ones(len(flat), np.int64)
        each[lone] = width
        out = np.repeat(flat, each)
        out[np.repeat(flat == -1, each)] = self.bytes[np.frombuffer(raw, np.uint8)]
        return out, np.bincount(row, weights=each, minlength=len(grid)).astype(np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text, without the space in front."""
        got = self.text.take(pa.array(ids))
        data, off = views(got)
        raw, cuts = data.tobytes(), off[first]
        return [raw[a + (1 if raw[a : a + 1] == b" " else 0) : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _model_type(path: str) -> int:
    """TrainerSpec.model_type (1 unigram, 2 BPE), read from the file's protobuf fields."""

    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                size = number()
                yield key >> 3, data[at : at + size]
                at += size
            else:
                size = {1: 8, 5: 4}[key & 7]
                yield key >> 3, data[at : at + size]
                at += size

    with open(path, "rb") as f:
        trainer = dict(fields(f.read())).get(2, b"")
    return dict(fields(trainer)).get(3, 1)


def segments(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the texts' segments, the distinct segments, and each text's first segment."""
    texts = pc.fill_null(texts, "")
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    marked = pc.replace_substring(texts, " ", chr(SPACE))
    marked = pc.if_else(pa.array(some), pc.binary_join_element_wise(pa.scalar(chr(SPACE)), marked, ""), marked)
    data, off = views(marked)
    n = len(data)
    mark = np.zeros(n, bool)
    if n > 2:
        mark[: n - 2] = (data[: n - 2] == 0xE2) & (data[1 : n - 1] == 0x96) & (data[2:] == 0x81)
    starts = np.zeros(n + 1, bool)
    if n:
        after = np.zeros(n, bool)  # a mark ends just before
        after[3:] = mark[: n - 3]
        starts[:n] = mark & ~after
    starts[off] = True
    starts[n] = False
    begin = np.flatnonzero(starts)
    spans = np.append(begin, n).astype(np.int64)
    arr = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data))])
    coded = arr.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(begin, off)


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id and ids of each text."""
    return _encoded(docs, model, "doc_id long, ids array<int>", lambda batch, ids, first: [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))])


def _encoded(docs: DataFrame, model: PieceModel, schema: str, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = shared.value.encode(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns(batch, ids, first)], names=names)

    return mapped(docs.select("text", "doc_id"), fn, schema)


def pieces_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip (decoding
    the ids gives the text)."""
    model = PieceModel.from_file(model_path)

    def columns(batch: pa.RecordBatch, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        data, off = views(batch.column("text"))
        text = data.tobytes()
        same = [text[a:b] == got for a, b, got in zip(off[:-1], off[1:], model_of().decode(ids, first), strict=True)]
        return [pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(same)]

    shared = docs.sparkSession.sparkContext.broadcast(model)
    model_of = lambda: shared.value
    return _encoded(docs, model, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean", columns)
