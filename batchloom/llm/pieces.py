"""SentencePiece encoding and decoding as a max-plus scan over text chunks.

The encoding of a text by merges is its only segmentation in which every two
neighbouring pieces stay apart when merged on their own: up to the first merge
across a boundary, the merges of the whole text restricted to two neighbours
are those of the two alone. So encoding is a best path through the lattice of
vocabulary pieces, where a step from piece to piece weighs 0 if the two stay
apart and minus infinity if not. Weights of paths add up and paths compete by
their maximum; chunks of a text are matrices over the pieces that lie across
their ends, and products of these matrices are associative.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.batches import pieces_of
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import row_numbers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts of this many characters and more are cut into chunks.
GIANT, CHUNK = 65_536, 16_384
#: Matrices that one task combines.
FAN = 16
#: Words and pairs of pieces that a worker remembers; beyond, it starts anew.
REMEMBER = 80_000
#: Bytes of texts whose words are looked up together.
AT_ONCE = 300_000

_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")
_STARTS = re.compile(f"(?<!{SPACE}){SPACE}")


@dataclass
class Vocabulary:
    """Pieces of a merge model with identity normalisation and byte fallback."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_at: list[int]
    #: Pieces that merging makes of their own text, with single characters; and all pieces.
    ids: dict[str, int] = field(default_factory=dict, repr=False)
    every: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        """The last merge of every piece, its place in the order of merges, and whether all of it follows that order."""
        self.every = {p: i for i, (p, ok) in enumerate(zip(self.pieces, self.normal)) if ok}
        scores = {p: self.scores[i] for p, i in self.every.items()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        n = len(self.pieces)
        self.rank = np.array([place.get(s, 0) for s in self.scores], np.int64)
        self.left, self.right, self.plain = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
        shared = {s for s, c in Counter(scores.values()).items() if c > 1}
        for p, i in sorted(self.every.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                self.ids[p] = i
                continue
            steps: list[list[str]] = []
            if merged(p, scores, steps) != [p]:
                continue
            self.ids[p] = i
            a, b = steps[-1]
            self.left[i], self.right[i] = a, b = self.every[a], self.every[b]
            ordered = all(len(self.pieces[c]) == 1 or self.rank[c] < self.rank[i] for c in (a, b))
            self.plain[i] = ordered and self.plain[a] and self.plain[b] and scores[p] not in shared

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces:
            raise ValueError("only merge models with byte fallback, identity normalisation and a leading space are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, s in zip(pieces, special) if not s):
            raise ValueError("pieces with a space after another character are not supported")
        return cls(pieces, [sp.get_score(i) for i in range(n)], [not x for x in special], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def merged(text: str, scores: dict[str, float], steps: list | None = None) -> list[str]:
    """Symbols after merging the best-scored neighbours, leftmost first, until none is a piece."""
    symbols = list(text)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        if steps is not None:
            steps.append(symbols[at : at + 2])
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h + ord(c) + 1) * int(_MIX) & (2**64 - 1)
    return h


class Lattice:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        self.scores = {p: s for p, s, ok in zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal) if ok}
        self.fallback = vocabulary.bytes_at
        self.left, self.right, self.rank, self.plain = vocabulary.left, vocabulary.right, vocabulary.rank, vocabulary.plain
        self.normal = np.array(vocabulary.normal)
        self.ids = vocabulary.ids
        self.longest = max(map(len, self.ids))
        self.apart: dict[tuple[str, str], bool] = {}
        # Two pieces that make a third, sorted by both.
        ids = self.ids
        made = sorted((ids[p[:k]] << 16 | ids[p[k:]], int(self.rank[i])) for p, i in vocabulary.every.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.made = np.array([m[0] for m in made], np.int64)
        self.made_rank = np.array([m[1] for m in made], np.int64)
        # Prefixes of pieces by a hash of their characters, and which of them are pieces.
        prefixes = {p[:k] for p in ids for k in range(1, len(p) + 1)}
        hashed = sorted((_hash(p), ids.get(p, -1)) for p in prefixes)
        self.prefix_hash = np.array([h for h, _ in hashed], np.uint64)
        self.prefix_id = np.array([i for _, i in hashed], np.int32)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[(self.prefix_hash >> np.uint64(44)).astype(np.int64)] = np.arange(len(hashed))
        # Which pairs stay apart, as far as known: the last pair asked for in each slot.
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_apart = np.zeros(1 << 20, bool)
        self.length = np.array([1 if not ok else len(p) for p, ok in zip(vocabulary.pieces, vocabulary.normal)], np.int64)
        self.known: dict[str, int] = {}
        self.known_ids, self.known_at = np.empty(0, np.int32), np.zeros(1, np.int64)
        single = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_at)}
        self.bytes_of = [single.get(i, p.replace(SPACE, " ").encode("utf-8", "surrogatepass")) for i, p in enumerate(vocabulary.pieces)]

    def stay_apart(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > REMEMBER:
                self.apart.clear()
            found = self.apart[left, right] = merged(left + right, self.scores) == [left, right]
        return found

    def apart_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`stay_apart` of many pairs of ids."""
        key = left.astype(np.int64) << 16 | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        missed = self.pair_key[slot] != key
        if not missed.any():
            return self.pair_apart[slot]
        asked = np.unique(key[missed])
        value = self._walk(asked >> 16, asked & 0xFFFF)
        out = self.pair_apart[slot]
        out[missed] = value[np.searchsorted(asked, key[missed])]
        self.pair_key[slot[missed]] = key[missed]
        self.pair_apart[slot[missed]] = out[missed]
        return out

    def _walk(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the merges of two pieces, the later first: they stay apart unless what then meets at their boundary
        makes a piece of better score than the merges that take either side away."""
        out = np.ones(len(left), bool)
        odd = ~(self.plain[left] & self.plain[right]) & self.normal[left] & self.normal[right]
        for i in np.flatnonzero(odd):
            out[i] = self.stay_apart(self.pieces[left[i]], self.pieces[right[i]])
        at = np.flatnonzero(~odd)
        never = np.iinfo(np.int64).max
        l, r = left[at], right[at]
        above_l, above_r = np.full(len(at), never), np.full(len(at), never)
        while len(at):
            key = l << 16 | r
            k = np.minimum(np.searchsorted(self.made, key), len(self.made) - 1)
            across = np.where(self.made[k] == key, self.made_rank[k], never)
            meets = (across < above_l) & (across <= above_r)
            out[at[meets]] = False
            rank_l, rank_r = np.where(self.left[l] >= 0, self.rank[l], -1), np.where(self.left[r] >= 0, self.rank[r], -1)
            go = ~meets & ((rank_l >= 0) | (rank_r >= 0))
            at, l, r, above_l, above_r, rank_l, rank_r = (x[go] for x in (at, l, r, above_l, above_r, rank_l, rank_r))
            later = rank_r >= rank_l
            above_r, above_l = np.where(later, rank_r, above_r), np.where(later, above_l, rank_l)
            r, l = np.where(later, self.left[r], r), np.where(later, l, self.right[l])
        return out

    def best_paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and where each word's end: all lattices at once, by the offset that pieces begin at."""
        text = "".join(units)
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        stop = np.repeat(ends, sizes)
        # Steps: where each begins, its piece and length. Characters that are no piece stand as their first byte.
        live, h = np.arange(len(x)), np.zeros(len(x), np.uint64)
        begin, piece = [], []
        rare = np.zeros(len(units), bool)
        for n in range(1, self.longest + 1):
            h = (h + x[live + n - 1].astype(np.uint64) + np.uint64(1)) * _MIX
            at = self.slot[(h >> np.uint64(44)).astype(np.int64)]
            found = (at >= 0) & (self.prefix_hash[at] == h)
            if (unsure := np.flatnonzero(~found & (at >= 0))).size:  # another prefix has the slot
                k = np.minimum(np.searchsorted(self.prefix_hash, h[unsure]), len(self.prefix_hash) - 1)
                at[unsure], found[unsure] = k, self.prefix_hash[k] == h[unsure]
            ids = np.where(found, self.prefix_id[at], -1)
            if n == 1:
                none = ids < 0
                ids = np.where(none, np.asarray(self.fallback)[np.minimum(x, 255)], ids)
                rare[np.searchsorted(ends, live[none & (x >= 128)], side="right")] = True
            is_piece = ids >= 0
            begin.append(live[is_piece])
            piece.append(ids[is_piece])
            live, h = live[found], h[found]
            inside = live + n < stop[live]
            live, h = live[inside], h[inside]
        begin, piece = np.concatenate(begin), np.concatenate(piece).astype(np.int64)
        offset = begin - np.repeat(starts, sizes)[begin]
        order = np.argsort(offset, kind="stable")
        begin, piece, offset = begin[order], piece[order], offset[order]
        last = np.full(len(x) + 1, -1, np.int64)  # by the place of a prefix's last character, the piece that ends there
        cuts = np.searchsorted(offset, np.arange((int(sizes.max()) if len(sizes) else 0) + 1))
        for k in range(len(cuts) - 1):
            b, p = begin[cuts[k] : cuts[k + 1]], piece[cuts[k] : cuts[k + 1]]
            if k:
                before = last[b - 1]
                ok = before >= 0
                b, p, before = b[ok], p[ok], before[ok]
                ok = self.apart_pairs(before, p)
                b, p = b[ok], p[ok]
            last[b + self.length[p] - 1] = p
        # Back from the ends, all words in step.
        place, word = ends - 1, np.arange(len(units))
        took = []
        while len(word):
            p = last[place]
            took.append((word, p))
            place = place - self.length[p]
            on = place >= starts[word]
            place, word = place[on], word[on]
        word = np.concatenate([w for w, _ in took][::-1]) if took else np.empty(0, np.int64)
        ids = np.concatenate([p for _, p in took][::-1]) if took else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        ids, count = ids[order].astype(np.int32), np.bincount(word, minlength=len(units))
        if rare.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(rare):
                parts[i] = np.array(self.best(units[i]), np.int32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.cumsum(count)

    def best(self, unit: str) -> list[int]:
        """The path through one text from its start: the one last piece of each prefix, then the way back."""
        ids, longest = self.ids, self.longest
        last: list[str] = [""]
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if (piece in ids or end - start == 1) and (not start or (last[start] and self.stay_apart(last[start], piece))):
                    last.append(piece)
                    break
            else:
                last.append("")
        path, end = [], len(unit)
        while end:
            path.append(last[end])
            end -= len(last[end])
        return self.numbers(reversed(path))

    def numbers(self, path) -> list[int]:
        out = []
        for piece in path:
            at = self.ids.get(piece)
            out.extend([at] if at is not None else [self.fallback[b] for b in piece.encode("utf-8", "surrogatepass")])
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and their numbers of ids; each distinct word is a path only once while it is remembered."""
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > REMEMBER:
                self.known.clear()
                self.known_ids, self.known_at = np.empty(0, np.int32), np.zeros(1, np.int64)
                fresh = list(dict.fromkeys(units))
            ids, ends = self.best_paths(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.known_at = np.concatenate([self.known_at, ends + len(self.known_ids)])
            self.known_ids = np.concatenate([self.known_ids, ids])
        word = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        at, size = self.known_at[word], self.known_at[word + 1] - self.known_at[word]
        return self.known_ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; no piece lies across the start of a run of spaces, so words are units."""
        units = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids, size = self.encode_units(list(chain.from_iterable(units)))
        words = np.cumsum([0, *map(len, units)])
        cuts = np.concatenate([[0], np.cumsum(size)])[words]
        return np.split(ids, cuts[1:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # Chunks. A state at a cut is the piece that holds the character before it: (characters before the cut, piece).

    def states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """Every piece of ``text`` that begins before ``cut`` and ends at or after it."""
        if cut == 0:
            return [(0, "")]
        return [(cut - start, text[start:end]) for start in range(max(0, cut - self.longest), cut) for end in range(cut, min(len(text), start + self.longest) + 1)
                if text[start:end] in self.ids or end - start == 1]

    def paths(self, text: str, lo: int, hi: int, entries: list[tuple[int, str]]):
        """Nodes reached from each entry, by end: ``{end: {piece: (entries as bits, piece before)}}``."""
        at: dict[int, dict[str, list]] = {}
        for bit, (before, piece) in enumerate(entries):
            at.setdefault(lo - before + len(piece), {})[piece] = [1 << bit, None]
        for start in range(lo, hi):
            here = at.get(start)
            if not here:
                continue
            for end in range(start + 1, min(len(text), start + self.longest) + 1):
                piece = text[start:end]
                if piece in self.ids or end - start == 1:
                    bits, back = 0, {}
                    for left, (reach, _) in here.items():
                        if not left or self.stay_apart(left, piece):
                            bits |= reach
                            back[left] = reach
                    if bits:
                        at.setdefault(end, {})[piece] = [bits, back]
        return at

    def borders(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last start of a word in ``text[lo:hi]``; no piece lies across them."""
        starts = [m.start() for m in _STARTS.finditer(text, max(lo, 1) - 1, hi) if lo <= m.start() < hi]
        return (starts[0], starts[-1]) if starts else None

    def reached(self, text: str, lo: int, hi: int, entries: list, exits: list) -> np.ndarray:
        at = self.paths(text, lo, hi, entries)
        matrix = np.full((len(entries), len(exits)), -np.inf, np.float32)
        for j, (before, piece) in enumerate(exits):
            node = at.get(hi - before + len(piece), {}).get(piece)
            for i in range(len(entries)) if node is not None else ():
                if node[0] >> i & 1:
                    matrix[i, j] = 0.0
        return matrix

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """The max-plus matrix of ``text[lo:hi]`` from the states at lo to those at hi.

        All paths meet where a word starts, so between the first and the last
        start of a word the matrix has rank one.
        """
        entries, exits = self.states(text, lo), self.states(text, hi)
        if (found := self.borders(text, lo, hi)) is None:
            return self.reached(text, lo, hi, entries, exits)
        first, last = found
        head = self.reached(text, lo, first, entries, self.states(text, first)).max(axis=1) if first > lo else self._ended(entries)
        return head[:, None] + self.reached(text, last, hi, [(0, "")], exits)

    def _ended(self, entries: list) -> np.ndarray:
        """0 for the states whose piece ends just at the cut."""
        return np.array([0.0 if before == len(piece) else -np.inf for before, piece in entries], np.float32)

    def trace(self, text: str, lo: int, hi: int, entry: tuple[int, str], exit: tuple[int, str]) -> list[int]:
        """Ids of the pieces after ``entry`` up to and with ``exit``."""
        if (found := self.borders(text, lo, hi)) is None:
            return self.way(text, lo, hi, entry, exit)
        first, last = found
        head = []
        if first > lo:
            state = next(s for s, r in zip(self.states(text, first), self.reached(text, lo, first, [entry], self.states(text, first))[0]) if r == 0)
            head = self.way(text, lo, first, entry, state)
        middle = self.encode_units(_UNITS.findall(text[first:last]))[0].tolist() if last > first else []
        return [*head, *middle, *self.way(text, last, hi, (0, ""), exit)]

    def way(self, text: str, lo: int, hi: int, entry: tuple[int, str], exit: tuple[int, str]) -> list[int]:
        at = self.paths(text, lo, hi, [entry])
        path, end, piece = [], hi - exit[0] + len(exit[1]), exit[1]
        while (back := at[end][piece][1]) is not None:
            path.append(piece)
            end -= len(piece)
            piece = next(iter(back))
        return self.numbers(reversed(path))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _whole(vocabulary: Vocabulary):
    def told(lattice, batch):
        texts = batch.column("text").to_pylist()
        ids = lattice.encode_all(texts)
        decoded = [lattice.decode(x) for x in ids]
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string()), pa.array([x == y for x, y in zip(texts, decoded)], pa.bool_())], names=["doc_id", "ids", "decoded", "round_trip"])

    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in pieces_of(batches, "text", AT_ONCE):
            yield told(lattice, batch)

    return run


def _cut(longest: int, size: int):
    """Chunks of long texts, each with as much of its neighbours as a piece can reach."""

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = SPACE + text.replace(" ", SPACE)
                for k, lo in enumerate(range(0, len(text), size)):
                    hi = min(len(text), lo + size)
                    left = max(0, lo - longest)
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "lo": lo - left, "hi": hi - left, "near": text[left : hi + longest]}], pa.schema(
                        [("row", pa.int64()), ("k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("near", pa.string())]))

    return run


def _transfers(vocabulary: Vocabulary):
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            rows, shapes = [], []
            for near, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("near", "lo", "hi"))):
                matrix = lattice.transfer(near, lo, hi)
                rows.append(matrix.tobytes())
                shapes.append(list(matrix.shape))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(shapes, pa.list_(pa.int32())), pa.array(rows, pa.binary())], names=["row", "k", "shape", "matrix"])

    return run


def _matrices(frame) -> list[np.ndarray]:
    return [np.frombuffer(m, np.float32).reshape(s) for m, s in zip(frame["matrix"], frame["shape"])]


def _combined(frame):
    """The product of the matrices of neighbouring chunks, or groups of them, as one."""
    frame = frame.sort_values("k")
    whole = functools.reduce(product, _matrices(frame))
    return frame[["row", "g"]].iloc[:1].rename(columns={"g": "k"}).assign(shape=[list(whole.shape)], matrix=[whole.tobytes()])


def _top(frames):
    """The states that a whole text begins and ends in."""
    for frame in frames:
        yield frame[["row", "k"]].assign(entry=0, exit=[int(np.argmax(m[0])) for m in _matrices(frame)])


def _split(frame):
    """Entry and exit state of every part of a group, from those of the group: forwards from its entry, then back from its exit."""
    frame = frame.sort_values("k")
    matrices = _matrices(frame)
    entry, exit = int(frame["entry"].iloc[0]), int(frame["exit"].iloc[0])
    prefixes = [matrices[0][entry]]
    for matrix in matrices[1:]:
        prefixes.append((prefixes[-1][:, None] + matrix).max(axis=0))
    exits = [0] * len(matrices)
    exits[-1] = exit
    for k in range(len(matrices) - 1, 0, -1):
        exits[k - 1] = int(np.argmax(prefixes[k - 1] + matrices[k][:, exits[k]]))
    return frame[["row", "k"]].assign(entry=[entry, *exits[:-1]], exit=exits)


def _states(matrices: DataFrame, scratch: Scratch) -> DataFrame:
    """``row, k, entry, exit`` of every chunk, by products in a tree.

    Upwards, FAN neighbours at a time are combined until one matrix is left of
    each text; downwards, each group hands its states on to its parts. Every
    group is on its own, so no task sees more than FAN matrices, and the number
    of rounds is logarithmic in the chunks of the longest text.
    """
    levels = [scratch.keep(matrices, "matrices")]
    left = (levels[0].agg(F.max("k").alias("k")).first()["k"] or 0) + 1
    group = F.expr(f"k div {FAN}")
    while left > 1:
        up = levels[-1].withColumn("g", group).groupBy("row", "g").applyInPandas(_combined, "row long, k long, shape array<int>, matrix binary")
        levels.append(scratch.keep(up, "products"))
        left = -(-left // FAN)
    schema = "row long, k long, entry int, exit int"
    states = scratch.keep(levels.pop().mapInPandas(_top, schema), "states")
    for level in reversed(levels):
        above = states.select("row", F.col("k").alias("g"), "entry", "exit")
        states = scratch.keep(level.withColumn("g", group).join(above, ["row", "g"]).groupBy("row", "g").applyInPandas(_split, schema), "states")
    return states


def _traces(vocabulary: Vocabulary):
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            ids = []
            for near, lo, hi, entry, exit in zip(*(batch.column(c).to_pylist() for c in ("near", "lo", "hi", "entry", "exit"))):
                ids.append(lattice.trace(near, lo, hi, lattice.states(near, lo)[entry], lattice.states(near, hi)[exit]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "k", "ids"])

    return run


def _decoder(vocabulary: Vocabulary):
    def run(batches):
        lattice = Lattice(vocabulary)
        for batch in batches:
            decoded = [lattice.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), pa.array(decoded, pa.string())], names=["row", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids, decoded, round_trip`` per row of stored ``docs``: ids of its pieces, and the text made from these.

    Texts of fewer than ``giant`` characters are paths through the lattices of
    their words. Longer ones become chunks that are spread over the cluster:
    each yields its max-plus transfer matrix, products in a tree give every
    chunk the piece that lies across each of its ends, and each chunk is traced
    back on its own. A text is at most one cell of a table. Ids equal those of the public
    library for the same model file.

    Null and empty texts have no ids and decode to an empty text, which counts
    as a round trip. Texts that hold the model's own space mark (U+2581) decode
    with spaces in its place, as in the library, and are no round trip.
    Repeated rows and null doc_ids each give their row; other columns are not
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(model)
    source = row_numbers(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "row")
    is_long = F.char_length("text") >= giant
    short = source.filter(~is_long).select("doc_id", "text").mapInArrow(_whole(vocabulary), "doc_id long, ids array<int>, decoded string, round_trip boolean")
    scratch = Scratch(spark, "pieces")
    longest = max(len(p) for p, ok in zip(vocabulary.pieces, vocabulary.normal) if ok)
    long = scratch.keep(source.filter(is_long), "long")
    cut = long.select("row", "text").mapInArrow(_cut(longest, chunk), "row long, k long, lo int, hi int, near string")
    chunks = scratch.keep(cut.repartition("row", "k"), "chunks")
    matrices = chunks.select("row", "k", "near", "lo", "hi").mapInArrow(_transfers(vocabulary), "row long, k long, shape array<int>, matrix binary")
    traced = chunks.join(_states(matrices, scratch), ["row", "k"]).mapInArrow(_traces(vocabulary), "row long, k long, ids array<int>")
    whole = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("row", F.flatten(F.col("parts.ids")).alias("ids")).mapInArrow(_decoder(vocabulary), "row long, ids array<int>, decoded string")
    whole = whole.join(long, "row").select("doc_id", "ids", "decoded", (F.col("decoded") == F.col("text")).alias("round_trip"))
    return short.unionByName(whole)


def op5(spark, sf_dir: str) -> DataFrame:
    found = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "round_trip")
