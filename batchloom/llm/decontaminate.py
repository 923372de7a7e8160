"""Benchmark passages in documents, by the q-gram lemma and banded alignment."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.batches import pieces_of
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import row_numbers

#: Letters and digits of a passage segment, edits allowed in one, and length of the grams.
SEGMENT, EDITS, Q = 72, 6, 8
#: Items with fewer letters and digits can't be told from ordinary prose within a line; they are looked for as whole lines.
LEAST = 32
#: Characters of benchmark text that one index holds; larger benchmarks take several passes.
INDEX_CHARS = 2_000_000
#: Characters of documents searched at a time, and places of grams in items that are expanded at a time.
BLOCK, POSTINGS = 1_000_000, 2_000_000
#: Letters of text that a segment with its edits and a gram can reach over.
REACH = SEGMENT + 2 * EDITS + Q

_P = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 22
_EMPTY = np.uint32(1)


def _fold_table() -> np.ndarray:
    """Code point to lower-cased letter or digit, 0 for what is left out; beyond the first plane as is."""
    table = np.zeros(0x110000, np.uint32)
    table[0x10000:] = np.arange(0x10000, 0x110000, dtype=np.uint32)
    for i in range(2, 0x10000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    table[0] = _EMPTY
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(x: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each position on, by doubling."""
    h, width = x.astype(np.uint64) + np.uint64(1), 1
    while width < Q:
        h = h[:-width] * (_P ** np.uint64(width)) + h[width:]
        width *= 2
    return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


@dataclass
class Index:
    """Letters of benchmark items, one after another, and where their grams are; a segment is named by the place of its first letter."""

    items: np.ndarray
    letters: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lengths: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    slots: np.ndarray
    keys: np.ndarray
    codes: np.ndarray
    short: dict[bytes, list[int]]

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index | None:
        """Each item with the length, budget and least shared grams of its segments; short items are one segment.

        ``codes`` are all grams of the items as ``place in keys << 32 | place in
        letters``, sorted. Items of fewer than LEAST letters are in ``short``.
        """
        table = _fold_table()
        items, parts, short = [], [], {}
        for item, text in rows:
            folded = table[_points(text or "")]
            folded = folded[folded > _EMPTY]
            if len(folded) >= LEAST:
                items.append(item)
                parts.append(folded)
            elif len(folded):
                short.setdefault(folded.tobytes(), []).append(item)
        if not parts and not short:
            return None
        if not parts:
            none = np.empty(0, np.int64)
            return cls(none, none.astype(np.uint32), none, none, none, none, none, none, np.zeros(1 << _SLOT_BITS, bool), none.astype(np.uint64), none, short)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        lengths = np.minimum(sizes, SEGMENT)
        edits = np.minimum(EDITS, (lengths - Q) // (Q + 2))
        h = np.concatenate([_grams(p) for p in parts])
        places = np.concatenate([np.arange(end - size, end - Q + 1) for size, end in zip(sizes, ends)])
        keys, of = np.unique(h, return_inverse=True)
        slots = np.zeros(1 << _SLOT_BITS, bool)
        slots[_slots(keys)] = True
        return cls(np.array(items, np.int64), np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), ends - sizes, ends, lengths, edits, lengths - Q + 1 - edits * Q, slots, keys, np.sort(of << 32 | places), short)

    def search(self, x: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and edits of every region of folded text within the budget of a segment of the item.

        ``borders`` are the positions at which another document begins; an item
        that a document quotes exactly is not looked for in it any further.
        """
        none = (np.empty(0, np.int64),) * 3
        if len(x) < Q or not len(self.keys):
            return none
        h = _grams(x)
        at = np.flatnonzero(self.slots[_slots(h)])
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[key] == h[at]
        at, key = at[real], key[real]
        if not len(at):
            return none
        # A stretch of text and one of the items at a time, as small as keeps the places that their grams share few.
        found, parts = [], [(0, len(x), 0, len(self.letters))]
        while parts:
            lo, hi, a, b = parts.pop()
            i, j = np.searchsorted(at, [lo, hi])
            first, last = np.searchsorted(self.codes, key[i:j] << 32 | a), np.searchsorted(self.codes, key[i:j] << 32 | b)
            if (last - first).sum() > POSTINGS:
                if hi - lo > 4 * REACH:
                    middle = (lo + hi) // 2
                    parts += [(lo, middle + REACH, a, b), (middle - REACH, hi, a, b)]
                    continue
                if self.item[a] < self.item[b - 1]:
                    middle = int(self.starts[(self.item[a] + self.item[b - 1] + 1) // 2])
                    parts += [(lo, hi, a, middle), (lo, hi, middle, b)]
                    continue
            found.append(self._near(x, at[i:j], first, last - first, borders))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _near(self, x: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, borders: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`search` among the ``n`` gram places from ``first`` on of each position ``at``."""
        none = (np.empty(0, np.int64),) * 3
        place = self.codes[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] & 0xFFFFFFFF
        diagonal = np.repeat(at, n) - place + len(self.letters)
        band = diagonal // EDITS
        place, start = self.candidates(np.concatenate([band << 32 | place, (band - 1) << 32 | place]))
        if not len(place):
            return none
        # A document that quotes an item exactly has one of its segments' grams all on one diagonal.
        exact_place, exact_start = self.exact(diagonal << 32 | np.repeat(at, n))
        pair = lambda place, start: self.documents(place, start, borders) * len(self.items) + self.item[place]
        quoted, one = np.unique(pair(exact_place, exact_start), return_index=True)
        exact_place, exact_start = exact_place[one], exact_start[one]
        zero = self.align(x, exact_place, exact_start)
        known = zero == 0
        left = ~np.isin(pair(place, start), quoted[known])
        place, start = place[left], start[left]
        distance = np.concatenate([zero[known], self.align(x, place, start)])
        place, start = np.concatenate([exact_place[known], place]), np.concatenate([exact_start[known], start])
        item = self.item[place]
        ok = distance <= self.edits[item]
        return np.maximum(start[ok], 0), item[ok], distance[ok]

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments that share enough grams with a band (``band << 32 | place of the gram``), and where in the text the band begins for them."""
        code.sort()
        item = self.item[code & 0xFFFFFFFF]
        last = np.arange(len(code)) + self.needed[item] - 1
        i = np.flatnonzero(last < len(code))
        i = i[(code[last[i]] - code[i] <= self.lengths[item[i]] - Q) & (item[last[i]] == item[i])]
        item, band, last = item[i], code[i] >> 32, last[i]
        # Within a band and item both ends rise, so each segment is taken once if a run begins behind the one before.
        low = np.maximum((code[last] & 0xFFFFFFFF) - self.lengths[item] + Q, self.starts[item])
        high = np.minimum(code[i] & 0xFFFFFFFF, self.ends[item] - self.lengths[item])
        again = (np.diff(band) == 0) & (np.diff(item) == 0)
        low[1:][again] = np.maximum(low[1:][again], high[:-1][again] + 1)
        n = np.maximum(high - low + 1, 0)
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return place, np.repeat(band, n) * EDITS - len(self.letters) + place

    def exact(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments whose grams all stand on one diagonal (``diagonal << 32 | position of the gram``), and their positions."""
        code.sort()
        position = code & 0xFFFFFFFF
        place = position - (code >> 32) + len(self.letters)
        item = self.item[place]
        last = np.arange(len(code)) + self.lengths[item] - Q
        i = np.flatnonzero(last < len(code))
        i = i[(code[last[i]] - code[i] == self.lengths[item[i]] - Q) & (item[last[i]] == item[i])]
        return place[i], position[i]

    def documents(self, place: np.ndarray, start: np.ndarray, borders: np.ndarray | None) -> np.ndarray:
        """The document in which the middle of each region lies."""
        if borders is None:
            return np.zeros(len(place), np.int64)
        return np.searchsorted(borders, np.maximum(start, 0) + self.lengths[self.item[place]] // 2, side="right")

    def align(self, x: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Least edits between each segment and a stretch of text that begins within its band."""
        out = np.empty(len(place), np.int64)
        width = 4 * EDITS + 1
        steps = np.arange(width)
        padded = np.concatenate([np.zeros(2 * SEGMENT, np.uint32), x, np.zeros(2 * SEGMENT + width, np.uint32)])
        for lo in range(0, len(place), 4096):
            p = place[lo : lo + 4096]
            lengths = self.lengths[self.item[p]]
            origin = start[lo : lo + 4096] - EDITS + 2 * SEGMENT
            text = padded[np.clip(origin[:, None] + np.arange(SEGMENT + width), 0, len(padded) - 1)]
            cost = np.zeros((len(p), width), np.int16)
            best = np.zeros(len(p), np.int64)
            for i in range(SEGMENT):
                new = cost + (text[:, i : i + width] != self.letters[np.minimum(p + i, len(self.letters) - 1), None])
                np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
                cost = (np.minimum.accumulate(new - steps, axis=1) + steps).astype(np.int16)
                done = lengths == i + 1
                if done.any():
                    best[done] = cost[done].min(axis=1)
            out[lo : lo + 4096] = best
        return out


def _hits(texts: list[str | None], index: Index | None, table: np.ndarray) -> list[dict[int, int]]:
    """For each text the items found in it, with their least edits; long texts are searched in overlapping parts."""
    found: list[dict[int, int]] = [{} for _ in texts]
    if index is None:
        return found
    gap = "\0" * (EDITS + Q)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < BLOCK):
            size += len(texts[hi] or "")
            hi += 1
        if size > BLOCK:
            tail = np.empty(0, np.uint32)
            for at in range(0, size, BLOCK):
                folded = table[_points(texts[lo][at : at + BLOCK])]
                x = np.concatenate([tail, folded[folded > 0]])
                _tell(index, x, None, found[lo : lo + 1])
                tail = x[max(0, len(x) - REACH) :]
        else:
            part = [t or "" for t in texts[lo:hi]]
            folded = table[_points(gap.join(part))]
            kept = folded > 0
            ends = np.cumsum(kept)[np.cumsum([len(t) + len(gap) for t in part[:-1]]) - 1] if len(part) > 1 else np.empty(0, np.int64)
            _tell(index, folded[kept], ends, found[lo:hi])
        lo = hi
    if index.short:
        for text, hits in zip(texts, found):
            _whole_lines(text or "", index.short, table, hits)
    return found


def _tell(index: Index, x: np.ndarray, ends: np.ndarray | None, found: list[dict[int, int]]) -> None:
    where, entry, edits = index.search(x, ends)
    middle = where + index.lengths[entry] // 2
    docs = np.searchsorted(ends, middle, side="right") if ends is not None else np.zeros(len(middle), np.int64)
    for doc, item, e in zip(docs.tolist(), index.items[entry].tolist(), edits.tolist()):
        found[doc][item] = min(e, found[doc].get(item, e))


def _whole_lines(text: str, short: dict[bytes, list[int]], table: np.ndarray, hits: dict[int, int]) -> None:
    """Short items that are all letters and digits of a line."""
    points = _points(text)
    folded = table[points]
    ends = np.append(np.flatnonzero(points == 10), len(points))
    before = np.append(0, np.cumsum(folded > _EMPTY))
    starts = np.append(0, ends[:-1] + 1)
    sizes = before[ends] - before[starts]
    for k in np.flatnonzero((sizes > 0) & (sizes < LEAST)):
        line = folded[starts[k] : ends[k]]
        for item in short.get(line[line > _EMPTY].tobytes(), ()):
            hits[item] = 0


def _scan(index: Index | None):
    def run(batches):
        table = _fold_table()
        for batch in pieces_of(batches, "text"):
            found = _hits(batch.column("text").to_pylist(), index, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array([min(f.values(), default=None) for f in found], pa.int64())],
                names=["row", "doc_id", "item_ids", "edits"])

    return run


def _clean(index: Index | None, text: str):
    def run(batches):
        table = _fold_table()
        for batch in pieces_of(batches, text):
            yield batch.filter(pa.array([not f for f in _hits(batch.column(text).to_pylist(), index, table)], pa.bool_()))

    return run


def _indexes(benchmark: DataFrame, item_id: str, item_text: str):
    """The benchmark's indexes, each of about INDEX_CHARS characters."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null and item_id is not null")
    blocks = int((items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0) // INDEX_CHARS) + 1
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield blocks, Index.build(sorted((r["item_id"], r["text"]) for r in rows))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row, doc_id, contaminated, item_ids, edits`` per row of stored ``docs``.

    Texts are compared by their letters and digits, lower-cased. A document is
    contaminated by an item if it holds, within EDITS insertions, deletions and
    substitutions, a stretch of SEGMENT letters of it (the whole item where
    that is shorter, with a smaller budget). By the q-gram lemma such a stretch
    shares at least ``length - Q + 1 - edits * Q`` grams with it, all on nearby
    diagonals; only bands with as many are aligned. Shorter shared phrases,
    which unrelated texts have too, do not count. An item of fewer than LEAST
    letters counts where it is all letters and digits of a line.

    ``item_ids`` are sorted, ``edits`` the least over them (null if none). Items
    without a letter or digit, or null, match nothing. Null texts are clean.
    Texts are searched BLOCK characters at a time, and POSTINGS places that
    their grams share with items, so memory does not follow either's length.
    The benchmark is indexed in blocks of INDEX_CHARS characters, and the
    documents read once for each. Other columns are not read; repeated rows
    each get their row; an empty table gives no rows, an empty benchmark none
    that are contaminated.
    """
    source = row_numbers(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "row").select("row", "doc_id", "text")
    blocks, parts = _found(source, benchmark, item_id, item_text)
    hits = parts[0] if blocks == 1 else None
    if hits is None:
        joined = _union(parts).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.min("edits").alias("edits"))
        hits = source.select("row", "doc_id").join(joined, "row", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<bigint>")))
    return hits.select("row", "doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "edits")


def _found(source: DataFrame, benchmark: DataFrame, item_id: str, item_text: str) -> tuple[int, list[DataFrame]]:
    """Hits by block of the benchmark: all rows of the source for a single one, else stored tables of the rows hit."""
    scratch, parts, blocks = Scratch(source.sparkSession, "decontaminate"), [], 0
    for blocks, index in _indexes(benchmark, item_id, item_text):
        hits = source.mapInArrow(_scan(index), "row long, doc_id long, item_ids array<long>, edits long")
        parts.append(hits if blocks == 1 else scratch.keep(hits.filter(F.size("item_ids") > 0).drop("doc_id"), "hits"))
    return blocks, parts


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of stored ``docs`` that :func:`contamination` finds clean, all columns.

    A benchmark of one block needs no shuffle; of a larger one the rows hit are
    stored block by block and left out by a join. Null and empty texts are
    clean and stay, repeated rows stay or go together, an empty table stays
    empty, and an empty benchmark drops nothing.
    """
    indexes = _indexes(benchmark, item_id, item_text)
    blocks, index = next(indexes)
    if blocks == 1:
        return docs.mapInArrow(_clean(index, text), docs.schema)
    source = row_numbers(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "row")
    _, parts = _found(source, benchmark, item_id, item_text)
    return row_numbers(docs, "_row").join(_union(parts).select(F.col("row").alias("_row")).hint("merge"), "_row", "left_anti").drop("_row")


def op2(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark")).drop("row")
