"""Similar lines across a corpus, by an exact set-similarity join."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.minhash import WordHashes
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach_large, row_numbers
from batchloom.llm.words import mix, pack, steps, unpack, words

#: Lines match from this Jaccard similarity of their sets of words on, in hundredths.
PERCENT = 75
#: Rarity is told by counts in so many hashed slots over all lines; a table of one byte each.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Parts in which the table is counted, and tasks whose counts one task sums.
PARTS, FAN = 64, 64
#: Characters of documents that a task works on at a time, and of the corpus for one bucket of the index.
BLOCK_CHARS, BUCKET_CHARS = 4_000_000, 8_000_000
#: Uses of a word from which its lines are held against each other in several cells, and lines of a cell's side.
HOT, CELL = 1 << 15, 1 << 14
#: Candidates before a line in a cell that it is held against at first; the rest only where none of these matches.
FIRST = 2
#: Lines just before a line in a cell that are looked at one by one, and lines of a cell that are then compared at once.
NEAR, DENSE = 24, 256
#: Distinct words from which a line's set is too large to be sent to each of its cells; its further candidates are held against it pair by pair.
WIDE = 512
#: Words with a larger share of all are in so many lines that the bitmaps, which tell lines apart, leave them out.
COMMON = 1 / 8192
#: Bits of the table, of fixed size, that tells most documents with wanted lines from the others; and bits in one row of it.
MARKS, MARK_ROW = 1 << 25, 1 << 15

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _slot(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _level(uses: np.ndarray) -> np.ndarray:
    """A byte for how often a slot is used; ONCE for a single use, and for no other number."""
    return np.round(8 * np.log2(uses + 1)).clip(0, 255).astype(np.uint8)


ONCE = int(_level(np.array([1]))[0])


class Lines:
    """The lines of some documents as sets of word hashes, side by side; lines without words are left out.

    ``row, line`` name a line, ``at`` and ``size`` its words within ``words``,
    which are in order of rarity, then hash, within each line.
    """

    def __init__(self, rows: list[int], texts: list[bytes], levels: np.ndarray):
        data = b"\n".join(texts)
        starts, hashes = words(data)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        sizes = np.array([len(t) + 1 for t in texts])
        top = np.searchsorted(ends, np.cumsum(sizes) - sizes)  # number of the first line of each text
        line = np.searchsorted(ends, starts)
        new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
        line, of = line[new], np.cumsum(new) - 1
        text = np.searchsorted(top, line, side="right") - 1
        self.row, self.line = np.array(rows, np.int64)[text], line - top[text]
        # One key has line, level and as much of the hash as fits; words that it can't tell apart are sorted by hash.
        bits = max(int(len(line)).bit_length(), 1)
        key = (of.astype(np.uint64) << np.uint64(64 - bits)) | (levels[_slot(hashes)].astype(np.uint64) << np.uint64(56 - bits)) | (hashes >> np.uint64(8 + bits))
        order = np.argsort(key)
        key, found = key[order], hashes[order]
        if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
            order = np.lexsort((hashes, key[np.argsort(order)]))
            found = hashes[order]
        of = of[order]
        kept = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1])) if len(of) else np.zeros(0, bool)
        self.of, self.words = of[kept], found[kept]
        self.size = np.bincount(self.of, minlength=len(self.row))
        self.at = np.cumsum(self.size) - self.size


def _texts(batches):
    """Rows and texts of about BLOCK_CHARS bytes at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for r, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            rows.append(r)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size > BLOCK_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _uses(batches):
    """How often this task's words use each slot, in PARTS rows, and as part -1 the bytes it read."""
    counts, total = np.zeros(SLOTS, np.int64), 0
    for _, texts in _texts(batches):
        data = b"\n".join(texts)
        np.add.at(counts, _slot(words(data)[1]), 1)
        total += len(data)
    parts = np.split(counts, PARTS)
    task = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([task] * (PARTS + 1), pa.int64()), pa.array([*range(PARTS), -1], pa.int32()), pa.array([*map(_sparse, parts), _sparse(np.array([total], np.int64))], pa.binary())], names=["task", "part", "uses"])


def _sparse(counts: np.ndarray) -> bytes:
    used = np.flatnonzero(counts)
    return pack(used.astype(np.uint32), counts[used].astype(np.uint64))


def _sum(last: bool):
    """Sums of the counts of a part; as the levels of its slots, and their sum, if these are the last."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(SLOTS // PARTS, np.int64)
        for data in table.column("uses"):
            at, n = unpack(data.as_py(), np.uint32, np.uint64)
            counts[at] += n.astype(np.int64)
        uses = pack(_level(counts), counts.sum(keepdims=True)) if last else _sparse(counts)
        return pa.table({"task": table.column("group")[:1], "part": table.column("part")[:1], "uses": pa.array([uses], pa.binary())})

    return run


def rarity(source: DataFrame, scratch: Scratch):
    """A level for each slot, higher for more used words, as a broadcast of fixed size; the level from which words are common; the bytes of the corpus.

    Tasks' counts are summed FAN at a time, so that no task holds more of them
    however many there are.
    """
    tasks = source.rdd.getNumPartitions()
    counts = source.mapInArrow(_uses, "task long, part int, uses binary")
    while tasks > FAN:
        counts, tasks = scratch.keep(_summed(counts, False), "uses"), -(-tasks // FAN)
    levels, uses, total = np.zeros(SLOTS, np.uint8), 0, 0
    for r in _summed(counts, True).collect():
        level, n = unpack(bytes(r["uses"]), np.uint8, np.int64)
        if r["part"] < 0:
            total = int(n[0])
        else:
            levels[r["part"] * len(level) : (r["part"] + 1) * len(level)] = level
            uses += int(n[0])
    return source.sparkSession.sparkContext.broadcast(levels), int(_level(uses * COMMON)), total


def _summed(counts: DataFrame, last: bool) -> DataFrame:
    grouped = counts.withColumn("group", F.expr(f"task div {FAN}")).groupBy("part", "group")
    return grouped.applyInArrow(_sum(last), "task long, part int, uses binary")


#: Of an entry: cell of a word, set, three words of a bitmap, row, line, size, place in the prefix, and number of the line in its block.
_ENTRY = (np.uint64, np.uint64, np.uint64, np.uint64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)


def _entries(levels, common: int, buckets: int):
    """For each bucket the prefix words of the lines; for bucket -1 lines equal to one before them in the same block.

    A word used once is in no other line and makes no entry. Blocks are named
    by their first row.
    """

    def run(batches):
        table = levels.value
        for rows, texts in _texts(batches):
            x = Lines(rows, texts, table)
            if not len(x.row):
                continue
            key = np.add.reduceat(mix(x.words + _M2), x.at) + x.size.astype(np.uint64) * _M1
            order = np.argsort(key)
            ranked = key[order]
            is_first = np.zeros(len(key), bool)
            is_first[np.minimum.reduceat(order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])))] = True
            gone = ~is_first
            yield _batch([-1], [pack(x.row[gone], x.line[gone])], rows[0])
            bit = mix(x.words * _M2)
            third = ((bit >> np.uint64(32)) * np.uint64(3)) >> np.uint64(32)
            level = table[_slot(x.words)]
            one = np.where(level < common, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            bits = [np.bitwise_or.reduceat(np.where(third == b, one, np.uint64(0)), x.at) for b in range(3)]
            of = x.of
            place = np.arange(len(of)) - x.at[of]
            prefix = x.size - (PERCENT * x.size + 99) // 100 + 1
            kept = np.flatnonzero((place < prefix[of]) & is_first[of])
            kept = kept[level[kept] != ONCE]
            word, of, level, place = x.words[kept], of[kept], level[kept], place[kept]
            cell, own = mix(word), np.ones(len(word), bool)
            uses = 2.0 ** (level / 8)
            if (hot := uses > HOT).any():
                sides = np.ceil(uses[hot] / CELL).astype(np.int64)
                mine = (key[of[hot]] % sides.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.flatnonzero(hot), sides)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(sides) - sides, sides)
                mine = np.repeat(mine, sides)
                p, q = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
                cell = np.concatenate([cell[~hot], mix(word[copy] + p * _M1 + q * _M2)])
                own = np.concatenate([own[~hot], mine == other])
                of, place = np.concatenate([of[~hot], of[copy]]), np.concatenate([place[~hot], place[copy]])
            order = np.argsort(cell)
            cell, of = cell[order], of[order]
            place = ((place << 1) | own)[order].astype(np.uint32)
            bucket = ((cell >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
            blobs = []
            for s in map(slice, first.tolist(), [*first[1:].tolist(), len(bucket)]):
                o = of[s]
                blobs.append(pack(steps(cell[s]), key[o], *(b[o] for b in bits), x.row[o].astype(np.uint64), x.line[o].astype(np.uint32), x.size[o].astype(np.uint32), place[s], o.astype(np.uint32)))
            yield _batch(bucket[first].astype(np.int32), blobs, rows[0])

    return run


def _batch(numbers, blobs: list[bytes], block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([block] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "data"])


_KINDS = EQUAL, PAIR, LATE, HELD = range(4)
_COLUMNS = ["row", "line", "row0", "line0", "kind", "bucket", "data"]


def _rows(kind: int, bucket: int, row, line, row0=-1, line0=-1, data=None) -> pd.DataFrame:
    return pd.DataFrame({"row": row, "line": line, "row0": row0, "line0": line0, "kind": kind, "bucket": bucket, "data": data})[_COLUMNS]


def _similar(c: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs may be similar: by length, then by place of the word they share, then by their bitmaps."""
    at = np.flatnonzero((PERCENT * c["size"][j] <= 100 * c["size"][i]) & (PERCENT * c["size"][i] <= 100 * c["size"][j]))
    i, j = i[at], j[at]
    both = c["size"][i] + c["size"][j]
    need = (PERCENT * both + 99 + PERCENT) // (100 + PERCENT)
    ok = np.minimum(c["left"][i], c["left"][j]) >= need
    at, i, j, both, need = at[ok], i[ok], j[ok], both[ok], need[ok]
    apart = np.bitwise_count(c["b0"][i] ^ c["b0"][j]).astype(np.int64)
    ok = both - apart >= 2 * need
    at, i, j, both, need, apart = at[ok], i[ok], j[ok], both[ok], need[ok], apart[ok]
    for name in ("b1", "b2"):
        apart = apart + np.bitwise_count(c[name][i] ^ c[name][j])
        ok = both - apart >= 2 * need
        at, i, j, both, need, apart = at[ok], i[ok], j[ok], both[ok], need[ok], apart[ok]
    return at


def _dense(c: dict, js: np.ndarray, lo: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The similar lines at least ``step`` before each of ``js`` in a cell that begins at ``lo``; by line, the nearest first."""
    span = np.arange(lo, int(js[-1]) - step + 1)
    size_j, size_i, left_j, left_i = c["size"][js][:, None], c["size"][span][None], c["left"][js][:, None], c["left"][span][None]
    ok = (100 + PERCENT) * np.minimum(left_j, left_i) >= PERCENT * (size_j + size_i)
    ok &= (PERCENT * size_j <= 100 * size_i) & (PERCENT * size_i <= 100 * size_j) & (span[None] <= js[:, None] - step)
    j, i = np.nonzero(ok[:, ::-1])
    j, i = js[j], span[len(span) - 1 - i]
    keep = _similar(c, i, j)
    return j[keep], i[keep]


def _earlier(c: dict, asked: np.ndarray, most: int | None, skip: int = 0):
    """For the asked places, sorted by cell and then table order, similar lines before them in their cell, the nearest first.

    Each gets up to ``most`` after its first ``skip``; gives ``(later, earlier, those with more to look at)``.
    """
    change = np.append(True, c["cell"][1:] != c["cell"][:-1])
    start = np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))
    hits = np.zeros(len(change), np.int64)
    later, earlier, more, step = [], [], [], 1
    live = asked[asked > start[asked]]
    c = c | {"size": c["size"].astype(np.int32), "left": (c["size"] - c["place"]).astype(np.int32)}
    while len(live) and step <= NEAR:
        other = live - step
        ok = _similar(c, other, live)
        found = live[ok]
        hits[found] += 1
        wanted = hits[found] > skip
        later.append(found[wanted])
        earlier.append(other[ok][wanted])
        step += 1
        on = live - step >= start[live]
        if most is not None:
            full = hits[live] >= most
            more.append(live[full & on])
            on &= ~full
        live = live[on]
    # Lines that still ask are held against all others of their cell at once, as rows of a table of pairs.
    for block in np.split(live, np.flatnonzero(np.diff(start[live])) + 1) if len(live) else ():
        for js in np.split(block, range(DENSE, len(block), DENSE)):
            j, i = _dense(c, js, int(start[js[0]]), step)
            rank = np.arange(len(j)) - np.searchsorted(j, j) + hits[j]
            wanted = (rank >= skip) if most is None else (rank < most)
            later.append(j[wanted])
            earlier.append(i[wanted])
            if most is not None:
                more.append(np.unique(j[~wanted]))
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(later), join(earlier), join(more)


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: lines equal to an earlier one, those that may be similar to earlier ones, and what later rounds need."""
    bucket = int(frame["bucket"].iloc[0])
    frame = frame.sort_values("block")
    if bucket < 0:
        row, line = (np.concatenate(a) for a in zip(*(unpack(d, np.int64, np.int64) for d in frame["data"])))
        return _rows(EQUAL, bucket, row, line)
    blobs = [unpack(d, *_ENTRY) for d in frame["data"]]
    cell, of_blob = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs]), np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
    # Only cells with several entries matter; they are brought into the order of cell, block and line.
    order = np.argsort(cell)
    same = cell[order][1:] == cell[order][:-1]
    order = order[np.append(False, same) | np.append(same, False)]
    cell = cell[order]
    rank = np.cumsum(np.append(0, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
    key, b0, b1, b2, row, line, size, place, number = (np.concatenate(a)[order] for a in list(zip(*blobs))[1:])
    del blobs
    again = np.lexsort((number, of_blob[order], rank)) if len(rank) and int(rank[-1]).bit_length() + len(frame).bit_length() > 31 else np.argsort((rank << 32 + len(frame).bit_length()) | (of_blob[order] << 32) | number)
    rank, key, b0, b1, b2, row, line, size, place = (a[again] for a in (rank, key, b0, b1, b2, row.astype(np.int64), line.astype(np.int64), size, place))
    # Of the lines of one set in a cell the first stays.
    both = mix(key + rank.astype(np.uint64) * _M2)
    order = np.argsort(both)
    new = np.append(True, both[order][1:] != both[order][:-1]) if len(order) else np.zeros(0, bool)
    is_first = np.zeros(len(order), bool)
    if len(order):
        is_first[np.minimum.reduceat(order, np.flatnonzero(new))] = True
    gone = ~is_first & (place == 1)  # by its first word, and where that is hot, in the cell of its own side
    parts = [_rows(EQUAL, bucket, row[gone], line[gone])]
    kept = np.flatnonzero(is_first)
    c = {"cell": rank[kept].astype(np.uint64), "row": row[kept], "line": line[kept], "place": (place[kept] >> 1).astype(np.int64), "size": size[kept].astype(np.int64), "b0": b0[kept], "b1": b1[kept], "b2": b2[kept]}
    later, earlier, more = _earlier(c, np.arange(len(kept)), FIRST)
    parts.append(_rows(PAIR, bucket, c["row"][later], c["line"][later], c["row"][earlier], c["line"][earlier]))
    if len(more):
        parts.append(_rows(LATE, bucket, c["row"][more], c["line"][more]))
        held = np.isin(c["cell"], c["cell"][more])
        data = pack(*[c[n][held] for n in _HELD])
        parts.append(_rows(HELD, bucket, [-1], [-1], data=[data]))
    return pd.concat(parts)


_HELD = {"cell": np.uint64, "row": np.int64, "line": np.int64, "place": np.int64, "size": np.int64, "b0": np.uint64, "b1": np.uint64, "b2": np.uint64}


#: Of a line that is compared within its cell; ``asks`` if further candidates stand before it. Pairs with a line of more than WIDE words are in part -1.
_FURTHER = {"bucket": "int32", "part": "int32", "cell": "int64", "row": "int64", "line": "int64", "place": "int64", "size": "int64", "b0": "int64", "b1": "int64", "b2": "int64", "asks": "bool", "row0": "int64", "line0": "int64"}
_FURTHER_SCHEMA = ", ".join(f"{n} {({'int32': 'int', 'int64': 'long', 'bool': 'boolean'})[t]}" for n, t in _FURTHER.items())


def _rest(key, late: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The lines of a bucket whose first candidates did not match, and all further candidates: each once for each cell, not for each pair."""
    if late.empty or held.empty:
        return pd.DataFrame({n: pd.Series(dtype=t) for n, t in _FURTHER.items()})
    bucket = int(late["bucket"].iloc[0])
    c = dict(zip(_HELD, unpack(held["data"].iloc[0], *_HELD.values())))
    wanted = pd.MultiIndex.from_arrays([c["row"], c["line"]]).isin(pd.MultiIndex.from_frame(late[["row", "line"]]))
    asks, used, parts = np.zeros(len(wanted), bool), np.zeros(len(wanted), bool), []
    asked = np.flatnonzero(wanted)
    for lo in range(0, len(asked), DENSE):
        later, earlier, _ = _earlier(c, asked[lo : lo + DENSE], None, FIRST)
        wide = np.maximum(c["size"][later], c["size"][earlier]) > WIDE
        asks[later[~wide]] = used[later[~wide]] = used[earlier[~wide]] = True
        j, i = later[wide], earlier[wide]
        parts.append(_further(bucket, -1, c, j, False, c["row"][i], c["line"][i]))
    at = np.flatnonzero(used)
    new = np.append(True, c["cell"][at][1:] != c["cell"][at][:-1]) if len(at) else np.zeros(0, bool)
    part = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) // CELL  # whole cells, so many lines that a task holds their sets
    return pd.concat([*parts, _further(bucket, part, c, at, asks[at], -1, -1)])


def _further(bucket: int, part, c: dict, at: np.ndarray, asks, row0, line0) -> pd.DataFrame:
    found = {n: c[n][at].view(np.int64) for n in _HELD}
    return pd.DataFrame({"bucket": bucket, "part": part, "asks": asks, "row0": row0, "line0": line0} | found, index=range(len(at)))[list(_FURTHER)].astype(_FURTHER)


def _compared(frame: pd.DataFrame) -> pd.DataFrame:
    """The lines that match, by their full sets, an earlier line of their cell."""
    frame = frame.sort_values(["cell", "row", "line"])
    c = {n: frame[n].to_numpy().view(t) for n, t in _HELD.items()}
    number, of = np.unique(_wide(b"".join(frame["words"])), return_inverse=True)
    sizes = frame["words"].str.len().to_numpy() // 6
    start = np.cumsum(sizes) - sizes
    mark, matched = np.zeros(len(number), bool), np.zeros(len(frame), bool)
    asked = np.flatnonzero(frame["asks"].to_numpy())
    for lo in range(0, len(asked), DENSE):
        later, earlier, _ = _earlier(c, asked[lo : lo + DENSE], None)
        order = np.argsort(later, kind="stable")
        later, earlier = later[order], earlier[order]
        for j, others in zip(later[np.flatnonzero(np.diff(later, prepend=-1))], np.split(earlier, np.flatnonzero(np.diff(later)) + 1)):
            own = of[start[j] : start[j] + sizes[j]]
            mark[own] = True
            for i in np.split(others, range(DENSE, len(others), DENSE)):
                n = sizes[i]
                ends = np.cumsum(n)
                both = np.add.reduceat(mark[of[np.repeat(start[i] - ends + n, n) + np.arange(ends[-1])]].astype(np.int64), ends - n)
                if (100 * both >= PERCENT * (n + sizes[j] - both)).any():
                    matched[j] = True
                    break
            mark[own] = False
    return pd.DataFrame({"row": c["row"][matched], "line": c["line"][matched]})


def _sets(batches):
    """The word sets of the wanted lines of each document, and whether each is a later or an earlier one of a pair."""
    hashes = WordHashes()
    for batch in batches:
        rows, numbers, later, earlier, sets = [], [], [], [], []
        for r, text, *wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "later", "earlier"))):
            found = (text or b"").lower().split(b"\n")
            after, before = map(set, wanted)
            for k in sorted(after | before):
                own = found[k].split()
                rows.append(r)
                numbers.append(k)
                later.append(k in after)
                earlier.append(k in before)
                sets.append(_narrow(np.unique(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)) >> np.uint64(16))))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(later, pa.bool_()), pa.array(earlier, pa.bool_()), pa.array(sets, pa.binary())], names=["row", "line", "later", "earlier", "words"])


def _narrow(x: np.ndarray) -> bytes:
    """Numbers of 48 bits as six bytes each."""
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _matching(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("a_words").to_pylist(), batch.column("b_words").to_pylist()):
            x, y = _wide(x), _wide(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("line")], names=["row", "line"]).filter(pa.array(keep, pa.bool_()))


def repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, line`` of each line of stored ``docs`` that an earlier line matches.

    Lines are ordered as in the table, and numbered from 0 within a text. Two
    lines match if the Jaccard similarity of their sets of words (runs of other
    than white space, A-Z lower-cased) is PERCENT hundredths or more. Lines
    without words match nothing. A line is removed for any earlier match,
    whether that is itself removed or not.

    Lines count as of one set if 64-bit sums over their words' hashes agree;
    where sets are compared, words are told apart by 48 bits.
    Words are ordered by rarity, then by hash. Matching lines share a word of
    their prefixes, so lines are indexed by these; lines of one set meet there
    once, however often they occur, and candidates are held to the length and
    positional bounds and to one by bitmaps of their less common words (what two
    lines' bitmaps differ in is at most what their sets do), then to the full
    sets. Words so frequent that their lines would not fit one task are split
    into cells of pairs of sides. A line is first held against the FIRST
    candidates before it in each cell; where none matches, against all others.
    For that a cell's lines are brought together with their sets, one row for
    each line; only pairs with a line of more than WIDE words get rows of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    source = row_numbers(docs.select(F.col(text).cast("string").cast("binary").alias("text")), "row").select("row", "text")
    levels, common, chars = rarity(source, scratch)
    buckets = int(chars // BUCKET_CHARS) + 1
    indexed = source.mapInArrow(_entries(levels, common, buckets), "bucket int, block long, data binary")
    # Blocks tell of their own repeated lines in bucket -1, spread over as many groups as there are buckets.
    spread = F.when(F.col("bucket") < 0, F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")).otherwise(F.lit(-1))
    schema = "row long, line long, row0 long, line0 long, kind int, bucket int, data binary"
    found = scratch.keep(indexed.withColumn("spread", spread).groupBy("bucket", "spread").applyInPandas(_pairs, schema), "pairs")
    gone = found.filter(F.col("kind") == EQUAL).select("row", "line")
    pairs = found.filter(F.col("kind") == PAIR).select("row", "line", "row0", "line0").distinct()
    matched = scratch.keep(_verified(pairs, source, scratch), "matched")
    late = found.filter(F.col("kind") == LATE).select("bucket", "row", "line").join(matched.hint("merge"), ["row", "line"], "left_anti").join(gone.hint("merge"), ["row", "line"], "left_anti")
    late = scratch.keep(late, "late")
    if not late.isEmpty():
        held = found.filter(F.col("kind") == HELD).select("bucket", "data")
        rest = scratch.keep(late.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(_rest, _FURTHER_SCHEMA), "rest")
        lines = rest.filter("part >= 0").drop("row0", "line0")
        wanted = lines.groupBy("row").agg(F.collect_set("line").alias("later"), F.array().cast("array<bigint>").alias("earlier"))
        schema = "row long, line long, later boolean, earlier boolean, words binary"
        sets = _likely(source, wanted).join(wanted.hint("merge"), "row").mapInArrow(_sets, schema).select("row", "line", "words")
        compared = lines.join(sets.hint("merge"), ["row", "line"]).groupBy("bucket", "part").applyInPandas(_compared, "row long, line long")
        wide = rest.filter("part < 0").select("row", "line", "row0", "line0").distinct()
        matched = matched.unionByName(compared).unionByName(_verified(wide, source, scratch))
    return gone.unionByName(matched).distinct()


def _likely(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``source`` that are among ``wanted``, and a few others, found without moving them.

    A table of MARKS bits, 4 MB at any size, is broadcast; the more rows are
    wanted the more others pass, up to all.
    """
    mark = F.pmod(F.xxhash64("row"), F.lit(MARKS))
    bits = wanted.select(mark.alias("mark")).groupBy(F.expr(f"int(mark div {MARK_ROW})").alias("part")).agg(F.bitmap_construct_agg(F.col("mark") % MARK_ROW).alias("bits"))
    at = (F.col("mark") % MARK_ROW).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.expr(f"int((mark % {MARK_ROW}) div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    marked = source.withColumn("mark", mark).withColumn("part", F.expr(f"int(mark div {MARK_ROW})")).join(F.broadcast(bits), "part")
    return marked.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*source.columns)


def _verified(pairs: DataFrame, source: DataFrame, scratch: Scratch) -> DataFrame:
    """The later lines of the pairs whose full sets match."""
    pairs = scratch.keep(pairs.withColumn("b", F.struct("row0", "line0")), "asked")
    ends = pairs.select("row", F.col("line").alias("later"), F.lit(None).cast("long").alias("earlier")).unionByName(
        pairs.select(F.col("row0").alias("row"), F.lit(None).cast("long").alias("later"), F.col("line0").alias("earlier")))
    wanted = ends.groupBy("row").agg(F.collect_set("later").alias("later"), F.collect_set("earlier").alias("earlier"))
    schema = "row long, line long, later boolean, earlier boolean, words binary"
    sets = scratch.keep(_likely(source, wanted).join(wanted.hint("merge"), "row").mapInArrow(_sets, schema), "sets")
    earlier = sets.filter("earlier").select(F.struct(F.col("row").alias("row0"), F.col("line").alias("line0")).alias("b"), F.col("words").alias("b_words"))
    both = attach_large(pairs, earlier, "b", F.col("row"))
    both = both.join(sets.filter("later").select("row", "line", F.col("words").alias("a_words")).hint("merge"), ["row", "line"])
    return both.select("row", "line", "a_words", "b_words").mapInArrow(_matching, "row long, line long").distinct()


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``row, doc_id, n_lines, removed`` per row of stored ``docs``: the sorted numbers of its :func:`repeated_lines`.

    Null texts have no line. Repeated rows repeat all lines of the first. Other
    columns are not read. An empty table gives no rows.
    """
    source = row_numbers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "row")
    rows = source.select("row", "doc_id", F.coalesce(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    gone = repeated_lines(docs, text).groupBy("row").agg(F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("removed"))
    return rows.join(gone.hint("merge"), "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def drop_repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of stored ``docs``, texts without their :func:`repeated_lines`.

    No row goes: a text of which every line is removed becomes empty, as that
    of each repeated row but the first does, and a null text stays null. Of
    lines that match, the first in the table stays. An empty table stays empty.
    """
    gone = repeated_lines(docs, text).groupBy(F.col("row").alias("_row")).agg(F.collect_list("line").alias("_gone"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i.cast("long")), F.lit(False))), "\n")
    return row_numbers(docs, "_row").join(gone, "_row", "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_row", "_gone")


def op9(spark, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))
