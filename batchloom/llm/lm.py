"""Language model scores from a weighted backoff automaton over the whole corpus.

The model has order three. A word, or a pair of words, seen in training is a
state; an n-gram that begins with it and was seen is an arc to the state of its
last words. Where a state has no arc for the next word, its failure arc leads to
the state without the first word, and from the root every word has an arc.
Weights are those of Dirichlet smoothing: with ``c`` the count of a state and
``m`` the mass of its order, an arc weighs ``(count + m * lower) / (c + m)``,
where ``lower`` is the same word's weight one state down, and the failure arc
``m / (c + m)``. So each weight needs nothing but counts of single n-grams, and
no n-gram has to be brought together with others that share its first words.

No machine holds the automaton. Documents form blocks; a block asks for the
counts of its own n-grams, builds the part of the automaton that its words can
reach, and walks it over its documents, carrying the state.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import row_numbers
from batchloom.llm.words import mix, pack, steps, unpack

#: Bytes of text in a block (a longer text forms several), and of the corpus for one bucket of n-grams.
BLOCK_CHARS, BUCKET_CHARS = 3_000_000, 6_000_000
#: Tokens of one lane of the walk; longer texts take several, each entered in the state its last words left.
LANE = 2048
#: Bits by which keys of bigrams and trigrams exceed the logarithm of their number: one in 2**SPARE meets another's key.
SPARE = 20
#: Steps for each doubling in which counts of states are grouped to estimate a mass, and groups.
FINE, GROUPS = 4, 256

_END, _START = b" ", b"  "
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("before", pa.binary()), ("last", pa.bool_()), ("text", pa.binary())])


def _cut(data: bytes):
    """A text as ``(before, last, part)``: parts of about BLOCK_CHARS bytes that end between words.

    ``before`` has the two words before a part, an empty one for the start of
    the text; it is None where no word is before it.
    """
    at, before = 0, None
    while True:
        space = _SPACE.search(data, at + BLOCK_CHARS) if len(data) > at + BLOCK_CHARS else None
        end = space.start() if space else len(data)
        yield before, space is None, data[at:end]
        if space is None:
            return
        tail = 4096
        while len(words := data[max(0, end - tail) : end].lower().split()) < 3 and tail < end:
            tail *= 2
        before, at = b" ".join(([b""] + words)[-2:]) if words else None, end


def _blocks(batches):
    """``(number, parts)`` of blocks: the same whenever a partition is read, however it is batched."""
    number, size, rows = TaskContext.get().partitionId() << 32, 0, []
    for batch in batches:
        for row, doc_id, train, text in zip(*(batch.column(c) for c in ("row", "doc_id", "train", "text"))):
            for before, last, part in _cut(text.as_py() or b""):
                if rows and size + len(part) > BLOCK_CHARS:
                    yield number, pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)
                    number, size, rows = number + 1, 0, []
                rows.append((row.as_py(), doc_id.as_py(), train.as_py(), before, last, part))
                size += len(part) + 1
    if rows:
        yield number, pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)


class Block:
    """Tokens of some parts of texts, each with the one or two before it, and the keys of their n-grams.

    ``real`` says which tokens are the parts' own. ``keys[k]`` are the distinct
    n-grams of order ``k + 1``, sorted, ``of[k]`` the place there of the one
    that ends at each token (without meaning where there is none), ``at[k]`` a
    token where it ends, ``count[k]`` how often training texts have it.
    """

    def __init__(self, parts: pa.RecordBatch, bits: int):
        local = _Numbered()
        self.end, self.start = local[_END], local[_START]
        flat, sizes, own = [], [], []
        for before, last, text in zip(*(parts.column(c).to_pylist() for c in ("before", "last", "text"))):
            context = [_START] if before is None else [w or _START for w in before.split(b" ")]
            words = context + text.lower().split()
            if last:
                words.append(_END)
            flat.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words))
            own.append(len(words) - len(context))
        self.sizes, self.own = np.array(sizes), np.array(own)
        self.flat = np.concatenate(flat)
        del flat
        self.first = np.cumsum(self.sizes) - self.sizes
        n = len(self.flat)
        place = np.arange(n) - np.repeat(self.first, self.sizes)
        self.real = place >= np.repeat(self.sizes - self.own, self.sizes)
        self.words = len(local)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
        del local
        counted = self.real & np.repeat(parts.column("train").to_numpy(zero_copy_only=False).astype(bool), self.sizes)
        narrow = np.uint64(64 - bits)
        of_word = hashed[self.flat]
        two = mix(np.roll(of_word, 1) * _M + of_word)
        three = mix(np.roll(two, 1) * _M + of_word)
        self.keys, self.of, self.at, self.count = [], [], [], []
        order = np.argsort(hashed)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        self._add(hashed[order], moved[self.flat], order, counted)
        self._add(*_ranked(two >> narrow, place >= 1), counted)
        self._add(*_ranked(three >> narrow, place >= 2), counted)

    def _add(self, keys, of, at, counted):
        self.keys.append(keys)
        self.of.append(of)
        self.at.append(at)
        # Where there is no n-gram of an order the token is none of the part's own, or its first one's; that place is len(keys).
        self.count.append(np.bincount(of[counted], minlength=len(keys) + 1)[: len(keys)])

    def requests(self, bits: int, buckets: int):
        """For each bucket that counts some of them the keys of each order and their counts."""
        buckets_of = [((keys >> np.uint64(width - 32)) * np.uint64(buckets)) >> np.uint64(32) for keys, width in zip(self.keys, (64, bits, bits))]
        some = np.unique(np.concatenate(buckets_of))
        cuts = [(np.searchsorted(of, some), np.searchsorted(of, some, side="right")) for of in buckets_of]
        for k, b in enumerate(some.tolist()):
            parts = [(keys[low[k] : high[k]], count[low[k] : high[k]]) for keys, count, (low, high) in zip(self.keys, self.count, cuts)]
            yield b, pack(*(a for keys, count in parts for a in (steps(keys), count.astype(np.uint32))))


def _ranked(keys: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys among those that are there, the place of each, and where one of each stands."""
    at = np.flatnonzero(there)
    order = at[np.argsort(keys[at], kind="stable")]
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    of = np.full(len(keys), int(new.sum()), np.int64)
    of[order] = np.cumsum(new) - 1
    return ranked[new], of, order[new]


_REQUEST = (np.uint64, np.uint32) * 3


def _ask(bits: int, buckets: int):
    def run(batches):
        for number, parts in _blocks(batches):
            found = list(Block(parts, bits).requests(bits, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([number] * len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["bucket", "block", "request"])

    return run


def _texts(batches):
    """Each block's parts as one row."""
    for number, parts in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(parts)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "parts"])


def _group(counts: np.ndarray) -> np.ndarray:
    return np.minimum(FINE * np.log2(counts), GROUPS - 1).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: sums over all blocks, answered to each in the order it asked; and, as block -1, statistics of the bucket.

    Statistics are sparse: for each order the number of n-grams seen, of those
    seen once, and of their uses; then the states and uses by groups of counts.
    """
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    asked = [unpack(r.as_py(), *_REQUEST) for r in table.column("request")]
    answers: list[list[np.ndarray]] = [[] for _ in blocks]
    stats = []
    for k in range(3):
        keys = np.concatenate([np.cumsum(a[2 * k], dtype=np.uint64) for a in asked])
        counts = np.concatenate([a[2 * k + 1] for a in asked])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
        of = np.cumsum(new) - 1
        sums = np.bincount(of, counts[order], int(new.sum())).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = sums[of]
        done = 0
        for a, out in zip(asked, answers):
            out.append(back[done : done + len(a[2 * k])].astype(np.uint32))
            done += len(a[2 * k])
        seen = sums[sums > 0]
        group = _group(seen)
        stats += [np.array([len(seen), (seen == 1).sum(), seen.sum()]), np.bincount(group, minlength=GROUPS), np.bincount(group, seen, GROUPS).astype(np.int64)]
    bucket = table.column("bucket")[0].as_py()
    stats = np.concatenate(stats).astype(np.int64)
    return pa.table({"block": pa.array([*blocks, -1], pa.int64()), "bucket": pa.array([bucket] * (len(blocks) + 1), pa.int32()), "answer": pa.array([*(pack(*a) for a in answers), stats.tobytes()], pa.binary())})


_STATS = 3 + 2 * GROUPS


def _totals(batches):
    """Statistics of buckets as rows ``at, n`` to be summed."""
    for batch in batches:
        for data in batch.column("answer").to_pylist():
            stats = np.frombuffer(data, np.int64)
            some = np.flatnonzero(stats)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(stats[some])], names=["at", "n"])


def mass(once: int, uses: int, states: np.ndarray, state_uses: np.ndarray) -> float:
    """The mass with which failure arcs take as much as left-one-out n-grams need.

    Leaving one use of an n-gram out, it is unseen if it was used once, which
    goes for ``once`` of ``uses``; a state used ``c`` times then fails with
    ``m / (c - 1 + m)``. States come as numbers and uses by groups of counts.
    """
    there = states > 0
    if not uses or not there.any():
        return 1.0
    weight = state_uses[there] / state_uses[there].sum()
    rest = state_uses[there] / states[there] - 1
    low, high = -10.0, 40.0
    for _ in range(100):
        m = 2.0 ** ((low + high) / 2)
        if (weight * m / (rest + m)).sum() < once / uses:
            low = (low + high) / 2
        else:
            high = (low + high) / 2
    return 2.0**low


class Automaton:
    """The states and arcs that one block can reach, with their weights as log10.

    States are numbered: words, then bigrams, then the root. ``fail`` and
    ``back`` are a state's failure arc, ``keys`` its other arcs, as ``state *
    words + word``, sorted; the root's are ``root`` and ``enter``, by word.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], model: dict):
        one, two, three = (c.astype(np.float64) for c in counts)
        words, flat = block.words, block.flat
        self.words, self.block = words, block
        by_word = np.empty(words)
        by_word[block.at[0]] = one
        self.known = by_word > 0
        p_one = (by_word + 0.5) / (model["total"] + 0.5 * (model["distinct"] + 1))
        self.root = np.log10(p_one)
        by_word[block.start] = model["texts"]
        self.of_state = np.concatenate([by_word, two, [0.0]])
        self.top = words + len(two)
        m_two, m_three = model["mass"]
        lower, after = flat[block.at[1] - 1], flat[block.at[1]]
        context = by_word[lower]
        p_two = np.where(context > 0, (two + m_two * p_one[after]) / (context + m_two), p_one[after])
        self.back = np.concatenate([np.full(words, self.top), np.where(by_word[after] > 0, after, self.top), [self.top]])
        self.fail = np.concatenate([np.log10(m_two / (by_word + m_two)), np.log10(m_three / (two + m_three)), [0.0]])
        before, last = block.of[1][block.at[2] - 1], block.of[1][block.at[2]]
        context = two[before]
        p_three = (three + m_three * p_two[last]) / (context + m_three)
        seen_two, seen_three = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
        keys = np.concatenate([lower[seen_two] * words + after[seen_two], (words + before[seen_three]) * words + flat[block.at[2]][seen_three]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate([p_two[seen_two], p_three[seen_three]]))[order]
        self.next = (words + np.concatenate([seen_two, last[seen_three]]))[order]
        self.enter = np.where(self.known, np.arange(words), self.top)

    def entered(self, at: np.ndarray) -> np.ndarray:
        """The states in which tokens at these places are read: the longest words before them that are one."""
        flat, block = self.block.flat, self.block
        word = flat[at - 1]
        pair = np.minimum(block.of[1][at - 1], self.top - self.words - 1) + self.words
        has_pair = (block.of[1][at - 1] < self.top - self.words) & (self.of_state[pair] > 0)
        return np.where(has_pair, pair, np.where(self.of_state[word] > 0, word, self.top))

    def walk(self) -> np.ndarray:
        """One pass from left to right over every part, all side by side, each carrying its state."""
        block = self.block
        begin, own = block.first + block.sizes - block.own, block.own
        lanes = -(-own // LANE)
        owner = np.repeat(np.arange(len(own)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts, sizes = begin[owner] + nth * LANE, np.minimum(LANE, own[owner] - nth * LANE)
        order = np.argsort(-sizes, kind="stable")
        starts, owner, sizes = starts[order], owner[order], sizes[order]
        total = np.zeros(len(starts))
        state = self.entered(starts) if len(starts) else starts
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        keys = np.append(self.keys, np.iinfo(np.int64).max)
        for t, n in enumerate(live):
            word = block.flat[starts[:n] + t]
            gained = np.zeros(n)
            moving = np.arange(n)
            at_state, at_word = state[:n], word
            for _ in range(2):
                wanted = at_state * self.words + at_word
                arc = np.searchsorted(self.keys, wanted)
                hit = keys[arc] == wanted
                taken, arc = moving[hit], arc[hit]
                gained[taken] += self.weight[arc]
                state[taken] = self.next[arc]
                moving = moving[~hit]
                if not len(moving):
                    break
                at_word, at_state = at_word[~hit], at_state[~hit]
                gained[moving] += self.fail[at_state]
                at_state = self.back[at_state]
            gained[moving] += self.root[at_word] if len(moving) else 0.0
            state[moving] = self.enter[at_word] if len(moving) else 0
            total[:n] += gained
        return np.bincount(owner, total, len(own))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(bits: int, model: dict):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(docs.column("parts")[0].as_py()) as stream:
            parts = stream.read_next_batch()
        block = Block(parts, bits)
        found = [unpack(a.as_py(), *[np.uint32] * 3) for a in answers.sort_by("bucket").column("answer")]
        automaton = Automaton(block, [np.concatenate([f[k] for f in found]) for k in range(3)], model)
        part = np.repeat(np.arange(len(block.sizes)), block.sizes)[block.real]
        words = block.flat[block.real]
        total = lambda x: np.bincount(part, x[words], len(block.sizes))
        return pa.table({
            "row": parts.column("row"), "doc_id": parts.column("doc_id"), "held_out": pa.compute.invert(parts.column("train")), "n_tokens": pa.array(block.own, pa.int64()),
            "n_known": pa.array(total(automaton.known).astype(np.int64)), "base_score": pa.array(total(automaton.root)), "score": pa.array(automaton.walk())})

    return run


def score(docs: DataFrame, train: F.Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of stored ``docs``.

    Tokens are words (runs of other than ``[\\x20\\x09-\\x0D]``, A-Z
    lower-cased) and one end for each text; rows where ``train`` is false or
    null are held out from the counts. ``base_score`` is the log10 probability
    by the unigram model alone, ``score`` that of the automaton. All n-grams of
    the training texts are counted.

    An n-gram occurs once in what a block asks, whatever its share of the
    corpus, and goes to a bucket by its own hash, so no key gathers rows. A
    block sends at most a row for each bucket and for each n-gram. Words are
    told apart by 64 bits, longer n-grams by SPARE bits more than their number
    has. A task holds a block or a bucket; texts longer than a block are cut
    between words, and each part begins in the state that the words before it
    leave.

    Null texts count as empty and have just their end. Repeated rows and null
    doc_ids each get their row; other columns are not read. Without training
    texts every token is unknown, and both scores are equal. An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    source = row_numbers(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").cast("binary").alias("text")), "row")
    sizes = source.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if("train").alias("texts")).first()
    chars = sizes["n"] or 0
    buckets, bits = int(chars // BUCKET_CHARS) + 1, min(64, SPARE + max(16, int(chars).bit_length()))
    asked = source.mapInArrow(_ask(bits, buckets), "bucket int, block long, request binary")
    answers = scratch.keep(asked.groupBy("bucket").applyInArrow(_count, "block long, bucket int, answer binary"), "answers")
    sums = np.zeros(3 * _STATS, np.int64)
    for r in answers.filter("block = -1").select("answer").mapInArrow(_totals, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    one, two, three = np.split(sums, 3)
    masses = [mass(int(of[1]), int(of[2]), *np.split(states[3:], 2)) for of, states in ((two, one), (three, two))]
    model = {"total": int(one[2]), "distinct": int(one[0]), "texts": sizes["texts"], "mass": masses}
    blocks = source.mapInArrow(_texts, "block long, parts binary")
    scored = blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(_score(bits, model), _SCORED)
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True)))
