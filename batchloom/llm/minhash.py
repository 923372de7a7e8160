"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.batches import pieces_of
from batchloom.llm.components import components
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach, attach_large, row_numbers

WORDS = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: BANDS bands of ROWS minima each: a pair at 0.75 shares none with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Low bits kept of each minimum, and the standard deviations below a similarity of PERCENT at which an estimate still passes.
BITS, SIGMAS = 2, 5
#: Members of a band that one task compares with as many others.
BLOCK = 512

_SEED = np.random.default_rng(7)
_A = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words as asked for, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text in UTF-8.

    A-Z are lower-cased and words are runs of other than ``[\\x20\\x09-\\x0D]``
    (just what bytes.lower and bytes.split do). A text of fewer than five words
    is one shingle, one without words none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        found = found * _M + ids[i : len(words) - width + 1 + i]
    return np.unique(_mixed(found))


def minima(found: np.ndarray) -> np.ndarray:
    """For each of HASHES hash functions the least value over a set."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        values = np.multiply.outer(_A, found[at : at + 2048])
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _signatures(batches):
    hashes = WordHashes()
    power = _M ** np.arange(1, ROWS + 1, dtype=np.uint64)
    for batch in pieces_of(batches, "text"):
        n, keys, sigs, bands = [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = shingles(text, hashes)
            n.append(len(found))
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            least = minima(found)
            low = (least >> np.uint64(32)) & np.uint64(2**BITS - 1)
            sigs.append(np.concatenate([np.packbits((low >> np.uint64(b)) & np.uint64(1)).view(np.int64) for b in range(BITS)]) if len(found) else None)
            bands.append(_mixed((least.reshape(BANDS, ROWS) * power).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["row", "doc_id", "n", "key", "sig", "bands"])


def _sets(batches):
    hashes = WordHashes()
    for batch in pieces_of(batches, "text"):
        sets = [shingles(x, hashes).tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], names=["cid", "members"])


def _confirmed(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x_set").to_pylist(), batch.column("y_set").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["a", "b"]).filter(pa.array(keep))


def least_matches() -> int:
    """Equal b-bit minima below which a pair at the threshold is SIGMAS deviations away.

    Two differing minima agree in b bits with probability 2^-b, so a pair of
    similarity s is expected to agree in s + (1 - s) 2^-b of them; the estimate
    of s is the count corrected for that.
    """
    p = PERCENT / 100 + (1 - PERCENT / 100) * 2.0**-BITS
    return int(np.floor(HASHES * p - SIGMAS * np.sqrt(HASHES * p * (1 - p))))


def _matches(x: Column, y: Column) -> Column:
    """Equal b-bit minima of two packed signatures, by bit counts."""
    words = HASHES // 64
    total = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for b in range(BITS):
            at = b * words + w
            differ = differ.bitwiseOR(x[at].bitwiseXOR(y[at]))
        total = total + (F.lit(64) - F.bit_count(differ))
    return total


_CELL = ("i", "band", "p", "q")


def _possible(c: dict) -> np.ndarray:
    """Which pairs of a cell's two sides may be linked, are in different components, and meet in no earlier band."""
    left = np.flatnonzero(c["side"] == 0)
    right = left if c["same"][0] else np.flatnonzero(c["side"] == 1)
    overlap = np.minimum(c["inside"][left][:, None], c["inside"][right][None, :])
    ok = (c["label"][left][:, None] != c["label"][right][None, :]) & ((100 + PERCENT) * overlap >= PERCENT * (c["n"][left][:, None] + c["n"][right][None, :]))
    if c["same"][0]:
        ok &= np.tri(len(left), dtype=bool).T
    x, y = np.nonzero(ok)
    if not len(x):
        return np.empty((0, 2), np.int64)
    x, y = left[x], right[y]
    words, differ = HASHES // 64, 0
    for w in range(words):
        apart = np.zeros(len(x), np.uint64)
        for bit in range(BITS):
            apart |= c["sig"][x, bit * words + w] ^ c["sig"][y, bit * words + w]
        differ = differ + np.bitwise_count(apart).astype(np.int64)
    ok = HASHES - differ >= least_matches()
    x, y = x[ok], y[ok]
    ok = (c["bands"][x] == c["bands"][y]).argmax(axis=1) == c["i"][0]
    return np.stack([x[ok], y[ok]], axis=1)


def _linked(c: dict) -> list[tuple[int, int]]:
    """Links of a cell's possible pairs, by their full sets; none between classes that its links already connect."""
    pairs = _possible(c)
    above: dict[int, int] = {}

    def root(k: int) -> int:
        while k in above:
            k = above[k]
        return k

    links = []
    sets = [np.frombuffer(m, np.uint64) for m in c["members"]]
    for x in np.unique(pairs[:, 0]):
        own, rest = sets[x], pairs[pairs[:, 0] == x, 1]
        while len(rest := np.array([y for y in rest if root(c["label"][y]) != root(c["label"][x])], np.int64)):
            some, rest = rest[:64], rest[64:]
            flat = np.concatenate([sets[y] for y in some])
            sizes = np.array([len(sets[y]) for y in some])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for y in some[100 * both >= PERCENT * (len(own) + sizes - both)]:
                if (i := root(c["label"][x])) != (j := root(c["label"][y])):
                    above[i] = j
                    links.append((c["cid"][x], c["cid"][y]))
    return links


def _cells(each):
    """Runs ``each`` over the cells of whole partitions that are sorted by cell; it gets columns and their table."""

    def columns(table) -> dict:
        out = {}
        for name in table.column_names:
            column = table.column(name).combine_chunks()
            if name in ("sig", "bands"):
                out[name] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(table), -1)
            else:
                out[name] = column.to_pylist() if name == "members" else column.to_numpy(zero_copy_only=False)
        return out

    def told(table, last: bool):
        c = columns(table)
        change = np.zeros(len(table) - 1, bool)
        for name in _CELL:
            change |= c[name][1:] != c[name][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
        whole = len(starts) - 1 if last else len(starts) - 2
        for lo, hi in zip(starts[:whole].tolist(), starts[1:].tolist()):
            if hi - lo > 1:
                yield from each({k: v[lo:hi] for k, v in c.items()}, table.slice(lo, hi - lo))
        return None if last else table.slice(int(starts[-2]))

    def run(batches):
        waiting = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                waiting = yield from told(table if waiting is None else pa.concat_tables([waiting, table]), False)
        if waiting is not None:
            yield from told(waiting, True)

    return run


def _involved(c: dict, table):
    """The cell's rows that stand in a possible pair."""
    pairs = _possible(c)
    if len(pairs):
        yield from table.take(pa.array(np.unique(pairs))).to_batches()


def _confirmed_links(c: dict, table):
    if links := _linked(c):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def _exploded(batches):
    for batch in batches:
        sets = batch.column("members").to_pylist()
        sizes = [len(s) // 8 for s in sets]
        flat = pa.array(np.frombuffer(b"".join(sets), np.int64))
        of = np.repeat(np.arange(len(sets)), sizes)
        yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(of)), batch.column("label").take(pa.array(of)), flat], names=["cid", "label", "shingle"])


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of stored ``docs`` with its group of near duplicates.

    Texts with one shingle set form a class, so copies cost one signature
    comparison altogether. Classes that share a band of minima are candidates.
    First every class is held against the least class of each of its bands;
    the b-bit estimate drops what can't reach the threshold, and the full sets
    confirm. Then bands that still hold classes of several components are
    compared in cells of two blocks each, across components only: on how much
    of a class any other component has in common with it, on signatures, and
    where these allow a link, on the full sets, within the cell. Each pair is
    looked at in the first band that it shares, and a cell gives at most one
    link for each two components it connects. So components are those of all
    links between candidates, and no pair that is not linked becomes a row.

    Columns: ``row``, ``doc_id``, ``n_shingles``, ``component_id``, ``kept``
    and ``first`` (true for one row of each component). Null texts and texts
    without words are linked with nothing. Null doc_ids count as larger than
    all others; a component without any doc_id has a null component_id and
    keeps its first row. Repeated rows are in one component; where a doc_id is
    repeated, ``kept`` holds for each of its rows. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = row_numbers(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "row")
    sigs = scratch.keep(source.mapInArrow(_signatures, "row long, doc_id long, n long, key binary, sig array<long>, bands array<long>"), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = scratch.keep(
        sigs.filter("key is not null").groupBy("key").agg(F.count("*").alias("rows"), best, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    bands = classes.select("cid", F.posexplode("bands").alias("i", "band"))
    shared = scratch.keep(bands.groupBy("i", "band").agg(F.count("*").alias("size"), F.min("cid").alias("least")).filter("size > 1"), "bands")
    members = scratch.keep(attach(bands, shared, ["i", "band"], "size", F.col("cid")), "members")
    pairs = members.filter("cid <> least").select(F.col("cid").alias("x"), F.col("least").alias("y")).distinct()
    sig = classes.select("cid", "sig")
    tested = scratch.keep(pairs, "pairs")
    rows = members.select("cid").distinct().join(classes.select("cid", F.col("best.row").alias("row")), "cid")
    sets = scratch.keep(source.select("row", "text").join(rows, "row").select("cid", "text").mapInArrow(_sets, "cid long, members binary"), "sets")
    links = scratch.keep(_verified(_alike(tested, sig), sets, scratch), "links")
    labels = components(links, scratch)
    labelled = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = scratch.keep(labelled.groupBy("i", "band").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("i", "band", "size"), "mixed")
    if not mixed.isEmpty():
        rest = scratch.keep(attach(labelled.select("i", "band", "cid", "label"), mixed, ["i", "band"], "size", F.col("cid")), "rest")
        more = scratch.keep(_across(rest, classes, sets, scratch), "across")
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
    of = classes.select("cid", "key", "rows", "best").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = scratch.keep(of.groupBy("label").agg(F.count("*").alias("size"), F.min("best").alias("group_best")), "groups")
    facts = scratch.keep(attach(of, groups, ["label"], "size", F.col("cid")).select("key", "rows", "group_best"), "facts")
    out = attach(sigs.select("row", "doc_id", "n", "key"), facts, ["key"], "rows", F.col("row"), "left")
    alone = F.col("group_best").isNull()
    return out.select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_best.doc_id")).alias("component_id"),
        (alone | F.coalesce(F.col("doc_id") == F.col("group_best.doc_id"), F.col("row") == F.col("group_best.row"))).alias("kept"),
        (alone | (F.col("row") == F.col("group_best.row"))).alias("first"))


def _alike(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The stored pairs whose b-bit estimate allows a link."""
    both = attach_large(pairs, sig.select(F.col("cid").alias("y"), F.col("sig").alias("y_sig")), "y", F.col("x"))
    both = both.join(sig.select(F.col("cid").alias("x"), F.col("sig").alias("x_sig")), "x")
    return both.filter(_matches(F.col("x_sig"), F.col("y_sig")) >= least_matches()).select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Those pairs, as ``a, b``, whose full shingle sets are as similar as asked for."""
    pairs = scratch.keep(pairs, "asked")
    both = attach_large(pairs, sets.select(F.col("cid").alias("y"), F.col("members").alias("y_set")), "y", F.col("x"))
    both = both.join(sets.select(F.col("cid").alias("x"), F.col("members").alias("x_set")).hint("merge"), "x")
    return both.select("x", "y", "x_set", "y_set").mapInArrow(_confirmed, "a long, b long")


def _inside(rest: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``cid, n, inside``: how many shingles each class of ``rest`` has, and has in common with any of another component.

    No class of another component shares more with it. Classes that share too
    little with all others together, to be linked with any one, are left out.
    """
    shingled = scratch.keep(rest.join(sets, "cid").mapInArrow(_exploded, "cid long, label long, shingle long"), "shingles")
    common = shingled.groupBy("shingle").agg(F.count("*").alias("uses"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle", "uses")
    common = scratch.keep(common, "common")
    counted = attach(shingled.select("cid", "shingle"), common, ["shingle"], "uses", F.col("cid")).groupBy("cid").agg(F.count("*").alias("inside"))
    sizes = rest.join(sets, "cid").select("cid", (F.octet_length("members") / 8).cast("long").alias("n"))
    return scratch.keep(counted.join(sizes, "cid").filter(100 * F.col("inside") >= PERCENT * F.col("n")), "inside")


def _across(rest: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` across components within the bands of ``rest``: cell by cell, each a pair of blocks of a band.

    Signatures tell which members have anyone to be compared with; the sets of
    just these follow them into their cells.
    """
    inside = _inside(rest.select("cid", "label").distinct(), sets, scratch)
    rows = rest.join(inside, "cid")
    sizes = rows.groupBy("i", "band").agg(F.count("*").alias("size"))
    rows = rows.drop("size").join(sizes, ["i", "band"]).filter("size > 1").join(classes.select("cid", "sig", "bands"), "cid")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("i", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
                       (F.col("own") == F.col("other")).alias("same"), "cid", "label", "n", "inside", "sig", "bands")
    dealt = lambda df: df.repartition(*_CELL).sortWithinPartitions(*_CELL)
    involved = scratch.keep(dealt(rows).mapInArrow(_cells(_involved), rows.schema), "involved")
    return dealt(involved.join(sets, "cid")).mapInArrow(_cells(_confirmed_links), "a long, b long")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored ``docs`` with one row left of each component of :func:`near_groups`, all columns.

    The row with the least doc_id stays, null as the largest, and of several
    with that doc_id the first in the table. Null texts and texts without words
    all stay; an empty table stays empty.
    """
    kept = near_groups(docs, text, doc_id).filter("first").select(F.col("row").alias("_row"))
    return row_numbers(docs, "_row").join(kept, "_row", "left_semi").drop("_row")


def op7(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "first")
