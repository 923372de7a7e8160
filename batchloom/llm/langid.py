"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.batches import pieces_of

#: Bound of the training sample: labelled texts for each language, snippets of each, and bytes of a snippet.
PER_LANGUAGE, SNIPPETS, SNIPPET = 800, 6, 96
#: State of each direction, training steps, snippets a step, and step size.
STATE, STEPS, BATCH, RATE = 8, 260, 256, 0.02
#: Bytes that one run of the network labels, those before and after them that it reads first, and runs side by side.
WINDOW, MARGIN, LANES = 512, 64, 512
#: Times that of chance which a score has to reach, else a text is taken to be in no learned language, where such texts go.
FLOOR = 1.02

_PLAIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode category L."""
    return _PLAIN.search(text) is not None or any(map(str.isalpha, text))


@dataclass
class Network:
    """Weights of both directions and of the layer that labels a position.

    ``gates[d]`` has a row of 3 * STATE inputs for each byte (update, reset,
    candidate), ``turn[d]`` the weights of the state before, ``out`` those of
    both states and a constant.
    """

    languages: list[str]
    gates: np.ndarray
    turn: np.ndarray
    out: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        h = STATE
        return cls(languages, rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32), rng.normal(0, 0.3, (2, h, 3 * h)).astype(np.float32), rng.normal(0, 0.3, (2 * h + 1, len(languages))).astype(np.float32))

    def states(self, x: np.ndarray, d: int, keep: bool = False, inside: np.ndarray | None = None):
        """States after each byte of ``x`` (time, lanes), read forwards (d = 0) or backwards; 0 where not ``inside``."""
        h, (steps, lanes) = STATE, x.shape
        states = np.empty((steps, lanes, h), np.float32)
        state = np.zeros((lanes, h), np.float32)
        kept = [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            inputs = self.gates[d].take(x[t], axis=0)
            turned = state @ self.turn[d]
            gate = inputs[:, : 2 * h] + turned[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            fresh = gate[:, h:] * turned[:, 2 * h :]
            fresh += inputs[:, 2 * h :]
            np.tanh(fresh, out=fresh)
            if keep:
                kept[t] = (state, gate, fresh, turned[:, 2 * h :])
            state = state + gate[:, :h] * (fresh - state)
            if inside is not None:
                state *= inside[t][:, None]
            states[t] = state
        return (states, kept) if keep else states

    def label(self, x: np.ndarray, inside: np.ndarray | None = None, margin: int = 0) -> np.ndarray:
        """Logarithms of the languages' probabilities at each position of ``x`` but the first and last ``margin``."""
        h = STATE
        steps, lanes = x.shape
        read = slice(margin, steps - margin)
        logits = self.states(x, 0, inside=inside)[read].reshape(-1, h) @ self.out[:h]
        logits += self.states(x, 1, inside=inside)[read].reshape(-1, h) @ self.out[h : 2 * h]
        logits += self.out[2 * h]
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits.reshape(steps - 2 * margin, lanes, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross entropy at all positions, by backpropagation through time."""
        h, (steps, lanes) = STATE, x.shape
        runs = [self.states(x, d, keep=True) for d in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0], np.ones((steps, lanes, 1), np.float32)], axis=2).reshape(steps * lanes, -1)
        logits = both @ self.out
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        target = np.tile(y, steps)
        at = np.arange(len(target))
        loss = float(-np.log(p[at, target] + 1e-9).mean())
        p[at, target] -= 1
        p /= len(target)
        d_both = (p @ self.out.T).reshape(steps, lanes, -1)
        d_gates, d_turn = np.zeros_like(self.gates), np.zeros_like(self.turn)
        for d in (0, 1):
            carried = np.zeros((lanes, h), np.float32)
            d_inputs = np.empty((steps, lanes, 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                state, gate, fresh, turned = runs[d][1][t]
                grad = carried + d_both[t, :, d * h : (d + 1) * h]
                update, reset = gate[:, :h], gate[:, h:]
                d_fresh = grad * update * (1 - fresh * fresh)
                d_gate = np.concatenate([grad * (fresh - state), d_fresh * turned], axis=1) * 2 * gate * (1 - gate)
                d_turned = np.concatenate([d_gate, d_fresh * reset], axis=1)
                d_inputs[t] = np.concatenate([d_gate, d_fresh], axis=1)
                d_turn[d] += state.T @ d_turned
                carried = grad * (1 - update) + d_turned @ self.turn[d].T
            order = np.argsort(x.ravel(), kind="stable")
            values, first = np.unique(x.ravel()[order], return_index=True)
            d_gates[d][values] = np.add.reduceat(d_inputs.reshape(-1, 3 * h)[order], first, axis=0)
        return [d_gates, d_turn, both.T @ p], loss

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 12) -> None:
        """Adam over random snippets; ``x`` has a row of bytes per snippet, ``y`` its language."""
        rng = np.random.default_rng(seed)
        weights = [self.gates, self.turn, self.out]
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), BATCH)
            found, _ = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in found))
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for w, g, m, s in zip(weights, found, mean, square):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of each whole text: the geometric means of those at all its positions, made to add up to 1.

        So positions that say nothing, such as a phrase that texts of all
        languages repeat, leave the decision to those that do.
        A text is cut into runs of WINDOW bytes. In either direction a run's
        states are those that the MARGIN bytes beyond it leave, and zero before
        the text begins, so they follow those of a single pass over the text.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts])
        runs = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), runs)
        # Texts lie apart by two margins of zeros at least, each from a multiple of WINDOW on.
        spaced = runs + 1 + 2 * MARGIN // WINDOW
        starts = (np.cumsum(spaced) - spaced) * WINDOW + MARGIN
        filled = np.zeros(int(spaced.sum()) * WINDOW + 2 * MARGIN, np.uint8)
        for text, at in zip(texts, starts):
            filled[at : at + len(text)] = np.frombuffer(text, np.uint8)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        first = starts[owner] + nth * WINDOW - MARGIN
        steps = np.arange(WINDOW + 2 * MARGIN)[:, None]
        for at in range(0, len(owner), LANES):
            own, begin = owner[at : at + LANES], first[at : at + LANES]
            place = steps + (begin - starts[own])
            inside = ((place >= 0) & (place < sizes[own])).astype(np.float32)
            p = self.label(filled[steps + begin], inside, MARGIN)
            p *= inside[MARGIN : MARGIN + WINDOW, :, None]
            np.add.at(sums, own, p.sum(axis=0))
        sums /= np.maximum(sizes, 1)[:, None]
        sums = np.exp(sums - sums.max(axis=1, keepdims=True))
        return sums / sums.sum(axis=1, keepdims=True)


def fit(docs: DataFrame) -> Network | None:
    """A network trained on a bounded sample of ``docs(doc_id, text, lang)``; None if no row has a language.

    The sample takes about PER_LANGUAGE texts of each language, however many
    languages there are, by a hash of their doc_id, and SNIPPETS snippets of
    SNIPPET bytes at hashed places of each.
    """
    labelled = docs.filter("lang is not null and text is not null and text <> '' and doc_id is not null")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))])[F.col("lang")]
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
    place = lambda i: F.lit(1) + F.pmod(F.xxhash64("doc_id", i), F.greatest(F.char_length("text") - SNIPPET, F.lit(1))).cast("int")
    snippets = F.transform(F.sequence(F.lit(1), F.lit(SNIPPETS)), lambda i: F.col("text").substr(place(i), F.lit(SNIPPET)))
    rows = labelled.filter(hashed).select("doc_id", "lang", snippets.alias("s")).limit(2 * PER_LANGUAGE * len(counts)).collect()
    languages = sorted(r["lang"] for r in counts)
    number = {lang: i for i, lang in enumerate(languages)}
    data = sorted((r["doc_id"], number[r["lang"]], s.encode("utf-8", "replace").lower()[:SNIPPET].ljust(SNIPPET, b"\0")) for r in rows for s in r["s"])
    network = Network.fresh(languages)
    if len(languages) > 1 and data:
        network.train(np.frombuffer(b"".join(d[2] for d in data), np.uint8).reshape(-1, SNIPPET), np.array([d[1] for d in data]))
    return network


def _labelled(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if network else []
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    for at in range(0, len(known), 512):
        part = known[at : at + 512]
        for i, p in zip(part, network.pooled([texts[i].encode("utf-8", "replace").lower() for i in part])):
            lang[i], score[i] = network.languages[int(p.argmax())], min(1.0, float(p.max()))
    return lang, score


def _predict(network: Network | None):
    def run(batches):
        for batch in pieces_of(batches, "_text"):
            lang, score = _labelled(network, batch.column("_text").to_pylist())
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(lang), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, and ``lang_pred`` and ``score`` of each row.

    Every byte of the whole text (A-Z lower-cased) is read in both directions
    and labelled; the text's probabilities are pooled over its positions. Of
    languages that are equally probable the first by name is predicted. Null
    texts and texts without a letter (Unicode category L) are ``und`` with
    score 0, as are all where nothing could be learned. Columns ``lang_pred``
    and ``score`` of ``docs`` give way.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "_text", "lang_pred", "score")]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return source.mapInArrow(_predict(network), schema)


def drop_unknown(docs: DataFrame, network: Network | None, text: str = "text", floor: float = FLOOR) -> DataFrame:
    """The rows of ``docs`` in a learned language, all columns.

    A text stays if the network finds one language ``floor`` times as probable
    as chance would, where it knows more than one. Null texts, empty ones and those without a letter go; so does every
    row where nothing could be learned. Repeated rows stay or go together; an
    empty table stays empty.
    """

    def run(batches):
        for batch in pieces_of(batches, text):
            lang, score = _labelled(network, batch.column(text).to_pylist())
            least = floor / len(network.languages) if network and len(network.languages) > 1 else 0.0
            yield batch.filter(pa.array([k != "und" and s >= least for k, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id, text, lang)``.

    Learned from the rows that are not held out and have a doc_id, a text and a
    language. Repeated rows each get their row; other columns are not read. An
    empty table gives no rows.
    """
    network = fit(docs.filter(~held_out("doc_id")))
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), network)


def op1(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
