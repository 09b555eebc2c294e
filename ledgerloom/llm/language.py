"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import remainder

HIDDEN = 8
#: Bytes of a window; the network starts anew in each, and a text's windows cover it whole.
WINDOW = 128
#: The network is fitted on an excerpt of at most EXCERPT characters from each of at most SAMPLE labelled documents.
SAMPLE, EXCERPT = 3000, 1000
#: Bits of a hash by which labelled rows are counted, to find how far the sample reaches.
SLOTS = 16
STEPS, BATCH, RATE, SEED = 500, 192, 0.02, 11
#: Windows that are labelled at once.
SIDE_BY_SIDE = 8192
UNDETERMINED = "und"

LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Parameters of two gated recurrent units, over the bytes forwards and backwards, and of the label of each position.

    table holds what each byte adds to update gate, reset gate and candidate; hidden what the state before does.
    """

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p[f"table_{way}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            p[f"hidden_{way}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        p["out"] = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        p["bias"] = np.zeros(len(langs), np.float32)
        return cls(langs, p)

    def states(self, cells: np.ndarray, way: str, keep: bool = False):
        """States after each row of cells (positions x windows), for `b` from the last row to the first; with keep, all gates too."""
        table, weights = self.p[f"table_{way}"], self.p[f"hidden_{way}"]
        h = weights.shape[0]
        steps, width = cells.shape
        out = np.zeros((steps, width, h), np.float32)
        kept = []
        state = np.zeros((width, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            given = table[cells[t]]
            gates = _sigmoid(given[:, : 2 * h] + state @ weights[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            held = r * state
            candidate = _sigmoid(2 * (given[:, 2 * h :] + held @ weights[:, 2 * h :]))
            candidate *= 2
            candidate -= 1
            if keep:
                kept.append((t, state, z, r, held, candidate))
            state = state + z * (candidate - state)
            out[t] = state
        return (out, kept) if keep else out

    def labels(self, cells: np.ndarray) -> np.ndarray:
        """P(language) at each position of each window: positions x windows x languages."""
        h = HIDDEN
        logits = self.states(cells, "f") @ self.p["out"][:h]
        logits += self.states(cells, "b") @ self.p["out"][h:]
        logits += self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, cells: np.ndarray, use: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over used positions, and its gradient by backpropagation through time."""
        h = self.p["hidden_f"].shape[0]
        ways = {way: self.states(cells, way, keep=True) for way in "fb"}
        both = np.concatenate([ways["f"][0], ways["b"][0]], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        n = max(1, int(use.sum()))
        picked = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (*cells.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * use).sum() / n)
        d = p
        np.put_along_axis(d, np.broadcast_to(target[None, :, None], (*cells.shape, 1)), picked[..., None] - 1, axis=2)
        d *= (use / n)[..., None].astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        grad = {"out": both.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(axis=0)}
        d_both = d @ self.p["out"].T
        for k, way in enumerate("fb"):
            weights = self.p[f"hidden_{way}"]
            table, hidden = np.zeros_like(self.p[f"table_{way}"]), np.zeros_like(weights)
            d_state = np.zeros((cells.shape[1], h), np.float32)
            for t, state, z, r, held, candidate in reversed(ways[way][1]):
                d_state += d_both[t, :, k * h : (k + 1) * h]
                d_c = d_state * z * (1 - candidate * candidate)
                d_held = d_c @ weights[:, 2 * h :].T
                d_gates = np.concatenate([d_state * (candidate - state) * z * (1 - z), d_held * state * r * (1 - r)], axis=1)
                hidden[:, : 2 * h] += state.T @ d_gates
                hidden[:, 2 * h :] += held.T @ d_c
                np.add.at(table, cells[t], np.concatenate([d_gates, d_c], axis=1))
                d_state = d_state * (1 - z) + d_held * r + d_gates @ weights[:, : 2 * h].T
            grad[f"table_{way}"], grad[f"hidden_{way}"] = table, hidden
        return loss, grad


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as windows x WINDOW, the last filled up with 256, and the number of bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    cells = np.full(n * WINDOW, 256, np.int16)
    cells[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return cells.reshape(n, WINDOW), sizes


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """The network fitted to texts and their languages, each language as often as any other; windows start anywhere in a text."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    network = Network.new(names, seed=seed)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    of = [[i for i, x in enumerate(langs) if x == name] for name in names]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(names), BATCH)
        cells = np.full((WINDOW // 2, BATCH), 256, np.int16)
        for j, k in enumerate(target):
            one = data[of[k][rng.integers(len(of[k]))]]
            at = int(rng.integers(0, max(1, len(one) - WINDOW // 2 + 1)))
            part = one[at : at + WINDOW // 2]
            cells[: len(part), j] = part
        _, grad = network.gradients(cells, cells < 256, target)
        size = np.sqrt(sum(float(np.square(g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (size + 1e-12))
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = RATE * (1 - step / (steps + 1))
            network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def predict(network: Network, texts: list[bytes]) -> tuple[list[int], list[float]]:
    """Of each text, the language with the highest mean log probability over all positions, and its share when these means are normalized."""
    parts = [windows(t) for t in texts]
    cells = np.concatenate([c for c, _ in parts])
    sizes = np.concatenate([s for _, s in parts])
    sums = np.zeros((len(cells), len(network.langs)))
    for at in range(0, len(cells), SIDE_BY_SIDE):
        rows = np.ascontiguousarray(cells[at : at + SIDE_BY_SIDE].T)
        p = network.labels(rows)
        p += 1e-6
        np.log(p, out=p)
        p *= (np.arange(WINDOW)[:, None] < sizes[at : at + SIDE_BY_SIDE])[..., None]
        sums[at : at + SIDE_BY_SIDE] = p.sum(axis=0)
    starts = np.concatenate(([0], np.cumsum([len(c) for c, _ in parts])[:-1]))
    pooled = np.add.reduceat(sums, starts, axis=0) / np.maximum(1, np.add.reduceat(sizes, starts))[:, None]
    p = np.exp(pooled - pooled.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best.tolist(), p.max(axis=1).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", divisor: int = 4, held_out: int = 2, sample: int = SAMPLE, excerpt: int = EXCERPT) -> Network | None:
    """The network fitted on labelled rows outside the held-out ones; None without any.

    Of the distinct labelled rows (id, text and language), the `sample` with the least hashes are fitted on; an excerpt of up to `excerpt` characters of each comes to the
    driver, from a place in the text that its hash names. Rows are first counted by the highest bits of their hashes, so that only those that can be in the sample are gathered; repeated
    rows are one in each task, and the reach is extended while repeats leave the sample short.
    """
    key = F.xxhash64(F.lit(SEED), id_col, text_col)
    rows = docs.where((remainder(F.col(id_col), divisor) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    start = (F.pmod(key, F.greatest(F.lit(1), F.length(text_col) - excerpt + 1)) + 1).cast("int")
    rows = rows.select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).substr(start, F.lit(excerpt)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    slot = F.shiftright(F.col("key"), 64 - SLOTS)
    counts = {r.slot: r.n for r in rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    slots = sorted(counts)
    upto = np.cumsum([counts[s] for s in slots])
    picked, reach = [], 0
    while len(picked) < sample and reach < len(slots):
        want = (upto[reach - 1] if reach else 0) + sample - len(picked)
        reach = min(len(slots), int(np.searchsorted(upto, want)) + 1)
        near = rows.where(slot <= slots[reach - 1]).groupBy("key", "lang").agg(F.min("text").alias("text"))
        picked = near.orderBy("key", "lang").limit(sample).collect()
    return fit([r.text for r in picked], [r.lang for r in picked]) if picked else None


def labelled(docs: DataFrame, network: Network | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score behind its columns, under names that docs doesn't have."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            texts = batch.column(at)
            done, size = 0, 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_py() or "")
                if size >= SIDE_BY_SIDE * WINDOW // 2 or i + 1 == batch.num_rows:
                    yield answered(network, batch.slice(done, i + 1 - done))
                    done, size = i + 1, 0

    def answered(network: Network | None, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(at).to_pylist()]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if network and LETTER.search(t)]
        if own:
            for i, k, p in zip(own, *predict(network, [texts[i].encode() for i in own]), strict=True):
                langs[i], scores[i] = network.langs[k], min(1.0, p)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    at = docs.columns.index(text_col)
    names = [*docs.columns, lang_name, score_name]
    schema = docs.select("*").schema.add(lang_name, "string").add(score_name, "double")
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", divisor: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    The network learns from labelled rows whose crc32(doc_id as text) modulo divisor is not held_out, and predicts from the text alone. A null text, or one without a letter, is
    `und` with score 0; so is every text if no row is labelled. A null id counts as the empty text in the split. Texts are read whole, in windows.
    """
    network = train(docs, id_col, text_col, lang_col, divisor, held_out)
    split = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), divisor) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return labelled(split, network, "text").select("doc_id", "held_out", "lang_pred", "score")
