"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads segments of ``SEGMENT`` bytes in both directions, labels every position with language
probabilities, and a document's probabilities are the means over all positions of all its segments. It is
trained here, in numpy by backpropagation through time, on ``SAMPLE`` labelled documents per language: those
with the lowest hash of their id, one piece of ``PIECE`` characters of each. That bound is all that is fitted;
prediction covers every byte of every text and uses nothing but the text.

A network without a class for the rest is as sure of a foreign text as of any. Whether a text is in a learned language
at all, :class:`Fit` decides: by the share of its three-letter groups that a language's training rows have, against
a threshold from held-out labelled rows, scored with their own language and with the others.

Defined cases: a null text or one without letters is ``und`` with score 0, as is everything if no row has a
label; repeated rows are predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.shared import lowest_share

HIDDEN, SEGMENT = 8, 128
SAMPLE, PIECE = 400, 192
#: Training: bytes of a sequence, sequences in a step, steps.
_LENGTH, _BATCH, _STEPS = 48, 192, 220
#: Characters of a held-out row that the threshold is found with, rows needed for it, and the share of them to keep.
WHOLE, _ROWS, _KEEP = 4000, 20, 0.995
#: Places that groups of three letters are hashed to.
_PLACES = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE, of_held_out: bool = False) -> list[tuple[str, str]]:
    """``(lang, piece)`` of the training rows, or of held-out rows; at most ``per_language`` for each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out() if of_held_out else ~held_out()))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    size = WHOLE if of_held_out else PIECE
    at = F.pmod(key, F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "doc_id", key.alias("key"), F.substr("text", at, F.lit(size)).alias("piece"))
    # One row per language; of each only as many rows as a sample needs meet in a task.
    counts = [(r.lang, r["count"]) for r in rows.groupBy("lang").count().collect()]
    lowest = F.lit(False)
    for lang, count in counts:
        lowest = lowest | ((F.col("lang") == lang) & lowest_share("key", count, per_language))
    rows = rows.where(lowest)
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "piece")
    rows = rows.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= per_language)
    return sorted((r.lang, r.piece) for r in rows.select("lang", "piece").collect())


class Network:
    """``table`` and ``turn`` hold the gates' weights of bytes and state for both directions; ``out`` the labels'."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n, h = max(1, len(languages)), HIDDEN
        self.weights = {
            "table": rng.normal(0, 0.3, (2, 256, 3 * h)), "turn": rng.normal(0, 0.3, (2, h, 3 * h)),
            "out": rng.normal(0, 0.3, (2 * h, n)), "bias": np.zeros(n),
        }
        self._cast()

    def _cast(self) -> None:
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _run(self, data: np.ndarray, side: int, keep: bool = False):
        """States after each byte of ``data`` (time, sequences); with ``keep`` also what the backward pass needs."""
        table, turn, h = self.weights["table"][side], self.weights["turn"][side], HIDDEN
        state = np.zeros((data.shape[1], h), dtype=np.float32)
        states = np.empty((*data.shape, h), dtype=np.float32)
        kept = []
        steps = range(len(data)) if side == 0 else range(len(data) - 1, -1, -1)
        for t in steps:
            x, u = table[data[t]], state @ turn
            gates = np.tanh((x[:, : 2 * h] + u[:, : 2 * h]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            new = np.tanh(x[:, 2 * h :] + gates[:, h:] * u[:, 2 * h :])
            if keep:
                kept.append((t, state, u[:, 2 * h :], gates, new))
            state = new + gates[:, :h] * (state - new)
            states[t] = state
        return states, kept

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position."""
        h = HIDDEN
        scores = self._run(data, 0)[0] @ self.weights["out"][:h]
        scores += self._run(data, 1)[0] @ self.weights["out"][h:]
        scores += self.weights["bias"]
        np.exp(scores - scores.max(axis=-1, keepdims=True), out=scores)
        return scores / scores.sum(axis=-1, keepdims=True)

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        w, h = self.weights, HIDDEN
        runs = [self._run(data, side, keep=True) for side in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=-1)
        scores = both @ w["out"] + w["bias"]
        p = np.exp(scores - scores.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        p[:, np.arange(len(labels)), labels] -= 1
        p /= data.size
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"] = np.einsum("tbh,tbl->hl", both, p, optimize=True)
        grad["bias"] = p.sum(axis=(0, 1))
        back = p @ w["out"].T
        for side in (0, 1):
            turn = w["turn"][side]
            carry = np.zeros((data.shape[1], h), dtype=np.float32)
            for t, before, u, gates, new in reversed(runs[side][1]):
                d = carry + back[t][:, side * h : side * h + h]
                z, r = gates[:, :h], gates[:, h:]
                d_new = d * (1 - z) * (1 - new * new)
                d_gates = np.concatenate([d * (before - new) * z * (1 - z), d_new * u * r * (1 - r), d_new], axis=1)
                d_turn = d_gates.copy()
                d_turn[:, 2 * h :] *= r
                np.add.at(grad["table"][side], data[t], d_gates)
                grad["turn"][side] += before.T @ d_turn
                carry = d * z + d_turn @ turn.T
        return grad

    def fit(self, data: np.ndarray, labels: np.ndarray, steps: int = _STEPS, seed: int = 11) -> None:
        """Adam over random batches of ``data`` (sequences, time); languages weigh alike."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(labels, minlength=len(self.languages))[labels]
        share /= share.sum()
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.choice(len(data), _BATCH, p=share)
            grad = self.gradients(data[pick].T, labels[pick])
            rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.weights[k] = self.weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
        self._cast()


def trained(docs: DataFrame) -> Network:
    return _trained_on(labelled_sample(docs))


def _trained_on(sample: list[tuple[str, str]]) -> Network:
    net = Network(sorted({lang for lang, _ in sample}))
    rows, labels = [], []
    for lang, piece in sample:
        data = np.frombuffer(piece.encode(), dtype=np.uint8)
        for at in range(0, max(1, len(data) - _LENGTH + 1), _LENGTH):
            part = data[at : at + _LENGTH]
            # A short text is repeated to a whole sequence.
            if len(part):
                rows.append(np.resize(part, _LENGTH))
                labels.append(net.languages.index(lang))
    if len(net.languages) > 1:
        net.fit(np.array(rows), np.array(labels))
    return net


_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _groups(text: bytes) -> np.ndarray:
    """Places of the three-byte groups of the words of letters, with a space at either end."""
    data = np.frombuffer(b" " + b" ".join(text.lower().translate(_SPACED).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    return ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)) >> np.uint32(14)


class Fit:
    """Whether a text is in the language the network names: ``known[language]`` marks the groups of its training rows.

    ``level`` lies midway between what held-out rows share with their own language, at the lowest hundredth, and
    with others, at the highest. Short texts share less by chance, and the network takes some for another's:
    ``slack`` over the root of the number of groups is allowed, as little as keeps ``_KEEP`` of the held-out rows by
    the language the network names for them. With too few of these no text is rejected.
    """

    def __init__(self, sample: list[tuple[str, str]], held: list[tuple[str, str]], net: Network):
        self.known: dict[str, np.ndarray] = {lang: np.zeros(_PLACES, dtype=bool) for lang, _ in sample}
        for lang, piece in sample:
            self.known[lang][_groups(piece.encode())] = True
        self.level, self.slack = 0.0, 0.0
        held = [(lang, text.encode()) for lang, text in held if lang in self.known and _LETTER.search(text)]
        if len(held) < _ROWS:
            return
        best = document_probabilities(net, [text for _, text in held]).argmax(axis=1)
        named = [net.languages[k] for k in best]
        held = [(lang, _groups(text)) for lang, text in held]
        own = np.array([self.known[lang][g].mean() for lang, g in held])
        other = np.array([self.known[x][g].mean() for lang, g in held for x in self.known if x != lang])
        # A single language has no other to be told from: half of its own share is asked for.
        low, high = np.quantile(own, 0.01), np.quantile(other, 0.99) if len(other) else 0.0
        self.level = float(low + min(low, high)) / 2
        roots = np.sqrt([len(g) for _, g in held])
        said = np.array([self.known[lang][g].mean() for lang, (_, g) in zip(named, held, strict=True)])
        self.slack = float(max(0.0, np.quantile((self.level - said) * roots, _KEEP, method="higher")))

    def __call__(self, text: bytes, lang: str) -> bool:
        groups = _groups(text)
        return bool(self.known[lang][groups].mean() >= self.level - self.slack / np.sqrt(len(groups)) - 1e-12)


#: Segments read at a time.
_AT_ONCE = 2048


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions; zeros for an empty text."""
    total = np.zeros((len(texts), len(net.languages)))
    lengths = np.array([len(t) for t in texts])
    counts = -(-lengths // SEGMENT)
    # Texts are laid out in whole segments; what fills the last one is not counted.
    data = np.zeros(int(counts.sum()) * SEGMENT, dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        data[begin[i] * SEGMENT : begin[i] * SEGMENT + len(t)] = np.frombuffer(t, dtype=np.uint8)
    data = data.reshape(-1, SEGMENT)
    of = np.repeat(np.arange(len(texts)), counts)
    left = lengths[of] - (np.arange(len(of)) - begin[of]) * SEGMENT
    for a in range(0, len(of), _AT_ONCE):
        part = slice(a, a + _AT_ONCE)
        p = net.positions(np.ascontiguousarray(data[part].T))
        short = np.flatnonzero(left[part] < SEGMENT)
        for i in short:
            p[left[part][i] :, i] = 0
        np.add.at(total, of[part], p.sum(axis=0))
    return total / np.maximum(lengths, 1)[:, None]


def _decided(net: Network, column: pa.Array, fit: Fit | None = None) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text, and whether it fits that language, if there is a rule for it."""
    said, texts = column.to_pylist(), wordhash.encoded(column)
    langs, scores, fits = [], [], []
    for a, b in wordhash.chunks(texts):
        p = document_probabilities(net, texts[a:b])
        for i in range(b - a):
            text = said[a + i]
            if not net.languages or text is None or not _LETTER.search(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(p[i].argmax())
                langs.append(net.languages[best])
                scores.append(round(min(1.0, float(p[i][best])), 6))
            fits.append(langs[-1] != UNKNOWN and (fit is None or fit(texts[a + i], langs[-1])))
    return langs, scores, fits


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = _decided(sent.value, batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predicted(docs, trained(docs))


def fitting(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Rows of ``docs`` whose text is in the language that the network names; its columns as they are.

    Texts without letters go. Each text is decided where it is read, so no row is moved.
    """
    sample = labelled_sample(docs)
    net = net or _trained_on(sample)
    sent = docs.sparkSession.sparkContext.broadcast((net, Fit(sample, labelled_sample(docs, of_held_out=True), net)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_decided(sent.value[0], batch.column("text"), sent.value[1])[2], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
