"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

Base spans come from three patterns. The field tags each token as begin, inside or outside of a secret. A token
is a run of word characters or one other character; its features are its shape, the words and shapes beside it,
and what kind of text it stands in. Scores of labels and of neighbouring labels are learned by maximum
likelihood (forward-backward, in numpy) from token windows of ``SAMPLE`` documents with base spans and as many
without, plus made-up lines that show secrets which the patterns miss; that bound is all that is fitted.

Decoding is Viterbi over every token of every text. Where outside leads by more than the transitions could ever
win back, the best path is outside for sure; only the runs in between are decoded, which gives the same path.

Positions are code points, the end is exclusive. Spans of the field that touch a base span are not added.
Defined cases: a null text is empty and has no spans; repeated rows are scanned alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.shared import lowest_share

# The base patterns, in their order.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")
# Words that announce a secret.
_CUES = "password passwd pwd secret token key apikey auth authorization bearer credential credentials private access pass login aws sig signature".split()
SAMPLE = 300

_OUT, _BEGIN, _IN = 0, 1, 2
#: Features of a token before its neighbours' are added, and buckets of each kind.
_SIZES = {"length": 12, "shape": 64, "switches": 6, "digits": 6, "cue": 32, "mark": 24}
_NEIGHBOURS = (-3, -2, -1, 1, 2)
#: Which of its features a neighbour shows: length, shape, cue and mark.
_SEEN = [0, 1, 4, 5]
_FILE = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the patterns; a run that is too short to count can't hold a longer one."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out)


_WORD = wordhash.ALNUM.copy()
_WORD[[ord(c) for c in "+/_-"]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
_HIGH = np.zeros(256, dtype=bool)
_HIGH[0x80:] = True
_HEXED = np.zeros(256, dtype=bool)
_HEXED[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_CLASS = np.select([_UPPER, _LOWER, _DIGIT, _HIGH], [1, 1, 2, 1], 3).astype(np.int8)
#: What a byte shows of its token: nothing if it lies between tokens.
_SHOWS_UPPER, _SHOWS_LOWER, _SHOWS_DIGIT, _SHOWS_HIGH, _SHOWS_NO_HEX = 1, 2, 4, 8, 16
_SHOWS = (_UPPER * _SHOWS_UPPER + _LOWER * _SHOWS_LOWER + _DIGIT * _SHOWS_DIGIT + _HIGH * _SHOWS_HIGH + ~_HEXED * _SHOWS_NO_HEX).astype(np.uint8)
_SHOWS[~wordhash.SPACED & ~_WORD] = 0
_MARKS = {c: i + 1 for i, c in enumerate("=:\"',;.()[]{}<>@#$&|*%")}
_MARK = np.array([_MARKS.get(chr(b), 0) for b in range(256)], dtype=np.int64)


class Tokens:
    """Tokens of texts laid end to end: ``start``, ``end`` in bytes, ``text``.

    ``own`` has each token's own features, ``file`` the kind of its text, ``features`` these and its neighbours'.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        word, space = _WORD[data], ~wordhash.SPACED[data]
        before = np.concatenate(([False], word[:-1]))
        begins = (word & ~before) | (~word & ~space)
        self.start = np.flatnonzero(begins)
        after = np.concatenate((word[1:], [False]))
        self.end = np.flatnonzero((word & ~after) | (~word & ~space)) + 1
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.text = np.searchsorted(self.offset, self.start, side="right") - 1
        self.own, self.file = np.zeros((0, len(_SIZES)), dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(self.start):
            kind = _CLASS[data]
            inside = np.concatenate(([False], kind[1:] != kind[:-1])) & ~space & ~begins
            self._describe(data, inside)

    def _count(self, flags: np.ndarray) -> np.ndarray:
        """How many of a token's bytes are flagged; none of those between tokens may be."""
        return np.add.reduceat(flags, self.start, dtype=np.int64)

    def _describe(self, data: np.ndarray, switched: np.ndarray) -> None:
        n = self.end - self.start
        shows = np.bitwise_or.reduceat(_SHOWS[data], self.start)
        upper, digit, switches = self._count(_UPPER[data]), self._count(_DIGIT[data]), self._count(switched)
        shown = lambda bit: (shows & bit > 0).astype(np.int64)
        shape = shown(_SHOWS_UPPER) + 2 * shown(_SHOWS_LOWER) + 4 * shown(_SHOWS_DIGIT) + 8 * (1 - shown(_SHOWS_NO_HEX)) + 16 * shown(_SHOWS_HIGH)
        shape += 32 * (upper > 1)
        length = np.minimum(np.where(n <= 4, n - 1, 2 + np.log2(n).astype(np.int64)), 11)
        cue = self._cues(data, n)
        mark = np.where(n == 1, _MARK[data[self.start]], 0)
        parts = [length, shape, np.minimum(switches, 5), np.minimum(6 * digit // (n + 1), 5), cue, mark]
        own = np.empty((len(n), len(_SIZES)), dtype=np.int64)
        at = 0
        for i, (size, values) in enumerate(zip(_SIZES.values(), parts, strict=True)):
            own[:, i] = at + values
            at += size
        count = len(texts_first := np.searchsorted(self.text, np.arange(len(self.offset)))) - 1
        tokens = np.maximum(np.diff(texts_first), 1)
        digits = np.bincount(self.text, weights=digit > 0, minlength=count) / tokens
        cues = np.bincount(self.text, weights=cue > 0, minlength=count) > 0
        marks = np.bincount(self.text, weights=mark > 0, minlength=count) / tokens
        self.own, self.file = own, (np.minimum(digits * 20, 2).astype(np.int64) * 4 + cues * 2 + (marks > 0.4))[self.text]

    def beside(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The token ``step`` places on from each, and whether it is of the same text."""
        other = np.arange(len(self.text)) + step
        np.clip(other, 0, max(0, len(self.text) - 1), out=other)
        fine = self.text[other] == self.text
        if step < 0:
            fine[:-step] = False
        else:
            fine[len(fine) - min(step, len(fine)) :] = False
        return other, fine

    @cached_property
    def features(self) -> np.ndarray:
        """One row per token, one column per feature that holds for it."""
        blocks = [self.own]
        for k, step in enumerate(_NEIGHBOURS):
            # Length, shape, cue and mark of the neighbour, or none beyond the text.
            other, fine = self.beside(step)
            block = self.own[other][:, _SEEN] + _WIDTH * (1 + k)
            block[~fine] = _NONE + k
            blocks.append(block)
        blocks.append((_NONE + len(_NEIGHBOURS) + self.file)[:, None])
        return np.concatenate(blocks, axis=1)

    def _cues(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        likely = np.flatnonzero((n >= 3) & (n <= 24) & _CUE_LETTER[data[self.start]])
        out = np.zeros(len(n), dtype=np.int64)
        raw = data.tobytes()
        for i in likely[_CUE_LETTER2[data[self.start[likely]].astype(np.int64) * 256 + data[self.start[likely] + 1]]]:
            word = raw[self.start[i] : self.end[i]].lower().rpartition(b"_")[2] or b""
            out[i] = _CUE.get(word, 0)
            if not out[i]:
                out[i] = _CUE.get(raw[self.start[i] : self.end[i]].lower().partition(b"_")[0], 0)
        return out


_CUE = {c.encode(): i + 1 for i, c in enumerate(_CUES)} | {b"api": len(_CUES) + 1}
_CUE_LETTER = np.zeros(256, dtype=bool)
_CUE_LETTER2 = np.zeros(65536, dtype=bool)
for _w in _CUE:
    for _a in (_w[0], _w[0] - 32):
        _CUE_LETTER[_a] = True
        for _b in (_w[1], _w[1] - 32):
            _CUE_LETTER2[_a * 256 + _b] = True
_WIDTH = sum(_SIZES.values())
_NONE = _WIDTH * (1 + len(_NEIGHBOURS))
_ALL = _NONE + len(_NEIGHBOURS) + _FILE


def labels_of(tokens: Tokens, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels from ``(text, start byte, end byte)``."""
    out = np.zeros(len(tokens.start), dtype=np.int64)
    for text, a, b in spans:
        at = tokens.offset[text]
        inside = np.flatnonzero((tokens.start >= at + a) & (tokens.end <= at + b))
        out[inside] = _IN
        out[inside[:1]] = _BEGIN
    return out


def made_up(n: int = 1200, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets of kinds that the patterns miss, and lines with harmless numbers and words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9)))
    words = lambda: " ".join(word() for _ in range(rng.randint(3, 12)))
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    both = string.ascii_letters + string.digits
    secrets = [
        lambda: ("Authorization: Bearer ", pick(both, 24, 60)), lambda: ("credential ", pick(both, 20, 44)),
        lambda: ("key is ", "sk-" + pick(both, 24, 48)), lambda: ("", "ghp_" + pick(both, 30, 40)),
        lambda: ("pwd: ", pick(both, 10, 20)), lambda: ("private key ", pick(both + "+/", 40, 64)),
        lambda: ('token = "', pick("0123456789abcdef", 32, 48)), lambda: ("access ", "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16)),
    ]
    plain = [
        lambda: pick(string.digits, 3, 17), lambda: f"{word()}@{word()}.example.com", lambda: f"https://{word()}.example.org/{word()}/{pick(string.digits, 1, 6)}",
        lambda: f"token {word()} {word()}", lambda: f"the key to {word()}", lambda: word().upper(), lambda: word().title() + word().title(), lambda: f"{word()}-{word()}-{word()}",
        lambda: f"+{pick(string.digits, 2, 3)} {pick(string.digits, 3, 4)} {pick(string.digits, 4, 7)}", lambda: pick(string.digits, 1, 3) + "." + pick(string.digits, 1, 3),
    ]
    out = []
    for i in range(n):
        head = words() + " "
        if i % 3:
            out.append((head + rng.choice(plain)() + " " + words(), []))
        else:
            cue, secret = rng.choice(secrets)()
            head += cue
            out.append((head + secret + " " + words(), [(len(head), len(head) + len(secret))]))
    return out


class Field:
    """``unary[feature, label]`` and ``pair[label, next label]``; inside can't follow outside or begin a text."""

    def __init__(self):
        self.unary = np.zeros((_ALL, 3))
        self.pair = np.zeros((3, 3))

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.unary[features[:, 0]]
        for j in range(1, features.shape[1]):
            out += self.unary[features[:, j]]
        return out

    def token_scores(self, tokens: Tokens) -> np.ndarray:
        """:meth:`scores` of all tokens. What a token adds to its own and its neighbours' scores is summed once per kind of token."""
        if not len(tokens.text):
            return np.zeros((0, 3))
        code = np.zeros(len(tokens.text), dtype=np.int64)
        at = 0
        for i, size in enumerate(_SIZES.values()):
            if i in _SEEN:
                code = code * size + (tokens.own[:, i] - at)
            at += size
        present = np.zeros(math.prod(list(_SIZES.values())[i] for i in _SEEN), dtype=bool)
        present[code] = True
        kinds = np.flatnonzero(present)
        number = np.zeros(len(present), dtype=np.int64)
        number[kinds] = np.arange(len(kinds))
        kind = number[code]
        # One token of each kind tells the features that all of them share.
        shown = np.empty((len(kinds), len(_SEEN)), dtype=np.int64)
        shown[kind] = tokens.own[:, _SEEN]
        out = self.unary[shown].sum(axis=1)[kind]
        for i in set(range(len(_SIZES))) - set(_SEEN):
            out += self.unary[tokens.own[:, i]]
        out += self.unary[_NONE + len(_NEIGHBOURS) + tokens.file]
        for k, step in enumerate(_NEIGHBOURS):
            other, fine = tokens.beside(step)
            # Beyond the text stands one more kind.
            table = np.concatenate((self.unary[shown + _WIDTH * (1 + k)].sum(axis=1), len(_SEEN) * self.unary[_NONE + k][None]))
            out += table[np.where(fine, kind[other], len(kinds))]
        return out

    def _allowed(self) -> np.ndarray:
        pair = self.pair.copy()
        pair[_OUT, _IN] = -1e4
        return pair

    def fit(self, features: np.ndarray, labels: np.ndarray, steps: int = 80, penalty: float = 1e-4) -> None:
        """Maximum likelihood over windows (window, position, feature), by Adam on exact gradients."""
        n, length, _ = features.shape
        params = [self.unary, self.pair]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        flat = features.reshape(n * length, -1)
        real = np.zeros((n, length, 3))
        np.put_along_axis(real, labels[..., None], 1.0, axis=2)
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for step in range(1, steps + 1):
            pair = self._allowed()
            score = self.scores(flat).reshape(n, length, 3)
            score[:, 0, _IN] -= 1e4
            ahead = np.empty_like(score)
            ahead[:, 0] = score[:, 0]
            for t in range(1, length):
                ahead[:, t] = lse(ahead[:, t - 1, :, None] + pair, 1) + score[:, t]
            back = np.zeros_like(score)
            for t in range(length - 2, -1, -1):
                back[:, t] = lse(pair + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            whole = lse(ahead[:, -1], 1)
            node = np.exp(ahead + back - whole[:, None, None])
            edge = np.zeros((3, 3))
            for t in range(length - 1):
                e = ahead[:, t, :, None] + pair + (score[:, t + 1] + back[:, t + 1])[:, None, :] - whole[:, None, None]
                edge += np.exp(e).sum(axis=0)
            seen = np.einsum("nta,ntb->ab", real[:, :-1], real[:, 1:])
            grad_u = np.zeros_like(self.unary)
            off = ((node - real) / n).reshape(n * length, 3)
            for j in range(flat.shape[1]):
                for c in range(3):
                    grad_u[:, c] += np.bincount(flat[:, j], weights=off[:, c], minlength=_ALL)
            grads = [grad_u + penalty * self.unary, (edge - seen) / n + penalty * self.pair]
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                p -= 0.15 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Labels of the best path of every text."""
        return self.best_labels(self.token_scores(tokens), tokens.text)

    def best_labels(self, score: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Labels of the best path of every text from the scores of all tokens and their texts' numbers."""
        labels = np.zeros(len(score), dtype=np.int64)
        if not len(labels):
            return labels
        same = np.concatenate(([False], text[1:] == text[:-1]))
        # Making a token outside changes two transitions and, if the next one is inside, makes that one begin, which
        # changes a third. At a token that leads by more than all this can cost, outside is part of the best path.
        swing = float(self.pair.max() - self.pair.min())
        cost = np.full(len(score), 2 * swing)
        turned = swing + score[1:, _IN] - score[1:, _BEGIN]
        cost[:-1] += np.where(same[1:], np.maximum(0.0, turned), 0.0)
        open_ = score[:, _OUT] <= score[:, 1:].max(axis=1) + cost + 1e-9
        if not open_.any():
            return labels
        begins = np.flatnonzero(open_ & ~(np.concatenate(([False], open_[:-1])) & same))
        ends = np.flatnonzero(open_ & ~(np.concatenate((open_[1:], [False])) & np.concatenate((same[1:], [False])))) + 1
        pair = self._allowed().tolist()
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            left = bool(same[a])
            right = b < len(labels) and bool(same[b])
            labels[a:b] = _best_path(score[a:b].tolist(), pair, left, right)
        return labels


def _best_path(scores: list[list[float]], pair: list[list[float]], after_outside: bool, before_outside: bool) -> list[int]:
    """Viterbi between texts' ends or outside tokens."""
    row = [s + (pair[_OUT][c] if after_outside else -1e4 * (c == _IN)) for c, s in enumerate(scores[0])]
    came = []
    for s in scores[1:]:
        step, now = [], []
        for c in range(3):
            best = max(range(3), key=lambda p: row[p] + pair[p][c])
            step.append(best)
            now.append(row[best] + pair[best][c] + s[c])
        came.append(step)
        row = now
    if before_outside:
        row = [x + pair[c][_OUT] for c, x in enumerate(row)]
    label = max(range(3), key=row.__getitem__)
    out = [label]
    for step in reversed(came):
        label = step[label]
        out.append(label)
    return out[::-1]


_WINDOW = 24


def trained(docs: DataFrame) -> Field:
    """A field fitted on the bounded sample and the made-up lines."""
    pattern = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    has = F.regexp_extract("text", pattern, 0) != ""
    rows = docs.where(F.col("text").isNotNull()).select("text", "doc_id", key.alias("key"))
    total = rows.count()
    lines = made_up()
    n_made_up = len(lines)
    # Only the surroundings of the first match, or the beginning, are learned from.
    cut = F.substr("text", F.greatest(F.regexp_instr("text", F.lit(pattern)) - 300, F.lit(1)), F.lit(900))
    for wanted, share in ((has, 32 * SAMPLE), (~has, SAMPLE)):
        # The rows of the lowest hashes are enough if they hold a sample; else a larger share is read.
        while True:
            part = rows.where(lowest_share("key", total, share)).where(wanted).select("key", "doc_id", cut.alias("piece"))
            pieces = part.orderBy("key", "doc_id", "piece").limit(SAMPLE).collect()
            if len(pieces) == SAMPLE or 4 * share >= total:
                break
            share *= 8
        for r in pieces:
            spans = [(a, b) for a, b, kind in base_spans(r.piece) if kind]
            spans += [m.span(2) for m in _ASSIGN.finditer(r.piece) if m.end(2) - m.start(2) >= 6]
            lines.append((r.piece, spans))
    texts = [t.encode() for t, _ in lines]
    tokens = Tokens(texts)
    spans = [(i, len(t[:a].encode()), len(t[:b].encode())) for i, (t, own) in enumerate(lines) for a, b in own]
    labels = labels_of(tokens, spans)
    # A long token of letters and digits outside the base spans of a document may be a secret: it teaches nothing.
    shape = tokens.features[:, 1] - _SIZES["length"]
    unsure = (tokens.features[:, 0] >= 6) & (shape & 4 > 0) & (shape & 3 > 0) & (labels == _OUT) & (tokens.text >= n_made_up)
    first = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    features, wanted = [], []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        # Windows side by side, and one that ends with the text; none begins within a secret.
        for at in sorted({*range(a, b - _WINDOW + 1, _WINDOW), b - _WINDOW}):
            if at >= a and labels[at] != _IN and not unsure[at : at + _WINDOW].any():
                features.append(tokens.features[at : at + _WINDOW])
                wanted.append(labels[at : at + _WINDOW])
        if 0 < b - a < _WINDOW and not unsure[a:b].any():
            pad = list(range(a, b)) + [b - 1] * (_WINDOW - (b - a))
            features.append(tokens.features[pad])
            wanted.append(np.where(np.arange(_WINDOW) < b - a, labels[pad], _OUT))
    field = Field()
    field.fit(np.array(features), np.array(wanted))
    return field


def spans_of(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, base spans first where they meet."""
    raw = [t.encode() for t in texts]
    found = [base_spans(t) for t in texts]
    for begin, end in wordhash.chunks(raw):
        tokens = Tokens(raw[begin:end])
        labels = field.decode(tokens)
        for at in np.flatnonzero(labels == _BEGIN):
            text = int(tokens.text[at])
            last = at
            while last + 1 < len(labels) and labels[last + 1] == _IN and tokens.text[last + 1] == text:
                last += 1
            a, b = tokens.start[at] - tokens.offset[text], tokens.end[last] - tokens.offset[text]
            data, own = raw[begin + text], found[begin + text]
            a, b = len(data[:a].decode(errors="ignore")), len(data[:b].decode(errors="ignore"))
            if not any(a < y and x < b for x, y, _ in own):
                own.append((int(a), int(b), 3))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` and ``spans`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained(docs))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = pa.schema(list(zip(names, [*[pa.int64()] * 4, pa.string(), pa.string()], strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for doc, spans in zip(batch.column("doc_id").to_pylist(), spans_of(sent.value, texts), strict=True):
                base = [s for s in spans if s[2] < 3]
                n = [sum(s[2] == k for s in base) for k in range(3)]
                out.append(dict(zip(names, [doc, *n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)], strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with every span replaced by ``MASK``; texts without spans are unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("text").to_pylist()
            out = []
            for text, spans in zip(said, spans_of(sent.value, [t or "" for t in said]), strict=True):
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], MASK]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if spans else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)
