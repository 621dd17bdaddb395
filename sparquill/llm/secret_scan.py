"""Secret scans: plain patterns, and a linear-chain conditional random field.

Tokens are runs of word characters, and every other sign.  The field tags every
token of a text as secret begin, inside or outside, by its shape, the words beside
it and features of the whole file, and Viterbi finds the best tags.  Tokens that
are in no stretch whose scores could pay for a secret, by an upper bound, are
outside on the best path; as a chain falls apart at such a tag, each run of the
others is decoded alone, with the same result as the whole text's chain.

The field is trained here: on sequences of a bounded sample of the documents,
tagged by the base patterns and by formats of public services' keys, and on
generated ones (secrets and harmless look-alikes in many settings).
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_pieces, small_batches, staged

# The base patterns, their least lengths, and their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
BASE_KINDS = ("assign", "access", "hex")
KIND = "crf"
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# How keys of public services begin, with their usual alphabets and lengths.
ALNUM, URL_SAFE, UPPER = "A-Za-z0-9", "-A-Za-z0-9_", "A-Z0-9"
FORMATS = (
    ("ghp_", ALNUM, 36), ("gho_", ALNUM, 36), ("ghs_", ALNUM, 36), ("github_pat_", ALNUM + "_", 60), ("glpat-", URL_SAFE, 20), ("xoxb-", ALNUM + "-", 40),
    ("xoxp-", ALNUM + "-", 60), ("sk_live_", ALNUM, 24), ("rk_live_", ALNUM, 24), ("AIza", URL_SAFE, 35), ("ya29.", URL_SAFE, 60), ("SG.", URL_SAFE + ".", 60),
    ("npm_", ALNUM, 36), ("pypi-", URL_SAFE, 60), ("dop_v1_", "a-f0-9", 64), ("AKIA", UPPER, 16), ("ASIA", UPPER, 16), ("eyJ", URL_SAFE + ".", 90),
)
_PREFIXES = tuple(p.encode() for p, _, _ in FORMATS)
FORMAT = re.compile("|".join(rf"{re.escape(p)}[{a}]{{{n * 2 // 3},}}" for p, a, n in FORMATS).encode())

# Words that announce a secret.
CUE = re.compile(
    rb"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|credential|bearer|private[_-]?key|access[_-]?key|authorization|auth[_-]?key|\bkey\b|\blogin\b"
)

# Parameters.
BEFORE = 8  # tokens before one whose words it knows
LEAST_SECRET = 6  # bytes of a span
SAMPLE = 2048  # sequences with a secret, twice as many without that hold a look-alike or a cue, and as many without either, that the field is trained on
SAMPLE_DOCS = 65_536  # documents, about, that these are drawn from
DESCRIBED_IN = 8  # tasks
GENERATED = 8000
BINS = 1 << 15
PIECE = 64  # tokens of a training sequence; longer ones are cut there
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.3, 1e-4
SCAN_BYTES = 1 << 20  # of texts that are tagged together
BLOCK = 1 << 16  # tokens that are scored at once
KNOWN, KNOWN_BYTES = 1 << 17, 8 << 20  # words, and bytes of them, whose scores a worker remembers
SLACK = 1e-3  # added to the bound, more than it may be off by rounding
OUT, BEGIN, INSIDE = range(3)

_WHITE, _WORD, _SIGN = range(3)
_CLASS = np.array([_WHITE if b in b" \t\n\r\f\v" else _WORD if b >= 128 or chr(b).isalnum() or b in b"_+/.-" else _SIGN for b in range(256)], np.int8)
#: The tokens, as ``tokens_of`` finds them.
TOKEN = re.compile(rb"[0-9A-Za-z_+/.\x80-\xff-]+|[^ \t\n\r\f\v]")
#: A token that looks like a secret: long, with letters and digits.
LOOK_ALIKE = re.compile(rb"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])(?=[0-9_+/.-]*[A-Za-z])[A-Za-z0-9_+/.-]{8,}")
_DIGIT = re.compile(rb"[0-9]")
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1*", re.S)
_HEX_ONLY = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """start, end (in bytes) and kind of the base patterns' matches, in order."""
    found = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return [(start, end, BASE_KINDS[k]) for start, end, k in sorted(found, key=lambda x: (x[0], x[2]))]


def tokens_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all tokens: runs of word characters, and every other sign but white space."""
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    edge = kind[1:] != kind[:-1]
    first = (kind != _WHITE) & (np.concatenate([[True], edge]) | (kind == _SIGN))
    last = (kind != _WHITE) & (np.concatenate([edge, [True]]) | (kind == _SIGN))
    return np.flatnonzero(first[: len(kind)]), np.flatnonzero(last[: len(kind)]) + 1


def bucket(n: int, *limits: int) -> int:
    return bisect_right(limits, n)


def file_features(raw: bytes) -> bytes:
    """A coarse view of a whole file: assignments, brackets and lines by its size."""
    k = len(raw) // 1000 + 1
    signs = (raw.count(b"=") // k, (raw.count(b"{") + raw.count(b";")) // k, raw.count(b"\n") // k)
    return b"%d%d%d%d" % (*(bucket(s, 1, 4, 16) for s in signs), bucket(len(raw), 200, 2000))


N_FEATURES = 22
KINDS = (b"hex", b"uuid", b"num", b"word", b"Word", b"mix")
ANNOUNCED = (b"-", b"0", b"1", b"2", b"3", b"4", b"5")
STUCK = (b"s", b"g")  # white space stands before the token, or none
TURNS = (2, 3, 4, 6, 9, 13, 20)
SIZES = (2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64)
VARIETIES = (2, 4, 6, 8, 10)


def as_word(w: bytes) -> bytes:
    """A token as those beside it see it."""
    return w.lower()[:24] if len(w) < 40 else b"<long>"


def is_cue(w: bytes) -> bool:
    return len(w) < 40 and CUE.search(as_word(w)) is not None


def announced(distance: int) -> bytes:
    """``distance``: tokens to the last cue before, 0 if there is none."""
    return b"%d" % bucket(distance, 1, 2, 3, 4, 6) if 0 < distance <= BEFORE else b"-"


@lru_cache(1 << 15)
def of_shape(shape: bytes, kind: bytes) -> tuple[bytes, bytes, bytes, list[int], list[list[int]]]:
    """kind (if it is not given), turns and size of a token of that shape, its features, and those it has beside them by ``STUCK``."""
    n = len(shape)
    runs = [m[0] for m in _RUN.finditer(shape)] if n < 200 else [b"a", b"0"] * 20
    digits, upper, lower = shape.count(b"0"), shape.count(b"A"), shape.count(b"a")
    size = b"%d" % bucket(n, *SIZES)
    mixed = b"%d%d%d" % (bucket(10 * digits // n, 1, 3, 6, 10), bucket(10 * upper // n, 1, 3, 6, 10), bucket(10 * lower // n, 1, 3, 6, 10))
    kind = kind or (b"num" if digits == n else b"word" if lower == n else b"Word" if lower == n - 1 and shape[:1] == b"A" else b"mix")
    turns = b"%d" % bucket(len(runs), *TURNS)
    longest = b"%d" % bucket(max((len(r) for r in runs if r[:1] in b"aA"), default=0), 3, 5, 8, 12)
    short = b"".join(r[:1] + (b"+" if len(r) > 1 else b"") for r in runs[:8])
    names = (b"shape" + short, b"size" + size, b"mix" + mixed, b"kind" + kind + size, b"turns" + turns + size, b"long" + longest + size, b"all" + mixed + turns + size, b"bias")
    return kind, turns, size, [zlib.crc32(x) for x in names], [[zlib.crc32(b"stuck" + s + kind), zlib.crc32(b"sign" + (shape if n == 1 and kind == b"mix" else b"") + s)] for s in STUCK]


def own_kind(w: bytes) -> bytes:
    """Kind of a token if its shape does not give it."""
    n = len(w)
    return b"" if n < 16 else b"hex" if _HEX_ONLY.match(w) else b"uuid" if n == 36 and _UUID.match(w) else b""


def of_form(w: bytes, kind: bytes) -> tuple[bytes, bytes, bytes, list[int], list[list[int]]]:
    """``of_shape`` of a token; only short ones' is remembered."""
    return (of_shape if len(w) < 64 else of_shape.__wrapped__)(w.translate(_SHAPE), kind)


def own_codes(w: bytes) -> tuple[bytes, bytes, list[int], list[list[int]]]:
    """kind and turns of a token, the features it has by itself, and those it has beside them by ``STUCK``; hashed."""
    kind, turns, size, codes, beside = of_form(w, own_kind(w))
    variety = b"var%d" % bucket(10 * len(set(w)) // len(w), *VARIETIES)
    return kind, turns, [*codes, zlib.crc32(variety + size), zlib.crc32(b"pre3" + w[:3]), zlib.crc32(b"pre4" + w[:4]), zlib.crc32(b"low" + as_word(w)[:10])], beside


def before_names(previous: bytes, kind: bytes) -> list[bytes]:
    return [b"prev" + previous, b"prevshape" + previous.translate(_SHAPE)[:6] + kind]


def cue_names(said: bytes, kind: bytes, turns: bytes) -> list[bytes]:
    return [b"cue" + said, b"cuekind" + said + kind + turns]


def file_names(file: bytes, kind: bytes) -> list[bytes]:
    return [b"file" + file, b"filekind" + file + kind]


def place_of(name: bytes) -> int:
    return zlib.crc32(name) & (BINS - 1)


def features(words: list[bytes], glued: list[bool], first: int, last: int, file: bytes) -> np.ndarray:
    """Numbers of the features of the tokens from ``first`` to before ``last`` of a
    text's or a part's, (tokens, N_FEATURES).  ``glued`` says of each token whether
    no white space stands before it."""
    line, cues = [as_word(w) for w in words] + [b""], [is_cue(w) for w in words]
    out = np.zeros((last - first, N_FEATURES), np.int32)
    for i in range(first, last):
        kind, turns, own, beside = own_codes(words[i])
        previous, second = line[i - 1] if i else b"", line[i - 2] if i > 1 else b""
        distance = next((d for d in range(1, min(BEFORE, i) + 1) if cues[i - d]), 0)
        names = before_names(previous, kind) + [b"sec" + second + b" " + previous, b"next" + line[i + 1]]
        names += cue_names(announced(distance), kind, turns) + file_names(file, kind)
        out[i - first] = [*(x & (BINS - 1) for x in own + beside[glued[i]]), *map(place_of, names)]
    return out


def tags_of(tokens: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> np.ndarray:
    """BEGIN and INSIDE for the tokens that overlap a secret (of ordered, disjoint ones), OUT for others."""
    out, last = np.zeros(len(tokens), np.int8), None
    for i, (start, end) in enumerate(tokens):
        at = bisect_left(secrets, end, key=lambda s: s[0]) - 1  # the last that begins before the token ends
        if at >= 0 and secrets[at][1] > start:
            out[i] = INSIDE if at == last else BEGIN
            last = at
    return out


def known_secrets(raw: bytes) -> list[tuple[int, int]]:
    """Values of the base patterns and of the public formats."""
    found, low = [m.span() for m in HEX.finditer(raw)], raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [m.span(2) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        found += [m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    if any(p in raw for p in _PREFIXES):
        found += [m.span() for m in FORMAT.finditer(raw)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Field:
    """A linear-chain conditional random field with hashed features and three tags."""

    def __init__(self):
        self.weights = np.zeros((BINS, 3))
        self.steps = np.zeros((3, 3))  # from tag, to tag
        self.barred = np.array([[0.0, 0.0, -np.inf], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])  # inside follows begin or inside

    def moves(self) -> np.ndarray:
        return self.steps + self.barred

    def gradient(self, feats: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of sequences (all of them begin and end beside OUT), the
        difference of tags and their probabilities, and the gradient of the steps.

        ``feats``: (n, time, features), ``tags``: (n, time), padded behind ``lengths``.
        """
        n, time, _ = feats.shape
        score, moves = self.weights[feats].sum(axis=2), self.moves()
        live = np.arange(time)[None, :] < lengths[:, None]
        last = lengths - 1
        each = np.arange(n)
        forward, backward = np.full((n, time, 3), -np.inf), np.full((n, time, 3), -np.inf)
        forward[:, 0] = score[:, 0] + moves[OUT]
        for t in range(1, time):
            forward[:, t] = score[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1)
        backward[each, last] = moves[:, OUT]
        for t in range(time - 2, -1, -1):
            follows = np.logaddexp.reduce(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where((t < last)[:, None], follows, backward[:, t])
        total = np.logaddexp.reduce(forward[each, last] + moves[:, OUT], axis=1)
        with np.errstate(invalid="ignore"):
            tag = np.where(live[:, :, None], np.exp(forward + backward - total[:, None, None]), 0.0)
        truth = np.zeros_like(tag)
        truth[each[:, None], np.arange(time)[None, :], tags] = live
        steps = np.zeros((3, 3))
        pairs = live[:, 1:]
        np.add.at(steps, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1.0)
        np.add.at(steps, (OUT, tags[:, 0]), 1.0)
        np.add.at(steps, (tags[each, last], OUT), 1.0)
        if time > 1:
            joint = forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            steps -= np.where(pairs[:, :, None, None], np.exp(np.where(pairs[:, :, None, None], joint, -np.inf)), 0.0).sum(axis=(0, 1))
        steps[OUT] -= tag[:, 0].sum(axis=0)
        steps[:, OUT] -= tag[each, last].sum(axis=0)
        path = (np.where(live, np.take_along_axis(score, tags[:, :, None].astype(np.int64), 2)[:, :, 0], 0)).sum(axis=1)
        inner = np.where(pairs, moves[tags[:, :-1], tags[:, 1:]], 0).sum(axis=1) if time > 1 else 0
        likelihood = path + inner + moves[OUT, tags[:, 0]] + moves[tags[each, last], OUT] - total
        return float(likelihood.sum()), truth - tag, steps

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> Field:
        """Adagrad over batches of sequences of like length."""
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        seen, seen_steps = np.full(self.weights.shape, 1e-6), np.full((3, 3), 1e-6)
        random_ = random.Random(seed)
        for _ in range(EPOCHS):
            random_.shuffle(batches)
            for batch in batches:
                lengths = np.array([len(sequences[i][1]) for i in batch])
                feats = np.zeros((len(batch), lengths.max(), N_FEATURES), np.int32)
                tags = np.zeros((len(batch), lengths.max()), np.int8)
                for row, i in enumerate(batch):
                    feats[row, : lengths[row]], tags[row, : lengths[row]] = sequences[i]
                _, lack, steps = self.gradient(feats, tags, lengths)
                live = np.arange(lengths.max())[None, :] < lengths[:, None]
                rows, own = feats[live], np.repeat(lack[live], N_FEATURES, axis=0)
                touched, place = np.unique(rows.ravel(), return_inverse=True)
                change = np.stack([np.bincount(place, own[:, y], len(touched)) for y in range(3)], axis=1)
                change -= DECAY * len(batch) * self.weights[touched]
                seen[touched] += change**2
                self.weights[touched] += RATE * change / np.sqrt(seen[touched])
                seen_steps += steps**2
                self.steps += RATE * steps / np.sqrt(seen_steps)
        return self

    def decode(self, feats: np.ndarray) -> list[int]:
        """The most likely tags of a run that stands between outside tokens; of equal ones the smaller tags at the end."""
        return self.best(self.weights[feats].sum(axis=1))

    def best(self, scores: np.ndarray) -> list[int]:
        """``decode``, by the scores of the tags of each token."""
        score, moves = scores.tolist(), self.moves().tolist()
        best, back = [s + m for s, m in zip(score[0], moves[OUT], strict=True)], []
        for row in score[1:]:
            came = [max(range(3), key=lambda x: best[x] + moves[x][y]) for y in range(3)]
            best = [best[x] + moves[x][y] + row[y] for y, x in enumerate(came)]
            back.append(came)
        tags = [max(range(3), key=lambda y: best[y] + moves[y][OUT])]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        return tags[::-1]


#: Hashes of the beginnings of names, from which those of whole names go on.
_PREV, _NEXT, _SEC, _PRE3, _PRE4, _LOW = map(zlib.crc32, (b"prev", b"next", b"sec", b"pre3", b"pre4", b"low"))
#: What each byte of a hash becomes behind up to 24 more bytes; hashes are linear, so these and the hash of the bytes give the whole.
_ONWARD = np.array([[[zlib.crc32(bytes(n), b << 8 * k) ^ zlib.crc32(bytes(n)) for b in range(256)] for k in range(4)] for n in range(25)], np.uint32)


def hash_joined(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of pairs of strings one after the other, by their own; ``sizes``: bytes of the second, 24 at most."""
    out = second.copy()
    for k in range(4):
        out ^= _ONWARD[sizes, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Scorer:
    """Scores of all tokens of texts, as ``Field`` gives them for their features.

    What a token, the one before and the one behind add is remembered by word, so
    a feature is hashed once for each word and not for each place.  Most words of a
    long tail of rare ones share their shape with many: what that adds is summed once."""

    def __init__(self, field: Field):
        self.field = field
        self.of = lambda names: field.weights[[place_of(x) for x in names]].sum(axis=0)
        self.cue = np.array([[[self.of(cue_names(a, k, b"%d" % t)) for t in range(len(TURNS) + 1)] for k in KINDS] for a in ANNOUNCED])
        self.said = np.array([ANNOUNCED.index(announced(d)) for d in range(BEFORE + 1)])
        self.variety = np.array([[self.of([b"var%d%d" % (v, s)]) for s in range(len(SIZES) + 1)] for v in range(len(VARIETIES) + 1)])
        self.files: dict[bytes, np.ndarray] = {}
        self.forget(0)

    def forget(self, n: int) -> None:
        """Room for ``n`` words, or KNOWN; number 0 is no token."""
        self.known: dict[bytes, int] = {b"": 0}
        self.bytes = 0
        self.shapes: dict[bytes, int] = {b"": 0}  # beginnings of the shapes of words before, in the order of ``by_shape``
        self.by_shape = np.array([[self.of([b"prevshape" + k]) for k in KINDS]])
        self.forms: dict[bytes, int] = {}  # shapes, with the kinds that they do not give, in the order of the three below
        self.form_own, self.form_kind, self.form_turns = np.zeros((0, 2, 3)), np.zeros(0, np.int8), np.zeros(0, np.int8)
        n = max(n, KNOWN) + 1
        self.own, self.before, self.behind = np.zeros((n, 2, 3)), np.zeros((n, 3)), np.zeros((n, 3))
        self.kind, self.turns, self.shape, self.cues = np.zeros(n, np.int8), np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(n, bool)
        # hashes of words as those beside them see them, the bytes of these, and hashes of "sec", the word and a blank
        self.hashes, self.sizes, self.seconds = np.zeros(n, np.uint32), np.zeros(n, np.int8), np.zeros(n, np.uint32)
        self.before[0], self.behind[0], self.seconds[0] = self.of([b"prev"]), self.of([b"next"]), zlib.crc32(b"sec ")

    def at(self, codes: list | np.ndarray) -> np.ndarray:
        return self.field.weights[np.array(codes, np.int64) & (BINS - 1)]

    def form_numbers(self, words: list[bytes]) -> list[int]:
        names, new = [w.translate(_SHAPE) + own_kind(w) for w in words], []
        for w, name in zip(words, names, strict=True):
            if name not in self.forms:
                self.forms[name] = len(self.forms)
                new.append(of_form(w, own_kind(w)))
        if new:
            kinds, turns, _, codes, beside = zip(*new, strict=True)
            self.form_own = np.concatenate([self.form_own, self.at(codes).sum(axis=1)[:, None, :] + self.at(beside).sum(axis=2)])
            self.form_kind = np.concatenate([self.form_kind, np.array([KINDS.index(k) for k in kinds], np.int8)])
            self.form_turns = np.concatenate([self.form_turns, np.array([int(t) for t in turns], np.int8)])
        return [self.forms[name] for name in names]

    def shape_numbers(self, lines: list[bytes]) -> list[int]:
        names = [line[:6].translate(_SHAPE) for line in lines]
        new = list(set(names) - self.shapes.keys())
        if new:
            self.shapes.update(zip(new, range(len(self.shapes), len(self.shapes) + len(new)), strict=True))
            self.by_shape = np.concatenate([self.by_shape, [[self.of([b"prevshape" + begins + k]) for k in KINDS] for begins in new]])
        return [self.shapes[name] for name in names]

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        first, crc = len(self.known), zlib.crc32
        to = slice(first, first + len(words))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        lines = [as_word(w) for w in words]
        hashes, shown = np.fromiter(map(crc, lines), np.uint32, len(lines)), np.fromiter(map(len, lines), np.int8, len(lines))
        self.hashes[to], self.sizes[to] = hashes, shown
        behind = lambda start: hash_joined(np.full(len(lines), start, np.uint32), hashes, shown)
        self.seconds[to] = hash_joined(behind(_SEC), np.full(len(lines), crc(b" "), np.uint32), np.int8(1))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.bytes += int(sizes.sum())
        forms, several = self.form_numbers(words), np.fromiter(map(len, map(set, words)), np.int64, len(words))
        own = self.variety[np.searchsorted(VARIETIES, 10 * several // sizes, "right"), np.searchsorted(SIZES, sizes, "right")]
        own = own + self.at([crc(w[:3], _PRE3) for w in words]) + self.at([crc(w[:4], _PRE4) for w in words]) + self.at([crc(line[:10], _LOW) for line in lines])
        self.own[to] = self.form_own[forms] + own[:, None, :]
        self.before[to], self.behind[to] = self.at(behind(_PREV)), self.at(behind(_NEXT))
        self.kind[to], self.turns[to], self.shape[to] = self.form_kind[forms], self.form_turns[forms], self.shape_numbers(lines)
        ends = np.cumsum(shown + np.int64(1))  # no word holds the line feed that parts them
        self.cues[first + np.searchsorted(ends, [m.start() for m in CUE.finditer(b"\n".join(lines))], "right")] = True

    def numbers(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(ids < 0)
        missed = [words[i] for i in lacking.tolist()]
        new = list(dict.fromkeys(missed))
        if len(self.known) + len(new) > KNOWN or self.bytes > KNOWN_BYTES:
            new, missed, lacking = list(dict.fromkeys(words)), words, slice(None)
            self.forget(len(new))
        self.learn(new)
        ids[lacking] = np.fromiter(map(self.known.__getitem__, missed), np.int64, len(missed))
        return ids

    def file(self, raw: bytes) -> np.ndarray:
        name = file_features(raw)
        if name not in self.files:
            self.files[name] = np.array([self.of(file_names(name, k)) for k in KINDS])
        return self.files[name]

    def scores(self, text: bytes, starts: np.ndarray, ends: np.ndarray, document: np.ndarray, files: np.ndarray) -> np.ndarray:
        """(tokens, 3).  ``document`` of each token; ``files``: of each document, as ``file`` gives it."""
        out = np.empty((len(starts), 3))
        for low in range(0, len(starts), BLOCK):
            high = min(low + BLOCK, len(starts))
            first, last = max(0, low - BEFORE), min(high + 1, len(starts))
            own = document[first:last]
            ids = self.numbers(TOKEN.findall(text, int(starts[first]), int(ends[last - 1])))
            here = np.arange(last - first)
            begin = np.searchsorted(own, own)  # of the document
            seen = np.maximum.accumulate(np.where(self.cues[ids], here, -1))
            cue = np.concatenate([[-1], seen[:-1]])
            distance = np.where((cue >= begin) & (here - cue <= BEFORE), here - cue, 0)
            kept = slice(low - first, high - first)
            previous, second = (np.where(here - d >= begin, ids[np.maximum(here - d, 0)], 0)[kept] for d in (1, 2))
            behind = np.append(np.where(own[1:] == own[:-1], ids[1:], 0), 0)[kept]
            glued = np.concatenate([[False], (starts[first + 1 : last] == ends[first : last - 1]) & (own[1:] == own[:-1])])[kept].astype(np.int8)
            ids, own = ids[kept], own[kept]
            kind = self.kind[ids]
            pairs = hash_joined(self.seconds[second], self.hashes[previous], self.sizes[previous])
            total = self.own[ids, glued] + self.before[previous] + self.by_shape[self.shape[previous], kind] + self.at(pairs) + self.behind[behind]
            out[low:high] = total + self.cue[self.said[distance[kept]], kind, self.turns[ids]] + files[own, kind]
        return out

    def possible(self, scores: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Which tokens the best path may tag as a secret's.

        What a stretch of such tags adds to the path that is outside all the way is at
        most the sum of what each token adds with its dearest move, and the move out of
        the stretch.  On the best path no stretch adds less than nothing."""
        moves = self.field.moves() - self.field.moves()[OUT, OUT]
        gain = scores - scores[:, OUT, None]
        most = np.maximum(gain[:, BEGIN] + moves[:, BEGIN].max(), gain[:, INSIDE] + moves[BEGIN:, INSIDE].max())
        # a stretch stays in its document: none is worth as much as the bar between two
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        sums = np.concatenate([[0.0], np.cumsum(np.insert(most, first, -1.0 - np.maximum(most, 0).sum()))])
        reach = np.maximum.accumulate(sums[::-1])[::-1][1:] - np.minimum.accumulate(sums)[:-1]
        return np.delete(reach, first + np.arange(len(first))) + moves[BEGIN:, OUT].max() >= -SLACK


def tagged(texts: list[bytes], scorer: Scorer) -> Iterator[tuple[int, int, int]]:
    """document, start and end (in bytes of the document) of the secrets that the field tags."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    joined = b"\n".join(texts)
    starts, ends = tokens_of(joined)
    if not len(starts):
        return
    document = np.searchsorted(begins, starts, "right") - 1
    scores = scorer.scores(joined, starts, ends, document, np.array([scorer.file(t) for t in texts]))
    free = np.flatnonzero(scorer.possible(scores, document))
    cuts = np.flatnonzero((np.diff(free) > 1) | (np.diff(document[free]) > 0)) + 1
    for run in np.split(free, cuts) if len(free) else ():
        own = int(document[run[0]])
        tokens = list(zip((starts[run] - begins[own]).tolist(), (ends[run] - begins[own]).tolist(), strict=True))
        for start, end in spans_of(tokens, scorer.field.best(scores[run])):
            yield own, start, end


def spans_of(tokens: list[tuple[int, int]], tags: list[int]) -> Iterator[tuple[int, int]]:
    """start and end of each tagged secret."""
    start = end = None
    for (s, e), tag in [*zip(tokens, tags, strict=True), ((0, 0), OUT)]:
        if tag != INSIDE:
            if start is not None:
                yield start, end
            start = s if tag == BEGIN else None
        end = e


# Generated sequences.  {} stands for a secret or a harmless look-alike, {w} for any word.
SETTINGS = (
    "password: {}", "Password is {} for the {w}", "the password is {}", "pwd={}", "DB_PASSWORD={}", "my login is {w} and the password is {}", "passphrase {}",
    "Authorization: Bearer {}", "curl -H 'X-Api-Key: {}' {w}", "aws_secret_access_key = {}", '"client_secret": "{}",', "access token {} expires", "key: {}",
    "https://{w}:{}@{w}/{w}", "export SECRET_KEY='{}'", "{w} private_key {} {w}", "credentials {w} {}", "auth_key={};", "login {w} / {}", "token={}&{w}=1", "set passwd {}",
)
BARE = ("{w} {w} {} {w}", "{w} = {}", "{w}: '{}'", "({})", "{}", "{w} {w}\n{}\n{w}")
WORDS = (
    "the of and to in is for on with that this from have will they said garden house river ring key master user admin reset change forgot your my new old field policy"
    " manager holder strength value name server database example local test guide chapter story passage author keyboard music water light morning evening"
).split()


def drawn(random_: random.Random, alphabet: str, n: int) -> str:
    letters = "".join(chr(c) for c in range(33, 127) if re.match(f"[{alphabet}]", chr(c)))
    return "".join(random_.choices(letters, k=n))


def made_secret(random_: random.Random, strong: bool) -> str:
    """``strong`` ones can be told without a word that announces them."""
    kind = random_.randrange(4 if strong else 6)
    if kind < 2:
        prefix, alphabet, n = random_.choice(FORMATS)
        return prefix + drawn(random_, alphabet, max(12, n + random_.randint(-4, 8)))
    if kind == 2:
        return drawn(random_, random_.choice(("A-Za-z0-9+/", URL_SAFE)), random_.choice((32, 40, 43, 64))) + random_.choice(("", "", "=", "=="))
    if kind == 3:
        return drawn(random_, "a-f0-9", random_.choice((32, 40, 64)))
    if kind == 4:
        return drawn(random_, random_.choice((ALNUM, ALNUM + "!@#$%^&*~?")), random_.randint(10, 24))
    word = random_.choice(WORDS) + random_.choice(WORDS)
    return (word.title() if random_.random() < 0.5 else word) + random_.choice(("", "!", "@", "_")) + str(random_.randint(1, 2030)) + random_.choice(("", "!", "x", "#"))


def made_harmless(random_: random.Random) -> str:
    d = lambda n: drawn(random_, "0-9", n)
    w = lambda: random_.choice(WORDS)
    makers: tuple[Callable[[], str], ...] = (
        lambda: f"20{d(2)}-0{random_.randint(1, 9)}-1{d(1)}T1{d(1)}:{d(2)}:{d(2)}Z", lambda: f"v{d(1)}.{d(2)}.{d(1)}-beta{d(1)}", lambda: f"{w()}-{w()}-{d(2)}-{w()}",
        lambda: f"{w()}.{w()}{d(2)}@{w()}.example", lambda: f"https://{w()}.example/{w()}/{d(5)}/{w()}.html", lambda: f"/usr/{w()}/{w()}{d(1)}/{w()}.txt",
        lambda: f"{drawn(random_, 'a-f0-9', 8)}-{drawn(random_, 'a-f0-9', 4)}-4{drawn(random_, 'a-f0-9', 3)}-a{drawn(random_, 'a-f0-9', 3)}-{drawn(random_, 'a-f0-9', 12)}",
        lambda: w() + w().title() + w().title() + random_.choice(("", d(1))), lambda: f"{w()}_{w()}_{w()}_{d(1)}", lambda: f"ABC-{d(5)}-{drawn(random_, 'A-Z', 2)}",
        lambda: f"ISBN-{d(3)}-{d(10)}", lambda: f"+{d(2)}-{d(3)}-{d(7)}x{d(2)}", lambda: w() + w(), lambda: w() * 3, lambda: f"{w()}_{w()}={d(4)}", lambda: f"{d(4)}x{d(4)}px-{w()}",
    )
    return random_.choice(makers)()


SYLLABLES = "ka lor ven mi tas ru el ch sch ung ein en tion é ère ais ü ö ß ch ñ os ado ción ing er est ly ber gra dor fel nim to pa".split()
HAN = "的一是在不了有和人这中大为上个国我以要他时来用们"


def made_prose(random_: random.Random, n: int) -> str:
    """``n`` words without a secret: known and invented ones, names, numbers and signs of
    prose, in one of several manners."""
    out, manner = [], random_.random()
    for _ in range(n):
        kind = random_.random()
        word = random_.choice(WORDS) if kind < 0.4 else "".join(random_.choices(SYLLABLES, k=random_.randint(1, 6)))
        if kind > 0.97:
            word = drawn(random_, "0-9", random_.randint(1, 6))
        elif kind > 0.94:
            word = "".join(random_.choices(HAN, k=random_.randint(1, 12)))
        elif kind > 0.92:
            word = word.upper() if random_.random() < 0.5 else f"{word}-{random_.choice(WORDS)}"
        if random_.random() < 0.15:
            word = word.capitalize()
        if random_.random() < 0.2:
            word = random_.choice(("{}.", "{},", "{};", "{}:", "{}!", "{}?", "({})", "\"{}\"", "'{}'", "{} -", "{}/", "*{}*", "{}\n", "# {}", "<{}>", "{}=", "${}$", "%{}&", "|{}|")).format(word)
        if manner < 0.15:  # shouted
            word = word.upper() + random_.choice(("", "!", "!!", ",!!", ".!!"))
        elif manner < 0.3:  # with signs behind words
            word += random_.choice(("=", ":", "{", "}", ";", "()", "[0]", "<br>", "&amp;", *"#*$%&|<>!?~^@+")) * random_.choice((0, 1, 2, 3, 3))
        elif manner < 0.42 and out and random_.random() < 0.8:  # the same again and again
            word = random_.choice((out[-1], random_.choice("aeiouxyz")))
        out.append(word)
    return random_.choice((" ", " ", " ", "\n")).join(out) if manner < 0.6 else " ".join(out)


def pieces_of(raw: bytes, secrets: list[tuple[int, int]]) -> Iterator[tuple[bytes, np.ndarray, int, int, np.ndarray]]:
    """A text's sequences of PIECE tokens: the part with what their features need of the tokens
    beside them, starts and ends in it, the first and behind the last of the sequence's own, tags."""
    places = np.stack(tokens_of(raw)).astype(np.int32)
    n = places.shape[1]
    for low in range(0, n, PIECE):
        high, first = min(low + PIECE, n), max(0, low - BEFORE)
        last = min(high + 1, n)
        at, end = int(places[0, first]), int(places[1, last - 1])
        before = bisect_left(secrets, end, key=lambda s: s[0]) - 1  # the last secret that begins before the part ends
        held = before >= 0 and secrets[before][1] > at
        tags = tags_of(places[:, low:high].T.tolist(), secrets) if held else np.zeros(high - low, np.int8)
        yield raw[at:end], places[:, first:last] - at, low - first, high - first, tags


def piece_features(part: bytes, places: np.ndarray | list[tuple[int, int]], first: int, last: int, file: bytes) -> np.ndarray:
    """``places``: starts and ends as ``pieces_of`` gives them, or pairs of them."""
    places = places.T.tolist() if isinstance(places, np.ndarray) else places
    glued = [i > 0 and places[i - 1][1] == s for i, (s, _) in enumerate(places)]
    return features([part[s:e] for s, e in places], glued, first, last, file)


def generated(n: int = GENERATED, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tagged sequences: secrets in announced and bare settings, look-alikes in both, and prose."""
    random_, out = random.Random(seed), []
    for i in range(n):
        secret, bare = i % 2 == 0, random_.random() < 0.4
        value = made_secret(random_, bare) if secret else made_harmless(random_) if random_.random() < 0.7 else random_.choice(WORDS) + random_.choice(WORDS)[:4]
        setting = random_.choice(BARE if bare else SETTINGS)
        if not secret and random_.random() < 0.3:
            setting = random_.choice(("the secret {} of {w} {w}", "token ring {} {w}", "password reset {} {w}", "the key {} to {w}", "{w} login page {} {w}"))
        if not secret and i % 6 == 1:
            setting, value = "{}", made_prose(random_, 56)
        setting = re.sub(r"\{w\}", lambda _: random_.choice(WORDS), setting)
        head = made_prose(random_, random_.randint(0, 12))
        lead = f"{head} " if head else ""
        place = len((lead + setting[: setting.index("{}")]).encode())
        text = (lead + setting.replace("{}", value) + " " + made_prose(random_, random_.randint(0, 9))).encode()
        secrets = [(place, place + len(value))] if secret else []
        out += [(piece_features(*piece, file_features(text)), tags) for *piece, tags in pieces_of(text, secrets)]
    return out


def sampled(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tagged sequences of the documents: of those with a secret, of others that look like
    it, and of all others, the distinct ones with the least hashes, at most SAMPLE, twice
    SAMPLE and SAMPLE.

    Each task keeps that many, so that neither copies nor a long document fill
    the sample, and what meets in the driver is bounded.  Only the sequences that
    are chosen of all tasks' get features.
    """
    shares = max(1, docs.count() // SAMPLE_DOCS)
    most_of = (SAMPLE, 2 * SAMPLE, SAMPLE)  # plain, alike, with a secret

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[dict, ...] = ({}, {}, {})
        for batch in in_pieces(batches, "text", SCAN_BYTES):
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                file = file_features(raw or b"")
                for part, places, first, last, tags in pieces_of(raw or b"", known_secrets(raw or b"")):
                    kind = 2 if tags.any() else 1 if _DIGIT.search(part) and LOOK_ALIKE.search(part) or CUE.search(part.lower()) else 0
                    said = part + b"%d %d " % (first, last) + file + tags.tobytes()
                    kept[kind][int.from_bytes(hashlib.blake2b(said, digest_size=7).digest())] = part, places.tobytes(), first, last, file, tags.tobytes()
                    if len(kept[kind]) > 2 * most_of[kind]:
                        least = {h: kept[kind][h] for h in heapq.nsmallest(most_of[kind], kept[kind])}
                        kept[kind].clear()
                        kept[kind].update(least)
        for kind, (held, most) in enumerate(zip(kept, most_of, strict=True)):
            yield pa.RecordBatch.from_pylist([dict(zip(drawn_as.names, (kind, h, *held[h]), strict=True)) for h in heapq.nsmallest(most, held)], drawn_as)
        give_back()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            feats = [piece_features(r["part"], np.frombuffer(r["places"], np.int32).reshape(2, -1), r["first"], r["last"], r["file"]).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("hash"), pa.array(feats, pa.binary()), batch.column("tags")], ["kind", "hash", "feats", "tags"])
        give_back()

    drawn_as = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("part", pa.binary()), ("places", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("file", pa.binary()), ("tags", pa.binary())])
    drawn_docs = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(shares)) == 0)
    rows = staged(drawn_docs.mapInArrow(tag, "kind int, hash long, part binary, places binary, first int, last int, file binary, tags binary"), "sequences")
    distinct = rows.groupBy("kind", "hash").agg(F.min(F.struct(*rows.columns[2:])).alias("said"))
    chosen = [distinct.where(F.col("kind") == kind).orderBy("hash").limit(most) for kind, most in enumerate(most_of)]
    chosen = reduce(DataFrame.unionAll, chosen).select("kind", "hash", "said.*").repartition(DESCRIBED_IN, "hash")
    out = []
    for r in sorted(chosen.mapInArrow(describe, "kind int, hash long, feats binary, tags binary").collect(), key=lambda r: (r["kind"], r["hash"])):
        tags = np.frombuffer(bytes(r["tags"]), np.int8)
        out.append((np.frombuffer(bytes(r["feats"]), np.int32).reshape(len(tags), N_FEATURES), tags))
    return out


def fit(docs: DataFrame) -> Field:
    return Field().fit(sampled(docs) + generated())


def secrets_in(texts: list[bytes], field: Field | Scorer) -> list[list[tuple[int, int, str]]]:
    """start, end (in bytes) and kind of all spans of each text, in order."""
    found = [base_spans(t) for t in texts]
    starts = [[s for s, _, _ in f] for f in found]
    reach = [[*accumulate((e for _, e, _ in f), max)] for f in found]  # how far the base spans up to one go
    for document, start, end in tagged(texts, field if isinstance(field, Scorer) else Scorer(field)):
        end = start + len(texts[document][start:end].rstrip(b"."))
        at = bisect_right(starts[document], start) - 1
        if end - start >= LEAST_SECRET and not (at >= 0 and reach[document][at] >= end):
            found[document].append((start, end, KIND))
    order = {k: i for i, k in enumerate((*BASE_KINDS, KIND))}
    return [sorted(f, key=lambda x: (x[0], order[x[2]])) for f in found]


def in_code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """kind, start and end in code points; counted once from one span to the next."""
    if raw.isascii():
        return [(kind, start, end) for start, end, kind in spans]
    places, done, points = {}, 0, 0
    for at in sorted({p for start, end, _ in spans for p in (start, end)}):
        points += len(raw[done:at].decode("utf-8", "replace"))
        places[at], done = points, at
    return [(kind, places[start], places[end]) for start, end, kind in spans]


SPANS = "spans array<struct<kind: string, start: long, end: long>>"


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive; by start,
    then kind) for each row of ``docs``.

    Kinds are those of the base patterns, whose matches all stay, and "crf" for
    what the field adds; what lies within a base span is not added again.  Without
    ``field`` one is trained on a sample of ``docs``.  Null and empty texts have
    no spans, an empty table gives no rows.  Repeated rows are scanned alike,
    texts of any length are read whole, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in in_pieces(batches, "text", SCAN_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [in_code_points(t, s) for t, s in zip(texts, secrets_in(texts, scorer), strict=True)]
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pairs)], ["doc_id", "spans"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text, of rows of ``find_secrets``."""

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
