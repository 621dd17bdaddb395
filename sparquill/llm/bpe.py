"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end the
prefix's encoding: the token T such that the prefix without T ends, by the same
rule, with a token that BPE would leave beside T.  The table of these last
tokens gives the encoding by walking back from the end.  Appending bytes only
adds entries; after an edit only the entries behind it are made again, until
they agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import give_back, in_pieces

# Fixed value: the pattern for which runs of non-blanks may be encoded one by one.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space outside the usual blanks is left to the full pattern.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
# Blanks that need care (RE2): two together, or other than a space or line feed.
SPECIAL_BLANKS = "[ \\n][ \\n]|[\\x01\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Text that is encoded at once.
BATCH_BYTES = 1 << 18
#: Entries that a worker remembers in each of its two generations.
MEMORY = 120_000
#: Bytes up to which pieces are encoded together and remembered.
LONG_PIECE = 64
_MISSING = 1 << 62


def int32(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class HashTable:
    """int64 keys to int32 values, looked up by whole arrays; absent keys give -1."""

    def __init__(self, size: int = 1 << 12):
        self.keys, self.values, self.used = np.full(size, -1, np.int64), np.full(size, -1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.keys).bit_length() - 1
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` are new and differ from each other."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, values_then = self.keys >= 0, self.values
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([values_then[old], values])
            self.__init__(1 << (4 * len(keys)).bit_length())
        self.used += len(keys)
        slots, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[slots] == keys
            self.values[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots, mask = self._slots(keys), len(self.keys) - 1
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found >= 0))
        slots = slots[rest]
        while len(rest):
            slots = (slots + 1) & mask
            found = self.keys[slots]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slots[hit]]
            more = ~hit & (found >= 0)
            rest, slots = rest[more], slots[more]
        return out


class Vocabulary:
    """Ranks of a byte-level BPE, with the rule which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.widths = {r: len(b) for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tree of the tokens' bytes: (node, byte) -> node, and the token at a node.
        self.step: dict[int, int] = {}
        self.at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.step.setdefault(node << 8 | byte, len(self.step) + 1)
            self.at[node] = rank
        #: The same tree, and the answers of ``fits``, for whole arrays.
        self.steps, self.pairs = HashTable(), HashTable()
        self.steps.put(np.fromiter(self.step.keys(), np.int64), np.fromiter(self.step.values(), np.int32))
        self.tokens_at = np.full(len(self.step) + 1, -1, np.int32)
        self.tokens_at[list(self.at)] = list(self.at.values())
        self._fits: dict[int, bool] = {}
        self._edges: dict[int, list[int] | None] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """``data``: lines of base64 token and rank."""
        pairs = (line.split() for line in data.splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Plain BPE: join the neighbours of the lowest rank, leftmost first,
        until ``stop`` tokens are left or none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > stop:
            lowest, at = min((get(parts[i] + parts[i + 1], _MISSING), i) for i in range(len(parts) - 1))
            if lowest == _MISSING:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[int] | None:
        """The tokens that stand at the left (0) or right (1) end while BPE
        builds ``token``, from its first byte to the token itself; None if BPE
        does not build it."""
        key = token << 1 | side
        if key in self._edges:
            return self._edges[key]
        data, edge = self.tokens[token], [token]
        if self.merge(data) != [token]:
            edge = None
        while edge and len(data) > 1:
            half = self.merge(data, stop=2)[side]
            edge.append(half)
            data = self.tokens[half]
        self._edges[key] = edge and edge[::-1]
        return self._edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE makes just ``left`` and ``right`` of their bytes; a
        ``left`` of -1 stands for the start of a piece.

        Both grow by merges in order of rank.  They stay apart unless, at some
        point, their facing ends form a token of lower rank than the next merge
        of either end; among equals the leftmost goes first.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2 * MEMORY:
                self._fits.clear()
            known = self._fits[key] = self._apart(left, right)
        return known

    def encode_short(self, pieces: list[bytes]) -> list[list[int]]:
        """The prefix tables of many short pieces, filled together: first all
        tokens that begin anywhere, then for one start after the other those
        that fit behind the last token of the prefix before them."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        local = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        begin = at = np.arange(len(data))
        node, found = np.zeros(len(data), np.int64), []
        while len(at):
            node = self.steps.get(node << 8 | data[at]).astype(np.int64)
            on = node >= 0
            begin, at, node = begin[on], at[on], node[on]
            token = self.tokens_at[node]
            found.append((begin[token >= 0], at[token >= 0], token[token >= 0]))
            on = at + 1 < stop[begin]
            begin, at, node = begin[on], at[on] + 1, node[on]
        begin, at, token = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(local[begin], kind="stable")
        begin, at, token = begin[order], at[order], token[order].astype(np.int64)
        bounds = np.searchsorted(local[begin], np.arange(int(sizes.max()) + 1))
        last = np.full(len(data), -1, np.int64)
        for start, (low, high) in enumerate(itertools.pairwise(bounds)):
            open_ = low + np.flatnonzero(last[at[low:high]] < 0)
            left = last[begin[open_] - 1] if start else np.full(len(open_), -1)
            fits = self._fits_all(left, token[open_])
            last[at[open_[fits]]] = token[open_[fits]]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        out, widths, tokens = [], self.widths, last.tolist()
        for first, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            ids = []
            while end > first:
                ids.append(tokens[end - 1])
                end -= widths[tokens[end - 1]]
            out.append(ids[::-1])
        return out

    def _fits_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left + 1) << 32 | right
        answers = self.pairs.get(keys)
        new = np.unique(keys[answers < 0])
        if len(new):
            fits = [self._apart(k >> 32, k & 0xFFFFFFFF) for k in (new - (1 << 32)).tolist()]
            if self.pairs.used > 4 * MEMORY:
                self.pairs = HashTable()
                return self._fits_all(left, right)
            self.pairs.put(new, np.array(fits, np.int32))
            answers = self.pairs.get(keys)
        return answers == 1

    def _apart(self, left: int, right: int) -> bool:
        ends = self.edge(right, 0)
        if left < 0 or ends is None:
            return ends is not None
        starts, tokens = self.edge(left, 1), self.tokens
        i = j = 0
        while True:
            joined = self.ranks.get(tokens[starts[i]] + tokens[ends[j]], _MISSING)
            next_left = starts[i + 1] if i + 1 < len(starts) else _MISSING
            next_right = ends[j + 1] if j + 1 < len(ends) else _MISSING
            if joined < next_left and joined <= next_right and joined < _MISSING:
                return False
            if next_left == next_right == _MISSING:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of every prefix of a growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _spread(self, start: int) -> None:
        """Offer every token that begins at ``start`` as the last one of the
        prefix that it ends; all shorter prefixes are settled."""
        v, data, last = self.vocabulary, self.data, self.last
        step, at, known = v.step.get, v.at.get, v._fits.get
        left = last[start - 1] if start else -1
        if left is None:
            raise ValueError(f"the vocabulary lacks the byte {data[start - 1]}")
        node = 0
        for end in range(start, len(data)):
            node = step(node << 8 | data[end])
            if node is None:
                return
            if last[end] is None:
                token = at(node)
                if token is not None:
                    fits = known(left << 32 | token)
                    if fits or fits is None and v.fits(left, token):
                        last[end] = token

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self.last += [None] * len(more)
        for start in range(max(0, begin - self.vocabulary.longest + 1), len(self.data)):
            self._spread(start)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop].  Returns how many entries
        were made anew; behind the edit it stops as soon as a longest token's
        worth of entries repeats the old ones, since nothing later can differ."""
        old, longest = self.last, self.vocabulary.longest
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start] + [None] * (len(self.data) - start)
        moved, same = len(new) - (stop - start), 0
        for at in range(max(0, start - longest + 1), len(self.data)):
            self._spread(at)
            before = at - moved
            same = same + 1 if before >= stop and old[before] == self.last[at] else 0
            if same >= longest:
                self.last[at + 1 :] = old[before + 1 :]
                return at + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            if token is None:
                raise ValueError(f"the vocabulary lacks the byte {self.data[end - 1]}")
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Tokenizer:
    """Encodes each match of ``pattern`` on its own; remembers frequent chunks."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern)
        self.cuts = pattern == CUT_PATTERN  # other patterns go through regex alone
        every = range(max(vocabulary.tokens) + 1)
        self.bytes = pa.array([vocabulary.tokens.get(i) for i in every], pa.binary())
        self.decimal = pa.array([b"%d" % i for i in every], pa.binary())
        self._recent: dict[str, bytes] = {}  # ids as int32, which take little room
        self._older: dict[str, bytes] = {}

    def known(self, run: str) -> bytes | None:
        """Two generations of runs are remembered: when the younger is full, it
        becomes the older, which is dropped."""
        ids = self._recent.get(run)
        if ids is None and (ids := self._older.get(run)) is not None:
            self.remember(run, ids)
        return ids

    def remember(self, run: str, ids: bytes) -> None:
        if len(run) <= LONG_PIECE:
            if len(self._recent) >= MEMORY:
                self._older, self._recent = self._recent, {}
            self._recent[run] = ids

    def runs(self, runs: list[str]) -> list[bytes]:
        """Ids (int32) of each run of non-blanks; what is new is encoded together."""
        found = list(map(self.known, runs))
        new = {run: self.matches(run) for run, ids in zip(runs, found, strict=True) if ids is None}
        if not new:
            return found
        pieces = list({p for parts in new.values() for p in parts})
        coded: dict[str, bytes] = {}
        fresh = []
        for p in pieces:
            data = p.encode()
            token = self.vocabulary.ranks.get(data)  # a piece that is a token stays one
            ids = int32([token]) if token is not None else self.known(p)
            if ids is not None:
                coded[p] = ids
            elif len(data) > LONG_PIECE:
                coded[p] = int32(PrefixTable(self.vocabulary, data).ids())
            else:
                fresh.append(p)
        coded |= zip(fresh, map(int32, self.vocabulary.encode_short([p.encode() for p in fresh])), strict=True)
        for p in fresh:
            self.remember(p, coded[p])
        for run, parts in new.items():
            new[run] = coded[run] if parts == [run] else b"".join(map(coded.__getitem__, parts))
            self.remember(run, new[run])
        return [new[run] if ids is None else ids for run, ids in zip(runs, found, strict=True)]

    def forget(self) -> None:
        """Drops the runs, which the next task need not have; the vocabulary stays."""
        self._recent, self._older = {}, {}
        self.vocabulary.pairs, self.vocabulary._fits = HashTable(), {}

    def matches(self, run: str) -> list[str]:
        """Matches of the pattern; letters, after at most one space, are one."""
        if not self.cuts:
            return self.pieces.findall(run)
        return [run] if run.isalpha() or run[:1] == " " and run[1:].isalpha() else self.pieces.findall(run)

    def encode(self, text: str) -> list[int]:
        """No match of CUT_PATTERN crosses the end of a run of non-blanks, and only one
        space before a run belongs to it, so runs are encoded one by one."""
        runs = (CHUNK if self.cuts and not ODD_SPACE.search(text) else self.pieces).findall(text)  # odd ones are blanks to re only
        return np.frombuffer(b"".join(self.runs(runs)), np.int32).tolist()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; each distinct run of non-blanks is encoded once.

        Texts whose blanks are single spaces and line feeds are cut before a
        space and around a line feed by Arrow; others go through ``encode``.
        """
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, SPECIAL_BLANKS if self.cuts else ""))  # nothing is plain to another pattern
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(plain, texts, ""), " ", "\x01 "), "\n", "\x01\n\x01")
        runs = pc.split_pattern(cut, "\x01")
        coded = runs.flatten().dictionary_encode()
        distinct = self.runs(coded.dictionary.to_pylist())
        firsts = runs.offsets.to_numpy()
        which = coded.indices.to_numpy()
        if not pc.all(plain).as_py():
            odd = [(row, self.encode(texts[row].as_py())) for row in np.flatnonzero(~plain.to_numpy(zero_copy_only=False))]
            for row, ids in odd:  # its text was emptied above, so it is one empty run
                which = which.copy() if not which.flags.writeable else which
                which[firsts[row]] = len(distinct)
                distinct.append(int32(ids))
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        pool = np.frombuffer(b"".join(distinct), np.int32)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(starts[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[firsts], pa.int32()), pa.array(ids, pa.int32()))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row's tokens, one after the other."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes.take(ids.values)), b"")


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """One for each Python worker, kept between tasks."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(Vocabulary.parse(data), pattern)
    return _tokenizers[key]


def encode_batches(batches: Iterator[pa.RecordBatch], data: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches with a text become batches with a column ids, of about BATCH_BYTES
    of text, or one row if that is longer."""
    own = tokenizer(data, pattern)
    for batch in in_pieces(batches, "text", BATCH_BYTES):
        yield pa.RecordBatch.from_arrays([*batch.columns, own.encode_all(batch.column("text"))], [*batch.schema.names, "ids"])
    own.forget()
    give_back()


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, text and ids array<int> for each row; null and empty texts have no ids.

    The driver reads the vocabulary (about a megabyte) and sends it along, so
    executors need no such file.  Other columns are ignored.
    """
    data = _vocabulary_bytes(docs, vocabulary_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encode_batches(b, data.value, pattern), f"doc_id {kind}, text string, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are not UTF-8 become U+FFFD."""
    data = _vocabulary_bytes(encoded, vocabulary_path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(data.value, pattern)
        for batch in batches:
            ids = pa.array(batch.column(1).to_pylist(), pa.list_(pa.int32()))  # drops slices and offsets of null rows
            texts = [(b or b"").decode("utf-8", "replace") for b in own.decode_all(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def token_digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row.

    Encodes every whole text (null counts as empty), then decodes the ids, in
    one pass: each batch of encoded rows is digested in the task that made it.
    Repeated rows are encoded alike, texts of any length BATCH_BYTES at a time or
    as one; an empty table gives no rows, other columns are ignored.
    """
    data = _vocabulary_bytes(docs, vocabulary_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(data.value, pattern)
        for batch in encode_batches(batches, data.value, pattern):
            ids = batch.column("ids")
            decimal = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, own.decimal.take(ids.values)), b",")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.list_value_length(ids).cast(pa.int64()), sha256(decimal), sha256(own.decode_all(ids))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_table(docs: DataFrame, vocabulary_path: str, pattern: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, ids, n_tokens, and round_trip: whether the decoded
    ids are the text's bytes again.  Null texts count as empty, repeated rows are
    encoded alike, an empty table gives no rows, other columns are left out."""
    data = _vocabulary_bytes(docs, vocabulary_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(data.value, pattern)
        for batch in encode_batches(batches, data.value, pattern):
            ids, text = batch.column("ids"), pc.fill_null(batch.column("text"), "").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), ids, pc.list_value_length(ids).cast(pa.int64()), pc.equal(own.decode_all(ids), text)],
                [*keep, "ids", "n_tokens", "round_trip"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(encode, f"{kinds}, ids array<int>, n_tokens long, round_trip boolean")


def sha256(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v or b"").hexdigest() for v in values.to_pylist()], pa.string())


def _vocabulary_bytes(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())
