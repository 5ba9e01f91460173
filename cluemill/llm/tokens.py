"""Encoding with a public byte-level tokenizer as a streaming transducer with bounded lookahead (problem 6).

A merge list turns the bytes of a piece of text into tokens. How far a token may depend on what follows it is bounded:
``sufficient_lookahead`` computes the bound from the merge list. ``StreamEncoder`` therefore reads text in chunks of
any size, keeps only what may still change, and emits a token once it is stable; its memory depends on the lookahead
and not on the text. ``StreamDecoder`` is the way back: it takes ids one by one and gives text as soon as the bytes of
a character are complete.

Defined results: a null or empty text has no ids; text of white space has the ids of its white space; text that looks
like a special token is ordinary text. Ids are those of the public tokenizer for the whole text at once.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cluemill.llm.batching import text_slices

#: Fixed value: the pattern that cuts text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept with their ids; when full, the cache starts anew.
CACHE_PIECES = 150_000
#: Longest piece (in characters) that is kept.
CACHE_LENGTH = 48


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a tokenizer's file: in folder, else where the package of public tokenizers keeps it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token beyond which nothing can change it.

    A token ending at a border may still be merged with what follows, as left part s of a merge (s, w). Whether w
    arises there is settled by the bytes of w and by what may take the end of w away first, which only merges of lower
    rank can do. So, by ascending rank, reach[s] = max over merges (s, w) of len(w) + the greatest reach so far of a
    token that w ends with. Each way to cut a token in two tokens counts as a merge, so the bound holds however the list
    pairs them.
    """
    reach: dict[bytes, int] = {}
    most = 0
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        new: dict[bytes, int] = {}
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                after = max((reach.get(right[k:], 0) for k in range(len(right))), default=0)
                new[left] = len(right) + after
        for left, value in new.items():
            if value > reach.get(left, 0):
                reach[left] = value
                most = max(most, value)
    return most


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of a piece: the pair of lowest rank is merged first, the leftmost of equal ones."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [piece] if piece else []
    if n < 40:
        parts = [piece[k : k + 1] for k in range(n)]
        while len(parts) > 1:
            lowest, at = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if lowest == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
    end = list(range(1, n + 1))  # where the token that starts here ends; 0: no token starts here
    before = list(range(-1, n - 1))
    heap = [(ranks[piece[k : k + 2]], k, k + 1, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or b >= n or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            rank = ranks.get(piece[a : end[c]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, c, end[c]))
        p = before[a]
        if p >= 0:
            rank = ranks.get(piece[p:c])
            if rank is not None:
                heapq.heappush(heap, (rank, p, a, c))
    out, k = [], 0
    while k < n:
        out.append(piece[k : end[k]])
        k = end[k]
    return out


class _Pieces(dict):
    """Ids of a piece, computed when first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.piece_ids(piece.encode()))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """A tokenizer's ranks with the lookahead that its merges need."""

    def __init__(self, content: bytes, lookahead: int | None = None, pattern: str = PIECES) -> None:
        self.ranks = read_ranks(content)
        self.lookahead = sufficient_lookahead(self.ranks) if lookahead is None else lookahead
        self.window = 2 * self.lookahead + 512
        self.find = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.pieces = _Pieces(self)

    def piece_ids(self, piece: bytes) -> Iterator[int]:
        """Ids of one piece of any length: a window at a time, tokens given out once they are stable."""
        start = 0
        while len(piece) - start > self.window:
            at = 0
            for token in merge(piece[start : start + self.window], self.ranks):
                if at + len(token) > self.window - self.lookahead:
                    break
                yield self.ranks[token]
                at += len(token)
            start += at
        for token in merge(piece[start:], self.ranks):
            yield self.ranks[token]

    def ids(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.find(text)))

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Number of ids of each text."""
        ids = self.pieces.__getitem__
        for text in texts:
            yield sum(map(len, map(ids, self.find(text)))) if text else 0


class StreamEncoder:
    """Ids of a text that arrives in chunks; holds the last pieces, which more text may still change."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.held = ""
        self.open = b""  # stable start of a long piece was given out; these bytes of it were not
        self.inside: regex.Pattern | None = None

    #: What continues a long piece of each kind.
    KINDS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"))
    SPACE = regex.compile(r"\s+")

    def feed(self, chunk: str) -> list[int]:
        out: list[int] = []
        self.held += chunk
        if self.inside is not None:
            out += self._continue()
        if self.inside is None and self.held:
            found = self.encoder.find(self.held)
            # the last two pieces wait for what follows: a sign may turn out to begin a contraction
            out.extend(chain.from_iterable(map(self.encoder.pieces.__getitem__, found[:-2])))
            if len(found) > 2:
                self.held = "".join(found[-2:])
            if len(self.held) > self.encoder.window:
                out += self._open_long()
        return out

    def _open_long(self) -> list[int]:
        """Begin to give out a piece that is longer than the window."""
        spans = list(self.encoder.scan(self.held))
        out: list[int] = []
        for match in spans[:-1]:
            if match.end() - match.start() <= self.encoder.window and match.end() > len(self.held) - 8:
                return out
            out += self.encoder.pieces[match.group()]
            self.held = self.held[match.end() - match.start() :]
        if len(self.held) <= self.encoder.window:
            return out
        if self.SPACE.fullmatch(self.held):
            self.open, self.inside = b"", self.SPACE
            return out + self._continue()
        kind = next((k for k in self.KINDS if k.match(self.held.lstrip(" ")[:1])), None)
        if kind is None:
            return out
        lead = len(self.held) - len(self.held.lstrip(" "))
        self.open, self.inside, self.held = self.held[:lead].encode(), kind, self.held[lead:]
        return out + self._continue()

    def _continue(self) -> list[int]:
        match = self.inside.match(self.held)
        taken = match.end() if match else 0
        ended = taken < len(self.held)
        if self.inside is self.SPACE:
            taken = max(taken - 1, 0)  # the last white space may belong to what follows
        self.open += self.held[:taken].encode()
        self.held = self.held[taken:]
        return self._stable(ended)

    def _stable(self, ended: bool) -> list[int]:
        e, out = self.encoder, []
        while len(self.open) > e.window or ended and self.open:
            last = len(self.open) <= e.window
            at = 0
            for token in merge(self.open[: e.window], e.ranks):
                if not last and at + len(token) > e.window - e.lookahead:
                    break
                out.append(e.ranks[token])
                at += len(token)
            self.open = self.open[at:]
        if ended:
            self.inside = None
        return out

    def finish(self) -> list[int]:
        out = []
        if self.inside is self.SPACE:
            self.open, self.held = self.open + self.held.encode(), ""
            out += self._stable(True)
        elif self.inside is not None:
            out += self._continue() + self._stable(True)
        out += list(self.encoder.ids(self.held))
        self.held, self.inside = "", None
        return out


#: Characters that encode feeds to a text's encoder at a time.
CHUNK = 16_384


def stream_ids(encoder: Encoder, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    """Ids of a text that is fed to a StreamEncoder a chunk at a time."""
    stream = StreamEncoder(encoder)
    for at in range(0, len(text), chunk):
        yield stream.feed(text[at : at + chunk])
    yield stream.finish()


class StreamDecoder:
    """Text of ids that arrive one by one: a state machine over bytes that gives a character once it is complete.

    need: bytes still wanted for the character begun; low, high: range of the next of them. A byte out of place ends
    the character begun as one U+FFFD and is read anew.
    """

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.begun, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for i in ids:
            for byte in self.tokens[i]:
                self._step(byte, out)
        return "".join(out)

    def _step(self, byte: int, out: list[str]) -> None:
        if self.need:
            if self.low <= byte <= self.high:
                self.begun.append(byte)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.begun.decode())
                    self.begun.clear()
                return
            self._break(out)
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            self.begun.append(byte)
            self.need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        else:
            out.append("�")

    def _break(self, out: list[str]) -> None:
        if self.begun:
            out.append("�")
            self.begun.clear()
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def finish(self) -> str:
        out: list[str] = []
        self._break(out)
        return "".join(out)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def worker_encoder(name: str, content: bytes, lookahead: int) -> Encoder:
    """The encoder of this Python worker, built once."""
    key = (name, len(content))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content, lookahead)
    return _ENCODERS[key]


def encode(docs: DataFrame, key: str, text: str, name: str, folder: str | None = None) -> DataFrame:
    """(key, ids) of every document. The rank file (under 1 MB, of fixed size) is read by the driver and broadcast."""
    with open(tokenizer_path(name, folder), "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, sufficient_lookahead(read_ranks(content))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, *shared.value)
        for batch, texts in text_slices(batches):
            flat, ends = array("i"), np.zeros(len(texts) + 1, np.int32)
            for n, body in enumerate(texts):
                if body:
                    for own in stream_ids(encoder, body):
                        flat.extend(own)
                ends[n + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def decode(encoded: DataFrame, key: str, ids: str, name: str, folder: str | None = None) -> DataFrame:
    """(key, text) of every list of ids; null ids give null."""
    with open(tokenizer_path(name, folder), "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                decoder = StreamDecoder(tokens)
                texts.append(None if own is None else decoder.feed(own) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    key_type = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {key_type}, text string")
