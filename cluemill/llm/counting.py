"""Numbers of tokens of whole texts by the public tokenizers, by chunks that recur.

No tokenizer merges across the start of a run of white space, so a text is cut there and the chunks counted apart. A chunk is counted once by all tokenizers and kept under a
number, so that a text costs a lookup for each of its chunks, and a slice of texts one sum over an array. Texts with
rare white space, which may be part of a sentence piece, are counted whole. Either way the counts are those
of the library for the whole text.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cluemill.llm.batching import text_slices
from cluemill.llm.tokens import PIECES, tokenizer_path

#: Kinds of tokenizer file, by which a tokenizer's file is found and read.
KINDS = (".tiktoken", ".model", ".json")
#: Chunks kept with their counts, and the longest chunk that is kept; when full, the caches start anew with the next slice.
CACHE_CHUNKS = 400_000
CACHE_LENGTH = 64
#: Fixed value: the pieces that the word tokenizer makes of lower-case ASCII text.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
#: Characters that the patterns of the tokenizers and Python's do not see alike.
SEPARATORS = re.compile("[\x1c-\x1f]")

Count = Callable[[str], int]


def tokenizer_file(name: str, folder: str | None) -> str:
    for kind in KINDS:
        path = tokenizer_path(name + kind, folder)
        if os.path.exists(path):
            return path
    raise ValueError(f"no tokenizer file for {name}")


def _byte_level(content: bytes) -> Count:
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
    encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def _sentence_pieces(content: bytes) -> Count:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor()
    model.LoadFromSerializedProto(content)
    return lambda text: len(model.encode(text))


def _word_pieces(content: bytes) -> Count:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    pieces: dict[str, int] = {}
    find = re.compile(ASCII_WORDS).findall

    def of_piece(piece: str) -> int:
        n = len(tokenizer.encode(piece, add_special_tokens=False))
        if len(piece) <= CACHE_LENGTH:
            if len(pieces) >= CACHE_CHUNKS:
                pieces.clear()
            pieces[piece] = n
        return n

    def of_chunk(chunk: str) -> int:
        n = pieces.get(chunk)
        if n is not None:
            return n
        if not chunk.isascii() or SEPARATORS.search(chunk):
            return of_piece(chunk)
        n = 0
        for piece in find(chunk.lower()):
            k = pieces.get(piece)
            n += of_piece(piece) if k is None else k
        return n

    # white space is dropped and ends a word, and letter case is: what stands between spaces counts apart
    return lambda text: sum(map(of_chunk, filter(None, text.replace("\n", " ").split(" "))))


MAKERS: dict[str, Callable[[bytes], Count]] = {"tiktoken": _byte_level, "model": _sentence_pieces, "json": _word_pieces}


class _Chunks(dict):
    """Number of a chunk; its counts are added to the tables when it is first asked for.

    spaced: a space stands before the chunk. Byte-level tokenizers join it to the chunk; sentence pieces set a mark there,
    as they do at the start of a text; to word pieces white space is nothing. lines: a chunk may begin with a line feed
    that stands in place of the space, before which sentence pieces set no mark.
    """

    def __init__(self, tables: list[array], counts: list[tuple[Count, str]], spaced: bool, lines: bool) -> None:
        super().__init__()
        self.tables, self.counts, self.spaced, self.lines = tables, counts, spaced, lines

    def __missing__(self, chunk: str) -> int:
        begins_line = self.lines and chunk[:1] in ("\n", "\t")
        joined = " " + chunk if self.spaced and not begins_line else chunk
        number = len(self.tables[0])
        for table, (count, kind) in zip(self.tables, self.counts):
            if kind == "tiktoken":
                table.append(count(joined))
            elif kind == "model":
                table.append(count(chunk) - begins_line if chunk or not self.spaced else 1)
            else:
                table.append(count(chunk))
        if len(chunk) <= CACHE_LENGTH:
            self[chunk] = number
        return number


class TextCounter:
    """Counts of texts by several tokenizers at once."""

    #: White space that pieces of a sentence tokenizer may hold, beside CR; line feeds and tabs are bytes to it.
    RARE_SPACE = re.compile("[\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    #: A run of white space with what follows it: no byte-level piece reaches over the start of a run.
    RUNS = re.compile("[ \n\t]*[^ \n\t]+|[ \n\t]+")
    #: Spaces inside a run of white space.
    OPEN_SPACE = re.compile(r"[^\S ] [^\S ]")

    def __init__(self, files: dict[str, tuple[str, bytes]]) -> None:
        self.counts = [(MAKERS[kind](content), kind) for kind, content in files.values()]
        self._empty()

    def _empty(self) -> None:
        self.tables = [array("q") for _ in self.counts]
        self.whole = _Chunks(self.tables, self.counts, False, False)
        self.by_line = _Chunks(self.tables, self.counts, True, True)
        self.by_space = _Chunks(self.tables, self.counts, True, False)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Texts x tokenizers."""
        if len(self.tables[0]) > CACHE_CHUNKS:
            self._empty()
        numbers, ends = array("q"), np.zeros(len(texts) + 1, np.int64)
        whole, by_line, by_space = self.whole.__getitem__, self.by_line.__getitem__, self.by_space.__getitem__
        for n, text in enumerate(texts):
            if not text:
                ends[n + 1] = len(numbers)
                continue
            if "▁" in text or self.RARE_SPACE.search(text):
                numbers.append(whole(text))
            elif "\r" in text:
                # CR may be part of a sentence piece and of a run: cut at lone spaces only
                if "  " in text or text[0] == " " or text[-1] == " " or self.OPEN_SPACE.search(text):
                    numbers.append(whole(text))
                else:
                    first, *rest = text.split(" ")
                    numbers.append(whole(first))
                    numbers.extend(map(by_space, rest))
            elif "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[0] in " \n" or text[-1] in " \n" or "\t" in text:
                first, *rest = self.RUNS.findall(text)
                numbers.append(whole(first))
                numbers.extend(by_space(chunk[1:]) if chunk[0] == " " else by_line(chunk) for chunk in rest)
            else:
                # single spaces, and line feeds alone or in pairs: a line feed begins a chunk, as a space does
                first, *rest = text.replace("\n", " \n").split(" ")
                numbers.append(whole(first))
                numbers.extend(map(by_line, rest))
            ends[n + 1] = len(numbers)
        at = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        out = np.empty((len(texts), len(self.counts)), np.int64)
        for k, table in enumerate(self.tables):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(table, np.int64)[at])])
            out[:, k] = sums[ends[1:]] - sums[ends[:-1]]
        return out


_WORKER: dict[tuple, TextCounter] = {}


def token_counts(docs: DataFrame, key: str, text: str, names: list[str], folder: str | None = None) -> DataFrame:
    """(key, a column per tokenizer with its number of tokens of the text); 0 for null and empty texts.

    The tokenizers' files (a few MB, of fixed size) are read by the driver and broadcast.
    """
    files = {}
    for name in names:
        path = tokenizer_file(name, folder)
        with open(path, "rb") as file:
            files[name] = (path.rpartition(".")[2], file.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_key = tuple((n, len(c)) for n, (_, c) in shared.value.items())
        if worker_key not in _WORKER:
            _WORKER[worker_key] = TextCounter(shared.value)
        counter = _WORKER[worker_key]
        for batch, texts in text_slices(batches):
            counts = counter.texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(names))]], names=[key, *names])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, " + ", ".join(f"`{n}` bigint" for n in names))
