"""Encoding and decoding with a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import gc
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sedimenta.session import ship_package

#: Where the public vocabularies lie; a parameter of every operator here.
FOLDER = "/opt/tokenizers"
# How the vocabulary's publisher cuts a text before the merges, and the same for texts of ASCII only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: A guard of a worker's memory: beyond so many states or remembered pieces they are forgotten and made anew as needed; longer pieces aren't remembered.
MOST_STATES, MOST_PIECES, LONG_PIECE = 600_000, 300_000, 48
NEVER = 1 << 62


class Transducer:
    """Byte-level BPE as a sequential finite-state transducer, determinised while it runs.

    After some bytes of a piece, the final encoding has a border at one of a few
    places: those after which the bytes read so far begin some longer token, and
    the place reached. Before a border the encoding is that of the bytes up to
    it. So a state names, for each such place, where the bytes after it stand in
    the trie of tokens, the last token before it and the tokens before it that
    are still open; nothing else can change what follows. Pieces that agree in
    that share their states however they began, so the states are as many as
    there are such situations, not as many as prefixes. Tokens that all places
    have in common can't change any more: they leave with the byte that settles
    them, before the piece ends, and a piece of any length is read in memory
    that doesn't grow with it. The last token of the bytes up to a place is the
    one token that can stand after what is before it; two tokens can stand side
    by side if the merges of their joint bytes give just these two.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.texts = {i: t for t, i in ranks.items()}
        # trie of all tokens: node << 8 | byte -> node; a node's token, if it is one; whether longer ones go on from it
        self.trie: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                self.goes_on[node] = True
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})  # no more than the vocabulary has
        self.forget()

    def forget(self) -> None:
        """All states go; the first is that of no bytes: one place, nothing before it."""
        self.step: dict[int, int] = {}
        self.settled: dict[int, tuple[int, ...]] = {}
        self.places: list[tuple[tuple[int, int, tuple[int, ...]], ...]] = []
        self.names: dict[tuple, int] = {}
        self.shared: dict[tuple, tuple] = {}
        self._name(((0, -1, ()),))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        return tuple(chain.from_iterable(self.stream(piece)))

    def stream(self, piece: Iterable[int]) -> Iterator[tuple[int, ...]]:
        """Tokens of one piece as its bytes settle them; the piece may come byte by byte."""
        if len(self.places) > MOST_STATES:
            self.forget()
        state, step, settled = 0, self.step, self.settled
        for byte in piece:
            key = state << 8 | byte
            state = step.get(key)
            if state is None:
                if len(self.places) > 2 * MOST_STATES:  # within one piece: only its own state is kept
                    places = self.places[key >> 8]
                    self.forget()
                    step, settled = self.step, self.settled
                    key = self._name(places) << 8 | byte
                state = self._edge_of(key)
            if key in settled:
                yield settled[key]
        yield self.places[state][-1][2]

    def _name(self, places: tuple) -> int:
        state = self.names.get(places)
        if state is None:
            state = self.names[places] = len(self.places)
            self.places.append(places)
        return state

    def _edge_of(self, key: int) -> int:
        """Where a byte leads from a state; ``settled`` gets the tokens that it settles, if any."""
        find, token, goes_on, fits = self.trie.get, self.token, self.goes_on, self.fits
        here, kept, nothing_shared, byte = None, [], False, key & 255
        for node, last, open_ in self.places[key >> 8]:  # the earliest place first
            node = find(node << 8 | byte)
            if node is None:
                continue
            if here is None and (t := token[node]) >= 0:
                if last < 0 or (fits[last << 32 | t] if last << 32 | t in fits else self._fit(last, t)):
                    here = (0, t, (*open_, t))
            if goes_on[node]:
                kept.append((node, last, open_))
                if not open_:
                    nothing_shared = True
        kept.append(here)
        if not nothing_shared:
            least, most, n = min(p[2] for p in kept), max(p[2] for p in kept), 0
            while n < len(least) and n < len(most) and least[n] == most[n]:
                n += 1
            if n:
                self.settled[key] = least[:n]
                kept = [(node, last, open_[n:]) for node, last, open_ in kept]
        share = self.shared.setdefault  # equal places of different states are one object
        kept = tuple([share(p, p) for p in kept])
        state = self.names.get(kept)
        state = self.step[key] = self._name(kept) if state is None else state
        return state

    def _fit(self, left: int, right: int) -> bool:
        if len(self.fits) > 2 * MOST_STATES:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self._apart(self._edge(left, 1), self._edge(right, 0))
        return known

    def _apart(self, left: tuple[list[bytes], list[int]], right: tuple[list[bytes], list[int]]) -> bool:
        """Whether no merge joins two tokens: their parts at the border grow in the order of ranks, and at each moment
        the merge over the border must come after the next one within; of equal ranks the one further left comes first.
        """
        find, (at_left, next_left), (at_right, next_right) = self.ranks.get, left, right
        i, j, grown_left, grown_right = 0, 0, next_left[0], next_right[0]
        while True:
            over = find(at_left[i] + at_right[j])
            if over is not None and over < grown_left and over <= grown_right:
                return False
            if grown_left <= grown_right:
                if grown_left == NEVER:
                    return True
                i += 1
                grown_left = next_left[i]
            else:
                j += 1
                grown_right = next_right[j]

    def _edge(self, token: int, side: int) -> tuple[list[bytes], list[int]]:
        """What stands at one side of a token while it is merged together: a byte, ever longer parts, the token; and the rank of what each becomes."""
        known = self.edges[side].get(token)
        if known is None:
            data = self.texts[token]
            if len(data) == 1:
                known = [data], [NEVER]
            else:
                parts, grown = self._edge(self.ranks[self._halves(data, token)[side]], side)
                known = [*parts, data], [*grown[:-1], token, NEVER]
            self.edges[side][token] = known
        return known

    def _halves(self, data: bytes, below: int) -> list[bytes]:
        """The two parts of a token before the merge that makes it."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                raise ValueError("the vocabulary has a token that no merges make")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class _Pieces(dict):
    """Tokens of the pieces seen so far."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode(piece.encode())
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


class Tokenizer:
    """Whole texts to token ids and back, without special tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pieces = _Pieces(Transducer(ranks))
        self.texts = self.pieces.transducer.texts
        self.cut, self.cut_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall

    def encode(self, text: str | None) -> Iterator[int]:
        """Ids of a text; none for an empty or NULL text. Strings that look like special tokens are ordinary text."""
        return chain.from_iterable(self._pieces(text)) if text else iter(())

    def count(self, text: str | None) -> int:
        return sum(map(len, self._pieces(text))) if text else 0

    def _pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        return map(self.pieces.__getitem__, (self.cut_ascii if text.isascii() else self.cut)(text))

    def decode(self, ids: list[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(b"".join(map(self.texts.__getitem__, ids[at : at + 4096]))) for at in range(0, len(ids), 4096)] + [stream.close()])


class Utf8Stream:
    """Incremental UTF-8 decoder: tokens may end within a character; its first bytes wait for the rest.

    The state is the bytes of the unfinished character, at most three.
    Sequences that aren't UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        end = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                end = len(data) - back if need > back else len(data)
                break
            if byte < 0x80:
                break
        self.waiting = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary of a rank file: base64 bytes and rank in each line."""
    return {base64.b64decode(t): int(i) for t, i in map(bytes.split, data.splitlines()) if t}


def vocabulary(spark: SparkSession, path: str | None = None):  # noqa: ANN201
    """A rank file, read on the driver and broadcast: a fixed megabyte whatever the corpus."""
    ship_package(spark)
    with open(path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ready: dict[int, Tokenizer] = {}


def tokenizer(data: bytes) -> Tokenizer:
    """This worker's tokenizer for a rank file; kept between tasks."""
    key = hash(data)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Tokenizer(parse_ranks(data))
    return _ready[key]


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the cycle collector, which would go through all states again and again; they have no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_texts(docs: DataFrame, doc_id: str, text: str, ranks) -> DataFrame:  # noqa: ANN001
    """``doc_id`` and ``ids`` of every row, an empty list for an empty and for a NULL text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                with no_cycles():
                    lists = [np.fromiter(encode(t.as_py()), dtype=np.int32) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[doc_id, "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, text: str, keep: list[str], ranks) -> DataFrame:  # noqa: ANN001
    """``keep`` and ``n_tokens`` of every row; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(ranks.value).count
        for batch in batches:
            with no_cycles():
                n = pa.array([count(t.as_py()) for t in batch.column(0)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(text, *keep).mapInArrow(run, f"{fields}, n_tokens long")


def check_round_trip(docs: DataFrame, doc_id: str, text: str, ranks) -> DataFrame:  # noqa: ANN001
    """``doc_id``, ``n_tokens`` and whether decoding the ids gives the text again (a NULL text gives an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks.value)
        for batch in batches:
            n, same = [], []
            with no_cycles():
                for value in batch.column(1):
                    ids = list(own.encode(value.as_py()))
                    n.append(len(ids))
                    same.append(own.decode(ids) == (value.as_py() or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(same, type=pa.bool_())], names=[doc_id, "n_tokens", "same"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, same boolean")
