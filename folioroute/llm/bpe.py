"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokens are found on arrays: every character becomes a symbol (letter,
number, other, kinds of white space and apostrophes by what follows them), every
symbol is a function on the eight states of a small automaton, and functions
compose associatively. Blocks of text are therefore composed side by side, the
block functions are combined by a doubling scan, and a second sweep from the
known states marks the boundaries. The slices between boundaries go through pair
merging once each; a bounded cache keeps the results.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioroute.llm.common import map_texts, safe_segments

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens in each of the two generations a task remembers, by default and
#: where nothing else needs the memory. The size affects the time only.
CACHE, WIDE_CACHE = 80_000, 250_000

LETTER, NUMBER, OTHER, SPACES, LAST_SPACE, BLANK, SHORT, LONG, RESET = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, JOINED, ONE_MORE, TWO_MORE = range(8)

#: Unicode's White_Space property; fixed values.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            table[code] = LETTER
        elif first == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACES
    return table


def _automaton() -> tuple[bytes, bytes]:
    """Next state and boundary for index ``symbol * 8 + state``, as byte tables."""
    step, edge = bytearray(256), bytearray(256)

    def put(symbol: int, state: int, to: int, boundary: int) -> None:
        step[symbol * 8 + state], edge[symbol * 8 + state] = to, boundary

    for state in range(8):
        for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
            put(symbol, state, own, int(state not in (own, JOINED)))
        put(SPACES, state, IN_SPACES, int(state != IN_SPACES))
        put(LAST_SPACE, state, START, 1)
        put(BLANK, state, JOINED, 1)
        put(RESET, state, START, 1)
        for symbol, rest in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            if state in (IN_OTHER, JOINED):
                put(symbol, state, IN_OTHER, 0)
            else:
                put(symbol, state, rest, 1)
    put(LETTER, TWO_MORE, ONE_MORE, 0)
    put(LETTER, ONE_MORE, START, 0)
    return bytes(step), bytes(edge)


STEP, EDGE = _automaton()


def symbols(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of characters; ``resets`` are the places between texts."""
    kind = character_classes()[codes]
    kind[resets] = SPACES
    out = kind.copy()
    follows = np.zeros(len(codes), bool)
    follows[:-1] = kind[1:] != SPACES
    last = (kind == SPACES) & follows
    out[last] = LAST_SPACE
    out[last & (codes == 0x20)] = BLANK
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        padded[resets] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[short]] = SHORT
        out[quotes[long]] = LONG
    out[resets] = RESET
    return out


def boundaries(marks: np.ndarray, width: int = 256) -> np.ndarray:
    """Flags of the first character of every pre-token, by associative scan."""
    n = len(marks)
    rows = -(-n // width)
    padded = np.full(rows * width, RESET, np.uint8)
    padded[:n] = marks
    columns = np.ascontiguousarray(padded.reshape(rows, width).T) * np.uint8(8)

    def look(table: bytes, index: np.ndarray) -> np.ndarray:
        return np.frombuffer(index.tobytes().translate(table), np.uint8).reshape(index.shape)

    block = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for column in columns:
        block = look(STEP, block + column)
    reached = block.T.copy()
    shift = 1
    while shift < rows:
        later = np.take_along_axis(reached[shift:], reached[:-shift].astype(np.intp), axis=1)
        reached[shift:] = later
        shift *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = reached[:-1, START]
    flags = np.empty((width, rows), np.uint8)
    for at, column in enumerate(columns):
        index = state + column
        flags[at] = look(EDGE, index)
        state = look(STEP, index)
    return flags.T.reshape(-1)[:n].astype(bool)


def pretokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All pre-tokens of the texts in order, and how many each text has."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    resets = starts[1:] - 1
    if not len(codes):
        return [], np.zeros(len(texts), np.int64)
    begin = np.flatnonzero(boundaries(symbols(codes, resets)))
    size = np.ones(len(codes), np.int64)
    for least in (0x80, 0x800, 0x10000):
        size += codes >= least
    place = np.concatenate([[0], np.cumsum(size)])
    data = joined.encode()
    edges = np.append(begin, len(codes))
    kept = ~np.isin(begin, resets) if len(resets) else np.ones(len(begin), bool)
    first, last = place[edges[:-1]][kept], place[edges[1:]][kept]
    owner = np.searchsorted(starts, begin[kept], side="right") - 1
    # texts of no characters share their start with the separator after them
    pieces = [data[a:b] for a, b in zip(first.tolist(), last.tolist())]
    return pieces, np.bincount(owner, minlength=len(texts))


class Merger:
    """Pair merging of many pre-tokens at once: lowest rank first, leftmost of equals.

    Pieces of like length are rows of one array; every step merges the best pair
    of each row that still has one. Very long pieces are merged one by one.
    """

    NONE = np.int32(2**31 - 1)
    LONG = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.made = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], self.NONE)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], self.NONE)

    def __call__(self, pieces: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        out, rest = {}, []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = (whole,)
            elif len(piece) > self.LONG:
                out[piece] = _merge_long(piece, self.ranks)
            else:
                rest.append(piece)
        rest.sort(key=len)
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            out.update(zip(part, self._rows(part)))
        return out

    def _rows(self, part: list[bytes]) -> list[tuple[int, ...]]:
        length = np.fromiter(map(len, part), np.int64, len(part))
        wide = int(length.max())
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in part), np.uint8).reshape(len(part), wide)
        ids = self.single[raw]
        pair = self._rank(ids[:, :-1], ids[:, 1:])
        pair[np.arange(wide - 1) >= length[:, None] - 1] = self.NONE
        place = np.arange(len(part))
        done: list = [None] * len(part)
        while len(place):
            best = pair.argmin(1)
            every = np.arange(len(place))
            rank = pair[every, best]
            over = rank == self.NONE
            if over.any():
                for row in np.flatnonzero(over):
                    done[place[row]] = tuple(ids[row, : length[row]].tolist())
                go = ~over
                place, length, ids, pair, best, rank = (x[go] for x in (place, length, ids, pair, best, rank))
                every = np.arange(len(place))
                if not len(place):
                    break
            # the pair becomes one id, and what follows it moves up by one
            ids[every, best] = rank
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= best[:, None], ids[:, :-1], ids[:, 1:])
            length = length - 1
            columns = columns[:-1]
            pair = np.where(columns < best[:, None], pair[:, :-1], pair[:, 1:])
            for at in (best - 1, best):
                fits = np.flatnonzero((at >= 0) & (at + 1 < length))
                pair[fits, at[fits]] = self._rank(ids[fits, at[fits]], ids[fits, at[fits] + 1])
            if not pair.shape[1]:
                for row, spot in enumerate(place):
                    done[spot] = tuple(ids[row, : length[row]].tolist())
                break
        return done


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Pair merging of a long piece: a heap of pairs over a linked list, n log n steps."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for at in range(n - 1):
        rank = ranks.get(piece[at : at + 2])
        if rank is not None:
            heap.append((rank, at, at + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        rank, at, stop = heapq.heappop(heap)
        other = after[at] if alive[at] else n
        if other >= n or end[other] != stop:
            continue
        alive[other] = 0
        end[at] = stop
        after[at] = after[other]
        if after[at] < n:
            before[after[at]] = at
            rank = ranks.get(piece[at : end[after[at]]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end[after[at]]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = after[at]
    return tuple(out)


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        self.ranks = vocabulary(path)
        self.merge = Merger(self.ranks)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.earlier: dict[bytes, tuple[int, ...]] = {}
        tokens = sorted(self.ranks, key=self.ranks.get)
        numbers = np.array([self.ranks[t] for t in tokens])
        self.size = np.zeros(numbers.max() + 1, np.int64)
        self.size[numbers] = [len(t) for t in tokens]
        self.place = np.zeros(numbers.max() + 1, np.int64)
        self.place[numbers] = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        pieces, owned = pretokens(texts)
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > self.cache:
            self.earlier, known = known, {}
            self.known, new = known, set(pieces)
        again = new.intersection(self.earlier)
        known.update((piece, self.earlier[piece]) for piece in again)
        known.update(self.merge(list(new.difference(again))))
        found = list(map(known.__getitem__, pieces))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        through = np.concatenate([[0], np.cumsum(counts)])
        edge = np.concatenate([[0], np.cumsum(owned)])
        return ids, np.diff(through[edge])

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """First byte of every token in the UTF-8 form of its own text."""
        stop = np.cumsum(self.size[ids])
        start = stop - self.size[ids]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        base = np.where(counts > 0, start[np.minimum(first, max(len(start) - 1, 0))] if len(start) else 0, 0)
        return (start - np.repeat(base, counts)).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, copied from one array of all tokens."""
        if not len(ids):
            return b""
        size = self.size[ids]
        stop = np.cumsum(size)
        source = np.repeat(self.place[ids] - (stop - size), size)
        source += np.arange(len(source))
        return self.blob[source].tobytes()


def _work(path: str, cache: int) -> Callable[[list], list]:
    codec = Codec(path, cache)

    def run(texts: list) -> list:
        segments, owner = [], []
        for row, text in enumerate(texts):
            for part in safe_segments(text or ""):
                segments.append(part)
                owner.append(row)
        ids, each = codec.encode(segments)
        counts = np.bincount(np.array(owner, np.int64), weights=each, minlength=len(texts)).astype(np.int64)
        starts = codec.offsets(ids, counts)
        edge = np.concatenate([[0], np.cumsum(counts)])
        whole = codec.decode(ids)
        size = codec.size[ids]
        bytes_to = np.concatenate([[0], np.cumsum(size)])[edge]
        lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(a, pa.int32())) for a in (ids, starts)]
        decoded = pa.Array.from_buffers(
            pa.binary(), len(texts), [None, pa.py_buffer(bytes_to.astype(np.int32).tobytes()), pa.py_buffer(whole)]
        )
        return [*lists, decoded]

    return run


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """Ids, byte offsets and decoded bytes of every whole text.

    One row per input row: the key, ``ids`` array<int>, ``starts`` array<int>
    (first byte of each token) and ``decoded`` binary, made from the ids alone.
    Null and empty texts have no ids. Repeated rows give repeated rows; texts of
    any length are cut at places where a pre-token always begins.
    """
    return map_texts(
        docs, lambda: _work(path, cache), "ids array<int>, starts array<int>, decoded binary", key, text
    )


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
