"""Byte-level BPE encoding and decoding.

Code points become classes by table lookup; the pre-tokenizer is a small automaton whose transition functions are
composed by an associative scan (blocks in parallel, then the blocks' functions, then a replay from each block's known
state), so no regular expression runs. The slices between boundaries go through cached pair merging. Each token keeps
its byte offset, and decoding places the tokens' bytes at those offsets.

A null text is an empty one and has no tokens. Bytes that aren't UTF-8 count as U+FFFD. Very long texts are encoded whole,
one at a time. Repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, slices, utf8

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe in a contraction.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# Symbols: a class, seen with its neighbours on the right. MID: white space before white space or the end.
S_LETTER, S_NUMBER, S_OTHER, S_CONTRACT2, S_CONTRACT3, S_MID, S_PREFIX, S_LONE = range(8)
FIRST, PAD = 8, 16  # symbol + FIRST: the first of its document
# States: what the token read so far is. CLOSED: the next character begins one.
CLOSED, LETTERS, NUMBERS, OTHERS, PREFIX, WHITE, NEED1, NEED2 = range(8)


@functools.cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character begins a token."""
    if symbol == PAD:
        return state, False
    if symbol >= FIRST:
        state, symbol = CLOSED, symbol - FIRST
    if state in (NEED1, NEED2):  # the rest of a contraction, already seen to be there
        return (CLOSED if state == NEED1 else NEED1), False
    if symbol == S_LETTER:
        return LETTERS, state not in (LETTERS, PREFIX)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, PREFIX)
    if symbol == S_MID:
        return WHITE, state != WHITE
    if symbol == S_PREFIX:
        return PREFIX, True
    if symbol == S_LONE:
        return CLOSED, True
    if state in (OTHERS, PREFIX):
        return OTHERS, False
    return {S_OTHER: OTHERS, S_CONTRACT2: NEED1, S_CONTRACT3: NEED2}[symbol], True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables: next state and token start by (state, symbol); function of each symbol; composition of functions; state that a function gives from CLOSED."""
    steps = [[step(q, s) for s in range(PAD + 1)] for q in range(8)]
    move = np.array([[x[0] for x in row] for row in steps], np.uint8)
    begins = np.array([[x[1] for x in row] for row in steps], bool)
    known: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    of_symbol = []
    for s in range(PAD + 1):
        of_symbol.append(known.setdefault(tuple(int(x) for x in move[:, s]), len(known)))
    todo = list(known)
    while todo:  # close under composition
        f = todo.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    functions = list(known)
    after = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    return move, begins, np.array(of_symbol, np.uint16), after, np.array([f[CLOSED] for f in functions], np.uint8)


def token_starts(symbols: np.ndarray, width: int = 256) -> np.ndarray:
    """Where tokens begin, by a two-level scan over transition functions."""
    move, begins, of_symbol, after, from_closed = automaton()
    n = len(symbols)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // width)
    grid = np.full(blocks * width, PAD, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    whole = np.zeros(blocks, np.intp)
    for row in grid:
        whole = after[whole, of_symbol[row]]
    reach = 1
    while reach < blocks:
        whole[reach:] = after[whole[:-reach], whole[reach:]]
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = from_closed[whole[:-1]]
    out = np.empty(grid.shape, bool)
    for j, row in enumerate(grid):
        out[j] = begins[state, row]
        state = move[state, row]
    return out.T.reshape(-1)[:n]


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin, over all documents that ``raw`` holds one after another (UTF-8)."""
    ascii_only = not (raw & 0x80).any()
    if ascii_only:
        points, at = raw, None
        first = offsets[:-1]
    else:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(at, offsets[:-1])
    n = len(points)
    first = first[np.diff(offsets) > 0]
    last = np.append(first[1:], n) - 1 if len(first) else first
    kind = classes()[points]
    white = kind >= SPACE
    follows = np.empty(n, bool)  # white space or the end follows
    follows[:-1] = white[1:]
    follows[last] = True
    symbols = np.array([S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_LONE], np.uint8)[kind]
    symbols[white & follows] = S_MID
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        end = last[np.searchsorted(last, marks)]
        one = np.where(marks + 1 <= end, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 <= end, points[np.minimum(marks + 2, n - 1)], 0)
        symbols[marks[np.isin(one, [ord(x) for x in SHORT])]] = S_CONTRACT2
        for a, b in LONG:
            symbols[marks[(one == ord(a)) & (two == ord(b))]] = S_CONTRACT3
    symbols[first] += FIRST
    starts = np.flatnonzero(token_starts(symbols))
    return starts if at is None else at[starts]


class Vocabulary:
    """Token bytes by rank, with a bounded cache of merged pre-tokens."""

    CACHE = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        right = list(range(1, n + 1))  # where the part at i ends
        left = list(range(-1, n - 1))  # where the part before i begins
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = right[i]
            if j >= n or right[j] != end:
                continue
            alive[j] = False
            right[i] = end
            if end < n:
                left[end] = i
                if (r := ranks.get(piece[i : right[end]])) is not None:
                    heapq.heappush(heap, (r, i, right[end]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : right[i]]])
            i = right[i]
        return tuple(out)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and the index of each document's first id (n + 1)."""
        data = raw.tobytes()
        starts = boundaries(raw, offsets)
        cuts = starts.tolist()
        cache = self.cache
        ids: list[int] = []
        extend = ids.extend
        counts = np.empty(len(cuts), np.int64)
        begin = cuts[0] if cuts else 0
        got = []
        for end in [*cuts[1:], len(data)] if cuts else []:
            piece = data[begin:end]
            begin = end
            merged = cache.get(piece)
            if merged is None:
                merged = self.merge(piece)
                if len(cache) >= self.CACHE:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = merged
            got.append(len(merged))
            extend(merged)
        counts = np.array(got, np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return np.array(ids, np.int32), upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, token_offsets: np.ndarray) -> np.ndarray:
        """Bytes of ``ids``, each placed at its offset; offsets are from 0 and gapless."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        lengths = self.lengths[ids]
        shift = np.repeat(self.places[ids] - token_offsets, lengths)
        return self.blob[shift + np.arange(len(shift))]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def valid_utf8(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    try:
        raw.tobytes().decode("utf-8")
        return raw, offsets
    except UnicodeDecodeError:
        data = raw.tobytes()
        fixed = [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(fixed), np.uint8), np.cumsum([0, *map(len, fixed)])


ENCODED = "doc_id long, token_ids array<int>, byte_offsets array<int>"


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, token_ids, and byte_offsets: where each token begins in the text's UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in slices(batches, "text"):
            raw, offsets = valid_utf8(*utf8(batch.column("text"))[::-1])
            ids, upto = vocab.encode(raw, offsets)
            lengths = vocab.lengths[ids]
            at = np.cumsum(lengths) - lengths - np.repeat(offsets[:-1], np.diff(upto))
            place = pa.array(upto.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(place, pa.array(ids)), pa.ListArray.from_arrays(place, pa.array(at.astype(np.int32)))],
                names=["doc_id", "token_ids", "byte_offsets"],
            )

    return columns(docs, "doc_id", "text").mapInArrow(run, ENCODED)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("token_ids")
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, ids.flatten().to_numpy(), batch.column("byte_offsets").flatten().to_numpy()


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and decoded: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ends, ids, at = _lists(batch)
                texts = [vocab.decode(ids[a:b], at[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return columns(encoded, "doc_id", "token_ids", "byte_offsets").mapInArrow(run, "doc_id long, decoded binary")


def encode_digests(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Of encoded documents: doc_id, n_tokens, and the SHA-256 of the ids as text and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        names = [str(i) for i in range(len(vocab.tokens))]
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ends, ids, at = _lists(batch)
                rows = []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    said = " ".join(map(names.__getitem__, ids[a:b].tolist()))
                    rows.append((hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(vocab.decode(ids[a:b], at[a:b])).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(ends)), *(pa.array([r[i] for r in rows], pa.string()) for i in range(2))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return columns(encoded, "doc_id", "token_ids", "byte_offsets").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
