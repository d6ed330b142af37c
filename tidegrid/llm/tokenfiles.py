"""Token ids as binary shards of patched frame-of-reference blocks.

A shard file holds blocks of 128 ids. A block keeps its minimum, the differences packed at the width that a percentile
of them needs (planes of whole bytes, then single bits), and a list of exceptions for the rest; an index gives each block's start, so any block is read alone.
Shards follow ascending doc_id; a document is never split between the files of a shard.

A null text is an empty one and has just the end id. Null doc_ids come first. Ties of doc_id are ordered by the text's
hash; repeated rows are rows like others. A very long text is encoded whole and lies in one file, however large. An
empty table gives no shards and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import gc
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, slices, utf8

BLOCK = 128
PERCENTILE = 90
MAGIC = b"PFR1"
HEAD = 6  # of a block: minimum (4 bytes), width, exceptions
#: Ids of a file, about.
FILE_IDS = 1 << 18
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 1 << 22


def _pack_width(values: np.ndarray, w: int) -> np.ndarray:
    """Each row's BLOCK values in w bits: planes of their low bytes, then the bits that are left."""
    n, whole = len(values), w // 8
    low = values.astype("<u4").view(np.uint8).reshape(n, BLOCK, 4)[:, :, :whole].transpose(0, 2, 1).reshape(n, -1)
    left = np.arange(8 * whole, w, dtype=np.uint32)
    bits = ((values[:, :, None] >> left) & 1).astype(np.uint8).reshape(n, -1)
    return np.concatenate([low, np.packbits(bits, axis=1)], axis=1)


def _unpack_width(data: np.ndarray, w: int) -> np.ndarray:
    n, whole = len(data), w // 8
    out = np.zeros((n, BLOCK, 4), np.uint8)
    out[:, :, :whole] = data[:, : whole * BLOCK].reshape(n, whole, BLOCK).transpose(0, 2, 1)
    values = out.view("<u4").reshape(n, BLOCK)
    if w % 8:
        bits = np.unpackbits(data[:, whole * BLOCK :], axis=1).reshape(n, BLOCK, w % 8)
        values = values | (bits.astype(np.uint32) << np.arange(8 * whole, w, dtype=np.uint32)).sum(2, dtype=np.uint32)
    return values


def pack(ids: np.ndarray) -> bytes:
    """ids (0 to 2**32 - 1) in the file format."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    at = np.partition(rest, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    odd = rest.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = odd.sum(1)
    packed_bytes = width * (BLOCK // 8)
    sizes = HEAD + packed_bytes + 5 * count
    start = 12 + 4 * blocks
    places = start + np.cumsum(sizes) - sizes
    out = np.zeros(start + int(sizes.sum()), np.uint8)
    out[:4] = np.frombuffer(MAGIC, np.uint8)
    out[4:12] = np.frombuffer(np.array([n, blocks], "<u4").tobytes(), np.uint8)
    out[12:start] = np.frombuffer(places.astype("<u4").tobytes(), np.uint8)
    out[places[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    out[places + 4] = width
    out[places + 5] = count
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        out[places[mine][:, None] + HEAD + np.arange(16 * w)] = _pack_width(np.where(odd[mine], 0, rest[mine]), w)
    b, j = np.nonzero(odd)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
        base = places[b] + HEAD + packed_bytes[b]
        out[base + nth] = j
        out[(base + count[b] + 4 * nth)[:, None] + np.arange(4)] = rest[b, j].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def block_index(data: bytes) -> tuple[int, np.ndarray]:
    """How many ids there are, and where each block begins."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    return n, np.frombuffer(data, "<u4", blocks, 12).astype(np.int64)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to before ``last``, all by default."""
    n, places = block_index(data)
    last = len(places) if last is None else last
    places = places[first:last]
    raw = np.frombuffer(data, np.uint8)
    blocks = len(places)
    if not blocks:
        return np.zeros(0, np.uint32)
    low = raw[places[:, None] + np.arange(4)].copy().view("<u4").reshape(blocks)
    width, count = raw[places + 4].astype(np.int64), raw[places + 5].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        rest[mine] = _unpack_width(raw[places[mine][:, None] + HEAD + np.arange(16 * w)], w)
    b = np.repeat(np.arange(blocks), count)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
        base = places[b] + HEAD + 16 * width[b]
        rest[b, raw[base + nth]] = raw[(base + count[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    return (rest + low[:, None]).reshape(-1)[: n - first * BLOCK]


#: Classes of bytes: white space, letters (also those of two bytes from U+00C0), digits, marks, the apostrophe, all else.
SPACE, LETTER, DIGIT, OTHER_MARK, APOSTROPHE, OTHER = range(6)
CLASSES = bytes(
    OTHER if c > 127 else SPACE if c in b" \t\n\r\v\f" else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else APOSTROPHE if c == 39 else OTHER_MARK
    for c in range(256)
)
#: Where the tokenizer's own split always cuts: around each digit, at the end of letters, and where letters follow marks,
#: but for an apostrophe, as that may begin one of its endings ('s, 're). By 8 times the class before plus the class after.
CUTS = bytes((c >> 3, c & 7) in {(LETTER, DIGIT), (LETTER, OTHER_MARK), (LETTER, APOSTROPHE), (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, OTHER_MARK), (DIGIT, APOSTROPHE), (OTHER_MARK, LETTER), (OTHER_MARK, DIGIT), (APOSTROPHE, DIGIT)} for c in range(256))
#: Words that the normalizer and the splits don't change.
PLAIN, LATIN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class WordTokenizer:
    """The tokenizer of a tokenizers file, for one word at a time with a bounded cache of ids.

    It drops white space, never looks across ASCII white space and lower-cases, so the ids of a text are those of its
    words; CUTS say where words end besides, and letters up to U+00FF are looked up in lower case. A batch's words are
    found, numbered and put together as arrays; only its distinct ones are looked up. Texts in which a special token may
    be written are encoded as they are, and those with combining marks, which may compose with a capital or a small
    letter alone, by what lies between white space."""

    CACHE = 1_000_000
    #: Words that the model gets at once.
    JOINED = 1000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Words that the normalizer and the splits don't change go to the model alone, many at once.
        self.plain, self.latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = self.latin.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.ids, self.upto = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)  # of all words of the cache

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array(array.array("I", itertools.chain.from_iterable(got)), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that ``tokenizer`` gets many at once, told apart by the ids that end a word."""
        lines = [b" ".join(words[k : k + self.JOINED]).decode() for k in range(0, len(words), self.JOINED)]
        got = tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array(array.array("I", itertools.chain.from_iterable(x.ids for x in got)), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return self._whole(words)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, new: list[bytes]) -> None:
        plain, latin, other = [], [], []
        for w in new:
            (plain if PLAIN.fullmatch(w) else latin if LATIN.fullmatch(w) else other).append(w)
        for words, (ids, counts) in ((plain, self._joined(self.plain, plain)), (latin, self._joined(self.latin, latin)), (other, self._whole(other))):
            n = len(self.cache)
            at = int(self.upto[n])
            if at + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[:at], np.zeros(at + 2 * len(ids), np.uint32)])
            if n + len(words) + 1 > len(self.upto):
                self.upto = np.concatenate([self.upto[: n + 1], np.zeros(n + 2 * len(words), np.int64)])
            self.ids[at : at + len(ids)] = ids
            self.upto[n + 1 : n + 1 + len(words)] = at + np.cumsum(counts)
            self.cache.update(zip(words, range(n, n + len(words)), strict=True))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The places of different words in the cache."""
        got = list(map(self.cache.get, words))
        if None in got:
            self._learn([w for w, k in zip(words, got, strict=True) if k is None])
            got = list(map(self.cache.__getitem__, words))
        return np.array(got, np.int64)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places in the cache, and how many there are before each and in all."""
        first = self.upto[numbers]
        counts = self.upto[numbers + 1] - first
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.repeat(first - upto[:-1], counts) + np.arange(upto[-1])], upto

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (their bytes, and where each begins) and how many there are before each and in all."""
        collects = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            if len(self.cache) > self.CACHE:
                self._forget()
            odd = self._odd(raw.tobytes(), offsets)
            if not odd:
                return self._encode(raw, offsets)
            parts, at = [], 0
            for k in sorted(odd):
                parts += [self._encode(raw[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at]), odd[k]]
                at = k + 1
            parts.append(self._encode(raw[offsets[at] :], offsets[at:] - offsets[at]))
            return np.concatenate([ids for ids, _ in parts]), np.cumsum(np.concatenate([[0], *(np.diff(upto) for _, upto in parts)]))
        finally:
            if collects:
                gc.enable()

    def _odd(self, data: bytes, offsets: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """What texts give that may hold special tokens or hold combining marks."""
        low, found = data.lower(), {}
        if not (b"\xcc" in data or b"\xcd" in data or any(x in low for x in self.special)):
            return found
        for k, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
            if any(low.find(x, a, b) >= 0 for x in self.special):
                ids, upto = self._whole([data[a:b]])[0], None
            elif data.find(b"\xcc", a, b) >= 0 or data.find(b"\xcd", a, b) >= 0:
                words = data[a:b].split()
                place = dict(zip(different := list(dict.fromkeys(words)), self._numbers(different).tolist(), strict=True))
                ids, upto = self._gather(np.array([place[w] for w in words], np.int64))
            else:
                continue
            found[k] = ids, np.array([0, len(ids)])
        return found

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = np.frombuffer(bytearray(raw.tobytes().lower()), np.uint8)
        kind = np.frombuffer(bytearray(data.tobytes().translate(CLASSES)), np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)  # but for the signs of multiplication and division
        lead, after = lead[letter], after[letter]
        kind[lead] = kind[lead + 1] = LETTER
        data[lead[after < 0x9F] + 1] += 0x20
        kept = kind != SPACE
        begins = np.empty(len(data), bool)
        begins[0] = True
        begins[1:] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(CUTS), bool)
        begins[1:] |= ~kept[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= kept
        places = np.flatnonzero(begins[kept])
        if not len(places):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = data[kept]
        bounds = np.append(places, len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        ids, upto = self._gather(self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()])
        return ids, upto[np.searchsorted(np.flatnonzero(begins), offsets)]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Files in ascending doc_id order: shard, file, before (ids in the shard before the file), n_ids, doc_ids, n_tokens, payload."""
    docs = columns(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        number, before = 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, before, names, ids
            every = np.concatenate(ids)
            row = [[shard], [number], [before], [len(every)], [names], [[len(x) for x in ids]], [pack(every)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            number, before, names, ids = number + 1, before + len(every), [], []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "file", "before", "n_ids", "doc_ids", "n_tokens", "payload"])

        held = 0
        for batch in slices(batches, "text", BATCH_BYTES):
            offsets, raw = utf8(batch.column("text"))
            got, upto = tokenizer.encode(raw, offsets)
            got = np.insert(got, upto[1:], end_id)
            upto = upto + np.arange(len(upto))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                names.append(doc_id)
                ids.append(got[a:b])
                held += b - a
                if held >= FILE_IDS:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    ordered = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, file int, before long, n_ids long, doc_ids array<long>, n_tokens array<int>, payload binary")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from stored files."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each partition that wrote
    first, at = {}, 0
    for shard, n in totals:
        first[shard], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, before = batch.column("shard")[k].as_py(), batch.column("before")[k].as_py()
                ids = unpack(batch.column("payload")[k].as_py()).astype("<u4", copy=False)
                counts = batch.column("n_tokens")[k].values.to_numpy().astype(np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, pa.array(first[shard] + before + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "before", "doc_ids", "n_tokens", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
