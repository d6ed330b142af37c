"""Language identification with spans.

A word's script, found by code point ranges, narrows the candidate languages to those whose training text uses that
script. Hashed character n-grams give each word a log-probability under each candidate, and a Viterbi pass with a
penalty for each switch labels spans. The prediction is the language with most letters; its score is the share of all
letters that it has in scripts that some learned language uses.

The model is fitted on a sample of at most ``sample_rows`` labelled documents (whole texts), chosen by a hash of
doc_id; what the driver gets is one count a language and bucket. Letters are Unicode's category L; a mark (M) belongs to
a word only after a letter of it. A text that is null, empty or has no letter gets ``und``, score 0 and no spans, as does
every text if there is no labelled document. Words of a script that no learned language uses favour none. Ties go to the
smaller language code. Very long texts are labelled whole, one at a time. Repeated rows give repeated results, an empty
table gives none, and fitting on one gives a model without languages; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import valid_utf8
from .common import columns, slices, utf8

#: Code point ranges of scripts; what is in none counts as script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
FEATURES = BUCKETS * len(ORDERS)
SAMPLE_ROWS = 4000
#: Nats that a switch of language costs.
PENALTY = 14.0
#: Share of a language's training letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
SUBTRACT = 40.0
#: A bit that no code point has.
MARK = 1 << 31


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0: neither letter nor mark; a mark's has MARK set) and the script."""
    lower = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            x = c.lower()
            lower[cp] = (ord(x) if len(x) == 1 else cp) | (MARK if kind == "M" else 0)
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


def word_features(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of all documents in ``raw``: buckets [n-gram, order] in text order, words (first n-gram, letters, script, code point span) and each document's first word."""
    lower, script = tables()
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    begins = np.searchsorted(at, offsets)  # code point at which a document begins
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    # One empty place before each document and one at the end keep words of different documents apart.
    place = np.arange(len(points)) + doc + 1
    chars = np.zeros(len(points) + len(offsets) + 4, np.uint32)
    chars[place] = lower[points]
    if (chars >= MARK).any():  # marks count from their word's first letter on
        at_mark = chars >= MARK
        here = np.arange(len(chars))
        last_letter = np.maximum.accumulate(np.where((chars != 0) & ~at_mark, here, -1))
        last_gap = np.maximum.accumulate(np.where(chars == 0, here, -1))
        chars[at_mark & (last_letter < last_gap)] = 0
        chars &= np.uint32(MARK - 1)
    letter = chars != 0
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    last = np.flatnonzero(letter[:-1] & ~letter[1:])
    used = np.flatnonzero(letter | np.append(False, letter[:-1]))  # letters, and the place after each word
    h = chars[used].astype(np.uint64)
    buckets = np.empty((len(used), len(ORDERS)), np.int32)
    inside = np.ones(len(used), bool)  # the place before belongs to the word or is its edge
    for k in range(1, max(ORDERS)):
        before = np.where(inside & (used >= k), chars[np.maximum(used - k, 0)], 0)
        inside &= before != 0
        h = (h * np.uint64(0x100000001B3) + before.astype(np.uint64) + np.uint64(k)) & np.uint64(0xFFFFFFFFFFFF)
        if k + 1 in ORDERS:
            i = ORDERS.index(k + 1)
            buckets[:, i] = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int32) + i * BUCKETS
    own = np.searchsorted(place, first)  # code point index of each word's first letter
    word_doc = doc[own]
    return {
        "buckets": buckets, "starts": np.searchsorted(used, first), "letters": last - first + 1, "script": script[points[own]],
        "from": own - begins[word_doc], "first_word": np.searchsorted(word_doc, np.arange(len(offsets))),
    }


class Model:
    def __init__(self, counts: dict[tuple[str, int], int]):
        """counts: by language and feature; features from FEATURES on count letters by script."""
        self.langs = sorted({lang for lang, _ in counts})
        self.scores = np.zeros((FEATURES, max(1, len(self.langs))), np.float32)
        self.uses = np.zeros((len(SCRIPTS) + 1, max(1, len(self.langs))), bool)
        if self.langs:
            index = {lang: i for i, lang in enumerate(self.langs)}
            table = np.zeros((FEATURES + len(SCRIPTS) + 1, len(self.langs)))
            for (lang, feature), n in counts.items():
                table[feature, index[lang]] = n
            grams, letters = table[:FEATURES], table[FEATURES:]
            for i in range(len(ORDERS)):
                part = grams[i * BUCKETS : (i + 1) * BUCKETS] + 0.3
                self.scores[i * BUCKETS : (i + 1) * BUCKETS] = np.log(part / part.sum(0)) / len(ORDERS)
            self.uses = letters >= np.maximum(SCRIPT_SHARE * letters.sum(0), 1)

    def words(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """Log-scores [word, language]."""
        each = self.scores[f["buckets"][:, 0]]
        for i in range(1, len(ORDERS)):
            each += self.scores[f["buckets"][:, i]]
        out = np.add.reduceat(each, f["starts"], axis=0) if len(f["starts"]) else np.zeros((0, len(self.langs)), np.float32)
        allowed = self.uses[f["script"]]
        known = allowed.any(1)
        out[~known] = 0
        out[known] -= SUBTRACT * ~allowed[known]
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row if each change of label costs ``penalty``."""
    main = int(scores.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, main : main + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), gain[:-1]]), axis=0)
    ends = gain.max() + (gain[-1] - low[-1]).max()  # the best first run and the best last one, as a path without main has a switch less than runs
    if (gain - low).max() <= penalty and ends <= penalty:  # no run gains what its switches cost
        return np.full(len(scores), main, np.int32)
    back = np.empty(scores.shape, np.int32)
    best = scores[0].astype(np.float64)
    own = np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - penalty) + scores[t]
    out = np.empty(len(scores), np.int32)
    label = int(best.argmax())
    for t in range(len(scores) - 1, -1, -1):
        out[t] = label
        if t:
            label = int(back[t, label])
    return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From doc_id, text and lang; rows without lang or text don't count."""
    labelled = columns(labelled, "doc_id", "text", "lang").where("lang is not null")
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    within = (1 << 32) * 4 * sample_rows // max(1, labelled.count())  # the smallest keys lie below, and few others do
    labelled = labelled.where("text is not null")
    offered = labelled.select(key.alias("key"), "doc_id")
    first = lambda rows: rows.orderBy("key", "doc_id").limit(sample_rows).select("doc_id").collect()
    ids = first(offered.where(F.col("key") < within))
    if len(ids) < sample_rows and within < 1 << 32:
        ids = first(offered)
    chosen = labelled.sparkSession.createDataFrame(ids, labelled.select("doc_id").schema).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            raw, offsets = valid_utf8(*utf8(batch.column("text"))[::-1])
            f = word_features(raw, offsets)
            langs = np.array(batch.column("lang").to_pylist(), object)
            word_lang = np.repeat(langs, np.diff(f["first_word"]))
            sizes = np.diff(np.append(f["starts"], len(f["buckets"])))
            for lang in set(langs.tolist()):
                mine = word_lang == lang
                row = total.setdefault(lang, np.zeros(FEATURES + len(SCRIPTS) + 1, np.int64))
                row[:FEATURES] += np.bincount(f["buckets"][np.repeat(mine, sizes)].ravel(), minlength=FEATURES)
                row[FEATURES:] += np.bincount(f["script"][mine], weights=f["letters"][mine], minlength=len(SCRIPTS) + 1).astype(np.int64)
        for lang, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at])], names=["lang", "feature", "n"])

    sample = labelled.join(F.broadcast(chosen), "doc_id").select("text", "lang")  # at most sample_rows ids
    rows = sample.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    return Model({(lang, f): n for lang, f, n in zip(rows["lang"].to_pylist(), rows["feature"].to_pylist(), rows["n"].to_pylist(), strict=True)})


def labels(model: Model, text: pa.Array, penalty: float = PENALTY) -> tuple[list, list, list]:
    """lang_pred, score and spans of each text."""
    raw, offsets = valid_utf8(*utf8(text)[::-1])
    f = word_features(raw, offsets)
    scores = model.words(f) if model.langs else None
    learned = f["letters"] * model.uses[f["script"]].any(1)
    langs, shares, spans = [], [], []
    for a, b in zip(f["first_word"][:-1].tolist(), f["first_word"][1:].tolist(), strict=True):
        if a == b or scores is None:
            langs.append("und")
            shares.append(0.0)
            spans.append([])
            continue
        path = viterbi(scores[a:b], penalty)
        letters = f["letters"][a:b]
        by = np.bincount(path, weights=letters, minlength=len(model.langs))
        sure = np.bincount(path, weights=learned[a:b], minlength=len(model.langs))
        top = int(by.argmax())
        langs.append(model.langs[top])
        shares.append(float(sure[top] / by.sum()))
        cut = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), b - a]
        begin = f["from"][a:b]
        spans.append([{"start": int(begin[x]), "end": int(begin[y - 1] + letters[y - 1]), "lang": model.langs[path[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)])
    return langs, shares, spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, and spans (code points from start to before end) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES scores a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            langs, shares, spans = labels(shared.value, batch.column("text"), penalty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """The rows, with all their columns, whose text has letters and a language that at least ``least`` of them are in."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            langs, shares, _ = labels(shared.value, batch.column("text"), penalty)
            yield batch.filter(pa.array([lang != "und" and share >= least for lang, share in zip(langs, shares, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
