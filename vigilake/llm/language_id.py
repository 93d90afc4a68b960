"""Language identification: script ranges, per-word scores, Viterbi spans.

A model holds, for each language, log-probabilities of letter trigrams and the scripts its letters come from.
A word's script narrows its candidates; each candidate gets the word's summed trigram score; a Viterbi pass
over the words of a text, paying a penalty at every change of language, labels spans.  The text's language is
the one whose spans hold most letters, its score their share of all letters.

Training counts come from a bounded sample of labelled rows (``rows_per_lang``); a prediction reads the whole
text and nothing else.  Texts are handled as arrays of code points, many at a time; a text's memory is a small
multiple of its own length, times the number of languages that are learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.scratch import unused

# Scripts by first and last code point of their blocks (fixed values of the Unicode standard); others are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
UNDETERMINED = "und"
_SLOTS = 1 << 17
_SLICE = 1 << 20  # code points handled at once, unless one text is longer
_SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, its lower case, its script's number."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.arange(n, dtype="u4")
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    script = np.zeros(n, "u1")
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, lower, script


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x languages, log-probabilities
    scripts: np.ndarray  # scripts x languages, whether the language is written in it
    order: np.ndarray  # languages by rows learned from, most first


@dataclass
class Words:
    """The words of several texts, one after the other."""

    slots: np.ndarray  # trigram slot of each letter
    starts: np.ndarray  # first letter of each word
    letters: np.ndarray  # letters of each word
    script: np.ndarray  # script of each word's first letter
    text: np.ndarray  # text of each word


def split_words(texts: list[str | None]) -> Words:
    letter, lower, script = _characters()
    each = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    gap = np.zeros(1, "<u4")
    cp = np.concatenate([gap, *[x for e in each for x in (e, gap)]])
    owner = np.repeat(np.arange(len(each)), [len(e) + 1 for e in each])
    is_letter = letter[cp]
    low = np.where(is_letter, lower[cp], _SPACE)
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.empty(0, "i8")
        return Words(none, none, none, none, none)
    h = low[at - 1] * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA77) ^ low[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    starts = np.flatnonzero(~is_letter[at - 1])
    return Words((h & np.uint32(_SLOTS - 1)).astype("i4"), starts, np.diff(np.r_[starts, len(at)]), script[cp[at[starts]]], owner[at[starts] - 1])


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


# --- learning ----------------------------------------------------------------------------------------------


def _count(langs: list[str]):
    k_of = {x: k for k, x in enumerate(langs)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), _SLOTS), "i8")
        scripts = np.zeros((len(langs), len(SCRIPTS) + 1), "i8")
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                w = split_words(texts[a:b])
                label = np.array([k_of[x] for x in labels[a:b]])[w.text] if len(w.text) else w.text
                np.add.at(grams, (np.repeat(label, w.letters), w.slots), 1)
                np.add.at(scripts, (label, w.script), w.letters)
        for kind, counts in (("g", grams), ("s", scripts)):
            k, i = np.nonzero(counts)
            if len(k):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(k)), "k": pa.array(k, pa.int32()), "i": pa.array(i, pa.int32()), "n": pa.array(counts[k, i])})

    return go


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 2000, max_langs: int = 200, min_script: float = 0.01) -> Model:
    """Fit on about ``rows_per_lang`` rows of each language, chosen by a hash of the text (all, if there are fewer).

    Rows with a null text or label are not learned from.  More labels than ``max_langs`` are an error: a model's
    size is what is fetched and sent, sums of trigrams and scripts (languages x slots), added up in Spark.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages to learn")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((_SLOTS, 0), "f4"), np.zeros((len(SCRIPTS) + 1, 0), bool), np.zeros(0, int))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / sizes[k])))])
    sample = rows.filter(F.col("l").isin(langs)).filter(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) < share[F.col("l")] * 1_000_003)
    grams = np.zeros((_SLOTS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
    summed = sample.mapInArrow(_count(langs), "kind string, k int, i int, n long").groupBy("kind", "k", "i").agg(F.sum("n").alias("n")).toArrow()
    kind, k, i, n = (summed.column(c).to_numpy() for c in ("kind", "k", "i", "n"))
    g = kind == "g"
    grams[i[g], k[g]] = n[g]
    scripts[i[~g], k[~g]] = n[~g]
    table = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * _SLOTS)).astype("f4")
    written = scripts / np.maximum(scripts.sum(0), 1) >= min_script
    return Model(langs, table, written, np.array(sorted(range(len(langs)), key=lambda k: (-sizes[langs[k]], langs[k]))))


# --- prediction --------------------------------------------------------------------------------------------


def word_scores(w: Words, model: Model) -> np.ndarray:
    """words x languages: summed trigram log-probabilities, less the word's best; far below for other scripts.

    A word that no learned language is written in says nothing: its scores are all 0.
    """
    out = np.empty((len(w.starts), len(model.langs)), "f4")
    for a in range(0, len(w.starts), 200_000):
        b = min(a + 200_000, len(w.starts))
        lo, hi = w.starts[a], w.starts[b] if b < len(w.starts) else len(w.slots)
        out[a:b] = np.add.reduceat(model.table[w.slots[lo:hi]], w.starts[a:b] - lo, axis=0)
    can = model.scripts[w.script]
    out[~can & can.any(1, keepdims=True)] = -1e4
    out[~can.any(1)] = 0
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -1e4)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of each word of each text, all texts in step; ``scores`` are words x languages."""
    by_length = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in by_length])
    k = scores[0].shape[1] if scores else 0
    offset = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate([scores[i] for i in by_length]) if len(scores) else np.empty((0, k))
    back = np.empty((len(flat), k), "i2")
    value = np.zeros((len(scores), k))
    alive = len(scores)
    own = np.arange(k)
    for t in range(sizes[0] if len(sizes) else 0):
        while alive and sizes[alive - 1] <= t:
            alive -= 1
        v = value[:alive]
        best = v.argmax(1)
        jump = v[np.arange(alive), best] - penalty
        moved = jump[:, None] > v
        at = offset[:alive] + t
        back[at] = np.where(moved, best[:, None], own)
        value[:alive] = np.where(moved, jump[:, None], v) + flat[at]
    out: list[np.ndarray] = [np.empty(0, "i2")] * len(scores)
    labels = np.empty(len(flat), "i2")
    state = value.argmax(1) if len(scores) else np.empty(0, int)
    alive = 0
    for t in range((sizes[0] if len(sizes) else 0) - 1, -1, -1):
        while alive < len(sizes) and sizes[alive] > t:
            alive += 1
        at = offset[:alive] + t
        labels[at] = state[:alive]
        state[:alive] = back[at, state[:alive]]
    for r, i in enumerate(by_length):
        out[i] = labels[offset[r] : offset[r + 1]]
    return out


def label_words(w: Words, n_texts: int, model: Model, penalty: float) -> np.ndarray:
    """Viterbi label of each word.

    A text in which no stretch of words prefers another language to the text's best by more than half a
    penalty has that one label throughout (the best path changes nowhere), so only the others are traced.
    """
    scores = word_scores(w, model).astype("f8")
    bounds = np.searchsorted(w.text, np.arange(n_texts + 1))
    held = np.flatnonzero(np.diff(bounds) > 0)
    labels = np.empty(len(scores), "i2")
    if not len(held):
        return labels
    firsts = bounds[held]
    best = np.add.reduceat(scores, firsts, axis=0).argmax(1)
    rank = np.repeat(np.arange(len(held)), np.diff(np.r_[firsts, len(scores)]))
    gain = scores - scores[np.arange(len(scores)), best[rank]][:, None]
    run = np.cumsum(gain, axis=0)
    before = run - gain
    apart = np.abs(run).max() * 2 + 1  # sets each text's sums below all earlier ones, so that minima start anew
    low = np.minimum.accumulate(before - rank[:, None] * apart, axis=0) + rank[:, None] * apart
    rise = np.maximum.reduceat((run - low).max(1), firsts)
    labels[:] = best[rank]
    unsure = np.flatnonzero(rise > penalty / 2 - 1e-6)
    spans = [(bounds[held[i]], bounds[held[i] + 1]) for i in unsure]
    for (a, b), got in zip(spans, viterbi([scores[a:b] for a, b in spans], penalty) if spans else [], strict=True):
        labels[a:b] = got
    return labels


def _predict(sent, penalty: float, text_at: int, keep_text: bool, names: list[str]):
    """``sent``: the model as a broadcast variable (slots x at most ``max_langs`` floats)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.langs)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            lang: list[str] = []
            score: list[float] = []
            spans: list[int] = []
            for a, b in _slices(texts):
                w = split_words(texts[a:b])
                n = b - a
                held = np.zeros((n, max(k, 1)))
                changes = np.zeros(n, int)
                if len(w.starts) and k:
                    labels = label_words(w, n, model, penalty)
                    known = model.scripts[w.script].any(1)
                    np.add.at(held, (w.text[known], labels[known]), w.letters[known])
                    changes = np.bincount(w.text, np.r_[True, (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])], n).astype(int)
                letters = np.bincount(w.text, w.letters, n) if len(w.text) else np.zeros(n)
                first = model.order[held[:, model.order].argmax(1)] if k else np.zeros(n, int)
                for i in range(n):
                    some = bool(letters[i]) and k > 0
                    lang.append(model.langs[first[i]] if some else UNDETERMINED)
                    score.append(float(held[i, first[i]] / letters[i]) if some else 0.0)
                    spans.append(int(changes[i]))
            cols = [batch.column(i) for i in range(batch.num_columns) if keep_text or i != text_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], names=names)

    return go


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", penalty: float = 25.0, names: tuple[str, str, str] = ("lang_pred", "score", "n_spans")) -> DataFrame:
    """(*keep, lang_pred, score, n_spans) per row; ``names`` gives the three new columns other names.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  Letters of scripts
    that no learned language uses count against the score; a text of only such letters gets the most frequent
    learned language with score 0.  Ties go to the language learned from more rows.
    """
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = rows.columns.index(text_col)
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(sent, penalty, at, text_col in keep, schema.names), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", rows_per_lang: int = 2000) -> DataFrame:
    """(id, held_out, lang_pred, score, n_spans) for every row; learns from rows that are not held out."""
    model = learn(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), rows_per_lang=rows_per_lang)
    return predict(docs.select(id_col, "text", held_out(id_col).alias("held_out")), model, [id_col, "held_out"])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", least: float = 0.3) -> DataFrame:
    """``docs`` without rows that have no language: no letter, or none that holds at least ``least`` of the letters.

    Where no row has a label to learn from, only texts without letters go.
    """
    model = learn(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()))
    names = tuple(unused(docs, n) for n in ("lang_pred", "score", "n_spans"))
    if not model.langs:  # nothing to tell languages by
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    marked = predict(docs, model, docs.columns, names=names)
    return marked.filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).drop(*names)
