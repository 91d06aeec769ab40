"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters; its script (UTF-8 lead bytes of the first letter) narrows the candidates to languages seen
with that script. A word scores by the learned frequencies of its byte trigrams, its ends included. Viterbi labels every word,
paying `penalty` for each change of language; consecutive equal labels are spans. The prediction is the language of most words.

The exact path is computed word by word only where a change can pay off: if no stretch of words prefers other languages by more
than the penalty, the best single language is the best path.

Learning uses only texts with a language, at most about `most_docs` of them (chosen by hash of the id), and every word of these. Trigrams
share 2^17 cells a language by hash, so the model has one size whatever was seen. Nothing but the text enters a prediction.

Null texts and texts without a letter are `und` with score 0. Without labelled texts that have letters everything is `und`.
Every row is predicted by itself, so repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import text_batches

U64 = np.uint64
CELLS = 1 << 17

#: ASCII letters and all bytes of longer characters.
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = True
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True

# Scripts by UTF-8 lead byte of a word's first character.
SCRIPTS = ("other", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul")
LEADS = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD6, 0xD7],
    "arabic": [0xD8, 0xD9, 0xDA, 0xDB],
    "indic": [0xE0],
    "kana": [0xE3],
    "han": [0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9],
    "hangul": [0xEA, 0xEB, 0xEC, 0xED],
}
SCRIPT_OF = np.zeros(256, dtype=np.int64)
for _name, _leads in LEADS.items():
    SCRIPT_OF[_leads] = SCRIPTS.index(_name)


@dataclass(frozen=True)
class Setting:
    """penalty of a change of language; lowest score of a language for a word against the best one.

    script_share: the least share of a language's words in a script that makes it a candidate there; most_docs: labelled texts to learn from.
    """

    penalty: float = 12.0
    floor: float = -8.0
    script_share: float = 0.001
    most_docs: int = 20_000


class Words:
    """Words of a slice: scripts, trigram cells of all letters, and where each word and text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = X.LOWER[data]
        # capitals of Latin-1 letters, as two bytes
        second = np.zeros(len(low), bool)
        second[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low = np.where(second, low + 0x20, low).astype(np.uint8)
        start, end, self.first = X.words(low, offsets, LETTER)
        self.script = SCRIPT_OF[low[start]] if len(start) else np.zeros(0, np.int64)
        inside = np.zeros(len(low) + 1, np.int32)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        inside = np.cumsum(inside[:-1]) > 0
        at = np.flatnonzero(inside)
        z = np.full(len(low) + 2, 0x20, np.int64)
        z[1:-1] = low
        before, after = z[at], z[at + 2]
        self.begin = np.searchsorted(at, start)
        before[self.begin] = 0x20
        after[np.searchsorted(at, end - 1)] = 0x20
        code = (before << 16 | z[at + 1] << 8 | after).astype(U64)
        self.cells = ((code * U64(0x9E3779B97F4A7C15)) >> U64(47)).astype(np.int64)


def _learn(batches):
    """lang, text -> counts: kind 0 trigram cell, 1 script."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        for at, to, data, offsets in X.slices(b, "text"):
            w = Words(data, offsets)
            owner = np.repeat(np.arange(at, to), np.diff(w.first))
            size = np.diff(np.append(w.begin, len(w.cells)))
            for lang in sorted(set(langs[at:to])):
                mine = langs[owner] == lang if len(owner) else np.zeros(0, bool)
                cells = w.cells[np.repeat(mine, size)] if len(size) else w.cells[:0]
                for kind, x in ((0, cells), (1, w.script[mine])):
                    v, c = np.unique(x, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(v), pa.string()), pa.array(np.full(len(v), kind, np.int32)), pa.array(v.astype(np.int64)), pa.array(c.astype(np.int64))], ["lang", "kind", "item", "n"]
                    )


class Model:
    """Score tables; predictions for slices."""

    def __init__(self, langs: list[str], cells: np.ndarray, scripts: np.ndarray, s: Setting):
        self.langs, self.cells, self.scripts, self.s = langs, cells, scripts, s

    @classmethod
    def fit(cls, docs: DataFrame, s: Setting = Setting()) -> "Model | None":
        """docs: doc_id, text, lang; only rows with both text and lang count."""
        text_batches(docs.sparkSession)
        rows = docs.where("text is not null and lang is not null")
        n = rows.count()
        if not n:
            return None
        if n > s.most_docs:
            rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * s.most_docs / n))
        counts = rows.select("lang", "text").mapInArrow(_learn, "lang string, kind int, item long, n long")
        got = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toPandas()  # CELLS and the scripts, for each language
        if got.empty:
            return None
        langs = sorted(got.lang.unique())
        at = got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
        kind, item, n = (got[c].to_numpy() for c in ("kind", "item", "n"))
        cells = np.full((CELLS, len(langs)), 0.5)
        pick = kind == 0
        cells[item[pick], at[pick]] += n[pick]
        scripts = np.zeros((len(SCRIPTS), len(langs)))
        pick = kind == 1
        scripts[item[pick], at[pick]] = n[pick]
        share = scripts / np.maximum(1, scripts.sum(0))

        def logs(x):
            y = np.log(x / x.sum(0))
            return (y - y.max(1, keepdims=True)).astype(np.float32)

        return cls(langs, logs(cells), share >= s.script_share, s)

    def scores(self, w: Words) -> np.ndarray:
        """Each word's score by language; the best candidate has 0."""
        if not len(w.begin):
            return np.zeros((0, len(self.langs)))
        y = np.add.reduceat(self.cells[w.cells], w.begin, axis=0).astype(np.float64)
        ok = self.scripts[w.script]
        ok |= ~ok.any(1)[:, None]
        y = np.where(ok, y, -np.inf)
        return np.maximum(self.s.floor, y - y.max(1, keepdims=True))

    def label(self, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language of each word: the best path of each text."""
        if not len(y):
            return np.zeros(0, np.int64)
        size = np.diff(first)
        text = np.repeat(np.arange(len(size)), size)
        total = np.zeros((len(size), y.shape[1]))
        full = np.flatnonzero(size)
        total[full] = np.add.reduceat(y, first[full], axis=0)
        best = total.argmax(1)
        out = best[text]
        if y.shape[1] == 1:
            return out
        mine = y[np.arange(len(y)), out]
        other = y.copy()
        other[np.arange(len(y)), out] = -np.inf
        gain = other.max(1) - mine
        # the best stretch of each text: running sum against its minimum so far, texts kept apart by an offset
        run = np.cumsum(gain)
        before = run - gain
        wide = (np.abs(gain).sum() + 1) * 2
        apart = text * wide
        low = np.minimum.accumulate(before - apart)
        top = np.zeros(len(size))
        top[full] = np.maximum.reduceat(run - apart - low, first[full])
        for i in np.flatnonzero(top > self.s.penalty):
            out[first[i] : first[i + 1]] = viterbi(y[first[i] : first[i + 1]], self.s.penalty)
        return out


def viterbi(y: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the best path; ties stay, then go to the smaller label."""
    n, k = y.shape
    came = np.empty((n, k), np.int16)
    v = y[0].tolist()
    every = range(k)
    for t, row in enumerate(y[1:].tolist(), 1):
        top = max(v)
        b = v.index(top)
        top -= penalty
        back = [a if v[a] >= top else b for a in every]
        v = [row[a] + (v[a] if v[a] >= top else top) for a in every]
        came[t] = back
    out = np.empty(n, np.int64)
    out[-1] = v.index(max(v))
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t][out[t]]
    return out


def _predict(model: Model | None, spans: bool):
    def run(batches):
        m = getattr(model, "value", model)
        for b in batches:
            # a text that is kept travels once
            texts = b if "text" in b.schema.names else pa.RecordBatch.from_arrays([b.column("_row").field("text")], ["text"])
            for at, to, data, offsets in X.slices(texts, "text"):
                n = to - at
                pred, score, parts = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if m is not None:
                    w = Words(data, offsets)
                    y = m.scores(w)
                    path = m.label(y, w.first)
                    ascii_letter = np.zeros(n, bool)
                    plain = np.flatnonzero(LETTER[data] & (data < 0x80))
                    ascii_letter[np.searchsorted(offsets, plain, "right") - 1] = True
                    size = np.diff(w.first)
                    k = len(m.langs)
                    text = np.repeat(np.arange(n), size)
                    votes = np.bincount(text * k + path, minlength=n * k).reshape(n, k) if len(path) else np.zeros((n, k))
                    total = np.zeros((n, k))
                    full = np.flatnonzero(size)
                    if len(full):
                        total[full] = np.add.reduceat(y, w.first[full], axis=0)
                    for i in full:
                        if not ascii_letter[i] and not any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
                            continue
                        top = votes[i].max()
                        j = max(np.flatnonzero(votes[i] == top), key=lambda c: (total[i, c], -c))
                        pred[i], score[i] = m.langs[j], top / size[i]
                        if spans:
                            p = path[w.first[i] : w.first[i + 1]]
                            cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                            parts[i] = [{"first": int(x), "last": int(z) - 1, "lang": m.langs[p[x]]} for x, z in zip(cut, np.append(cut[1:], len(p)), strict=True)]
                cols = [b.column("_row").slice(at, n), pa.array(pred, pa.string()), pa.array(score)]
                names = ["_row", "lang_pred", "score"]
                if spans:
                    cols.append(pa.array(parts, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _labelled(docs: DataFrame, model: Model | None, spans: bool, keep: tuple[str, ...]) -> DataFrame:
    """_row (struct of the kept columns), lang_pred, score and maybe spans."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("_row"))
    if "text" not in keep or docs.schema["text"].dataType.simpleString() != "string":
        rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, lang_pred string, score double" + ", spans array<struct<first:int,last:int,lang:string>>" * spans
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None  # bounded by the setting
    return rows.mapInArrow(X.tidy(_predict(shared, spans)), schema)


def language_id(docs: DataFrame, model: Model | None, spans: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score (share of the words with that label) and spans (first and last word, lang)."""
    return _labelled(docs, model, spans, keep).select("_row.*", "lang_pred", "score", *["spans"] * spans)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Documents kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The documents that have a language, with the columns of docs: all but those without a letter.

    Without labelled texts a letter alone decides.
    """
    model = Model.fit(docs.where(~held_out()).select("doc_id", "text", "lang"), setting)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _labelled(docs, model, False, tuple(docs.columns)).where("lang_pred <> 'und'").select("_row.*")
