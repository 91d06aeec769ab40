"""License scan by diagonal voting.

The hashes of all rolling k-word grams of the texts meet the grams of the templates. A hit votes for the diagonal
word number - template place; a phrase stands where all its grams vote for one diagonal. Neighbouring diagonals (a few words put in or
left out) merge to one span, and a span that has enough votes is verified on its words: the share of
the template's words that stand in order within it. Of overlapping spans with different labels the best stays.

Base phrases must stand word by word; other templates need `least` of their words. Templates are a bounded parameter, so their table is
broadcast. Grams in no template are left out before the join, which changes no vote. Votes count template places once, so
repeated rows get the same result each. Null or empty texts have no words, no places, no labels and score 0.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import Scratch, small_enough, text_batches

#: label, phrase: places where the words stand consecutively.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Wording of widely used public license notices.
NOTICES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl", "boost software license version 1 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("epl-2", "eclipse public license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


# Whole texts of short public licenses and of a file notice, as published.
BODIES = (
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and
        must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
)


def words_of(text: str) -> list[str]:
    """The words of a template, as the texts' words are taken."""
    low = X.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = X.words(low, np.array([0, len(low)]), X.ALNUM_WORD)
    return [low[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]


@dataclass(frozen=True)
class Setting:
    """k words a gram; diagonals up to `near` apart merge; least share of votes for a span and of words to verify it."""

    k: int = 3
    near: int = 4
    votes: float = 0.4
    least: float = 0.8
    base: tuple[tuple[str, str], ...] = BASE
    notices: tuple[tuple[str, str], ...] = NOTICES + BODIES

    @property
    def templates(self) -> list[tuple[str, list[str], bool]]:
        """(label, words, whether base)."""
        out = [(a, b.split(), True) for a, b in self.base] + [(a, words_of(b), False) for a, b in self.notices]
        if any(len(w) < self.k for _, w, _ in out):
            raise ValueError(f"templates need {self.k} words at least")
        return out


def template_grams(s: Setting) -> list[tuple[int, int, int]]:
    """(template, place, gram)."""
    out = []
    for t, (_, words, _) in enumerate(s.templates):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        hashes, _ = X.word_hashes(data, np.array([0, len(data)]), X.ALNUM_WORD)
        out += [(t, i, int(g)) for i, g in enumerate(X.grams(hashes, s.k).view(np.int64))]
    return out


def _hits(s: Setting, known: np.ndarray):
    """key, text -> key, n_words, hits (word number, gram) of grams that some template has."""

    def run(batches):
        for b in batches:
            for at, to, data, offsets in X.slices(b, "text"):
                hashes, first = X.word_hashes(data, offsets, X.ALNUM_WORD)
                g = X.grams(hashes, s.k)
                where = np.searchsorted(known, g)
                where[where == len(known)] = 0
                hit = np.flatnonzero(known[where] == g)
                doc = np.searchsorted(first, hit, "right") - 1
                inside = hit + s.k <= first[doc + 1]
                hit, doc = hit[inside], doc[inside]
                cut = np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array((hit - first[doc]).astype(np.int32)), pa.array(g[hit].view(np.int64))], ["pos", "gram"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), b.column("key").slice(at, to - at), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), items)], ["doc_id", "key", "n_words", "hits"]
                )

    return run


def _windows(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """A span as it is, or a longer one (many notices in a row) as windows that overlap by half, so each template stands whole in one."""
    if hi - lo <= size:
        return [(lo, hi)]
    return [(at, min(hi, at + size)) for at in range(lo, hi - size // 2, size // 2)]


def _checked(s: Setting):
    """key, text, spans -> key, label, template, first, last, score of the spans that hold their template."""
    templates = s.templates

    def run(batches):
        for b in batches:
            out = []
            for key, text, spans in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                low = X.LOWER[raw]
                start, end, _ = X.words(low, np.array([0, len(low)]), X.ALNUM_WORD)
                good = []
                for span in spans:
                    label, words, _ = templates[span["t"]]
                    match = difflib.SequenceMatcher(None, [], words, autojunk=False)
                    for lo, hi in _windows(max(0, span["lo"] - s.near), min(len(start), span["hi"] + s.near + 1), 2 * (len(words) + s.near)):
                        match.set_seq1([low[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(start[lo:hi], end[lo:hi], strict=True)])
                        blocks = [m for m in match.get_matching_blocks() if m.size]
                        score = sum(m.size for m in blocks) / len(words)
                        if score >= s.least:
                            good.append((-score, -len(words), label, lo + blocks[0].a, lo + blocks[-1].a + blocks[-1].size - 1))
                taken: list[tuple] = []
                for span in sorted(good):
                    # similar templates match the same words: the best one names them
                    if all(span[2] == x[2] or span[4] < x[3] or x[4] < span[3] for x in taken):
                        taken.append(span)
                out += [(key, label, first, last, -score) for score, _, label, first, last in taken]
            if out:
                k, n, lo, hi, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(score, pa.float64())], ["key", "label", "first", "last", "score"])

    return run


def license_scan(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first, last, score)."""
    s, spark = setting, docs.sparkSession
    scratch = Scratch(spark)
    text_batches(spark)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    grams = template_grams(s)
    table = spark.createDataFrame(grams, "t int, place int, gram long")
    known = np.unique(np.array([g for _, _, g in grams], np.int64).view(np.uint64))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = scratch.store(rows.mapInArrow(_hits(s, known), f"doc_id {kind}, key long, n_words long, hits array<struct<pos:int,gram:long>>"))

    facts = [(t, label, len(w), len(w) - s.k + 1, base) for t, (label, w, base) in enumerate(s.templates)]
    facts = F.broadcast(spark.createDataFrame(facts, "t int, label string, n int, full int, base boolean"))
    votes = seen.select("key", F.inline("hits")).join(F.broadcast(table), "gram")
    diagonal = votes.groupBy("key", "t", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("pos").alias("lo"), (F.max("pos") + s.k - 1).alias("hi")
    )
    diagonal = scratch.store(diagonal.join(facts, "t"))
    base = diagonal.where(F.col("base") & (F.size("places") == F.col("full"))).select("key", "label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n") - 1).alias("last"), F.lit(1.0).alias("score"), F.lit(True).alias("base"))

    by = Window.partitionBy("key", "t").orderBy("diagonal")
    merged = diagonal.where("not base").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= s.near, 0).otherwise(1))
    merged = merged.withColumn("run", F.sum("new").over(by)).groupBy("key", "t", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("full").alias("full")
    )
    spans = merged.where(F.col("votes") >= F.greatest(F.lit(1.0), F.col("full") * s.votes))
    spans = scratch.store(spans.groupBy("key").agg(F.collect_list(F.struct("t", "lo", "hi")).alias("spans")))
    side = F.broadcast(spans) if small_enough(spans, 200_000) else spans.hint("shuffle_hash")
    checked = rows.join(side, "key").select("key", "text", "spans").mapInArrow(_checked(s), "key long, label string, first int, last int, score double").distinct()
    places = base.union(checked.select("key", "label", "first", "last", "score", F.lit(False).alias("base")))
    item = F.struct("label", "first", "last", "score")
    found = places.groupBy("key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.array_sort(F.collect_set(item)).alias("spans"),
    )
    return seen.select("doc_id", "key", "n_words").join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
