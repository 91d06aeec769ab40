"""Fill-in-middle transformation over run-length class encodings.

A text is stored as its maximal runs of one character class, with the number of units that end in the runs so far. A cut after so many units is
found by binary search of the run that holds it, and its offset is arithmetic: start of the run, plus units into the run times the run's step.

| unit | classes | units of a run | step |
|-|-|-|-|
| line | line feeds; others | its line feeds; 1 if it ends the text, else 0 | 1; its length |
| word | blanks; others | 1 (a word goes with the blanks after it); 1 if it ends the text, else 0 | its length |
| char | UTF-8 lengths 1 to 4 | its characters | bytes of a character |

Two cuts give prefix, middle and suffix; order and whether a text is changed at all come from a hash of seed and doc_id, so every row is
decided by itself: no shuffle, no state, the same result in every run. Cuts and form use the first four 8-digit groups of the sha256.

Null text: as the empty one, form plain, output empty. Empty text, or one that holds a sentinel: plain. Null doc_id: hashed as the empty
string. Repeated rows: the same result each. Extra columns, whatever their names, are not read. A long document is a slice of its own; its task
holds it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import _text as X
from factloom.llm._spark import text_batches

UNITS = ("line", "word", "char")


@dataclass(frozen=True)
class Setting:
    """Unit of the cuts; percent of texts changed (rate) and of these in suffix-prefix-middle order (spm); sentinels before prefix, suffix, middle."""

    unit: str = "line"
    seed: str = "7"
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.marks
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("sentinels are not empty and differ")
        if any(a in b for a in marks for b in marks if a != b):
            raise ValueError("no sentinel may hold another one")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no sentinel may end as another one begins: outputs could not be taken apart")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Runs:
    """Runs of a slice of texts: start, step, and units up to and with each run (over the whole slice)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        if unit == "char":
            at = np.flatnonzero((data & 0xC0) != 0x80)
            width = np.diff(np.append(at, len(data)))
            kind = width
        else:
            at = np.arange(len(data))
            kind = data == 10 if unit == "line" else ~X.BLANK_WORD[data]
        new = np.ones(len(at), dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        new[np.searchsorted(at, starts)] = True
        first = np.flatnonzero(new)
        self.start = at[first]
        size = np.diff(np.append(self.start, len(data)))
        ends_text = np.isin(self.start + size, offsets[1:], assume_unique=False)
        if unit == "char":
            self.step = kind[first]
            units = size // np.maximum(self.step, 1)
        elif unit == "line":
            self.step = np.where(kind[first], 1, size)
            units = np.where(kind[first], size, ends_text)
        else:
            self.step = size
            units = kind[first] | ends_text
        self.through = np.cumsum(units, dtype=np.int64)
        #: units before each text, and in all
        before = np.append(0, self.through)[np.searchsorted(self.start, offsets)]
        self.before, self.n = before[:-1], np.diff(before)
        self.offsets = offsets

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Byte offset after so many units of each text."""
        if not len(self.through):
            return self.offsets[:-1].copy()
        goal = self.before + units
        run = np.minimum(np.searchsorted(self.through, goal), len(self.through) - 1)
        inside = goal - np.where(run > 0, self.through[run - 1], 0)
        return np.where(units > 0, self.start[run] + inside * self.step[run], self.offsets[:-1])


def _transformed(s: Setting):
    """doc_id, text, h1 to h4 -> doc_id, n, form, prefix_chars, middle_chars, output."""
    pre, suf, mid = (m.encode() for m in s.marks)

    def run(batches):
        for b in batches:
            h = [b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            for at, to, data, offsets in X.slices(b, "text"):
                runs = Runs(data, offsets, s.unit)
                n, (h1, h2, h3, h4) = runs.n, (x[at:to] for x in h)
                one, two = h1 % (n + 1), h2 % (n + 1)
                lo, hi = runs.cut(np.minimum(one, two)), runs.cut(np.maximum(one, two))
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
                raw = data.tobytes()
                output, form = [], []
                for k in range(to - at):
                    x, p, q, y = int(offsets[k]), int(lo[k]), int(hi[k]), int(offsets[k + 1])
                    text = raw[x:y]
                    if not text or h3[k] % 100 >= s.rate or pre in text or suf in text or mid in text:
                        form.append("plain")
                        output.append(text)
                    elif h4[k] % 100 < s.spm:
                        form.append("spm")
                        output.append(b"".join((suf, raw[q:y], pre, raw[x:p], mid, raw[p:q])))
                    else:
                        form.append("psm")
                        output.append(b"".join((pre, raw[x:p], suf, raw[q:y], mid, raw[p:q])))
                plain = np.array([f == "plain" for f in form], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(form, pa.string()), pa.array(chars[lo] - chars[offsets[:-1]], pa.int64(), mask=plain),
                        pa.array(chars[hi] - chars[lo], pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return X.tidy(run)


def fill_middle(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output (the transformed text)."""
    s = setting
    text_batches(docs.sparkSession)
    name = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), name.alias("h"))
    seeds = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", *seeds).mapInArrow(_transformed(s), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, setting: Setting = Setting()) -> Column:
    """The text that an output was made of."""
    first, second = F.when(form == "spm", setting.suffix).otherwise(setting.prefix), F.when(form == "spm", setting.prefix).otherwise(setting.suffix)
    one, two = F.instr(output, second), F.instr(output, F.lit(setting.middle))
    a = F.substring(output, F.length(first) + 1, one - F.length(first) - 1)
    b = F.substring(output, one + F.length(second), two - one - F.length(second))
    middle = F.substring(output, two + len(setting.middle), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))
