"""Discard ledger: every dropped, folded or replaced item is a row, and nothing is lost between stages. OPS-01, OPS-02, OPS-14."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import markup as M

ENTRY = ("stage", "action", "item_type", "reason", "setting", "record_id", "item", "kept_as", "place")


def discards(df: DataFrame, stage: str, item_type: str, reason: Column, item: Column, record_id: Column | None = None, action: str = "dropped", setting: Column | None = None, kept_as: Column | None = None, place: Column | None = None) -> DataFrame:
    """Ledger rows of the rows of df that have a reason."""
    none = F.lit(None).cast("string")
    values = (F.lit(stage), F.lit(action), F.lit(item_type), reason, setting, record_id, item, kept_as, place)
    return df.where(reason.isNotNull()).select(*((none if v is None else v.cast("string")).alias(n) for n, v in zip(ENTRY, values, strict=True)))


def split_by_reason(df: DataFrame, reason: Column, stage: str, item_type: str, record_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, ledger rows): a row goes if it has a reason. FLT-05."""
    item = F.to_json(F.struct(*df.columns))
    return df.where(reason.isNull()), discards(df, stage, item_type, reason, item, F.col(record_id))


def balance(came: DataFrame, kept: DataFrame, ledger: DataFrame) -> DataFrame:
    """came, kept, discarded, balanced."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(came, "came").crossJoin(F.broadcast(n(kept, "kept"))).crossJoin(F.broadcast(n(ledger.where("action = 'dropped'"), "discarded")))  # one row each
    return out.withColumn("balanced", F.col("came") == F.col("kept") + F.col("discarded"))


def require_balance(came: DataFrame, kept: DataFrame, ledger: DataFrame) -> None:
    row = balance(came, kept, ledger).first()
    if not row.balanced:
        raise ValueError(f"{row.came} came, {row.kept} kept, {row.discarded} discarded")


def fuzz_cleaning(rounds: int = 200, seed: int = 0) -> list[str]:
    """Random markup that the cleaner loses something of: none, if all is well. OPS-14."""
    rng = random.Random(seed)
    bits = ["word", "x<sub>2</sub>", "<p>", "</p>", "<b>be</b>", "&amp;rsquo;", " ", "\n", '<a href="http://e.org/a">t</a>', "<li>one</li>", "<td>c</td>", "a < b", "<z>", "<script>s</script>", "&lt;i&gt;q&lt;/i&gt;", "<br>", "9.5", "<img src='u.png'>", "<p", "&"]
    bad = []
    for _ in range(rounds):
        raw = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        c = M.clean(raw)
        if c.tier != "source" and M.missing_tokens(raw, c.text):
            bad.append(raw)
    return bad
