"""A language model as a lookup source: one prompt a piece, replies as a column, answers kept by content. SRC-26, SNK-09, OPS-03, OPS-06.

`ask` is any function from a prompt to a reply. The stand-in reads facts by patterns, so pipelines and tests run without a service.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.sources.sinks import move, names_in, shared_folder

Ask = Callable[[str], str]


def answer_key(*parts: Column | str) -> Column:
    """The content key of a question: prompt, model and settings."""
    return F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def pattern_extractor(prompt: str) -> str:
    """The stand-in: 'X is aboard Y', 'X is part of Y' as facts."""
    facts = [
        {"subject": m[1], "predicate": {"aboard": "ABOARD", "part of": "PART_OF"}[m[2]], "object": m[3], "source_text": m[0]}
        for m in re.finditer(r"([A-Z][\w-]*) is (aboard|part of) ([A-Z][\w-]*)", prompt)
    ]
    return json.dumps({"triples": facts})


def ask_all(prompts: DataFrame, ask: Ask, parallel: int = 8, most_failures: int = 5) -> DataFrame:
    """key, reply, error of prompts (key, prompt); a task asks a few at once and stops after so many failures in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return ask(prompt), None
            except Exception as e:  # what went wrong is a row of the result
                return None, str(e)[:500]

        with ThreadPoolExecutor(parallel) as pool:
            for pdf in frames:
                got = []
                for at in range(0, len(pdf), parallel):
                    part = list(pool.map(one, pdf["prompt"][at : at + parallel]))
                    for _, error in part:
                        failed = failed + 1 if error else 0
                    got += part
                    if failed >= most_failures:
                        raise RuntimeError(f"{failed} failures in a row, the last: {got[-1][1]}")
                yield pd.DataFrame({"key": pdf["key"], "reply": [r for r, _ in got], "error": [e for _, e in got]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, reply string, error string")


def with_cache(prompts: DataFrame, cache: DataFrame, ask: Ask, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers to all prompts, new answers for the cache): only what the cache lacks is asked, once for each key.

    New answers are written to a folder before anything reads them, so both results, however often they are computed, hold what the one call
    said. A task that is tried again asks its prompts again.
    """
    spark = prompts.sparkSession
    missing = prompts.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    path = folder or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    ask_all(missing, ask).where("error is null").select("key", "reply").write.parquet(path)
    new = spark.read.schema("key string, reply string").parquet(path)
    return prompts.join(cache.select("key", "reply").unionByName(new), "key", "left"), new


def answered(prompts: DataFrame, store: str, ask: Ask) -> DataFrame:
    """Answers to all prompts, kept in a store (a folder) that later runs ask first. SNK-09.

    Each call of the function adds one folder, which gets its name when its answers are whole.
    """
    spark = prompts.sparkSession
    kept = [f"{store}/{n}" for n in names_in(spark, store) if n.startswith("answers-")]
    empty = spark.createDataFrame([], "key string, reply string")
    cache = spark.read.schema("key string, reply string").parquet(*kept).dropDuplicates(["key"]) if kept else empty
    name = uuid.uuid4().hex
    with_cache(prompts, cache, ask, f"{store}/.new-{name}")
    move(spark, f"{store}/.new-{name}", f"{store}/answers-{name}")
    new = spark.read.schema("key string, reply string").parquet(f"{store}/answers-{name}")
    return prompts.join(cache.unionByName(new), "key", "left")


_TRIPLE = "array<struct<subject:string,predicate:string,object:string,source_text:string,problem:string>>"


def rows_of_replies(answers: DataFrame) -> DataFrame:
    """answers with one row a fact and its `problem`, null if it may stay. answers: text, reply."""

    def parse(replies: pd.Series, texts: pd.Series) -> pd.Series:
        from factloom.functions.keys import Lookup, passages

        out = []
        for reply, text in zip(replies, texts, strict=True):
            state, value = X.find_json(reply)
            rows = value.get("triples") if state == "object" and isinstance(value, dict) else None
            held, found = Lookup(text), []
            if not isinstance(rows, list):
                found.append(dict.fromkeys(("subject", "predicate", "object", "source_text")) | {"problem": f"reply {X.classify_reply(reply)}"})
                rows = []
            for r in rows:
                slots = {k: X.slot(r.get(k), text or "") if isinstance(r, dict) else None for k in ("subject", "predicate", "object", "source_text")}
                parts = passages(slots["source_text"])
                missing = any(slots[k] is None for k in ("subject", "predicate", "object"))
                why = "malformed" if missing else "no source text" if not parts else "source not in text" if not all(map(held.contains, parts)) else None
                found.append(slots | {"problem": why})
            out.append(found)
        return pd.Series(out)

    from pyspark.sql.types import _parse_datatype_string

    parse.__annotations__ = {"replies": pd.Series, "texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(parse, _parse_datatype_string(_TRIPLE))
    rest = [c for c in answers.columns if c != "reply"]
    return answers.withColumn("_t", udf("reply", "text")).select(*rest, F.explode("_t").alias("_f")).select(*rest, "_f.*")
