"""Sinks: whole outputs, appends by name, write-once outputs, manifests, previous versions, size-capped parts, schema edits."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.relational import keyed_diff


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only where it is unset and the master local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined() and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors on other machines need a shared folder")
        folder = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="files-")
    return folder.rstrip("/")


def write_whole(df: DataFrame, path: str, kind: str = "parquet", replace: bool = True, most_rows: int | None = None) -> None:
    """All rows in a folder of their own, which then takes the output's name: a write that fails leaves the old output. SNK-01, SNK-08, SRC-03.

    The old output moves aside first and is deleted last, so there is one at any time, under its name or beside it (name.old-...).
    """
    spark = df.sparkSession
    if not replace and exists(spark, path):
        raise FileExistsError(path)
    new = _written_beside(df, path, kind, most_rows)
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    had = move(spark, path, old)
    if not move(spark, new, path):
        if had:
            move(spark, old, path)
        raise OSError(f"{new} could not take the name {path}")  # the new rows are whole: they stay
    delete(spark, old)


def _written_beside(df: DataFrame, path: str, kind: str, most_rows: int | None) -> str:
    """The folder with all rows, beside the output; nothing is left of a write that fails."""
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if most_rows:
        writer = writer.option("maxRecordsPerFile", most_rows)
    try:
        writer.save(new)
    except Exception:
        delete(df.sparkSession, new)
        raise
    return new


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename what stands under a name, if anything does."""
    fs, source = _file_system(spark, old)
    return bool(fs.exists(source) and fs.rename(source, spark._jvm.org.apache.hadoop.fs.Path(new)))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted; none if there is no folder."""
    fs, p = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


class Run:
    """Outputs of a run that change together or not at all. SNK-05.

        with Run(spark, journal) as run:
            run.write(first, path)
            run.write(second, other)

    Before an output changes, the journal (a folder on the outputs' file system) notes it, and its old rows move there. An error in the block puts
    all of them back; so does the next run with this journal, if the process died. Giving the journal another name is the moment that the
    outputs count as written.
    """

    def __init__(self, spark: SparkSession, journal: str):
        self.spark, self.journal, self.n = spark, journal.rstrip("/"), 0

    def __enter__(self) -> Run:
        roll_back(self.spark, self.journal)
        return self

    def write(self, df: DataFrame, path: str, kind: str = "parquet", most_rows: int | None = None) -> None:
        """One output; it can be read, but is not settled before the block ends."""
        new = _written_beside(df, path, kind, most_rows)
        self.n += 1
        note = {"path": path, "existed": exists(self.spark, path)}
        fs, p = _file_system(self.spark, f"{self.journal}/{self.n:06d}.part")
        out = fs.create(p)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        move(self.spark, f"{self.journal}/{self.n:06d}.part", f"{self.journal}/{self.n:06d}.json")
        if note["existed"] and not move(self.spark, path, f"{self.journal}/{self.n:06d}.old") or not move(self.spark, new, path):
            raise OSError(f"{path} could not be replaced")

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            roll_back(self.spark, self.journal)
        elif self.n:
            done = f"{self.journal}.done-{uuid.uuid4().hex}"
            if not move(self.spark, self.journal, done):
                raise OSError(f"{self.journal} could not be closed")
            delete(self.spark, done)


def roll_back(spark: SparkSession, journal: str) -> list[str]:
    """The outputs that a journal put back as they were before the run. SNK-05.

    Steps that were done before stay done, so an interrupted roll back can be started again.
    """
    back = []
    for name in reversed([x for x in names_in(spark, journal) if x.endswith(".json")]):
        fs, p = _file_system(spark, f"{journal}/{name}")
        stream = fs.open(p)
        note = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        old = f"{journal}/{name.removesuffix('.json')}.old"
        if exists(spark, old):
            delete(spark, note["path"])
            move(spark, old, note["path"])
        elif not note["existed"]:
            delete(spark, note["path"])
        back.append(note["path"])
    delete(spark, journal)
    return back


def append_by_name(df: DataFrame, path: str) -> None:
    """Rows under the output's own columns, matched by name; others are refused. SNK-02."""
    have = df.sparkSession.read.parquet(path)
    if extra := set(df.columns) - set(have.columns):
        raise ValueError(f"no such columns in the output: {sorted(extra)}")
    empty = have.limit(0)
    empty.unionByName(df, allowMissingColumns=True).select(*(F.col(f.name).cast(f.dataType) for f in have.schema)).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def write_once(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """The output as it is kept; a first write makes it, a later one only reports what differs (key, change). SNK-04."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
    return keyed_diff(spark.read.parquet(path), df, key)


def manifest(spark: SparkSession, run_id: str, inputs: Mapping[str, str], outputs: Mapping[str, str], settings: Mapping[str, object], headline: str) -> DataFrame:
    """One row a file of a run, with size and sha256 of its content. SNK-05, SRC-23."""
    parts = []
    for role, files in (("input", inputs), ("output", outputs)):
        for name, path in files.items():
            f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            parts.append(f.select(F.lit(role).alias("role"), F.lit(name).alias("name"), "path", "length", F.sha2("content", 256).alias("sha256")))
    if not parts:
        raise ValueError("a run has inputs or outputs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    facts = F.to_json(F.create_map(*[x for k, v in sorted(settings.items()) for x in (F.lit(k), F.lit(str(v)))])) if settings else F.lit("{}")
    return out.select(F.lit(run_id).alias("run_id"), "*", facts.alias("settings"), F.lit(headline).alias("headline"))


def keep_versions(spark: SparkSession, path: str, store: str) -> None:
    """The bytes of an output's files, kept in a table by hash (sha256, content) unless it has them. SNK-06."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if exists(spark, store):
        files = files.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    files.write.mode("append").parquet(store)


def superseded(catalog: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier versions worth keeping: content that the current outputs no longer have. SNK-06. Both: file, path, sha256."""
    return catalog.join(current.select("file", "sha256"), ["file", "sha256"], "left_anti").dropDuplicates(["file", "sha256"])


def rename_entries(table: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """A schema edit applied to a dependent table: old names become new ones in the given columns. SNK-10. renames: old, new."""
    out = table
    for c in columns:
        out = out.join(F.broadcast(renames.select(F.col("old").alias(c), F.col("new").alias("_new"))) if renames.count() <= 100_000 else renames.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left")
        out = out.withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*table.columns)


def unmark(entries: DataFrame, edits: DataFrame, marks: str = "marks") -> DataFrame:
    """entries (name, marks array<string>) less the marks that edits (name, mark) take away; an edit that takes away nothing stops all of them. SNK-10."""
    gone = edits.groupBy("name").agg(F.collect_set("mark").alias("_gone"))
    both = entries.join(gone, "name", "full_outer")
    idle = F.array_except("_gone", F.coalesce(marks, F.array()))
    stop = F.raise_error(F.concat_ws(" ", F.lit("no such mark:"), "name", F.element_at(idle, 1))).cast("array<string>")
    left = F.when(F.size(idle) > 0, stop).otherwise(F.array_except(F.col(marks), F.coalesce("_gone", F.array())))
    return both.select("name", *(left.alias(marks) if c == marks else F.col(c) for c in entries.columns if c != "name"))


def edit_plan(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """The entries after a whole plan of edits; any edit that cannot be made stops all of them. SNK-10.

    edits: op (add, rename, redefine, remove), name, value.
    """
    known = entries.select("name").withColumn("_k", F.lit(1))
    checked = edits.join(known, "name", "left").withColumn("bad", F.when(F.col("op") == "add", F.col("_k").isNotNull()).otherwise(F.col("_k").isNull()))
    bad = [r.name for r in checked.where("bad").select("name").limit(10).collect()]
    if bad:
        raise ValueError(f"the plan cannot be carried out for: {bad}")
    one = edits.groupBy("name").agg(F.max_by("value", F.col("op") == "rename").alias("_v"), *(F.max(F.when(F.col("op") == op, F.col("value"))).alias(f"_{op}") for op in ("rename", "redefine")), F.max(F.col("op") == "remove").alias("_gone"))
    out = entries.join(one, "name", "left").where("not coalesce(_gone, false)")
    out = out.select(F.coalesce("_rename", "name").alias("name"), F.coalesce("_redefine", "definition").alias("definition"))
    return out.unionByName(edits.where("op = 'add'").select("name", F.col("value").alias("definition")))
