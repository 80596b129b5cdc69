"""Reading and writing tables, line-delimited samples and the seed categories."""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category codes and names.
CATEGORIES = {
    "cs.AI": "Artificial Intelligence", "cs.AR": "Hardware Architecture", "cs.CC": "Computational Complexity",
    "cs.CE": "Computational Engineering, Finance, and Science", "cs.CG": "Computational Geometry", "cs.CL": "Computation and Language",
    "cs.CR": "Cryptography and Security", "cs.CV": "Computer Vision and Pattern Recognition", "cs.CY": "Computers and Society",
    "cs.DB": "Databases", "cs.DC": "Distributed, Parallel, and Cluster Computing", "cs.DL": "Digital Libraries",
    "cs.DM": "Discrete Mathematics", "cs.DS": "Data Structures and Algorithms", "cs.ET": "Emerging Technologies",
    "cs.FL": "Formal Languages and Automata Theory", "cs.GL": "General Literature", "cs.GR": "Graphics",
    "cs.GT": "Computer Science and Game Theory", "cs.HC": "Human-Computer Interaction", "cs.IR": "Information Retrieval",
    "cs.IT": "Information Theory", "cs.LG": "Machine Learning", "cs.LO": "Logic in Computer Science", "cs.MA": "Multiagent Systems",
    "cs.MM": "Multimedia", "cs.MS": "Mathematical Software", "cs.NA": "Numerical Analysis", "cs.NE": "Neural and Evolutionary Computing",
    "cs.NI": "Networking and Internet Architecture", "cs.OH": "Other Computer Science", "cs.OS": "Operating Systems",
    "cs.PF": "Performance", "cs.PL": "Programming Languages", "cs.RO": "Robotics", "cs.SC": "Symbolic Computation", "cs.SD": "Sound",
    "cs.SE": "Software Engineering", "cs.SI": "Social and Information Networks", "cs.SY": "Systems and Control",
    "eess.AS": "Audio and Speech Processing", "eess.IV": "Image and Video Processing", "eess.SP": "Signal Processing",
    "eess.SY": "Systems and Control", "math.ST": "Statistics Theory", "stat.ML": "Machine Learning", "stat.AP": "Applications",
    "stat.CO": "Computation",
}
SAMPLES = "id string, question string, query string, answers array<string>, answer string, sources array<string>, citations array<string>, arxiv_ids array<string>"


def seed_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "code string, display_name string")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from line-delimited JSON: qid, question, golds and gold_citations; blank lines do not count."""
    raw = spark.read.schema(SAMPLES).json(path).where("id is not null or question is not null or query is not null")
    return raw.select(
        F.col("id").alias("qid"),
        F.coalesce("question", "query").alias("question"),
        F.coalesce("answers", F.when(F.col("answer").isNotNull(), F.array("answer")), F.array().cast("array<string>")).alias("golds"),
        F.coalesce("sources", "citations", "arxiv_ids", F.array().cast("array<string>")).alias("gold_citations"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Tasks that write buckets, at most.
MOST_WRITERS = 4096


class Versions:
    """Tables that belong together, in versions under a root, for any readers and one writer at a time.

    A version is a small file that names the folders of each table. It is created, never overwritten, once all its
    tables are written: readers see whole versions only, a half-written file does not count, and of two writers that
    started from the same version the second one fails. (The file system must create files atomically, as HDFS does.)
    Tables that a write leaves out are carried over. A table is one folder, or in hash buckets of its key: then a merge
    reads and writes only the buckets that its rows fall into.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hadoop = spark, root, spark._jvm.org.apache
        self.folder = self._path()
        self.fs = self.folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.hadoop.hadoop.fs.Path("/".join((self.root, *parts)))

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def manifest(self, number: int) -> dict | None:
        """What a version holds, below the root; None where its file is not whole."""
        stream = self.fs.open(self._path(f"v={number}"))
        try:
            found = json.loads(self.hadoop.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) else None

    def latest(self) -> dict | None:
        return next((m for n in reversed(self.numbers()) if (m := self.manifest(n)) is not None), None)

    def begin(self) -> Draft:
        return Draft(self)

    def write(self, keep: int | None = None, **tables: DataFrame | Callable[[dict[str, DataFrame]], DataFrame]) -> int:
        """The number of the new version. A table may be a function of the tables written before it. With ``keep``, only so
        many versions stay: enough for readers that still hold an older one."""
        with self.begin() as draft:
            done: dict[str, DataFrame] = {}
            for name, table in tables.items():
                done[name] = draft.put(name, table(done) if callable(table) else table)
            return draft.publish(keep)

    def clean(self, keep: int) -> None:
        """Deletes older versions, and the folders that only they name."""
        numbers = self.numbers()
        named = [folders(self.manifest(n) or {}) for n in numbers]
        for n in numbers[:-keep]:
            self.fs.delete(self._path(f"v={n}"), False)
        for path in set().union(*named[:-keep]) - set().union(*named[-keep:]):
            self.fs.delete(self._path(path), True)

    def delete(self) -> None:
        """All versions and their tables."""
        self.fs.delete(self.folder, True)

    def rows(self, entry: str | dict, codes: list[int] | None = None) -> DataFrame:
        """A table of a manifest; of one in buckets, those in ``codes``."""
        if isinstance(entry, str):
            return self.spark.read.parquet(f"{self.root}/{entry}")
        if "path" in entry:
            return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['path']}")
        held = [folder for code, (folder, _) in entry["buckets"].items() if folder and (codes is None or int(code) in codes)]
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in held]) if held else self.spark.createDataFrame([], schema)

    def read(self) -> dict[str, DataFrame] | None:
        """The tables of the last whole version, or None."""
        held = self.latest()
        return None if held is None else {name: self.rows(entry) for name, entry in held.items()}


def in_buckets(entry: str | dict) -> bool:
    return isinstance(entry, dict) and "buckets" in entry


def folders(manifest: dict) -> set[str]:
    buckets = {folder for e in manifest.values() if in_buckets(e) for folder, _ in e["buckets"].values() if folder}
    return buckets | {e if isinstance(e, str) else e["path"] for e in manifest.values() if not in_buckets(e)}


def depth(code: int) -> int:
    return code.bit_length() - 1


def place(df: DataFrame, keys: list[str], codes: list[int]) -> DataFrame:
    """``df`` with ``_bucket``. Bucket codes number a binary tree (1 is its root, 2c and 2c + 1 are below c) over the leading
    bits of a key's hash; ``codes`` are leaves that cover the keys. The directory that is sent to all tasks has a row
    for each slot of the deepest level."""
    deepest = max(map(depth, codes))
    slot = F.lit(1).cast("long") if not deepest else F.shiftrightunsigned(F.xxhash64(*keys), 64 - deepest) + F.lit(1 << deepest)
    slots = [(s, c) for c in codes for s in range(c << (deepest - depth(c)), (c + 1) << (deepest - depth(c)))]
    directory = df.sparkSession.createDataFrame(slots, "_slot long, _bucket long")
    return df.withColumn("_slot", slot).join(F.broadcast(directory), "_slot").drop("_slot")  # as many rows as buckets, or a few times that


class Draft:
    """The next version while it is written. As a context it deletes what it has written unless it was published."""

    def __init__(self, store: Versions):
        self.store, self.spark = store, store.spark
        self.number = max(store.numbers(), default=0) + 1
        self.held, self.written, self.published = dict(store.latest() or {}), [], False
        self._counts: dict[str, dict[str, int]] = {}

    def __enter__(self) -> Draft:
        return self

    def __exit__(self, *_) -> None:
        if not self.published:
            for path in self.written:
                self.store.fs.delete(self.store._path(path), True)

    def _folder(self, name: str) -> str:
        self.written.append(f"{name}/{self.number}-{uuid.uuid4().hex}")
        return self.written[-1]

    def put(self, name: str, df: DataFrame, by: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
        """A whole table in one folder; ``by``: below it in folders by the first of these columns, in files sorted by all. Rows that
        are ``dealt`` already stay in their tasks."""
        path = self._folder(name)
        if by:
            (df if dealt else df.repartitionByRange(*by)).sortWithinPartitions(*by).write.partitionBy(by[0]).parquet(f"{self.store.root}/{path}")
            self.held[name] = {"path": path, "schema": df.schema.jsonValue()}
        else:
            df.write.parquet(f"{self.store.root}/{path}")
            self.held[name] = path
        return self.read(name)

    def create(self, name: str, schema: str, keys: list[str], bucket_rows: int = 100_000) -> None:
        """An empty table in buckets of at most about ``bucket_rows`` rows, by the hash of ``keys``."""
        self.held[name] = {"keys": keys, "bucket_rows": bucket_rows, "schema": T.StructType.fromDDL(schema).jsonValue(), "buckets": {}, "notes": {}}

    def notes(self, name: str) -> dict:
        """Small facts that are kept with a table in buckets; writing into it changes the draft only."""
        entry = self.held[name]
        if not in_buckets(entry):
            return {}
        self.held[name] = entry = {**entry, "notes": dict(entry["notes"])}
        return entry["notes"]

    def merge(self, name: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Replaces the buckets that the keys of ``batch`` fall into by ``change(their rows, batch)``, and gives their new rows.

        What is read and written grows with the batch: with as many buckets as it has keys, at most. A bucket that may get more
        rows than it should is divided, by halves of its hashes. A column ``action`` is counted and left out. Of a
        table in one folder, all is read and written.
        """
        entry = self.held[name]
        if not in_buckets(entry):
            new = change(self.store.rows(entry), batch)
            if "action" in new.columns:
                self._counts[name] = {r["action"]: r["count"] for r in new.groupBy("action").count().collect()}
            return self.put(name, new.drop("action"))
        keys, held = entry["keys"], {int(c): tuple(b) for c, b in entry["buckets"].items()}
        leaves = sorted(held) or [1]
        arriving = {r["_bucket"]: r["count"] for r in place(batch, keys, leaves).select("_bucket", *keys).distinct().groupBy("_bucket").count().collect()}  # one row a bucket
        if not arriving:
            return self.store.rows(entry, [])
        halvings = {c: max(0, math.ceil(math.log2((n + held.get(c, ("", 0))[1]) / entry["bucket_rows"]))) for c, n in arriving.items()}
        own = [p for c, k in halvings.items() for p in range(c << k, (c + 1) << k)]
        new = change(self.store.rows(entry, list(arriving)), batch)
        new = new.withColumnRenamed("action", "_action") if "action" in new.columns else new.withColumn("_action", F.lit(None).cast("string"))
        path = self._folder(name)
        where = f"{self.store.root}/{path}"
        place(new, keys, own).repartition(min(len(own), MOST_WRITERS), "_bucket").write.partitionBy("_bucket").parquet(where)
        # counted from the files: the same whatever tasks ran twice. Readers of the table do not see the column
        there = any(f.isDirectory() for f in self.store.fs.listStatus(self.store._path(path)))
        seen = self.spark.read.parquet(where).groupBy("_bucket", "_action").count().collect() if there else []
        sizes, actions = Counter(), Counter()
        for r in seen:
            sizes[r["_bucket"]] += r["count"]
            actions[r["_action"]] += r["count"]
        self._counts[name] = dict(actions)
        buckets = {c: b for c, b in held.items() if c not in arriving} | {c: (f"{path}/_bucket={c}" if sizes[c] else "", sizes[c]) for c in own}
        self.held[name] = entry = {**entry, "buckets": {str(c): buckets[c] for c in sorted(buckets)}}
        return self.store.rows(entry, own)

    def counts(self, name: str) -> dict[str, int]:
        """Rows of the last merge by action."""
        return self._counts.get(name, {})

    def forget(self, name: str) -> None:
        """Leaves a table out of the version; its folder goes too if this draft has written it."""
        for path in folders({name: self.held.pop(name)}) & set(self.written):
            self.store.fs.delete(self.store._path(path), True)

    def check(self, **violations: DataFrame) -> None:
        """Raises if any of these frames has a row, naming the first ones: the draft is then not published."""
        for name, df in violations.items():
            if rows := df.limit(5).collect():
                raise ValueError(f"{name}: {', '.join(str(tuple(r)) for r in rows)}")

    def read(self, name: str) -> DataFrame:
        return self.store.rows(self.held[name])

    def publish(self, keep: int | None = None) -> int:
        """Creates the version's file; an error if another writer has created it meanwhile."""
        try:
            stream = self.store.fs.create(self.store._path(f"v={self.number}"), False)
        except Exception as error:
            raise RuntimeError(f"version {self.number} of {self.store.root} is another writer's") from error
        stream.write(bytearray(json.dumps(self.held).encode()))
        stream.close()
        self.published = True
        if keep:
            self.store.clean(keep)
        return self.number


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; only where none is named, its warehouse. All executors see both."""
    context = spark.sparkContext
    return context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared folder, deleted at the end."""
    path = f"{shared_folder(spark)}/quillwork-{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        Versions(spark, path).delete()


@contextmanager
def files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when its write ends: nothing reads them again. Then the session is as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed now and held as a checkpoint, so that the tables it reads can be deleted. Spark's cleaner deletes the
    checkpoint when nothing refers to it any more, if the session asks for that
    (spark.cleaner.referenceTracking.cleanCheckpoints). A session without a checkpoint folder gets one in its warehouse."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/quillwork-checkpoints")
    return df.checkpoint()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
