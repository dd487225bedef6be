"""Landing files: format by extension, audit columns, quarantine, and each file only once."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import store

# File extensions and their formats.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
CORRUPT = "_corrupt_record"
AUDIT = ("ingestion_timestamp", "source_file_path", "job_run_id")

RATINGS = T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("movie_id", T.IntegerType()), T.StructField("rating", T.FloatType()), T.StructField("rated_at", T.StringType())])
MOVIES = T.StructType(
    [
        T.StructField("movie_id", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType()),
        T.StructField("year", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("country", T.StringType()),
    ]
)
USERS = T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("signup_date", T.StringType()), T.StructField("country", T.StringType()), T.StructField("plan", T.StringType())])


def file_format(path: str) -> str:
    """Format by extension; others are refused."""
    ext = Path(path).suffix.lower()
    if ext not in FORMATS:
        raise ValueError(f"no format for {ext!r}; known: {sorted(FORMATS)}")
    return FORMATS[ext]


def is_json_document(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one array, which a task must read whole, and not an object per line, which can be split."""
    head = store.head(spark, next(store.files(spark, path)), 256).decode(errors="replace").lstrip("\ufeff \t\r\n")
    return head.startswith("[")


def read_source(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """The file, or files of one format, under a declared schema, with broken records in ``_corrupt_record``.

    JSON is an array of records, or a record per line.  CSV and JSON records that do not fit have null fields and their text in that column,
    which is part of the schema or Spark would not fill it.  Parquet must have all columns of the schema; they are
    cast to its types, and further columns are left out.
    """
    path = [path] if isinstance(path, str) else list(path)
    fmt = file_format(path[0])
    lines = fmt == "json" and not is_json_document(spark, path[0])
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    if fmt == "csv":
        return spark.read.schema(full).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path)
    if fmt == "json":
        return spark.read.schema(full).options(multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).json(path)
    df = spark.read.option("mergeSchema", len(path) > 1).parquet(*path)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path[0]} lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], F.lit(None).cast("string").alias(CORRUPT))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the corrupt column, and broken records with it."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def add_audit_columns(df: DataFrame, path: str | Column, run_id: str) -> DataFrame:
    return df.withColumns({"ingestion_timestamp": F.current_timestamp(), "source_file_path": F.lit(path) if isinstance(path, str) else path, "job_run_id": F.lit(run_id)})


def file_path() -> Column:
    """The file that a row was read from, written as listings write it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


#: Files beyond this are known by their length and time, not by their bytes.
HASHED_BYTES = 1 << 30


def content_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, hash`` of files, hashed where they are read."""
    if not paths:
        return spark.createDataFrame([], "path string, hash string")
    # the lengths come from the listing, so that no large file's bytes are asked for
    big = F.col("length") > HASHED_BYTES
    by_time = F.md5(F.concat_ws("/", "length", F.unix_micros("modificationTime")).cast("binary"))
    read = spark.read.format("binaryFile").load(list(paths))
    small = read.filter(~big).select("path", F.md5("content").alias("hash"))
    return small.unionByName(read.filter(big).select("path", by_time.alias("hash")))


def landing_path(base: str, source: str, entity: str, run_id: str, at: datetime | None = None) -> str:
    """base/source/entity/yyyy/mm/dd/first eight characters of the run."""
    at = at or datetime.now(UTC)
    return store.join(base, source, entity, f"{at:%Y}", f"{at:%m}", f"{at:%d}", run_id[:8])


class Registry:
    """Which contents were landed: one small file per content, so that parallel runs don't overwrite each other."""

    SCHEMA = "hash string, path string, rows bigint, bad bigint, out string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)

    def has(self, digest: str) -> bool:
        return store.exists(self.spark, store.join(self.folder, f"{digest}.json"))

    def add(self, digest: str, **facts) -> None:
        store.write_text(self.spark, store.join(self.folder, f"{digest}.json"), json.dumps({"hash": digest, **facts}, default=str))

    def as_dataframe(self) -> DataFrame:
        if not store.children(self.spark, self.folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.folder)


class Quarantine:
    """Copies of files that could not be landed, with the reason; broken records of files that could."""

    SCHEMA = "file string, copy string, reason string, job_run_id string, at string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder)
        self.records = store.join(self.folder, "records")

    def put(self, path: str, reason: str, run_id: str) -> None:
        stem, dot, ext = store.name(path).rpartition(".")
        copy = f"{stem}-{uuid.uuid4().hex[:8]}{dot}{ext}"
        store.copy(self.spark, path, store.join(self.folder, "files", copy))
        record = {"file": path, "copy": copy, "reason": reason[:500], "job_run_id": run_id, "at": datetime.now(UTC).isoformat()}
        store.write_text(self.spark, store.join(self.folder, "errors", f"{copy}.json"), json.dumps(record))

    def errors(self) -> list[dict]:
        folder = store.join(self.folder, "errors")
        return [json.loads(store.read_text(self.spark, store.join(folder, n))) for n in store.children(self.spark, folder)]

    def as_dataframe(self) -> DataFrame:
        folder = store.join(self.folder, "errors")
        if not store.children(self.spark, folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(folder)


#: What errors say that tell of a file, not of the cluster.
_UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "MALFORMED_", "is not a Parquet file", "Could not read footer")


def _is_the_files_fault(e: Exception) -> bool:
    if isinstance(e, ValueError):
        return True
    return isinstance(e, (PySparkException, Py4JJavaError)) and any(x in str(e) for x in _UNREADABLE)


@dataclass
class Landing:
    """Lands files of one source: each content once, broken records beside the good ones."""

    spark: SparkSession
    base: str
    registry: Registry
    quarantine: Quarantine

    def ingest(self, path: str, source: str, entity: str, schema: T.StructType, run_id: str | None = None) -> str | None:
        """The folder written, or None: file missing, content known, unreadable, or no good row."""
        out = self._land(list(store.files(self.spark, path)), source, entity, schema, run_id or str(uuid.uuid4()))
        return out[0] if out else None

    def ingest_directory(self, folder: str, source: str, entity: str, schema: T.StructType, pattern: str = "*") -> list[str]:
        """The files of a folder under one run, those of a format together; the folders written.

        Their contents are hashed and looked up among those landed before by one join.
        """
        there = [n for n in store.children(self.spark, folder) if fnmatch(n, pattern)]
        names = [store.join(folder, n) for n in there if any(n.lower().endswith(e) for e in FORMATS)]
        return self._land([f for n in names for f in store.files(self.spark, n)], source, entity, schema, str(uuid.uuid4()))

    def fresh(self, paths: Sequence[str]) -> dict[str, str]:
        """Of the files those whose content was not landed, with its hash; of equal ones the first by name."""
        h = content_hashes(self.spark, [p for p in paths if not store.name(p).startswith("_")])
        known = self.registry.as_dataframe().select("hash").distinct()
        rows = h.join(known, "hash", "left_anti").groupBy("hash").agg(F.min("path").alias("path")).collect()  # a row per listed file
        return {r["path"]: r["hash"] for r in rows}

    def _land(self, paths: list[str], source: str, entity: str, schema: T.StructType, run_id: str) -> list[str]:
        kinds: dict[str, dict[str, str]] = {}
        for path, digest in sorted(self.fresh(paths).items()):
            kind = file_format(path)
            kinds.setdefault("json-lines" if kind == "json" and not is_json_document(self.spark, path) else kind, {})[path] = digest
        out = []
        for kind, files in kinds.items():
            try:
                out += self._land_together(kind, files, source, entity, schema, run_id)
            except Exception as e:
                if not _is_the_files_fault(e):
                    raise
                if len(files) == 1:
                    self.quarantine.put(next(iter(files)), str(e), run_id)
                for path, digest in files.items() if len(files) > 1 else ():  # one of them is broken: each by itself
                    out += self._land([path], source, entity, schema, run_id)
        return out

    def _land_together(self, kind: str, files: dict[str, str], source: str, entity: str, schema: T.StructType, run_id: str) -> list[str]:
        """Files of one format in one pass: good rows are written, broken ones counted and set aside."""
        out = f"{landing_path(self.base, source, entity, run_id)}-{kind}-{min(files.values())[:8]}"
        df = read_source(self.spark, list(files), schema).withColumn("_path", file_path())
        good = add_audit_columns(df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), F.col("_path"), run_id).drop("_path")
        good.write.mode("overwrite").option("compression", "snappy").parquet(out)
        rows = {r["p"]: r["n"] for r in self.spark.read.parquet(out).groupBy(F.col("source_file_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        bad: dict[str, int] = {}
        if kind != "parquet":  # whose rows are whole
            records = store.join(self.quarantine.records, f"{store.name(out)}")
            df.filter(F.col(CORRUPT).isNotNull()).write.mode("overwrite").parquet(records)
            bad = {r["p"]: r["n"] for r in self.spark.read.schema(df.schema).parquet(records).groupBy(F.col("_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            if not bad:
                store.delete(self.spark, records)
        for path, digest in files.items():
            if rows.get(path):
                self.registry.add(digest, path=path, rows=rows[path], bad=bad.get(path, 0), out=out)
            elif kind == "parquet" and rows:  # an empty part of a table
                self.registry.add(digest, path=path, rows=0, bad=0, out=out)
            else:
                self.quarantine.put(path, "no row could be read", run_id)
        if not rows:
            store.delete(self.spark, out)
            return []
        return [out]


def read_landed(spark: SparkSession, base: str, source: str, entity: str) -> DataFrame:
    """Everything landed of an entity, over all runs."""
    return spark.read.option("recursiveFileLookup", True).parquet(store.join(base, source, entity))


def write_samples(spark: SparkSession, folder: str, rows: int = 200, seed: int = 42) -> dict[str, str]:
    """Small input files of every format, with one file of broken lines; the same for a seed.  Their paths by name."""
    rnd = random.Random(seed)
    lines = [",".join(RATINGS.fieldNames())]
    for _ in range(rows):
        day = rnd.randint(1, 28)
        lines.append(f"{rnd.randint(1, 50)},{rnd.randint(1, 30)},{rnd.randint(2, 10) / 2},2024-0{rnd.randint(1, 3)}-{day:02d} {rnd.randint(0, 23):02d}:00:00")
    kinds = ["Action", "Comedy", "Drama", "Horror", "Romance"]
    movies = [{"movie_id": i, "title": f"Movie {i}", "genres": "|".join(rnd.sample(kinds, rnd.randint(1, 3))), "year": rnd.randint(1990, 2024), "language": "en", "country": rnd.choice(["USA", "UK", "FR"])} for i in range(1, 31)]
    out = {n: store.join(folder, f) for n, f in (("ratings", "ratings.csv"), ("movies", "movies.json"), ("ratings_bad", "ratings_bad.csv"), ("users", "users.parquet"))}
    store.write_text(spark, out["ratings"], "\n".join(lines) + "\n")
    store.write_text(spark, out["movies"], json.dumps(movies))
    store.write_text(spark, out["ratings_bad"], lines[0] + "\n1\n1,2,3,4,5,6\nx,y,z\n")
    users = [(i, f"{rnd.choice([2022, 2023])}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", rnd.choice(["USA", "UK", "FR"]), rnd.choice(["basic", "standard", "premium"])) for i in range(1, 51)]
    spark.createDataFrame(users, USERS).coalesce(1).write.mode("overwrite").parquet(out["users"])
    return out
