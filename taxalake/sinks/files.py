"""One file a row, and reruns that do only what is new or changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.sources.listed import open_folder


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's content (text or binary) to the file ``name`` in ``folder``; returns their number.

    A file appears under its name only when it is whole: it is written beside and moved. Rows
    without a name or content write nothing; of rows with one name, any one is kept."""
    files, at = open_folder(folder)
    files.create_dir(at)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = open_folder(folder)
        for batch in it:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{at}/.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(c.as_py())
                files.move(part, f"{at}/{n}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    rows = df.select(F.col(name).cast("string"), F.col(content).cast("binary")).where(F.col(name).isNotNull() & F.col(content).isNotNull())
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ---------------------------------------------------------------- reruns


def _versions(spark: SparkSession, log: str) -> tuple[object, object, list[str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{log.rstrip('/')}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return files, path, sorted(n for n in names if n.startswith("v"))


def finished(spark: SparkSession, log: str) -> DataFrame:
    """unit, length, hash, version and data (folder) of the units done so far, each as it was done last."""
    _, _, names = _versions(spark, log)
    schema = "unit string, length bigint, hash string, version int, data string"
    return spark.read.schema(schema).parquet(f"{log}/manifest/{names[-1]}") if names else spark.createDataFrame([], schema)


def run_new(units: DataFrame, log: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Does ``work`` on the units that are new or have changed since the last run, and returns their number.

    ``units`` has ``unit`` (unique), ``content`` (binary) and what ``work`` needs; a unit has changed
    if its length or content hash has. ``work`` returns rows with ``unit``. Its rows go to a folder of
    their own; then a new manifest is written beside and renamed to the next version, which is when the
    run counts: a run that dies before leaves the former version as it is, and of two runs at
    once the later one fails. Units that are gone keep their rows, as outputs do that nobody deletes."""
    spark = units.sparkSession
    files, folder, names = _versions(spark, log)
    version = int(names[-1][1:]) + 1 if names else 1
    done = finished(spark, log)
    keyed = units.withColumns({"length": F.octet_length("content").cast("bigint"), "hash": F.sha2("content", 256)})
    todo = keyed.join(done.select("unit", "length", "hash"), ["unit", "length", "hash"], "left_anti")
    mark = uuid.uuid4().hex
    data, draft = f"{log}/data/{mark}", f"{folder.toString()}/.{mark}"
    work(todo).write.parquet(data)
    own = todo.select("unit", "length", "hash", F.lit(version).alias("version"), F.lit(data).alias("data"))
    own.write.parquet(f"{log}/units/{mark}")
    own = spark.read.parquet(f"{log}/units/{mark}")
    count = own.count()
    done.join(own.select("unit"), "unit", "left_anti").unionByName(own).write.parquet(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(f"{folder.toString()}/v{version:08d}")
    if files.exists(target) or not files.rename(path(draft), target):
        raise RuntimeError(f"another run has written version {version}")
    return count


def results(spark: SparkSession, log: str) -> DataFrame:
    """The rows of all units, each as it was done last, with ``version``, the run that did it."""
    done = finished(spark, log)
    folders = [r["data"] for r in done.select("data").distinct().collect()]  # one a run
    if not folders:
        raise ValueError(f"no run has finished in {log}")
    rows = None
    for folder in sorted(folders):
        own = done.where(F.col("data") == folder).select("unit", "version")
        part = spark.read.parquet(folder).join(own, "unit")
        rows = part if rows is None else rows.unionByName(part)
    return rows
