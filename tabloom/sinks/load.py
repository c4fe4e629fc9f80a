"""Loading rows into a target: all or nothing, or in committed chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, types as T

from tabloom.operators.describe import footer_rows
from tabloom.session import work_path

# Fixed value: rows per committed chunk.
COMMIT_EVERY = 20_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished file its name, if no other has it: of two writers one gets it, the other a ``FileExistsError``."""
    fs, src = _fs(spark, source)
    jvm, dst = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(target)
    try:
        if fs.getScheme() == "file":
            # A local rename would replace what is there; a link is made or refused.
            at = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(at(dst), at(src))
            fs.delete(src, False)
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration()).rename(src, dst, kinds)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(target) from None
        raise OSError(f"could not name {target}: {e.java_exception}") from e


class LoadConflict(RuntimeError):
    """Another writer changed the target meanwhile; nothing of this load is visible."""


def load(df: DataFrame, target: str, mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """All rows or none, as a new version of the target.

    Rows go to a batch folder of their own, which nobody reads until a
    version names it: a small file with the batches that are current from
    then on, put in place only if no other writer took its number.  Versions
    follow each other, so a load goes by the one that it began with: appends
    move on to the next number with what is there then, while a ``replace``
    of a target that has changed raises ``LoadConflict``.  A failed load leaves
    the target as it was.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown load mode {mode!r}")
    spark, root, batch = df.sparkSession, target.rstrip("/"), f"b={uuid.uuid4().hex[:16]}"
    version = max(versions(spark, root), default=0)
    try:
        df.write.format(fmt).save(f"{root}/{batch}")
        while True:
            held = batches(spark, root, version) if version and mode == "append" else []
            try:
                _publish(spark, root, version + 1, [*held, batch])
                break
            except FileExistsError:
                if mode == "replace":
                    raise LoadConflict(f"{target} has a version {version + 1} already") from None
                version = max(versions(spark, root))
    except BaseException:
        fs, held = _fs(spark, f"{root}/{batch}")
        fs.delete(held, True)
        raise
    return read_loaded(spark, target, fmt, df.schema)


def _publish(spark: SparkSession, root: str, version: int, held: list[str]) -> None:
    draft = f"{root}/_versions/.draft-{uuid.uuid4().hex[:16]}"
    fs, p = _fs(spark, draft)
    try:
        out = fs.create(p, False)
        out.write(bytearray("\n".join(held).encode()))
        out.close()
        rename(spark, draft, f"{root}/_versions/{version}")
    finally:
        fs.delete(p, False)


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of a target's versions."""
    return _committed(spark, f"{target.rstrip('/')}/_versions")


def batches(spark: SparkSession, target: str, version: int) -> list[str]:
    """The folders, or single files, that are one version."""
    fs, p = _fs(spark, f"{target.rstrip('/')}/_versions/{version}")
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split("\n")
    finally:
        stream.close()


def read_loaded(spark: SparkSession, target: str, fmt: str = "parquet", schema=None, version: int | None = None) -> DataFrame:
    """The current version of a loaded target, or an earlier one."""
    version = version or max(versions(spark, target), default=0)
    if not version:
        raise FileNotFoundError(target)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    # A batch's name looks like a partition's; without a base path it is none.
    return reader.option("recursiveFileLookup", "true").load([f"{target.rstrip('/')}/{b}" for b in batches(spark, target, version)])


def forget_versions(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete all versions but the last ``keep`` and the batches that only they have; how many batches went.

    Batches that no version names are left alone: another writer may be about to publish them.
    """
    known = sorted(versions(spark, target))
    old, last = known[:-keep], known[-keep:]
    used = {b for v in last for b in batches(spark, target, v)}
    # A folder of which single files are still named stays, and so does a file of a folder that is.
    held = used | {b.split("/")[0] for b in used}
    gone = {b for v in old for b in batches(spark, target, v) if b not in held and b.split("/")[0] not in used}
    for name in [*gone, *[f"_versions/{v}" for v in old]]:
        fs, p = _fs(spark, f"{target.rstrip('/')}/{name}")
        fs.delete(p, True)
    return len(gone)


@dataclass
class ChunkReport:
    committed: int
    rows: int
    failed: str = ""


def load_chunked(df: DataFrame, target: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                 commit_every: int = COMMIT_EVERY, files_per_commit: int = 1) -> ChunkReport:
    """Commit chunk by chunk; when a row fails, the committed chunks stay.

    The rows are staged in files of at most ``commit_every`` rows, then read
    once as a stream of ``files_per_commit`` files per batch.  ``transform``
    (conversion, checks) runs inside the batch, and each batch is one
    committed folder.  Large loads raise both numbers.
    """
    spark = df.sparkSession
    staged = work_path(spark, "chunks")
    df.write.option("maxRecordsPerFile", str(commit_every)).parquet(staged)
    return load_chunked_files(spark, staged, df.schema, target, transform, files_per_commit)


def load_chunked_files(spark: SparkSession, source: str, schema: T.StructType, target: str,
                       transform: Callable[[DataFrame], DataFrame] | None = None, files_per_commit: int = 1) -> ChunkReport:
    """The same for files that exist already; a second run goes on after the last commit."""
    root = target.rstrip("/")

    def commit(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{root}/chunk={epoch}")

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_commit)).parquet(source)
              .writeStream.foreachBatch(commit).option("checkpointLocation", f"{root}/_checkpoint")
              .trigger(availableNow=True).start())
    failed = ""
    try:
        stream.awaitTermination()
    except Exception as e:
        failed = str(e).split("\n", 1)[0]
    done = _committed(spark, f"{root}/_checkpoint/commits")
    paths = [f"{root}/chunk={i}" for i in done if path_exists(spark, f"{root}/chunk={i}")]
    rows = footer_rows(spark, paths).first().rows if paths else 0
    return ChunkReport(len(paths), rows, failed)


def _committed(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def load_relational(df: DataFrame, url: str, table: str, mode: str = "append", driver: str | None = None,
                    staging: str | None = None, batch_rows: int = 500) -> None:
    """All or nothing into a relational table: staging table, then one copy.

    The statement that copies runs in one transaction on the server.
    """
    from tabloom.sources.jdbc import write_relational

    spark = df.sparkSession
    staging = staging or f"stage_{uuid.uuid4().hex[:8]}"
    write_relational(df, url, staging, "errorifexists", driver=driver, batch_rows=batch_rows)
    if driver:
        spark._jvm.java.lang.Class.forName(driver)
    conn = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        conn.setAutoCommit(False)
        st = conn.createStatement()
        if mode == "replace":
            st.executeUpdate(f"DELETE FROM {table}")
        names = ", ".join(f'"{c}"' for c in df.columns)
        st.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}")
        st.executeUpdate(f"DROP TABLE {staging}")
        conn.commit()
    except Exception:
        conn.rollback()
        raise
    finally:
        conn.close()
