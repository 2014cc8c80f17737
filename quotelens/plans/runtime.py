"""Session-level helpers: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each context, so that
    they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_quotelens_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quotelens-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._quotelens_shipped = True


def jvm_function(spark: SparkSession, source: Path, returns: str) -> str:
    """The name of the SQL function that the class in a Java file is, of package `quotelens` and
    named like the file; it is compiled once for each context by the compiler that comes with
    Spark for its own plans, and sent to the executors."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    made = sc.__dict__.setdefault("_quotelens_compiled", {})
    name = f"quotelens_{source.stem.lower()}"
    if name not in made:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.read_text(encoding="utf-8"))
        archive = Path(tempfile.mkdtemp(prefix="quotelens-")) / f"{name}.jar"
        with zipfile.ZipFile(archive, "w") as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(f"{c.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(str(archive))
        made[name] = compiler.getClassLoader().loadClass(f"quotelens.{source.stem}").newInstance()
    spark._jsparkSession.udf().register(name, made[name], jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only in a session of one process (tests) that names none a folder is set here; on a
    cluster a machine's own folder would be lost with the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quotelens-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over removed now; Spark does so only when
    the driver happens to collect its garbage, until when they all stay.  What listeners
    still hold of the last step goes in the second round."""
    for pause in (0.2, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    For a result that several later steps read; it survives the loss of executors.
    """
    spark = df.sparkSession
    ship(spark)
    shared_dir(spark)
    done = df.checkpoint()
    del df
    release(spark)
    return done


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0):
            with pa.ipc.open_stream(rows.as_buffer()) as r:
                yield from r


def materialize_packed(df: DataFrame) -> DataFrame:
    """As ``materialize``, compressed: for large tables of texts, which a checkpoint holds
    as they are in memory."""
    shape = df.schema
    ship(df.sparkSession)
    return materialize(df.mapInArrow(_packed, "rows binary")).mapInArrow(_unpacked, shape)
