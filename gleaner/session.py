"""Session defaults and the shared-folder helper that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than that (a single small file is one split); larger inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= n else df.repartition(n)


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small frame of literals that needs no Python worker; ``columns``: names with types, as in DDL. Values are numbers, strings or None."""
    def lit(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]
    names, cast = ", ".join(n for n, _ in pairs), ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in pairs)
    if not rows:
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {t}) AS {n}' for n, t in pairs)} WHERE false")
    return spark.sql(f"SELECT {cast} FROM VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)} AS t({names})")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, wherever the driver imported it from (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gleaner-ship-")  # of the driver alone, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/gleaner_pkg.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"gleaner/{f.relative_to(root)}")
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a written table; errors of the storage rise."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_gleaner_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
