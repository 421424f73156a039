"""Sessions, tables, and the shared folder for what a job writes between its steps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark deletes a write's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="siltstone-")) / f"{here.name}.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, f"{here.name}/{file.relative_to(here)}")
    context.addPyFile(str(packed))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.

    Where it is unset and the session is local, a temporary folder takes its place; on a cluster that would lose
    files, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="siltstone-"))


class Scratch:
    """Tables written between the steps of one operator, so that lineage is cut and a lost executor costs one step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and return it as read back; what it shuffled is gone by then."""
        path = f"{self.base}/{self._made:04d}"
        self._made += 1
        conf, before = self.spark.conf, self.spark.conf.get(_CLEAN)
        conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counting(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """As keep, and the rows of which `what` is true, counted while they are written."""
        seen = Observation()
        made = self.keep(df.observe(seen, F.count_if(what).alias("n")))
        return made, seen.get["n"]

    def path_of(self, df: DataFrame) -> str:
        return df.inputFiles()[0].rsplit("/", 1)[0]

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no result reads any more."""
        for df in frames:
            files = df.inputFiles()
            if files:
                delete(self.spark, files[0].rsplit("/", 1)[0])


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM drop what earlier steps left, broadcast tables first, and give freed memory to the system.

    Many small steps in a row would else fill its heap and its allocator's pools before a collection is due.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # By the interface's method: Python's gateway does not see those of the class behind it.
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        call = next(m for m in kind.getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        given[2], given[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # noqa: BLE001  a JVM that has no such command
        pass


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
