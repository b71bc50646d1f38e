"""Cutting plans: tables that several branches read are computed once, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


HEAP_SHARE = 6


def release(spark: SparkSession) -> None:
    """Let go of shuffles, broadcasts and checkpoints that nothing refers to any more.

    Spark's cleaner frees them, here and on the executors, once the driver's collector has
    seen that they are gone. A driver whose heap is a sixth full is asked to look, and then to give back
    what its native code has freed.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > runtime.maxMemory() // HEAP_SHARE:
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> None:
    """Return the pages that the driver's C library keeps after they were freed.

    The compiler, codecs and network buffers allocate there from hundreds of threads, and the library keeps
    what each of them freed: 380 MB after a few runs of the pipeline, with 110 MB of live objects. A JVM
    without this command (it is HotSpot's, on Linux with glibc) keeps the pages.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        named = jvm.java.lang.Class.forName
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        types, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(kinds):
            types[k] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is not open to callers
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass
