"""Durable versions of tables: a new version is written beside the old one and takes its place when it is whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import BuildError

if TYPE_CHECKING:
    from .runtime import Runtime
    from .schema import TableDef


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by files in the folder of ``spark.checkpoint.dir``. Where none is set, a local session gets one; a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        conf = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not conf and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="typedframe-"))
    return df.checkpoint()


def staged(rt: Runtime, table: TableDef, df: DataFrame) -> Callable[[], DataFrame]:
    """Writes the version; the function returned puts it in place and reads it. Readers of the old version must be done by then."""
    spark = rt.spark
    mark = uuid.uuid4().hex[:8]
    if isinstance(rt.source, str):
        path = f"{rt.source.rstrip('/')}/{table.name}.parquet"
        new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
        df.write.parquet(new)

        def swap() -> DataFrame:
            jvm = spark._jvm
            at = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)]
            fs = at[0].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            had = fs.exists(at[0])
            if had and not fs.rename(at[0], at[2]):
                raise OSError(f"{path} can't be moved")
            if not fs.rename(at[1], at[0]):
                if had:
                    fs.rename(at[2], at[0])
                raise OSError(f"{new} can't be moved to its place")
            if had:
                fs.delete(at[2], True)
            spark.catalog.refreshByPath(path)
            return spark.read.parquet(path)

        return swap
    if rt.is_jdbc(table):
        whole = checkpointed(df)  # it reads the table that it replaces

        def overwrite() -> DataFrame:
            o = rt.jdbc_options(table)
            whole.write.option("truncate", "true").jdbc(o["url"], o.get("table", table.physical), mode="overwrite", properties=o.get("properties"))
            return rt.read_jdbc(table)

        return overwrite
    if isinstance(rt.source, dict):
        raise BuildError("tables that are DataFrames can't be durable")
    name = table.physical
    temp = f"{name}_{mark}"
    df.write.format("parquet").saveAsTable(temp)

    def rename() -> DataFrame:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {temp} RENAME TO {name}")
        return spark.table(name)

    return rename
