"""Scratch space that driver and executors share, and lineage cuts by written tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: What the open scratch contexts of this thread delete when they end: folders and tables, the innermost context last.
_OPEN: ContextVar[tuple[list[tuple[str, str]], ...]] = ContextVar("open_scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Where the session names none, a local session gets a folder of its own and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        top = spark.sparkContext.getCheckpointDir()
    made = f"{top}/aeroframe-{uuid.uuid4().hex}"
    _note("folder", made)
    return made


def _note(kind: str, name: str) -> None:
    if _OPEN.get():
        _OPEN.get()[-1].append((kind, name))


def save_table(df_writer, name: str, where: str) -> str:
    """Save as a catalog table at a path; a scratch context drops it."""
    df_writer.option("path", where).saveAsTable(name)
    _note("table", name)
    return name


@contextmanager
def scratch(spark: SparkSession):
    """On leaving, deletes the intermediate tables that operators wrote inside. Consume their results before that:

    ``with scratch(spark): near_duplicates(docs).write.parquet(out)``"""
    made: list[tuple[str, str]] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for kind, name in made:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write to the shared folder and read the table back, so a lost executor costs no more than the last step."""
    where = where or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose tables to SQL text as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


#: SQL functions of the session: signature and body. The optimiser sees through them, like through any expression.
SQL_FUNCTIONS = {
    "aero_wrap_degrees(x DOUBLE) RETURNS DOUBLE": "pmod(x + 180, 360D) - 180",
    "aero_utm_epsg(lat DOUBLE, lon DOUBLE) RETURNS INT": "cast(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS int)",
    "aero_compass(azimuth DOUBLE) RETURNS STRING": "element_at(array('N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'), cast(floor((pmod(azimuth, 360D) + 22.5) / 45) AS int) % 8 + 1)",
    "aero_window_starts(n INT, size INT, stride INT) RETURNS TABLE (start INT)": "SELECT explode(array_distinct(concat(sequence(0, greatest(n - size, 0), stride), array(greatest(n - size, 0)))))",
}


def register_functions(spark: SparkSession) -> None:
    """Makes the library's scalar and table functions known to SQL text of the session.

    ``triangulate(TABLE(rings) PARTITION BY ring_id)`` takes corners (ring_id, pos, x, y) and
    gives triangles (ring_id, k, a, b, c), corners by their pos."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("triangulate", _triangulate())


def _triangulate():
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    from pyspark.sql.udtf import AnalyzeResult

    class Triangulate:
        """One ring a partition; its corners may come in any order."""

        def __init__(self):
            self.ring, self.corners = None, []

        @staticmethod
        def analyze(rings):
            if not rings.isTable:
                raise ValueError("triangulate takes a table of corners")
            missing = {"ring_id", "pos", "x", "y"} - set(rings.dataType.names)
            if missing:
                raise ValueError(f"corners lack {sorted(missing)}")
            whole = [StructField(c, LongType()) for c in "abc"]
            return AnalyzeResult(StructType([StructField("ring_id", rings.dataType["ring_id"].dataType), StructField("k", IntegerType()), *whole]))

        def eval(self, row):
            self.ring = row["ring_id"]
            self.corners.append((row["pos"], float(row["x"]), float(row["y"])))

        def terminate(self):
            import numpy as np

            from aeroframe.operators.kernels import triangulate

            corners = sorted(self.corners)
            if len(corners) >= 3:
                for k, t in enumerate(triangulate(np.array([c[1:] for c in corners])).tolist()):
                    yield (self.ring, k, *[int(corners[i][0]) for i in t])

    return udtf(Triangulate)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever the driver was started."""
    import shutil
    import tempfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='aeroframe-')}/aeroframe_package", "zip", here.parent, here.name))
        _SHIPPED.add(app)
