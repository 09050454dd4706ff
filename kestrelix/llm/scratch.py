"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` (or the folder given to ``SparkContext.setCheckpointDir``) is that
folder. Only a local session without one (tests) gets a folder of this process, removed at
exit; on a cluster a missing setting is an error, because other executors would not see it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2000
_own: list[str] = []
_made: list[list[str]] = []  # paths of the operators that are running, innermost last


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or for local sessions a private one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = given.get() if given.isDefined() else None
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kestrelix-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kestrelix-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    The result no longer depends on the plan of ``df``: a lost executor costs a
    re-read, not a recomputation.
    """
    spark = df.sparkSession
    # a union must not promise its inputs' partitioning: adaptive execution may still change it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # whole texts travel to Python in Arrow batches: smaller ones keep its workers small
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    path = new_path(spark, name)
    if _made:
        _made[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file in the store of ``path``; an existing one is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it does not exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of :func:`written` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        for made in _made:
            if path in made:
                made.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(conf).delete(p, True)


def paths_read(df: DataFrame) -> list[str]:
    """Folders and files that the plan of ``df`` scans."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("LogicalRelation") or leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(j).toString() for j in range(roots.size())]
    return found


def tidy(operator):
    """Of the tables that an operator writes, only those stay that its result still reads."""

    @wraps(operator)
    def run(*args, **options):
        _made.append([])
        try:
            out = operator(*args, **options)
        except BaseException:
            made = _made.pop()
            for frame in (x for x in args if isinstance(x, DataFrame)):
                remove(frame.sparkSession, *made)
                break
            raise
        made = _made.pop()
        ids = {p.rstrip("/").split("/")[-2] for p in paths_read(out) if "/" in p.rstrip("/")}
        keep = [p for p in made if p.split("/")[-2] in ids]
        remove(out.sparkSession, *[p for p in made if p not in keep])
        if _made:
            _made[-1] += keep
        return out

    return run
