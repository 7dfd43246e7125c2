"""Session defaults, the shared work folder and materialised intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
Made = TypeVar("Made")
#: Paths handed out inside ``passing``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def build_session(master: str | None = None, app_name: str = "panelkit", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.unix.domain.socket.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        made = tempfile.mkdtemp(prefix="panelkit-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local_folders[context.applicationId] = made
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{work_folder(spark)}/panelkit/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    held = _passing.get()
    if held is not None:
        held.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the work folder that no relation in use reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes to the work folder inside are deleted at the end; results must be written elsewhere before."""
    held: list[str] = []
    token = _passing.set(held)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in held:
            discard(spark, path)


def clean_up(spark: SparkSession) -> None:
    """Delete what this application wrote to the work folder; call it when no relation built on it is needed any more."""
    discard(spark, f"{work_folder(spark)}/panelkit/{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, column pruning kept."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, label: str) -> DataFrame:
    """A side whose size is known before it is joined: written once, so that its file size lets the planner choose the join."""
    return materialise(df, label)


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """``df`` itself when it is a scan with projections and filters, else a written copy.

    For steps that read their input more than once: a join or aggregation below them runs only once.
    """
    light = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "SubqueryAlias", "DataSourceV2ScanRelation"}
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().split(" ")[0] not in light:
            return materialise(df, label)
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return df


def side_by_side(steps: Sequence[Callable[[], Made]]) -> list[Made]:
    """Results of steps that do not need each other, run at once: the jobs of later ones take the cores that earlier ones leave idle."""
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]
