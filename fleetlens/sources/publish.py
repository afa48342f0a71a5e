"""Publishing the reports of a bundle together: readers see all of them or none.

Every report is written to a new folder that no reader looks for. Then a manifest, a
small file that names the folders, is renamed into place under the next number;
that rename is the only step readers can see. A run that fails before it leaves
folders that nothing refers to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetlens.sources.sink import write

_MANIFESTS = "manifests"


class PublishedByOther(RuntimeError):
    """Another writer took the number in between."""


def _files(spark: SparkSession, root: str) -> tuple[object, object]:
    """Hadoop's file context of a folder, and its path class."""
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    uri = fs.Path(root).toUri()
    conf = context._jsc.hadoopConfiguration()
    return (fs.FileContext.getFileContext(uri, conf) if uri.getScheme() else fs.FileContext.getFileContext(conf)), fs


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all published versions, oldest first."""
    files, fs = _files(spark, root)
    folder = fs.Path(f"{root}/{_MANIFESTS}")
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def publish(reports: Mapping[str, DataFrame], root: str, version: int | None = None) -> int:
    """Write all reports and make them visible at once; gives the number of the version.

    ``version`` is the number to take, by default the next one. If another writer has taken it when
    the reports are ready, :class:`PublishedByOther` is raised and nothing of this
    run is visible. Every version stays readable. The folder needs a file system on which
    a rename that finds its target there fails.
    """
    if not reports:
        raise ValueError("no reports")
    spark = next(iter(reports.values())).sparkSession
    if version is None:
        version = max(versions(spark, root), default=0) + 1
    folders = {}
    for name, df in reports.items():
        folder = f"data/{name}-{uuid.uuid4().hex}"
        write(df, f"{root}/{folder}", mode="errorifexists")
        folders[name] = {"folder": folder, "schema": spark.read.parquet(f"{root}/{folder}").schema.jsonValue()}
    _commit(spark, root, version, json.dumps({"version": version, "reports": folders}))
    return version


def _commit(spark: SparkSession, root: str, version: int, text: str) -> None:
    files, fs = _files(spark, root)
    folder = f"{root}/{_MANIFESTS}"
    files.mkdir(fs.Path(folder), None, True)
    draft, final = fs.Path(f"{folder}/.{uuid.uuid4().hex}.draft"), fs.Path(f"{folder}/{version}.json")
    system = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        files.rename(draft, final, options)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise PublishedByOther(f"version {version} of {root} is there already") from e
        raise
    finally:
        if files.util().exists(draft):
            files.delete(draft, False)


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The reports of a version, by default the newest; all of one version, whatever is published meanwhile."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{root} has no version {version or ''}")
    path = f"{root}/{_MANIFESTS}/{version or known[-1]}.json"
    manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {
        name: spark.read.schema(T.StructType.fromJson(r["schema"])).parquet(f"{root}/{r['folder']}")
        for name, r in manifest["reports"].items()
    }
