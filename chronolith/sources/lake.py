"""Storage by URI, through Hadoop's file systems: local, HDFS and object stores alike."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = __name__.split(".")[0]
REPOSITORY = str(Path(__file__).resolve().parents[2])
LAYERS = ("raw", "bronze", "silver", "gold", "samples", "exports", "models", "metrics", "plans", "charts")


def normalise(uri: str) -> str:
    """``/user/...`` on an HDFS backend becomes ``hdfs:///user/...``; other URIs stay."""
    return f"hdfs://{uri}" if uri.startswith("/user/") else uri


def storage_backend(value: str | None = None) -> str:
    """``local`` or ``hdfs``, from the argument or STORAGE_BACKEND."""
    backend = (value or os.environ.get("STORAGE_BACKEND", "local")).lower()
    if backend not in ("local", "hdfs"):
        raise ValueError(f"unknown storage backend {backend!r}: use local or hdfs")
    return backend


def guard(root: str) -> str:
    """Refuse an empty root, the file-system root and this repository."""
    bare = root.removeprefix("file://").rstrip("/")
    if not bare or bare.endswith(":"):
        raise ValueError("the data root must not be the file-system root")
    if "://" not in bare and (Path(bare).resolve() == Path(REPOSITORY) or Path(REPOSITORY) in Path(bare).resolve().parents):
        raise ValueError("the data root must lie outside the repository")
    return root.rstrip("/")


def default_root(backend: str | None = None, user: str | None = None) -> str:
    """DATA_ROOT, else a folder of the backend: the user's home in HDFS, or below the local home."""
    if root := os.environ.get("DATA_ROOT"):
        return normalise(root) if storage_backend(backend) == "hdfs" else root
    if storage_backend(backend) == "hdfs":
        name = user or os.environ.get("HDFS_USER") or os.environ.get("USER")
        if not name:
            raise ValueError("HDFS needs DATA_ROOT, HDFS_USER or USER")
        return normalise(f"/user/{name}/{PACKAGE}-data")
    return str(Path.home() / f"{PACKAGE}-data")


def storage_errors(spark: SparkSession, root: str, least_free_gb: float = 50, volume: str | None = None, local_dir: str | None = None) -> list[str]:
    """Why a root is not fit for use: missing, not writable, too little space, or not on the mounted volume it should be on."""
    errors = []
    place = Location(spark, normalise(root))
    if volume is not None and not os.path.ismount(volume):
        errors.append(f"no volume is mounted at {volume}")
    if volume is not None and Path(volume).resolve() not in Path(root).resolve().parents:
        errors.append(f"{root} lies outside the volume {volume}")
    if local_dir and "://" in local_dir:
        errors.append(f"the scratch folder {local_dir} must be a local path")
    if not place.is_dir():
        return [*errors, f"{root} is no folder"]
    probe = place / ".probe"
    try:
        probe.write_text("")
        probe.remove()
    except Exception as e:  # noqa: BLE001  a store's own errors come through Py4J
        errors.append(f"{root} is not writable: {type(e).__name__}")
    if (free := place.free() / 1e9) < least_free_gb:
        errors.append(f"{free:.1f} GB are free at {root}, {least_free_gb} GB are needed")
    return errors


@dataclass(frozen=True)
class Location:
    """A path in any store that the session's Hadoop configuration reaches."""

    spark: SparkSession
    uri: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Location:
        return Location(self.spark, f"{self.uri.rstrip('/')}/{name.lstrip('/')}")

    def exists(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path)

    def is_file(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path) and fs.getFileStatus(path).isFile()

    def is_dir(self) -> bool:
        path, fs = self._fs()
        return fs.exists(path) and fs.getFileStatus(path).isDirectory()

    def make(self) -> Location:
        path, fs = self._fs()
        fs.mkdirs(path)
        return self

    def resolve(self) -> str:
        path, fs = self._fs()
        return fs.makeQualified(path).toString()

    def size(self) -> int:
        """Bytes below the path, 0 if it does not exist."""
        path, fs = self._fs()
        return int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0

    def free(self) -> int:
        """Bytes left in the store."""
        path, fs = self._fs()
        return int(fs.getStatus(path).getRemaining())

    def remove(self) -> bool:
        path, fs = self._fs()
        return fs.delete(path, True)

    def put(self, local: str) -> Location:
        """Copy a local file here."""
        path, fs = self._fs()
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(local).resolve()}"), path)
        return self

    def read_text(self) -> str:
        path, fs = self._fs()
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        path, fs = self._fs()
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def workspace(spark: SparkSession) -> str:
    """A fresh folder that goes when the driver ends, below ``spark.checkpoint.dir``; only one machine may do without that."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    place = Location(spark, f"{(base or tempfile.gettempdir()).rstrip('/')}/{PACKAGE}-{uuid.uuid4().hex}").make()
    path, fs = place._fs()
    fs.deleteOnExit(path)
    return place.uri


@dataclass(frozen=True)
class Lake:
    """The layers below a guarded root."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        guard(self.root)

    @property
    def base(self) -> Location:
        return Location(self.spark, guard(normalise(self.root)))

    def at(self, layer: str, name: str = "") -> Location:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        place = self.base / layer
        return place / name if name else place

    def create(self) -> Lake:
        for layer in LAYERS:
            self.at(layer).make()
        return self

    def holds(self, uri: str) -> bool:
        """Whether a path lies below the root."""
        inside = Location(self.spark, uri).resolve()
        return inside.startswith(self.base.resolve().rstrip("/") + "/")
