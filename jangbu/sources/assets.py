"""Where inputs lie and what they are set to: version folders, layered settings, one truth per version."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(folder: str | Path, pattern: str) -> Path:
    """The last of the matching sub-folders in order of name; none fails."""
    found = sorted(p for p in Path(folder).glob(pattern) if p.is_dir())
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found[-1]


def layered(*settings: Mapping[str, Any], required: tuple[str, ...] = ()) -> dict[str, Any]:
    """Settings laid over each other, the last on top; mappings are merged, everything else replaced. ``required`` names dotted keys."""
    out: dict[str, Any] = {}
    for s in settings:
        for k, v in s.items():
            out[k] = layered(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    for key in required:
        at: Any = out
        for part in key.split("."):
            if not isinstance(at, Mapping) or part not in at or at[part] is None:
                raise KeyError(key)
            at = at[part]
    return out


def digest(path: str | Path) -> str:
    """SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def one_truth(candidates: list[str | Path]) -> Path:
    """The first existing one of several places of the same version; two with different content fail."""
    there = [Path(p) for p in candidates if Path(p).exists()]
    if not there:
        raise FileNotFoundError(", ".join(map(str, candidates)))
    if len({digest(p) for p in there}) > 1:
        raise ValueError(f"the same version differs: {', '.join(map(str, there))}")
    return there[0]


def latest_folder(spark: SparkSession, folder: str, pattern: str) -> str:
    """``latest`` on any file system Spark reads: the last matching sub-folder by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().getName() for s in found or [] if s.isDirectory())
    if not names:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return names[-1]


def flattened(settings: Mapping[str, Any], above: str = "") -> list[tuple[str, str]]:
    """Settings as dotted keys and texts, in order of the keys."""
    out: list[tuple[str, str]] = []
    for k in sorted(settings):
        v = settings[k]
        out += flattened(v, f"{above}{k}.") if isinstance(v, Mapping) else [(f"{above}{k}", str(v))]
    return out


def conflicting_versions(registered: DataFrame, keys: list[str], digest_column: str) -> DataFrame:
    """Keys under which one version stands in several places with different content: ``n_places, n_contents``."""
    g = registered.where(F.col(digest_column).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_places"), F.countDistinct(digest_column).alias("n_contents"))
    return g.where("n_contents > 1")
