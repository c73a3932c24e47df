"""Bundles of files that appear together: texts and tables first, then a manifest with their checksums.

Every bundle is a numbered folder of its own; nothing of an earlier one is touched. The rename of its manifest is the
only commit: a bundle with a manifest is whole, one without isn't there. Readers take the highest number, and can
check each file. A start recovers: folders without a manifest and staged manifests go, older bundles too but for the last `KEEP`.
Of two writers at once the higher number is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drafts import _fs

KEEP = 2


@dataclass
class Bundle:
    version: int
    path: str
    #: name: {"bytes": …, "sha256": …} of texts; of tables {"parts": {file: …}} besides
    files: dict[str, dict]


def _names(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest-{version:08d}.json"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.hsync()
    out.close()


def _get(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def _sums(spark: SparkSession, path: str) -> dict[str, dict]:
    """Bytes and sha-256 of a folder's files, read where Spark reads them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    return {r["name"]: {"bytes": r["length"], "sha256": r["sha256"]} for r in rows.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256")).filter("name not like '\\_%'").collect()}


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[9:17]) for n in _names(spark, root) if n.startswith("manifest-") and n.endswith(".json"))


def write(spark: SparkSession, root: str, texts: dict[str, str], tables: dict[str, DataFrame] | None = None, step: Callable[[str], None] = lambda name: None) -> Bundle:
    """Writes a bundle: texts by file name, tables as folders of JSON lines (their rows' order within parts is kept). step: told after each
    step that lasts."""
    recover(spark, root)
    version = max(versions(spark, root), default=0) + 1
    folder, files = f"{root}/bundle-{version:08d}", {}
    for name, text in texts.items():
        data = text.encode()
        _put(spark, f"{folder}/{name}", data)
        files[name] = {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        step(name)
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").json(f"{folder}/{name}")
        parts = _sums(spark, f"{folder}/{name}")
        files[name] = {"bytes": sum(p["bytes"] for p in parts.values()), "sha256": hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest(), "parts": parts}
        step(name)
    staged = f"{_manifest(root, version)}.staging"
    _put(spark, staged, json.dumps({"version": version, "files": files}, sort_keys=True).encode())
    step("staged")
    fs, src = _fs(spark, staged)
    if not fs.rename(src, _fs(spark, _manifest(root, version))[1]):
        raise OSError(f"{staged} can't be committed")
    step("committed")
    _prune(spark, root)
    step("pruned")
    return Bundle(version, folder, files)


def current(spark: SparkSession, root: str) -> Bundle | None:
    """The last bundle that was committed."""
    last = max(versions(spark, root), default=None)
    if last is None:
        return None
    return Bundle(last, f"{root}/bundle-{last:08d}", json.loads(_get(spark, _manifest(root, last)))["files"])


def damaged(spark: SparkSession, bundle: Bundle) -> list[str]:
    """Names of files that aren't what the manifest says."""
    out = []
    for name, told in bundle.files.items():
        fs, p = _fs(spark, f"{bundle.path}/{name}")
        if not fs.exists(p):
            out.append(name)
        elif "parts" in told:
            out += [name] if _sums(spark, f"{bundle.path}/{name}") != told["parts"] else []
        elif hashlib.sha256(_get(spark, f"{bundle.path}/{name}")).hexdigest() != told["sha256"]:
            out.append(name)
    return sorted(out)


def _prune(spark: SparkSession, root: str) -> None:
    for old in versions(spark, root)[:-KEEP]:
        # the manifest goes first, so that a half-removed bundle is one without
        for path in (_manifest(root, old), f"{root}/bundle-{old:08d}"):
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def recover(spark: SparkSession, root: str) -> list[str]:
    """Takes away what a writer that broke off left, and says what."""
    whole = {f"bundle-{v:08d}" for v in versions(spark, root)}
    gone = [n for n in _names(spark, root) if n.endswith(".staging") or (n.startswith("bundle-") and n not in whole)]
    for n in gone:
        fs, p = _fs(spark, f"{root}/{n}")
        fs.delete(p, True)
    _prune(spark, root)
    return sorted(gone)
