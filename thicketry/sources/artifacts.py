"""Artifacts with an identity: saved with it, read only if it agrees, reused, rebuilt or verified; manifests; protocols."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from thicketry.functions.fingerprints import canonical_json, value_fingerprint
from thicketry.operators.relations import same_bag
from thicketry.sources.files import exists, place

MODES = ("build", "reuse", "rebuild", "verify")


def mismatches(saved: dict, expected: dict) -> list[str]:
    """All fields in which two identities differ, not only the first."""
    show = lambda d, k: canonical_json(d[k]) if k in d else "nothing"
    return [f"{k}: {show(saved, k)} in place of {show(expected, k)}" for k in sorted(set(saved) | set(expected)) if show(saved, k) != show(expected, k)]


def _meta(spark: SparkSession, path: str) -> str:
    return f"{path}/meta"


def save_artifact(df: DataFrame, path: str, kind: str, version: int, identity: dict) -> None:
    """A table with what it is and what it was made from; refuses to write over one."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    place(df, f"{path}/data", f"{path}.writing")
    text = canonical_json({"kind": kind, "version": version, "identity": identity})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(_meta(spark, path))


def load_artifact(spark: SparkSession, path: str, kind: str, version: int, identity: dict) -> DataFrame:
    """The table, if kind, version and identity agree; else an error that names all that does not."""
    if not exists(spark, f"{path}/data") or not exists(spark, f"{_meta(spark, path)}/_SUCCESS"):
        raise FileNotFoundError(f"{path} is missing or in part only")
    meta = json.loads(spark.read.text(_meta(spark, path)).first()[0])
    wrong = mismatches({"kind": meta.get("kind"), "version": meta.get("version"), **meta.get("identity", {})}, {"kind": kind, "version": version, **identity})
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return spark.read.parquet(f"{path}/data")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], kind: str, version: int, identity: dict, mode: str = "build") -> DataFrame:
    """The artifact by one of four modes.

    ``build`` makes what is not there and refuses what is; ``reuse`` reads and refuses to make;
    ``rebuild`` makes it anew beside the old one and replaces that; ``verify`` reads, makes it once
    more and fails if the rows differ. What is there in part only fails, but for ``rebuild``.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    there = [exists(spark, f"{path}/data"), exists(spark, f"{_meta(spark, path)}/_SUCCESS")]
    if any(there) != all(there) and mode != "rebuild":
        raise RuntimeError(f"{path} is there in part only: rebuild it")
    if mode == "build" and all(there):
        raise FileExistsError(f"{path}: reuse or rebuild it")
    if mode in ("reuse", "verify"):
        saved = load_artifact(spark, path, kind, version, identity)
        if mode == "verify" and not same_bag(saved, build()):
            raise ValueError(f"{path} holds other rows than are made now")
        return saved
    new = f"{path}.{uuid.uuid4().hex}" if mode == "rebuild" else path
    save_artifact(build(), new, kind, version, identity)
    if new != path:
        _replace(spark, new, path)
    return load_artifact(spark, path, kind, version, identity)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (new, path))
    fs = q.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"cannot rename to {path}")


def check_replay(saved, expected: dict, field: str, label: str) -> None:
    """Fails unless ``saved`` is ``expected`` with its fingerprint in ``field``: by fingerprint, by fields, by content."""
    if not isinstance(saved, dict):
        raise ValueError(f"{label} is no mapping")
    want = value_fingerprint(expected)
    if saved.get(field) != want:
        raise ValueError(f"{label}: the fingerprint is another")
    bare = {k: v for k, v in saved.items() if k != field}
    if set(bare) != set(expected):
        raise ValueError(f"{label}: the fields are others")
    if value_fingerprint(bare) != want:
        raise ValueError(f"{label}: the content is another")


def save_manifest(manifest: dict, path: str, older: dict | None = None, field: str = "fingerprint", rebuild: bool = False) -> str:
    """Writes a manifest with its fingerprint: ``written``, ``same``, ``upgraded`` or ``rebuilt``.

    A different one stays, and is an error, unless it is exactly ``older`` (the one form before this
    that may be upgraded) or ``rebuild`` is asked for.
    """
    p = Path(path)
    value = {**manifest, field: value_fingerprint(manifest)}
    how = "written"
    if p.exists():
        saved = json.loads(p.read_text())
        if saved == json.loads(canonical_json(value)):
            return "same"
        if rebuild:
            how = "rebuilt"
        elif older is None:
            raise FileExistsError(f"{path} holds another manifest")
        else:
            check_replay(saved, older, field, path)
            how = "upgraded"
    tmp = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    tmp.write_text(canonical_json(value) + "\n")
    os.replace(tmp, p)
    return how


def read_metadata(path: str, fields: tuple[str, ...] = ()) -> dict:
    """A small JSON document of the driver; fails, naming all, if fields are missing."""
    value = json.loads(Path(path).read_text())
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    lacking = [f for f in fields if f not in value]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return value


def protocol(counts: Iterable[int], named: dict[str, tuple[int, ...]], custom: bool = False) -> dict:
    """Name, budgets and seeds of a sampling protocol of three budgets, whole, positive and rising.

    Budgets each of which is that of some named protocol at its place, but not of one, are refused;
    others than the named only with ``custom``.
    """
    if isinstance(counts, (str, bytes)) or not isinstance(counts, Iterable):
        raise TypeError("budgets must be whole numbers")
    v = tuple(counts)
    if any(isinstance(x, bool) or not isinstance(x, int) for x in v):
        raise TypeError("budgets must be whole numbers")
    if len(v) != 3 or min(v) <= 0 or list(v) != sorted(set(v)):
        raise ValueError("three budgets, positive and rising")
    for name, own in named.items():
        if v == tuple(own):
            return {"name": name, "budgets": v, "seeds": v[0], "formal": True}
    if named and all(x in column for x, column in zip(v, zip(*named.values()))):
        raise ValueError(f"budgets of several protocols: {v}")
    if not custom:
        raise ValueError(f"no named protocol has {v}")
    return {"name": "custom_" + "_".join(f"{x:04d}" for x in v), "budgets": v, "seeds": v[0], "formal": False}


def profile_name(name: str, aliases: dict[str, str], known: Iterable[str]) -> str:
    """A profile's name in its usual spelling, by its alias if it has one; fails on one that is not known."""
    plain = name.strip().lower().replace("-", "_").replace(" ", "_")
    plain = aliases.get(plain, plain)
    if plain not in set(known):
        raise ValueError(f"no profile {name!r}")
    return plain
