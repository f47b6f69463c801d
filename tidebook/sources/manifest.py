"""Manifests of artifacts: what files belong to a data set, and whether they are whole."""

from __future__ import annotations

import json
import shutil
from pathlib import Path, PurePosixPath

import pyarrow.parquet as pq

from tidebook.sources.files import sha256_file, write_json

#: Version and fields of the file format.
VERSION, FIELDS = 1, {"path": str, "row_count": int, "size_bytes": int, "sha256": str}


class ManifestError(ValueError):
    pass


def inside(root: Path, relative: str) -> Path:
    """A path below root; absolute ones and steps upwards are errors."""
    parts = PurePosixPath(relative)
    if parts.is_absolute() or ".." in parts.parts or not parts.parts:
        raise ManifestError(f"unsafe path {relative!r}")
    return root.joinpath(*parts.parts)


def totals(artifacts: list[dict]) -> dict:
    return {"files": len(artifacts), "rows": sum(a["row_count"] for a in artifacts), "size_bytes": sum(a["size_bytes"] for a in artifacts)}


def validated(manifest: dict) -> dict:
    """The manifest, if its version, fields, paths and totals are right."""
    if manifest.get("schema_version") != VERSION or not isinstance(manifest.get("artifacts"), list) or not manifest.get("dataset_id"):
        raise ManifestError("not a manifest of version 1")
    for a in manifest["artifacts"]:
        if any(not isinstance(a.get(k), kind) for k, kind in FIELDS.items()) or a["size_bytes"] < 0 or a["row_count"] < 0:
            raise ManifestError(f"broken artifact {a.get('path')}")
        inside(Path(), a["path"])
    names = [a["path"] for a in manifest["artifacts"]]
    if len(set(names)) != len(names) or manifest.get("totals") != totals(manifest["artifacts"]):
        raise ManifestError("totals or paths do not agree")
    return manifest


def described(root: Path, path: Path, kind: str) -> dict:
    return {"path": path.relative_to(root).as_posix(), "kind": kind, "row_count": pq.read_metadata(path).num_rows, "size_bytes": path.stat().st_size, "sha256": sha256_file(path)}


def register(manifest: dict, root: Path, kind: str, files: list[Path]) -> dict:
    """Replace the artifacts of one kind and count again."""
    kept = [a for a in manifest.get("artifacts", []) if a.get("kind") != kind]
    artifacts = sorted([*kept, *(described(root, f, kind) for f in files)], key=lambda a: a["path"])
    return validated({"schema_version": VERSION, "dataset_id": manifest.get("dataset_id", root.name), "artifacts": artifacts, "totals": totals(artifacts)})


def faults(root: Path, manifest: dict, deep: bool = True) -> list[str]:
    """What is missing, changed or left over; empty if all is whole."""
    out = []
    for a in validated(manifest)["artifacts"]:
        path = inside(root, a["path"])
        if not path.is_file():
            out.append(f"missing {a['path']}")
        elif path.stat().st_size != a["size_bytes"] or deep and sha256_file(path) != a["sha256"]:
            out.append(f"changed {a['path']}")
        elif path.suffix == ".parquet" and pq.read_metadata(path).num_rows != a["row_count"]:
            out.append(f"wrong row count {a['path']}")
    return out + [f"unfinished {p.relative_to(root)}" for p in sorted(root.rglob("*.partial"))]


def copy_dataset(source: Path, target: Path, manifest: dict) -> dict:
    """Copy what the target lacks; files that are there and whole are skipped, others are errors. Counts of both.

    The target must be another folder, and empty or of the same data set.
    """
    if source.resolve() == target.resolve():
        raise ManifestError("source and target are the same")
    held = target / "manifest.json"
    if held.exists() and load(held)["dataset_id"] != manifest.get("dataset_id"):
        raise ManifestError("the target holds another data set")
    done = {"copied": 0, "skipped": 0}
    for a in validated(manifest)["artifacts"]:
        old, new = inside(source, a["path"]), inside(target, a["path"])
        if new.exists():
            if sha256_file(new) != a["sha256"]:
                raise ManifestError(f"{a['path']} differs in the target")
            done["skipped"] += 1
            continue
        new.parent.mkdir(parents=True, exist_ok=True)
        draft = new.with_name(new.name + ".partial")
        shutil.copyfile(old, draft)
        if sha256_file(draft) != a["sha256"]:
            draft.unlink()
            raise ManifestError(f"{a['path']} is not what the manifest says")
        draft.replace(new)
        done["copied"] += 1
    write_json(manifest, target / "manifest.json")
    return done


def load(path: Path) -> dict:
    return validated(json.loads(Path(path).read_text()))
