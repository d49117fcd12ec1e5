"""Workspaces: a folder with a manifest and one subtree of each kind."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

# The kinds of subtrees.
KINDS = ("literature", "assets", "notes", "annotations", "reading", "search", "imports", "settings")


def create(root: str, title: str) -> dict:
    """A new workspace in a folder that is not there, moved to its place when complete."""
    if os.path.exists(root):
        raise FileExistsError(root)
    staging = f"{root}.building-{uuid.uuid4().hex}"
    now = int(time.time() * 1000)
    manifest = {"schema_version": 1, "workspace_id": uuid.uuid4().hex, "title": title, "subtrees": [{"kind": k, "directory": k, "state": "ready"} for k in KINDS], "created_at_ms": now, "updated_at_ms": now}
    try:
        for k in KINDS:
            os.makedirs(os.path.join(staging, k))
        with open(os.path.join(staging, "workspace.json"), "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.rename(staging, root)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return manifest


def open_(root: str) -> dict:
    """The manifest, with the subtrees whose folder is missing as degraded."""
    with open(os.path.join(root, "workspace.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    for s in manifest["subtrees"]:
        s["state"] = "ready" if os.path.isdir(os.path.join(root, s["directory"])) else "degraded"
    return manifest


def migrate(legacy: str, root: str, title: str, backup: str) -> dict:
    """A workspace from a legacy folder: a backup first, then a new workspace with the folders that it knows."""
    from .sources.sinks import backup as zipped

    zipped(legacy, backup)
    manifest = create(root, title)
    for k in KINDS:
        if os.path.isdir(os.path.join(legacy, k)):
            shutil.copytree(os.path.join(legacy, k), os.path.join(root, k), dirs_exist_ok=True)
    return manifest
