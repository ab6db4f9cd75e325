"""Landing files, manifests and the pointer to the latest run. Paths are on storage that all workers share."""

from __future__ import annotations

import json
import os


def land(path: str, content: bytes) -> None:
    """Written beside, then renamed: no reader sees half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)


def manifest(path: str, **fields) -> None:
    land(path, json.dumps(fields, indent=1, sort_keys=True, default=str).encode())


def link_latest(run: str) -> None:
    """``latest`` beside the run, where links can be made."""
    link = os.path.join(os.path.dirname(run), "latest")
    try:
        if os.path.islink(link):
            os.unlink(link)
        os.symlink(os.path.basename(run), link)
    except OSError:
        pass


def find_root(start: str) -> str:
    """The nearest folder at or above ``start`` that is a repository; ``start`` itself if none is."""
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if (up := os.path.dirname(at)) == at:
            return os.path.abspath(start)
        at = up
    return at
