"""Folders by their address, in any store that Arrow knows."""

from __future__ import annotations

from pyarrow import fs


def store_at(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, by its address, and the folder's path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
