"""Where rows come from."""

from tessella.sources import files, media, remote

__all__ = ["files", "media", "remote"]
