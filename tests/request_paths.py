"""Paths that the tests of the request library share (a module name of its own: ``conftest`` exists twice)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def local_dir(uri: str) -> str:
    """Local filesystem path of a ``file:`` URI (test helpers write files)."""
    return uri[len("file:"):] if uri.startswith("file:") else uri
