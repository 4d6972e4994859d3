"""Paths for `pyarrow.fs`, from the names that Spark users give."""

import pyarrow.fs


def native(uri: str) -> str:
    """A path whose scheme only Hadoop knows, under the store's own name; other paths as they are."""
    scheme, colon, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        return "s3" + colon + rest
    if scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    return uri


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(native(uri).replace(" ", "%20") if ":" in uri else uri)
