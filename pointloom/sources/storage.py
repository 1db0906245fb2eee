"""Files of a shared folder as tasks open them: local and mounted paths, and the stores that pyarrow knows."""

from __future__ import annotations

import re

import pyarrow.fs


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; Hadoop writes local URIs with one slash."""
    local = re.match(r"file:(?://)?(/.*)", path)
    if local or path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), local[1] if local else path
    return pyarrow.fs.FileSystem.from_uri(path)
