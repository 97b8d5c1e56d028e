"""This package, sent to the Python workers of a session."""

from __future__ import annotations

import atexit
import importlib.util
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_SHIPPED: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its session's Python workers can import this package: it is sent to them as a zip file."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(importlib.util.find_spec(__name__.partition(".")[0]).origin).parent
        folder = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "tablewright_workers.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return df
