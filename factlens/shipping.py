"""Make the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package's source to the executors, once for each application.

    Functions that run there are pickled by reference to their modules, so a worker
    started elsewhere, or without this package on its path, needs the files.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # it runs from such an archive already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="factlens-"), "factlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("factlens", os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
