"""Citation analytics over text tables, as DataFrame operations."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the Python workers, once, unless they find it by PYTHONPATH or in their working folder."""
    package = Path(__file__).resolve().parent
    root = package.parent
    if Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="citeloom-code-"), "citeloom.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
