"""The registered queries of the core with their reference SQL."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from pathlib import Path

from arborine.plans import core, problems

_shipped: set[str] = set()


def queries() -> dict:
    return {**core.QUERIES, **problems.QUERIES}


def oracle_sql() -> dict:
    return {**core.ORACLE, **problems.ORACLE}


def ship(spark) -> None:
    """Add the package to the workers' Python path, once per application; workers of a local session need it too."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(importlib.util.find_spec("arborine").origin).parent
    target = Path(tempfile.mkdtemp(prefix="arborine-zip-")) / "arborine.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("arborine", p.relative_to(root)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
