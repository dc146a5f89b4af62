"""A PySpark-native engine for analysing, searching and filing document archives."""

from __future__ import annotations

import os


def importable(spark) -> None:
    """Let Python workers that start from now on import this package from where the driver has it.

    On one machine, or with a shared folder, nothing else is needed; a cluster
    without one gets the package by ``--py-files``.
    """
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])
