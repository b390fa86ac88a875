"""Intermediate tables in the folder that all executors share, and names for added columns."""

from pyspark.sql import DataFrame

from sentrel.sources.scratch import Scratch, shared_dir, written

__all__ = ["Scratch", "free", "shared_dir", "written"]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
