"""Column names for an operator's own use that its input does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(frames: DataFrame | list[DataFrame], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it unlike every column of the frames and unlike the
    names before it, whatever their case."""
    taken = {c.lower() for df in ([frames] if isinstance(frames, DataFrame) else frames) for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
