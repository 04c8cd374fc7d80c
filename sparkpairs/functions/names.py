"""Names for helper columns that no column of the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(frame: DataFrame | list[DataFrame], *bases: str, taken: tuple[str, ...] = ()) -> list[str]:
    """``bases`` with underscores added until no column of ``frame`` and none of ``taken`` has the name (compared without case)."""
    frames = frame if isinstance(frame, list) else [frame]
    used = {c.lower() for f in frames for c in f.columns} | {c.lower() for c in taken}
    out = []
    for name in bases:
        while name.lower() in used:
            name = f"{name}_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"
