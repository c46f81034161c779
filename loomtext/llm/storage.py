"""Names that clash with none, and the tables between steps."""

from __future__ import annotations

from loomtext.storage import discard, shared_dir, written

__all__ = ["discard", "fresh", "shared_dir", "written"]


def fresh(taken, *names: str) -> list[str]:
    """Column names that clash with none of ``taken`` (compared without case, as Spark does)."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        pick = f"__{name}"
        while pick.lower() in have:
            pick += "_"
        have.add(pick.lower())
        out.append(pick)
    return out
