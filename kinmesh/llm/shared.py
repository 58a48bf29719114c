"""What the corpus operators share: the word rule, and the library's tables in the shared folder."""

from __future__ import annotations

from kinmesh.functions.expressions import let
from kinmesh.storage import drop, keep, kept_path, partitions, table

__all__ = ["SPACES", "WORD", "drop", "keep", "kept_path", "let", "partitions", "table"]

#: Words are runs of other characters than these: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
