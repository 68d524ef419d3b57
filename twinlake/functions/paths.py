"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last component; trailing slashes are stripped, an empty path is ``.`` and only slashes are ``/``."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(path == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def extension(path: Column) -> Column:
    """From the last dot of the base name on, lower-cased; empty if it has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def parts_below(path: Column, root: Column) -> Column:
    """The components of ``path`` below ``root``."""
    rest = F.substring(path, F.char_length(F.rtrim(root, F.lit("/"))) + 2, F.char_length(path))
    return F.split(rest, "/")


def is_symlink(mode: Column) -> Column:
    """Whether the mode of a scanned entry is that of a symbolic link."""
    return mode.bitwiseAND(F.lit(0o170000)) == 0o120000


def is_at_or_below(path: Column, folder: str) -> Column:
    """Equal to ``folder`` or inside it, by whole components."""
    folder = folder.rstrip("/")
    return (path == (folder or "/")) | path.startswith(folder + "/")
