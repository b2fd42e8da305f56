"""Parts of slash-separated paths, and the paths of the archive and the backup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """All before the last slash; ``/`` for a file in the root, ``.`` for a bare name."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(F.length(found) > 0, found).when(F.startswith(path, F.lit("/")), "/").otherwise(".")


def suffix(name: Column) -> Column:
    """Extension with its dot; empty for names like ``.hidden`` or ``name.``."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without a dot."""
    return F.lower(F.substring(suffix(file_name(path)), 2, 1_000_000))


def normalised_extension(ext: Column) -> Column:
    """Trimmed, lower-case, without one leading dot."""
    return F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")


def organized_path(root: Column, day: Column, event: Column, device: Column, path: Column) -> Column:
    """root/YYYY/YYYY-MM-DD_event/device/name"""
    return F.concat_ws("/", root, F.date_format(day, "yyyy"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), event), device, file_name(path))


def backup_path(backup: Column, root: Column, path: Column, preserve: bool = True) -> Column:
    """Below ``backup``: relative to ``root`` if the structure is preserved and the file lies in it, else the bare name."""
    base = F.concat(root, F.lit("/"))
    inside = F.startswith(path, base) if preserve else F.lit(False)
    return F.concat_ws("/", backup, F.when(inside, F.substr(path, F.length(base) + 1)).otherwise(file_name(path)))
