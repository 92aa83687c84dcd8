"""Collection paths and plain paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOLUME = "Macintosh HD"


def location_to_path(folder: Column, file: Column) -> Column:
    """``/:a/:b/:`` and a file name as ``/a/b/file``."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(folder), "^/:", ""), "/:$", "")
    return F.concat(F.when(inner != "", F.concat(F.lit("/"), F.replace(inner, F.lit("/:"), F.lit("/")))).otherwise(F.lit("")), F.lit("/"), file)


def path_to_location(path: Column, volume: str = VOLUME) -> Column:
    """The struct (dir, file, volume, volumeid) of a path; the root folder is ``/:``."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    folder = F.when(F.size(folders) > 0, F.concat(F.lit("/:"), F.array_join(folders, "/:"), F.lit("/:"))).otherwise(F.lit("/:"))
    return F.struct(folder.alias("dir"), F.element_at(parts, -1).alias("file"), F.lit(volume).alias("volume"), F.lit(volume).alias("volumeid"))


def key_to_path(key: Column, volume: str = VOLUME) -> Column:
    """A playlist key ``Volume/:a/:file`` as ``/a/file``; empty parts vanish."""
    rest = F.when(key.startswith(volume), F.substring(key, len(volume) + 1, 1 << 30)).otherwise(key)
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(rest, "/:"), lambda p: p != ""), "/"))


def any_key_to_path(key: Column) -> Column:
    """Like :func:`key_to_path` for any volume: everything before the first ``/:`` is the volume; keys with plain slashes are kept."""
    at = F.locate("/:", key)
    cut = F.when(at > 0, F.substr(key, at)).otherwise(key)
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(cut, "/:?"), lambda p: p != ""), "/"))


def path_to_key(path: Column, volume: str = VOLUME) -> Column:
    return F.concat(F.lit(f"{volume}/:"), F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/:"))


def folder_after(path: Column, root: str) -> Column:
    """The component after the folder ``root``, else the last folder."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root)
    return F.when((at > 0) & (at + 1 < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(-2)))


def re_anchor(path: Column, root: str, new_root: str) -> Column:
    """The components after ``root`` (any case) below ``new_root``; null if the path does not lie in it."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), root.lower())
    return F.when(at > 0, F.concat(F.lit(new_root.rstrip("/") + "/"), F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "/")))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the folders or lies in one."""
    hit = F.lit(False)
    for r in roots:
        hit = hit | (path == r) | path.startswith(r.rstrip("/") + "/")
    return hit


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
