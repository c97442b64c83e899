"""Functions of paths, names and listing predicates, all as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.schema import CLASS_OF_EXTENSION, DECODABLE


def file_name(path: Column) -> Column:
    return F.substring_index(normal_slashes(path), "/", -1)


def normal_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """Trimmed lower-case extension; "" without one.  A name that only begins with a dot has none."""
    return F.lower(F.trim(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)))


def stem(path: Column) -> Column:
    """Trimmed lower-case name without its extension."""
    return F.lower(F.trim(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")))


def file_class(ext: Column) -> Column:
    by_class: dict[str, list[str]] = {}
    for name, kind in CLASS_OF_EXTENSION.items():
        by_class.setdefault(kind, []).append(name)
    out = F.lit("other")
    for kind, names in by_class.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    return out


def needs_sha256(kind: Column) -> Column:
    return kind.isin("image", "raw_image", "video")


def needs_visual(kind: Column) -> Column:
    return kind == "image"


def is_supported_image(ext: Column) -> Column:
    return ext.isin([e for e, k in CLASS_OF_EXTENSION.items() if k in ("image", "raw_image")])


def can_decode(ext: Column) -> Column:
    return ext.isin(list(DECODABLE))


_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_key(path: Column) -> Column:
    """Identity of a path: forward slashes, trimmed, ASCII letters in lower case; others stay."""
    return F.translate(F.trim(normal_slashes(path)), *_ASCII)


def root_key(path: Column) -> Column:
    key = path_key(path)
    return F.when(key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))


def display_path(path: Column) -> Column:
    """Without a long-path prefix."""
    return F.regexp_replace(path, r"^(//\?/|\\\\\?\\)", "")


def directory(path: Column) -> Column:
    """/parent/ of a path, "" without a parent."""
    parent = F.get(F.split(normal_slashes(path), "/"), F.size(F.split(normal_slashes(path), "/")) - 2)
    return F.when(parent.isNull() | (parent == ""), F.lit("")).otherwise(F.concat(F.lit("/"), parent, F.lit("/")))


def parent(path: Column) -> Column:
    return F.regexp_replace(normal_slashes(path), r"/?[^/]*$", "")


def format_name(ext: Column) -> Column:
    return F.when(ext.isin("jpg", "jpeg"), "JPEG").when(ext == "", F.lit(None)).otherwise(F.upper(ext))


def megapixels_at_least(width: Column, height: Column, megapixels: float) -> Column:
    return width.cast("long") * height.cast("long") >= F.lit(int(megapixels * 1e6))


def contains_folded(column: Column, query: str) -> Column:
    """LIKE '%query%' with ASCII letters folded; % and _ in the query keep their meaning."""
    pattern = query.strip()
    plain = "".join(c.lower() if c.isascii() else c for c in pattern)
    return F.translate(column, *_ASCII).like(f"%{plain}%")


def text_filter(query: str, *columns: Column) -> Column:
    """Trimmed lower-case containment in any of the columns; an empty query holds."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    out = F.lit(False)
    for column in columns:
        out = out | F.coalesce(F.lower(column).contains(wanted), F.lit(False))
    return out


def ids_from_json(column: Column) -> Column:
    """Array of ids; [] for what is no such array."""
    return F.coalesce(F.from_json(column, "array<bigint>"), F.array().cast("array<bigint>"))


def ids_to_json(column: Column) -> Column:
    """JSON text of an array of ids; that of none for null."""
    return F.to_json(F.coalesce(column, F.array().cast("array<bigint>")))
