"""Paths in their plain form and what can be read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any of: blanks or separators at an end, a backslash, an empty, "." or ".." segment.
_ODD = r"^[\s/]|\\|//|(^|/)\.\.?(/|$)|[\s/]$"


def _resolve(segments: Column) -> Column:
    """Segments without "." and empty ones, where each ".." has taken its predecessor."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, part))

    kept = F.filter(segments, lambda x: (x != "") & (x != "."))
    return F.when(F.array_contains(kept, ".."), F.aggregate(kept, F.array().cast("array<string>"), step)).otherwise(kept)


def plain_path(path: Column, root: Column | None = None) -> Column:
    """The plain form of a path: relative to ``root``, ``/`` between names, no blanks around, no detours.

    Null stays null; a path that is its root, or empty, gives ''. A path with a leading ``/`` that does not
    lie below ``root`` keeps its names without the leading ``/``. ``..`` above the root stays.
    The regular expression in front spares clean paths, which are most, the list functions.
    """
    s = F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/")
    whole = F.array_join(_resolve(F.split(s, "/")), "/")
    if root is not None:
        top = F.array_join(_resolve(F.split(F.translate(F.regexp_replace(root, r"^\s+|\s+$", ""), "\\", "/"), "/")), "/")
        inside = s.startswith("/") & (top != "")
        whole = (
            F.when(inside & (whole == top), F.lit(""))
            .when(inside & whole.startswith(F.concat(top, F.lit("/"))), F.substring(whole, F.length(top) + 2, F.length(whole)))
            .otherwise(whole)
        )
    return F.when(path.rlike(_ODD), whole).otherwise(path)


def base_name(path: Column) -> Column:
    """What follows the last ``/``."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """What precedes the last ``/``; '' for a name alone."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))
