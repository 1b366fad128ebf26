"""Scalar expressions on names, sizes and texts."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions.dims import EXTENSIONS, FAMILIES, UNNAMED
from arborlens.functions.paths import base_name


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def extension(path: Column) -> Column:
    """From the last dot of the name on; '' without one."""
    return F.regexp_extract(base_name(path), r"\.[^.]*$", 0)


def language(path: Column) -> Column:
    """The language of a path by its extension, null if unknown."""
    return _lookup(EXTENSIONS, F.lower(extension(path)))


def family(lang: Column) -> Column:
    """Languages of one family may import each other; null for an unknown language."""
    known = _lookup({x: FAMILIES.get(x, x) for x in EXTENSIONS.values()}, lang)
    return known


def is_test(path: Column) -> Column:
    """Whether a name is that of a test: ``x_test.go``, ``test_x.py``, ``x.test.*``, ``x.spec.*``."""
    return F.lower(base_name(path)).rlike(r"_test\.go$|^test_.*\.py$|\.(test|spec)\.[^.]*$|\.(test|spec)$")


def human_size(n: Column) -> Column:
    """Bytes as a number with one decimal and a unit of 1024."""
    out = F.format_string("%.1f%s", n / 1024, F.lit("KB"))
    for k, unit in ((2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**k, F.format_string("%.1f%s", n / 1024**k, F.lit(unit))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.1f%s", n.cast("double"), F.lit("B"))).otherwise(out)


def cut_at_line(text: Column, most: int, note: str = "\n\n... (truncated)\n") -> Column:
    """A text of more than ``most`` bytes, cut there, or at the last line end within the final 1000 bytes, with a note."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    kept = F.make_valid_utf8(raw.cast("string"))
    # a letter cut in two becomes a replacement mark, which goes
    kept = F.regexp_replace(kept, "�+$", "")
    tail = F.regexp_extract(kept, r"\n[^\n]*\z", 0)
    at_line = (tail != "") & (F.octet_length(kept) - F.octet_length(tail) > max(most - 1000, 0))
    short = F.when(at_line, F.length(kept) - F.length(tail)).otherwise(F.length(kept))
    return F.when(F.octet_length(text) > most, F.concat(F.left(kept, short), F.lit(note))).otherwise(text)


def first_letters(text: Column, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters; a mark takes the last place where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit(mark))).otherwise(text)


def title(text: Column) -> Column:
    """Each word with its first letter in upper case, the rest as it is, one blank between words."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def system_name(directory: Column) -> Column:
    """What a directory is about: its first telling part, in words."""
    parts = F.split(F.translate(directory, "\\", "/"), "/")
    telling = F.filter(parts, lambda p: ~F.lower(p).isin(*UNNAMED))
    name = F.when(F.size(telling) > 0, F.translate(F.try_element_at(telling, F.lit(1)), "_-", "  ")).otherwise(F.element_at(parts, -1))
    return title(name)


def plain_text(text: Column) -> Column:
    """Without terminal colours and other control sequences: ``ESC [ ... letter`` and ``ESC ] ... BEL``."""
    return F.regexp_replace(text, "\u001b(?:\\[[0-9;?]*[a-zA-Z]|\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\))", "")


def is_transient(path: Column) -> Column:
    """Whether a name is that of a build tool's temporary file, which comes and goes within milliseconds."""
    return F.contains(base_name(path), F.lit(".timestamp-"))


def is_source(path: Column) -> Column:
    """Whether a path has the extension of a known language and is not transient."""
    return language(path).isNotNull() & ~is_transient(path)


def control(path: Column, config: str = ".arborlens/config.json") -> Column:
    """What a change of a file means for the watch itself: ``ignores`` or ``config`` are to be read anew; null for data."""
    return F.when(base_name(path) == ".gitignore", "ignores").when(path == config, "config")


def rust_strings(text: Column) -> Column:
    """The contents of Rust string literals, plain and raw (up to three hashes), in order; escapes stay as written."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)(r###".*?"###|r##".*?"##|r#".*?"#|r"[^"]*"|"(?:[^"\\]|\\.)*")'), 1)
    return F.transform(found, lambda s: F.regexp_replace(s, r'(?s)^(?:r#*)?"|"#*$', ""))


def mentions(text: Column, most: int | None = None) -> Column:
    """File names in a text: longer extensions first, then by place, each once."""
    exts = sorted({e[1:] for e in EXTENSIONS}, key=lambda e: (-len(e), e))
    # a name lies within a run of its letters: only runs with a dot are looked through for each extension
    runs = F.array_join(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9_/.@-]+\.[a-zA-Z][a-zA-Z0-9_/.@-]*)"), 1), " ")
    # bound by a lambda, the runs are found once and not anew for each extension
    each = F.transform(F.array(runs), lambda r: F.array(*[F.regexp_extract_all(r, F.lit(rf"([a-zA-Z0-9_/.@-]+\.{e}\b)"), 1) for e in exts]))
    found = F.array_distinct(F.flatten(F.element_at(each, 1)))
    return found if most is None else F.slice(found, 1, most)


def lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(text, "\n")


def excerpt(text: Column, line: Column, radius: int) -> Column:
    """The lines around a line (from 1), each with its number in four places and a bar."""
    all_lines = lines(text)
    first = F.greatest(line - radius, F.lit(1))
    last = F.least(line + radius, F.size(all_lines))
    return F.array_join(F.transform(F.sequence(first, last), lambda n: F.concat(F.lpad(n.cast("string"), 4, " "), F.lit(" | "), F.element_at(all_lines, n.cast("int")))), "\n")


def glob_regex(glob: str) -> str:
    """The regular expression of a simple glob: ``*`` and ``?`` do not cross ``/``."""
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)
    return f"^{out}$"


def matches_pattern(path: Column, pattern: str) -> Column:
    """A glob on the name or path; else an extension in any case, or a directory or file name within the path."""
    if "*" in pattern or "?" in pattern:
        return base_name(path).rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern))
    ending = "." + pattern.removeprefix(".").lower()
    return F.lower(path).endswith(ending) | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{pattern}/")


def passes(path: Column, ext: Column, only: list[str], exclude: list[str]) -> Column:
    """Whether a file passes an allow-list of extensions and a list of excluded patterns; empty lists pass all."""
    ok = F.lit(True)
    allowed = [o.strip().removeprefix(".").lower() for o in only]
    if allowed:
        ok = ok & F.lower(F.regexp_replace(ext, r"^\.", "")).isin(*allowed)
    for pattern in (p.strip() for p in exclude):
        if pattern:
            ok = ok & ~matches_pattern(path, pattern)
    return ok


def skill_path(pattern: Column, path: Column) -> Column:
    """A pattern column on a path column: substring without a glob, else the whole path or the name."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*+", "[^/]*"), r"\?", "[^/]"), F.lit("$"))
    return F.when(pattern.rlike(r"[*?]"), F.regexp_like(path, regex) | F.regexp_like(base_name(path), regex)).otherwise(F.contains(path, pattern))
