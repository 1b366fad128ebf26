"""Imports and functions of source text, by one regular expression a language.

A parser is not at hand in the JVM, so what is found is a ``mixed`` source, never an authoritative one. The
expressions run inside the scan; a text is looked through once for imports and once for functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.text import language

#: Imports of a language: the expression and its group.
IMPORTS = {
    "go": r'(?m)^(?:import\s+(?:[\w.]+\s+)?|\t(?:[\w.]+\s+)?)"([^"\n]+)"\s*$',
    "python": r"(?m)^\s*(?:import|from)\s+([\w.]+)",
    "javascript": r"(?:\bfrom\s+|\bimport\s+|\brequire\s*\(\s*)[\"']([^\"'\n]+)[\"']",
    "typescript": r"(?:\bfrom\s+|\bimport\s+|\brequire\s*\(\s*)[\"']([^\"'\n]+)[\"']",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([^;{]+)[;{]",
    "ruby": r"(?m)^\s*require(?:_relative)?\s+[\"']([^\"'\n]+)[\"']",
    "c": r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",
    "cpp": r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "kotlin": r"(?m)^\s*import\s+([\w.]+)",
    "scala": r"(?m)^\s*import\s+([\w.]+)",
    "swift": r"(?m)^\s*import\s+([\w.]+)",
    "csharp": r"(?m)^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    "php": r"(?m)^\s*(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"'\n]+)[\"']",
    "bash": r"(?m)^\s*(?:source|\.)\s+(\S+)",
    "lua": r"\brequire\s*\(?\s*[\"']([^\"'\n]+)[\"']",
    "elixir": r"(?m)^\s*(?:import|alias|use|require)\s+([\w.]+)",
    "solidity": r"(?m)^\s*import\s+[^;\"']*[\"']([^\"'\n]+)[\"']",
}

#: Functions of a language. Languages that are not here have none extracted.
FUNCTIONS = {
    "go": r"(?m)^func\s+(?:\([^)\n]*\)\s*)?(\w+)\s*\(",
    "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "javascript": r"\bfunction\s+(\w+)\s*\(",
    "typescript": r"\bfunction\s+(\w+)\s*[(<]",
    "rust": r"\bfn\s+(\w+)",
    "ruby": r"(?m)^\s*def\s+([\w.]+[?!=]?)",
    "c": r"(?m)^\w[\w \t*]*?[ \t*](\w+)\s*\([^;{}()]*\)\s*\{",
    "cpp": r"(?m)^\w[\w \t*&:<>]*?[ \t*&](\w+)\s*\([^;{}()]*\)\s*\{",
    "java": r"(?m)^\s+(?:[\w<>\[\],.]+\s+)+(\w+)\s*\([^;{}()]*\)\s*\{",
    "csharp": r"(?m)^\s+(?:[\w<>\[\],.]+\s+)+(\w+)\s*\([^;{}()]*\)\s*\{",
    "swift": r"\bfunc\s+(\w+)",
    "kotlin": r"\bfun\s+(?:<[^>\n]*>\s*)?(\w+)",
    "bash": r"(?m)^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{",
}


def _found(text: Column, lang: Column, table: dict[str, str]) -> Column:
    out = F.array().cast("array<string>")
    for name, regex in table.items():
        out = F.when(lang == name, F.regexp_extract_all(text, F.lit(regex), 1)).otherwise(out)
    return F.array_distinct(F.transform(out, lambda x: F.trim(x)))


def analyses(files: DataFrame) -> DataFrame:
    """(path, language, imports, functions) of each file of a known language; ``files``: path, content and what else is to stay."""
    lang = language(F.col("path"))
    text = F.coalesce("content", F.lit(""))
    rest = [c for c in files.columns if c not in ("path", "content", "language", "imports", "functions")]
    return files.filter(lang.isNotNull()).select(*rest, "path", lang.alias("language"), _found(text, lang, IMPORTS).alias("imports"), _found(text, lang, FUNCTIONS).alias("functions"))


def go_fallback(files: DataFrame) -> DataFrame:
    """(path, imports, functions, skipped) of Go files where no parser told anything: functions without receivers only.

    A file without a package clause, or with braces that do not match, cannot be read: it has neither and counts as skipped.
    """
    bare = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'", "")
    n = lambda c: F.length(bare) - F.length(F.translate(bare, c, ""))
    ok = bare.rlike(r"(?m)^\s*package\s+\w+") & (n("{") == n("}")) & (n("(") == n(")"))
    text, none = F.coalesce("content", F.lit("")), F.array().cast("array<string>")
    go = files.filter(language(F.col("path")) == "go")
    return go.select(
        *[c for c in files.columns if c not in ("content", "imports", "functions", "skipped")], F.when(ok, _found(text, F.lit("go"), {"go": IMPORTS["go"]})).otherwise(none).alias("imports"),
        F.when(ok, _found(text, F.lit("go"), {"go": r"(?m)^func\s+(\w+)\s*[(\[]"})).otherwise(none).alias("functions"), (~ok).alias("skipped"),
    )


def recovered(analysed: DataFrame, key: list[str]) -> DataFrame:
    """(key, status, detail): the outcome of :func:`go_fallback` as a source of coverage."""
    one = analysed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("skipped")).alias("ok"))
    detail = F.format_string("recovered %d of %d files", F.col("ok"), F.col("n"))
    return one.select(*key, F.when(F.col("ok") > 0, "fallback").otherwise("unavailable").alias("status"), detail.alias("detail"))


def import_path(text: Column) -> Column:
    """What an import statement of any language names; '' if it is none.

    A header in angle brackets, a sourced script, the first quoted text, a C# using (also static or by
    alias), the word after ``import`` or ``from``, the root of a Rust ``use``: the first that fits. A
    Java name loses its semicolon.
    """
    t = F.trim(text)
    tries = [
        F.when(t.startswith("#include"), F.regexp_extract(t, r"<([^>]+)>", 1)), F.when(t.rlike(r"^(source|\.) "), F.regexp_extract(t, r"^\S+\s+(\S+)", 1)),
        F.regexp_extract(t, r'"([^"]+)"', 1), F.regexp_extract(t, r"'([^']+)'", 1), F.regexp_extract(t, r"`([^`]+)`", 1),
        F.when(t.startswith("using "), F.regexp_extract(t, r"^using\s+(?:static\s+)?(?:[^=]*=)?\s*([^;]*?)\s*;?$", 1)),
        F.when(t.startswith("import ") | t.startswith("from "), F.regexp_extract(t, r"^\w+\s+([^\s;]+)", 1)), F.when(t.startswith("use "), F.regexp_extract(t, r"^use\s+([^:;]+)", 1)),
    ]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in tries], F.lit(""))


def function_name(text: Column, lang: Column) -> Column:
    """The name in the head of a function of a language; '' if there is none."""
    t = F.trim(text)
    before = F.trim(F.regexp_extract(t, r"^([^(]+)\(", 1))
    last = F.regexp_extract(before, r"(\S+)$", 1)
    identifier = r"^[A-Za-z_]\w*$"
    method = F.regexp_replace(before, r"^(?:(?:public|private|protected|static|readonly|async|get|set|override) )+", "")
    js = F.when(t.contains("function "), F.regexp_extract(t, r"function +([^(]*?)\s*\(", 1)).when(method.rlike(identifier) & ~method.isin("if", "for", "while", "switch", "catch"), method).otherwise("")
    c = F.regexp_replace(last, r"^\*+", "")
    plain = F.regexp_replace(before, "^function ", "")
    return (
        F.when(lang == "go", F.regexp_extract(t, r"^func (?:\([^)]*\)\s*)?([^(]+)\(", 1)).when(lang.isin("javascript", "typescript"), js).when(lang == "python", F.regexp_extract(t, r"^def ([^(]+)\(", 1))
        .when(lang == "rust", F.regexp_extract(t, r"fn ([^(<]+)[(<]", 1)).when(lang.isin("java", "csharp"), last).when(lang == "ruby", F.regexp_extract(t, r"^def ([^(\s]+)", 1))
        .when(lang.isin("swift", "kotlin"), F.trim(F.regexp_extract(t, r"(?:func|fun) ([^(<]+)[(<]", 1))).when(lang.isin("c", "cpp"), F.when(c.rlike(identifier), c).otherwise("")).when(lang == "bash", F.when(plain.rlike(identifier), plain).otherwise(""))
        .otherwise("")
    )
