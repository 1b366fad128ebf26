"""Source that was not written by hand in its project: generated, minified, vendored, data saved as code.

Repositories may declare such paths in attribute files. Each line's glob is compiled to a regular expression
below its directory; of all lines that match a path, the one in the deepest directory, and there the last, decides
an attribute. Repositories without attribute files get equivalent patterns, mined from the corpus: names of directories,
endings and names of files that repositories with attribute files declare as a rule (:func:`mined`), and names of copied
packages, which carry an upstream notice wherever they lie. Last comes the fixed list below, read as an attribute file at
the top. What paths leave open is decided by a file's text: notices in its first lines and leading comments, and the shape
of its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.paths import base_name, dir_name, plain_path
from arborlens.scratch import cut

#: The patterns that stand for an attribute file where a repository has none.
EQUIVALENT = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/jspm_packages/** linguist-vendored
**/vendor/** linguist-vendored
**/vendored/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/3rdparty/** linguist-vendored
**/3rd-party/** linguist-vendored
**/Pods/** linguist-vendored
**/Carthage/** linguist-vendored
**/site-packages/** linguist-vendored
**/Godeps/** linguist-vendored
**/external/*-[0-9]*/** linguist-vendored
**/deps/*/[0-9]*/** linguist-vendored
**/generated/** linguist-generated
**/__generated__/** linguist-generated
**/autogen/** linguist-generated
**/gen/** linguist-generated
**/build/stubs/** linguist-generated
**/dist/** linguist-generated
*.min.js linguist-generated
*.min.ts linguist-generated
*.min.css linguist-generated
*-min.js linguist-generated
*-min.ts linguist-generated
*-min.css linguist-generated
*.bundle.js linguist-generated
*.bundle.ts linguist-generated
*.pb.go linguist-generated
*.pb.gw.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*_pb.rb linguist-generated
*Grpc.java linguist-generated
*.generated.* linguist-generated
*.gen.* linguist-generated
*.g.cs linguist-generated
*.g.dart linguist-generated
*.Designer.cs linguist-generated
*_generated.go linguist-generated
*_gen.go linguist-generated
zz_generated.* linguist-generated
*.designer.cs linguist-generated
*.freezed.dart linguist-generated
"""

#: Notices by which programs and upstream projects mark their files.
_COMMENT = r"(?im)^[ \t]*(?:<\?php[ \t]*)?(?://+!?|#+|/\*+!?|\*|--|;|<!--|\"\"\"|')[ \t]*"
_BY_PROGRAM = _COMMENT + (
    r"(?:[^\n\"'`]*?(?:@generated\b|<auto-?generated|\bauto-?generated\b|\bcode generated\b|\bgenerated (?:by|from|file|code|automatically|with|using)\b"
    r"|\bautomatically (?:created|generated|produced|written)\b|\bautomatisch\b[^\n]*\b(?:erzeugt|generiert|gegenereerd)\b|\bg[eé]n[eé]r[eé] (?:automatiquement|par)\b|\bgenerado autom|\bgerado autom"
    r"|\bmachine[- ](?:made|generated|written)\b|\bdo not (?:edit|modify|change|touch)\b|\bchanges will be (?:lost|overwritten)\b|\bedits are overwritten\b)"
    r"|source: [\w./-]+\.(?:def|proto|schema|thrift|idl|fbs|graphql|yaml|yml|json|xsd|wsdl)\s*(?:\*/)?\s*$)"
)
_BY_OTHERS = _COMMENT + (
    r"(?:[^\n]*\(c\) [^\n]*\b(?:contributors|authors)\b|[^\n]*\bupstream: ?\S+|part of [\w.-]+ v?\d+(?:\.\d+)+\b|[^\n]*\bcopied (?:unchanged |verbatim )?from [\w.-]+ v?\d+(?:\.\d+)+"
    r"|[\w.-]+ v\d+(?:\.\d+)+ \| )"
)
#: The comments, of any length, that a text begins with: a notice may follow a licence. Possessive, so that long ones need no stack.
_HEADER = (
    r"^\ufeff?(?:[ \t]*(?:\r?\n|<\?php[^\n]*(?:\n|$)|/\*(?s:.*?)\*/[^\n]*(?:\n|$)|<!--(?s:.*?)-->[^\n]*(?:\n|$)|\"\"\"(?s:.*?)\"\"\"[^\n]*(?:\n|$)|'''(?s:.*?)'''[^\n]*(?:\n|$)"
    r"|(?://|#(?!include|define|import)|\*|--|;|')[^\n]*(?:\n|$)))*+"
)
#: A line of values only: numbers, bytes, one long word in quotes, separated fields that begin with a number.
_VALUES = r"^\s*(?:(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)\s*[,;]?\s*){4,}|\"[A-Za-z0-9+/=]{40,}\"[,;]?|\d+(?:[;,|\t][^\s;,|\t]*){2,})\s*$"
#: Dense code: most of the text lies in lines of so many letters, or lines are long on average and hold hardly a blank.
WIDE_LINE, WIDE_SHARE, LONG_MEAN, FEW_BLANKS = 200, 0.5, 100, 0.15
#: A text counts as data if so many of its lines, and this share, hold values only.
DATA_LINES, DATA_SHARE = 8, 0.7
#: A package name is mined from files in so many repositories, of which this share carries an upstream notice.
MINED_ROOTS, MINED_SHARE = 3, 0.8
#: A part of paths stands for its attribute if so many repositories declare files with it, and this share of its files is declared.
SHARED_ROOTS, SHARED_SHARE = 3, 0.9


def glob_regex(glob: str) -> str | None:
    """The regular expression, for a path below the attribute file's directory, of one of its globs; None if it matches no file."""
    if glob.endswith("/"):  # names a directory itself, and attributes of directories are not passed on
        return None
    anywhere = "/" not in glob  # a slash inside or in front ties a glob to its directory
    glob = glob.removeprefix("/")
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            turned = body[:1] in "!^"
            body = re.sub(r"([\\\[\]&~|])", r"\\\1", body[turned:])
            out.append("(?!/)[" + "^" * turned + body + "]")
            i = end + 1
        else:
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            out.append(re.escape(glob[i]))
            i += 1
    return ("^(?:.*/)?" if anywhere else "^") + "".join(out) + "$"


_LINE = re.compile(r'[ \t]*(?:"((?:[^"\\]|\\.)*)"|(\S+))[ \t]*(.*)')


def parse_attributes(text: str | None) -> list[tuple[int, str, str, str, bool | None]]:
    """(line, glob, regex, attribute, on) of the lines of an attribute file that say anything of generated or vendored paths.

    ``on`` is null where a line makes the attribute unspecified again (``!name``). Comments, negative globs and globs that
    match no file are left out.
    """
    out = []
    for n, line in enumerate((text or "").split("\n")):
        m = _LINE.match(line.rstrip("\r"))
        if not m or (m[2] or "").startswith(("#", "!", "[attr]")):
            continue
        glob = re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]
        regex = glob_regex(glob)
        for a in m[3].split() if regex else ():
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                out.append((n, glob, regex, name[9:], None if a.startswith("!") else not a.startswith("-") and value.lower() not in ("false", "0")))
    return out


def attribute_rules(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(root, dir, line, glob, regex, attribute, on) of all attribute files; ``files`` has root, path (plain), file_id."""
    own = files.filter(base_name(F.col("path")) == ".gitattributes").select("file_id", "root", dir_name(F.col("path")).alias("dir"))
    texts = contents.filter(F.contains("content", F.lit("linguist-"))).select("file_id", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(root, at, *r) for root, at, text in zip(*(c.to_pylist() for c in b.columns)) for r in parse_attributes(text)]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["root", "dir", "line", "glob", "regex", "attribute", "on"])

    schema = "root string, dir string, line int, glob string, regex string, attribute string, on boolean"
    return own.join(texts, "file_id").select("root", "dir", "content").mapInArrow(work, schema).distinct()


def declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, generated, vendored): what attribute files say of each path they match; null where they are silent.

    A path meets the rules of the directories above it by equality, never by comparing it with all rules.
    """
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    met = files.select("file_id", "root", "path", F.explode(above).alias("dir")).join(rules, ["root", "dir"])
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    met = met.withColumn("below", below).filter(F.expr("below rlike regex"))
    order = F.struct(F.length("dir"), "line")
    of = lambda a: F.max_by(F.when(F.col("attribute") == a, F.col("on")), F.when(F.col("attribute") == a, order)).alias(a)
    return met.groupBy("file_id").agg(of("generated"), of("vendored"))


def traits(path: Column) -> Column:
    """The parts of a path that may stand for an attribute: names of directories, of the file, and its endings."""
    name = base_name(path)
    folders = F.transform(F.filter(F.split(dir_name(path), "/"), lambda d: d != ""), lambda d: F.concat(F.lit("in "), d))
    ends = F.filter(F.array(*[F.regexp_extract(name, r, 1) for r in (r"^[^.]+(\.[^.]+\..+)$", r"([-_.][^-_.]+\.[^.]+)$", r"^.+(\.[^.]+)$")]), lambda e: e != "")
    return F.array_distinct(F.concat(folders, F.transform(ends, lambda e: F.concat(F.lit("ends "), e)), F.array(F.concat(F.lit("is "), name))))


def globs_traits(glob: Column) -> Column:
    """The trait that a glob says by itself, wherever its repository has such files; null for other globs."""
    folder, ends, name = (F.regexp_extract(glob, r, 1) for r in (r"^(?:/|\*\*/)?([^/*?\[\]\\]+)/\*\*$", r"^\*([-_.][^/*?\[\]\\]+)$", r"^([^/*?\[\]\\]+)$"))
    return F.when(folder != "", F.concat(F.lit("in "), folder)).when(ends != "", F.concat(F.lit("ends "), ends)).when(name != "", F.concat(F.lit("is "), name))


def mined(files: DataFrame, rules: DataFrame, said: DataFrame, declaring: DataFrame) -> DataFrame:
    """(trait): parts of paths that declare a file not hand-written, by what repositories with attribute files say of theirs.

    Counted are all files of these repositories, each repository once in the number of those that declare; and
    simple globs, as long as no repository unsets them.
    """
    told = rules.select("root", globs_traits(F.col("glob")).alias("trait"), "on").filter(F.col("trait").isNotNull())
    told = told.groupBy("trait").agg(F.count_distinct("root").alias("roots"), F.bool_and(F.coalesce("on", F.lit(False))).alias("on")).filter(F.col("on") & (F.col("roots") >= SHARED_ROOTS))
    own = files.join(declaring.select("root"), "root", "left_semi").join(said, "file_id", "left")
    yes = F.coalesce(F.col("generated"), F.lit(False)) | F.coalesce(F.col("vendored"), F.lit(False))
    by_root = own.select("root", F.explode(traits(F.col("path"))).alias("trait"), yes.cast("long").alias("yes")).groupBy("trait", "root").agg(F.sum("yes").alias("yes"), F.count(F.lit(1)).alias("n"))
    by = by_root.groupBy("trait").agg(F.count_if(F.col("yes") > 0).alias("roots"), (F.sum("yes") / F.sum("n")).alias("share"))
    return by.filter((F.col("roots") >= SHARED_ROOTS) & (F.col("share") >= SHARED_SHARE)).select("trait").union(told.select("trait")).distinct()


def _any(path: Column, regexes: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{r})" for r in regexes))


def stem(path: Column) -> Column:
    """A file's name without its endings and without a version behind it."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"(?:\.[A-Za-z]+)+$", ""), r"[-_.]v?\d+(?:\.\d+)+$", "")


def by_text(content: Column) -> dict[str, Column]:
    """What a file's text says: by_program, by_others, dense (minified, or data in long lines), data."""
    top = F.concat_ws("\n", F.substring_index(content, "\n", 5), F.regexp_extract(content, _HEADER, 0))
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    values = F.size(F.filter(lines, lambda x: x.rlike(_VALUES)))
    size = F.length(content)
    wide = F.length(F.array_join(F.filter(lines, lambda x: F.length(x) >= WIDE_LINE), "")) >= WIDE_SHARE * size
    wide = wide & content.rlike(rf"[^\n]{{{WIDE_LINE}}}")
    long = size >= LONG_MEAN * F.greatest(F.size(lines), F.lit(1))
    few = F.length(F.translate(content, " \t\r\n", "")) >= (1 - FEW_BLANKS) * size
    return {
        "by_program": F.coalesce(top.rlike(_BY_PROGRAM), F.lit(False)),
        "by_others": F.coalesce(top.rlike(_BY_OTHERS), F.lit(False)),
        "dense": F.coalesce(wide | (long & few), F.lit(False)),
        "data": F.coalesce((values >= DATA_LINES) & (values >= DATA_SHARE * F.size(lines)), F.lit(False)),
    }


def classify(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, root, path, reason, evidence) of every file; ``reason`` is null for hand-written source.

    Reasons: declared, generated, vendored, minified-or-data. ``evidence`` is the strongest that spoke for it:
    attributes, mined pattern, notice, mined package, fixed pattern, shape of lines. An attribute file that unsets an attribute on
    a path overrides patterns and text for it. ``files`` needs file_id, root, path, size, ``contents``
    file_id and content; other columns do not matter. A file scanned twice counts once, with its first
    path in order; null paths match no pattern, null and empty texts say nothing; of several texts
    of a file it is enough that one says so.
    """
    one = files.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min_by(F.struct("root", "path", "size"), F.struct("path", "root", "size")).alias("f"))
    plain = one.select("file_id", "f.root", plain_path(F.col("f.path"), F.col("f.root")).alias("path"), "f.size")
    # texts are judged where they are read; only what they say is shuffled
    says = by_text(F.col("content"))
    text = contents.select("file_id", *[c.alias(n) for n, c in says.items()]).groupBy("file_id").agg(*[F.bool_or(n).alias(n) for n in says])
    known = plain.join(text, "file_id", "left").select(*plain.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in says])

    fixed = parse_attributes(EQUIVALENT)
    generated = [r[2] for r in fixed if r[3] == "generated"] + [r"(?:^|/)(?:assets|static|dist)/[^/]*-[0-9a-f]{6,}\.(?:js|ts|css)$"]
    vendored = [r[2] for r in fixed if r[3] == "vendored"]
    marked = known.withColumn("stem", stem(F.col("path"))).withColumn("by_path_g", F.coalesce(_any(F.col("path"), generated), F.lit(False))).withColumn("by_path_v", F.coalesce(_any(F.col("path"), vendored), F.lit(False)))
    marked = cut(marked, "marked")  # so that texts are read and judged once
    # names of packages: nearly all files of that name, in several repositories, carry an upstream notice
    names = marked.filter(~F.col("by_path_v")).groupBy("stem").agg(F.count_distinct(F.when(F.col("by_others"), F.col("root"))).alias("roots"), F.avg(F.col("by_others").cast("double")).alias("share"))
    packages = names.filter((F.col("roots") >= MINED_ROOTS) & (F.col("share") >= MINED_SHARE)).select("stem", F.lit(True).alias("package"))
    joined = marked.join(packages, "stem", "left")

    rules = cut(attribute_rules(marked, contents), "rules")
    if rules.isEmpty():  # nobody declares anything
        joined = joined.withColumns({"generated": F.lit(None).cast("boolean"), "vendored": F.lit(None).cast("boolean"), "like": F.lit(False)})
    else:
        said = cut(declared(marked, rules), "declared")
        declaring = rules.select("root").distinct()
        others = marked.join(declaring, "root", "left_anti").select("file_id", F.explode(traits(F.col("path"))).alias("trait"))
        like = others.join(mined(marked, rules, said, declaring), "trait", "left_semi").select("file_id").distinct().withColumn("like", F.lit(True))
        joined = joined.join(said, "file_id", "left").join(like, "file_id", "left")
    g_off, v_off = F.col("generated") == F.lit(False), F.col("vendored") == F.lit(False)
    off = lambda c: F.coalesce(c, F.lit(False))
    why = lambda reason, by: F.struct(F.lit(reason).alias("reason"), F.lit(by).alias("evidence"))
    evidence = (
        F.when(off(F.col("generated")) | off(F.col("vendored")), why("declared", "attributes"))
        .when(off(F.col("like")), why("declared", "mined pattern"))
        .when(~off(v_off) & F.col("by_others"), why("vendored", "notice"))
        .when(~off(v_off) & off(F.col("package")), why("vendored", "mined package"))
        .when(~off(v_off) & F.col("by_path_v"), why("vendored", "fixed pattern"))
        .when(~off(g_off) & F.col("by_program"), why("generated", "notice"))
        .when(~off(g_off) & F.col("by_path_g"), why("generated", "fixed pattern"))
        .when(~off(g_off) & (F.col("dense") | F.col("data")), why("minified-or-data", "shape of lines"))
    )
    return joined.select("file_id", "root", "path", evidence.alias("e")).select("file_id", "root", "path", "e.reason", "e.evidence")
