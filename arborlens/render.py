"""Small results as text. Renderers collect what they are given: pass results that limits have made short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions.text import human_size


class Text:
    """Text within a budget of characters; what does not fit is cut with a note, and an open fence is closed."""

    def __init__(self, most: int, note: str = "\n... (truncated)\n") -> None:
        self.most, self.note, self.parts, self.used, self.full = most, note, [], 0, False

    def add(self, text: str) -> bool:
        """Append; False if nothing or not all of it fitted."""
        if self.full:
            return False
        room = self.most - self.used
        if len(text) <= room:
            self.parts.append(text)
            self.used += len(text)
            return True
        self.parts.append(text[: max(0, room - len(self.note))])
        self.full = True
        return False

    def __str__(self) -> str:
        text = "".join(self.parts)
        if not self.full:
            return text
        return text + ("\n```" if text.count("```") % 2 else "") + self.note


def tree(directories: DataFrame, files: DataFrame, depth: int) -> str:
    """Directories first, then files, by name; below ``depth`` only counts. One root at a time."""
    dirs = {r["dir"]: r for r in directories.filter(F.col("depth") <= depth).withColumn("size", human_size(F.col("bytes"))).collect()}
    shown: dict[str, list[str]] = {}
    for r in files.filter(F.size(F.split("path", "/")) <= depth).select("path").collect():
        up, _, name = r["path"].rpartition("/")
        shown.setdefault(up, []).append(name)
    out = []

    def walk(at: str, indent: str) -> None:
        inner = sorted(d for d in dirs if d and d.rpartition("/")[0] == at)
        names = sorted(shown.get(at, []))
        items = [(d.rpartition("/")[2] + "/", d) for d in inner] + [(n, None) for n in names]
        for i, (name, d) in enumerate(items):
            last = i == len(items) - 1
            label = f"{name} ({dirs[d]['files']} files, {dirs[d]['size']})" if d else name
            out.append(f"{indent}{'└── ' if last else '├── '}{label}")
            if d:
                walk(d, indent + ("    " if last else "│   "))

    walk("", "")
    return "\n".join(out)


def skyline(buildings: DataFrame) -> str:
    """Buildings side by side, the tallest in the middle, with their extensions below."""
    rows = buildings.orderBy("place").collect()
    top = max((r["height"] for r in rows), default=0)
    lines = ["".join("█████  " if r["height"] > y else "       " for r in rows).rstrip() for y in range(top - 1, -1, -1)]
    return "\n".join([*lines, "".join(f"{r['ext'][:5]:<7}" for r in rows).rstrip()])


def markdown(title: str, bundle: dict[str, DataFrame], most: int = 20_000) -> str:
    """A bundle of results as one table each, within a budget."""
    text = Text(most)
    text.add(f"# {title}\n")
    for name, df in bundle.items():
        text.add(f"\n## {name.replace('_', ' ')}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n")
        # a row takes four letters at least, so no more rows than that can fit
        for row in df.limit(most // 4 + 1).collect():
            if not text.add("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |\n"):
                return str(text)
    return str(text)
