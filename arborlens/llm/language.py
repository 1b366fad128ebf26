"""Languages of documents and of their paragraphs, by prediction by partial matching.

Of each language a tree of byte contexts of variable order is counted from labelled texts. A byte's
probability is that in its longest known context, times the probabilities of the escapes from the longer
ones (escape method C); bytes never seen cost 1/256 after the last escape. The statistics are frozen
after training, so the code length of a word, from the blank before it to the one behind it, is the same
wherever it stands: it is computed once for each distinct word, and a text's code length is an exact sum.
Contexts do not reach across words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.text import mended, portions

#: Longest context in bytes.
ORDER = 5
#: Training takes this many labelled texts at most, in order of id. The table of samples has 360 and does not grow.
SAMPLES = 20_000
#: Code lengths are differences of bits; a confidence divides them by this before they become odds.
TEMPER = 8.0

#: Names of languages in labels (ISO 639-1, 639-2 and -3 codes, names in English and in the language).
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french francais français",
    "es": "es spa spanish castilian espanol español castellano",
    "pt": "pt por portuguese portugues português",
    "nl": "nl nld dut dutch flemish nederlands",
}
_CODE = {n: code for code, names in NAMES.items() for n in names.split()}

_BREAK = re.compile(r"\n(?:[ \t\r\f\v\u00a0\u2000-\u200b\u3000]*\n)+")
_FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_LOG = re.compile(r"(?m)^[ \t>#*/-]*\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*$")
_PLACE = re.compile(r"\S*[/\\]\S*|\b\w+\.(?:[a-z]{1,4})(?::\d+)?\b|\bhttps?:\S+")
_CODELINE = re.compile(r"(?m)^.*(?:[;{}]|\)\s*:)[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+")


def label_code(label: str | None) -> str | None:
    """The language that a label names, in whatever notation, or None."""
    if not label:
        return None
    return _CODE.get(re.split(r"[-_.\s]", label.strip().lower(), maxsplit=1)[0])


def paragraphs(text: str) -> list[str]:
    """The blocks between lines that are empty or blank, without code, paths and log lines.

    Code that a fence opens goes on over blank lines until it is closed.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    if "```" in text or "~~~" in text:
        # blank lines inside a fence part blocks too: keep them, and drop the code around them
        text = _FENCED.sub(lambda m: "\n\n".join("\x00" for _ in _BREAK.split(m[0])), text)
    out = [p for p in _BREAK.split(text)]
    out = [p for p in out if p.strip()]
    for i, p in enumerate(out):
        if "`" in p:
            p = _INLINE.sub(" ", p)
        if "|" in p or "-" in p and p[:60].lstrip(" >#*/-")[:2].isdigit():
            p = _LOG.sub(" ", p)
        if ";" in p or "{" in p or "}" in p:
            p = _CODELINE.sub(" ", p)
        if "/" in p or "\\" in p or ":" in p:
            p = _PLACE.sub(" ", p)
        out[i] = p
    return out


def bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class Contexts:
    """The frozen context trees of all languages, and the code lengths of words under them."""

    def __init__(self, samples: Iterable[tuple[str, str]], order: int = ORDER) -> None:
        self.order = order
        seen: dict[str, dict[bytes, dict[int, int]]] = {}
        for lang, text in samples:
            tree = seen.setdefault(lang, {})
            low = text.lower()
            for form in (low, bare(low)) if not low.isascii() else (low, low):  # letters may have lost their accents
                for w in _WORD.findall(form):
                    b = b" " + w.encode() + b" "
                    for i in range(1, len(b)):
                        for k in range(min(order, i) + 1):
                            ctx = tree.setdefault(b[i - k : i], {})
                            ctx[b[i]] = ctx.get(b[i], 0) + 1
        self.langs = sorted(seen)
        # of each context: bits of each following byte, and of the escape to the next shorter one
        self.trees = [
            {c: ({s: -math.log2(n / (sum(f.values()) + len(f))) for s, n in f.items()}, -math.log2(len(f) / (sum(f.values()) + len(f)))) for c, f in seen[lang].items()}
            for lang in self.langs
        ]
        self.known: dict[str, int] = {}
        self.rows: list[list[float]] = []

    def bits(self, word: str) -> list[float]:
        """The code length of a word in each language."""
        b = b" " + word.encode() + b" "
        out = []
        for tree in self.trees:
            total = 0.0
            for i in range(1, len(b)):
                for k in range(min(self.order, i), -1, -1):
                    node = tree.get(b[i - k : i])
                    if node is None:
                        continue
                    got = node[0].get(b[i])
                    if got is not None:
                        total += got
                        break
                    total += node[1]
                else:
                    total += 8.0
            out.append(total)
        return out

    def places(self, words: list[str]) -> list[int]:
        """Rows of :meth:`table` for words; a word's code length is computed when it first comes."""
        known = self.known
        for w in set(words) - known.keys():
            known[w] = len(self.rows)
            self.rows.append(self.bits(w))
        return [known[w] for w in words]

    def forget(self, most: int = 500_000) -> None:
        """Start the memory of words anew if it holds more than ``most``."""
        if len(self.rows) > most:
            self.known, self.rows = {}, []


_models: dict[int, Contexts] = {}


def _model(samples: list[tuple[str, str]]) -> Contexts:
    """The model of the samples, built once in a Python worker."""
    name = hash(tuple(samples))
    if name not in _models:
        _models.clear()
        _models[name] = Contexts(samples)
    return _models[name]


def score(model: Contexts, texts: list[str | None]) -> Iterator[tuple[int, int, str, float, int]]:
    """(text's place, paragraph number, language, confidence, words) of every paragraph with words."""
    at, found = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for k, p in enumerate(paragraphs(mended(text).lower()), 1):
            ws = _WORD.findall(p)
            if ws:
                at.append((i, k))
                found.append(ws)
    if not at:
        return
    model.forget()
    ids = np.array(model.places(list(chain.from_iterable(found))), np.int64)
    size = np.array([len(w) for w in found])
    table = np.array(model.rows)
    bits = np.add.reduceat(table[ids], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
    best = bits.argmin(1)
    odds = np.exp2(-(bits - bits.min(1, keepdims=True)) / TEMPER)
    sure = odds[np.arange(len(best)), best] / odds.sum(1)
    for (i, k), b, c, n in zip(at, best, sure, size):
        yield i, k, model.langs[b], float(c), int(n)


def identify(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", only_cases: bool = False) -> DataFrame:
    """(doc_id, para_no, lang, confidence, words, label) of each document (para_no 0) and each of its paragraphs.

    A document's language is that of most of its words, counting each paragraph's words for the paragraph's
    language (the first in order of code on a tie); its confidence is their share times the paragraphs'
    confidence, weighted by words. Code, paths, log lines and digits are no words; documents and
    paragraphs without words have no rows, null and empty texts neither. ``label`` in the result is the code
    that the document's label names, null if none. Texts are read whole; repeated rows give repeated rows.
    ``only_cases``: leave out documents with a right label and paragraphs in their document's language.
    ``samples`` (sample_id, lang, text) is the training table, of which :data:`SAMPLES` rows at most are taken.
    """
    rows = [(r["lang"], r["text"]) for r in samples.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).orderBy("sample_id").limit(SAMPLES).select("lang", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # SAMPLES short texts at most
    kind = dict(docs.dtypes)[doc_id]
    schema = f"`{doc_id}` {kind}, para_no int, lang string, confidence double, words bigint, label string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in chain.from_iterable(portions(b, 1) for b in batches):
            labels = [label_code(x) for x in b.column(2).to_pylist()]
            paras: dict[int, list[tuple[int, str, float, int]]] = {}
            for i, k, lang, sure, n in score(model, b.column(1).to_pylist()):
                paras.setdefault(i, []).append((k, lang, sure, n))
            out: list[tuple] = []
            for i, ps in paras.items():
                total, sums = 0, {}
                for _, lang, sure, n in ps:
                    c = sums.setdefault(lang, [0, 0.0])
                    c[0], c[1], total = c[0] + n, c[1] + n * sure, total + n
                top = min(sums, key=lambda x: (-sums[x][0], x))
                if not only_cases or labels[i] != top:
                    out.append((i, 0, top, sums[top][1] / total, total, labels[i]))
                out += [(i, k, lang, sure, n, labels[i]) for k, lang, sure, n in ps if not only_cases or lang != top]
            ids = b.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            kinds = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[j + 1] for o in out], t) for j, t in enumerate(kinds))], names=[doc_id, "para_no", "lang", "confidence", "words", "label"])

    return docs.select(doc_id, text, label).mapInArrow(work, schema)


def cases(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Of :func:`identify` the documents with a missing or wrong label and the paragraphs in another language than theirs."""
    return identify(docs, samples, doc_id, text, label, only_cases=True).select(doc_id, "para_no", "lang", "confidence")
