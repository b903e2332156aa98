"""License scans by ordered signature rules.

Texts are folded to words joined by one space. A rule's pattern is tried only where its keywords
stand in the text. Detections are then resolved: one goes if its words lie within those of a detection
of higher priority, or of the same priority and longer, or as long and of an earlier rule.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.license_rules import Rule, rules
from peakloom.llm.packing import bound_batches, tidy

#: phrase -> label; all of their places count, and no rule suppresses them
BASE_PHRASES = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
#: What a base phrase is worth where no rule stands for its label.
BASE_CONFIDENCE = 0.5

#: A-Z folded, ASCII that is neither letter nor digit blank, all else as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Detection:
    """A rule's match: words start to end (exclusive), counted from 0."""

    start: int
    end: int
    rule: Rule


class Scanner:
    """Rules ready to run over texts: patterns compiled when first needed, keywords numbered."""

    def __init__(self, ordered: list[Rule]):
        self.rules = ordered
        self._patterns = lru_cache(maxsize=None)(lambda k: ordered[k].compiled())
        self.keywords = sorted({k for r in ordered for part in r.keywords for k in part})
        number = {k: i for i, k in enumerate(self.keywords)}
        self._needs = [[{number[k] for k in part} for part in r.keywords] for r in ordered]
        # a keyword's rules: those of which it may be the first
        self._of = [[] for _ in self.keywords]
        for k, parts in enumerate(self._needs):
            for i in parts[0]:
                self._of[i].append(k)

    def words(self, text: str) -> tuple[int, bytes]:
        """Number of words, and the words with a blank before and behind each."""
        found = text.encode().translate(_FOLD).split(b" ")
        found = [w for w in found if w]
        return len(found), b" " + b" ".join(found) + b" " if found else b" "

    def detect(self, line: bytes) -> list[Detection]:
        """All matches of the rules whose keywords stand in line, unresolved."""
        here = {i for i, k in enumerate(self.keywords) if b" " + k in line}
        tried = sorted({k for i in here for k in self._of[i] if all(part & here for part in self._needs[k])})
        matches = [(m.start(), m.end(), k) for k in tried for m in self._patterns(k).finditer(line)]
        if not matches:
            return []
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.searchsorted(blanks, [m[0] for m in matches]) - 1
        ends = np.searchsorted(blanks, [m[1] for m in matches])
        return [Detection(s, e, self.rules[k]) for s, e, (_, _, k) in zip(starts.tolist(), ends.tolist(), matches, strict=True)]

    def base(self, line: bytes) -> list[tuple[int, str]]:
        """(byte before, label) of every place of a base phrase."""
        out = []
        for phrase, label in BASE_PHRASES.items():
            phrase, at = b" " + phrase + b" ", -1
            while (at := line.find(phrase, at + 1)) >= 0:
                out.append((at, label))
        return out


def resolve(found: list[Detection], order: dict[str, int]) -> list[Detection]:
    """What is left of the detections, by place. order: a rule's name to its place among the rules."""
    kept: list[Detection] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of kept ones that start there or before
    for priority in sorted({d.rule.priority for d in found}):
        level, far = [], -1
        for d in sorted((d for d in found if d.rule.priority == priority), key=lambda d: (d.start, -d.end, order[d.rule.name])):
            i = bisect_right(starts, d.start) - 1
            if d.end > max(far, reach[i] if i >= 0 else -1):
                level.append(d)
                far = d.end
        kept = sorted(kept + level, key=lambda d: d.start)
        starts = [d.start for d in kept]
        reach = np.maximum.accumulate([d.end for d in kept]).tolist()
    return kept


_ADDED = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("base_labels", "labels")]
    + [T.StructField("detections", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("confidence", T.DoubleType())]))), T.StructField("score", T.DoubleType())]
)


def scan_text(text: str | None, scanner: Scanner, order: dict[str, int]) -> tuple:
    """The added columns of one text."""
    n, line = scanner.words(text or "")
    base = scanner.base(line)
    kept = resolve(scanner.detect(line), order)
    worth: dict[str, float] = {}
    for label in {label for _, label in base}:
        worth[label] = BASE_CONFIDENCE
    for d in kept:
        worth[d.rule.label] = max(worth.get(d.rule.label, 0.0), d.rule.confidence)
    doubt = 1.0
    for c in sorted(worth.values()):
        doubt *= 1 - c
    places = [line.count(b" ", 0, at) for at in ((min(base)[0], max(base)[0]) if base else ())]
    spans = [{"start": d.start, "end": d.end, "label": d.rule.label, "rule": d.rule.name, "confidence": d.rule.confidence} for d in kept]
    return n, len(base), *(places or (None, None)), sorted({label for _, label in base}), sorted(worth), spans, 1 - doubt


def scan_licenses(docs: DataFrame, *, text_col: str = "text", ordered: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs, or their columns `keep`, with n_words, n_base, first_word, last_word, base_labels, labels, detections and score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. n_base counts the places of BASE_PHRASES,
    first_word and last_word are the least and the greatest of their first words, null without any. detections holds what is left of the rules' matches, as
    word ranges with an exclusive end, by start. labels: those of the base phrases and of the detections, distinct,
    sorted. score: one less the product of the doubts (1 - confidence) in the labels, 0 without labels.

    Null and empty texts have no words, no labels and score 0. Rows pass through as they are, repeated ones too;
    columns named like an added one are replaced. Texts of any length are scanned whole, in linear time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(docs.sparkSession)
    ordered = rules() if ordered is None else ordered
    names = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED.names]
    df = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], *_ADDED.fields])
    arrow = to_arrow_schema(_ADDED)

    @tidy
    def run(batches) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordered)
        order = {r.name: k for k, r in enumerate(ordered)}
        for batch in batches:
            rows = [scan_text(t.as_py(), scanner, order) for t in batch.column(batch.num_columns - 1)]
            columns = zip(*rows, strict=True) if rows else ([] for _ in arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


QUERIES = {"op13_license_scan": op13_license_scan}
#: The rules are regular expressions with priorities and suppression by containment; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
