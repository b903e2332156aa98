"""Secret scans with DataFrame functions only.

Base patterns are found by Java regular expressions; a kind's positions come from the lengths of what
`split` leaves between the matches that `regexp_extract_all` returns. On top, candidate strings of a
character class are scanned with a sliding window whose Shannon entropy is kept up to date by the
counts of the characters that enter and leave; strings on the allow list are suppressed.

Arrays enter higher-order functions as arguments, never as captured columns: an expression captured
by a lambda would be worked out once an element.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, group whose length counts, least length), in the order that breaks ties
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


@dataclass(frozen=True)
class EntropyClass:
    """Strings of `chars` (a regex class) of at least `least` characters; entropy in bits over `window` characters."""

    kind: str
    chars: str
    least: int
    window: int
    bits: float


#: A random string of 24 characters has about 3.5 bits in 16 letters and 4.3 in 64; words stay below.
ENTROPY_CLASSES = (
    EntropyClass("entropy16", "[0-9A-Fa-f]", 24, 24, 3.0),
    EntropyClass("entropy64", "[A-Za-z0-9+/_-]", 24, 24, 4.0),
)
#: What looks random but is no secret: examples, placeholders, sequences, repeats, UUIDs, integrity sums.
#: A pattern that starts with ^ speaks for a whole run, ALLOW_WORDS for the piece between slashes that
#: they stand in, any other for what it matches.
ALLOW_WORDS = r"(?i)example|placeholder|changeme|dummy|redacted"
ALLOW_LIST = (
    ALLOW_WORDS,
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(.)\1{7}",
    r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",
    r"^sha(?:1|256|384|512)-",
)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Items of a scan whose results grow together, and code points of a block of text that pieces are cut from.
_RUN = 128
_BLOCK = 2048


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, kind: str, step) -> Column:
    """(at, out: array of type kind) after all items in order; step(at, item) -> (next at, whether to emit, what).

    An array that grows by one element a step is copied at each step, so items are taken in runs of
    _RUN and the runs' results are flattened once: n items cost about n * _RUN copied elements, not n * n.
    """

    def over(run: Column, at: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, emit, what = step(acc["at"], x)
            return F.struct(after.alias("at"), F.when(emit, F.concat(acc["out"], F.array(what))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), one)

    def joined(acc: Column, run: Column) -> Column:
        return _let(over(run, acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    cut = _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(_RUN)), lambda i: F.slice(x, i + 1, F.lit(_RUN))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(cut, zero, joined, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def _positions(text: Column, pattern: str, rank: int, kind: str, keep) -> Column:
    """Spans of the matches for which keep(match, group 1 or null) holds."""
    p = F.lit(pattern)
    grouped = "(" in pattern.replace("(?", "")
    matches = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"), F.lit(None).cast("string").alias("v")))
    if grouped:
        groups = F.regexp_extract_all(text, p, F.lit(1))
        pairs = F.zip_with(pairs, groups, lambda x, v: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), v.alias("v")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return end, F.coalesce(keep(x["m"], x["v"]), F.lit(False)), span

    return _scan(pairs, _SPAN, step)["out"]


def window_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any `window` consecutive characters of s (ASCII from '+' to 'z'); 0 for shorter strings.

    One pass: the sum of n*log2(n) over the window's counts n changes by the character that enters and the one that leaves.
    """
    weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    chars = F.split(s, "", -1)
    codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) - F.lit(43))
    pairs = F.filter(
        F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), window), F.transform(F.filter(F.split(s, "", -1), lambda c: c != ""), lambda c: F.ascii(c) - F.lit(43))), lambda a, b: F.struct(a.alias("in"), b.alias("out"))),
        lambda p: p["in"].isNotNull(),
    )

    def step(acc: Column, p: Column) -> Column:
        counts = acc["counts"]
        n_out = F.when(p["out"] >= 0, F.get(counts, p["out"])).otherwise(F.lit(0))
        n_in = F.get(counts, p["in"]) - F.when(p["in"] == p["out"], 1).otherwise(0)
        total = acc["total"] + F.when(p["out"] >= 0, weigh(n_out - 1) - weigh(n_out)).otherwise(F.lit(0.0)) + weigh(n_in + 1) - weigh(n_in)
        seen = acc["seen"] + 1
        bits = F.when(seen >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(
            F.transform(counts, lambda n, i: n + F.when(i == p["in"], 1).otherwise(0) - F.when(i == p["out"], 1).otherwise(0)).alias("counts"),
            total.alias("total"),
            seen.alias("seen"),
            F.greatest(acc["best"], bits).alias("best"),
        )

    zero = F.struct(F.array_repeat(F.lit(0), 80).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def _anchored(pattern: str) -> bool:
    return re.match(r"(?:\(\?[a-z]+\))?\^", pattern) is not None


def find_secrets(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secrets", classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES, allow: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """docs with spans_col: array of (start, rank, end, kind) in code points, end exclusive, by start, then kind.

    rank is the kind's place in BASE_KINDS, then in classes. Base matches are leftmost and
    non-overlapping within a kind and always stay, the allow list does not touch them. A candidate of
    a class, a maximal run of its characters with a letter and a digit in it, is added whole when some
    window clear of what the allow list speaks for reaches the class's entropy and no allow-list pattern
    that starts with ^ matches the run; of two classes that hold the same run the earlier one reports it.

    Null and empty texts have no spans. Rows pass through as they are, repeated ones too; a column
    named spans_col is replaced. No Python runs on executors.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    none = F.array().cast(_SPAN)
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        keep = (lambda m, v, n=least: F.length(v) >= n) if group else (lambda m, v, n=least: F.length(m) >= n)
        found.append(F.when(text.rlike(pattern), _positions(text, pattern, rank, kind, keep)).otherwise(none))
    for i, c in enumerate(classes):
        earlier = [x.chars for x in classes[:i]]
        run = f"(?<!{c.chars}){c.chars}{{{c.least},}}"

        def keep(m: Column, _v: Column, c=c, earlier=tuple(earlier)) -> Column:
            ok = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
            rest = m
            for pattern in allow:
                if _anchored(pattern):
                    ok &= ~m.rlike(pattern)
                else:  # a line break is in no class, so windows stay between the matches
                    rest = F.regexp_replace(rest, rf"(?<![^/\n])[^/\n]*?(?:{pattern})[^/\n]*" if pattern == ALLOW_WORDS else pattern, "\n")
            for chars in earlier:
                ok &= ~m.rlike(f"^{chars}+$")
            parts = F.filter(F.split(rest, "\n", -1), lambda part: F.length(part) >= c.window)
            return F.when(ok, F.exists(parts, lambda part: window_entropy(part, c.window) >= c.bits)).otherwise(F.lit(False))

        found.append(F.when(text.rlike(run), _positions(text, run, len(BASE_KINDS) + i, c.kind, keep)).otherwise(none))
    return docs.withColumn(spans_col, F.array_sort(F.concat(*found)))


def redact(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text_col replaced by one mark; null texts stay null.

    What is kept is cut from blocks of the text, so that no span walks the text from its start.
    """
    text = F.col(f"`{text_col}`")

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["end"]), s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end"))

    def piece(blocks: Column, p: Column) -> Column:
        first = F.floor(p["start"] / _BLOCK).cast("int")
        count = F.floor(p["end"] / _BLOCK).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(blocks, first + 1, count), ""), p["start"] - first * _BLOCK + 1, p["end"] - p["start"])

    runs = _scan(F.col(f"`{spans_col}`"), "array<struct<start:int,end:int>>", step)
    pieces = _let(runs, lambda r: F.concat(r["out"], F.array(F.struct(r["at"].alias("start"), F.length(text).alias("end")))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    clean = _let(blocks, lambda b: F.array_join(F.transform(pieces, lambda p: piece(b, p)), mark))
    return docs.withColumn(text_col, F.when(F.size(f"`{spans_col}`") > 0, clean).otherwise(text))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = F.col("secrets")
    count = lambda rank: F.size(F.filter(s, lambda x: x["rank"] == rank)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        *(count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE_KINDS)),
        F.sha2(_listed(F.filter(s, lambda x: x["rank"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        _listed(s).alias("spans"),
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL: dict[str, str] = {}
