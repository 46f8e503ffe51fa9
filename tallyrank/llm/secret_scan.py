"""Secret scan with built-in expressions only.

Base kinds are regular expressions, leftmost and non-overlapping per kind; a
match that fails its kind's length test is dropped and not searched again.

The method adds spans of high entropy. Candidates are runs of a character
class; a window of ``width`` characters slides over each and its Shannon
entropy follows from incremental counts: with S the sum of c*log2(c) over the
window's character counts, entropy is log2(width) - S / width. The scan carries
S and the counts, one cell for each code point of the class; a step takes the
character that leaves out of its cell, puts the one that enters into its own and
changes S by these two cells alone. A candidate's span reaches from its first
window at or above the class's threshold to the end of its last one.

The allow list suppresses only what it names. A piece of a run between the marks
``/ _ - + =`` that matches a pattern of ``allow_pieces`` is cut out, and what lies
around it are candidates of their own (``example/<key>`` still gives the key); a
candidate that matches a pattern of ``allow`` is suppressed. Base spans never are.

All offsets are code points, ends exclusive. A null text is empty and has no
span; an empty table gives an empty one. Rows are independent: repeated rows and
null ids give rows of their own. Long texts are scanned whole, in time linear in
their candidates' lengths. An input column of the output's name comes out as
``kept_<name>``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept_names, prefix_sums

# The base kinds, in their order.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern``, whose characters lie between the code points ``least`` and ``most``."""
    kind: str
    pattern: str
    width: int
    threshold: float
    least: str = "!"
    most: str = "~"


CLASSES = (CharClass("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0, "0", "f"),
           CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", 24, 4.0, "+", "z"))
#: Random strings mix letters and digits; samples, counters and UUIDs are no secrets.
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
ALLOW_PIECES = (r"(?i)example|sample|dummy|placeholder|changeme|x{6,}", r"0123456789|abcdefgh|ABCDEFGH")


def _let(value: Column, use) -> Column:
    """``use`` of a value computed once."""
    return F.transform(F.array(value), use)[0]


def _at(found: str | Column, text: str | Column, pattern: str) -> tuple[Column, Column]:
    """Lengths of the matches, and of each match with the gap before it."""
    size = F.transform(found, lambda m: F.length(m))
    none = F.array().cast("array<int>")
    gaps = F.when(F.size(found) > 0, F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
                                                 lambda g: F.length(g))).otherwise(none)
    return size, F.zip_with(gaps, size, lambda g, m: g + m)


def _window_span(chars: Column, k: CharClass) -> Column:
    """``struct<first, last>``: start of the first and end of the last window with
    enough entropy (-1 if none), for an array of single characters."""
    w, least, cells = k.width, ord(k.least), ord(k.most) - ord(k.least) + 1
    f = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)))
    limit = w * (math.log2(w) - k.threshold) + 1e-9

    # Counts are held as a string of one character a cell, "!" for none: the
    # functions that read and replace one character of it are built in.
    def cell(i: Column) -> Column:
        return F.ascii(F.get(chars, i)) - (least - 1)

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substring(counts, at, F.lit(1))) - 33

    def moved(counts: Column, at: Column, n: Column, by: int) -> Column:
        return F.overlay(counts, F.char(n + (33 + by)), at, F.lit(1))

    def changed(a: Column, i: Column, by: int) -> Column:
        """S and the counts after character i entered (1) or left (-1)."""
        return _let(cell(i), lambda at: _let(count(a["counts"], at), lambda n: F.struct(
            (a["s"] + F.get(f, n + by) - F.get(f, n)).alias("s"), moved(a["counts"], at, n, by).alias("counts"))))

    def step(a: Column, i: Column) -> Column:
        # a.s and a.counts belong to the window that ends before i.
        high = (i >= w) & (a["s"] <= limit)
        window = F.struct(a["s"].alias("s"), a["counts"].alias("counts"))
        left = F.when(i >= w, changed(a, i - w, -1)).otherwise(window)
        after = F.when(i < F.size(chars), _let(left, lambda x: changed(x, i, 1))).otherwise(window)
        return _let(after, lambda x: F.struct(
            x["s"].alias("s"), x["counts"].alias("counts"),
            F.when(high & (a["first"] < 0), i - w).otherwise(a["first"]).alias("first"),
            F.when(high, i).otherwise(a["last"]).alias("last")))

    start = F.struct(F.lit(0.0).alias("s"), F.lit("!" * cells).alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars)), start, step,
                       lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _candidates(run: Column, k: CharClass, pieces: tuple[str, ...]) -> Column:
    """``array<struct<at, text>>``: a run without its allowed pieces, which are blanked
    so that offsets stay; what lies between them is long enough for a window."""
    blanked = F.array_join(F.transform(F.regexp_extract_all(run, F.lit(r"[/_+=-]+|[^/_+=-]+"), 0), lambda x: F.when(
        _any(x, pieces), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "")
    parts = r"[^ ]{%d,}" % k.width

    def cut(text: Column) -> Column:
        return _let(F.regexp_extract_all(text, F.lit(parts), 0), lambda found: _let(_at(found, text, parts)[1], lambda steps: _let(
            prefix_sums(steps), lambda ends: F.transform(found, lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x)).alias("at"), x.alias("text"))))))
    return F.when(_any(run, pieces), _let(blanked, cut)).otherwise(F.array(F.struct(F.lit(0).alias("at"), run.alias("text"))))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", classes: tuple[CharClass, ...] = CLASSES,
                 allow: tuple[str, ...] = ALLOW, allow_pieces: tuple[str, ...] = ALLOW_PIECES) -> DataFrame:
    """``docs`` with ``out``: ``array<struct<start, rank, end, kind>>`` sorted by
    start, then kind as listed (base kinds first, ``rank`` is that order)."""
    kinds = [*BASE, *(k.kind for k in classes)]
    pattern = dict(zip(kinds, [ASSIGN, ACCESS, HEX, *(k.pattern for k in classes)]))
    docs = docs.withColumnsRenamed({c: name for c, name in kept_names(tuple(docs.columns), (out,)).items() if c != name})
    text = text if text != out else f"kept_{out}"
    t, names = f"__{out}_text", {k: f"__{out}_{k}" for k in kinds}
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({names[k]: F.regexp_extract_all(t, F.lit(pattern[k]), 0) for k in kinds})
    values = f"__{out}_values"
    df = df.withColumn(values, F.when(F.size(names["assign"]) > 0, F.regexp_extract_all(t, F.lit(ASSIGN), 1)))
    sizes, steps = {k: f"{c}_size" for k, c in names.items()}, {k: f"{c}_step" for k, c in names.items()}
    made = {k: _at(names[k], t, pattern[k]) for k in kinds}
    df = df.withColumns({sizes[k]: made[k][0] for k in kinds} | {steps[k]: made[k][1] for k in kinds})

    def span(kind: str, lo: Column, hi: Column) -> Column:
        return F.struct(lo.alias("start"), F.lit(kinds.index(kind)).alias("rank"), hi.alias("end"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for kind in kinds:
        whole = F.zip_with(prefix_sums(F.col(steps[kind])), sizes[kind], lambda end, n: span(kind, end - n, end))
        if kind == "assign":
            ok = F.zip_with(whole, values, lambda s, v: F.struct(s.alias("s"), (F.length(v) >= 12).alias("ok")))
            whole = F.transform(F.filter(ok, lambda x: x["ok"]), lambda x: x["s"])
        elif kind not in BASE:
            k = classes[kinds.index(kind) - len(BASE)]
            windows = F.transform(names[kind], lambda m: F.transform(
                F.filter(_candidates(m, k, allow_pieces), lambda c: ~_any(c["text"], allow)),
                lambda c: F.struct(c["at"].alias("at"), _let(
                    F.slice(F.split(c["text"], ""), F.lit(1), F.length(c["text"])), lambda a: _window_span(a, k)).alias("w"))))
            whole = F.flatten(F.zip_with(whole, windows, lambda s, found: F.transform(
                F.filter(found, lambda c: c["w"]["first"] >= 0), lambda c: span(
                    kind, s["start"] + c["at"] + c["w"]["first"], s["start"] + c["at"] + c["w"]["last"]))))
        parts.append(F.when(F.size(names[kind]) > 0, whole).otherwise(none))
    return (df.withColumn(out, F.sort_array(F.concat(*parts)))
            .drop(t, values, *names.values(), *sizes.values(), *steps.values()))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(p)
    return hit


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans share a
    marker. A text without secrets, or a null one, stays as it is."""
    found = find_secrets(docs, text, "__spans")
    ends = F.transform("__spans", lambda s: s["end"])
    upto = found.withColumn("__ends", ends)
    upto = upto.withColumn("__upto", F.when(F.size("__ends") > 0, prefix_sums(
        F.col("__ends"), merge=lambda a, x: F.greatest(a, x))))
    # What lies between the spans so far and the next one; nothing where they overlap.
    before = F.concat(F.array(F.lit(0)), F.slice("__upto", F.lit(1), F.size("__upto") - 1))
    pieces = F.zip_with("__spans", before, lambda s, at: F.when(
        s["start"] >= at, F.concat(F.substring(F.col(text), at + 1, s["start"] - at), F.lit(marker))).otherwise(""))
    clean = F.concat(F.array_join(pieces, ""),
                     F.substring(F.col(text), F.element_at("__upto", -1) + 1, F.length(text)))
    return (upto.withColumn(text, F.when(F.size("__ends") > 0, clean).otherwise(F.col(text)))
            .drop("__spans", "__ends", "__upto"))
