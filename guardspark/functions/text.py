"""Text helpers: literal patterns, first and all matches, byte offsets."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"
#: Constructs that the policy dialect (linear-time, no look-around or back-references) rejects.
REJECTED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def escape(literal: str) -> str:
    """The literal as a pattern, valid in Java and RE2."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", literal)


def in_order(terms: list[str]) -> list[str]:
    """Terms in the order in which alternatives are tried: shorter prefixes first (earliest end wins)."""
    order = sorted(range(len(terms)), key=lambda k: next((j for j, t in enumerate(terms) if terms[k] != t and terms[k].lower().startswith(t.lower())), k))
    return [terms[k] for k in order]


def any_of(terms: list[str]) -> str:
    """ASCII case-insensitive alternation of literals."""
    return "(?i)" + "|".join(map(escape, in_order(terms)))


@cache
def keys(terms: tuple[str, ...], least: int = 5) -> list[str]:
    """Few strings of which each term holds at least one: parts of ``least`` letters or more (or whole terms), the one in most terms first, the longest of equals."""
    parts: dict[str, set[str]] = {}
    for t in terms:
        n = min(least, len(t))
        for a in range(len(t) - n + 1):
            for b in range(a + n, len(t) + 1):
                parts.setdefault(t[a:b], set()).add(t)
    left, out = set(terms), []
    while left:
        out.append(max(parts, key=lambda p: (len(parts[p] & left), len(p), p)))
        left -= parts[out[-1]]
    return out


def maybe(text: Column, terms: list[str]) -> Column:
    """False only where no term occurs in any case: a cheap byte search in front of a pattern. Each search walks the whole text, so parts that many terms
    share come first, and only a text with one of those is searched for the terms themselves."""
    low = F.lower(text)
    wanted = tuple(dict.fromkeys(t.lower() for t in terms))
    one_of = lambda these: reduce(lambda a, b: a | b, [low.contains(t) for t in these])
    shared = keys(wanted)
    return one_of(shared) & one_of(wanted) if len(shared) < 0.7 * len(wanted) else one_of(wanted)


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a term occurs, in any ASCII case."""
    return maybe(text, terms) & text.rlike(any_of(terms))


def count_any(text: Column, terms: list[str]) -> Column:
    return F.when(maybe(text, terms), F.regexp_count(text, F.lit(any_of(terms)))).otherwise(0)


def first(text: Column, pattern: str) -> Column:
    """The first match, null if none."""
    return F.regexp_substr(text, F.lit(pattern))


def folded(text: Column) -> Column:
    """Lower case, with the one letter besides that case-insensitive patterns take for an ASCII one."""
    # To translate goes through every character, and the letter is rare.
    return F.when(text.contains("\u017f"), F.translate(F.lower(text), "\u017f", "s")).otherwise(F.lower(text))


def needed(pattern: str) -> list[str] | None:
    """Lower-case ASCII literals of which every match of the pattern has at least one; None if that can't be told."""
    parser = re._parser  # type: ignore[attr-defined]

    def of(tokens) -> set[str] | None:
        found: list[set[str]] = []
        run = ""
        for op, arg in [*tokens, (None, None)]:
            if op is parser.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            if len(run) >= 3:
                found.append({run})
            run = ""
            inner = None
            if op is parser.SUBPATTERN:
                inner = of(arg[3])
            elif op is parser.BRANCH:
                parts = [of(x) for x in arg[1]]
                inner = None if any(x is None for x in parts) else set().union(*parts)
            elif op is parser.MAX_REPEAT and arg[0] > 0:
                inner = of(arg[2])
            if inner:
                found.append(inner)
        # The fewest literals, and of those the longest.
        return min(found, key=lambda x: (len(x), -min(map(len, x)))) if found else None

    literals = of(parser.parse(pattern))
    return sorted(literals) if literals else None


def loose(pattern: str) -> str:
    """A pattern that finds something wherever this one does under Unicode classes, without the word borders, which are dear to test."""
    return re.sub(r"\\[bds]", lambda m: {"\\b": "", "\\d": r"\p{Nd}", "\\s": r"\p{IsWhite_Space}"}[m[0]], pattern)


def first_if_any(text: Column, pattern: str, flags: str = "(?U)") -> Column:
    """As :func:`first`, behind a cheap search for the literals, or else the digits, that a match needs."""
    literals = needed(pattern)
    if not literals and re.search(r"\\[bd]", pattern) and not re.search(r"\\[^bds.()\[\]{}?*+|^$/-]", pattern):
        return F.when(text.rlike({"(?U)": "", "(?iuU)": "(?iu)"}[flags] + loose(pattern)), first(text, flags + pattern))
    if not literals:
        return first(text, flags + pattern)
    low = folded(text)
    return F.when(reduce(lambda a, b: a | b, [low.contains(x) for x in literals]), first(text, flags + pattern))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_span(text: Column, pattern: str) -> Column:
    """Byte offsets of the first match (null if none)."""
    start = F.octet_length(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1))
    hit = first(text, pattern)
    return F.when(hit.isNotNull(), F.struct(start.cast("int").alias("start"), (start + F.octet_length(hit)).cast("int").alias("end")))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def all_spans(text: Column, pattern: str, block: int = 128, length: Callable[[Column], Column] = F.octet_length) -> Column:
    """Byte offsets (or those that ``length`` counts) of all matches: gaps and matches alternate, so offsets are running sums of lengths.

    Sums run inside blocks and over blocks, as an array that grows by one would be copied at each step.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches(text, pattern).alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        a = acc["at"] + length(piece["gap"])
        b = a + length(piece["hit"])
        span = F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
        return F.when(piece["hit"].isNull(), acc).otherwise(F.struct(b.cast("int").alias("at"), F.concat(acc["spans"], span).alias("spans")))

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(block)), lambda i: F.aggregate(F.slice(p, i + 1, F.lit(block)), nothing, step))

    def glued(b: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        more = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
        shift = lambda x, s: F.transform(x["spans"], lambda p: F.struct((p["start"] + s).alias("start"), (p["end"] + s).alias("end")))
        return F.flatten(F.zip_with(b, F.aggregate(b, begin, more)["starts"], shift))

    return bound(bound(pieces, blocks), glued).cast(SPAN)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def count_true(flags: list[Column]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total


def byte_prefix(text: Column, n: Column) -> Column:
    """The text's first ``n`` bytes (n on a character border)."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), n), "UTF-8")


def byte_suffix(text: Column, n: Column) -> Column:
    """What follows the text's first ``n`` bytes."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), n + 1, F.lit(2**31 - 1)), "UTF-8")
