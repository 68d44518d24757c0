"""Text without the tricks that hide words from classifiers, and the way back to the source.

Zero-width characters go; separators go where they stand between single characters ("g u a r", "g.u.a.r"); look-alike letters, full-width forms
and digits that stand for letters become plain lower-case ones, each a single character. What goes is cut out of the source between *pieces*,
so the map from the folded text back is one pair of offsets a piece, and a match in the folded text gives its place in the source with all
that was hidden inside.

All of it is JVM expressions over one row. Fold for term lists only: digits become letters, so patterns of numbers belong on the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark.functions import text as T

# Characters without width, characters that are put between letters, digits for letters, and letters of other scripts that look Latin.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
SEPARATORS = r"\s._*~|-"
LEET = {"4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "@": "a", "$": "s"}
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ս": "u", "օ": "o", "ո": "n", "հ": "h", "ց": "g", "ı": "i",
}
CUT = f"[{SEPARATORS}{ZERO_WIDTH}]+"


def plain() -> tuple[str, str]:
    """Characters and what they become, one for one: upper case, full width, look-alikes (in either case) and digits."""
    table = {chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}
    table |= {chr(0xFF21 + k + 32 * low): chr(ord("a") + k) for k in range(26) for low in (0, 1)}
    table |= {k.upper(): v for k, v in LOOK_ALIKE.items() if len(k.upper()) == 1 and not k.upper().isascii()} | LOOK_ALIKE | LEET
    return "".join(table), "".join(table.values())


FROM, TO = plain()


def prefix_sums(lengths: Column, block: int = 128) -> Column:
    """For each number the sum of those before it. Sums run inside blocks and over blocks, as an array that grows by one would be copied at each step."""
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(block)), lambda i: F.aggregate(F.slice(x, i + 1, F.lit(block)), nothing, step))

    def glued(b: Column) -> Column:
        starts = F.aggregate(b, nothing, lambda acc, x: step(acc, x["at"]))["sums"]
        return F.flatten(F.zip_with(b, starts, lambda x, s: F.transform(x["sums"], lambda n: n + s)))

    return T.bound(T.bound(lengths, blocks), glued)


def pieces(text: Column) -> Column:
    """array<struct<gap, hit, kept>>: text between cuts, the characters of the cut behind it, and those of them that stay."""
    raw = F.arrays_zip(F.split(text, CUT, -1).alias("gap"), T.matches(text, CUT).alias("hit"))

    def cut(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            hit = F.coalesce(x["hit"], F.lit(""))
            single = (F.length(x["gap"]) == 1) & (F.length(F.get(p, i + 1)["gap"]) == 1)
            gone = F.coalesce(single, F.lit(False)) | ~hit.rlike(f"[^{ZERO_WIDTH}]")
            return F.struct(x["gap"].alias("gap"), hit.alias("hit"), F.when(gone, "").otherwise(hit).alias("kept"))

        return F.transform(p, one)

    return T.bound(raw, cut)


def with_folded(df: DataFrame, text: str, folded: str = "folded", places: str = "places", wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with the folded text and its map, array<struct<folded, source>>: where each piece begins, in characters; null where the folded text isn't ``wanted``."""
    name = f"_{folded}_pieces"
    df = df.withColumn(name, pieces(F.coalesce(text, F.lit(""))))
    whole = F.array_join(F.transform(name, lambda p: F.concat(p["gap"], p["kept"])), "")
    lengths: Callable[[str], Column] = lambda f: F.transform(name, lambda p: F.length(p["gap"]) + F.length(p[f]))
    pairs = F.arrays_zip(prefix_sums(lengths("kept")).alias("folded"), prefix_sums(lengths("hit")).alias("source"))
    df = df.withColumn(folded, F.translate(whole, FROM, TO))
    return df.withColumn(places, pairs if wanted is None else F.when(wanted(F.col(folded)), pairs)).drop(name)


def source_place(places: Column, at: Column) -> Column:
    """Where a character of the folded text stands in the source (in characters). The last piece that begins there or before has it: an empty one has no character."""
    home = F.try_element_at(F.filter(places, lambda p: p["folded"] <= at), F.lit(-1))
    return home["source"] + at - home["folded"]


def source_spans(folded: Column, places: Column, pattern: str) -> Column:
    """Spans in the source (in characters) of what a pattern matches in the folded text, cuts inside of them included."""
    spans = T.all_spans(folded, pattern, length=F.length)
    return F.transform(spans, lambda s: F.struct(source_place(places, s["start"]).cast("int").alias("start"), (source_place(places, s["end"] - 1) + 1).cast("int").alias("end")))


def byte_spans(text: Column, spans: Column) -> Column:
    """Spans in characters as spans in bytes."""
    upto = lambda n: F.octet_length(F.substring(text, F.lit(1), n)).cast("int")
    return F.transform(spans, lambda s: F.struct(upto(s["start"]).alias("start"), upto(s["end"]).alias("end")))


def redacted(text: Column, spans: Column, replacement: str) -> Column:
    """The text with each of its spans (ascending, disjoint, in characters) replaced."""

    def piece(s: Column, i: Column) -> Column:
        open_ = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, open_ + 1, s["start"] - open_), F.lit(replacement))

    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.lit(2**31 - 1)))


def is_cut(c: str) -> bool:
    return re.fullmatch(CUT, c, re.ASCII) is not None


#: Characters that a cut may have and that become letters if it stays: a text with one of them is taken apart.
BOTH = "".join(c for c in FROM if is_cut(c))
#: What else a cut may have.
REST = "".join(c for c in map(chr, range(0x3000)) if is_cut(c) and c not in FROM) + "﻿"
# A cut that goes. The code point beyond the BMP makes Java look behind by code points.
_CUT = f"[{SEPARATORS}{ZERO_WIDTH}]"
_BESIDE = f"(?:[^{SEPARATORS}{ZERO_WIDTH}\U00010000]|\U00010000)"
GONE = f"(?:(?<=(?:\\A|{_CUT}){_BESIDE}){_CUT}++(?={_BESIDE}(?:{_CUT}|\\z))|[{ZERO_WIDTH}]++(?!{_CUT}))"


def in_source(term: str) -> str | None:
    """The pattern of what a folded term stands for in a source: each character in all of its forms, with a cut that goes between any two. A cut of the
    term's own has to stay as it is. None for a term that begins or ends with a cut."""
    parts = re.split(f"({CUT})", term, flags=re.ASCII)
    if not parts[0] or not parts[-1]:
        return None
    forms: dict[str, str] = {}
    for c, to in zip(FROM, TO, strict=True):
        forms[to] = forms.get(to, to) + c
    letters = lambda part: f"{GONE}?+".join("[" + "".join(map(T.escape, forms.get(c, c))) + "]" for c in part)
    return "".join(f"(?!{GONE}){T.escape(x)}(?!{_CUT})" if k % 2 else letters(x) for k, x in enumerate(parts))


def squeezed(text: Column) -> Column:
    """The folded text without all cuts."""
    return F.translate(text, FROM + REST, TO)


def protect(df: DataFrame, terms: list[str], text: str = "text", replacement: str = "[REDACTED]") -> DataFrame:
    """``df`` with ``hits`` (the terms found, in folded form), ``spans`` (bytes of the source) and ``protected``: the source with them replaced.

    Terms are folded like the text. What stands for them is looked for in the source itself, where the text has their characters in a row once all cuts
    are left out. Texts with characters that are both cuts and letters are taken apart, and all are for terms that a pattern can't tell.
    """
    low = list(dict.fromkeys(t.translate(str.maketrans(FROM, TO)) for t in terms))
    bare = {"".join(c for c in t if not is_cut(c)): t for t in low}
    sources = [in_source(t) for t in T.in_order(low)]
    if None in sources or len(bare) < len(low):
        return by_pieces(df, low, text, replacement)
    pattern = "|".join(f"(?:{x})" for x in sources)
    # A class of so many characters takes ten times as long as to leave them out.
    df = df.withColumn("_apart", F.coalesce(F.translate(text, BOTH, "") != F.col(text), F.lit(False)))
    # Null is an empty text, which costs nothing.
    df = df.withColumn("_source", F.when(F.col("_apart"), F.col(text)))
    df = by_pieces(df, low, "_source", replacement).withColumnsRenamed({c: f"_{c}" for c in ("hits", "spans", "protected")})
    may = ~F.col("_apart") & T.maybe(squeezed(F.col(text)), list(bare))
    df = df.withColumn("_found", F.when(may, T.matches(F.col(text), pattern)))
    meant = F.create_map(*[F.lit(x) for kv in bare.items() for x in kv])
    found = F.size("_found") > 0
    return df.withColumns({
        "hits": F.when(F.col("_apart"), F.col("_hits")).otherwise(F.coalesce(F.transform("_found", lambda x: meant[squeezed(x)]), F.array().cast("array<string>"))),
        "spans": F.when(F.col("_apart"), F.col("_spans")).when(found, T.all_spans(F.col(text), pattern)).otherwise(F.array().cast(T.SPAN)),
        "protected": F.when(F.col("_apart"), F.col("_protected")).when(found, F.regexp_replace(text, F.lit(pattern), F.lit(re.sub(r"([\\$])", r"\\\1", replacement)))).otherwise(F.col(text)),
    }).drop("_apart", "_source", "_found", "_hits", "_spans", "_protected")


def by_pieces(df: DataFrame, low: list[str], text: str, replacement: str) -> DataFrame:
    """As :func:`protect`, for any folded terms, with the pieces of a text put together again."""
    pattern = T.any_of(low)
    df = with_folded(df, text, "_folded", "_places", lambda folded: T.maybe(folded, low))
    found = T.maybe(F.col("_folded"), low)
    df = df.withColumn("_chars", F.when(found, source_spans(F.col("_folded"), F.col("_places"), pattern)).otherwise(F.array().cast(T.SPAN)))
    return df.withColumns({
        "hits": F.when(found, T.matches(F.col("_folded"), pattern)).otherwise(F.array().cast("array<string>")),
        "spans": byte_spans(F.col(text), F.col("_chars")), "protected": F.when(F.size("_chars") > 0, redacted(F.col(text), F.col("_chars"), replacement)).otherwise(F.col(text)),
    }).drop("_folded", "_places", "_chars")
