"""The two appliers of text modifications. Spans are byte offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardspark.functions import text as T


def spliced(text: Column, m: Column) -> Column:
    return F.concat(T.byte_prefix(text, m["span_start"]), m["content"], T.byte_suffix(text, m["span_end"]))


def injected(text: Column, m: Column) -> Column:
    return F.when(m["position"] == "before", F.concat(m["content"], text)).when(m["position"] == "replace", m["content"]).otherwise(F.concat(text, m["content"]))


def by_span(mods: Column) -> Column:
    """Span starts descending, ties and lists with a missing span in their own order."""
    whole = F.forall(mods, lambda m: m["span_start"].isNotNull())
    keyed = F.transform(mods, lambda m, i: F.struct((-m["span_start"]).alias("k"), i.alias("i"), m.alias("m")))
    by = F.array_sort(keyed, lambda a, b: F.when(a["k"] != b["k"], F.when(a["k"] < b["k"], -1).otherwise(1)).otherwise(a["i"] - b["i"]))
    return F.when(whole, F.transform(by, lambda k: k["m"])).otherwise(mods)


def apply_library(text: Column, mods: Column) -> Column:
    """Spans from the back; a redaction without a valid span does nothing."""

    def step(t: Column, m: Column) -> Column:
        size = F.octet_length(t)
        valid = m["span_start"].isNotNull() & (m["span_start"] < size) & (m["span_end"] <= size) & (m["span_start"] < m["span_end"])
        return F.when(m["kind"] == "redact", F.when(valid, spliced(t, m)).otherwise(t)).otherwise(injected(t, m))

    return F.aggregate(by_span(mods), text, step)


def apply_service(text: Column, mods: Column) -> Column:
    """In declaration order; a redaction without a valid span replaces the whole text."""

    def step(t: Column, m: Column) -> Column:
        valid = m["span_start"].isNotNull() & (m["span_start"] < m["span_end"]) & (m["span_end"] <= F.octet_length(t))
        return F.when(m["kind"] == "redact", F.when(valid, spliced(t, m)).otherwise(m["content"])).otherwise(injected(t, m))

    return F.aggregate(mods, text, step)
