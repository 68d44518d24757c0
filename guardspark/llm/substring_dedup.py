"""Substring deduplication over a sparse suffix array (operator 8).

Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes.

1. **Copies.** Of equal texts only the one with the smallest doc_id is worked on: every 50-byte string of
   a later copy starts in the first, so a later copy of 50 bytes or more goes as a whole. Texts with one SHA-256 are copies
   only if they are the same bytes; others are worked on like all. The texts are written once as a table in
   buckets, which later joins read without dealing texts again.
2. **Sparse suffixes.** Of the 27 suffixes that start in a 50-byte window's first 27 bytes, the one whose
   leading 24 bytes (its *tokens*) have the least hash is kept, so equal windows keep equal suffixes at
   equal places. A suffix matters only if its tokens occur in at least two documents: the hashes are dealt
   in packed blocks, each block answers for one task's documents, and hashes seen in two documents of one
   task need no answer. (Equal hashes of other tokens only let a suffix through that then meets none.)
3. **Splitters.** A sample of leading tokens, of a bounded number of documents, gives the splitters that range-partition
   the kept suffixes in order. A suffix travels with the 26 bytes on either side, which hold every 50-byte window around its
   tokens. Equal suffixes of one block of texts (a few MB) are sent once, by their smallest doc_id, with the
   others settled on the spot, so a passage in a third of all rows reaches its range once a block. Tokens that are a
   splitter themselves are dealt to all ranges that they border on: tokens of a large share of the sample are several
   splitters and so several ranges.
4. **Sort and compare.** Ranges are taken one at a time. Each sorts its suffixes by multikey quicksort over 8-byte tokens, once as
   they read on from their tokens and once as they read back, and the lengths that neighbours have in common say
   which of the 27 windows around the tokens are the same bytes; a window belongs to the smallest doc_id of those that have it and is
   marked in all others.
5. **Across borders.** Suffixes whose tokens are a splitter may stand on both sides of a border. What is not marked in a range
   is compared with what isn't in the others that have the same tokens, in the same way.
6. **Removal.** Marked windows meet their text again (bucketed join) and their union goes.

Strings are judged on the input, so matches inside removed parts count. All comparisons that decide are
on bytes; hashes only choose candidates.

Defined cases: null text is empty; texts under 50 bytes lose nothing; a string that repeats only inside
one document stays; rows that repeat a doc_id are separate texts of equal id, so neither removes from
the other; a null doc_id counts as large as 2**63 - 1 and comes back as null; ids are whole numbers of 64 bits; very long
texts are read whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, agreed, conf, discard, documents, join_by_group, partitions, saved, session, shared_dir, with_text
from .graph import sorted_groups

WINDOW = 50
LEAD = 24
#: Places at which the leading tokens may stand in a window; also the bytes needed on either side.
SPAN = WINDOW - LEAD + 1
SIDE = SPAN - 1
CONTEXT = SIDE + LEAD + SIDE
#: Documents, about, and leading tokens of one that are sampled for the splitters: what the driver holds.
SAMPLED, SAMPLE = 4096, 16
#: Ranges for each partition; one is held at a time.
RANGES = 8
LAST = 2**63 - 1
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the LEAD bytes at every position, by doubling."""
    x = (data.astype(np.uint64) + np.uint64(1)) * ODD[0]
    width = {}
    for k in (1, 2, 4, 8):
        width[k] = x
        if len(x) <= k:
            return np.zeros(0, np.uint64)
        x = x[:-k] * ODD[1] + (x[k:] ^ (x[k:] >> np.uint64(31)))
    sixteen, eight = x, width[8]
    n = len(data) - LEAD + 1
    x = sixteen[:n] * ODD[1] + eight[16 : 16 + n] * ODD[2]
    return (x ^ (x >> np.uint64(32))) * ODD[2]


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = pick(x[: len(x) - (width - done)], x[width - done :])
    return x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the suffixes that are least in some window."""
    h = lead_hashes(data)
    if len(h) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(h, SPAN, np.minimum)
    # The largest of the window minima that cover a position is its own hash if it is the least of one.
    pad = np.zeros(SPAN - 1, np.uint64)
    cover = sliding(np.concatenate((pad, least, pad)), SPAN, np.maximum)
    at = np.flatnonzero(cover == h)
    return at, h[at]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins (with the end)."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, starts, and of each kept suffix: position in data, number of its text, hash."""
    data, starts = joined(texts)
    at, h = anchors(data)
    doc = np.searchsorted(starts, at, "right") - 1
    inside = at + LEAD <= starts[doc + 1]
    return data, starts, at[inside], doc[inside], h[inside]


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    # Kept hashes are small ones; mixed again they are spread evenly.
    x = (h ^ (h >> np.uint64(29))) * ODD[0]
    return ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def chunks(pdf: pd.DataFrame, size: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Row numbers, doc ids and texts in runs of about ``size`` bytes."""
    row, ids, texts = pdf["row"].to_numpy(), pdf["doc_id"].to_numpy(), [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size or k == len(texts) - 1:
            yield row[a : k + 1], ids[a : k + 1], texts[a : k + 1]
            a, held = k + 1, 0


def by_group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``keys`` and the start of each run of equal keys in it (with the end)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.concatenate((np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), [len(k)])) if len(k) else np.zeros(1, np.int64)


def pack(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, values of that key as bytes)."""
    order, cuts = by_group(keys)
    v = values[order]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(keys[order[a]]), v[a:b].tobytes()


def hash_block(h: np.ndarray, row: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes() + row.astype("<i8").tobytes()


def shared_hashes(base: DataFrame, parts: int) -> DataFrame:
    """row, hashes: per document the suffix hashes (packed) that occur in another document too."""
    ranges = RANGES * parts

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, _, texts in chunks(pdf):
                _, _, _, doc, h = suffixes(texts)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
                h, row = h[new], ids[doc[new]]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate((first, [len(h)])))
                # One row a hash goes out; where this run has the hash twice, its documents know already.
                out_h, out_row = h[first], np.where(n > 1, -1, row[first])
                twice = np.repeat(n > 1, n)
                key = range_of(out_h, ranges)
                order, cuts = by_group(key)
                blocks = [hash_block(out_h[order[x:y]], out_row[order[x:y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({"key": key[order[cuts[:-1]]], "block": blocks, "kind": 0})
                yield pd.DataFrame(pack(row[twice], h[twice]), columns=["key", "block"]).assign(kind=1)

    dealt = in_ranges(base.select("row", "doc_id", "text").mapInPandas(send, "key bigint, block binary, kind int"), parts, ranges)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, _, g in by_range(batches):
            if kind == 1:
                yield pd.DataFrame({"row": g["key"], "hashes": g["block"]})
                continue
            held = g["block"].tolist()
            h = np.concatenate([np.frombuffer(x, "<u8", len(x) // 16) for x in held])
            row = np.concatenate([np.frombuffer(x, "<i8", len(x) // 16, len(x) // 2) for x in held])
            order, cuts = by_group(h)
            n = np.diff(cuts)
            again = order[np.repeat(n > 1, n)]
            again = again[row[again] >= 0]
            yield pd.DataFrame(pack(row[again], h[again]), columns=["row", "hashes"])

    return dealt.mapInPandas(answer, "row bigint, hashes binary").groupBy("row").agg(F.collect_list("hashes").alias("hashes"))


def in_ranges(rows: DataFrame, parts: int, ranges: int) -> DataFrame:
    """Rows of kind 0 dealt and sorted by their range (``key``), in order over the partitions; those of kind 1 by their row."""
    place = F.when(F.col("kind") == 0, F.floor(F.col("key") * parts / ranges)).otherwise(F.pmod(F.col("key"), F.lit(parts))).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions("kind", "key")


def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """(kind, key, rows): whole ranges of kind 0 one at a time, rows of kind 1 batch by batch."""
    rest: list[pd.DataFrame] = []

    def first() -> Iterator[pd.DataFrame]:
        for pdf in batches:
            local = pdf["kind"] == 1
            if local.any():
                rest.append(pdf[local])
            yield pdf[~local]
            if rest:
                return

    for g in sorted_groups(first(), ["key"]):
        yield 0, int(g["key"].iloc[0]), g
    for pdf in rest:
        yield 1, -1, pdf
    for pdf in batches:
        if len(pdf):
            yield 1, -1, pdf


def sample_splitters(base: DataFrame, ranges: int) -> np.ndarray:
    """Ascending leading tokens that cut the suffixes into ``ranges`` parts, from about ``SAMPLED`` documents whatever the table's size.

    Tokens that hold a large share come several times, so that as many ranges share them.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, _, texts in chunks(pdf):
                data, _, at, doc, h = suffixes(texts)
                # A few of each document, by hash.
                order = np.lexsort((h, doc))
                pick = order[ramp(np.bincount(doc, minlength=1)) < SAMPLE]
                yield pd.DataFrame({"tokens": [data[p : p + LEAD].tobytes() for p in at[pick]]})

    share = F.lit(SAMPLED / max(SAMPLED, base.count()))
    rows = base.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30)).select("row", "doc_id", "text")
    tokens = sorted(r.tokens for r in rows.mapInPandas(draw, "tokens binary").collect())
    return np.array([bytes(tokens[k * len(tokens) // ranges]) for k in range(1, ranges)] if tokens else [], f"S{LEAD}")


def contexts(data: np.ndarray, starts: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CONTEXT bytes around each suffix's tokens (zeros beyond the text) and how many of the text's bytes lie before and after."""
    padded = np.concatenate((np.zeros(SIDE, np.uint8), data, np.zeros(CONTEXT, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at].copy()
    before = np.minimum(at - starts[doc], SIDE)
    after = np.minimum(starts[doc + 1] - at - LEAD, SIDE)
    place = np.arange(CONTEXT)
    rows[(place < (SIDE - before)[:, None]) | (place >= (SIDE + LEAD + after)[:, None])] = 0
    return rows, before, after


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit tokens by multikey quicksort.

    A run is parted in three by its middle row's token: the lesser and the greater go on with the same token, the equal
    ones with the next. All runs of a round are parted at once.
    """
    order = np.arange(len(words))
    start, size, level = np.array([0]), np.array([len(words)]), np.array([0])
    while True:
        open_ = (size > 1) & (level < words.shape[1])
        start, size, level = start[open_], size[open_], level[open_]
        if not len(start):
            return order
        run = np.repeat(np.arange(len(start)), size)
        head = np.cumsum(size) - size
        at = start[run] + np.arange(len(run)) - head[run]
        rows = order[at]
        token = words[rows, level[run]]
        pivot = token[head + size // 2][run]
        less, more = token < pivot, token > pivot
        part = np.where(less, 0, np.where(more, 2, 1))
        counts = np.bincount(run * 3 + part, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(counts, 1) - counts
        to = np.empty(len(run), np.int64)
        for k in range(3):
            mine = part == k
            seen = np.cumsum(mine) - 1
            before = np.where(head > 0, seen[np.maximum(head - 1, 0)] + 1, 0)
            to[mine] = (begin[run, k] + seen - before[run])[mine]
        order[to] = rows
        start, size, level = begin.ravel(), counts.ravel(), (level[:, None] + np.array([0, 1, 0])).ravel()


def tokens_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit tokens."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def runs(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in ``order`` (with the end)."""
    differ = (words[order[1:]] != words[order[:-1]]).any(1)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], differ))), [len(order)]))


#: ``n`` is the number of places in the document.
RECORD = np.dtype([("context", np.uint8, CONTEXT), ("before", np.uint8), ("after", np.uint8), ("doc", "<i8"), ("row", "<i8"), ("n", "<i4")])
#: A run of successive marked windows.
MARK = np.dtype([("start", "<i8"), ("count", "<i4")])


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in ``counts``, in a row."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def marks_by_row(row: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """row, marks: window starts of each row as runs."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1))) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), MARK)
    out["start"] = start[first]
    out["count"] = start[np.concatenate((first[1:], [len(row)]))[: len(first)] - 1] - start[first] + 1
    return pd.DataFrame(pack(row[first], out), columns=["row", "marks"])


def windows_in(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``[i, o]``: the window that starts ``o`` bytes before suffix i lies in its text."""
    o = np.arange(SPAN)
    return (o <= before[:, None]) & (SIDE - o <= after[:, None])


def shared_runs(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows of bytes, and how many leading bytes each has in common with the one before it (the first: none)."""
    order = multikey_order(tokens_of(content))
    same = content[order[1:]] == content[order[:-1]]
    common = np.where(same.all(1), content.shape[1], same.argmin(1))
    return order, np.concatenate(([-1], common))


def numbered(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number for each row that is equal where the first ``length`` bytes are."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length) - 1
    return out


def settle(records: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """``[i, o]``: that window of record i also starts in a smaller doc_id of ``records``. ``valid`` are the windows to be looked at."""
    context, doc = np.ascontiguousarray(records["context"]), records["doc"]
    if valid is None:
        valid = windows_in(records["before"].astype(np.int64), records["after"].astype(np.int64))
    flags = np.zeros(valid.shape, bool)
    if not len(records):
        return flags
    order, common = shared_runs(context[:, SIDE:])
    near = common >= LEAD
    many = np.flatnonzero((near | np.concatenate((near[1:], [False])))[np.argsort(order)])
    if not len(many):
        return flags
    # As the suffixes read on, and as the bytes before them read back.
    on = shared_runs(np.ascontiguousarray(context[many, SIDE:]))
    back = shared_runs(np.ascontiguousarray(context[many, SIDE - 1 :: -1]))
    owners = doc[many]
    for o in range(SPAN):
        use = np.flatnonzero(valid[many, o])
        if len(use) < 2:
            continue
        # Equal windows are equal o bytes back and equal from the tokens on.
        key = numbered(*back, o)[use] * len(many) + numbered(*on, LEAD + SIDE - o)[use]
        by, cuts = by_group(key)
        at = use[by]
        owner = np.minimum.reduceat(owners[at], cuts[:-1])
        flags[many[at], o] = owners[at] > np.repeat(owner, np.diff(cuts))
    return flags


def marked(base: DataFrame, shared: DataFrame, splitters: np.ndarray, parts: int) -> DataFrame:
    """row, marks: per document the runs of window starts (packed) that also start in a smaller doc_id."""
    rows = base.select("row", "doc_id", "text").join(shared, "row")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists, done = pdf["hashes"].tolist(), 0
            for row, ids, texts in chunks(pdf):
                known = lists[done : done + len(texts)]
                done += len(texts)
                data, starts, at, doc, h = suffixes(texts)
                keep = np.zeros(len(h), bool)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                for k, blocks in enumerate(known):
                    keep[cuts[k] : cuts[k + 1]] = np.isin(h[cuts[k] : cuts[k + 1]], np.frombuffer(b"".join(blocks), "<u8"))
                at, doc = at[keep], doc[keep]
                if not len(at):
                    continue
                context, before, after = contexts(data, starts, at, doc)
                place, own_row, own_id = at - starts[doc], row[doc], ids[doc]
                words = np.concatenate((tokens_of(context), np.stack((before, after), 1).astype(np.uint64)), 1)
                order = multikey_order(words)
                cuts = runs(words, order)
                n = np.diff(cuts)
                group = np.empty(len(order), np.int64)
                group[order] = np.repeat(np.arange(len(n)), n)
                owner = np.minimum.reduceat(own_id[order], cuts[:-1])
                # Suffixes of larger doc_ids: every window of their context starts in the owner's text too.
                later = own_id > owner[group]
                r, o = np.nonzero(windows_in(before, after) & later[:, None])
                settled = marks_by_row(own_row[r], place[r] - o)
                yield settled.set_axis(["key", "block"], axis=1).assign(kind=1, places=None)
                # The owner's go to their range, once a document, with all their places in it.
                mine = np.flatnonzero(~later)
                mine = mine[np.lexsort((own_row[mine], group[mine]))]
                new = np.concatenate(([True], (group[mine][1:] != group[mine][:-1]) | (own_row[mine][1:] != own_row[mine][:-1])))
                lead = mine[new]
                tokens = np.ascontiguousarray(context[lead, SIDE : SIDE + LEAD]).view(f"S{LEAD}").ravel()
                # Tokens that are a splitter, or several, are spread over the ranges beside it.
                low, high = np.searchsorted(splitters, tokens, "left"), np.searchsorted(splitters, tokens, "right")
                key = low + (own_row[lead] * 0x9E3779B1 >> 16) % (high - low + 1)
                record = np.zeros(len(lead), RECORD)
                for name, values in (("context", context), ("before", before), ("after", after), ("doc", own_id), ("row", own_row)):
                    record[name] = values[lead]
                record["n"] = np.diff(np.concatenate((np.flatnonzero(new), [len(mine)])))
                lists_of = np.split(place[mine].astype("<i4"), np.flatnonzero(new)[1:])
                order, cuts = by_group(key)
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pd.DataFrame({
                    "key": key[order[cuts[:-1]]],
                    "block": [record[order[x:y]].tobytes() for x, y in spans],
                    "kind": 0,
                    "places": [b"".join(lists_of[k].tobytes() for k in order[x:y]) for x, y in spans],
                })

    dealt = in_ranges(rows.mapInPandas(send, "key bigint, block binary, kind int, places binary"), parts, len(splitters) + 1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for kind, key, g in by_range(batches):
            if kind == 1:
                yield pd.DataFrame({"row": g["key"], "marks": g["block"]}).assign(border=None, block=None, places=None, open=None)
                continue
            records, where = np.frombuffer(b"".join(g["block"]), RECORD), np.frombuffer(b"".join(g["places"]), "<i4")
            flags = settle(records)
            yield marks_of(records, where, flags).assign(border=None, block=None, places=None, open=None)
            # What is left of the tokens at this range's borders is compared with the other ranges that have them.
            tokens = np.ascontiguousarray(records["context"][:, SIDE : SIDE + LEAD]).view(f"S{LEAD}").ravel()
            left = windows_in(records["before"].astype(np.int64), records["after"].astype(np.int64)) & ~flags
            for border in {*splitters[max(key - 1, 0) : key + 1].tolist()}:
                at = np.flatnonzero((tokens == border) & left.any(1))
                if len(at):
                    bits = (left[at].astype(np.uint32) << np.arange(SPAN, dtype=np.uint32)).sum(1, dtype=np.uint32)
                    n = records["n"][at].astype(np.int64)
                    begin = (np.cumsum(records["n"].astype(np.int64)) - records["n"])[at]
                    own = where[np.repeat(begin, n) + ramp(n)]
                    block = {"border": int(np.searchsorted(splitters, np.array(border, splitters.dtype))), "block": records[at].tobytes(), "places": own.tobytes(), "open": bits.tobytes()}
                    yield pd.DataFrame([{"row": None, "marks": None, **block}]).astype({"row": "Int64"})

    compared = saved(dealt.mapInPandas(compare, "row bigint, marks binary, border bigint, block binary, places binary, open binary"), "compared")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["border"]):
            records, where = np.frombuffer(b"".join(g["block"]), RECORD), np.frombuffer(b"".join(g["places"]), "<i4")
            bits = np.frombuffer(b"".join(g["open"]), "<u4")
            left = (bits[:, None] >> np.arange(SPAN, dtype=np.uint32) & 1).astype(bool)
            yield marks_of(records, where, settle(records, left))

    borders = compared.where("border is not null").select("border", "block", "places", "open").repartition("border").sortWithinPartitions("border")
    marks = compared.where("row is not null").select("row", "marks").unionByName(borders.mapInPandas(across, "row bigint, marks binary"))
    done = saved(marks.groupBy("row").agg(F.collect_list("marks").alias("marks")), "marks")
    discard(compared)
    return done


def marks_of(records: np.ndarray, where: np.ndarray, flags: np.ndarray) -> pd.DataFrame:
    """row, marks of the flagged windows, at all places of their records."""
    r, o = np.nonzero(flags)
    n = records["n"].astype(np.int64)
    begin = np.cumsum(n) - n
    start = where[np.repeat(begin[r], n[r]) + ramp(n[r])].astype(np.int64) - np.repeat(o, n[r])
    return marks_by_row(np.repeat(records["row"][r], n[r]), start)


def remove(text: bytes, blocks: list[bytes]) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed and the bytes that stay."""
    marks = np.frombuffer(b"".join(blocks), MARK)
    if not len(marks):
        return 0, 0, text
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, marks["start"], 1)
    np.add.at(step, marks["start"] + marks["count"] - 1 + WINDOW, -1)
    gone = np.cumsum(step)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def bucketed(docs: DataFrame, parts: int) -> DataFrame:
    """row (a number of its own), doc_id (null ones as the last), own (the doc_id as it is), digest and text of every row, written once in buckets of ``row``."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("doc_id"), F.col("doc_id").alias("own"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    name = f"substring_rows_{uuid.uuid4().hex}"
    writer = rows.repartition(parts, "row").write.bucketBy(parts, "row").option("compression", "zstd").option("path", shared_dir(spark, "substring-rows"))
    with conf(spark, **{CLEANUP: "true"}):
        writer.saveAsTable(name)
    table = spark.table(name)
    table.schema
    # The frame knows its files and buckets; the catalog needs no entry for them.
    spark.sql(f"DROP TABLE {name}")
    return table


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    spark = session(docs.sparkSession)
    parts = partitions(spark)
    base = bucketed(docs, parts)
    size = F.octet_length("text")
    long = saved(base.where(size >= WINDOW).select("row", "doc_id", "digest"), "digests")
    groups = long.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = saved(groups.select("digest", F.col("first.doc_id").alias("first"), F.col("first.row").alias("at"), "n"), "copied")
    same = agreed(base.select("digest", "row", "text"), groups, "digest", "at", "row")
    confirmed = saved(groups.join(same, "digest", "left_semi"), "copied")
    copies = saved(join_by_group(long, confirmed, "digest", "n", long.count()).where("doc_id > first").select("row"), "copies")
    discard(long, groups, confirmed)
    work = base.where(size >= WINDOW).join(copies, "row", "left_anti")
    shared = shared_hashes(work, parts)
    shared = saved(shared, "shared")
    marks = marked(base, shared, sample_splitters(work, RANGES * parts), parts)
    discard(shared)
    out = base.select("row", "own", "text").join(marks, "row", "left").join(copies.withColumn("copy", F.lit(True)), "row", "left")

    def cut(rows: list[dict]) -> dict[str, list]:
        done: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for r in rows:
            text = r["text"].encode("utf-8", "surrogatepass")
            removed, spans, kept = (len(text), 1, b"") if r["copy"] else remove(text, r["marks"] or [])
            for values, x in zip(done.values(), (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                values.append(x)
        return done

    rows = out.select(F.col("own").alias("doc_id"), F.struct("text", "marks", "copy").alias("parts"))
    return with_text(rows, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", lambda: cut, text="parts")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).drop("kept")


#: Every window of 50 bytes with the smallest doc_id that has it; what stays is glued together as hex digits.
OP8_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, k, h[k + 1:k + 50] AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, octet_length(h) - 49))) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, k, lag(k) OVER p AS before, lead(k) OVER p AS after FROM w JOIN m USING (s) WHERE doc_id > owner WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k, after, before IS NULL OR k > before + 50 AS opens, least(50, coalesce(after - k, 50)) AS gone FROM g),
n AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE opens)::BIGINT AS n_spans FROM r GROUP BY doc_id),
-- Bytes that stay: up to the first window, and between a window's end and the next window.
e AS (SELECT doc_id, 0 AS a, min(k) AS b FROM g GROUP BY doc_id UNION ALL SELECT doc_id, k + 50, coalesce(after, 2147483647) FROM g WHERE after IS NULL OR after > k + 50),
t AS (SELECT doc_id, string_agg(hex(h[a + 1:least(b, octet_length(h))]), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) WHERE least(b, octet_length(h)) > a GROUP BY doc_id)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_removed IS NULL THEN h ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
