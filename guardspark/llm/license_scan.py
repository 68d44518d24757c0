"""Licence scan by a generalised suffix automaton (operator 11).

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. The words of all licence templates, the contract's
phrases among them, go into one suffix automaton, which every task builds from the templates (a few hundred words).

1. **Matching statistics.** A file is streamed through the automaton; at each word the state and length are the longest run of words up to
   here that stands in any template. Words that follow each other nowhere in the templates cut the file into runs first, so most of a file
   never reaches the automaton.
2. **Maximal matches.** At each word the suffix links give every place in a template at which a long enough match ends. It counts where the
   template's next word isn't the file's, so each template gets all of its maximal matches, whatever else matches longer.
3. **Chains.** Matches of a template follow each other in the file and in the template with at most ``GAP`` words between them; the chain that
   covers most of the template is its span. A template whose words are covered to ``LEAST`` gives its label. A phrase has to stand as a whole,
   and each of its places counts.

The score is the best share of a template that a chain covers, so it is 1 where a phrase or notice stands whole.

Defined cases: a text that is null, empty or without words has no words, no labels and the score 0; overlapping places count each; very long texts
are read whole, a slice at a time; rows that repeat a doc_id or have none are rows of their own; ids of any type stay as they are; an empty table
gives an empty result; extra columns are kept by :func:`scan`, whatever their names (its own are named beside them), and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, session, with_text
from .license_templates import NOTICES, PHRASES

#: Words of a match that counts (a shorter template has to match as a whole), words between two matches of a chain, share of a notice.
LONG, GAP, LEAST = 4, 10, 0.8
#: Bytes of a text that become words at once.
SLICE = 1 << 20
#: Every byte to itself in lower case, or to a space between words.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if len(folded) - at > SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[int, ...]
    phrase: bool

    @property
    def need(self) -> int:
        """Words that a match must have."""
        return len(self.words) if self.phrase else min(LONG, len(self.words))


class SuffixAutomaton:
    """All runs of words of several sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[tuple[int, ...]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for w in s:
                last = self.extend(last, w)
        #: Ends (sequence, words before) at the state of each prefix, then of each state by its suffix-link subtree.
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.step]
        for k, s in enumerate(sequences):
            at = 0
            for n, w in enumerate(s, 1):
                at = self.step[at][w]
                self.ends[at].add((k, n))
        for v in sorted(range(1, len(self.step)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def split(self, above: int, word: int) -> int:
        """The state that ``word`` leads to from ``above``, cut so that its longest run is one word longer than that of ``above``."""
        found = self.step[above][word]
        if self.length[found] == self.length[above] + 1:
            return found
        part = self.state(self.length[above] + 1, dict(self.step[found]), self.link[found])
        self.link[found] = part
        while above >= 0 and self.step[above].get(word) == found:
            self.step[above][word] = part
            above = self.link[above]
        return part

    def extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self.split(last, word)
        new = self.state(self.length[last] + 1, {}, 0)
        above = last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self.split(above, word)
        return new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run that ends at each word."""
        at = length = 0
        for w in words:
            while at and w not in self.step[at]:
                at = self.link[at]
                length = self.length[at]
            if w in self.step[at]:
                at, length = self.step[at][w], length + 1
            yield at, length


@dataclass
class Match:
    """``size`` words of a template up to ``end`` (of the template) and ``at`` (of the file, both exclusive), and the chain that ends here."""

    at: int
    end: int
    size: int
    covered: int = 0
    first: int = 0
    followed: bool = False


class Scanner:
    def __init__(self, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> None:
        self.known: dict[bytes, int] = {}
        number = lambda text: tuple(self.known.setdefault(w, len(self.known) + 1) for part in word_slices(text.encode()) for w in part)
        self.templates = [Template(label, number(text), True) for label, text in phrases] + [Template(label, number(text), False) for label, text in notices]
        self.automaton = SuffixAutomaton([t.words for t in self.templates])
        self.follows = np.zeros((len(self.known) + 1, len(self.known) + 1), bool)
        for t in self.templates:
            self.follows[list(t.words[:-1]), list(t.words[1:])] = True
        self.least = min(t.need for t in self.templates)
        self.reach = lru_cache(None)(self.reach)

    def numbers(self, text: bytes) -> np.ndarray:
        """The file's words as numbers, 0 for one that no template has."""
        get = self.known.get
        parts = [np.fromiter((get(w, 0) for w in words), np.int32, len(words)) for words in word_slices(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def reach(self, state: int) -> list[tuple[int, int, int]]:
        """Template, end and length of all matches long enough that end where ``state`` does; its own ends have length 0 (that of the walk)."""
        seen: dict[tuple[int, int], int] = {}
        size, at = 0, state
        while at > 0 and self.automaton.length[at] >= self.least:
            for end in self.automaton.ends[at]:
                seen.setdefault(end, size)
            at = self.automaton.link[at]
            size = self.automaton.length[at]
        return [(t, end, size) for (t, end), size in sorted(seen.items()) if not size or size >= self.templates[t].need]

    def matches(self, words: np.ndarray) -> dict[int, list[Match]]:
        """All maximal matches by template, in the order of the file."""
        found: dict[int, list[Match]] = {}
        if len(words) < 2:
            return found
        joined = np.concatenate(([False], self.follows[words[:-1], words[1:]], [False]))
        turns = np.flatnonzero(joined[1:] != joined[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            run = words[a : b + 1].tolist()
            for k, (state, length) in enumerate(self.automaton.walk(run)):
                if length < self.least:
                    continue
                following = run[k + 1] if k + 1 < len(run) else -1
                for t, end, size in self.reach(state):
                    template, size = self.templates[t], size or length
                    if size >= template.need and not (end < len(template.words) and template.words[end] == following):
                        found.setdefault(t, []).append(Match(a + k + 1, end, size))
        return found

    def chained(self, matches: list[Match]) -> list[Match]:
        """The same matches, each with the most template words that a chain up to it covers and where that chain starts."""
        oldest = 0
        reach = max((m.size for m in matches), default=0) + GAP
        for k, m in enumerate(matches):
            m.covered, m.first, before = m.size, m.at - m.size, None
            while matches[oldest].at < m.at - reach:
                oldest += 1
            for p in matches[oldest:k]:
                behind, below = m.at - m.size - p.at, m.end - m.size - p.end
                if behind > GAP or below > GAP or p.at >= m.at or p.end >= m.end or p.at - p.size > m.at - m.size or p.end - p.size > m.end - m.size:
                    continue
                covered = p.covered + m.size - max(0, -behind, -below)
                if covered > m.covered:
                    m.covered, m.first, before = covered, p.first, p
            if before is not None:
                before.followed = True
        return matches

    def scan(self, text: bytes) -> dict:
        words = self.numbers(text)
        places, base, labels, spans, score = [], set(), set(), [], 0.0
        for t, matches in self.matches(words).items():
            template = self.templates[t]
            if template.phrase:
                places += [m.at - m.size for m in matches]
                base.add(template.label)
                score = 1.0
                spans += [(template.label, m.at - m.size, m.at - 1, 1.0) for m in matches]
                continue
            for m in self.chained(matches):
                share = m.covered / len(template.words)
                score = max(score, share)
                if share >= LEAST:
                    labels.add(template.label)
                    if not m.followed:
                        spans.append((template.label, m.first, m.at - 1, share))
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score,
            "spans": [dict(zip(("label", "first", "last", "covered"), s, strict=True)) for s in sorted(spans)],
        }


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
SPANS = "spans array<struct<label: string, first: bigint, last: bigint, covered: double>>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (but ``text``) with a struct ``licenses`` (or that name with underscores, where taken): ``FIELDS`` and ``spans``."""
    session(docs.sparkSession)
    name = fresh("licenses", docs)

    def make():
        scanner = Scanner()
        return lambda texts: {name: [scanner.scan((t or "").encode("utf-8", "surrogatepass")) for t in texts]}

    inner = ", ".join(f"{n}: {kind}" for n, kind in (f.split() for f in FIELDS.split(", "))) + ", " + SPANS.replace("spans ", "spans: ", 1)
    return with_text(docs, f"{name} struct<{inner}>", make, text=text)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *[F.col(f"licenses.{n}").alias(n) for n in NAMES])
