"""Secret scan with a random forest that removes false positives (operator 2).

Candidates come from patterns: values assigned to names such as *token* or *api key*, well-known key
formats, private-key headers, passwords in URLs, and long mixed runs of key characters. Each is described by
its length, how its character classes follow one another, its entropy, how much of it common
words cover, the path it stands under and the words beside it; a random forest (bagged Gini trees over
random feature subsets) turns that into a score, and candidates below ``THRESHOLD`` are dropped as false positives.

The forest is trained from labelled findings: rows of ``text, start, length, path, label``. Findings that a
reviewer labelled can be passed to :func:`train`; without any there are two kinds. :func:`corpus_findings` takes
key-like runs of the documents themselves, labelled by what stands around them (a known key format, or a name
that assigns a secret, against a word that says hash, commit or version, or no such word at all): about
``CORPUS_SAMPLE`` documents, drawn by hash, are read for it, and about ``CORPUS_FINDINGS`` of each label, drawn by
hash again, go to the driver. :func:`labelled_findings`
makes a fixed, bounded set from rules (keys of many shapes in assigning contexts against hashes, ids,
placeholders, words, paths and numbers in theirs).

The dictionary of the coverage feature holds the ``DICTIONARY`` words of all documents that occur most often
(at least ``LEAST_COUNT`` times) and the fixed :data:`WORDS`.

A candidate keeps its place in code points, never its value: the digest is what is returned. A private key is a
candidate from its header's label to its footer's, with all that stands between, or its header's label without a footer.

Defined cases: null or empty text has no candidates; overlapping candidates count once, the first
pattern first; very long texts and values are scanned whole, in linear time; rows that repeat come back each; an
empty table gives an empty result; a null path counts as empty; extra columns are ignored, whatever their names;
ids stay as they are (they never leave Arrow).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, documents, saved, session

THRESHOLD = 0.5
TREES, DEPTH, LEAST_LEAF = 25, 8, 3
FINDINGS = 3000
#: Findings of each label that :func:`corpus_findings` takes, about; words of the dictionary and how often they occur at least.
CORPUS_FINDINGS, DICTIONARY, LEAST_COUNT = 1000, 20_000, 5
#: Documents that findings to learn from are taken from, about (all, if there are fewer).
CORPUS_SAMPLE = 20_000
NAME = r"(?:token|secret|passwo?r?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|client[_-]?key)"

#: Public key formats. The group ``v`` is the candidate. Lengths have no upper bound but where the format
#: is one of fixed length; possessive repeats and starts at run borders keep the scan linear.
PATTERNS = [
    ("private_key", re.compile(r"-----BEGIN (?P<v>[A-Z ]*PRIVATE KEY(?=-----)(?:-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY(?=-----))?)")),
    ("cloud_key_id", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})\b")),
    ("forge_token", re.compile(r"\b(?P<v>gh[pousr]_[A-Za-z0-9]{36,}+)\b")),
    ("chat_token", re.compile(r"\b(?P<v>xox[abprs]-[A-Za-z0-9-]{10,}+)")),
    ("map_key", re.compile(r"\b(?P<v>AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])")),
    ("payment_key", re.compile(r"\b(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+)\b")),
    ("web_token", re.compile(r"\b(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})")),
    ("url_password", re.compile(r"://[^\s:/@]*+:(?P<v>[^\s:/@]{6,}+)@")),
    ("assigned", re.compile(r"(?<![\w.-])(?=[\w.-]*?" + NAME + r")[\w.-]++[\"']?\s*+(?:=|:=?|=>)\s*+[\"']?(?P<v>[^\s\"',;<>()\[\]{}#]{8,}+)", re.I)),
    ("long_run", re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<v>[A-Za-z0-9+/_-]{24,}+={0,2}+)(?![A-Za-z0-9+/_=-])")),
]
#: Runs of a web token's characters, and where one may begin in them: its pattern alone would read a run anew from each such place.
TOKEN_RUN, TOKEN_MARK = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++"), re.compile(r"\beyJ")
#: Only texts with one of these need the slower patterns.
HINTS = {
    "private_key": "-----BEGIN ", "forge_token": "gh", "chat_token": "xox", "map_key": "AIza", "payment_key": "k_", "web_token": "eyJ", "url_password": "://",
}

NAME_HINTS = ("token", "secret", "pass", "pwd", "key", "auth", "credential")

#: Words that make up placeholders, names and prose.
WORDS = """access account admin alpha auth beta bucket build cache change changeme client code common config connect
content create data database debug default demo develop device document dummy email error event example fake field file
folder format function group hash header hello here host http https image index input insert internal item json key level
library list local login main manager message method model module name null number object option output page panel param
pass password path placeholder port private product project public query random record remote report request result
role sample schema search secret select server service session setting simple source start state status string style
system table target task temp test text title token type update upload user username value version view window world
xxxx your""".split()
#: Words beside a candidate that speak for, or against, a secret.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "login", "private")
AGAINST = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "etag", "integrity", "example", "sample", "version", "build", "trace", "id")
PATH_SAFE = ("test", "example", "sample", "fixture", "mock", "doc", "readme", "lock", "vendor")
PATH_RISKY = ("config", "env", "secret", "deploy", "prod", "settings", "credential", "yml", "yaml", "properties")
CLASS_NAMES = "lower upper digit other".split()
BESIDE = 48


class Dictionary:
    """Words of four letters and more; :meth:`coverage` is the share of a value's characters that they cover."""

    def __init__(self, words: list[str]):
        self.automaton = ahocorasick.Automaton()
        for w in {*words, *WORDS}:
            if len(w) >= 4:
                self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def coverage(self, value: str) -> float:
        low = value.lower()
        return sum(n for _, n in self.automaton.iter_long(low)) / max(1, len(low))


@cache
def fixed_words() -> Dictionary:
    return Dictionary([])


def frequent_words(docs: DataFrame) -> list[str]:
    """The ``DICTIONARY`` most frequent words of four letters and more of all documents, ties by code points."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 4")
    counts = saved(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
    # How often the last word that is taken occurs: from the numbers of words by count, as a sorted limit would send that many words of every task to the driver.
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = by_count.withColumn("upto", F.sum("words").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)))
    last = upto.where(F.col("upto") >= DICTIONARY).orderBy(F.desc("n")).select("n", F.col("upto") - F.col("words")).first() or (0, 0)
    found = [r.w for r in counts.where(F.col("n") > last[0]).select("w").collect()]
    ties = counts.where(F.col("n") == last[0]).select("w").orderBy("w").limit(DICTIONARY - last[1]).collect() if last[0] else []
    discard(counts)
    return sorted([*found, *(r.w for r in ties)])


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(text: str, start: int, length: int, path: str | None, pattern: str, words: Dictionary | None = None) -> list[float]:
    value = text[start : start + length]
    kinds = [kind_of(c) for c in value]
    n = len(value)
    steps = Counter(zip(kinds[:-1], kinds[1:], strict=True))
    share = Counter(kinds)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0
    before, after = text[max(0, start - BESIDE) : start].lower(), text[start + length : start + length + BESIDE].lower()
    near = re.findall(r"[a-z0-9]+", before)[-4:] + re.findall(r"[a-z0-9]+", after)[:2]
    where = (path or "").lower()
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / max(1, n)
    return [
        n, *(steps[a, b] / max(1, n - 1) for a in range(4) for b in range(4)), *(share[k] / max(1, n) for k in range(4)),
        entropy, entropy / max(1.0, math.log2(max(2, n))), len(counts) / max(1, n), hexes, (words or fixed_words()).coverage(value), max((len(r) for r in re.findall(r"[a-z]+", value)), default=0),
        sum(any(w in x for w in FOR) for x in near), sum(x in AGAINST or x.endswith("sum") for x in near), float(before.rstrip("\"' ")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
        sum(w in where for w in PATH_SAFE), sum(w in where for w in PATH_RISKY), float(len(where)), float(pattern == "assigned"), float(pattern not in ("assigned", "long_run")),
        float(value.count("/") > 1), float(value.count("-") >= 4), float("." in value),
    ]


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """(pattern, start, length) of each candidate, in code points, ascending."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    low = text.lower()
    for name, pattern in PATTERNS:
        # Cheap tests that can't be false where the pattern matches.
        if name in HINTS and HINTS[name] not in text or name == "assigned" and not any(h in low for h in NAME_HINTS):
            continue
        if name == "long_run" and max(map(len, text.split()), default=0) < 24:
            continue
        if name == "web_token":
            found = [(*span, name) for m in TOKEN_RUN.finditer(text) for span in web_tokens(m[0], m.start())]
        else:
            found = [(*m.span("v"), name) for m in pattern.finditer(text)]
        if name == "long_run":
            found = [f for f in found if any(map(str.isdigit, text[f[0] : f[1]])) and any(map(str.isalpha, text[f[0] : f[1]]))]
        taken = merged(taken, found)
    return [(name, a, b - a) for a, b, name in taken]


def web_tokens(run: str, start: int) -> list[tuple[int, int]]:
    """Places of three dotted parts in a run that begins at ``start``: the first begins with the mark of such a token. Each part is looked at once."""
    if "eyJ" not in run:
        return []
    parts = run.split(".")
    ends = list(accumulate((len(p) + 1 for p in parts), initial=start))
    found, k = [], 0
    while k + 2 < len(parts):
        mark = TOKEN_MARK.search(parts[k]) if len(parts[k + 1]) >= 8 and len(parts[k + 2]) >= 4 else None
        if mark and len(parts[k]) - mark.start() >= 11:
            found.append((ends[k] + mark.start(), ends[k + 3] - 1))
            k += 3
        else:
            k += 1
    return found


def merged(taken: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``taken`` and those of ``found`` that overlap none of it; both ascending and disjoint, as is the result."""
    new, k = [], 0
    for f in found:
        while k < len(taken) and taken[k][1] <= f[0]:
            k += 1
        if k == len(taken) or f[1] <= taken[k][0]:
            new.append(f)
    return sorted(taken + new) if new else taken


class Forest:
    """Random forest of binary trees in flat arrays: feature, threshold, left child, share of ones."""

    def __init__(self, seed: int = 11):
        self.seed, self.trees = seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        for _ in range(TREES):
            pick = rng.integers(0, len(y), len(y))
            self.trees.append(self.grow(x[pick], y[pick], rng))
        return self

    def grow(self, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, child, share = [0], [0.0], [-1], [float(y.mean())]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            ones = y[rows].sum()
            if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or ones in (0, len(rows)):
                continue
            best = (0.0, -1, 0.0)
            for f in rng.permutation(x.shape[1])[: int(math.sqrt(x.shape[1])) + 2]:
                order = np.argsort(x[rows, f], kind="stable")
                v, left = x[rows[order], f], np.cumsum(y[rows[order]])[:-1]
                n = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
                if ok.any():
                    # Gini impurity is least where the sum of squared ones and zeros by side is greatest.
                    right = ones - left
                    gain = (left**2 + (n - left) ** 2) / n + (right**2 + (len(rows) - n - right) ** 2) / (len(rows) - n)
                    gain = np.where(ok, gain - (ones**2 + (len(rows) - ones) ** 2) / len(rows), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
            if best[1] < 0:
                continue
            feature[node], cut[node], child[node] = best[1], best[2], len(feature)
            low = x[rows, best[1]] <= best[2]
            for part in (rows[low], rows[~low]):
                todo.append((len(feature), part, depth + 1))
                feature.append(0), cut.append(0.0), child.append(-1), share.append(float(y[part].mean()))
        return np.array(feature), np.array(cut), np.array(child), np.array(share)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees."""
        total = np.zeros(len(x))
        for feature, cut, child, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = child[node] >= 0
                node = np.where(inner, child[node] + (x[np.arange(len(x)), feature[node]] > cut[node]), node)
            total += share[node]
        return total / len(self.trees)


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, length, path, label): a fixed set of ``n`` findings made from rules, half of them secrets."""
    draw = random.Random(seed)
    some = lambda alphabet, a, b: "".join(draw.choice(alphabet) for _ in range(draw.randint(a, b)))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: draw.choice(WORDS) if draw.random() < 0.3 else some("aeiou" + string.ascii_lowercase, 2, 9)
    prose = lambda k: " ".join(word() for _ in range(k))
    good = [
        lambda: some(hexes, 32, 32), lambda: some(hexes, 40, 40), lambda: some(hexes, 64, 64), lambda: some(mixed, 20, 48), lambda: some(mixed + "+/", 40, 40),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + some(mixed, 36, 36), lambda: "sk_live_" + some(mixed, 24, 24),
        lambda: "xoxb-" + some(string.digits, 10, 12) + "-" + some(mixed, 24, 24), lambda: some(mixed + "!$%&*@^", 10, 20),
        lambda: "eyJ" + some(mixed, 20, 30) + "." + some(mixed, 30, 60) + "." + some(mixed, 20, 43),
    ]
    bad = [
        lambda: "_".join(draw.choice(WORDS) for _ in range(draw.randint(2, 5))), lambda: "your-" + "-".join(draw.choice(WORDS) for _ in range(3)), lambda: "x" * draw.randint(8, 40),
        lambda: "/".join(word() for _ in range(draw.randint(3, 7))) + draw.choice(["", "1", ".v2"]), lambda: "${" + draw.choice(WORDS).upper() + "_TOKEN}", lambda: some(string.digits, 12, 24),
        lambda: draw.choice(WORDS) + draw.choice(["1", "123", "2024", "01"]), lambda: "".join(draw.choice(WORDS).title() for _ in range(draw.randint(3, 5))) + some(string.digits, 0, 2),
    ]
    names = ["token", "secret", "password", "api_key", "auth_token", "access-key", "client_secret", "db_password", "private_key", "API_TOKEN"]
    paths = ["", "src3", "web", "config/prod.yml", "deploy/.env", "src/settings.py", "README.md", "tests/fixtures/a.json", "docs/example.txt", "package-lock.json"]
    out = []
    for k in range(n):
        secret = k % 2 == 0
        if secret:
            value = draw.choice(good)()
            lead = draw.choice([f'{draw.choice(names)} = "', f"{draw.choice(names)}: ", f"{draw.choice(names)}='", f"export {draw.choice(names).upper()}=", f"the {draw.choice(names)} := "])
        elif draw.random() < 0.5:
            # The shape of a key in a context that says what it is.
            value = draw.choice([good[0], good[1], good[2], lambda: "-".join(some(hexes, m, m) for m in (8, 4, 4, 4, 12)), good[3]])()
            lead = draw.choice(["commit ", "sha256: ", "md5 = ", "checksum ", 'integrity "sha512-', "uuid: ", 'etag: "', "revision ", "digest = ", "trace id ", "build hash "])
        else:
            value = draw.choice(bad)()
            lead = draw.choice([f'{draw.choice(names)} = "', f"{draw.choice(names)}: ", "see ", "path ", "number ", f"set {draw.choice(names)}="])
        before = prose(draw.randint(0, 6))
        text = f"{before} {lead}" if before else lead
        out.append((text + value + draw.choice(['"', "", "'", ";"]) + " " + prose(draw.randint(0, 5)), len(text), len(value), draw.choice(paths), int(secret)))
    return out


def pattern_at(text: str, start: int) -> str:
    return next((name for name, a, _ in candidates(text) if a == start), "long_run")


#: Runs that could be keys to the eye: what :func:`corpus_findings` labels.
WIDE = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_-]{12,}+={0,2}+(?![A-Za-z0-9+/_=@-])")


def label_of(text: str, start: int, length: int, pattern: str) -> int | None:
    """1 for a secret, 0 for none, as the surroundings of a key-like run tell; None where they don't."""
    value = text[start : start + length]
    beside = re.findall(r"[a-z0-9]+", text[max(0, start - BESIDE) : start].lower())[-3:]
    mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
    if any(w in AGAINST or w.endswith("sum") for w in beside):
        return 0
    if pattern not in ("assigned", "long_run"):
        return 1
    if pattern == "assigned":
        return int(mixed and len(set(value)) >= 8)
    # A run without a name before it: words and numbers are no secrets, a long mixed one may be.
    return None if mixed and length >= 24 else 0


def corpus_findings(docs: DataFrame, path: str = "source", most: int = CORPUS_FINDINGS) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings of ``docs``, about ``most`` of each label: (text, start, length, path, label), with the text beside the run alone."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = [(a, a + n, name) for name, a, n in candidates(text)]
                wide = [(*m.span(), "long_run") for m in WIDE.finditer(text or "")]
                for a, b, name in merged(known, wide):
                    label = label_of(text, a, b - a, name)
                    if label is not None:
                        begin = max(0, a - BESIDE)
                        piece = text[begin : b + BESIDE]
                        draw = int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")
                        rows.append((piece, a - begin, b - a, where or "", label, draw))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    ddl = "text string, start bigint, length bigint, path string, label bigint, draw bigint"
    shape = to_arrow_schema(StructType.fromDDL(ddl))
    share = CORPUS_SAMPLE / max(CORPUS_SAMPLE, docs.count())
    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("text", F.col(path).cast("string").alias("path"))
    # Pieces that repeat have one draw: they count once.
    found = saved(rows.mapInArrow(run, ddl).distinct(), "findings")
    wanted = F.lit(False)
    for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        wanted |= (F.col("label") == r.label) & (F.col("draw") < int(2**56 * min(1.0, most / r.n)))
    return sorted((r.text, r.start, r.length, r.path, r.label) for r in found.where(wanted).collect())


def train(findings: list[tuple[str, int, int, str, int]] | None = None, words: Dictionary | None = None) -> Forest:
    """Forest from labelled findings (text, start, length, path, label)."""
    rows = labelled_findings() if findings is None else findings
    return Forest().fit(features(rows, words), np.array([y for *_, y in rows], float))


def features(rows: list[tuple[str, int, int, str, int]], words: Dictionary | None = None) -> np.ndarray:
    return np.array([describe(t, a, n, p, pattern_at(t, a), words) for t, a, n, p, _ in rows])


def quality_of(forest: Forest, findings: list[tuple[str, int, int, str, int]], words: Dictionary | None = None) -> tuple[float, float]:
    """Precision and recall over labelled findings."""
    said = forest.predict(features(findings, words)) >= THRESHOLD
    true = np.array([bool(y) for *_, y in findings])
    both = float((said & true).sum())
    return both / max(1.0, float(said.sum())), both / max(1.0, float(true.sum()))


def scan(docs: DataFrame, forest: Forest, path: str = "source", words: list[str] | None = None) -> DataFrame:
    """One row per candidate: doc_id, pattern, start, length, value_sha256, score, secret."""
    session(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col(path).cast("string").alias("path"))
    added = "pattern string, start bigint, length bigint, value_sha256 string, score double, secret boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(words or [])
        for batch in batches:
            at, rows, x = [], [], []
            for k, (text, where) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for name, a, n in candidates(text):
                    at.append(k)
                    rows.append((name, a, n, hashlib.sha256(text[a : a + n].encode("utf-8", "surrogatepass")).hexdigest()))
                    x.append(describe(text, a, n, where, name, known))
            if rows:
                score = forest.predict(np.array(x))
                columns = [pa.array(v) for v in zip(*rows, strict=True)]
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                names = ["doc_id", "pattern", "start", "length", "value_sha256", "score", "secret"]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(score), pa.array(score >= THRESHOLD)], names)

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *StructType.fromDDL(added).fields]))


def held_out() -> Column:
    """Documents whose findings no forest learns from, for measuring."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = frequent_words(docs)
    findings = labelled_findings() + corpus_findings(docs.where(~held_out()))
    return scan(docs, train(findings, Dictionary(words)), words=words)
