"""SQL expressions of the classifiers, for the queries' counterparts."""

from __future__ import annotations

from guardspark.functions import lexicons as L
from guardspark.functions.text import any_of
from guardspark.plans.fixtures import listed, literal


def rx(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {literal(pattern)})"


def first(t: str, pattern: str) -> str:
    return f"nullif(regexp_extract({t}, {literal(pattern)}), '')"


def hits(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {literal(pattern)}))"


def tox(t: str) -> str:
    return "least(0.95::DOUBLE, 0.35::DOUBLE * (" + " + ".join(f"contains(lower({t}), '{w}')::INT" for w in L.TOXIC) + "))"


def sent(t: str) -> str:
    p, n = hits(t, any_of(L.POSITIVE)), hits(t, any_of(L.NEGATIVE))
    return f"(CASE WHEN {p} + {n} = 0 THEN 0.5 ELSE {p}::DOUBLE / ({p} + {n}) END)::DOUBLE"


def pii(t: str) -> str:
    return "(" + " OR ".join(rx(t, p) for _, p in L.PII) + ")::INT::DOUBLE"


def cascade(t: str, categories, default: str, value: int) -> str:
    out = "CASE"
    for c in categories:
        v = literal(c[0]) if value == 0 else f"{c[1]}::DOUBLE"
        out += f" WHEN {rx(t, any_of(c[-1]))} THEN {v}"
    return f"{out} ELSE {default} END"


def inj(t: str, value: int = 1) -> str:
    return cascade(t, L.INJECTION, "'clean'" if value == 0 else "0.0::DOUBLE", value)


def adv(t: str, value: int = 1) -> str:
    return cascade(t, L.ADVICE, "'information'" if value == 0 else "0.1::DOUBLE", value)


def sequence(t: str) -> str:
    words = f"list_transform(regexp_split_to_array({t}, '[^A-Za-z]+'), lambda x: lower(x))"
    count = lambda terms: f"len(list_filter({words}, lambda w: list_contains({listed(terms)}, w)))"
    p, n = count(L.SEQUENCE_POSITIVE), count(L.SEQUENCE_NEGATIVE)
    return f"""CASE WHEN {p} = 0 AND {n} = 0 THEN 0.5 WHEN {n} = 0 THEN least(0.99, greatest(0.92, 0.92 + ({p} - 1) * 0.03))
 WHEN {p} = 0 THEN least(0.08, greatest(0.01, 0.08 - ({n} - 1) * 0.02)) ELSE least(0.9, greatest(0.1, {p}::DOUBLE / ({p} + {n}))) END"""


#: Scores of the five classifiers for every text of ``guard``.
SCORED = f"""scored AS (SELECT text_id, text, {tox('text')} AS tox, {sent('text')} AS sent, {pii('text')} AS pii, {inj('text')} AS inj, {adv('text')} AS adv FROM guard)"""


def drawn(key: str, seed: int, n: int) -> str:
    return f"(('0x' || md5({key} || ':{seed}')[1:12])::BIGINT % {n})"


def between(key: str, seed: int, low: int, high: int) -> str:
    return f"({drawn(key, seed, high - low)} + {low})"


def pick(values: list[str], key: str, seed: int) -> str:
    return f"({listed(values)})[({drawn(key, seed, len(values))} + 1)::INT]"


def fake(kind: str, key: str, seed: int = 0) -> str:
    from guardspark.sources import datagen as G

    n = lambda k, a, b: between(key, seed * 100 + k, a, b)
    some = lambda values, k: pick(values, key, seed * 100 + k)
    return {
        "ssn": f"format('{{:03d}}-{{:02d}}-{{:04d}}', {n(1, 100, 999)}, {n(2, 10, 99)}, {n(3, 1000, 9999)})",
        "credit_card": f"format('{{:04d}} {{:04d}} {{:04d}} {{:04d}}', {n(1, 4000, 4999)}, {n(2, 1000, 9999)}, {n(3, 1000, 9999)}, {n(4, 1000, 9999)})",
        "email": f"{some(G.NAMES, 1)} || '@' || {some(G.DOMAINS, 2)}",
        "phone": f"format('({{:03d}}) {{:03d}}-{{:04d}}', {n(1, 200, 999)}, {n(2, 200, 999)}, {n(3, 1000, 9999)})",
        "address": f"{n(1, 100, 9999)} || ' ' || {some(G.STREETS, 2)} || ', ' || {some(G.CITIES, 3)} || ', CA ' || {n(4, 90000, 99999)}",
        "name": f"{some(G.FIRST, 1)} || ' ' || {some(G.LAST, 2)}",
    }[kind]


def planted(text: str, kind: str, key: str, probability: float, seed: int) -> str:
    from guardspark.sources import datagen as G

    if kind == "pii":
        phrase = f"{literal(G.PII_LEAD['ssn'])} || {fake('ssn', key, seed)} || '.'"
    else:
        phrase = pick({"toxicity": G.TOXICITY["moderate"], "injection": G.INJECTIONS, "financial": G.ADVICE}[kind], key, seed + 1)
    after = f"concat_ws(' ', {text}, {phrase})"
    out = f"CASE WHEN {drawn(key, seed + 2, 2)} = 0 THEN concat_ws(' ', {phrase}, {text}) ELSE {after} END" if kind == "injection" else after
    return f"CASE WHEN {drawn(key, seed + 3, 1_000_000)} < {int(probability * 1_000_000)} THEN {out} ELSE {text} END"
