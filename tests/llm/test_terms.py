"""Disclosing terms of the sanitisation against a plain recomputation over all documents."""

import math
import random
from collections import Counter

import pytest
import regex

from filetwin.llm.pii import find_pii, redact

WORD = regex.compile(r"[\p{L}\p{N}]+")
EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def wanted(texts, generalise_at, remove_at, min_support):
    """Per text its term spans as (start, end, removed)."""
    outside, owners = [], []
    for text in texts:
        spans = [m.span() for m in EMAIL.finditer(text or "")]
        owners.append({m.group().lower() for m in EMAIL.finditer(text or "")})
        free = [m for m in WORD.finditer(text or "") if not any(s < m.end() and e > m.start() for s, e in spans)]
        outside.append(free)
    n_term = Counter(t for free in outside for t in {m.group().lower() for m in free})
    n_entity = Counter(e for own in owners for e in own)
    both = Counter(
        (e, t) for own, free in zip(owners, outside) for e in own for t in {m.group().lower() for m in free}
    )
    strongest = {}
    for (entity, term), n in both.items():
        if n >= min_support and n_entity[entity] >= min_support:
            information = math.log2(len(texts) / n_entity[entity])
            told = 1 + math.log2(min(1.0, n / n_term[term])) / information if information > 0 else 0.0
            strongest[term] = max(strongest.get(term, 0.0), told)
    return [
        [
            (m.start(), m.end(), strongest[m.group().lower()] >= remove_at)
            for m in free
            if strongest.get(m.group().lower(), 0.0) >= generalise_at
        ]
        for free in outside
    ]


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(8)
    common = ["the", "a", "word", "Word", "wörter", "ÉTÉ", "été", "x1", "7", "𝒜bc", "İi", "straße", "STRASSE", "ſet", "set", "K", "k"]
    people = [(f"p{k}@mail.org", [f"Name{k}", f"town{k % 3}", f"Ñame{k}"]) for k in range(8)]
    out = []
    for k in range(160):
        words = [dice.choice(common) for _ in range(dice.choice([2, 10, 40]))]
        if dice.random() < 0.4:
            mail, told = dice.choice(people)
            words += [dice.choice([mail, mail.upper()])] * dice.choice([1, 2])
            words += [dice.choice([str.lower, str.upper, str])(t) for t in told if dice.random() < 0.8]
        elif dice.random() < 0.2:
            words.append(dice.choice(dice.choice(people)[1]))
        dice.shuffle(words)
        out.append(dice.choice([" ", ", ", "\n", "-"]).join(words))
    return [*out, None, "", "p1@mail.org " * 300, "Name1 " * 5000, "p2@mail.org.Name2", "name3name3 name3"]


@pytest.mark.parametrize("generalise_at, remove_at, min_support", [(0.75, 0.95, 2), (0.3, 0.98, 1), (0.5, 2.0, 4)])
def test_terms_against_brute_force(spark, texts, generalise_at, remove_at, min_support):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    told = wanted(texts, generalise_at, remove_at, min_support)
    settings = dict(generalise_at=generalise_at, remove_at=remove_at, min_support=min_support)
    found = {r.doc_id: r for r in find_pii(docs, **settings).collect()}
    for d, spans in enumerate(told):
        got = [s for s in found[d].spans.split(",") if s.startswith("term:")]
        assert got == [f"term:{s}:{e}" for s, e, _ in spans] and found[d].n_term == len(spans)
    assert sum(map(len, told)) > 100
    assert {r for spans in told for *_, r in spans} <= {False, True}
    left = {r.doc_id: r.text for r in redact(docs, **settings).collect()}
    for d, spans in enumerate(told):
        gone = {texts[d][s:e].lower() for s, e, _ in spans}
        assert not gone & {m.group().lower() for m in WORD.finditer(left[d] or "")} - {"name", "word", "number", "email"}
