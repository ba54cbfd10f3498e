"""Private spans beside other numbers, and the defined results."""

import random

import pytest

from tessella.llm import pii

CASES = {
    "call +1 (826) 555-4081 19.137.223.204 now": {("PHONE", "+1 (826) 555-4081"), ("IP", "19.137.223.204")},
    "from 19.137.223.204 (826) 555-4081 now": {("IP", "19.137.223.204"), ("PHONE", "(826) 555-4081")},
    "tel +44-20-7946-0958 ok": {("PHONE", "+44-20-7946-0958")},
    "ring +49 151 1234 56789 soon": {("PHONE", "+49 151 1234 56789")},
    "card 4111111111111111 12/25 ok": {("CARD", "4111111111111111")},
    "pay 12 4111 1111 1111 1111 ok": {("CARD", "4111 1111 1111 1111")},
    "seen at 127.204.92.12 then": {("IP", "127.204.92.12")},
    "to ES91 2100 0418 4502 0005 1332 1234 ok": {("IBAN", "ES91 2100 0418 4502 0005 1332")},
    "mail ann@gmail.com now": {("EMAIL", "ann@gmail.com")},
    "no number": set(),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card() -> str:
        head = "4" + digits(14)
        return next(head + d for d in "0123456789" if pii._luhn(head + d))

    rows = []
    for _ in range(150):
        octets = [rng.randrange(1, 256) for _ in range(4)]
        parts = [f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(map(str, octets)), card(), f"x{digits(2)}@mail{digits(1)}.com", "aB3" + digits(9) + "xYzKq"]
        rows.append(" word then ".join(["some", *parts, "end"]))
    texts = [*rows, *CASES, None, "", "   "]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_overlapping_proposals_reach_the_vote(corpus):
    docs, texts = corpus
    found: dict[int, set] = {}
    for r in pii.find(docs, pii.fit(docs)).collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.span
        found.setdefault(r.doc_id, set()).add((r.kind, r.span))
    got = {t: found.get(i, set()) for i, t in enumerate(texts) if t in CASES}
    assert got == CASES
    assert all(len(found[i]) == 5 for i in range(150))
    assert not set(found) & {len(texts) - 3, len(texts) - 2, len(texts) - 1}


def test_redact_replaces_what_find_finds(corpus):
    docs, texts = corpus
    model = pii.fit(docs)
    for r in pii.redact(docs, model).collect():
        want = texts[r.doc_id]
        for s in reversed(model.find(want)) if want else []:
            want = want[: s.start] + f"[{s.kind}]" + want[s.end :]
        assert r.text == want


def test_every_border_of_a_group_is_proposed():
    got = {(s.kind, s.start, s.end) for s in pii.propose("4111111111111111 12/25")}
    assert ("CARD", 0, 16) in got and ("CARD", 0, 19) in got
