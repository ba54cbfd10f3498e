"""Repeated windows against a dictionary of all windows."""

import random

from tessella.llm import suffix_dedup


def test_removed_words_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randrange(0, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "  "), (None, rows[3][1]), (7, "short")]
    seen, want = set(), {}
    best: dict[int, str] = {}
    for i, t in rows:
        if i is not None and t is not None and (len(t), t) > (len(best.get(i, "")), best.get(i, "")):
            best[i] = t
    for i in sorted(best):
        w = best[i].split()
        for at in range(len(w) - 7):
            window = tuple(w[at : at + 8])
            if window in seen:
                want.setdefault(i, set()).update(range(at, at + 8))
            seen.add(window)
    got: dict[int, set] = {}
    for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), threshold=8).filter("removed").collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want
