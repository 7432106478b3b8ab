import random
from itertools import combinations

import pytest

from tickweave.llm import decontaminate as d


def test_no_allowed_overlap_is_without_a_hit():
    for n in range(d.SHORTEST, 25):
        window = min(n, d.WINDOW)
        masks = (*d.MASKS, d.SHORT) if n < 7 else d.MASKS
        for missed in combinations(range(window), d.allowed(n)):
            assert any(not {p + o for o in m} & set(missed) for m in masks for p in range(window - m[-1]))


def plain(docs, items):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for i, text in docs:
        w, best = words(text), []
        for k, item in items:
            x = words(item)
            size = min(len(x), d.WINDOW)
            if len(x) < d.SHORTEST:
                continue
            most = 0
            for at in range(1 - len(x), len(w)):
                same = [0 <= at + j < len(w) and w[at + j] == x[j] for j in range(len(x))]
                most = max(most, max(sum(same[s : s + size]) for s in range(len(x) - size + 1)))
            if most >= size - d.allowed(len(x)):
                best.append((most, -k))
        out[i] = (bool(best), len(best), -max(best)[1] if best else None)
    return out


def case(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)] + ["the", "of", "and"]
    pick = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [pick(n) for n in (4, 5, 6, 7, 9, 12, 14, 15, 16, 20, 40)]
    docs = []
    for _ in range(60):
        body, item = pick(r.randint(0, 40)), list(r.choice(items))
        for _ in range(r.randint(0, 5)):
            item[r.randrange(len(item))] = "other"
        at = r.randint(0, len(body))
        docs.append(" ".join(body[:at] + (item[r.choice([0, 0, 3]) :] if r.random() < 0.8 else []) + body[at:]))
    docs += [None, "", " ".join(items[-1]).upper().replace(" ", "!! | ")]
    return list(enumerate(docs)), [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")]


@pytest.mark.parametrize("seed, words, bits", [(1, 400_000, 1 << 27), (2, 30, 1 << 27), (3, 30, 1 << 6)])
def test_equals_brute_force(spark, make, monkeypatch, seed, words, bits):
    """Seeds that are broadcast, and those that pass a filter, also one that is nearly full."""
    monkeypatch.setattr(d, "BROADCAST_WORDS", words)
    monkeypatch.setattr(d, "FILTER_BITS", bits)
    docs, items = case(seed)
    out = d.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["row"]["doc_id"]: (r["contaminated"], r["n_items"], r["item_id"]) for r in out} == plain(docs, items)


@pytest.mark.parametrize("words", [400_000, 1])
def test_rows_without_ids_and_shared_ids(spark, monkeypatch, words):
    monkeypatch.setattr(d, "BROADCAST_WORDS", words)
    docs = spark.createDataFrame([(None, "so one two three four five six it goes"), (None, "clean"), (4, "one two three four five six"), (4, "other"), (5, None)], "doc_id long, text string")
    found = d.overlaps(docs, spark.createDataFrame([(1, "One, two; three four five SIX")], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["matched"]) for r in found) == [("4", 1, 6), ("None", 1, 6)]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "same words in two rows of it"), (2, "no id here at all but words")], "item_id long, text string")
    out = d.decontaminate(odd, items).collect()
    assert len(out) == odd.count() and [r["contaminated"] for r in out if r["row"]["doc_id"] == 3] == [True, True]
    assert [r["contaminated"] for r in out if r["row"]["doc_id"] is None] == [False]
    assert d.decontaminate(none, items).collect() == []
    assert not any(r["contaminated"] for r in d.decontaminate(odd, items.limit(0)).collect())


@pytest.mark.parametrize("words", [400_000, 1])
def test_main_path_has_no_python(spark, make, monkeypatch, words):
    monkeypatch.setattr(d, "BROADCAST_WORDS", words)
    docs, items = case(1)
    plan = d.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan.replace("applySchemaToPythonRDD", "")
