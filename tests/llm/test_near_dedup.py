import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tests.conftest import SF_CHECK
from tickweave.llm import near_dedup
from tickweave.llm.components import connected_components
from tickweave.runtime import Scratch


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain(rows):
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def corpus(seed, groups=25, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, words))]
        if g % 3 == 0:
            base[10:10] = passage
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 35))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["one two", "One  TWO", "", None, "É a b c d e f", "é a b c d e f"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, make, seed):
    rows = corpus(seed)
    assert result(near_dedup.near_components(make(rows), Scratch(spark, "t"))) == plain(rows)


@pytest.mark.parametrize("large", [0, 4])
def test_open_nodes_branch_and_the_last_level_is_whole(spark, make, monkeypatch, large):
    """With tiny limits all ways are used: exhaustive nodes, pivots, branches and blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "LEVELS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    rows = corpus(3, groups=30, words=120)
    assert result(near_dedup.near_components(make(rows), Scratch(spark, "t"))) == plain(rows)


def indexed(rows):
    """Components by counting the common shingles of all pairs, from an index of shingles."""
    sets, posts = {i: sets_of(t) for i, t in rows}, defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in posts[s])
        for j, both in common.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
        for s in sets[i]:
            posts[s].append(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_no_link_is_lost_in_documents(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(near_dedup.near_components(docs, Scratch(spark, "t"))) == indexed(rows)


def test_odd_rows(spark, odd, none):
    out = result(near_dedup.near_components(odd, Scratch(spark, "t")))
    assert out[0] == (0, 0, True) and out[1] == (0, 1, True) and out[3][1:] == (3, True) and out[None][1] is None
    assert near_dedup.near_components(none, Scratch(spark, "t")).collect() == []


def test_null_ids(spark, make):
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g"), (None, "q r s t u v w"), (None, "q r s t u v w")]
    out = near_dedup.near_components(make(rows), Scratch(spark, "t")).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in out))) == sorted(map(str, [(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)]))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    labels = {r["id"]: r["label"] for r in connected_components(links, Scratch(spark, "t")).collect()}
    assert all(labels[i] == 0 for i in range(201)) and labels[501] == 500 and None not in labels
