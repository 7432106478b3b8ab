import hashlib
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_near_dedup import plain as plain_near
from tickweave.llm import decontaminate, toxicity
from tickweave.runtime import table

@pytest.fixture(scope="module")
def by_hand(spark):
    """The stages, done plainly one after the other."""
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.train(docs, table(spark, SF_SMALL, "labels"), toxicity.held_out)
    rows = [x for x in rows if model.score(x[1]) < toxicity.THRESHOLD]
    seen, kept = set(), []
    for i, text in sorted(rows):
        key = " ".join(re.split(r"[\x20\x09-\x0D]+", text or ""))
        if key not in seen:
            seen.add(key)
            kept.append((i, text))
    near = plain_near(kept)
    kept = [x for x in kept if near[x[0]][2]]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    return kept, {i for i, text in kept if leaks(text, items)}


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(text, items):
    """Whether an item's window occurs, over all alignments in which a word is shared; for texts of any length."""
    words, where = words_of(text), defaultdict(list)
    for at, word in enumerate(words):
        where[word].append(at)
    for _, body in items:
        item = words_of(body)
        n = len(item)
        if n < decontaminate.SHORTEST:
            continue
        size, agree = min(n, decontaminate.WINDOW), defaultdict(set)
        for i, word in enumerate(item):
            for at in where.get(word, ()):
                agree[at - i].add(i)
        need = size - decontaminate.allowed(n)
        for same in agree.values():
            if len(same) >= need and any(sum(i in same for i in range(a, a + size)) >= need for a in range(n - size + 1)):
                return True
    return False


def test_leaks_equal_the_plain_comparison(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect() if len((r["text"] or "").split()) < 300][:120]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_SMALL, "benchmark").collect()]
    plain = plain_leaks(docs, items)
    assert {i for i, text in docs if leaks(text, items)} == {i for i, v in plain.items() if v[0]}


def test_run_equals_plain_stages(spark, by_hand, library):  # noqa: F811
    kept, leaked = by_hand
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    want = {i: t for i, t in kept if i not in leaked}
    assert set(out) == set(want)
    for i, row in out.items():
        ids = library.encode_ordinary(want[i] or "")
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((want[i] or "").encode()).hexdigest()

def test_stages_keep_columns_and_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF_SMALL).columns == odd.columns, name
        assert stage(spark, none, SF_SMALL).collect() == [], name
    exact = corpus_pipeline.drop_copies(spark, odd, SF_SMALL)
    assert exact.where("doc_id = 1").count() == 0 and exact.where("doc_id = 0").count() == 1
    assert exact.where("doc_id = 3").count() == 1
    near = corpus_pipeline.drop_near_copies(spark, odd, SF_SMALL)
    assert near.where("doc_id is null").count() == 1 and near.where("doc_id = 2").count() == 1 and near.where("doc_id = 3").count() == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_told_apart_by_themselves(spark):
    """Null ids and ids that rows share: copies and leaks go, whatever their ids; innocent rows stay."""
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:30] + ["x"] + base[31:])
    rows = [
        (None, " ".join(base), "a"), (None, near, "b"), (7, " ".join(base), "c"), (7, "quite another text of some words here", "d"), (8, f"before {item} after", "e"),
        (8, "an innocent text that shares its id with a leak", "f"), (None, f"so it goes {item} and on", "g"), (9, "said twice in two equal rows", "h"), (9, "said twice in two equal rows", "h"),
        (None, "no id and said twice", "i"), (None, "no id and said twice", "i"), (None, "an innocent text without an id", "j"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)
    left = lambda frame: sorted(r["source"] for r in frame.collect())
    exact = corpus_pipeline.drop_copies(spark, docs, SF_SMALL)
    assert left(exact) == sorted("bcdefghij")
    assert left(corpus_pipeline.drop_near_copies(spark, exact, SF_SMALL)) == sorted("cdefhij")  # the two leaks are near copies
    assert left(corpus_pipeline.drop_near_copies(spark, docs, SF_SMALL)) == sorted("cdefhij")
    clean = corpus_pipeline.drop_leaks(spark, docs, SF_SMALL)
    assert left(clean) == sorted("abcdfhhiij")
    coded = corpus_pipeline.tokens(spark, clean, SF_SMALL)
    assert coded.count() == 10 and coded.where("doc_id is null").count() == 5
