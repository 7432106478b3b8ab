from collections import defaultdict

from pyspark.sql import functions as F

from tickweave.llm.exact_dedup import exact_dedup


def plain(rows):
    import re

    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(g), len(g), i == min(g)) for g in groups.values() for i in g)


def result(frame):
    return sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in frame.collect())


def test_groups(make):
    rows = list(enumerate(["a b", "a  b", "a\tb", "a b ", "A b", None, "", " ", " ", "x" * 300_000, "x" * 300_000] + ["hot copy"] * 500))
    assert result(exact_dedup(make(rows))) == plain(rows)


def test_colliding_hashes_do_not_merge_texts(make):
    rows = list(enumerate(["a", "b", "a", "c", "b"]))
    assert result(exact_dedup(make(rows), key=lambda body: F.lit("same"))) == plain(rows)


def test_odd_rows(odd, none):
    out = exact_dedup(odd)
    assert out.count() == odd.count() and out.select("row.*").columns == odd.columns
    kept = [r["id"] for r in out.where("kept").collect()]
    assert kept.count(3) == 2 and None in kept and 1 not in kept
    assert exact_dedup(none).collect() == []
