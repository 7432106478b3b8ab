import base64
import gzip
import hashlib
from collections import defaultdict

from tickweave.llm import warc
from tickweave.runtime import Scratch

SCHEMA = "page_id long, url string, html string, digest string"


def plain(rows):
    groups = defaultdict(list)
    for i, _, html, _ in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html, _ in rows:
        body, top = (html or "").encode(), max((x for x in groups[html or ""] if x is not None), default=None)
        first = i == top or top is None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", f"<p>{i % 40}é\r\n\r\nWARC/1.1" * (i % 40), "z") for i in range(300)] + [(900, None, None, None), (901, "u", "", None), (None, "u", "q", "q"), (902, "v", "big" * 400_000, None)]
    manifest, uri = warc.write_archives(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), roll=2_000)
    out = warc.read_archives(manifest, uri)
    assert result(out) == plain(rows)
    bodies = {r["page_id"]: r["payload"] for r in out.where("record_type = 'response'").collect()}
    assert bytes(bodies[902]) == b"big" * 400_000 and bytes(bodies[299]) == rows[299][2].encode()
    assert manifest.count() > 4 and manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_same_bytes_twice_and_order(spark):
    rows = [(i * 7 % 101, f"http://x/{i}", "body %d" % i, None) for i in range(101)]
    names = []
    for _ in range(2):
        manifest, uri = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark, "t"), roll=1_000)
        listed = manifest.orderBy("file").collect()
        names.append([(r["file"], r["sha256"]) for r in listed])
    assert names[0] == names[1]
    ids = []
    for r in listed:
        path = f"{uri.removeprefix('file://')}/{r['file']}"
        with gzip.open(path) as stream:
            ids += [int(h["x-page-id"]) for h, _ in warc.parse_records(stream)]
        assert hashlib.sha256(open(path, "rb").read()).hexdigest() == r["sha256"]
    assert ids == sorted(ids)


def test_empty_table_and_repeated_rows(spark):
    manifest, uri = warc.write_archives(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert manifest.collect() == [] and warc.read_archives(manifest, uri).collect() == []
    rows = [(1, "u", "same", None), (1, "u", "same", None), (0, "u", "same", None)]
    manifest, uri = warc.write_archives(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))
    assert result(warc.read_archives(manifest, uri)) == plain(rows)


def test_parts_depend_on_the_rows_alone(spark):
    """Other partitions, sessions' settings and ids far apart: the same files, of ranges of about the wanted size."""
    rows = [(i, "u", f"body {i} " * 20, None) for i in range(2000)] + [(10**17 + i, "u", f"far {i} " * 20, None) for i in range(300)] + [(-(2**63), "u", "least", None), (2**63 - 1, "u", "most", None)]
    frame, seen = spark.createDataFrame(rows, SCHEMA), []
    for n in (1, 7):
        manifest, uri = warc.write_archives(frame.repartition(n), Scratch(spark, "t"), part=20_000)
        seen.append(sorted(map(tuple, manifest.collect())))
        assert result(warc.read_archives(manifest, uri)) == plain(rows)
    assert seen[0] == seen[1] and 10 < len(seen[0]) < 60 and sum(r[2] for r in seen[0]) == len(rows)


def test_a_name_can_be_given_twice(tmp_path):
    from pyarrow import fs

    store, old, new = fs.LocalFileSystem(), str(tmp_path / "_a.1.tmp"), str(tmp_path / "a")
    for left in (b"", b"ha"):  # nothing, or half a copy of an attempt that was lost
        open(old, "wb").write(b"half")
        if left:
            open(new, "wb").write(left)
        for _ in range(2):
            warc._rename(store, old, new, 4)
        assert open(new, "rb").read() == b"half"


def test_many_equal_groups_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"b{i % 30}", None) for i in range(200)] + [(None, "u", "b3", None), (None, None, None, None), (300, None, "", None)]
    manifest, uri = warc.write_archives(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))
    assert result(warc.read_archives(manifest, uri)) == plain(rows)
