"""What a Python worker holds after the tasks of several operators; in a session with one worker, as others share several."""

import json
import subprocess
import sys

from tests.conftest import ROOT

SCRIPT = """
import json, random, sys, tempfile
import public_tokenizers as P
from pyspark.sql import SparkSession
from tickweave.llm import bpe, near_dedup

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
r = random.Random(1)
docs = spark.createDataFrame([(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(400))) for i in range(400)], "doc_id long, text string").repartition(1).cache()
docs.count()

def held(batches):
    import os, re
    import pyarrow as pa
    from tickweave.llm import bpe
    for _ in batches:
        pass
    mb = sum(map(int, re.findall(r"Rss(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/status").read()))) / 1024
    yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [bpe.codec.cache_info().currsize], "mb": [mb]})

def look():
    return spark.range(1).repartition(1).mapInArrow(held, "pid long, n long, mb double").collect()[0].asDict()

look()
near_dedup.sketches(docs, "doc_id", "text").collect()
first = look()
bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).write.format("noop").mode("overwrite").save()
coded = look()
near_dedup.sketches(docs, "doc_id", "text").collect()
print(json.dumps([first, coded, look()]))
"""


def test_a_worker_gives_back_what_the_last_operator_kept(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT, tmp_path.as_uri()], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert out.returncode == 0, out.stderr[-2000:]
    first, coded, last = json.loads(out.stdout.splitlines()[-1])
    assert first["pid"] == coded["pid"] == last["pid"]
    assert coded["n"] == 1, "the codec stays for the next task of its operator"
    assert last["n"] == 0
    assert coded["mb"] > first["mb"] + 25 and last["mb"] < first["mb"] + 20, (first, coded, last)
