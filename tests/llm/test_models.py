import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tickweave.llm import langid, secrets, toxicity


def texts(seed, n, bad):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        body = [r.choice(words) for _ in range(60)]
        if i % 5 == 0:
            body[r.randrange(60)] = r.choice(bad)
            body[r.randrange(60)] = r.choice(bad)
        out.append((i, " ".join(body), int(i % 5 == 0)))
    return out


def test_toxicity_learns_and_holds_out(spark):
    rows = texts(1, 1500, ["vile", "nasty", "awful"])
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 1), (4, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.held_out)
    scored = toxicity.score_texts(docs, model).select("row.doc_id", "score").collect()
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    hit = [(r["score"] >= toxicity.THRESHOLD) == bool(rows[r["doc_id"]][2]) for r in scored if r["doc_id"] in held]
    assert sum(hit) / len(hit) > 0.97 and len(model.index) < 5000
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped, toxicity.held_out)
    assert (again.weight == model.weight).all() and again.intercept == model.intercept


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, toxicity.held_out)
    out = toxicity.score_texts(odd, model)
    assert out.count() == odd.count() and out.select("row.*").columns == odd.columns
    assert {r["score"] for r in out.collect()} == {0.5}
    assert toxicity.score_texts(none, model).collect() == []


def test_langid_on_held_out_documents(spark):
    rows = langid.op2_langid(spark, SF_CHECK).where("held_out").join(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_rejects_and_odd_rows(spark, odd, none):
    model = langid.train(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), langid.held_out)
    out = langid.identify(odd, model).collect()
    by = {r["row"]["doc_id"]: r for r in out}
    assert len(out) == odd.count() and by[0]["lang_pred"] == by[1]["lang_pred"] == by[4]["lang_pred"] == "und" and by[0]["score"] == 0.0
    assert by[3]["lang_pred"] != "und"
    far = spark.createDataFrame([(1, "漢字仮名交じり文 " * 20)], "doc_id long, text string")
    assert langid.identify(far, model, reject=True).first()["lang_pred"] == "und"
    assert langid.identify(none, model).collect() == []
    untrained = langid.train(none, langid.held_out)
    assert langid.identify(odd, untrained).first()["lang_pred"] == "und"


def plain_counts(text, dims):
    """n-grams one by one, with whole numbers."""
    squeezed, last = [], True
    for c in text.lower():
        if c.isalpha() or last:
            squeezed.append(ord(c) if c.isalpha() else 32)
        last = c.isalpha()
    full, shift, out = (1 << 64) - 1, 64 - (dims.bit_length() - 1), [0] * dims
    for i in range(len(squeezed)):
        h = None
        for k in range(3):
            if i + k >= len(squeezed):
                break
            a = (squeezed[i + k] + 1) * 0x9E3779B97F4A7C15 & full
            h = a if h is None else ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + a) & full
            out[((h ^ (h >> 32)) * (0x94D049BB133111EB + 2 * k) & full) >> shift] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 64, 1 << 20])
def test_langid_counts_for_any_chunk(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ("Hello, big  World 12 again", "  x", "ab", "İstanbul ΣΑΣ. ß", "a1b2c3 " * 40):
        assert list(langid.counts(text, 256)) == plain_counts(text, 256)


def test_langid_equals_brute_force(spark):
    """Document frequencies, clusters, nearest centroid and limit, computed plainly on small data."""
    import math

    r = random.Random(4)
    words = {"aa": ["kala", "meri", "talo", "suuri"], "bb": ["worth", "think", "house", "great"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(r.choice(["aa", "bb"]) for _ in range(60))] + [(90, None, "aa"), (91, "12", "aa"), (92, "x y", None)]
    settings = langid.Settings(dims=128, clusters=2, reject=0.1)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.held_out, settings)
    held = {x["doc_id"] for x in spark.createDataFrame(rows, "doc_id long, text string, lang string").where(langid.held_out(F.col("doc_id"))).collect()}
    found = [(lang, plain_counts(t, 128)) for i, t, lang in rows if i not in held and t and lang and any(c.isalpha() for c in t)]
    idf = [math.log((1 + len(found)) / (1 + sum(c[g] > 0 for _, c in found))) + 1 for g in range(128)]
    assert model.idf.tolist() == pytest.approx(idf, rel=1e-5)

    def unit(v):
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / size for x in v]

    cosine = lambda a, b: sum(x * y for x, y in zip(a, b))
    vectors = [(lang, unit([math.log1p(n) * w for n, w in zip(c, idf)])) for lang, c in found]
    centroids = [(model.languages[o], list(map(float, c))) for o, c in zip(model.owner, model.centroids)]
    assert len(centroids) == 4
    for lang in ("aa", "bb"):  # a further round of k-means changes nothing
        own = [c for name, c in centroids if name == lang]
        groups = [[v for name, v in vectors if name == lang and max(range(2), key=lambda j: cosine(own[j], v)) == j] for j in range(2)]
        for c, group in zip(own, groups):
            assert unit([sum(x) / len(group) for x in zip(*group)]) == pytest.approx(c, abs=1e-4)
    reached = sorted(max(cosine(c, v) for name, c in centroids if name == lang) for lang, v in vectors)
    assert abs(model.limit - reached[int(0.1 * len(reached))]) < 2e-4
    for i, text, _ in rows[:20]:
        v = unit([math.log1p(n) * w for n, w in zip(plain_counts(text, 128), idf)])
        best = max(range(4), key=lambda j: cosine(centroids[j][1], v))
        lang, score, _ = model.predict(text)
        assert lang == centroids[best][0] and score == pytest.approx(cosine(centroids[best][1], v), abs=1e-5)


def test_langid_ties_go_to_the_first_language():
    import numpy as np

    same = np.ones((2, 128), np.float32) / np.sqrt(128)
    model = langid.Model(["aa", "bb"], np.ones(128, np.float32), same, np.array([0, 1]), 0.0)
    assert model.predict("any text")[0] == "aa"


def test_repeated_rows_get_equal_results(spark):
    docs = spark.createDataFrame([(1, "same text", "en"), (1, "same text", "en"), (2, "same text", "en")], "doc_id long, text string, lang string")
    model = langid.train(spark.read.parquet(f"{SF_CHECK}/documents.parquet"), langid.held_out)
    assert len({(r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}) == 1
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    scores = toxicity.score_texts(docs, toxicity.train(docs, labels, toxicity.held_out)).collect()
    assert len(scores) == 3 and len({r["score"] for r in scores}) == 1


def test_toxicity_equals_plain_ftrl(spark):
    """The learner, coordinate by coordinate in dictionaries."""
    import math

    rows = texts(3, 300, ["vile", "nasty"])
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    s = toxicity.Settings(bits=14, epochs=2, l1=1.0)
    model = toxicity.train(docs, labels, toxicity.held_out, s)
    order = labels.where(~toxicity.held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id", F.lit(17))).orderBy("turn").collect()
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for r in order:
            at = [*toxicity.features(rows[r["doc_id"]][1], s.bits).tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - r["toxic"]
            for i in at:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i]
                n[i] = old + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, abs=1e-9) and model.intercept == pytest.approx(weight("bias"), abs=1e-9)
    for _, text, _ in rows[:20]:
        total = weight("bias") + sum(weight(i) for i in toxicity.features(text, s.bits).tolist())
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_toxicity_settings_are_compared_within_training_rows(spark):
    rows = texts(2, 600, ["vile", "nasty"])
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    choices = [toxicity.Settings(bits=16), toxicity.Settings(bits=16, l1=1e9)]
    a, b = (sorted(map(tuple, toxicity.compare_settings(docs, x, toxicity.held_out, choices).collect())) for x in (labels, flipped))
    assert a == b and a[0][1] == a[1][1] == labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert a[0][6] < a[1][6] and a[0][2] > 0.9 * a[0][3] and a[1][4] == a[1][5]  # without weights every score is one half


@pytest.fixture(scope="module")
def forest(spark):
    """Learnt from the findings whose candidate has an odd hash."""
    return secrets.train(secrets.findings(spark, 6000).where(F.crc32(F.col("candidate").cast("binary")) % 2 == 1))


def test_secrets(spark, forest):
    key, sha = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [(1, f'we saw token = "{key}" there', "src0"), (2, f"in commit {sha} of it", "src0"), (3, "your_api_key_here_0001 api_key: your_api_key_here_0002", "docs/x"), (4, f"api_key={key}", None), (5, "plain words only", "a")]
    found = {(r["doc_id"], r["candidate"]): r["is_secret"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), forest).collect()}
    assert found == {(1, key): True, (2, sha): False, (3, "your_api_key_here_0001"): False, (3, "your_api_key_here_0002"): False, (4, key): True}


def test_secrets_on_held_out_findings(spark, forest):
    """Findings whose candidates have an even hash; none of these candidates was trained on."""
    from pyspark.ml.feature import VectorAssembler

    rows = secrets.findings(spark, 8000).where("candidate is not null").where(F.crc32(F.col("candidate").cast("binary")) % 2 == 0)
    rows = secrets.with_features(rows, secrets.dictionary_of_findings(spark))
    scored = forest.transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(rows))
    assert scored.where("prediction = label").count() / scored.count() > 0.95


def test_secret_features_equal_plain_ones(spark):
    import re

    words = ["river", "castle", "orange"]
    rows = [("AKIAabc123--xyzRiver", "my token =", "is here", "deploy/x"), ("orange-castle-river", "see", "commit", "tests/a"), ("00ff00ff00ff00ff", "sha1", "", ""), ("yourexampleAAAA9999", "api_key: '", "the secret", "a")]
    out = secrets.with_features(spark.createDataFrame(rows, "candidate string, before string, after string, path string"), spark.createDataFrame([(w,) for w in words], "word string"))
    for r in out.collect():
        c, low, n = r["candidate"], r["candidate"].lower(), len(r["candidate"])
        kind = lambda x: "l" if x.islower() else "u" if x.isupper() else "d" if x.isdigit() else "s"
        vowel = lambda x: x in "aeiou"
        want = {
            "length": n, "digits": sum(x.isdigit() for x in c) / n, "uppers": sum(x.isupper() for x in c) / n, "symbols": sum(not x.isalnum() for x in c) / n,
            "transitions": sum(kind(a) != kind(b) and kind(a) != "s" for a, b in zip(c, c[1:])) / n,
            "alternations": sum(a.isalpha() and b.isalpha() and vowel(a) != vowel(b) for a, b in zip(low, low[1:])) / n,
            "distinct": len(set(c)) / n, "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", c))), "repeats": len(re.findall(r"(.)\1\1", low)) / n,
            "words": sum(len(w) for w in re.findall("[a-z]{4,20}", low) if w in words) / n, "fillers": (n - len(re.sub("|".join(secrets.FILLERS), "", low))) / n,
            "shaped": float(c.startswith("AKIA")), "announced": float(bool(re.search(secrets.FOR, r["before"]))), "denied": float(bool(re.search(secrets.AGAINST, r["before"]))),
            "assigned": float(bool(re.search(r"[=:]\s*[\"'`(]*$", r["before"]))), "announced_after": float(bool(re.search(secrets.FOR, r["after"]))),
            "denied_after": float(bool(re.search(secrets.AGAINST, r["after"]))), "test_path": float("test" in r["path"]), "config_path": float("deploy" in r["path"]),
        }
        assert set(want) == set(secrets.FEATURES)
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (c, name)


def test_secret_scan_has_no_python(spark, forest, odd):
    plan = secrets.scan(odd, forest)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    for part in (secrets.candidates(odd), secrets.dictionary(odd)):
        assert not any(x in part._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_secrets_odd_rows(odd, none, forest):
    assert secrets.scan(odd, forest).collect() == []
    assert secrets.scan(none, forest).collect() == []
