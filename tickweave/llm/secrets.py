"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything is DataFrame functions and the JVM's tree learner. The forest sees a
candidate's length, its transitions between character classes and between vowels
and consonants, how much of it dictionary words cover, the path that the text comes
from and the neighbouring words on both sides. The dictionary is made of the words of
the scanned texts. The forest is trained from labelled findings: ``findings()`` builds
a set of them by rule, so it then knows what these rules know and no more; a table of
reviewed findings with the same columns can be given instead.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.runtime import Scratch, table

#: Beginnings of the keys of well-known issuers.
PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|[sr]k_live_|xox[abprs]-|glpat-"
#: What keys look like, as Java regular expressions: signed tokens of dotted parts; private-key marks; runs of 16 key
#: characters or more with a digit or a known prefix; longer ones without a digit that change case at least twice.
SHAPES = (
    r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_=-]{4,})+",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"-----BEGIN(?=$)",
    rf"(?:(?=[A-Za-z+/_-]*[0-9])|(?=(?:{PREFIXES})))[A-Za-z0-9+/_-]{{16,}}={{0,2}}",
    r"(?=(?:[A-Za-z+/_-]*?[a-z][A-Z]){2})[A-Za-z+/_-]{20,}={0,2}",
)
CANDIDATE = rf"(?<![A-Za-z0-9+/_.-])(?:{'|'.join(SHAPES)})|(?<=[A-Za-z0-9]\.)(?:{SHAPES[3]})"
#: The words of a private-key mark.
KEY_MARK = r"^-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY"
SPACES = r"[\x20\x09-\x0D]+"
#: Placeholders and parts of identifiers, looked for anywhere in a candidate.
FILLERS = (
    "example", "sample", "test", "dummy", "fake", "your", "here", "change", "replace", "placeholder", "insert", "version", "release", "notes", "section",
    "chapter", "page", "index", "article", "image", "static", "assets", "content", "user", "name", "value", "default", "config", "module", "package",
    "public", "build", "report", "table", "figure", "http", "https", "www", "html", "json", "data", "file", "path", "abc", "xyz", "xxx", "foo", "bar",
)
#: Words of the dictionary (the most frequent ones, about 10 bytes each), in how many texts a word has to be, and the lengths that count.
DICTIONARY_WORDS, LEAST_TEXTS, WORD = 50_000, 3, "[a-z]{4,20}"
#: White space and punctuation that a word of the dictionary stands between.
AROUND = r"[\s.,;:!?\"'()]+"
#: Neighbouring words that announce a secret, or a digest or identifier that is none.
FOR = "secret|token|passw|pwd|api.?key|apikey|auth|credential|private|bearer|access.?key"
AGAINST = "commit|sha|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|base64|example|dummy|sample|order|invoice|card|account|phone"
#: An announcing word with = or :, and the value of six characters or more that follows it; at the end of a word for VALUE.
ASSIGNED = rf"(?i)(?:{FOR})[A-Za-z0-9_.-]*[\"'`]?\s*[=:]+\s*[\"'`(]*"
VALUE = ASSIGNED + r"([^\s\"'`,;()<>=:][^\s\"'`,;()<>]{5,})(?:[\"'`,;()<>]\S*)?$"
#: A password between the user and the host of an address.
IN_ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:@/]+:([^\s@/]{3,})@"
#: Parts of paths of test material, and of configuration.
TEST_PATH, CONFIG_PATH = "test|example|sample|fixture|mock|docs?/", "env|config|settings|deploy|prod|credential"

FEATURES = (
    "length", "digits", "uppers", "symbols", "transitions", "alternations", "distinct", "hex", "repeats", "words", "fillers", "shaped", "announced", "denied", "assigned",
    "announced_after", "denied_after", "test_path", "config_path",
)
#: Share of trees from which a candidate counts as a secret.
THRESHOLD = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, word_at, part, candidate, before and after (neighbouring words, in lower case) of whole texts.

    A place is looked at if its word is long, or a word up to two before it has = or :. Null and empty
    texts have none; a null path counts as an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = rows.where("text is not null").select("doc_id", "path", F.split("text", SPACES).alias("words"))
    near = lambda i, steps: F.concat_ws(" ", *[F.get("words", i + k) for k in steps])
    sign = lambda w: F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))
    # Cheap tests find the few places of long words and signs of assignment; only there, and up to two words on, patterns are tried.
    places = F.array_compact(F.transform("words", lambda w, i: F.when((F.length(w) >= 16) | sign(w) | (w == "-----BEGIN"), i)))
    places = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))
    rows = rows.select("doc_id", "path", "words", places.alias("places")).where(F.size("places") > 0)

    def wanted(i):
        w = F.coalesce(F.get("words", i), F.lit(""))
        key = ((F.length(w) >= 16) | (w == "-----BEGIN")) & w.rlike(CANDIDATE)
        return (w != "") & (key | near(i, (-3, -2, -1, 0)).rlike(VALUE) | (F.contains(w, F.lit("://")) & w.rlike(IN_ADDRESS)))

    # Only the wanted words are made rows, so that the array of words isn't copied for each of them.
    rows = rows.select("doc_id", "path", "words", F.explode(F.filter("places", wanted)).alias("word_at"))
    rows = rows.select("doc_id", "path", "word_at", F.get("words", F.col("word_at")).alias("word"), near(F.col("word_at"), (-3, -2, -1)).alias("left"), near(F.col("word_at"), (1, 2, 3, 4)).alias("right"))
    value = F.regexp_replace(F.regexp_extract(F.concat_ws(" ", "left", "word"), VALUE, 1), "[.!?]+$", "")
    value = F.coalesce(F.nullif(F.regexp_extract("word", IN_ADDRESS, 1), F.lit("")), value)
    keys = F.filter(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), lambda x: (x != "-----BEGIN") | F.concat_ws(" ", "word", "right").rlike(KEY_MARK))
    rows = rows.select("*", keys.alias("keys"), F.split("word", CANDIDATE).alias("gaps"), value.alias("value"))
    known = F.exists("keys", lambda x: F.contains(F.col("value"), x) | F.contains(x, F.col("value")))
    found = F.when((F.length("value") >= 3) & ~known & ((F.length("value") >= 6) | F.col("word").rlike(IN_ADDRESS)), F.array_append("keys", F.col("value"))).otherwise(F.col("keys"))
    rows = rows.select("doc_id", "path", "word_at", "word", "left", "right", "keys", "gaps", F.posexplode(found).alias("part", "candidate"))
    # What precedes the candidate in its word: the gaps and keys before a key; all before its last occurrence for a value.
    before_key = F.array_join(F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.concat(F.get("gaps", i), F.when(i < F.col("part"), F.get("keys", i)).otherwise(F.lit("")))), "")
    before_value = F.expr("substring(word, 1, length(word) - locate(reverse(candidate), reverse(word)) - length(candidate) + 1)")
    head = F.when(F.col("part") < F.size("keys"), before_key).otherwise(before_value)
    mark = F.regexp_extract(F.concat_ws(" ", "word", "right"), KEY_MARK, 0)
    text = F.when(F.col("candidate") == "-----BEGIN", mark).otherwise(F.col("candidate"))
    return rows.select("doc_id", "path", "word_at", "part", text.alias("candidate"), F.lower(F.concat_ws(" ", "left", head)).alias("before"), F.lower("right").alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The DICTIONARY_WORDS most frequent words (column ``word``) among those in LEAST_TEXTS texts or more.

    Words are lower-case runs of WORD between white space and punctuation, so that keys
    add none. Counts are over all texts and are pre-aggregated before the shuffle.
    """
    words = F.array_distinct(F.split(F.lower(F.col(text_col)), AROUND))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("word").rlike(f"^{WORD}$"))
    return counted.where(F.col("n") >= LEAST_TEXTS).orderBy(F.col("n").desc(), "word").limit(DICTIONARY_WORDS).select("word")


def _share(count: Column) -> Column:
    return count / F.length("candidate")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add the columns FEATURES, all double, to (candidate, before, after, path); ``words`` is the dictionary.

    Each distinct candidate's letter runs are looked up once; the dictionary has a fixed
    size and is broadcast.
    """
    c, low = F.col("candidate"), F.lower("candidate")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    runs = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    known = runs.join(F.broadcast(words), "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("known"))
    found = found.join(known, "candidate", "left")
    each = {
        "length": F.length(c).cast("double"),
        "digits": _share(F.regexp_count(c, F.lit("[0-9]"))),
        "uppers": _share(F.regexp_count(c, F.lit("[A-Z]"))),
        "symbols": _share(F.regexp_count(c, F.lit("[^A-Za-z0-9]"))),
        "transitions": _share(F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"))),
        "alternations": _share(F.regexp_count(low, F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"))),
        "distinct": _share(F.size(F.array_distinct(F.split(c, "")))),
        "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "repeats": _share(F.regexp_count(low, F.lit(r"(.)\1\1"))),
        "words": _share(F.coalesce("known", F.lit(0))),
        "fillers": _share(F.length(c) - F.length(F.regexp_replace(low, "|".join(FILLERS), ""))),
        "shaped": flag(c.rlike(rf"^(?:{PREFIXES})|^eyJ|^SG\.|^-----BEGIN")),
        "announced": flag(F.col("before").rlike(FOR)),
        "denied": flag(F.col("before").rlike(AGAINST)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`(]*$")),
        "announced_after": flag(F.col("after").rlike(FOR)),
        "denied_after": flag(F.col("after").rlike(AGAINST)),
        "test_path": flag(F.lower("path").rlike(TEST_PATH)),
        "config_path": flag(F.lower("path").rlike(CONFIG_PATH)),
    }
    return found.select("*", *[each[f].cast("double").alias(f) for f in FEATURES])


def findings(spark: SparkSession, count: int = 6_000) -> DataFrame:
    """Labelled findings (candidate, before, after, path, label, template) made by rule: keys and tokens in their usual surroundings, and digests, identifiers, numbers, slugs and placeholders."""
    rows = spark.range(count).select("id", F.md5(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("a"), F.md5(F.concat(F.lit("b"), F.col("id").cast("string"))).alias("b"))
    packed = "replace(replace(base64(unhex(concat(a, b))), '=', ''), '/', '_')"
    cue = "element_at(array('token =', 'secret =', 'api_key:', 'password =', 'auth token', 'access_key =', 'bearer', 'private credential ='), cast(id % 8 as int) + 1)"
    plain = "element_at(array('of the', 'and', 'see', 'it was', 'in', '', 'to', 'with a'), cast(id div 12 % 8 as int) + 1)"
    deny = "element_at(array('commit', 'sha1', 'md5 checksum:', 'git revision', 'etag:', 'digest =', 'uuid', 'hash'), cast(id % 8 as int) + 1)"
    assign = "element_at(array('password =', 'pwd:', 'secret =', 'passwd:', 'auth:', 'token:', 'author:', 'credential ='), cast(id % 8 as int) + 1)"
    word = "element_at(array('correct', 'horse', 'battery', 'staple', 'winter', 'garden', 'copper', 'lantern', 'meadow', 'silver', 'thunder', 'pocket', 'orange', 'castle', 'river', 'marble'), cast(conv(substr(b, {}, 2), 16, 10) as int) % 16 + 1)"
    kinds = [  # candidate, before, label
        ("concat(a, substr(b, 1, 8))", cue, 1),
        ("upper(concat(a, substr(b, 1, 8)))", cue, 1),
        (f"substr({packed}, 1, 20 + cast(id % 20 as int))", cue, 1),
        (f"concat(element_at(array('sk_live_', 'ghp_', 'xoxb-', 'glpat-'), cast(id % 4 as int) + 1), substr({packed}, 1, 24))", f"if(id % 3 = 0, {plain}, {cue})", 1),
        ("concat('AKIA', upper(translate(substr(a, 1, 16), '0189', 'WXYZ')))", f"if(id % 3 = 0, {plain}, {cue})", 1),
        ("a", cue, 1),
        (f"concat_ws('-', {word.format(1)}, {word.format(3)}, {word.format(5)})", assign, 1),
        ("concat(initcap(translate(substr(a, 1, 5 + cast(id % 4 as int)), '0123456789', 'ghkmnprtvz')), substr('&!#$%@', 1 + cast(id % 6 as int), 1), cast(id % 97 as string))", assign, 1),
        ("concat(element_at(array('AKIA', 'ghp_', 'sk_live_'), cast(id % 3 as int) + 1), upper(translate(substr(a, 1, 16), '0123456789', 'GHKMNPRTVZ')))", f"if(id % 2 = 0, {plain}, {cue})", 1),
        (f"concat('eyJhbGciOi', substr({packed}, 1, 16), '.', substr({packed}, 8, 20), '.', substr({packed}, 3, 22))", f"if(id % 2 = 0, {plain}, {cue})", 1),
        (f"regexp_replace(substr({packed}, 1, 28 + cast(id % 12 as int)), '[0-9]', 'Q')", cue, 1),
        ("concat('-----BEGIN', if(id % 2 = 0, ' RSA', ''), ' PRIVATE KEY')", plain, 1),
        ("concat(a, substr(b, 1, 8))", deny, 0),
        (f"concat(initcap({word.format(1)}), initcap({word.format(3)}), initcap({word.format(5)}), initcap({word.format(7)}))", f"if(id % 2 = 0, {plain}, {cue})", 0),
        ("concat_ws('-', substr(translate(a, 'abcdef', '274951'), 1, 4), substr(translate(b, 'abcdef', '593817'), 1, 12))", f"if(id % 2 = 0, {plain}, 'card number:')", 0),
        ("a", f"if(id % 2 = 0, {plain}, {deny})", 0),
        ("concat_ws('-', substr(a, 1, 8), substr(a, 9, 4), substr(a, 13, 4), substr(a, 17, 4), substr(a, 21, 12))", f"if(id % 2 = 0, {plain}, {deny})", 0),
        ("substr(translate(concat(a, b), 'abcdef', '274951'), 1, 16)", f"if(id % 2 = 0, {plain}, 'order number')", 0),
        (word.format(7), assign, 0),
        ("element_at(array('required', 'string', 'disabled', 'optional', 'changeme', 'your-password', 'example', 'default', 'unknown'), cast(id % 9 as int) + 1)", assign, 0),
        ("concat_ws('-', 'release', 'notes', 'section', cast(id % 97 as string), 'page', cast(id % 13 as string))", plain, 0),
        ("concat(element_at(array('your_api_key_here_', 'example-token-', 'xxxxxxxxxxxxxxxx', 'changeme_placeholder_', 'test_dummy_value_'), cast(id % 5 as int) + 1), cast(id % 1000 as string))", cue, 0),
    ]
    pick = F.col("id") % len(kinds)
    columns = [F.expr("CASE " + " ".join(f"WHEN id % {len(kinds)} = {i} THEN {k[j]}" for i, k in enumerate(kinds)) + " END") for j in (0, 1)]
    path = F.expr("element_at(array('src0', 'src7', 'web/page', 'config/settings.env', 'deploy/prod.yml', 'tests/fixture.py', 'lib/main.c', ''), cast(conv(substr(b, 1, 4), 16, 10) as int) % 8 + 1)")
    label = F.when(pick < sum(k[2] for k in kinds), 1).otherwise(0)
    after = F.expr(f"if(conv(substr(a, 5, 2), 16, 10) < 200, element_at(array('of the', 'and', 'see', '', 'to', 'with a', 'was left', 'in it'), cast(conv(substr(a, 7, 2), 16, 10) as int) % 8 + 1), if(id % {len(kinds)} < {sum(k[2] for k in kinds)}, 'is the token', 'is the commit'))")
    return rows.select(columns[0].alias("candidate"), F.lower(columns[1]).alias("before"), after.alias("after"), path.alias("path"), label.cast("double").alias("label"), pick.cast("int").alias("template"))


def dictionary_of_findings(spark: SparkSession) -> DataFrame:
    """The ordinary words that findings() makes pass phrases, names and slugs of."""
    text = "correct horse battery staple winter garden copper lantern meadow silver thunder pocket orange castle river marble release notes section page required string disabled optional default unknown"
    return spark.createDataFrame([(w,) for w in text.split()], "word string")


def train(labelled: DataFrame, words: DataFrame | None = None, trees: int = 40, depth: int = 9, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, label); rows with nulls in candidate or label are left out, other nulls are empty."""
    words = dictionary_of_findings(labelled.sparkSession) if words is None else words
    rows = labelled.where("candidate is not null and label is not null").fillna("", ["before", "after", "path"])
    order = ["candidate", "before", "after", "path", "label"]  # the forest draws rows by their place
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(rows, words))
    rows = rows.select("features", *order).repartition(1).sortWithinPartitions(*order).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col="doc_id", text_col="text", path_col="source", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, word_at, part (place among the candidates of a word), candidate, score and is_secret for every candidate.

    Only candidates and word counts are shuffled; nothing is collected. The candidates
    are written once, to ``scratch``. Repeated rows give repeated findings; empty tables
    give none; other columns of the input aren't read. Whole texts of any length are read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    found = scratch.write(candidates(docs, id_col, text_col, path_col), "candidates")
    rows = with_features(found, scratch.write(dictionary(docs, text_col), "dictionary"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("doc_id", "word_at", "part", "candidate", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict."""
    found = scan(table(spark, sf_dir, "documents"), train(findings(spark)))
    return found.select("doc_id", "word_at", "part", "candidate", F.round("score", 9).alias("score"), "is_secret")
