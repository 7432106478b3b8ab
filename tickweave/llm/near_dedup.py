"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Documents with equal
sets are taken together first. Each set has ``MINWISE`` minwise tokens. A tree
branches the sets: a node picks one of the token positions, every third node two,
and a set goes to the child named by its token there. Two sets of similarity s
share a child with probability s, and with 4/3 children a node on average, pairs
at the threshold keep one common child per level in expectation, while less
similar pairs lose each other. Independent trees make up for pairs that a tree
loses.

In every node of the first level all sets are compared with the node's smallest id;
what is confirmed on full sets joins components. A node whose sets all have one
component is done, however large it is. Of the other nodes, small ones are compared
exhaustively across components. In large ones with at most LARGE sets outside the
largest component, these are compared with all members on full sets, block by block,
by an index of shingles within each pair of blocks. The others branch, as most of them
hold texts that share a passage and little else; below the first level all their sets
are also compared with a few further members. After LEVELS levels blocks take over. So
groups of very many copies cost a comparison per copy, and no cap drops a candidate.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.components import connected_components
from tickweave.llm.hashing import mix, sequence_hashes, word_hashes
from tickweave.runtime import Scratch, ship_package, table, thrifty

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
MINWISE = 128
TREES = 10
#: Sets up to which a node is compared exhaustively by tokens; sets outside a node's largest component from which it branches; levels of a tree.
SMALL, LARGE, LEVELS = 48, 512, 12
#: Members that all others of a large node with several components are compared with, at each level.
PIVOTS = 2
#: Shingles of a block, on average, in nodes that are still large at the last level.
BLOCK = 200_000
#: Equal minwise tokens (of MINWISE) that a pair needs to be compared on full sets: five standard deviations below the mean at the threshold.
AGREE = 70
#: Ids up to which a list of documents (8 bytes each) is broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000

_random = np.random.default_rng(20240101)
_FACTOR = (_random.integers(0, 1 << 32, MINWISE, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_OFFSET = _random.integers(0, 1 << 32, MINWISE, dtype=np.uint64).astype(np.uint32)[:, None]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; ASCII letters in lower case, words between ASCII spaces.

    Fewer words than ``size`` make one shingle; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < size:
        return mix(sequence_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(sequence_hashes(hashes, size))


def minwise(found: np.ndarray) -> np.ndarray:
    """MINWISE tokens of a non-empty set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINWISE, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):
        np.minimum(out, (low[None, start : start + 1024] * _FACTOR + _OFFSET).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null if empty), tokens (32 bits each), bytes (their lowest 8 bits)."""

    def run(batches):
        for batch in batches:
            n, keys, tokens, low = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                n.append(len(found))
                if len(found):
                    token = minwise(found)
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                    tokens.append(token.tobytes())
                    low.append(token.astype(np.uint8).tobytes())
                else:
                    keys.append(None), tokens.append(None), low.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(low, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "tokens", "low"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(thrifty(run, "near_dedup"), "doc_id long, n_shingles long, set_key binary, tokens binary, low binary")


def _child(node, position):
    return F.xxhash64(node, position, F.substring("tokens", (position * 4 + 1).cast("int"), F.lit(4)))


def _branch(rows: DataFrame) -> DataFrame:
    """Children (node, id) of the nodes of (node, id, tokens)."""
    first, second = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(MINWISE)), F.pmod(F.xxhash64("node", F.lit(2)), F.lit(MINWISE))
    two = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(3)) == 0
    children = F.filter(F.array(_child(F.col("node"), first), F.when(two & (first != second), _child(F.col("node"), second))), lambda x: x.isNotNull())
    return rows.select("id", F.explode(children).alias("node"))


def _roots(sets: DataFrame) -> DataFrame:
    """The first level of all trees; every third root picks two positions."""
    order = [int(x) for x in np.random.default_rng(7).permutation(MINWISE)]
    picks = [(t, order[(t * 2 + k) % MINWISE]) for t in range(TREES) for k in range(2 if t % 3 == 0 else 1)]
    return sets.select("id", F.explode(F.array(*[_child(F.lit(t).cast("long"), F.lit(p).cast("long")) for t, p in picks])).alias("node"))


def _agreeing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose tokens agree often enough."""
    low_a, low_b = sets.select(F.col("id").alias("a"), F.col("low").alias("low_a")), sets.select(F.col("id").alias("b"), F.col("low").alias("low_b"))
    rows = pairs.join(low_b, "b").join(low_a, "a").select("a", "b", "low_a", "low_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINWISE) for c in ("low_a", "low_b"))
                near = pa.array((x == y).sum(1) >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    return rows.mapInArrow(thrifty(run, "near_dedup"), "a long, b long")


def _few(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table, to be broadcast if it has few rows; else joins shuffle, and hot keys are split adaptively."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _mixed(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (node, id) of the nodes that hold several components, with label, the node's size, its largest component and how many are outside that."""
    labelled = scratch.write(members.join(labels, "id", "left").select("node", "id", F.coalesce("label", "id").alias("label")), "labelled")
    sizes = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"))
    sizes = sizes.select("node", "size", F.col("top.label").alias("top"), (F.col("size") - F.col("top.n")).alias("others"))
    nodes = scratch.write(sizes.where("others > 0"), "nodes")
    out = scratch.write(labelled.join(_few(nodes), "node"), "mixed")
    scratch.drop(labelled, nodes)
    return out


def _pivot_pairs(mixed: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """Each member with the PIVOTS of its nodes that are of another component.

    Pivots are the members with the smallest hashes of id and level, so that nodes
    of different trees that hold the same group share them; a member meets each
    pivot once, however many of its nodes have it.
    """
    turn = [F.min(F.struct(F.xxhash64("id", F.lit(level * PIVOTS + k)).alias("turn"), "id", "label")) for k in range(PIVOTS)]
    pivots = scratch.write(mixed.groupBy("node").agg(F.array(*turn).alias("pivots")), "turns")
    others = F.transform(F.filter("pivots", lambda p: p["label"] != F.col("label")), lambda p: p["id"])
    met = mixed.join(_few(pivots), "node").select("id", others.alias("others")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    rows = met.select("id", F.explode("others").alias("other"))
    return rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (id, label) after further links (a, b), from the components of the linked components."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(end), F.col("label").alias("__label")), end, "left").withColumn(end, F.coalesce("__label", end)).drop("__label")
    top = connected_components(ends, scratch)
    known = labels.join(top.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return scratch.write(known.union(top.join(labels, "id", "left_anti").select("id", "label")), "merged")


def _still_open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs whose ends are of different components by now."""
    a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _exhaustive(members: DataFrame) -> DataFrame:
    """Agreeing pairs across components in small nodes; members: node, id, label, low."""
    packed = members.groupBy("node").agg(F.collect_list(F.struct("id", "label", "low")).alias("all")).select("all")

    def run(batches):
        for batch in batches:
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for rows in batch.column(0):
                flat = rows.values
                ids, labels = flat.field("id").to_numpy(), flat.field("label").to_numpy()
                low = np.frombuffer(b"".join(flat.field("low").to_pylist()), np.uint8).reshape(-1, MINWISE)
                i, j = np.triu_indices(len(ids), 1)
                other = labels[i] != labels[j]
                i, j = i[other], j[other]
                near = (low[i] == low[j]).sum(1) >= AGREE
                left.append(ids[i[near]]), right.append(ids[j[near]])
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return packed.mapInArrow(thrifty(run, "near_dedup"), "a long, b long")


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Whole texts of the documents whose ids are listed."""
    need = scratch.write(ids.select("id").distinct(), "need")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(_few(need), "id", "left_semi")
    texts = scratch.write(texts, "texts")
    scratch.drop(need)
    return texts


def _blockwise(mixed: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Links across components in nodes of any size; mixed: node, id, label, top (label of the node's largest component), n_shingles.

    Left of each pair of blocks are members outside the node's largest component,
    right are all members. A pair of blocks gives only links that join components
    which its earlier links don't, fewer than it has components.
    """
    outside = F.when(F.col("label") != F.col("top"), F.col("n_shingles"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).alias
    sizes = scratch.write(mixed.groupBy("node").agg(parts(F.sum(outside))("lefts"), parts(F.sum("n_shingles"))("rights")), "sizes")
    rows = mixed.join(_few(sizes), "node")
    block = F.xxhash64("id")
    left = rows.where("label <> top").select("node", F.pmod(block, F.col("lefts")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("y"), F.lit(True).alias("left"), "id", "label")
    right = rows.select("node", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("x"), F.pmod(block, F.col("rights")).alias("y"), F.lit(False).alias("left"), "id", "label")
    placed = scratch.write(left.union(right), "blocks")

    def run(group: pa.Table) -> pa.Table:
        sides = group.column("left").to_numpy()
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        sets = [shingles(t.as_py()) for t in group.column("text")]
        right = [i for i in np.flatnonzero(~sides) if len(sets[i])]
        a, b = [], []
        if right:
            known, at = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            size = np.array([len(sets[i]) for i in right])
            starts, owner, other = np.concatenate([[0], size.cumsum()[:-1]]), np.array(right), labels[right]
            root: dict[int, int] = {}

            def top(x):
                while (y := root.get(x, x)) != x:
                    x = y
                return x

            has = np.zeros(len(known), np.int32)
            for i in np.flatnonzero(sides):
                spot = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
                spot = spot[known[spot] == sets[i]]
                has[spot] = 1
                common = np.add.reduceat(has[at], starts)
                has[spot] = 0
                linked = (100 * common >= PERCENT * (len(sets[i]) + size - common)) & (common > 0) & (other != labels[i])
                for j in owner[linked]:
                    x, y = top(int(labels[i])), top(int(labels[j]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(int(ids[i])), b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = _texts(mixed, docs, scratch, id_col, text_col)
    out = placed.join(texts, "id").groupBy("node", "x", "y").applyInArrow(run, "a long, b long")
    return scratch.write(out.distinct(), "across")


def _confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, scratch, id_col, text_col)
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        hub, of_hub = None, None
        for batch in batches:
            a, b = [], []
            for x, y, left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if (left := left.as_py()) != hub or of_hub is None:
                    hub, of_hub = left, shingles(left)
                other = shingles(right.as_py())
                common = len(np.intersect1d(of_hub, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(of_hub) + len(other) - common) > 0:
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = scratch.write(rows.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(run, "near_dedup"), "a long, b long"), "confirmed")
    scratch.drop(texts)
    return out


def near_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id is component_id), a row per row of ``docs``.

    Ids are long. Null or empty texts have no shingles and are linked with
    nothing. A row with a null id is linked only to rows with an id and an equal
    set, and then not kept; else it has a null component and is kept. Rows with the same id
    are taken as one document when their sets are linked; repeated rows are kept or dropped alike.
    Whole texts of any length are read. Other columns, whatever their names, aren't read.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sketched = scratch.write(sketches(docs, id_col, text_col), "sketches")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tokens", "low", "n_shingles"))
    firsts = sketched.where("set_key is not null").groupBy("set_key").agg(F.min(known).alias("f"), F.count(F.lit(1)).alias("n")).where("f is not null")
    firsts = scratch.write(firsts.select("set_key", F.col("f.doc_id").alias("id"), F.col("f.tokens").alias("tokens"), F.col("f.low").alias("low"), F.col("f.n_shingles").alias("n_shingles"), "n"), "sets")
    sets = firsts.select("id", "tokens", "low", "n_shingles")

    tree = _roots(sets)
    nodes = scratch.write(tree.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot")).where("size > 1"), "nodes")
    members = scratch.write(tree.join(_few(nodes), "node"), "members")
    scratch.drop(nodes)
    stars = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = scratch.write(_agreeing(stars, sets), "stars")
    labels = connected_components(_confirmed(stars, docs, scratch, id_col, text_col), scratch)
    scratch.drop(stars)

    # A node of two is settled by its star; the others are open if they hold more than one component.
    open_nodes, pairs = members.where("size > 2").select("node", "id"), []
    for level in range(1, LEVELS + 1):
        mixed = _mixed(open_nodes, labels, scratch)
        scratch.drop(members)
        if level > 1:
            stars = scratch.write(_agreeing(scratch.write(_pivot_pairs(mixed.where(F.col("others") > LARGE), level, scratch), "pivots"), sets), "stars")
            if stars.limit(1).count():
                labels = _merged(labels, _confirmed(stars, docs, scratch, id_col, text_col), scratch)
                mixed = _mixed(mixed.select("node", "id"), labels, scratch)
        small, large = mixed.where(F.col("size") <= SMALL), mixed.where(F.col("size") > SMALL)
        pairs.append(scratch.write(_exhaustive(small.join(sets.select("id", "low"), "id").select("node", "id", "label", "low")).distinct(), "pairs"))
        ending = large if level == LEVELS else large.where(F.col("others") <= LARGE)
        if ending.limit(1).count():
            links = _blockwise(ending.join(sets.select("id", "n_shingles"), "id"), docs, scratch, id_col, text_col)
            if links.limit(1).count():
                labels = _merged(labels, links, scratch)
        growing = large.where(F.col("others") > LARGE)
        if level == LEVELS or not growing.limit(1).count():
            break
        tree = scratch.write(_branch(growing.select("node", "id").join(sets.select("id", "tokens"), "id")), "tree")
        nodes = scratch.write(tree.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
        members = scratch.write(tree.join(_few(nodes), "node", "left_semi"), "members")
        scratch.drop(tree, nodes, mixed)
        open_nodes = members
    rest = scratch.write(_still_open(reduce(DataFrame.union, pairs).distinct(), labels), "rest")
    if rest.limit(1).count():
        links = _confirmed(rest, docs, scratch, id_col, text_col)
        if links.limit(1).count():
            labels = _merged(labels, links, scratch)

    copies = firsts.where("n > 1").select("set_key", F.col("id").alias("first"))
    rows = sketched.select("doc_id", "n_shingles", "set_key").join(copies, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("id"))
    rows = rows.join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_components(table(spark, sf_dir, "documents"), Scratch(spark, "op5", compact=True))
