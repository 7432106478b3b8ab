"""Sharding by a hierarchical weighted hash tree.

Every node of the tree (region, rack, shard) draws an exponential variable from
a hash of the row's key and the node's name, divided by the node's weight; a row
descends into the child with the smallest draw. A child is chosen with the
probability that its weight has among its siblings. If the weights of one
subtree change, rows move only into or out of it; a region that is added takes
rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import table


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has a shard number, others the sum of their children's weights."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def standard_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """Shards of weight 1, filled up rack by rack and region by region.

    With a multiple of ``per_rack * racks_per_region`` shards, the next one opens
    a region of its own, so that it takes rows only into itself.
    """
    racks: dict[int, list[Node]] = {}
    for s in range(shards):
        racks.setdefault(s // per_rack, []).append(Node(f"s{s}", 1.0, s))
    regions: dict[int, list[Node]] = {}
    for r, leaves in racks.items():
        regions.setdefault(r // racks_per_region, []).append(Node(f"k{r}", children=tuple(leaves)))
    return Node("root", children=tuple(Node(f"g{g}", children=tuple(kids)) for g, kids in regions.items()))


def _draw(key: Column, node: Node) -> Column:
    digits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(node.name), key)), 1, 12), 16, 10).cast("double")
    return -F.log((digits + F.lit(1.0)) / F.lit(float(2**48 + 1))) / F.lit(float(node.total))


def place(key: Column, tree: Node) -> Column:
    """The shard of a key (null: as the empty string). Ties go to the sibling listed first."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    alive = [c for c in tree.children if c.total > 0]
    if len(alive) == 1:
        return place(key, alive[0])
    draws = F.array(*[_draw(key, c) for c in alive])
    best = F.array_position(draws, F.array_min(draws))
    out = place(key, alive[0])
    for i, child in enumerate(alive[1:], 2):
        out = F.when(best == i, place(key, child)).otherwise(out)
    return out


#: Blocks that the rows of a shard are numbered by; a shard's offsets are one row each.
BLOCKS = 512
#: Offsets (24 bytes each) up to which their table is broadcast.
BROADCAST_OFFSETS = 500_000


def number_within(rows: DataFrame, group: str, order: list[str], blocks: int = BLOCKS, groups: int | None = None) -> DataFrame:
    """Add ``slot``: numbers from 0, without gaps, within each value of ``group``.

    No task gets a whole group: rows are numbered within hashed blocks, to which
    the counts of the blocks before are added (groups x ``blocks`` rows, at most
    65,536 blocks). Identical rows get different slots. The offsets are broadcast if
    ``groups``, the number of groups, is given and small.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]
    block = F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 4), 16, 10).cast("int") % F.lit(blocks)
    rows = rows.withColumn("__block", block)
    counts = rows.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.expr(f"coalesce(sum(__n) OVER (PARTITION BY `{group}` ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    offsets = counts.select(group, "__block", before.alias("__before"))  # at most groups x blocks rows
    ranked = rows.withColumn("__rank", F.expr(f"row_number() OVER (PARTITION BY `{group}`, __block ORDER BY {', '.join(f'`{c}`' for c in order)})"))
    few = groups is not None and groups * blocks <= BROADCAST_OFFSETS
    return ranked.join(F.broadcast(offsets) if few else offsets, [group, "__block"]).withColumn("slot", F.col("__rank") - 1 + F.col("__before")).drop("__block", "__rank", "__before")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents by id.

    Returns doc_id, size (bytes of the text plus 1), text_crc32, law (`key`),
    shard, slot (gapless in a shard) and grown_shard (with one more shard).
    Nulls: a null text has size 1 and the checksum of no bytes; a null id is
    placed like an empty one. Rows with the same id go to the same shard; their
    slots follow checksum and size; repeated rows have slots of their own. Whole texts of
    any length are read, by one pass in the JVM. Other columns, whatever their names,
    aren't read. Empty tables give no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), place(key, standard_tree(shards)).cast("int").alias("shard"), place(key, standard_tree(shards + 1)).cast("int").alias("grown_shard"),
    )
    return number_within(rows, "shard", ["doc_id", "text_crc32", "size"], groups=shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def place_sql(tree: Node) -> str:
    """``place`` as SQL over a column ``key``."""
    if tree.shard is not None:
        return str(tree.shard)
    alive = [c for c in tree.children if c.total > 0]
    if len(alive) == 1:
        return place_sql(alive[0])
    draws = [f"-ln((('0x' || substr(md5('{c.name}/' || key), 1, 12))::UBIGINT::DOUBLE + 1) / {float(2**48 + 1)!r}::DOUBLE) / {float(c.total)!r}::DOUBLE" for c in alive]
    listed = f"[{', '.join(draws)}]"
    return f"CASE list_position({listed}, list_min({listed})) " + " ".join(f"WHEN {i} THEN {place_sql(c)}" for i, c in enumerate(alive, 1)) + " END"


#: The checksum goes byte by byte over a table of 256 remainders, which is made first.
OP7_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS n FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), remainders AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8
), d AS (
  SELECT doc_id, doc_id::VARCHAR AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), c AS (
  SELECT doc_id, key, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, remainders
), p AS (
  SELECT *, ({place_sql(standard_tree(8))})::INT AS shard, ({place_sql(standard_tree(9))})::INT AS grown_shard,
         ('0x' || substr(md5(key || '/' || text_crc32 || '/' || size), 1, 4))::INT % {BLOCKS} AS block FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM p
"""
