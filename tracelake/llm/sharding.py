"""Sharding by a k-d tree over metadata.

The space of the metadata dimensions is split again and again: a node that is to hold n shards is cut along its widest
dimension (relative to the whole range) at the weighted quantile that leaves its halves their shares of the bytes. The
dimensions are the size and, as codes of 20 bits, the values of metadata columns such as language and source; rows with
equal texts take the least code of their group. A cut is searched by histograms of the node's bytes, all nodes of a level
in one aggregation, with ever narrower bins; where rows tie in a dimension, the others decide, then the text's checksum,
and last the id. So rows with equal texts tie in all but the id: a group of them is cut only where the law of equal bytes
asks for it, i.e. if it is larger than `group_slack` of a shard and lies across a cut.

Only histograms (at most `bins` sums for each shard) come to the driver; texts are read once, for sizes and checksums.

Defined results: a null text has no bytes and checksum 0; null ids come before all others; repeated rows are rows of
their own, each with its own slot; an empty table gives no rows; columns of the input that aren't named are ignored.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

LAW = "bytes"


@dataclass
class Node:
    """first and n: its shards. id: its place in the list of nodes. cut: what rows below it, which go left, are compared with,
    in the order that dim leads."""

    id: int
    first: int
    n: int
    dim: int = 0
    cut: list[int] = field(default_factory=list)
    left: "Node | None" = None
    right: "Node | None" = None
    # The search for the cut: equal values so far, the interval of the next key and the bytes below it.
    prefix: list[int] = field(default_factory=list)
    low: int | None = None
    high: int | None = None
    width: int = 1
    below: int = 0
    target: float = 0.0
    slack: float = 0.0
    group_slack: float = 0.0


def _orders(dims: list[str], ties: list[str]) -> list[list[str]]:
    """For each dimension, the columns in the order in which rows are compared along it."""
    return [[d, *(x for x in dims if x != d), *ties] for d in dims]


def _key(orders: list[list[str]], dim: Column) -> Column:
    """A row's values in the order that dim leads. Arrays compare as the columns one by one would."""
    out = F.array(*orders[-1])
    for i in range(len(orders) - 1):
        out = F.when(dim == i, F.array(*orders[i])).otherwise(out)
    return out


def _told(nodes: list[Node], size: int, fields: dict) -> Column:
    """For a row's node, the struct of fields (name to a type and a function of the node), null for nodes not in nodes.

    It is one constant, so that plans and compiled code stay the same however many nodes there are.
    """
    by_id, kind = {x.id: x for x in nodes}, ", ".join(f"{k}: {t}" for k, (t, _) in fields.items())

    def shown(value, type_: str) -> str:
        items = f"array({', '.join(f'{v}L' for v in value)})" if isinstance(value, list) else "NULL" if value is None else str(value)
        return f"CAST({items} AS {type_})"

    def row(x: Node | None) -> str:
        if x is None:
            return f"CAST(NULL AS STRUCT<{kind}>)"
        return "named_struct(" + ", ".join(f"'{k}', {shown(f(x), t)}" for k, (t, f) in fields.items()) + ")"

    return F.get(F.expr(f"array({', '.join(row(by_id.get(i)) for i in range(size))})"), F.col("node"))


def _moved(rows: DataFrame, nodes: list[Node], size: int, orders: list[list[str]]) -> DataFrame:
    """rows with node moved on to the left or right of nodes, which have been cut; other rows stay where they are."""
    told = _told(nodes, size, {"dim": ("INT", lambda x: x.dim), "cut": ("ARRAY<BIGINT>", lambda x: x.cut), "left": ("INT", lambda x: x.left.id), "right": ("INT", lambda x: x.right.id)})
    at = rows.withColumn("_told", told)
    goes = F.when(_key(orders, F.col("_told.dim")) < F.col("_told.cut"), F.col("_told.left")).otherwise(F.col("_told.right"))
    return at.withColumn("node", F.when(F.col("_told").isNull(), F.col("node")).otherwise(goes)).drop("_told")


def _search(rows: DataFrame, nodes: list[Node], size: int, orders: list[list[str]], n_group: int, bins: int) -> None:
    """Find the cut of each of nodes; rows has the columns of orders, size, and node. The first n_group columns of an order
    are those of a group of equal texts."""
    fields = {
        "dim": ("INT", lambda x: x.dim), "prefix": ("ARRAY<BIGINT>", lambda x: x.prefix), "low": ("BIGINT", lambda x: x.low), "high": ("BIGINT", lambda x: x.high), "width": ("BIGINT", lambda x: x.width)
    }
    todo = nodes
    while todo:
        at = rows.select("node", "size", *(c for c in orders[0] if c != "size"), _told(todo, size, fields).alias("_told")).filter("_told IS NOT NULL")
        at = at.select("node", "size", "_told", _key(orders, F.col("_told.dim")).alias("_key"))
        known = F.size("_told.prefix")
        at = at.filter(F.slice("_key", F.lit(1), known) == F.col("_told.prefix"))
        at = at.select("node", "size", "_told", F.get("_key", known).alias("_at")).filter("_told.low IS NULL OR _at BETWEEN _told.low AND _told.high")
        place = F.expr("coalesce((_at - _told.low) DIV _told.width, 0L)").alias("bin")
        got: dict[int, list] = {x.id: [] for x in todo}
        for r in at.groupBy("node", place).agg(F.sum("size").alias("size"), F.min("_at").alias("low"), F.max("_at").alias("high")).collect():
            got[r["node"]].append(r)
        still = []
        for x in todo:
            sums = sorted(got[x.id], key=lambda r: r["bin"])
            if x.low is None:
                if not sums:
                    x.cut = [*x.prefix, 0]
                    continue
                x.low, x.high = sums[0]["low"], sums[0]["high"]
                x.width = -(-(x.high - x.low + 1) // bins)
                still.append(x)
                continue
            below = x.below
            for r in sums:
                start = x.low + r["bin"] * x.width
                if below + r["size"] >= x.target or r is sums[-1]:
                    break
                below += r["size"]
            after, end = below + r["size"], min(x.high, start + x.width - 1)
            near, cut = min((abs(below - x.target), start), (abs(after - x.target), end + 1))
            tied, keys_left = x.width == 1, len(orders[0]) - len(x.prefix)
            in_group = tied and len(x.prefix) + 1 >= n_group
            if near <= x.slack or tied and keys_left == 1 or in_group and r["size"] <= x.group_slack:
                x.cut = [*x.prefix, cut]
                continue
            if tied:
                x.prefix, x.low, x.high, x.width = [*x.prefix, start], None, None, 1
            else:
                x.low, x.high = start, end
                x.width = -(-(end - start + 1) // bins)
            x.below = below
            still.append(x)
        todo = still


def build_tree(
    rows: DataFrame,
    dims: list[str],
    ties: list[str],
    shards: int,
    bins: int = 1024,
    group_slack: float = 0.05,
    slack: float = 0.002
) -> DataFrame:
    """rows (with dims, ties and size, all long) with shard. Nodes are cut along one of dims; ties decide between equals, of
    which all but the last (the id) belong to a text. slack: how far, in shares of a shard, a cut may be off.

    Each level of the tree is written to the checkpoint folder with the node that a row has come to.
    """
    orders = _orders(dims, ties)
    every = [Node(0, 0, shards)]
    at, whole, leaves = rows.withColumn("node", F.lit(0)), {}, every[:]
    while nodes := [x for x in leaves if x.n > 1]:
        spans = at.groupBy("node").agg(
            F.sum("size").alias("_size"),
            *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max)))
        )
        by_node = {r["node"]: r for r in spans.collect()}
        whole = whole or {d: max(1, by_node[0][f"high_{d}"] - by_node[0][f"low_{d}"]) for d in dims} if by_node else {}
        for x in nodes:
            r, half = by_node.get(x.id), x.n // 2
            if r is None:
                x.cut = [0]
            else:
                widest = max(dims, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / whole[d])
                x.dim, x.low, x.high = dims.index(widest), r[f"low_{widest}"], r[f"high_{widest}"]
                x.width = -(-(x.high - x.low + 1) // bins)
                x.target, x.slack, x.group_slack = r["_size"] * half / x.n, slack * r["_size"] / x.n, group_slack * r["_size"] / x.n
        _search(at, [x for x in nodes if not x.cut], len(every), orders, len(dims) + len(ties) - 1, bins)
        for x in nodes:
            half = x.n // 2
            x.left, x.right = Node(len(every), x.first, half), Node(len(every) + 1, x.first + half, x.n - half)
            every += [x.left, x.right]
        leaves = [y for x in leaves for y in ((x.left, x.right) if x.left else (x,))]
        at = checkpointed(_moved(at, nodes, len(every), orders))
    shard_of = _told(leaves, len(every), {"first": ("INT", lambda x: x.first)})
    return at.withColumn("shard", shard_of["first"]).drop("node")


def _code(value: Column) -> Column:
    """20 bits that tell values apart well enough to keep equal ones together; they take two rounds of a search."""
    return F.shiftrightunsigned(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 12)


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = 40,
    target_bytes: int | None = None,
    per_row: int = 16,
    metadata: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row.

    size: bytes of the text plus per_row. shards of nearly equal bytes; if it is None, as many as target_bytes asks for.
    metadata: columns that make dimensions besides the size; those that docs doesn't have are left out.
    slot: gapless from 0 in each shard, by id. Slots come from counts by range partition, not from one task a shard.
    """
    codes = {f"_m{i}": _code(F.col(c)) for i, c in enumerate(metadata) if c in docs.columns}
    meta = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + per_row).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *(c.alias(k) for k, c in codes.items()),
    )
    meta = checkpointed(meta)
    if codes:
        least = checkpointed(meta.groupBy("size", "text_crc32").agg(*(F.min(k).alias(k) for k in codes)))
        meta = checkpointed(meta.drop(*codes).join(least, ["size", "text_crc32"]))
    if shards is None:
        shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = build_tree(meta, ["size", *codes], ["text_crc32", "_id"], shards)
    ranged = placed.drop(*codes).repartitionByRange("shard", "_id", "text_crc32")
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("_id", "text_crc32", "size"))
    placed = ranged.withColumn("rank", rank).join(offsets, ["part", "shard"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard")
    )
