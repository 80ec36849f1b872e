"""Resharding by minimum-cost flow.

Old shard sizes supply, new capacities demand; an edge costs the bytes that cross it, staying is free. The flow, solved
on the graph of shards (its size is the number of shards, not of rows), says how many bytes go from each old to each new
shard. Rows in the order of their old shard are cut into blocks at these byte counts, so that all but the rows at a cut
move or stay in whole blocks. Law ``bytes``: the new shards' sizes are equal but for a row at each cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import shuffle_width, staged, with_rank


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_transfers(
    sizes: dict[int, int], capacities: list[int], cost: dict[tuple[int, int], int] | None = None
) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, of the least total cost (by default 1 a byte moved, 0 a byte kept).

    Successive shortest paths with Bellman-Ford over old and new shards. The capacities must hold all bytes.
    """
    if sum(capacities) < sum(sizes.values()):
        raise ValueError("the new shards can't hold all bytes")
    price = lambda o, n: (cost or {}).get((o, n), int(o != n))
    flow: dict[tuple[int, int], int] = {}
    left, room = dict(sizes), dict(enumerate(capacities))
    while any(left.values()):
        dist: dict[tuple[str, int], float] = {("o", o): 0 for o, v in left.items() if v}
        back: dict[tuple[str, int], tuple[str, int]] = {}
        for _ in range(len(sizes) + len(capacities)):
            changed = False
            for o in sizes:
                for n in room:
                    u, v = ("o", o), ("n", n)
                    if u in dist and dist[u] + price(o, n) < dist.get(v, float("inf")):
                        dist[v], back[v], changed = dist[u] + price(o, n), u, True
                    if v in dist and flow.get((o, n)) and dist[v] - price(o, n) < dist.get(u, float("inf")):
                        dist[u], back[u], changed = dist[v] - price(o, n), v, True
            if not changed:
                break
        at = min((("n", n) for n, r in room.items() if r and ("n", n) in dist), key=lambda v: (dist[v], v))
        path = [at]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        hops = list(zip(path, path[1:], strict=False))
        amount = min(left[path[0][1]], room[at[1]], *(flow[(b[1], a[1])] for a, b in hops if a[0] == "n"))
        for a, b in hops:
            key, step = ((a[1], b[1]), amount) if a[0] == "o" else ((b[1], a[1]), -amount)
            flow[key] = flow.get(key, 0) + step
        left[path[0][1]] -= amount
        room[at[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def reshard(
    rows: DataFrame, shards: int, old: str = "old_shard", size: str = "size", order: tuple[str, ...] = ("doc_id",), capacities: list[int] | None = None
) -> DataFrame:
    """Add shard and slot to rows that have their old shard's number and their size.

    Only one total per old shard, and per old and new shard, reaches the driver. A row goes where the middle of its bytes
    falls; slots number the rows of a new shard from 0 without gaps. Repeated rows each get their own slot. Other columns
    stay, so whole rows can be placed for rewrite_affected(), or slim ones for a plan.
    """
    spark = rows.sparkSession
    ranked = staged(with_rank(rows, [old], list(order), max(16, shuffle_width(spark)), rank="_rank", running=(size, "_before")), "ranked")
    sizes = {r[old]: int(r["bytes"]) for r in ranked.groupBy(old).agg(F.sum(size).alias("bytes")).collect()}
    flow = min_cost_transfers(sizes, capacities or equal_capacities(sum(sizes.values()), shards))
    cuts: dict[int, list[tuple[int, int]]] = {}
    for o in sizes:
        end = 0
        for n in sorted((n for a, n in flow if a == o), key=lambda n: (n != o, n)):
            end += flow[(o, n)]
            cuts.setdefault(o, []).append((end, n))
    shard = F.lit(None).cast("int")
    for o, found in cuts.items():
        to = F.lit(found[-1][1])
        for end, n in reversed(found[:-1]):
            to = F.when(F.col("_before") * 2 + F.col(size) < 2 * end, n).otherwise(to)
        shard = F.when(F.col(old) == o, to).otherwise(shard)
    placed = ranked.withColumn("shard", shard)
    blocks = placed.groupBy(old, "shard").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).collect()
    slot, ends = F.lit(None).cast("long"), {}
    for r in sorted(blocks, key=lambda r: (r["shard"], r[old])):
        start = ends.get(r["shard"], 0)
        slot = F.when((F.col(old) == r[old]) & (F.col("shard") == r["shard"]), F.col("_rank") - r["first"] + start).otherwise(slot)
        ends[r["shard"]] = start + r["n"]
    return placed.withColumn("slot", slot.cast("long")).drop("_rank", "_before")


def rewrite_affected(placed: DataFrame, path: str, old: str = "old_shard", rows_per_file: int = 1_000_000) -> list[int]:
    """Write the new files of every shard that loses or gains rows to the new folder path/shard=N; returns those shards.

    ``placed`` is reshard()'s result over whole rows, all columns of which are written, with their slots: every row once,
    repeated rows and null ids too. A shard that loses all its rows is returned but has no files. Shards whose rows all stay
    are not written again. Files are ranges of slots, so a large shard is several tasks' work. The folder must be new, so
    that neither the old files nor those of a run that failed are mistaken for these.
    """
    moves = placed.filter(~F.col(old).eqNullSafe(F.col("shard"))).select(old, "shard").distinct().collect()
    touched = sorted({x for r in moves for x in r if x is not None})
    whole = placed.filter(F.col("shard").isin(touched)).withColumn("_file", F.floor(F.col("slot") / rows_per_file))
    whole.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
    return touched


def reshard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The columns of op6. The old shards come from the sources (crc32 of source modulo the number of shards; null: 0).

    Null texts have size 1 and the crc32 of the empty text; rows with a null id, and repeated rows, each get a slot of their
    own; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(shards)), F.lit(0)).cast("int").alias("old_shard"),
    )
    out = reshard(rows, shards, order=("doc_id", "text_crc32"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )
