"""K-d tree sharding by distributed weighted medians (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynxframe.llm.common import Scratch, hot_join, hot_keys, text_or_empty

#: Bits of a split key, from the top: place in the dimension, hash of the text, hash of the unit.
PLACE_BITS, TEXT_BITS, ROW_BITS = 16, 24, 23
KEY_BITS = PLACE_BITS + TEXT_BITS + ROW_BITS
#: Bits that one pass of the median search settles.
PASS_BITS = 14


def category(name: str) -> Column:
    """A place in [0, 1) for a value without order; null has one too."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\0"))), 11) / F.lit(float(1 << 53))


def metadata_dimensions(docs: DataFrame) -> dict[str, Column]:
    """The dimensions used by default, each scaled to [0, 1): size, and language and source where the table has them."""
    out = {"size": F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(0.999999))}
    return out | {x: category(x) for x in ("lang", "source") if x in docs.columns}


def _key(place: Column, text: Column, *row: Column) -> Column:
    high = F.shiftleft(F.floor(place * (1 << PLACE_BITS)).cast("long"), TEXT_BITS + ROW_BITS)
    middle = F.shiftleft(F.shiftrightunsigned(text, 64 - TEXT_BITS), ROW_BITS)
    return high.bitwiseOR(middle).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*row), 64 - ROW_BITS))


def _by_node(values: dict[int, int | float], other: int | float) -> Column:
    """A value per node, as a look-up in a constant array: nodes are numbered like a heap, so the array is short."""
    kind = float if isinstance(other, float) else int
    return F.coalesce(F.get(F.lit([kind(values.get(n, other)) for n in range(max(values) + 1)]), F.col("node")), F.lit(other))


def _splits(units: DataFrame, need: dict[int, float], tolerance: float) -> dict[int, tuple[int, float]]:
    """For each node the key from which its units go right, so that the left gets ``need`` bytes, and what the left gets.

    A histogram of the keys' top bits finds the bin in which these are reached; only that bin is looked into more
    closely, until the rest is within ``tolerance`` bytes, or one unit, or the key is used up. A row per node reaches the
    driver; nodes without units have no entry.
    """
    done: dict[int, tuple[int, float]] = {}
    open_ = {n: (0, max(x, 0.0), 0.0) for n, x in need.items()}  # the bin looked into, the bytes wanted of it, the bytes left of it
    bits = 0
    while open_:
        take = min(PASS_BITS, KEY_BITS - bits)
        shift = KEY_BITS - bits - take
        inside = _by_node({n: low for n, (low, _, _) in open_.items()}, -1) == F.shiftright("key", KEY_BITS - bits)
        if not bits:
            inside = _by_node(dict.fromkeys(open_, 1), 0) == 1
        bins = units.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = F.sum("size").over(Window.partitionBy("node").orderBy("bin")) - F.col("size")
        # The last bin that begins at or below the bytes wanted; a node has at most 2 ** PASS_BITS bins.
        reached = bins.withColumn("before", before).where(F.col("before") <= _by_node({n: float(x) for n, (_, x, _) in open_.items()}, -1.0))
        found = reached.groupBy("node").agg(F.max(F.struct("bin", "before", "size", "n")).alias("m")).select("node", "m.*").collect()
        still = {}
        for r in found:
            _, wanted, left = open_[r["node"]]
            rest = wanted - r["before"]
            over = rest > r["size"] - rest
            if r["n"] == 1 or shift == 0 or min(abs(rest), abs(r["size"] - rest)) <= tolerance:
                done[r["node"]] = ((r["bin"] + over) << shift, left + r["before"] + r["size"] * over)
            else:
                still[r["node"]] = (r["bin"], rest, left + r["before"])
        open_ = still
        bits += take
    return done


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, rows_per_slot_task: int = 50_000) -> DataFrame:
    """Put every row into a shard of about equal bytes, near rows of its metadata, and equal texts together.

    The unit is the group of rows with one text; it has the metadata of its smallest doc_id. Groups larger than a shard
    are cut into pieces of 1/256 of a shard at most, which stay neighbours; no other group is torn. Units are split at the
    weighted median (for an odd number of leaves: the weighted share) along the dimension in which the node is widest,
    until there are ``shards`` leaves, or as many as ``target_bytes`` asks for. A row weighs the UTF-8 bytes of its text
    (null: none) plus 16. Large units (over 1/64 of a shard) have a median of their own, and that of the small ones makes
    up for what it leaves uneven, so that the unit at a boundary does not decide how equal two shards are. Units at one
    place of a dimension are ordered by their text's hash, so a hot language or source is split like anything else.
    Medians come from histograms: what reaches the driver is a row per node.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in the shard), grown_shard (null: this
    law moves rows when a shard is added). Repeated rows are rows of their own; a null doc_id, language or source is a
    value; an empty table gives no rows; with fewer groups than shards some shards are empty; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "kd-shards")
    text = text_or_empty()
    sized = docs.select(F.col("doc_id"), text.alias("text"), (F.octet_length(text) + 16).cast("long").alias("size"), *[c for c in ("lang", "source") if c in docs.columns and not dimensions], *([] if not dimensions else [c.alias(f"_dim_{n}") for n, c in dimensions.items()]))
    places = {n: F.col(f"_dim_{n}") for n in dimensions} if dimensions else metadata_dimensions(docs)
    hashed = [F.xxhash64("text"), F.col("doc_id"), F.col("size")]
    rows = sized.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.array(*[p.cast("double") for p in places.values()]).alias("place"), F.xxhash64("text").alias("text_hash"), F.xxhash64(*hashed).alias("row_hash"))
    rows = scratch.save(rows)
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    leaves = shards or max(1, -(-(total or 0) // target_bytes))
    target = (total or 0) / leaves
    first_row = F.min(F.struct("doc_id", "row_hash", "place"))
    # Fewer groups than shards can be larger than one, so there is a row a shard at most to broadcast.
    large = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), first_row.alias("f")).where(F.col("bytes") > target)
    large = large.select("text_hash", F.ceil(F.col("bytes") / max(target / 256, 1)).alias("pieces"), F.col("f.place").alias("of_all"))
    rows = rows.join(F.broadcast(large), "text_hash", "left").withColumn("piece", F.coalesce(F.pmod("row_hash", "pieces"), F.lit(0))).withColumn("place", F.coalesce("of_all", "place")).drop("pieces", "of_all")
    rows = scratch.save(rows)
    grouped = rows.groupBy("text_hash", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n"), first_row.alias("f"))
    units = scratch.save(grouped.select("text_hash", "piece", "size", "n", F.col("f.place").alias("place"), F.xxhash64("text_hash", "piece").alias("unit_hash"), F.lit(1).alias("node"), F.lit(None).cast("long").alias("key")))
    big = F.col("size") > target / 64

    count = {1: leaves}  # leaves below each open node
    first = {1: 0}  # the first shard below each node
    while any(k > 1 for k in count.values()):
        live = [n for n, k in count.items() if k > 1]
        box = units.where(F.col("node").isin(live)).groupBy("node").agg(F.sum("size").alias("size"), F.sum(F.when(big, F.col("size")).otherwise(0)).alias("big"), *[F.min(F.col("place")[i]).alias(f"lo{i}") for i in range(len(places))], *[F.max(F.col("place")[i]).alias(f"hi{i}") for i in range(len(places))])
        nodes = {}
        for r in box.collect():
            widest = max(range(len(places)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
            share = (count[r["node"]] // 2) / count[r["node"]]
            nodes[r["node"]] = {"dim": widest, "need": r["size"] * share, "big": r["big"] * share}
        if not nodes:
            break
        dim = _by_node({n: x["dim"] for n, x in nodes.items()}, -1)
        keyed = units.withColumn("key", F.when(dim >= 0, _key(F.get("place", dim), F.col("text_hash"), F.col("unit_hash"))))
        inner = keyed.where("key is not null")
        for_big = _splits(inner.where(big), {n: x["big"] for n, x in nodes.items() if x["big"]}, target * 0.0005)
        for_small = _splits(inner.where(~big), {n: x["need"] - for_big.get(n, (0, 0.0))[1] for n, x in nodes.items()}, target * 0.0005)
        at = F.when(big, _by_node({n: k for n, (k, _) in for_big.items()} or {0: 0}, 0)).otherwise(_by_node({n: k for n, (k, _) in for_small.items()} or {0: 0}, 0))
        moved = F.when(F.col("key").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (F.col("key") >= at).cast("int"))
        split = scratch.save(keyed.withColumn("node", moved))
        scratch.drop(units)
        units = split
        for n in live:
            k, s = count.pop(n), first.pop(n)
            if n in nodes:
                count |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
                first |= {2 * n: s, 2 * n + 1: s + k // 2}
    shard = _by_node(first, 0)
    of_units = scratch.save(units.select("text_hash", "piece", "n", shard.cast("int").alias("shard")))
    scratch.drop(units)
    # Slots: numbered within parts of a shard, after the rows of the parts before.
    parts = max(8, -(-(n_rows or 0) // (leaves * rows_per_slot_task)))
    placed = hot_join(rows, of_units.drop("n"), ["text_hash", "piece"], hot_keys(of_units)).select("doc_id", "size", "text_crc32", "row_hash", "shard", F.pmod("row_hash", F.lit(parts)).cast("int").alias("part"))
    placed = scratch.save(placed)
    sums = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = sums.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("from"))
    # The join brings the parts together that the numbering needs, so it costs no exchange.
    numbered = placed.join(starts.hint("merge"), ["shard", "part"]).withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_hash", "doc_id")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("from") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
