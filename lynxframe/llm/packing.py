"""Hierarchical residual best-fit packing (operator 1)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm.common import Scratch, lean, text_or_empty
from lynxframe.llm.tokens import load_ranks, tokenizer_path

#: What byte_bpe_50k.json treats as special wherever a text holds it.
SPECIAL = (("<|endoftext|>", 50256),)

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = pa.schema([("fill", pa.int32()), ("members", pa.list_(MEMBER))])
BIN_DDL = "fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the members of each bin, by position.

    The open bins stand in stacks by the room they have left; a bit mask of the stacks in use finds the tightest
    fitting one at once, so the cost of an item does not depend on how many bins are open.
    """
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need = sizes[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, own = capacity, []
            bins.append(own)
        own.append(i)
        if room - need:
            rooms[room - need].append(own)
            mask |= 1 << (room - need)
    return bins


def _bins(fills: list[int], members: list[list[dict]], capacity: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Pack items, each of one or more members, and give the bins in batches."""
    packed = best_fit(fills, capacity)
    for k in range(0, len(packed), rows):
        run = packed[k : k + rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([sum(fills[i] for i in b) for b in run], pa.int32()), pa.array([[m for i in b for m in members[i]] for b in run], pa.list_(MEMBER))],
            schema=BIN,
        )


def pack(docs: DataFrame, tokenizer_ranks: str, capacity: int = 1024, end_id: int = 2, slack: int = 4, items_per_task: int = 50_000) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    Each partition encodes its documents, cuts those longer than ``capacity`` (all pieces full but the first) and packs
    the pieces best-fit into bins, ``items_per_task`` at a time. Bins with at most ``slack`` free tokens are final. The
    others go on as items: each round merges them over fewer partitions and packs them best-fit again, until one
    partition's worth is left or a round merges under a hundredth of them. A bin carries its members (at most
    ``capacity``, as each has a token or more), so no round looks at texts again, and every round is a written table.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is a
    piece of one token, the end id. Repeated rows are packed each on its own; a null doc_id stays null; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def encode_and_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_ranks(tokenizer_path(tokenizer_ranks), SPECIAL)
        fills: list[int] = []
        members: list[list[dict]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encoding.encode(text, allowed_special="all"), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    fills.append(length)
                    members.append([{"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc}])
            if len(fills) >= items_per_task:
                yield from _bins(fills, members, capacity)
                fills, members = [], []
        yield from _bins(fills, members, capacity)

    def fit_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        members: list[list[dict]] = []
        for batch in batches:
            fills += batch.column("fill").to_pylist()
            members += batch.column("members").to_pylist()
            if len(fills) >= 4 * items_per_task:
                yield from _bins(fills, members, capacity)
                fills, members = [], []
        yield from _bins(fills, members, capacity)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bins = scratch.save(texts.mapInArrow(lean(encode_and_fit), BIN_DDL))
    done = bins.where(F.col("fill") >= capacity - slack)
    left = bins.where(F.col("fill") < capacity - slack)
    count = left.count()
    parts = max(1, -(-count // (items_per_task // 8)))
    while count > 1:
        # Round-robin by content, so that a lost task deals its rows out again as before.
        deal = F.hash(F.col("members").getItem(0), F.lit(parts))
        merged = scratch.save(left.repartition(parts, deal).mapInArrow(lean(fit_again), BIN_DDL))
        done = done.unionByName(merged.where(F.col("fill") >= capacity - slack))
        left = merged.where(F.col("fill") < capacity - slack)
        after, last, before = left.count(), parts == 1, count
        merged_now = before - merged.count()
        count, parts = after, max(1, min(parts // 4, -(-after // items_per_task)))
        if last or merged_now < 0.01 * before and parts * items_per_task < after:
            break
    sequences = done.unionByName(left).withColumn("sequence_id", F.monotonically_increasing_id())
    # The offset of a member is the length of those before it in its bin.
    offsets = F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (a, m) -> a + m.length))")
    placed = sequences.select("sequence_id", F.posexplode(F.arrays_zip("members", offsets.alias("offsets"))).alias("at", "m"))
    return placed.select(*[F.col(f"m.members.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], "sequence_id", F.col("m.offsets").alias("offset"))
