"""Chat formatting as a prefix tree (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lynxframe.llm.common import NO_ID, Scratch, lean, tasks_for
from lynxframe.llm.tokens import load_ranks, tokenizer_path

#: Control strings of the template and their ids, after the 50,256 ranks.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ((START, 50257), (END, 50258))

#: Bytes of the digest that stands for a turn and all turns before it.
KEY = 16

#: A key that many rows ask for is looked up in this many tasks.
SALTS = 64

PLACED = "conv_id long, keys array<binary>, ends array<int>, ids binary, losses array<struct<from:int,to:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def escape(text: str) -> str:
    """One backslash more between < and | wherever none or some stand there: no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(encoding, role: str, text: str) -> tuple[list[int], int, int]:
    """Ids of a turn, and the span of its text in them."""
    head = [CONTROL[0][1], *encoding.encode_ordinary(escape_role(role) + "\n")]
    body = encoding.encode_ordinary(escape(text))
    return [*head, *body, CONTROL[1][1], *encoding.encode_ordinary("\n")], len(head), len(head) + len(body)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))


def _lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Join ``table`` (one row a key) to rows of conversations, of which very many may ask for one key: the key's row is
    copied once for each salt that asks for it, so no task has all of them, and there are never more copies than rows."""
    asked = _salted(rows)
    copies = asked.select(key, "salt").distinct().join(table.hint("merge"), key)
    return asked.join(copies.hint("merge"), [key, "salt"]).drop("salt")


def _starts(scratch: Scratch, chains: DataFrame, per_task: int) -> DataFrame:
    """``start``: tokens of all chains with smaller paths, by a range-partitioned sort and a sum per partition."""
    spark = chains.sparkSession
    ordered = scratch.save(chains.repartitionByRange(tasks_for(spark, chains.count(), per_task), "path").withColumn("part", F.spark_partition_id()))
    # One row per partition reaches the driver.
    before, bases = 0, {}
    for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases[r["part"]], before = before, before + r["n"]
    offsets = spark.createDataFrame(list(bases.items()), "part int, base long")
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("path"))
    placed = ordered.withColumn("run", run).join(F.broadcast(offsets), "part")
    return scratch.save(placed.withColumn("start", F.col("base") + F.col("run") - F.col("n_tokens")).drop("part", "base", "run"))


def prefix_tree(conversations: DataFrame, tokenizer_ranks: str, nodes_per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Merge conversations that share initial turns and emit each shared turn's tokens once, depth first.

    A turn is known by a rolling digest of itself and all turns before it, and belongs to the smallest conv_id that has
    it. What one conversation owns is the end of it, its chain; the turns before are ends or middles of other chains.
    The forest is emitted depth first with the owner's branch before the others, so a chain is one run of the stream, and
    a token attends to the tokens of its chain before it and to one interval of each chain above. There are never more
    such intervals than turns in the input. A chain's path is, for each chain from the root's down to it, where that
    leaves the one before (deepest first) and its conv_id; sorting by path is the depth-first order.

    Returns (nodes, leaves). nodes, a row a chain: path, conv_id, start (first token's place in the stream), n_tokens,
    position (position id of the first token; they run on by one), ids (little-endian unsigned 16-bit), loss (spans
    [from, to) of ids under the loss mask: the texts of assistant turns), ancestors (intervals [from, to) of the stream).
    leaves, a row a conversation: conv_id, spans (position, and the interval [from, to) of the stream, in order).

    Rows are ordered by turn (nulls first), then role and text, so ties and repeated rows have one order; null roles and
    texts are empty; rows with a null conv_id (or 2^63 - 1, which stands for it) are one conversation; an empty table
    gives no rows; other columns are not read. A conversation's own turns meet in one task, as its digests need them in
    order; conversations that begin alike never do.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    empty = F.lit("")
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    turns = conversations.select(conv.alias("conv_id"), F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.expr("transform(turns, t -> struct(t.role as role, t.text as text))").alias("turns"))
    schema = to_arrow_schema(StructType.fromDDL(PLACED))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_ranks(tokenizer_path(tokenizer_ranks))
        for batch in batches:
            rows = []
            for conv_id, own in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                key, keys, ends, ids, losses = b"", [], [], [], []
                for t in own:
                    key = hashlib.sha256(key + f"{len(t['role'])}:{t['role']}{t['text']}".encode()).digest()[:KEY]
                    more, a, b = format_turn(encoding, t["role"], t["text"])
                    if t["role"] == "assistant":
                        losses.append({"from": len(ids) + a, "to": len(ids) + b})
                    ids += more
                    keys.append(key)
                    ends.append(len(ids))
                rows.append({"conv_id": conv_id, "keys": keys, "ends": ends, "ids": np.array(ids, "<u2").tobytes(), "losses": losses})
            yield pa.RecordBatch.from_pylist(rows, schema)

    placed = scratch.save(whole.mapInArrow(lean(walk), PLACED))
    steps = placed.select("conv_id", F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("ends").alias("end"))).alias("depth", "t")).select("conv_id", "depth", "t.key", "t.end")
    owners = steps.groupBy("key").agg(F.min("conv_id").alias("owner"))
    runs = _lookup(steps, "key", owners).groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"), F.max("end").alias("end"))
    spans = scratch.save(runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "end", "owner"))).alias("spans")))

    path = "unhex(array_join(transform(spans, (s, i) -> concat(lpad(hex(4294967295 - if(i = 0, 0, spans[i - 1].depth + 1)), 8, '0'), lpad(hex(s.owner), 16, '0'))), ''))"
    at = "if(size(spans) > 1, spans[size(spans) - 2].end, 0)"
    chains = spans.where("element_at(spans, -1).owner = conv_id").selectExpr("conv_id", f"{path} as path", f"{at} as position", f"element_at(spans, -1).end - {at} as n_tokens")
    starts = _starts(scratch, chains, nodes_per_task)

    pieces = spans.select("conv_id", F.explode(F.expr("transform(spans, (s, i) -> struct(s.owner as owner, if(i = 0, 0, spans[i - 1].end) as position, s.end as end))")).alias("s")).select("conv_id", "s.*")
    found = _lookup(pieces, "owner", starts.select(F.col("conv_id").alias("owner"), "start"))
    span = F.struct("position", F.col("start").alias("from"), (F.col("start") + F.col("end") - F.col("position")).alias("to"))
    leaves = scratch.save(found.groupBy("conv_id").agg(F.array_sort(F.collect_list(span)).alias("spans")))

    whole_rows = starts.join(leaves.hint("merge"), "conv_id").join(placed.select("conv_id", "ids", "losses").hint("merge"), "conv_id")
    nodes = whole_rows.selectExpr(
        "path", "conv_id", "start", "cast(n_tokens as long) as n_tokens", "cast(position as long) as position", "substring(ids, 2 * position + 1, 2 * n_tokens) as ids",
        "transform(filter(losses, l -> l.from >= position), l -> struct(l.from - position as from, l.to - position as to)) as loss",
        "transform(slice(spans, 1, size(spans) - 1), s -> struct(s.from as from, s.to as to)) as ancestors",
    )
    return scratch.save(nodes), leaves


def read_back(nodes: DataFrame, leaves: DataFrame, tokenizer_ranks: str) -> DataFrame:
    """Every conversation from the emitted stream: its leaf's intervals, the ids there, decoded and parsed.

    Returns conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars and loss_sha256 (all text under
    the loss mask, unescaped), formatted_chars (code points as formatted) and n_tokens.
    """
    scratch = Scratch(nodes.sparkSession, "chat-read")
    asked = _salted(leaves.select("conv_id", F.explode("spans").alias("s")).selectExpr("conv_id", "s.position", "s.from as start", "cast(s.to - s.from as int) as n"))
    # A salt's copy of a chain is no longer than the longest piece that one of its rows reads.
    wanted = asked.groupBy("start", "salt").agg(F.max("n").alias("most"))
    copies = wanted.join(nodes.select("start", "ids", "loss").hint("merge"), "start").selectExpr("start", "salt", "substring(ids, 1, 2 * most) as ids", "filter(loss, l -> l.to <= most) as loss")
    piece = F.expr("struct(position, substring(ids, 1, 2 * n) as ids, filter(loss, l -> l.to <= n) as loss)")
    pieces = asked.join(copies.hint("merge"), ["start", "salt"]).select("conv_id", piece.alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_ranks(tokenizer_path(tokenizer_ranks), CONTROL)
        turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
        for batch in batches:
            rows = []
            for conv_id, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                ids = [np.frombuffer(p["ids"], "<u2").tolist() for p in pieces]
                text = encoding.decode([i for x in ids for i in x])
                turns = [(unescape_role(m[1]), unescape(m[2])) for m in turn.finditer(text)]
                loss = "".join(unescape(encoding.decode(x[s["from"] : s["to"]])) for x, p in zip(ids, pieces, strict=True) for s in p["loss"])
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append({
                    "conv_id": None if conv_id == NO_ID else conv_id, "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text), "n_tokens": sum(map(len, ids)),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scratch.save(whole).mapInArrow(lean(parse), READ)
