"""Quality rules by compression bands (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.llm.common import lean

SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANK = re.compile(r"[\x20\x09-\x0D]")

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{x} long" for x in SIGNALS) + ", base_failed boolean, ratio double, min_chunk_ratio double, max_chunk_ratio double, kept boolean"


@dataclass(frozen=True)
class Bands:
    """Limits on raw bytes / compressed bytes.

    ``whole``: (up to so many bytes, least ratio, greatest ratio); longer texts compress better, so each length has its
    own limits. A text below the least is incompressible, one above the greatest repetitive. ``chunk_bytes`` is the size
    of the fixed chunks; the last, shorter one is only judged if it is at least half of that, or if it is the whole text.
    ``bad_chunks``: a text with a greater share of its chunks out of the chunk band is rejected.

    The limits come from a sample: the 1,578 texts of sf0.1 that hold the base rules, are labelled quality 1 and have an
    even doc_id. Each length class of ``whole`` contains the middle 99.5 % of its ratios, rounded outward; up to 256 bytes
    the sample has none. ``chunk`` contains all chunks of clean texts there (1.99 to 2.26).
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (256, 0.8, 3.0), (384, 1.35, 1.75), (512, 1.4, 1.9), (768, 1.45, 1.9), (1024, 1.6, 2.0), (1536, 1.7, 2.1), (2048, 1.8, 2.12), (3072, 1.9, 2.18),
        (4096, 2.0, 2.24), (6144, 2.1, 2.32), (8192, 2.15, 2.36), (16384, 2.2, 2.44), (float("inf"), 2.25, 2.6),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.95, 2.3)
    bad_chunks: float = 0.05
    level: int = 3
    least_words: int = 50
    repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of three words which the text has twice or more."""
    runs = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(runs)) == len(runs):
        return 0
    seen: set = set()
    twice: set = set()
    for run in runs:
        (twice if run in seen else seen).add(run)
    count, until = 0, 0
    for at, run in enumerate(runs):
        if run in twice:
            count += at + 3 - max(at, until)
            until = at + 3
    return count


def judge(text: str | None, bands: Bands, pack) -> tuple:
    """The row of one text, in the order of SCHEMA. ``pack``: bytes to their compressed length."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeat = len(words), repeated_words(words)
    failed = n < bands.least_words or 100 * repeat > bands.repeat_percent * n
    base = (n, len(text) - len(BLANK.findall(text)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat, failed)
    if not raw:
        return (*base, None, None, None, False)
    ratio = len(raw) / pack(raw)
    least, most = next((a, b) for top, a, b in bands.whole if len(raw) <= top)
    chunks = [raw[k : k + bands.chunk_bytes] for k in range(0, len(raw), bands.chunk_bytes)]
    if len(chunks) == 1:
        parts = [ratio]
        bad = 0
    else:
        parts = [len(c) / pack(c) for c in chunks if 2 * len(c) >= bands.chunk_bytes]
        bad = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in parts)
    kept = not failed and least <= ratio <= most and bad <= bands.bad_chunks * len(parts)
    return (*base, ratio, min(parts), max(parts), kept)


def quality(docs: DataFrame, bands: Bands = Bands(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """Signals and verdict of every whole text.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. Base signals: n_words, word_chars (code points in words), n_symbols
    (``[#*$%&|<>]``), n_dup_lines (\\n-split lines with a word, equal to an earlier line), n_repeat_words (words in 3-word
    runs that occur twice or more). base_failed: fewer than ``least_words`` words or more than ``repeat_percent`` of them
    repeated. kept: the base holds and the zstandard ratios of the whole text and of its fixed chunks lie in the bands.

    Returns the columns ``keep`` of each input row, then SIGNALS, base_failed, ratio, min_chunk_ratio, max_chunk_ratio
    and kept. Null and empty texts have zeros, null ratios and are not kept; repeated rows are judged each on its own;
    input columns called like a signal are not read unless in ``keep``; an empty table gives no rows. One pass, no shuffle.
    """
    # A text that is kept anyhow goes to the workers once.
    also = [F.col("text").cast("string").alias("text")] if "text" not in keep else []
    alone = bool(also)
    inner = docs.select(F.struct(*keep).alias("kept_columns"), *also)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        pack = lambda x: len(compressor.compress(x))
        kinds = [*[pa.int64()] * 5, pa.bool_(), *[pa.float64()] * 3, pa.bool_()]
        names = [*SIGNALS, "base_failed", "ratio", "min_chunk_ratio", "max_chunk_ratio", "kept"]
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text") if alone else pc.struct_field(batch.column("kept_columns"), "text")
                rows = [judge(x, bands, pack) for x in texts.to_pylist()]
                verdict = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                yield pa.RecordBatch.from_arrays([batch.column("kept_columns"), verdict], ["kept_columns", "verdict"])

    out = inner.mapInArrow(lean(compute), f"kept_columns {inner.schema['kept_columns'].dataType.simpleString()}, verdict struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    return out.select("kept_columns.*", "verdict.*")
