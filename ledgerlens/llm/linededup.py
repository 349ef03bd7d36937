"""Line-level deduplication across documents."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import explode_text
from ledgerlens.session import materialize

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """White space stripped at both ends, A-Z lower-cased; other letters keep their case."""
    return line.strip(BLANK).encode().lower().decode()


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, row_hash, pos, k1, k2`` of each line whose key has at least ``min_chars`` code points.

    ``k1, k2`` are the halves of the key's 128-bit hash; ``pos`` counts from 0.
    """

    def of(texts: list[str | None]) -> tuple:
        at, pos, keys = [], [], []
        for i, text in enumerate(texts):
            for j, line in enumerate((text or "").split("\n")):
                if len(line) >= min_chars and len(line.strip(BLANK)) >= min_chars:
                    at.append(i)
                    pos.append(j)
                    keys.append(xxhash.xxh3_128_intdigest(line.strip(BLANK).encode().lower()))
        return at, [pos, [(k >> 64) - (1 << 63) for k in keys], [(k & (1 << 64) - 1) - (1 << 63) for k in keys]]

    return explode_text(rows.select("doc_id", "row_hash", "text"), "text", of, [("pos", "int"), ("k1", "long"), ("k2", "long")])


def drop_shared_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text", whole_row: bool = False
) -> DataFrame:
    """Drop every line that at least ``min_docs`` documents share, except in the document with the largest id.

    Returns ``doc_id, n_lines, n_dropped, kept_text`` for each row, with ``whole_row`` also the input row as a struct ``row``;
    otherwise the other columns of ``docs`` are not read. A null or empty text is one empty line. Rows with one doc_id are one document (null is a document of its
    own, smaller than all others); each of its rows keeps its own lines. If all lines go, ``kept_text`` is empty.

    Lines are exploded with a 128-bit key. A key's documents are counted in two aggregations, by (key, document) and then
    by key, so a line that stands in every document is combined before each shuffle. The lines that go return to their row
    as positions; texts move once, and only rows' own position lists are gathered.
    """
    whole = [F.struct(*[c for c in docs.columns if c != text]).alias("row")] if whole_row else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("row_hash"), *whole)
    lines = materialize(long_lines(rows, min_chars), "lines")
    held = lines.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
    shared = held.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # from a file, so that the join deals out both sides itself and can split a line that stands in most documents
    shared = materialize(shared.select("k1", "k2", "keeper"), "shared-lines").hint("merge")
    gone = lines.join(shared, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # repeated rows have equal positions: a set
    lists = gone.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("h")).agg(F.collect_set("pos").alias("gone"))
    met = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h")), "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
    # the outer transform binds the lines once; each kept position then is one array access
    rest = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(left, lambda i: lines[i]), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(rest)
    return met.select(
        "doc_id", F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"), *(["row"] if whole_row else []),
    )
