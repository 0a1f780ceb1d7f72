"""Texts of a group joined in order, however long the group is.

All rows are numbered in order first (range partitions and prefix sums, no window over a group), so a block of
``BLOCK`` consecutive numbers is a bounded piece of one group. Pieces are joined block by block, then blocks of
blocks, until a group is one text: no buffer ever holds more than ``BLOCK`` pieces, and nothing is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators.numbering import dense_numbers

BLOCK = 1000


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str, path: str,
                 out: str = "text", block: int = BLOCK) -> DataFrame:
    """(keys, out): the non-NULL ``text`` values of each group joined with ``sep`` in the order of ``order``.

    ``path``: a new folder for the sorted rows. A group without any non-NULL text has no row; rows that tie in
    ``order`` come in any sequence.
    """
    keys = list(keys)
    rows = df.select(*keys, *order, F.col(text).cast("string").alias("_piece")).filter("_piece IS NOT NULL")
    # the number stands for the order from here on
    numbered = dense_numbers(rows, [*keys, *order], path, "_n").select(*keys, "_n", "_piece")
    longest = numbered.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    pieces, width = numbered, 1
    while True:
        width *= block
        # the last level takes a group's pieces whatever blocks they lie in: at most ``block`` and one for a block that is cut by the group's start
        last = width >= longest
        by = [] if last else [F.expr(f"_n div {width}").alias("_block")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_piece"))), lambda x: x["_piece"]), sep)
        pieces = pieces.groupBy(*keys, *by).agg(F.min("_n").alias("_n"), joined.alias("_piece")).select(*keys, "_n", "_piece")
        if last:
            return pieces.select(*keys, F.col("_piece").alias(out))
