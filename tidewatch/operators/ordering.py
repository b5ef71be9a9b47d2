"""Global order without a single-task sort.

``number_rows`` gives dense positions, ``in_chunks`` cuts an ordered table into bounded pieces
with a look-back margin, ``keep_lowest`` selects exactly the n smallest keys without moving the
rows, and ``lookup`` joins a dictionary to rows whatever the size of the dictionary or the skew
of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import freeze

_SLOT_BITS = 33  # monotonically_increasing_id(): partition index above, row index below
_SLOT_MASK = (1 << _SLOT_BITS) - 1

# Bounds under which a dictionary may be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key group that the driver looks at to find a cut.
CUT_ROWS = 1000


def _dense(stored: DataFrame, name: str, slot: str = "_slot") -> DataFrame:
    """Replace the per-partition slot of a stored table by a 0-based dense position."""
    part = F.shiftrightunsigned(F.col(slot), _SLOT_BITS)
    index = F.col(slot).bitwiseAND(F.lit(_SLOT_MASK))
    # one row per partition of the stored table, so the window and the broadcast stay small
    bases = (
        stored.groupBy(part.alias("_part"))
        .agg((F.max(index) + 1).alias("_rows"))
        .withColumn(
            "_base",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("_part", "_base")
    )
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")
        .withColumn(name, F.col("_base") + index)
        .drop("_part", "_base", slot)
    )


def number_rows(
    df: DataFrame, order: list[str], name: str = "position", keep: list[str] | None = None
) -> DataFrame:
    """Dense 0-based position of every row in the order of ``order``.

    A range shuffle spreads equal leading keys over many tasks as long as the order columns
    together are unique. The sorted rows are stored once, so positions never change between
    actions or after a lost executor. ``keep`` names the columns to store, if not all.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select(*(keep or ["*"]), F.monotonically_increasing_id().alias("_slot"))
    return _dense(freeze(ordered, "ordered"), name)


def number_in_place(df: DataFrame, name: str) -> DataFrame:
    """Dense position in the partition order ``df`` already has; no shuffle."""
    return _dense(freeze(df.withColumn("_slot", F.monotonically_increasing_id()), "rows"), name)


def in_chunks(df: DataFrame, position: str, rows: int, margin: int) -> DataFrame:
    """Copy each row to its chunk and, for the last ``margin`` rows, to the next one as look-back.

    Adds ``_chunk`` and ``_margin`` (true for look-back copies). Windows over ``_chunk`` then
    hold at most ``rows + margin`` rows.
    """
    if margin > rows:
        raise ValueError("a chunk must be at least as long as its margin")
    own = F.floor(F.col(position) / rows).cast("bigint")
    tail = F.col(position) % rows >= rows - margin
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", own.alias("_own"), F.explode(copies).alias("_chunk")).select(
        "*", (F.col("_chunk") != F.col("_own")).alias("_margin")
    ).drop("_own")


def seeded_key(seed: int, row_id: str = "line_no") -> Column:
    """Reproducible shuffle key of a row; independent of how the table is partitioned."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def keep_lowest(
    df: DataFrame, key: Column, quota, row_id: str = "line_no", name: str = "kept"
) -> DataFrame:
    """Mark exactly the ``quota(total)`` rows with the smallest hex keys.

    A histogram over four hex digits (65,536 counts at most) finds the group the cut falls into;
    inside a group that is still large the next four digits are counted. A small group gives the
    cut itself, so every row is then decided where it stands, by one comparison. ``row_id`` must be
    unique, as the keys are made of it.
    """
    keyed = df.withColumn("_key", key)
    cut, prefix, want = "", "", None
    running = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        inside = keyed.filter(F.col("_key").startswith(prefix)) if prefix else keyed
        counts = inside.groupBy(F.substring("_key", len(prefix) + 1, 4).alias("_group")).agg(
            F.count("*").alias("_n")
        )
        wanted = quota(F.sum("_n").over(Window.partitionBy())) if want is None else F.lit(want)
        at = (
            counts.select(
                "_group", "_n", (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
                wanted.cast("bigint").alias("_quota"),
            )
            .filter(F.col("_before") < F.col("_quota"))
            .orderBy(F.desc("_group"))
            .first()
        )
        if at is None:
            break  # nothing is wanted, or there is no row
        prefix, want = prefix + at["_group"], min(at["_quota"] - at["_before"], at["_n"])
        if at["_n"] <= CUT_ROWS or len(prefix) >= 32:
            rows = keyed.filter(F.col("_key").startswith(prefix)).select("_key").orderBy("_key")
            cut = rows.limit(want).collect()[-1]["_key"]
            break
    return keyed.withColumn(name, F.col("_key") <= cut).drop("_key")


def fits_broadcast(df: DataFrame, text_columns: list[str]) -> bool:
    """True when ``df`` is proven small: counted rows and text bytes are under the bounds."""
    size = F.lit(0)
    for c in text_columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    found = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("b")
    ).first()
    return found["n"] <= BROADCAST_ROWS and found["b"] <= BROADCAST_BYTES


def lookup(rows: DataFrame, dictionary: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join a dictionary with unique keys to rows.

    A dictionary of checked small size is broadcast. For a larger one each key meets its rows by a
    shuffle; a key that fills a large share of the rows is split by the adaptive skew-join rule,
    and the dictionary is sent once.
    """
    on = [on] if isinstance(on, str) else list(on)
    small = fits_broadcast(dictionary, dictionary.columns)
    return rows.join(F.broadcast(dictionary) if small else dictionary, on, how)
