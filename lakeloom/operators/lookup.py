"""Looking values up in a large table where a few of them may be most of the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.errors import TokenizerError

#: Values that are looked up by broadcast, and values that the sketch keeps count of.
HEAVY, TRACKED = 256, 8192
#: Bytes of what is looked up together.
SHARD = 16 << 20


def heavy_values(rows: DataFrame, key: str) -> list:
    """The at most HEAVY values that most rows have, by a mergeable sketch of TRACKED counters: each task counts, and the tasks' sketches are merged."""
    top = rows.where(F.col(key).isNotNull()).agg(F.call_function("approx_top_k", F.col(key), F.lit(HEAVY), F.lit(TRACKED)).alias("t")).first()["t"]
    return [x["item"] for x in top]


def look_up(rows: DataFrame, side: DataFrame, key: str, heavy: list | None = None) -> DataFrame:
    """rows left-joined with side (one row for each key). Rows of heavy values meet the side's rows for them by broadcast and are not shuffled; the others are
    joined by a shuffle, where no value has more than about one in HEAVY of the rows."""
    heavy = heavy_values(rows, key) if heavy is None else heavy
    if not heavy:
        return rows.join(side, key, "left")
    is_heavy = F.coalesce(F.col(key).isin(*heavy), F.lit(False))
    few = F.broadcast(side.where(F.col(key).isin(*heavy)))
    return rows.where(is_heavy).join(few, key, "left").unionByName(rows.where(~is_heavy).join(side, key, "left"))


def look_up_arrays(rows: DataFrame, cells: Callable[[Column], Column], size: Column, side: DataFrame, name: str, missing: str | None = None) -> DataFrame:
    """rows with `name` in place of their last column: for each element of the array cells(last column) the second column of side (one row for each value
    of the first), or null; with `missing`, an element that side lacks is an error of that text.

    Rows are dealt to shards of about SHARD bytes (`size` of each row), and each different element of a shard is looked up once: what is shuffled are the rows
    themselves and those elements, not a row for each element of an array."""
    spark = rows.sparkSession
    given, value = side.columns
    n = max(spark.sparkContext.defaultParallelism, -(-int(rows.agg(F.sum(size)).first()[0] or 0) // SHARD))
    source = rows.columns[-1]
    keys = rows.columns[:-1]
    shard = F.pmod(F.xxhash64(*rows.columns), F.lit(n)).alias("_shard")
    dealt = rows.select(shard, *rows.columns).repartition(n, "_shard").sortWithinPartitions("_shard").select("_shard", *keys, F.coalesce(cells(F.col(source)), F.array()).alias("_cells"))
    kind, looked = side.schema[given].dataType.simpleString(), side.schema[value].dataType.simpleString()

    def different(table: pa.Table) -> pa.Table:
        found = pc.unique(pc.list_flatten(table.column("_cells"))).drop_null()
        return pa.table({"_shard": pa.repeat(table.column("_shard")[0], len(found)), "_cell": found})

    def put(table: pa.Table, answers: pa.Table) -> pa.Table:
        lists = table.column("_cells")
        flat = pc.list_flatten(lists).combine_chunks()
        at = pc.index_in(flat, value_set=answers.column("_cell").combine_chunks())
        if missing is not None and at.null_count:
            raise TokenizerError(f"{missing} {flat[pc.index(pc.is_null(at), True).as_py()].as_py()}")
        ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy())).astype(np.int32)
        got = pa.ListArray.from_arrays(pa.array(ends), answers.column("_found").combine_chunks().take(at))
        return pa.table({**{k: table.column(k) for k in keys}, name: got})

    asked = dealt.groupBy("_shard").applyInArrow(different, f"_shard long, _cell {kind}")
    answers = asked.join(side.select(F.col(given).alias("_cell"), F.col(value).alias("_found")), "_cell").select("_shard", "_cell", "_found")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"{name} array<{looked}>"])
    return dealt.groupBy("_shard").cogroup(answers.groupBy("_shard")).applyInArrow(put, schema)
