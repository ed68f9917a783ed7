"""Lane packing of events along the years, each layout a group of its own."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bins from the centre of the view outwards, first the sides of the middle.
BIN_ORDER = {b: i for i, b in enumerate((7, 8, 6, 9, 5, 4, 3, 2, 1, 0, 10, 11, 12, 13, 14))}


class _Lane:
    """The intervals of a lane, which don't overlap, so that starts and ends are in one order; odd ones (without a bound,
    or with their end before their start) stand apart."""

    def __init__(self) -> None:
        self.starts: list[float] = []
        self.ends: list[float] = []
        self.odd: list[tuple[float, float]] = []

    def free(self, a: float, b: float) -> bool:
        if self.odd and not all(b <= x or a >= y for x, y in self.odd):
            return False
        if a != a or b != b:
            return all(b <= x or a >= y for x, y in zip(self.starts, self.ends, strict=True))
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def take(self, a: float, b: float) -> None:
        if a <= b:
            insort(self.starts, a)
            insort(self.ends, b)
        else:
            self.odd.append((a, b))


def pack_lanes(events: DataFrame, lanes: int) -> DataFrame:
    """Add lane to events (layout_id, id, bin_num, weight, x_start, x_end, cached_lane): the first lane free over the
    event's width, a free cached lane before others, null where none is free. Layouts are packed side by side; within
    one the choice is greedy in order of bin, weight (heaviest first), start and end.

    Spark sorts the events of each partition by layout and that order; a worker goes through them and holds the lanes of
    one layout at a time, so that small layouts cost no call of their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = object(), []
        for batch in batches:
            out = []
            layouts, starts, ends = batch.column(0).to_pylist(), *(batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for i in (2, 3))
            for layout, a, b, cached in zip(layouts, starts, ends, batch.column(4).to_pylist(), strict=True):
                if layout != now:
                    now, taken = layout, [_Lane() for _ in range(lanes)]
                first = [int(cached)] if cached is not None and 0 <= cached < lanes else []
                lane = next((k for k in [*first, *range(lanes)] if taken[k].free(a, b)), None)
                if lane is not None:
                    taken[lane].take(a, b)
                out.append(lane)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["layout_id", "id", "lane"])

    places = F.create_map(*[F.lit(float(x)) for pair in BIN_ORDER.items() for x in pair])
    place = F.coalesce(F.element_at(places, F.col("bin_num").cast("double")), F.lit(float(len(BIN_ORDER))))
    weight = F.nanvl("weight", F.lit(0.0)) if dict(events.dtypes)["weight"] in ("double", "float") else F.col("weight")
    order = ["layout_id", place, F.desc(F.coalesce(weight, F.lit(0))), F.asc_nulls_last("x_start"), F.asc_nulls_last("x_end"), "id"]
    rows = events.repartition("layout_id").sortWithinPartitions(*order)
    rows = rows.select(F.col("layout_id").cast("long"), F.col("id").cast("long"), "x_start", "x_end", "cached_lane")
    return rows.mapInArrow(pack, "layout_id long, id long, lane int")
