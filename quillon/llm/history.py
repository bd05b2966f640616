"""Versioned dimension history: two layers kept up to date by each arrival.

A key's changes are updates and deletes, which hold from their start until the next one's, and corrections, which hold on a
range of days and lie above. The base layer is a list of the updates' and deletes' starts, the upper layer one of the days that
corrections cover; a third list holds the visible versions. All three are sorted and linked to their neighbours. An arrival
finds its place by bisection, changes the boundaries of its own layer, and has the visible list replaced on just the days that
this affects: from the start to the base's next start where no correction lies, or the correction's days. Equal neighbours
merge at once.

What arrives is reduced before it is shuffled: of the updates and deletes with one start, and of the corrections of one range,
the last arrival hides the others for good. A key's days are then cut into spans of `span` days, each worked on alone: it
starts from the base state that the spans before leave, which needs a row a span. Versions that go on over a seam are joined
again by the spans' first and last versions. So neither a key with many changes nor one with a long history is one task's.

Defined results: changes without a key, a start or a known kind take no part, nor do corrections without an end after their
start, as they cover no day; a null value is a value like others. Of changes that arrive by equal values, the larger (kind,
value) counts as later, null first. Keys that are never present have no rows; an empty table gives an empty table. Other columns
aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import plain, release, small_batches, stash

#: Days of a span, and the end of what never ends.
SPAN, ENDLESS = 1024, (1 << 63) - 1
DELETE, CORRECTION, UPDATE = "delete", "correction", "update"


class Version:
    """Holds from since until the next one's since; state is a tuple of the value, or None for absence."""

    __slots__ = ("after", "before", "since", "state")

    def __init__(self, since: int, state: tuple | None, before: Version | None, after: Version | None):
        self.since, self.state, self.before, self.after = since, state, before, after


class VersionList:
    """Versions of the days from lo to hi, linked to their neighbours. merging: equal neighbours become one."""

    def __init__(self, lo: int, hi: int, state: tuple | None, merging: bool = True):
        self.hi, self.merging = hi, merging
        self.starts, self.by_start = [lo], {lo: Version(lo, state, None, None)}

    def at(self, day: int) -> Version:
        return self.by_start[self.starts[bisect_right(self.starts, day) - 1]]

    def end(self, v: Version) -> int:
        return v.after.since if v.after else self.hi

    def cut(self, day: int) -> Version:
        """The version that begins on day; made if there is none."""
        v = self.at(day)
        if v.since < day:
            v.after = new = Version(day, v.state, v, v.after)
            if new.after:
                new.after.before = new
            self.starts.insert(bisect_left(self.starts, day), day)
            self.by_start[day] = v = new
        return v

    def drop(self, v: Version) -> None:
        """The version before it, which there is, goes on."""
        v.before.after = v.after
        if v.after:
            v.after.before = v.before
        del self.starts[bisect_left(self.starts, v.since)], self.by_start[v.since]

    def put(self, lo: int, hi: int, state: tuple | None) -> Version:
        """The days from lo to hi get state."""
        if hi < self.hi:
            self.cut(hi)
        v = self.cut(lo)
        while v.after and v.after.since < hi:
            self.drop(v.after)
        v.state = state
        if self.merging:
            if v.after and v.after.state == state:
                self.drop(v.after)
            if v.before and v.before.state == state:
                self.drop(v)
                v = v.before
        return v

    def __iter__(self) -> Iterator[tuple[int, int, tuple | None]]:
        v = self.by_start[self.starts[0]]
        while v:
            yield v.since, self.end(v), v.state
            v = v.after


class History:
    """One key's days from lo to hi; state is what holds before the first change."""

    def __init__(self, lo: int, hi: int, state: tuple | None):
        self.lo, self.hi = lo, hi
        self.base, self.corrections, self.visible = VersionList(lo, hi, state, merging=False), VersionList(lo, hi, None), VersionList(lo, hi, state)

    def arrive(self, kind: str, since: int, until: int | None, value: str | None) -> None:
        if kind == CORRECTION:
            lo, hi = max(since, self.lo), min(until, self.hi)
            self.corrections.put(lo, hi, (value,))
            self.visible.put(lo, hi, (value,))
            return
        state = (value,) if kind == UPDATE else None
        v = self.base.cut(since)  # holds as far as the base's next start
        v.state = state
        hi, above = self.base.end(v), self.corrections.at(since)
        while above and above.since < hi:
            if above.state is None:
                self.visible.put(max(above.since, since), min(self.corrections.end(above), hi), state)
            above = above.after

    def versions(self) -> Iterator[tuple[int, int, str | None]]:
        return ((lo, hi, state[0]) for lo, hi, state in self.visible if state is not None)


def _spans(batches: Iterator[pa.RecordBatch], value: pa.DataType, key: pa.DataType, span: int) -> Iterator[pa.RecordBatch]:
    """key, span, next_span, carry (kind, value), changes in order of arrival: key, span, versions (lo, hi, value)."""
    version = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("value", value)]))
    for batch in batches:
        keys, at, after, carries, changes = (batch.column(i) for i in range(5))
        out = []
        for first, following, carry, rows in zip(at.to_pylist(), after.to_pylist(), carries.to_pylist(), changes.to_pylist(), strict=True):
            h = History(first * span, ENDLESS if following is None else following * span, (carry["v"],) if carry and carry["kind"] == UPDATE else None)
            for r in rows:
                h.arrive(r["kind"], r["s"], r["e"], r["v"])
            out.append([{"lo": lo, "hi": hi, "value": v} for lo, hi, v in h.versions()])
        yield pa.RecordBatch.from_arrays([keys.cast(key), at, pa.array(out, version)], names=["k", "span", "versions"])
    release()


def history(changes: DataFrame, key: str = "key", kind: str = "kind", since: str = "since", until: str = "until", value: str = "value", arrival: Sequence[str] = ("arrival",), span: int = SPAN) -> DataFrame:
    """key, version (int, from 1 by valid_from), valid_from, valid_to (exclusive; null where endless), value. kind: update, delete or correction; later arrivals have larger `arrival` columns."""
    changes = plain(changes)
    small_batches(changes.sparkSession)
    c = lambda n: changes[f"`{n}`"]
    rows = changes.select(c(key).alias("k"), c(kind).alias("kind"), c(since).cast("long").alias("s"), F.when(c(kind) == CORRECTION, c(until).cast("long")).alias("e"), c(value).alias("v"), F.struct(*[c(a).alias(f"a{i}") for i, a in enumerate(arrival)]).alias("a"))
    rows = rows.where("k is not null and s is not null").where(F.col("kind").isin(UPDATE, DELETE) | ((F.col("kind") == CORRECTION) & (F.col("e") > F.col("s"))))
    last = rows.groupBy("k", "s", "e").agg(F.max(F.struct("a", "kind", "v")).alias("last"))
    slots = last.select("k", "s", "e", F.col("last.a").alias("a"), F.col("last.kind").alias("kind"), F.col("last.v").alias("v"))
    number = lambda day: F.floor(day / span).cast("long")
    placed = slots.withColumn("span", F.explode(F.sequence(number(F.col("s")), F.when(F.col("e").isNull(), number(F.col("s"))).otherwise(number(F.col("e") - 1)))))
    base = F.max(F.when(F.col("e").isNull(), F.struct("s", "kind", "v")))
    held = stash(placed.groupBy("k", "span").agg(base.alias("base"), F.array_sort(F.collect_list(F.struct("a", "s", "e", "kind", "v"))).alias("changes")), "history-spans")
    order = Window.partitionBy("k").orderBy("span")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    around = held.select("k", "span", F.lead("span").over(order).alias("next_span"), F.last("base", ignorenulls=True).over(before).alias("carry"))
    whole = held.join(around, ["k", "span"]).select("k", "span", "next_span", "carry", F.transform("changes", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))).alias("changes"))
    kinds = {f.name: f.dataType for f in whole.schema.fields}
    v_type = kinds["carry"]["v"].dataType
    out = T.StructType([T.StructField("k", kinds["k"]), T.StructField("span", T.LongType()), T.StructField("versions", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("value", v_type)])))])
    from pyspark.sql.pandas.types import to_arrow_type

    k_arrow, v_arrow = to_arrow_type(kinds["k"]), to_arrow_type(v_type)
    worked = stash(whole.mapInArrow(lambda batches: _spans(batches, v_arrow, k_arrow, span), out), "history-versions").where(F.size("versions") > 0)
    return _joined(worked, span)


def _joined(worked: DataFrame, span: int) -> DataFrame:
    """Versions that end where the next span's first begins, with an equal value, are one; versions are numbered. Windows see a row a span."""
    order = Window.partitionBy("k").orderBy("span")
    head, tail = F.get("versions", F.lit(0)), F.element_at("versions", -1)
    seams = worked.select("k", "span", F.size("versions").alias("n"), head.alias("head"), tail.alias("tail"))
    before = F.lag("tail").over(order)
    seams = seams.withColumn("goes_on", F.coalesce((before["hi"] == F.col("head.lo")) & before["value"].eqNullSafe(F.col("head.value")), F.lit(False)))
    next_on = F.coalesce(F.lead("goes_on").over(order), F.lit(False))
    through = F.col("goes_on") & (F.col("n") == 1) & next_on  # its only version came from before and goes on
    seams = seams.withColumn("ends", F.when(F.col("goes_on") & ~through, F.col("head.hi"))).withColumn("next_on", next_on)
    following, preceding = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("next_on"), F.first("ends", ignorenulls=True).over(following)).otherwise(F.col("tail.hi"))
    begun = F.coalesce(F.sum(F.col("n") - F.col("goes_on").cast("int")).over(preceding), F.lit(0))
    seams = seams.select("k", "span", "goes_on", end.alias("end"), begun.alias("begun"))
    rows = worked.join(seams, ["k", "span"]).select("k", "begun", "goes_on", "end", F.size("versions").alias("n"), F.posexplode("versions").alias("at", "version"))
    rows = rows.where(~(F.col("goes_on") & (F.col("at") == 0)))
    to = F.nullif(F.when(F.col("at") == F.col("n") - 1, F.col("end")).otherwise(F.col("version.hi")), F.lit(ENDLESS))
    number = F.col("begun") + F.col("at") + 1 - F.col("goes_on").cast("int")
    return rows.select(F.col("k").alias("key"), number.cast("int").alias("version"), F.col("version.lo").alias("valid_from"), to.alias("valid_to"), F.col("version.value").alias("value"))
