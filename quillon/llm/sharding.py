"""Sharding by balanced label propagation.

Documents are linked through groups. Each document starts in a shard that its id's hash gives, with the other documents
of its group in the same one of CELLS cells; such a unit moves as one. In each round a group calls its units to the
shards that hold most of it, as few as the quota allows; shards take no more than their quota, so of what wants to move
from one shard to another a share is let through, group by group. Groups above a CELLS_PER_SHARD-th of a quota, of which there
are no more than cells, are packed before all others, as whole as the quota allows. Where documents have links of other
kinds, weighted edges, groups then go to the shards that most of their edges lead to, under the same quotas. When nothing moves any more, or after ROUNDS rounds of each kind, rows without a link, and
rows beyond a shard's quota, fill the shards up until the counts are at most one apart.

Defined results: a null text has no bytes and counts as equal to the empty text; repeated rows are documents of one group;
an empty table has no shards. The driver sees counts by shard, by pairs of shards, and of large groups; broadcast are the
places of large groups, a few for each cell. Offsets, one for about ROWS_A_BUCKET rows, are joined.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain, stash, unstash

SHARDS = 24
CELLS_PER_SHARD = 8
ROUNDS = 8
ROWS_A_BUCKET = 1 << 16
LEAST_BUCKETS = 256


def let_through(demand: dict[tuple[int, int], int], load: list[int], quota: int) -> dict[tuple[int, int], float]:
    """The share of each demand (from, to) with which no shard exceeds its quota, by repeated scaling of what comes in."""
    part = {k: 1.0 for k in demand}
    coming, going = ([[(k, d) for k, d in demand.items() if k[end] == j] for j in range(len(load))] for end in (1, 0))
    for _ in range(50):
        tight = False
        for j in range(len(load)):
            into = sum(part[k] * d for k, d in coming[j])
            out = sum(part[k] * d for k, d in going[j])
            room = max(0.0, quota - load[j] + out)
            if into > room + 0.5:
                tight = True
                for k, _ in coming[j]:
                    part[k] *= room / into
        if not tight:
            break
    else:  # what is let in at the last pass may still exceed a quota by what others then keep; scale all down to what fits without outflow
        for a, j in demand:
            into = sum(part[k] * n for k, n in coming[j])
            part[a, j] *= min(1.0, max(0.0, quota - load[j]) / into) if into else 0.0
    return part


def share(part: dict[tuple[int, int], float], shards: int, a: Column, b: Column) -> Column:
    """part[a, b], 0 where it isn't there; one literal in the plan, however many pairs there are."""
    values = ["0.0"] * (shards * shards)
    for (i, j), p in part.items():
        values[i * shards + j] = repr(float(p))
    return F.coalesce(F.get(F.split(F.lit(",".join(values)), ",").cast("array<double>"), a * shards + b), F.lit(0.0))


def flows(moves: DataFrame) -> dict[tuple[int, int | None], int]:
    """moves: shard, to, w. The rows w by shard and to, which may be null, in one job."""
    return {(d["shard"], d["to"]): d["w"] for d in moves.groupBy("shard", "to").agg(F.sum("w").alias("w")).collect()}


def pack(large: list[tuple[bytes, int]], shards: int, quota: int) -> tuple[list[tuple[bytes, float, float, int]], list[int]]:
    """(group, from, to, shard): which part of each large group goes where, the largest first into the emptiest shards; and the room that is left."""
    room, out = [quota] * shards, []
    for g, total in sorted(large, key=lambda x: (-x[1], x[0])):
        done = 0
        while done < total:
            s = max(range(shards), key=lambda k: (room[k], -k))
            take = min(total - done, max(1, room[s]))
            out.append((g, done / total, (done + take) / total, s))
            room[s] -= take
            done += take
    return out, [max(0, x) for x in room]


def cell_shards(room: list[int], cells: int) -> list[int]:
    """A shard for each cell, in proportion to the room."""
    total = sum(room)
    if not total:
        return [c % len(room) for c in range(cells)]
    ends = list(accumulate(room))
    return [bisect_right(ends, (c + 0.5) * total / cells) for c in range(cells)]


def propagate(units: DataFrame, fixed: list[int], shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """units: g, cell, w (rows), total (rows of g), shard; stashed. fixed: rows by shard that stay. Returns units with their last shards."""
    for r in range(rounds):
        held = units.groupBy("g", "shard").agg(F.sum("w").alias("w"), F.max("total").alias("total"))
        wanted = F.least(F.lit(shards), F.ceil(F.col("total") / quota))
        place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("w"), F.xxhash64("g", "shard"), "shard"))
        homes = held.withColumn("place", place).where(F.col("place") <= wanted).groupBy("g").agg(F.array_sort(F.collect_list("shard")).alias("homes"))
        pick = F.get(F.col("homes"), F.pmod(F.xxhash64("cell", F.lit(r)), F.size("homes")).cast("int"))
        called = units.join(homes, "g").withColumn("to", F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(pick)).drop("homes")
        called = stash(called, "called")
        flow, load = flows(called), list(fixed)
        for (a, _), w in flow.items():
            load[a] += w
        demand = {k: w for k, w in flow.items() if k[0] != k[1]}
        if not demand:
            unstash(called)
            break
        part = let_through(demand, load, quota)
        goes = F.pmod(F.xxhash64("g", F.lit(r)), F.lit(1 << 30)) / float(1 << 30) < share(part, shards, F.col("shard"), F.col("to"))
        new = stash(called.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to"), "units")
        unstash(units, called)
        units = new
    return units


def attract(units: DataFrame, edges: DataFrame, fixed: DataFrame, load: list[int], shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """units: g, cell, w, total, shard; stashed. edges: a, b (groups), w. fixed: g, shard, w of units that stay. load: their rows by shard.

    Groups move whole, so what changes is a row for each group; its units follow at the end. In each round every group counts the weight of its edges into each shard, and wants to go where most of them lead if that
    is more than where it is. Quotas let a share of each demand through. Odd and even groups take turns, so
    that two neighbours don't swap places for ever."""
    both = stash(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    still = stash(fixed.groupBy(F.col("g").alias("b")).agg(F.max(F.struct("w", "shard"))["shard"].alias("shard")), "still")
    of_units = [F.max(F.struct("w", "shard"))["shard"].alias("home"), F.sum("w").alias("size"), F.collect_list(F.struct("shard", "w")).alias("parts")]  # a part for each cell at most
    groups = stash(units.groupBy("g").agg(*of_units).withColumn("moved", F.lit(False)), "groups")
    for r in range(rounds):
        where = groups.select(F.col("g").alias("b"), F.col("home").alias("shard")).unionByName(still)
        votes = both.join(where, "b").groupBy("a", "shard").agg(F.sum("w").alias("w")).withColumnRenamed("a", "g").join(groups.select("g", "home", "size"), "g")
        best = votes.groupBy("g", "home", "size").agg(F.max(F.struct("w", F.xxhash64("g", "shard").alias("h"), "shard")).alias("best"), F.sum(F.when(F.col("shard") == F.col("home"), F.col("w"))).alias("stay"))
        turn = F.pmod(F.xxhash64("g"), F.lit(2)) == r % 2
        moves = best.where(turn & (F.col("best.w") > F.coalesce("stay", F.lit(0)))).select("g", "home", "size", F.col("best.shard").alias("to"))
        moves = stash(moves.where("to <> home"), "moves")
        here = groups.select(F.inline("parts")).withColumn("to", F.lit(None).cast("int"))
        flow, now = flows(here.unionByName(moves.select(F.col("home").alias("shard"), "to", F.col("size").alias("w")))), list(load)
        for (a, b), w in flow.items():
            now[a] += w if b is None else 0
        demand = {k: w for k, w in flow.items() if k[1] is not None}
        if not demand:
            unstash(moves)
            if r % 2:
                break
            continue
        part = let_through(demand, now, quota)
        goes = F.pmod(F.xxhash64("g", F.lit(r + 101)), F.lit(1 << 30)) / float(1 << 30) < share(part, shards, F.col("home"), F.col("to"))
        on = groups.join(moves.where(goes).select("g", "to"), "g", "left")
        parts = F.when(F.col("to").isNull(), F.col("parts")).otherwise(F.array(F.struct(F.col("to").alias("shard"), F.col("size").alias("w"))))
        new = stash(on.select("g", F.coalesce("to", "home").alias("home"), "size", parts.alias("parts"), (F.col("moved") | F.col("to").isNotNull()).alias("moved")), "groups")
        unstash(groups, moves)
        groups = new
    new = stash(units.join(groups.where("moved").select("g", "home"), "g", "left").withColumn("shard", F.coalesce("home", "shard")).drop("home"), "units")
    unstash(both, still, groups, units)
    return new


def shard(rows: DataFrame, shards: int = SHARDS, edges: DataFrame | None = None) -> DataFrame:
    """rows: id, g (group, binary) and any columns. Adds shard and slot (gapless from 0 in each shard); counts are at most one apart.

    edges: a, b, ids of linked documents, and w, the weight. Ids that rows lack, and links within a group, count for nothing."""
    cells = shards * CELLS_PER_SHARD
    base = stash(rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")), "base")
    n = base.count()
    quota = max(1, math.ceil(n / shards))
    units = base.groupBy("g", "cell").agg(F.count("*").alias("w")).withColumn("total", F.sum("w").over(Window.partitionBy("g")))
    if edges is None:
        units = stash(units.where("total > 1"), "linked")
    else:
        end = lambda name: base.select(F.col("id").alias(name), F.col("g").alias(f"g_{name}")).distinct()
        known = edges.join(end("a"), "a").join(end("b"), "b").where(F.col("g_a") != F.col("g_b"))
        edges = stash(known.groupBy(F.least("g_a", "g_b").alias("a"), F.greatest("g_a", "g_b").alias("b")).agg(F.sum("w").alias("w")), "edges")
        ends = edges.select(F.col("a").alias("g")).unionByName(edges.select(F.col("b").alias("g"))).distinct().withColumn("linked", F.lit(True))
        units = stash(units.join(ends, "g", "left").where("total > 1 or linked").drop("linked"), "linked")
    is_large = F.col("total") * CELLS_PER_SHARD > quota  # so there are at most `cells` of them
    large = [(bytes(x.g), x.total) for x in units.where(is_large).groupBy("g").agg(F.max("total").alias("total")).collect()]
    parts, room = pack(large, shards, quota)
    known = F.from_json(F.lit(json.dumps([{"g": g.hex(), "lo": lo, "hi": hi, "shard": s} for g, lo, hi, s in parts])), "array<struct<g string, lo double, hi double, shard int>>")
    ranges = base.sparkSession.range(0, 1, 1, 1).select(F.inline(known)).withColumn("g", F.unhex("g"))
    middle = (F.col("cell") + 0.5) / cells
    placed_large = stash(units.where(is_large).join(F.broadcast(ranges), "g").where((middle >= F.col("lo")) & (middle < F.col("hi"))).select("g", "cell", "w", "shard"), "large")
    fixed = [0] * shards
    for row in placed_large.groupBy("shard").agg(F.sum("w").alias("w")).collect():
        fixed[row.shard] = row.w
    start = F.get(F.array(*[F.lit(s) for s in cell_shards(room, cells)]), F.col("cell"))
    units = propagate(stash(units.where(~is_large).withColumn("shard", start), "units"), fixed, shards, quota)
    if edges is not None:
        units = attract(units, edges, placed_large.select("g", "shard", "w"), fixed, shards, quota)
    units = units.select("g", "cell", "w", "shard").unionByName(placed_large)
    buckets = min(1 << 20, max(LEAST_BUCKETS, n // ROWS_A_BUCKET))
    placed = base.join(units.select("g", "cell", "shard"), ["g", "cell"], "left").withColumn("kind", F.coalesce("shard", F.lit(-1))).drop("shard", "cell")
    placed = stash(placed.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(buckets)).cast("int")), "placed")
    counts = placed.groupBy("kind", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stash(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    total = [0] * shards
    for row in offsets.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        if row.kind >= 0:
            total[row.kind] = row.n
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    kept = [min(a, b) for a, b in zip(total, goal, strict=True)]
    over, ends, lead, at = [a - b for a, b in zip(total, kept, strict=True)], [], [], 0
    for s in range(shards):
        lead.append(at)
        at += over[s]
    first_free = at  # the unlinked rows follow those beyond a quota
    at = 0
    for s in range(shards):
        at += goal[s] - kept[s]
        ends.append(at)
    at_kind = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("id", "g")) - 1 + F.col("before")
    out = placed.join(offsets.drop("n"), ["kind", "bucket"]).withColumn("rank", rank)
    stays = (F.col("kind") >= 0) & (F.col("rank") < at_kind(kept))
    out = out.withColumn("p", F.when(F.col("kind") >= 0, at_kind(lead) + F.col("rank") - at_kind(kept)).otherwise(F.col("rank") + first_free))
    free = sum((F.col("p") >= e).cast("int") for e in ends)
    get = lambda values, k: F.get(F.array(*[F.lit(v).cast("long") for v in values]), k)
    out = out.withColumn("shard", F.when(stays, F.col("kind")).otherwise(free))
    out = out.withColumn("slot", F.when(stays, F.col("rank")).otherwise(get(kept, F.col("shard")) + F.col("p") - get([0, *ends], F.col("shard"))))
    return out.drop("kind", "bucket", "before", "rank", "p", "g")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard, and row: a struct of the columns keep. Equal texts are linked, and the documents a and b of edges by their weight w."""
    docs = plain(docs)
    raw = docs[f"`{text}`"].cast("string")
    row = [F.struct(*[docs[f"`{n}`"] for n in keep]).alias("row")] if keep else []
    whole = F.coalesce(raw, F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.unhex(F.md5(whole)).alias("g"), *row)
    return shard(rows, shards, edges).select("id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if keep else []))
