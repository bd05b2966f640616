"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all rates r of documents that meet the targets and stay within MOST, those are
taken that are nearest to 1 in relative entropy: r = min(MOST, exp(lambda * size / mean size)), a lambda for each source.
Newton iterations find the lambdas from the dual's gradient and curvature, each a distributed aggregation over the
counts of documents by source and size, several to a job; a bracket around each root keeps them safe. Rates become whole
copies by a threshold from a hash of the id; one shift a source brings the sum of the copies' words to the target, found in
one pass from the words that each of CELLS possible shifts adds; and two ladders of single documents, four a power of two, to
take once more or once less, close what is left.

Defined results: a null text has size 0 and is taken whole, which is no words; a null source is a source of its own, the
last; rows that repeat an id are told apart by their text's hash, and equal rows by a number, so each is rounded for itself
and equal input gives equal output, whatever the partitions. Per-source tables stay distributed: they are broadcast only
where Spark finds their files below its own threshold, else joined with skewed keys split; the driver gets sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordinals import with_ordinal
from .common import plain, stash, unstash

SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
ROUNDS = 60
#: Newton steps in one job.
STEPS = 4
NEAR = 1e-7
#: Shifts from -1 up to 1 that a source may have; a source has as many rows at most when they are summed.
CELLS = 1 << 15
BUCKET_BITS = 18
#: Parts of rows that are equal altogether, at most.
TASKS = 1024
#: What tells rows apart.
EACH = ("key", "id", "hash", "copy")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """sizes: key, size. A row a source: key, source_size, mean, least, target; the excess over most times a source's size is shared anew by weight.

    The level is words a unit of weight: a source whose cap, by weight, isn't above the level stops at its cap, and the rest
    of the words over the rest of the weight is the next level. It rises until no source stops any more; each round is one
    sum over the sources."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    per = stash(per.withColumn("name", F.when(F.col("key") == "null", F.lit("~")).otherwise(F.col("key"))), "sources")  # "~" sorts after "="
    ranked = with_ordinal(per, "name", "rank").drop("name")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    t = stash(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).drop("rank"), "weights")
    unstash(per)
    everything = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        r = t.agg(F.sum(F.when(stops, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(stops).alias("n")).first()
        if r.n == n or not r.weight:
            break
        level, n = (everything - r.cap) / r.weight, r.n
    free = F.col("weight") * F.lit(level or 0.0)
    target = F.when(F.col("cap") <= free, F.col("cap")).otherwise(free) if r.weight else F.col("cap")
    return t.withColumn("target", target).select("key", "source_size", "mean", "least", "target", (F.col("target") >= F.col("cap")).alias("full"))


def _newton(table: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """state after one step, and off: how far from its target each source was before it. A source that is near stays."""
    x = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    moved = table.join(state, "key").groupBy("key", "target", "mean", "lo", "hi", "lam").agg(
        F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(most)))).alias("got"),
        F.sum(F.when(tilt < float(most), F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
    )
    gap = F.col("got") - F.col("target")
    moved = moved.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
    newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
    step = F.when(F.abs(gap) <= NEAR * F.col("target"), F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
    return moved.select("key", "target", "mean", "lo", "hi", step.alias("lam"), (F.abs(gap) / F.col("target")).alias("off"))


def balance(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources with the column lam that meets each target."""
    table = stash(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").cast("double").alias("n")), "sizes")
    x_least = F.col("least") / F.col("mean")
    # Bracket: at hi every document of at least one word is at most copies; at lo all rates are so small that the target isn't met.
    start = sources.where(~F.col("full")).select("key", "target", "mean", (F.log(F.lit(float(most))) / x_least).alias("hi"), (F.log(F.col("target") / F.col("source_size")) / x_least).alias("lo"))
    state = start.select("key", "target", "mean", F.least("lo", F.lit(-1e-9)).alias("lo"), "hi", F.lit(0.0).alias("lam"))
    state = stash(state, "state")
    for _ in range(0, ROUNDS, STEPS):
        moved = state
        for _ in range(STEPS):
            moved = _newton(table, moved, most)
        new = stash(moved, "state")
        unstash(state)
        state = new
        off = state.agg(F.max("off")).first()[0]
        if off is None or off <= NEAR:
            break
    else:  # the brackets halve each round, so what is left is beyond what doubles can tell apart
        if off > 1e-3:
            raise RuntimeError(f"balance: a source is {off:.2%} from its target after {ROUNDS} rounds")
    return sources.join(state.select("key", "lam"), "key", "left")


def _closed(batches):
    """key, lack, sizes and thresholds of a source's ladders: the places in them of documents to take once more and once less,
    a pair or a single one after another, as long as what the source lacks comes nearer to 0."""
    for batch in batches:
        out = []
        for key, lack, *ladders in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more, more_u, less, less_u = (np.array(x, float) for x in ladders)
            steps = np.append(more, 0)[:, None] - np.append(less, 0)[None, :]
            steps[:-1, :-1][more_u[:, None] == less_u[None, :]] = np.nan  # one document
            used: tuple[list[int], list[int]] = ([], [])
            while True:
                left = np.abs(lack - steps)
                if np.isnan(left).all() or not np.nanmin(left) < abs(lack):
                    break
                i, j = divmod(int(np.nanargmin(left)), steps.shape[1])
                lack -= steps[i, j]
                for k, n, place, own, other in ((i, len(more), 0, more_u, less_u), (j, len(less), 1, less_u, more_u)):
                    if k < n:
                        used[place].append(k)
                        (steps if place == 0 else steps.T)[k] = np.nan
                        (steps.T if place == 0 else steps)[np.flatnonzero(other == own[k])] = np.nan
            out.append((key, *used))
        k, m, less_ = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(m, pa.list_(pa.int32())), pa.array(less_, pa.list_(pa.int32()))], names=["key", "more_at", "less_at"])


@dataclass
class Mix:
    sources: DataFrame  # key, source_size, mean, target, full, lam, shift
    extra: DataFrame  # key, id, hash, copy of documents, and one: the copy that is added (1) or left out (-1)
    most: int
    share: float

    def rate(self) -> Column:
        return F.when(F.col("full"), F.lit(float(self.most))).otherwise(F.least(F.lit(float(self.most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))

    def copies(self, shift: Column) -> Column:
        whole = F.floor(F.col("rate") + F.col("u") + F.when(F.col("full"), F.lit(0.0)).otherwise(shift))
        return F.greatest(F.lit(0), F.least(F.lit(self.most), whole)).cast("long")

    def rated(self, sized: DataFrame) -> DataFrame:
        """sized: key, id, size, hash, copy and any columns. Adds those of sources, rate and u."""
        u = F.pmod(F.xxhash64("id", "hash", "copy", F.lit(1789)), F.lit(1 << 40)) / float(1 << 40)
        return sized.join(self.sources, "key").withColumn("rate", self.rate()).withColumn("u", u)

    def apply(self, sized: DataFrame) -> DataFrame:
        """sized with source_size, target, rate, copies and taken."""
        added = self.extra.select(*[F.col(n).alias(f"{n}_") for n in EACH], "one")
        out = self.rated(numbered(sized)).withColumn("copies", self.copies(F.col("shift")))
        out = out.join(added, reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in EACH]), "left")
        out = out.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(self.most), F.col("copies") + F.coalesce("one", F.lit(0)))).cast("long"))
        return out.withColumn("taken", F.col("copies") * F.col("size")).drop("one", "u", "mean", "least", "full", "lam", "shift", *EACH[:1], *EACH[2:], *[f"{n}_" for n in EACH])


def numbered(sized: DataFrame) -> DataFrame:
    """sized with copy: 0, or the number of the row among equal ones, from 0. Only rows whose key, id and hash are in one of at most 2 ** BUCKET_BITS buckets with equal rows are shuffled.

    Equal rows are numbered in parts: by a hash of the row, and by the task that wrote them, as rows that are equal altogether
    may be numbered in any order. Parts before count as offsets, of which there is one row a part."""
    bucket = F.pmod(F.xxhash64(*EACH[:3]), F.lit(1 << BUCKET_BITS))
    twice = sized.groupBy(*EACH[:3]).count().where("count > 1").select(bucket.alias("bucket")).distinct()
    twice = stash(twice, "twice")
    if not twice.limit(1).count():
        return sized.withColumn("copy", F.lit(0))
    marked = sized.withColumn("bucket", bucket)
    alone = marked.join(F.broadcast(twice), "bucket", "left_anti").drop("bucket").withColumn("copy", F.lit(0))
    content = F.xxhash64(F.to_json("row")) if "row" in sized.columns else F.lit(0).cast("long")
    some = marked.join(F.broadcast(twice), "bucket", "left_semi").drop("bucket")
    some = stash(some.withColumn("content", content).withColumn("task", F.spark_partition_id() % TASKS), "repeated")  # written, so that tasks stay what they are
    part = [*EACH[:3], "content", "task"]
    before = F.sum("n").over(Window.partitionBy(*EACH[:3]).orderBy("content", "task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = some.groupBy(*part).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"{c}_of") for c in part], F.coalesce(before, F.lit(0)).alias("before"))
    rows = some.withColumn("within", F.row_number().over(Window.partitionBy(*part).orderBy("id")) - 1)
    rows = rows.join(offsets, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in part]))
    return alone.unionByName(rows.withColumn("copy", (F.col("before") + F.col("within")).cast("int")).select(*sized.columns, "copy"))


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """id, key, size, hash (of the text), and row: a struct of the columns keep."""
    docs = plain(docs)
    row = [F.struct(*[docs[f"`{n}`"] for n in keep]).alias("row")] if keep else []
    return docs.select(docs[f"`{id_col}`"].alias("id"), _key(docs[f"`{source}`"]).alias("key"), word_count(docs[f"`{text}`"]).alias("size"), F.xxhash64(docs[f"`{text}`"].cast("string")).alias("hash"), *row)


def shifts(own: Mix, sizes: DataFrame) -> DataFrame:
    """own.sources with the column shift: of CELLS shifts from -1 up to 1, the greatest at which the copies' words aren't above
    the target, or -1.

    A document has floor(rate + u) - 1 copies at -1; one more from where the shift lifts rate + u to its own whole part on, and
    another from the next whole number on. These are words at a cell each; running sums over a source's cells meet the target.
    """
    v = F.col("rate") + F.col("u")
    whole = F.floor(v)
    cell = lambda m: F.ceil((m - v + 1) * (CELLS // 2)).cast("int")
    adds = F.array(
        F.struct(F.lit(0).alias("cell"), (F.col("size") * F.greatest(whole - 1, F.lit(0))).alias("words")),
        F.struct(cell(whole).alias("cell"), F.when(whole.between(1, own.most), F.col("size")).otherwise(0).alias("words")),
        F.struct(cell(whole + 1).alias("cell"), F.when(whole + 1 <= own.most, F.col("size")).otherwise(0).alias("words")),
    )
    words = own.rated(sizes.where("size > 0")).where(~F.col("full")).select("key", "target", F.inline(adds)).groupBy("key", "target", "cell").agg(F.sum("words").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
    over = words.withColumn("so_far", so_far).where(F.col("so_far") > F.col("target")).groupBy("key").agg(F.min("cell").alias("over"))
    at = F.greatest(F.lit(0), F.coalesce(F.col("over") - 1, F.lit(CELLS - 1)))
    return own.sources.join(over, "key", "left").withColumn("shift", at * (2.0 / CELLS) - 1.0).drop("over")


def mix(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> Mix:
    """sizes: id, key, size, hash of every document, stashed."""
    sizes = numbered(sizes)
    sources = stash(targets(sizes, share, most, weights), "targets")
    none = sizes.select(*EACH, F.lit(0).alias("one")).limit(0)
    balanced = stash(balance(sizes, sources, most), "lambdas")
    sources = stash(shifts(Mix(balanced, none, most, share), sizes), "shifts")
    unstash(balanced)
    own = Mix(sources, none, most, share)
    taken = own.rated(sizes).withColumn("copies", own.copies(F.col("shift")))
    lacks = taken.groupBy("key").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack"))
    rung = F.floor(F.log2(F.col("size")) * 4)
    some = taken.where("size > 0").groupBy("key", rung.alias("rung")).agg(*[F.min(F.when(can, F.struct("size", "u", *EACH[1:]))).alias(name) for name, can in (("more", F.col("copies") < most), ("less", F.col("copies") > 0))])
    ladder = some.groupBy("key").agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in ("more", "less")]).join(lacks, "key")
    sides = [F.transform(name, lambda d: d[part]).alias(f"{name}_{part}") for name in ("more", "less") for part in ("size", "u")]
    steps = ladder.select("key", F.col("lack").cast("double").alias("lack"), *sides).mapInArrow(_closed, "key string, more_at array<int>, less_at array<int>")
    chosen = ladder.join(steps, "key").select("key", F.concat(*[F.transform(f"{name}_at", lambda i: F.struct(F.get(name, i).alias("d"), F.lit(one).alias("one"))) for name, one in (("more", 1), ("less", -1))]).alias("all"))
    extra = stash(chosen.select("key", F.explode("all").alias("x")).select("key", *[F.col(f"x.d.{n}").alias(n) for n in EACH[1:]], "x.one"), "extra")
    return Mix(sources, extra, most, share)
