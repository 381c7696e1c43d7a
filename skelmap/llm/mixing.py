"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from itertools import islice
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

BLOCK_DOCS = 8
#: Bounds of a schedule by patterns, which is broadcast: distinct sources, and slots in the patterns of all phases. Beyond them the same schedule is
#: written slot by slot, WRITE_SLOTS at a time, and joined by key.
MAX_SOURCES = 1000
MAX_SLOTS = 1_000_000
WRITE_SLOTS = 500_000
#: Rows that one (source, bucket) group numbers, at the mean.
BUCKET_ROWS = 5_000


def pattern(weights: dict[str, int]) -> list[str]:
    """Sources of the slots of one hyperperiod of sum(weights) slots.

    Block k of a source of weight w (of D in all) is released at floor(k D / w) and due at ceil((k + 1) D / w). Each slot goes to
    the released block that is due first, ties to the source whose next block is due first, then by name. On one
    processor with full use this meets every deadline, so a source is never a whole block ahead or behind.
    """
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights) if weights[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            w = weights[s]
            heapq.heappush(ready, (-(-(k + 1) * total // w), -(-(k + 2) * total // w), s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Phases that place every block: for each, its weights and how often its hyperperiod repeats.

    A phase repeats while every source that still has blocks has enough. Then the sources that have fewer than their weight enter
    one hyperperiod with what they have left, which ends them, and the others go on at their weights.
    """
    left = {s: n for s, n in blocks.items() if n}
    out = []
    while left:
        g = 0
        for s in left:
            g = gcd(g, weights[s])
        w = {s: weights[s] // g for s in left}
        times = min(n // w[s] for s, n in left.items())
        if not times:
            w, times = {s: min(w[s], n) for s, n in left.items()}, 1
        out.append({"weights": w, "times": times})
        left = {s: n - times * w[s] for s, n in left.items() if n > times * w[s]}
    return out


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[dict] | None:
    """For each source its phases: first and end block, first slot, weight, hyperperiod and places of its blocks in it.

    None if there are over MAX_SOURCES sources or the patterns take over MAX_SLOTS slots.
    """
    if len(blocks) > MAX_SOURCES:
        return None
    done, start, used = dict.fromkeys(blocks, 0), 0, 0
    rows: dict[str, list] = {s: [] for s in blocks}
    for n, p in enumerate(phases(blocks, weights)):
        w, total = p["weights"], sum(p["weights"].values())
        used += total
        if used > MAX_SLOTS:
            return None
        places: dict[str, list[int]] = {s: [] for s in w}
        for t, s in enumerate(pattern(w)):
            places[s].append(t)
        for s in w:
            end = done[s] + p["times"] * w[s]
            rows[s].append({"phase": n, "b0": done[s], "b1": end, "start": start, "w": w[s], "d": total, "places": places[s]})
            done[s] = end
        start += p["times"] * total
    return [{"source": s, "phases": r} for s, r in rows.items()]


def slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """The schedule slot by slot: source, block, phase, slot, release and deadline of each block."""
    done, start = dict.fromkeys(blocks, 0), 0
    for n, p in enumerate(phases(blocks, weights)):
        w, total = p["weights"], sum(p["weights"].values())
        base = dict(done)
        for turn in range(p["times"]):
            for t, s in enumerate(pattern(w)):
                k = done[s] - base[s]
                yield s, done[s], n, start + turn * total + t, start + k * total // w[s], start - (-(k + 1) * total // w[s])
                done[s] += 1
        start += p["times"] * total


def _written(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """slots() as a table in the shared folder: the driver holds WRITE_SLOTS of them at a time."""
    path = f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    schema = "_mx_p string, _mx_b long, mix_phase int, mix_slot long, mix_release long, mix_deadline long"
    while part := list(islice(rows, WRITE_SLOTS)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("(null)"))


PLAN = "array<struct<source:string,phases:array<struct<phase:int,b0:long,b1:long,start:long,w:long,d:long,places:array<long>>>>>"


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_docs: int = BLOCK_DOCS, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with their place in the mixture: columns mix_phase, mix_block, mix_slot, mix_release, mix_deadline, mix_at.

    weights: whole-number weights of sources, others have default_weight. A source's rows are dealt into blocks of
    block_docs in the order of a hash of their ids; its last block may be shorter. mix_slot is the block's slot in
    the schedule, mix_at the row's place in the block; ordering by both gives the mixture. In a phase all sources that still
    have blocks keep their weights to within one block. Every row is placed, none twice. A null source is the source
    `(null)`. Repeated rows and null ids are rows like any other: those of one id are in the order of a hash of their columns (but for
    maps, which have none), and rows that have all of them alike may change places. Texts are as long as they are; nothing but their hash is looked at. An empty table gives no
    rows. Columns of these names in docs are replaced.
    """
    spark = docs.sparkSession
    weights = {k: v for k, v in (weights or {}).items()}
    if default_weight < 1 or any(v < 1 or v != int(v) for v in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    own = [c for c in docs.columns if c not in ("mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")]
    counts = docs.groupBy(_key(F.col(source_col)).alias("s")).agg(F.count("*").alias("n")).collect()
    blocks = {r.s: -(-r.n // block_docs) for r in counts}
    each = {s: weights.get(s, default_weight) for s in blocks}
    plan = schedule(blocks, each)
    buckets = max(1, sum(r.n for r in counts) // BUCKET_ROWS)

    # number the rows of a source: within hash buckets, plus the rows of the buckets before. An id, null too, that more rows share
    # than a bucket is to have is split by a hash of the rows
    own_id = F.col(id_col).cast("long")
    hot = docs.groupBy(own_id.alias("_mx_i")).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    hot = cut(hot.select("_mx_i", F.expr(f"cast(n div {BUCKET_ROWS} + 1 as int)").alias("_mx_parts")), "mix-hot", "none")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.select(*own).dtypes if "map<" not in kind and kind != "variant"])
    h = F.xxhash64(own_id)
    keyed = docs.select(*own, own_id.alias("_mx_id"), _key(F.col(source_col)).alias("_mx_s"), h.alias("_mx_h"), whole.alias("_mx_w"))
    part = F.coalesce(F.pmod("_mx_w", F.col("_mx_parts")), F.lit(0))
    keyed = keyed.join(hot, F.col("_mx_id").eqNullSafe(F.col("_mx_i")), "left").withColumn("_mx_k", F.struct(F.pmod("_mx_h", F.lit(buckets)).alias("k"), part.alias("p")))
    inner = F.row_number().over(Window.partitionBy("_mx_s", "_mx_k").orderBy("_mx_h", "_mx_id", "_mx_w"))
    sizes = keyed.groupBy("_mx_s", "_mx_k").agg(F.count("*").alias("_mx_n"))
    before = F.coalesce(F.sum("_mx_n").over(Window.partitionBy("_mx_s").orderBy("_mx_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_mx_s").alias("_mx_s2"), F.col("_mx_k").alias("_mx_k2"), before.alias("_mx_o"))
    numbered = keyed.withColumn("_mx_r", inner - 1).join(offsets, (F.col("_mx_s") == F.col("_mx_s2")) & (F.col("_mx_k") == F.col("_mx_k2")))
    n = F.col("_mx_o") + F.col("_mx_r")
    numbered = numbered.select(*own, "_mx_s", F.expr(f"(_mx_o + _mx_r) div {block_docs}").alias("mix_block"), (n % block_docs).cast("int").alias("mix_at"))

    if plan is None:
        placed = numbered.join(_written(spark, slots(blocks, each)), (F.col("_mx_s") == F.col("_mx_p")) & (F.col("mix_block") == F.col("_mx_b")))
        return placed.select(*own, "mix_phase", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), PLAN))).select(F.col("source").alias("_mx_p"), F.col("phases").alias("_mx_ph"))
    placed = numbered.join(F.broadcast(table), F.col("_mx_s") == F.col("_mx_p"))
    mine = F.filter("_mx_ph", lambda p: (F.col("mix_block") >= p.b0) & (F.col("mix_block") < p.b1))[0]
    placed = placed.withColumn("_mx_now", mine)
    k = "(mix_block - _mx_now.b0)"
    return placed.select(
        *own,
        F.col("_mx_now.phase").alias("mix_phase"),
        "mix_block",
        F.expr(f"_mx_now.start + ({k} div _mx_now.w) * _mx_now.d + _mx_now.places[cast({k} % _mx_now.w as int)]").alias("mix_slot"),
        F.expr(f"_mx_now.start + ({k} * _mx_now.d) div _mx_now.w").alias("mix_release"),
        F.expr(f"_mx_now.start + (({k} + 1) * _mx_now.d + _mx_now.w - 1) div _mx_now.w").alias("mix_deadline"),
        "mix_at",
    )


def interleave(docs: DataFrame, weights: dict[str, int] | None = None, **options) -> DataFrame:
    """docs in the order of the mixture, with their own columns: files and rows follow one another slot by slot."""
    return mix(docs, weights, **options).orderBy("mix_slot", "mix_at").select(*docs.columns)
