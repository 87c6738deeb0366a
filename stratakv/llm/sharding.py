"""Shards of equal row counts that keep linked documents together.

Documents with equal texts are linked.  Linked rows start in balanced shards and
then move, round by round, to the shard where most of their neighbours are
(balanced label propagation): a join with the neighbours' counts gives every row
its wish, the wishes are summed to a matrix of shard-to-shard flows, and as much
of each flow is granted as leaves every shard within its quota.  Rows without
links fill what the quotas leave free, so the counts of any two shards differ by
one at most (law ``rows``).

A group of copies larger than ``1 / PARTS`` of a shard is placed before the
others, the largest first: in the fullest shard that has room for all of it, or
else as much of it as fits in the emptiest shard and the remainder like a group
of its own.  Its rows stay there, so such a group is cut only where no shard has
room for what is left of it, and the others move in what the quotas leave.

Everything is done by DataFrame operations.  Flows are granted by hash buckets
of neighbourhoods, so the driver sees shards x shards numbers and the sizes of
the large groups, about shards x PARTS at most; places within a shard or a large
group come from bucket counts and a window over one small bucket each.

Cases: a null text counts as empty; null ids and repeated rows are rows like
others; a very long text counts by its digest and size alone; ties of wishes
fall by a hash; with fewer rows than shards some shards
stay empty; an empty table gives no rows; columns of the input other than
doc_id and text are not carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ._store import stored, table

SHARDS = 16
ROUNDS = 5
PARTS = 8
BUCKETS = 256
BUCKET_ROWS = 20_000
UPPER = 1024
GROUP_BUCKETS = 64


def _before(window: WindowSpec) -> Column:
    """The sum of _n over the rows before."""
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def indexed(df: DataFrame, group: str, key: str, rows: int, into: str, buckets: int = 1) -> DataFrame:
    """A gapless number from 0 within each group, for rows with a unique ``key``: by hash bucket, then by key.

    Counts of buckets are summed up in runs of UPPER, and those of runs in turn,
    so that no window holds all buckets of a large group.

    rows: about how many rows there are; a bucket holds about BUCKET_ROWS of them, or less. buckets: the least number of them.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(max(buckets, rows // BUCKET_ROWS + 1))))
    counts = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).withColumn("_run", F.floor(F.col("_bucket") / UPPER))
    above = counts.groupBy(group, "_run").agg(F.sum("_n").alias("_n"))
    runs = above.select(group, "_run", _before(Window.partitionBy(group).orderBy("_run")).alias("_above"))
    in_run = counts.select(group, "_run", "_bucket", _before(Window.partitionBy(group, "_run").orderBy("_bucket")).alias("_below"))
    offsets = in_run.join(runs, [group, "_run"]).select(group, "_bucket", (F.col("_above") + F.col("_below")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(key)) - 1
    return dealt.join(offsets, [group, "_bucket"]).withColumn(into, F.col("_before") + within).drop("_bucket", "_before")


def _described(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def pieces(sizes: list[int], quota: list[int]) -> list[list[tuple[int, int]]]:
    """(shard, rows) of the parts of each group: whole where a shard has room, else cut."""
    room = list(quota)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    todo = [(-n, i) for i, n in enumerate(sizes)]
    heapq.heapify(todo)
    while todo:
        n, i = heapq.heappop(todo)
        fits = [b for b, free in enumerate(room) if free >= -n]
        b = min(fits, key=room.__getitem__) if fits else max(range(len(room)), key=room.__getitem__)
        taken = min(-n, room[b])
        room[b] -= taken
        out[i].append((b, taken))
        if taken < -n:
            heapq.heappush(todo, (n + taken, i))
    return out


def _in_groups(large: list[tuple[bytes, int]]) -> str:
    return f"digest IN ({', '.join(f"X'{digest.hex()}'" for digest, _ in large)})"


def _anchored(rows: DataFrame, large: list[tuple[bytes, int]], parts: list[list[tuple[int, int]]]) -> DataFrame:
    """The rows of large groups with their shards, in which they have the first slots."""
    values, used = [], {}
    for (digest, _), found in zip(large, parts, strict=True):
        first = 0
        for b, n in found:
            values.append(f"(X'{digest.hex()}', {b}, {first}L, {first + n}L, {used.get(b, 0)}L)")
            first, used[b] = first + n, used.get(b, 0) + n
    ranges = F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(digest, shard, first, beyond, start)"))
    own = rows.where(_in_groups(large))
    nth = indexed(own, "digest", "row", sum(n for _, n in large), "nth", GROUP_BUCKETS)
    found = nth.join(ranges, (nth.digest == ranges.digest) & (nth.nth >= ranges["first"]) & (nth.nth < ranges.beyond))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - F.col("first")).alias("slot"))


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """Each row's neighbourhood, a hash of its text; null for a row without links."""
    counts = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts, "digest", "left").select("doc_id", "row", "size", "text_crc32", F.when(F.col("n") > 1, F.xxhash64("digest")).alias("hood"))


def shares(rows: int, room: list[int]) -> list[int]:
    """``rows`` dealt in proportion to ``room``, which is not exceeded."""
    every = sum(room)
    out = [rows * free // every if every else 0 for free in room]
    for b in sorted(range(len(room)), key=lambda b: out[b] - room[b])[: rows - sum(out)]:
        out[b] += 1
    return out


def _by_place(counts: list[int]) -> Column:
    """The shard of each ``place`` if the first so many places are the first shard's, and so on."""
    ends = [sum(counts[: b + 1]) for b in range(len(counts))]
    return F.expr(f"size(filter(array({', '.join(f'{e}L' for e in ends)}), e -> e <= place))")


def granted(wishes: list[list[int]], free: list[int]) -> list[list[int]]:
    """The largest flows that a plain reduction finds, so that no shard takes in more than it gives plus what it has free."""
    n = len(free)
    flow = [row[:] for row in wishes]
    while True:
        over = [sum(flow[a][b] for a in range(n)) - sum(flow[b]) - free[b] for b in range(n)]
        worst = max(range(n), key=over.__getitem__)
        if over[worst] <= 0:
            return flow
        excess = over[worst]
        for a in sorted(range(n), key=lambda a: -flow[a][worst]):
            cut = min(excess, flow[a][worst])
            flow[a][worst] -= cut
            excess -= cut


def _matrix(values: list[list[int]], row: str, column: str) -> Column:
    inner = ", ".join("array(" + ", ".join(map(str, r)) + ")" for r in values)
    return F.expr(f"array({inner})[{row}][{column}]")


def _round(linked: DataFrame, quota: list[int], shards: int) -> DataFrame:
    """One step: wishes, flows, and the rows' new shards."""
    counts = linked.groupBy("hood", "shard").agg(F.count("*").alias("n"))
    best = counts.groupBy("hood").agg(F.max_by("shard", F.struct("n", F.xxhash64("hood", "shard"))).alias("wish"))
    tagged = stored(linked.join(best, "hood").withColumn("bucket", F.pmod(F.xxhash64("hood", F.lit(1)), F.lit(BUCKETS)).cast("int")), "wishes")
    flows = tagged.groupBy("shard", "wish", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard", "wish").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    steps = flows.withColumn("upto", F.sum("n").over(upto)).collect()  # at most shards x shards x BUCKETS rows
    wishes = [[0] * shards for _ in range(shards)]
    held = [0] * shards
    for r in steps:
        held[r.shard] += r.n
        if r.shard != r.wish:
            wishes[r.shard][r.wish] += r.n
    flow = granted(wishes, [q - h for q, h in zip(quota, held, strict=True)])
    # Whole buckets are granted. Dropping part of one flow takes room from no other, but leaves its source fuller; so grants are worked out again until they hold.
    while True:
        last = [[-1] * shards for _ in range(shards)]
        real = [[0] * shards for _ in range(shards)]
        for r in steps:
            if r.shard != r.wish and r.upto <= flow[r.shard][r.wish] and r.upto >= real[r.shard][r.wish]:
                last[r.shard][r.wish], real[r.shard][r.wish] = r.bucket, r.upto
        again = granted(real, [q - h for q, h in zip(quota, held, strict=True)])
        if again == real:
            break
        flow = again
    moves = F.col("bucket") <= _matrix(last, "shard", "wish")
    return tagged.select("doc_id", "row", "size", "text_crc32", "hood", F.when(moves, F.col("wish")).otherwise(F.col("shard")).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    described = stored(_described(docs), "described")
    total = described.count()
    quota = [total // shards + (b < total % shards) for b in range(shards)]
    most = max(2, total // (shards * parts))
    large = sorted((bytes(r.digest), r.n) for r in described.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > most).collect())  # at most total / most
    cut = pieces([n for _, n in large], quota)
    n_large = sum(n for _, n in large)
    room = list(quota)
    for b, n in (x for found in cut for x in found):
        room[b] -= n
    rows = stored(_neighbourhoods(described.where(f"NOT {_in_groups(large)}") if large else described), "hoods")
    n_linked = rows.where("hood is not null").count()
    linked = indexed(rows.where("hood is not null").withColumn("_all", F.lit(0)), "_all", "row", n_linked, "place").withColumn("shard", _by_place(shares(n_linked, room))).drop("_all", "place")
    for _ in range(rounds if n_linked else 0):
        linked = _round(linked, room, shards)
    before = F.expr(f"array({', '.join(f'{q - free}L' for q, free in zip(quota, room, strict=True))})[shard]")
    placed = indexed(linked, "shard", "row", n_linked, "slot").select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + before).alias("slot"))
    placed = stored(placed.unionByName(_anchored(described, large, cut)) if large else placed, "linked")
    held = dict.fromkeys(range(shards), 0) | {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    rest = [q - held[b] for b, q in enumerate(quota)]
    single = indexed(rows.where("hood is null").withColumn("_all", F.lit(0)), "_all", "row", total - n_linked - n_large, "place")
    single = single.withColumn("shard", _by_place(rest))
    first = F.expr(f"array({', '.join(f'{held[b] - sum(rest[:b])}L' for b in range(shards))})[shard]")
    return placed.unionByName(single.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + first).alias("slot")))


def op10_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
