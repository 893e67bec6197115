"""Filling containers of fixed capacity, planned over the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import token_counts
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep
from webloom.sources.tables import table


#: Ranks of a length that meet the slots of the same stretch.
STRETCH = 1024


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts, longest first: (length, first, n, start, each) and the number of containers.

    The items of a length with ranks first to first + n - 1 go into the containers from start on, `each` of them into one. All items of a
    length meet all containers of equal room at once, so the work depends on the capacity and not on the number of items.
    """
    rooms: list[int] = []  # sorted rooms left of open containers
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (start, containers)
    out: list[tuple[int, int, int, int, int]] = []
    total = 0

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((start, n))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, first = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)  # the tightest room that holds it
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    out.append((length, first, full * each, total, each))
                    leave(capacity - each * length, total, full)
                if rest:
                    out.append((length, first + full * each, rest, total + full, rest))
                    leave(capacity - rest * length, total + full, 1)
                total += full + bool(rest)
                break
            room = rooms[at]
            start, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            rest = min(rest, each - 1) if each > 1 else 0
            if full:
                out.append((length, first, full * each, start, each))
                leave(room - each * length, start, full)
            if rest:
                out.append((length, first + full * each, rest, start + full, rest))
                leave(room - rest * length, start + full, 1)
            leave(room, start + full + bool(rest), n - full - bool(rest))
            first += full * each + rest
            left -= full * each + rest
    return out, total


def packed(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """pack_id, doc_id, piece_no, container_id, tokens: a container for each document at each capacity.

    sizes: doc_id, tokens; limits: pack_id, capacity_tokens (a small fixed table). A document longer than the capacity
    fills containers of its own, and what remains of it is an item as any other. Only the counts of each length reach the driver, at most
    capacity of them, so do the planned slots; documents take slots by their rank among those of their length.
    A document without tokens takes no room: its container_id is null and piece_no 0. Rows of null doc_id are left out, a
    repeated doc_id counts once; a capacity below 1 or null is left out.
    """
    spark = sizes.sparkSession
    caps = {r.pack_id: r.capacity_tokens for r in limits.filter("pack_id is not null and capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().collect()}
    docs = keep(sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("tokens", F.lit(0))).alias("tokens")))
    schema = "pack_id int, doc_id long, piece_no int, container_id long, tokens long"
    if not caps:
        return spark.createDataFrame([], schema)
    packs = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).cast("long").alias("capacity")) for p, c in caps.items()])).alias("x")
    rows = docs.select("doc_id", "tokens", packs).select("doc_id", "tokens", "x.pack_id", "x.capacity")
    rows = rows.withColumn("whole", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0)).withColumn("rest", F.col("tokens") - F.col("whole") * F.col("capacity"))
    counts = rows.filter("rest > 0").groupBy("pack_id", "rest").agg(F.count("*").alias("n")).collect()
    slots, used = [], {}
    for p, c in caps.items():
        planned, used[p] = plan({r.rest: r.n for r in counts if r.pack_id == p}, c)
        slots += [(int(p), *s) for s in planned]
    slot = spark.createDataFrame(slots, "pack_id int, rest long, first long, n long, start long, each long")
    stretch = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("first") + F.col("n") - 1) / STRETCH))).alias("stretch")
    slot = slot.select("*", stretch)  # a document meets the slots of its stretch of ranks alone
    ranked = count_before(rows.filter("rest > 0").select("pack_id", "rest", "doc_id", "whole", F.lit(1).alias("one")), ["pack_id", "rest"], ["doc_id"], "one", "rank")
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    placed = ranked.join(slot, ["pack_id", "rest", "stretch"]).filter("rank >= first and rank < first + n")
    items = placed.select("pack_id", "doc_id", (F.col("whole") + 1).cast("int").alias("piece_no"), (F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container_id"), F.col("rest").alias("tokens"))
    own = count_before(rows.filter("whole > 0").select("pack_id", "doc_id", "whole", "capacity"), ["pack_id"], ["doc_id"], "whole", "before")
    base = F.coalesce(*[F.when(F.col("pack_id") == int(p), F.lit(n)) for p, n in used.items()])
    full = own.select("pack_id", "doc_id", "capacity", "before", F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("piece_no"))
    full = full.select("pack_id", "doc_id", "piece_no", (base + F.col("before") + F.col("piece_no") - 1).alias("container_id"), F.col("capacity").alias("tokens"))
    empty = rows.filter("tokens = 0").select("pack_id", "doc_id", F.lit(0).alias("piece_no"), F.lit(None).cast("long").alias("container_id"), "tokens")
    return items.union(full).union(empty)


def _sizes(spark, d) -> DataFrame:
    return token_counts(table(spark, d, "documents").select("doc_id", "text"))


def p8_containers(spark, d):
    """The container of each document at each capacity."""
    return packed(_sizes(spark, d), table(spark, d, "pack_limits"))


def p8_fill(spark, d):
    """Containers of each capacity, the tokens in them, and the part of their room that is used."""
    rows = p8_containers(spark, d).filter("container_id is not null")
    each = rows.groupBy("pack_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    sums = each.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return sums.join(table(spark, d, "pack_limits"), "pack_id").select("pack_id", "capacity_tokens", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


def p8_invariants(spark, d):
    """Of each capacity: documents placed, containers over it, texts cut though they fit, and containers less than half full beyond one."""
    rows = p8_containers(spark, d).join(table(spark, d, "pack_limits"), "pack_id")
    docs = rows.groupBy("pack_id", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    cut = docs.groupBy("pack_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("cut"))
    full = rows.filter("container_id is not null").groupBy("pack_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"))
    over = full.groupBy("pack_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over"), F.greatest(F.count_if(2 * F.col("tokens") < F.col("capacity_tokens")) - 1, F.lit(0)).alias("half_empty"))
    return cut.join(over, "pack_id")


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_invariants": p8_invariants}
SQL = {"p8_invariants": "SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS cut, 0 AS over, 0 AS half_empty FROM pack_limits"}
