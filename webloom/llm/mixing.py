"""Mixing sources to target shares of tokens, by a minimum-cost flow over membership patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import token_counts
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep
from webloom.sources.tables import table

SEED = 20
#: Spans of patterns up to which they are broadcast.
FEW = 100_000


class Flow:
    """Minimum-cost flow by successive shortest paths; for the few nodes that patterns and sources make."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, s: int, t: int) -> int:
        """Send as much as fits, at the least cost; gives the amount."""
        total = 0
        while True:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[s], todo = 0, [s]
            while todo:
                later = []
                for a in todo:
                    for e in self.out[a]:
                        if self.room[e] and (far[self.to[e]] is None or far[a] + self.cost[e] < far[self.to[e]]):
                            far[self.to[e]], via[self.to[e]] = far[a] + self.cost[e], e
                            later.append(self.to[e])
                todo = list(dict.fromkeys(later))
            if far[t] is None:
                return total
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            n = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= n
                self.room[e ^ 1] += n
            total += n


def routed(tokens: dict[tuple[str, ...], int], share: dict[str, float], repeats: dict[str, int], total: int) -> tuple[dict, int]:
    """Tokens of (pattern, use number, source) that make up the quotas of a total, as near as supplies allow, and their sum.

    A pattern is the set of sources that hold a text. Its n-th use costs 2n - 1, so repeating a text costs the more the
    more often it is used, and repeats are spread over all texts before any is used once more.
    """
    sources = sorted(share)
    levels = [(p, k) for p in sorted(tokens) for k in range(1, max([repeats[s] for s in p if s in share] or [0]) + 1)]
    f = Flow(2 + len(levels) + len(sources))
    at = {s: 2 + len(levels) + i for i, s in enumerate(sources)}
    used = {}
    for i, (p, k) in enumerate(levels):
        f.arc(0, 2 + i, tokens[p], 2 * k - 1)
        for s in p:
            if s in share and k <= repeats[s]:
                used[p, k, s] = f.arc(2 + i, at[s], tokens[p], 0)
    for s in sources:
        f.arc(at[s], 1, int(share[s] * total), 0)
    sent = f.send(0, 1)
    return {key: f.room[e ^ 1] for key, e in used.items() if f.room[e ^ 1]}, sent


def largest_total(tokens: dict[tuple[str, ...], int], share: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source can fill its quota."""
    low, high = 0, sum(n * max([repeats[s] for s in p if s in share] or [0]) for p, n in tokens.items()) + 1
    while high - low > max(1, high // 10_000):
        middle = (low + high) // 2
        if routed(tokens, share, repeats, middle)[1] >= sum(int(v * middle) for v in share.values()):
            low = middle
        else:
            high = middle
    return low


def mixed(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, uses, tokens: the records chosen, with how often each is used for its source.

    records: doc_id, source, text_hash, tokens; targets: source, target_share, max_repeats (a small fixed table). Records of one
    text_hash are one text: it may serve any source that holds it, in all at most max_repeats times of the source
    served, and its record there is the one of the smallest doc_id. Texts are gathered by membership pattern (at most
    2 to the number of sources, whatever the records); tokens of patterns flow to the sources' quotas of the
    total (if None, the largest at which all shares can be met), then texts take their places on each pattern's line of tokens
    in seeded order. Records without tokens, of null doc_id or of a source without a target are never chosen.
    """
    spark = records.sparkSession
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").collect()}
    share, repeats = {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}
    schema = "doc_id long, source string, uses int, tokens long"
    if not goal:
        return spark.createDataFrame([], schema)
    good = records.filter((F.col("tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isin(*goal))
    first = good.groupBy("text_hash", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = keep(first.groupBy("text_hash").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("held")))  # at most one entry a source
    texts = texts.withColumn("pattern", F.array_join("held.source", "\t"))
    supply = {tuple(r.pattern.split("\t")): int(r.n) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    if total is None:
        total = largest_total(supply, share, repeats)
    flow, _ = routed(supply, share, repeats, total)
    spans, ends = [], {}
    for (p, k, s), n in sorted(flow.items()):
        start = ends.get((p, k), 0)
        ends[p, k] = start + n
        spans.append(("\t".join(p), k, s, start, start + n))
    if not spans:
        return spark.createDataFrame([], schema)
    lines = count_before(texts.withColumn("order", F.xxhash64("text_hash", F.lit(seed))), ["pattern"], ["order", "text_hash"], "tokens", "at")
    span = spark.createDataFrame(spans, "pattern string, level int, source string, lo long, hi long")
    middle = F.col("at") + F.col("tokens") / 2
    taken = lines.join(F.broadcast(span) if len(spans) <= FEW else span, "pattern").filter((middle >= F.col("lo")) & (middle < F.col("hi")))  # one span for each use number
    record = F.filter("held", lambda h: h["source"] == F.col("source"))[0]["doc_id"]
    return taken.select(record.alias("doc_id"), "source", "tokens").groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("uses")).select("doc_id", "source", "uses", "tokens")


def _records(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.unhex(F.md5("text")).alias("text_hash"), "text")
    return token_counts(docs)


def p9_selection(spark, d):
    """The records chosen, with their uses."""
    return mixed(_records(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    """The share of tokens that each source reached, beside its target."""
    chosen = p9_selection(spark, d).groupBy("source").agg(F.count("*").alias("records"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    total = chosen.agg(F.sum("tokens").alias("all"))
    rows = table(spark, d, "mix_targets").join(chosen, "source", "left").join(F.broadcast(total))  # one row
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", "max_repeats", n("records"), n("uses"), n("most_uses"), n("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6).alias("share"))


def p9_invariants(spark, d):
    """Of each source: whether its share is within a hundredth or two of the longest records of its target, and whether a record is used too often or comes twice."""
    chosen = p9_selection(spark, d)
    whole = chosen.agg(F.max("tokens").alias("longest"), F.sum(F.col("uses") * F.col("tokens")).alias("all"))
    gap = F.greatest(2 * F.col("longest") / F.col("all"), F.lit(0.01))
    shares = p9_shares(spark, d).join(F.broadcast(whole))  # one row
    shares = shares.select("source", (F.abs(F.col("share") - F.col("target_share")) <= gap).alias("near"), (F.col("most_uses") > F.col("max_repeats")).alias("too_often"))
    again = chosen.groupBy("source").agg((F.count("*") - F.count_distinct("doc_id")).alias("again"))
    return shares.join(again, "source", "left").select("source", "near", "too_often", F.coalesce("again", F.lit(0)).alias("again"))


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares, "p9_invariants": p9_invariants}
SQL = {"p9_invariants": "SELECT source, true AS near, false AS too_often, 0 AS again FROM mix_targets"}
