"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's documents below a threshold of the hash are used once
more than the others, and the threshold is found from histograms: tokens are summed by source and
leading bits of the hash, the bucket in which the budget ends is found, and only that bucket is
summed again by the next bits. Nothing is sorted, and a larger budget always holds a smaller one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.util import materialise

#: Bits of the hash that each histogram resolves, from the highest of 60 down.
STEPS = (12, 12, 12, 12, 12)
BITS = sum(STEPS)
MOST_SOURCES = 10_000


@dataclass
class Mix:
    """``uses``: source, key, tokens, uses (rows used at least once). ``report``: one row for each target source."""

    uses: DataFrame
    report: DataFrame


def source_name(column: str):
    """Source names are compared without case and outer blanks."""
    return F.lower(F.trim(F.col(column)))


def hash_histogram(rows: DataFrame, level: int) -> DataFrame:
    """source, bucket, tokens and rows by the hash bits of one level; combined before the shuffle."""
    shift = BITS - sum(STEPS[: level + 1])
    bucket = F.shiftright("h", shift).bitwiseAND(F.lit(2 ** STEPS[level] - 1))
    return rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def mix(sizes: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, target_source: str, share: str, repeats: str, total: int | str | None = None) -> Mix:
    """Choose how often each document is used so that sources have their target shares of the tokens.

    sizes: ``key`` (identifies the document, and is hashed), ``source``, ``tokens``. targets:
    ``target_source``, ``share``, ``repeats`` (most uses of a document; null counts as 1).
    total: tokens of the mix; by default the most, up to the size of the corpus, at which every
    source that can give anything reaches its share. With "corpus" every source has a budget of its
    share of the whole corpus, clipped at what its repeats give: nothing is rescaled, a scarce
    source gives all it has, and ``reached_tokens`` falls short of its share of ``mix_tokens``.

    The report has for each target source: source (as spelt in targets), target_share, max_repeats, documents,
    source_tokens, corpus_tokens, reachable (whether it could reach its share of a mix as large as
    the corpus), mix_tokens, reached_tokens and reached_share. A source without documents, with
    only empty ones, with max_repeats 0 or with a share of 0 has none used and reached_share 0; its
    share goes to the others in proportion, so their reached_share is above their target_share, and
    the mix is empty only if no source can give anything. A scarce source does limit the default
    mix, since shares follow the targets. Documents whose source has no target are not used, but count
    in the corpus. Null or negative sizes count as 0. Rows with the same key have the same hash
    and are used alike; a budget ends within one document's size of its target, or of the copies'
    where a document is repeated.
    """
    size = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    h = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - BITS)
    rows = materialise(sizes.select(F.col(key).alias("key"), source_name(source).alias("source"), size.alias("tokens"), h.alias("h")), "mix-sizes")
    wanted = targets.filter(F.col(target_source).isNotNull()).groupBy(source_name(target_source).alias("source")).agg(F.min(target_source).alias("name"), F.max(F.coalesce(F.col(share).cast("double"), F.lit(0.0))).alias("share"), F.max(F.coalesce(F.col(repeats).cast("int"), F.lit(1))).alias("repeats"))
    few = wanted.limit(MOST_SOURCES + 1).collect()
    if len(few) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    first = materialise(hash_histogram(rows, 0), "mix-histogram")
    corpus = int(first.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    named = [r["source"] for r in few]
    first = first.filter(F.col("source").isin(named))
    have = {r["source"]: (int(r["tokens"]), int(r["rows"])) for r in first.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).collect()}
    plan = {}
    for r in few:
        held, count = have.get(r["source"], (0, 0))
        plan[r["source"]] = {"name": r["name"], "share": max(0.0, r["share"]), "repeats": max(0, r["repeats"]), "held": held, "rows": count}
    # what sources that can give nothing leave open goes to the others in proportion
    giving = [p for p in plan.values() if p["share"] > 0 and p["held"] * p["repeats"] > 0]
    scale = sum(p["share"] for p in plan.values()) / sum(p["share"] for p in giving) if len(giving) < sum(p["share"] > 0 for p in plan.values()) and giving else 1.0
    if total == "corpus":
        total, scale = corpus, 1.0
    elif total is None:
        total = min([corpus, *(int(p["held"] * p["repeats"] / (p["share"] * scale)) for p in giving)]) if giving else 0
    for p in plan.values():
        budget = min(p["share"] * scale * total, p["held"] * p["repeats"])
        p["base"] = int(budget // p["held"]) if p["held"] else 0
        p["left"] = budget - p["base"] * p["held"] if p["held"] else 0.0
        p["threshold"], p["open"] = 0, p["left"] > 0

    # narrow the bucket in which each source's rest of the budget ends
    spark, level, extra = sizes.sparkSession, 0, {}
    histogram = first
    while True:
        ends = [(s, float(p["left"])) for s, p in plan.items() if p["open"]]
        if not ends:
            break
        budgets = F.create_map(*[x for s, left in ends for x in (F.lit(s), F.lit(left))])
        w = Window.partitionBy("source").orderBy("bucket")
        sums = histogram.filter(F.col("source").isin([s for s, _ in ends])).withColumn("upto", F.sum("tokens").over(w)).withColumn("budget", budgets[F.col("source")])
        edge = sums.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("tokens") <= F.col("budget"))).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("below"), "tokens", "rows"), "bucket").alias("e")).collect()
        found = {r["source"]: r["e"] for r in edge}
        shift = BITS - sum(STEPS[: level + 1])
        for s, _ in ends:
            p, e = plan[s], found.get(s)
            if e is None:  # the budget covers all that is left here
                p["threshold"] += 2 ** (STEPS[level] + shift)
                p["open"] = False
                continue
            p["threshold"] += int(e["bucket"]) << shift
            p["left"] -= float(e["below"])
            p["open"] = level + 1 < len(STEPS) and e["rows"] > 1
            if not p["open"] and p["left"] >= float(e["tokens"]) / 2:  # the nearer end of the last bucket
                p["threshold"] += 1 << shift
        level += 1
        open_ = {s: p["threshold"] >> shift for s, p in plan.items() if p["open"]}
        if not open_:
            break
        heads = F.create_map(*[x for s, head in open_.items() for x in (F.lit(s), F.lit(head))])
        histogram = hash_histogram(rows.filter(F.col("source").isin(list(open_)) & (F.shiftright("h", shift) == heads[F.col("source")])), level)

    cells = [F.struct(F.lit(s).alias("source"), F.lit(p["name"]).alias("name"), F.lit(p["share"]).alias("share"), F.lit(p["repeats"]).alias("repeats"), F.lit(p["base"]).alias("base"), F.lit(p["threshold"]).cast("bigint").alias("threshold"), F.lit(p["held"]).cast("bigint").alias("held"), F.lit(p["rows"]).cast("bigint").alias("documents")) for s, p in plan.items()]
    kinds = "array<struct<source:string,name:string,share:double,repeats:int,base:int,threshold:bigint,held:bigint,documents:bigint>>"
    decided = spark.range(1).select(F.explode(F.array(*cells) if cells else F.array().cast(kinds)).alias("p")).select("p.*")
    # decided has one row for each of at most MOST_SOURCES targets
    used = rows.join(F.broadcast(decided.select("source", "base", "threshold")), "source").withColumn("uses", F.least(F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.lit(2**31 - 1)))
    used = used.filter("uses > 0").select("key", "source", "tokens", "uses")
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"))
    report = decided.join(reached, "source", "left").select(F.col("name").alias("source"), F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "documents", F.col("held").alias("source_tokens"), F.lit(corpus).cast("bigint").alias("corpus_tokens"), (F.col("held") * F.col("repeats") >= F.col("share") * F.lit(float(corpus))).alias("reachable"), F.lit(total).cast("bigint").alias("mix_tokens"), F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached_tokens"))
    everything = Window.partitionBy(F.lit(1))  # at most MOST_SOURCES rows
    report = report.withColumn("reached_share", F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(everything), F.lit(0)))
    return Mix(used.withColumnRenamed("key", key), report)
