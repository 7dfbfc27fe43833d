"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target number of words. Whole passes over the source are taken while they fit; the
remaining budget is filled from a histogram of exact document lengths by a bounded knapsack, which says
how many documents of each length to take once more; of each length the rows with the smallest seeded hashes
are taken. The result depends on the rows and the seed alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandkeep.llm import common

#: A source's target is at most so many times its size.
MOST = 3
#: Words of the budget that the knapsack is left at first, and those it is left at most where the longest text needs no more.
EXACT, LARGEST = 1 << 16, 1 << 25
#: Bits of the hash ranges by which a length's documents are counted before the last range is ranked.
RANGE_BITS = 10
#: Equal rows that are numbered in one part, about.
TIED = 100_000


def cycle_weights(k):
    """The weights 1, 2, 3, repeating, of a place (a number or a column)."""
    return k % 3 + 1


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above most times its size; the excess is reshared by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / weight for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = share[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in over]
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take (at most counts) so that their words come as near under budget as found.

    A proportional share of every length first and the best sum there is for what is left. If that misses the
    budget, ever more of it is left to the best sum, until the budget is met, all of it was left (no sum is
    better then) or LARGEST words and twice the longest text were: any text can then be taken or passed over.
    """
    total = sum(n * k for n, k in zip(lengths, counts, strict=True))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    unit = math.gcd(*lengths)
    lengths, budget, total = [n // unit for n in lengths], budget // unit, total // unit
    order = sorted((j for j in range(len(lengths)) if lengths[j] > 0), key=lambda j: -lengths[j])
    most = min(budget, max(LARGEST, 2 * lengths[order[0]]))
    best, missed, room = [], budget + 1, 0
    while True:
        taken = [k * (budget - room) // total for k in counts]
        left = budget - sum(n * k for n, k in zip(lengths, taken, strict=True))
        for j in order:
            more = min(counts[j] - taken[j], max(0, left - max(room, EXACT)) // lengths[j])
            taken[j] += more
            left -= more * lengths[j]
        for j, more in subset_sum([lengths[j] for j in order], [counts[j] - taken[j] for j in order], left):
            taken[order[j]] += more
            left -= more * lengths[order[j]]
        if left < missed:
            best, missed = [*taken], left
        if missed == 0 or room == most:
            return best
        room = min(most, max(EXACT, room * 8))


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> list[tuple[int, int]]:
    """Bounded knapsack over bit sets of reachable sums: (index, how many) of the largest sum up to budget."""
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    first = np.zeros(budget + 1, np.int32)  # the step that first reached a sum
    for j in range(len(lengths) - 1, -1, -1):  # short lengths first: they reach most sums
        left, part = min(counts[j], budget // lengths[j]), 1
        while left > 0 and not reach >> budget & 1:
            part = min(part, left)
            new = reach << (part * lengths[j]) & mask & ~reach
            if new:
                low = (new & -new).bit_length() - 1
                bits = new >> low
                bits = np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8)
                first[low + np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                steps.append((j, part))
                reach |= new
            left -= part
            part *= 2
    at, taken = reach.bit_length() - 1, {}
    while at:
        j, part = steps[first[at]]
        taken[j] = taken.get(j, 0) + part
        at -= part * lengths[j]
    return sorted(taken.items())


def source_targets(totals: DataFrame, weights, most: float = MOST) -> DataFrame:
    """totals (__sk, __n) with __target, by the rule of targets, for any number of sources.

    Sources are numbered in code point order by ranges; the level up to which shares rise is found by sums over
    them, and the driver sees one total a range and two a step.
    """
    spark = totals.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("__sk") == "n", F.col("__sk")
    ranged = common.stash(totals.repartitionByRange(n, *by).withColumn("__range", F.spark_partition_id()))
    at, before = 0, []
    for r in sorted(ranged.groupBy("__range").count().collect()):
        before.append((r[0], at))
        at += r[1]
    numbered = ranged.join(F.broadcast(spark.createDataFrame(before, "__range int, __before long")), "__range")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    numbered = common.stash(numbered.select("__sk", "__n", weights(place).cast("double").alias("__w")))
    most_of = F.col("__n") * F.lit(float(most))
    total, open_ = numbered.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    level, last = (total / open_ if open_ else 0.0), None
    while level != last and open_:
        over = F.lit(level) * F.col("__w") > most_of
        capped, open_ = numbered.agg(F.coalesce(F.sum(F.when(over, most_of)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("__w"))), F.lit(0.0))).first()
        last, level = level, max(level, (total - capped) / open_) if open_ else level
    return numbered.select("__sk", "__n", F.least(F.lit(level) * F.col("__w"), most_of).alias("__target"))


def mix(docs: DataFrame, weights=cycle_weights, seed: int = 17, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes the document), taken (its words in the mix).

    docs needs doc_id, text, source; other columns stay, but for those of the names above, which are replaced.
    Null text has size 0; documents of size 0 are taken once if their source's whole passes take it. Null
    sources form one source, ordered last. Of each length the rows with the smallest hashes of doc_id, text and
    other columns go in; of rows equal in all of them, so many. So reruns agree, and a source is fitted to the row
    whether its ids are null, repeated or alike. An empty table gives an empty one. weights(k) is the weight of the
    source with the place k.

    Histograms are fitted source by source, their rows bounded by the distinct lengths. Counts are pre-aggregated
    per length, hash range and hash, so no task ranks a whole source; equal rows of which only some go in are
    numbered in salted parts.
    """
    docs = docs.drop(*{"size", "source_size", "target", "copies", "taken"} & set(docs.columns))
    others = [x for f in docs.schema if f.name not in ("doc_id", "text", "source") for x in _hashable(f)]
    keyed = docs.withColumns({
        "__sk": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "size": common.n_words("text"),
        "__h": F.xxhash64(F.lit(seed), "doc_id", "text", *others),
    })
    narrow = common.stash(keyed.select("__sk", "size", "__h"))
    n = F.col("__n")
    whole = F.when(n > 0, F.least(F.floor(F.col("__target") / n), F.lit(int(most)))).otherwise(1).cast("int")
    plan = source_targets(narrow.groupBy("__sk").agg(F.sum("size").alias("__n")), weights, most).withColumn("__whole", whole)
    plan = common.stash(plan.withColumn("__budget", F.greatest(F.lit(0), F.least(F.round("__target").cast("long") - F.col("__whole") * n, n))))
    plan = common.sized(plan, F.octet_length("__sk"))

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        take = fit(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["__budget"].iloc[0]))
        return pd.DataFrame({"__sk": key[0], "size": pdf["size"], "extra": take})

    lengths = narrow.where("size > 0").groupBy("__sk", "size").agg(F.count("*").alias("n")).join(plan.select("__sk", "__budget"), "__sk")
    extra = common.stash(lengths.groupBy("__sk").applyInPandas(fitted, "__sk string, size long, extra long"))
    # the range of hashes in which the count of a length is reached, then the last hash taken in it
    part = F.shiftrightunsigned(F.col("__h"), 64 - RANGE_BITS).cast("int")
    ranges = narrow.where("size > 0").groupBy("__sk", "size", part.alias("__part")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__sk", "size").orderBy("__part"))
    last = (
        ranges.withColumn("upto", upto).join(extra.where("extra > 0"), ["__sk", "size"])
        .where("upto >= extra AND upto - n < extra")
        .select("__sk", "size", "__part", (F.col("extra") - F.col("upto") + F.col("n")).alias("rank"))
    )
    last = common.sized(common.stash(last), F.octet_length("__sk"))
    inside = narrow.withColumn("__part", part).join(last, ["__sk", "size", "__part"]).groupBy("__sk", "size", "__part", "rank", "__h").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__sk", "size", "__part").orderBy("__h"))
    cuts = inside.withColumn("upto", upto).where("upto >= rank AND upto - n < rank")
    cuts = common.stash(cuts.select("__sk", "size", "__part", F.col("__h").alias("__cut"), (F.col("rank") - F.col("upto") + F.col("n")).alias("__some"), F.col("n").alias("__all")))
    out = keyed.join(plan.select("__sk", "__n", "__target", "__whole"), "__sk").join(common.sized(cuts, F.octet_length("__sk")), ["__sk", "size"], "left")
    more = F.when(F.col("__part").isNull() | (part > F.col("__part")), 0).when((part < F.col("__part")) | (F.col("__h") <= F.col("__cut")), 1).otherwise(0)
    out = out.withColumn("__more", more)
    most_tied = cuts.where("__some < __all").agg(F.max("__all")).first()[0]
    if most_tied:
        tied = F.coalesce((F.col("__h") == F.col("__cut")) & (F.col("__some") < F.col("__all")), F.lit(False))
        out = out.where(~tied).unionByName(_some(out.where(tied), max(1, most_tied // TIED)))
    out = out.withColumn("copies", (F.col("__whole") + F.col("__more")).cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*docs.columns, "size", F.col("__n").alias("source_size"), F.col("__target").alias("target"), "copies", "taken")


def _hashable(field) -> tuple[F.Column, F.Column]:
    """A column as xxhash64 takes it, maps and variants as JSON, and whether it is null, as the hash passes over nulls."""
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column, column.isNull()


def _some(rows: DataFrame, salts: int) -> DataFrame:
    """rows with __more = 1 for __some of each group of equal rows, else 0. The salts are written with the rows, so that counts and numbers see the same ones."""
    keys = ["__sk", "size", "__h"]
    salted = common.stash(rows.drop("__more").withColumn("__salt", (F.rand() * salts).cast("int")))
    counts = salted.groupBy(*keys, "__salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__salt")) - F.col("n")
    counts = counts.select(*keys, "__salt", before.alias("__before"))
    number = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(F.lit(0)))
    joined = salted.withColumn("__number", number).join(counts, [*keys, "__salt"])
    return joined.withColumn("__more", (F.col("__before") + F.col("__number") <= F.col("__some")).cast("int")).drop("__salt", "__number", "__before")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op6_source_mix": op6_source_mix}
