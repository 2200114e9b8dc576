"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. Their shares
of all tokens are water-filled below three times their own size. Blocks of
``block_tokens`` go to sources by highest quotients target / (2 seats + 1), and
each source's seats go to its shards in the same way. Documents of a shard are
laid end to end in seeded order; a shard's quota takes its blocks from the
front, round after round, so that at most one document of a shard is cut.

Everything is a DataFrame operation. Apportionment starts from the proven
lower bound of each party's seats, so only about half as many seats as there
are parties (and a few rows each) are ranked, whatever the corpus size.
Documents are shuffled once, by shard; a shard holds about ``shard_tokens``,
so a source with a third of all rows is dealt over many tasks. A source's shards
are ranked by bins of their quotients where they are many. Sources themselves
are ranked in one task, a row each: millions of them are fine, but a corpus
whose every host is a source should name them more coarsely.

Defined results: null texts have size 0 and take 0; texts of any length count
whole, and one longer than a shard is a shard's own; of equal quotients the first
source or shard wins; a null source is a source of its own; a null id is kept;
repeated rows each count; an empty table gives
an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans import cut

WEIGHTS, MOST_REPEATS = 3, 3
BLOCK_TOKENS, SHARD_TOKENS, SEED = 16, 200_000, "mix-1"
RANKED, BINS = 200_000, 4096


def token_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: source_size, weight and target, from (source, size) rows.

    Water-filling in one pass: by rising cap / weight, a source is capped while
    the level that the rest could reach still exceeds its own.
    """
    # One row per source from here on: windows without a key hold a source table, never documents.
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    placed = sums.withColumn("weight", ((F.row_number().over(order) - 1) % WEIGHTS + 1).cast("double"))
    placed = placed.withColumn("cap", F.col("source_size") * MOST_REPEATS)
    rising = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = placed.withColumn("level", left / F.sum("weight").over(rest))
    # The first source whose cap is not below its share fixes the level for it and all that follow.
    open_ = F.col("cap") >= F.col("weight") * F.col("level")
    first = level.withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    share = F.col("weight") * F.col("final")
    return first.select("source", "source_size", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _matched(rows: DataFrame, by_group: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the columns of their group's row; null is a group like others."""
    named = by_group.withColumnsRenamed({g: f"_of_{g}" for g in group})
    on = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group))
    return rows.join(named, on).drop(*(f"_of_{g}" for g in group))


def _narrowed(tries: DataFrame, group: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(won, open): of each group's tries, in order of quotient and then key, the sure winners and those still to be ranked.

    The span of quotients (or of keys, where all quotients are equal) is cut
    into BINS; bins before the one in which the group's last seat falls have won.
    """
    span = tries.groupBy(*group).agg(F.min("_quotient").alias("_a"), F.max("_quotient").alias("_b"), F.min(key).alias("_i"), F.max(key).alias("_j"))
    by_quotient = (F.col("_b") - F.col("_quotient")) / (F.col("_b") - F.col("_a"))
    by_key = (F.col(key) - F.col("_i")) / (F.col("_j") - F.col("_i") + 1)
    binned = _matched(tries, span, group).withColumn("_bin", F.floor(F.when(F.col("_b") > F.col("_a"), by_quotient).otherwise(by_key) * BINS)).drop("_a", "_b", "_i", "_j")
    binned = cut(binned, "mix-bins")
    # At most BINS + 1 rows a group.
    upto = Window.partitionBy(*group).orderBy("_bin")
    bins = binned.groupBy(*group, "_bin").agg(F.count("*").alias("_m"), F.first("_left").alias("_left")).withColumn("_upto", F.sum("_m").over(upto))
    last = bins.where("_upto >= _left").groupBy(*group).agg(F.min(F.struct("_bin", F.col("_left") - (F.col("_upto") - F.col("_m")))).alias("_last"))
    placed = _matched(binned.drop("_left"), last.select(*group, F.col("_last")["_bin"].alias("_at"), F.col("_last")["col2"].alias("_left")), group)
    return placed.where("_bin < _at").drop("_bin", "_at"), placed.where("_bin = _at").drop("_bin", "_at")


def apportion(parties: DataFrame, group: list[str], keys: list[str], votes: str, seats: str, ranked: int = RANKED) -> DataFrame:
    """Sainte-Lague within each group: adds ``won``, summing to the group's ``seats``.

    A divisor method's seats differ from the exact share q by at most
    q * k / (2 N) + 1/2 with k parties and N seats, so that many below q are
    certain; the few left go to the highest quotients, ties by ``keys``. Where a
    group has more than ``ranked`` such quotients and its one key is a number,
    they are first narrowed to a bin that holds the last seat, so that no
    task ranks a whole group; the seats are the same.
    """
    totals = parties.groupBy(*group).agg(F.count("*").alias("_k"), F.sum(votes).alias("_v"))
    rows = _matched(parties, totals, group)
    share = F.when(F.col("_v") > 0, F.col(seats) * (F.col(votes) / F.col("_v"))).otherwise(0.0)
    slack = F.when(F.col("_v") > 0, F.ceil(F.col(votes) / F.col("_v") * F.col("_k") / 2)).otherwise(0) + 2
    rows = rows.withColumn("_q", share).withColumn("_s", slack)
    rows = cut(rows.withColumn("_low", F.greatest(F.floor("_q") - F.col("_s"), F.lit(0).cast("long"))).drop("_q", "_v", "_k"), "mix-parties")
    given = rows.groupBy(*group).agg((F.first(seats) - F.sum("_low")).alias("_left"), F.sum(F.col("_s") * 2 + 3).alias("_tries"))
    tries = rows.where(F.col(votes) > 0).select(*group, *keys, "_low", "_s", votes)
    tries = tries.select(*group, *keys, votes, F.explode(F.sequence(F.col("_low"), F.col("_low") + F.col("_s") * 2 + 2)).alias("_n"))
    tries = _matched(tries.select(*group, *keys, "_n", (F.col(votes) / (F.col("_n") * 2 + 1)).alias("_quotient")), given.select(*group, "_left"), group)
    sure = None
    if len(keys) == 1 and isinstance(parties.schema[keys[0]].dataType, T.NumericType):
        most = given.agg(F.max("_tries")).first()[0] or 0
        while most > ranked:
            won, tries = _narrowed(tries, group, keys[0])
            sure = won if sure is None else sure.unionByName(won)
            most = tries.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    best = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *keys, "_n")
    got = tries.withColumn("_nth", F.row_number().over(best)).where("_nth <= _left").drop("_nth")
    more = (got if sure is None else got.unionByName(sure)).groupBy(*group, *keys).agg(F.count("*").alias("_more"))
    named = more.withColumnsRenamed({c: f"_of_{c}" for c in (*group, *keys)})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, *keys)))
    return rows.join(named, on, "left").select(*parties.columns, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("won"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    sized = cut(docs.select(F.col(id_col), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = source_targets(sized)
    total = Window.partitionBy(F.lit(0))
    targets = targets.withColumn("seats", F.round(F.sum("target").over(total) / block_tokens).cast("long")).withColumn("one", F.lit(0))
    quotas = apportion(targets, ["one"], ["source"], "target", "seats").drop("seats", "one")
    quotas = cut(quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1))), "mix-quotas")

    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    shard = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("shards"))
    joined = sized.withColumn("key", key).join(quotas, sized["source"].eqNullSafe(quotas["source"]), "left").drop(quotas["source"])
    dealt = joined.withColumn("shard", shard)

    # Quotas per shard from (source, shard) sums; the sums are small and pre-aggregated before their shuffle.
    sums = cut(dealt.groupBy("source", "shard").agg(F.sum("size").alias("tokens"), F.first("won").alias("source_won")), "mix-shards")
    per_shard = apportion(sums, ["source"], ["shard"], "tokens", "source_won").select("source", "shard", "tokens", F.col("won").alias("quota"))

    # Rows without words take nothing wherever they lie, so they need not meet: any number of them may share a shard.
    lies = F.when(F.col("size") == 0, F.xxhash64("key"))
    laid = Window.partitionBy("source", "shard", lies).orderBy("key", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(laid))
    rows = placed.join(per_shard.withColumnsRenamed({"source": "s2", "shard": "h2"}), F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")), "left")
    blocks = F.ceil(F.col("tokens") / block_tokens)
    rounds = F.when(blocks > 0, F.least(F.floor(F.col("quota") / blocks), F.lit(MOST_REPEATS))).otherwise(0)
    cut_at = F.when(rounds < MOST_REPEATS, (F.col("quota") - rounds * blocks) * block_tokens).otherwise(0)
    part = F.greatest(F.least(F.col("upto"), cut_at) - (F.col("upto") - F.col("size")), F.lit(0))
    return rows.select(id_col, "size", "source_size", "target", (F.col("size") * rounds + part).cast("long").alias("taken"))
