"""Best representative of each duplicate group by Bayesian fusion with copy detection.

Every group of records makes claims about a few fields. Claims are reduced to one row per group, field and value, with
the set of sources (ways of tying a record to its group) that say so and the newest record that does; all values of all
sources vote. A row holds at most as many sources as there are, however many records the group has, and the reduction
combines on the map side.

On these rows the operator alternates, until accuracies and dependences stand still, between
  1. the posterior of every value: the log-odds votes of its sources, each discounted by the probability that it copied a
     more accurate source that says the same;
  2. the accuracy of every source: the mean posterior of what it says;
  3. the dependence of every pair of sources: of the values that one of them says and that another value of the group
     beats, the share that the other says too, against what chance would give. Shared true values are no evidence.
Age and rank have no vote; the newest claim is only preferred among equally probable values. Groups in which all
agree count by their set of sources, so a round reads the sets and the disputed groups, not all claims. Only accuracies
(a row per source) and dependences (a row per pair of sources) reach the driver.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.session import keep

#: Stand-ins for "no value", compared in lower case without surrounding white space.
STAND_INS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "undefined", "unknown", "?", "nan", "(no place)", "no place", "(none)", "(unknown)", "(null)", "tbd", "0", "#")


def usable_id(value: Column) -> Column:
    """The id where it is whole: digits only, at least 12 of them, not all alike; else null."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^[0-9]{12,}$") & ~trimmed.rlike(r"^([0-9])\1*$"), trimmed)


def usable_url(value: Column) -> Column:
    """The address where it points to a post: a host, and a path whose last segment has a digit; else null."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"(?i)^https?://[^/?#\s]+\.[^/?#\s]+/(?:[^?#\s]*/)?[^/?#\s]*[0-9][^/?#\s]*/?(?:[?#]\S*)?$"), trimmed)


def usable_name(value: Column) -> Column:
    """The name where it is one: a letter or digit in it, and no stand-in; else null."""
    trimmed = F.trim(F.regexp_replace(value, r"[\p{Z}\p{C}]+", " "))
    return F.when(~F.lower(trimmed).isin(*STAND_INS) & trimmed.rlike(r"[\p{L}\p{N}]"), trimmed)


def url_key(value: Column) -> Column:
    """What two spellings of one post's address share: host without ``m.`` or ``www.``, and path."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"[?#].*$", "")), r"^https?://(?:m\.|www\.)?|/$", "")


def claims(observations: DataFrame, records: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per group, field and distinct value: group, field, key, says (the sources, sorted), top, rank.

    ``observations``: group, record, source, rank, seen. ``records``: record and the columns that ``fields`` names;
    ``fields`` maps a field's name to its usable value and to the key under which values count as equal. ``top`` is the
    newest claim (seen, minus rank, minus record, value), of one time the one of the strongest rank, then of the smallest
    record; ``rank`` is the strongest rank of any claim of the value. Repeated rows, null groups and null records are
    disregarded; groups seen in fewer than two distinct records make no claims. A null rank counts as the last, a null
    time as the first.
    """
    seen = observations.where("group IS NOT NULL AND record IS NOT NULL").select(
        "group", "record", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"),
        F.coalesce(F.unix_micros("seen"), F.lit(-(2**62))).alias("seen"),
    )
    several = seen.groupBy("group").agg(F.min("record").alias("_a"), F.max("record").alias("_b")).where("_a <> _b").select("group")
    values = records.select("record", *[F.struct(value.alias("value"), key.alias("key")).alias(f"f_{name}") for name, (value, key) in fields.items()]).where(
        reduce(operator.or_, [F.col(f"f_{name}.value").isNotNull() for name in fields])
    )
    values = values.groupBy("record").agg(*[F.min(f"f_{name}").alias(f"f_{name}") for name in fields])
    each = F.filter(F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"f_{name}.value").alias("value"), F.col(f"f_{name}.key").alias("key")) for name in fields]), lambda x: x.value.isNotNull())
    said = seen.join(values, "record").select("group", "source", "rank", "seen", "record", F.inline(each))
    newest = F.struct(F.col("seen"), (-F.col("rank")).alias("rank"), (-F.col("record")).alias("record"), F.col("value"))
    distinct = said.groupBy("group", "field", "key").agg(F.sort_array(F.collect_set("source")).alias("says"), F.max(newest).alias("top"), F.min("rank").alias("rank"))
    # Only now are there few rows per group, however many records it has.
    return distinct.join(several, "group", "left_semi")


def _score(says: Column, accuracy: dict[str, float], dependence: dict[tuple[str, str], float], n_false: int, copy_rate: float, prior_copy: float) -> Column:
    """Sum of the votes of the sources, the most accurate first, later ones discounted for what they may have copied."""
    weights = {s: math.log(n_false * a / (1 - a)) for s, a in accuracy.items()}
    vote = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    told = {pair: d for pair, d in dependence.items() if abs(d - prior_copy) > 0.005}
    tie = F.create_map(*[F.lit(x) for (a, b), d in told.items() for x in (f"{a}\0{b}", d)]) if told else None

    def copied(a: Column, b: Column) -> Column:
        pair = F.concat_ws("\0", F.least(a, b), F.greatest(a, b))
        return F.coalesce(tie[pair], F.lit(prior_copy)) if tie is not None else F.lit(prior_copy)

    if vote is None:
        return F.lit(0.0)
    ranked = F.array_sort(F.transform(says, lambda s: F.struct((-F.coalesce(vote[s], F.lit(0.0))).alias("vote"), s.alias("source"))))

    def discounted(c: Column, i: Column) -> Column:
        before = F.slice(ranked, F.lit(1), i)
        return -c.vote * F.aggregate(before, F.lit(1.0), lambda p, b: p * (1 - F.lit(copy_rate) * copied(b.source, c.source)))

    return F.aggregate(F.transform(ranked, discounted), F.lit(0.0), lambda s, x: s + x)


def _dependence(successes: float, trials: float, accuracy: float, n_false: int, copy_rate: float, prior_copy: float) -> float:
    """Probability that one of two sources copies the other, from how many of the false values of either both say."""
    chance = (1 - accuracy) / n_false
    copying = copy_rate + (1 - copy_rate) * chance
    evidence = successes * math.log(copying / chance) + (trials - successes) * math.log((1 - copying) / (1 - chance))
    return 1 / (1 + (1 - prior_copy) / prior_copy * math.exp(-max(-60.0, min(60.0, evidence))))


def fuse(
    claimed: DataFrame, rounds: int = 25, n_false: int = 20, copy_rate: float = 0.8, prior_accuracy: float = 0.8, prior_copy: float = 0.1, still: float = 0.002
) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float]]:
    """Fused groups, source accuracies and pairwise dependences.

    The first is one row per group and field: group, field, values (how many differ), best (seen, rank, record, value of
    the newest claim of the most probable value), posterior, newest (the same of the newest claim of any value) and
    strongest (the strongest rank of any claim). Rounds end when nothing moves by more than ``still``. Accuracies are kept
    within [2 / (n_false + 1), 0.99]. An empty input gives an empty result and no accuracies.
    """
    claimed = keep(claimed)
    groups = claimed.groupBy("group", "field").agg(
        F.min("key").alias("_a"), F.max("key").alias("_b"), F.count("*").alias("values"), F.max("top").alias("newest"), F.min("rank").alias("strongest"), F.first("says").alias("says"), F.first("top").alias("best")
    )
    groups = keep(groups)
    disputed = groups.where("values > 1").select("group", "field", "values")
    rows = claimed.join(disputed, ["group", "field"])
    every = rows.select("group", "field", F.explode("says").alias("s")).groupBy("group", "field").agg(F.collect_set("s").alias("all"))
    rows = keep(rows.join(every, ["group", "field"]).select("group", "field", "key", "values", "says", "all", "top"))
    agreed = keep(groups.where("values = 1").groupBy("says").agg(F.count("*").alias("n")))
    sources = [r.s for r in agreed.select(F.explode("says").alias("s")).union(rows.select(F.explode("says").alias("s"))).distinct().collect()]
    accuracy, dependence = dict.fromkeys(sources, prior_accuracy), {}
    low, high = 2 / (n_false + 1), 0.99

    def posteriors(table: DataFrame) -> DataFrame:
        """Disputed rows with the posterior of each value; the values nobody claims weigh exp(0) each."""
        scored = table.withColumn("e", F.exp(_score(F.col("says"), accuracy, dependence, n_false, copy_rate, prior_copy)))
        total = scored.groupBy("group", "field").agg((F.sum("e") + F.greatest(F.lit(float(n_false + 1)) - F.max("values"), F.lit(0.0))).alias("z"))
        return scored.join(total, ["group", "field"]).withColumn("p", F.col("e") / F.col("z")).drop("e", "z")

    def agreed_posterior() -> Column:
        e = F.exp(_score(F.col("says"), accuracy, dependence, n_false, copy_rate, prior_copy))
        return e / (e + n_false)

    for _ in range(rounds if sources else 0):
        one = agreed.select(agreed_posterior().alias("p"), F.col("n").cast("double").alias("n"), F.lit(False).alias("false"), "says", F.col("says").alias("all"))
        several = posteriors(rows).select("p", F.lit(1.0).alias("n"), (F.col("p") < 0.5).alias("false"), "says", "all")
        # What each source says, and for what it says in vain, who else of the group says it too.
        heard = F.transform("says", lambda a: F.struct(a.alias("a"), a.alias("b"), F.col("p").alias("hit")))
        vain = F.flatten(
            F.transform("says", lambda a: F.transform(F.filter("all", lambda b: b != a), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.array_contains("says", b).cast("double").alias("hit"))))
        )
        counts = one.unionByName(several).select("n", F.inline(F.concat(heard, F.when(F.col("false"), vain).otherwise(F.array().cast("array<struct<a:string,b:string,hit:double>>")))))
        sums = counts.groupBy("a", "b").agg(F.sum(F.col("hit") * F.col("n")).alias("hits"), F.sum("n").alias("n")).collect()
        before = (accuracy, dependence)
        accuracy = {r.a: min(high, max(low, (r.hits + prior_accuracy * 10) / (r.n + 10))) for r in sums if r.a == r.b}
        dependence = {(r.a, r.b): _dependence(r.hits, r.n, (accuracy[r.a] + accuracy[r.b]) / 2, n_false, copy_rate, prior_copy) for r in sums if r.a != r.b}
        moved = [abs(x - before[0].get(s, 0.0)) for s, x in accuracy.items()] + [abs(x - before[1].get(s, prior_copy)) for s, x in dependence.items()]
        if max(moved, default=0.0) <= still:
            break

    columns = ["group", "field", "values", "best", "posterior", "newest", "strongest"]
    alone = groups.where("values = 1").withColumn("posterior", agreed_posterior()).select(*columns)
    winners = posteriors(rows).groupBy("group", "field").agg(F.max(F.struct("p", "top")).alias("w"))
    chosen = groups.where("values > 1").drop("best").join(winners, ["group", "field"]).select("*", F.col("w.top").alias("best"), F.col("w.p").alias("posterior")).select(*columns)
    plain = lambda c: F.struct(F.col(f"{c}.seen").alias("seen"), (-F.col(f"{c}.rank")).alias("rank"), (-F.col(f"{c}.record")).alias("record"), F.col(f"{c}.value").alias("value"))
    return alone.unionByName(chosen).withColumns({"best": plain("best"), "newest": plain("newest")}), accuracy, dependence


def undisputed(fused: DataFrame) -> DataFrame:
    """The exact check on fused groups: group, field, record of the newest claim where no claim is of a stronger rank.

    ``agrees`` tells whether that claim is of the most probable value.
    """
    chosen = fused.where(F.col("newest.rank") == F.col("strongest"))
    return chosen.select("group", "field", F.col("newest.record").alias("record"), (F.col("newest.value") == F.col("best.value")).alias("agrees"))
