"""Quality rules whose cutoffs are certified on labelled holdouts by exact binomial bounds (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, discard, materialize

#: Symbols that the base features count.
SYMBOLS = "#*$%&|<>"
#: rule -> (statistic per mille from the feature columns, candidate cutoffs from lenient to strict); a rule rejects above its cutoff.
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", [2000, 1000, 500, 300, 200, 100, 50, 20]),
    "long_words": ("word_chars * 1000 div greatest(n_words, 1)", [12000, 10000, 9000, 8000, 7500, 7000, 6500]),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", [900, 800, 700, 600, 500, 400]),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", [480, 450, 400, 350, 300]),
}
#: Most false rejections by all certified rules of a stratum together, the chance that any stratum's bound is wrong, and the cost of
#: a false rejection when a cutoff is chosen.
ALPHA, DELTA, COST = 0.02, 0.05, 4
#: Broadcast the thresholds up to so many strata; beyond, they are joined.
MAX_BROADCAST_STRATA = 5000


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed (longs, boolean).

    A null text counts as empty: all counts are 0 and the base rule fails it. Existing columns
    of these names are replaced. Whole texts are read, whatever their length.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__w", F.filter(F.split(text, SPACE_CLASS), lambda w: w != ""))
    df = df.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)))
    n = F.size("__w")
    at = lambda i, k: F.get("__w", i + k)
    places = F.sequence(F.lit(0), n - 3)
    df = df.withColumn("__h", F.when(n >= 3, F.transform(places, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))).otherwise(F.array().cast("array<bigint>")))
    # where two hashes agree, every 3-word window with its place; equal windows are neighbours after the sort
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    windows = F.when(some, F.transform(places, lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("w"), i.alias("i")))).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    df = df.withColumn("__s", F.sort_array(windows))
    s = F.col("__s")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
    df = df.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x)
    features = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_CLASS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    # a generator, so that filters on the features aren't pushed below it, where each would compute them again
    df = df.select(*docs.columns, F.inline(F.array(features)))
    return df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly summed term by term in logarithms. Its being at most d is the same
    as the one-sided exact upper bound on the rate, at confidence 1 - d, being at most p."""
    import math

    odds, q = math.log(p) - math.log1p(-p), math.log1p(-p)
    first = F.struct((n * q).alias("t"), F.exp(n * q).alias("s"))

    def add(a, j):
        t = a["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), first, add)["s"]


def _statistics() -> Column:
    return F.array(*(F.expr(stat).cast("long") for stat, _ in RULES.values()))


def thresholds(rows: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """stratum, rule, cutoff, place: the certified cutoffs of ``rows`` (doc_id, the stratum, features). Strata without one have no row.

    Labelled documents that pass the base rule are split by the parity of crc32(doc_id). The even half chooses for each
    stratum and rule the cutoff with the largest gain (bad rejected minus COST times good rejected; ties: the most lenient),
    drops rules without a gain, and orders the others by their gain. The odd half certifies: the rules join one after
    the other, and as long as the exact upper bound on the share of good documents that the rules so far reject
    together is at most ALPHA, at level DELTA / (strata that test anything), the next one may join. A fixed
    sequence needs no further correction, and the bound holds for the rules of a stratum together. A document whose
    labels contradict each other or are null isn't used; repeated labels count once. A null stratum is a stratum.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__q")).where("__id is not null").groupBy("__id").agg(F.min("__q").alias("__good"), F.max("__q").alias("__max")).where("__good = __max and __good in (0, 1)")
    own = rows.where("not base_failed").select("doc_id", F.col(stratum).cast("string").alias("stratum"), _statistics().alias("stats")).join(known, F.col("doc_id") == F.col("__id"))
    own = materialize(own.select("stratum", F.col("__good").alias("good"), (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"), "stats"), "quality-labelled")
    candidates = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(c).cast("long").alias("cutoff"), (F.get("stats", F.lit(i)) > c).cast("long").alias("hit")) for i, (_, cuts) in enumerate(RULES.values()) for c in cuts))
    flat = own.where("half = 0").select("stratum", "good", F.explode(candidates).alias("c"))
    worth = F.sum(F.when(F.col("good") == 1, -COST).otherwise(1) * F.col("c.hit"))
    gains = flat.groupBy("stratum", "c.rule", "c.cutoff").agg(worth.alias("gain"))
    best = gains.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b")).where("b.gain > 0")
    path = best.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct((-F.col("b.gain")).alias("order"), "rule", F.col("b.cutoff").alias("cutoff")))).alias("path"))
    path = materialize(path, "quality-paths")
    strata = path.count()
    # the place of the first rule that rejects a good document; a rule's joint rejections are those up to its place
    judged = own.where("half = 1 and good = 1").alias("o").join(path.withColumnRenamed("stratum", "__s"), F.col("stratum").eqNullSafe(F.col("__s")))
    hits = F.transform("path", lambda p: F.get("stats", p["rule"]) > p["cutoff"])
    judged = judged.select("__s", F.array_position(hits, True).alias("first")).groupBy("__s", "first").agg(F.count(F.lit(1)).alias("n"))
    judged = judged.groupBy("__s").agg(F.sum("n").alias("n"), F.collect_list(F.struct("first", "n")).alias("by"))
    joint = lambda place: F.aggregate(F.filter("by", lambda x: (x["first"] > 0) & (x["first"] <= place)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    steps = path.join(judged, F.col("stratum").eqNullSafe(F.col("__s"))).select("stratum", "n", "by", F.posexplode("path").alias("i", "p"))
    steps = steps.select("stratum", "n", (F.col("i") + 1).alias("place"), "p.rule", "p.cutoff", joint((F.col("i") + 1).cast("long")).alias("k"))
    level = DELTA / max(strata, 1)
    fails = steps.where(binomial_tail(F.col("k"), F.col("n"), ALPHA) > level).groupBy("stratum").agg(F.min("place").alias("stop")).withColumnRenamed("stratum", "__s")
    good = steps.join(fails, F.col("stratum").eqNullSafe(F.col("__s")), "left").where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    names = F.array(*(F.lit(r) for r in RULES))
    out = materialize(good.select("stratum", F.get(names, F.col("rule")).alias("rule"), "cutoff", "place"), "quality-cutoffs")
    discard(own, path)
    return out


def score(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the features, base_failed, rules_hit (array of rule names) and kept.

    kept: the base rule passes and no certified rule of the document's stratum rejects it. In
    a stratum too small to certify anything only the base rule rejects. The features are computed once and written with the
    columns to keep; columns of ``docs`` with their names are replaced. Empty tables give no rows; without labels only the base
    rule works.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*own, "rules_hit", "kept")]
    used = dict.fromkeys([*keep, "doc_id", stratum, "text"])
    rows = materialize(with_features(docs.select(*used)).select(*dict.fromkeys([*keep, "doc_id", stratum]), *own), "quality-features")
    found = thresholds(rows.select("doc_id", stratum, *own), labels, stratum)
    table = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))
    table = table.select(F.col("stratum").alias("__stratum"), "__cut")
    if table.count() <= MAX_BROADCAST_STRATA:
        table = F.broadcast(table)
    df = rows.join(table, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left")
    cut = F.col("__cut")
    hits = F.array_compact(F.array(*(F.when(F.expr(stat) > F.try_element_at(cut, F.lit(r)), F.lit(r)) for r, (stat, _) in RULES.items())))
    df = df.withColumn("rules_hit", hits).withColumn("kept", ~F.col("base_failed") & (F.size("rules_hit") == 0))
    return df.select(*keep, *own, "rules_hit", "kept")
