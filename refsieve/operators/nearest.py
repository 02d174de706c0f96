"""The registered titles that share most words with each claimed one: an exact top-k join by Jaccard, bound by scores.

Passes go down a ladder of scores t. A pass finds, for the sets of words still
asked about, every record at t or more; a set with as many as wanted leaves, as
no record below t can beat them. The last pass takes all records that share a
word, so nothing is lost.

What passes compare are classes, not records. Words that at most ``RARE`` records
hold are met one by one, and the few records met so are scored by all words. No
other record shares such a word with the set, so to the set all records of one
number of words and the same frequent words are alike: they score the same, and
the first in order stand for them. Sets of the same frequent words and number of
words ask once. Copies, and titles that differ by a number of their own, so cost
one class however many they are; a class's score never exceeds a record's own.

A pass never pairs records on a word alone if it can help it. Words have one
order, from rare to common. A set of n words and a record of s at t share at
least need = t (n + s) / (1 + t) words, all of them frequent, so of the set's m
frequent ones the first in that order is among the first m - need + 1, and the
first two among the first m - need + 2.
A set asks by single words or by pairs of words, whichever lists its own words'
counts make out to be shorter; records are listed under both. Lists are also by
the record's number of words, so that a common word meets only records of a size
that can reach t. Of what meets, the words left behind the place on either side,
and a sketch of 64 bits of each set, bound the overlap; only pairs that pass both
are scored by their words.

Sets and records without words match nothing. Ties go to the record first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refsieve.functions.text import jaccard, shared_ratio
from refsieve.operators.durable import written

c = F.col

#: Scores of the passes. They set the work, not the result.
LADDER = (0.7, 0.5, 0.35, 0.2, 0.1, 0.05, 0.02)
#: From this score on, records are listed under pairs of words, too.
PAIRED = 0.2
#: Words that so many records hold at most are met one by one. It sets the work, not the result.
RARE = 8
#: Rounding of need: a score just at t is never lost.
_SLACK = 1e-9


def _need(n: Column, s: Column, t: float) -> Column:
    return F.greatest(F.ceil((n + s) * F.lit(t / (1 + t)) - _SLACK).cast("int"), F.lit(1))


def _sketch(words: Column) -> Column:
    """64 bits: one for each word, by its hash."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def _lost() -> Column:
    """How many words of ``held`` its sketch does not tell apart."""
    return F.size("held") - F.bit_count("sketch")


def word_counts(index: DataFrame) -> DataFrame:
    """(w, df): how many records hold each word."""
    return index.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def placed(rows: DataFrame, key: str, words: str, counts: DataFrame) -> DataFrame:
    """(key, words, n, held, sketch): ``held`` has the words as (df, w), from rare to common; n is that of ``rows``, else how many they are."""
    keys = [key, *(["n"] if "n" in rows.columns else [])]
    each = rows.select(*keys, F.explode(words).alias("w")).join(counts, "w", "left").select(*keys, F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w").alias("x"))
    held = each.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("held"))  # as many as a title has words
    n = c("n") if "n" in rows.columns else F.size("held").alias("n")
    return held.select(key, F.transform("held", lambda x: x["w"]).alias("words"), n, "held", _sketch(F.transform("held", lambda x: x["w"])).alias("sketch"))


def cores(rows: DataFrame, key: str, words: str, frequent: DataFrame) -> DataFrame:
    """(key, n, core): the frequent ones of each row's n words, in order; rows without any are left out."""
    each = rows.select(key, F.size(words).alias("n"), F.explode(words).alias("w")).join(frequent.select("w"), "w", "left_semi")
    return each.groupBy(key, "n").agg(F.sort_array(F.collect_list("w")).alias("core"))


def record_classes(index: DataFrame, frequent: DataFrame, most: int) -> DataFrame:
    """(found, core, n, firsts): records of n words and the same frequent words, numbered (found), with the first ``most`` of them."""
    order = Window.partitionBy("core", "n").orderBy("found")
    first = cores(index, "found", "words", frequent).withColumn("k", F.row_number().over(order)).where(c("k") <= most)
    firsts = first.groupBy("core", "n").agg(F.sort_array(F.collect_list("found")).alias("firsts"))
    return firsts.withColumn("found", F.monotonically_increasing_id())


def by_rare_words(sets: DataFrame, index: DataFrame, frequent: DataFrame, least: float) -> DataFrame:
    """(qid, direct): the records at ``least`` or more that share a word with the set which is not frequent, as (-score, found)."""
    rare = lambda rows, words: rows.withColumn("w", F.explode(words)).join(frequent.select("w"), "w", "left_anti")
    pairs = rare(sets.select("qid", "q"), "q").join(rare(index.select("found", "words"), "words"), "w")
    scored = pairs.select("qid", "found", jaccard(c("q"), c("words")).alias("score")).where(c("score") >= least)
    return scored.groupBy("qid").agg(F.collect_set(F.struct((-c("score")).alias("below"), "found")).alias("direct"))  # RARE for each word at most


def _pairs(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of (m, p, x), all words' number, the place and word, once for each earlier word, under both."""
    two = rows.select(*keep, "m", "p", c("x.w").alias("w"), F.explode(F.slice("held", 1, c("p"))).alias("before"))
    return two.select(*keep, (c("m") - c("p") + 1).alias("reach"), F.concat_ws(" ", "before.w", "w").alias("sig"))


def _singles(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, (c("m") - c("p")).alias("reach"), c("x.w").alias("sig"))


def asked_lists(sets: DataFrame, sizes: list[int], records: int, t: float) -> DataFrame:
    """(qid, n, s, need, sketch, lost, reach, sig): the lists that each set asks for, for each size of record that can reach t."""
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda s: (s >= c("n") * t - _SLACK) & (s * t <= c("n") + _SLACK))
    rows = sets.withColumn("s", F.explode(fits)).withColumn("need", _need(c("n"), c("s"), t)).withColumns({"m": F.size("held"), "lost": _lost()}).where("need <= m and need <= s")
    # Spark may take a slice before the filter, so no length is negative.
    one, two = F.greatest(c("m") - c("need") + 1, F.lit(0)), F.greatest(c("m") - c("need") + 2, F.lit(0))
    df = F.transform("held", lambda x: x["df"].cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    first = F.slice(df, F.lit(1), two)
    squares = total(F.transform(first, lambda v: v * v))
    paired = (c("need") >= 2) & ((total(first) * total(first) - squares) / (2 * max(records, 1)) + two * (two - 1) / 2 < total(F.slice(df, F.lit(1), one)))
    rows = rows.withColumn("paired", paired if t >= PAIRED else F.lit(False))
    keep = ["qid", "n", "s", "need", "sketch", "lost"]
    at = rows.select(*keep, "m", "held", "paired", F.posexplode(F.slice("held", F.lit(1), F.when(c("paired"), two).otherwise(one))).alias("p", "x"))
    # A word that no record holds has no list.
    at = at.where("x.df > 0")
    return _singles(at.where("not paired"), keep).union(_pairs(at.where("paired"), keep))


def listed(index: DataFrame, t: float) -> DataFrame:
    """(found, s, its_sketch, its_lost, its_reach, sig): the records' lists, for sets of any size."""
    least = F.greatest(F.ceil(c("n") * t - _SLACK).cast("int"), F.lit(1))
    at = index.select("found", "n", F.size("held").alias("m"), "held", "sketch", _lost().alias("lost"), least.alias("least"), F.posexplode("held").alias("p", "x"))
    keep = ["found", "n", "sketch", "lost"]
    lists = _singles(at.where("p <= m - least"), keep)
    if t >= PAIRED:
        lists = lists.union(_pairs(at.where("p <= m - least + 1"), keep))
    return lists.withColumnsRenamed({"n": "s", "reach": "its_reach", "sketch": "its_sketch", "lost": "its_lost"})


def met(sets: DataFrame, index: DataFrame, sizes: list[int], records: int, t: float) -> DataFrame:
    """(qid, found): pairs that share a list and that no bound keeps below t."""
    pairs = asked_lists(sets, sizes, records, t).join(listed(index, t), ["sig", "s"])
    both = F.bit_count(c("sketch").bitwiseAND(c("its_sketch")))
    # Words of one set that fall on one bit are counted once by the sketches, so what either lost that way is added.
    bound = F.least(c("reach"), c("its_reach"), both + F.least("lost", "its_lost"))
    return pairs.where(bound >= c("need")).select("qid", "found").distinct()


def nearest(sets: DataFrame, index: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """(q, found, score, rank): the ``most`` records of ``index`` (found, words) that are nearest to each distinct set ``q`` of ``sets``.

    Only records at ``least`` or more count; at 0, all that share a word.
    """
    index = index.where(F.size("words") > 0)
    frequent = written(word_counts(index).where(c("df") > RARE), "title-words")
    numbered = written(sets.where(F.size("q") > 0).select("q").distinct().withColumn("qid", F.monotonically_increasing_id()), "title-sets")
    asked = written(cores(numbered, "qid", "q", frequent), "title-cores")
    kinds = written(asked.select("core", "n").distinct().withColumn("kind", F.monotonically_increasing_id()), "title-kinds")
    records = written(record_classes(index, frequent, most), "title-classes")
    near = kinds.join(nearest_classes(kinds.withColumnRenamed("kind", "qid"), records, most, least), kinds["kind"] == c("qid")).select("core", "n", "near")
    near = asked.join(near, ["core", "n"]).select("qid", "near")
    found = numbered.join(by_rare_words(numbered, index, frequent, least), "qid", "left").join(near, "qid", "left")
    # A record met both ways has its own score from its rare words.
    none = F.array().cast("array<struct<below:double,found:string>>")
    direct, near = F.coalesce("direct", none), F.coalesce("near", none)
    both = F.concat(direct, F.filter(near, lambda x: ~F.array_contains(F.transform(direct, lambda y: y["found"]), x["found"])))
    best = found.select("q", F.posexplode(F.slice(F.array_sort(both), 1, most)).alias("at", "x"))
    return best.select("q", "x.found", (-c("x.below")).alias("score"), (c("at") + 1).alias("rank"))


def nearest_classes(kinds: DataFrame, records: DataFrame, most: int, least: float) -> DataFrame:
    """(qid, near): of the classes ``records``, by the frequent words of ``kinds`` (qid, core, n), the ``most`` nearest records as (-score, found)."""
    counts = written(word_counts(records.select(c("core").alias("words"))), "title-class-words")
    index = written(placed(records, "found", "core", counts).join(records.select("found", "firsts"), "found"), "title-index")
    active = written(placed(kinds, "qid", "core", counts), "title-asked")
    # As many sizes as the longest title has words, at most.
    tally = index.groupBy("n").agg(F.count("*").alias("k")).collect()
    sizes, classes = sorted(r["n"] for r in tally), sum(r["k"] for r in tally)
    out = None
    for t in [*(x for x in LADDER if x > least), least]:
        pairs = met(active, index, sizes, classes, t)
        scored = pairs.join(index.select("found", c("words").alias("theirs"), c("n").alias("s"), "firsts"), "found").join(active.select("qid", "words", "n"), "qid")
        score = shared_ratio(F.size(F.array_intersect("words", "theirs")), c("n"), c("s"))
        scored = written(scored.select("qid", "firsts", score.alias("score")).where(c("score") >= t), "title-scored")
        if t > least:
            done = written(scored.groupBy("qid").agg(F.sum(F.size("firsts")).alias("k")).where(c("k") >= most).select("qid"), "title-done")
            scored = scored.join(done, "qid", "left_semi")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "found")
        best = scored.select("qid", "score", F.explode("firsts").alias("found")).withColumn("rank", F.row_number().over(order)).where(c("rank") <= most)
        out = best if out is None else out.union(best)
        if t > least:
            active = written(active.join(done, "qid", "left_anti"), "title-asked")
            if not active.limit(1).count():
                break
    return out.groupBy("qid").agg(F.collect_list(F.struct((-c("score")).alias("below"), "found")).alias("near"))
