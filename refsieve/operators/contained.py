"""Which texts hold which titles as they are: a positional index of character grams.

The grams of ``GRAM`` characters of all texts are counted in ``BUCKETS`` buckets of
their hash, which bounds the table of counts. A title asks by the one of its own
grams whose bucket counts least, and only if no bucket of its grams is empty. Of
the texts, only grams whose bucket a title asks for are shuffled. The place of that
gram in the title and in the text says where the title would begin; the grams just
before and after it must agree there, too, and then the title is compared. So a
shared opening or a common word costs nothing, and a title that begins or ends
inside a word of the text is found. Hashes only choose what is compared.

Nulls and titles shorter than a gram are held by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.operators.durable import written

c = F.col

GRAM = 6
#: Buckets of the counts and of what is asked for; both are broadcast, about 30 MB at most. They set the work, not the result.
BUCKETS = 1 << 20
_SHIFT = 1 << 32


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def grams(text: Column) -> Column:
    """The hashes of a text's grams, in order of their places."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.transform(places, lambda i: F.xxhash64(F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<bigint>"))


def placed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, gram, before, after, bucket): the grams of each text, places from 1, with those ``GRAM`` places before and after (null: none)."""
    none = F.array_repeat(F.lit(None).cast("bigint"), GRAM)
    hashed = rows.select(key, grams(c(text)).alias("gram")).where(F.size("gram") > 0)
    beside = hashed.select(key, "gram", F.slice(F.concat(none, "gram"), F.lit(1), F.size("gram")).alias("before"), F.slice(F.concat("gram", none), F.lit(GRAM + 1), F.size("gram")).alias("after"))
    each = beside.select(key, F.posexplode(F.arrays_zip("gram", "before", "after")).alias("p", "x"))
    return each.select(key, (c("p") + 1).alias("at"), "x.gram", "x.before", "x.after", _bucket(c("x.gram")).alias("bucket"))


def candidates(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(nid, tid, start): where a title (nid, title) would begin in a text (tid, text), by its rarest gram and those beside it."""
    all_grams = texts.select(F.explode(grams(c("text"))).alias("gram"))
    counts = written(all_grams.groupBy(_bucket(c("gram")).alias("bucket")).agg(F.count("*").alias("df")), "gram-counts")
    known = placed(titles, "nid", "title").select("nid", "at", "bucket").join(F.broadcast(counts), "bucket", "left")
    # The count and the place in one number: numbers are combined before the shuffle.
    rarest = known.groupBy("nid").agg(F.min(F.coalesce("df", F.lit(0)) * _SHIFT + c("at")).alias("x")).where(c("x") >= _SHIFT)
    rarest = rarest.select("nid", F.pmod("x", F.lit(_SHIFT)).cast("int").alias("own")).join(titles, "nid")
    piece = lambda at: F.when((at >= 1) & (at + GRAM - 1 <= F.length("title")), F.xxhash64(F.substr("title", at, F.lit(GRAM))))
    rarest = written(rarest.select("nid", "own", piece(c("own")).alias("gram"), piece(c("own") - GRAM).alias("own_before"), piece(c("own") + GRAM).alias("own_after")), "gram-keys")
    asked = rarest.select(_bucket(c("gram")).alias("bucket")).distinct()
    held = placed(texts, "tid", "text").join(F.broadcast(asked), "bucket", "left_semi")
    alike = lambda ours, theirs: c(ours).isNull() | F.coalesce(c(ours) == c(theirs), F.lit(False))
    met = held.join(rarest, "gram").where((c("at") >= c("own")) & alike("own_before", "before") & alike("own_after", "after"))
    return met.select("nid", "tid", (c("at") - c("own") + 1).alias("start"))


def contained(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(nid, tid): the texts (tid, text) that hold each title (nid, title)."""
    pairs = candidates(titles, texts).join(titles, "nid").join(texts, "tid")
    return pairs.where(F.substr("text", "start", F.length("title")) == c("title")).select("nid", "tid").distinct()
