"""Comparing claimed with registered metadata: authors, journals, years, and the verdict ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.functions.similarity import sequence_ratio
from refsieve.functions.text import first_year, folded, has_cjk, shared_ratio, word_set

TITLE_WORDS, TITLE_SEQUENCE = 0.5, 0.9
REGISTRY_AUTHORS = 10
#: Words that journal names are compared without.
JOURNAL_STOP, ABBREV_STOP = ["the", "of", "and", "journal", "j"], ["of", "and", "the", "in", "on", "for"]


def name_parts(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), " ")


def family_name(parts: Column) -> Column:
    """Of a name's parts, "Family AB" or "A Family" or one alone; lower case, without trailing marks; "" for blanks."""
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    initial_first = (F.length(first) == 1) | F.contains(first, F.lit("."))
    picked = F.when((F.size(parts) > 1) & initial_first, last).otherwise(first)
    return F.rtrim(F.lower(F.coalesce(picked, F.lit(""))), F.lit(".,"))


def surname(name: Column) -> Column:
    return family_name(name_parts(name))


def surnames(names: Column) -> Column:
    # Parts first, so that the picking reads a lambda's variable and splits each name once.
    parts = F.transform(names, lambda n: name_parts(n))
    return F.filter(F.transform(parts, lambda p: family_name(p)), lambda s: F.length(s) >= 2)


def with_authors(rows: DataFrame, claimed: str = "claimed_authors", actual: str = "authors") -> DataFrame:
    """``rows`` with author_ran, author_full_skip, author_any_skip, author_hits and author_match of two author lists.

    Names in another script than the registry's carry no signal and are dropped;
    if none is left the check is skipped. A claimed surname hits if it is part of
    a registered one; two hits are needed when two or more are compared. Each
    step is a projection of its own, so that nothing is computed twice.
    """
    c, false = F.col, F.lit(False)
    rows = rows.withColumns({"__ours": surnames(c(claimed)), "__theirs": surnames(F.slice(c(actual), 1, REGISTRY_AUTHORS))})
    some = (F.coalesce(F.size("__ours"), F.lit(0)) > 0) & (F.coalesce(F.size("__theirs"), F.lit(0)) > 0)
    rows = rows.withColumns({"__some": some, "__cjk": has_cjk(F.array_join("__theirs", " ")), "__our_cjk": has_cjk(F.array_join("__ours", " "))})
    rows = rows.withColumn("author_any_skip", F.coalesce(c("__some") & (c("__our_cjk") != c("__cjk")), false))
    rows = rows.withColumn("__kept", F.when(c("author_any_skip"), F.filter("__ours", lambda s: has_cjk(s) == c("__cjk"))).otherwise(c("__ours")))
    rows = rows.withColumn("author_full_skip", c("author_any_skip") & (F.size("__kept") == 0))
    rows = rows.withColumn("author_ran", c("__some") & ~c("author_full_skip"))
    hits = F.size(F.filter("__kept", lambda ours: F.exists("__theirs", lambda theirs: F.contains(theirs, ours))))
    rows = rows.withColumn("author_hits", F.when(c("author_ran"), hits))
    enough = c("author_hits") >= F.when(F.size("__kept") >= 2, 2).otherwise(1)
    return rows.withColumn("author_match", F.coalesce(c("author_ran") & enough, false)).drop("__ours", "__theirs", "__some", "__cjk", "__our_cjk", "__kept")


#: Names of more words are compared by a walk over the words instead of a pattern, whose matcher recurs.
PATTERN_WORDS = 200


def _words_in_order(words: Column, pool: Column) -> Column:
    """Whether each word begins a later word of the pool, taken greedily.

    The words become one pattern: each skips as few words of the pool as it can
    and never gives a place back, so matching is linear and stays in one function.
    """
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"(?>(?:\S+ )*?\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\S*(?: |$))")))
    pattern = F.concat(F.lit("^"), F.array_join(quoted, ""))
    return F.when(F.size(pool) <= PATTERN_WORDS, F.regexp_like(F.array_join(pool, " "), pattern)).otherwise(_walk(words, pool))


def _walk(words: Column, pool: Column) -> Column:
    """The same, word by word; the state is the next place, -1 once failed."""
    n = F.size(pool)

    def step(at: Column, word: Column) -> Column:
        later = F.filter(F.sequence(at, n - 1), lambda k: F.startswith(F.get(pool, k), word))
        return F.when((at < 0) | (at > n - 1), F.lit(-1)).otherwise(F.coalesce(F.try_element_at(later, F.lit(1)) + 1, F.lit(-1)))

    return F.aggregate(words, F.lit(0), step) >= 0


def journal_abbreviates(short: Column, full: Column) -> Column:
    """Whether the words of one name, or their initials if there are two or more, begin words of the other in order."""
    words = lambda c: F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: (w != "") & ~w.isin(ABBREV_STOP))
    ours, theirs = words(short), words(full)
    fits = (F.size(ours) > 0) & (F.size(theirs) > 0) & (F.size(ours) <= F.size(theirs))
    initials = F.transform(ours, lambda w: F.substring(w, 1, 1))
    return F.coalesce(fits & (_words_in_order(ours, theirs) | ((F.size(ours) >= 2) & _words_in_order(initials, theirs))), F.lit(False))


def journal_match(claimed: Column, actual: Column) -> Column:
    a, b = F.lower(F.trim(claimed)), F.lower(F.trim(actual))
    words = lambda c: F.array_except(F.array_distinct(F.split(c, r"\s+")), F.array(*map(F.lit, [*JOURNAL_STOP, ""])))
    ours, theirs = words(a), words(b)
    near = (2 * F.size(F.array_intersect(ours, theirs)) >= F.least(F.size(ours), F.size(theirs))) & (F.size(ours) > 0) & (F.size(theirs) > 0)
    return F.coalesce(F.contains(b, a) | F.contains(a, b) | near | journal_abbreviates(claimed, actual) | journal_abbreviates(actual, claimed), F.lit(False))


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _any(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def compared(rows: DataFrame, sequence: bool = True) -> DataFrame:
    """``rows`` with the comparisons of claimed_* with title, authors, journal and pubdate, all as columns.

    The character similarity runs in Python, for rows only where the words fall
    short and the lengths still allow it; others pass it nulls.
    """
    ct, at = F.col("claimed_title"), F.col("title")
    both = _some(ct) & _some(at)
    skip = both & (has_cjk(ct) != has_cjk(at))
    rows = rows.withColumns({"title_ran": both, "title_skipped": skip, "__cw": F.when(both, word_set(ct)), "__rw": F.when(both, word_set(at))})
    rows = rows.withColumn("__shared", F.size(F.array_intersect("__cw", "__rw")))
    rows = rows.withColumn("word_ratio", F.when(F.col("title_ran") & ~F.col("title_skipped"), shared_ratio(F.col("__shared"), F.size("__cw"), F.size("__rw")))).drop("__cw", "__rw", "__shared")
    if sequence:
        a, b = folded(ct), folded(at)
        may = (2 * F.least(F.length(a), F.length(b)) >= TITLE_SEQUENCE * (F.length(a) + F.length(b))) & (F.col("word_ratio") < TITLE_WORDS)
        rows = rows.withColumns({"seq_a": F.when(may, a), "seq_b": F.when(may, b)})
        rows = rows.withColumn("seq_ratio", sequence_ratio("seq_a", "seq_b")).drop("seq_a", "seq_b")
    else:
        rows = rows.withColumn("seq_ratio", F.lit(None).cast("double"))
    rows = with_authors(rows)
    journal_ran = _some(F.col("claimed_journal")) & _some(F.col("journal"))
    year = first_year(F.col("pubdate"))
    year_ran = _some(F.col("claimed_year")) & (year != "")
    return rows.withColumns(
        {
            "title_match": F.coalesce((F.col("word_ratio") >= TITLE_WORDS) | (F.coalesce(F.col("seq_ratio"), F.lit(0.0)) >= TITLE_SEQUENCE), F.lit(False)),
            "journal_ran": journal_ran,
            "journal_match": journal_ran & journal_match(F.col("claimed_journal"), F.col("journal")),
            "year_ran": year_ran,
            "year_match": year_ran & (F.col("claimed_year") == year),
        }
    )


def graded(rows: DataFrame) -> DataFrame:
    """``compared`` rows with verdict, details, confidence and the four fields (null: not compared)."""
    c = F.col
    checks = sum(c(k).cast("int") for k in ("title_ran", "author_ran", "journal_ran", "year_ran"))
    wins = sum(c(k).cast("int") for k in ("title_match", "author_match", "journal_match", "year_match"))
    title, authors, journal, year = _some(c("claimed_title")), _any(c("claimed_authors")), _some(c("claimed_journal")), _some(c("claimed_year"))
    skipped = c("author_any_skip")
    raw = F.array_join(c("authors"), " ")
    anywhere = F.exists(F.coalesce(c("claimed_authors"), F.array().cast("array<string>")), lambda t: (F.length(t) >= 4) & F.contains(raw, t))
    foreign = authors & ~skipped & ~c("author_match") & (c("author_hits") == 0) & ~F.coalesce(anywhere, F.lit(False)) & c("journal_match")
    miss = lambda when, what: F.when(when, F.lit(what))
    author_miss, journal_miss, year_miss = miss(authors & ~skipped & ~c("author_match"), "author differs"), miss(journal & ~c("journal_match"), "journal differs"), miss(year & ~c("year_match"), "year differs")
    listed = lambda *parts, other="": F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(other))
    # A difference of journals across scripts is reported as one only where both names are of one script.
    far = journal & _some(c("journal")) & (has_cjk(c("claimed_journal")) != has_cjk(c("journal")))
    far_miss = F.when(far & ~c("journal_match"), F.lit("journal skipped (cross-language)")).otherwise(journal_miss)
    steps = [
        (checks == 0, "unknown", F.lit("Insufficient claimed metadata for cross-check")),
        (~title & ~authors, "unknown", F.lit("Insufficient claimed metadata for cross-check")),
        (skipped & ~title & c("journal_match") & c("year_match"), "partial", F.lit("title not claimed (author skipped cross-language); all comparable fields match")),
        (~title, "partial", F.concat(F.lit("title not claimed; "), listed(author_miss, journal_miss, year_miss, other="all comparable fields match"))),
        (c("title_skipped"), "partial", F.concat(F.lit("title skipped (cross-language); "), listed(author_miss, far_miss, year_miss, other="comparable fields match"))),
        (c("title_match") & (c("author_match") | c("journal_match")) & F.coalesce(foreign, F.lit(False)), "partial", F.lit("author set entirely different (mis-attribution)")),
        (c("title_match") & (c("author_match") | c("journal_match")), "correct", listed(miss(~c("author_match") & ~skipped, "author differs slightly"), miss(skipped, "author skipped (cross-language)"), miss(~c("journal_match"), "journal name variant"), other="all metadata matches")),
        (c("author_match") & c("journal_match"), "partial", F.lit("title differs but author+journal match")),
        (c("title_match"), "partial", F.lit("title matches but author/journal not claimed or differ")),
        (F.lit(True), "mismatch", listed(miss(title & ~c("title_match"), "title differs"), miss(~skipped & ~c("author_match"), "author differs"), journal_miss, year_miss)),
    ]
    # The first rule that holds is found once; verdict and details are read off its number.
    rule = F.lit(len(steps) - 1)
    for i in range(len(steps) - 2, -1, -1):
        rule = F.when(steps[i][0], i).otherwise(rule)
    rows = rows.withColumn("__rule", rule)
    details = F.lit(None).cast("string")
    for i, (_, _, text) in enumerate(steps):
        details = F.when(c("__rule") == i, text).otherwise(details)
    verdict = F.get(F.array(*[F.lit(name) for _, name, _ in steps]), c("__rule"))
    compared_authors = authors & _any(c("authors"))
    made = {
        "verdict": verdict,
        "details": details,
        "confidence": F.when(checks > 0, wins / checks).otherwise(0.0),
        "field_title": F.when(c("title_ran") & ~c("title_skipped"), c("title_match")),
        "field_author": F.when(compared_authors & ~c("author_full_skip"), c("author_match")),
        "field_journal": F.when(c("journal_ran") & ~(c("title_skipped") & far & ~c("journal_match")), c("journal_match")),
        "field_year": F.when(c("year_ran"), c("year_match")),
    }
    # One struct a row, unpacked by a generator: a filter on what it gives is not rewritten into all
    # that it is made of, as one on projected columns would be.
    return rows.select(*[x for x in rows.columns if x != "__rule"], F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def cross_check(rows: DataFrame, sequence: bool = True) -> DataFrame:
    return graded(compared(rows, sequence))
