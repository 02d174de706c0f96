"""The verification legs. Each takes work items and registry tables as DataFrames and gives graded rows.

The ordered rewrites of the PMID leg are separate columns steps, because later
ones read what earlier ones set. Registries are tables; live lookups belong in a
job that writes those tables. All joins are equi-joins on an identifier, so
they scale with shuffles, and AQE picks broadcasts by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refsieve.functions.match import TITLE_WORDS, cross_check
from refsieve.functions.similarity import sequence_ratio
from refsieve.functions.text import arxiv_valid, clean_doi, doi_match, folded, has_cjk, keyword_score, path_keywords, retraction_reason, shared_ratio, word_set
from refsieve.operators.contained import GRAM, contained
from refsieve.operators.durable import dealt, written
from refsieve.operators.nearest import nearest
from refsieve.plans.schemas import EXPLICIT_LABELS

c = F.col


def _some(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def keep_first(items: DataFrame, key: str = "id", fold: bool = False) -> DataFrame:
    """One row per id: explicit input before scanned, then input order (A4)."""
    by = F.lower(key) if fold else c(key)
    order = Window.partitionBy(by).orderBy(c("explicit").desc(), "input_ord")
    return items.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def coalesce_sources(first: DataFrame, second: DataFrame, key: str = "pmid") -> DataFrame:
    """Records of the first source, except where it failed by network and the second has the record."""
    other = second.select(key, F.struct(*[x for x in second.columns]).alias("__other"))
    joined = first.join(other, key, "left")
    swap = _true(c("network_error")) & c("__other").isNotNull()
    return joined.select(*[F.when(swap, c("__other")[x]).otherwise(c(x)).alias(x) if x in second.columns else c(x) for x in first.columns])


def capped_splice(verdict: Column, splice: Column) -> Column:
    return F.when(_true(splice) & (verdict == "correct"), "partial").otherwise(verdict)


def capped_retraction(verdict: Column, retracted: Column) -> Column:
    return F.when(_true(retracted) & verdict.isin("correct", "partial"), "partial").otherwise(verdict)


def retraction_details(verdict: Column, details: Column, retracted: Column) -> Column:
    note = F.lit("RETRACTED — do not cite as valid")
    return F.when(_true(retracted) & verdict.isin("correct", "partial"), F.concat(note, F.when(_some(details), F.concat(F.lit("; "), details)).otherwise(""))).otherwise(details)


def with_registry(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items left-joined with their records on pmid; columns of the record keep their names."""
    return items.join(registry.withColumnRenamed("pmid", "id"), "id", "left")


def verify_pmid(items: DataFrame, registry: DataFrame, sequence: bool = True) -> DataFrame:
    """PMID leg: ladder, then unverified, splice, existence, gate, upgrade and caps, in that order."""
    rows = cross_check(with_registry(items, registry), sequence)
    valid = _true(c("valid"))
    title, authors = _some(c("claimed_title")), F.coalesce(F.size("claimed_authors"), F.lit(0)) > 0
    bare = ~title & ~authors
    explicit = c("label").isin(*EXPLICIT_LABELS)
    rows = rows.withColumns({"doi_splice": valid & _some(clean_doi(c("claimed_doi"))) & _some(clean_doi(c("doi"))) & ~doi_match(c("claimed_doi"), c("doi")), "route": F.lit("metadata")})
    steps = [
        # neither title nor authors claimed: the identifier is all that was asked about
        (valid & bare, "correct", F.lit("existence confirmed"), "existence_only", F.lit(1.0)),
        # a scanned mismatch without both title and authors is not an accusation
        (valid & (c("verdict") == "mismatch") & ~(title & authors) & ~explicit, "unknown", F.concat(F.lit("mismatch gated: "), c("details")), "mismatch_gated", c("confidence")),
        (valid & (c("verdict") == "partial") & c("title_match") & ~authors & ~_some(c("claimed_journal")) & ~_some(c("claimed_year")) & ~c("label").isin("cli", "claims") & ~c("explicit"), "correct", F.lit("existence confirmed and title matches"), "existence_title_match", F.greatest(c("confidence"), F.lit(0.8))),
        (~valid & _true(c("network_error")), "unknown", F.lit("registry unreachable (network), never counted as invalid"), "network_error", F.lit(0.0)),
        (~valid & ~_true(c("network_error")), "invalid", F.lit("identifier not found in the registry"), "not_found", F.lit(0.0)),
    ]
    # No two of them hold at once, so the number of the one that does says all.
    hit = F.lit(-1)
    for i, (when, *_) in enumerate(steps):
        hit = F.when(when, i).otherwise(hit)
    rows = rows.withColumn("__hit", hit)
    made = {}
    for at, name in enumerate(("verdict", "details", "route", "confidence"), 1):
        made[name] = c(name)
        for i, step in enumerate(steps):
            made[name] = F.when(c("__hit") == i, step[at]).otherwise(made[name])
    rows = rows.withColumns(made)
    rows = rows.withColumn("verdict", capped_splice(c("verdict"), c("doi_splice")))
    flagged = valid & _true(c("retracted"))
    rows = rows.withColumns({"details": retraction_details(c("verdict"), c("details"), flagged), "verdict": capped_retraction(c("verdict"), flagged), "retracted": flagged, "valid": valid, "network_error": _true(c("network_error"))})
    return rows.withColumns({"confidence": F.bround("confidence", 2), "kind": F.lit("pmid")}).drop("__hit")


def second_opinion(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Gated rows whose title stands verbatim in a registered title: the same record makes them correct, another is a signal.

    Each title is looked up once, however many rows claim it; it may begin or end inside a word.
    """
    # Graded once: the rows are read from what is written, for their titles and for the answer.
    rows = written(rows, "graded-rows")
    gated = _true((c("route") == "mismatch_gated") & (F.size(word_set(c("claimed_title"))) >= 4) & ~has_cjk(c("claimed_title")))
    asked = rows.where(gated).withColumn("__title", folded(c("claimed_title")))
    titles = written(asked.select(c("__title").alias("title")).distinct().withColumn("nid", F.monotonically_increasing_id()), "claimed-titles")
    texts = written(dealt(registry.where("valid").select(c("pmid").alias("tid"), "title")).select("tid", folded(c("title")).alias("text")), "registered-titles")
    held = written(contained(titles, texts), "held-titles")
    least = titles.join(held.groupBy("nid").agg(F.min("tid").alias("other")), "nid").select(c("title").alias("__title"), c("nid").alias("__nid"), "other")
    own = held.select(c("nid").alias("__nid"), c("tid").alias("id"), F.lit(True).alias("__own"))
    met = asked.join(least, "__title", "left").join(own, ["__nid", "id"], "left").withColumn("same", F.when(c("other").isNotNull(), _true(c("__own"))))
    out = met.select(*rows.columns, "same", "other").union(rows.where(~gated).select("*", F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("string").alias("other")))
    return out.withColumns({"wrong_pmid_signal": _true(~c("same")), "suggested": F.when(~c("same"), c("other")), "route": F.when(c("same"), "title_corroborated").otherwise(c("route")), "verdict": F.when(c("same"), "correct").otherwise(c("verdict"))}).drop("same", "other")


def resolved_dois(records: DataFrame, fallback: DataFrame) -> DataFrame:
    """DOI records; the fallback registry is asked only for those not found."""
    other = fallback.where("status = 'resolved'").select("doi", F.struct(*[x for x in fallback.columns if x != "doi"]).alias("__other"))
    joined = records.join(other, "doi", "left")
    swap = (c("status") == "not_found") & c("__other").isNotNull()
    return joined.select("doi", *[F.when(swap, c("__other")[x]).otherwise(c(x)).alias(x) if x in fallback.columns else c(x) for x in records.columns if x != "doi"])


def verify_doi(items: DataFrame, records: DataFrame, registry: DataFrame, sequence: bool = True) -> DataFrame:
    """DOI leg: record, link to PubMed unless that names another DOI, ladder if a title is claimed, cap."""
    record = records.select(clean_doi(c("doi")).alias("id"), "status", c("title").alias("r_title"), c("journal").alias("r_journal"), c("year").alias("r_year"), c("authors").alias("r_authors"), c("retracted").alias("r_retracted"))
    # The least PMID of each DOI, combined before the shuffle.
    fields = ("title", "journal", "pubdate", "authors", "retracted")
    least = F.min_by(F.struct(c("pmid").alias("linked_pmid"), *[c(x).alias(f"p_{x}") for x in fields]), "pmid")
    linked = registry.where(_true(c("valid")) & _some(c("doi"))).groupBy(clean_doi(c("doi")).alias("id")).agg(least.alias("__linked")).select("id", "__linked.*")
    rows = items.withColumn("id", clean_doi(c("id"))).join(record, "id", "left").join(linked, "id", "left")
    from_pubmed = (c("status") == "resolved") & c("linked_pmid").isNotNull()
    pick = lambda ours, theirs: F.when(from_pubmed, c(theirs)).otherwise(c(ours))
    rows = rows.withColumns({"title": pick("r_title", "p_title"), "journal": pick("r_journal", "p_journal"), "pubdate": pick("r_year", "p_pubdate"), "authors": pick("r_authors", "p_authors"), "retracted": (c("status") == "resolved") & (_true(c("r_retracted")) | (from_pubmed & _true(c("p_retracted")))), "pmid": F.when(from_pubmed, c("linked_pmid")), "meta_source": F.when(from_pubmed, "pubmed").when(c("status") == "resolved", "doi_registry")})
    rows = cross_check(rows, sequence)
    claimed, resolved = _some(c("claimed_title")), F.coalesce(c("status") == "resolved", F.lit(False))
    lost, explicit = c("status") == "not_found", c("label").isin("cli", "claims")
    verdict = F.when(resolved & claimed, capped_retraction(c("verdict"), c("retracted"))).when(lost & explicit, "invalid").otherwise("unknown")
    details = F.when(resolved & claimed, retraction_details(c("verdict"), c("details"), c("retracted"))).when(resolved, "DOI resolves; no claimed metadata to cross-verify").when(lost & explicit, "DOI not found — fabrication signal").when(lost, "DOI not found — treated as a suspect").otherwise("DOI registry unreachable (network), never counted as invalid")
    rows = rows.withColumns({"details": details, "verdict": verdict, "suspect": _true(lost & ~explicit), "network_error": ~resolved & ~_true(lost), "valid": resolved, "doi": c("id"), "kind": F.lit("doi")})
    return rows.drop(*[x for x in rows.columns if x.startswith(("r_", "p_"))]).withColumn("confidence", F.bround("confidence", 2))


def verify_arxiv(items: DataFrame, records: DataFrame, registry: DataFrame, sequence: bool = True) -> DataFrame:
    """arXiv leg: shape, existence, title, then the claimed DOI against the registered one."""
    links = registry.where(_true(c("valid")) & _some(c("doi"))).groupBy(clean_doi(c("doi")).alias("__doi")).agg(F.min("pmid").alias("pmid"))
    record = records.select(F.lower("arxiv_id").alias("key"), "status", "title", c("year").alias("pubdate"), "registered_doi", F.nullif(clean_doi(c("registered_doi")), F.lit("")).alias("__doi"))
    # An id may have many claims and many records, so what takes one side alone is made before they are paired, on the cores that pair them.
    record = record.join(links, "__doi", "left").repartition("key").withColumn("__theirs", word_set(c("title")))
    own = {"__ours": word_set(c("claimed_title")), "__our_doi": F.nullif(clean_doi(c("claimed_doi")), F.lit("")), "__claimed": _some(c("claimed_title")), "__shaped": arxiv_valid(c("id"))}
    rows = items.withColumn("key", F.lower("id")).repartition("key").withColumns(own).join(record, "key", "left").drop("key")
    rows = rows.withColumn("__shared", F.size(F.array_intersect("__ours", F.coalesce("__theirs", F.array().cast("array<string>")))))
    rows = rows.withColumn("word_ratio", shared_ratio(c("__shared"), F.size("__ours"), F.coalesce(F.size("__theirs"), F.lit(0))))
    if sequence:
        # the words decide most rows; characters are compared only for the rest
        asked = (c("word_ratio") < 0.5) & c("__claimed") & _some(c("title"))
        rows = rows.withColumns({"__a": F.when(asked, folded(c("claimed_title"))), "__b": F.when(asked, folded(c("title")))}).withColumn("seq", sequence_ratio("__a", "__b"))
    else:
        rows = rows.withColumn("seq", F.lit(0.0))
    same = (c("word_ratio") >= 0.5) | (F.coalesce("seq", F.lit(0.0)) >= 0.9)
    shaped, found, claimed = c("__shaped"), F.coalesce(c("status") == "found", F.lit(False)), c("__claimed")
    absent = c("status") == "not_found"
    pair = found & _true(c("__our_doi") != c("__doi"))
    graded = F.when(~shaped | _true(absent), "invalid").when(~found | ~claimed, "unknown").when(same, "correct").otherwise("mismatch")
    rows = rows.withColumns({"arxiv_doi_mismatch": pair, "network_error": shaped & ~found & ~_true(absent), "valid": found & shaped, "field_title": F.when(found & claimed, same), "field_year": F.when(found & _some(c("claimed_year")), c("claimed_year") == c("pubdate"))})
    rows = rows.withColumn("verdict", F.when(pair & (graded == "correct"), "partial").otherwise(graded))
    return rows.withColumn("kind", F.lit("arxiv")).drop("__doi", "__our_doi", "__ours", "__theirs", "__shared", "__claimed", "__shaped", "__a", "__b", "seq")


def _title_sets(items: DataFrame) -> DataFrame:
    """Items that claim a title, with ``__q``: its words in order, as one text, which titles of the same words share."""
    return items.where(_some(c("claimed_title"))).withColumn("__q", F.array_join(F.array_sort(word_set(c("claimed_title"))), " "))


def _nearest_titles(asked: DataFrame, registry: DataFrame, most: int, least: float) -> DataFrame:
    """(__q, found, score, rank): the ``most`` valid records nearest to each set of words asked for."""
    records = registry.where("valid").select(c("pmid").alias("found"), word_set(c("title")).alias("words"))
    sets = asked.where("__q <> ''").select(F.split("__q", " ").alias("q"))
    return nearest(sets, records, most, least).select(F.array_join("q", " ").alias("__q"), "found", "score", "rank")


def title_candidates(items: DataFrame, registry: DataFrame, most: int = 3, least: float = 0.0) -> DataFrame:
    """The ``most`` registered records nearest in words to each claimed title, of all that share a word or reach ``least``.

    Ties go to the record first in order. Claims of one title share its candidates: they are found once for each
    set of words, with their titles, and dealt to the claims last.
    """
    asked = _title_sets(items).select("id", "input_ord", "__q")
    titles = registry.where("valid").select(c("pmid").alias("found"), c("title").alias("found_title"))
    best = _nearest_titles(asked, registry, most, least).join(titles, "found")
    return asked.join(best, "__q").select("id", "input_ord", "found", "found_title", "score", "rank")


def title_search(items: DataFrame, registry: DataFrame, sequence: bool = True) -> DataFrame:
    """Title leg: the best candidate that the ladder calls correct; retracted ones are partial; else unknown, never mismatch.

    Without ``sequence`` the ladder accepts no title below ``TITLE_WORDS``, so none is looked for. Records join
    the sets of words, so that a claim's fields are shuffled once, not for each candidate.
    """
    asked = _title_sets(items)
    best = _nearest_titles(asked, registry, 3, 0.0 if sequence else TITLE_WORDS)
    records = best.join(registry.withColumnRenamed("pmid", "found"), "found")
    checked = cross_check(asked.join(records, "__q"), sequence).where("verdict = 'correct'")
    best = checked.groupBy("id", "input_ord").agg(F.min_by(F.struct("found", "retracted"), "rank").alias("best"))
    out = items.join(best, ["id", "input_ord"], "left")
    return out.withColumns({"pmid": c("best.found"), "retracted": _true(c("best.retracted")), "verdict": F.when(c("best").isNull(), "unknown").when(_true(c("best.retracted")), "partial").otherwise("correct"), "kind": F.lit("title")}).drop("best")


def suggestions(rows: DataFrame, registry: DataFrame, most: int = 3) -> DataFrame:
    """suggested_pmids, an array of (pmid, title), for rows still graded mismatch."""
    found = title_candidates(rows.where("verdict = 'mismatch'"), registry, most)
    packed = found.groupBy("id", "input_ord").agg(F.sort_array(F.collect_list(F.struct("rank", c("found").alias("pmid"), c("found_title").alias("title")))).alias("s"))
    return rows.join(packed.select("id", "input_ord", F.transform("s", lambda x: F.struct(x["pmid"], x["title"])).alias("suggested_pmids")), ["id", "input_ord"], "left")


def doi_merged(doi_items: DataFrame, pmid_rows: DataFrame) -> DataFrame:
    """DOI items that no verified PMID registers, compared clean on both sides."""
    seen = pmid_rows.where(_true(c("valid")) & _some(c("doi"))).select(clean_doi(c("doi")).alias("__seen")).distinct()
    return doi_items.join(seen, clean_doi(c("id")) == c("__seen"), "left_anti")


def with_reasons(rows: DataFrame, notices: DataFrame) -> DataFrame:
    """Retracted rows with the reason that their notice gives."""
    told = notices.select(clean_doi(c("doi")).alias("__notice"), retraction_reason(c("title"), c("abstract")).alias("retraction_reason"))
    return rows.join(told, clean_doi(c("notice_doi")) == c("__notice"), "left").drop("__notice")


def with_links(rows: DataFrame, links: DataFrame, registry: DataFrame) -> DataFrame:
    """DOI rows (id) with the linked PMID, unless that record registers another DOI: then ``link_note`` says so."""
    linked = links.groupBy(clean_doi(c("doi")).alias("__doi")).agg(F.min("pmid").alias("__pmid"))
    record = registry.where(_true(c("valid"))).select(c("pmid").alias("__pmid"), F.struct("title", "journal", "pubdate", "authors", "doi", "retracted").alias("__linked"))
    joined = rows.join(linked.join(record, "__pmid"), clean_doi(c("id")) == c("__doi"), "left")
    other = _some(clean_doi(c("__linked.doi"))) & ~doi_match(c("__linked.doi"), c("id"))
    joined = joined.withColumns({"link_note": F.when(_true(other), "linked record registers a different DOI — link ambiguous, keeping the DOI registry's metadata"), "linked": F.when(~_true(other), c("__linked")), "pmid": F.when(~_true(other), c("__pmid"))})
    return joined.drop("__doi", "__pmid", "__linked")


def merged_scanned(doi_items: DataFrame, links: DataFrame, pmid_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned DOIs split by whether their linked PMID is verified already (J8b): (to be checked, merged into a PMID)."""
    linked = links.groupBy(clean_doi(c("doi")).alias("__doi")).agg(F.min("pmid").alias("merged_into"))
    seen = pmid_rows.where(_true(c("valid"))).select(c("id").alias("merged_into")).distinct()
    known = linked.join(seen, "merged_into")
    same = clean_doi(c("id")) == c("__doi")
    scanned = doi_items.where(~c("explicit"))
    kept = scanned.join(known, same, "left_anti").unionByName(doi_items.where("explicit"))
    return kept, scanned.join(known, same).drop("__doi")


def plain_title(title: Column) -> Column:
    """A registered title without the mark of a retraction before it."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^\s*RETRACTED(\s+ARTICLE)?\s*:\s*", "")


def crossref_check(rows: DataFrame, records: DataFrame, sequence: bool = True) -> DataFrame:
    """PMID rows with what the DOI registry says of their registered DOI.

    doi_verified: resolved, or false where the registry could not say; null
    without a DOI. doi_title_match: titles alike in characters (without
    ``sequence``: equal when folded). A retraction there flags the row, before
    one that the publication type tells; ``retraction_source`` names which.
    """
    theirs = records.groupBy(clean_doi(c("doi")).alias("__doi")).agg(F.min_by(F.struct("status", "title", "retracted", "retraction_note"), F.when(c("status") == "resolved", 0).otherwise(1)).alias("__r"))
    asked = _true(c("valid")) & _some(clean_doi(c("doi")))
    rows = rows.withColumn("__key", F.when(asked, clean_doi(c("doi")))).join(theirs, c("__key") == c("__doi"), "left")
    resolved = _true(c("__r.status") == "resolved")
    rows = rows.withColumns({"__a": F.when(resolved, folded(plain_title(c("__r.title")))), "__b": F.when(resolved, folded(c("title")))})
    alike = sequence_ratio("__a", "__b") >= 0.9 if sequence else c("__a") == c("__b")
    known = _true(c("__r.retracted")) & asked
    return rows.withColumns(
        {
            "doi_verified": F.when(asked, resolved),
            "doi_title_match": F.when(asked & resolved, F.coalesce(alike, F.lit(False))),
            "retraction_source": F.when(known, "doi registry").when(_true(c("retracted")), "publication type"),
            "retraction_note": F.when(known, c("__r.retraction_note")),
            "retracted": known | _true(c("retracted")),
        }
    ).drop("__key", "__doi", "__r", "__a", "__b")


#: Title words that searches leave out.
QUERY_STOP = ("the", "and", "for", "with", "from", "that", "this")
REPLACEMENT_STOP = (*QUERY_STOP, "effect", "study", "using", "based")


def title_query(title: Column, most: int, stop: tuple[str, ...]) -> Column:
    """The first words of a title longer than three characters, stop words apart."""
    bare = F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: F.btrim(w, F.lit(",.;:()")))
    return F.array_join(F.slice(F.filter(bare, lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*stop)), 1, most), " ")


def suggestion_query(authors: Column, title: Column, journal: Column, year: Column) -> Column:
    """What a registry is searched for in place of a mismatch: author, title words, journal, year (F20); "" if nothing is claimed."""
    tagged = lambda x, tag: F.when(_some(x), F.concat(x, F.lit(tag)))
    words = F.slice(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*QUERY_STOP)), 1, 4)
    return F.concat_ws(" AND ", tagged(F.get(authors, F.lit(0)), "[au]"), F.nullif(F.array_join(words, " "), F.lit("")), tagged(journal, "[jour]"), tagged(year, "[dp]"))


def replacements(rows: DataFrame, registry: DataFrame, most: int = 3) -> DataFrame:
    """``replacement_pmids`` for retracted rows: live records of other ids whose titles are nearest in words; suggestions, not verdicts."""
    title = F.coalesce(F.nullif(c("title"), F.lit("")), "claimed_title")
    suggested = F.lit(False) if "suggested_pmids" not in rows.columns else F.coalesce(F.size("suggested_pmids") > 0, F.lit(False))
    asked = rows.where(_true(c("retracted")) & (F.length(title) >= 15) & ~suggested).select("id", "input_ord", title_query(title, 6, REPLACEMENT_STOP).alias("claimed_title"))
    live = registry.where(~_true(c("retracted")))
    found = title_candidates(asked, live, most + 1).where(c("found") != c("id"))
    rank = Window.partitionBy("id", "input_ord").orderBy("rank")
    kept = found.withColumn("n", F.row_number().over(rank)).where(c("n") <= most)
    packed = kept.groupBy("id", "input_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "found"))), lambda x: x["found"]).alias("replacement_pmids"))
    return rows.join(packed, ["id", "input_ord"], "left")


def with_relevance(rows: DataFrame, least: float = 0.2) -> DataFrame:
    """``match_score`` of the registered title and the words of the source's file name, and ``unmatched`` below ``least``."""
    score = keyword_score(c("title"), path_keywords(c("label")))
    return rows.withColumn("match_score", F.when(_true(c("valid")), score)).withColumn("unmatched", _true(c("match_score") < least))


def cjk_search(items: DataFrame, works: DataFrame, sequence: bool = True) -> DataFrame:
    """Entries (id, input_ord, raw, claimed_*) without an identifier, by a registered title that stands in their text as it is.

    ``works`` has work_id, title, authors, journal, year, retracted; titles of
    fewer than ``GRAM`` characters do not count. The years must not differ, and
    the ladder must say correct. Never a mismatch: all else is unknown. The
    longest title wins, then the least work_id.
    """
    asked = items.where(has_cjk(c("raw"))).select("id", "input_ord", "raw", c("claimed_authors").alias("__authors"), c("claimed_journal").alias("__journal"), c("claimed_year").alias("__year"))
    asked = written(dealt(asked).withColumn("tid", F.monotonically_increasing_id()), "cjk-entries")
    record = written(dealt(works).select(F.monotonically_increasing_id().alias("nid"), "work_id", F.trim("title").alias("title"), "authors", "journal", c("year").alias("pubdate"), "retracted"), "cjk-works")
    held = contained(record.where(F.length("title") >= GRAM).select("nid", "title"), asked.select("tid", c("raw").alias("text")))
    met = held.join(asked, "tid").join(record, "nid").where(~_some(c("__year")) | ~_some(c("pubdate")) | (c("__year") == c("pubdate"))).drop("nid", "tid")
    met = met.withColumns({"claimed_title": c("title"), "claimed_authors": F.when(F.coalesce(F.size("__authors"), F.lit(0)) > 0, c("__authors")).otherwise(F.slice("authors", 1, 3)), "claimed_journal": F.when(_some(c("__journal")), c("__journal")).otherwise(c("journal")), "claimed_year": F.when(_some(c("__year")), c("__year")).otherwise(c("pubdate"))})
    good = cross_check(met, sequence).where("verdict = 'correct'")
    order = F.struct((-F.length("title")).alias("l"), "work_id")
    best = good.groupBy("id", "input_ord").agg(F.min_by(F.struct("work_id", "title", "journal", "pubdate", "retracted", F.bround("confidence", 2).alias("confidence")), order).alias("__best"))
    rows = items.join(best, ["id", "input_ord"], "left")
    found = c("__best").isNotNull()
    graded = F.when(found, capped_retraction(F.lit("correct"), c("__best.retracted"))).otherwise("unknown")
    note = F.lit("registered title stands verbatim in the entry")
    return rows.withColumns({"verdict": graded, "details": F.when(found, retraction_details(F.lit("correct"), note, c("__best.retracted"))).otherwise("no registered title stands verbatim in the entry; a PMID or DOI would decide"), "route": F.when(found, "cjk_title"), "work_id": c("__best.work_id"), "title": c("__best.title"), "retracted": _true(c("__best.retracted")), "confidence": c("__best.confidence"), "valid": found, "kind": F.lit("title")}).drop("__best")
