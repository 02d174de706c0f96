"""The top-k title join and the gram index against comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from refsieve.functions.text import word_set
from refsieve.operators import contained, nearest, verify
from refsieve.plans import catalog, catalog_flow, synth  # noqa: F401

SF = "/root/testdata/sf0.001"


def brute(sets, records, most, least):
    out = set()
    for q in sets:
        scored = []
        for found, words in records:
            shared = len(set(q) & set(words))
            score = shared / (len(q) + len(words) - shared) if shared else 0
            if shared and score >= least:
                scored.append((-score, found))
        out |= {(tuple(q), found, round(-score, 9), at) for at, (score, found) in enumerate(sorted(scored)[:most], 1)}
    return out


def check_nearest(spark, sets, records, most, least=0.0):
    sets = [sorted(set(q)) for q in sets]
    records = [(i, sorted(set(words))) for i, words in records]
    asked = spark.createDataFrame([(q,) for q in sets], "q array<string>")
    index = spark.createDataFrame(records, "found string, words array<string>")
    got = {(tuple(r["q"]), r["found"], round(r["score"], 9), r["rank"]) for r in nearest.nearest(asked, index, most, least).collect()}
    want = brute({tuple(q) for q in sets if q}, records, most, least)
    assert got == want
    return want


@pytest.mark.parametrize("paired", [0.2, 2.0])
@pytest.mark.parametrize("most, least", [(3, 0.0), (1, 0.0), (4, 0.5), (2, 0.34)])
def test_nearest_equals_all_pairs(spark, monkeypatch, paired, most, least):
    """Few words, so that most are shared by many records; one stands in all."""
    monkeypatch.setattr(nearest, "PAIRED", paired)
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(25)]
    records = [(f"{i:03}", ["trial", *rng.sample(pool, rng.randrange(0, 12))]) for i in range(220)]
    sets = [rng.sample(words, rng.randrange(1, len(words) + 1)) + rng.sample([*pool, "odd", "rare"], rng.randrange(4)) for _, words in records[:60]]
    sets += [["trial"], ["unheard"], [], ["trial", "unheard"], ["odd", "rare", "w1"]]
    assert len(check_nearest(spark, sets, records, most, least)) > 50


def test_the_best_are_not_by_the_rarest_words(spark):
    """Two words that only poor matches hold, beside four that five good ones share."""
    records = [*((f"g{i}", ["alpha", "beta", "gamma", "delta", f"x{i}"]) for i in range(5)), ("p1", ["eta", "a1", "a2"]), ("p2", ["theta", "b1", "b2"])]
    got = check_nearest(spark, [["alpha", "beta", "gamma", "delta", "eta", "theta"]], records, 3)
    assert {found for _, found, _, _ in got} == {"g0", "g1", "g2"}


def test_nearest_on_empty_tables(spark):
    check_nearest(spark, [], [("a", ["x"])], 3)
    check_nearest(spark, [["x"]], [], 3)
    check_nearest(spark, [["x"], []], [("a", []), ("b", ["x"]), ("c", ["x", "y"])], 3)


def test_title_candidates_take_each_claim(spark):
    registry = spark.createDataFrame([("1", "The trial of roots", True), ("2", "Roots and trial", True), ("3", "roots trial", False), ("4", None, True), ("5", "", True)], "pmid string, title string, valid boolean")
    items = spark.createDataFrame([("a", 1, "Trial: roots"), ("a", 2, "trial ROOTS"), ("b", 3, None), ("c", 4, "the of"), ("d", 5, "leaves")], "id string, input_ord long, claimed_title string")
    got = {(r["id"], r["input_ord"], r["found"], r["found_title"], r["rank"]) for r in verify.title_candidates(items, registry).collect()}
    assert got == {("a", n, f, t, i) for n in (1, 2) for i, (f, t) in enumerate([("1", "The trial of roots"), ("2", "Roots and trial")], 1)}


def test_contained_equals_all_pairs(spark):
    rng = random.Random(9)
    letters = "ab 中"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (502, "shared lead one"), (503, "shared lead one and more"), (504, "unshared lead one\U0001f600 tail")]
    titles = [(i, t[a : a + rng.randrange(4, 20)]) for i, (_, t) in enumerate(texts[:120]) for a in [rng.randrange(len(t) + 1)]]
    titles += [(900, None), (901, ""), (902, "shared lead one"), (903, "hared lead on"), (904, "aaaaaaaaaaaaaaaaaaaaa"), (905, "one\U0001f600 tail"), (906, "shared lead one")]
    got = {(r["nid"], r["tid"]) for r in contained.contained(spark.createDataFrame(titles, "nid long, title string"), spark.createDataFrame(texts, "tid long, text string")).collect()}
    want = {(n, t) for n, title in titles for t, text in texts if title and text and len(title) >= contained.GRAM and title in text}
    assert got == want and {(903, 504), (905, 504), (906, 503)} <= want


def test_titles_cut_inside_words_get_a_second_opinion(spark):
    registry = spark.createDataFrame([("1", "Outcome of systemic long arthritis", True), ("2", "arthrit and others", True), ("3", "Another thing", True)], "pmid string, title string, valid boolean")
    rows = spark.createDataFrame([("1", 1, "outcome of systemic long arthrit", "mismatch_gated", "unknown"), ("3", 2, "utcome of systemic long arthrit", "mismatch_gated", "unknown"), ("3", 3, "outcome of systemic short arthrit", "mismatch_gated", "unknown"), ("1", 4, "systemic long", "mismatch_gated", "unknown")], "id string, input_ord long, claimed_title string, route string, verdict string")
    got = {r["input_ord"]: (r["verdict"], r["wrong_pmid_signal"], r["suggested"]) for r in verify.second_opinion(rows, registry).collect()}
    assert got == {1: ("correct", False, None), 2: ("unknown", True, "1"), 3: ("unknown", False, None), 4: ("unknown", False, None)}


def test_gram_pairs_stay_few(spark, monkeypatch):
    """All titles share their opening, yet about one pair is met for each entry."""
    kept = []
    usual = contained.candidates
    monkeypatch.setattr(contained, "candidates", lambda titles, texts: kept.append((usual(titles, texts).count(), texts.count())) or usual(titles, texts))
    assert catalog.QUERIES["cjk_title_search"](spark, SF).where("work_id is not null").count()
    met, entries = kept[0]
    assert 0 < met <= 10 * entries


def test_grams_beside_the_rarest_must_agree(spark):
    """No gram tells two of these titles apart by itself: each begins as 12 do and ends as 12 do."""
    titles = [(12 * i + j, f"{i:03}abcdef{j:03}") for i in range(12) for j in range(12)]
    frames = spark.createDataFrame(titles, "nid long, title string"), spark.createDataFrame([(n, f"[1] {t}.") for n, t in titles], "tid long, text string")
    assert contained.candidates(*frames).count() == len(titles)
    assert {(r["nid"], r["tid"]) for r in contained.contained(*frames).collect()} == {(n, n) for n, _ in titles}


def test_bucket_collisions_lose_no_title(spark, monkeypatch):
    monkeypatch.setattr(contained, "BUCKETS", 3)
    test_contained_equals_all_pairs(spark)


def test_rows_are_graded_once_for_a_second_opinion(spark):
    registry = spark.createDataFrame([("1", "Outcome of systemic long arthritis", True)], "pmid string, title string, valid boolean")
    graded = spark.sparkContext.accumulator(0)

    def route(_):
        graded.add(1)
        return "mismatch_gated"

    rows = spark.createDataFrame([("1", 1, "outcome of systemic long arthrit", "unknown"), ("2", 2, "outcome of systemic short arthrit", "unknown")], "id string, input_ord long, claimed_title string, verdict string")
    rows = rows.withColumn("route", F.udf(route)("verdict"))
    assert {r["input_ord"]: r["verdict"] for r in verify.second_opinion(rows, registry).collect()} == {1: "correct", 2: "unknown"}
    assert graded.value == 2


def test_arxiv_sides_are_read_before_they_are_paired(spark):
    """One id with many claims and many records: no text is taken apart once for each pair; the answers are those of all pairs."""
    claims = [(f"2101.{i % 2:05}", i, f"Outcome of arthritis {i % 3}", f"doi:10.1/{'AB'[i % 2]}" if i % 4 else None) for i in range(24)]
    stored = [(f"2101.{i % 2:05}", "found", f"outcome: arthritis {i % 5} more", f"10.1/{'ab'[i % 2]}" if i % 3 else None) for i in range(20)]
    items = spark.createDataFrame([(*x, None) for x in claims], "id string, input_ord long, claimed_title string, claimed_doi string, claimed_year string")
    records = spark.createDataFrame([(*x, None) for x in stored], "arxiv_id string, status string, title string, registered_doi string, year string")
    registry = spark.createDataFrame([("7", "10.1/A", True), ("8", "10.1/a", True)], "pmid string, doi string, valid boolean")
    rows = verify.verify_arxiv(items, records, registry, False)
    paired = rows._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    assert "verdict" in paired and "regexp_replace" not in paired
    got = sorted((r["input_ord"], r["title"], r["verdict"], r["pmid"] or "") for r in rows.collect())
    # Of the words outcome, arthritis, a number and, on one side, more, three of four are shared if the numbers agree, else two of five.
    assert got == sorted((o, t, "correct" if str(o % 3) in t else "mismatch", "7" if d == "10.1/a" else "") for i, o, *_ in claims for j, _, t, d in stored if i == j)


def test_records_join_sets_of_words_not_claims(spark):
    """Claims, with all of their fields, are joined once with what their set of words found, and once for the answer."""
    registry, items = synth.registry(spark, SF), synth.claims(spark, SF)
    joins = lambda rows: [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    searched = joins(verify.title_search(items, registry, False))
    assert [sum(name in x for x in searched) for name in ("input_ord#", "__q#")] == [1, 1] and "input_ord#" in searched[0]
    found = joins(verify.title_candidates(items, registry))
    assert "__q#" in found[0] and not [x for x in found[1:] if "__q#" in x]


def test_title_lists_stay_short(spark):
    """A word that every record holds pairs no set with records that cannot reach the score."""
    registry = synth.registry(spark, SF)
    records = registry.where("valid").select(F.col("pmid").alias("found"), word_set(F.col("title")).alias("words"))
    counts = nearest.word_counts(records)
    index = nearest.placed(records, "found", "words", counts).cache()
    sets = nearest.placed(records.select(F.monotonically_increasing_id().alias("qid"), "words"), "qid", "words", counts).cache()
    sizes, n = sorted(r["n"] for r in index.select("n").distinct().collect()), index.count()
    assert nearest.met(sets, index, sizes, n, 0.5).count() < n * n / 4


def test_copies_with_numbers_of_their_own_are_scored_once(spark, monkeypatch):
    """Three titles in 40 copies, told apart by a number: all are asked for, yet what passes score does not grow with the copies."""
    scored = []
    usual = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, name: (out := usual(df, name), name == "title-scored" and scored.append(out.count()))[0])
    cores = [["hot", "bolt", "large", "trial"], ["hot", "gear", "small", "trial"], ["cold", "bolt", "large", "trial"]]
    records = [(f"{40 * i + j:03}", [*words, f"k{40 * i + j}"]) for i, words in enumerate(cores) for j in range(40)]
    check_nearest(spark, [words for _, words in records], records, 3, 0.5)
    assert sum(scored) <= 2 * len(cores) ** 2


@pytest.mark.parametrize("rare", [0, 2, 50])
def test_words_of_few_records_lose_no_record(spark, monkeypatch, rare):
    """Frequent words and ones of one to three records, on either side, beside copies."""
    monkeypatch.setattr(nearest, "RARE", rare)
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(6)]
    records = [(f"{i:03}", [*rng.sample(pool, rng.randrange(0, 5)), *rng.sample([f"k{i}", f"l{i // 2}", f"m{i // 3}"], rng.randrange(0, 3))]) for i in range(150)]
    sets = [[*rng.sample(words, rng.randrange(1, len(words) + 1)), *rng.sample([*pool, "odd", "k7", "l8", "m9"], rng.randrange(3))] for _, words in records if words]
    assert len(check_nearest(spark, sets, records, 3)) > 200


def test_reference_numbers_by_ranges(spark, monkeypatch):
    """All names begin alike; numbers run through each section in order, and no range has over twice its share."""
    from refsieve.operators import export

    rng = random.Random(10)
    rows = [("verified" if i % 3 else "review", f"smith {rng.randrange(40):02}", i) for i in rng.sample(range(6000), 6000)]
    kept = []
    usual = export.written
    monkeypatch.setattr(export, "written", lambda df, name: kept.append(usual(df, name)) or kept[-1])
    frame = spark.createDataFrame(rows, "section string, name string, input_ord long").repartition(7)
    got = export.numbered(frame, [F.col("name"), F.col("input_ord")]).collect()
    for section in ("verified", "review"):
        want = sorted((name, i) for s, name, i in rows if s == section)
        assert [(r["name"], r["input_ord"]) for r in sorted(got, key=lambda r: r["n"]) if r["section"] == section] == want
        assert sorted(r["n"] for r in got if r["section"] == section) == list(range(1, len(want) + 1))
    sizes = sorted(r["count"] for r in kept[-1].groupBy("__range").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert export.numbered(frame.limit(0), [F.col("name")]).collect() == []
