"""Stated cases of the citation engine: input rows and the verdicts, fields and lines they must give."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from refsieve.functions import match, styles, text
from refsieve.operators import export, rollup, verify
from refsieve.plans.schemas import ARXIV_RECORD, DOI_RECORD, REGISTRY, WORK_ITEM
from refsieve.sources import bibliography, extract, files
from refsieve.sources.context import journal_in, parse

CLAIM = "claimed_title string, claimed_authors array<string>, claimed_journal string, claimed_year string, title string, authors array<string>, journal string, pubdate string"
REG = ("Juvenile idiopathic arthritis treatment outcomes", ["Ravelli A", "Martini B"], "New England Journal of Medicine", "2021 Dec")
LADDER = [
    (("Treatment outcomes in juvenile idiopathic arthritis", ["Ravelli"], None, None), REG, "correct"),
    (("Completely unrelated oncology paper", None, "N Engl J Med", "2021"), REG, "mismatch"),
    ((None, None, None, None), REG, "unknown"),
    ((None, None, "N Engl J Med", "2021"), REG, "unknown"),
    ((None, ["Ravelli", "Martini"], "N Engl J Med", "2021"), REG, "partial"),
    (("Completely unrelated oncology paper", ["Ravelli", "Martini"], "N Engl J Med", None), REG, "partial"),
    ((REG[0], ["Nobody", "Noone"], "N Engl J Med", None), REG, "partial"),
    ((REG[0], ["Ravelli", "Noone"], "N Engl J Med", "1999"), REG, "correct"),
    ((REG[0], None, None, None), REG, "partial"),
    (("儿童风湿病的治疗研究", ["Ravelli", "Martini"], None, None), REG, "partial"),
    ((REG[0] + "s", ["Ravelli"], None, None), REG, "correct"),
]


@pytest.fixture(scope="module")
def ladder(spark):
    rows = [(*claim, *actual) for claim, actual, _ in LADDER]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {CLAIM}")
    return {r["n"]: r for r in match.cross_check(out.coalesce(1)).collect()}


@pytest.mark.parametrize("n", range(len(LADDER)))
def test_ladder(ladder, n):
    assert ladder[n]["verdict"] == LADDER[n][2]


def test_fields_and_details(ladder):
    assert ladder[9]["field_title"] is None and ladder[9]["field_author"] is True
    assert ladder[6]["details"] == "author set entirely different (mis-attribution)"
    assert ladder[7]["field_year"] is False


def test_journals_and_authors(spark):
    rows = [("N Engl J Med", "New England Journal of Medicine", True), ("Pediatr. Rheumatol.", "Pediatric Rheumatology", True), ("J Med N", "New England Journal of Medicine", False), ("Lancet", "Nature", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(match.journal_abbreviates(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    names = [("Zaripova A", "zaripova"), ("A Zaripova", "zaripova"), ("J.-P. Martin", "martin"), ("Cher", "cher"), ("", "")]
    got = spark.createDataFrame(names, "n string, want string").select(match.surname(F.col("n")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_dois_and_arxiv(spark):
    rows = [("https://doi.org/10.1000/ABC.", "10.1000/abc"), ("doi: 10.1000/x?utm=1", "10.1000/x"), ("http://dx.doi.org/doi:10.1000/y）。", "10.1000/y"), (None, ""), ("", "")]
    got = spark.createDataFrame(rows, "d string, want string").select(text.clean_doi(F.col("d")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    assert all(extract.tidy_doi(d) == want for d, want in rows if d)
    shapes = [("2101.00001", True), ("2113.00001", False), ("arXiv:1905.1234v2", True), ("math.GT/0309136", True), ("hep-th/99", False)]
    got = spark.createDataFrame(shapes, "a string, want boolean").select(text.arxiv_valid(F.col("a")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def _registry(spark):
    base = ("A randomized trial of early therapy in arthritis", ["Ravelli A", "Martini B"], "Lancet", "2020", "1", None, "5", "10.1/a")
    rows = [("1", *base, True, False, False, None, 3, "ncbi"), ("2", *base[:-1], "10.1/b", True, False, True, None, None, "ncbi"), ("3", *([None] * 8), False, True, None, None, None, "ncbi")]
    return spark.createDataFrame(rows, REGISTRY)


def test_pmid_leg_rewrites(spark):
    title = "A randomized trial of early therapy in arthritis"
    items = [
        ("1", "claims", True, 1, title, ["Ravelli", "Martini"], "Lancet", "2020", None),
        ("1", "claims", True, 2, title, ["Ravelli", "Martini"], "Lancet", "2020", "10.1/other"),
        ("2", "claims", True, 3, title, ["Ravelli", "Martini"], "Lancet", "2020", None),
        ("3", "claims", True, 4, title, None, None, None, None),
        ("9", "claims", True, 5, title, None, None, None, None),
        ("1", "scan.txt", False, 6, None, None, None, None, None),
        ("1", "scan.txt", False, 7, "Wholly different words about geology here", None, None, None, None),
        ("1", "scan.txt", False, 8, title, None, None, None, None),
        ("1", "claims", True, 9, "Wholly different words about geology here", None, None, None, None),
    ]
    rows = {r["input_ord"]: r for r in verify.verify_pmid(spark.createDataFrame(items, WORK_ITEM), _registry(spark)).collect()}
    want = {1: "correct", 2: "partial", 3: "partial", 4: "unknown", 5: "invalid", 6: "correct", 7: "unknown", 8: "correct", 9: "mismatch"}
    assert {k: r["verdict"] for k, r in rows.items()} == want
    assert rows[2]["doi_splice"] and rows[7]["route"] == "mismatch_gated" and rows[8]["route"] == "existence_title_match" and rows[6]["route"] == "existence_only"
    assert rows[3]["details"].startswith("RETRACTED")


def test_other_legs(spark):
    registry = _registry(spark)
    title = "A randomized trial of early therapy in arthritis"
    dois = spark.createDataFrame([("10.1/a", "resolved", title, "Lancet", "2020", ["Ravelli A"], False, None, None, None, "crossref"), ("10.1/z", "not_found", *([None] * 9))], DOI_RECORD)
    items = spark.createDataFrame([("10.1/A.", "claims", True, 1, title, ["Ravelli"], None, None, None), ("10.1/z", "claims", True, 2, title, None, None, None, None), ("10.1/z", "scan.txt", False, 3, None, None, None, None, None), ("10.1/q", "cli", True, 4, None, None, None, None, None)], WORK_ITEM)
    rows = {r["input_ord"]: r for r in verify.verify_doi(items, dois, registry).collect()}
    assert [rows[i]["verdict"] for i in (1, 2, 3, 4)] == ["correct", "invalid", "unknown", "unknown"] and rows[1]["pmid"] == "1" and rows[4]["network_error"]
    records = spark.createDataFrame([("2101.00001", "found", title, "2021", ["x"], "10.1/a")], ARXIV_RECORD)
    items = spark.createDataFrame([("2101.00001", "cli", True, 1, title, None, None, None, None), ("2101.00001", "cli", True, 2, title, None, None, None, "10.1/zz"), ("2113.00001", "cli", True, 3, title, None, None, None, None), ("2101.00002", "cli", True, 4, title, None, None, None, None)], WORK_ITEM)
    rows = {r["input_ord"]: r for r in verify.verify_arxiv(items, records, registry).collect()}
    assert [rows[i]["verdict"] for i in (1, 2, 3, 4)] == ["correct", "partial", "invalid", "unknown"] and rows[1]["pmid"] == "1"
    found = verify.title_search(items.withColumn("claimed_authors", F.array(F.lit("Ravelli"))).where("input_ord = 1"), registry).first()
    assert (found["pmid"], found["verdict"]) == ("1", "correct")


def test_title_search_finds_every_title_near_in_words(spark):
    import itertools
    import random

    rng = random.Random(4)
    pool = [f"w{i}" for i in range(24)]
    titles = [" ".join(rng.sample(pool, rng.randrange(1, 12))) for _ in range(150)]
    claimed = [" ".join(rng.sample(t.split(), len(t.split()) - rng.randrange(2)) + rng.sample(["odd", "rare", "unheard"], rng.randrange(3))) for t in titles] + ["", None]
    # two wrong words that are rarer than all of the record's own
    titles += ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta iota", "odd", "rare"]
    claimed.append("alpha beta gamma delta epsilon zeta odd rare")
    registry = spark.createDataFrame([(str(i), t, True) for i, t in enumerate(titles)], "pmid string, title string, valid boolean")
    items = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(claimed)], "id string, input_ord long, claimed_title string")
    got = {(r["input_ord"], r["found"]) for r in verify.title_candidates(items, registry, most=1000).where("score >= 0.5").collect()}
    near = lambda a, b: 2 * len(a & b) >= len(a | b) > 0
    want = {(i, str(j)) for (i, a), (j, b) in itertools.product(enumerate(claimed), enumerate(titles)) if near(set((a or "").split()), set(b.split()))}
    assert got == want and (len(claimed) - 1, "150") in want


def test_delta_ledger_readiness(spark):
    old = spark.createDataFrame([("a", "correct", False), ("b", "mismatch", False), ("c", "correct", False), ("d", "correct", False)], "key string, verdict string, retracted boolean")
    new = spark.createDataFrame([("a", "mismatch", False, False), ("b", "correct", False, False), ("c", "partial", True, False), ("e", "correct", True, False)], "key string, verdict string, retracted boolean, network_error boolean")
    got = {(r["key"], r["category"]) for r in rollup.delta(old, new).collect()}
    assert got == {("a", "degraded"), ("b", "improved"), ("c", "newly_retracted"), ("d", "dropped"), ("e", "new"), ("e", "newly_retracted")}
    rows = spark.createDataFrame([("correct", False, False, False), ("partial", False, False, False)], "verdict string, retracted boolean, doi_splice boolean, network_error boolean")
    assert rollup.readiness(rollup.stats(rows)).first()["ready"]
    assert not rollup.readiness(rollup.stats(rows.withColumn("doi_splice", F.lit(True)))).first()["ready"]


def test_style_lines(spark):
    row = [("A study", "Smith J, Doe Anna", False, "Pediatric Rheumatology", "2021 Dec", "19", "1", "75", "10.1/x")]
    frame = spark.createDataFrame(row, "title string, authors string, authors_truncated boolean, journal string, pubdate string, volume string, issue string, pages string, doi string")
    got = frame.select(*[styles.reference(s, F.lit(1)).alias(s) for s in styles.STYLES]).first()
    assert got["gbt"] == "[1] SMITH J, DOE A. A study[J]. Pediatric Rheumatology, 2021, 19(1): 75. DOI:10.1/x."
    assert got["gbty"] == "SMITH J, DOE A. A study. Pediatric Rheumatology, 2021, 19(1): 75. DOI:10.1/x."
    assert got["vancouver"] == got["ama"] == "1. Smith J, Doe A. A study. Pediatric Rheumatology. 2021;19(1):75. doi:10.1/x"
    assert got["apa"] == "Smith, J., & Doe, A. (2021). A study. Pediatric Rheumatology, 19(1), 75. https://doi.org/10.1/x"
    assert got["harvard"] == "Smith, J. and Doe, A. (2021) 'A study', Pediatric Rheumatology, 19(1), pp. 75. doi: 10.1/x."
    assert got["chicago"] == 'Smith, J, and Doe, A. "A study." Pediatric Rheumatology 19, no. 1 (2021): 75. https://doi.org/10.1/x.'


def test_exports(spark, tmp_path):
    rows = verify.verify_pmid(spark.createDataFrame([("1", "claims", True, 1, "A randomized trial of early therapy in arthritis", ["Ravelli"], "Lancet", "2020", None), ("2", "claims", True, 2, "A randomized trial of early therapy in arthritis", ["Ravelli"], "Lancet", "2020", None), ("9", "claims", True, 3, "x", None, None, None, None)], WORK_ITEM), _registry(spark)).withColumn("pmid", F.col("id"))
    shown = export.display(rows)
    bib = {r["pmid"]: r["entry"] for r in export.bibtex(shown).collect()}
    assert bib["1"].startswith("@article{ravelli2020pmid1,") and bib["2"] == "% EXCLUDED (RETRACTED): PMID 2 — do not cite." and bib["9"] is None
    item = json.loads(export.csl(shown).where("pmid = '1'").first()["item"])
    assert item["author"][0] == {"family": "Ravelli", "given": "A"} and item["issued"]["date-parts"] == [[2020]]
    assert export.export_counts(shown).first().asDict() == {"included": 1, "partial": 0, "excluded": 2}
    export.report(rows, str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())["results"]) == 3
    with pytest.raises(ValueError, match="no report form"):
        export.report(rows, "r.xyz")


def test_extraction():
    sample = "See PMID: 12345678 and PMID:12345678901. doi:10.1000/ABC(1). https://doi.org/10.1000/abc(1 arXiv:math.GT/0309136. arxiv.org/abs/2113.1"
    assert [h[0] for h in extract.hits(sample, "pmid")] == ["12345678", "123456789"]
    assert [h[0] for h in extract.hits(sample, "doi")] == ["10.1000/abc(1"]
    assert [h[0] for h in extract.hits(sample, "arxiv")] == ["2113.1", "math.GT/0309136"]
    assert list(extract.hits(None, "doi")) == []


def test_context():
    c = parse("Some prose came before it. Zaripova LN, Midgley A, Christmas SE. Juvenile arthritis in the U.S. population. Pediatr Rheumatol. 2021;19:135. PMID: 34425842")
    assert (c.title, c.authors, c.journal, c.year) == ("Juvenile arthritis in the U.S. population", ["Zaripova", "Midgley", "Christmas"], "Pediatr Rheumatol", "2021")
    c = parse("[1] 张三, 李四. 儿童风湿病的治疗研究[J]. 中华儿科杂志, 2020. PMID: 123456. doi:10.1/x.")
    assert (c.title, c.authors, c.journal, c.doi, c.form) == ("儿童风湿病的治疗研究", ["张三", "李四"], "中华儿科杂志", "10.1/x", "gbt7714")
    assert parse("").row() == parse(None).row()


#: (context; title, authors, journal, DOI) of references in Chinese, read by hand.
CHINESE = [
    ("Zhang S, Li S. 儿童病的诊断与治疗[J]. 中华儿科杂志, 2019. PMID: 31018962", ("儿童病的诊断与治疗", ["Zhang S", "Li S"], "中华儿科杂志", "")),
    ("[1] 王五. 别的题目和内容[M]. 北京, 2018.\n[2] 张三；李四. 儿童, 风湿病的\n治疗研究[J]. 中华 儿科杂志, 2020. DOI: 10.1/abc. PMID: 123456", ("儿童, 风湿病的 治疗研究", ["张三", "李四"], "中华 儿科杂志", "10.1/abc")),
    ("1. 王五. 别的题目和内容[J]. 甲杂志, 2018. PMID: 111111. [2] 张三  李四. 儿童病的治疗研究[J]. 乙杂志, 2020. PMID: 123456", ("儿童病的治疗研究", ["张三", "李四"], "乙杂志", "")),
    ("王五. 别的题目和内容[J]. 甲杂志, 2018. 张三. 儿童病的治疗研究[J]. 乙杂志, 2020. PMID: 123456", ("儿童病的治疗研究", ["张三"], "乙杂志", "")),
    ("张三. 儿童病的治疗研究[D]. 北京大学, 2020. PMID: 123456 doi: 10.2/zz PMID", ("儿童病的治疗研究", ["张三"], "", "10.2/zz")),
    ("张三. 儿童病的治疗研究[J], 2020. PMID: 123456", ("儿童病的治疗研究", ["张三"], "", "")),
    ("一段没有标签的中文说明 PMID: 123456", ("", [], "", "")),
]


@pytest.mark.parametrize(("context", "want"), CHINESE)
def test_chinese_contexts(context, want):
    c = parse(context)
    assert (c.title, c.authors, c.journal, c.doi, c.form) == (*want, "gbt7714")


def test_journal_in_prose():
    texts = {"Smith wrote in Ann Rheum Dis 2019": "Ann Rheum Dis", "the Pediatr Rheumatol J today": "Pediatr Rheumatol J", "in Arthritis Res Ther.": "Arthritis Res", "Lancet": "", "in Ann. Rheum Dis": "Rheum Dis", "": ""}
    assert {t: journal_in(t) for t in texts} == texts


def test_bibliographies(spark):
    entries = list(bibliography.bibtex('@string{x={y}}\n@article{k1, title={A {B} C}, note="PMID: 123456", year=2020}\n@article(k2, title={D})\n@misc{ , title={E}}\n@book{k3, title={F'))
    assert [(e[0], e[3]) for e in entries] == [("k1", 2), ("k2", 3), ("anon1", 4), (None, 5)] and entries[0][2]["title"] == "A B C" and entries[3][4]
    found = spark.createDataFrame([("p", "@article{a, doi={10.1/x}, note={PMID: 123456}}")], "path string, text string")
    assert [(r["route"], r["id"]) for r in bibliography.routed(bibliography.entries(found, "bib")).collect()] == [("pmid", "123456")]
    ris = spark.createDataFrame([("p", "TY  - JOUR\nTI  - A\n more\nAU  - X\nAU  - Y\nUR  - https://arxiv.org/abs/2101.00001\nER  - \n")], "path string, text string")
    row = bibliography.routed(bibliography.bib_view(bibliography.entries(ris, "ris"))).first()
    assert (row["route"], row["id"], row["fields"]["title"], row["fields"]["author"]) == ("arxiv", "2101.00001", "A more", "X; Y")
    # a heading among plain lines keeps its place (the order that input has)
    assert bibliography.split_list("first line\n# heading\nlast line") == ["first line", "heading", "last line"]


def test_documents(tmp_path, spark):
    def archive(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    (tmp_path / "x.docx").write_bytes(archive({"word/document.xml": f"<w:d {w}><w:p><w:t>one </w:t><w:t>PMID: 123456</w:t></w:p><w:p/></w:d>"}))
    (tmp_path / "x.pptx").write_bytes(archive({f"ppt/slides/slide{n}.xml": f"<a:d {a}><a:p><a:t>s{n}</a:t></a:p></a:d>" for n in (10, 2)}))
    (tmp_path / "x.html").write_text('<p>a</p><script>b</script><a href="https://doi.org/10.1/q">c</a>')
    (tmp_path / "x.nxml").write_text('<article xmlns:x="u"><p>t</p><r x:href="h"/>tail</article>')
    (tmp_path / "bad.docx").write_text("plain PMID: 777777")
    (tmp_path / "skip.bin").write_text("PMID: 888888")
    got = {r["basename"]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["x.docx"]["text"] == "one PMID: 123456" and got["x.pptx"]["text"] == "s2\ns10" and got["x.nxml"]["format"] == "jats"
    assert "https://doi.org/10.1/q" in got["x.html"]["text"] and "b" not in got["x.html"]["text"].split() and got["bad.docx"]["degraded"] and "skip.bin" not in got


def test_claims_and_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿PMID,Title,authors,doi,arxiv\n123,A title,X; Y,,\n,B,P|Q,10.1/x,\n,C,,,2101.00001\n", encoding="utf-8")
    items = {r["claimed_title"]: r for r in files.work_items(files.claims_csv(spark, str(tmp_path / "c.csv"))).collect()}
    assert [(items[t]["kind"], items[t]["id"]) for t in ("A title", "B", "C")] == [("pmid", "123"), ("doi", "10.1/x"), ("arxiv", "2101.00001")]
    assert items["A title"]["claimed_authors"] == ["X", "Y"] and items["B"]["claimed_authors"] == ["P", "Q"]
    rows = [(str(i % 5), i % 2 == 0, i) for i in range(20)]
    random.Random(1).shuffle(rows)
    kept = verify.keep_first(spark.createDataFrame(rows, "id string, explicit boolean, input_ord long")).collect()
    assert sorted((r["id"], r["input_ord"]) for r in kept) == [("0", 0), ("1", 6), ("2", 2), ("3", 8), ("4", 4)]


def test_small_functions(spark):
    row = spark.createDataFrame([("=1+1", "Retraction Note: Some title", "ev_case-sjia_treatment.md")], "f string, n string, p string")
    got = row.select(text.formula_safe(F.col("f")).alias("f"), text.retraction_reason(F.col("n"), F.lit(None).cast("string")).alias("r"), text.path_keywords(F.col("p")).alias("k"), text.keyword_score(F.lit("Systemic JIA therapy"), F.array(F.lit("sjia"), F.lit("xyz"))).alias("s"), text.host_key(F.lit("https://a.b/c")).alias("h")).first()
    assert (got["f"], got["r"], got["k"], got["s"], got["h"]) == ("'=1+1", "Retraction Note: Some title", ["case", "sjia", "treatment"], 0.5, "https://a.b")
