"""Options, lint, registry answers, the flow from files to reports, and hostile inputs."""

import io
import json
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from refsieve.functions import match, text
from refsieve.operators import export, flow, lint, rollup, verify
from refsieve.plans import catalog, catalog_flow, synth  # noqa: F401
from refsieve.plans.options import Options, masked_proxy, redacted_arguments
from refsieve.plans.schemas import ARXIV_RECORD, DOI_RECORD
from refsieve.sources import context, files, records

SF = "/root/testdata/sf0.001"
CLAIM = "n int, claimed_title string, claimed_authors array<string>, claimed_journal string, claimed_year string, title string, authors array<string>, journal string, pubdate string"


def test_options():
    got = Options(workers=20, retries=9).checked()
    assert (got.workers, got.retries, len(got.warnings)) == (8, 3, 2)
    for wrong in ({"timeout": 0}, {"cache_days": -1}, {"threshold": 1.5}, {"workers": 0}, {"retries": -1}, {"max_entries": -2}, {"title": "t", "pmids": ("1", "2")}, {"title": "t", "claims": "x", "pmids": ("1",)}, {"journal": "j"}):
        with pytest.raises(ValueError):
            Options(**wrong).checked()
    assert Options(title="t", pmids=("1",), year="2001").direct_claim() == ("1", "t", None, "2001")


def test_secrets_are_masked():
    assert redacted_arguments(["--ncbi-api-key", "K", "--source", "x"]) == ["--ncbi-api-key", "***", "--source", "x"]
    assert redacted_arguments(["--nc=K", "--ncbi-api-key=K", "a=b"]) == ["--nc=***", "--ncbi-api-key=***", "a=b"]
    assert masked_proxy("http://u:p@h:1") == "http://u:****@h:1" and masked_proxy("http://h:1") == "http://h:1"


def test_lint_header_and_counts(spark):
    assert [i[:2] for i in lint.header(["PMID", "Titel"])] == [("unknown_column", "WARN")] and [i[0] for i in lint.header(["title"])] == ["no_id_column"]
    rows = spark.createDataFrame([(1, "1", None, None, "t"), (2, None, None, None, None), (3, "1", None, None, "t")], "line long, pmid string, doi string, arxiv_id string, title string")
    assert {(r["line"], r["tag"]) for r in lint.sheet(rows).collect()} == {(2, "blank_row"), (3, "duplicate_key")}
    assert lint.outcome(lint.sheet(rows)).first().asDict() == {"errors": 0, "warnings": 1, "infos": 1, "exit_code": 0}
    entry = spark.createDataFrame([(7, "a: ERROR b", "article", {}, "none", None, None)], "line long, citekey string, entry_type string, fields map<string,string>, route string, id string, issue string")
    assert all("a_ ERROR b" in r["message"] for r in lint.entries(entry).collect())


def test_dois(spark):
    pairs = [("10.1186/x", "10.1186/X", True), ("https://doi.org/10.1186/X", "10.1186/x", True), ("http://dx.doi.org/10.1/AbC", "doi: 10.1/abc", True), ("doi:doi:10.1/x", "10.1/x", True), ("dx.doi.org/10.1/x", "10.1/X", True), ("10.1/x.", "10.1/x", True), ("10.4012/a", "10.1186/b", False), ("", "10.1/x", False), ("10.1/x", "", False), (None, None, False)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", text.doi_match(F.col("a"), F.col("b"))).collect())


def test_journals(spark):
    full = "New England Journal of Medicine"
    pairs = [("N Engl J Med", full, True), (full, "N Engl J Med", True), ("Pediatr Rheumatol Online J", "Pediatric Rheumatology Online Journal", True), ("N. Engl. J. Med.", full, True), ("Nature", full, False), ("Lancet", full, False), ("Med Engl J N", full, False), (r"A\E.* B", full, False), ("w " * 300, "w " * 301, True)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    both = match.journal_abbreviates(F.col("a"), F.col("b")) | match.journal_abbreviates(F.col("b"), F.col("a"))
    assert [(r["a"], r["got"]) for r in frame.withColumn("got", both).collect()] == [(a, want) for a, _, want in pairs]


def test_authors(spark):
    rows = [(["A"], ["Zaripova A"], False, False, "partial"), (["Zaripova", "A."], ["A Zaripova", "B Smith"], True, False, "partial"), (["张三"], ["Zhang San"], False, True, "unknown"), (["Zaripova A"], ["Zaripova A"], True, False, "partial"), (["Smith", "张三"], ["Smith J"], True, True, "partial"), (["Ravelli"], ["Smith J"], False, False, "partial"), (["Zaripova"], ["Zaripova A"], True, False, "partial")]
    frame = spark.createDataFrame([(i, None, a, None, None, None, b, None, None) for i, (a, b, *_) in enumerate(rows)], CLAIM)
    got = {r["n"]: r for r in match.cross_check(frame).collect()}
    for i, (_, _, hit, skipped, _) in enumerate(rows):
        assert (got[i]["author_match"], got[i]["author_any_skip"]) == (hit, skipped), i
    assert got[2]["verdict"] == "unknown" and got[5]["verdict"] == "partial" and "author differs" in got[5]["details"] and "title differs" not in got[5]["details"]
    other = spark.createDataFrame([(0, None, ["张三"], "Lancet", "2007", None, ["Zhang San"], "Lancet", "2007 Jun")], CLAIM)
    assert match.cross_check(other).first()["verdict"] == "partial"


def test_registry_answers_that_are_none(spark):
    body = json.dumps({"result": {"999": {"title": "T", "source": "X", "elocationid": "pii: RP9. doi: 10.1/y"}, "7": {"error": "gone"}, "8": {"title": "U", "articleids": [{"idtype": "pubmed", "value": "8"}, {"idtype": "doi", "value": "10.7554/e"}], "elocationid": "pii: x", "pubtype": ["Retraction of Publication"]}}})
    asked = spark.createDataFrame([(["999", "7", "8", "5"], body), (["1"], "not json"), (["2"], None), (["3"], "{}")], "pmids array<string>, body string")
    got = {r["pmid"]: r for r in records.ncbi_summaries(asked).collect()}
    assert got["999"]["doi"] == "10.1/y" and got["8"]["doi"] == "10.7554/e" and not got["8"]["retracted"]
    assert [(got[k]["valid"], got[k]["network_error"]) for k in ("7", "5", "1", "2", "3")] == [(False, False), (False, False), (False, True), (False, True), (False, True)]
    feeds = spark.createDataFrame([("a", "<feed><entry>"), ("b", None), ("c", "<feed></feed>"), ("d", "plain")], "arxiv_id string, body string")
    assert {r["arxiv_id"]: r["status"] for r in records.arxiv_feed(feeds).collect()} == {"a": "error", "b": "error", "c": "not_found", "d": "error"}
    works = spark.createDataFrame([("10.1/A", 200, "oops"), ("10.1/B", 404, ""), ("10.1/C", 200, '{"message": {}}')], "doi string, http_status int, body string")
    assert {r["doi"]: r["status"] for r in records.crossref_works(works).collect()} == {"10.1/a": "error", "10.1/b": "not_found", "10.1/c": "resolved"}


def test_contexts():
    golden = [
        ("Ravelli A, Martini A. Juvenile idiopathic arthritis. Lancet. 2007;369:767-78. PMID: 17336654", ("Juvenile idiopathic arthritis", ["Ravelli", "Martini"], "Lancet", "2007")),
        ("prose first here. Van Dijk M. Title of the work here. Some Journal. 2010;1. PMID 1234567", ("Title of the work here", ["Van"], "Some Journal", "2010")),
        ("As others show. Ravelli A, et al. Use of CT in ICU. Lancet. 2007. PMID: 17336654", ("Use of CT in ICU", ["Ravelli"], "Lancet", "2007")),
        ("Smith J, Doe A. Trials, e.g. dosage effects. J Clin Med. 2020;1:2. PMID: 123456", ("Trials, e.g. dosage effects", ["Smith", "Doe"], "J Clin Med", "2020")),
        ("[2] Long descriptive title words here for test. Journal of X. 2001.", ("[2] Long descriptive title words here for test", [], "Journal of X", "2001")),
        ("## The heading title in export. - DOI: 10.1/x 2064 | J | A PMID: 12345", ("The heading title in export", [], "", "")),
    ]
    for line, want in golden:
        c = context.parse(line)
        assert (c.title, c.authors, c.journal, c.year) == want, line


def test_broken_files():
    def packed(name, data, flag=0):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue().replace(b"PK\x01\x02\x14\x03\x14\x00\x00", b"PK\x01\x02\x14\x03\x14\x00" + bytes([flag]))

    deep = b"<article>" + b"<p>" * 20_000 + b"x" + b"</p>" * 20_000 + b"</article>"
    assert files.decode("a.jats", b"<article><p>x</p></article>")[:2] == ("x", "jats")
    assert files.decode("a.xml", deep)[0].strip().endswith("x") or files.decode("a.xml", deep)[2]
    for name, data in (("a.docx", packed("word/document.xml", "<x/>", 1)), ("a.docx", b"junk"), ("a.pptx", packed("other", "x")), ("a.xml", b"<a>")):
        assert files.decode(name, data)[2] in (True, False)
    assert files.wanted(F.lit("x.jats")) is not None and "jats" in files.EXTENSIONS and "csv" not in files.EXTENSIONS


def test_from_files_to_reports(spark, tmp_path):
    paper = synth.registry(spark, SF).where("valid and not retracted").orderBy("pmid").first()
    (tmp_path / "in").mkdir()
    line = f"{paper['authors'][0]}, {paper['authors'][1]}. {paper['title']}. {paper['journal']}. 2001;1:2. PMID: {paper['pmid']}\nsee doi:10.9/none and {paper['doi']} and arXiv:2101.00001"
    (tmp_path / "in" / "ev_a.txt").write_text(line)
    none = spark.createDataFrame([], "id string, claimed_title string, claimed_authors array<string>, claimed_journal string, claimed_year string, claimed_doi string")
    dois = spark.createDataFrame([(paper["doi"], "resolved")], "doi string, status string").select("doi", "status", *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in DOI_RECORD.split(", ")) if n not in ("doi", "status")])
    arxiv = spark.createDataFrame([], ARXIV_RECORD)
    rows = flow.audit_folder(spark, str(tmp_path / "in"), none, synth.registry(spark, SF), dois, arxiv).cache()
    got = {r["id"]: r["verdict"] for r in rows.collect()}
    assert got[paper["pmid"]] == "correct" and paper["doi"] not in got and got["2101.00001"] == "unknown"
    changes = rollup.delta(spark.createDataFrame([("old", "correct", False)], "key string, verdict string, retracted boolean"), rows.withColumn("key", F.col("id")))
    assert {r["category"]: r["n"] for r in rollup.delta_counts(changes).collect()} == {"dropped": 1, "new": len(got)}
    export.audit_report(rows, str(tmp_path / "audit.json"), {"sequence": True}, changes)
    whole = json.loads((tmp_path / "audit.json").read_text())
    assert whole["summary"]["total"] == len(got) and whole["delta_vs_baseline"]["dropped"] == 1 and len(whole["citations"]) == len(got) and whole["honesty_notes"]
    for form in ("json", "md", "html", "csv", "txt"):
        export.report(rows, str(tmp_path / f"r.{form}"), changes)
        told = (tmp_path / f"r.{form}").read_text(encoding="utf-8-sig")
        assert paper["pmid"] in told and ("dropped: 1" in told or form in ("json", "csv")), form
    export.report(rows, str(tmp_path / "r.jsonl"))
    lines = [ln for p in sorted((tmp_path / "r.jsonl").glob("part-*")) for ln in p.read_text().splitlines()]
    assert len(lines) == len(got) + 1 and "_stats" in json.loads(lines[-1])
    with pytest.raises(ValueError):
        export.report(rows, str(tmp_path / "r.doc"))


def test_sinks_compute_the_rows_once(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            passed.add(len(frame))
            yield frame

    rows = verify.verify_pmid(synth.claims(spark, SF), synth.registry(spark, SF), False).withColumn("pmid", F.col("id"))
    n, counted = rows.count(), rollup.stats(rows).first().asDict()
    rows = rows.mapInPandas(count, rows.schema)
    kept, counts = export.settled(rows)
    assert passed.value == n and counts.first().asDict() == counted and kept.count() == n
    export.evidence_pack(rows, str(tmp_path / "pack"))
    assert passed.value == 2 * n
    summary = spark.read.json(str(tmp_path / "pack" / "summary")).first().asDict()
    assert {k: summary[k] for k in counted} == counted
    export.report(rows, str(tmp_path / "r.html"))
    export.audit_report(rows, str(tmp_path / "a.json"), {})
    assert passed.value == 4 * n
    page = (tmp_path / "r.html").read_text()
    assert page.count("<tr ") == n and page.count(" retracted") == counted["retracted"] and "pick('splice')" in page


def test_filters_are_not_rewritten_through_the_ladder(spark):
    rows = verify.verify_pmid(synth.claims(spark, SF), synth.registry(spark, SF), False).where("verdict = 'mismatch'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000 and "Generate inline" in plan


def test_audit_keeps_each_cited_paper(spark, tmp_path):
    """Papers beyond 100,000, whose arXiv ids are those of others, are not taken for them; nothing is graded only to merge DOIs."""
    con = duckdb.connect()
    for table, keys in (("part", {"p_partkey": 100_000}), ("orders", {"o_orderkey": 1_000_000, "o_custkey": 100_000})):
        shifted = ", ".join(f"{k} + {by} * i AS {k}" for k, by in keys.items())
        con.execute(f"copy (select * replace ({shifted}) from '{SF}/{table}.parquet', range(2) t(i)) to '{tmp_path}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    rows = catalog.QUERIES["audit"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 3
    got = Counter((r["kind"], r["input_ord"], r["id"], r["verdict"]) for r in rows.collect())
    assert got == Counter(con.execute(f"select kind, input_ord, id, verdict from ({catalog.ORACLES['audit']})").fetchall())
