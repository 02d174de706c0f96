from refsieve.plans.schemas import REGISTRY
from refsieve.streaming.documents import watch


def test_files_are_graded_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("Ravelli A, Martini B. A trial of early therapy. Lancet. 2020;1:5. PMID: 1234567")
    registry = spark.createDataFrame([("1234567", "A trial of early therapy", ["Ravelli A", "Martini B"], "Lancet", "2020", *([None] * 4), True, False, False, None, None, None)], REGISTRY)
    for _ in range(2):
        watch(spark, str(source), registry, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["id"], r["verdict"]) for r in rows] == [("1234567", "correct")]


def test_all_kinds_are_graded(spark, tmp_path):
    from refsieve.plans.schemas import ARXIV_RECORD, DOI_RECORD

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("see PMID: 1234567, doi:10.1000/lost and arXiv:2101.00001")
    registry = spark.createDataFrame([("1234567", "A trial of early therapy", ["Ravelli A"], "Lancet", "2020", *([None] * 4), True, False, False, None, None, None)], REGISTRY)
    dois = spark.createDataFrame([("10.1000/lost", "not_found", *([None] * (len(DOI_RECORD.split(",")) - 2)))], DOI_RECORD)
    arxiv = spark.createDataFrame([("2101.00001", "not_found", *([None] * (len(ARXIV_RECORD.split(",")) - 2)))], ARXIV_RECORD)
    watch(spark, str(tmp_path / "in"), registry, str(tmp_path / "out"), str(tmp_path / "cp"), doi_records=dois, arxiv_records=arxiv).awaitTermination()
    rows = {r["kind"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == {"pmid", "doi", "arxiv"} and (rows["doi"], rows["arxiv"]) == ("unknown", "invalid")
