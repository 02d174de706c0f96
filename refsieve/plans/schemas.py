"""The relations, as DDL. Absent values are null; order is explicit in ``input_ord``."""

CLAIM = "claimed_title string, claimed_authors array<string>, claimed_journal string, claimed_year string, claimed_doi string"
WORK_ITEM = f"id string, label string, explicit boolean, input_ord long, {CLAIM}"
REGISTRY = (
    "pmid string, title string, authors array<string>, journal string, pubdate string, volume string, issue string, pages string, doi string, "
    "valid boolean, network_error boolean, retracted boolean, retraction_note string, cited_by_count int, source string"
)
DOI_RECORD = "doi string, status string, title string, journal string, year string, authors array<string>, retracted boolean, retraction_note string, notice_doi string, abstract string, registry string"
ARXIV_RECORD = "arxiv_id string, status string, title string, year string, authors array<string>, registered_doi string"
#: Labels of input that the user vouches for.
EXPLICIT_LABELS = ("cli", "claims", "cli-quick")
#: Days that a cached record holds, if found and if not.
CACHE_DAYS, NEGATIVE_CACHE_DAYS = 30, 3
