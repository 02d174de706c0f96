"""Text, identifier and keyword functions as column expressions.

Regular expressions avoid what engines read differently: word characters are
letters, digits and the underscore by Unicode property, and the wide and the
no-break space count as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that titles are compared without.
STOP_WORDS = (
    "a an the of in on for and to with by from is are was were at as or its it this that which be has have had not but "
    "also into than through during between their our we they can may via no all such"
).split()
#: Prefixes that a DOI may carry, and marks that may trail it.
DOI_PREFIX = r"^(?:(?:https?://(?:dx\.)?doi\.org/|dx\.doi\.org/|doi\.org/|doi:)\s*)+"
DOI_TAIL = r"[.,;:。，；）」】)\]}!?！？\"”’'\s]+$"
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"
#: Months 01-12 in new identifiers; archive and optional class in old ones.
ARXIV_NEW, ARXIV_OLD = r"(?i)^\d{2}(0[1-9]|1[0-2])\.\d{4,5}(v\d+)?$", r"(?i)^[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"
YEAR = r"((?:19|20)\d{2})"
#: Topic keywords and what they stand for.
KEYWORDS = {
    "sjia": ["systemic juvenile idiopathic arthritis", "systemic jia"],
    "csle": ["childhood systemic lupus", "childhood-onset sle", "childhood lupus", "pediatric sle", "juvenile sle", "lupus nephritis"],
    "sle": ["lupus", "systemic lupus erythematosus"],
    "jia": ["juvenile idiopathic arthritis", "juvenile arthritis"],
    "jdm": ["juvenile dermatomyositis", "dermatomyositis"],
    "kd": ["kawasaki"],
    "mas": ["macrophage activation syndrome"],
    "igav": ["iga vasculitis", "henoch-schönlein", "henoch schonlein", "hsp", "purpura"],
    "aid": ["autoinflammatory", "autoinflammation", "recurrent fever"],
    "fmf": ["familial mediterranean fever"],
    "caps": ["cryopyrin-associated periodic", "cryopyrin associated"],
    "savi": ["sting-associated vasculopathy", "sting associated", "sting vasculopathy", "sting", "vascular and pulmonary"],
    "traps": ["tnf receptor-associated"],
    "nlrc4": ["nlrc4"],
    "ild": ["interstitial lung disease", "lung disease"],
    "pid": ["primary immunodeficiency", "immunodeficiency"],
    "alps": ["autoimmune lymphoproliferative", "alps"],
    "cvid": ["common variable immunodeficiency"],
    "cgd": ["chronic granulomatous disease"],
    "scid": ["severe combined immunodeficiency"],
    "xla": ["x-linked agammaglobulinemia", "bruton"],
    "itp": ["immune thrombocytopenia", "thrombocytopenic"],
    "evans": ["evans syndrome"],
    "uveitis": ["uveitis"],
    "behcet": ["behçet", "behcet"],
    "ln": ["lupus nephritis", "nephritis"],
    "aiha": ["autoimmune hemolytic", "hemolytic anemia"],
    "lahps": ["lupus anticoagulant", "hypoprothrombinemia"],
    "ivig": ["intravenous immunoglobulin", "immunoglobulin", "ivig", "igg"],
    "cal": ["coronary aneurysm", "coronary artery"],
    "gio": ["glucocorticoid-induced osteoporosis", "osteoporosis", "bone loss", "fracture"],
    "ctd": ["connective tissue disease"],
    "ar": ["autoimmune regulator", "aire", "aps-1"],
    "npsle": ["neuropsychiatric lupus", "cns lupus"],
    "apls": ["antiphospholipid", "antiphospholipid syndrome"],
    "refractory": ["refractory", "resistant"],
    "biologic": ["biologic", "biological", "biologics"],
    "failure": ["failure", "refractory", "resistant"],
    "early": ["early", "initial", "onset"],
    "incomplete": ["incomplete", "atypical"],
    "nephritis": ["nephritis", "renal", "glomerul"],
    "pulmonary": ["pulmonary", "lung", "respiratory"],
    "gi": ["gastrointestinal"],
    "double": ["double", "repeat", "second"],
    "neuro": ["neurologic", "neurological", "nervous system"],
    "shock": ["shock", "toxic shock"],
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def plain_blanks(c: Column) -> Column:
    return F.translate(c, "　 ", "  ")


def folded(c: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain_blanks(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def single_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain_blanks(F.coalesce(c, F.lit(""))), r"\s+", " "))


def word_set(c: Column) -> Column:
    """Distinct words without stop words; empty for null."""
    words = F.split(folded(F.coalesce(c, F.lit(""))), " ")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, [*STOP_WORDS, ""])))


def shared_ratio(shared: Column, ours: Column, theirs: Column) -> Column:
    """Jaccard of two sets from how many elements they share and have; 0 if either is empty."""
    return F.when((ours > 0) & (theirs > 0), shared.cast("double") / (ours + theirs - shared)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    return shared_ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(CJK), F.lit(False))


def clean_doi(c: Column) -> Column:
    """Lower case without URL or doi: prefixes, query and trailing marks; "" for null."""
    body = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), DOI_PREFIX, "")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)\?.*$", ""), DOI_TAIL, "")


def doi_match(a: Column, b: Column) -> Column:
    return (clean_doi(a) == clean_doi(b)) & (clean_doi(a) != "")


def arxiv_id(c: Column) -> Column:
    """An identifier without its arxiv: prefix and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^arxiv:\s*", ""), r"\.+$", "")


def arxiv_valid(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"(?i)arxiv:", "")
    return F.coalesce(bare.rlike(ARXIV_NEW) | F.trim(c).rlike(ARXIV_OLD), F.lit(False))


def first_year(c: Column) -> Column:
    """The first 19xx or 20xx, as text; "" if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 1)


def keyword_score(title: Column, keywords: Column) -> Column:
    """The share of keywords that a title holds, itself or what it stands for; 1 if either is empty."""
    table = F.create_map(*[x for k, v in KEYWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    low = F.lower(title)
    hit = lambda k: F.contains(low, F.lower(k)) | F.exists(F.coalesce(F.try_element_at(table, F.lower(k)), F.array().cast("array<string>")), lambda x: F.contains(low, x))
    share = F.size(F.filter(keywords, hit)).cast("double") / F.size(keywords)
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(F.size(keywords), F.lit(0)) <= 0), 1.0).otherwise(share)


def path_keywords(path: Column) -> Column:
    """Keywords of a file name: its stem without a known prefix, cut at _ and -, longer than two."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "[/\\\\]"), -1)), r"\.[^.]*$", "")
    return F.filter(F.split(F.regexp_replace(stem, "^(ev_|case_|paper_|ref_)", ""), "[_-]"), lambda w: F.length(w) > 2)


def retraction_reason(title: Column, abstract: Column) -> Column:
    """The notice's abstract, else its title if that names a retraction, without its opening if the rest still does."""
    names = r"(?i)retract|withdraw|removal|removed|invalid|misconduct|duplicate|unreliable|erratum|corrigendum"
    t, a = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(abstract, F.lit("")))
    rest = F.trim(F.regexp_replace(t, r"(?i)^\s*(retraction|withdrawal|removal|retracting|retracted)[^:]{0,40}:\s*", ""))
    return F.substring(F.when(a != "", a).when(~t.rlike(names), "").when(rest.rlike(names), rest).otherwise(t), 1, 300)


def formula_safe(c: Column) -> Column:
    """A spreadsheet cell that cannot start a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def markdown_safe(c: Column) -> Column:
    return F.substring(F.regexp_replace(single_blanks(c), r"([\\\[\]|])", r"\\$1"), 1, 120)


def strip_tags(c: Column, most: int = 400) -> Column:
    return F.substring(single_blanks(F.regexp_replace(c, "<[^>]+>", " ")), 1, most)


def pubtype_retracted(types: Column) -> Column:
    """Whether a list of publication types has "retracted publication" itself."""
    return F.coalesce(F.array_contains(F.transform(types, F.lower), "retracted publication"), F.lit(False))


def registered_doi(article_ids: Column, elocation: Column) -> Column:
    """The doi of an identifier list, else what the e-location, which may name several ids, marks as one."""
    listed = F.filter(article_ids, lambda x: (x["idtype"] == "doi") & (F.coalesce(x["value"], F.lit("")) != ""))
    return F.coalesce(F.try_element_at(listed, F.lit(1))["value"], F.nullif(F.regexp_extract(F.coalesce(elocation, F.lit("")), r"doi:\s*(\S+)", 1), F.lit("")), F.lit(""))


def host_key(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")))
