"""Reference styles as column expressions over title, authors (", "-joined), authors_truncated, journal, pubdate, volume, issue, pages, doi."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refsieve.functions.text import first_year, single_blanks

#: Styles that list entries by first author, without numbers.
AUTHOR_DATE = ("gbty", "harvard", "chicago")
TRUNCATED = " [registry returned a truncated author list]"


def author_list(c: str = "authors") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[,;]"), lambda a: F.trim(a)), lambda a: a != "")


def _each(form: Callable[[Column, Column], Column], lone: Callable[[Column], Column] = lambda a: a) -> Column:
    """Authors, each by ``form(family, initials)``; single names by ``lone``."""

    def one(a: Column) -> Column:
        parts = F.split(a, r"\s+")
        initials = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.upper(F.substring(p, 1, 1)))
        return F.when(F.size(parts) < 2, lone(a)).otherwise(form(F.element_at(parts, 1), initials))

    return F.transform(author_list(), one)


def _cut(names: Column, most: int, tail: str | Column) -> Column:
    short = F.coalesce(F.col("authors_truncated"), F.lit(False)) | (F.size(names) > most)
    return F.when(short, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(", "), tail if isinstance(tail, Column) else F.lit(tail))).otherwise(F.array_join(names, ", "))


def _joined(names: Column, two: str, last: str) -> Column:
    n = F.size(names)
    but_last = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    whole = F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(but_last, F.when(n == 2, two).otherwise(last), F.get(names, n - 1)))
    return F.when(F.coalesce(F.col("authors_truncated"), F.lit(False)) & (n > 0), F.concat(F.array_join(names, ", "), F.lit(", et al."))).otherwise(whole)


def authors_in(style: str) -> Column:
    """The author list as a style writes it; "" without authors."""
    if style in ("gbt", "gbty"):
        cjk = F.exists(author_list(), lambda a: a.rlike(r"[一-鿿]"))
        latin = _each(lambda f, i: F.concat_ws(" ", F.upper(f), F.array_join(i, " ")), F.upper)
        return F.when(F.size(author_list()) == 0, "").when(cjk, _cut(author_list(), 3, "等")).otherwise(_cut(latin, 3, "et al"))
    if style in ("vancouver", "ama"):
        return F.when(F.size(author_list()) == 0, "").otherwise(_cut(_each(lambda f, i: F.concat_ws(" ", f, F.array_join(i, ""))), 6, "et al"))
    if style == "harvard":
        return _joined(_each(lambda f, i: F.concat(f, F.lit(", "), F.array_join(i, ". "), F.lit("."))), " and ", " and ")
    if style == "chicago":
        return _joined(_each(lambda f, i: F.concat(f, F.lit(", "), F.array_join(i, ""))), ", and ", ", and ")
    return _joined(_each(lambda f, i: F.concat(f, F.lit(", "), F.array_join(i, ". "), F.lit("."))), ", & ", ", & ")


def _if(c: Column, *parts: Column | str) -> Column:
    """The parts joined, if ``c`` is not empty; else ""."""
    return F.when(c != "", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")


def reference(style: str, index: Column) -> Column:
    """One entry of a reference list. ``index`` is its number, used by the numbered styles."""
    title = single_blanks(F.regexp_replace(F.trim(F.coalesce(F.col("title"), F.lit(""))), r"\.+$", ""))
    journal, volume, pages = (single_blanks(F.col(k)) for k in ("journal", "volume", "pages"))
    issue = F.regexp_replace(single_blanks(F.col("issue")), r"^[()]+|[()]+$", "")
    year, doi, who = first_year(F.col("pubdate")), F.coalesce(F.col("doi"), F.lit("")), authors_in(style)
    number = index.cast("string")
    truncated = F.when(F.coalesce(F.col("authors_truncated"), F.lit(False)), TRUNCATED).otherwise("")
    brackets = _if(issue, "(", issue, ")")
    if style in ("gbt", "gbty"):
        mid = F.concat(journal, _if(year, _if(journal, ", "), year))
        mid = F.concat(mid, _if(volume, ", ", volume, brackets), F.when((pages != "") & ((volume != "") | (mid != "")), F.concat(F.lit(": "), pages)).otherwise(""))
        head = F.concat(F.lit("") if style == "gbty" else F.concat(F.lit("["), number, F.lit("] ")), _if(who, who, ". "))
        tag = F.when(mid != "", ".").otherwise("[J].") if style == "gbty" else F.lit("[J].")
        line = F.concat(_if(title, head, title, tag), F.lit(" "), _if(mid, mid, "."), _if(doi, " DOI:", doi, "."))
    elif style in ("vancouver", "ama"):
        place = _if(volume, volume, brackets)
        body = F.concat(journal, _if(year, _if(journal, ". "), year), F.when((place != "") | (pages != ""), F.concat(F.lit(";"), place, _if(pages, ":", pages))).otherwise(""))
        line = F.concat(number, F.lit(". "), _if(who, who, ". "), _if(title, title, ". "), _if(body, body, "."), _if(doi, " doi:", doi))
    elif style == "chicago":
        where = _if(journal, journal, F.when(volume != "", F.concat(F.lit(" "), volume, _if(issue, ", no. ", issue))).otherwise(_if(issue, ", no. ", issue)))
        line = F.concat(_if(who, who, F.when(F.endswith(who, F.lit(".")), " ").otherwise(". ")), _if(title, '"', title, '." '), where, _if(year, " (", year, ")", _if(pages, ": ", pages)), F.lit("."), _if(doi, " https://doi.org/", doi, "."), truncated)
    else:
        before, quote = (", pp. ", ("'", "', ")) if style == "harvard" else (", ", ("", ". "))
        mid = F.concat(journal, _if(volume, ", ", volume, brackets))
        mid = F.concat(mid, F.when((pages != "") & (mid != ""), F.concat(F.lit(before), pages)).otherwise(""))
        dated = _if(year, "(", year, ") " if style == "harvard" else "). ")
        link = _if(doi, " doi: ", doi, ".") if style == "harvard" else _if(doi, " https://doi.org/", doi)
        line = F.concat(_if(who, who, " "), dated, _if(title, quote[0], title, quote[1]), _if(mid, mid, "."), link, truncated)
    return single_blanks(line)


STYLES = ("gbt", "gbty", "vancouver", "ama", "apa", "harvard", "chicago")
