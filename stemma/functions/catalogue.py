"""Functions of catalogue fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the eras, by the first year after them.
ERAS = ((1700, "17世紀"), (1800, "18世紀"), (1850, "19世紀前半"), (1900, "19世紀後半"))
LAST_ERA = "20世紀初頭"


def year_number(year: Column) -> Column:
    """The year as an integer, where the text is one."""
    return F.when(year.rlike("^-?[0-9]{1,9}$"), year.cast("int"))


def sort_year(year: Column) -> Column:
    """An exact year; the last year but one of a century; null for all else."""
    century = F.regexp_extract(year, "^([0-9]{1,7})世紀$", 1)
    return F.coalesce(year_number(year), F.when((century != "") & (F.try_to_number(century, F.lit("9999999")) > 0), century.cast("int") * 100 - 1))


def era(year: Column) -> Column:
    """The era of an exact year; others have none."""
    y = year_number(year)
    out = F.when(y.isNull(), "")
    for limit, name in ERAS:
        out = out.when(y < limit, name)
    return out.otherwise(LAST_ERA)


def haystack(strings: list[str], arrays: list[str]) -> Column:
    """All searchable fields in one lower-case string; a missing one leaves its place empty."""
    parts = [F.coalesce(F.col(s), F.lit("")) for s in strings]
    values = F.concat(F.array(*parts), *[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    return F.lower(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), " "))


def multiset_overlap(left: Column, right: Column) -> Column:
    """How many elements on the left are on the right too, repeated ones each."""
    return F.size(F.filter(left, lambda x: F.array_contains(right, x)))


def tags(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


#: Parameters of a catalogue's address in their order, with what each is where it is not there; and that of full-text search.
PARAMETERS = {"q": "", "type": "", "region": "", "language": "", "era": "", "sort": "year-asc", "perPage": "12", "page": "1"}
FULLTEXT = "fulltext"


def parameter(url: Column, name: str) -> Column:
    """A parameter of an address, decoded; null if it is not there."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    found = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.url_decode(F.substring(F.try_element_at(found, F.lit(1)), F.lit(len(name) + 2), F.length(query)))


def asked(url: Column, name: str) -> Column:
    """What an address asks for, or the default; pages are whole numbers from 1, sizes those that there are."""
    value = F.coalesce(F.nullif(parameter(url, name), F.lit("")), F.lit(PARAMETERS[name]))
    if name == "page":
        return F.greatest(F.coalesce(F.floor(value.try_cast("double")), F.lit(1)), F.lit(1)).cast("string")
    return F.when(value.isin("6", "12", "24", "all"), value).otherwise(PARAMETERS[name]) if name == "perPage" else value


def address(url: Column, state: dict[str, Column]) -> Column:
    """The address with a state (by PARAMETERS) instead of its own: defaults left out, full-text query and fragment kept."""
    coded = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(value))
    fulltext = F.nullif(parameter(url, FULLTEXT), F.lit(""))
    parts = [F.when(fulltext.isNotNull(), coded(FULLTEXT, fulltext))]
    for name, default in PARAMETERS.items():
        value = state[name].cast("string")
        other = state[name].cast("long") > 1 if name == "page" else (value != default) & (value != "")
        parts.append(F.when(other, coded(name, value)))
    query = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "&")
    return F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.regexp_extract(url, "(#.*)?$", 1))
