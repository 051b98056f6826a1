"""Personal data: expressions propose, checksums confirm, context adjusts the score. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import let, narrowed, table

#: A span of a kind that the method adds counts from this score on; kinds with a base definition always stay.
THRESHOLD = 0.5
#: Characters before and after a span in which a context word counts, up to the next match of its kind, and what it
#: adds or takes.
NEAR, FOR, AGAINST = 40, 0.4, 0.3
#: Words near a span that make it less likely, whatever its kind.
DOUBTS = "example|sample|dummy|order no|serial|version|isbn"
#: Spans that are summed up together when positions are computed.
BLOCK = 64

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Lengths of account numbers by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _account_pattern() -> str:
    """A country's accounts have one length, so a word that follows is never taken in. An alternative for each length."""
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    return "|".join(rf"(?:{'|'.join(cs)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, cs in sorted(by.items()))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + let(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's check digits are right: letters count as 10 to 35, from the fifth character round."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


class Kind(NamedTuple):
    name: str
    pattern: str
    may: Callable[[Column], Column]  # a cheap test that all texts with a span pass
    valid: Callable[[Column], Column]
    score: float
    words: str  # of the context
    base: bool


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _account(span: Column) -> Column:
    return mod97(F.replace(span, F.lit(" "), F.lit("")))


# The patterns find what the plain definitions find, but each character is looked at a bounded number of times,
# however long a run is: a run is entered at its start or where the last match ended, quantifiers are possessive,
# and a repeated group is always one character, which Java matches without recursion.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@(?={HOST}++\.{HOST})(?:(?!\.(?!{HOST}))[A-Za-z0-9.-])++", lambda t: F.contains(t, F.lit("@")), lambda s: F.lit(True), 0.9, "e-?mail|contact|write to", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.contains(t, F.lit(".")), lambda s: s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 0.6, "ip|address|host|server", True),
    Kind("card", r"[0-9](?:(?![ -](?![0-9]))[0-9 -])++", lambda t: t.rlike("[0-9]"), lambda s: F.length(_digits(s)).between(16, 19) & luhn(_digits(s)), 0.8, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda s: F.length(_digits(s)).between(8, 15), 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_account_pattern()})(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"), _account, 0.8, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda s: ~s.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|tax id", False),
)
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """The valid spans of a kind, in order: kind, start and end (code points, end exclusive), value, score.

    Matches and the pieces between them come from the same expression; a match begins after all pieces and
    matches before it. Their lengths are summed by block first, so a text with many spans costs little more
    than one pass.
    """
    pattern = F.lit(kind.pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    # A space stands for the span itself, so that no word is made of what is before and after it.
    near = lambda p, after: F.lower(F.concat(F.right(p, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    part = lambda x: F.struct(F.length(x.p).alias("gap"), F.length(x.m).alias("n"), x.m.alias("m"), near(x.p, x.after).alias("near"))
    total = lambda rows: F.aggregate(rows, F.lit(0), lambda a, r: a + r.gap + r.n)
    word = lambda words: rf"(?<![a-z])(?:{words})(?![a-z])"

    def placed(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(rows, b * BLOCK + 1, F.lit(BLOCK))))
        sums = let(blocks, lambda bs: F.transform(bs, lambda _, b: F.aggregate(F.slice(bs, F.lit(1), b), F.lit(0), lambda a, x: a + x)))

        def at(before: Column, r: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.element_at(before, b + 1) + total(F.slice(rows, b * BLOCK + 1, i % BLOCK)) + r.gap
            score = F.lit(kind.score) + F.when(r.near.rlike(word(kind.words)), FOR).otherwise(0.0) - F.when(r.near.rlike(word(DOUBTS)), AGAINST).otherwise(0.0)
            score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + r.n).alias("end"), r.m.alias("value"), score.alias("score"))

        return let(sums, lambda before: F.transform(rows, lambda r, i: at(before, r, i)))

    zipped = lambda f: F.arrays_zip(F.slice(f.p, F.lit(1), F.size(f.m)).alias("p"), f.m.alias("m"), F.slice(f.p, F.lit(2), F.size(f.m)).alias("after"))
    rows = let(found, lambda f: F.transform(zipped(f), part))
    out = F.when(kind.may(text), let(rows, lambda r: F.when(F.size(r) > 0, placed(r))))
    keep = lambda s: kind.valid(s.value) & (F.lit(kind.base) | (s.score >= THRESHOLD))
    return F.filter(F.coalesce(out, F.array().cast(SPAN)).cast(SPAN), keep)


def find(docs: DataFrame) -> DataFrame:
    """Add column `pii`: the spans of all kinds, by kind in the order of KINDS, then by start.

    Null and empty texts have none. Every row is judged by itself, in the task that reads it: repeated rows
    get the same spans, and no row is moved. A column `pii` that is there is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans_of(text, k) for k in KINDS]))


def redact(docs: DataFrame) -> DataFrame:
    """Replace the spans of `pii` in `text` by their kind in brackets, and drop `pii`.

    Where spans overlap, the first (the longer one of two with one start) gives the name, and the others
    just lengthen it. A null text stays null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).when(a.end > b.end, -1).when(a.end < b.end, 1).otherwise(0)

    def rebuilt(spans: Column) -> Column:
        # The end of all spans before span i: blocks first, as for positions.
        most = lambda rows: F.aggregate(rows, F.lit(0), lambda a, s: F.greatest(a, s.end))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: most(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))))
        sums = let(blocks, lambda bs: F.transform(bs, lambda _, b: F.aggregate(F.slice(bs, F.lit(1), b), F.lit(0), lambda a, x: F.greatest(a, x))))

        def piece(before: Column, s: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            seen = F.greatest(F.element_at(before, b + 1), most(F.slice(spans, b * BLOCK + 1, i % BLOCK)))
            return let(seen, lambda e: F.when(s.start >= e, F.concat(F.substring(text, e + 1, s.start - e), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(""))

        return let(sums, lambda before: F.concat(F.array_join(F.transform(spans, lambda s, i: piece(before, s, i)), ""), F.substring(text, most(spans) + 1, F.length(text))))

    new = F.when(F.size("pii") == 0, F.col("text")).otherwise(let(F.array_sort("pii", order), rebuilt))
    return docs.withColumn("text", new).drop("pii")


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(narrowed(table(spark, sf_dir, "documents"), "doc_id", "text"))
    count = lambda name: F.size(F.filter("pii", lambda s: s.kind == name)).cast("long").alias(f"n_{name}")
    base = [k.name for k in KINDS if k.base]
    sha = F.sha2(_said(F.filter("pii", lambda s: s.kind.isin(base))), 256).alias("base_sha256")
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s.score)), ",").alias("scores")
    return found.select("doc_id", *map(count, base), sha, _said(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), scores)
