import hashlib
import random
import re

import duckdb

from stemma.llm import pii

#: The base definitions.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in twice) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "", re.A) if valid(k, m.group())]


PARTS = ["a", "@", ".", "1", "2 ", "-", "+", "(", ")", "4111111111111111", "é", "b.c", "@x.y", "1.2.3.4", "_", "%", " ", "😀"]


def texts():
    r = random.Random(5)
    fixed = ["", None, "a@b.c_d@e.f a@b..c a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "4111 1111-1111 1111  4111", "+1 (017) 555-7713 +", "😀x@y.zz" * 300]
    long_ = ["a" * 200_000, "1" * 100_000, "1-" * 50_000, "a@" + "b." * 50_000 + "c", "1." * 50_000, "x " * 50_000 + "q@r.st"]
    return fixed + long_ + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(400)]


def test_base_spans(spark, make_docs, tmp_path):
    all_ = texts()
    make_docs(all_).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op5_pii(spark, str(tmp_path)).collect():
        want = brute(all_[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), all_[r.doc_id][:80]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in BASE] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in BASE]


def test_added_kinds(make_docs):
    cases = {
        "pay to GB82 WEST 1234 5698 7654 32 now": ["GB82 WEST 1234 5698 7654 32"],
        "DE89370400440532013000": ["DE89370400440532013000"],
        "DE89370400440532013001 and DE8937040044053201300": [],  # check digits; length
        "my SSN is 123-45-6789": ["123-45-6789"],
        "number 123-45-6789": [],  # no context
        "SSN 000-45-6789": [],
    }
    rows = pii.find(make_docs(list(cases))).collect()
    for r in rows:
        assert [s.value for s in r.pii if s.kind in ("iban", "ssn")] == cases[r.text], r.text


def test_context_adds_to_the_score(make_docs):
    rows = {r.doc_id: r.pii[0].score for r in pii.find(make_docs(["call +1 555 123 4567", "x +1 555 123 4567"])).collect()}
    assert rows[0] > rows[1]


def test_redact(make_docs):
    long_ = " ".join(f"u{i}@h.org" for i in range(300))
    docs = make_docs(["é a@b.co and +4111111111111111, ok", "clean", "", None, "1.2.3.4@x.yz", long_])
    rows = {r.doc_id: r.text for r in pii.redact(pii.find(docs)).collect()}
    assert rows == {0: "é [EMAIL] and [CARD], ok".replace("[CARD]", "+[CARD]"), 1: "clean", 2: "", 3: None, 4: "[EMAIL]", 5: " ".join(["[EMAIL]"] * 300)}


def test_no_rows(make_docs):
    assert pii.redact(pii.find(make_docs([]))).count() == 0


def test_query(spark, small):
    all_ = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{small}/documents.parquet')").fetchall())
    rows = pii.op5_pii(spark, small).collect()
    assert len(rows) == len(all_)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(brute(all_[r.doc_id])).encode()).hexdigest()


def test_accounts_before_other_words(make_docs):
    """A following word in capitals or digits is not taken into an account, and countries of any length are known."""
    cases = {
        "IBAN GB82WEST12345698765432 BIC NWBK": ["GB82WEST12345698765432"],
        "GB82 WEST 1234 5698 7654 32 NOW": ["GB82 WEST 1234 5698 7654 32"],
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["DE89 3704 0044 0532 0130 00"],
        "DE89 3704 0044 0532 0130 00 2024 paid": ["DE89 3704 0044 0532 0130 00"],
        "NO93 8601 1117 947 X": ["NO93 8601 1117 947"],
        "UA21 3223 1300 0002 6007 2335 6600 1": ["UA21 3223 1300 0002 6007 2335 6600 1"],
        "BR15 0000 0000 0000 1093 2840 814 P2 OK": ["BR15 0000 0000 0000 1093 2840 814 P2"],
        "MT84MALT011000012345MTLCAST001S and LC55HEMM000100010012001200023015": ["MT84MALT011000012345MTLCAST001S", "LC55HEMM000100010012001200023015"],
    }
    for r in pii.find(make_docs(list(cases))).collect():
        assert [s.value for s in r.pii if s.kind == "iban"] == cases[r.text], r.text


def added(text):
    """All spans of the kinds that the method adds, one by one; as for the base kinds, a failing match is not retried."""
    out, last = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=([A-Z]{2})[0-9]{2})", text):
        n, at, taken = pii.IBAN_LENGTHS.get(m.group(1), 0), m.start(), ""
        if at < last:
            continue
        while len(taken) < n and at < len(text):
            one = re.match(r" ?([A-Z0-9])" if len(taken) >= 4 else r"([A-Z0-9])", text[at:])
            if not one:
                break
            taken, at = taken + one.group(1), at + one.end()
        if n and len(taken) == n and not re.match("[A-Za-z0-9]", text[at:]):
            last = at
            if int("".join(str(int(c, 36)) for c in taken[4:] + taken[:4])) % 97 == 1:
                out.append(f"iban:{m.start()}:{at}")
    all_ = list(re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text))
    ends, starts = [0, *(m.end() for m in all_)], [*(m.start() for m in all_[1:]), len(text)]
    for m, low, high in zip(all_, ends, starts, strict=False):
        near = (text[max(low, m.start() - 40) : m.start()] + " " + text[m.end() : min(high, m.end() + 40)]).lower()
        score = 0.3 + 0.4 * bool(re.search(r"(?<![a-z])(ssn|social security|tax id)(?![a-z])", near)) - 0.3 * bool(re.search(rf"(?<![a-z])({pii.DOUBTS})(?![a-z])", near))
        if m.group(1) not in ("000", "666") and m.group(1)[0] != "9" and m.group(2) != "00" and m.group(3) != "0000" and round(score, 2) >= 0.5:
            out.append(f"ssn:{m.start()}:{m.end()}")
    return out


def test_added_spans(make_docs, spark, tmp_path):
    """Against a search one by one; context counts on both sides."""
    r = random.Random(9)
    parts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82", "DE", "ssn", " ", ". ", "123-45-6789", "000-45-6789", "SSN", "tax id", "sample", "A1", "x", "12", "-", "é", "FR14 2004 1010 0505 0001 3M02 606", "long words between them so that the context is far away"]
    texts = ["123-45-6789 is my SSN", "SSN sample 123-45-6789", *(" ".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400))]
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = 0
    for r in pii.op5_pii(spark, str(tmp_path)).collect():
        got = [s for s in r.spans.split(",") if s.split(":")[0] in ("iban", "ssn")]
        assert got == added(texts[r.doc_id]), texts[r.doc_id]
        assert r.n_spans == len([s for s in r.spans.split(",") if s]) == len([s for s in r.scores.split(",") if s])
        found += len(got)
    assert found > 100
