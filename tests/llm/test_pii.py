import hashlib
import random
import re
import time

from cases import documents, rows
from penprint.llm import pii

# The base rules as plain expressions.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_expressions():
    rnd = random.Random(5)
    parts = list("aB9.0_%+-@@..12 3() ") + ["4111111111111111", "1.2.3.4", "255", "256", "@x.com", "é", "+1 ", "٣", "🙂"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert [(s.start, s.kind, s.end) for s in pii.spans_of(text)[0]] == plain(text), text


def test_added_kinds_need_checksum_or_context():
    def kinds(text):
        return [(pii.BASE + pii.ADDED)[s.kind] for s in pii.spans_of(text)[1]]

    assert kinds("iban GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("GB82WEST12345698765432") == ["iban"]
    assert kinds("iban GB83 WEST 1234 5698 7654 32") == []
    assert kinds("call (785) 555-4434") == ["local_phone"] and kinds("part (785) 555-4434") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    assert kinds("call +1 (785) 555-4434") == ["phone"]


def test_rows_and_redaction(spark):
    data = rows() + [(20, "Mail é.x@a-b.org, card 4111 1111 1111 1111 at 10.0.0.1 or +49 (30) 123-4567."),
                     (21, "a@b.com_c@d.com a@b.com@e.org")]
    got = sorted(map(tuple, pii.find(documents(spark, data)).drop("scores").collect()), key=repr)
    want = []
    for i, t in data:
        base, every = pii.spans_of(t)
        text = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in plain(t or ""))
        assert pii.written(base) == text
        want.append((i, *(sum(s.kind == k for s in base) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(),
                     pii.written(every)))
    assert got == sorted(want, key=repr)
    docs = documents(spark, data)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(data)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[20] == "Mail é[EMAIL], card [CARD] at [IP] or [PHONE]." and texts[1] is None and texts[2] == ""
    assert pii.find(documents(spark, [])).collect() == []


def test_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "+" + "1((" * 300_000, "1.1." * 300_000, "AB12 " * 200_000):
        began = time.time()
        pii.spans_of(text)
        assert time.time() - began < 20


def test_text_after_the_number_hides_no_account():
    def found(text):
        return [text[s.start:s.end] for s in pii.spans_of(text)[1] if s.kind >= 4]

    for number in ("GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00",
                   "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606"):
        bare = number.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        for after in ("", " Please confirm", " A note", " BIC COBADEFFXXX", " 12 MAY", ". Thanks", ", 5 EUR", " 7 AB12 CD"):
            assert found(f"Pay {number}{after}") == [number], after
        assert found(f"Pay {number}x") == [] and found(f"{number} {number}") == [number] * 2
    assert found("AB12 GB82WEST12345698765432 OK") == ["GB82WEST12345698765432"]
    assert found("account 12345678.") == ["12345678"] and found("account 12345678- closed") == ["12345678"]
    assert found("account 12345678.5") == [] and found("account 12345678-9") == []
    assert pii.redacted("To GB82WEST12345698765432 Please") == "To [IBAN] Please"


def test_context_moves_the_scores_of_base_spans():
    def score(text):
        return pii.spans_of(text)[0][0].score

    for kind, plain_text, telling in (("email", "x a@b.com y", "mail a@b.com"), ("ip", "x 10.0.0.1 y", "server 10.0.0.1"),
                                      ("card", "x 4111111111111111 y", "credit card 4111111111111111"),
                                      ("phone", "x +1 785 555 4434", "call +1 785 555 4434")):
        assert pii.ACCEPT <= score(plain_text) < score(telling) <= 1, kind


def test_accounts_of_unknown_countries_need_context():
    def sound(head, body):
        digits = "".join(str(int(c, 36)) for c in body + head + "00")
        return head + f"{98 - int(digits) % 97:02d}" + body

    def kinds(text):
        return [(pii.BASE + pii.ADDED)[s.kind] for s in pii.spans_of(text)[1]]

    unknown, short = sound("QX", "ABCD1234EFGH5678"), sound("DE", "ABCD1234EFGH5678")
    assert kinds(f"code {unknown} here") == kinds(f"code {short} here") == []
    assert kinds(f"iban {unknown} here") == kinds(f"bank {short} here") == ["iban"]
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    codes = ["QZ" + "".join(rnd.choice("0123456789") for _ in range(2)) + "".join(rnd.choice(letters) for _ in range(20))
             for _ in range(3000)]
    assert sum("iban" in kinds(f"part {c} end") for c in codes) == 0


def test_very_many_spans_take_linear_time():
    text = " ".join(f"account {10_000_000 + k}" for k in range(600_000))
    began = time.time()
    spans = pii.spans_of(text)[1]
    assert len(spans) == 600_000 and len(text) > 10_000_000 and time.time() - began < 20
