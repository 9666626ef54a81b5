import hashlib
import random
import re

from llm.helpers import awkward, documents, sentence
from storepulse.llm.pii import KINDS, base_spans, detect, fit, luhn, redact, spans_of

CARD = "4111 1111 1111 1111"


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for pattern, kind, low, high in ((r"[0-9]([\x20-]?[0-9])+", 2, 12, 19), (r"\+[0-9][\x20().0-9-]+[0-9]", 3, 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@d-e.f.g", "@", "a@", "@b.c", "@@", ".", "..", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8", CARD,
             "4111-1111-1111-1111", "4111111111111112", "+1 (578) 555-6437", "+1", "+", "++4912345678", "-", " ", "  ", "é", "日", "\n",
             "7", "12", "345678901234567890123456789", "a.b", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [tuple(s) for s in base_spans(text)] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 150_000):
        base_spans(text)


def rows_with_data(n=60):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = sentence(rng, 40).split()
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        words.insert(5, rng.choice([f"+1 {phone}", f"kfs.{i}@mail.example.com", f"10.{i}.3.4", CARD]))
        words.insert(20, f"{rng.randint(1000, 9999)}" if i % 3 else f"{rng.randint(10**11, 10**12)}")
        rows.append((i, " ".join(words)))
    return rows


def test_result(spark):
    rows = awkward() + rows_with_data()
    found = sorted(detect(documents(spark, rows)).collect(), key=lambda r: (str(r["doc_id"]), r["base_sha256"]))
    expect = sorted(((i, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(t or ""))) for i, t in rows),
                    key=lambda r: (str(r[0]), hashlib.sha256(r[1].encode()).hexdigest()))
    for r, (i, base) in zip(found, expect, strict=True):
        assert (r["doc_id"], r["base_sha256"]) == (i, hashlib.sha256(base.encode()).hexdigest())
        spans = [s for s in r["spans"].split(",") if s]
        assert {s for s in base.split(",") if s} <= set(spans)
        assert [sum(s.startswith(k + ":") for s in spans) for k in KINDS] == [r[f"n_{k}"] for k in KINDS]


def test_repeated_number_gets_the_same_label(spark):
    weights = fit(documents(spark, rows_with_data()))
    assert weights.skip > 0
    text = "call +1 (578) 555-6437 now, or later dial (578) 555-6437 again; not 1234 or 987654321099"
    base, more = spans_of([text, "only (578) 555-6437 here", ""], weights)
    at = text.rindex("(578)")
    assert [text[s.start:s.end] for s in base[0]] == ["+1 (578) 555-6437"]
    assert [(s.start, KINDS[s.kind], s.end) for s in more[0]] == [(at, "phone", at + len("(578) 555-6437"))]
    assert more[1:] == [[], []]


def test_redaction_leaves_clean_rows_alone(spark):
    rows = awkward() + [(700, f"mail a.b@c.de or {CARD}, 1.2.3.4")]
    df = documents(spark, rows)
    out = redact(df, fit(df))
    assert out.columns == df.columns
    texts = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    expect = [(i, t) for i, t in rows if i != 700] + [(700, "mail <EMAIL> or <CARD>, <IP>")]
    assert texts == sorted(expect, key=str)


def test_empty_table(spark):
    assert detect(documents(spark, [])).count() == 0
