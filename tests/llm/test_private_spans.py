import hashlib
import random
import re

from pyspark.sql import functions as F

from folioframe.llm import private_spans as P
from tests.conftest import ROOT

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text = text or ""
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        number = re.sub("[^0-9]", "", m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            found.append(("card", m))
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


def check(rows, texts):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        want, row = base(text), got[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, row)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(w.startswith(k + ":") for w in want) for k in P.KINDS]
        spans = [s for s in row.spans.split(",") if s]
        assert set(want) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_tables_agree_with_the_base_rules(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    check(P.find(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_random_texts_agree_with_the_base_rules(spark):
    rng = random.Random(5)
    parts = ["a", "b9", "@", ".", "+", "1", "4111 1111 1111 1111", "255", "0256", "-", " ", "_", "(", ")", "é", "😀", "x.y", "\n", "%", "12",
             "a@b.c", "+1 (375) 555-4393", "1.2.3.4"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(40))) for i in range(1500)}
    texts |= {2000: None, 2001: "", 2002: "1" * 30_000, 2003: "a" * 50_000 + "@", 2004: "1 " * 20_000, 2005: "a.b@c.d " * 1500,
              2006: "+1" + " " * 20_000, 2007: "a@" + "b." * 20_000, 2008: "1." * 20_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(P.find(docs.withColumn("cands", F.lit(1))).collect(), texts)


def test_empty_table(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_strong_loose_spans_are_added_and_plain_numbers_are_not(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        n = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"please call +1 {n.replace('-', ' ')} or phone {n} today"))
        rows.append((1000 + i, f"order {rng.randrange(10**15, 10**16)}x and isbn {rng.randrange(10**12, 10**13)} token"))
        rows.append((2000 + i, f"write to user{i}@mail.example.com or user{i} [at] mail [dot] com now"))
    got = {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(s.count("phone:") == 2 for i, s in got.items() if i < 1000) > 270
    assert sum(s.count("email:") == 2 for i, s in got.items() if i >= 2000) > 270
    assert not any("card" in s and not base(dict(rows)[i]) for i, s in got.items() if 1000 <= i < 2000)


def test_em_finds_the_labeler_that_guesses():
    rows = [(0, "yyyy--", True, 90), (0, "yy-n--", False, 80), (0, "nn-n--", False, 200), (0, "nn-y--", False, 10)]
    posterior = P.reliabilities(rows)
    assert posterior[0, "yy-n--"] > 0.5 > posterior[0, "nn-y--"]
