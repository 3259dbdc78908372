import hashlib
import random
from collections import Counter

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import brute
import pytest
from ludex.llm import pii
from pyspark.sql import functions as F

TEXTS = ["mail a.b+c@x-y.example.com, a@b, @c.d e@f..g h@i.j.k@l.m .@n.o ä@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 999.999.999.999 1.2.3.4",
         "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41 4111111111111111111 0000000000000 12 34", "+1 (017) 555-7713 +12 +1234567890123456 +1--2345678- +49 30 12345678",
         "x" * 20_000 + "@" + "y" * 20_000, "1 " * 30_000, "9" * 50_000, "+" * 5000 + "1" * 30, "1.1.1.1" * 500, "ü🎉 a@b.cc ü🎉 10.0.0.1", "", None, "4111111111111111@host.example.com +4111111111111111"]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("0123456789.@+- ()aB%_ä,") for _ in range(rng.randrange(200))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, base_ string").repartition(4)
    got = rows_of(pii.detect(df).select("doc_id", pii.listed(F.col("base")).alias("s")))
    for k, t in enumerate(texts):
        assert got[k].s == ",".join(f"{a}:{b}:{c}" for a, b, c in brute.pii(t)), (k, t and t[:80])


def test_no_python_in_the_plan(docs):
    plan = pii.detect(docs)._jdf.queryExecution().executedPlan().toString() + pii.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def corpus(spark):
    """Cards that pass the check digit in most places, and some with a wrong digit in the same format."""
    rng, rows = random.Random(3), []
    for k in range(300):
        d = [rng.randrange(10) for _ in range(15)]
        c = next(x for x in range(10) if brute.luhn("".join(map(str, d)) + str(x)))
        wrong = k % 60 == 0
        card = "".join(map(str, d)) + str((c + 1) % 10 if wrong else c)
        rows.append((k, f"word {card} word number {rng.randrange(100)} token=\"{rng.getrandbits(160):040x}\" version {k}.{k}"))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_boosted_candidates_are_added(spark):
    df, rows = corpus(spark)
    got = rows_of(pii.detect(df))
    for k, t in rows:
        base, added = got[k].base, got[k].added
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in base] == brute.pii(t)
        if k % 60 == 0:                                     # same format and context as valid cards
            assert [(s.kind, s.start, s.end) for s in added] == [(2, 5, 21)]
        else:
            assert not [s for s in added if s.kind == 2]


def test_variants_are_found_and_redacted(spark):
    """Well-formed data and look-alikes all over; a few phones without "+" and emails spelled out among them."""
    rng, rows = random.Random(5), []
    for k in range(300):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10_000):04}"
        rows.append((k, f"word {phone} word ab.{k}@mail{k % 9}.example.com then 2023-01-{k % 28 + 1:02} 10:30, order {rng.randrange(10**9, 10**10)} "
                        f"version {k}.4 at 3 @ 1.{k:03} each, rows {rng.randrange(10**7)} 12 {rng.randrange(100)}. me @ noon. Then"))
    planted = {300: ("phone", "(555) 123-4567"), 301: ("phone", "555-123-4567"), 302: ("phone", "1 (017) 555-7713"),
               303: ("email", "jane.doe (at) example (dot) com"), 304: ("email", "jane.doe[at]example.com"), 305: ("email", "jane @ example.com"),
               306: ("phone", "(555) 123-4567"), 307: ("email", "jane.doe(AT)mail.example.org")}
    texts = {k: f"some words {v} 12 more words" if k == 306 else f"some words {v}. More words" for k, (_, v) in planted.items()}
    df = spark.createDataFrame(rows + list(texts.items()), "doc_id long, text string")
    got = rows_of(pii.detect(df).select("doc_id", pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").alias("n_added")))
    clean = rows_of(pii.redact(df))
    for k, (kind, v) in planted.items():
        assert got[k].spans == f"{kind}:11:{11 + len(v)}", (v, got[k].spans)
        assert clean[k].text == texts[k].replace(v, f"[{kind.upper()}]")
    assert sum(got[k].n_added for k, _ in rows) == 0                 # no date, order number, price or "@ noon"


def test_boosting_calibrates():
    assert pii.boost([]).threshold == {}
    assert pii.boost([(0, 0, 10.0, 0.0)]).threshold == {}
    m = pii.boost([(0, 1, 100.0, 99.0), (0, 2, 100.0, 5.0), (0, 3, 50.0, 49.0)])
    keep = [b for b in (1, 2, 3) if m.score(0, b) >= m.threshold[0] - 1e-9]
    assert keep == [1, 3]


def test_redact(spark):
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)] + [(99, "call +1 (017) 555-7713 or a@b.cc!", 1)], "doc_id long, text string, base int")
    got = rows_of(pii.redact(df, model=pii.Boosted()))
    assert got[99].text == "call [PHONE] or [EMAIL]!" and got[99].base == 1
    assert got[11].text is None and got[10].text == ""
    assert got[9].text == "ü🎉 [EMAIL] ü🎉 [IP]"
    assert got[12].text == "[EMAIL] [PHONE]" or "@" not in got[12].text


def test_nasty_and_empty(odd_docs, nasty, empty_docs):
    out = pii.detect(odd_docs.drop("base"))
    assert out.count() == len(nasty)
    got = Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest(), len(r.base)) for r in out.collect())
    assert got == Counter((r[0], hashlib.md5((r[1] or "").encode()).hexdigest(), len(brute.pii(r[1]))) for r in nasty)
    assert pii.detect(empty_docs).count() == 0 and pii.redact(empty_docs).count() == 0


@pytest.mark.parametrize("kind", range(4))
def test_loose_patterns_run_on_long_texts(spark, kind):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    assert df.select(F.size(pii._spans(F.coalesce("text", F.lit("")), pii._LOOSE[pii.KINDS[kind]]))).count() == len(TEXTS)
