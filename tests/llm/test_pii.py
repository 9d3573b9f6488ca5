"""Pseudonyms against a plain Python version, on the given documents and on made-up values."""

import random
import re

import regex
from pyspark.sql import functions as F

from tracelake.llm import pii

from . import plain


def swapped(text):
    """The text with pseudonyms, and how many matches changed; the pattern is the operator's."""
    if text is None:
        return None, 0
    n = 0

    def one(m):
        nonlocal n
        new = plain.pseudonym(m.group(), pii.KEY, pii.FORMS)
        n += new != m.group()
        return new

    return regex.sub(pii.ANY, one, text), n


def made_up():
    rnd = random.Random(41)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(60):
        card = d(rnd.randint(12, 18))
        card += str(-plain.luhn(card + "0") % 10)
        bban = d(rnd.randint(12, 26))
        iban = "DE" + str(98 - plain.mod97("DE00" + bban)).zfill(2) + bban
        out += [
            f"card {card}, spaced {' '.join(card[i : i + 4] for i in range(0, len(card), 4))}, wrong {card[:-1]}{(int(card[-1]) + 1) % 10}",
            f"iban {iban}; {' '.join(iban[i : i + 4] for i in range(0, len(iban), 4))}", f"ssn {d(3)}-{d(2)}-{d(4)}", f"tel +{d(2)} ({d(3)}) {d(3)}-{d(4)} or +1.{d(3)}.{d(3)}.{d(4)}",
            f"ip {rnd.randrange(300)}.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}", f"on {rnd.randint(1850, 2150)}-{d(2)}-{d(2)}, {d(2)}/{d(2)}/{rnd.randint(1850, 2150)}",
            f"mail {rnd.choice(['a', 'Joe.9', 'x_y+z', 'q'])}@{rnd.choice(['x.org', 'mail.example.com'])}", f'token = "{d(6)}ABcdef{d(6)}"', f"secret:{d(13)}",
        ]
    return out


def test_against_plain_python(spark):
    texts = [None, "", "no digits", *made_up()]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r["text"], r["_pii_found"]) == swapped(t), t


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = 0
    for r in pii.pseudonymise(docs).collect():
        assert (r["text"], r["_pii_found"]) == swapped(before[r["doc_id"]])
        changed += r["_pii_found"] > 0
    assert changed > 20


def test_valid_and_apart(spark):
    """Valid numbers stay valid, and different values of one form get different pseudonyms."""
    df = spark.range(4000).select(F.concat(F.lpad((F.col("id") % 899 + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("id") % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("text")).where("text NOT LIKE '666%'")
    out = [r["text"] for r in pii.pseudonymise(df).collect()]
    assert len(set(out)) == len(out) and not any(re.match("000|666|9|...-00|.*0000$", x) for x in out)
    short = spark.createDataFrame([(f"{a}{b}@x.org",) for a in "abcdefghij" for b in "0123456789"] + [(f"{a}@x.org",) for a in "abcdefghijklmnopqrstuvwxyz"], "text string")
    assert pii.pseudonymise(short).select("text").distinct().count() == 126
