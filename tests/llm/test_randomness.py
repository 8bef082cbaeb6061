"""The battery of randomness tests: its size on random keys, keys and words by encoding and length, and personal data in lists."""

import random

import pytest

from plumbline.llm import pii, secrets

LENGTHS = (24, 32, 64)
WORDS = "get set user account number value total session index report customer service provider handler factory manager default config request response".split()


def key(rng, letters, n):
    """A random key that a candidate can be: digits and letters, or two cases within."""
    while True:
        token = "".join(rng.choice(letters) for _ in range(n))
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and token[0] not in "+/-_=" and token[-1] not in "+/-_=":
            return token


def identifier(rng, n):
    """A name of at least n characters as programs have them."""
    style = rng.randrange(3)
    words = []
    while sum(map(len, words)) < n:
        words.append(rng.choice(WORDS))
    if style == 0:
        return words[0] + "".join(w.capitalize() for w in words[1:])
    return ("_" if style == 1 else "-").join(words) + f"_{rng.randint(1, 9)}"


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    rows = []
    for name, _, letters in secrets.ENCODINGS[1:]:  # long runs of hexadecimal letters are spans of the fixed patterns
        for n in LENGTHS:
            rows += [("key", name, n, key(rng, letters, n)) for _ in range(100)]
    for n in LENGTHS:
        rows += [("word", "", n, identifier(rng, n)) for _ in range(1500)]
    docs = spark.createDataFrame([(i, f"see {r[3]} there") for i, r in enumerate(rows)], "doc_id long, text string")
    hit = {r.doc_id: [s.text for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    return [(*r, hit[i] == [r[3]]) for i, r in enumerate(rows)]


def test_random_keys_are_reported_whatever_encoding_and_length(found):
    """The rule loses about the rate 0.05 of the keys; the bound leaves three standard deviations of 100 keys below."""
    least = 0.95 - 3 * (0.05 * 0.95 / 100) ** 0.5
    for name, _, _ in secrets.ENCODINGS[1:]:
        for n in LENGTHS:
            hits = [f[4] for f in found if f[:3] == ("key", name, n)]
            assert sum(hits) >= least * len(hits), (name, n, sum(hits))


def test_false_alarms_among_identifiers_are_counted(found):
    shares = {n: sum(f[4] for f in found if f[0] == "word" and f[2] == n) / 1500 for n in LENGTHS}
    assert shares[24] <= 0.25 and shares[32] <= 0.1 and shares[64] <= 0.02, shares


def test_the_size_of_the_battery(spark):
    """Of uniform tokens few more than the level have a p-value up to it: what is lost to an error of the approximations."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    tokens = [("".join(rng.choice(letters) for _ in range(n)),) for name, _, letters in secrets.ENCODINGS[:5] for n in (20, 40) for _ in range(600)]
    df = spark.createDataFrame(tokens, "token string").select(secrets.p_value(F.col("token")).alias("p"))
    r = df.agg(F.avg((F.col("p") <= 0.05).cast("int")).alias("a"), F.avg((F.col("p") <= 0.01).cast("int")).alias("b")).first()
    assert r.a <= 0.07 and r.b <= 0.02


KINDS = {
    "phone_local": (["(415) 555-2671", "212-555-0147", "646 555 0199", "303.555.0123"], "Office tel. {}", "Order no. {} shipped"),
    "ssn": (["219-09-9999", "457-55-5462", "078-05-1120"], "SSN {}", "Version {} of the part list"),
    "iban": (["DE89370400440532013000", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"], "pay to {}", None),
    "email_masked": (["jane(at)mail(dot)org", "j.doe [at] example [dot] com", "info(at)firm.net"], "contact {}", None),
    "birth": (["1984-05-12", "2001-01-02", "1957-11-30"], "born {}", "released {}"),
}


def test_personal_data_in_lists_records_and_alone(spark):
    cases = []
    for kind, (values, phrase, negative) in KINDS.items():
        for v in values:
            cases.append((phrase.format(v), {kind: [v]}))
            cases.append((f"{phrase.format(v)}, {values[0]} and {values[-1]}", {kind: [v, values[0], values[-1]]}))
            cases.append((f"Name: X Y; dob: 1990-03-04; {phrase.format(v)}; phone: 415-555-0101", {kind: [v]}))
            if negative:
                cases.append((negative.format(v), {}))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    sought, hit, false = {}, {}, []
    for i, (text, want) in enumerate(cases):
        for kind, values in want.items():
            own = [s.text for s in rows[i] if s.kind == kind]
            sought[kind] = sought.get(kind, 0) + len(values)
            hit[kind] = hit.get(kind, 0) + sum(v in own for v in values)
        if not want and rows[i]:
            false.append(text)
    assert all(hit[k] >= 0.9 * sought[k] for k in KINDS), (hit, sought)
    assert not false


def test_long_lists_are_found_whole(spark):
    texts = {1: "born 2001-01-02 . " * 2000, 2: "call (212) 555-0147, " * 200, 3: "tel 212-555-0147 / mail x(at)y.org / " * 500, 4: "a@b.de 212-555-0147 " * 500}
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [len(rows[i]) for i in texts] == [2000, 200, 1000, 1000]
    assert all([s.start for s in r] == sorted(s.start for s in r) for i, r in rows.items() if i != 4)
