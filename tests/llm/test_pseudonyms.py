import hashlib
import re

from tillwatch.llm import pseudonyms


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def run(spark, texts, key="k"):
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, __matches int")
    return {r.doc_id: (r.text, r.pii_found) for r in pseudonyms.pseudonymise(table, key).collect()}


def test_formats_are_kept_and_equal_values_stay_linked(spark):
    values = {"card": ["4111111111111111", "5500 0055 5555 5559", "3782-8224-6310-005"], "email": ["jo.Doe-9@mail.example.com", "a@b.org"],
              "ipv4": ["10.0.0.255", "255.255.255.255"], "date": ["1999-02-28", "29.02.2000", "12/31/2099", "1900-01-01"],
              "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"], "phone": ["+1 (319) 555-5132", "+49 30 1234567", "(212) 555-0187"]}
    cases = [(k, v) for k, vs in values.items() for v in vs if k != "card" or luhn(re.sub(r"\D", "", v))]
    got = run(spark, [f"Über {v}, and again {v}!" for _, v in cases] + [f"{v}" for _, v in cases])
    for i, (kind, v) in enumerate(cases):
        text, found = got[i]
        name = text[5:text.index(", and again")]
        assert found == [kind, kind] and text == f"Über {name}, and again {name}!" and name != v, (kind, v, text)
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", name))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v))) \
            or kind == "ipv4"
        assert got[len(cases) + i][0] == name
        if kind == "card":
            assert luhn(re.sub(r"\D", "", name)) and name[0] == v[0]
        if kind == "ipv4":
            assert all(0 <= int(x) < 256 for x in name.split(".")) and len(name.split(".")) == 4
    again = run(spark, [got[i][0] for i in range(len(cases))])
    assert all(again[i][1] == got[i][1] for i in range(len(cases))), "a pseudonym is valid again"


def test_one_to_one(spark):
    ips = [f"10.{i // 64}.7.{i % 64}" for i in range(400)]
    dates = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000, 2024) for m in range(1, 13) for d in (1, 15, 28)]
    ssn = [f"{a:03d}-10-{s:04d}" for a in (1, 2, 665, 667, 899) for s in range(1, 30)]
    for values in (ips, dates, ssn):
        names = [t for t, _ in run(spark, values).values()]
        assert len(set(names)) == len(values) and set(names) != set(values)
    assert run(spark, ips[:3], "one") != run(spark, ips[:3], "two")


def test_invalid_values_and_clean_texts_stay(spark):
    texts = ["4111111111111112", "256.1.1.1", "1.2.3.4.5", "2001-02-29", "31.04.2000", "000-12-3456", "version 3.0.1 of 2.0", "plain é text", "", None,
             "x" * 50_000, "a@b", "1234567890123456789012", "Apache License, Version 2.0."]
    got = run(spark, texts)
    assert all(got[i] == (t, []) for i, t in enumerate(texts))
    assert run(spark, []) == {}


def test_long_text_and_many_values(spark):
    text = " ".join(f"w{i} 10.1.{i % 250}.9" for i in range(2000))
    name, found = run(spark, [text])[0]
    assert len(found) == 2000 and len(set(name.split()[1::2])) == 250 and name.split()[::2] == text.split()[::2]


def feistel(digits, kind, key, rounds=10):
    """The permutation of a string of digits, by plain Python."""
    cut = len(digits) // 2
    halves = [digits[:cut], digits[cut:]]
    for i in range(rounds):
        own, other = halves[i % 2], halves[1 - i % 2]
        out = ""
        for j, c in enumerate(own, 1):
            stream = hashlib.sha256(f"{key}|{kind}|{i}|{other}|{j // 15}".encode()).hexdigest()
            at = 4 * (j % 15)
            out += str((int(c) + int(stream[at:at + 4], 16)) % 10)
        halves[i % 2] = out
    return "".join(halves)


def card_of(digits, key):
    body = digits[0] + feistel(digits[1:-1], "card", key)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def test_numbers_are_linked_however_they_are_written(spark):
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005", "378282246310005"]
    phones = ["+1 319 555 0132", "+1 (319) 555-0132", "+1-319-555-0132", "319-555-0132", "(319) 555-0132"]
    got = run(spark, cards + phones)
    bare = [re.sub(r"\D", "", got[i][0]) for i in range(10)]
    assert bare[:5] == [card_of(re.sub(r"\D", "", c), "k") for c in cards] and len(set(bare[:3])) == 1 and bare[3] == bare[4]
    assert {b[-10:] for b in bare[5:]} == {feistel("3195550132", "phone", "k")}
    shape = lambda v: re.sub(r"\d", "9", v)
    assert all(shape(got[i][0]) == shape(v) for i, v in enumerate(cards + phones))


def test_any_column_name_comes_back(spark):
    table = spark.createDataFrame([(1, "10.0.0.1", 2, 3, 4, 5)], "doc_id long, text string, _found int, _typed int, __typed int, pii_found int")
    out = pseudonyms.pseudonymise(table, "k")
    row = out.first()
    assert out.columns == ["doc_id", "text", "_found", "_typed", "__typed", "pii_found"]
    assert (row["_found"], row["_typed"], row["__typed"], row["pii_found"]) == (2, 3, 4, ["ipv4"])
