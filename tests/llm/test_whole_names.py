"""Mentions of persons and phones beyond the plainest form."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii


def test_all_mentions_of_a_person_are_replaced(spark, monkeypatch):
    rows = [
        (1, "Mr John Smith came. Later Smith said that John was late, and SMITH's dog ran. Goldsmith stayed."),
        (2, "Mr McDonald met Dr. Jean-Luc Picard, Mr John Paul Jones and Herr Prof. von Neumann; Luc and Neumann left."),
        (3, "Call +44 20 7946 0958 or +49 30 123456-78 or (415) 555-2485 now."),
        (4, "Mr Smith wrote."),
        (5, "John Smith has no title here."),
        (6, "Dr. Maria Keller and Keller's aide wrote to Ken Ashford."),
        (7, "Joe.Doe+x1@Mail.Acme.org, joe.doe+x1@mail.acme.org and ab@acme.org"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert not re.search(r"\b(John|Smith|SMITH)\b", by[1].text) and "Goldsmith stayed" in by[1].text
    john, smith = re.match(r"Mr (\w+) (\w+) came", by[1].text).groups()
    assert f"Later {smith} said that {john} was" in by[1].text and by[4].text == f"Mr {smith} wrote."
    assert not re.search("Donald|Jean|Luc|Picard|John|Paul|Jones|Neumann", by[2].text) and "Herr Prof. von " in by[2].text
    assert "7946" not in by[3].text and "123456" not in by[3].text and "555-2485" not in by[3].text and by[3].n_entities == 3
    assert re.fullmatch(r"\w+on \w+on has no title here\.", by[5].text) and by[5].text.startswith(f"{john} {smith} ")
    assert re.fullmatch(r"Dr\. \w+ina (\w+ina) and \1's aide wrote to Ken Ashford\.", by[6].text)
    first, second, third = re.split(r", | and ", by[7].text)
    assert first.lower() == second and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\+[a-z][0-9]@[a-z]{10}\.example\.org", first) and len(third.split("@")[0]) == 8


def test_surrogates_avoid_originals(spark):
    """A number whose permuted form is somebody's real one gets another surrogate; two writings of it stay one."""
    one = "988-555-2485"
    taken = spark.range(1).select(pii.surrogate(F.lit(one), "k").alias("s")).first().s
    df = spark.createDataFrame([(1, f"call {one} or (988) 555-2485"), (2, f"call {taken}")], "doc_id long, text string")
    by = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    a, b = re.match(r"call (\S+) or \((\d{3})\) ", by[1])[1], re.sub(r"\D", "", by[1].split(" or ")[1])
    assert a not in (one, taken) and re.sub(r"\D", "", a) == b and by[2] != f"call {a}"


def test_mentions_of_one_word_stay_one(spark):
    rows = [(1, "Mr John Smith came."), (4, "Mr Smith wrote.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    assert by[1].split()[2] == by[4].split()[1]


def test_a_second_surrogate_is_used_everywhere(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Mr John Smith came. Later Smith said that John was late."), (4, "Mr Smith wrote.")], "doc_id long, text string")
    john = pii.pseudonymise(df, "k").where("doc_id = 1").first().text.split()[1]
    made = pii.surrogates

    def patched(found, key):
        """As after a collision: another stem for one word."""
        return made(found, key).withColumn("surrogate", F.when(F.col("original") == "Dr Smith", "Dr Oth").otherwise(F.col("surrogate")))

    monkeypatch.setattr(pii, "surrogates", patched)
    by = {r.doc_id: r.text for r in pii.pseudonymise(df.where(F.col("doc_id").isin(1, 4)), "k").collect()}
    assert by[4] == "Mr Othon wrote." and by[1].startswith(f"Mr {john} Othon came. Later Othon said that {john}")


def test_one_stem_in_all_documents_and_endings_by_gender(spark):
    rows = [
        (1, "Mr John Smith came."), (2, "Dr. Smith wrote. Mrs Smith left."), (3, "MR JOHN SMITH AND MRS. JANE DOE met."),
        (4, "Smith, John: late"), (5, "Paid with 3782 822463 10005 or 371449635398431."), (6, "Dr. Smith alone"), (7, "THE END AND MORE"),
    ]
    by = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    john, smith = re.fullmatch(r"Mr (\w+)on (\w+)on came\.", by[1].text).groups()
    assert by[2].text == f"Dr. {smith}ina wrote. Mrs {smith}ina left." and by[6].text == f"Dr. {smith}er alone"
    assert re.fullmatch(rf"MR {john}on {smith}on AND MRS\. \w+INA \w+INA met\.".replace(f"{john}on {smith}on", f"{john}on {smith}on".upper()), by[3].text)
    assert by[4].text == f"{smith}on, {john}on: late" and by[7].text == rows[6][1]
    cards = re.fullmatch(r"Paid with (37\d\d \d{6} \d{5}) or (37\d{13})\.", by[5].text).groups()
    for c in cards:
        d = [int(x) for x in re.sub(r"\D", "", c)]
        assert sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    assert re.sub(r"\D", "", cards[0]) not in rows[4][1].replace(" ", "") and by[5].n_entities == 2


def test_surrogates_are_one_to_one_over_all_documents(spark):
    """Every entity of shuffled documents gets one surrogate of its kind, distinct entities distinct ones, other text stays."""
    rng = random.Random(5)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    kinds = {
        r"\+1 \(\d{3}\) \d{3}-\d{4}": lambda: f"+1 ({rng.randrange(200, 999)}) {digits(3)}-{digits(4)}",
        r"\d{1,3}(\.\d{1,3}){3}": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        r"[a-z]{3}\.[a-z]{4}@[a-z]{10}\.example\.(com|org|net)": lambda: "".join(rng.choices("abcdefgh", k=3)) + "." + "".join(rng.choices("abcdefgh", k=4)) + "@" + rng.choice(["x.org", "yy.com", "z.net", "w.de"]),
        r"\d{3}-\d{2}-\d{4}": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        r"4\d{3} \d{4} \d{4} \d{4}": lambda: f"4{digits(3)} {digits(4)} {digits(4)} {digits(4)}",
        r"Mrs [A-Z][a-z]+ina": lambda: "Mrs " + rng.choice("BCDFG") + "".join(rng.choices("aeiorstl", k=6)),
    }
    pool = [(k, make()) for k, make in kinds.items() for _ in range(12)]
    docs = []
    for i in range(80):
        docs.append((i, rng.sample(pool, 4)))
    rows = [(i, " # ".join(e for _, e in picked) + " # end") for i, picked in docs]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "k").collect()}
    found = {}
    for i, picked in docs:
        *new, end = got[i].text.split(" # ")
        assert end == "end" and got[i].n_entities == len(picked) == len(new)
        for (kind, old), surrogate in zip(picked, new, strict=True):
            assert re.fullmatch(kind, surrogate) and surrogate != old
            assert found.setdefault((kind, old), surrogate) == surrogate
    assert len(set(found.values())) == len(found) and not set(found.values()) & {e for _, e in pool}
