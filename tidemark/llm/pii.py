"""PII surrogates: keyed, type-consistent replacements.

Everything is DataFrame functions.  One pattern finds entities; the text between them is kept by
``split`` with the same pattern, and both are zipped again, so replacements can't hit other text.

* Digits (phones, cards, social security numbers) and IPv4 addresses go through a keyed
  Feistel permutation of the same format: distinct stays distinct, equal stays equal, in all documents.  Cards
  keep their issuer digit and the distance of the last digit to a valid check digit.
* E-mail addresses keep dots, plus parts, digits' places and case; letters and digits are keyed ones, local parts
  of fewer than 8 characters grow to that length.  A domain keeps one surrogate in all addresses, below ``example.*``.
* Names after titles, with a common given name, or written "Surname, Given", keep titles, script (Latin or Cyrillic), particles, capitals
  and number of words.  A word has one stem in all documents; its ending follows the gender that the mention tells, else the
  one that its text tells.  All other mentions of a found name's words (two letters or more) in its text are replaced with them.

Surrogates are made once, for the distinct entities of all documents, and brought back to the texts that hold them.  An original whose
surrogate (with any ending) another original has too, or whose surrogate is itself an original somewhere, is given further keyed
surrogates until a free one is found; number spaces so dense that ``MAX_ATTEMPTS`` of them are taken are an error.

Defined cases: null texts stay null with no entity; null ids and repeated rows keep their rows; texts
without entities are returned unchanged; very long texts are handled whole; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = (
    r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+(])\+[1-9](?:[ .-]?(?:\([0-9]{1,4}\) ?)?[0-9]){8,14}(?![0-9])"
)
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z-])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Titles that tell a gender, titles that don't, and particles within names.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Sir", "Lord"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Lady"]
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Doctora", "Profesor", "Profesora", "доктор", "профессор"]
# Common given names by gender, which make a name of the capitalised words after them.
GIVEN_MALE = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Steven Andrew Kenneth George Kevin Brian Edward Peter "
    "Hans Klaus Jürgen Pierre Jean Michel François José Juan Carlos Miguel Luis Antonio Giovanni Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир"
).split()
GIVEN_FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Maria Laura Julia Sophie Marie "
    "Claire Isabelle Ursula Ingrid Carmen Lucía Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана"
).split()
# Words in capitals that end a name.
STOPS = "AND OR THE OF IN ON AT TO FOR WITH BY UND ODER VON ET OU DE Y О И".split()


def _alternatives(words: list[str]) -> str:
    """The words as they are and in capitals, longest first."""
    return "|".join(sorted({*words, *map(str.upper, words)}, key=lambda t: (-len(t), t)))


GIVEN = _alternatives(GIVEN_MALE + GIVEN_FEMALE)
TITLE = _alternatives(MALE + FEMALE + NEUTRAL)
TITLES = rf"(?:{TITLE})\.?(?: (?:{TITLE})\.?(?= ))*"
RUN = r"[\p{L}\p{M}]+"
_WORD = rf"(?!(?:{'|'.join(STOPS)}|{'|'.join(t.upper() for t in MALE + FEMALE + NEUTRAL)})(?!\p{{L}}))\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’-][\p{{L}}\p{{M}}]++)*+"
_LINK = r"(?:(?:von|van|vom|zu|de|der|den|del|della|da|di|du|dos|la|le|bin|ibn|al|el|\p{Lu}\.) )*+"
#: What titles and given names begin with: most places of a text are left after one look.
_HEAD = r"(?<!\p{L})(?=[\p{Lu}гдп])"
NAME = rf"{_HEAD}(?:{TITLES} {_LINK}{_WORD}(?: {_LINK}{_WORD})*+|(?:{GIVEN})(?: {_LINK}{_WORD})++|{_WORD}, (?:{GIVEN})(?!\p{{L}}))"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, CARD, PHONE, IPV4, SSN, NAME))
# Letters of the syllables of surrogate names.
CONSONANTS = {"latin": "bdfghklmnprstvz", "cyrillic": "бвгдзклмнпрстфх"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
ENDINGS = {
    ("latin", "m"): "on", ("latin", "f"): "ina", ("latin", "n"): "er", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова", ("cyrillic", "n"): "ко"
}
# The title that stands before a single word where it is an entity of its own.
ALONE = "Dr "
ROUNDS = 4
MAX_ATTEMPTS = 64


def _hash(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(hex_digits: Column, at: int, width: int = 12) -> Column:
    return F.conv(F.substring(hex_digits, at, width), 16, 10).cast("long")


def _permute(a: Column, b: Column, modulus: int, key: str, kind: str) -> Column:
    """A keyed bijection of pairs of numbers below ``modulus``, as a struct."""

    def step(acc: Column, i: Column) -> Column:
        moved = (acc["a"] + _number(_hash(key, kind, i.cast("string"), acc["b"].cast("string")), 1) % modulus) % modulus
        return F.struct(acc["b"].alias("a"), moved.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _permute_digits(digits: Column, width: int, key: str, kind: str) -> Column:
    half = width // 2
    moved = _permute(F.substring(digits, 1, half), F.substring(digits, half + 1, half), 10**half, key, kind)
    return _let(moved, lambda out: F.concat(F.lpad(out["a"].cast("string"), half, "0"), F.lpad(out["b"].cast("string"), half, "0")))


def _pour(shape: Column, digits: Column) -> Column:
    """The digits in the places of ``shape``'s digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"),
        )

    return F.aggregate(F.split(shape, ""), start, step)["s"]


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _luhn_rest(body: Column, n: int) -> Column:
    """The check digit that the ``n`` leading digits ask for."""
    total = F.lit(0)
    for i in range(1, n + 1):
        d = F.substring(body, i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if (n - i) % 2 == 0 else d)
    return (F.lit(10) - total % 10) % 10


def _kind(name: str, attempt: str) -> str:
    return name if attempt == "0" else f"{name} {attempt}"


def _card(e: Column, key: str, attempt: str) -> Column:
    """Cards of 16 digits keep their first one, those of 15 their first two."""
    def made(d: Column, n: int, keep: int) -> Column:
        def pour(body: Column) -> Column:
            gap = (F.substring(d, n, 1).cast("int") - _luhn_rest(F.substring(d, 1, n - 1), n - 1) + 10) % 10
            return _pour(e, F.concat(body, ((_luhn_rest(body, n - 1) + gap) % 10).cast("string")))

        width = n - 1 - keep
        return _let(F.concat(F.substring(d, 1, keep), _permute_digits(F.substring(d, keep + 1, width), width, key, _kind("card", attempt))), pour)

    return _let(_digits(e), lambda d: F.when(F.length(d) == 16, made(d, 16, 1)).otherwise(made(d, 15, 2)))


def _phone(e: Column, key: str, attempt: str) -> Column:
    """Country code and the first two digits of the number stay."""
    def move(d: Column) -> Column:
        keep = F.length(d) - 8
        return F.concat(F.substr(d, F.lit(1), keep), _permute_digits(F.substr(d, keep + 1, F.lit(8)), 8, key, _kind("phone", attempt)))

    return _let(_let(_digits(e), move), lambda d: _pour(e, d))


def _ssn(e: Column, key: str, attempt: str) -> Column:
    moved = _let(_digits(e), lambda d: F.concat(F.substring(d, 1, 1), _permute_digits(F.substring(d, 2, 8), 8, key, _kind("ssn", attempt))))
    return _let(moved, lambda d: _pour(e, d))


def _ipv4(e: Column, key: str, attempt: str) -> Column:
    moved = _let(F.transform(F.split(e, r"\."), lambda x: x.cast("int")), lambda o: _permute(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, key, _kind("ipv4", attempt)))
    return _let(moved, lambda out: F.concat_ws(".", F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256))


def _letters(h: Column, n: int) -> Column:
    return F.concat(*[F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (_number(h, 1 + 3 * i, 3) % 26 + 1).cast("int"), F.lit(1)) for i in range(n)])


def _email(e: Column, key: str, attempt: str) -> Column:
    low, local = F.lower(e), F.substring_index(e, "@", 1)
    domain = F.substring_index(low, "@", -1)
    tld = F.substring_index(domain, ".", -1)

    def change(h: Column, c: Column, i: Column) -> Column:
        def by(n: Column) -> Column:
            letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
            return F.when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).when(c.rlike("^[0-9]$"), (n % 10).cast("string")).otherwise(c)

        return _let(F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int"), by)

    h = F.concat(_hash(key, "email", low, attempt), _hash(key, "more", low, attempt))
    own = _let(h, lambda x: F.array_join(F.transform(F.split(local, ""), lambda c, i: change(x, c, i)), ""))
    more = F.substr(_let(_hash(key, "tail", low, attempt), lambda x: _letters(x, 8)), F.lit(1), F.greatest(8 - F.length(local), F.lit(0)))
    where = F.concat(_let(_hash(key, "domain", domain), lambda x: _letters(x, 10)), F.lit(".example."), F.when(tld.isin("org", "net"), tld).otherwise("com"))
    return F.concat(own, more, F.lit("@"), where)


def _both(words: list[str]) -> list[str]:
    return [*words, *map(str.upper, words)]


def _as_written(made: Column, e: Column) -> Column:
    """The surrogate of an address with the capitals of the local part ``e`` had."""
    local = F.substring_index(e, "@", 1)
    letters = F.zip_with(F.split(F.substr(made, F.lit(1), F.length(local)), ""), F.split(local, ""), lambda m, c: F.when(c.rlike("^[A-Z]$"), F.upper(m)).otherwise(m))
    return F.when(local == F.lower(local), made).otherwise(F.concat(F.array_join(letters, ""), F.substr(made, F.length(local) + 1)))


def _gender(e: Column) -> Column:
    """Of a name: that of its first title that tells one, else of its given name."""
    titles = F.transform(F.split(F.regexp_extract(e, f"^{TITLES}", 0), " "), lambda t: F.regexp_replace(t, r"\.$", ""))
    told = F.filter(titles, lambda t: t.isin(*_both(MALE + FEMALE)))
    given = F.regexp_extract(e, rf"(?:^|^{TITLES} |, )({GIVEN})(?!\p{{L}})", 1)
    by_name = F.when(given.isin(*_both(GIVEN_MALE)), "m").when(given.isin(*_both(GIVEN_FEMALE)), "f").otherwise("n")
    return F.when(F.size(told) == 0, by_name).when(F.get(told, F.lit(0)).isin(*_both(MALE)), "m").otherwise("f")


def _each_run(text: Column, change) -> Column:
    """The text with every run of letters changed."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), change)
    return F.array_join(F.zip_with(F.split(text, RUN, -1), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _stem(w: Column, key: str, attempt: str) -> Column:
    """The keyed stem of a name's word, the same whatever its capitals."""
    def spell(h: Column, script: str) -> Column:
        syllables = [
            F.concat(
                F.substr(F.lit(CONSONANTS[script]), (_number(h, 1 + 6 * i, 3) % 15 + 1).cast("int"), F.lit(1)),
                F.substr(F.lit(VOWELS[script]), (_number(h, 4 + 6 * i, 3) % 5 + 1).cast("int"), F.lit(1)),
            )
            for i in range(5)
        ]
        return F.initcap(F.concat(*syllables, F.lit(CONSONANTS[script][6])))

    return _let(_hash(key, "name", F.lower(w), attempt), lambda h: F.when(w.rlike(r"\p{IsCyrillic}"), spell(h, "cyrillic")).otherwise(spell(h, "latin")))


def _ended(stem: Column, gender: Column) -> Column:
    def ending(script: str) -> Column:
        return F.when(gender == "m", ENDINGS[script, "m"]).when(gender == "f", ENDINGS[script, "f"]).otherwise(ENDINGS[script, "n"])

    return F.concat(stem, F.when(stem.rlike(r"\p{IsCyrillic}"), ending("cyrillic")).otherwise(ending("latin")))


def _name(e: Column, key: str, attempt: str) -> Column:
    """The stem of a name of one word, after its title."""
    return F.concat(F.lit(ALONE), _stem(F.substring_index(e, " ", -1), key, attempt))


def name_words(typed: Column) -> Column:
    """Words w and genders g of all names among the entities (kind, e), in order, each once."""
    names = F.transform(F.filter(typed, lambda x: x["kind"] == "name"), lambda x: F.struct(x["e"].alias("e"), _gender(x["e"]).alias("g")))

    def split(x: Column) -> Column:
        words = F.regexp_extract_all(F.regexp_replace(x["e"], f"^{TITLES}", ""), F.lit(RUN), F.lit(0))
        return F.transform(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.struct(w.alias("w"), x["g"].alias("g")))

    return F.array_distinct(F.flatten(F.transform(names, split)))


def kind_of(e: Column) -> Column:
    whole = {"email": EMAIL, "card": CARD, "ipv4": IPV4, "ssn": SSN, "phone": PHONE}
    out = F.when(e.contains("@"), "email")
    for kind in ("card", "ipv4", "ssn", "phone"):
        out = out.when(e.rlike(f"^(?:{whole[kind]})$"), kind)
    return out.otherwise("name")


def surrogate(e: Column, key: str, attempt: str = "0", kind: Column | None = None) -> Column:
    """The replacement of one entity (names: the stem of one word after a title); each ``attempt`` gives another one."""
    kind = kind_of(e) if kind is None else kind
    return (
        F.when(kind == "email", _email(e, key, attempt))
        .when(kind == "card", _card(e, key, attempt))
        .when(kind == "ipv4", _ipv4(e, key, attempt))
        .when(kind == "ssn", _ssn(e, key, attempt))
        .when(kind == "phone", _phone(e, key, attempt))
        .otherwise(_name(e, key, attempt))
    )


def _mark(kind: Column, e: Column) -> Column:
    """What makes two writings the same: digits of numbers, lower case of the rest."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "ssn", "phone"), _digits(e)).otherwise(F.lower(e)))


def _may_have(text: Column) -> Column:
    return text.rlike(rf"[@0-9]|{_HEAD}(?:(?:{TITLE})\.? \p{{L}}|(?:{GIVEN})(?: \p{{L}}|(?<=, [\p{{L}}-]{{1,20}})(?!\p{{L}})))")


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(_may_have(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def collisions(checked: DataFrame) -> DataFrame:
    """Of ``checked(original, mark, surrogate, new_mark)``: the originals with a surrogate that a smaller one has (``meets``) or that is an original."""
    least = checked.groupBy("new_mark").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("new_mark", "low")
    taken = checked.select(F.col("mark").alias("new_mark")).distinct().withColumn("taken", F.lit(True))
    d = checked.join(least, "new_mark", "left").join(taken, "new_mark", "left")
    meets = F.coalesce(F.col("mark") > F.col("low"), F.lit(False))
    return d.withColumn("meets", meets).where("meets OR taken").groupBy("original").agg(F.max("meets").alias("meets"))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """original, surrogate: free of collisions over all of ``found(original)`` (distinct; e-mails in lower case, names word by word)."""

    def named_by(rows: DataFrame, attempt: int) -> DataFrame:
        """A row for each form that a surrogate may take: names have one for each ending."""
        e, kind = F.col("original"), F.col("kind")
        rows = rows.select("original").withColumn("kind", kind_of(e))
        rows = rows.select("original", "kind", surrogate(e, key, str(attempt), kind).alias("surrogate"))
        forms = F.when(kind == "name", F.transform(F.array(*map(F.lit, "mfn")), lambda g: _ended(F.col("surrogate"), g))).otherwise(F.array("surrogate"))
        rows = rows.withColumn("form", F.explode(forms))
        return rows.select("original", _mark(kind, e).alias("mark"), "surrogate", _mark(kind, F.col("form")).alias("new_mark"))

    tasks = max(found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = materialize(named_by(found.repartition(tasks, "original"), 0), "surrogates")  # small rows, much work each
    for attempt in range(1, MAX_ATTEMPTS + 1):
        again = materialize(collisions(named), "collisions")
        if again.isEmpty():
            return named.select("original", "surrogate").distinct()
        named = materialize(named.join(again, "original", "left_anti").unionByName(named_by(again, attempt)), "surrogates")
    raise RuntimeError("surrogates keep colliding: a kind's values are too dense")


def pseudonymise(documents: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates and n_entities of every row."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("typed", F.transform(entities(F.col("text")), lambda e: F.struct(kind_of(e).alias("kind"), e.alias("e"))))
    rows = rows.withColumn("words", name_words(F.col("typed")))

    def plain(x: Column) -> Column:
        return F.when(x["kind"] == "email", F.lower(x["e"])).otherwise(x["e"])

    def alone(w: Column) -> Column:
        return F.concat(F.lit(ALONE), F.initcap(F.lower(w)))

    singles = F.transform("words", lambda x: alone(x["w"]))
    others = F.transform(F.filter("typed", lambda x: x["kind"] != "name"), plain)
    asked = rows.select(F.xxhash64("text").alias("mark"), F.explode(F.array_distinct(F.concat(others, singles))).alias("original")).distinct()
    asked = materialize(asked, "entities")
    named = surrogates(asked.select("original").distinct(), key)
    maps = asked.join(named, "original").groupBy("mark").agg(F.map_from_entries(F.collect_set(F.struct("original", "surrogate"))).alias("made"))
    maps = materialize(maps, "surrogates-by-text")  # a table of its own: the join can split the rows of a frequent text
    # Texts without entities stay where they are; the others meet their map by a merge join, at every size of the tables.
    none = rows.where(F.size("typed") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    rows = rows.where(F.size("typed") > 0).withColumn("mark", F.xxhash64("text")).join(maps.hint("merge"), "mark", "left")
    rows = rows.withColumn("between", F.split("text", ANY, -1))

    def told(x: Column) -> Column:
        """The gender that a word's mentions tell first, if any does."""
        mine = F.filter("words", lambda y: (F.lower(y["w"]) == F.lower(x["w"])) & (y["g"] != "n"))
        return F.coalesce(F.get(mine, F.lit(0))["g"], x["g"])

    def stem(x: Column) -> Column:
        return F.substring_index(F.col("made")[alone(x["w"])], " ", -1)

    names = F.transform("words", lambda x: F.struct(F.lower(x["w"]).alias("a"), stem(x).alias("s"), told(x).alias("g")))
    rows = rows.withColumn("names", F.transform(names, lambda x: F.struct(x["a"].alias("a"), x["s"].alias("s"), x["g"].alias("g"), _ended(x["s"], x["g"]).alias("b"))))

    def own(w: Column, gender: Column) -> Column:
        """The surrogate of a name's word, with the mention's gender if it tells one."""
        found = F.get(F.filter("names", lambda x: x["a"] == F.lower(w)), F.lit(0))
        new = F.when(gender == "n", found["b"]).otherwise(_ended(found["s"], gender))
        new = F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).otherwise(new)
        return F.when(w.rlike(r"^\p{Lu}"), F.coalesce(new, w)).otherwise(w)

    def entity(x: Column) -> Column:
        titles = F.regexp_extract(x["e"], f"^{TITLES}", 0)
        name = _let(_gender(x["e"]), lambda g: F.concat(titles, _each_run(F.substr(x["e"], F.length(titles) + 1), lambda w: own(w, g))))
        made = F.col("made")[plain(x)]
        return F.when(x["kind"] == "name", name).when(x["kind"] == "email", _let(made, lambda m: _as_written(m, x["e"]))).otherwise(made)

    # Other mentions: one pass over the text for each word of the names found in it.
    swaps = F.filter(F.array_distinct(F.transform("names", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))), lambda x: F.length(x["a"]) > 1)

    def mentions(part: Column) -> Column:
        def swap(acc: Column, x: Column) -> Column:
            return F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{M}])(?=\p{Lu})(?iu:"), x["a"], F.lit(r")(?![\p{L}\p{M}])")), x["b"])

        return F.aggregate("swaps", part, swap)

    rows = rows.withColumn("new", F.transform("typed", entity)).withColumn("swaps", swaps)
    kept = F.when(F.size("swaps") > 0, F.transform("between", mentions)).otherwise(F.col("between"))
    pairs = F.zip_with(kept, F.col("new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("new") > 0, F.array_join(pairs, "")).otherwise(F.col("text"))
    found = rows.select("doc_id", text.alias("text"), F.size("typed").cast("long").alias("n_entities"))
    return none.unionByName(found)
