"""Operator 3, personal data: detected entities get keyed surrogates of their own kind. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, written

#: Titles by gender, in Latin and Cyrillic script; in capitals only before names in capitals.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа"], "n": ["Dr", "Prof"]}
LOUD = {"m": ["MR", "HERR", "MONSIEUR", "SEÑOR"], "f": ["MRS", "MISS", "FRAU", "MADAME", "SEÑORA"]}
#: How well-known access keys begin.
KEY_STARTS = ["AKIA", "ASIA", "sk-", "ghp_", "xoxb-", "xoxp-", "AIza"]
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_LOUD = "|".join(t for ts in LOUD.values() for t in ts)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d+])(?:(?:\d{4}[ -]?){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}|\+\d{1,3} \d{2,4} \d{5,8}|0\d{2,4}[ /-]\d{3}[ -]\d{2}[ -]\d{2})(?!\d)",
    "key": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|sk-[0-9A-Za-z_-]{20,200}|ghp_[0-9A-Za-z]{36}|xox[bp]-[0-9A-Za-z-]{10,200}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])",
    # Beyond 64 places hexadecimal text without any digit is a run of letters, not a secret.
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,64}|(?=[a-fA-F]*[0-9])[0-9a-fA-F]{65,})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?|(?:{_LOUD})\.? \p{{Lu}}{{2,31}}(?: \p{{Lu}}{{2,31}})?(?!\p{{L}}))",
}
#: The first characters of each kind: most places of a text are passed over by one look at a character.
FIRST = {"ip": r"\d", "ip6": "[0-9A-Fa-f]", "iban": "[A-Z]", "card": r"\d", "ssn": r"\d", "phone": r"[\d+(]", "key": "[Asgx]", "secret": "[0-9A-Fa-f]", "name": "[MHSFDPг]"}
_REST = "|".join(f"(?={FIRST[k]}){x}" for k, x in PATTERNS.items() if k != "email")
_ALL = PATTERNS["email"] + "|" + _REST
#: What any entity but an address with an at sign holds: a digit, a title, a long run of hexadecimal letters, a colon between
#: hexadecimal digits or how a key begins; texts without are not searched further.
_HINT = rf"\d|(?={FIRST['name']})(?:{_TITLE}|{_LOUD})\.? \p{{Lu}}|[a-fA-F]{{32}}|[0-9A-Fa-f]::?[0-9A-Fa-f]|sk-|xox[bp]-"
#: Numbers that are cards only if their check digit is right.
_CARD_IF_LUHN = r"^(?:\d{13,15}|\d{17,19}|\d{4}[ -]\d{6}[ -]\d{5})$"
_IBAN = "^" + PATTERNS["iban"] + "$"
ROUNDS = 64
#: Letters by script for surrogates: class of characters, first code point, how many follow on.
SCRIPTS = [
    (r"\p{IsCyrillic}", 0x430, 32), (r"\p{IsGreek}", 0x3B1, 17), (r"\p{IsArmenian}", 0x561, 38), (r"\p{IsHebrew}", 0x5D0, 27), (r"\p{IsArabic}", 0x628, 19), (r"\p{IsDevanagari}", 0x915, 37),
    (r"\p{IsThai}", 0xE01, 46), (r"\p{IsHiragana}", 0x304B, 58), (r"\p{IsKatakana}", 0x30AB, 58), (r"\p{IsHangul}", 0xAC00, 11172), (r"\p{IsHan}", 0x4E00, 20000),
]
#: Consonants, vowels, and endings of female, male and other given names and of surnames, by script.
SYLLABLES = [
    (r"\p{IsCyrillic}", "бвгдклмнрст", "аеиоу", ("на", "слав", "ин")), (r"\p{IsGreek}", "βγδζκλμνπρστ", "αειου", ("να", "ρος", "ης")), ("", "bdfgklmnprstv", "aeiou", ("na", "rd", "son")),
]


def _kind(entity: Column) -> Column:
    out = F.lit("secret")
    for kind in reversed(["email", "ip", "ip6", "iban", "card", "ssn", "phone", "key", "name"]):
        out = F.when(entity.rlike("^(?:" + PATTERNS[kind] + ")$"), kind).otherwise(out)
    return out


def _gender(entity: Column) -> Column:
    out = F.lit("n")
    for g in ("f", "m"):
        out = F.when(entity.rlike("^(?:" + "|".join(TITLES[g] + LOUD[g]) + r")\.? "), g).otherwise(out)
    return out


def _luhn(digits: Column, from_right_odd_doubled: int) -> Column:
    """Sum of the digits with every second one, counted from the right, doubled (digits of the double added)."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == from_right_odd_doubled, (x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without blanks, its first four places put last and letters read as 10 to 35."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))

    def step(a, c):
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step)


def _false_alarm(entity: Column) -> Column:
    """What a pattern finds but a check digit rules out."""
    card = entity.rlike(_CARD_IF_LUHN) & (_luhn(F.regexp_replace(entity, "[^0-9]", ""), 1) % 10 != 0)
    return card | (entity.rlike(_IBAN) & (_mod97(F.replace(entity, F.lit(" "), F.lit(""))) != 1))


def _unit(kind: Column, text: Column) -> Column:
    """What a surrogate stands for: names, addresses and hexadecimal secrets are one in any case of their letters."""
    return F.when(kind.isin("email", "ip6", "secret") | kind.startswith("given") | (kind == "surname"), F.lower(text)).when(kind == "iban", F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def _chars(text: Column, one) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _with_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, unit, attempt) with the surrogate of `unit` of `kind` at `attempt`: digits for digits, letters for letters of
    their script and case, the rest kept. Addresses and names grow with the attempt, so that they cannot run out; other kinds
    keep their length. What the forms share is made in columns, once a row: written out in each form it makes a plan of
    megabytes of text, which the driver holds many times over."""
    kind, unit, attempt = F.col("kind"), F.col("unit"), F.col("attempt")
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "unit", attempt.cast("string"))
    stream, numbers, letters = F.col("__stream"), F.col("__numbers"), F.col("__letters")
    consonants, vowels, end = F.col("__consonants"), F.col("__vowels"), F.col("__end")

    def number(i, modulo):
        """Three bytes of the stream, which is read again from the start where it ends, with the round mixed in."""
        return ((F.get(numbers, (i % 60).cast("int")) + F.floor(i / 60) * 7919) % modulo).cast("int")

    def like(c, i):
        code = 97 + number(i, 26)
        for script, first, n in reversed(SCRIPTS):
            code = F.when(c.rlike(script), first + number(i, n)).otherwise(code)
        # Code points beyond 255 come from their UTF-16 form.
        small = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when(c.rlike("[0-9]"), number(i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).otherwise(c)

    def by_script(of):
        """What `of` takes from the first of `SYLLABLES` whose script `unit` holds, else null."""
        out = F.lit(None).cast("string")
        for script, *rest in reversed(SYLLABLES):
            out = F.when(unit.rlike(script or r"\p{IsLatin}"), of(*rest)).otherwise(out)
        return out

    made = units.withColumns({
        "__stream": F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("more"), seed), 256)),
        "__consonants": by_script(lambda c, v, e: F.lit(c)), "__vowels": by_script(lambda c, v, e: F.lit(v)),
        "__end": by_script(lambda c, v, e: F.when(kind == "given_f", e[0]).when(kind == "given_m", e[1]).otherwise(e[2])),
    })
    # What letters are made for; names without syllables of their script get a letter more each attempt.
    text = F.when(kind == "email", F.substring_index(unit, "@", 1)).when(kind.isin("card", "phone", "ssn", "key", "iban"), unit)
    text = text.when(~kind.isin("ip", "ip6", "secret") & consonants.isNull(), F.substr(F.repeat(unit, 16), F.lit(1), (F.length(unit) + attempt).cast("int")))
    three = lambda i: F.conv(stream.substr((i * 2 + 1).cast("int"), F.lit(6)), 16, 10).cast("long")
    made = made.withColumns({"__numbers": F.transform(F.sequence(F.lit(0), F.lit(59)), three), "__text": text})
    made = made.withColumn("__letters", _chars(F.col("__text"), like))

    tag = F.substr(F.conv(F.sha2(F.concat(F.lit("tag"), seed), 256).substr(1, 15), 16, 10), F.lit(1), (2 + 2 * attempt).cast("int"))
    email = F.concat(letters, F.lit("@mail"), tag, F.lit(".example.org"))
    ip = F.concat_ws(".", (number(F.lit(0), 223) + 1).cast("string"), number(F.lit(3), 256).cast("string"), number(F.lit(6), 256).cast("string"), (number(F.lit(9), 254) + 1).cast("string"))
    ip6 = _chars(unit, lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex((number(i, 15) + 1).cast("long")))).otherwise(c))
    plain = F.regexp_replace(unit, "[^0-9]", "")
    digits = F.regexp_replace(letters, "[^0-9]", "")
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    check = ((10 - _luhn(body, 0) % 10) % 10).cast("string")
    card = F.when(_luhn(plain, 1) % 10 == 0, F.concat(letters.substr(F.lit(1), F.length(letters) - 1), check)).otherwise(letters)
    prefix = F.regexp_extract(unit, r"^\+\d{1,3}|^0", 0)
    phone = F.concat(prefix, F.substr(letters, F.length(prefix) + 1))
    start = F.regexp_extract(unit, "^(?:" + "|".join(KEY_STARTS) + ")", 0)
    access = F.concat(start, F.substr(letters, F.length(start) + 1))
    country, account = unit.substr(1, 2), F.substr(letters, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    secret = F.repeat(stream, F.ceil(F.length(unit) / 128).cast("int")).substr(F.lit(1), F.length(unit))
    # Syllables, one more each attempt, and an ending by gender for given names.
    pair = lambda i: F.concat(*[x.substr(number(2 * i + k, F.length(x)) + 1, F.lit(1)) for k, x in enumerate((consonants, vowels))])
    word = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), pair), ""), end)
    out = F.when(consonants.isNull(), letters).otherwise(word)
    for name, value in {"email": email, "ip": ip, "ip6": ip6, "card": card, "phone": phone, "ssn": letters, "key": access, "iban": iban, "secret": secret}.items():
        out = F.when(kind == name, value).otherwise(out)
    return made.select(*units.columns, out.alias("surrogate"))


def _worded(kind: Column, old: Column, new: Column) -> Column:
    """The surrogate `new` of a unit in the form in which `old` has it: blanks, capitals all over, first or by place."""
    by_place = lambda t: _chars(t, lambda c, i: F.when(old.substr((i + 1).cast("int"), F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    loud = (old == F.upper(old)) & (old != F.lower(old)) & (F.length(old) > 1)
    first = F.concat(F.upper(new.substr(1, 1)), F.substr(new, F.lit(2)))
    local = F.substring_index(new, "@", 1)
    email = F.when(loud, F.upper(new)).otherwise(F.concat(by_place(local), F.substr(new, F.length(local) + 1)))
    grouped = F.regexp_replace(new, "(.{4})(?=.)", "$1 ")
    return (
        F.when(kind == "email", email).when(kind == "ip6", by_place(new)).when(kind == "iban", F.when(F.contains(old, F.lit(" ")), grouped).otherwise(new))
        .when(kind == "secret", F.when(old == F.lower(old), new).when(old == F.upper(old), F.upper(new)).otherwise(by_place(new)))
        .when(kind.startswith("given") | (kind == "surname"), F.when(loud, F.upper(new)).otherwise(first)).otherwise(new)
    )


def surrogate_units(units: DataFrame, key: str) -> DataFrame:
    """(kind, unit, surrogate) with a different surrogate for each unit of a kind, none of which is a unit of the data.

    Collisions are found by grouping surrogates; of those that collide the first unit keeps its own, the others try again.
    The space of addresses grows a hundredfold an attempt, that of names by a syllable, so a few rounds do. Kinds of fixed
    length have 1e9 values and more; only where the data hold most of these do the rounds run out, which is an error.
    """
    done, todo = [], written(units.distinct().withColumn("attempt", F.lit(0)), "units")
    real = todo.select(F.col("kind"), F.col("unit").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(ROUNDS):
        # Written, for it is read twice.
        tried = written(_with_surrogates(todo, key), "tried")
        first = tried.groupBy("kind", "surrogate").agg(F.min("unit").alias("winner"))
        taken = reduce(DataFrame.unionByName, [real.select("kind", "surrogate"), *[d.select("kind", "surrogate") for d in done]]).distinct()
        judged = tried.join(first, ["kind", "surrogate"]).join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        judged = written(judged.select("kind", "unit", "attempt", "surrogate", (F.col("taken").isNull() & (F.col("winner") == F.col("unit"))).alias("ok")), "surrogates")
        done.append(judged.where("ok").select("kind", "unit", "surrogate"))
        todo = judged.where("not ok").select("kind", "unit", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise ValueError(f"units still collide after {ROUNDS} rounds: too few surrogates of their kind")


def pseudonymise(docs: DataFrame, key: str = "strataframe") -> DataFrame:
    """All columns of `docs` with entities in `text` replaced, and n_entities and entity_kinds.

    The same entity gets the same surrogate everywhere under one key, in capitals or not, different ones get different
    ones; a person's surname is replaced alike with and without the given name. Null text stays null with no entities;
    empty texts and texts without entities stay as they are; repeated rows are rewritten alike; an empty table gives an
    empty table; columns named like the new ones are replaced. The key should be kept secret.
    """
    r1, r2 = row_key(F.lit(0), F.col("text"))
    # Only texts with an at sign are searched for addresses, at every word.
    searched = F.when(F.contains("text", F.lit("@")), F.regexp_extract_all("text", F.lit(_ALL), 0)).when(F.col("text").rlike(_HINT), F.regexp_extract_all("text", F.lit(_REST), 0))
    base = docs.drop("n_entities", "entity_kinds").withColumns({"__e": F.coalesce(searched, F.array().cast("array<string>")), "__r1": r1, "__r2": r2})
    # What is found and no entity stays in __e, which lies between the pieces of the text, and is put back as it is.
    base = base.withColumn("__f", F.filter("__e", lambda e: ~_false_alarm(e)))
    mentions = base.where("size(__f) > 0").select("__r1", "__r2", F.explode(F.array_distinct("__f")).alias("entity"))
    mentions = written(mentions.distinct(), "mentions")
    entities = mentions.groupBy("entity").agg(F.count("*").alias("texts")).select("entity").withColumn("kind", _kind(F.col("entity")))
    title = F.regexp_extract("entity", r"^\S+", 0)
    words = F.slice(F.split("entity", " "), 2, 9)
    surname = F.lit("surname")
    units = F.when(
        F.col("kind") == "name",
        F.transform(words, lambda w, i: F.struct(i.alias("i"), F.when(i == F.size(words) - 1, surname).otherwise(F.concat(F.lit("given_"), _gender(F.col("entity")))).alias("kind"), w.alias("unit"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("kind").alias("kind"), F.col("entity").alias("unit"))))
    parts = entities.select("entity", F.col("kind").alias("whole"), F.inline(units).alias("i", "kind", "word"))
    parts = written(parts.withColumn("unit", _unit(F.col("kind"), F.col("word"))), "parts")
    chosen = written(surrogate_units(parts.select("kind", "unit"), key), "chosen")
    worded = parts.join(chosen, ["kind", "unit"]).withColumn("surrogate", _worded(F.col("kind"), F.col("word"), F.col("surrogate")))
    joined = worded.groupBy("entity", "whole").agg(F.sort_array(F.collect_list(F.struct("i", "surrogate"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["surrogate"]), " ")
    mapping = written(joined.select("entity", "whole", F.when(F.col("whole") == "name", F.concat(title, F.lit(" "), text)).otherwise(text).alias("new")), "mapping")
    by_text = mentions.join(mapping, "entity").groupBy("__r1", "__r2").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("__new"), F.sort_array(F.collect_set("whole")).alias("__kinds")
    )
    between = F.split("text", _ALL, -1)
    pieces = F.zip_with(F.concat(F.array(F.lit("")), F.transform("__e", lambda e: F.coalesce(F.col("__new")[e], e))), between, lambda a, b: F.concat(a, b))
    rewritten = base.where("size(__f) > 0").join(by_text, ["__r1", "__r2"])
    empty = F.array().cast("array<string>")
    as_is = base.where("size(__f) = 0").withColumns({"n_entities": F.lit(0).cast("long"), "entity_kinds": empty}).drop("__e", "__f", "__r1", "__r2")
    rewritten = rewritten.withColumns({"text": F.array_join(pieces, ""), "n_entities": F.size("__f").cast("long"), "entity_kinds": F.col("__kinds")})
    return as_is.unionByName(rewritten.select(*as_is.columns))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymise() over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs).select("doc_id", "n_entities", "entity_kinds", "text")
