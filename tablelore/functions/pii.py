"""Column expressions that recognise personal data in column names and in cell text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Entity names of the recognisers and the type each is reported as.
ENTITY_TYPES = {
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "PERSON": "NAME",
    "LOCATION": "LOCATION",
    "CREDIT_CARD": "FINANCIAL",
    "IBAN_CODE": "FINANCIAL",
}

# Our confidence per built-in recogniser.
ENTITY_CONFIDENCE = {
    "EMAIL_ADDRESS": 1.0,
    "PHONE_NUMBER": 0.75,
    "CREDIT_CARD": 1.0,
    "IBAN_CODE": 1.0,
}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

# International calling codes by their first digits, and how many digits may follow. Zones 1 and 7 have one plan each.
CALLING_CODES = (
    ("[17]", 10, 10),
    ("(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", 6, 13),
    ("(?:(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[67])[0-9]|99[1-68])", 5, 12),
)
ABROAD = r"\+(?:" + "|".join(f"{code}(?:[ .()/-]{{0,2}}[0-9]){{{low},{high}}}" for code, low, high in CALLING_CODES) + r")\b"
AT_HOME = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
PHONE = f"(?:{ABROAD}|{AT_HOME})"

# Digits in groups, each one blank or hyphen apart; a letter behind the last group spoils it. Possessive, so that no length of text needs a stack.
CARD_RUN = r"\b[0-9](?:[ -]?[0-9]){12,}+[A-Za-z_]?"
CARD_LENGTHS = (13, 19)

# Length of an account number by country, from the ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# What may be an account number, at every place where one may begin: longer than any, with the character behind it.
IBAN_START = r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?[a-z_]?))"

# What a text must hold for the patterns above to fit anywhere in it. Cheap to look for, and most texts lack it.
PHONE_CORE = r"\+[0-9]|[0-9]{3}[ .-][0-9]{4}"
CARD_CORE = r"[0-9](?:[ -]?[0-9]){12}"
IBAN_CORE = r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"

TRIGGER_LENGTH = 200


def _any(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def latitude_name(c: Column) -> Column:
    return c.contains("latitude") | c.endswith("lat") | c.contains("_lat") | c.startswith("lat_")


def longitude_name(c: Column) -> Column:
    return c.contains("longitude") | c.contains("lng")


def name_rules(column_name: Column) -> list[tuple[Column, str, float]]:
    """(test, type, confidence), first match wins."""
    c = F.lower(column_name)
    return [
        (_any(c, "email"), "EMAIL", 0.95),
        (_any(c, "phone", "fax"), "PHONE", 0.95),
        (_any(c, "address", "street"), "LOCATION", 0.90),
        (_any(c, "zip", "postal", "city") | c.rlike("(^|_)state($|_)"), "LOCATION", 0.75),
        (_any(c, "dob", "birth"), "DATE_OF_BIRTH", 0.95),
        (_any(c, "card", "account", "iban"), "FINANCIAL", 0.95),
        (latitude_name(c) | longitude_name(c), "LOCATION", 0.85),
        (_any(c, "name") & ~_any(c, "username"), "NAME", 0.80),
        (c.endswith("_id"), "ID", 0.70),
    ]


def pii_of_name(column_name: Column) -> Column:
    """struct(pii_type, confidence), or NULL when no rule fires."""
    out = None
    for test, kind, confidence in name_rules(column_name):
        hit = F.struct(F.lit(kind).alias("pii_type"), F.lit(confidence).alias("confidence"))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def luhn_ok(digits: Column) -> Column:
    """Card checksum: every second digit from the right is doubled, the sum divides by ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.try_cast("int"))
    weighed = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x < 5, x * 2).otherwise(x * 2 - 9))
    total = F.aggregate(weighed, F.lit(0), lambda acc, x: acc + x)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def iban_ok(code: Column) -> Column:
    """Account-number checksum, folded character by character so no number outgrows an int."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    values = F.transform(
        F.split(turned, ""),
        lambda x: F.when(x.rlike("^[0-9]$"), x.try_cast("int")).otherwise(F.ascii(x) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda acc, v: F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97)
    return F.length(code).between(15, 34) & (rest == 1)


def _all(text: Column, pattern: str, worth_it: Column, group: int = 0) -> Column:
    none = F.array().cast("array<string>")
    return F.when(worth_it, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def email_matches(text: Column) -> Column:
    return _all(text, EMAIL, text.contains("@"))


def phone_matches(text: Column) -> Column:
    """Numbers with a calling code, or in groups of 3, 3 and 4 digits."""
    return _all(text, PHONE, text.rlike(PHONE_CORE))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card_at(groups: Column, i: Column) -> Column:
    """(hit, size): groups and digits of the shortest card number that begins with group i and ends with a group; hit is 0 if none does."""
    low, high = CARD_LENGTHS
    start = F.struct(F.lit("").alias("digits"), F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(0).alias("size"))

    def add(acc: Column, group: Column) -> Column:
        # one digit too many is kept, so that a number too long stays too long
        longer = F.concat(acc["digits"], F.substring(group, 1, high + 1))
        state = lambda digits: F.struct(
            digits.alias("digits"), (acc["n"] + 1).alias("n"), F.when(luhn_ok(digits), acc["n"] + 1).otherwise(0).alias("hit"), F.length(digits).alias("size"))
        over = (acc["hit"] > 0) | (F.length(acc["digits"]) > high)
        return F.when(over, acc).otherwise(_with(longer, state))

    return F.aggregate(F.slice(groups, i + 1, F.lit(high)), start, add)


def _cards_in(run: Column) -> Column:
    """Card numbers of a run of digits, each group once: at every group the shortest one, unless an earlier one holds the group."""

    def of(whole: Column) -> Column:
        found = _with(F.split(whole, "[ -]"), lambda groups: F.transform(
            groups, lambda g, i: F.struct(F.length(g).alias("own"), _card_at(groups, i).alias("card"))))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

        def pick(acc: Column, x: Column) -> Column:
            size = x["card"]["size"] + x["card"]["hit"] - 1
            take = (x["card"]["hit"] > 0) & (acc["at"] >= acc["free"])
            return F.struct((acc["at"] + x["own"] + 1).alias("at"), F.when(take, acc["at"] + size).otherwise(acc["free"]).alias("free"),
                            F.when(take, F.array_append(acc["out"], F.substring(whole, acc["at"] + 1, size))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(found, start, pick, lambda acc: acc["out"])

    return _with(F.regexp_replace(run, "[ -]?[0-9]+[A-Za-z_]$", ""), of)


def card_matches(text: Column) -> Column:
    """Card numbers of 13 to 19 digits with a right checksum, whatever digits stand before or after them in groups of their own."""
    return F.flatten(F.transform(_all(text, CARD_RUN, text.rlike(CARD_CORE)), _cards_in))


def _iban_of(candidate: Column) -> Column:
    """The account number a candidate begins with, as long as its country's are and with no character right behind it; NULL if it is none."""
    table = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    size = F.try_element_at(table, F.left(candidate, F.lit(2)))
    places = F.sequence(F.lit(1), F.length(candidate))
    end = _with(size, lambda n: F.get(F.filter(places, lambda p: F.length(F.replace(F.substring(candidate, F.lit(1), p), F.lit(" "))) == n), F.lit(0)))

    def checked(e: Column) -> Column:
        found = F.substring(candidate, F.lit(1), e)
        alone = F.substring(candidate, e + 1, F.lit(1)).isin("", " ")
        return F.when(alone & iban_ok(F.replace(found, F.lit(" "))), found)

    return _with(end, checked)


def iban_matches(text: Column) -> Column:
    """Account numbers of the right length for their country with a right checksum, in one piece or in groups of four."""
    return F.array_compact(F.transform(_all(text, IBAN_START, text.rlike(IBAN_CORE), 1), _iban_of))


MATCHERS: dict[str, Callable[[Column], Column]] = {
    "EMAIL_ADDRESS": email_matches,
    "PHONE_NUMBER": phone_matches,
    "CREDIT_CARD": card_matches,
    "IBAN_CODE": iban_matches,
}


def entity_flags(text: Column) -> dict[str, Column]:
    """One boolean per built-in recogniser."""
    return {
        "EMAIL_ADDRESS": text.contains("@") & text.rlike(EMAIL),
        "PHONE_NUMBER": text.rlike(PHONE_CORE) & text.rlike(PHONE),
        "CREDIT_CARD": F.size(card_matches(text)) > 0,
        "IBAN_CODE": F.size(iban_matches(text)) > 0,
    }


def trigger(text: Column) -> Column:
    t = F.btrim(text)
    return F.when(F.length(t) > TRIGGER_LENGTH, F.concat(F.substring(t, 1, TRIGGER_LENGTH - 3), F.lit("..."))).otherwise(t)


def report_type(entity: Column) -> Column:
    """The reported type of an entity; NULL for entities that are not reported."""
    table = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.try_element_at(table, entity)
