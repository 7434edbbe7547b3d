"""PII: detected entities get keyed surrogates of their own type and form, in SQL functions only.

An entity is first reduced to what it names: an address in small letters, a number's digits, each part of a name without its honorific. A surrogate is a
function of the key, the type and that, so that an entity has the same surrogate in every document and spelling (coreference), and is then written in
the form that the entity has in the text. Two entities whose surrogates collide, and one whose surrogate is an entity of the corpus, are found
by joins over the distinct entities; all but the first of them are given a later attempt's surrogate until none collide
(distinctness). Those few are the only ones that texts are joined with.
"""

from __future__ import annotations

import secrets as random_source

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgrove.llm.common import checkpoint, read, small

KEY_SETTING = "spark.gridgrove.pii.key"  # the session's setting that has the key
BROADCAST = 200_000  # collided entities of documents up to which their attempts are broadcast
LATE = 8  # attempts from which on a surrogate gets 48 bits more, as the numbers of its form may be used up
MOST_ATTEMPTS = 64

# What each type looks like; of overlapping entities the first to begin counts, then the first type.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]|[.-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "ip": rf"(?<![A-Za-z0-9]|[0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "name": r"(?<![\p{L}\p{N}])(?:Mrs|Mr|Ms|Miss|Herrn|Herr|Frau|Señora|Señor|Sra|Monsieur|Madame|Mme|Госпожа|Господин|Κυρία|Κύριος)\.? \p{Lu}\p{Ll}{1,30}(?:[ -]\p{Lu}\p{Ll}{1,30}){0,2}(?![\p{L}\p{N}])",
}
_FEMALE = "^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|Κυρία)"
_HONORIFIC = r"^(?:Mrs|Mr|Ms|Miss|Herrn|Herr|Frau|Señora|Señor|Sra|Monsieur|Madame|Mme|Госпожа|Господин|Κυρία|Κύριος)\.? "
# What any entity holds: two digits, an at sign, or a part of an honorific.
SIGNS = "[0-9][0-9.]|@|Mr|Ms|Miss|Herr|Frau|Señor|Sra|Monsieur|Madame|Mme|Госпо|Κυρ|Κύρ"
# A card number or IBAN may begin and end at any group of a longer run, as beside a CVV: its check digits tell which groups are its own.
_BEFORE = {"iban": "(?<![A-Za-z0-9])", "card": r"(?<![A-Za-z0-9.]|(?<![0-9])-)"}
_AFTER = {"iban": "(?![A-Za-z0-9])", "card": r"(?![A-Za-z0-9]|\.[0-9])"}
_RUN = {"iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "card": "[0-9](?:[ -]?[0-9]){12,18}"}

# Syllables of made-up names by script, and what given names and surnames end in by gender.
_SYLLABLES = {
    "latin": ("ba be da de fa fe ga ka la le li ma me mi na ne ni pa pe ra re ri sa se ta te va ve wa za ze zo".split(), ("na", "ro"), ("n", "n")),
    "cyrillic": ("ба бе да де фа фе га ка ла ле ли ма ме ми на не ни па пе ра ре ри са се та те ва ве жа за зе зо".split(), ("на", "ров"), ("ова", "ов")),
    "greek": ("βα βε δα δε φα φε γα κα λα λε λι μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε βι ξα ξε ζα ζε ζο".split(), ("να", "ρος"), ("ς", "ς")),
}


def by_script(value: Column, made) -> Column:
    """made(script) of the value's own script."""
    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def entity_type(value: Column) -> Column:
    """The first type whose whole pattern the value has."""
    out = F.lit("name")
    for kind in reversed(list(PATTERNS)[:-1]):
        plain = PATTERNS[kind]
        out = F.when(value.rlike(f"^(?:{plain})$"), F.lit(kind)).otherwise(out)
    return out


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(value: Column) -> Column:
    """The digits of a value, as an array of integers."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """The Luhn sum of a value's digits, modulo 10."""
    return F.aggregate(F.reverse(digits(value)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), lambda a, d: F.struct((a["i"] + 1).alias("i"), (a["s"] + F.when(a["i"] % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))).cast("int").alias("s")))["s"] % 10


def mod97(value: Column) -> Column:
    """An IBAN's remainder: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.cast("int")) % 97).when(c.rlike("^[A-Z]$"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(r).cast("int"))


def valid(kind: Column, value: Column) -> Column:
    """Whether a value passes its type's check digits; other types have none."""
    return F.when(kind == "card", luhn(value) == 0).when(kind == "iban", mod97(value) == 1).otherwise(F.lit(True))


def stream(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """256 keyed bits in hex, extended to 512."""
    seed = F.concat_ws(":", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit(":more")), 256))


def number(bits: Column, i: Column | int) -> Column:
    """The i-th byte of the stream; past its end it begins again."""
    at = (i if isinstance(i, Column) else F.lit(i)) % 64
    return F.conv(F.substring(bits, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def same_form(value: Column, bits: Column, keep: int = 0) -> Column:
    """Other digits for digits, other small and capital letters for theirs; the first `keep` characters and all else stay."""

    def swap(c, i):
        n, code = number(bits, i), F.ascii(c)
        return (
            F.when((i < keep) | ~c.rlike("^[0-9A-Za-z]$"), c)
            .when(c.rlike("^[0-9]$"), ((code - 47 + n % 9) % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), F.char(97 + (code - 96 + n % 25) % 26))
            .otherwise(F.char(65 + (code - 64 + n % 25) % 26))
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), swap), "")


def email(value: Column, bits: Column) -> Column:
    """A local part of the same form, under a domain of a reserved top level that stands for the entity's own."""
    local = F.substring_index(value, "@", 1)
    return F.concat(same_form(local, bits), F.lit("@mail-"), F.substring(bits, 113, 12), F.lit(".example"))


def card(value: Column, bits: Column) -> Column:
    """The same first digit and length; the last digit makes the Luhn sum right."""
    draft = F.concat(F.substring(same_form(value, bits, 1), F.lit(1), F.length(value) - 1), F.lit("0"))
    return bound(draft, lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((10 - luhn(d)) % 10).cast("string")))


def iban(value: Column, bits: Column) -> Column:
    """The same country and form, with right check digits."""
    draft = F.concat(F.substring(value, 1, 2), F.lit("00"), F.substring(same_form(value, bits, 4), F.lit(5), F.length(value)))
    return bound(draft, lambda d: F.concat(F.substring(value, 1, 2), F.lpad((98 - mod97(d)).cast("string"), 2, "0"), F.substring(d, F.lit(5), F.length(d))))


def ip(bits: Column) -> Column:
    """An address of the reserved range from 240.0.0.0."""
    return F.concat_ws(".", 240 + number(bits, 0) % 15, number(bits, 1), number(bits, 2), 1 + number(bits, 3) % 254)


def stem(value: Column, bits: Column) -> Column:
    """Four syllables of the script of a name's part."""

    def made(script: str) -> Column:
        table = F.array(*(F.lit(s) for s in _SYLLABLES[script][0]))
        return F.concat(*(F.get(table, number(bits, k) % len(_SYLLABLES[script][0])) for k in range(4)))

    return by_script(value, made)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What stands for a canonical value: an address, digits, or the stem of a name's part."""

    def made(bits):
        ssn = F.concat(F.lit("9"), F.substring(same_form(value, bits, 1), F.lit(2), F.length(value)))
        return (
            F.when(kind == "email", email(value, bits)).when(kind == "iban", iban(value, bits)).when(kind == "card", card(value, bits)).when(kind == "ssn", ssn)
            .when(kind == "ip", ip(bits)).when(kind == "phone", same_form(value, bits, 1)).otherwise(stem(value, bits))
        )

    return bound(stream(kind, value, attempt, key), made)


def mark(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Nothing, or after LATE attempts 12 more characters that tell surrogates apart."""
    return F.when(attempt >= LATE, F.translate(F.substring(stream(kind, value, attempt, key), 65, 12), "0123456789", "ghijklmnop")).otherwise(F.lit(""))


def canonical(kind: Column, value: Column) -> Column:
    """What an entity other than a name is told by: small letters, digits, or both without spaces; a US phone number has its country code."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    phone = F.when(value.startswith("+"), plain).otherwise(F.concat(F.lit("1"), plain))
    return F.when(kind == "email", F.lower(value)).when(kind == "ip", value).when(kind == "phone", phone).otherwise(plain)


def name_parts(value: Column) -> Column:
    """A name's parts after the honorific, each with the space or hyphen before it."""
    title = F.regexp_extract(value, _HONORIFIC, 0)
    return F.regexp_extract_all(F.substring(value, F.length(title) + 1, F.length(value)), F.lit(r"[ -]?\p{L}+"), F.lit(0))


def part_name(value: Column, part: Column, last: Column) -> Column:
    """A name's part in small letters; a woman's Cyrillic surname without its last letter."""
    plain = F.lower(F.regexp_replace(part, "^[ -]", ""))
    return F.when(last & value.rlike(_FEMALE) & plain.rlike("^\\p{IsCyrillic}{3,}а$"), F.regexp_replace(plain, "а$", "")).otherwise(plain)


def numbered(value: Column, body) -> Column:
    """body(part, whether it is the last) of each of a name's parts."""

    def each(parts):
        return F.transform(parts, lambda p, i: body(p, i == F.size(parts) - 1))

    return bound(name_parts(value), each)


def units(kind: Column, value: Column) -> Column:
    """The canonical values that an entity consists of: one, or those of a name's parts."""
    return F.when(kind == "name", numbered(value, lambda p, last: part_name(value, p, last))).otherwise(F.array(canonical(kind, value)))


def in_form(value: Column, plain: Column) -> Column:
    """The last letters and digits of plain in the places of value's; all else of value stays."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    skipped = F.length(plain) - F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    start = F.struct((skipped + 1).alias("i"), F.lit("").alias("out"))

    def step(s, c):
        taken = c.rlike("^[0-9A-Za-z]$")
        return F.struct((s["i"] + F.when(taken, 1).otherwise(0)).alias("i"), F.concat(s["out"], F.when(taken, F.substring(plain, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(chars, start, step)["out"]


def replaced(kind: Column, value: Column, tries: Column, key: str) -> Column:
    """An entity's surrogate in its own form; tries has the attempts of canonical values (kind:value) whose first surrogates collide."""

    def attempt(k: Column, v: Column) -> Column:
        return F.coalesce(F.element_at(tries, F.concat(k, F.lit(":"), v)), F.lit(0))

    def written(own):  # (value, attempt)
        made = surrogate(kind, own["v"], own["n"], key)
        return F.concat(F.when(kind.isin("email", "ip"), made).otherwise(bound(made, lambda m: in_form(value, m))), mark(kind, own["v"], own["n"], key))

    one = bound(canonical(kind, value), lambda v: bound(F.struct(v.alias("v"), attempt(kind, v).alias("n")), written))
    name = F.lit("name")

    def part(p, last):
        def ending(script: str) -> Column:
            _, (she, he), (her, his) = _SYLLABLES[script]
            female = value.rlike(_FEMALE)
            return F.when(last & female, F.lit(her)).when(last, F.lit(his)).when(female, F.lit(she)).otherwise(F.lit(he))

        def made(own):
            bits = stream(name, own["v"], own["n"], key)
            return F.concat(F.regexp_extract(p, "^[ -]", 0), F.initcap(F.concat(bound(bits, lambda b: stem(own["v"], b)), mark(name, own["v"], own["n"], key), by_script(own["v"], ending))))

        return bound(part_name(value, p, last), lambda v: bound(F.struct(v.alias("v"), attempt(name, v).alias("n")), made))

    names = F.concat(F.regexp_extract(value, _HONORIFIC, 0), F.array_join(numbered(value, part), ""))
    return F.when(kind == "name", names).otherwise(one)


def checked(text: Column, kind: str) -> Column:
    """The distinct values of a text, at all groups of its runs, that have right check digits; of those with one beginning the longest is first."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_BEFORE[kind]}(?=({_RUN[kind]}){_AFTER[kind]})"), F.lit(1)))

    def heads(v):
        ends = F.filter(F.sequence(F.lit(12), F.length(v)), lambda e: ~F.substring(v, e + 1, F.lit(1)).rlike("[A-Z0-9]"))
        return F.transform(ends, lambda e: F.substring(v, F.lit(1), e))

    right = F.filter(F.array_distinct(F.flatten(F.transform(runs, heads))), lambda v: v.rlike(f"^{_RUN[kind]}$") & valid(F.lit(kind), v))
    return F.when(text.rlike(_RUN[kind]), F.sort_array(right, asc=False)).otherwise(F.expr("cast(array() as array<string>)"))


def any_of(text: Column) -> Column:
    """A pattern of all entities of a text: of cards and IBANs the very values with right check digits, so that no others hide what is within them."""

    def own(kind: str) -> Column:
        return F.transform(checked(text, kind), lambda v: F.concat(F.lit(f"(?:{_BEFORE[kind]}"), v, F.lit(f"{_AFTER[kind]})")))

    plain = {k: F.lit(f"(?:{p})") for k, p in PATTERNS.items()}
    return F.concat_ws("|", *(own(k) if k in _RUN else plain[k] for k in PATTERNS))


def found_in(text: Column, pattern: Column) -> Column:
    """Entity-like values in the order of the text; the patterns are tried only where their first signs are."""
    return F.when(text.rlike(SIGNS), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, value): every distinct valid entity of each document."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), any_of(F.col(text)).alias("any"))
    rows = rows.select("id", F.explode(F.array_distinct(found_in(F.col("t"), F.col("any")))).alias("value")).withColumn("kind", entity_type(F.col("value")))
    return rows.where(valid(F.col("kind"), F.col("value"))).select("id", "kind", "value")


def overrides(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, other, attempt) of the distinct canonical values (kind, value) whose first surrogate collides: another one that doesn't, and its attempt."""

    def drawn_at(rows: DataFrame, attempt: int) -> DataFrame:
        kind, value, n = F.col("kind"), F.col("value"), F.lit(attempt)
        return checkpoint(rows.select("kind", "value", F.concat(surrogate(kind, value, n, key), mark(kind, value, n, key)).alias("other"), n.alias("attempt")))

    values = drawn_at(values, 0)
    originals = values.select("kind", F.col("value").alias("other"))

    def losers(drawn: DataFrame, kept: DataFrame | None) -> DataFrame:
        """Those that aren't the first of their surrogate, or whose surrogate is taken or an entity."""
        taken = originals if kept is None else originals.union(kept.select("kind", "other"))
        first = drawn.groupBy("kind", "other").agg(F.min("value").alias("_first"))
        lost = drawn.join(first, ["kind", "other"]).where(F.col("value") != F.col("_first")).select("kind", "value")
        return lost.union(drawn.join(taken, ["kind", "other"], "left_semi").select("kind", "value")).distinct()

    lost = checkpoint(losers(values, None))
    settled, done = values, values.limit(0)
    for attempt in range(1, MOST_ATTEMPTS):
        if small(lost, 0):
            return done
        settled = settled.join(lost, ["kind", "value"], "left_anti")
        drawn = drawn_at(lost, attempt)
        lost = checkpoint(losers(drawn, settled))
        good = drawn.join(lost, ["kind", "value"], "left_anti")
        settled, done = settled.union(good), checkpoint(done.union(good))
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; where there is none, a random one that lasts as long as the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = random_source.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, secret: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every detected entity of the text replaced, and n_entities, how many were; all else stays.

    Detected are e-mail addresses, IBANs and card numbers with right check digits, US social security numbers, IPv4 addresses, phone
    numbers with a country code or in US form, and names after an honorific, which gives their gender. The secret is that of the
    session's setting KEY_SETTING where none is given; without a setting it is random, and surrogates differ from session to session. A null text stays null
    with 0 entities, an empty one stays empty, and texts of any length are read whole. Repeated rows are all returned, and an empty table gives none. A
    column n_entities of docs is replaced. Rows of one id, or of none, share the attempts of their entities.
    """
    secret = secret or session_key(docs.sparkSession)
    docs = docs.drop("n_entities")
    each = entities(docs, key, text).select("id", "kind", F.explode(units(F.col("kind"), F.col("value"))).alias("value"))
    each = checkpoint(each.distinct())
    other = overrides(each.select("kind", "value").distinct(), secret).select("kind", "value", "attempt")
    other = F.broadcast(other) if small(other, BROADCAST) else other
    collided = checkpoint(each.join(other, ["kind", "value"]))
    entry = F.struct(F.concat("kind", F.lit(":"), "value").alias("k"), F.col("attempt").alias("v"))
    extra = collided.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_set(entry)).alias("_tries"))
    extra = F.broadcast(extra) if small(collided, BROADCAST) else extra
    rows = docs.join(extra, F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")
    t = F.col(text)
    rows = rows.withColumn("_any", any_of(t))
    found, between = found_in(t, F.col("_any")), F.split(t, F.col("_any"), -1)

    def swap(x):
        return F.struct(F.when(x["ok"], replaced(x["kind"], x["v"], F.col("_tries"), secret)).otherwise(x["v"]).alias("v"), x["ok"].alias("ok"))

    rows = rows.withColumn("_found", found)
    told = F.transform("_found", lambda v: F.struct(v.alias("v"), entity_type(v).alias("kind")))
    told = F.transform(told, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), valid(x["kind"], x["v"]).alias("ok")))
    rows = rows.withColumn("_new", F.when(F.size("_found") > 0, F.transform(told, swap)))
    glued = F.array_join(F.flatten(F.zip_with(between, F.col("_new"), lambda b, n: F.array(F.coalesce(b, F.lit("")), F.coalesce(n["v"], F.lit(""))))), "")
    count = F.coalesce(F.size(F.filter("_new", lambda n: n["ok"])), F.lit(0))
    columns = [F.when(F.size("_found") > 0, glued).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, F.when(F.size("_found") > 0, count).otherwise(0).cast("bigint").alias("n_entities"))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of their entities."""
    return pseudonymise(read(spark, sf_dir, "documents"))
