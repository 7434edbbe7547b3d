"""Spellings of one entity, session keys, and surrogates against a plain version."""

import re

import pytest
import regex
from pyspark.sql import functions as F
from test_text import DOCS, table

from gridgrove.llm import pii

SPELLINGS = [
    ("Mr. Smith", "Mr Smith", "Mrs. Smith", "Mr. John Smith"),
    ("4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795"),
    ("a.b@mail.example.com", "A.B@Mail.example.com"),
    ("+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+1 988 555 2485"),
    ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"),
    ("Господин Иванов", "Госпожа Иванова"),
]


def last_word(text):
    return re.findall(r"\w+", text)[-1].removesuffix("а")


def test_spellings_share_a_surrogate(spark):
    texts = [f"see {v} there" for group in SPELLINGS for v in group]
    got = [r.text for r in pii.pseudonymise(table(spark, texts), "k").orderBy("doc_id").collect()]
    at = 0
    seen = set()
    for k, group in enumerate(SPELLINGS):
        made = [got[at + j][4:-6] for j in range(len(group))]
        at += len(group)
        plain = {last_word(m) for m in made} if k in (0, 5) else {re.sub(r"\W", "", m).lower()[-10:] for m in made}
        assert len(plain) == 1, made
        assert not plain & seen
        seen |= plain
        assert all(re.sub(r"\w", "", m) == re.sub(r"\w", "", v) for m, v in zip(made, group, strict=True) if "@" not in v), made
        assert not any(m == v for m, v in zip(made, group, strict=True))
    assert got[0].startswith("see Mr. ") and got[2].startswith("see Mrs. ") and len(got[3].split()) == 5


def test_key_of_the_session(spark):
    docs = table(spark, ["ssn 123-45-6789"])
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.pseudonymise(docs).first().text
    assert first == pii.pseudonymise(docs).first().text and len(spark.conf.get(pii.KEY_SETTING)) == 64
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.pseudonymise(docs).first().text == pii.pseudonymise(docs, "mine").first().text != first
    spark.conf.unset(pii.KEY_SETTING)


def test_used_up_surrogates_get_longer(spark, monkeypatch):
    """With one surrogate in all, later attempts' marks tell entities apart, and the loop ends."""
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: F.when(kind.isNotNull() & value.isNotNull(), F.lit("same")))
    values = spark.createDataFrame([("ssn", f"{k:09d}") for k in range(30)], "kind string, value string")
    got = pii.overrides(values, "k").collect()
    assert len(got) == 29 and len({r.other for r in got}) == 29 and {r.attempt for r in got} == {pii.LATE}


def plain_entities(text):
    """Entities by the fixed patterns, the first to begin first and then the longest right card or IBAN; a version in plain Python."""
    out, at = [], 0
    patterns = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}

    def right(kind, v):
        digits = [int(c) for c in v if c.isdigit()][::-1]
        if kind == "card":
            return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
        moved = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1

    while at < len(text):
        best = None
        for kind, p in patterns.items():
            if kind in ("card", "iban"):
                run, stop = (r"[0-9](?:[ -]?[0-9]){12,18}", r"[A-Za-z0-9]") if kind == "card" else (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Za-z0-9]")
                if at and re.match(r"[A-Za-z0-9]" if kind == "iban" else r"[A-Za-z0-9.]", text[at - 1]):
                    continue
                if kind == "card" and at > 1 and text[at - 1] == "-" and not text[at - 2].isdigit() or kind == "card" and at == 1 and text[0] == "-":
                    continue
                for end in range(min(len(text), at + 60), at + 12, -1):
                    v = text[at:end]
                    if re.fullmatch(run, v) and not re.match(stop, text[end : end + 1]) and not (kind == "card" and re.match(r"\.[0-9]", text[end : end + 2])) and right(kind, v):
                        best = (kind, v)
                        break
            elif m := p.match(text, pos=at):
                best = (kind, m[0])
            if best:
                break
        if best:
            out.append(best)
            at += len(best[1])
        else:
            at += 1
    return out


TEXTS = [
    "ssn 123-45-6789 2024 ok", "123-45-6789 988-555-2485", "IBAN ES9121000418450200051332 ALSO", "4111111111111111 123 and 12 4111111111111111", "Mr. Smith wrote x.y@z.example.com twice, x.y@z.example.com!",
    "10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "+1 (988) 555-2485 or (988) 555-2485", "nothing at all", "", None, "card 4111 1111 1111 1112", "Frau Müller-Weiß und Herr Groß", "a@b.co " * 3000,
]


def test_surrogates_are_where_a_plain_version_finds_entities(spark):
    docs = spark.createDataFrame([(k % 10, t, None, None, None) for k, t in enumerate(TEXTS)] + [(None, "ssn 123-45-6789", None, None, None)], DOCS).withColumn("n_entities", F.lit("clash")).withColumn("_found", F.lit("other")).drop("_found")
    got = {r.text: r for r in docs.select("text", F.col("doc_id").alias("d")).collect()}
    assert len(got) == len(TEXTS) + 1
    made = pii.pseudonymise(docs.withColumn("old", F.col("text")), "k").collect()
    assert len(made) == len(TEXTS) + 1
    for r in made:
        want = plain_entities(r.old or "")
        assert r.n_entities == len(want), (r.old, want)
        if r.old is None:
            assert r.text is None
            continue
        pattern = "".join(re.escape(piece) + ("(.+?)" if k < len(want) else "") for k, piece in enumerate(pieces_between(r.old, [v for _, v in want]))) if len(want) < 50 else None
        if pattern:
            m = re.fullmatch(pattern, r.text)
            assert m and not any(a == v for a, (_, v) in zip(m.groups(), want, strict=True)), (r.old, r.text)
        else:
            assert "a@b.co" not in r.text and r.text.count(".example") == len(want)


def pieces_between(text, values):
    out, at = [], 0
    for v in values:
        k = text.index(v, at)
        out.append(text[at:k])
        at = k + len(v)
    return [*out, text[at:]]


def test_op10_query(spark, tmp_path):
    table(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op10_pii(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities"] and got.count() == len(TEXTS)
    assert pii.op10_pii(spark, str(tmp_path)).where("n_entities > 0").count() == sum(bool(plain_entities(t or "")) for t in TEXTS)
    with pytest.raises(Exception):
        pii.pseudonymise(spark.range(1)).count()
