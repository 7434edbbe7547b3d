"""Card numbers and IBANs beside other groups of digits and letters."""

from gridgrove.llm import pii


def test_pii_beside_other_numbers(spark):
    card, iban = "4111111111111111", "BE68539007547034"
    texts = [f"{card} 123", f"12 {card}", f"1234 4111 1111 1111 1111 12", f"{card}-123", f"{iban} EUR", f"{iban} 1234 EUR now", "123-45-6789 1234", "4111111111111112 123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    for k, secret in enumerate([card, card, "4111 1111 1111 1111", card, iban, iban, "123-45-6789"]):
        assert got[k].n_entities == 1 and secret not in got[k].text, texts[k]
        assert got[k].text.startswith(texts[k].split(secret)[0]) and got[k].text.endswith(texts[k].split(secret)[-1])
    assert got[7].text == texts[7] and got[7].n_entities == 0
