"""Texts that once broke a contract: very long entities, letters that normalization splits, numbers that are no letters."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import langid, packing, surrogates, toxicity
from fathomline.llm.queries import vocabulary_path

KEY = surrogates.SurrogateParams("a key of these tests")
N = 100_000
LONG = {
    "name": "Mr. " + "Abc " * N, "given": "Mary " + "Smith-" * N + "Smith", "particles": "Dr. " + "von " * N + "Abc", "initials": "Dr. " + "J. " * N + "Smith",
    "phone": "+1" + " 23" * N, "brackets": "+1" + "(23)" * N, "local": "0123 456" + " 78" * N, "digits": "9" * N,
    "domain": "a@" + "b." * N + "com", "labels": "a@" + "bc." * N + "9", "letters": "a" * N + "@b.com", "astral": "a@b." + "x\U00010400" * N, "no_domain": "a@" * N,
    "secret": "0a" * N, "key": "sk_live_" + "Ab1" * N, "token": "eyJ" + "a" * N + "." + "b" * N + "." + "c" * N, "card": "4111 1111 " * N, "iban": "DE89 " + "3704 " * N, "ip": "10.0.0." * N, "ipv6": "a:" * N,
}


def test_no_length_exhausts_the_matcher(spark):
    rows = [(i, f"see {text} end") for i, text in enumerate(LONG.values())]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), KEY).collect()}
    assert len(got) == len(rows)
    for i, (kind, before) in enumerate(LONG.items()):
        after = got[i].text
        if kind in ("name", "given", "phone", "brackets", "local", "digits", "domain", "letters", "secret", "key", "token"):
            assert after != f"see {before} end" and after.startswith("see ") and after.endswith(" end"), kind
        if kind not in ("given", "name"):
            assert len(after) == len(before) + 8, kind


def test_an_address_keeps_its_public_suffix_alone(spark):
    rows = [(1, "to jane@janedoe.org now"), (2, "to j.d@mail.jane.co.uk now"), (3, "to jane@janedoe.org and x@y.b.com.123 ok")]
    got = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert re.fullmatch(r"to [a-z]{4}@[a-z]{7}\.org now", got[1]) and "jane" not in got[1]
    assert re.fullmatch(r"to [a-z]\.[a-z]@[a-z]{4}\.[a-z]{4}\.co\.uk now", got[2]) and "jane" not in got[2]
    assert got[3].split()[1] == got[1].split()[1] and got[3].endswith(".com.123 ok") and "x@y.b" not in got[3]


def test_listed_given_names_do_not_stay(spark):
    rows = [(1, "Dr. Mary Smith came. Or Mary Smith, or Smith, or MARY SMITH."), (2, "Then John Miller and Anna von Berg met. Miller left."), (3, "mary smith and the mark"), (4, "Иван Петров пришёл")]
    got = {r.doc_id: r.text for r in surrogates.replace_checked(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, names in ((1, "Mary Smith MARY SMITH"), (2, "John Miller Anna Berg"), (4, "Иван Петров")):
        assert not [n for n in names.split() if re.search(rf"\b{n}\b", got[i])], got[i]
    a = re.fullmatch(r"Dr\. (\w+) (\w+) came\. Or (\w+) (\w+), or (\w+), or (\w+) (\w+)\.", got[1]).groups()
    assert a[0] == a[2] and a[1] == a[3] == a[4] and (a[5], a[6]) == (a[0].upper(), a[1].upper()) and a[0].lower() in surrogates.GIVEN_NAMES[1]
    b = re.fullmatch(r"Then (\w+) (\w+) and (\w+) von (\w+) met\. (\w+) left\.", got[2]).groups()
    assert b[1] == b[4] and b[0].lower() in surrogates.GIVEN_NAMES[0] and b[2].lower() in surrogates.GIVEN_NAMES[1]
    assert got[3] == rows[2][1]


@pytest.mark.parametrize("shape", ["a{}, x", "{}."])
def test_ids_of_every_sign_are_those_of_the_library(shape):
    encoder = packing.Encoder(packing.PackParams(tokenizer=vocabulary_path("word_bpe_49k.json")))
    assert encoder.by_chunk
    signs = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 20_000):
        texts = [shape.format(c) for c in signs[at : at + 20_000]]
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        for text, ids, (raw, _) in zip(texts, want, encoder.encode(pa.array(texts))):
            assert np.frombuffer(raw[:-2], dtype=encoder.kind).tolist() == ids.ids, ascii(text)


def test_numbers_and_marks_are_no_letters(spark):
    ranked = langid.fit(spark.createDataFrame([("some words here", "en"), ("einige worte hier", "de")], "text string, lang string"))
    rows = [(1, "½ ² ①"), (2, "Ⅳ ⅷ"), (3, "́ ̀"), (4, "१२ 12 _"), (5, "ª"), (6, "x½"), (7, "ʰ"), (8, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), ranked).collect()}
    assert [got[i].lang_pred == "und" and got[i].score == 0 for i in range(1, 9)] == [True, True, True, True, False, False, False, True]
    assert toxicity.windows("a½b Ⅳ") == ["a", "b"]
