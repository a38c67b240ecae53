"""Golden cells for the parsers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricewright.functions import parse, style, units


def read(spark, expression, *cells):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("t"))).collect()]


def test_numbers(spark):
    cells = ("$1,299.00", "20 hrs", "IPX4", "20-24 h", "95%", "n/a", None, "-5.5 C", "100-200", "5 to 7 mm", "-10 to -5")
    assert read(spark, parse.number, *cells) == [1299.0, 20.0, 4.0, 22.0, 95.0, None, None, -5.5, 150.0, 6.0, -7.5]


def test_numbers_in_compatibility_forms(spark):
    cells = ("１２,５００.５ kg", "x²", "1\u00a0299 €", "③ Stück", "٣")
    assert read(spark, parse.number, *cells) == [12500.5, 2.0, 1299.0, 3.0, None]


def test_letters_without_marks(spark):
    assert read(spark, parse.unaccented, "Größe  ÉTÉ", "e\u0301te\u0301", "Ａｂ", None) == ["große ete", "ete", "ab", None]


def test_words_that_are_no_units_stay_unknown(spark):
    words = units.lexicon()
    assert "kilogram" not in words["mass_g"][1] and "megavolt" not in words["voltage_v"][1]
    assert read(spark, lambda t: parse.converted(t, "mass_g"), "2 kilogram", "3 kilogramm") == [[], [3000.0]]


def test_european_numbers(spark):
    cells = ("20.000", "1,5", "1.234,5", "1.2", "", "1.234.567", "x")
    assert read(spark, parse.european_number, *cells) == [20000.0, 1.5, 1234.5, 1.2, None, 1234567.0, None]


def test_canonical(spark):
    cells = ("BLUETOOTH  5.0", "bluetooth 5.0 ", " - ", "Straße;", "ｆｕｌｌ", None)
    assert read(spark, parse.canonical, *cells) == ["bluetooth 5.0", "bluetooth 5.0", None, "strasse", "full", None]


def test_units(spark):
    got = read(spark, lambda t: parse.converted(t, "mass_g"), "2 kg", "1,5 kg and 3 lb", "5 m", "")
    assert got == [[2000.0], [1500.0, 3 * 453.592], [], []]
    assert read(spark, lambda t: parse.converted(t, "time_h"), "30 min")[0] == [0.5]
    assert read(spark, lambda t: parse.converted(t, "power_w"), "1.5 kW")[0] == [1500.0]


def test_neighbouring_numbers_stay_apart(spark):
    got = read(spark, parse.pairs, "70 20000 hz")[0]
    assert [(p["value"], p["unit"]) for p in got] == [(70.0, ""), (20000.0, "hz")]


def test_triples(spark):
    got = read(spark, parse.triple_mm, "10 x 20 x 30 mm", "1x2x3", "nothing")
    assert got == [[10.0, 20.0, 30.0], [10.0, 20.0, 30.0], None]
    cells = ("10 cm x 20mm X 3 m", "12,5 × 8 × 4 cm", "30 l x 20 b x 10 h cm", "1*2*4 inch", "40 x 30", "Maße: 1.5x2x3 unknown", "5 kg", None)
    assert read(spark, parse.triple_mm, *cells) == [
        [100.0, 20.0, 3000.0], [125.0, 80.0, 40.0], [300.0, 200.0, 100.0], [25.4, 50.8, 101.6], None, [15.0, 20.0, 30.0], None, None,
    ]
    assert read(spark, lambda t: parse.sides_mm(t, 2), "40 x 30", "7", "4x5x6 mm") == [[400.0, 300.0], None, [4.0, 5.0, 6.0]]


def test_flags_and_colours(spark):
    assert read(spark, parse.flag, "oui", "nein", "IPX7", "maybe", None) == [True, False, True, None, None]
    assert read(spark, parse.colour, "Noir mat", "grün", "Dunkelgrau", "") == ["black", "green", None, None]


@pytest.mark.parametrize(("header", "name"), [("ttf_Marque", "brand"), ("btf_Weight (in g):", "weight"), ("Couleur", "color"),
     ("ttf_Modèle", "model name"), ("Plug-in  type .", "plug-in type"), ("Size (a (b) c) of_box", "size of box"), ("Weight (g", "weight"), ("ttf", "ttf"), ("", "")])
def test_concepts(header, name):
    assert parse.concept(header) == name


def test_concepts_by_rules_of_a_catalogue():
    own = parse.Naming(sources=("src",), synonyms={"vikt": "weight"})
    assert own.concept("src_Vikt (g)") == "weight" and own.concept("ttf_Marque") == "ttf marque"


def test_lexicon_has_every_dimension_once():
    words = units.lexicon()
    assert len(words) == 16
    assert words["power_w"][1]["kilowatt"] == 1000 and words["count"][1][""] == 1


def test_style_of_blank_text_is_zero(spark):
    frame = spark.createDataFrame([("",), ("Hi! Hi there, WORLD.",)], "t string")
    found = style.features(F.col("t"))
    blank, text = frame.select(*[v.alias(k) for k, v in found.items()]).collect()
    assert set(blank) == {0.0}
    assert text["hapax_ratio"] == 5 / 6 and text["exclamation_ratio"] == 0.5 and text["uppercase_ratio"] == 1 / 7


def test_languages(spark):
    texts = ("the cat is on the mat", "le chat est sur la table", "der Hund ist in dem Haus", "el gato es de la casa", "il gatto non si trova nel giardino anche", "o gato foi para a casa dos pais", "de kat is niet op het dak van een huis", "xyz", None)
    assert read(spark, style.language, *texts) == ["en", "fr", "de", "es", "it", "pt", "nl", "en", "en"]


def test_word_classes_and_requests(spark):
    words = lambda t: style.tagged(style.tokens(t))
    assert read(spark, words, "The 3 very useful lamps quickly heated it , and", "")[0] == [
        "determiner", "numeral", "adverb", "adjective", "noun", "adverb", "verb", "pronoun", "mark", "conjunction",
    ]
    assert read(spark, style.imperative_ratio, "Buy it now and keep it. It is good, see more! We buy lamps.", "", None) == [1.0, 0.0, 0.0]
    degrees = lambda t: style.tag_ratios(style.tokens(t))["comparative_superlative"]
    assert read(spark, degrees, "brighter and cheapest other number", "")[:2] == [0.4, 0.0]


def test_style_of_hand_counted_texts(spark):
    from pricewright.functions import style

    texts = ["Use the small lamp, and click it. The lamp is BIG! Is it quickly?", "", None, "12 lamps... 12"]
    text = F.col("text")
    found = style.features(text) | {f"{k}_ratio": v for k, v in style.tag_ratios(style.tokens(text)).items()} | {"imperative_ratio": style.imperative_ratio(text)}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", *[v.alias(k) for k, v in found.items()])
    first, empty, null, last = (r.asDict() for r in rows.orderBy("i").collect())
    assert sorted(style.NAMES) == sorted(found)
    for text, row in zip(texts, (first, empty, null, last), strict=True):
        at_once = dict(zip(style.NAMES, style.style_of(text or "")[1], strict=True))
        assert at_once == pytest.approx({k: v for k, v in row.items() if k != "i"})
    # use the small lamp , and click it . | the lamp is big ! | is it quickly ?
    expected = {
        "avg_sentence_length": 18 / 3, "max_sentence_length": 9.0, "type_token_ratio": 16 / 18, "uppercase_ratio": 1 / 18, "capitalized_ratio": 3 / 18,
        "determiner_ratio": 2 / 18, "pronoun_ratio": 2 / 18, "conjunction_ratio": 1 / 18, "verb_ratio": 2 / 18, "adverb_ratio": 1 / 18,
        "adjective_ratio": 2 / 18, "noun_ratio": 4 / 18, "imperative_ratio": 2 / 3, "exclamation_ratio": 1 / 3, "question_ratio": 1 / 3, "comma_ratio": 1 / 3,
    }
    for name, value in expected.items():
        assert abs(first[name] - value) < 1e-9, name
    assert all(v == 0 for k, v in empty.items() if k != "i") and all(v == 0 for k, v in null.items() if k != "i")
    assert last["numeral_ratio"] == 2 / 6 and last["digit_token_ratio"] == 2 / 6 and last["hapax_ratio"] == 1 / 3
