import pytest
from pyspark.sql import functions as F

from lodestone.functions import designation as D
from lodestone.functions import text as X
from lodestone.functions import values as V

#: Spellings made from the grammar: prefix, number, then part and section, then the year, then a reaffirmation.
PREFIXES = [("IS", "IS"), ("is", "IS"), ("IS/IEC", "IS/IEC"), ("IS/ISO", "IS/ISO"), ("SP", "SP"), ("IS :", "IS")]
MIDDLES = [("", ""), (" (Part 4)", " (Part 4)"), (" (part 4 / Section 6)", " (Part 4 / Section 6)"), (" (Sec 6)", " (Section 6)"), (" Part 4", " (Part 4)"), ("-4", " (Part 4)"), (" - 4.6", " (Part 4 / Section 6)")]
YEARS = [("", ""), (":1987", ":1987"), (" : 1987", ":1987"), (" 1987", ":1987"), (":1987 (Reaffirmed 1999)", ":1987 (Reaffirmed 1999)"), (" : 1987 (Reaffirmation 1999)", ":1987 (Reaffirmed 1999)")]
ACCEPTED = [(f"{p} 8123{m}{y}", f"{q} 8123{n}{z}") for p, q in PREFIXES for m, n in MIDDLES for y, z in YEARS] + [("IS 8123-1987", "IS 8123:1987"), ("IS 8123 (1987)", "IS 8123:1987"), ("IS 8123-4 (Sec 6)", "IS 8123 (Part 4 / Section 6)")]
#: Two readings of one field that differ, numbers that aren't there, years that aren't, and other text.
REJECTED = ["IS 8123 (Part 4) 8123-4", "IS 8123-4-5-6", "IS 8123:1987 (1987)", "IS 8123-4 (Part 5)", "IS 8123:3021", "IS eight", "IS : B8123 - 1987", "no standard", "", "  "]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_designations(spark):
    assert column(spark, [a for a, _ in ACCEPTED], lambda c: D.render(D.parse(c))) == [b for _, b in ACCEPTED]
    assert column(spark, REJECTED, lambda c: D.parse(c).isNull()) == [True] * len(REJECTED)
    keys = column(spark, ["IS 8123-4-6 : 1987", "is 8123 (part 4 / section 6):1987"], lambda c: D.canonical(D.parse(c)))
    assert keys == ["IS|8123|4|6|1987|None"] * 2


def test_identifiers_and_yearless(spark):
    got = column(spark, ["gov.in.is.8123.1987", "gov.in.is.8123.4.6.1987", "gov.in.is.8123.4", "gov.in.is.1987", "com.other.1", "gov.in.is.", "gov.in.is.x.1987"], lambda c: D.render(D.of_identifier(c)))
    assert got == ["IS 8123:1987", "IS 8123 (Part 4 / Section 6):1987", "IS 8123 (Part 4)", "IS 1987", None, None, None]
    assert column(spark, ["IS|8123|4|None|1987|None", "IS 8123 (Part 4):1987", "Some  Text"], D.yearless) == ["is 8123 (part 4)", "is 8123 (part 4)", "some text"]


def test_find_all(spark):
    assert column(spark, ["see IS 8123:1987, IS 77 (Part 1) and IS 8123:1987; IS x", None], D.find_all) == [["IS 8123:1987", "IS 77 (Part 1)"], []]
    assert column(spark, ["IS 456:2000; IS 11:2011, IS 3:1972 (Reaffirmed 2002)", "IS 90"], D.find_all) == [["IS 456:2000", "IS 11:2011", "IS 3:1972 (Reaffirmed 2002)"], ["IS 90"]]
    assert column(spark, ["IS 12:1990 IS  7 (Part 3):2001, this 4:1999, IS 5:20", None], D.scrape) == [["IS 12:1990", "IS 7:2001"], []]


@pytest.mark.parametrize("text, want", [("Les Éléments of steels", ["les", "element", "steel"]), ("SP/ISO 9-2 gas", ["sp/iso", "9-2", "gas"]), (None, []), ("...", [])])
def test_tokens(spark, text, want):
    assert column(spark, [text], X.tokenize) == [want]


def test_chunks_bigrams_keywords(spark):
    words = " ".join(f"w{i}" for i in range(170))
    got = column(spark, [words, "", None], lambda c: X.chunks(X.words(c)))
    assert [len(c.split()) for c in got[0]] == [100, 90, 10] and got[1:] == [[], []]
    assert column(spark, ["a", None], lambda c: X.bigrams(F.array(c, c)))[0] == ["a_a"]
    assert column(spark, ["Method of test for (pumps), cement"], X.record_keywords) == [["cement", "pumps", "test"]]


def test_values(spark):
    assert column(spark, ["NaN", " x ", None, "null"], V.as_text) == ["", "x", "", ""]
    assert column(spark, ["2009.0", "x", None], V.as_int) == [2009, None, None]
    assert column(spark, ["Yes", "withdrawn", "?"], V.as_bool) == [True, False, True]
