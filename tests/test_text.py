"""Text functions, stemmer, URLs and search operators."""

from __future__ import annotations

import pytest
from gleaner.functions import text, urls
from gleaner.functions.stem import stem, stemmed
from gleaner.operators import quality
from pyspark.sql import functions as F


def one(spark, expression, value, kind: str = "string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("given, want", [
    ("What? Really! Yes.", ["What?", "Really!", "Yes."]),
    ("Dr. Smith of Acme Inc. Came here. every day.", ["Dr. Smith of Acme Inc. Came here. every day."]),
    ("One. Two. three. Four", ["One.", "Two. three.", "Four"]),
    ("Casino. No. Way", ["Casino.", "No. Way"]),
    ("A. B. C", ["A.", "B.", "C"]),
    ("Ends. École stays. 5 too", ["Ends. École stays. 5 too"]),
    ("  spaced \n out.\tNext ", ["spaced out.", "Next"]),
    ("e.g. The end. Mr. Dr. X", ["e.g.", "The end.", "Mr. Dr. X"]),
    ("", []),
])
def test_sentences(spark, given, want):
    assert one(spark, text.sentences, given) == want


@pytest.mark.parametrize("given, want", [
    ("useState hook", ["use", "state", "hook"]),
    ("parseHTMLDocument XMLHttp", ["parse", "html", "document", "xml", "http"]),
    ("The is of a", []),
    ("x yz 12 é déjà-vu", ["yz", "12", "déjà", "vu"]),
    ("state state", ["state", "state"]),
    ("a b😀cd 😀😀", ["cd"]),
    ("", []),
])
def test_tokens(spark, given, want):
    assert one(spark, text.tokens, given) == want


def test_lengths_are_utf16(spark):
    assert one(spark, text.utf16_length, "a😀") == 3 and one(spark, text.utf16_length, "né") == 2


def test_trim_covers_wide_spaces(spark):
    assert one(spark, text.trim, " \t x y\n　") == "x y"


def test_clean_code(spark):
    assert one(spark, text.clean_code, "x = 1 Copy") == "x = 1"
    assert one(spark, text.clean_code, "dryRun") == "dry"
    assert one(spark, text.clean_code, "y Open in playground") == "y"
    assert one(spark, text.clean_code, "z View on GitHub") == "z"


def test_set_measures(spark):
    row = spark.createDataFrame([(["a", "a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    got = row.select(text.jaccard(F.col("a"), F.col("b")), text.overlap(F.col("a"), F.col("b")), text.overlap(F.col("e"), F.col("b")), text.jaccard(F.col("e"), F.col("e")), text.term_counts(F.col("a"))).first()
    assert got[:4] == (1 / 3, 1 / 3, 0.0, 0.0) and got[4] == {"a": 2, "b": 1}


def test_title(spark):
    assert one(spark, text.title, "<html><TITLE lang=x> A &amp; B </title><title>no</title>") == "A &amp; B"
    assert one(spark, text.title, "<p>none") == ""


# from the published description of the algorithm
STEMS = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled", motoring="motor", sing="sing",
    conflated="conflat", troubled="troubl", sized="size", hopping="hop", tanned="tan", falling="fall", hissing="hiss", fizzed="fizz", failing="fail", filing="file",
    happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration", valenci="valenc", digitizer="digit", operator="oper", feudalism="feudal",
    decisiveness="decis", hopefulness="hope", callousness="callous", formaliti="formal", sensitiviti="sensit", sensibiliti="sensibl", triplicate="triplic",
    formative="form", formalize="formal", electriciti="electr", electrical="electr", hopeful="hope", goodness="good", revival="reviv", allowance="allow", inference="infer",
    airliner="airlin", adjustable="adjust", defensible="defens", irritant="irrit", replacement="replac", adjustment="adjust", dependent="depend", adoption="adopt",
    communism="commun", activate="activ", angulariti="angular", homologous="homolog", effective="effect", bowdlerize="bowdler", probate="probat", rate="rate", cease="ceas",
    controll="control", roll="roll", use="us", yes="ye", by="by",
)


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    words = list(STEMS)
    assert spark.createDataFrame([(words,)], "w array<string>").select(stemmed(F.col("w"))).first()[0] == list(STEMS.values())


@pytest.mark.parametrize("url, host, path", [
    ("http://A.com", "a.com", "/"), ("https://a.com/x/y?q#f", "a.com", "/x/y"), ("http://a.com:80/", "a.com", "/"), ("not a url", None, None), ("http://a.com/a b", "a.com", "/a%20b"),
])
def test_url_parts(spark, url, host, path):
    assert one(spark, lambda u: F.struct(urls.host(u), urls.path(u)), url) == (host, path)


@pytest.mark.parametrize("url, want", [
    ("https://medium.com/x", True), ("https://blog.medium.com/x", True), ("https://notmedium.com/x", False), ("https://github.com/u/r", True), ("https://github.com/u/r/", True),
    ("https://www.github.com/u/r/issues", False), ("https://github.com/u", False), ("nonsense", False),
])
def test_blocked(spark, url, want):
    assert one(spark, urls.is_blocked, url) is want


@pytest.mark.parametrize("url, want", [
    ("https://v3.tailwind.com/docs", "tailwind.com/docs"), ("https://docs.x.org/en/latest/a", "x.org/a"), ("https://go.dev/doc", "dev/doc"), ("https://x.org/v1/v2/x", "x.org/v2/x"),
    ("https://x.org/4.3/a?b#c", "x.org/a"), ("https://www.x.org//a", "www.x.org/a"), ("en-us.x.org", "en-us.x.org"), ("https://pt-br.x.org/a", "x.org/a"),
])
def test_dedup_key(spark, url, want):
    assert one(spark, urls.dedup_key, url) == want


@pytest.mark.parametrize("given, want", [
    ("react hooks", "react hooks"), ("site:react.dev hooks", "hooks"), ("site:a.com OR site:b.com hooks", "hooks"), ('"exact phrase" more', "exact phrase more"),
    ("hooks -class -old", "hooks"), ("-first word", "word"), ("well-known thing", "well-known thing"), ("filetype:pdf guide", "guide"), ("cats OR dogs", "cats OR dogs"), ("site:x.y", ""),
])
def test_operators(spark, given, want):
    assert one(spark, urls.without_operators, given) == want


def test_short_and_key(spark):
    assert one(spark, urls.short, "https://www.a.com/" + "x" * 50) == "a.com/" + "x" * 36 + "..."
    assert one(spark, lambda u: urls.session_key(u, F.array(*map(F.lit, "bab"))), "u") == "u:a,b"


@pytest.mark.parametrize("sentence, want", [
    ("^ a b Smith, J.", True), ("Retrieved 14 August 2025.", True), ("The data was retrieved March 3, 2020 from it and more of it is there.", True), ("doi:10.1000/182 is a long identifier that is cited here", True),
    ("[12] Smith and others", True), ("example.com.", True), ("Hello World.", True), ("React.", True), ("It works. 3 March 2020", True), ("It is a plain sentence about hooks.", False), ("hello world.", False),
    ("Archived from the original on a day long past, and kept for all readers.", True),
])
def test_citations(spark, sentence, want):
    assert one(spark, quality.is_citation, sentence) is want


@pytest.mark.parametrize("sizes, reason", [
    ([60, 60, 60, 25, 25], None), ([60, 60, 60, 25], "Too few sentences (4 < 5)"), ([60, 60, 25, 25, 25], "Too few long sentences (2 < 3)"),
    ([60] * 3 + [5] * 7, "Too many fragments (70% > 65%)"), ([60] * 7 + [25] * 6 + [5] * 7, None), ([51] * 3 + [24] * 4 + [30] * 1, None), ([51] * 7 + [20] * 13, None),
])
def test_quality(spark, sizes, reason):
    rows = spark.createDataFrame([(1, "x" * n) for n in sizes], "page_id long, text string")
    got = quality.page_quality(rows).first()
    if reason is None and got["median_length"] < 25:
        reason = f"Median sentence too short ({got['median_length']:.0f} < 25)"
    assert got["reject_reason"] == reason and got["passes"] == (reason is None)


def test_sentences_keep_any_symbol(spark):
    held = "One\x02two. Three\x02 four. Mr. Ten \x02. Dr. \x02Five. End."
    got = spark.createDataFrame([(held,)], "t string").select(text.sentences(F.col("t")).alias("s")).first()["s"]
    assert got == ["One\x02two.", "Three\x02 four.", "Mr. Ten \x02.", "Dr. \x02Five.", "End."]
