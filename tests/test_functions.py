"""Normalisation, similarity, identifiers and classification, on cases that once went wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeloom.functions import classify, identifiers, similarity, text


def overlap(a, b):
    return bool(text.family_keys(a) & text.family_keys(b))


def test_names():
    assert text.family_key("Straße") == "strasse"
    assert overlap("Rußwurm", "Russwurm") and overlap("Müller", "Mueller") and overlap("Müller", "Muller")
    assert overlap("Carlos Riquelme Ruiz", "Riquelme, Carlos") and not overlap("Thomas Brox", "Kingma, D.")
    assert overlap(r"Gon{\c{c}}alves", "Gonçalves") and overlap(r'H{\"a}nsch', "Hänsch")
    assert text.family_key("van der Berg") == text.family_key("van der Berg, Jan") == "berg"
    assert text.family_keys("Armando Solar-Lezama") >= {"solar lezama", "solarlezama", "lezama"}
    assert text.family_keys("") == text.family_keys("X") == set()


def test_titles():
    assert text.norm_text("&lt;title&gt;Cloud detection&lt;/title&gt;") == text.norm_text("Cloud  detection") == "cloud detection"
    ratio = lambda a, b: round(similarity.ratio(text.norm_text(a), text.norm_text(b)), 4)
    squash = lambda t: text.norm_text(t).replace(" ", "")
    cov = lambda a, b: round(similarity.coverage(squash(a), squash(b)), 4)
    a, b = "Efficient graph-based image segmentation", "Graph based image segmentation"
    assert (ratio(a, b), cov(a, b), cov(b, a)) == (0.8571, 0.75, 1.0)
    a, b = "Attention is all you need", "Is Attention All You Need?"
    assert (ratio(a, b), cov(a, b), cov(b, a)) == (0.88, 0.9048, 0.9048)
    a, b = "Decoupled Weight Decay Regularization", "Fixing Weight Decay Regularization in Adam"
    assert (ratio(a, b), cov(a, b), cov(b, a)) == (0.7089, 0.7353, 0.6757)
    assert similarity.coverage("", "x") == 0.0


TITLES = ["Plain ASCII: a {T}itle", "Müller & Söhne", r"Gon{\c{c}}alves", "<b>x</b> a<b", "Тест", "", "ſpecial ﬁ ligature", None, "A -- b's 12%"]


def test_columns_equal_functions(spark):
    df = spark.createDataFrame([(t, o) for t in TITLES for o in TITLES[:3]], "t string, o string")
    n, m = text.norm_col(F.col("t")), text.norm_col(F.col("o"))
    q, r = text.squash_col(n), text.squash_col(m)
    got = df.select("t", "o", n.alias("n"), similarity.ratio_col(n, m).alias("r"), similarity.coverage_col(q, r).alias("c"), text.strip_accents_col(F.col("t")).alias("s"), text.expand_diacritics_col(F.col("t")).alias("e"), text.delatex_col(F.col("t")).alias("d"), text.family_key_col(F.col("t")).alias("k"))
    for x in got.collect():
        if x.t is None:
            assert x.n is None
            continue
        a, b = text.norm_text(x.t), text.norm_text(x.o)
        assert x.n == a and x.r == pytest.approx(1.0 if a == b else similarity.ratio(a, b))
        assert x.c == pytest.approx(similarity.coverage(a.replace(" ", ""), b.replace(" ", "")))
        assert (x.s, x.e, x.d, x.k) == (text.strip_accents(x.t), text.expand_diacritics(x.t), text.delatex(x.t), text.family_key(x.t))


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "fields,want",
    [
        ({"eprint": "1711.05101", "archiveprefix": "arXiv"}, "1711.05101"),
        ({"note": "arXiv:2005.14165v4"}, "2005.14165"),
        ({"doi": "10.48550/arXiv.2103.00020"}, "2103.00020"),
        ({"journal": "CoRR", "volume": "abs/1810.04805"}, "1810.04805"),
        ({"eprint": "cs/0701001"}, "cs/0701001"),
        ({"journal": "arXiv preprint arXiv:1505.04597"}, "1505.04597"),
        ({"eprint": "1711.05101v2"}, "1711.05101"),
        ({"eprint": "123", "archiveprefix": "pubmed"}, None),
        ({"journal": "Nature"}, None),
        ({"journal": "arXiv preprint arXiv:1505.104597"}, "1505.104597"),
        ({"volume": "abs/1810.104805v3"}, "1810.104805"),
    ],
)
def test_arxiv_ids(spark, fields, want):
    assert column(spark, fields, identifiers.field_arxiv, "map<string,string>") == want


def test_identifiers(spark):
    assert column(spark, r"10.1162/tacl\_a\_00276", identifiers.unescape_identifier) == "10.1162/tacl_a_00276"
    assert column(spark, "doi:10.1109/ABC.2 and https://doi.org/10.1109/ABC.2017.27, x", identifiers.printed_doi) == "10.1109/ABC.2017.27"
    assert column(spark, "none", identifiers.printed_doi) is None
    assert column(spark, "see arXiv:2301.00001v2.", identifiers.printed_arxiv) == "2301.00001"
    assert column(spark, "1949 1950 in 2049a 2050 (2017)", identifiers.years) == ["1950", "2017"]
    assert column(spark, "Smith, J. and others", identifiers.authors) == ["Smith, J."]
    assert column(spark, "A  and\nothers", identifiers.and_others) is True
    assert column(spark, {"doi": " "}, identifiers.has_identifier, "map<string,string>") is False


def test_kinds(spark):
    assert column(spark, "Anonymous. A title. Under review.", classify.is_anonymized)
    paper = "Ronneberger, O., Fischer, P., Brox, T.: U-Net: convolutional networks. In: MICCAI (2015)"
    assert column(spark, "ESA: Sentinel-2 technical report, 2015", classify.is_grey) and not column(spark, paper, classify.is_grey)
    assert column(spark, "National Mapping Agency: maps of the land", classify.is_grey)
    assert column(spark, "X. See https://example.org/a", classify.is_grey) and not column(spark, "Şimşek, F.: x. https://doi.org/10.1000/1", classify.is_grey)
    assert column(spark, paper, classify.guess_title_col) == "U-Net: convolutional networks"
    assert column(spark, "Olaf Ronneberger, Philipp Fischer, and Thomas Brox. A title of a certain length. In MICCAI, 2015.", classify.guess_title_col) == "A title of a certain length"
    plausible = lambda c, d: spark.range(1).select(classify.type_is_plausible(F.lit(c), F.lit(d)).alias("r")).first().r
    assert [plausible(*x) for x in [("dissertation", "x"), ("book-chapter", "x"), ("proceedings-article", "x"), ("dissertation", "phd thesis"), (None, "x")]] == [False, False, True, True, True]


def test_ratios_below_a_bound_are_nought(spark):
    """Characters alone rule out most pairs; those at the bound and above keep their ratio."""
    import random

    import pandas as pd

    from citeloom.functions.similarity import _ratios, ratio

    rng = random.Random(2)
    pairs = [("".join(rng.choices("abc é", k=rng.randrange(0, 12))), "".join(rng.choices("abc ü", k=rng.randrange(0, 12)))) for _ in range(3000)]
    a, b = (pd.Series(x) for x in zip(*pairs, strict=True))
    want = [ratio(*p) for p in pairs]
    assert list(_ratios(a, b, 0.0)) == want
    assert [r if r >= 0.85 else 0 for r in _ratios(a, b, 0.85)] == [r if r >= 0.85 else 0 for r in want]
    assert pd.isna(_ratios(pd.Series([None, "a"]), pd.Series(["a", "a"]), 0.85)).tolist() == [True, False]


def test_norms_of_letters_are_one_function(spark):
    """Each character alone and between letters, in the JVM or in Python, is what norm_text makes of it; Latin letters need no Python."""
    from citeloom.functions import text

    rows = [f"{c}|a{c}B {c}{c}" for c in map(chr, [*range(1, 0x2100), 0xFF21, 0x1F600]) if not 0xD800 <= ord(c) < 0xE000] + ["é\u0301x", "İstanbul – ÆØß ŉ", "&eacute; <b>é</b>", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.norm_col(F.col("t")).alias("n")).collect()
    assert [r.t for r in got if r.n != (None if r.t is None else text.norm_text(r.t))] == []
    assert {text._ONE[c] for c in "éüÅşñ"} == set("euasn") and text._MANY["ß"] == "ss"


def test_decoders_are_spread_over_cores(spark):
    """A table of one file is decoded in more than one task."""
    from citeloom.plans import queries

    for name in ("d2_arxiv_atom", "d5_display"):
        assert queries.Q[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
