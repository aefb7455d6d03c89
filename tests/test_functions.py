"""Golden cases of column functions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from phosfold.functions import accessions as A
from phosfold.functions import peptides as P
from phosfold.functions import stats


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_peptides(spark):
    seq = lit("ZZZZABCDEFGZZZABCDEFGHIZZ")
    got = one(
        spark,
        P.expansions(lit("aBCDeF")), P.expansions(lit("ABC")), P.occurrences(lit("ABCDEFGABCDHIJK"), lit("BCD")), P.occurrences(lit(""), lit("A")),
        P.site_number(seq, lit("AbCdEfG")), P.site_number(seq, lit("AbCdEfG"), types="df"), P.site_number(seq, lit("AbCdEfG"), lit("D23")), P.site_number(seq, lit("AbCdEfG"), lit("X50")),
    )
    assert got == (["aBCDEF", "ABCDeF"], [], [2, 9], [], "B6", "D8", "D18", None)


def test_alignment(spark):
    seq = lit("ABCDEFGHI")
    got = one(spark, P.aligned_peptide(seq, lit("E5"), 4), P.aligned_peptide(seq, lit("B2"), 4), P.aligned_peptide(seq, lit("Y5")), P.valid_site(seq, lit("I9")), P.valid_site(seq, lit("I10")), P.valid_site(seq, lit("junk")), P.valid_site(lit(None), lit("A1")))
    assert got == ("ABCDeFGHI", "AbCDEF", None, True, False, False, False)


def test_formats(spark):
    got = one(
        spark,
        P.from_annotation(lit("K.AS*DY*K.R")), P.from_annotation(lit("A*SDK"), before=True), P.from_p_prefix(lit("AApSGGmKpY")), P.from_centre(lit("AAAYAAA")), P.from_centre(lit("ABCD")), P.from_centre(lit("")),
        P.from_probability(lit("AAS(0.98)GT(0.02)K")), P.from_unimod(lit("AS(UniMod_21)C(UniMod_4)K")), P.only_phospho(lit("AmKsT")), P.acceptable(lit("AsK")), P.acceptable(lit("AmK")), P.is_number(lit(" 1e3 ")), P.is_number(lit("x")),
    )
    assert got == ("AsDyK", "AsDK", "AAsGGKy", "AAAyAAA", "AbCD", "", "AAsGTK", "AsCK", "AMKsT", True, False, True, False)


def test_detection(spark):
    cases = {
        "AApSK": ("lowercase_p", "AAsK"), "AS(UniMod_21)K": ("unimod", "AsK"), "AS(0.9)K": ("maxquant_perc", "AsK"), "A(x)K": ("unrecognized", None), "AS*K": ("annotated", "AsK"), "A-1": ("unrecognized", None),
        "AsK": ("acceptable", "AsK"), "AmK": ("unrecognized", None), "AmKsT": ("acceptable", "AMKsT"), "AAA": ("uppercase", "AAA"), "AS(2)K": ("unrecognized", None), "AS(0.9)K(x)": ("unrecognized", None),
        "AS(ph)K": ("annotated", "AsK"), "AS(Phospho)K": ("annotated", "AsK"), "A[ph]SK": ("annotated", "AsK"), "[Phospho]YAK": ("annotated", "yAK"), "AKT[ph]": ("annotated", "AKt"), "K.AT#DY#K.R": ("annotated", "AtDyK"), "^SAK": ("annotated", "sAK"),
        "AS*T#K": ("annotated", None), "AA*K": ("annotated", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", P.peptide_format(F.col("p")).alias("f"), P.formatted(F.col("p")).alias("g")).collect()
    assert {r.p: (r.f, r.g) for r in rows} == cases
    frame = spark.createDataFrame([("AsK",), ("A-1",), ("A-2",)], "p string")
    assert P.column_format(frame, "p") == "unrecognized" and P.column_format(frame.union(frame.where("p = 'AsK'")).union(frame.where("p = 'AsK'")), "p") == "acceptable"
    frame = spark.createDataFrame([("AAAYAAA",), ("CCCSCCC",)], "p string")
    assert P.column_format(frame, "p") == "centered"
    assert [r.p for r in P.autoformat(frame, "p").collect()] == ["AAAyAAA", "CCCsCCC"]
    with pytest.raises(ValueError):
        P.autoformat(spark.createDataFrame([("A-1",)], "p string"), "p")


def test_accessions(spark):
    got = one(spark, A.strip_isoform(lit("P12345-2")), A.strip_isoform(lit("P12345")), A.first_part(lit("A-1-2")), A.first_parts(lit("Q2-1;Q1;Q2-2")), A.is_accession(lit("A0A024R1X5")), A.is_accession(lit("TP53")))
    assert got == ("P12345", "P12345", "A", "Q1;Q2", True, False)
    rows = spark.createDataFrame([("a;b",), ("c",), ("d;e",)], "x string")
    assert A.separator(rows, "x") == ";"
    assert A.separator(spark.createDataFrame([("a",)], "x string"), "x") is None
    ids = spark.createDataFrame([("a", "P2"), ("b", "P1"), ("a", "P1")], "from_id string, accession string")
    assert {r.x: r.accession for r in A.convert(rows, "x", ids).collect()} == {"a;b": "P1;P2", "c": None, "d;e": None}


def test_accession_kinds(spark):
    kinds = {
        "P12345": "UniProtKB", "P12345-2": "UniProtKB", "A0A024R1X5": "UniProtKB", "P53_HUMAN": "UniProtKB_AC-ID", "ENSG_HUMAN": "UniProtKB_AC-ID", "UPI_HUMAN": "UniProtKB_AC-ID", "UPI01": "UniParc", "UniRef50_P12345": "UniRef50",
        "UniRef90_P12345": "UniRef90", "UniRef100_P12345": "UniRef100", "CCDS123": "CCDS", "ENSG01": "Ensembl", "ENSP01": "Ensembl_Protein", "ENST01": "Ensembl_Transcript", "NM_1": "RefSeq_Nucleotide", "XM_1": "RefSeq_Nucleotide",
        "NP_1": "RefSeq_Protein", "XP_1": "RefSeq_Protein", "gi|12": "GI_number", "TP53": "genename/unrecognized", "J3KP06": "genename/unrecognized", "NR_1": "genename/unrecognized", "WP_1": "genename/unrecognized",
    }
    rows = spark.createDataFrame([(k,) for k in kinds], "a string").select("a", A.accession_type(F.col("a")).alias("k")).collect()
    assert {r.a: r.k for r in rows} == kinds


def test_hypergeometric(spark):
    rows = [(k, m, g, n) for m in (1, 5, 10, 40) for g in range(0, m + 1, max(1, m // 4)) for n in range(0, m + 1, max(1, m // 4)) for k in range(0, min(g, n) + 2)]
    rows.append((30, 5000, 400, 300))

    def exact(k, m, g, n):
        hits = sum(math.comb(g, i) * math.comb(m - g, n - i) for i in range(max(k, 0), min(g, n) + 1) if n - i >= 0)
        return float(Fraction(hits, math.comb(m, n)))

    frame = spark.createDataFrame(rows, "k long, m long, degree long, n long")
    for r in stats.with_hypergeometric_tail(frame).collect():
        assert r.tail == pytest.approx(exact(r.k, r.m, r.degree, r.n), rel=1e-9, abs=1e-12), r


def test_normal_tail(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(-24, 105)], "x double").select("x", stats.erfc(F.col("x")).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-11, abs=1e-300)


def test_conversion_by_kind(spark):
    maps = spark.createDataFrame([("Ensembl_Protein", "ENSP1", "ENSG1"), ("Ensembl", "ENSG1", "TP53"), ("genename/unrecognized", "TP53", "P04637"), ("genename/unrecognized", "TP53", "Q00001"), ("Ensembl", "LOOP", "P11111"), ("genename/unrecognized", "A", "B"), ("genename/unrecognized", "B", "A")], "kind string, from_id string, to_id string")
    rows = spark.createDataFrame([(1, "ENSP1;LOOP"), (2, "TP53;P12345"), (3, "A;XM_1"), (4, None)], "n int, ids string")
    out, shares = A.convert_by_kind(rows, "ids", maps)
    assert {r.n: r.accession for r in out.collect()} == {1: "P04637;Q00001", 2: "P04637;P12345;Q00001", 3: None, 4: None}
    assert {r.kind: (r.ids, r.converted, round(r.share, 3)) for r in shares.collect()} == {"Ensembl_Protein": (1, 1, 1.0), "genename/unrecognized": (3, 1, 0.333), "UniProtKB": (1, 1, 1.0), "RefSeq_Nucleotide": (1, 0, 0.0)}
    short, _ = A.convert_by_kind(rows, "ids", maps, hops=2)
    assert {r.n: r.accession for r in short.collect()}[1] is None


def test_largest_overlap_is_that_of_trying_each(spark):
    rows = [(m, g, n) for m in (1, 7, 60, 3000) for g in (0, 1, 5, 40, 900) for n in (0, 1, 6, 50, 2500) if g <= m and n <= m]
    got = {(r.m, r.degree, r.n): r.largest for r in stats.with_largest_overlap(spark.createDataFrame(rows, "m bigint, degree bigint, n bigint")).collect()}
    for m, g, n in rows:
        k = np.arange(1, min(g, n) + 1)
        above = np.flatnonzero(stats.hypergeometric_tail(k, *(np.full(k.size, x) for x in (m, g, n))) > 0)
        assert got[m, g, n] == (int(above[-1]) if above.size else None), (m, g, n)


def test_composed_maps_meet_by_classes(spark):
    to_gene = [("E1", "G1"), ("E1", "G2"), ("E2", "G2"), ("E2", "G1"), ("E2", "G1"), ("E3", "G3"), ("E4", None), (None, "G3"), ("E5", "G9")]
    to_accession = [("G1", "P1"), ("G2", "P1"), ("G1", "P2"), ("G2", "P2"), ("G3", "P3"), ("G3", None), (None, "P4"), ("G2", "P5")]
    ids, accessions = spark.createDataFrame(to_gene, "from_id string, gene string"), spark.createDataFrame(to_accession, "gene string, accession string")
    found = A.compose_maps(ids, accessions)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, a) for i, g in to_gene for h, a in to_accession if g is not None and g == h}
    # pairs of members come from the last joins as they are, with no search for equal ones behind them
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Project") and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
