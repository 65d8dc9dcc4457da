"""The registered queries against their SQL, and the operators' cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from legalspark.functions import text as X
from legalspark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"parse_and_resolve", "audit_mirror"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", [q for q in plans.queries() if q not in SLOW])
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    want = duck.sql(plans.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=key)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("label", "want"), [("(a)", ("a", "point", False)), ("12.", ("12", "paragraph", False)), ("(12)", ("12", "numeric", False)), ("12)", ("12", "numeric", False)), ("(iv)", ("iv", "subpoint", False)), ("xxxix", ("xxxix", "subpoint", False)), ("‘(b)", ("b", "point", True)), ("–", ("—", "dash", False)), ("(abc)", ("(abc)", "unknown", False)), ("", ("", "unknown", False)), ("1. (a)", ("1. (a)", "unknown", False))])
def test_labels_native_and_in_python(spark, label, want):
    from legalspark.functions.dom import label_of

    assert tuple(one(spark, X.normalize_label(F.lit(label)))) == want
    assert label_of(label) == want


def test_leading_references_and_labels(spark):
    assert one(spark, X.strip_leading_refs(F.lit("1. (a) — (ii) whereas it holds"))) == "whereas it holds"
    assert one(spark, X.looks_like_label(F.lit("CHAPTER IV Scope"))) and one(spark, X.looks_like_label(F.lit("(iv)"))) and not one(spark, X.looks_like_label(F.lit("Chapters apply")))
    assert tuple(one(spark, X.strip_leading_label(F.lit("7.  rest of\nit ")))) == ("rest of\nit", "7")
    assert one(spark, X.normalize_text(F.lit(" a  b\n c "))) == "a b c"


def test_celex_numbers(spark):
    assert one(spark, X.celex_in(F.lit("uri=CELEX%3a02016R0679-20160504&x"))) == "02016R0679-20160504"
    assert one(spark, X.base_celex(F.lit("02016R0679-20160504"))) == "32016R0679"
    assert one(spark, X.celex_in(F.lit("100% none"))) is None
    assert one(spark, X.celex(F.lit("decision"), F.lit(1999), F.lit(12345))) == "31999D12345"


def test_language(spark):
    assert one(spark, X.detect_language(F.lit('<meta name="WT.z_usr_lan" content="fr-FR"><html lang="de">'))) == "FR"
    assert one(spark, X.detect_language(F.lit("see /legal-content/es/TXT"))) == "ES"
    assert one(spark, X.detect_language(F.lit("<p>none</p>"))) is None
