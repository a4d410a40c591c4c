import pytest
from pyspark.sql import functions as F

from freshet.operators import places
from freshet.operators.listing import Place

# One case or more for each rule of the resolution.
CASES = {
    # a city by alias, by accent-folded name, with its region and country, in brackets, with more behind a dash
    "Philly": ("philadelphia", "united states", False),
    "MÜNCHEN": ("munich", "germany", False),
    "Zaragoza, Aragon, Spain": ("zaragoza", "spain", False),
    "(Rijeka, Croatia)": ("rijeka", "croatia", False),
    "Stockholm - Finance": ("stockholm", "sweden", False),
    # site codes, and segments in the other order
    "us-az-tucson": ("tucson", "united states", False),
    "OH - Dayton": (None, "united states", False),
    "Sweden, Stockholm": ("stockholm", "sweden", False),
    # countries, regions, postal codes
    "U.S.": (None, "united states", False),
    "Brasil": (None, "brazil", False),
    "Juneau, AK 99801": (None, "united states", False),
    "Denver, CO 80202-1234": ("denver", "united states", False),
    # remote forms
    "Remote": (None, None, True),
    "remote, Poland": (None, "poland", True),
    "Norway (remote)": (None, "norway", True),
    "WFH - south": (None, None, True),
    "Remote, FL": (None, "united states", True),
    # a name that two countries share
    "Santiago": ("santiago", "chile", False),
    "Hamilton": ("hamilton", "canada", False),
    "Santiago, Poland": (None, "poland", False),
    # several offices: the first city; words inside other text: the longest alias
    "Málaga / Paris": ("malaga", "spain", False),
    "our place near santiago de chile station": ("santiago", "chile", False),
    "parisian quarter": (None, None, None),
    # texts that name no place
    "8 locations": (None, None, None),
    "Unspecified": (None, None, None),
    "somewhere nice": (None, None, None),
    "": (None, None, None),
    " \t ": (None, None, None),
}


def test_resolve(spark):
    raws = spark.createDataFrame([(raw,) for raw in CASES], "raw string")
    found = {
        r["raw"]: (r["city"], r["country"], r["remote"] if r["resolved"] else None)
        for r in places.resolve_places(raws, places.default_gazetteer(spark)).collect()
    }
    assert found == CASES


def test_literal(spark):
    gazetteer = places.default_gazetteer(spark)
    assert places.resolve_literal(spark, "Munich", gazetteer) == Place("munich", "germany", False)
    assert places.resolve_literal(spark, "somewhere else", gazetteer) is None


@pytest.mark.parametrize(("raw", "offices"), [
    ("Oslo / Rome", ["Oslo", "Rome"]), ("Remote/US", ["Remote/US"]), (" a ;b| c • ", ["a", "b", "c"]), ("", []),
])
def test_split(spark, raw, offices):
    assert spark.range(1).select(places.split_offices(F.lit(raw))).first()[0] == offices


def test_derive_and_facets(spark):
    gazetteer = places.default_gazetteer(spark)
    jobs = spark.createDataFrame([
        ("a", "Berlin", ["Berlin", "Hamburg", "Berlin, Germany"], False),
        ("b", "Remote, Germany", ["Paris"], False),
        ("c", "nowhere", ["Remote"], False),
        ("d", "Tucson", None, True),
    ], "id string, location string, locations array<string>, is_remote boolean")
    placed = places.office_places(jobs, gazetteer)
    rows = {r["id"]: (r["location"], r["city"], r["country"], r["is_remote"]) for r in places.derive_location(jobs, placed).collect()}
    assert rows == {
        "a": ("berlin, germany", "berlin", "germany", False), "b": ("remote, germany", None, "germany", True),
        "c": ("unknown", None, None, True), "d": ("tucson, united states", "tucson", "united states", True),
    }
    facets = {tuple(r) for r in places.location_facets(placed).collect()}
    assert facets == {
        ("a", "berlin", "germany"), ("a", "hamburg", "germany"), ("b", "", "germany"), ("b", "paris", "france"), ("d", "tucson", "united states"),
    }
