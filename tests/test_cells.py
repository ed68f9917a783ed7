from pyspark.sql import functions as F

from eraframe.functions import cells
from eraframe.functions.candidates import candidate_kinds


def test_cell_dates(spark):
    rows = [("753 BC", "21 April"), ("AD 14", "summer"), ("27 BC – AD 14", None), ("c. 500 BC", ""), ("64", "July 18"), ("69 ?", "Sep"), ("0", None), (None, "May"), ("60–58 BC", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, y string, d string").select("i", cells.table_cell_date(F.col("y"), F.col("d")).alias("x"))
    got = [None if r.x is None else tuple(r.x) for r in df.orderBy("i").collect()]
    assert got[0] == (-753, -753, 4, 21, 4, 1000.0, "legendary") and got[1] == (14, 14, 6, None, 8, 0.25, "explicit")
    assert got[2][:2] == (-27, 14) and got[3][0] == -500 and got[3][5:] == (0.01, "approximate") and got[4] == (64, 64, 7, 18, 7, 1000.0, "explicit")
    assert got[5][2] == 9 and got[5][6] == "contentious" and got[6] is None and got[7] is None and got[8][:2] == (-60, -58)


def test_war_rows(spark):
    rows = [["431 BC", "404 BC", "Long War", "Athens vs. Sparta", "n1", "n2"], ["1914–1918", "World War", "A; B"], ["44 BC", "One", "x, y", "z"], ["name", "x", "y"], ["1066", "A"]]
    got = [r.war for r in cells.war_row(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>")).orderBy("i").collect()]
    assert (got[0].start_year, got[0].end_year, got[0].title, got[0].belligerents, got[0].notes) == (-431, -404, "Long War", ["Athens", "Sparta"], "n1 n2")
    assert (got[1].start_year, got[1].end_year, got[1].title, got[1].belligerents) == (1914, 1918, "World War", ["A", "B"])
    assert got[2].start_year == -44 and got[2].title == "One" and got[2].notes == "z" and got[3] is None and got[4] is None


def test_war_shapes(spark):
    rows = {
        "between": ["(Between 753 and 716 BC)", "Name [3]", "A v. B", "n"], "range": ["1810–1795 BC", "Salt Row", "Orra, Velm", "Some", "notes"], "eras": ["27 BC – AD 14", "Two  eras"],
        "one": ["c. 1640 BC", "Ford", "Orra versus Velm"], "two": ["1520 BC", "1490 BC", "Hill War", "Orra; Velm"], "open": ["1990 AD", "present", "Now", "A"],
        "century": ["Late 13th century BC", "Coast[25]", "Orra Velm"], "early": ["Early 5th century", "X"], "mid": ["Mid 5th century AD", "X"], "two digits": ["44 BC", "One", "x, y"],
        "two of two": ["44 BC", "31 BC", "Two", "x"], "bare": ["1914", "1918", "World", "A vs B"], "digits": ["c. 5", "c. 9", "Small", ""], "no era": ["1066", "A", "x"], "text": ["name", "x", "y"], "short": ["1066 AD", "A"], "none": [], "null": [None, "1", None],
    }
    df = spark.createDataFrame([*rows.items(), ("no cells", None)], "k string, cells array<string>")
    got = {r.k: r.war and (r.war.shape, r.war.start_year, r.war.end_year, r.war.title, r.war.belligerents, r.war.notes) for r in cells.war_row(df).collect()}
    assert got == {
        "between": ("between", -753, -716, "Name ", ["A", "B"], "n"), "range": ("range", -1810, -1795, "Salt Row", ["Orra", "Velm"], "Some notes"), "eras": ("range", -27, 14, "Two eras", [], ""),
        "one": ("date", -1640, -1640, "Ford", ["Orra", "Velm"], ""), "two": ("two dates", -1520, -1490, "Hill War", ["Orra", "Velm"], ""), "open": ("two dates", 1990, 1990, "Now", ["A"], ""),
        "century": ("century", -1233, -1201, "Coast", ["Orra Velm"], ""), "early": ("century", 401, 434, "X", [], ""), "mid": ("century", 435, 467, "X", [], ""), "two digits": ("date", -44, -44, "One", ["x", "y"], ""),
        "two of two": ("two dates", -44, -31, "Two", ["x"], ""), "bare": ("two dates", 1914, 1918, "World", ["A", "B"], ""), "digits": ("two dates", 5, 9, "Small", [], ""),
        **dict.fromkeys(("no era", "text", "short", "none", "null", "no cells")),
    }


def test_scored_years(spark):
    far = " and nothing else that anyone would count, "
    texts = {
        1: "The place was founded in 450 BC" + far + "it fell in 300 BC.", 2: "no numbers", 3: "Built in 1850" + far + "rebuilt in 1901", 4: "12 km of road in 1900", 5: "in 2036 or 2035", 6: "in 5001 BC", 7: "in 50, and in AD 60 AD", 8: "item 300", 9: None, 10: "12345",
    }
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r.k: (r.start_year, r.is_bc, r.end_year, round(r.confidence, 6)) for r in cells.scored_years(df, "k", "t").collect()}
    assert got == {1: (450, True, 450, 0.7), 3: (1850, False, 1901, 0.8), 5: (2035, False, None, 0.8), 7: (60, False, None, 0.7), 8: (300, False, None, 0.46)}


def test_candidate_kinds(spark):
    rows = {
        "ref": ("Main article: The other page", None, None), "head": ("Known works:[2]", None, None), "dated": ("1969 – Riots, and more. Then", None, None), "bc": ("600 BC; the poem", None, None),
        "by century": ("The first law was passed. More came.", None, "20th"), "by title": ("The first law was passed", "In the 19th century", "20th"), "by year in text": ("It was passed back in 1933 or so", None, None),
        "list": ("A list, see also the others of 1933", None, "20th"), "short": ("brief", None, "20th"), "plain": ("Nothing that says when it was", None, None), "null": (None, None, "20th"),
    }
    df = spark.createDataFrame([(k, *v, 7) for k, v in rows.items()], "k string, text string, art string, cent string, weight int")
    got = candidate_kinds(df, "text", "art", "cent")
    assert got.columns == [*df.columns, "candidate"] and got.agg(F.min("weight")).first()[0] == 7
    got = {r.k: r.candidate and (r.candidate.kind, r.candidate.title, r.candidate.start_year, r.candidate.end_year, r.candidate.is_bc_start) for r in got.collect()}
    assert got == {
        "ref": ("reference", None, None, None, None), "head": ("header", None, None, None, None), "dated": ("dated", "1969 – Riots, and more.", 1969, 1969, False), "bc": ("dated", "600 BC", 600, 600, True),
        "by century": ("undated", "The first law was passed.", 1901, 2000, False), "by title": ("undated", "The first law was passed", 1801, 1900, False), "by year in text": ("undated", "It was passed back in 1933 or so", 1900, 1900, False),
        **dict.fromkeys(("list", "short", "plain", "null")),
    }
