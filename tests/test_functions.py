import hashlib

from pyspark.sql import functions as F

from eraframe.functions import text as tx
from eraframe.functions import years as yr


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict(recursive=True)


def L(x, t=None):  # noqa: N802
    return F.lit(x) if t is None else F.lit(x).cast(t)


def test_years(spark):
    r = one(
        spark, a=yr.fractional_year(L(44), L(True), L(3), L(15)), b=yr.fractional_year(L(1), L(False), L(12), L(31)), c=yr.fractional_year(L(5), L(False), L(None, "int"), L(None, "int")), d=yr.fractional_year(L(5), L(False), L(2), L(None, "int")),
        e=yr.continuous_year(L(1), L(True)), f=yr.display_year(L(490), L(True)), g=yr.display_year(L(0), L(False)), h=yr.period_name(L(-509)), i=yr.century_years(L(5), L(True)), j=yr.century_years(L(18), L(False), L("mid")),
        k=yr.parse_year_bound(L("150 BC")), m=yr.month_number(L("Sept."), True), n=yr.month_number(L("March")), o=yr.belongs_to_bin(L(10.0), L(0.0), L(1.0)), p=yr.belongs_to_bin(L(15.0), L(0.0), L(1.0)), q=yr.belongs_to_bin(L(16.0), L(0.0), L(1.0)),
        s=yr.scope_from_title(L("5th century BC")), t=yr.scope_from_title(L("1880s")), u=yr.scope_from_title(L("AD 33")), v=yr.date_range_text(L(10), L(True), L(10), L(False)), w=yr.ancient_precision(L(12000), L(True), L(0.4)), x=yr.padded_date(L(44), L(3), L(5), L(True)),
    )
    assert round(r["a"], 6) == round(-44 + 74 / 365, 6) and r["b"] == 2.0 and r["c"] == 5.0 and round(r["d"], 6) == round(5 + 45 / 365, 6)
    assert (r["e"], r["f"], r["g"], r["h"]) == (0, "490 BC", None, "Early Republic")
    assert (r["i"]["start"], r["i"]["end"], r["j"]["start"], r["j"]["end"]) == (500, 401, 1734, 1767)
    assert r["k"] == {"year": 150, "is_bc": True} and (r["n"], r["o"], r["p"], r["q"]) == (3, 10, 14, None)
    assert (r["s"]["start"], r["s"]["end"], r["t"]["end"], r["u"]["start"]) == (500, 401, 1889, 33)
    assert r["v"] == "10 BC to 10 AD" and r["w"] == 0.2 and r["x"] == "44-03-05 BC"


def test_sql_functions(spark):
    yr.register_sql(spark)
    r = spark.sql("SELECT get_signed_position(44, true) a, round(to_fractional_year(44, true, 3, 15), 6) b, to_fractional_year(7, false, null, null) c").first()
    assert (r.a, r.b, r.c) == (-44, round(-44 + 74 / 365, 6), 7.0)


def test_text(spark):
    r = one(
        spark, a=tx.event_key(L("  T "), L(1), L(None, "int"), L(None, "string")), b=tx.event_key(L(" "), L(1), L(1), L("x")), c=tx.is_event_key(L("ab")), d=tx.short_title(L("word " * 30)), e=tx.split_belligerents(L("Rome vs. Carthage")), f=tx.split_belligerents(L("A; B, C")),
        g=tx.title_from_url(L("https://h.example/wiki/A+B%20C_d#x")), h=tx.trim_leading_date(L("March 15, 44 BC – Caesar dies")), i=tx.trim_leading_date(L("300 soldiers")), j=tx.client_class(L("curl/8.1")), k=tx.client_class(L("Mozilla/5.0 Chrome/120.0 Safari/537")), m=tx.client_class(L("Googlebot/2.1")),
        n=tx.first_sentence(L("One two. Three.")), o=tx.citation_numbers(L("a[1] b[22]")), p=tx.strip_citations(L("a[1] b[22]")), q=tx.semantic_category(L("World War")), s=tx.closest_category(L("naval battle")), t=tx.closest_category(L("zzz")), u=tx.exclude_item(L("v")), v=tx.exclude_item(L("Category: x")), w=tx.collapse_dashes(L("1 – 2")),
    )
    assert r["a"] == hashlib.sha256(b"T|1|0|").hexdigest() and r["b"] is None and r["c"] is False and 50 <= len(r["d"]) <= 70
    assert r["e"] == ["Rome", "Carthage"] and r["f"] == ["A", "B, C"] and r["g"] == "A+B C d"
    assert r["h"] == "Caesar dies" and r["i"] == "soldiers"
    assert (r["j"]["client_type"], r["k"]["browser"], r["m"]["client_type"], r["m"]["confidence"]) == ("cli", "Chrome", "bot", 0.95)
    assert r["n"] == "One two" and r["o"] == [1, 22] and r["p"] == "a b" and r["q"] == "#fa709a"
    assert r["s"] == "War & Conflict" and r["t"] == "Other" and (r["u"], r["v"], r["w"]) == ("too_short", "category", "1-2")
