import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text
from tessera.functions.normalize import Learned, normalize, segment, split_alias


@pytest.mark.parametrize("raw, want", [
    ("राम", "ram"), ("आदित्य", "aditya"), ("लिमिटेड", "limited"), ("ਰਾਮ", "ram"), ("Éclair Müller Straße", "eclair muller strasse"), ("", ""), (None, ""), ("ABC", "abc"), ("१२", "12"),
])
def test_to_ascii(raw, want):
    assert text.to_ascii(raw) == want


@given(st.text(max_size=30))
def test_to_ascii_is_ascii(s):
    assert text.to_ascii(s).isascii()


def test_skeleton(spark):
    words = ["praivet", "private", "phoenix", "city", "cook", "", "aeiou"]
    got = {r.t: r.k for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", text.skeleton(F.col("t")).alias("k")).collect()}
    assert got["praivet"] == got["private"] == "prvt"
    assert got["phoenix"] == "fnks" and got["city"] == "st" and got["cook"] == "k" and got[""] == "" and got["aeiou"] == ""


def test_ocr(spark):
    words = ["b00k", "5mith", "c1ty", "a1", "abc1230", "500", "ab3c0"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "t string").select(text.ocr_fix(F.col("t")).alias("f")).collect()]
    assert got == ["b00k", "smith", "clty", "a1", "abc1230", "500", "ab3c0"]


def normal(spark, rows, learned=Learned()):
    """Normalised records of (name, address, country) rows, in order."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "idx int, business_name string, business_address string, country string")
    return sorted(normalize(df, learned=learned).collect(), key=lambda r: r.idx)


def test_names(spark):
    want = {
        "ACME Private Limited": ("acme private limited", ["acme"], ["ltd", "pvt"]),
        "Zzyx d/b/a Blue Moon Cafe": ("blue moon cafe", ["blue", "moon", "cafe"], []),
        "| The Company": ("the company", ["company"], ["co"]),
        " | ": ("", [], []),
        "bsservicescom": ("bsservices", ["bsservices"], []),
        "telecom": ("telecom", ["telecom"], []),
        "https://www.bluemoon.co.in": ("bluemoon", ["bluemoon"], []),
        "A.B. Foods & Co.": ("ab foods and co", ["ab", "foods"], ["co"]),
        "Foods Foods Inc Foods": ("foods inc", ["foods"], ["inc"]),
        "The Of And": ("the of and", ["the", "of", "and"], []),
        "Pvt Ltd": ("pvt ltd", ["pvt", "ltd"], ["ltd", "pvt"]),
        "Crème Brûlée SARL": ("creme brulee sarl", ["creme", "brulee"], ["sarl"]),
        "राम प्राइवेट लिमिटेड": ("ram praivet limited", ["ram"], ["ltd", "pvt"]),
        None: ("", [], []), "": ("", [], []),
    }
    got = normal(spark, [(n, None, "US") for n in want])
    assert [(r.name_norm, r.core, r.legal) for r in got] == list(want.values())
    words = normal(spark, [("राम", None, None), ("ram", None, None)], Learned(words={"ram": "rama"}))
    assert [r.core for r in words] == [["rama"], ["ram"]]


def test_alias_markers(spark):
    want = {
        "zzyx d/b/a blue moon": ("zzyx", "blue moon"), "zzyx (formerly known as blue)": ("zzyx", "blue"), "blue aka red": ("blue aka red", ""), "dba red": ("dba red", ""),
        "dba red dba blue": ("dba red", "blue"), "red trading as: blue fka green": ("red", "blue fka green"), "red dba": ("red dba", ""), "red dbase blue": ("red dbase blue", ""), "": ("", ""),
    }
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(want)], "k int, n string").select("k", split_alias(F.col("n")).alias("x")).collect()
    assert [tuple(r.x) for r in sorted(rows)] == list(want.values())


def test_addresses(spark):
    rows = {
        ("12 1/2 Main Street, 1st floor, Springfield, IL", "US"): ("12 main st 1st fl springfield st_illinois", ["12", "1"], "12", "st_illinois", ["springfield"], ["main"]),
        ("2nd Street 007", "US"): ("2nd st 007", ["2", "7"], "7", "", [], []),
        ("2nd Street", "US"): ("2nd st", ["2"], "2", "", [], []),
        ("Plot 4-B, Shop No 00, Near City Mall, Anna Nagar, Chennai, Tamil Nadu, 600040", "India"): (
            "4 b 00 nr mall anna ngr chennai st_tamilnadu 600040", ["4", "0", "600040"], "4", "st_tamilnadu", ["chennai", "anna", "mall"], []),
        ("New York, NY, newyork", "US"): ("st_newyork ny newyork", [], "", "st_newyork", ["newyork", "ny"], []),
        ("5 rue X, Bretagne", "France"): ("5 rue x bretagne", ["5"], "5", "", ["bretagne"], []),
        ("Goa, Goa", None): ("goa goa", [], "", "", ["goa"], []),
        (" , ,", "US"): ("", [], "", "", [], []), (None, "US"): ("", [], "", "", [], []),
    }
    got = normal(spark, [(None, a, c) for a, c in rows])
    for (address, _), want, r in zip(rows, rows.values(), got):
        assert (r.addr_norm, r.nums, r.hno, r.state, r["loc"], r.street) == want, address
    got = normal(spark, [(None, "5 rue X, Bretagne, Autre", "France")], Learned(admin={"France": frozenset({"bretagne"})}, states={"France": {"autre": "st_autre"}}))
    assert (got[0]["loc"], got[0].state) == ([], "st_autre")


def test_clashing_names_give_way(spark):
    df = spark.createDataFrame([("Acme", None, "US", "old", 1)], "business_name string, business_address string, country string, hno string, idx int")
    out = normalize(df)
    assert out.columns.count("hno") == 1 and out.first().hno == ""


def test_segment():
    vocab = {"blue": 50, "river": 40, "foods": 30, "food": 10}
    assert segment("blueriverfoods", vocab) == ["blue", "river", "foods"]
    assert segment("blue", vocab) == ["blue"] and segment("qqzzxxww", vocab) == ["qqzzxxww"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_metrics(a, b):
    assert sim.lcs(a, b) == slow_lcs(a, b)
    for f in (sim.ratio, sim.token_sort, sim.token_set, sim.wratio):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))
    assert sim.partial(a, b) >= sim.ratio(a, b) - 1e-9 or not a or not b
    assert 0 <= sim.jaro_winkler(a, b) <= 1


def test_known_values():
    assert sim.ratio("abcd", "abxd") == 75 and sim.partial("abc", "xxabcxx") == 100
    assert sim.token_set("foo bar", "bar foo baz") == 100 and sim.token_set("", "x") == 0
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
