from causeway.llm import entities as X

C = "entry_id long, official_title string, accident_date string, location string, investigation_number string, investigation_number_candidate string, rule string"
N = "notice_id long, headline string, event_date string, place string, file_ref string, rule string"
ENTRIES = [
    (1, "Galtux Petrochem Silo Toxic Release", "2009-06-26", "Dunmarrow, Valmora", "2009-04-B-VL", "", "x"),
    (2, "Galtux Petrochem Dryer Fire", "2012-03-01", "Dunmarrow, VL", "", "2012-10-B-VL", "x"),
    (3, "Halnoral Solvents Storage Tank Vapor Cloud Ignition", "9/3/2002", "Rasgabroford, OK", "", "", "x"),
    (4, "", None, "", None, None, "x"),
]
NOTICES = [
    (11, "Galtuux Petrochem: silo toxic leak", "26 June 2009", "near Dunmarrow, VL", None, "x"),
    (12, "toxic leak at chemical plant", "unknown", None, "Inv. No. 2009-04-B-VL", "x"),
    (13, "Fire at Galtux", "March 2012", "DUNMARROW", "FM-1", "x"),
    (14, "ｃｌｏｕｄ ｉｇｎｉｔｉｏｎ ｉｎ ｓｔｏｒａｇｅ ｔａｎｋ ｏｆ Halnoral Solv.", "Sep 4, 2002", "", None, "x"),
    (15, "Galtux Petrochem dryer fire", "1 July 2019", "Dunmarrow", None, "x"),
    (16, "Explosion at Zelnoral Foods", "2002-09-03", "Elsewhere, MD", None, "x"),
    (17, None, None, None, None, "x"),
    (18, "", "", "Dunmarrow, VL", "", "x"),
]


def pairs(spark, entries, notices):
    found = X.match(X.catalogue_attributes(spark.createDataFrame(entries, C)), X.notice_attributes(spark.createDataFrame(notices, N)))
    return {r.notice_id: r for r in found.collect()}


def test_cascade(spark):
    found = pairs(spark, ENTRIES + ENTRIES[:1], NOTICES + NOTICES[:2])
    assert {n: r.entry_id for n, r in found.items()} == {11: 1, 12: 1, 13: 2, 14: 3}
    assert all(0 < r.confidence < 1 for r in found.values())


def test_empty_sides(spark):
    assert pairs(spark, ENTRIES[:0], NOTICES) == {} and pairs(spark, ENTRIES, NOTICES[:0]) == {}


def test_dates_places_and_numbers(spark):
    from pyspark.sql import functions as F

    dates = ["2009-06-26", "20090626", "6/26/2009", "26 June 2009", "26. Jun. 2009", "Jun 26, 2009", "June 2009", "2009", "unknown", "", None, "99/99/2009"]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(dates)], "k int, d string")
    df = df.withColumn("d", F.lower("d"))
    rows = [tuple(r) for r in df.orderBy("k").select(*X.date_parts(F.col("d")).values()).collect()]
    assert rows[:6] == [(2009, 6, 26)] * 6 and rows[6:9] == [(2009, 6, None), (2009, None, None), (None, None, None)]
    places = ["dunmarrow, valmora", "near dunmarrow, vl", "dunmarrow (vl)", "dunmarrow", "vl", None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(places)], "k int, p string")
    rows = [tuple(r) for r in df.orderBy("k").select(*X.place_parts(F.col("p")).values()).collect()]
    assert rows == [("dunmarrow", "valmora"), ("dunmarrow", "vl"), ("dunmarrow", "vl"), ("dunmarrow", None), ("vl", None), (None, None)]
    numbers = ["2002-37-i-ok", "inv. no. 2002/37/i/ok", "i-ok 2002-37", "200237iok", "fm-399", None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(numbers)], "k int, n string")
    rows = [tuple(r) for r in df.orderBy("k").select(*X.number_parts(F.col("n")).values()).collect()]
    assert [r[0] for r in rows] == ["200237"] * 4 + [None, None] and rows[0][1] == ["i", "ok"] and rows[4][1] is None


def test_names_of_no_list(spark):
    """Firms, places, plants and kinds of accident that stand nowhere in the code; German months."""
    entries = [
        (1, "Northfield Paperboard Boiler Steam Burst", "2015-05-04", "Houston, Texas", "", "", "x"),
        (2, "Lakeside Dairy Ammonia Leak", "2011-10-19", "Duluth, Minnesota", "", "", "x"),
    ]
    notices = [
        (11, "Boiler steam burst at Northfield Paperboard", "4 May 2015", "Houston, TX", None, "x"),
        (12, "Ammoniak: Lakeside Dairy", "19. Oktober 2011", "Duluth", None, "x"),
        (13, "Boiler steam burst", "4 May 1998", "Boise, ID", None, "x"),
    ]
    assert {n: r.entry_id for n, r in pairs(spark, entries, notices).items()} == {11: 1, 12: 2}


def test_frequent_town_and_firm(spark):
    """A town and a firm that hold most rows: days and words tell their accidents apart, and a tie resolves nothing."""
    kinds = ["Boiler Burst", "Ammonia Leak", "Dust Blast", "Silo Collapse"]
    entries = [(k, f"{'Bigfirm' if k % 3 else f'Lone{chr(97 + k % 26)}{chr(97 + k // 26)}xx'} {kinds[k % 4]}", f"{1990 + k // 12}-{k % 12 + 1:02}-{k % 27 + 1:02}", "Bigtown, Xland" if k % 3 else f"Town{chr(97 + k % 26)}{chr(97 + k // 26)}, Yland", f"{1990 + k // 12}-{100 + k}-A" if k % 4 == 0 else "", "", "x") for k in range(240)]
    notices = [(1000 + k, f"{e[1].split()[1].lower()} {e[1].split()[2].lower()} at {e[1].split()[0]}", e[2], e[3] if k % 5 else None, e[4] or None, "x") for k, e in enumerate(entries)]
    entries += [(500, "Twin Mill Fire", "2031-01-01", "Alba, Xland", "", "", "x"), (501, "Twin Mill Fire", "2031-01-01", "Alba, Xland", "", "", "x")]
    notices.append((2000, "Fire at Twin Mill", "2031-01-01", "Alba", None, "x"))
    found = pairs(spark, entries, notices)
    assert 2000 not in found
    right = sum(r.entry_id == n - 1000 for n, r in found.items())
    assert right >= 235 and len(found) - right <= 1


def test_confidence_is_learned_from_other_attributes(spark):
    """The number's precision is measured by the days, the others' by the numbers: a rule that is wrong half the time says so."""
    entries = [(k, f"Firm{chr(97 + k % 26)}{chr(97 + k // 26)}q Fire", f"{1990 + k % 20}-03-{k % 27 + 1:02}", f"Town{chr(97 + k % 26)}{chr(97 + k // 26)}, Xland", f"{1990 + k % 20}-{100 + k}-A", "", "x") for k in range(100)]
    notices = [(1000 + k, f"Fire at {e[1].split()[0]}", e[2] if k % 2 else "2040-01-01", e[3], e[4], "x") for k, e in enumerate(entries)]
    sure = {r.rule: r.confidence for r in pairs(spark, entries, notices).values()}
    assert abs(sure["number"] - 0.5) < 0.1
