"""Accidents of two sources without a shared key: a cascade of exact joins on ever weaker combinations of attributes.

Nothing about firms, places, plants or kinds of accident is written down here; it is learned from the two tables:

- A title's words are names where they keep to few towns (``NAME_TOWNS``, ``NAME_SHARE``), however many records have them,
  else common.
- Of common words it is learned which ones translate into each other, on pairs of one file number.
- How much an agreement or a contradiction says is its frequency among pairs of one file number against chance pairs.

Each rule joins what is still unresolved on a combination of attributes. A pair must say more than chance explains among all
entries, and a notice is resolved if one partner is better than all others; an anti-join leaves the rest to the next rule.
The confidence of a pair is its rule's smoothed precision on labelled pairs: those whose file numbers tell whether they are
right, or, for the rule that joins the numbers, those whose days tell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.lookalike import one_form
from causeway.session import broadcast_if_small, durable, released

#: Towns that a name keeps to at most, as an effective number, or this share of all towns; a frequent firm stays a name.
NAME_TOWNS, NAME_SHARE = 4.0, 0.01
#: Share of the pairs with a word in which its translation stands at least, and how much more than in all pairs.
TRANSLATED, LIFT = 0.8, 1.5
#: Days by which the dates of one accident may differ.
DAYS = 2
#: Bounds of what is learned from: pairs of one number, chance pairs; and labelled notices that each rule is measured on.
SEEDS, CHANCE, LABELLED = 50_000, 60_000, 20_000
#: Bits that a pair must say beyond chance among all entries, and beyond a notice's second partner.
MARGIN, LEAD = 0.0, 1.0
# Beginnings of the names of months in English, German, French, Spanish, Portuguese and Dutch.
MONTHS = {
    1: ["jan", "jän", "ene"], 2: ["feb", "fév", "fev"], 3: ["mar", "mär", "maa", "mrt"], 4: ["apr", "avr", "abr"], 5: ["may", "mai", "mei"],
    6: ["jun", "juin"], 7: ["jul", "juil"], 8: ["aug", "aoû", "aou", "ago"], 9: ["sep", "set"], 10: ["oct", "okt", "out"], 11: ["nov"], 12: ["dec", "dez", "déc", "dic"],
}
# Words before a place's name.
BEFORE_PLACE = ["near", "in", "at", "of", "outside", "off"]
# Shares assumed of pairs of one accident and of chance pairs while few are seen (``ASSUMED`` pairs' worth), by attribute and outcome.
ASSUMED = 20
EXPECTED = {
    "name": {"same": (0.7, 0.01), "near": (0.2, 0.01), "none": (0.1, 0.98)},
    "town": {"same": (0.8, 0.02), "near": (0.1, 0.01), "none": (0.1, 0.97)},
    "region": {"same": (0.95, 0.1), "none": (0.05, 0.9)},
    "date": {"day": (0.5, 0.003), "days": (0.1, 0.01), "month": (0.2, 0.02), "year": (0.15, 0.05), "none": (0.05, 0.917)},
    "words": {"one": (0.3, 0.1), "two": (0.3, 0.03), "more": (0.3, 0.01), "some": (0.05, 0.3), "none": (0.05, 0.56)},
    "number": {"same": (0.9, 0.001), "digits": (0.05, 0.001)},
}


def _plain(text: str) -> Column:
    """Lower case in one form, blanks single, or null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(one_form(text)), r"\s+", " ")), F.lit(""))


def date_parts(text: Column) -> dict[str, Column]:
    """Year, month and day of the ways to write a date, each null where not given. Numbers with slashes are month/day/year."""
    number = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
    word = F.lower(F.regexp_extract(text, r"(\p{L}{3,})", 1))
    named = F.coalesce(*(F.when(word.rlike("^(" + "|".join(ways) + ")"), m) for m, ways in MONTHS.items()))
    iso, run, slash = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})(\d\d)(\d\d)$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    year = F.coalesce(number(iso, 1), number(run, 1), number(slash, 3), number(r"(?<!\d)(\d{4})(?!\d)", 1))
    month = F.coalesce(number(iso, 2), number(run, 2), number(slash, 1), named)
    day = F.coalesce(number(iso, 3), number(run, 3), number(slash, 2), F.when(named.isNotNull(), number(r"(?<!\d)(\d{1,2})(?!\d)", 1)))
    return {"year": year, "month": F.when(month.between(1, 12), month), "day": F.when(day.between(1, 31), day)}


def place_parts(place: Column) -> dict[str, Column]:
    """Town and region of a place: what stands before a comma or bracket, and what after; one part alone is the town."""
    bare = F.regexp_replace(place, "^(" + "|".join(BEFORE_PLACE) + ") ", "")
    split = r"^(.*?)\s*[,(]\s*([^)]*?)\s*\)?$"
    letters = lambda c: F.nullif(F.regexp_replace(c, r"[^\p{L}]", ""), F.lit(""))
    parted = bare.rlike(split)
    return {"town": letters(F.when(parted, F.regexp_extract(bare, split, 1)).otherwise(bare)), "region": letters(F.when(parted, F.regexp_extract(bare, split, 2)))}


def number_parts(text: Column) -> dict[str, Column]:
    """The digits of a file number in a row, at least five, and its groups of letters."""
    digits = F.regexp_replace(text, r"\D", "")
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)))
    return {"digits": F.when(F.length(digits) >= 5, digits), "letters": F.when(F.length(digits) >= 5, F.coalesce(letters, F.expr("cast(array() as array<string>)")))}


def attributes(rows: DataFrame, id_col: str, title: str, date: str, place: str, number: Column) -> DataFrame:
    """The attributes of both sides, one row for each id: exact copies collapse, the least row of an id is taken.

    Gives title words, town, region, low and high (the first and last day that the date can mean), digits and letters.
    """
    plain = rows.select(id_col, _plain(title).alias("_t"), _plain(date).alias("_d"), _plain(place).alias("_p"), number.alias("_n"))
    plain = plain.where(F.col(id_col).isNotNull()).withColumn("_n", _plain("_n"))
    words = F.filter(F.array_distinct(F.split(F.col("_t"), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    parts = {"title": words, **date_parts(F.col("_d")), **place_parts(F.col("_p")), **number_parts(F.col("_n"))}
    cols = plain.select(id_col, *(c.alias(k) for k, c in parts.items()))
    one = cols.groupBy(id_col).agg(F.min_by(F.struct(*parts), F.to_json(F.struct(*parts))).alias("a")).select(id_col, "a.*")
    first = lambda m, d: F.expr(f"cast(try_make_timestamp(year, {m}, {d}, 0, 0, 0) as date)")
    low = F.coalesce(first("month", "day"), F.when(F.col("day").isNull(), first("month", 1)), F.when(F.col("month").isNull(), first(1, 1)))
    high = F.coalesce(first("month", "day"), F.when(F.col("day").isNull(), F.last_day(first("month", 1))), F.when(F.col("month").isNull(), first(12, 31)))
    return one.withColumns({"low": low, "high": high}).drop("year", "month", "day")


def common_words(records: DataFrame) -> DataFrame:
    """word: title words that stand with more towns than a name does. Counts are by word and town first.

    A town counts by the root of its records, so that one frequent town doesn't make all words look like names of it.
    """
    placed = records.where("town is not null")
    towns = placed.groupBy("town").agg(F.count("*").alias("of_town"))
    pairs = placed.select(F.explode("title").alias("word"), "town").groupBy("word", "town").agg(F.count("*").alias("n")).join(towns, "town")
    pairs = pairs.select("word", (F.col("n") / F.sqrt("of_town")).alias("n"))
    spread = F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))
    most = towns.agg(F.greatest(F.lit(NAME_TOWNS), NAME_SHARE * F.count("*")).alias("most"))
    return pairs.groupBy("word").agg(spread.alias("towns")).crossJoin(F.broadcast(most)).where("towns > most").select("word")


def told_apart(records: DataFrame, common: DataFrame) -> DataFrame:
    """Title words as names and common words; a town that others write as a region is one."""
    words = records.select("side", "id", F.explode("title").alias("word")).join(broadcast_if_small(common.withColumn("common", F.lit(True))), "word", "left")
    sides = words.groupBy("side", "id").agg(
        F.sort_array(F.collect_list(F.when(F.col("common").isNull() & (F.length("word") >= 4), F.col("word")))).alias("names"),
        F.sort_array(F.collect_list(F.when(F.col("common"), F.col("word")))).alias("words"),
    )
    regions = records.where("region is not null and town is not null").groupBy("region").agg(F.lit(True).alias("is_region")).withColumnRenamed("region", "town")
    told = records.drop("title").join(sides, ["side", "id"], "left").join(regions, "town", "left")
    empty = F.expr("cast(array() as array<string>)")
    return told.select(
        "side", "id", F.coalesce("names", empty).alias("names"), F.coalesce("words", empty).alias("words"), F.when(F.col("is_region").isNull(), F.col("town")).alias("town"),
        F.when(F.col("is_region"), F.col("town")).otherwise(F.col("region")).alias("region"), "low", "high", "digits", "letters",
    )


def _near(a: Column, b: Column) -> Column:
    """The texts differ by two letters at most, or the longer one begins with the other."""
    few = (F.levenshtein(a, b) <= 2) & (F.least(F.length(a), F.length(b)) >= 5)
    return few | (F.least(F.length(a), F.length(b)) >= 5) & (a.startswith(b) | b.startswith(a))


def _any_near(a: str, b: Column | str) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: _near(x, y)))


def _short_for(a: Column, b: Column) -> Column:
    """Equal, or one is short for the other: the same first letter, and its letters stand in the other in their order."""
    within = lambda s, t: F.regexp_like(t, F.concat(F.lit("^"), F.regexp_replace(s, r"(\p{L})", "$1.*")))
    return (a == b) | within(a, b) | within(b, a)


def outcomes() -> dict[str, Column]:
    """What each attribute of a pair (e_ and n_ columns, translations to_n and to_e) says; null where a side lacks it."""
    e, n = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"n_{c}"))
    town = F.when(e("town").isNotNull(), F.array("e_town")).otherwise(F.expr("cast(array() as array<string>)"))
    told = F.exists("n_names", lambda x: F.exists(town, lambda y: _near(x, y)))
    name = (
        F.when(F.arrays_overlap("e_names", "n_names"), "same")
        .when(_any_near("e_names", "n_names"), "near")
        .when((F.size("e_names") > 0) & (F.size("n_names") > 0) & ~told, "none")
    )
    place = (
        F.when((e("town") == n("town")) | F.array_contains("n_names", e("town")), "same")
        .when(_near(e("town"), n("town")) | told, "near")
        .when(e("town").isNotNull() & n("town").isNotNull(), "none")
    )
    day = (e("low") == e("high")) & (n("low") == n("high"))
    meet = (n("low") <= F.date_add("e_high", DAYS)) & (n("high") >= F.date_sub("e_low", DAYS))
    month = F.datediff(n("high"), n("low")) < 31
    date = (
        F.when(day & (e("low") == n("low")), "day").when(day & meet, "days").when(meet & month, "month").when(meet, "year")
        .when(e("low").isNotNull() & n("low").isNotNull(), "none")
    )
    agreed, told_words = F.size(F.filter("n_to", lambda t: F.arrays_overlap(t, F.col("e_words")))), F.size("n_to")
    back, told_back = F.size(F.filter("e_to", lambda t: F.arrays_overlap(t, F.col("n_words")))), F.size("e_to")
    whole = (agreed == told_words) & ((back == told_back) | (F.size("n_words") == 0))
    words = (
        F.when(told_words == 0, None).when(whole & (agreed == 1), "one").when(whole & (agreed == 2), "two").when(whole, "more")
        .when(agreed > 0, "some").otherwise("none")
    )
    all_letters = F.forall("e_letters", lambda x: F.array_contains("n_letters", x))
    number = F.when((e("digits") == n("digits")) & all_letters, "same").when(e("digits") == n("digits"), "digits")
    return {"name": name, "town": place, "region": F.when(_short_for(e("region"), n("region")), "same").when(e("region").isNotNull() & n("region").isNotNull(), "none"), "date": date, "words": words, "number": number}


def translations(pairs: DataFrame) -> DataFrame:
    """side, word, into: the words of the other side that stand in nearly all pairs with the word, and more than anywhere.

    ``pairs`` has e_words and n_words, and tells both ways: of an entry's words into a notice's, and back.
    """
    ways = F.explode(F.array(F.struct(F.lit("e").alias("side"), F.col("e_words").alias("of"), F.col("n_words").alias("to")), F.struct(F.lit("n").alias("side"), F.col("n_words").alias("of"), F.col("e_words").alias("to")))).alias("w")
    told = pairs.select(ways).select("w.*")
    both = told.select("side", F.explode("of").alias("word"), "to").select("side", "word", F.explode("to").alias("into")).groupBy("side", "word", "into").agg(F.count("*").alias("n"))
    alone = F.explode(F.concat(F.transform("of", lambda x: F.struct(F.lit("of").alias("role"), x.alias("word"))), F.transform("to", lambda x: F.struct(F.lit("to").alias("role"), x.alias("word"))))).alias("x")
    counts = told.select("side", alone).groupBy("side", "x.role", "x.word").agg(F.count("*").alias("n"))
    of = counts.where("role = 'of'").select("side", "word", F.col("n").alias("of"))
    to = counts.where("role = 'to'").select("side", F.col("word").alias("into"), F.col("n").alias("all"))
    share, total = F.col("n") / F.col("of"), F.lit(pairs.count())
    kept = both.join(of, ["side", "word"]).join(to, ["side", "into"]).where((F.col("of") >= 5) & (share >= TRANSLATED) & (share >= LIFT * F.col("all") / total))
    return kept.groupBy("side", "word").agg(F.array_sort(F.collect_list("into")).alias("into"))


def _sided(rows: DataFrame, side: str, id_col: str) -> DataFrame:
    return rows.where(F.col("side") == side).select(F.col("id").alias(id_col), *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in ("side", "id")))


def _translated(records: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``to``: for each word with translations, the list of them."""
    found = records.select("side", "id", F.explode("words").alias("word")).join(broadcast_if_small(table), ["side", "word"]).groupBy("side", "id").agg(F.collect_list("into").alias("to"))
    return records.join(found, ["side", "id"], "left").withColumn("to", F.coalesce("to", F.expr("cast(array() as array<array<string>>)")))


def _weights(pairs: DataFrame, chance: DataFrame) -> dict[str, dict[str, float]]:
    """Bits for each attribute and outcome, from counts among pairs of one accident and chance pairs: a table of fixed size."""
    stacked = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), c.alias("o")) for a, c in outcomes().items()))).alias("x")
    sides = pairs.withColumn("k", F.lit(0)).unionByName(chance.withColumn("k", F.lit(1)))
    tallied = sides.select("k", stacked).where("x.o is not null").groupBy("k", "x.a", "x.o").agg(F.count("*").alias("n"))
    counted = {(r.k, r.a, r.o): r.n for r in tallied.collect()}
    bits: dict[str, dict[str, float]] = {}
    for attribute, expected in EXPECTED.items():
        if attribute == "number":  # the pairs learned from are those of one number
            counted = {k: n for k, n in counted.items() if k[1] != attribute}
        totals = [sum(counted.get((k, attribute, o), 0) for o in expected) + ASSUMED for k in (0, 1)]
        shares = {o: [(counted.get((k, attribute, o), 0) + ASSUMED * e[k]) / totals[k] for k in (0, 1)] for o, e in expected.items()}
        bits[attribute] = {o: math.log2(a / b) for o, (a, b) in shares.items()}
    return bits


#: The rules in order: name and alternative keys. A key is made of parts; with a date part its day, month or year must be known.
RULES: list[tuple[str, list[list[str]]]] = [
    ("number", [["digits"]]),
    ("name and day", [["name", "day"], ["name_part", "day"]]),
    ("town and day", [["town", "day"], ["town_part", "day"]]),
    ("name or town and month", [["name", "month"], ["name_part", "month"], ["town", "month"]]),
    ("name or town and word and year", [["name", "year"], ["name_part", "year"], ["town", "word", "year"]]),
    ("name and word", [["name", "word"]]),
]
_EMPTY = "cast(array() as array<string>)"


def _keys(ways: list[list[str]], spread: bool) -> str:
    """SQL of the keys of a record for a rule; ``spread`` makes them for each day, month or year that is near enough."""
    days = f"sequence(date_sub(low, {DAYS}), date_add(high, {DAYS}))" if spread else "array(low)"
    made = {
        "digits": f"if(digits is null, {_EMPTY}, array(digits))",
        "name": "names",
        "town": f"if(town is null, {_EMPTY}, array(town))",
        "name_part": "flatten(transform(filter(names, x -> length(x) >= 5), x -> array(concat('<', left(x, 5)), concat('>', right(x, 5)))))",
        "town_part": f"if(length(town) >= 5, array(concat('<', left(town, 5)), concat('>', right(town, 5))), {_EMPTY})",
        "word": "words" if spread else "array_distinct(flatten(to))",
        "day": f"if(low = high, transform({days}, d -> string(d)), {_EMPTY})",
        "month": f"if(datediff(high, low) < 31, array_distinct(transform({days}, d -> date_format(d, 'yyyy-MM'))), {_EMPTY})",
        "year": f"if(low is null, {_EMPTY}, array_distinct(transform({days}, d -> string(year(d)))))",
    }
    keys = []
    for parts in ways:
        way = made[parts[0]]
        for part in parts[1:]:
            way = f"flatten(transform({way}, a -> transform(coalesce({made[part]}, {_EMPTY}), b -> concat_ws('|', a, b))))"
        keys.append(f"coalesce({way}, {_EMPTY})")
    return f"array_distinct(concat({', '.join(keys)}))"


def match(entries: DataFrame, notices: DataFrame) -> DataFrame:
    """Pairs of the two sides' attributes that are one accident: entry_id, notice_id, rule, confidence.

    A notice has at most one entry, an entry may have several notices. Rows without an id and rows without attributes
    match nothing; a rule skips rows that lack one of its attributes. A tie of several entries resolves nothing, and
    the notice stays open for the later rules; a bounded sample of resolved ones goes along, to measure them. Keys and ids alone go through a rule's join; a hot name or town is split
    by the key's date or word.
    """
    columns = ["title", "town", "region", "low", "high", "digits", "letters"]
    sides = (rows.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), *columns) for rows, side, id_col in ((entries, "e", "entry_id"), (notices, "n", "notice_id")))
    records = durable(reduce(DataFrame.unionByName, sides))
    common = durable(common_words(records))
    records = durable(told_apart(records, common))

    # pairs whose file number has one entry only teach translations and weights
    numbers = records.where("digits is not null")
    by_number = numbers.where("side = 'e'").groupBy("digits", "letters").agg(F.count("*").alias("n"), F.min("id").alias("entry_id"), F.first("words").alias("e_words")).where("n = 1")
    seeds = numbers.where("side = 'n'").select("digits", F.col("id").alias("notice_id"), F.col("letters").alias("n_letters"), F.col("words").alias("n_words")).join(by_number, "digits")
    seeds = seeds.where(F.forall("letters", lambda x: F.array_contains("n_letters", x))).select("entry_id", "notice_id", "e_words", "n_words")
    seeds = durable(seeds.orderBy(F.xxhash64("notice_id")).limit(SEEDS))
    # with few pairs of one number a common word stands for itself
    same = common.select(F.explode(F.array(F.lit("e"), F.lit("n"))).alias("side"), "word", F.array("word").alias("into"))
    table = same if seeds.count() < ASSUMED else durable(translations(seeds))
    # agencies number their own files, so only a number that some entry has tells
    numbered = numbers.where("side = 'e'").groupBy("digits").agg(F.lit(True).alias("numbered"))
    records = durable(_translated(records, table).join(numbered, "digits", "left").na.fill(False, ["numbered"]))
    e_side, n_side = _sided(records, "e", "entry_id"), _sided(records, "n", "notice_id")
    entries = records.where("side = 'e'").drop("side").withColumnRenamed("id", "entry_id")
    notices = records.where("side = 'n'").drop("side").withColumnRenamed("id", "notice_id")

    def attributed(pairs: DataFrame) -> DataFrame:
        return pairs.join(e_side, "entry_id").join(n_side, "notice_id")

    sizes = {r.side: r.n for r in records.groupBy("side").agg(F.count("*").alias("n")).collect()}
    total = sizes.get("e", 0)
    parts = max(1, math.ceil(total * sizes.get("n", 0) / CHANCE))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    chance = entries.select("entry_id", part("entry_id").alias("part")).join(notices.select("notice_id", part("notice_id").alias("part")), "part").drop("part")
    bits = _weights(attributed(seeds.select("entry_id", "notice_id")), attributed(chance))
    said = sum((reduce(lambda w, o: w.when(F.col(a) == o, bits[a][o]), bits[a], F.when(F.lit(False), 0.0)).otherwise(0.0) for a in bits), F.lit(0.0))
    least = math.log2(max(total, 1)) + MARGIN

    asked, resolved = notices.withColumn("open", F.lit(True)), []
    for no, (_, ways) in enumerate(RULES):
        if resolved:
            hits = reduce(DataFrame.unionByName, (r.where("open").select("notice_id") for r in resolved))
            labelled = notices.join(resolved[0].select("notice_id").orderBy(F.xxhash64("notice_id")).limit(LABELLED), "notice_id", "left_semi")
            asked = notices.join(hits, "notice_id", "left_anti").withColumn("open", F.lit(True)).unionByName(labelled.withColumn("open", F.lit(False)))
        left = entries.select("entry_id", F.explode(F.expr(_keys(ways, True))).alias("key"))
        right = asked.select("notice_id", "open", F.explode(F.expr(_keys(ways, False))).alias("key"))
        pairs = attributed(left.join(right, "key").select("entry_id", "notice_id", "open").distinct())
        days_known = (F.col("e_low") == F.col("e_high")) & (F.col("n_low") == F.col("n_high"))
        found = pairs.select("entry_id", "notice_id", "open", days_known.alias("days_known"), "n_numbered", *(c.alias(a) for a, c in outcomes().items()))
        known, right_ = (F.col("days_known"), F.col("date").isin("day", "days")) if no == 0 else (F.col("n_numbered"), F.col("number").isNotNull())
        scored = found.select("entry_id", "notice_id", "open", F.round(said, 6).alias("bits"), F.coalesce(known, F.lit(False)).alias("known"), F.coalesce(right_, F.lit(False)).alias("right"))
        order = Window.partitionBy("notice_id", "open").orderBy(F.desc("bits"), "entry_id")
        ranked = scored.where(F.col("bits") >= least).withColumns({"nth": F.row_number().over(order), "second": F.lead("bits").over(order)})
        best = ranked.where("nth = 1").where(F.col("second").isNull() | (F.col("bits") - F.col("second") >= LEAD))
        # the plans of a rule are large, so they go before the next one's
        steps = [best.select("notice_id", "open", "entry_id", "known", "right", F.lit(no).alias("rule_no"))]
        del left, right, pairs, found, scored, ranked, best
        resolved.append(released(entries.sparkSession, steps.pop))
    tried = reduce(DataFrame.unionByName, resolved)
    sure = tried.where("known").groupBy("rule_no").agg(F.count("*").alias("n"), F.count_if("right").alias("k"))
    names = F.array(*(F.lit(rule) for rule, _ in RULES))
    confidence = (F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)
    return tried.where("open").join(F.broadcast(sure), "rule_no", "left").select("entry_id", "notice_id", names[F.col("rule_no")].alias("rule"), confidence.alias("confidence"))


def catalogue_attributes(catalogue: DataFrame) -> DataFrame:
    number = F.coalesce(F.nullif(F.trim("investigation_number"), F.lit("")), F.col("investigation_number_candidate"))
    return attributes(catalogue, "entry_id", "official_title", "accident_date", "location", number)


def notice_attributes(notices: DataFrame) -> DataFrame:
    return attributes(notices, "notice_id", "headline", "event_date", "place", F.col("file_ref"))
