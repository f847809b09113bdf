"""Matching and dispatch on literal rows."""

from pyspark.sql import functions as F

from docmill.operators import dispatch, matching as M


def test_fuzzy_titles(spark):
    titles = spark.createDataFrame([("c", "expert report", 0), ("c", "claim", 1), ("c", "claim", 2), ("d", "claims", 0), ("c", None, 3)], "case string, title string, pos int")
    asked = spark.createDataFrame([("c", 1, "clam"), ("c", 2, "zzz"), ("e", 3, "claim"), ("c", 4, "Expert reports"), ("c", 5, None)], "case string, id int, candidate string")
    got = {r.id: (r.title, r.ratio and round(r.ratio, 3)) for r in M.fuzzy_titles(asked, titles, "case", "id", "candidate", "title", "pos").collect()}
    assert got == {1: ("claim", 0.889), 2: (None, None), 3: (None, None), 4: ("expert report", 0.889), 5: (None, None)}


def test_copies_of_titles_and_candidates_make_no_more_pairs(spark):
    names = ["large ring", "large bolt", "small ring", None, ""]
    said = ["large rimg", "small ring", "smoll bolt", "qqq", None]
    one = lambda xs, of: spark.createDataFrame([("c", x, i * len(xs) + j) for i in range(of) for j, x in enumerate(xs)], "case string, text string, n int")
    frames = lambda of: (one(said, of).withColumnsRenamed({"text": "candidate", "n": "id"}), one(names, of).withColumnsRenamed({"text": "title", "n": "pos"}))
    args = ("case", "id", "candidate", "title", "pos")
    sizes = [M.could_match(asked.dropDuplicates(["case", "candidate"]), titles, *args).count() for asked, titles in (frames(1), frames(20))]
    assert sizes[0] == sizes[1]
    plain = {r.id: (r.title, r.ratio) for r in M.fuzzy_titles(*frames(1), *args).collect()}
    many = {r.id: (r.title, r.ratio) for r in M.fuzzy_titles(*frames(20), *args).collect()}
    assert many == {i: plain[i % 5] for i in range(100)} and plain[1] == ("small ring", 1.0) and plain[3] == (None, None)
    twice = spark.createDataFrame([("c", 1, "small ring"), ("c", 1, "large bolx"), ("c", 2, "large bolx")], "case string, id int, candidate string")
    found = sorted((r.id, r.title) for r in M.fuzzy_titles(twice, frames(1)[1], *args).collect())
    assert found == [(1, "small ring"), (1, "small ring"), (2, "large bolt")]


def test_defendant_ranks(spark):
    who, memo = "المدعى عليه", "مذكرة دفاع"
    rows = [
        (1, "مذكرة", who, memo, 0), (1, "مذكرة الثاني", who, memo, 1), (1, "رد الثاني", who, memo, 2), (1, "المدعى عليها الأولى", who, memo, 3),
        (1, "مذكرة", who, memo, 4), (1, "صحيفة", who, "صحيفة دعوى", 5), (2, "وحيدة", who, memo, 6), (1, "x", "المدعي", memo, 7),
    ]
    df = spark.createDataFrame(rows, "case int, doc string, party string, kind string, pos int")
    got = [r.party for r in M.defendant_ranks(df, "case", "doc", "party", "kind", "pos").orderBy("pos").collect()]
    assert got == [f"{who} الثالث", f"{who} الثاني", f"{who} الرابع", "المدعى عليها الأولى", f"{who} الثالث", who, who, "المدعي"]


def test_absent_party_note(spark):
    long = "الأول يدفع " + "نص " * 30
    df = spark.createDataFrame([(long, ["الأول", "المحكمة"]), ("الأول قصير", ["الأول"]), (long, []), (long + M.DISCLAIMER, ["الأول"])], "t string, p array<string>")
    got = [r.n for r in df.select(M.absent_party_note(F.col("t"), F.col("p")).alias("n")).collect()]
    assert got[0].endswith(f"{M.CORRECTION} الأول: {M.DISCLAIMER}") and got[0].count(M.CORRECTION) == 1
    assert got[1:] == ["الأول قصير", long, long + M.DISCLAIMER]


def test_sourced_sentences(spark):
    df = spark.createDataFrame([([("a", ["x"]), ("b", []), ("c", ["y"])],)], "s array<struct<text:string,sources:array<string>>>")
    assert df.select(M.sourced_sentences(F.col("s")).alias("t")).first().t == "a c"


def test_tiers(spark):
    asked = spark.createDataFrame([(1, ["law", "reason", "magic", "law"]), (2, ["law"])], "id int, agents array<string>")
    law = lambda df: df.select("id", F.lit("L").alias("response"), F.lit(None).cast("string").alias("error"))
    reason = lambda df: df.select("id", F.get("earlier", F.lit(0))["response"].alias("response"), F.lit(None).cast("string").alias("error"))
    got = {(r.id, r.agent, r.response, r.error) for r in dispatch.run_tiers(asked, [{"law": law}, {"reason": reason}], "id", "agents").collect()}
    assert got == {(1, "law", "L", None), (2, "law", "L", None), (1, "reason", "L", None), (1, "magic", "", "unknown agent: magic")}
