"""Templates: what counts as one placeholder, short items, hot windows; and the SQL twin on awkward tables."""

import duckdb
import numpy as np
from lumenframe.llm import decontamination, queries

ITEM = "a train leaves the station with Maria at 9 and travels 120 km before it meets 3.5 other trains near the old bridge"
BENCH = [
    (10, ITEM),
    (11, "What is the capital of France?"),
    (12, "12 13"),
    (13, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
    (14, None),
    (15, ""),
    (16, "round and round it goes round and round it goes round and round it goes and stops"),
    (None, ITEM),
]
DOCS = [
    (1, ITEM.replace("120 km", "1,200 kilometers").replace("Maria", "Ana Lucia Perez").replace("3.5", "7")),
    (2, f"Intro. {ITEM} And then {ITEM.replace('120', '80').replace('9', '7')} the end"),
    (3, "We asked: what is the capital of france? Nobody knew."),
    (4, " ".join(str(x) for x in range(100, 3100))),
    (5, "x " + " ".join(str(x) for x in range(0, 40))),
    (6, "They say round and round it goes round and round it goes round and round it goes and stops here"),
    (7, None),
    (8, ""),
    (9, "capital of France"),
    (11, " ".join(f"word{i}" for i in range(20_000)) + " " + ITEM),
    (12, "12 13"),
    (13, "so " + "Ab " * 100_000 + "1,2." * 100_000),
    (None, ITEM),
]


def _run(spark, docs, bench, share=0.3):
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, h string, at int")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, w int")
    return sorted(map(tuple, decontamination.contaminated(d, b, 8, share).collect()))


def test_placeholders_short_items_and_values(spark):
    got = {(d, i): k for d, i, _, _, k in _run(spark, DOCS, BENCH)}
    assert got == {(1, 10): "reparameterised", (2, 10): "exact", (3, 11): "exact", (5, 13): "exact", (6, 16): "exact", (11, 10): "exact"}


NAMES = "Tom Smith has 5 red apples and Ann has 7 green pears so how many fruits do they hold together before lunch"
LEADS = "Maria leaves the harbour at noon and rows to the island of her uncle. Maria stays there for seven days with twelve workers and rows home"
MORE = [(20, NAMES), (21, LEADS), (22, "Twelve workers build a wall in seven days and then rest for three weeks in the mountains")]


def test_copies_in_other_case(spark):
    docs = [(1, NAMES.lower()), (2, NAMES.upper()), (3, "see: " + NAMES.title()), (4, NAMES.lower().replace("5", "9").replace("7", "8")), (5, LEADS.upper())]
    got = {(d, i): k for d, i, _, _, k in _run(spark, docs, MORE)}
    assert got == {(1, 20): "exact", (2, 20): "exact", (3, 20): "exact", (4, 20): "reparameterised", (5, 21): "exact"}


def test_names_at_the_beginning_and_numbers_in_words(spark):
    changed = LEADS.replace("Maria", "Peter")
    docs = [
        (1, changed),
        (2, LEADS),
        (3, LEADS.replace("Maria stays", "Peter stays")),
        (4, MORE[2][1].replace("Twelve", "Nine").replace("seven", "16").replace("three", "five")),
        (5, MORE[2][1].replace("Twelve workers", "TWELVE workers")),
        (6, "Then " + changed.replace("seven", "three")),
    ]
    rows = {(d, i): (n, m, k) for d, i, n, m, k in _run(spark, docs, MORE)}
    assert {p: k for p, (_, _, k) in rows.items()} == {(1, 21): "reparameterised", (2, 21): "exact", (3, 21): "exact", (4, 22): "reparameterised", (5, 22): "exact", (6, 21): "reparameterised"}
    assert rows[1, 21][0] == rows[1, 21][1] and rows[4, 22][0] == rows[4, 22][1]  # every window
    assert rows[3, 21][0] < rows[3, 21][1]  # the item's own values alone


def test_windows_of_many_items_meet_only_what_shares_a_rare_one(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("w" + "".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    same = "read the following question with care and mark the one right answer below"
    bench = [(i, f"{same} {text(40)}") for i in range(200)]
    docs = [(1, same), (2, f"{text(20)} {same} {text(20)}"), *((10 + i, bench[i][1]) for i in range(5))]
    words = lambda rows, key: decontamination._words(spark.createDataFrame(rows, f"{key} long, text string"), key)
    asked = decontamination._asked(words(bench, "item_id"), 8, 0.3)
    assert decontamination.meetings(words(docs, "doc_id"), asked, 8).select("doc_id", "item_id").distinct().count() == 5
    assert {(d, i) for d, i, *_ in _run(spark, docs, bench)} == {(10 + i, i) for i in range(5)}
    assert {i for d, i, *_ in _run(spark, [(1, same)], [(i, f"{same} {text(4)}") for i in range(30)]) if d == 1} == set(range(30))  # shared, but enough


def test_sql_twin(spark, tmp_path):
    # without document 13: the twin's time grows with the square of a text's words
    rng = np.random.default_rng(3)
    words = ["the", "Train", "7", "12.5", "Maria", "km", "old", "and", "x,", "Then.", "9 km", "1,000", "Ana Lopez", "seven", "Twelve", "DAYS", "days"]
    docs = [*((d, t) for d, t in DOCS if d and d != 13), *((100 + i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(60))]
    bench = [*BENCH[:-1], *((100 + i, " ".join(rng.choice(words, rng.integers(2, 16)))) for i in range(40))]
    docs += [(500 + i, f"{docs[-i][1]} so {bench[-i][1]} so") for i in range(1, 30)]
    docs += [(600 + i, bench[-i][1].lower() if i % 2 else bench[-i][1].upper()) for i in range(1, 30)]
    docs += [(700, LEADS.replace("Maria", "Peter")), (701, NAMES.upper()), (702, LEADS.replace("seven", "ten")), (703, "\x01m \x01nseven " + NAMES)]
    bench += MORE
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, item_id, n_windows, item_windows, kind FROM ({queries.SQL['op10_template_decontamination']})").fetchall())
    assert _run(spark, docs, bench) == want and len(want) > 30
