"""Order-dependent databook operators against plain Python on random rows."""

import random

import pytest

from pyspark.sql import functions as F

from reportloom.functions.scale import previous_values, ranked, running_total
from reportloom.operators import databook


def by_hand_order(periods):
    """Row names of lists of rows: a new row goes right after the one before it, else to the end."""
    names, seen = [], {}
    for number, rows in enumerate(periods):
        before = None
        for row in rows:
            if not row:
                continue
            key = row.lower()
            if key not in seen:
                seen[key] = row
                if number and before:
                    names.insert(names.index(seen[before]) + 1, row)
                else:
                    names.append(row)
            before = key
    return names


def ordered(spark, groups, **limits):
    rows = [
        (company, "s", p, r, name)
        for company, periods in groups.items() for p, names in enumerate(periods) for r, name in enumerate(names)
    ]
    df = spark.createDataFrame(rows, "company_id int, statement string, period_no int, row_no int, name string")
    out = databook.statement_order(df, **limits).orderBy("company_id", "position").collect()
    return {c: [r["label"] for r in out if r["company_id"] == c] for c in groups}


def test_statement_order(spark):
    draw = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRST"
    groups = {
        0: [["A", "B", "C"], ["A", "X", "B"]],
        1: [["A", "B", "C"], ["A", "X", "B"], ["Z", "C"]],
        2: [[], ["A", "B", "A", "C"]],
        3: [["A"], ["A", "x1", "x2", "x1", "y", "", "x2", "z"], ["x2", "w", "v"], ["w", "u", "A", "t"]],
    }
    for company in range(4, 24):
        groups[company] = [
            [draw.choice(letters) for _ in range(draw.randint(0, 12))] for _ in range(draw.randint(1, 6))
        ]
    want = {c: by_hand_order(p) for c, p in groups.items()}
    assert ordered(spark, groups) == want
    assert ordered(spark, groups, at_once=0) == want and ordered(spark, groups, at_once=9) == want
    assert want[0] == ["A", "X", "B", "C"] and want[1] == ["A", "X", "B", "C", "Z"]


@pytest.mark.parametrize("kind", ["line", "turned"])
def test_a_long_chain_is_ranked_in_few_rounds(spark, monkeypatch, kind):
    """Every name hangs on the one before it, as deep as a forest can be."""
    count = 20_000
    if kind == "line":  # the second period goes down from the first row
        periods = [["n0"], [f"n{i}" for i in range(count)]]
    else:  # each period puts a name right after the same row
        periods = [["n0"]] + [["n0", f"n{i}"] for i in range(1, 300)]
    stored = []
    cut = databook.cut_lineage
    monkeypatch.setattr(databook, "cut_lineage", lambda df: stored.append(1) or cut(df))
    want = by_hand_order(periods)
    assert ordered(spark, {1: periods}, at_once=100)[1] == want
    assert len(stored) < 25


def test_every_row_once(spark):
    out = ordered(spark, {0: [["A", "B"], ["b", "A", "C (MSEK)"], ["c"]]})
    assert [x.lower() for x in out[0]] == ["a", "c (msek)", "b"] or sorted(x.lower() for x in out[0]) == ["a", "b", "c (msek)"]


def bullets(text):
    marks = ("• ", "- ", "* ", "– ")
    lines = [x.strip() for x in text.split("\n")]
    return {x[2:52].lower().strip() for x in lines if x.startswith(marks) and x[2:52].strip()}


def sentence(text):
    for line in (x.strip() for x in text.split("\n")):
        if len(line) > 50 and ("." in line or "•" in line):
            return line[:100].lower().replace(" ", "")
    return ""


def same_content(a, b):
    x, y = bullets(a), bullets(b)
    if x and y:
        common = len(x & y)
        if common >= 3 or common / min(len(x), len(y)) > 0.7:
            return True
    return bool(sentence(a)) and sentence(a) == sentence(b)


def first_wins(rows):
    want, titles, contents = set(), {}, {}
    for company, number, title, _, content in sorted(rows, key=lambda r: r[:2]):
        if any(same_content(content, c) for c in contents.setdefault(company, [])):
            continue
        if title and title not in titles.setdefault(company, set()):
            titles[company].add(title)
            contents[company].append(content)
            want.add((company, number))
    return want


def unique(spark, rows, **limits):
    df = spark.createDataFrame(rows, "company_id int, section_no int, title string, page int, content string")
    return {(r["company_id"], r["section_no"]) for r in databook.unique_sections(df, **limits).collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_unique_sections_over_several_blocks(spark, seed):
    draw = random.Random(seed)
    rows = []
    for company in range(6):
        for number in range(80):
            picked = draw.sample(range(24), draw.choice([0, 1, 1, 2, 2, 3, 4, 6, 9]))
            lead = f"Mening {draw.randint(0, 40)} som är lång nog för att räknas som en mening i texten."
            lines = [f"• punkt {i * i}" for i in picked] + ([lead] if draw.random() < 0.4 else [])
            rows.append((company, number * 3, f"t{draw.randint(0, 120)}", number % 9, "\n".join(lines)))
    want = first_wins(rows)
    assert unique(spark, rows, block_weight=60) == want == unique(spark, rows)


def test_a_chain_of_sections_and_many_shared_bullets(spark):
    """Each section is the rival of the next one only; two more share a thousand bullets."""
    rows = [(1, i, f"t{i}", 1, f"• länk {i}\n• länk {i + 1}\n• a{i // 2}\n• b{(i + 1) // 2}\n• c{i // 2}\n• d{(i + 1) // 2}\n• e{i // 2}\n• f{(i + 1) // 2}") for i in range(3000)]
    shared = "\n".join(f"• gemensam punkt {i}" for i in range(1000))
    rows += [(2, 1, "first", 1, shared), (2, 2, "second", 1, shared + "\n• egen"), (2, 3, "third", 1, "• gemensam punkt 7\n• ny"), (2, 4, "fourth", 1, "• gemensam punkt 7")]
    want = {(1, i) for i in range(0, 3000, 2)} | {(2, 1), (2, 3)}
    assert unique(spark, rows) == want
    assert unique(spark, rows, block_weight=9000) == want


def test_unique_sections(spark):
    draw = random.Random(3)
    rows = []
    for company in range(8):
        for number in range(60):
            picked = draw.sample(range(14), draw.randint(0, 6))
            lead = f"Mening {draw.randint(0, 25)} som är lång nog för att räknas som en mening i texten."
            lines = [f"• punkt {i}" for i in picked] + ([lead] if draw.random() < 0.5 else [])
            rows.append((company, number, draw.choice(["", *"abcdefghijklmnopqrstuvwxyz"]), number % 9, "\n".join(lines)))
    want = set()
    for company in range(8):
        titles, contents = set(), []
        for _, number, title, _, content in (r for r in rows if r[0] == company):
            if any(same_content(content, c) for c in contents):
                continue
            if title and title not in titles:
                titles.add(title)
                contents.append(content)
                want.add((company, number))
    df = spark.createDataFrame(rows, "company_id int, section_no int, title string, page int, content string")
    got = {(r["company_id"], r["section_no"]) for r in databook.unique_sections(df).collect()}
    assert got == want and len(want) > 40


def test_unique_by_title(spark):
    draw = random.Random(5)
    alphabets = ["abcdef", "ghijkl", "abcxyz", "mnopq ", "åäö"]
    rows = [
        (number % 3, draw.choice(["t", "u"]), number,
         "".join(draw.choice(draw.choice(alphabets)) for _ in range(draw.choice([0, 5, 40, 180, 260]))))
        for number in range(150)
    ]

    def likeness(a, b):
        s1, s2 = a[:200].lower().replace(" ", ""), b[:200].lower().replace(" ", "")
        return sum(c in s2 for c in s1) / max(len(s1), len(s2)) if s1 and s2 else 0

    kept, want = {}, set()
    for company, title, number, content in rows:
        group = kept.setdefault((company, title), [])
        if not any(likeness(content, c) > 0.8 for c in group):
            group.append(content)
            want.add((company, number))
    df = spark.createDataFrame(rows, "company_id int, title string, section_no int, content string")
    for limits in ({}, {"block": 1}, {"block": 3}):
        got = {(r["company_id"], r["section_no"]) for r in databook.unique_by_title(df, **limits).collect()}
        assert got == want, limits
    assert databook.unique_by_title(df, threshold=1.0).count() == len(rows)


def test_table_dump(spark):
    schema = """company_id int, period string, period_no int, id int, table_type string, title string, page_number int,
      columns array<string>, rows array<struct<label:string,values:array<string>,type:string>>"""
    rows = [
        (1, "Q1 2024", 0, 1, "kpi", "A", 3, ["MSEK", "Note", "2024", "2023"], [("x", [None, "n1", "5", "6"], "data")]),
        (1, "Q1 2024", 0, 2, "kpi", "B", None, ["", "Not", "2024"], [("y", [None, "7", "8", "9"], "data"), ("z", [None, "1"], None)]),
        (1, "Q1 2024", 0, 3, "note", "C", 1, ["", "2024"], [("w", [None, "1"], "data")]),
        (1, "Q1 2024", 0, 4, "other", "D", 0, ["2024"], [("v", [], "data")]),
        (1, "Q1 2024", 0, 5, "other", "E", 2, ["MSEK", "TSEK", "2024"], [("u", [None, "5"], "data")]),
    ]
    def dump(rows, **options):
        out = databook.table_dump(spark.createDataFrame(rows, schema), **options).orderBy("id", "row_no", "cell_no").collect()
        return [(r["id"], r["table_title"], r["label"], r["header"], r["value"]) for r in out]

    whole = dump(rows)
    assert (2, "B", "y", None, "9") in whole and (3, "C (s. 1)", "w", "2024", "1") in whole
    bare = [(1, "Q1 2024", 0, 6, "kpi", None, 4, ["", "2024", "2023"], []), (1, "Q1 2024", 0, 7, "annat", "", None, None, None)]
    assert dump(bare) == [
        (6, "Nyckeltal (s. 4)", None, "2024", None), (6, "Nyckeltal (s. 4)", None, "2023", None), (7, "Övrigt", None, None, None)]
    assert dump(rows, known_types_only=True, clip=True) == [
        (1, "A (s. 3)", "x", "2024", "5"), (1, "A (s. 3)", "x", "2023", "6"),
        (2, "B", "y", "2024", "8"), (2, "B", "z", None, None),
        (4, "D", "v", None, None),
        (5, "E (s. 2)", "u", "2024", "5"),
    ]


def test_scale_helpers(spark):
    draw = random.Random(1)
    rows = [(k, p, draw.randint(0, 9)) for k in range(3) for p in draw.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "k int, p int, x int")
    total = running_total(df, ["k"], "p", {"x": "before"}, width=7).collect()
    last = {(r["k"], r["p"]): r["prev"] for r in previous_values(df, ["k"], "p", {"x": "prev"}, width=7).collect()}
    for r in total:
        earlier = sorted(q for q in rows if q[0] == r["k"] and q[1] < r["p"])
        assert r["before"] == sum(q[2] for q in earlier)
        assert last[r["k"], r["p"]] == (earlier[-1][2] if earlier else None)
    place = {(r["k"], r["p"]): r["place"] for r in ranked(df, ["k"], ["p"], "place").collect()}
    for k in range(3):
        own = sorted(p for q, p, _ in rows if q == k)
        assert [place[k, p] for p in own] == list(range(1, len(own) + 1))


def test_notes_and_captions(spark):
    notes = spark.createDataFrame(
        [(1, 3, "Ny", 2, "b"), (1, 3, "Först", 0, "a")], "company_id int, number int, title string, period_no int, body string"
    )
    assert [tuple(r) for r in databook.latest_notes(notes).collect()] == [(1, 3, "Först", "b", 2)]
    charts = spark.createDataFrame(
        [(1, "Q1 2024", 1, None, None, None, [])],
        "company_id int, period string, id int, title string, y_axis string, estimated boolean, "
        "data_points array<struct<label:string,value:double>>",
    )
    row = databook.chart_rows(charts).first()
    assert (row["title"], row["caption"], row["label"]) == ("Graf", "Q1 2024 | Uppskattade värden", "")
    assert charts.select(F.size("data_points")).first()[0] == 0
