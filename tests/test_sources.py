import datetime as dt
import json

import pytest

from tideline.sources import feeds

NOW = dt.datetime(2026, 8, 26)


def test_listings(spark, tmp_path):
    rows = [
        {"company_name": "Acme", "title": "Dev", "locations": ["Berlin", "Paris"], "url": "", "company_url": "https://a", "sponsorship": "Offers Sponsorship", "date_posted": 1767841111, "active": True},
        {"company_name": "Hid", "title": "Dev", "locations": "x", "is_visible": False},
        {"company_name": " ", "title": "Dev"},
        {"company_name": "One", "title": "Ops", "locations": "Rome"},
    ]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    got = feeds.listings_json(spark, str(tmp_path / "l.json"), "org/feed", NOW).orderBy("row_ord").collect()
    assert [(r.company, r.location, r.url, r.sponsorship_flag, r.date_posted) for r in got] == [
        ("Acme", "Berlin | Paris", "https://a", "yes", dt.date(2026, 1, 8)), ("One", "Rome", "", "unknown", None),
    ]


def test_pipe_table(spark, tmp_path):
    text = (
        "intro\n| Company | Role | Location | Application | Date |\n| --- | --- | --- | --- | --- |\n"
        '| **Acme** | 🛂 Dev | Berlin<br>Paris | <a href="https://x.example/1">go</a> | Aug 05 |\n'
        "| Shut | Dev | Rome | 🔒 | Aug 04 |\n| ↳ | Dev | Rome | [go](https://y) | Aug 04 |\n"
        "| Position | Company | Date |\n| Ops | Late | Aug 03 |\n"
    )
    (tmp_path / "t.md").write_text(text)
    got = feeds.pipe_table(spark, str(tmp_path / "t.md"), "org/table", NOW).orderBy("row_ord").collect()
    assert [(r.company, r.title, r.location, r.url, r.sponsorship_flag, r.date_posted.day) for r in got] == [
        ("Acme", "Dev", "Berlin | Paris", "https://x.example/1", "yes", 5), ("Late", "Ops", "Unspecified", "", "unknown", 3),
    ]


def test_a_table_over_many_tasks(spark, tmp_path):
    """Headers are carried over parts of files; order and rows are those of one task."""
    for f in range(2):
        rows = []
        for n in range(300):
            if n % 97 == 0:
                rows.append("| Company | Role | Location |" if n % 2 else "| Position | Note | Company |")
            rows.append(f"| a{n} | b{n} | c{n} |")
        (tmp_path / f"t{f}.md").write_text("before\n| x | y | z |\n" + "\n".join(rows) + ("\n" if f else ""))
    read = lambda: [(r.company, r.title, r.location) for r in feeds.pipe_table(spark, str(tmp_path / "t*.md"), "s", NOW).orderBy("row_ord", "company").collect()]
    one = read()
    assert len(one) == 600 and one[0] == one[1] == ("c0", "a0", "Unspecified") and one[200] == ("a100", "b100", "c100")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path / "t*.md")).rdd.getNumPartitions() > 8 and read() == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_boards_all_or_nothing(spark, tmp_path):
    job = {"id": 5, "title": "Dev", "location": {"name": "Germany (Remote) ; United States"}, "absolute_url": "https://g/5", "first_published": "2026-08-01T00:00:00-04:00"}
    lever = [{"id": "AB", "text": "Ops", "categories": {"location": "Rome", "allLocations": []}, "createdAt": 1767841111000, "hostedUrl": "https://l"}]
    ashby = {"jobs": [{"id": "X", "title": "A", "location": "Oslo", "secondaryLocations": [{"location": "Bergen"}], "jobUrl": "https://a"}, {"id": "Y", "title": "B", "isListed": False, "jobUrl": "https://b"}]}
    for kind, board, data in (("greenhouse", "good", {"jobs": [job]}), ("greenhouse", "bad", {"jobs": [job, {"id": 6}]}), ("lever", "l", lever), ("ashby", "a", ashby)):
        d = tmp_path / kind / f"board={board}"
        d.mkdir(parents=True)
        (d / "jobs.json").write_text(json.dumps(data))
    registry = spark.createDataFrame([("greenhouse", "good", "Good"), ("greenhouse", "bad", "Bad"), ("lever", "l", "L"), ("ashby", "a", "A")], "ats string, board string, name string")
    got = {r.ats_key: r for r in feeds.boards(spark, str(tmp_path), registry, NOW).collect()}
    assert set(got) == {"gh:5", "lever:ab", "ashby:x"}
    assert got["gh:5"].location == "Germany (Remote) | United States" and got["gh:5"].company == "Good" and got["gh:5"].region_only
    assert got["ashby:x"].location == "Oslo | Bergen" and got["lever:ab"].date_posted == dt.date(2026, 1, 8)


def test_missing_keys_are_told_from_nulls(spark, tmp_path):
    """What a field says is what Python's truth of it is; a missing one counts as yes."""
    values = [None, False, True, 0, 1, 0.0, 0.5, "", "false", [], [0], {}, {"a": None}, "0"]
    rows = [{"company_name": f"c{i}", "title": "T", "active": v} for i, v in enumerate(values)] + [{"company_name": "none", "title": "T"}]
    rows += [{"company_name": f"v{i}", "title": "T", "is_visible": v} for i, v in enumerate(values)]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    got = {r.company: r.active for r in feeds.listings_json(spark, str(tmp_path / "l.json"), "f", NOW).collect()}
    assert {c: a for c, a in got.items() if c[0] == "c"} == {f"c{i}": bool(v) for i, v in enumerate(values)} and got["none"]
    assert {c for c in got if c[0] == "v"} == {f"v{i}" for i, v in enumerate(values) if v is not False}
    d = tmp_path / "ashby" / "board=a"
    d.mkdir(parents=True)
    jobs = [{"id": f"J{i}", "title": "T", "jobUrl": "u", "isListed": v} for i, v in enumerate(values)] + [{"id": "none", "title": "T", "jobUrl": "u"}]
    (d / "jobs.json").write_text(json.dumps({"jobs": jobs}, indent=1))
    registry = spark.createDataFrame([("a", "A")], "board string, name string")
    listed = {r.key: r.listed for r in feeds.ashby_jobs(spark, str(tmp_path / "ashby"), registry, NOW).collect()}
    assert listed == {f"j{i}": bool(v) for i, v in enumerate(values)} | {"none": True}


def test_a_job_without_categories_drops_its_board(spark, tmp_path):
    job = {"id": "A", "text": "Ops", "categories": {"location": "Rome"}, "hostedUrl": "https://l"}
    for board, other in (("good", {"categories": {}}), ("bare", {"categories": None}), ("less", {})):
        d = tmp_path / "lever" / f"board={board}"
        d.mkdir(parents=True)
        (d / "jobs.json").write_text(json.dumps([job, {"id": "B", "text": "Dev", "hostedUrl": "https://m", **other}]))
    registry = spark.createDataFrame([("lever", b, b) for b in ("good", "bare", "less")], "ats string, board string, name string")
    got = feeds.boards(spark, str(tmp_path), registry, NOW).collect()
    assert {(r.seed_group, r.ats_key, r.location) for r in got} == {("ats/lever/good", "lever:a", "Rome"), ("ats/lever/good", "lever:b", "Unspecified")}
    jobs = feeds.lever_jobs(spark, str(tmp_path / "lever"), registry.drop("ats"), NOW)
    assert sorted(r.board for r in feeds.quarantined_boards(jobs).collect()) == ["bare", "less"]


def test_empty_union(spark):
    empty = spark.createDataFrame([], "id string")
    with pytest.raises(ValueError):
        feeds.union_sources([empty, empty])


def test_bad_source_is_skipped(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"company_name": "One", "title": "Ops", "locations": "Rome"}]))
    configs = [{"name": "a", "adapter": "listings_json", "path": str(tmp_path / "l.json")}, {"name": "b", "adapter": "pipe_table", "path": str(tmp_path / "none.md")}]
    rows, failed = feeds.read_sources(spark, configs, NOW)
    assert [r.company for r in rows.collect()] == ["One"] and list(failed) == ["b"]
    with pytest.raises(ValueError):
        feeds.read_sources(spark, configs[1:], NOW)


def test_listings_fail_loudly_and_skip_what_is_no_object(spark, tmp_path):
    good = json.dumps([1, {"company_name": "One", "title": "Ops", "locations": ["A", "B"]}, "x", None, {"company_name": "Two", "title": "Dev"}])
    for name, text in (("mixed", good), ("cut", good[:-20]), ("object", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    assert [r.company for r in feeds.listings_json(spark, str(tmp_path / "mixed.json"), "s", NOW).orderBy("row_ord").collect()] == ["One", "Two"]
    configs = [{"name": n, "adapter": "listings_json", "path": str(tmp_path / f"{n}.json")} for n in ("cut", "mixed", "object")]
    rows, failed = feeds.read_sources(spark, configs, NOW)
    assert sorted(failed) == ["cut", "object"] and rows.count() == 2


def test_pipe_table_rows(spark, tmp_path):
    text = (
        "| Company Size | Company | Role | Location |\n|---|---|---|---|\n| | Dev | Rome | x |\n"
        "|  Acme Company | Role Lead | Oslo | Bergen |\n| short | row |\n| A | Co | Boss | |\n"
    )
    (tmp_path / "t.md").write_text(text)
    (tmp_path / "none.md").write_text("no table\n")
    got = feeds.pipe_table(spark, str(tmp_path / "t.md"), "t", NOW).orderBy("row_ord").collect()
    # the first cell that names a company is the company's, though another one says nothing else
    assert [(r.company, r.title, r.location) for r in got] == [("Acme Company", "Oslo", "Bergen"), ("A", "Boss", "Unspecified")]
    with pytest.raises(ValueError):
        feeds.pipe_table(spark, str(tmp_path / "none.md"), "t", NOW)
    (tmp_path / "unclear.md").write_text("| Company Role | Company |\n| a | b |\n")
    with pytest.raises(Exception, match="no columns"):
        feeds.pipe_table(spark, str(tmp_path / "unclear.md"), "t", NOW).collect()


def test_unreadable_boards_are_quarantined(spark, tmp_path):
    job = {"id": "a5", "title": "Dev", "absolute_url": "https://g/5"}
    for board, text in (("good", json.dumps({"jobs": [job]})), ("empty", '{"jobs": []}'), ("cut", json.dumps({"jobs": [job]})[:-9]), ("other", '{"error": 1}')):
        d = tmp_path / "greenhouse" / f"board={board}"
        d.mkdir(parents=True)
        (d / "jobs.json").write_text(text)
    registry = spark.createDataFrame([(b, b) for b in ("good", "empty", "cut", "other")], "board string, name string")
    jobs = feeds.greenhouse_jobs(spark, str(tmp_path / "greenhouse"), registry, NOW)
    assert sorted(r.board for r in feeds.quarantined_boards(jobs).collect()) == ["cut", "other"]
    assert [r.ats_key for r in feeds._board(jobs, "greenhouse", 0).collect()] == ["gh:a5"]


def test_cards_and_cutoffs(spark):
    from tideline.operators import reports, state

    rows = spark.createDataFrame([("Acme", "Dev", "Rome", "listed", "https://x", dt.date(2026, 8, 5), "a/b"), ("B", None, None, "region", "x", None, "c")], "company string, title string, location string, tier string, url string, date_posted date, source_repo string")
    a, b = [r.card for r in reports.cards(rows).orderBy("company").collect()]
    assert a.title == "Acme — Dev" and a.description == "📍 Rome · 🛂 Known H-1B employer · _listed · a/b_" and a.footer == "Posted 08/05/2026" and a.url == "https://x"
    assert b.title == "B — Unknown role" and b.description == "📍 Unspecified · _region · c_" and b.footer == "Posted unknown date" and b.url is None
    assert reports.parse_cutoff("07312026") == reports.parse_cutoff("2026-07-31") == dt.date(2026, 7, 31)
    assert reports.since(rows, "08052026").count() == 1 and reports.since(rows, "2026-08-06").count() == 0
    assert state.migrated_groups(spark, ["a", "b"], True).count() == 2 and state.migrated_groups(spark, ["a"], False).isEmpty()
