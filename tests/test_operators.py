import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import keywords, screens, state
from tideline.plans import pipelines

NOW = dt.datetime(2026, 8, 26)


def test_greedy_dedupe_equals_fold(spark):
    rng = random.Random(4)
    rows = [(n, f"i{rng.randrange(60)}", rng.choice([None, f"k{rng.randrange(60)}"])) for n in range(300)]
    ids, keys, kept = set(), set(), []
    for n, i, k in rows:
        if i not in ids and (k is None or k not in keys):
            kept.append(n)
            ids.add(i)
            keys.add(k)
    df = spark.createDataFrame(rows, "ord int, id string, ats_key string").repartition(5)
    assert sorted(r.ord for r in state.greedy_dedupe(df, "id", "ats_key", "ord").collect()) == kept


def _folded(rows):
    ids, keys, kept = set(), set(), []
    for n, i, k in rows:
        if i not in ids and (k is None or k not in keys):
            kept.append(n)
            ids.add(i)
            keys.add(k)
    return kept


def _rounds_of(spark, monkeypatch, rows):
    """Kept rows, and how many rounds over open rows it took."""
    rounds, plain = [], state._round
    monkeypatch.setattr(state, "_round", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame(rows, "ord int, id string, ats_key string").repartition(5)
    return sorted(r.ord for r in state.greedy_dedupe(df, "id", "ats_key", "ord").collect()), len(rounds)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each row shares its id with the one before or its key with the one after: rounds alone would take 25,000."""
    rows = [(n, f"i{(n + 1) // 2}", f"k{n // 2}") for n in range(100_000)]
    assert _rounds_of(spark, monkeypatch, rows) == (_folded(rows), 1)


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(state, "FOLD_ROWS", 6)
    rows = [(n, f"i{(n + 1) // 2}", f"k{n // 2}") for n in range(20)] + [(100 + n, f"x{(n + 1) // 2}", f"y{n // 2}" if n != 2 else None) for n in range(6)]
    kept, rounds = _rounds_of(spark, monkeypatch, rows)
    assert kept == _folded(rows) and rounds > 2


def test_dedupe_of_hot_groups_and_nulls(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(n, rng.choice(["hot", None, f"i{rng.randrange(400)}"]), rng.choice([None, "warm", f"k{rng.randrange(400)}"])) for n in range(3000)]
    kept, rounds = _rounds_of(spark, monkeypatch, rows)
    assert kept == _folded(rows) and rounds < 12


def test_prefix_semi(spark):
    df = spark.createDataFrame([("Amazon Web Services",), ("Johns Amazon",), ("The Boeing Company",), (None,)], "company string")
    names = spark.createDataFrame([("Amazon",), ("Boeing",)], "n string")
    got = {r.company: r.listed for r in screens.prefix_semi(df, "company", names).collect()}
    assert got["Amazon Web Services"] and got["The Boeing Company"] and not got["Johns Amazon"]


REGION = {"countries": ("germany",), "cities": (), "remote": (), "exclude": ()}


def postings(spark, *rows):
    schema = "ord int, id string, ats_key string, seed_group string, company string, title string, location string, sponsorship_flag string, active boolean, date_posted date, region_only boolean"
    return spark.createDataFrame([(n, f"p{n}", None, g, "Co", t, loc, flag, True, dt.date(2026, 8, n + 1), ro) for n, (g, t, loc, flag, ro) in enumerate(rows)], schema)


def test_first_decisive(spark):
    df = postings(
        spark, ("a", "x", "Austin, TX | Berlin, Germany", "no", False), ("a", "x", "Austin, TX | Berlin, Germany", "no", True),
        ("a", "x", "Austin, TX | Germany", "unknown", False), ("a", "intern", "Germany", "yes", False), ("a", "x", "", "yes", False),
    )
    got = [r.outcome for r in screens.match_postings(df, REGION, {"exclude_title_patterns": ["intern"]}).orderBy("ord").collect()]
    assert got == ["refused", "region", "region", "title", "rejected"]


def test_incremental_run_is_idempotent(spark):
    df = postings(spark, ("a", "x", "Germany", "yes", False), ("a", "y", "Germany", "yes", False), ("b", "z", "Germany", "yes", False), ("a", "w", "Lima", "yes", False))
    seen = spark.createDataFrame([], "id string, first_seen timestamp, company string, title string, ats_key string, seeded boolean")
    groups = spark.createDataFrame([("a",)], "seed_group string")
    one = pipelines.incremental_run(df, seen, groups, REGION, {"max_notifications_per_run": 1}, NOW)
    assert [r.id for r in one.notify.collect()] == ["p1"] and [r.id for r in one.deferred.collect()] == ["p0"]
    assert [r.id for r in one.silent.collect()] == ["p2"] and {r.seed_group for r in one.groups.collect()} == {"a", "b"}
    two = pipelines.incremental_run(df, one.seen, one.groups, REGION, {}, NOW)
    assert [r.id for r in two.notify.collect()] == ["p0"] and two.silent.isEmpty()
    assert pipelines.incremental_run(df, two.seen, two.groups, REGION, {}, NOW).notify.isEmpty()
    with pytest.raises(ValueError):
        pipelines.incremental_run(df.limit(0), seen, groups, REGION, {}, NOW)


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.read_state(spark, path, "id string").isEmpty()
    state.write_state(spark.createDataFrame([("a",)], "id string"), path, "1")
    now = state.read_state(spark, path, "id string")
    state.write_state(now.union(spark.createDataFrame([("b",)], "id string")), path, "2")
    assert sorted(r.id for r in state.read_state(spark, path, "id string").collect()) == ["a", "b"]


def test_section_keywords(spark):
    text = (
        "<h2>Requirements</h2><ul><li>Python and REST services</li><li>Go would be a plus</li></ul><h2>Nice to have</h2><p>Kubernetes, k8s</p>"
        "<h2>Benefits</h2><p>Rust club</p>"
    )
    docs = spark.createDataFrame([(1, text, "Acme"), (2, text.replace("<", "&lt;").replace(">", "&gt;"), " rest ")], "doc int, text string, employer string")
    vocab = ["Python", "REST", "Go", "Kubernetes", "Rust"]
    found = keywords.section_keywords(docs, vocab, {"Kubernetes": ["k8s"]}, {"Kubernetes": {"implies": ["Docker", "Go"]}}, employer="employer")
    got = {(r.doc, r.term): (r.weight, r.source) for r in found.collect()}
    assert got[1, "Python"] == (1.0, "exact") and got[1, "Go"] == (0.5, "exact") and got[1, "Kubernetes"] == (0.65, "exact")
    assert got[1, "Docker"] == (0.325, "inferred") and (1, "Rust") not in got
    assert {t for d, t in got if d == 2} == {t for d, t in got if d == 1} - {"REST"}


def test_hits_by_brute_force(spark):
    """Weights of whole tables against regular expressions, one for each spelling, over the same clauses."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS doc", "text")
    docs = docs.union(spark.createDataFrame([(-1, "Go, go C++ and .NET; ASP.NET is not c++. Machine learning and learning - machine learning"), (-2, "R R#; R+ r"), (-3, None)], "doc long, text string"))
    vocab, aliases = ["the", "Go", "C++", ".NET", "ML", "R", "und der", "trash", "de"], {"ML": ["machine learning", "learning"], "the": ["The"]}
    by_doc = {}
    for r in keywords.clauses(docs).collect():
        by_doc.setdefault(r.doc, []).append((r.clause, r.weight))
    wanted = {}
    for doc, parts in by_doc.items():
        for term in vocab:
            places = {}
            for s in {term, *aliases.get(term, ())}:
                rx = re.compile(r"(?<![\w+#])" + re.escape(s) + r"(?![\w+#])", 0 if s.isupper() or len(s) <= 3 else re.I)
                places |= {(i, m.start()): w for i, (c, w) in enumerate(parts) for m in rx.finditer(c)}
            down = sorted((w for w in places.values() if w > 0), reverse=True)
            if down:
                wanted[doc, term] = round(down[0] + 0.3 * sum(down[1:2]) + 0.1 * sum(down[2:]), 3)
    found = keywords.ranked(keywords.section_keywords(docs, vocab, aliases, {})).collect()
    got = {(r.doc, r.term): r.weight for r in found}
    assert set(got) == set(wanted) and all(abs(got[k] - v) < 0.0011 for k, v in wanted.items())
    # "C++" is all capitals, so it keeps its case and "c++" is no second hit.
    assert [got[k] for k in ((-1, "ML"), (-1, "C++"), (-1, ".NET"), (-1, "Go"), (-2, "R"))] == [1.12, 0.7, 0.7, 0.7, 0.7]
    own = [r for r in found if r.doc == -1]
    assert [r.term for r in sorted(own, key=lambda r: r.rank)] == [r.term for r in sorted(own, key=lambda r: (-r.weight, r.term))]
    table = spark.createDataFrame([("ml", "ML"), ("Machine Learning", "ML")], "spelling string, canonical string")
    terms = spark.createDataFrame([("machine learning",), ("Go",)], "term string")
    assert sorted(r.term for r in keywords.canonical_terms(terms, table).collect()) == ["Go", "ML"]
    covered = spark.createDataFrame([(1, "b", 1.0, "exact", ["v"]), (1, "a", 2.0, "inferred", []), (1, "c", 3.0, "exact", ["v", "w"])], "doc int, term string, weight double, source string, variants array<string>")
    assert [r.line for r in keywords.explain(covered).orderBy("n").collect()] == ["covered  3.000  c  v, w", "covered  1.000  b  v", "uncovered  2.000  a  inferred"]


def test_weakest_and_verbatim(spark):
    losses = spark.createDataFrame([(0.5, "v2", "b"), (0.2, "v9", "c"), (0.2, "v1", "a")], "loss double, variant_id string, bullet_id string")
    assert keywords.weakest_filler(losses).first()[0] == "a"
    placed = spark.createDataFrame([("v1", "x"), ("v2", "y"), ("v3", None)], "variant_id string, text string")
    bank = spark.createDataFrame([("v1", "x"), ("v2", "z")], "variant_id string, text string")
    assert [r.variant_id for r in keywords.verbatim_check(placed, bank).collect()] == ["v2"]


def test_vocabulary():
    assert keywords.vocabulary(["k8s", "Go"], {"Kubernetes": ["k8s"]}, {"cloud": {"implies": ["AWS"]}}) == ["AWS", "Go", "Kubernetes", "cloud"]


def test_layout_rules(spark):
    vk = spark.createDataFrame([("v1", "a"), ("v2", "a"), ("v3", "a"), ("v3", "b")], "variant_id string, term string")
    kw = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "term string, weight double")
    placed = spark.createDataFrame([(1, f"b{i}", f"v{i}", i != 2) for i in (1, 2, 3)], "layout_id int, bullet_id string, variant_id string, optional boolean")
    none = spark.createDataFrame([], "term string, forced long")
    assert [r.item for r in keywords.over_cap(placed, vk, kw, none).collect()] == ["a"]
    bullets = spark.createDataFrame([("b1", True), ("b2", True), ("b3", True)], "bullet_id string, mandatory boolean")
    variants = placed.select("bullet_id", "variant_id", F.lit("x").alias("voice"))
    assert keywords.over_cap(placed, vk, kw, keywords.forced_terms(bullets, variants, vk, "x")).isEmpty()
    losses = {r.bullet_id: r.loss for r in keywords.bullet_losses(placed, vk, kw).collect()}
    assert losses == {"b1": 0.0, "b3": 0.5}
    options = spark.createDataFrame([("b", "x", ["p", "q"], 1.0, 1), ("b", "x", ["q", "p"], 1.0, 2), ("b", "x", ["q"], 1.0, 3)], "bullet_id string, voice string, terms array<string>, height double, ord int")
    assert sorted(r.ord for r in keywords.distinct_options(options).collect()) == [1, 3]


def test_exports(spark, tmp_path):
    from tideline.functions.textnorm import content_key
    from tideline.operators.reports import html_escape
    from tideline.sources import sinks

    rows = spark.createDataFrame([("1", "confirmed"), ("2", "region")], "i string, g string")
    sinks.write_board(rows, str(tmp_path / "board"))
    assert spark.read.json(str(tmp_path / "board")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_board(rows.limit(0), str(tmp_path / "board"))
    one = rows.select(html_escape(F.lit('<a&"')).alias("e"), (content_key(F.lit("1"), F.lit(" Acme"), F.lit("a  b")) == content_key(F.lit("1"), F.lit("acme"), F.lit(" a\nb"))).alias("k")).first()
    assert one.e == "&lt;a&amp;&quot;" and one.k


def test_health_row(spark):
    seen = spark.createDataFrame([("a", "2026-08-25 00:00:00", False), ("b", "2026-08-25 00:00:00", True), ("c", "no time", None)], "id string, first_seen string, seeded boolean")
    runs = [(n, "check", "completed", "success" if n else "failure", dt.datetime(2026, 8, n + 1), 61_000.0) for n in range(6)]
    df = spark.createDataFrame(runs, "run_id int, name string, status string, conclusion string, updated_at timestamp, duration_ms double")
    row = pipelines.health(seen, df, NOW).first()
    assert (row.tracked, row.new_week, row.runs, row.used, row.failures, row.status, row.max_s) == (3, 1, 6, 12, 0, "warn", 61)
    groups = spark.createDataFrame([("a",)], "seed_group string")
    assert not state.groups_changed(groups, groups) and state.groups_changed(groups.limit(0), groups)


def test_long_clauses(spark):
    """Hits of a clause of many blocks, by brute force; no row carries the clause, lines without hits are not moved."""
    words = [("go", "Go", "x", "deep learning", "C++", "a")[i * i % 11 % 6] for i in range(3000)]
    text = "Skills\n" + " ".join(words) + "\nnothing of this kind in a line of more than eight words"
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    known = keywords.Spellings(keywords.spelling_table(spark, ["Go", "ML", "C++"], {"ML": ["deep learning", "deep"]}))
    cut = keywords.clauses(docs, pattern=known.pattern())
    assert [r.clause[:6] for r in cut.orderBy("clause_no").collect()] == ["Skills", " ".join(words)[:6]]
    hits = keywords.exact_hits(cut, known)
    assert "clause" not in hits.columns and hits.selectExpr("max(length(snippet))").first()[0] <= 80 + len("deep learning")
    counts = {r.term: r["count"] for r in hits.groupBy("term").count().collect()}
    assert counts == {t: n for t, n in (("Go", words.count("Go")), ("ML", words.count("deep learning")), ("C++", words.count("C++"))) if n}
    line = " ".join(words)
    at = line.index("deep learning")
    best = hits.where("term = 'ML'").orderBy("at").first()
    assert best.snippet == line[max(at - 40, 0) : at + len("deep learning") + 40].strip()


def test_counted_bonus(spark):
    import itertools

    every = [tuple(c) for c in itertools.product((0, 1, 2, 7), repeat=len(keywords.WEIGHTS))]
    df = spark.createDataFrame(every, ", ".join(f"n{i} long" for i in range(len(keywords.WEIGHTS))))
    listed = F.flatten(F.array(*(F.array_repeat(F.lit(w), F.col(f"n{i}").cast("int")) for i, w in enumerate(keywords.WEIGHTS))))
    counted = keywords.counted_bonus([(w, F.col(f"n{i}")) for i, w in enumerate(keywords.WEIGHTS)])
    assert df.where(F.bround(keywords.bonus(listed), 3) != counted).isEmpty()


def test_match_moves_no_lists(spark):
    """The match is that of all keywords with the lists of variants, but no list, evidence or inferred term is made for it."""
    from tideline.plans import pipelines

    docs = spark.createDataFrame([(1, "the trash and the les"), (2, "der les"), (3, "none")], "doc int, text string")
    variants = spark.createDataFrame([("v1", "the"), ("v2", "the"), ("v2", "der"), ("v3", "trash")], "variant_id string, term string")
    vocab, tree = ["the", "der", "and", "trash", "les"], {"the": {"implies": ["der", "article"]}}
    made = pipelines.document_match(docs, variants, vocab, {}, tree)
    # the weighs 0.91 and so is core, the others 0.7: 1.61 of 3.01, then 0.6 * 100 + 0.4 * 53.5
    assert sorted(map(tuple, made.collect())) == [(1, 53, 100, 81, "strong"), (2, 50, None, 50, "weak")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "min_by" not in plan
