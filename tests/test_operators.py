import functools
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import allocation, assembly, cascade, evidence, external, identity, jats, minset, ordinal, scoring, validate


def one(df):
    return df.first()[0]


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(f(F.col("c"))).collect()]


def test_text_functions(spark):
    assert values(spark, [" a   b\x1d\n c ", None, ""], tx.collapse) == ["a b c", None, ""]
    assert values(spark, ["https://x.example/10.1234/AB.c.", "doi:10.99901/q", "", None, "11.2/3"], tx.doi_norm) == ["10.1234/ab.c", "10.99901/q", None, None, None]
    assert values(spark, ["&amp;&lt;", None], tx.unescape) == ["&<", None]
    assert values(spark, ["“ﬁne” – a&nbsp;b"], tx.normalize_anchor) == ['"fine" - a b']
    assert values(spark, ["x" * 10, "x" * 11, None], lambda c: F.length(tx.elide_middle(c, 10, "|"))) == [10, 11, None]
    assert values(spark, ["a|b||c", "", None], tx.pipe_split) == [["a", "b", "c"], [], []]
    assert values(spark, ["12", " 7", "x", None], tx.int_or_zero) == [12, 7, 0, 0]
    assert values(spark, ['Sure:\n```json\n{"a": {"b": 1}}\n```', "none"], tx.json_block) == ['{"a": {"b": 1}}', None]
    assert values(spark, ["a.PNG", "b.jpeg", "c"], tx.mime_of) == ["image/png", "image/jpeg", "application/octet-stream"]
    df = spark.createDataFrame([("It — “works”", "-  \"works\""), ("abc", " "), (None, "a")], "t string, a string")
    assert [r[0] for r in df.select(tx.contains_anchor(F.col("t"), F.col("a"))).collect()] == [True, False, False]


def test_cascade_takes_the_first(spark):
    df = spark.createDataFrame([(1, None), (5, True), (20, False)], "n int, f boolean")
    code = cascade.first_match([("small", F.col("n") < 3), ("flag", F.col("f")), ("big", F.col("n") > 10)])
    assert [r[0] for r in df.select(code).collect()] == ["small", "flag", "big"]
    minima = [("a", "n", 5), ("b", "m", 1)]
    df = spark.createDataFrame([(9, 1), (None, 1), (9, None)], "n int, m int")
    assert [r[0] for r in df.select(cascade.below_minimum(minima)).collect()] == [None, "a", "b"]
    assert [r[0] for r in df.select(cascade.all_hold({"n": 5, "m": 1})).collect()] == [True, False, False]


def test_scores_and_ties(spark):
    df = spark.createDataFrame([("p", "actin acts on interacting actin", ["B"]), ("q", None, None)], "k string, t string, l array<string>")
    lex = [(0, "A", ["actin"]), (1, "B", ["act"])]
    s = {(r.k, r.category): r.score for r in scoring.category_scores(df, "k", F.col("t"), lex, F.col("l")).collect()}
    assert s == {("p", "A"): 3, ("p", "B"): 6, ("q", "A"): 0, ("q", "B"): 0}
    best = scoring.best_category(scoring.category_scores(df, "k", F.col("t"), lex, F.col("l")), "k").collect()
    assert {r.k: r.category for r in best} == {"p": "B", "q": "A"}
    w = {r.category: (r.n_papers, r.weight) for r in scoring.fractional_weights(spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", None]), (3, None)], "k int, l array<string>"), "k", "l").collect()}
    assert w == {"a": (2, 1.5), "b": (1, 0.5)}


def test_positions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as g", "(id * 37) % 1000 as o").repartition(5)
    got = {r.id: r.pos for r in ordinal.global_position(df, ["o"]).collect()}
    assert got == {i: (i * 37) % 1000 + 1 for i in range(1000)}
    got = {r.id: r.pos for r in ordinal.group_position(df.withColumn("g", F.lit(1)), ["g"], ["o"]).collect()}
    assert got == {i: (i * 37) % 1000 + 1 for i in range(1000)}
    g = {r.id: r.pos for r in ordinal.group_position(df, ["g"], ["o"]).collect()}
    for k in range(7):
        members = sorted((i for i in range(1000) if i % 7 == k), key=lambda i: (i * 37) % 1000)
        assert [g[i] for i in members] == list(range(1, len(members) + 1))
    assert ordinal.global_position(df.limit(0), ["o"]).count() == 0


def test_intervals_and_quotas(spark):
    assert ordinal.parse_interval("5") == (1, 5) and ordinal.parse_interval("2-9") == (2, 9)
    for bad in ("0", "5-2", "x", "-3"):
        with pytest.raises(ValueError):
            ordinal.parse_interval(bad)
    assert ordinal.year_quotas(2020, 2022, 3002) == {2020: 1001, 2021: 1001, 2022: 1000}
    df = spark.range(10).withColumnRenamed("id", "o")
    assert sorted(r.o for r in ordinal.interval(df, ["o"], "3-5").collect()) == [2, 3, 4]
    assert ordinal.interval(df, ["o"], "8-20").count() == 3
    with pytest.raises(ValueError):
        ordinal.interval(df, ["o"], "8-20", strict=True)
    hits = df.withColumn("h", F.col("o") % 2 == 0)
    assert sorted(r.o for r in ordinal.until_target(hits, ["o"], "h", 2).collect()) == [0, 1, 2]
    assert sorted(r.o for r in ordinal.until_target(hits, ["o"], "h", 3, existing=2).collect()) == [0]


def test_last_per_key_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, s int, v string")
    new = spark.createDataFrame([("a", 2, "z", 1), ("c", 1, "w", 2)], "k string, s int, v string, extra int")
    got = {r.k: (r.v, r.extra) for r in identity.upsert(old, new, ["k"], ["s"]).collect()}
    assert got == {"a": ("z", 1), "b": ("y", None), "c": ("w", 2)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 63), st.integers(1, 4)), min_size=1, max_size=7))
def test_cover_against_all_sets(options):
    """Fewest, then the greatest total, then the smallest positions from the last: against every set of options."""
    masks, scores = [m for m, _ in options], [float(c) for _, c in options]
    goal = functools.reduce(lambda a, b: a | b, masks)
    full = [ix for k in range(len(masks) + 1) for ix in itertools.combinations(range(len(masks)), k) if functools.reduce(lambda a, i: a | masks[i], ix, 0) == goal]
    assert minset.smallest_cover(masks, scores) == list(min(full, key=lambda ix: (len(ix), -sum(scores[i] for i in ix), ix[::-1])))


def test_covers_with_bridges_and_over_the_limit(spark):
    ring = [("p", f"r{i}", f"u{i}") for i in range(4)] + [("p", f"r{i}", f"u{(i + 1) % 4}") for i in range(4)]
    forced = [("q", "a", "x"), ("q", "b", "x"), ("q", "a", "BRIDGE:1:a")]
    wide = [("w", f"r{i}", f"u{i % 12}") for i in range(24)] + [("w", "only", "lone")]
    members, papers = minset.minimum_cover(spark.createDataFrame(ring + forced + wide, "paper string, ref string, unit string"))
    got = sorted((r.paper, r.ref, r.forced) for r in members.collect())
    assert [g for g in got if g[0] == "q"] == [("q", "a", True)] and sum(g[0] == "p" for g in got) == 2 and [g for g in got if g[0] == "w"] == [("w", "only", True)]
    assert {r.paper: (r.n_units, r.n_left, r.status) for r in papers.collect()} == {"p": (4, 4, "EXACT"), "q": (2, 0, "EXACT"), "w": (13, 12, "OVER_LIMIT")}
    facts = spark.createDataFrame([("p", "f1", "a"), ("p", "f1", "a"), ("p", None, "b"), ("p", "f2", None)], "paper string, fact_id string, ref string")
    bridges = spark.createDataFrame([("p", "b1", "PARTIAL", "a"), ("p", "b2", "MISSING", "a")], "paper string, bridge_id string, status string, ref string")
    units = minset.coverage_units(facts, bridges)
    assert sorted((r.ref, r.unit) for r in units.collect()) == [("a", "BRIDGE:b1:a"), ("a", "FACT:f1")]
    need = spark.createDataFrame([("p", "FACT:f1"), ("p", "FACT:f9")], "paper string, unit string")
    assert [r.unit for r in minset.uncovered_units(need, units).collect()] == ["FACT:f9"]
    e = spark.createDataFrame([], "paper string, ref string, unit string")
    assert [x.count() for x in minset.minimum_cover(e)] == [0, 0] and minset.removal_test(e).count() == 0


def test_subsets_in_order(spark):
    got = one(spark.range(1).select(minset.subset_masks(F.lit(3))))
    assert got == [0b011, 0b101, 0b110, 0b111]
    assert len(one(spark.range(1).select(minset.subset_masks(F.lit(6))))) == 57


def test_smallest_subset_falls_back(spark):
    s = spark.createDataFrame([("p", 3, 1, 1.0, False), ("p", 5, 2, 1.0, True), ("p", 7, 3, 1.0, True), ("q", 3, 1, 1.0, False)], "paper string, mask int, subset_no int, confidence double, sufficient boolean")
    assert {r.paper: (r.mask, r.fallback) for r in minset.smallest_sufficient(s).collect()} == {"p": (5, False), "q": (3, True)}
    d = {(r.paper, r.unit): r.indispensable for r in minset.deletion_test(s, minset.smallest_sufficient(s)).collect()}
    assert d == {("p", 0): True, ("p", 2): True, ("q", 0): True, ("q", 1): True}


def picked(lists, weights, limit, minimum):
    """The sample by its definition: whole lists, every category looked at before every pick."""
    names, taken = sorted(lists), {}
    held = lambda c: sum(v == c for v in taken.values())
    free = lambda c: [x for x in lists[c] if x not in taken]
    for c in sorted(names, key=lambda c: (len(set(lists[c])), c)):
        while held(c) < minimum and free(c) and len(taken) < limit:
            taken[free(c)[0]] = c
    rest = limit - len(taken)
    target = {c: held(c) + rest * weights[c] / (sum(weights.values()) or 1.0) for c in names}
    while len(taken) < limit and (able := [c for c in names if free(c)]):
        c = min(able, key=lambda c: (held(c) - target[c], -weights[c] / (held(c) + 1), c))
        taken[free(c)[0]] = c
    return taken


def test_topic_sample_against_its_definition(spark):
    """Also where categories have more candidates than the limit, and with the population's hits."""
    rnd, rows, hits, want = random.Random(3), [], [], {}
    for g in range(12):
        ids = [f"x{i}" for i in range(90)]
        lists = {c: rnd.sample(ids, rnd.randint(1, 80)) for c in "abcd"}
        many = {c: rnd.randint(1, 500) for c in "abc"}
        rows += [(g, c, i, x) for c, xs in lists.items() for i, x in enumerate(xs)] + [(g, "a", 500, lists["a"][0])]
        hits += [(g, c, n) for c, n in many.items()]
        frac = {c: sum((1 << 40) // sum(x in ys for ys in lists.values()) for x in xs) / 2**40 for c, xs in lists.items()}
        weights = {c: many.get(c, len(xs)) * (frac[c] / len(xs)) for c, xs in lists.items()}
        want |= {(g, n): (x, c) for n, (x, c) in enumerate(picked(lists, weights, 40, 3).items(), 1)}
    df, h = spark.createDataFrame(rows, "g int, c string, pos int, x string"), spark.createDataFrame(hits, "g int, c string, hits int")
    got = {(r.g, r.pick_no): (r.x, r.c) for r in allocation.topic_sample(df, "g", "c", "pos", "x", 40, 3, h).collect()}
    assert got == want and len(got) > 300
    assert allocation.topic_sample(df.limit(0), "g", "c", "pos", "x", 40, 3).count() == 0
    assert allocation.expanding_candidates(10, 100) == [35, 53, 80, 100]
    assert (allocation.least_per_category(100), allocation.least_per_category(10), allocation.least_per_category(90000, True)) == (5, 1, 200)


def test_validators(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, None)], "k int, v string, n int")
    got = sorted(tuple(r) for r in validate.violations(df, ["k"], [("no_v", F.col("v").isNull(), F.lit("")), ("big", F.col("n") > 3, F.col("n"))]).collect())
    assert got == [(1, "big", "5"), (2, "no_v", "")]
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 2], [2, 3]))
    assert sorted(tuple(r) for r in validate.both_ways(a, b, ["k"]).collect()) == [(1, "extra"), (3, "missing")]
    with pytest.raises(ValueError):
        validate.sealed(df.withColumn("target_title", F.lit("")))


def test_memo_is_asked_once_and_failures_are_rows(spark):
    calls = []
    req = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), ("k3", "c")], "key string, payload string")
    memo = spark.createDataFrame([("k1", "op", "kept", None), ("k3", "op", None, "failed before")], external.MEMO)
    answers, new = external.call(req, memo, external.replay({"b": "fresh"}), "op", tries=1)
    got = {(r.key, r.response, r.error) for r in answers.collect()}
    assert got == {("k1", "kept", None), ("k2", "fresh", None), ("k3", None, "not recorded")}
    assert new.count() == 2 and not calls

    def broken(payloads):
        raise RuntimeError("down")

    def picky(payloads):
        if "b" in payloads:
            raise ValueError("b")
        return [(p.upper(), None) for p in payloads]

    answers, _ = external.call(req, memo, picky, "op", tasks=1, tries=1)
    assert {r.key: (r.response, r.error) for r in answers.collect()} == {"k1": ("kept", None), "k2": (None, "ValueError: b"), "k3": ("C", None)}
    answers, _ = external.call(req, memo, broken, "op", tries=2)
    assert {r.key: r.error for r in answers.collect()} == {"k1": None, "k2": "RuntimeError: down", "k3": "RuntimeError: down"}


ARTICLES = """<pmc-articleset xmlns:xlink="http://www.w3.org/1999/xlink"><article article-type="case-study"><front><journal-meta><journal-title-group><journal-title>Moss &amp; Fern</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmc">4410</article-id><article-id pub-id-type="doi">10.99901/moss.8</article-id><article-categories><subj-group><subject>Botany</subject></subj-group></article-categories>
<title-group><article-title>Spores of <sup>3</sup>H &amp;amp; <bold>Q7</bold></article-title></title-group>
<pub-date pub-type="collection"><year>2016</year></pub-date><pub-date pub-type="epub"><year>2017</year></pub-date><permissions><license><p>Free</p><license-ref>http://licence.example/1</license-ref></license></permissions>
<abstract><p>Wet.</p></abstract><abstract><p>Dry.</p></abstract><custom-meta-group><custom-meta><meta-name>article-type</meta-name><meta-value>brief</meta-value></custom-meta><custom-meta><meta-name>x</meta-name><meta-value>no</meta-value></custom-meta></custom-meta-group></article-meta></front>
<body><sec sec-type="intro"><title>Opening words</title><p>Wind <xref ref-type="bibr" rid="m2 m1">2,1</xref> and rain <xref ref-type="bibr" rid="m2">2</xref> <xref ref-type="fig" rid="f">F</xref>.</p><p>Snow<xref ref-type="bibr" rid="none"/></p></sec>
<sec><title>Background</title><p>Older.</p></sec><sec><title>Findings and Discussion</title><p>Seen.</p><fig><caption><p>Leaf</p></caption><graphic xlink:href="leaf.tif"/></fig></sec></body>
<back><ref-list><ref id="m1"><element-citation><person-group><name><surname>Ito</surname><given-names>K</given-names></name><name><surname>Bo</surname></name></person-group><article-title>Old moss</article-title><source>Ferns</source><year>1990</year><pub-id pub-id-type="pmid">31</pub-id><pub-id pub-id-type="pmc">9</pub-id></element-citation></ref>
<ref><mixed-citation>No id here</mixed-citation></ref><ref id="m2">bare</ref></ref-list></back></article>
<article><front/></article><article><front><article-meta><title-group><article-title>Second</article-title></title-group></article-meta></front><body><sec/><sec><title>Late intro</title><p>Far</p></sec></body></article></pmc-articleset>"""


def test_articles(spark):
    df = spark.createDataFrame([(1, ARTICLES), (2, "<broken"), (3, None), (4, "<a/>"), (5, "")], "k long, x string")
    a = jats.parse_articles(df, "k", "x")
    r, second = a.orderBy("article_no").collect()
    assert (r.pmcid, r.title, r.year, r.journal, r.license, r.license_url) == ("PMC4410", "Spores of 3H & Q7", 2017, "Moss & Fern", "Freehttp://licence.example/1", "http://licence.example/1")
    assert r.article_types == ["case-study", "Botany", "brief"] and r.abstract == "Wet. Dry."
    assert (second.article_no, second.title, second.year, second.introduction_text) == (3, "Second", 0, "Late introFar")
    assert r.introduction == "BackgroundOlder." and r.results == "Findings and DiscussionSeen.Leaf" and r.discussion == ""
    assert [(p.article_no, p.paragraph_index, p.reference_ids) for p in jats.paragraphs(a, "k").orderBy("article_no", "paragraph_index").collect()] == [(1, 1, ["m2", "m1"]), (1, 2, ["none"]), (3, 1, [])]
    refs = {x.reference_id: x for x in jats.references(a, "k").collect()}
    assert refs["m1"].authors == "Ito K; Bo" and (refs["m1"].pmid, refs["m1"].pmcid) == ("31", "PMC9") and refs["R2"].citation_text == "No id here" and refs["m2"].citation_text == "bare"
    assert {x.reference_id: [c.paragraph_index for c in x.contexts] for x in jats.contexts(a, "k").collect()} == {"m1": [1], "m2": [1, 1]}
    assert sorted((m.reference_id, m.paragraph_index, m.marker) for m in jats.mentions(a, "k").collect()) == [("m1", 1, "2,1"), ("m2", 1, "2,1"), ("none", 2, "")]
    assert [(f.figure_id, f.label, f.caption, f.href) for f in jats.figures(a, "k").collect()] == [("fig1", "", "Leaf", "leaf.tif")]
    assert [(f.figure_id, f.label) for f in jats.figures(a, "k", "F", labelled=True).collect()] == [("F1", "Figure 1")]
    by_type, exact = jats.parse_articles(df, "k", "x", by_type=True), jats.parse_articles(df, "k", "x", exact=True)
    assert by_type.filter("article_no = 1").first().introduction == "BackgroundOlder."
    assert [x.introduction_text for x in exact.orderBy("article_no").collect()] == ["Opening wordsWind 2,1 and rain 2 F.Snow", ""]


def test_renumber_remap_files_registry(spark):
    items = spark.createDataFrame([("p", 10, 2), ("p", 10, 1), ("p", 30, 1), ("q", 5, 1)], "s string, par int, o int")
    assert sorted(r.new_id for r in assembly.renumbered(items, "s", "par", ["o"], "O").collect()) == ["O1_1", "O1_1", "O1_2", "O2_1"]
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "k int, ids array<string>")
    m = spark.createDataFrame([(1, "a", ["x", "y"])], "k int, old_id string, new_ids array<string>")
    assert {r.k: r.ids for r in assembly.remapped(rows, "k", "ids", m).collect()} == {1: ["x", "y", "b"]}
    figs = spark.createDataFrame([("p", "f1", "d/A.jpg"), ("p", "f2", "b.tif"), ("p", "f3", "zz")], "s string, figure_id string, href string")
    members = spark.createDataFrame([("p", "in/a.JPG"), ("p", "b.png"), ("p", "b.gif")], "s string, member string")
    assert {r.figure_id: (r.member, r.status) for r in assembly.matched_files(figs, members, "s").collect()} == {"f1": ("in/a.JPG", "FOUND"), "f2": ("b.gif", "FOUND"), "f3": (None, "MISSING")}
    e, p = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert {r.k: r.status for r in assembly.registry(e, p, ["k"]).collect()} == {1: "SKIPPED", 2: "READY"}
    assert [r.v for r in assembly.replaced(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), "k", "b", {"v": "9"}).collect()] == ["1", "9"]


def test_audit_rates_of_nothing(spark):
    df = spark.createDataFrame([("p", True), ("p", None), ("q", None)], "paper string, ok boolean")
    assert {r.paper: (r.n_total, r.n_x, r.x_rate) for r in evidence.audit_rates(df, "paper", {"x": "ok"}).collect()} == {"p": (2, 1, 0.5), "q": (1, 0, 0.0)}
