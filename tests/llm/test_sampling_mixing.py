import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import mixing, sampling
from quillmark.llm.sampling import Target, allocate

PAPER = "row_id long, pmcid string, primary_category string, year int, category string, leaf_1 string"
TARGETS = "dimension string, value string, target_permille int, min_rows int"


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from(["a", "b", "c", ""]), st.sampled_from(["1", "2", ""])), st.integers(0, 40), max_size=12), st.integers(0, 80))
def test_allocation_fills_what_it_can(counts, n):
    first = [Target("c", x, x, p, 2) for x, p in (("a", 500), ("b", 300), ("c", 200))]
    second = [Target("y", x, x, p, 1) for x, p in (("1", 600), ("2", 400))]
    got = allocate(counts, n, [first, second])
    assert sum(got.values()) == min(n, sum(counts.values()))
    assert all(0 <= got[k] <= counts[k] for k in counts)


def test_shares_match_where_papers_allow():
    first = [Target("c", "a", "a", 700, 2), Target("c", "b", "b", 300, 2)]
    second = [Target("y", "1", "1", 500, 1), Target("y", "2", "2", 500, 1)]
    got = allocate({(c, y): 100 for c in "ab" for y in "12"}, 100, [first, second])
    assert got[("a", "1")] + got[("a", "2")] == 70 and got[("a", "1")] + got[("b", "1")] == 50
    # year 1 of a is empty: its quota goes to the sibling
    got = allocate({("a", "1"): 0, ("a", "2"): 90, ("b", "1"): 20, ("b", "2"): 5}, 50, [first, second])
    assert got[("a", "2")] == 35 and got[("b", "1")] + got[("b", "2")] == 15
    # a has too few papers at all: what its leaves and siblings lack goes to the cousins
    got = allocate({("a", "1"): 3, ("a", "2"): 4, ("b", "1"): 40, ("b", "2"): 40}, 50, [first, second])
    assert got[("a", "1")] == 3 and got[("a", "2")] == 4 and sum(got.values()) == 50


def test_three_levels_and_many_leaves():
    levels = [[Target(d, k, k, 1000 // 12, 1) for k in "abcdefghijkl"] for d in "xyz"]
    counts = {(a, b, c): (ord(a) * 7 + ord(b) * 3 + ord(c)) % 5 for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl"}
    got = allocate(counts, 1200, levels)
    assert sum(got.values()) == 1200 and all(0 <= got[k] <= counts[k] for k in counts)
    for i in range(3):
        for k in "abcdefghijkl":
            assert abs(sum(v for x, v in got.items() if x[i] == k) - 100) <= 12
    began = time.time()
    levels = [[Target(d, str(k), str(k), 4, 1) for k in range(250)] for d in "xy"]
    got = allocate({(str(a), str(b)): (a * b) % 7 for a in range(250) for b in range(250)}, 40_000, levels)
    assert sum(got.values()) == 40_000 and time.time() - began < 20


def test_sample_and_report(spark):
    rows = [(i, f"PMC{i}" if i % 2 else f" pmc{i}", ["Cat-A", "cat a ", None, "B"][i % 4], [2020, 2021, 0][i % 3], "", "") for i in range(1, 201)]
    rows += [(1000, "PMC1", None, 2020, "", ""), (1001, None, "B", 2020, "", "")]
    papers = spark.createDataFrame(rows, PAPER)
    targets = spark.createDataFrame([("primary_category", "Cat A", 500, 2), ("primary_category", "B", 400, 2), ("primary_category", "None such", 100, 2), ("year", "2020", 500, 2), ("year", "2021", 500, 2), (None, "x", 1, 1)], TARGETS)
    sample = sampling.draw_sample(papers, targets).collect()
    assert len(sample) == 50 == len({r.paper for r in sample})
    assert sample and sorted(r.paper for r in sample) == sorted(r.paper for r in sampling.draw_sample(papers.repartition(7), targets).collect())
    rep = {r.value: r for r in sampling.sample_report(papers, targets).collect()}
    assert rep["None such"].is_short and rep["None such"].needed == 5 and rep["None such"].available == 0
    assert not rep["B"].is_short and rep["B"].sampled >= 20 and rep["Cat A"].available == 100
    for value, column in (("B", "category"), ("Cat A", "category"), ("2020", "year")):
        assert rep[value].sampled == sum(r[column] == value.lower().replace(" ", "") for r in sample)
    assert sampling.draw_sample(papers.limit(0), targets).count() == 0
    assert sampling.draw_sample(papers, targets.limit(0)).count() == 50


DOC = "doc_id long, text string, source string, key string, n_tokens string"
SOURCE = "source string, target_share double, max_repeats int"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary file")


@needs_tokenizer
def test_mixture_reaches_shares(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 17), ["Big", "small "][i % 10 == 0], "", "") for i in range(1, 401)]
    docs += [(1000 + i, docs[i][1], "big", "", "") for i in range(20)] + [(2000, None, "big", "", ""), (2001, "", "big", "", ""), (2002, "x", None, "", ""), (2003, "no target", "other", "", "")]
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("ghost", 0.1, 2), (None, 0.0, 1)], SOURCE)
    mixed = mixing.mix(d, t).collect()
    assert all(0 <= r.position <= 1 for r in mixed)
    assert max(r.use_no for r in mixed) <= 4 and all(r.use_no == 1 for r in mixed if r.source == "big")
    assert len({(r.doc_id, r.use_no) for r in mixed}) == len(mixed)
    rep = {r.source: r for r in mixing.mixture_report(d, t).filter("source is not null").collect()}
    assert abs(rep["big"].used_tokens / rep["small"].used_tokens - 2) < 0.1
    assert rep["ghost"].is_short and rep["ghost"].used_tokens == 0
    whole = sum(rep[s].available_tokens for s in ("big", "small"))
    more = {r.source: r for r in mixing.mixture_report(d, t, total=2 * whole).filter("source is not null").collect()}
    assert more["big"].used_tokens == more["big"].available_tokens and more["small"].most_uses == 4
    assert mixing.demands({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 100) == {"a": 10, "b": 54.0, "c": 36.0}
    assert [r.position for r in mixing.mix(d, t).collect()] == sorted(r.position for r in mixed)
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


@needs_tokenizer
def test_curriculum_changes_over_time(spark):
    d = spark.createDataFrame([(i, f"doc {i} alpha beta", ["big", "small"][i % 5 == 0], "", "") for i in range(1000)], DOC)
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 1)], SOURCE)
    rows = mixing.mix(d, t, ramp=0.8).collect()
    early, late = ([r for r in rows if lo <= r.position < lo + 0.25] for lo in (0.0, 0.75))
    share = lambda rs: sum(r.source == "small" for r in rs) / len(rs)
    assert share(early) < 0.15 < 0.25 < share(late)
    slopes = mixing.schedules({"big": 0.8, "small": 0.2})
    assert abs(0.8 * slopes["big"] + 0.2 * slopes["small"]) < 1e-9


@needs_tokenizer
def test_tokens_of_whole_texts(spark):
    n = spark.createDataFrame([(1, "hello world " * 50_000), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.with_tokens(n, "doc_id", "text", []).collect()}
    assert got[1] >= 100_000 and got[2] == got[3] == 0
