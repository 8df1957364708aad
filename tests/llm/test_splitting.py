import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm.splitting import boundaries, split_spans, split_texts


def check(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit or (a, b) == (0, 0) for a, b, _ in spans)
    for (_, e, _), (a, b, _) in zip(spans, spans[1:]):
        assert a == e - overlap and b > e
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n,。é́", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries_win():
    rnd = random.Random(1)
    paras = [" ".join("".join(rnd.choices("abcdef", k=5)) for _ in range(rnd.randint(20, 60))) + "." for _ in range(40)]
    spans = check("\n\n".join(paras), 600, 50)
    assert sum(k == "paragraph" for *_, k in spans) >= 0.6 * (len(spans) - 1)


def brute(text, limit, overlap):
    """Least cost by trying every sequence of boundaries."""
    from quillmark.llm.splitting import BALANCE, KINDS

    at, kinds = boundaries(text, limit)
    at, pen = at.tolist(), [[*KINDS.values()][k] for k in kinds]
    n, stride = len(text), limit - overlap
    mean = (n + (-(-(n - overlap) // stride) - 1) * overlap) / -(-(n - overlap) // stride)
    size = lambda s: BALANCE * ((s - mean) / limit) ** 2
    best = {}

    def go(last):
        if last not in best:
            options = [size(n - last + overlap)] if n - last + overlap <= limit else []
            options += [pen[i] + size(p - last + overlap) + go(p) for i, p in enumerate(at) if p > last and p - last + overlap <= limit]
            best[last] = min(options, default=float("inf"))
        return best[last]

    return min([pen[i] + size(p) + go(p) for i, p in enumerate(at) if p <= limit and p >= overlap], default=float("inf")), mean


def test_optimal_against_brute_force():
    from quillmark.llm.splitting import BALANCE, KINDS

    rnd = random.Random(5)
    for _ in range(40):
        text = "".join(rnd.choice(["ab", "c", " ", ". ", "\n", "\n\n", ", "]) for _ in range(120))
        limit, overlap = rnd.randint(30, 60), rnd.randint(0, 8)
        if len(text) <= limit:
            continue
        spans = split_spans(text, limit, overlap)
        want, mean = brute(text, limit, overlap)
        got = sum(KINDS.get(k, 0.0) for *_, k in spans) + sum(BALANCE * ((b - a - mean) / limit) ** 2 for a, b, _ in spans)
        assert got == pytest.approx(want, abs=1e-6)


def test_edges_and_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "short", "z"), (4, "x" * 10_000, "k"), (4, "x" * 10_000, "k"), (5, "w " * 300_000, "k")], "row_id long, full_text string, piece string")
    got = split_texts(df, "row_id", "full_text").groupBy("row_id").count().collect()
    n = {r.row_id: r["count"] for r in got}
    assert set(n) == {2, 3, 4, 5} and n[2] == n[3] == 1 and n[4] == 8 and n[5] >= 214
    assert split_texts(df.limit(0), "row_id", "full_text").count() == 0
    with pytest.raises(ValueError):
        split_spans("abc", 5, 5)


def test_code_points():
    spans = check("😀" * 7000, 3000, 200)
    assert len(spans) == 3
