import numpy as np
import pytest

from quillmark.llm import leakage as L

DOC, ITEM = "doc_id long, text string, item_id string, cosine int", "item_id long, text string, lang string, task string, doc_id int"
ITEMS = [
    (1, "Suppose neurons from T. susulus receive 13.1 nm of zomadulin for 68 hours, while TXIR7 is silenced at contact sites and glycogen storage is scored twice.", "en", "x", 0),
    (2, "Name the biphasic scaffold that DBEL2 needs for peroxisome import.", "en", "x", 0),
    (3, "假设DPON14缺失45小时，founalin升至19.4单位，而ZMIR15组改用moseiphorin，那么KNIB14先到达C区？", "zh", "x", 0),
    (4, None, "en", "x", 0), (5, "", "en", "x", 0), (6, " ... ", None, "x", 0),
]
FILL = [f"Filler text number {i} about cells of kind {i % 13} and the storage of glycogen at sites {i}." for i in range(60)]


def find(spark, docs, kinds=("whole", "part")):
    rows = [(i, t, "a", 1) for i, t in docs] + [(10_000 + i, t, "a", 1) for i, t in enumerate(FILL)]
    out = L.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame(ITEMS, ITEM))
    return sorted((r.item_id, r.doc_id) for r in out.collect() if r.kind in kinds)


def test_passages_as_a_reader_sees_them(spark):
    run12 = "receive 13.1 nm of zomadulin for 68 hours, while TXIR7 is silenced"
    docs = [
        (1, "Before. " + ITEMS[0][1] + " After."), (2, "He said RECEIVE 13.1\nNM OF ZOMA-\nDULIN FOR 68 HOURS -- WHILE TXIR7 IS SILENCED and left"), (3, run12[: run12.rindex(" ")]),
        (4, "Text. Name the bi­phasic scaffold that DBEL2\nneeds for peroxisome import"), (5, "Name the biphasic scaffold that DBEL2 needs for import"),
        (6, "前文。假设DPON14缺失45小\n时，founa\nlin升至19.4单位，后文"), (7, "假设DPON14缺失45小时"), (8, None), (9, ""), (1, "Before. " + ITEMS[0][1] + " After."),
    ]
    assert find(spark, docs) == [(1, 1), (1, 1), (1, 2), (2, 4), (3, 6)]


def test_long_documents_and_hot_texts(spark):
    long = "noise words here " * 30_000 + ITEMS[0][1] + " more noise" * 1000
    docs = [(1, long)] + [(100 + i, ITEMS[1][1]) for i in range(50)]
    assert find(spark, docs) == [(1, 1)] + [(2, 100 + i) for i in range(50)]


def test_paraphrase(spark):
    text = "Suppose the neurons from T. susulus would receive about 13.1 nm of the zomadulin for some 68 long hours, and while TXIR7 is then silenced at all contact sites, glycogen storage is scored."
    assert find(spark, [(1, text)]) == []
    assert find(spark, [(1, text)], ("paraphrase",)) == [(1, 1)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame(ITEMS, ITEM)
    assert L.leaks(d, i).count() == 0
    assert L.leaks(spark.createDataFrame([(1, ITEMS[0][1], "", 1)], DOC), i.limit(0)).count() == 0


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_ITEMS", 2)
    with pytest.raises(ValueError):
        L.load_items(spark.createDataFrame(ITEMS, ITEM))


def test_common_subsequence_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = ([f"w{k}" for k in rng.integers(0, 6, rng.integers(1, 12))] for _ in range(2))
        it = L.Item(1, " ".join(a), "en")
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert it.common(b) == t[-1, -1]


def test_recall_of_the_index_against_brute_force(spark, data):
    """The latent search finds every document that a plain scan of all items over all documents finds."""
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_item.parquet")
    got = {(r.item_id, r.doc_id) for r in L.leaks(docs, items).collect() if r.kind in ("whole", "part")}
    listed, want = L.load_items(items), set()
    for r in docs.select("doc_id", "text").collect():
        stream, starts = L.letters(r.text or "")
        for it in listed:
            run = it.run(stream, starts) if any(p in stream for p in it.pieces) else 0
            if run >= min(it.least, it.size):
                want.add((it.item_id, r.doc_id))
    assert got == want and want


def brute(docs, items):
    want = set()
    for d, text in docs:
        stream, starts = L.letters(text or "")
        for i, t, lang, *_ in items:
            it = L.Item(i, t or "", lang)
            if it.stream and it.run(stream, starts) >= min(it.least, it.size):
                want.add((i, d))
    return want


def test_items_of_one_to_twelve_words(spark):
    words = "Zomadulin slows 13.1 nm vesicle-budding in TXIR7 neurons once glycogen storage stops growing".split()
    items = [(k, " ".join(words[:k]), "en", "x", 0) for k in range(1, 13)]
    cut = [(100 + k, "Some text of cells. " + " ".join(words[:k]) + " then other words of neurons follow here and there.") for k in range(1, 14)]
    shifted = [(200 + k, "noise word of a cell " * 3 + "pad " * k + " ".join(words) + " and the end" * k) for k in range(0, 30)]
    broken = [(300, "Zoma-\ndulin slows 13.1 nm"), (301, "ZOMADULIN\u00a0slows 13.1\nnm vesicle-\nbudding in TXIR7"), (302, "zomadulins slows"), (303, "slows 13.1 nm vesicle budding")]
    docs = cut + shifted + broken + [(400 + i, t) for i, t in enumerate(FILL)]
    out = L.leaks(spark.createDataFrame([(i, t, "a", 1) for i, t in docs], DOC), spark.createDataFrame(items, ITEM))
    got = {(r.item_id, r.doc_id) for r in out.collect() if r.kind in ("whole", "part")}
    assert got == brute(docs, items) and len(got) > 400


def test_runs_at_every_offset(spark):
    """Chinese runs of 24 characters and runs of 12 words full of decimals and codes, wherever they stand."""
    zh = "假设DPON14缺失45小时,founalin升至19.4单位,而ZMIR15组改用moseiphorin,那么KNIB14是否先到达C区?若F组保持32.5单位又如何"
    en = "Rates of 3.5-4.5 nm/s, 12.25 mg/ml (0.5x), p53-like AB-12/C3 and 1,000.5 U/l at 37.5 °C, x-1/y-2 over 7.5-9.5 h, 2.5e-3 M per 4.75 cm2, as T-7.1/T-8.2 fall by 0.25-0.75 %"
    items = [(1, zh, "zh", "x", 0), (2, en, "en", "x", 0)]
    stream, tokens = L.Item(1, zh, "zh").stream, en.split()
    docs = [(k, "前文说明细胞的变化" * (k % 7) + stream[k:k + 24] + "后文说明其他结果" * (k % 5)) for k in range(len(stream) - 23)]
    docs += [(1000 + k, "pad " * (k % 13) + " ".join(tokens[k:k + 12]) + " tail" * (k % 11)) for k in range(len(tokens) - 11)]
    docs += [(2000 + k, stream[k:k + 23]) for k in range(10)] + [(3000 + i, t) for i, t in enumerate(FILL)]
    out = L.leaks(spark.createDataFrame([(i, t, "a", 1) for i, t in docs], DOC), spark.createDataFrame(items, ITEM))
    got = {(r.item_id, r.doc_id) for r in out.collect() if r.kind in ("whole", "part")}
    assert got == brute(docs, items) and len(got) > 70


def test_paraphrase_of_an_item_without_telling_terms(spark):
    item = [(1, "the old cat sat on the warm mat by the open door and saw the bird", "en", "x", 0)]
    text = "here the old grey cat sat down on the warm red mat by the open back door and then saw the small bird"
    out = L.leaks(spark.createDataFrame([(1, text, "a", 1)] + [(10 + i, t, "a", 1) for i, t in enumerate(FILL)], DOC), spark.createDataFrame(item, ITEM))
    assert [(r.doc_id, r.kind) for r in out.collect()] == [(1, "paraphrase")]


def test_windows_hold_every_run():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 90, 3)
        doc, at = np.repeat([0, 1, 2], sizes), np.concatenate([np.sort(rng.integers(0, 80, n)) for n in sizes])
        row, entry = L.in_windows(doc, at, 24, 12)
        held = {}
        for r, e in zip(row, entry):
            held.setdefault(r, set()).add(e)
        assert set(held) <= set(range(max(held) + 1))
        for e in range(len(doc)):
            run = {k for k in range(len(doc)) if doc[k] == doc[e] and at[e] <= at[k] < at[e] + 12}
            assert any(run <= h for h in held.values())


def test_sparse_products():
    rng = np.random.default_rng(1)
    row, term = np.sort(rng.integers(0, 20, 70)), rng.integers(0, 9, 70)
    idf = rng.random(9) + 0.5
    r, t, w = L._weights(row, term, 20, idf)
    a = np.zeros((20, 9), np.float32)
    a[r, t] = w
    tf = np.zeros((20, 9))
    np.add.at(tf, (row, term), 1)
    raw = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0)
    assert np.allclose(a, raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12), atol=1e-5)
    b = rng.random((9, 4)).astype(np.float32)
    assert np.allclose(L._times(r, t, w, 20, b), a @ b, atol=1e-5)
    terms, v = L._transposed_times(r, t, w, a @ b)
    full = np.zeros((9, 4))
    full[terms] = v
    assert np.allclose(full, a.T @ (a @ b), atol=1e-4)
