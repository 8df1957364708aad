import re

import pytest

from quillmark.llm import sentences as S

DOC = "doc_id long, text string, lang string, start_pos int"


@pytest.fixture(scope="module", params=["sf0.001", "sf0.1"])
def model(spark, request):
    """The models that the queries have at the smallest and at the largest scale."""
    out = S.train(spark.read.parquet(f"/root/testdata/{request.param}/documents.parquet"))
    out.scale = request.param
    return out


def split(model, text):
    return [text[a:b] for a, b in S.decide(text, S.gaps(text), model, {})]


CASES = {
    "abbreviations": ["Dr. Moreno measured it at 3.5 nm.", "The result (cf. Fig. 2B) was clear, i.e. positive.", "Pools held A, B etc.", "All came from Leeds, U.K.", "Next we waited."],
    "quotes": ["“No signal was seen. We repeated it twice,” wrote Moreno about stress.", "One note reads: \"Did it move? It did not.\"", "“Is it a channel?” asked Moreno."],
    "brackets": ["(All cells carried it; none moved.)", "Then they left (see Tab. 3)."],
    "numbers": ["The value was 0.75.", "25.8% of cells died.", "At day 23.4 all were moved."],
    "ellipsis": ["Was it lost in cells … or only slowed by stress?!", "It moved... Neither was needed."],
    "german": ["Am 62. Tag stieg es auf 5 nm, d. h. um das 3-Fache.", "Der Verlust betraf die Zellen C und A.", "Nach Prof. Weber bleibt es stabil."],
    "french": ["Pourquoi quitte-t-elle la membrane ?", "Le Dr Martin a mesuré 3,5 nm.", "Selon M. Martin, elle reste stable, c.-à-d. à 20 nm."],
    "spanish": ["¿Por qué abandona la membrana?", "¡El complejo volvió!", "Según la Dra. Ruiz, se mantiene, p. ej., a 39 nm (véase la fig. 54)."],
    "russian": ["«Сигнала не было. Мы повторили опыт», — отметил проф. Иванов.", "Почему белок покидает ядро?"],
    "greek": ["Γιατί η πρωτεΐνη εγκαταλείπει τον πυρήνα;", "Κατά τον κ. Ιωάννου, μένει σταθερή, π.χ. στους 20 °C."],
    "markers": ["It was lost.[7,8]", "It was kept. [3]", "It was seen.¹⁴", "The last one."],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_sentences(model, name):
    want = CASES[name]
    if name == "german" and model.scale == "sf0.001":
        want = want[1:]  # the few German texts there show no ordinal
    given = want
    if name == "ellipsis":
        want = [want[0], "It moved...", "Neither was needed."]
    assert split(model, " ".join(given)) == want
    assert split(model, "\n\n".join(given)) == want


def test_scripts_without_blanks(model):
    assert split(model, "为什么它会离开细胞核？温度降至3.1度后，含量下降了13%。“没有看到它。我们又测了一次。”王在记录中写道。") == ["为什么它会离开细胞核？", "温度降至3.1度后，含量下降了13%。", "“没有看到它。我们又测了一次。”王在记录中写道。"]
    assert split(model, "細胞膜で結合した。図4に示すように、小胞に集まった。") == ["細胞膜で結合した。", "図4に示すように、小胞に集まった。"]
    assert split(model, "कोशिका से जुड़ता है। केंद्रक से बाहर क्यों जाता है?") == ["कोशिका से जुड़ता है।", "केंद्रक से बाहर क्यों जाता है?"]
    assert split(model, "لماذا يغادر النواة؟ ذكر د. سامي أنه يظهر في الشكل 52.11.") == ["لماذا يغادر النواة؟", "ذكر د. سامي أنه يظهر في الشكل 52.11."]


def test_thai_by_the_model(model):
    if model.scale == "sf0.001":
        pytest.skip("a few dozen texts tell too little of a script without marks")
    a, b = "เซลล์ที่ขาด PBIL2 แบ่งตัวช้าลงอย่างชัดเจน", "เราวัดระดับ menilin ซ้ำอีกครั้งในวันถัดมา"
    assert split(model, f"{a} {b} {a}") == [a, b, a]


def test_end_marks_of_all_scripts(model):
    """Marks that Unicode calls sentence terminals, with and without a blank after them."""
    for text in ("ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។", "ကျောင်းသွားသည်။ အိမ်မှာနေသည်။", "Նա գնաց տուն։ Մենք մնացինք։", "ወደ ቤት ሄደ። እኛ ቀረን።", "ང་ཁྱིམ་ལ་འགྲོ། ཁོ་འདུག", "ᠮᠣᠩᠭᠣᠯ᠃ ᠪᠢᠴᠢᠭ᠃"):
        for t in (text, text.replace(" ", "") if text[0] not in "Նወᠮ" else text):
            parts = split(model, t)
            assert len(parts) == 2 and "".join(parts) == t.replace(" ", "") or " " in parts[0] + parts[1], t
            assert parts[0][-1] in S._END


def test_blanks_where_no_mark_stands(model):
    """Text without marks: words that begin and end sentences elsewhere decide; most boundaries found are right."""
    import pandas as pd
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").query("lang == 'en'").text.dropna()
    right = found = true = 0
    for t in texts[:300]:
        one = [x for x in split(model, t) if x[-1:] == "." and x[:1].isupper() and "\n" not in x and len(x.split()) > 4][:12]
        words = [" ".join(re.sub(r"[^\w\s-]", "", x).casefold().split()) for x in one]
        bare = " ".join(words)
        if len(one) < 4:
            continue
        want, at = set(), 0
        for w in words[:-1]:
            at += len(w) + 1
            want.add(at)
        got = {a for a, _ in S.decide(bare, S.gaps(bare), model, {})[1:]}
        right, found, true = right + len(got & want), found + len(got), true + len(want)
    assert true > 60 and found, (right, found, true)
    print("unmarked", model.scale, right, found, true)
    if model.scale == "sf0.1":
        assert right / found > 0.6 and right / true > 0.3, (right, found, true)


def test_lines_without_any_mark(model):
    text = "The cells of the first group were kept warm for a day\nThey moved\nThe others of the second group stayed where they were for another two days"
    assert split(model, text) == text.split("\n")


def test_layout(model):
    assert split(model, "Methods\nThe cells were kept.\nResults\nThey moved\nacross the tissue at once.") == ["Methods", "The cells were kept.", "Results", "They moved\nacross the tissue at once."]
    assert split(model, "  One. \r\n\r\n Two.  ") == ["One.", "Two."]
    assert split(model, "It docks.We used light.") == ["It docks.", "We used light."]


def test_tables(spark, model):
    long = "A sentence of words that goes on. " * 20_000
    df = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, " \n ", "", 0), (4, "no end", "", 0), (4, "no end", "", 0), (5, long, "", 0)], DOC)
    n = {r.doc_id: r["count"] for r in S.split_sentences(df, model=model).groupBy("doc_id").count().collect()}
    assert n == {4: 2, 5: 20_000}
    assert S.split_sentences(df.limit(0)).count() == 0


def test_spans_are_trimmed_and_ordered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    last = {}
    for r in S.split_sentences(docs).orderBy("doc_id", "start_pos").collect():
        s = text[r.doc_id][r.start_pos:r.end_pos]
        assert s and s == s.strip() and r.start_pos >= last.get(r.doc_id, 0)
        last[r.doc_id] = r.end_pos


def test_letters_are_kept(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.filter("text is not null").collect()}
    kept = dict.fromkeys(text, "")
    for r in S.split_sentences(docs).orderBy("doc_id", "start_pos").collect():
        kept[r.doc_id] += text[r.doc_id][r.start_pos:r.end_pos]
    assert all("".join(kept[k].split()) == "".join((v or "").split()) for k, v in text.items())


def test_rare_kinds_count(spark, monkeypatch):
    """The model is estimated from every kind of context, also from more than 400,000 of them."""
    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    texts = [(d, "\n\n".join(f"Xu {word(i)}." for i in range(d * 2050, (d + 1) * 2050)), "", 0) for d in range(200)]
    monkeypatch.setattr(S, "Model", lambda kinds, words: list(kinds))
    kinds = S.train(spark.createDataFrame(texts, DOC))
    assert len(kinds) == 410_000 and sum(k[-1] for k in kinds) == 410_000


def test_many_brackets_inside_a_quotation():
    text = "“" + "It was seen (A). " * 12 + "It was lost. We went on,” wrote Moreno. Then they left."
    close = text.index("”")
    assert [g.end for g in S.gaps(text)] == [text.index("Moreno.") + 7, len(text)] and close < text.index("Moreno.")
