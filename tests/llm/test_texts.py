import random

import pytest

from notemill.llm import leakage, markup, sentences
from notemill.llm.markup import parse


def units(text, lang=None):
    return [text[a:b] for a, b in sentences.sentences(text, lang)]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("en", "Dr. Smith saw 3.5 cats, e.g. two. They left at 5 p.m. In Sec. 2 it ends.", ["Dr. Smith saw 3.5 cats, e.g. two.", "They left at 5 p.m.", "In Sec. 2 it ends."]),
        ("en", '"It works!" wrote Ann. Wait... did it? Yes (really!) it did. 🙂 Done', ['"It works!" wrote Ann.', "Wait... did it?", "Yes (really!) it did. 🙂", "Done"]),
        ("en", "use np.nan for x. it failed. by 9 a.m. and later.the end", ["use np.nan for x.", "it failed.", "by 9 a.m. and later.", "the end"]),
        ("en", "It is slow :( We wait.\nA line\nbreak ends nothing.", ["It is slow :(", "We wait.", "A line\nbreak ends nothing."]),
        ("de", "Am 3. Mai kam z.B. Dr. Alt. „Es geht!“, rief er. Der 2. Lauf.", ["Am 3. Mai kam z.B. Dr. Alt.", "„Es geht!“, rief er.", "Der 2. Lauf."]),
        ("fr", "Quelle surprise ! M. Roy dit oui. « Ça marche ! » écrit Zoé.", ["Quelle surprise !", "M. Roy dit oui.", "« Ça marche ! » écrit Zoé."]),
        ("es", "¡Hola! ¿Qué tal? La Sra. Paz, p. ej. hoy, va.", ["¡Hola!", "¿Qué tal?", "La Sra. Paz, p. ej. hoy, va."]),
        ("ru", "В 2023 г. вышло много, т.е. два. См. рис. 2 ниже. «Да!» — сказал он.", ["В 2023 г. вышло много, т.е. два.", "См. рис. 2 ниже.", "«Да!» — сказал он."]),
        ("zh", "真没想到！他说：“好了！”我笑。快了……但是贵。", ["真没想到！", "他说：“好了！”我笑。", "快了……但是贵。"]),
        ("ja", "驚いた！「動いた！」と書いた。終わり。", ["驚いた！", "「動いた！」と書いた。", "終わり。"]),
        ("ko", '놀랍네요! "됩니다!"라고 썼다. 끝.', ["놀랍네요!", '"됩니다!"라고 썼다.', "끝."]),
        ("hi", "यह है। क्यों नहीं? 2.5 है।", ["यह है।", "क्यों नहीं?", "2.5 है।"]),
        ("ar", "لماذا؟ كتب: «يعمل!» ثم ذهب. نعم.", ["لماذا؟", "كتب: «يعمل!» ثم ذهب.", "نعم."]),
        ("th", "ไปแล้วครับ มาแล้วค่ะ ดี", ["ไปแล้วครับ", "มาแล้วค่ะ", "ดี"]),
        (None, "", []),
        (None, "  \n ", []),
    ],
)
def test_sentences(lang, text, want):
    assert units(text, lang) == want


def test_blocks():
    text = "# Head. Two\nText one. Text two.\n\nTitle line\nIt starts here. It ends.\n\n- item one. more\n- item two\n\n```py\nx = 1. y\n```\nAfter"
    assert units(text, "en") == ["# Head. Two", "Text one.", "Text two.", "Title line", "It starts here.", "It ends.", "- item one. more", "- item two", "After"]


def test_sentences_cover_the_text_in_order(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("text", "lang").collect()
    for r in rows:
        spans = sentences.sentences(r["text"], r["lang"])
        assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
        assert all(r["text"][a:b] == r["text"][a:b].strip() for a, b in spans)


def test_sentence_operator(spark):
    schema = "doc_id long, text string, lang string, start_pos int"
    df = spark.createDataFrame([(1, "A b. C d.", "xx", 0), (2, None, "en", 0), (3, "", None, 0), (4, "🙂 x. Y", None, 0), (5, "word " * 60000 + ".", "en", 0)], schema)
    got = {}
    for r in sentences.split_sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    assert got == {1: [(0, 4), (5, 9)], 4: [(0, 4), (5, 6)], 5: [(0, 300001)]}
    assert sentences.split_sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# T\n\n- a\n- b\n\n> q\n\n**x** and [l](u)", {("markdown", s) for s in ("heading", "list", "quote", "emphasis", "link")}),
        ("Title\n=====\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n~~old~~ `c`", {("markdown", s) for s in ("heading", "table", "emphasis", "code")}),
        ("```\n# no\n<b>x</b>\n$a$\n```", {("markdown", "code")}),
        ("<h1>T</h1><p>a<br/> &amp; <!-- **no** --> <u>x", {("html", s) for s in ("heading", "layout", "entity", "comment", "emphasis")}),
        ("<A HREF='x' title='a > b'>t</A> <pre># x</pre> <ul><li>a</ul>", {("html", s) for s in ("link", "code", "list")}),
        (r"\section{A} \textbf{b} $x^2$ \href{u}{t}" + "\n\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\n\\begin{verbatim}\n# x\n\\end{verbatim}", {("latex", s) for s in ("heading", "emphasis", "formula", "link", "list", "code")}),
        ("== W ==\n\n'''b''' [[Page|x]]\n\n{| class=\"x\"\n|-\n| a || b\n|}", {("wiki", s) for s in ("heading", "emphasis", "link", "table")}),
        ("List<int> p < 0.05 and q > 1, $5 to $12, 2 * 3 * 4, max_depth and min_child_weight, R&D, df[['a','b']], x[[1]], C# ~3 ^_^ C:\\new\\table", set()),
        ("", set()),
    ],
)
def test_markup(text, want):
    assert set(parse(text)[1]) == want


def test_frame_is_no_markup():
    text = "Markdown Narrative from: a_b_c.ipynb\n" + "=" * 50 + "\n\nMarkdown Cell #1:\nplain\n\n" + "-" * 30 + "\n\nMarkdown Cell #2:\nmore\n\n" + "-" * 30 + "\n\n"
    assert parse(text) == ("plain\n\nmore", {})


def test_clean_text_keeps_structure():
    clean, _ = parse("# Head *x*\n\nText with <b>bold</b> and [link](http://x).\n\n- one\n- two\n\n```py\na_b = 1\n```\n\n$$\nE=mc^2\n$$")
    assert clean == "# Head x\n\nText with bold and link.\n\n- one\n- two\n\n```\na_b = 1\n```\n\n$$\nE=mc^2\n$$"


def test_sections_of_links_are_dropped():
    nav = "# Links\n\n" + "[one page](u) [another page](u) [third page](u)"
    body = "# Text\n\n" + "A sentence, with commas, and words enough to count. " * 6
    clean, _ = parse(f"{nav}\n\n{body}")
    assert "another page" not in clean and "words enough" in clean


def test_markup_operator(spark):
    schema = "notebook_id long, markdown_narrative string, scraped_at long, clean_text string"
    df = spark.createDataFrame([(1, "**old**", 1, ""), (1, "new", 2, ""), (1, "new", 2, ""), (2, None, 1, ""), (3, "", 1, ""), (4, "# x\n" * 20000, 1, "")], schema)
    got = {r["notebook_id"]: r for r in markup.strip_markup(df).collect()}
    assert set(got) == {1, 3, 4} and got[1]["clean_text"] == "new" and got[4]["structures"][0]["n"] == 20000
    assert markup.strip_markup(df.limit(0)).count() == 0


def distance_leak(item, words, run=12, edits=2):
    """Plain dynamic programming over every run of the item."""
    for p in range(len(item) - run + 1):
        pattern = item[p : p + run]
        row = [0] * (len(words) + 1)
        for i, w in enumerate(pattern, 1):
            new = [i]
            for j, v in enumerate(words, 1):
                new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
            row = new
        if min(row) <= edits:
            return True
    return False


def test_leaks_equal_dynamic_programming():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "in"] * 8
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(8, 30))] for i in range(40)}
    index = leakage.ItemIndex({i: (w, 0, len(w)) for i, w in items.items()})
    leaks = 0
    for _ in range(150):
        item = items[rng.randrange(40)]
        part = item[rng.randrange(3) :][: rng.randrange(9, 16)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(part) + 1)
            part = rng.choice([part[:k] + [rng.choice(vocabulary)] + part[k:], part[:k] + part[k + 1 :], part[:k] + ["zz"] + part[k + 1 :]])
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + part + [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        want = {i for i, own in items.items() if len(own) >= 12 and distance_leak(own, words)}
        got = {index.ids[at] for at in index.leaks(words)}
        assert got == want
        leaks += len(want)
    assert leaks > 40


def test_words_as_a_reader_takes_them():
    plain = leakage.words_of("At Givalund the silver crate, i.e. one")
    assert plain == ["at", "givalund", "the", "silver", "crate", "ie", "one"]
    for altered in ("AT GIVALUND THE SILVER CRATE, I.E. ONE", "At Giva\u00adlund thе si\u200blver crаte[3], i.e. one", 'At **Givalund,** <span class="q">the</span> silver\n&nbsp;crate, i.e. _one_', "At \\emph{Givalund} the [silver](http://x.y/z) cra-\nte i.e. ｏｎｅ"):
        assert leakage.words_of(altered) == plain


def test_leak_operator(spark):
    item = "Read the text first and then answer. At noon the old red fox ran over nine tall hills near the quiet lake while rain fell. Where was it?"
    other = "Read the text first and then answer. Many green ships sailed past seven bright harbours before the long storm ended that winter night. What was seen?"
    items = spark.createDataFrame([(k, f"Read the text first and then answer. {' '.join(f'z{k}a{j}' for j in range(14))}. What is z{k}?") for k in range(3, 8)] + [(1, item), (2, other), (9, None), (10, "short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "So: at noon the old red dog ran over tall hills near the quiet lake."), (2, "Read the text first and then answer. Nothing else is here to be read at all."), (3, None), (4, ""), (5, "ship " * 50000 + other), (6, "at noon the old red fox")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (5, 2)}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 5, 50])
def test_items_on_one_passage_keep_it(spark, n):
    passage = "At noon the old red fox ran over nine tall hills near the quiet lake. Then seven grey geese slept under a wooden bridge until the morning rain had stopped."
    items = spark.createDataFrame([(k, f"{passage} What did number {k} see there?") for k in range(n)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"It says: {passage}"), (2, "then seven grey geese slept under some wooden bridge until the morning")], "doc_id long, text string")
    got = leakage.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, k) for d in (1, 2) for k in range(n)}
    assert all(r["passage_share"] == (1.0 if r["doc_id"] == 1 else pytest.approx(12 / 29, abs=0.1)) for r in got)


def test_question_and_passage_are_verified_apart(spark):
    passage, question = "Many green ships sailed past seven bright harbours before the long storm ended.", "Which of the ships was the last to come home that very winter night?"
    items = spark.createDataFrame([(1, f"{passage} {question}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, question), (3, f"{passage} {question}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["passage_share"], r["question_share"]) for r in leakage.find_leaks(docs, items).collect()}
    assert got[1][0] == 1.0 and got[1][1] < 0.2 and got[2][1] == 1.0 and got[2][0] < 0.2 and got[3] == (1.0, 1.0)


def test_instruction_alone_is_no_leak():
    texts = {k: f"Read the text first and then answer all of it in one word only. {' '.join(f'z{k}a{j}' for j in range(14))}. What is z{k}?" for k in range(6)}
    index = leakage.item_index(texts)
    assert not index.leaks(leakage.words_of("Read the text first and then answer all of it in one word only. z1a0 z1a1 and nothing else"))
    # a match that begins in the instruction needs most of its words beyond it
    assert [index.ids[a] for a in index.leaks(leakage.words_of("one word only. " + " ".join(f"z3a{j}" for j in range(9))))] == [3]


def test_indexed_rules_decide_like_the_whole_cascade(spark, monkeypatch):
    """Rules chosen by neighbours and the short cut for plain ends change nothing."""
    rng = random.Random(9)
    parts = ["Dr", "etc", "e.g", "x", "5", "3.2", "Word", "word", "p.m", "usw", "г", "то", "好了", "動く", "됩니다", "है", "نعم", "ไป", "“", '"', "(", ")", "»", "「", "」", ":)", "[3]", "http://a.b", "_x", "no", "ph.d", "U.S", "д-р", "डॉ"]
    texts = ["".join(rng.choice(parts) + rng.choice([". ", ".", "! ", "? ", "... ", "…", "。", " ", ", ", "।", ".\n", "?! ", ": "]) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    texts = [(t, rng.choice([*sentences.LANGUAGE, None])) for t in texts]
    texts += [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text", "lang").collect()]
    got = [sentences.sentences(t, lang) for t, lang in texts]
    whole = {(k, low): sentences.cascade(k, low) for k in sentences.LANGUAGE for low in (False, True)}
    monkeypatch.setattr(sentences, "_CASCADES", {key: {a + b + c: rules for a in sentences.PREVIOUS for b in sentences.NEXT for c in sentences.STOPS} for key, rules in whole.items()})
    monkeypatch.setattr(sentences, "_plain_end", lambda body, k, s, e: False)
    monkeypatch.setattr(sentences, "tail_of", lambda body, last, s, e, plain: " ".join(body[last:e].rsplit(None, 3)[-3:]))
    for (text, lang), spans in zip(texts, got, strict=True):
        assert sentences.sentences(text, lang) == spans, (text, lang)


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("hi", "डॉ. राम आए। वे ठीक हैं।", ["डॉ. राम आए।", "वे ठीक हैं।"]),
        ("ar", "وصل د. سامي اليوم. ثم ذهب.", ["وصل د. سامي اليوم.", "ثم ذهب."]),
        ("th", "ปี พ.ศ. 2566 มาแล้วครับ ไปแล้ว", ["ปี พ.ศ. 2566 มาแล้วครับ", "ไปแล้ว"]),
        ("ko", "Fig. 3을 보세요. 끝.", ["Fig. 3을 보세요.", "끝."]),
        ("en", 'He said "' + "it works well and runs on. " * 5 + 'It does" and left. Then he slept.', ['He said "' + "it works well and runs on. " * 5 + 'It does" and left.', "Then he slept."]),
        ("en", "we meet at 5 p.m. in practice, it is later. step 3 is done.", ["we meet at 5 p.m.", "in practice, it is later.", "step 3 is done."]),
    ],
)
def test_rules_of_scripts_and_long_quotations(lang, text, want):
    assert units(text, lang) == want


def test_sentence_texts_are_those_of_the_spans(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en"), (1, "A b. C d.", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["sentence"] for r in sentences.sentence_texts(df).collect()) == ["A b.", "A b.", "C d.", "C d."]


def test_best_container_and_its_siblings_are_kept():
    article = "# Text\n\n" + "A sentence, with commas, and words enough to count. " * 6
    for around in ("# Menu\n\nHome About Contact", "<div><nav>Home About Contact Us Login</nav></div>", "<footer><ul><li>Imprint</li><li>Privacy Policy</li></ul></footer>", "# More\n\n[one page](u) [another page](u)"):
        for text in (f"{around}\n\n{article}", f"{article}\n\n{around}"):
            clean, _ = parse(text)
            assert "words enough" in clean and not any(w in clean for w in ("About", "Imprint", "another page", "Menu")), (around, clean)
    clean, _ = parse(f"{article}\n\n<div><p>A short note.</p><section>see the plot below</section></div>\n\n# Steps\n\n- load\n- fit\n\n# Data\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert all(w in clean for w in ("A short note.", "see the plot below", "- load\n- fit", "1\t2"))


def test_structures_belong_to_nodes():
    root = markup.Cell("# Head **x**\n\ntext with `code` and $a^2$\n\n<div>in [l](u)</div>").root
    found = {n.kind: set(n.found) for n in root.walk() if n.found}
    assert found["heading"] == {("markdown", "heading"), ("markdown", "emphasis")} and found["cell"] == {("html", "layout")}
    assert [set(n.found) for n in root.walk() if n.kind == "paragraph"] == [{("markdown", "code"), ("latex", "formula")}, {("markdown", "link")}]
    assert any(n.kind == "div" and n.children for n in root.walk())
