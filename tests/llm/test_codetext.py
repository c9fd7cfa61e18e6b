import pytest

from notemill.llm import codetext
from notemill.llm.lexer import cut, edges, effects, lex, prefix_starts, prefix_states, stitch, transition

CODE = '''
Content of code cell #1:import os  # drop the rows without a value
x = "a # b"
def f():
    """Plot how the loss changes.

    # second line
    """
Content of code cell #2:%%bash
# prüfen, ob jede Zeile einen Wert hat
echo "don't" # nur ein Test
Content of code cell #3:y = ("die Ergebnisse " 'werden neben dem '
     r"Notebook gespeichert")
s = 'no end
z = f"keep the {n} last days of it"  # x = df.drop(columns=["a"])
'''


def test_lexer():
    kinds = [(s.kind, s.text.strip()) for s in lex(CODE)]
    assert ("comment", "drop the rows without a value") in kinds and ("string", "a # b") in kinds
    assert ("comment", "prüfen, ob jede Zeile einen Wert hat") in kinds and ("comment", "nur ein Test") in kinds
    assert not any("second line" in t for k, t in kinds if k == "comment")
    assert ("string", "no end") in kinds and ("string", "keep the {n} last days of it") in kinds


@pytest.mark.parametrize("size", [7, 20, 64])
def test_chunks_give_the_same_spans(size):
    chunks = cut(CODE, size)
    assert "".join(c for _, c in chunks) == CODE
    states = prefix_states([transition(c) for _, c in chunks])
    got = stitch([(lex(c, s, at), -1, True) for (at, c), s in zip(chunks, states, strict=True)])
    assert [(s.kind, s.start, s.end, s.text) for s in got] == [(s.kind, s.start, s.end, s.text) for s in lex(CODE)]


@pytest.mark.parametrize("size", [7, 20, 64])
def test_chunks_know_the_open_brackets(size):
    code = "x = ))[\n" + 'y = [(\n  "the model is "\n  # why (not]\n  "trained on all "\n "of the rows"), {\n' * 4 + "Content of code cell #2:a = f(\n'b'\n))\n" + "Content of code cell #3:%%bash\necho ( # one\n" + CODE
    chunks = cut(code, size)
    starts = prefix_starts([effects(c) for _, c in chunks])
    parts = [(c, lex(c, s, at, d), at, k) for k, ((at, c), (s, d)) in enumerate(zip(chunks, starts, strict=True))]
    got = stitch([(spans, edges(c, spans, at, False, False)[2], bool(spans)) for c, spans, at, k in parts])
    assert [(s.kind, s.start, s.end, s.text, s.depth) for s in got] == [(s.kind, s.start, s.end, s.text, s.depth) for s in lex(code)]
    assert max(s.depth for s in got) > 8
    want = list(codetext.units(lex(code)))
    assert list(codetext.units(got)) == want
    # units within the chunks and those of the open ends together are all units
    inner, ends = [], []
    for c, spans, at, k in ((c, lex(c, *starts[k][:1], at, starts[k][1]), at, k) for c, _, at, k in parts):
        within, open_ends, tail = edges(c, spans, at, k == 0, k == len(parts) - 1)
        inner += codetext.units(within)
        ends.append((open_ends, tail, bool(spans)))
    assert sorted(inner + list(codetext.units(stitch(ends)))) == sorted(want) and (size < 20 or inner)


def test_sentence_over_lines_of_a_long_call_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    code = "x = [\n" + "  1,\n" * 100 + '  "the rows without "\n  "a value are "\n  "dropped before training"\n]\n'
    df = spark.createDataFrame([(1, code, 1)], "notebook_id long, code string, scraped_at long")
    whole, pieces = ({tuple(r) for r in codetext.language_in_code(df, docs, chunk=n).collect()} for n in (10_000, 200))
    assert whole == pieces and {r[5] for r in pieces} == {"the rows without a value are dropped before training"}


def test_adjacent_literals_are_one():
    texts = [t for kind, pieces in codetext.units(lex(CODE)) if kind == "string" for _, _, t in pieces]
    assert "die Ergebnisse werden neben dem Notebook gespeichert" in texts
    assert any(t.startswith("keep the  ") for t in texts)


@pytest.mark.parametrize(
    ("text", "natural"),
    [
        ("drop the rows without a value", True), ("x = df.drop(columns=[1])", False), ("for i in range(10):", False), ("SELECT a, count(*) FROM t WHERE b > 3", False),
        ("results are saved next to it", True), ("only three words", False), ("检查每一行是否都有标签", True), ("数据行", False), ("https://a.b/c d e f g", False), ("type: ignore this one here", False), ("a b c d e f", False), ("行の順番を変えてはいけない", True), ("", False),
    ],
)
def test_natural(text, natural):
    assert codetext.is_natural(text) is natural


def test_values():
    span = lex("x = 'V\\xe9rifier l\\'ordre\\n'")[0]
    assert codetext.literal_value(span) == "Vérifier l'ordre\n"


def test_operator_on_whole_and_cut_files(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long_code = "x = 1\n" * 300 + "# on supprime les lignes sans valeur de prix\n" + 's = """\nlos resultados se guardan junto al cuaderno\n' + "y\n" * 200 + '"""\n'
    rows = [(1, CODE, 1), (1, "old", 0), (2, None, 1), (3, "", 1), (4, long_code, 1), (4, long_code, 1)]
    df = spark.createDataFrame(rows, "notebook_id long, code string, scraped_at long")
    want = {(1, "en", "comment"), (1, "de", "comment"), (1, "de", "string"), (1, "en", "string"), (4, "fr", "comment"), (4, "es", "string")}
    whole = codetext.language_in_code(df, docs)
    pieces = codetext.language_in_code(df, docs, chunk=200)
    columns = ["notebook_id", "lang", "found_in"]
    assert {tuple(r) for r in whole.select(*columns).collect()} == want
    assert {tuple(r) for r in pieces.collect()} == {tuple(r) for r in whole.collect()}
    shares = codetext.language_shares(whole).collect()
    assert all(0 < r["share"] <= 1 for r in shares)
    assert codetext.language_in_code(df.limit(0), docs).count() == 0


def test_language_model_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    nb = spark.read.parquet("/root/testdata/sf0.01/nb_contents.parquet")
    model = codetext.train(docs.where("doc_id % 4 <> 0"), nb)
    hits = [model.predict(r["text"][:400])[0] == r["lang"] for r in docs.where("doc_id % 4 = 0").where(docs.lang.isin(codetext.LANGUAGES)).where("n_chars > 60 and text not like '%lund%'").collect()]
    assert len(hits) > 80 and sum(hits) / len(hits) > 0.95


@pytest.mark.parametrize("lines", [2, 7, 8, 30])
def test_a_sentence_over_any_number_of_lines(spark, lines):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = (["the", "rows", "without", "a", "value", "are", "dropped", "before", "training", "and", "the", "rest", "of", "them", "is", "saved", "in", "a", "new", "file", "which", "we", "read", "again", "when", "the", "model", "is", "tested", "today"] * 2)[: max(lines, 6)]
    spread = [" ".join(words[k::lines] if lines < 6 else [words[k]]) for k in range(lines)]
    doc = 'x = """\n' + "\n".join(spread) + '\n"""\n'
    notes = "".join(f"# {w}\n" for w in spread)
    df = spark.createDataFrame([(1, doc, 1), (2, notes, 1)], "notebook_id long, code string, scraped_at long")
    got = {(r["notebook_id"], r["lang"], r["found_in"]) for r in codetext.language_in_code(df, docs).collect()}
    assert got == {(1, "en", "string"), (2, "en", "comment")}


def test_a_huge_file_is_shared_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = "".join(f"value_{i} = compute(a[{i}], b)\n" for i in range(4000))
    planted = ["# on supprime les lignes sans valeur de prix\n", 's = """\nlos resultados se guardan junto al cuaderno\n"""\n', "x = ('the rows without '\n  'a value are '\n  'dropped before training')\n"]
    code = "".join(part + planted[i % 3] for i in range(90))
    assert len(code) > 10_000_000
    df = spark.createDataFrame([(1, code, 1)], "notebook_id long, code string, scraped_at long")
    found = codetext.language_in_code(df, docs)
    got = found.collect()
    assert len(got) == 90 and {(r["lang"], r["found_in"]) for r in got} == {("fr", "comment"), ("es", "string"), ("en", "string")}
    assert all(code[r["start_pos"] : r["end_pos"]].strip()[:1] in "#'\"" for r in got)
