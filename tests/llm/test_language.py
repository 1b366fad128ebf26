import pytest

from arborlens.llm import language as G


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def rows(samples):
    return [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]


def test_held_out_samples(rows):
    for k in range(3):
        model = G.Contexts([s for i, s in enumerate(rows) if i // 6 % 3 != k])
        held = [s for i, s in enumerate(rows) if i // 6 % 3 == k]
        right = sum(lang == held[i][0] for i, _, lang, _, _ in G.score(model, [t for _, t in held]))
        assert right / len(held) >= 0.98


def test_code_lengths_are_those_of_a_distribution(rows):
    model = G.Contexts(rows)
    tree = model.trees[0]
    for ctx in (b"", b" ", b" th", b"zz"):
        if (node := tree.get(ctx)) is not None:
            assert abs(sum(2 ** -b for b in node[0].values()) + 2 ** -node[1] - 1) < 1e-9
    assert model.bits("the")[model.langs.index("en")] < model.bits("the")[model.langs.index("nl")]


def test_labels():
    assert [G.label_code(x) for x in ("en", "en_GB", "EN", "eng", " English ", "pt-BR", "Deutsch", "ger", "und", "xx", "", None, "??", "fr-CA", "nld")] == ["en", "en", "en", "en", "en", "pt", "de", "de", None, None, None, None, None, "fr", "nl"]


def test_paragraphs_are_blocks_between_blank_lines():
    text = "One two.\n\n```\ncode();\n\nmore();\n```\n \t\nThree.\r\n\r\n2021-01-02 10:00 | WRITE | a/b.go | 3\n\n\nFour `x.go` five"
    got = G.paragraphs(text)
    assert len(got) == 6 and got[0] == "One two." and got[3] == "Three." and got[4].strip() == "" and got[5].split() == ["Four", "five"]
    assert [G._WORD.findall(got[i]) for i in (1, 2)] == [[], []]


def test_documents_and_paragraphs(spark, samples, rows):
    by = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    en, de, fr = by["en"], by["de"], by["fr"]
    docs = [
        (1, en[0] + " " + en[1], "de", 0), (2, en[0] + " " + en[1] + " " + en[2] + "\n\n" + de[0], "English", 0), (3, "", "en", 0), (4, None, None, 0), (5, "```\nfoo(bar);\n```", "en", 0), (6, fr[0].upper(), None, 0),
        (7, fr[1].encode().decode("latin-1"), "fr", 0), (8, en[3] * 200 + "\n\n" + de[1], "en-US", 0), (9, "123 456", "xx", 0),
    ]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string, lang string, para_no int")
    got = sorted((x["doc_id"], x["para_no"], x["lang"]) for x in G.cases(df, samples).collect())
    assert got == [(1, 0, "en"), (1, 0, "en"), (2, 2, "de"), (6, 0, "fr"), (8, 2, "de")]
    every = G.identify(df, samples).collect()
    assert all(0 < x["confidence"] <= 1 and x["words"] > 0 for x in every)
    assert {x["doc_id"] for x in every} == {1, 2, 6, 7, 8}
    assert G.identify(df.limit(0), samples).count() == 0
