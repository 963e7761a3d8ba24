import pytest

from sluice.llm import decontaminate as d

from texts import ITEM, prose


@pytest.fixture
def bench(spark, rnd):
    rows = [(1, ITEM), (2, prose(rnd, 40)), (3, "only four words here"), (4, None), (5, "the quick brown fox jumps over it"),
            (None, prose(rnd, 30)), (6, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_and_new_parameters_are_found_but_not_inconsistent_ones(make_docs, bench, rnd):
    texts = {r["item_id"]: r["text"] for r in bench.collect()}
    same = ITEM.replace("3", "8").replace("Ann", "Eve").replace("5 miles", "9 miles")
    torn = ITEM.replace("3 of", "4 of")
    rows = [
        (10, prose(rnd, 50) + " " + ITEM + " " + prose(rnd, 50), "en", "a"),
        (11, prose(rnd, 50) + "\n" + same, "en", "a"),
        (12, prose(rnd, 50) + " " + torn, "en", "a"),
        (13, texts[2], "en", "a"),
        (14, prose(rnd, 200), "en", "a"),
        (15, "so the quick brown fox jumps over it again", "en", "a"),
        (16, texts[2] + " " + texts[None] + " " + texts[2], "en", "a"),
        (17, " ".join(texts[2].split()[5:30]), "en", "a"),
    ]
    docs = make_docs(rows)
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in d.find_leaks(docs, bench).collect()}
    assert got == {(10, 1): False, (11, 1): True, (13, 2): False, (15, 5): False, (16, 2): False, (16, None): False,
                   (17, 2): False}
    kept = d.drop_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 14] and kept.columns == docs.columns


def test_odd_rows_and_empty_tables(make_docs, odd_rows, bench):
    docs = make_docs(odd_rows)
    assert d.find_leaks(docs, bench).count() == 0
    assert d.drop_leaks(docs, bench).count() == len(odd_rows)
    assert d.find_leaks(docs.limit(0), bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0


def test_repeated_rows_and_a_shared_passage(make_docs, bench, rnd):
    rows = [(i, prose(rnd, 20) + " " + ITEM, "en", "a") for i in range(40)] + [(50, ITEM, "en", "a")] * 3
    got = [r["doc_id"] for r in d.find_leaks(make_docs(rows), bench).collect()]
    assert sorted(got) == [*range(40), 50]


def test_word_codes():
    assert d.word_code("3,000") == d.word_code("$5") == d.word_code("seven,") == d.NUM
    assert d.word_code("Paris") == d.word_code("(Ann)") == d.NAME
    assert d.word_code("word,") == d.word_code("word") and d.word_code("word") & 1
    assert d.Templates()(["5", "km", "km"]).tolist()[1] == d.UNIT


def test_torn_long_copies_equal_values_and_one_changed_word_are_found(spark, make_docs, rnd):
    long = "the value 3 is first " + prose(rnd, 40).lower() + " and the value 3 is last of all"
    twenty = prose(rnd, 20).lower().split()
    bench = spark.createDataFrame([(1, ITEM), (2, long), (3, " ".join(twenty))], "item_id long, text string")
    rows = [
        (10, prose(rnd, 30) + " " + ITEM.replace("3", "4").replace("5", "4"), "en", "a"),
        (11, prose(rnd, 30) + " " + long.replace("3 is last", "4 is last"), "en", "a"),
        (12, " ".join([*twenty[:10], "changed", *twenty[11:]]), "en", "a"),
        (13, ITEM.replace("3 of", "4 of"), "en", "a"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["reparameterised"], r["n_words"]) for r in d.find_leaks(make_docs(rows), bench).collect()}
    assert got == {(10, 1): (True, 25), (11, 2): (False, 48), (12, 3): (False, 19)}


def test_passages_of_numbers_and_names_match_exact_copies(spark, make_docs, rnd):
    sums = "3 8 14 22 31 45 58 67 73 88 91 104 110 127"
    title = "The Old Man And The Sea By Ernest Hemingway New York Charles Scribner Sons 1952"
    partly = "we saw that red house near Alan Bob Carl Dora Eve 7"
    bench = spark.createDataFrame([(1, sums), (2, title), (3, partly)], "item_id long, text string")
    rows = [(10 + i, f"{prose(rnd, 30)} Then {t} {prose(rnd, 30)}", "en", "a") for i, t in enumerate((sums, title, partly))]
    rows += [(20, prose(rnd, 9) + " " + sums.replace("58", "59"), "en", "a"),
             (21, title.replace("Ernest", "Jack").replace("Sea", "Lake"), "en", "a")]
    got = {(r["doc_id"], r["item_id"], r["n_words"]) for r in d.find_leaks(make_docs(rows), bench).collect()}
    assert got == {(10, 1, len(sums.split())), (11, 2, len(title.split())), (12, 3, len(partly.split()))}


def test_items_of_few_words_match_whole_documents_only(spark, make_docs):
    docs = make_docs([(1, "what is two plus", "en", "a"), (2, "Well what is two plus two", "en", "a"), (3, "what is  Two plus?", "en", "a"),
                      (4, "what is one plus", "en", "a"), (5, "Yes.", "en", "a"), (6, "yes", "en", "a"), (7, None, "en", "a")])
    items = spark.createDataFrame([(1, "what is two plus"), (2, "yes"), (3, ""), (4, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_words"]) for r in d.find_leaks(docs, items).collect())
    assert got == [(1, 1, 4), (3, 1, 4), (5, 2, 1), (6, 2, 1)]
