import re

from sluice.llm import quality_rules as q

from texts import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_match_a_plain_count(rnd):
    texts = [None, "", "a", "a a a a", "a b c a b c", "x y\x1cz", "a\n\na\n \na", "#<>|&%$* é b"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    texts += ["\n".join(rnd.choice(["l m", "", " ", "n o p"]) for _ in range(8)) for _ in range(20)]
    for t in texts:
        assert q.text_counts(t)[:5] == brute(t), t


def test_outliers_go_and_plain_texts_stay(make_docs, rnd):
    rows = [(i, prose(rnd, rnd.randint(60, 200)), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rnd, 100).split()), "en", "a") for i in range(12)]
    shout = [(2000 + i, prose(rnd, 100).upper(), "en", "a") for i in range(12)]
    docs = make_docs(rows + junk + shout)
    got = {r["doc_id"]: r["kept"] for r in q.judge(docs).collect()}
    assert all(got[i] for i, *_ in rows) and not any(got[i] for i, *_ in junk + shout)
    assert sorted(r["doc_id"] for r in q.keep(docs).collect()) == sorted(i for i, *_ in rows)
    assert q.keep(docs).columns == docs.columns


def test_odd_rows_and_few_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = q.judge(docs).collect()
    assert len(got) == len(odd_rows)
    # fewer than MIN_ROWS passing rows: the base rules decide alone
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert [r["kept"] for r in got if r["n_words"] == 0] == [False] * 4
    assert q.judge(docs.limit(0)).count() == 0 and q.keep(docs.limit(0)).count() == 0


def test_small_sources_are_judged_with_their_language(make_docs, rnd):
    rows = [(i, prose(rnd, 100), "en", f"s{i % 9}") for i in range(90)]
    junk = [(500, " ".join(w + "$$$" for w in prose(rnd, 100).split()), "en", "s1")]
    got = {r["doc_id"]: r["kept"] for r in q.judge(make_docs(rows + junk)).collect()}
    assert not got[500] and all(got[i] for i in range(90))


def test_a_tiny_source_is_judged_with_the_large_one_of_its_language(make_docs, rnd):
    def junk(n):
        return " ".join(w + "$$$" for w in prose(rnd, n).split())

    rows = [(i, prose(rnd, 100), "en", "big") for i in range(150)] + [(200, prose(rnd, 100), "en", "tiny")]
    rows += [(i, prose(rnd, 100), "en", None) for i in range(300, 370)]
    bad = [(500 + i, junk(90 + i), "en", "tiny") for i in range(3)] + [(510, junk(100), "rare", "x"), (511, junk(80), None, None)]
    got = {r["doc_id"]: r["kept"] for r in q.judge(make_docs(rows + bad)).collect()}
    assert not any(got[i] for i, *_ in bad) and all(got[i] for i, *_ in rows)


def test_a_source_that_is_mostly_copies_keeps_its_other_texts(make_docs, rnd):
    copy = prose(rnd, 100)
    rows = [(i, copy, "en", "a") for i in range(320)] + [(1000 + i, prose(rnd, rnd.randint(60, 200)), "en", "a") for i in range(80)]
    junk = [(2000, " ".join(w + "###" for w in prose(rnd, 100).split()), "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in q.judge(make_docs(rows + junk)).collect()}
    assert all(got[i] for i, *_ in rows) and not got[2000]


def test_moderate_outliers_go_and_one_repeated_line_stays(make_docs, rnd):
    def lines(n):
        words = prose(rnd, n).split()
        return [" ".join(words[i:i + 10]) for i in range(0, n, 10)]

    rows = [(i, "\n".join(lines(rnd.randint(6, 20) * 10)), "en", "a") for i in range(300)]
    again = [(1000 + i, "\n".join([*a, a[1]]), "en", "a") for i in range(10) for a in [lines(70)]]
    laden = [(2000 + i, " ".join(w + "#" * (k % 7 == 0) for k, w in enumerate(prose(rnd, 100).split())), "en", "a") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in q.judge(make_docs(rows + again + laden)).collect()}
    assert not any(got[i] for i, *_ in laden)
    assert all(got[i] for i, *_ in again) and sum(got[i] for i, *_ in rows) >= 297
