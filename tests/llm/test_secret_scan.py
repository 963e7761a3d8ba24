import hashlib
import re

from math import factorial, log10

from sluice.llm import secret_scan as s
from sluice.llm.guess_cost import _alphabet, log10_guesses, spans_of

ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s.KINDS[k], a, e) for a, k, e in sorted(found)]


def test_base_spans_match_the_plain_patterns(rnd):
    pieces = ["password", "PassWD", "secret", "toKen", "api_key", "ApiKey", " ", "  ", ":", "=", '"', "'", "hunter2abc", "AKIA",
              "AKIAABCDEFGH12345", "0123456789abcdef" * 2, "deadbeef", "é", "ſ", "K", "\n", "Tok", "aaaa-bbbb", "x.y=z"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))
        assert [x[:3] for x in s.find_secrets(text) if x[0] != "guess"] == base(text), text


def test_values_in_context_are_judged_by_their_cost():
    def kinds(text):
        return [(k, text[a:e]) for k, a, e, _ in s.find_secrets(text)]

    assert kinds("pwd: hV7$kq2!xz.") == [("guess", "hV7$kq2!xz")]
    assert kinds('passphrase = "tr0ub4dor&3-x9"') == [("guess", "tr0ub4dor&3-x9")]
    assert kinds("pwd: password1") == [] and kinds("pin: 123456") == [] and kinds("pwd: qwerty") == []
    assert kinds("auth: thewholething") == []  # a plain word
    assert kinds("the author: X$9kd83hfa") == []  # another word ends there
    assert kinds("token = " + "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")[0][0] == "assign"


def test_costs_follow_the_patterns():
    assert log10_guesses("") == 0
    assert log10_guesses("password") < log10_guesses("P@ssword") < log10_guesses("password2019") < log10_guesses("hV7$kq2!")
    assert log10_guesses("aaaaaaaaaa") < log10_guesses("asdfghjkl") < log10_guesses("akxmqpzwvt")
    assert log10_guesses("31/12/1999") < log10_guesses("93/72/1482")
    assert log10_guesses("drowssap") < 2


def test_query_columns_and_odd_rows(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (70, "x token = abcdefgh12 pwd: hV7$kq2!xz", "en", "a")])
    got = s.scan(docs).collect()
    assert len(got) == len(odd_rows) + 1
    assert [tuple(x)[:3] for r in got if r["doc_id"] == 70 for x in r["spans"]] == [("assign", 2, 20), ("guess", 26, 36)]
    assert all(r["spans"] == [] for r in got if r["doc_id"] != 70)
    assert s.scan(docs.limit(0)).count() == 0


def test_digest_of_the_query(spark, make_docs, tmp_path):
    make_docs([(1, "secret: abcdefgh1 AKIAABCDEFGH12345", "en", "a"), (2, None, "en", "a")]).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in s.op1_secret_scan(spark, str(tmp_path)).collect()}
    assert got[1]["spans"] == "assign:0:17,access:18:35" and (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 0)
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_cost_is_the_least_of_all_cuts(rnd):
    pieces = ["love", "1999", "aaa", "qwer", "X", "7$", "dragon", "12/3/99", "k", "abab", "Zz", "god"]
    for _ in range(150):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4)))[:11]
        rest = _alphabet(text)
        found = {}
        for i, j, cost in spans_of(text, rest):
            found[i, j] = min(cost, found.get((i, j), cost))
        least = float("inf")
        for cuts in range(1 << (len(text) - 1)):
            ends = [0, *(k + 1 for k in range(len(text) - 1) if cuts >> k & 1), len(text)]
            cost = sum(min(found.get((a, b), 1e9), (b - a) * log10(rest)) for a, b in zip(ends, ends[1:]))
            least = min(least, cost + log10(factorial(len(ends) - 1)))
        assert abs(log10_guesses(text) - least) < 1e-6, text


def test_cuts_have_no_limit_of_spans_and_values_none_of_length():
    many = "Dragon-summer-" * 5
    assert log10_guesses(many.rstrip("-")) < 55
    for n in (100, 200, 5000):
        assert s.find_secrets(f"pwd='{'x' * n}'") == []
    import string
    hard = "".join(string.printable[(7 * k * k + 3 * k) % 62] for k in range(3000))
    (kind, start, end, cost), = s.find_secrets(f"pwd='{hard}'")
    assert (kind, start, end) == ("guess", 5, 3005) and cost > 100


def test_a_value_that_reaches_beyond_a_base_span_is_found():
    text = "secret: abcd1234$%Rest!9"
    assert [x[:3] for x in s.find_secrets(text)] == [("assign", 0, 16), ("guess", 8, 24)]
