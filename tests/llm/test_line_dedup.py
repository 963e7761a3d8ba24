import duckdb

from sluice.llm import line_dedup as d


def brute(rows):
    """Plain count over (id, text) with distinct ids."""
    seen, covered = set(), {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        filled = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\f\r")]
        for a, _, c in zip(filled, filled[1:], filled[2:]):
            body = tuple(x for _, x in filled[filled.index(a):filled.index(c) + 1])
            if body in seen:
                covered.setdefault(i, set()).update(range(a[0], c[0] + 1))
            seen.add(body)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in covered.get(i, ()))
            for i, t in rows}


def test_matches_brute_force_and_sql(make_docs, rnd, tmp_path):
    lines = ["alpha", "beta", "gamma", "delta", "", " ", "eps"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14))), "en", "a") for i in range(120)]
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "a\nb", "en", "a"), (503, "a\nb", "en", "a")]
    docs = make_docs(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in d.dedup_lines(docs).collect()}
    assert {i: t for i, (_, _, t) in got.items()} == brute([(i, t) for i, t, *_ in rows])
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(d.OP3_SQL).fetchall()} == got


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = d.dedup_lines(docs)
    # no text here has a repeated window, so all come back as they were, columns included
    assert sorted(map(str, got.select("doc_id", "text", "k1", "K2").collect())) == sorted(
        map(str, docs.select("doc_id", "text", "k1", "K2").collect()))
    assert d.dedup_lines(docs.limit(0)).count() == 0


def test_a_repeated_row_is_one_document_and_null_ids_come_first(make_docs):
    body = "l1\nl2\nl3"
    docs = make_docs([(5, body, "en", "a"), (5, body, "en", "a"), (6, "x\n" + body + "\ny", "en", "a")])
    got = sorted((r["doc_id"], r["text"]) for r in d.dedup_lines(docs).collect())
    assert got == [(5, body), (5, body), (6, "x\ny")]
    docs = make_docs([(None, body, None, None), (1, body + "\nz", "en", "a")])
    assert {r["doc_id"]: r["text"] for r in d.dedup_lines(docs).collect()} == {None: body, 1: "z"}


def test_runs_in_the_jvm_only(make_docs):
    plan = d.dedup_lines(make_docs([(1, "a\nb\nc", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
