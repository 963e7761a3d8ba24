import numpy as np

from sluice.llm import ngram_join as n
from sluice.llm.components import connected_components
from sluice.llm.shingles import MinHash, Shingler

from texts import prose


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Links and groups by comparing all pairs of rows."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return links, group


def edited(rnd, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def near_rows(rnd):
    rows = [(i, prose(rnd, rnd.randint(1, 150)), "en", "a") for i in range(60)]
    base = prose(rnd, 200)
    rows += [(100 + i, edited(rnd, base, i % 6), "en", "a") for i in range(40)]
    rows += [(200 + i, base, "en", "b") for i in range(5)]
    short = prose(rnd, 4)
    return rows + [(300, short, "en", "a"), (301, short.upper(), "en", "a"), (302, short + " more", "en", "a")]


def test_links_and_groups_match_brute_force(make_docs, rnd):
    rows = near_rows(rnd)
    links, group = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in n.join_documents(make_docs(rows)).collect()}
    names = {g: min(r[0] for r, h in zip(rows, group) if h == g) for g in group}
    assert got == {r[0]: (names[g], k) for r, k, g in zip(rows, links, group)}
    kept = n.keep_first(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(names.values()))
    assert kept.columns == make_docs(rows).columns


def test_a_cluster_of_many_blocks_loses_no_link(make_docs, rnd, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 7)
    rows = near_rows(rnd)
    links, _ = brute(rows)
    got = {r["doc_id"]: r["n_links"] for r in n.join_documents(make_docs(rows)).collect()}
    assert got == {r[0]: k for r, k in zip(rows, links)}


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = n.join_documents(docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got if r["doc_id"] in (2, 3, 4, 5, 6)}
    assert by_id == {2: (1, 3), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    kept = sorted((r["doc_id"] or 0) for r in n.keep_first(docs).collect())
    assert kept == [0, 1, 1, 3, 4, 5, 6, 7, 8, 9]  # of the four copies one row of id 1
    assert n.join_documents(docs.limit(0)).count() == 0 and n.keep_first(docs.limit(0)).count() == 0


def test_pruning_bounds_rise_with_the_hashes_and_spare_the_threshold():
    bounds = [n.least_matches(k) for k in (32, 64, 96, 128, 160)]
    assert bounds == sorted(bounds) and 0 < bounds[0] < 32 * 0.8 and bounds[-1] < 160 * 0.8
    draw = np.random.default_rng(2)
    assert (draw.binomial(160, 0.8, 20_000) >= bounds[-1]).mean() > 0.9999


def test_minhash_estimates_similarity(rnd):
    a, b = Shingler()(prose(rnd, 300)), Shingler()("")
    assert len(b) == 0 and len(Shingler()("one two")) == 1
    half = np.concatenate([a[::2], a[::2] + np.uint64(1)])
    same = (MinHash(2000)(a) == MinHash(2000)(half)).mean()
    assert abs(same - 1 / 3) < 0.05


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split_in_the_rounds(spark, monkeypatch):
    """The join of the edges with the least neighbours is one that Spark's skew rule splits."""
    from sluice.llm import components

    plans = []
    keep = components.materialize

    def watched(df):
        done = keep(df)
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    monkeypatch.setattr(components, "materialize", watched)
    edges = spark.range(1, 20_000).selectExpr("id as a", "if(id < 12000, 0L, id - 1) as b").repartition(8)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = components.connected_components(edges.filter("a < 12000 or a % 50 != 0")).filter("component = 0").count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == 12_000 and any("skew=true" in p for p in plans)
