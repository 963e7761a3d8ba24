"""Property checks: random frames and rules against a plain-Python model of
the semantics (nulls included), plus the split invariants."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.operators.filters import apply_filters
from sluice.operators.validation import validate
from sluice.specs import FilterRule, ValidationRule

WORDS = ["a", "b", "ab", "ba", "c1", "x"]
rows_st = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.sampled_from(WORDS))),
    min_size=0,
    max_size=12,
)

filter_rule_st = st.one_of(
    st.builds(lambda op, v: {"column": "n", "operator": op, "value": v},
              st.sampled_from(["eq", "neq", "gt", "lt", "gte", "lte"]), st.integers(-5, 5)),
    st.builds(lambda op, v: {"column": "s", "operator": op, "value": v},
              st.sampled_from(["eq", "neq", "contains", "not_contains"]), st.sampled_from(WORDS + ["^a", "b$"])),
    st.builds(lambda op, c: {"column": c, "operator": op}, st.sampled_from(["is_null", "is_not_null"]),
              st.sampled_from(["n", "s"])),
    st.builds(lambda op, vs: {"column": "s", "operator": op, "values": vs}, st.sampled_from(["in", "not_in"]),
              st.lists(st.sampled_from(WORDS), min_size=1, max_size=3)),
)


def keep_row(row, rule):
    """Reference semantics of one rule on one (n, s) row."""
    v = row[0] if rule["column"] == "n" else row[1]
    op = rule["operator"]
    if op == "is_null":
        return v is None
    if op == "is_not_null":
        return v is not None
    if op == "eq":
        return v is not None and v == rule["value"]
    if op == "neq":
        return v is None or v != rule["value"]
    if op in ("gt", "lt", "gte", "lte"):
        if v is None:
            return False
        x = rule["value"]
        return {"gt": v > x, "lt": v < x, "gte": v >= x, "lte": v <= x}[op]
    if op in ("contains", "not_contains"):
        hit = v is not None and re.search(rule["value"], str(v)) is not None
        return hit if op == "contains" else not hit
    if op == "in":
        return v is not None and v in rule["values"]
    if op == "not_in":
        return v is None or v not in rule["values"]
    raise AssertionError(op)


def as_tuples(df):
    return sorted(((r["i"], r["n"], r["s"]) for r in df.collect()))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_st, rules=st.lists(filter_rule_st, min_size=1, max_size=3))
def test_filters_match_model_and_split_is_total(spark, rows, rules):
    data = [(i, n, s) for i, (n, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, n int, s string")
    kept, dropped = apply_filters(df, [FilterRule(**r) for r in rules])
    expect = sorted(t for t in data if all(keep_row(t[1:], r) for r in rules))
    assert as_tuples(kept) == expect
    assert sorted(as_tuples(kept) + as_tuples(dropped)) == sorted(data)


vrule_st = st.one_of(
    st.just({"column": "n", "rule_type": "not_null"}),
    st.just({"column": "s", "rule_type": "unique"}),
    st.just({"column": "n", "rule_type": "unique"}),
    st.builds(lambda m: {"column": "n", "rule_type": "min_value", "params": {"min": m}}, st.integers(-5, 5)),
    st.builds(lambda m: {"column": "n", "rule_type": "max_value", "params": {"max": m}}, st.integers(-5, 5)),
    st.builds(lambda vs: {"column": "s", "rule_type": "allowed_values", "params": {"values": vs}},
              st.lists(st.sampled_from(WORDS), min_size=1, max_size=3)),
    st.builds(lambda p: {"column": "s", "rule_type": "regex", "params": {"pattern": p}}, st.sampled_from(["a", "b", "[ab]+$"])),
    st.builds(lambda k: {"column": "s", "rule_type": "min_length", "params": {"min_length": k}}, st.integers(0, 3)),
)


def bad_rows(data, rule):
    col = 1 if rule["column"] == "n" else 2
    kind, p = rule["rule_type"], rule.get("params") or {}
    out = set()
    seen = set()
    for i, *vals in data:
        v = vals[col - 1]
        if kind == "not_null":
            bad = v is None
        elif kind == "unique":
            bad = v in seen
            seen.add(v)
        elif kind == "min_value":
            bad = v is not None and v < p["min"]
        elif kind == "max_value":
            bad = v is not None and v > p["max"]
        elif kind == "allowed_values":
            bad = v not in p["values"]
        elif kind == "regex":
            bad = v is None or re.match(p["pattern"], v) is None
        elif kind == "min_length":
            bad = v is not None and len(v) < p["min_length"]
        if bad:
            out.add(i)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_st, rules=st.lists(vrule_st, min_size=1, max_size=3))
def test_validation_matches_model_and_split_is_total(spark, rows, rules):
    data = [(i, n, s) for i, (n, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, n int, s string")
    res = validate(df, [ValidationRule(**r) for r in rules], order_by="i")
    expect_errors = sorted((i, r["column"], r["rule_type"]) for r in rules for i in bad_rows(data, r))
    got_errors = sorted((e["row_id"], e["column"], e["rule"]) for e in res.errors.collect())
    assert got_errors == expect_errors
    invalid = {i for i, _, _ in expect_errors}
    assert sorted(r["i"] for r in res.invalid.collect()) == sorted(invalid)
    assert sorted(r["i"] for r in res.valid.collect()) == sorted(i for i, *_ in data if i not in invalid)


NUM_RE = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def model_float(text):
    if text is None:
        return None
    s = text.replace(",", "").replace("$", "").strip()
    if NUM_RE.fullmatch(s) or s.lower() in ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"):
        return float(s)
    return None


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="0123456789+-.eE $,dfnaiy", max_size=8)),
                      min_size=1, max_size=25))
def test_float_and_integer_casts_match_model(spark, texts):
    from sluice.operators.mapping import apply_mappings
    from sluice.specs import ColumnMapping

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r["v"] for r in apply_mappings(df, [ColumnMapping("v", "float")]).df.orderBy("i").collect()]
    want = [model_float(t) for t in texts]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or g == w
    res = apply_mappings(df, [ColumnMapping("v", "integer")], on_error="report")
    whole = all(w is None or (w == w and abs(w) != float("inf") and w == int(w) and abs(w) < 2**63) for w in want)
    if whole:
        ints = [r["v"] for r in res.df.orderBy("i").collect()]
        assert ints == [None if w is None else int(w) for w in want]
    else:
        assert res.errors and "have a fraction" in res.errors[0]["error"]


# named format -> strptime form (the parse the mapping reproduces)
STRPTIME = {
    "YYYY-MM-DD": "%Y-%m-%d", "YY-MM-DD": "%y-%m-%d", "DD-MM-YYYY": "%d-%m-%Y", "DD-MM-YY": "%d-%m-%y",
    "YYYY/MM/DD": "%Y/%m/%d", "YY/MM/DD": "%y/%m/%d", "DD/MM/YYYY": "%d/%m/%Y", "DD/MM/YY": "%d/%m/%y",
    "MMM DD, YYYY": "%b %d, %Y", "MMMM DD, YYYY": "%B %d, %Y",
}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    fmt=st.sampled_from(sorted(STRPTIME)),
    dates=st.lists(st.dates(min_value=__import__("datetime").date(1950, 1, 1),
                            max_value=__import__("datetime").date(2060, 12, 31)), min_size=1, max_size=12),
    unpad=st.booleans(),
    upper=st.booleans(),
)
def test_named_date_formats_match_strptime(spark, fmt, dates, unpad, upper):
    import datetime as dt

    from sluice.operators.mapping import apply_mappings
    from sluice.specs import ColumnMapping

    texts = []
    for d in dates:
        t = d.strftime(STRPTIME[fmt])
        if unpad:  # one-digit day and month are accepted too
            t = re.sub(r"(?<![0-9])0([1-9])(?![0-9])", r"\1", t)
        texts.append(t.upper() if upper else t)
    texts.append("not-a-date")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r["v"] for r in apply_mappings(df, [ColumnMapping("v", "date", date_format=fmt)]).df.orderBy("i").collect()]

    def model(t):
        try:
            return dt.datetime.strptime(t, STRPTIME[fmt]).date()
        except ValueError:
            return None

    assert got == [model(t) for t in texts]


DT_STRPTIME = {
    "YYYY-MM-DD HH:MM:SS": "%Y-%m-%d %H:%M:%S",
    "DD-MM-YYYY HH:MM:SS": "%d-%m-%Y %H:%M:%S",
    "MM-DD-YYYY HH:MM:SS": "%m-%d-%Y %H:%M:%S",
    "YYYY-MM-DDTHH:MM:SS": "%Y-%m-%dT%H:%M:%S",
    "ISO8601": "%Y-%m-%dT%H:%M:%SZ",
}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    fmt=st.sampled_from(sorted(DT_STRPTIME)),
    stamps=st.lists(st.datetimes(min_value=__import__("datetime").datetime(1970, 1, 1),
                                 max_value=__import__("datetime").datetime(2050, 12, 31)), min_size=1, max_size=10),
    unpad=st.booleans(),
)
def test_named_datetime_formats_match_strptime(spark, fmt, stamps, unpad):
    import datetime as dt

    from sluice.operators.mapping import apply_mappings
    from sluice.specs import ColumnMapping

    texts = []
    for s_ in stamps:
        t = s_.replace(microsecond=0).strftime(DT_STRPTIME[fmt])
        if unpad:
            t = re.sub(r"(?<![0-9])0([0-9])(?![0-9])", r"\1", t)
        texts.append(t)
    texts.append("2024-13-45 99:99:99")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r["v"] for r in apply_mappings(df, [ColumnMapping("v", "datetime", datetime_format=fmt)]).df.orderBy("i").collect()]

    def model(t):
        try:
            return dt.datetime.strptime(t, DT_STRPTIME[fmt])
        except ValueError:
            return None

    assert got == [model(t) for t in texts]


CELLS = ["1", "-7", "+3", "2.5", "1e3", ".5", "True", "False", "true", "abc", "x y", "", "NA", "null", "N/A",
         "nan", "None", "inf", "5d"]


def model_column(cells):
    """Type and values a pandas-style CSV read gives one column."""
    from sluice import constants as C

    vals = [None if c in C.CSV_NULL_TOKENS else c for c in cells]
    present = [v for v in vals if v is not None]
    is_int = all(re.fullmatch(r"[+-]?[0-9]+", v.strip()) for v in present)
    is_num = all(NUM_RE.fullmatch(v.strip()) or v.strip().lower() in ("inf", "+inf", "-inf") for v in present)
    is_bool = all(v in ("True", "TRUE", "true", "False", "FALSE", "false") for v in present)
    if not present:
        return "double", [None] * len(vals)
    if is_int:
        if len(present) == len(vals):
            return "bigint", [int(v) for v in vals]
        return "double", [None if v is None else float(v) for v in vals]
    if is_num:
        return "double", [None if v is None else float(v) for v in vals]
    if is_bool and len(present) == len(vals):
        return "boolean", [v in ("True", "TRUE", "true") for v in vals]
    return "string", vals


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(cols=st.lists(st.lists(st.sampled_from(CELLS), min_size=3, max_size=3), min_size=1, max_size=4))
def test_csv_inference_matches_model(spark, cols):
    import os
    import tempfile

    from sluice.sources.files import read_csv

    d = tempfile.mkdtemp(prefix="sluice-test-")
    path = os.path.join(d, "t.csv")
    names = [f"c{i}" for i in range(len(cols))]
    with open(path, "w") as fh:
        fh.write(",".join(["k"] + names) + "\n")
        for r in range(3):
            fh.write(",".join([str(r)] + [f'"{col[r]}"' if col[r] else "" for col in cols]) + "\n")
    df = read_csv(spark, path)
    rows = sorted(df.collect(), key=lambda r: r["k"])
    for name, col in zip(names, cols):
        kind, values = model_column(col)
        assert df.schema[name].dataType.simpleString() == kind, (name, col)
        assert [r[name] for r in rows] == values, (name, col)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
                               st.one_of(st.none(), st.integers(-20, 20))), min_size=0, max_size=15))
def test_aggregation_matches_model(spark, rows):
    import statistics

    from sluice.operators.aggregate import aggregate

    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "o int, k string, v int")
    aggs = [{"column": "v", "function": f} for f in ("sum", "count", "mean", "min", "max", "median", "first", "last",
                                                     "nunique", "size")]
    out = [r.asDict() for r in aggregate(df, {"group_by": ["k"], "aggregations": aggs}, order_by="o").collect()]
    groups = {}
    for o, k, v in data:
        if k is not None:
            groups.setdefault(k, []).append(v)
    expect = []
    for k in sorted(groups):
        vs = [v for v in groups[k] if v is not None]
        expect.append({
            "k": k, "sum_v": sum(vs), "count_v": len(vs), "mean_v": (sum(vs) / len(vs)) if vs else None,
            "min_v": min(vs) if vs else None, "max_v": max(vs) if vs else None,
            "median_v": float(statistics.median(vs)) if vs else None,
            "first_v": vs[0] if vs else None, "last_v": vs[-1] if vs else None,
            "nunique_v": len(set(vs)), "size_v": len(groups[k]),
        })
    assert len(out) == len(expect)
    for got, want in zip(out, expect):  # ordered by key, like the model
        for name, value in want.items():
            if isinstance(value, float):
                assert abs(got[name] - value) < 1e-9, (name, got, want)
            else:
                assert got[name] == value, (name, got, want)
