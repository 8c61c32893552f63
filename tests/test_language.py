import datetime

import pytest

from tributary.functions.compiler import TypeFault, compile_text, scope_of
from tributary.functions.syntax import SyntaxFault, parse_expression

CASES = [
    ("1 + 2 * 3", 7), ("-7 % 3", -1), ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ('"a" + "b"', "ab"), ("null == null", True), ("i == null", False), ("n != null", False), ("null < 1", None),
    ('i < "x"', False), ("1 == 1.0", True), ('"1" == 1', False), ("true and null", None), ("false and null", False), ("true or null", True), ("not null", None), ("null ?? null ?? 3", 3),
    ("if null then 1 else 2", 2), ("if false then 1", None), ('match i { 5 => "five", _ => "?" }', "five"), ("match i { 6 => 1 }", None), ("[1, 2, 3][1]", 2), ("[1][9]", None), ("[1][-1]", None),
    ("[x * 2 for x in [1, 2, 3] if x > 1]", [4, 6]), ('{"a": 1, "b": {"c": 2}}["b"]["c"]', 2), ("f == f", True), ("nan == nan", False), ("nan < 1.0", False),
    ('"  x\u00a0".trim()', "x"), ('"abc".substring(1)', "bc"), ('"abc".substring(-5, 2)', "ab"), ('"abc".left(-1)', None), ('"abc".pad_left(2)', "abc"), ('"abc".pad_right(5, "xy")', "abcxx"),
    ('"abc".matches("b")', True), ('"abc".capture("z(.)", 1)', None), ('"a.b".split(".").length()', 2), ('"x".concat(null, 1)', "x1"), ("i.upper()", None), ("n.is_null()", True), ("n.type_of()", "null"),
    ("1.0.type_of()", "float"), ('"".is_empty()', True), ("[].is_empty()", True), ("i.is_empty()", False), ("n.catch(4)", 4), ("2.5.round()", 3.0), ("(-2.5).round()", -3.0), ("1.005.round(2)", 1.0),
    ("3.round(1)", 3), ("3.round_to(1)", None), ("3.7.floor()", 3), ("5.clamp(null, 3)", 3), ("5.min(7)", 5), ("5.max(null)", None), ("#2024-01-31#.add_months(1)", datetime.date(2024, 2, 29)),
    ("#2024-03-01#.diff_days(#2024-02-28#)", 2), ("#2024-03-01#.hour()", None), ('#2024-03-05#.format_date("%d %b %Y")', "05 Mar 2024"), ('" 5".try_int()', None), ('"5".try_int()', 5), ("2.9.to_int()", 2),
    ("(-2.9).to_int()", -2), ("true.to_int()", 1), ('"YES".try_bool()', True), ('"y".try_bool()', None), ("42.0.to_string()", "42"), ("4.5.to_string()", "4.5"), ("[1, 2].to_string()", "[1, 2]"),
    ('"2024-02-30".try_date()', None), ('"05/03/2024".try_date("%d/%m/%Y")', datetime.date(2024, 3, 5)), ("[1, null, 3].filter(x => x > 1)", [3]), ("[1, 2].map(x => x + 1)", [2, 3]),
    ("[1, 2].find(x => x > 1)", 2), ("[null, 1].any(x => x > 5)", False), ("[1, 2].flat_map(x => [x, x])", [1, 1, 2, 2]), ("[1, 2, 3].remove(1)", [1, 3]), ("[1].remove(7)", [1]), ('["a", null].join("-")', "a-"),
    ('{"a": 1}.keys()', ["a"]), ('{"a": 1}.merge({"a": 2, "b": 3})["a"]', 2), ('{"a": 1}.set("b.c", 5)["b"]["c"]', 5), ('{"a": 1, "b": 2}.remove_field("a").keys()', ["b"]), ('"/x/a.tar.gz".file_stem()', "a.tar"),
    ('".bashrc".extension()', None), ('"/x/y/".file_name()', "y"), ('"/x/y.txt".parent_name()', "x"), ("i.debug()", 5), ("#2024-03-01#.diff_months(#2024-01-01#)", None),
]


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(5, 1.5, float("nan"), "s", None)], "i long, f double, nan double, s string, n long")


def test_all_cases(row):
    cols = [compile_text(t, scope_of(row.schema)).col.alias(f"c{k}") for k, (t, _) in enumerate(CASES)]
    got = row.select(*cols).first()
    wrong = [(t, want, got[k]) for k, (t, want) in enumerate(CASES) if got[k] != want or (isinstance(want, bool) != isinstance(got[k], bool))]
    assert not wrong


def test_errors(row):
    for text in ("1 +", "a b", "match {", "#2024#"):
        with pytest.raises(SyntaxFault):
            parse_expression(text)
    with pytest.raises(TypeFault):
        compile_text("nope + 1", scope_of(row.schema))
    for text in ("1 / (i - 5)", '"x".to_int()', "9223372036854775807 + i"):
        with pytest.raises(Exception, match="(?i)zero|to_int|overflow"):
            row.select(compile_text(text, scope_of(row.schema)).col).collect()
