import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators.packed import COMMA, STRONG, parse, unpack

values = lambda s: [v for _, v, _ in parse(s)]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []), ("", []), ("  ", []), ("-", []), (" - ", []), ("[]", []), (";;", []),
        ("a; b|c\nd；e\r\nf", ["a", "b", "c", "d", "e", "f"]),
        ("a, b,c", ["a", "b", "c"]),
        ("a, b; c", ["a, b", "c"]),
        ('a,"b; c",d', ["a", "b; c", "d"]),
        ('"x, y"', ["x, y"]),
        ('"""classic"" form"; other', ['"classic" form', "other"]),
        ("“a;b”, c", ["a;b", "c"]),
        ('["a, 1","b"]', ["a, 1", "b"]),
        (r"Dwarfism\; Short; Tall", ["Dwarfism; Short", "Tall"]),
        (r"a\,b,c", ["a,b", "c"]),
        (r'"Bone\Joint; Pain"; x', [r"Bone\Joint; Pain", "x"]),
        ('say "hi"; b', ['say "hi"', "b"]),
        ('"open; b', ['"open', "b"]),
        ('"a" b; c', ['"a" b', "c"]),
        ("a;a;;a", ["a", "a", "a"]),
        ('x, "p; q"; y', ['x, "p; q"', "y"]),
        ("[a]; [b]", ["a]", "[b"]),
        (r'x, "p\;q"; y\, z', [r'x, "p\;q"', "y, z"]),
    ],
)
def test_grammar(text, want):
    assert values(text) == want
    assert [p for p, _, _ in parse(text)] == list(range(1, len(want) + 1))


def test_error_flag():
    assert [e for _, _, e in parse('"open; b; "ok"')] == ["malformed_quote", None, None]


def quote(v):
    return '"' + v.replace('"', '""') + '"'


plain = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters='"“”\\[]'), min_size=1, max_size=12)
field = st.lists(plain.map(str.strip).filter(lambda v: v not in ("", "-")), min_size=2, max_size=6)


@given(field, st.sampled_from(list(";|；\n")))
@settings(max_examples=200, deadline=None)
def test_quoted_values_come_back(items, sep):
    assert values(f" {sep} ".join(quote(v) for v in items)) == items


@given(st.lists(st.text("ab c.", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from(STRONG + COMMA))
@settings(max_examples=200, deadline=None)
def test_bare_values_come_back(items, sep):
    assert values(sep.join(items)) == items


@given(st.text(st.sampled_from('ab;,|"“”\\[] \n-'), max_size=30))
@settings(max_examples=500, deadline=None)
def test_never_fails_and_loses_no_letter(text):
    got = "".join(values(text))
    assert got.count("a") == text.count("a") and got.count("b") == text.count("b")


def test_long_field_is_linear():
    assert len(parse('"a; ' * 200_000)) > 1000
    assert parse("x" * 2_000_000)[0][1] == "x" * 2_000_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "a;b", "z"), (None, "c", "z"), (2, None, "z"), (1, "a;b", "z")], "row_id bigint, f string, item string")
    rows = [(r.row_id, r.pos, r.item) for r in unpack(df, "row_id", "f").collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (1, 1, "a"), (1, 2, "b")], key=str)
    assert unpack(df.limit(0), "row_id", "f").count() == 0
