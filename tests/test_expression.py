import pytest

from barloom.library.catalogs import alpha101, features158, unique_names
from barloom.library.sharing import batches, common_subexpressions
from barloom.operators import builtin, registry  # noqa: F401
from barloom.plans.expression import Apply, ExpressionError, Field, Literal, dialect, node_hash, parse
from barloom.sdk import diagnose

PAIRS = [
    ("ts_delay(close, 5)", "Ref($close, 5)"), ("ts_mean(close, 5)", "Mean($close, 5)"), ("ts_std(close, 5)", "Std($close, 5)"), ("rank(close)", "Rank($close)"), ("ts_rank(close, 5)", "Rank($close, 5)"),
    ("ts_max(high, 5)", "Max($high, 5)"), ("elem_max(high, low)", "Max($high, $low)"), ("ts_argmax(high, 5)", "IdxMax($high, 5)"), ("correlation(close, volume, 10)", "Corr($close, $volume, 10)"),
    ("decay_linear(close, 7)", "WMA($close, 7)"), ("where(gt(close, open), high, low)", "If($close > $open, $high, $low)"), ("signed_power(close, 2)", "SignedPower($close, 2)"), ("adv20", "Mean($volume, 20)"), ("returns", "ts_returns($close, 1)"),
]


@pytest.mark.parametrize(("a", "b"), PAIRS)
def test_dialects_give_one_tree(a, b):
    assert node_hash(parse(a)) == node_hash(parse(b))


def test_precedence():
    assert parse("-close^2") == Apply("neg", (Apply("pow", (Field("close"), Literal(2))),))
    assert parse("2^-3^2") == parse("2^(-(3^2))")
    assert parse("a + b * c") == Apply("add", (Field("a"), Apply("mul", (Field("b"), Field("c")))))
    assert parse("a < b < c") == Apply("lt", (Apply("lt", (Field("a"), Field("b"))), Field("c")))
    assert parse("a || b ? c : d ? e : f") == Apply("where", (Apply("or", (Field("a"), Field("b"))), Field("c"), Apply("where", (Field("d"), Field("e"), Field("f")))))
    assert parse("a - b - c") == parse("(a - b) - c")
    assert parse("-1 * 2.") == Apply("mul", (Literal(-1), Literal(2.0)))


def test_literals_keep_their_kind():
    assert len({node_hash(parse(f"close * {x}")) for x in ("20", "20.0")}) == 2
    assert parse("decay_linear(close, 7.89)") == parse("decay_linear(close, 7)")


@pytest.mark.parametrize(
    ("text", "code"),
    [("", "EMPTY_EXPRESSION"), ("close # 2", "UNEXPECTED_CHARACTER"), ("close + ", "UNEXPECTED_EOF"), ("close close", "TRAILING_TOKENS"), ("foo(close)", "UNKNOWN_OPERATOR"), ("rank(a, b, c)", "OPERATOR_ARITY"), ("ts_mean(close, volume)", "INVALID_WINDOW"), ("* close", "UNEXPECTED_TOKEN"), ("(" * 80 + "a" + ")" * 80, "EXPRESSION_TOO_DEEP"), ("indneutralize(close, 3)", "INVALID_ARGUMENT")],
)
def test_errors_have_codes(text, code):
    with pytest.raises(ExpressionError) as e:
        parse(text)
    assert e.value.code == code
    assert diagnose(text)[0].name == code


def test_diagnose_finds_what_parsing_does_not():
    assert [f.code for f in diagnose("close")] == ["P012"]
    assert [f.code for f in diagnose("1 + 2")] == ["P011"]
    assert [f.code for f in diagnose("rank(nope)", ["close"])] == ["E001"]
    assert [f.code for f in diagnose("delay(close, -1)")] == ["E007"]
    assert [f.code for f in diagnose("ts_std(close, 1)")] == ["E004"]
    assert [f.code for f in diagnose("indneutralize(close, sector)")] == ["E005"]
    assert diagnose("indneutralize(rank(close), sector)", ["close"], ["sector"]) == []


def test_dialect_is_told():
    assert dialect("Mean($close, 5)") == "dollar" and dialect("ts_mean(close, 5)") == "functional"


def test_catalogs_parse():
    assert len(alpha101()) == 101 and len(features158()) == 158
    for e in (*alpha101().values(), *features158().values()):
        parse(e)
    assert list(unique_names(["rank(a)", "rank(a)", "alpha101:3"])) == ["rank(a)", "rank(a)#2", "alpha101:3"]


def test_custom_operators():
    registry.register("twice", lambda ctx, x: x * 2)
    try:
        assert parse("twice(close)") == Apply("twice", (Field("close"),))
        assert "twice" in registry.operator_schema()
    finally:
        registry.unregister("twice")
    with pytest.raises(ExpressionError):
        parse("twice(close)")


def test_sharing():
    top = common_subexpressions(["rank(delta(close, 1)) + 1", "rank(delta(close, 1)) * 2", "bad("])
    assert top[0]["expression"] == "cs_rank(ts_delta(close, 1))" and top[0]["count"] == 2
    groups = batches({f"f{i}": f"rank(delta(close, {i + 1}))" for i in range(10)}, max_nodes=6)
    assert sum(map(len, groups)) == 10 and all(len(g) <= 3 for g in groups)
