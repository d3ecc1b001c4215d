import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from trawl.operators import detect, rules

PATTERNS = (
    "(ÉCOLE-[0-9]{4})", "(ПАРОЛЬ=[0-9]{2,4})", "(?i)(straße[a-z]+)", "(?i:КЛЮЧ)=([a-z]+)", "([Ss][Kk]-[a-z0-9]{3})", "tok(?:é|e)n=(x+)", "(x[ab][cd]yz)", "(ab+cd?e)", "((?:foo|bar)baz)",
    "(İx|ſabc)", "([а-я]{3}-key)", "(a[0-9]b[0-9]c[0-9]d)", "^(begin)", "([^a]xyz)", "(?i)([K]elvin)",
)
PACK = [rules.Rule(f"t.{k}", "t", p) for k, p in enumerate(PATTERNS)]
TOOLS = detect.Tools(PACK)
#: Texts that the patterns match, in pieces, so that many generated texts match.
PIECES = st.sampled_from(
    ["ÉCOLE-", "école-", "1234", "ПАРОЛЬ=", "пароль=", "STRASSE", "STRAßE", "straße", "abc", "КЛЮЧ=", "ключ=", "Sk-", "a1b", "token=", "tokén=", "x", "xac", "yz", "abbcde", "abce", "FOO", "foo", "barbaz", "baz", "İx", "ſabc", "абв-key", "a1b2c3d", "begin", "\n", "bxyz", "kelvin", "Kelvin", "É", "é"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=3)), max_size=12).map("".join))
@example("ÉCOLE-1234")
@example("ПАРОЛЬ=1234")
def test_every_rule_that_matches_is_a_candidate(text):
    body = text.encode("utf-8", "surrogatepass")
    found = set(TOOLS.candidates(body))
    assert all(k in found for k, (_, finder, _, _) in enumerate(TOOLS.rules) if next(finder(body), None))


def test_examples_of_the_whole_pack_are_candidates():
    pack = rules.pack()
    tools = detect.Tools(pack)
    for k, rule in enumerate(pack):
        for text in rule.examples:
            assert k in tools.candidates(text.encode())
            if re.search(rules.portable(rule.pattern).encode(), text.upper().encode()):
                assert k in tools.candidates(text.upper().encode())
    assert len(tools.always) <= 7


def test_both_plans_find_capitals_beyond_ascii(spark):
    frame = spark.createDataFrame([(1, "ÉCOLE-1234 ПАРОЛЬ=1234"), (2, "école-1234 пароль=1234")], "k long, text string")
    one, two = (sorted((r.k, r.matching) for r in plan(frame, PACK[:2]).collect()) for plan in (detect.with_columns, detect.with_python))
    assert one == two == [(1, "ÉCOLE-1234"), (1, "ПАРОЛЬ=1234")]
