import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.functions import ids, text
from trawl.operators import detect, findings, rules, suppress

BY_ID = {r.id: r for r in rules.BUILTIN}


def blobs(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return frame.select("k", ids.blob_id(F.coalesce("text", F.lit(""))).alias("blob_id"), "text")


def test_every_example_matches_and_no_negative_does(spark):
    texts = [(r.id, e, True) for r in rules.BUILTIN for e in r.examples] + [(r.id, e, False) for r in rules.BUILTIN for e in r.negative_examples]
    rows = detect.with_python(blobs(spark, [t[1] for t in texts]), rules.BUILTIN).select("k", "rule_id").distinct().collect()
    hit = {(r.k, r.rule_id) for r in rows}
    assert [((k, i) in hit) for k, (i, _, _) in enumerate(texts)] == [want for _, _, want in texts]


def test_both_plans_agree(spark):
    texts = ["é a=1\ntoken = \"" + "0a" * 20 + "\" x@y.example.org\n1.2.3.4 5.6.7.8", "", None, "no match at all " * 500, "a@b.example\n" * 50, "\n\nLicensed under X.\n", "4465758382889437 4465758382889437"]
    texts += [e for r in rules.BUILTIN for e in r.examples]
    frame = blobs(spark, texts)
    one, two = (sorted(map(repr, plan(frame, rules.BUILTIN).collect())) for plan in (detect.with_columns, detect.with_python))
    assert one == two and len(one) > 60


def test_offsets_are_bytes_and_lines_count_from_one(spark):
    body = "café: é\nmail né.x@y.example.org now"
    (m,) = [r for r in detect.with_columns(blobs(spark, [body]), [BY_ID["tr.email.1"]]).collect()]
    data = body.encode()
    assert data[m.start : m.end].decode() == m.matching == "x@y.example.org" or m.matching == ".x@y.example.org"
    assert (m.start_line, m.start_column) == (2, m.start - data.rindex(b"\n", 0, m.start))
    assert (m.end_line, m.end_column) == (2, m.end - data.rindex(b"\n", 0, m.end))


def test_ids_are_hashes(spark):
    frame = detect.with_ids(detect.with_columns(blobs(spark, ["x 1.2.3.4 é"]), [BY_ID["tr.ipv4.1"]]))
    (m,) = frame.collect()
    data = "x 1.2.3.4 é".encode()
    assert m.blob_id == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    sid = BY_ID["tr.ipv4.1"].structural_id.encode()
    assert m.structural_id == hashlib.sha1(sid + b"\0" + bytes.fromhex(m.blob_id) + b"\0" + b"2" + b"\0" + b"9").hexdigest()
    assert m.finding_id == hashlib.sha1(sid + b"\0" + b'["MS4yLjMuNA=="]').hexdigest()
    long = spark.range(1).select(ids.finding_id(F.lit("r"), F.array(F.lit("x" * 200))).alias("a"), ids.finding_id(F.lit("r"), F.array().cast("array<string>")).alias("b"), ids.finding_id(F.lit("r"), F.lit(None).cast("array<string>")).alias("c")).first()
    import base64

    assert long.a == hashlib.sha1(b"r\0" + json.dumps([base64.b64encode(b"x" * 200).decode()]).encode()).hexdigest()
    assert long.b == hashlib.sha1(b"r\0[]").hexdigest() and long.c == hashlib.sha1(b"r\0null").hexdigest()


def context(body, start, end, lines):
    before = "\n".join(body[:start].split("\n")[-(lines + 1) :])
    rest = body[end:].removeprefix("\n")
    parts = rest.split("\n")
    return before, "\n".join(parts[:lines]) + ("\n" if len(parts) > lines else "")


@pytest.mark.parametrize("lines", [1, 2, 3])
def test_context(spark, lines):
    rows = [(b[:s], b[e:], *context(b, s, e, lines)) for b, s, e in [("a\nb\nHIT\nc\nd\n", 4, 7), ("HIT", 0, 3), ("x HIT y\nz", 2, 5), ("1\n2\n3\n4\nHIT\n", 8, 11), ("\n\nHIT\n\n\n", 2, 5)]]
    frame = spark.createDataFrame(rows, "pre string, post string, b string, a string")
    for r in frame.select("*", text.context_before(F.col("pre"), lines).alias("gb"), text.context_after(F.col("post"), lines).alias("ga")).collect():
        assert (r.gb, r.ga) == (r.b, r.a)


def test_first_row_of_copies_is_the_least(spark):
    ids = list(range(40))
    rows = [(k, f"{'b' * 40}", "1.1.1.1 2.2.2.2") for k in reversed(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, blob_id string, text string").repartition(7)
    frame = detect.with_ids(detect.with_columns(frame, [BY_ID["tr.ipv4.1"]]))
    for kept in (detect.first_by_content(frame, ties=["doc_id"]), detect.first_by_place(frame, ties=["doc_id"])):
        assert sorted((r.doc_id, r.start) for r in kept.collect()) == [(0, 0), (0, 8)]


def test_dedup_findings_and_top(spark):
    frame = detect.with_ids(detect.with_columns(blobs(spark, ["1.1.1.1 1.1.1.1 2.2.2.2", "1.1.1.1"]), [BY_ID["tr.ipv4.1"]]))
    assert frame.count() == 4 and detect.first_by_content(frame).count() == 3 and detect.first_by_place(frame.union(frame)).count() == 4
    rows = {r.groups[0]: (r.n_matches, r.n_blobs) for r in findings.findings(frame).collect()}
    assert rows == {"1.1.1.1": (3, 2), "2.2.2.2": (1, 1)}
    assert findings.first_matches(frame, 2).count() == 3
    with_cap = detect.with_python(blobs(spark, ["1.1.1.1 1.1.1.1 2.2.2.2"]), [BY_ID["tr.ipv4.1"]], most=2)
    assert with_cap.count() == 2


def test_roll_up_and_facets(spark):
    rows = [("f", "valid", 0.95), ("f", "valid", 0.90), ("g", "undetermined", 0.5), ("g", "invalid", 1.0), ("h", None, None)]
    got = {r.k: (r.n_validated, r.confidence, r.status) for r in findings.roll_up(spark.createDataFrame(rows, "k string, status string, confidence double"), ["k"]).collect()}
    assert got["f"] == (2, pytest.approx(0.925), "valid") and got["g"][2] == "invalid" and got["h"] == (0, None, None)
    frame = spark.createDataFrame([("A", ["x", "y"], "valid"), ("A", ["x"], None), ("B", None, "invalid")], "rule_name string, categories array<string>, status string")
    counts = {(r.facet, r.value): r.n for r in findings.facets(frame).collect()}
    assert counts == {("rule", "A"): 2, ("rule", "B"): 1, ("category", "x"): 2, ("category", "y"): 1, ("validation", "valid"): 1, ("validation", "-"): 1, ("validation", "invalid"): 1}
    under = {(r.facet, r.value): r.n for r in findings.facets_under(frame, {"category": ["y"], "validation": ["valid", "-"]}).collect()}
    assert under[("rule", "A")] == 1 and under[("rule", "B")] == 0 and under[("category", "x")] == 1


def test_suppression(spark):
    def ask(predicate, values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(predicate(F.col("v"))).collect()]

    assert ask(suppress.is_password_prompt, ["请输入密码", "密码", "Please enter password", "“password required”", "hunter2", "password"]) == [True, False, True, True, False, False]
    assert ask(suppress.is_opaque, ["a8f5f167f44f4964e6c998dee827110c", "aaaaaaaaaaaa1", "short1", "onlylettershere", "YOUR_TOKEN_123456", "a1b2c3d4e5f6=="]) == [True, False, False, False, False, True]
    assert ask(suppress.is_client_secret, ["test_secret_a1b2c3d4", "a8f5f167f44f4964e6c998dee827110c"]) == [False, True]
    window = "color: x date: x email: x month: x number: x 'range': x"
    assert ask(lambda v: suppress.is_type_label(v, F.lit(window)), ["Passwort", "pass1", "x" * 33]) == [True, False, False]
    found = detect.with_columns(blobs(spark, ["client_secret: 'notasecretvalue123' client_secret: 'a8f5f167f44f4964e6c9' password: 'Enter password'"]), [BY_ID["tr.client-secret.1"], BY_ID["tr.password.1"]])
    assert [r.groups for r in suppress.unsuppressed(found).collect()] == [["a8f5f167f44f4964e6c9"]]


def test_rules(spark, tmp_path):
    rules.check(rules.BUILTIN)
    for r in rules.RULESETS:
        rules.check_ruleset(r, rules.BUILTIN)
    (tmp_path / "a.yml").write_text("rules:\n- {id: x.1, name: X, pattern: '(?P<v>a+)', keywords: [a], unknown: 1}\n")
    (one,) = rules.load(tmp_path)
    assert one.structural_id == hashlib.sha1(b"(a+)").hexdigest() and one.keywords == ("a",)
    (tmp_path / "b.yml").write_text("rules:\n- {id: x.1, name: Y, pattern: b}\n")
    with pytest.raises(ValueError, match="twice"):
        rules.load(tmp_path)
    for bad in ("(", "(?P<a>x)(y)"):
        with pytest.raises(ValueError):
            rules.check([rules.Rule("i", "n", bad)])
    with pytest.raises(ValueError, match="unknown"):
        rules.check_ruleset(rules.Ruleset("r", "n", ("none",)), rules.BUILTIN)
    assert rules.portable("(?xi) a \\  [ #] # note\n b (?#c) (?P<n>d)") == "(?i)a\\ [ #]b(d)"
    frame = rules.frame(spark, rules.BUILTIN)
    assert {r.id for r in rules.select(frame, "slack,stripe", "^tr\\.str").collect()} == {"tr.slack.1"}
    assert rules.select(frame).count() == len(rules.BUILTIN)
    assert len(rules.custom("builtin")) == len(rules.BUILTIN) and rules.custom('[{"id": "a", "name": "b", "pattern": "c"}]')[0].pattern == "c"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab1.\n é", max_size=40), min_size=1, max_size=5))
def test_matching_is_the_text_between_offsets(spark, texts):
    rule = rules.Rule("t", "t", r"\b([ab1]{2,})")
    for r in detect.with_columns(blobs(spark, texts).select("k", "text"), [rule]).collect():
        assert texts[r.k].encode()[r.start : r.end].decode() == r.matching


def test_no_row_of_the_report_holds_all_matches_of_a_finding(spark):
    from trawl.operators import report

    frame = blobs(spark, [f"{'x' * k} same@host.example.org" for k in range(50)])
    rows = report.findings_json(detect.with_ids(detect.with_columns(frame, [BY_ID["tr.email.1"]]))).collect()
    lines = [json.loads(r.json) for r in rows]
    heads, matches = [x for x in lines if "match" not in x], [x["match"] for x in lines if "match" in x]
    assert [h["n_matches"] for h in heads] == [50] and len({m["blob_id"] for m in matches}) == 50
    assert max(len(r.json) for r in rows) < 500 and {r.finding_id for r in rows} == {heads[0]["finding_id"]}
