import pytest

from trawl.api import Scanner
from trawl.operators import aesflow, validate

SPEC = """
validators:
- {name: one, rule_ids: [a.1], http: {method: GET, url: "https://h/{{ .id }}/{{secret}}", auth: {type: bearer, secret_group: secret}, headers: [{name: X, value: "{{id}}"}], success_codes: [200], failure_codes: [401]}}
- {name: two, rule_ids: [a.1, b.1], http: {url: "https://h/q?x=1", auth: {type: query, query_param: k, secret_group: token}, success_codes: [200], failure_codes: [403]}}
- {name: three, rule_ids: [c.1], http: {url: "https://h", auth: {type: basic, secret_group: secret}}}
"""


def test_request_plans():
    one, two, three = validate.parse(SPEC)
    assert validate.request(one, {"secret": "s", "id": "7"}) == {"method": "GET", "url": "https://h/7/s", "headers": {"Authorization": "Bearer s", "X": "7"}, "body": "", "error": None}
    assert validate.request(two, {"token": "a b"})["url"] == "https://h/q?x=1&k=a+b"
    assert validate.request(three, {"secret": "s"})["headers"] == {"Authorization": "Basic czpz"}
    assert "not found" in validate.request(two, {})["error"]
    for bad in ("validators: [{name: x, http: {url: u}}]", "validators: [{name: x, rule_ids: [a], http: {url: u, auth: {type: odd}}}]"):
        with pytest.raises(ValueError):
            validate.parse(bad)


def test_each_secret_is_sent_once(spark, tmp_path):
    folder = str(tmp_path)

    def send(plan):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").write(plan["url"])
        return 200 if plan["url"].endswith("/good") else 401 if plan["url"].endswith("/bad") else 500

    rows = [("a.1", {"secret": s, "id": "1"}, s) for s in ("good", "good", "bad", "odd")] + [("c.9", {"secret": "good"}, "good"), ("b.1", {}, "x")]
    got = validate.validated(spark.createDataFrame(rows, "rule_id string, named map<string,string>, matching string"), validate.parse(SPEC), send)
    seen = sorted((r.rule_id, r.matching, r.validation.status, r.validation.confidence) for r in got.collect())
    assert seen == [("a.1", "bad", "invalid", 1.0), ("a.1", "good", "valid", 1.0), ("a.1", "good", "valid", 1.0), ("a.1", "odd", "undetermined", 0.5), ("b.1", "x", "undetermined", 0.0), ("c.9", "good", "undetermined", 0.0)]
    assert len(list(tmp_path.iterdir())) == 3


def test_password_flow(spark):
    text = "var k = 'short'; var k=\"0123456789abcdef\"; function enc(p){}; x = enc(form.user?.Password); notenc(a.password); enc(name); password: enc('hunter2'); y = enc('zzz')"
    rows = [("b", text, text.index("function"), "enc", "k", None), ("c", "function f(p){}", 0, "f", None, "0123456789abcdef"), ("d", "f(pwd)", 0, "f", None, "no key")]
    got = aesflow.expand(spark.createDataFrame(rows, "blob_id string, text string, start long, encryptor string, key_source string, static_key string")).collect()
    seen = sorted((r.blob_id, r.argument or "", r.is_literal, r.aes_key) for r in got)
    assert seen == [("b", "'hunter2'", True, "0123456789abcdef"), ("b", "form.user?.Password", False, "0123456789abcdef"), ("c", "", None, "0123456789abcdef"), ("d", "pwd", False, None)]
    for r in got:
        if r.argument and r.blob_id == "b":
            assert text[r.start : r.end].startswith("enc(") and text[r.start : r.end].endswith(")")


def test_scanner(spark, tmp_path):
    scanner = Scanner(spark, include="ipv4|email", exclude="email")
    assert [r.id for r in scanner.rules] == ["tr.ipv4.1"]
    got = scanner.scan_texts([("a", "1.2.3.4 1.2.3.4"), ("b", "x@y.example.org"), ("c", "5.6.7.8")])
    assert sorted((r.source, r.matching) for r in got.collect()) == [("a", "1.2.3.4"), ("c", "5.6.7.8")]
    (tmp_path / "f.txt").write_text("at 9.9.9.9")
    assert [r.path for r in scanner.scan_folder(f"file://{tmp_path}").collect()] == ["f.txt"]
    assert scanner.scan_table(spark.createDataFrame([(None,)], "text string")).count() == 0
