import re

import pytest
from pyspark.sql import functions as F

from trawl.api import Scanner, kind
from trawl.functions import ids
from trawl.operators import aesflow, chunks, detect, rules, scan, suppress
from trawl.plans.store import Store
from trawl.plans.store import scan as store_scan


def blobs(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return frame.select("k", ids.blob_id(F.coalesce("text", F.lit(""))).alias("blob_id"), "text")


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        (r"key(?i)abc", "keyABC", True), (r"key(?i)abc", "KEYabc", False), (r"a(?i)b|c", "C", True), (r"(?:x(?i)y)z", "xYZ", False), (r"(?:x(?i)y)z", "xYz", True),
        (r"(?P<q>['\"])v(?P=q)", "'v'", True), (r"(?P<q>['\"])v(?P=q)", "'v\"", False), (r"(?<q>a)\k<q>", "aa", True), (r"(?x) a [ #] \# # note", "a #", True), (r"[(?i)]x(y)", ")xy", True),
    ],
)
def test_portable_patterns(pattern, text, want):
    assert bool(re.fullmatch(rules.portable(pattern), text)) == want


def test_literals_are_needed_by_every_match():
    named = {"a": r"\bfoo_[a-z]{3}(?:bar|bazz)", "b": r"(?i)(?:Token|secret)=\w+", "c": r"[ab]+c?", "d": r"(?:abcd)?x", "e": r"(?:abcd){2,}x"}
    found = {k: rules.literals(rules.Rule(k, k, p)) for k, p in named.items()}
    assert found == {"a": {"foo_"}, "b": {"token", "secret"}, "c": None, "d": None, "e": {"abcd"}}


def test_pack_finds_what_it_describes(spark):
    pack = rules.pack()
    assert len({r.id for r in pack}) == len(pack) > 300 and not any(rules.problem(r) for r in pack)
    made = {"tr.prefix.npm": "npm_" + "a1B2" * 9, "tr.prefix.linear": "lin_api_" + "x" * 40, "tr.near.datadog": 'DATADOG_API_KEY = "' + "0a" * 16 + '"', "tr.near.asana": "asana.token: " + "a_b-" * 11, "tr.near.telnyx": "Telnyx secret => '12345678-1234-1234-1234-123456789abc'"}
    rows = detect.with_python(blobs(spark, list(made.values())), pack).select("k", "rule_id", "named").collect()
    for k, rule in enumerate(made):
        assert any(r.k == k and r.rule_id == rule and r.named["secret"] for r in rows), rule


def test_load_reports_each_bad_rule(tmp_path):
    (tmp_path / "a.yml").write_text("rules:\n- {id: a, name: A, pattern: '(x)'}\n- {id: b, name: B, pattern: '('}\n- {id: a, name: C, pattern: 'y'}\n- {id: c, name: D, pattern: '(?P<n>x)(y)(?i)z'}\n")
    good, bad = rules.load_report(tmp_path)
    assert [r.id for r in good] == ["a", "c"] and [i for i, _ in bad] == ["b", "a"]
    with pytest.raises(ValueError, match="rule b"):
        rules.load(tmp_path)


def test_groups_by_name_and_anchors_in_both_plans(spark):
    rule = rules.Rule("r", "R", r"^(?P<word>key-[0-9]{4})$")
    texts = ["x\nkey-1234\ny", "key-1234", " key-1234", "key-1234\r\nz", "é\nkey-9999 "]
    one, two = (sorted(map(repr, plan(blobs(spark, texts), [rule]).collect())) for plan in (detect.with_columns, detect.with_python))
    assert one == two and len(one) == 2 and "{'word': 'key-1234'}" in one[0]
    with pytest.raises(ValueError, match="groups"):
        detect.with_columns(blobs(spark, texts), [rules.Rule("r", "R", "(a)(b)")])
    found = detect.with_python(blobs(spark, ["ab a"]), [rules.Rule("r", "R", r"(?P<x>a)(?P<y>b)?")]).collect()
    assert [(r.groups, r.named) for r in found] == [(["a", "b"], {"x": "a", "y": "b"}), (["a"], {"x": "a"})]


def test_context_of_both_plans_agrees(spark):
    rule = rules.Rule("r", "R", "(HIT)")
    texts = ["a\nb\nHIT\nc\nd\n", "HIT", "x HIT y\nz", "1\n2\n3\n4\nHIT\n", "\n\nHIT\n\n\n", "é\nHIT é\n\nü"]
    for lines in (1, 2, 3):
        one, two = (sorted(map(repr, plan(blobs(spark, texts), [rule], context=lines).collect())) for plan in (detect.with_columns, detect.with_python))
        assert one == two


WRAPPER = "var k1 = '0123456789abcdef';\nfunction enc(p) { var k = CryptoJS.enc.Utf8.parse(k1); return CryptoJS.AES.encrypt(p, k); }\n"


def test_wrappers_become_their_calls(spark):
    body = "é var k1 = '0123456789abcdef';\nfunction enc(p) { return CryptoJS.AES.encrypt(p, CryptoJS.enc.Utf8.parse(k1)); }\nlogin(enc(form.password)); x = {password: enc('hunter\\x41')};"
    alone = "function other(p) { return CryptoJS.AES.encrypt(p, CryptoJS.enc.Utf8.parse('0123456789abcdef')); }"
    got = scan.scan(blobs(spark, [body, alone, body]).select("blob_id", "text"), rules.SCANNED).collect()
    calls = sorted(r.matching for r in got if r.named.get("argument"))
    assert calls == ["enc('hunter\\x41')", "enc(form.password)"]
    data = body.encode()
    for r in got:
        if "argument" in r.named:
            assert data[r.start : r.end].decode() == r.matching and r.named["aes_key"] == "0123456789abcdef" and r.named["mode"] == "ECB"
    assert sum("argument" not in r.named for r in got) == 1


def test_literals_of_scripts():
    assert [aesflow.unquoted(x) for x in (r'"a\x41B"', r"'it\'s \"q\"'", r'"\u{1F600}\n"', r'"\q\\"')] == ["aAB", 'it\'s "q"', "\U0001f600\n", "q\\"]


def test_scan_drops_suppressed_matches_and_copies(spark):
    texts = ['token = "' + "0a1b2c3d4e5f6789" * 2 + '" token = "' + "0a1b2c3d4e5f6789" * 2 + '"', 'token = "' + "0" * 32 + '"', "password: 'Please enter password'", "password: 'hunter22!'"]
    got = scan.scan(blobs(spark, [*texts, texts[0]]).select("blob_id", "text"), rules.BUILTIN).collect()
    assert sorted(r.rule_id for r in got) == ["tr.password.1", "tr.token.1"]
    linked = ["AQ" + "x1Y2" * 20, "linkedin_key = AQ" + "x1Y2" * 20, "other = AQ" + "x1Y2" * 20 + " more"]
    assert scan.scan(blobs(spark, linked).select("blob_id", "text"), rules.SCANNED).count() == 2
    labels = "color: 'x'\ndate: 'x'\nemail: 'x'\nmonth: 'x'\nnumber: 'x'\nrange: 'x'\npassword: 'Passwort'\n"
    assert scan.scan(blobs(spark, [labels]).select("blob_id", "text"), rules.BUILTIN).count() == 1
    assert scan.scan(blobs(spark, [labels]).select("blob_id", "text"), rules.BUILTIN, context=9).count() == 0
    asked = spark.createDataFrame([("\\u8bf7\\u8f93\\u5165\\u5bc6\\u7801",), ("\\u0061bc",)], "v string").select(suppress.is_password_prompt(F.col("v"))).collect()
    assert [r[0] for r in asked] == [True, False]


def test_chunks_find_each_hit_once(spark):
    lines = [f"line {k} 10.0.{k % 7}.{k % 200}" if k % 3 else "é" * 30 for k in range(400)]
    frame = blobs(spark, ["\n".join(lines), "", None, "10.1.1.1", "x" * 5000 + "\n10.2.2.2\n"]).select("blob_id", "text")
    rule = [r for r in rules.BUILTIN if r.id == "tr.ipv4.1"]
    key = ["structural_id", "start", "end", "start_line", "start_column", "matching"]
    want = sorted(map(tuple, detect.with_ids(detect.with_python(frame, rule)).select(*key).collect()))
    for size, overlap in ((300, 2), (1000, 0), (1 << 20, 10)):
        assert sorted(map(tuple, chunks.scan(frame, rule, size=size, overlap=overlap).select(*key).collect())) == want
    for body in ("a\nb\nc\n", "a" * 50 + "\nb", "", "\n\n\n", "no end"):
        parts = chunks.cut(body.encode(), 4, 0)
        assert b"".join(body.encode()[a:b] for a, b, _ in parts) == body.encode()
        assert all(body.encode()[:a].count(b"\n") == n for a, _, n in parts)


def greedy(text, most):
    """Chunks of lines, one line after another."""
    out, held, first = [], "", 1
    lines = [x for x in re.findall(r"[^\n]*\n|[^\n]+", text)]
    for k, line in enumerate(lines):
        if held and len((held + line).encode()) > most:
            out.append((first, k, held))
            held, first = "", k + 1
        held += line
    return out + ([(first, len(lines), held)] if held else [])


def test_review_chunks_are_those_of_one_line_after_another(spark):
    texts = ["a\nbb\nccc\n" * 20, "x" * 100, "", "é\n" * 30 + "end", "\n" * 12]
    got = chunks.review_chunks(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), most=16).collect()
    for k, text in enumerate(texts):
        assert [(r.first_line, r.last_line, r.text) for r in sorted(got, key=lambda r: r.chunk) if r.k == k] == greedy(text, 16)


def test_insights(spark):
    text = "# Report\n- **API key** in app.js\n- **API key** in app.js\n---\n2. No secret here\n| token | leaked |\n`admin` page\n* debug on\n" + "x" * 300 + " risk\nplain"
    got = chunks.insights(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).orderBy("rank").collect()
    assert [r.insight for r in got] == ["API key** in app.js", "token | leaked", "admin` page"]


def test_scanner_takes_the_same_way(spark, tmp_path):
    (tmp_path / "a.txt").write_text("password: 'hunter22!' password: 'Enter password'")
    found = Scanner(spark).scan_folder(tmp_path).collect()
    assert [r.matching for r in found] == ["password: 'hunter22!'"] and found[0].path == "a.txt" and found[0].before == ""
    assert Scanner(spark, include="aws").rule_count == 1
    assert [kind(t) for t in ("https://github.com/a/b", "https://x.example/a.js", "./src", "git@gitlab.com:a/b.git")] == ["repository", "url", "path", "repository"]


def test_store_keeps_each_key_once_when_writers_race(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store, rows = Store(spark, root), lambda n: spark.createDataFrame([(f"b{k}", k) for k in range(n)], "blob_id string, size long")
    store.add("blobs", rows(3))
    keep, raced = Store._commit, []

    def late(self, name, version, runs):
        if not raced:
            raced.append(True)
            Store(spark, root).add("blobs", rows(5))
        return keep(self, name, version, runs)

    monkeypatch.setattr(Store, "_commit", late)
    store.add("blobs", rows(8))
    assert sorted(r.blob_id for r in store.table("blobs").collect()) == [f"b{k}" for k in range(8)]
    monkeypatch.undo()
    note = lambda status, at: spark.createDataFrame([("finding", "f", status, "", at)], "target_type string, target_id string, status string, comment string, at long")
    store.annotate(note("accept", 1))
    store.annotate(note("reject", 2))
    assert [r.status for r in store.table("annotations").collect()] == ["reject"]
    frame = blobs(spark, ["1.1.1.1", "2.2.2.2"]).select("blob_id", F.lit("p").alias("path"), "text")
    pack = [r for r in rules.BUILTIN if r.id == "tr.ipv4.1"]
    assert store_scan(store, frame, pack).count() == 2 and store_scan(store, frame, pack).count() == 0 and store.table("matches").count() == 2
