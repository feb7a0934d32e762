"""The engine on small pages: vectors for every rule, and whole runs."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.config import Settings
from veilspark.functions import text as tx
from veilspark.functions.validators import VALIDATORS
from veilspark.operators import entities, evaluate, finders, geometry, merge, rewrite, surrogates, views
from veilspark.operators import judge as jdg
from veilspark.plans import cases, engine
from veilspark.sources import readers

PAGE = (
    "Mr. Rajesh Kumar Sharma, contact +91 98765 43210 or rajesh.sharma@acme.co.in\nRegistered office: Plot No. 12, MG Road, Pune 411 001, Maharashtra, India\n"
    "PAN ABCPK1234F and date of birth: 12/05/1980; card 4111 1111 1111 1111\nDIN 01234567. Mr. Sharma met the Board."
)


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")


@pytest.mark.parametrize(
    ("name", "value", "ok"),
    [
        ("luhn", "4111111111111111", True), ("luhn", "4111111111111112", False), ("luhn", "0", False), ("verhoeff", "234567890124", True), ("verhoeff", "234567890123", False),
        ("verhoeff", "134567890124", False), ("pan", "ABCPK1234F", True), ("pan", "ABCXK1234F", False), ("phone", "+919876543210", True), ("phone", "09876543210", True),
        ("phone", "1111111111", False), ("phone", "9876500000", False), ("phone", "2019 2020 21", False), ("phone", "2019202021", True), ("ssn", "123-45-6789", True), ("ssn", "000-45-6789", False),
        ("ssn", "666-45-6789", False), ("ssn", "900-45-6789", False), ("ssn", "123-00-6789", False), ("ip", "10.0.0.255", True), ("ip", "10.0.0.256", False),
        ("ip", "1:2:3:4:5:6:7:8", True), ("din", "01234567", True), ("din", "11111111", False),
    ],
)
def test_validators(spark, name, value, ok):
    assert spark.range(1).select(VALIDATORS[name](F.lit(value))).first()[0] is ok


def test_find_all_offsets(spark):
    pattern = r"\b\d{2,4}\b"
    texts = ["", "12 and 345, 6 then 7890", "é12 ü 99", "11 22 33"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.find_all(F.col("t"), pattern).alias("m")).collect()
    for r in rows:
        assert [(m.start, m.end, m.text) for m in r.m] == [(*m.span(), m.group()) for m in re.finditer(pattern, r.t)]


def test_hmac(spark):
    got = spark.range(1).select(tx.hmac_hex("salt", F.lit("PERSON|ä"))).first()[0]
    assert got == hmac.new(b"salt", "PERSON|ä".encode(), hashlib.sha256).hexdigest()


def test_views_and_words(spark):
    docs = spark.createDataFrame([(1, "a  b\n\n c/d (Alpha/Beta,\n" + "\n".join("x" * 60)), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.page_no): r.text for r in views.page_views(docs).collect()}
    assert got[1, 1].startswith("a b\nc/d (Alpha Beta,\nx") and set(got) == {(1, 1), (1, 2)}
    plain = {(r.doc_id, r.page_no): r.text for r in views.page_views(docs, split_slashes=False).collect()}
    assert plain == {(r.doc_id, r.page_no): r.text for r in views.view_of_words(views.words(docs)).collect()}


def test_digit_guard_and_context(spark):
    found, parked = finders.find_regex(pages(spark, "x 123-45-67890 y 123-45-6789", "DIN 12345678", "number 87654321", "number 87654320"))
    assert [(r.text, r.type) for r in found.where("type = 'SSN'").collect()] == [("123-45-6789", "SSN")]
    assert sorted(r.text for r in parked.where("type = 'DIN'").collect()) == ["87654320", "87654321"]
    kept = jdg.resolve_parked(parked, pages(spark, "", "DIN 12345678", "number 87654321", "number 87654320"))
    assert [r.text for r in kept.collect()] == ["87654321"]


def test_islands_are_components(spark):
    rng = random.Random(5)
    rows = [(p, 1, (w := rng.randrange(30)), w + rng.randrange(4), n) for p in range(60) for n in range(rng.randrange(1, 12))]
    got = {(r.doc_id, r.seq): r.island for r in merge.groups(spark.createDataFrame(rows, "doc_id long, page_no int, w0 int, w1 int, seq long")).collect()}
    for p in range(60):
        own = [r for r in rows if r[0] == p]
        root = {r[4]: r[4] for r in own}
        for _ in own:
            for a in own:
                for b in own:
                    if a[2] <= b[3] and b[2] <= a[3]:
                        root[a[4]] = root[b[4]] = min(root[a[4]], root[b[4]])
        for a in own:
            for b in own:
                assert (root[a[4]] == root[b[4]]) == (got[p, a[4]] == got[p, b[4]])


def test_whole_run(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "doc_id long, text string")
    model = finders.gazetteer({"Rajesh Kumar Sharma": "full name"})
    result = engine.run(docs, models=[lambda v: finders.find_with_model(v, model)])
    kept = {(r.type, r.text): r for r in result.mentions.collect()}
    assert {k[0] for k in kept} == {"PERSON", "PHONE", "EMAIL", "ADDRESS", "PAN", "DOB", "CREDIT_CARD", "DIN"}
    assert kept["PERSON", "Sharma"].entity_id == kept["PERSON", "Rajesh Kumar Sharma"].entity_id == "P1"
    assert kept["PERSON", "Rajesh Kumar Sharma"].surrogate.endswith(kept["PERSON", "Sharma"].surrogate)
    text = result.pages.first().text
    assert "Sharma" not in text and "411 001" not in text and "the Board." in text and text.startswith("Mr. ")
    assert result.leaks.count() == 0 and result.summary().first().verify == "ok"


def test_judge_rules(spark):
    view = "Reliance said. SEBI rules. " + "and so on " * 8 + "Acme Limited and BRLMs"  # the corporate word is out of reach of the first name
    rows = [("Reliance", "ORG", ["gliner"], 0.9), ("SEBI", "ORG", ["gliner"], 0.9), ("Acme Limited", "ORG", ["gliner"], 0.9), ("BRLMs", "ORG", ["gliner", "llm"], 0.9), ("said", "ORG", ["gliner"], 0.45), ("rules", "PERSON", ["gliner"], 0.9)]
    merged = spark.createDataFrame([(1, 1, view.index(t), view.index(t) + len(t), t, k, f, c, i, i, i) for i, (t, k, f, c) in enumerate(rows)], "doc_id long, page_no int, start int, end int, text string, type string, finders array<string>, confidence double, w0 int, w1 int, seq long")
    got = {r.text: r.reason for r in jdg.judge(merged, pages(spark, view)).collect()}
    assert got == {"Reliance": "judge_org_context", "SEBI": "judge_exempt", "Acme Limited": "kept", "BRLMs": "judge_generic", "said": "no_capital", "rules": "no_capital"}


def test_person_links_against_loop(spark):
    rng = random.Random(3)
    words = ["asha", "devi", "ravi", "nair", "shah", "a", "r"]
    docs = [[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(7)] for _ in range(40)]
    docs = [list(dict.fromkeys(d)) for d in docs]
    rows = [(i, "PERSON", k, n) for i, d in enumerate(docs) for n, k in enumerate(d)]
    got = {(r.doc_id, r.key): r.target for r in entities.person_links(spark.createDataFrame(rows, "doc_id long, type string, key string, first long")).collect()}

    def inside(small, big):
        it = iter(big)
        return all(any(w == b or (len(w) == 1 and b.startswith(w)) for b in it) for w in small)

    for i, d in enumerate(docs):
        able = [k for k in d if len(k.split()) >= 2 and all(len(w) > 1 for w in k.split())]
        over = lambda k, pool: [t for t in pool if len(t.split()) > len(k.split()) and inside(k.split(), t.split())]
        targets = [k for k in able if not over(k, able)]
        for k in d:
            best = min(over(k, targets), key=lambda t: (t.split()[-1] != k.split()[-1], d.index(t)), default=None)
            assert got.get((i, k)) == best


def test_surrogates_are_valid_and_stable(spark):
    real = {"CREDIT_CARD": ("4111 1111 1111 1111", "luhn"), "AADHAAR": ("2345 6789 0124", "verhoeff"), "PAN": ("ABCPK1234F", "pan"), "SSN": ("123-45-6789", "ssn"), "IP": ("10.0.0.1", "ip"), "DIN": ("0123 4567", None)}
    base = spark.range(50).select(surrogates.stream("s", F.col("id").cast("string")).alias("d"))
    for kind, (value, check) in real.items():
        got = [r[0] for r in base.select(surrogates.GENERATORS[kind](F.lit(value), F.col("d"))).collect()]
        assert len(set(got)) > 20 and [len(g) for g in got] == [len(value)] * 50 or kind == "IP"
        if check:
            tight = spark.createDataFrame([(g.replace(" ", ""),) for g in got], "v string")
            assert tight.where(~VALIDATORS[check](F.col("v"))).count() == 0


def test_edits_and_needles(spark):
    edits = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("repl")) for a, b, c in [(0, 3, "X"), (5, 6, "YY")]))
    assert spark.range(1).select(rewrite.apply_edits(F.lit("abcdefgh"), edits)).first()[0] == "XdeYYgh"
    assert rewrite.split_over_lines("Harbor Works Limited", [6, 6, 7]) == ["Harbor", "Works", "Limited"]


def test_scoring(spark):
    pred = evaluate.numbered(spark.createDataFrame([(1, "Acme Ltd", "ORG"), (1, "Bob", "PERSON"), (2, "x@y.zz", "EMAIL")], "page int, text string, type string"))
    truth = evaluate.numbered(spark.createDataFrame([(1, "ACME  LTD", "ORG"), (1, "Bobby", "PERSON"), (2, "q@y.zz", "EMAIL")], "page int, text string, type string"))
    pred, truth = pred.cache(), truth.cache()
    got = {r.type: (r.tp, r.fp, r.fn) for r in evaluate.scores(pred, truth, evaluate.match(pred, truth)).collect()}
    assert got == {"ORG": (1, 0, 0), "PERSON": (1, 0, 0), "EMAIL": (0, 1, 1), None: (2, 1, 1)}
    assert evaluate.match(pred, truth, any_type=True, ratio=0.8).count() == 3
    assert evaluate.coverage("call Rastogi/Abhijit at www.nuvama.com now".split(), ["Abhijit", "uvama"]) == [False, True, False, False, False]


def stacked_words(spark, rows, doc="d"):
    """Words of one page; a row is (text, block, line, x0, y0) or, for a line below the last at its left, a text."""
    out = []
    for i, r in enumerate(rows):
        text, block, line, x0, y0 = r if isinstance(r, tuple) else (r, i, 0, 0.0, 10.0 * i)
        out.append((doc, 1, i, text, "pdf", block, line, None, x0, y0, x0 + 5.0, y0 + 9.0))
    return spark.createDataFrame(out, "doc_id string, page_no int, word_id int, text string, source string, block int, line int, para int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize(
    ("rows", "view"),
    [
        (["Pro", *"moter", ("two", 6, 0, 0.0, 60.0), ("words", 6, 0, 9.0, 60.0)], "Promoter\ntwo words"),
        (["a", "b", "end"], "a\nb\nend"),
        (["a", "b", "c", "end", "next"], "abcend\nnext"),
        (["x", "a", "b", ("c", 3, 0, 90.0, 30.0)], "xab\nc"),
        (["Non-", "Institutional"], "Non-Institutional"),
        (["cs.connect@ksh.co", "m"], "cs.connect@ksh.com"),
        (["cs@x.com", "Telephone:"], "cs@x.com\nTelephone:"),
        (["cs@x.co", "a"], "cs@x.co\na"),
        ([("one", 0, 0, 0.0, 0.0), ("two", 0, 0, 9.0, 0.0), ("three", 0, 1, 0.0, 30.0)], "one two three"),
    ],
)
def test_layout_views(spark, rows, view):
    assert geometry.layout_views(stacked_words(spark, rows)).first().text == view


def test_lines_glue_fragments(spark):
    words = stacked_words(spark, [("Ra", 0, 0, 0.0, 0.0), ("vi", 0, 0, 5.0, 0.0), ("now", 0, 1, 9.0, 0.0)]).withColumn("para", F.lit(0))
    assert [(r.text, r.n_tokens) for r in geometry.lines(words).orderBy("line_no").collect()] == [("Ravi", 1), ("now", 1)]


def test_geometry_and_chunks(spark):
    assert geometry.first_images([(0, 0, 10, 10), (0, 0, 10, 9.5), (20, 0, 30, 10)]) == [0, 2]
    texts = ["One. " * 100, "line\n" * 70, "x" * 350, "", "short", "é. ü\n" * 99, "a" * 70 + ". " + "b" * 200]
    for text, r in zip(texts, spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(views.chunks(F.col("t"), 100, 20).alias("c")).collect()):
        assert all(text[p.start : p.start + len(p.text)] == p.text and len(p.text) <= 100 for p in r.c)
        at = 0
        for n, p in enumerate(r.c):
            assert p.start == at
            end = min(at + 100, len(text))
            cuts = [i + 1 for i in range(at + 66, end) if text[i] == "\n" or (text[i : i + 2] == ". " and i + 2 <= end)]
            if end < len(text) and cuts:
                end = max(cuts)
            assert p.start + len(p.text) == end and (end < len(text)) == (n + 1 < len(r.c))
            at = max(end - 20, at + 1)
        assert bool(r.c) == bool(text)
    assert finders.locate("aaa", "aa") == [(0, 2), (1, 3)] and finders.locate("a b c", "abc") == [(0, 5)] and finders.locate("a b", " ") == []
    text = "Promoter: K U S H A L\nS U B B A Y Y A HEGDE, Pune"
    assert finders.locate(text, "KUSHAL SUBBAYYA HEGDE") == [(10, 43)] and finders.locate(text, "nowhere") == []


def test_coverage_and_documents_apart(spark):
    tokens = "Contact Kushal Hegde at cs@x.com from Acme Private Limited and SEBI or www.acme.com".split()
    truth, found = ["Kushal Hegde", "cs@x.com", "Acme Private Limited"], ["KUSHAL  HEGDE", "cs@x.com", "Acme", "SEBI"]
    a, b = evaluate.coverage(tokens, found), evaluate.coverage(tokens, truth)
    assert (sum(x == y for x, y in zip(a, b)), len(tokens)) == (10, 13)
    assert evaluate.coverage("aa aa aa".split(), ["aa", "aa"]) == [True, True, False]
    rows = spark.createDataFrame([("d1", 1, "Acme", "ORG"), ("d2", 1, "Acme", "ORG")], "doc_id string, page int, text string, type string")
    left, right = evaluate.numbered(rows), evaluate.numbered(rows.where("doc_id = 'd2'"))
    assert evaluate.match(left, right).count() == 1
    got = {r.type: (r.tp, r.fp, r.fn) for r in evaluate.scores(left, right, evaluate.match(left, right)).collect()}
    assert got[None] == (1, 1, 0)
    pages = spark.createDataFrame([("d1", 1, "Acme is in the town"), ("d2", 1, "Acme is in the town"), ("d2", 5, "12")], "doc_id string, page int, text string")
    accuracy = {(r.doc_id, r.page): (r.correct, r.total, r.skipped) for r in evaluate.token_accuracy(pages, left, right).collect()}
    assert accuracy == {("d1", 1): (4, 5, False), ("d2", 1): (5, 5, False), ("d2", 5): (0, 0, True)}


def test_propagation_gate(spark):
    text = ["Our Promoter is Mr. Kushal Subbayya Hegde. The Broad Family Trust holds 10% of shares.", "Mr. Hegde has a broad range of experience. Broad Family Trust and Mr. Broad agree. HEGDE was appointed in 2019. Lane was"]
    v = pages(spark, *text)
    seeds = [("Mr. Kushal Subbayya Hegde", "PERSON"), ("Broad Family Trust", "ORG"), ("Daniel Lane", "PERSON")]
    rows = [(1, 1, text[0].find(t), text[0].find(t) + len(t), t, k, i) for i, (t, k) in enumerate(seeds)]
    spans = spark.createDataFrame(rows, "doc_id long, page_no int, start int, end int, text string, type string, seq long")
    spans = spans.join(v.select("page_no", F.col("text").alias("view")), "page_no").select("doc_id", "page_no", "start", "end", "text", "type", F.array(F.lit("gliner")).alias("finders"), F.lit(0.9).alias("confidence"), *finders.span_columns(F.col("view")), "seq")
    got = {(r.page_no, r.type, r.text, r.confidence) for r in finders.propagate(v, spans, settings=Settings(common_words=("broad", "lane"))).collect()}
    assert {(2, "PERSON", "Hegde", 0.9), (2, "PERSON", "HEGDE", 0.9), (2, "ORG", "Broad Family Trust", 0.9), (2, "ORG", "Broad", 0.6)} <= got
    assert not [x for x in got if x[2] in ("broad", "Lane") or x[0] == 1]


def test_llm_finder(spark):
    v = pages(spark, "Ask R a v i Rao or Acme. Acme!", "no name", "broken")

    def load():
        def ask(system, text):
            if text == "broken":
                raise RuntimeError("down")
            return 'Sure: ```json {"items": [{"type": "person", "text": "Ravi Rao"}, {"type": "ORG", "text": "Acme"}, {"type": "FISH", "text": "Ask"}, {"type": "ORG", "text": "Nobody Here"}]} ```'

        return ask

    spans, events = finders.find_with_llm(v, load)
    assert {(r.page_no, r.start, r.end, r.type, r.confidence) for r in spans.collect()} == {(1, 4, 15, "PERSON", 0.8), (1, 19, 23, "ORG", 0.8), (1, 25, 29, "ORG", 0.8)}
    told = {(r.page_no, r.event, r.detail) for r in events.collect()}
    assert {(3, "failed", "down"), (1, "unlocated", "Nobody Here"), (2, "unlocated", "Acme")} <= told
    result = engine.run(None, views=v, models=[lambda x: finders.find_with_llm(x, load)])
    assert {r.stage for r in rewrite.audit_rows(result.judged, result.events, "r").collect()} == {"judge", "llm_failed", "llm_unlocated"}
    s = result.summary().first()
    assert (s.pages, s.failed, s.verify, s.spans, s.review_items) == (3, 1, "ok", 1, 2)


def test_ip_without_digits(spark):
    spans, _ = finders.find_regex(pages(spark, "at dead:beef:cafe:face:feed:babe:fade:deaf now"), types=["IP"])
    assert [r.text for r in spans.collect()] == ["dead:beef:cafe:face:feed:babe:fade:deaf"]


def test_docx_round_trip(tmp_path, spark):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Call Ra</w:t></w:r><w:r><w:t>vi now</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="mailto:ravi@x.org" TargetMode="External"/></Relationships>'
    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", rels)
    content = path.read_bytes()
    assert readers.docx_links(content) == ["ravi@x.org"]
    new = readers.write_docx(content, {0: [(5, 9, "Asha")]}, {"ravi@x.org": "a@example.com"})
    assert "".join(t for p, _, t in readers.docx_runs(new) if p == 0) == "Call Asha now" and readers.docx_links(new) == ["a@example.com"]
    files = readers.open_files(spark, str(path))
    assert [r.text for r in readers.parse_docx(files).collect()] == ["Call Ravi now\ncell"]


def docx_file(path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="a" xmlns:p="p"'
    run = lambda *texts: "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts)
    picture = '<w:r><w:drawing><p:extent cx="127000" cy="254000"/><a:blip r:embed="rId7"/></w:drawing></w:r>'
    paragraphs = [run("Our head is Mr. Ra", "vi Na", "ir, card 4111 1111 ", "1111 1111 now"), f"<w:r><w:t>Mail:</w:t><w:tab/><w:t>ravi.n@acme.org</w:t></w:r>{picture}", run("Ravi Nair signed")]
    body = f"<w:document {w}><w:body>{''.join(f'<w:p>{p}</w:p>' for p in paragraphs)}</w:body></w:document>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="mailto:ravi.n@acme.org" TargetMode="External"/></Relationships>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", rels)
    return path.read_bytes()


def docx_text(content):
    out = {}
    for para, _, t in readers.docx_runs(content):
        out[para] = out.get(para, "") + t
    return list(out.values())


def test_office_files_end_to_end(spark, tmp_path):
    from veilspark.plans.office import redact_files

    content = docx_file(tmp_path / "a.docx")
    words = list(readers.docx_file_words(content, 50))
    assert [w[2] for w in words if w[3] == 0][3:6] == ["Mr.", "Ra", "vi"] and words[4][4] == words[5][4] and words[-1][2] == "ravi.n@acme.org"
    assert readers.docx_images(content) == [("rId7", 1, 10.0, 20.0)]
    model = finders.gazetteer({"Ravi Nair": "PERSON"})
    result, files = redact_files(spark, str(tmp_path / "a.docx"), models=[lambda v: finders.find_with_model(v, model)])
    assert result.views.first().text.split("\n")[:2] == ["Our head is Mr. Ravi Nair, card 4111 1111 1111 1111 now", "Mail: ravi.n@acme.org"]
    new = bytes(files.first().content)
    fake = {r.text.strip(): r.surrogate.strip() for r in result.mentions.collect()}
    assert docx_text(new) == [f"Our head is Mr. {fake['Ravi Nair']}, card {fake['4111 1111 1111 1111']} now", f"Mail:\t{fake['ravi.n@acme.org']}", f"{fake['Ravi Nair']} signed"]
    assert readers.docx_links(new) == [fake["ravi.n@acme.org"]] and b"acme.org" not in new


def test_service(spark, tmp_path):
    import json
    import threading
    import time
    import urllib.error
    import urllib.request

    from veilspark.plans.service import Jobs, serve

    content = docx_file(tmp_path / "a.docx")
    server = serve(Jobs(spark, str(tmp_path / "jobs")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def code(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data), timeout=60) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert code("/redact?name=a.txt", b"x")[0] == 400 and code("/jobs/none")[0] == 404 and code("/jobs/none/download")[0] == 404
    job = json.loads(code("/redact?name=a.docx", content)[1])["job_id"]
    broken = json.loads(code("/redact?name=b.docx", b"no zip")[1])["job_id"]
    assert code(f"/jobs/{broken}/download")[0] == 409
    state = lambda j: json.loads(code(f"/jobs/{j}")[1])
    for _ in range(240):
        if state(broken)["status"] in ("done", "failed", "verify_failed"):
            break
        time.sleep(0.5)
    assert state(job)["status"] == "done" and state(broken)["status"] == "failed"
    assert b"acme.org" not in code(f"/jobs/{job}/download")[1] and b"ravi.n@acme.org" in code(f"/jobs/{job}/mapping")[1]
    server.shutdown()


def test_ocr_lines_and_boxes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (100).to_bytes(4, "big")
    images = spark.createDataFrame([(1, 1, 0, bytearray(png), 10.0, 20.0, 110.0, 70.0), (1, 2, 0, bytearray(png), None, None, None, None)], "doc_id long, page_no int, image_no int, png binary, x0 double, y0 double, x1 double, y1 double")
    lines = [([(20, 10), (60, 10), (60, 30), (20, 30)], " Ravi ", 0.9), ([(0, 0), (1, 0), (1, 1), (0, 1)], "dim", 0.4), ([(0, 0), (1, 0), (1, 1), (0, 1)], " ", 0.9)]
    got = {(r.page_no, r.line, r.text, r.x0, r.y0, r.x1, r.y1) for r in readers.ocr_words(images, lambda: lambda content: lines).collect()}
    assert got == {(1, 0, "Ravi", 20.0, 25.0, 40.0, 35.0), (2, 0, "Ravi", 20.0, 10.0, 60.0, 30.0)}
    words = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 9.0), (1, 1, 1, 6.0, 1.0, 9.0, 12.0)], "doc_id long, page_no int, word_id int, x0 double, y0 double, x1 double, y1 double")
    mention = spark.createDataFrame([(1, 1, 0, 9, 0, 1, "P1", "Gray Fern")], "doc_id long, page_no int, start int, end int, w0 int, w1 int, entity_id string, surrogate string")
    assert [tuple(r) for r in readers.covering_boxes(words, mention).collect()] == [(1, 1, "P1", "Gray Fern", 0.0, 0.0, 9.0, 12.0)]


def test_review(spark):
    from veilspark.operators.review import review

    before, after = pages(spark, "Ravi is here", "nothing", "bad"), pages(spark, "Noel is here", "nothing", "bad")
    mention = spark.createDataFrame([(1, 1, "Ravi", "Noel", "PERSON")], "doc_id long, page_no int, text string, surrogate string, type string")

    def load():
        def ask(system, text):
            if "bad" in text:
                raise RuntimeError("down")
            return '{"leaks": ["' + ("- Ravi -> Noel (PERSON)" if "- Ravi -> Noel (PERSON)" in text else "none") + '"], "inconsistent": "one"}'

        return ask

    got = {r.page_no: (r.leaks, r.wrong_replacements, r.inconsistent, r.error) for r in review(before, after, mention, load).collect()}
    assert got == {1: (["- Ravi -> Noel (PERSON)"], [], ["one"], None), 2: (["none"], [], ["one"], None), 3: ([], [], [], "RuntimeError: down")}


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.streaming.ingest import redact_stream

    docs = spark.createDataFrame([(1, "mail a.b@example.org now"), (2, "nothing")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    redact_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    streamed = {r.text for r in spark.read.parquet(f"{tmp_path}/out/pages").collect()}
    assert streamed == {r.text for r in engine.run(docs).pages.collect()} and not any("a.b@example.org" in t for t in streamed)


def test_entry_registers():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship" in e.queries()


def test_settings():
    s = Settings().with_type("PHONE", enabled=False)
    assert "PHONE" not in [t.name for t in s.enabled()]


def test_no_surrogates_without_a_salt(spark):
    with pytest.raises(ValueError, match="PII_SALT"):
        engine.run(spark.createDataFrame([(1, "mail a.b@example.org now")], "doc_id long, text string"), Settings(salt=""))


def test_documents_that_leak_are_not_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@example.org now"), (2, "card 4111 1111 1111 1111 and 74111 1111 1111 1111")], "doc_id long, text string")
    result = engine.run(docs)
    assert {r.doc_id for r in result.leaks.collect()} == {2}
    assert not engine.write(result, str(tmp_path / "out"), run_id="r1")
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "out/pages")).collect()} == {1}
    verify = {r.doc_id: r.verify for r in spark.read.json(str(tmp_path / "out/summary")).collect()}
    assert verify == {1: "ok", 2: "verify_failed"}
    nested = spark.read.json(str(tmp_path / "out/mapping_json")).where("doc_id = 1").first()
    assert [m.text for m in nested.mentions] == ["a.b@example.org"] and spark.read.json(str(tmp_path / "out/audit")).count() > 0


# ---------------------------------------------------------------- whole runs at size


@pytest.fixture
def stages(monkeypatch):
    """The labels of the tables that a run writes, in order."""
    labels, write = [], engine.written
    monkeypatch.setattr(engine, "written", lambda df, label: labels.append(label) or write(df, label))
    return labels


@pytest.fixture(scope="module")
def customers(spark):
    return spark.range(7).withColumnRenamed("id", "c_custkey").coalesce(1)


def test_letters_of_a_small_file_are_dealt_out(spark, customers):
    assert cases.letters(customers).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_decisions_stop_at_the_judge(customers, stages):
    assert cases.decisions(customers).count() == 7 * 9 + 3 + 3  # odd keys: 1, 3, 5; by three: 0, 3, 6
    assert stages[-1] == "judged" and stages.count("raw") == 1


def test_entities_need_no_surrogates(customers, stages, monkeypatch):
    monkeypatch.setattr(surrogates, "assign", None)
    rows = cases.entities(customers).collect()
    assert len(rows) == 35 and {r.real for r in rows if r.type == "ORG"} == {cases.FIRM} and stages[-2:] == ["entities", "mentions"]


def test_surrogates_need_no_pages(customers, monkeypatch):
    monkeypatch.setattr(rewrite, "rewrite", None)
    rows = cases.surrogates(customers).collect()
    assert len(rows) == 35 and all(r.spellings == 1 for r in rows) and sum(r.fitting for r in rows) == 7 * 8


def test_scores_need_no_surrogates(customers, monkeypatch):
    monkeypatch.setattr(surrogates, "assign", None)
    assert {r.type: (r.tp, r.fp, r.fn) for r in cases.scores(customers).collect()}["all"] == (35, 21, 7)


def test_tagged_pages_need_no_surrogates(customers, monkeypatch):
    monkeypatch.setattr(surrogates, "assign", None)
    texts = {(r.doc_id, r.page_no): r.text for r in cases.tagged(customers).collect()}
    assert len(texts) == 14 and texts[1, 2] == "<P1> wrote again from <EMAIL1> today."


def test_leaks_run_every_stage(customers, stages):
    rows = cases.leaks(customers).collect()
    assert len(rows) == 49 and {r.pages for r in rows} == {"original"} and stages[-5:] == ["entities", "mentions", "entities", "mentions", "pages"]


def test_offsets_beside_the_separator(spark):
    """Matches in texts that hold the character that stands for a match, and words by number."""
    texts = ["", "12 ab 34", "\0 12\0 34", "x12", "a\U0001f60012 b 7\n8"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.find_all(F.col("t"), r"\d+").alias("m"), rewrite.word_offsets(F.col("t"), F.lit(1)).alias("w")).collect()
    for r in got:
        assert [tuple(m) for m in r.m] == [(*m.span(), m[0]) for m in re.finditer(r"\d+", r.t)]
        assert r.w == len(re.split("[ \n]", r.t)[0]) + 1


def test_loose_variants_with_signs(spark):
    views_ = pages(spark, "Smith & Sons Ltd. wrote.", "S m i t h & Sons Ltd. again, SMITH &SONS LTD.")
    seed = views_.limit(1).selectExpr("doc_id", "page_no", "0 start", "17 end", "'Smith & Sons Ltd.' text", "'ORG' type", "array('gliner') finders", "0.9D confidence", "0 w0", "3 w1", "0L seq")
    assert {r.text for r in finders.propagate(views_, seed).collect()} >= {"S m i t h & Sons Ltd.", "SMITH &SONS LTD."}


def test_confirmed_words_are_not_searched_again(spark):
    """What is left of a page to look for variants in; a match is searched for once."""
    rows = [("Ann Lee met\nBob Ray and Ann Lee", [(0, 1), (3, 4)]), ("Ann Lee", [(0, 1)]), ("Ann Lee", None), ("a b c d", [(0, 2), (1, 1), (3, 3)])]
    table = spark.createDataFrame(rows, "t string, c array<struct<c0:int,c1:int>>").coalesce(1)
    assert [r.x for r in table.select(finders._uncovered(F.col("t"), F.col("c")).alias("x")).collect()] == ["\0met\0andAnnLee", "\0", "Ann Lee", "\0\0\0"]
    plan = spark.range(1).select(tx.find_all(F.col("id").cast("string"), r"\d+").alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1 and "slice(" not in plan


def test_propagation_keeps_what_touches_no_confirmed_word(spark):
    views = spark.createDataFrame([("d", 1, "Asha Nair met Nair. Nair and\nAsha Nair"), ("d", 2, "asha nair")], "doc_id string, page_no int, text string")
    raw = spark.createDataFrame([("d", 1, 0, 9, "Asha Nair", "PERSON", ["gliner"], 0.9, 0, 1, 1), ("d", 1, 29, 38, "Asha Nair", "PERSON", ["gliner"], 0.9, 6, 7, 2)], "doc_id string, page_no int, start int, end int, text string, type string, finders array<string>, confidence double, w0 int, w1 int, seq long")
    found = sorted((r.page_no, r.start, r.end, r.w0, r.w1) for r in finders.propagate(views, raw, raw).collect())
    assert found == [(1, 14, 18, 3, 3), (1, 20, 24, 4, 4), (2, 0, 9, 0, 1), (2, 5, 9, 1, 1)]


def test_surrogates_write_no_digests(spark, monkeypatch):
    """Name fakes and the assigned entities are all that is written; digests and mailboxes are not."""
    labels, real = [], surrogates.written
    monkeypatch.setattr(surrogates, "written", lambda df, label: labels.append((label, df.columns)) or real(df, label))
    people = spark.createDataFrame(
        [("d", "P1", "PERSON", "asha nair", "Asha Nair", (1, 0, 1)), ("d", "EMAIL1", "EMAIL", "ashanairmailexample", "asha.nair7@mail.example", (1, 3, 2)), ("d", "ORG1", "ORG", "borealislimited", "Borealis Limited", (1, 5, 3))],
        "doc_id string, entity_id string, type string, key string, canonical string, first struct<page_no:int,w0:int,seq:long>",
    )
    mentions = people.select("doc_id", "entity_id", "type", F.col("canonical").alias("text"))
    found, told = surrogates.assign(people, mentions, Settings(salt="s"))
    fakes = {r.entity_id: r.surrogate for r in found.collect()}
    assert [label for label, _ in labels] == ["name-fakes", "named"] and not {"digest", "mailbox", "local"} & set(labels[1][1])
    first, last = fakes["P1"].lower().split()
    assert fakes["EMAIL1"] == f"{first}.{last}7@example.com" and fakes["ORG1"].endswith(" Limited") and fakes["ORG1"] != "Borealis Limited"
    assert {r.entity_id: r.surrogate for r in told.collect()}["P1"] == fakes["P1"]
