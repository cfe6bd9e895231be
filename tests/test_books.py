import pytest
from pyspark.sql import functions as F

from quireflow.operators import books, dom, gates, pairing, registers, rewrite
from quireflow.sources import archive

ENTRY = "book_id string, pos int, id string, idref string, href string, role string, output_strategy string, reason string"


def structural(spark, entries, output, translated=(), images=None, names=None):
    source = spark.createDataFrame([("b", 1, "cov", "OPS/cover.xhtml"), ("b", 2, "c1", "OPS/one.xhtml")], "book_id string, src_pos int, src_idref string, src_href string")
    more = {} if images is None else {"images": spark.createDataFrame(images, "book_id string, id string, name string"), "names": spark.createDataFrame(names, "book_id string, name string")}
    rows = gates.structural_failures(source, spark.createDataFrame(entries, ENTRY), spark.createDataFrame(output, "book_id string, idref string, href string"), spark.createDataFrame([("b", x) for x in translated], "book_id string, id string"), **more)
    return sorted(r.message for r in rows.collect())


def test_structural_checks(spark):
    cover = ("b", 1, "item_001", "cov", "cover.xhtml", "cover", "source_only", None)
    body = ("b", 2, "item_002", "c1", "one.xhtml", "body", "translate", None)
    whole = [("b", "cov", "cover.xhtml"), ("b", "item_002", "one.xhtml")]
    assert structural(spark, [cover, body], whole, ["item_002"]) == []
    assert structural(spark, [cover, body], whole) == ["no translation: item_002"]
    assert structural(spark, [], whole) == ["not in the output: c1", "not in the output: cov"]
    # Neither its own entry nor anything called so: the cover is lost; a page that isn't a contents list is a body.
    assert structural(spark, [cover, body], [("b", "x", "x.xhtml")], ["item_002"]) == ["cover lost", "not in the output: c1", "not in the output: cov", "spine has 1 of 2"]
    assert structural(spark, [cover, body], [("b", "nav", "nav.xhtml")], ["item_002"])[:2] == ["cover lost", "no body chapter"]
    gone = ("b", 1, "item_001", "cov", "cover.xhtml", "cover", "drop_explicit", "a scan")
    assert structural(spark, [gone, body], [("b", "item_002", "one.xhtml")], ["item_002"]) == ["cover lost"]
    blank = (*gone[:7], " ")
    assert "not in the output: cov" in structural(spark, [blank, body], [("b", "item_002", "one.xhtml")], ["item_002"])
    assert structural(spark, [cover, body], whole, ["item_002"], [("b", "item_001", "a.png"), ("b", "item_001", "z.png")], [("b", "a.png"), ("c", "z.png")]) == ["image missing: z.png"]


def test_suite_is_closed(spark):
    all_books = spark.createDataFrame([("b",), ("c",)], "book_id string")
    fault = spark.createDataFrame([("b", "x", 2, "p", "late"), ("b", "x", 1, "p", "early")], "book_id string, audit string, seq long, path string, message string")
    none = fault.limit(0)
    some = gates.suite(all_books, {"structural": fault})
    assert {(r.book_id, r.audit): r.status for r in some.collect()}[("c", "href_resolve")] == "not run"
    assert {r.book_id: r.passed for r in gates.all_passed(some).collect()} == {"b": False, "c": False}
    every = gates.suite(all_books, {a: fault if a == "structural" else none for a in gates.AUDITS})
    assert {r.book_id: (r.passed, r.n_failed) for r in gates.all_passed(every).collect()} == {"b": (False, 1), "c": (True, 0)}
    text = {r.book_id: r.summary for r in gates.summary(every).collect()}
    assert text["b"].split("\n")[:4] == ["3 passed, 1 not", "FAIL structural", "  early", "  late"] and text["c"].count("PASS") == 4
    assert {r.status for r in gates.suite(all_books, {}).collect()} == {"not run"}
    with pytest.raises(ValueError):
        gates.suite(all_books, {"other": fault})


def test_preferences(spark):
    e = spark.createDataFrame([("b", "item_001", "ch_01"), ("b", "item_002", "ch_02"), ("b", "item_003", None)], "book_id string, id string, translation_id string")
    files = spark.createDataFrame([("b", f"chapters/{n}_translation.txt", n) for n in ("item_001", "ch_01", "ch_02")] + [("c", "chapters/item_003_translation.txt", "x")], "book_id string, name string, text string")
    assert {(r.id, r.text) for r in books.translation_files(e, files).collect()} == {("item_001", "item_001"), ("item_002", "ch_02")}
    p = spark.createDataFrame([("b", "i", "OPS/t/a.xhtml", "chapters/i.html", "OPS/b.xhtml"), ("b", "j", None, None, "OPS/b.xhtml")], "book_id string, id string, original_path string, href string, src_href string")
    names = spark.createDataFrame([("b", "chapters/i.html"), ("b", "b.xhtml"), ("c", "t/a.xhtml")], "book_id string, name string")
    assert {(r.id, r.name) for r in books.source_pages(p, names, F.lit("OPS/c.opf")).collect()} == {("i", "chapters/i.html"), ("j", "b.xhtml")}
    shown = spark.createDataFrame([("b", 1, "i", "OPS/a%20b.xhtml#x", None, "", "translate", "body"), ("b", 2, "j", "", "x/a b.xhtml", "y.xhtml?q", "translate", "body"), ("b", 3, "n", "nav.xhtml", "", "", "translate", "nav")], "book_id string, pos int, id string, original_path string, href string, src_href string, output_strategy string, role string")
    assert {(r.name, r.id) for r in books.by_file_name(shown).collect()} == {("a b.xhtml", "i"), ("y.xhtml", "j")}


def test_registers(spark):
    hints = spark.createDataFrame([(1, "Plain", "plain prose", 0.22, [" a ", ""]), (2, "exact", "precise", 0.3, None)], registers.REGISTER)
    asked = spark.createDataFrame([("plain", None), ("plain", " EXACT "), ("plain", "other"), (None, None), ("x", "")], "requested string, override string")
    got = {(r.requested, r.override): (r.register_id, r.rules) for r in registers.resolved(asked, hints, ["f"]).collect()}
    assert got == {("plain", None): ("Plain", ["a"]), ("plain", " EXACT "): ("exact", ["f"]), ("plain", "other"): (None, ["f"]), (None, None): (None, ["f"]), ("x", ""): (None, ["f"])}
    many = spark.createDataFrame([(i, f"r{i}", f"register{i:05d}", 0.1, []) for i in range(1500)], registers.REGISTER)
    assert registers.matched(spark.createDataFrame([("register01499",)], "requested string"), many).first().register_id == "r1499"


def test_headings_and_sizes(spark):
    html = "<body><h2>Second</h2><h1>One. Two. Three.</h1><h1>Later</h1><p>Text  here</p></body>"
    n = dom.shred(spark.createDataFrame([(1, html), (2, "<h3></h3><h4>Four</h4>"), (3, None)], "id int, html string"), "id", "html")
    assert {r.doc: r.heading for r in books.headings(n).collect()} == {"1": "Second", "2": "Four"}
    assert {r.doc: r.char_count for r in books.text_sizes(n).collect()}["2"] == 4


def test_json_and_backfill(spark):
    files = spark.createDataFrame([("b", '{"spine": [{"id": "x", "n": 1}, {"id": null}]}'), ("c", "no"), ("d", None), ("e", '{"spine": 3}')], "book_id string, json string")
    rows = {(r.book_id, r.pos): (r.x.id if r.x else None, r.problem) for r in books.json_rows(files, "spine", "id string, n int").collect()}
    assert rows == {("b", 1): ("x", None), ("b", 2): (None, None), ("c", 0): (None, "not JSON"), ("d", 0): (None, "not JSON"), ("e", 0): (None, "no list spine")}
    columns = "spine_id src_idref src_href original_idref original_path href linear media_type role char_count first_heading output_strategy translation_id parent_id reason".split()
    old = spark.createDataFrame([("b", 1, "ch_01", "s1", *[None] * 4, "chapters/x.html", *[None] * 9)], "book_id string, pos int, id string, " + ", ".join(f"{c} string" for c in columns))
    r = books.backfilled(old, legacy=True).first()
    assert (r.id, r.translation_id, r.src_idref, r.src_href, r.original_path, r.linear, r.role, r.char_count, r.first_heading, r.output_strategy) == ("s1", "ch_01", "s1", "chapters/x.html", "chapters/x.html", "yes", "body", 0, "s1", "translate")
    assert books.backfilled(old.limit(0)).count() == 0


def test_standalone_archive(spark):
    pages = spark.createDataFrame([("b", 1, "OPS/a.xhtml", b"<p>one</p>")], "book_id string, pos int, name string, content binary")
    opf = '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><meta name="cover" content="pic"/></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="i/z.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>'
    packages = spark.createDataFrame([("b", "OPS/c.opf", opf)], "book_id string, opf_path string, opf string")
    mine = spark.createDataFrame([("b", "OPS/i/z.png", b"png"), ("b", "OPS/a.xhtml", b"old")], "book_id string, name string, content binary")
    other = spark.createDataFrame([("b", "OPS/i/z.png", b"worse"), ("b", "OPS/s.css", b"css")], "book_id string, name string, content binary")
    made = archive.zipped(books.standalone(pages, packages, books.assets(mine, other)))
    rows = books.standalone(pages, packages, books.assets(mine, other)).orderBy("o").collect()
    assert [r.name for r in rows] == ["mimetype", "META-INF/container.xml", "OPS/c.opf", "OPS/a.xhtml", "OPS/i/z.png", "OPS/s.css"]
    assert bytes(rows[4].content) == b"png" and bytes(rows[3].content) == b"<p>one</p>" and made.count() == 1
    listed = spark.createDataFrame([(r.book_id, i, r.name, r.content) for i, r in enumerate(rows)], "book_id string, ordinal int, name string, content binary")
    assert archive.cover(listed, archive.packages(listed)).first().name == "OPS/i/z.png"


def test_ncx_that_is_no_xml(spark):
    docs = spark.createDataFrame([("b", "<ncx>"), ("c", None), ("d", "<ncx><navPoint><content src='t/a.x'/></navPoint></ncx>")], "book_id string, xml string")
    labels = spark.createDataFrame([("d", 2, "x/a.x", "late"), ("d", 1, "a.x", "first")], "book_id string, pos int, path string, label string")
    got = {r.book_id: r.xml for r in rewrite.patched_ncx(docs, labels).collect()}
    assert got["b"] == "<ncx>" and got["c"] is None and "first" in got["d"] and "late" not in got["d"]


def test_nested_and_unmatched_tags_stay_small(spark):
    deep = "<div>" * 2_000 + "x y" + "</div>" * 2_000 + "</b>" * 20_000 + "<blockquote>" * 900 + "譯" + "</blockquote>" * 900
    n = dom.shred(spark.createDataFrame([(1, deep)], "id int, html string"), "id", "html")
    r = n.agg(F.sum(F.length("text")).alias("t"), F.count("*").alias("n"), F.count_if("has_han").alias("h")).first()
    assert r.n == 2_900 and r.t < 10 and r.h == 900
    assert [x.text for x in dom.text_nodes(n).collect()] == ["譯"]


def test_first_rows_and_source_texts(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "only")], "k string, o int, v string")
    assert {(r.k, r.v) for r in pairing.first_by(rows, ["k"], "o").collect()} == {("a", "first"), ("b", "only")}
    nodes = spark.createDataFrame([("b", 3, ["src"], "two"), ("b", 1, ["src"], "one"), ("b", 4, ["src"], "one"), ("b", 2, ["src"], "譯"), ("b", 5, ["tgt"], "no"), ("b", 6, None, "no"), ("b", 7, ["src"], "")], "book_id string, pos int, classes array<string>, text string")
    assert [(r.book_id, r.texts) for r in rewrite.source_only_texts(nodes).collect()] == [("b", ["one", "two"])]
    n = dom.shred(spark.createDataFrame([(1, "<p>a</p><img src='x.png'><div><p>b <i>c</i></p></div>")], "id int, html string"), "id", "html")
    assert [r.text for r in dom.paragraphs(n).orderBy("block").collect()] == ["a", "b c"]
