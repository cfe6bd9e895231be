import io
import zipfile

from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import dom, gates, pairing, registers, rewrite, state
from quireflow.plans.spine import classified
from quireflow.sources import archive
from quireflow.streaming import chapters


def one(spark, column, **values):
    row = [tuple(values.values())]
    return spark.createDataFrame(row, list(values)).select(column).first()[0]


def test_paths(spark):
    cases = {"a/../b": "b", "../x": "../x", "": ".", "/a/../../b": "/b", "//h/x": "//h/x", "a//b/./c": "a/b/c", "..": "..", "a/..": "."}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", T.normpath(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == cases
    links = {"c2.xhtml#x": "OPS/t/c2.xhtml", "#x": None, "": None, "mailto:a@b": None, "../a%20b+c.html": "OPS/a b+c.html", "/abs": "/abs", "javascript:x": "OPS/t/javascript:x", "HTTP://x/y": None, "a?b=1": "OPS/t/a?b=1"}
    rows = spark.createDataFrame([(k,) for k in links], "h string").select("h", T.resolve_href(F.lit("OPS/t/c1.xhtml"), F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in rows} == links
    rel = lambda a, b: one(spark, T.relative_path(F.col("a"), F.col("b")), a=a, b=b)
    assert rel("OPS/t/c.x", "OPS") == "t/c.x" and rel("a/b", "c/d") == "../../a/b" and rel("x", "") == "x" and rel("a/b", "a/b") == "."
    assert one(spark, T.original_path(F.col("o"), F.col("s"), F.col("h"), F.col("i"), F.col("p")), o="", s="", h="chapters/x.html", i="item_1", p="OPS/c.opf") == "OPS/item_1.xhtml"


def test_text(spark):
    assert one(spark, T.clean(F.col("x")), x=" a \x1c b　") == "a b"
    long = "x" * 62 + "1" * 118
    assert one(spark, T.is_english(F.col("x")), x=long) and not one(spark, T.is_english(F.col("x")), x="x" * 61 + "1" * 119)
    assert one(spark, T.ensure_han(F.col("x"), F.col("s")), x="abc", s="plain words") == "譯文：abc"
    assert one(spark, T.ensure_han(F.col("x"), F.col("s")), x="abc", s="file_name.txt") == "abc"
    assert one(spark, T.target_classes(F.array(F.lit("src"), F.lit("lead"), F.lit("tgt")), F.lit(True)), x=1) == ["tgt", "tgt-zh", "lead", "unpaired"]
    assert one(spark, T.int_or_zero(F.col("x")), x="1x") == 0 and one(spark, T.safe_uid(F.col("x")), x="a-b..c") == "a_b_c"


def shredded(spark, html):
    return dom.shred(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")


def test_dom(spark):
    html = "<body><nav><p>menu</p></nav><h1>T</h1><blockquote><p>in</p> out</blockquote><p></p><li><p>x</p></li><div><img src='a/b.png' alt='A'>t<p>y <img src='z.png'></p></div><p><img src='c.jpg'></p><script>'<p>no</p>'</script></body>"
    n = shredded(spark, html).cache()
    assert [r.text for r in dom.text_nodes(n).orderBy("pre").collect()] == ["menu", "T", "in out", "x", "y"]
    got = [(r.type, r.text or r.src) for r in dom.blocks(n).orderBy("block").collect()]
    assert got == [("text", "T"), ("text", "in out"), ("text", "x"), ("image", "b.png"), ("text", "y"), ("image", "c.jpg")]
    assert {r.name for r in dom.images(n).collect()} == {"b.png", "z.png", "c.jpg"}
    assert shredded(spark, None).count() == 0
    body = "This paragraph is long enough to count as English content."
    n = shredded(spark, f"<p class='src'>{body}</p><p class='tgt'>譯文</p><p>{body}</p><div class='src'><p>{body}</p></div><p>有譯</p>")
    assert [r.pre for r in dom.uncovered(n).collect()] == [2]


def test_roles_and_chain(spark):
    names = [("nav", "nav.xhtml", "", "nav"), ("cover", "cover.xhtml", "", ""), ("tp", "title.xhtml", "", ""), ("x1", "a.xhtml", "Copyright © 2020", ""), ("x2", "b.xhtml", "To my mother", ""), ("toc", "toc.xhtml", "", ""), ("p1", "p1.xhtml", "PART I", ""), ("c1", "c1.xhtml", "One", ""), ("epi", "epilogue.xhtml", "", ""), ("n", "notes.xhtml", "", ""), ("promo", "promo.xhtml", "", ""), ("c2", "c2.xhtml", "Two", "")]
    rows = [("b", i + 1, *x, "text", 2400) for i, x in enumerate(names)]
    df = spark.createDataFrame(rows, "book_id string, pos int, idref string, href string, heading string, properties string, text string, char_count int")
    got = classified(df).orderBy("pos").collect()
    assert [r.role for r in got] == "nav cover title_page copyright dedication contents part_divider body epilogue notes promo body".split()
    assert [r.parent_id for r in got] == [None] * 7 + ["item_007"] * 3 + [None] * 2
    assert [r.translation_id for r in got if r.translation_id] == [f"ch_{i:02d}" for i in range(1, 7)]
    few = classified(df.withColumn("char_count", F.lit(0))).orderBy("pos").collect()
    assert [r.output_strategy for r in few] == "nav_generated source_only source_only source_only translate source_only source_only source_only translate source_only source_only source_only".split()


def test_pairs(spark):
    nodes = [("a", 1, "h1", "Introduction", "translate"), ("a", 2, "p", "one", "translate"), ("b", 1, "p", "one", "translate"), ("b", 2, "p", "file_one", "translate"), ("b", 3, "p", "three", "translate"), ("c", 1, "p", "Notes", "source_only"), ("d", 1, "h2", "My Title", "translate"), ("d", 2, "p", "x", "translate")]
    paras = [("a", 1, "一"), ("b", 1, "甲"), ("d", 1, "乙"), ("c", 1, "不用")]
    labels = spark.createDataFrame([("My Title", "題")], "text string, label string")
    got = pairing.pairs(spark.createDataFrame(nodes, "item string, n int, tag string, text string, strategy string"), spark.createDataFrame(paras, "item string, n int, text string"), labels)
    assert sorted((r.item, r.n, r.target, r.unpaired) for r in got.collect()) == [("a", 1, "導論", False), ("a", 2, "一", False), ("b", 1, "甲", False), ("b", 3, "譯文：", True), ("c", 1, "註釋", False), ("d", 1, "題", False), ("d", 2, "乙", False)]


def test_state(spark):
    log = [("b", "1", i, e, "譯" * 300, "err", "why") for i, e in enumerate(["failed", "failed"])] + [("b", "2", 0, "failed", "", "e1", ""), ("b", "2", 1, "done", "譯" * 300, "", ""), ("b", "2", 2, "failed", "", "e2", ""), ("b", "3", 0, "done", "譯" * 300, "", ""), ("b", "4", 0, "dropped", "", "", "why")]
    got = {r.chapter_id: r for r in state.fold(spark.createDataFrame(log, "book_id string, chapter_id string, seq int, event string, text string, error string, reason string")).collect()}
    assert [(got[c].status, got[c].retry_count, got[c].output_strategy) for c in "1234"] == [("failed", 2, None), ("failed", 1, "translate"), ("done", 0, "translate"), ("dropped", 0, "drop_explicit")]
    assert got["2"].error == "e2" and got["2"].carryover is None and len(got["3"].carryover) == 200 and len(got["3"].translation_hash) == 12 and got["4"].reason == "why"
    folded = spark.createDataFrame(list(got.values()))
    assert {r.chapter_id for r in state.to_run(folded).collect()} == {"2"} and state.invalid(folded).count() == 0


def test_gates(spark):
    pairs = [("b", "p", 1, "p", "s" * 100, "譯" * 25), ("b", "p", 2, "p", "s" * 100, "譯" * 21), ("b", "p", 3, "h1", "PART I", "PARTI"), ("b", "p", 4, "p", "text", None)]
    df = spark.createDataFrame(pairs, "book_id string, path string, seq int, tag string, text string, target string")
    assert sorted((r.seq, r.message[:9]) for r in gates.pair_failures(df).collect()) == [(2, "too short"), (3, "banned: P"), (4, "no target")]
    assert sorted(r.seq for r in gates.pair_failures(df, 0.3).collect()) == [1, 2, 3, 4]
    source = spark.createDataFrame([("b", 1, "i1", "t/a.x"), ("b", 2, "i2", "t/cover.x"), ("b", 3, "i3", "t/c.x")], "book_id string, src_pos int, src_idref string, src_href string")
    entries = spark.createDataFrame([("b", 1, "item_001", "i1", "t/a.x", "body", "translate", None), ("b", 2, "item_002", "zz", "cover.x", "cover", "source_only", None), ("b", 3, "item_003", "i3", "t/c.x", "promo", "drop_explicit", "ad")], "book_id string, pos int, id string, idref string, href string, role string, output_strategy string, reason string")
    out = spark.createDataFrame([("b", "i1"), ("b", "zz")], "book_id string, idref string")
    done = spark.createDataFrame([("b", "item_001")], "book_id string, id string")
    assert gates.structural_failures(source, entries, out, done).count() == 0
    lost = {r.message for r in gates.structural_failures(source, entries, out.where("idref = 'i1'"), done.limit(0)).collect()}
    assert lost == {"spine has 1 of 2", "not in the output: i2", "no translation: item_001", "cover lost"}
    assert [r.message for r in gates.preflight(entries, done, done).collect()] == ["no source page"]
    suite = gates.suite(entries, {a: gates.pair_failures(df) if a == "translation_quality" else gates.pair_failures(df).limit(0) for a in gates.AUDITS})
    assert {r.audit: r.status for r in suite.collect()} == {"structural": "pass", "bilingual_coverage": "pass", "translation_quality": "fail", "href_resolve": "pass"}
    assert gates.all_passed(suite).first().passed is False


def epub(**extra):
    files = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OPS/content.opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="c1" href="t/../c1.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="gone" href="gone.xhtml" media-type="application/xhtml+xml"/><item id="cov" href="i/cover.png" media-type="image/png" properties="cover-image"/></manifest><spine><itemref idref="nav"/><itemref idref="c1" linear="no"/><itemref idref="gone"/></spine></package>',
        "OPS/nav.xhtml": "<p>nav</p>", "OPS/c1.xhtml": "<body><header><h1>Head</h1></header><p class='lead'>Hello &amp; you</p></body>", "OPS/css/a.css": "x", "OPS/i/cover.png": "png",
    } | extra
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archive_round_trip(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    entries = archive.read_archives(spark, str(tmp_path)).cache()
    opened = archive.packages(entries).cache()
    assert {r.book_id for r in entries.collect()} == {"one"}
    assert archive.metadata(opened).first()[:] == ("one", "Book", ["A"], "und")
    docs = archive.content_documents(entries, opened).collect()
    assert [(d.pos, d.idref, d.linear, d.href) for d in docs] == [(2, "c1", "no", "OPS/c1.xhtml")]
    assert [d.pos for d in archive.content_documents(entries, opened, include_nav=True).orderBy("pos").collect()] == [1, 2]
    assert archive.cover(entries, opened).first().name == "OPS/i/cover.png"
    assert [r.name for r in archive.under(entries, "css").collect()] == ["OPS/css/a.css"] and archive.image_files(entries).first().name == "cover.png"
    pages = spark.createDataFrame([("c1", docs[0].content.decode(), "body", {})], "item string, html string, role string, labels map<string,string>")
    nodes = rewrite.nodes_to_pair(pages).withColumn("strategy", F.lit("translate"))
    pairs = pairing.pairs(nodes, spark.createDataFrame([("c1", 1, "頭"), ("c1", 2, "你好")], "item string, n int, text string"))
    html = rewrite.bilingual_pages(pages, pairs).first().html
    assert html == '<body><h1 class="src">Head</h1><p class="tgt tgt-zh">頭</p><p class="lead src">Hello &amp; you</p><p class="tgt tgt-zh lead">你好</p></body>'
    new = spark.createDataFrame([("one", "OPS/c1.xhtml", bytearray(html.encode()))], "book_id string, name string, content binary")
    made = archive.zipped(archive.overlay(entries, new)).first().content
    names = zipfile.ZipFile(io.BytesIO(made)).namelist()
    assert names[0] == "mimetype" and names[-1] == "OPS/c1.xhtml" and len(names) == 7


def test_contents_and_packages(spark):
    page = spark.createDataFrame([("t", "<a href='x'>Cover</a><a>Other</a>", "contents", pairing.CONTENTS)], "item string, html string, role string, labels map<string,string>")
    none = spark.createDataFrame([], "item string, n int, target string, unpaired boolean")
    assert rewrite.bilingual_pages(page, none).first().html == '<a href="x">Cover ｜ 封面</a><a>Other</a>'
    ncx = "<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src='t/a%20b.x'/></navPoint><navPoint><content src='t/a%20b.x#f'/></navPoint></navMap></ncx>"
    got = rewrite.patched_ncx(spark.createDataFrame([("b", ncx)], "book_id string, xml string"), spark.createDataFrame([("b", "q/a b.x", "一")], "book_id string, path string, label string")).first().xml
    assert got.count("一") == 1 and "One" not in got
    opf = rewrite.minimal_package(spark.createDataFrame([("b", 2, "c2", "OPS/t/c2.xhtml"), ("b", 1, "c1", "OPS/t/c1.xhtml")], "book_id string, pos int, idref string, path string"), spark.createDataFrame([("b", "OPS/i/x.png")], "book_id string, path string"), spark.createDataFrame([("b", "T & U", "OPS")], "book_id string, title string, root string")).first().opf
    assert opf.index('href="t/c1.xhtml"') < opf.index('href="t/c2.xhtml"') < opf.index('href="i/x.png" media-type="image/png"') and "T &amp; U" in opf
    e = spark.createDataFrame([("b", 1, "p", None, "part_divider", "source_only", "PART I", "p.x", "PART I ｜ 第一部"), ("b", 2, "c", "p", "body", "translate", "One", "c.x", "One")], "book_id string, pos int, id string, parent_id string, role string, output_strategy string, first_heading string, path string, shown string")
    nav = pairing.nav_document(e, spark.createDataFrame([("b", "T")], "book_id string, title string")).first().xhtml
    assert '<li><a href="p.x">PART I ｜ 第一部</a><ol><li><a href="c.x">One</a></li></ol></li>' in nav
    kept = pairing.merged_overrides(spark.createDataFrame([("b", "One", "一")], "book_id string, source string, target string"), e.withColumn("idref", F.col("id")), spark.createDataFrame([("b", "c", "舊"), ("b", "z", "留")], "book_id string, key string, value string"))
    assert {r.key: r.value for r in kept.collect()} == {"c": "舊", "z": "留"}
    listed = spark.createDataFrame([("b", '["x", {"src_text": "y"}, 3]'), ("c", "{bad")], "book_id string, json string")
    assert {(r.book_id, r.text) for r in rewrite.listed_exceptions(listed).collect()} == {("b", "x"), ("b", "y")}


def test_registers_and_prompts(spark):
    text = '```json\n{"characters": {" A ": "甲"}, "places": {}, "terms": {}, "style_anchor": {"register": "plain", "avoid": [], "prefer": []}}\n```'
    assert one(spark, F.map_entries(registers.trimmed(registers.glossary(F.col("x"))["characters"])), x=text)[0].asDict() == {"key": "A", "value": "甲"}
    assert one(spark, registers.glossary(F.col("x")), x='{"characters": {}}') is None
    rules = F.array(F.lit("a"), F.lit("b"))
    p = one(spark, registers.prompt(F.lit("1"), F.lit("T"), F.lit("日本語"), F.lit("{}"), F.lit(""), F.lit(""), F.lit("text"), F.lit(3), rules, F.lit(None).cast("string")), x=1)
    assert "  5. a\n  6. b" in p and "  7. No other" in p and "  8. The translation must have 3" in p and "(first chapter)" in p


def test_stream(spark, tmp_path):
    log = spark.sql("select 'b' as book_id, cast(id % 3 as string) as chapter_id, id as seq, if(id % 2 = 0, 'failed', 'done') as event, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as ts from range(30)")
    log.write.parquet(str(tmp_path / "in"))
    q = chapters.running_status(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r.chapter_id: (r.status, r.n_failed) for r in spark.table("running").collect()} == {"0": ("done", 5), "1": ("failed", 5), "2": ("done", 5)}
