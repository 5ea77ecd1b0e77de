"""Character references in the plain text of op10_warc, against Python's own table."""

import html
import html.entities

from tierspark.llm import warc


def texts(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [r.t for r in warc.with_text(rows, "html", "t").orderBy("page_id").collect()]


def test_every_named_reference(spark):
    names = [n for n in html.entities.html5 if not html.unescape(f"&{n}").isspace()]
    assert texts(spark, [f"<p>a&{n}b</p>" for n in names]) == [html.unescape(f"a&{n}b") for n in names]


def test_numbers_and_one_pass(spark):
    pages = ["&#8217;&#xE9;&#XE9;&eacute;&copy;&middot;", "&amp;copy; &amp;#39; &amp;amp;lt;", "a&nbsp;&#160;b", "&#0;&#xD800;&#39;", "&lt;b&gt;", None]
    assert texts(spark, pages) == ["’ééé©·", "&copy; &#39; &amp;lt;", "a b", "��'", "<b>", None]


def test_sql_resolves_what_python_does(spark, tmp_path):
    """The SQL that op10 is compared with, over every name, with and without its semicolon, and odd numbers."""
    import duckdb

    from tierspark.llm.oracles import ORACLES

    numbers = [0, 1, 9, 13, 38, 60, 127, 128, 150, 159, 160, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]
    forms = [f"a&{n}b &{n.rstrip(';')}x" for n in html.entities.html5]
    forms += [f"[&#{n};&#x{n:x};&#X{n:X} &#00{n}z]" for n in numbers]
    forms += ["&amp;copy; &amp;#39;", "&", "&&amp", "&notit; &nosuchname; &#; &#x; &#xg", "<p>a</p>&lt;b&gt;", "", None]
    pages = spark.createDataFrame([(i, "http://x/", f) for i, f in enumerate(forms)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    cursor = con.execute(ORACLES["op10_warc"])
    names = [d[0] for d in cursor.description]
    want = {(r["page_id"], r["record_type"]): r for r in (dict(zip(names, row)) for row in cursor.fetchall())}
    found = {(r.page_id, r.record_type): r.asDict() for r in warc.derivatives(warc.responses(pages)).collect()}
    assert len(found) == 2 * len(forms) and found == want
