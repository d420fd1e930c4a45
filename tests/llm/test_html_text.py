import re

from marginkit.llm.html_text import extract_text, render


def test_blocks_lists_tables_and_visibility():
    page = ('<title>x</title><h1>Head</h1>para one<p>a  b\n c<p>d<br>e<ul><li>one<li>two <ol start=3><li>x<li>y</ol><li>three</ul>'
            '<table><caption>Cap</caption><tr><th>Name<th>Age<tr><td>Al<td>3<tr><td>Barbara<br>Ann<td>42</table><pre>  a\n   b</pre>'
            '<div hidden>no</div><span style="display: none">no</span>after &amp; &lt;x&gt; 3 < 4<script>var t="</p>";</script>z'
            '<blockquote>q1<p>q2</blockquote><details><summary>S</summary>hid</details>')
    assert render(page) == "\n".join([
        "Head", "", "para one", "", "a b c", "", "d", "e", "", "- one", "- two", "  3. x", "  4. y", "- three", "", "Cap",
        "Name     Age", "Al       3", "Barbara  42", "Ann", "", "  a", "   b", "", "after & <x> 3 < 4z", "", "  q1", "", "  q2", "", "S"])


def test_implied_tags():
    assert render("<p>a<div>b</div>c") == "a\n\nb\nc"
    assert render("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"
    assert render("<table><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert render("<head><meta x><p>body text") == "body text"
    assert render("<select><option>a<option>b</select>") == "a\nb"
    assert render("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>") == "in  ner  out"
    assert render("</div></p>x</b>") == "x"
    assert render('<div style="visibility:hidden">a<b style="visibility:visible">c</b></div>') == "c"


def test_edge_cases():
    assert render(None) is None and render("") == "" and render("   \n ") == ""
    assert render("<!-- a <p>b") == "" and render("a<b c='") == "a" and render("a <") == "a <"
    assert render("<script>x") == "" and render("<textarea> k\n l</textarea>") == " k\n l"
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert render(deep) == "x"
    assert render("<li>" * 3 + "x").endswith("- x")
    wide = "<table>" + "".join(f"<tr><td>{'w' * (500 if i == 3 else 2)}<td>b" for i in range(200)) + "</table>"
    assert len(render(wide)) < 3 * len(wide)
    assert render("<table><tr><td colspan=999999999>a<td>b</table>") == "a  b"
    assert render("<td>" * 100 + "x") is not None


def test_stray_quotes_and_empty_comments():
    assert render('<a href="x"">text</a> more <b>and</b> "on"') == 'text more and "on"'
    assert render("<p title=John's>one <i>two</i><p>it's three") == "one two\n\nit's three"
    assert render('<table><tr><td width=5">a<td title="b>c">d</table>e') == "a  d\n\ne"
    assert render("a<!-->b<!--->c<!-- x > -->d<!---->e<!-- y --!>f") == "abcdef"
    assert render("<a b='x>y' c = \"p>q\" d=e\"f =g\">t") == "t" and render('<a "b>c') == "c" and render("<a =\"x>t") == "t"
    assert render("<br/><img alt='>'/>x<div/hidden>no</div>y<p hidden=\">z") == "xy"
    assert render('<p style="display:none"">no</p>yes') == "yes"
    assert render("<p " + "a=\"b\" c' " * 50_000 + ">x") == "x"


def test_all_visible_words_of_the_pages_survive(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html)
        want = re.findall(r"\w+", __import__("html").unescape(re.sub(r"<[^>]*>", " ", body)))
        assert [w for w in re.findall(r"\w+", out[r.page_id])] == want


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "<p>x", None)], "page_id long, html string, _row string")
    out = extract_text(df)
    assert out.columns == ["page_id", "_row", "text"] and sorted(map(tuple, out.collect())) == [(1, "a", None), (2, None, "x")]
    assert extract_text(df.limit(0)).count() == 0
