import html
import re

from quillet.llm.html_extract import extract, main_text

LONG = "The man was of the view that it is in the nature of a river to be on its way to the sea. " * 4


def test_boilerplate_goes_and_short_blocks_inherit():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=x>Home</a></li><li><a href=y>About the site</a></li></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div class=sidebar><p>Short note.</p><p>{LONG}</p></div>
    <div id=content><h1>A &amp; B</h1><p>Hi.</p><p>{LONG}<p>Caf&eacute;   &#8212; <b>bold</b>
    text.<br>Next</p></div><form><p>{LONG}</p></form><div id="comments"><p>{LONG}</p></div><footer>&copy; x</footer>"""
    assert main_text(page) == "\n\n".join(["A & B", "Hi.", LONG.strip(), "Café — bold text. Next"])


def test_odd_inputs():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x") == ""
    assert main_text("<article><p>One.<p>Two.") == "One.\n\nTwo."
    assert main_text("<p>" + "the of and " * 100_000 + "</p>").startswith("the of")


def test_whole_table_against_the_article_element(spark):
    from quillet.session import table

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = extract(pages.withColumn("text", pages["url"])).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", source[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_null_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()) == [(0, "", 0), (1, "", 0)]
    assert extract(df.limit(0)).collect() == []


PROSE = "One two of the and that is in a sentence with the words of it. " * 4


def test_frames_negations_and_broken_markup():
    from quillet.llm.html_extract import main_text

    whole = PROSE.strip()
    for page in ('<div class="site no-sidebar"><p>%s</p></div>', '<div class="nav-open"><p>%s</p></div>', "<form><p>%s</p></form>", "<p title=it's>%s</p>", "<article><p>%s</p></article>"):
        assert main_text(page.replace("%s", PROSE)) == whole, page
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div><p>{PROSE}</p></article>') == "Title\n\n" + whole
    assert main_text(f"<article><p>© {PROSE}</p></article>") == "© " + whole
    assert main_text(f"<article><p>{PROSE}</p><p><a href=x>a paragraph that is a link</a></p></article>").endswith("a paragraph that is a link")
    assert main_text(f'<p>{PROSE}</p><form><p>{PROSE[:80]}</p></form><div class="sidebar"><p>{PROSE}</p></div><div id=comments><p>{PROSE * 9}</p></div>') == whole


def test_languages_without_a_list():
    from quillet.llm.html_extract import main_text

    for text in ("これは日本語の文章です。" * 20, ("Zażółć gęślą jaźń oraz wiele innych słów które nie są znane tutaj wcale. " * 4).strip()):
        assert main_text(f"<nav><a href=x>{text[:20]}</a></nav><p>{text}</p><p><a href=y>{text}</a></p>") == text


def test_a_hundred_thousand_unclosed_tags():
    import time

    from quillet.llm.html_extract import main_text

    for part in ("<div>x ", "<svg> ", '<p title="a ', "<span class=ad>y ", "<![CDATA[ ", "<!-- ", "< "):
        began = time.process_time()
        main_text(part * 100_000)
        assert time.process_time() - began < 30, part
