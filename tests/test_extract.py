from corpusmill.operators.extract import best_run, extract_page, prepare

BODY = "<p>" + "A paragraph of real prose that is long enough to count as text. " * 3 + "</p>"


def test_main_text_and_title():
    page = f"<html><head><title>Fish &amp; ships</title><style>p{{}}</style></head><body><nav><a href='/'>Home page of the site</a></nav><h1>Fish</h1>{BODY}{BODY}<footer>All the rights in this world</footer><script>var x = '<p>no</p>'</script></body></html>"
    text, title = extract_page(page)
    assert title == "Fish & ships" and text.startswith("Fish\n\nA paragraph") and "Home" not in text and "rights" not in text and "var x" not in text


def test_links_lose_to_prose():
    links = "".join(f"<li><a href='/{k}'>A link with quite a long text number {k}</a></li>" for k in range(20))
    text, _ = extract_page(f"<ul>{links}</ul>{BODY}<ul>{links}</ul>")
    assert text.startswith("A paragraph") and "link" not in text


def test_fragmented_body_survives_a_long_sidebar():
    parts = "".join(f"<p>Short paragraph {k} with <a href='#'>one link</a> inside it here.</p>" for k in range(6))
    text, _ = extract_page(f"<div>{parts}</div>")
    assert text.count("Short paragraph") == 6


def test_degenerate_pages():
    assert extract_page("") == extract_page(None) == extract_page("  \n") == ("", None)
    assert extract_page("<title>Only a title</title>") == ("", "Only a title")
    assert extract_page("<p>unclosed <b>tags are fine in here, really") == ("unclosed tags are fine in here, really", None)
    assert extract_page("<title> </title><p>x</p>") == ("", None)
    assert extract_page(f"{BODY}<embed>{BODY}")[0].count("real prose") == 3  # embed has no end


def test_short_blocks_and_words_across_tags():
    assert extract_page("<p>tiny</p>", min_block_chars=3)[0] == "tiny"
    assert extract_page("<p><b>Words</b> <i>do not</i> fuse across tags at all</p>")[0] == "Words do not fuse across tags at all"


def test_best_run():
    assert best_run([0.0, 10.0, 10.0, 0.0]) == (1, 3)
    assert best_run([1.0]) == (0, 1)


def test_prepare(spark):
    rows = [(1, "given", "<p>" + "html text " * 9 + "</p>", None), (2, None, f"<title>T</title>{BODY}", None), (3, "", f"<title>T</title>{BODY}", "Own"), (4, " ", BODY, None), (5, None, None, None)]
    got = {r.k: (r.text, r.title) for r in prepare(spark.createDataFrame(rows, "k int, text string, html string, title string")).collect()}
    assert got[1] == ("given", None) and got[2][1] == "T" and got[2][0].startswith("A paragraph") and got[3][1] == "Own"
    assert got[4] == ("", None) and got[5] == ("", None)
