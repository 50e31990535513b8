"""Main text of pages whose text is known."""

import html
import random
import time

from panelwright.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T, t</title><style>p{{color:red}}</style><script>var a = "</p><p>no, no, no</p>";</script></head><body class="page">
<header><a href="/">Site</a><p>Slogan, of the site, that is here</p></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more cookies, on this site.</div><div id="sidebar"><p>Side, bar, text, of, some, length here.</p></div>
{main}
<section id="comments"><div class="comment"><p>A reader, with a very long, very, very comma-rich comment, writes here, on and on.</p></div></section>
<form><label>Mail, please</label><input name=a><textarea>x</textarea></form><aside>Aside, with words</aside><footer>&copy; Footer, inc.</footer></body></html>"""


def test_articles_in_many_shapes():
    body = "<h1>Title &amp; more</h1><p>First  block,\n with <b>bold</b> &lt;text&gt; and <a href='x'>a link</a>.</p><!-- no --><p>Second&nbsp;block<br>goes on<p>Third, unclosed<ul><li>one<li>two</ul><pre>a  b</pre>"
    want = "Title & more\nFirst block, with bold <text> and a link.\nSecond block goes on\nThird, unclosed\none\ntwo\na b"
    for main in (f"<article>{body}</article>", f"<main><article>{body}</article></main>", f'<div class="post content">{body}</div>', f"<div><div><div>{body}</div></div></div>",
                 f'<article><header>{body.split("<p>")[0]}</header>{body[body.index("<p>"):]}<div class="ad">Buy, buy, now</div></article>'):
        assert main_text(PAGE.format(main=main)) == want, main


def test_sections_are_kept_together_in_page_order():
    parts = [f"<section><h2>Part {i}</h2><p>Text of part {i}, with commas, and words.</p></section>" for i in range(4)]
    want = "\n".join(f"Part {i}\nText of part {i}, with commas, and words." for i in range(4))
    assert main_text(PAGE.format(main="<article>" + "".join(parts) + "</article>")) == want
    assert main_text(PAGE.format(main="<div>" + "".join(parts) + "</div>")) == want


def test_short_empty_broken_and_deep_pages():
    assert main_text("") == "" and main_text("<html><body><nav>x</nav></body></html>") == ""
    assert main_text("plain words, &eacute;") == "plain words, é"
    assert main_text(PAGE.format(main="<article><p>Hi.</p></article>")) == "Hi."
    assert main_text(PAGE.format(main="<article></article>")) == ""
    assert main_text("<p>a < b and c<p>d</i></div>") == "a < b and c\nd"
    assert main_text("<div>" * 3000 + "<p>deep, text</p>") == "deep, text"
    assert main_text("<article><p>" + "long, " * 100_000 + "</p></article>").count("long,") == 100_000
    assert main_text("<article><p>end</p><script>never") == "end"


def test_letters_that_change_length_in_lower_case():
    page = PAGE.format(main="<article><h1>İstanbul</h1><p>İlk, uzun paragraf.</p><script>var İ = 1;</SCRIPT><p>Son, paragraf: İ.</p></article>").replace("T, t", "İİ, haber")
    assert main_text(page) == "İstanbul\nİlk, uzun paragraf.\nSon, paragraf: İ."
    assert main_text("<title>x</title><p>one, two</p><script>a</script><p>İ</p>") == "one, two\nİ"
    assert main_text("<article><p>one</p><script>'</\u017fcript>' hidden</script><p>two</p></article>") == "one\ntwo"


def test_names_made_of_titles_keep_their_text():
    body = """<h1>Title</h1><section id="side-effects"><h2>Side effects</h2><p>Nausea, mostly.</p></section><h2 id="related-work">Related work</h2><p>Others, too.</p>
<div id="alert-rules"><p>Rules, of alerts.</p></div><p id="ad-hoc-queries">Queries, ad hoc.</p><div class="alert"><p>Mind, the gap.</p></div><section id="market-share"><h3>Market share</h3><p>Half, or so.</p></section>"""
    want = "Title\nSide effects\nNausea, mostly.\nRelated work\nOthers, too.\nRules, of alerts.\nQueries, ad hoc.\nMind, the gap.\nMarket share\nHalf, or so."
    assert main_text(PAGE.format(main=f"<article>{body}</article>")) == want
    assert main_text(PAGE.format(main=f"<main>{body}</main>")) == want
    sections = "".join(f'<section id="{name}"><h2>Part</h2><p>Text, of {name}.</p></section>' for name in ("side-effects", "related-work", "notice-periods"))
    assert main_text(PAGE.format(main=f"<div>{sections}</div>")).count("Text, of") == 3
    assert main_text(PAGE.format(main=f'<div class="sidebar-layout-x has-ads"><div><p>{"Long, text. " * 40}</p></div></div>')).count("Long, text.") == 40
    assert main_text("<body class='side-effects'><article><p>One, two.</p></article>") == "One, two."


def test_words_that_keep_do_not_keep_comments_and_adverts():
    long = "A reader, with a long, long, comma-rich remark, goes on. " * 8
    for name in ("post-comments", "content-ad", "article-share", "post-comments-list", "entry__related", "reader-comments", "ad-slot"):
        for main in (f'<article><p>Text, of it.</p><div class="{name}"><p>{long}</p></div></article>', f'<article><p>Text, of it.</p></article><div class="{name}"><p>{long}</p></div>'):
            assert main_text(PAGE.format(main=main)) == "Text, of it.", main
    assert main_text(PAGE.format(main='<article><p>Text, of it.</p><section id="comments"><h2>Comments</h2><p>No, no.</p></section></article>')) == "Text, of it."


def test_whole_table(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choice(["the", "ça", "a & b", "x<y", "und,", "…"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        rows.append((i, f"http://x.org/{i}", PAGE.format(main="<article>" + "".join(f"<p>{html.escape(b)}</p>" for b in blocks) + "</article>"), "x", 1))
        want[i] = "\n".join(blocks)
    rows += [(None, None, None, None, None), (77, "u", "", "x", 1), rows[0]]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows) and all(r.text == want.get(r.page_id, "") and r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_one_long_and_short_parts_stay_whole():
    long = "".join(f"<p>Paragraph {i}, of the long part, with commas, and words.</p>" for i in range(30))
    parts = [f"<section><h2>Opening</h2><p>Short.</p></section>", f"<section><h2>Middle</h2>{long}</section>", "<section><p>The end.</p></section>"]
    for main in ("<article><h1>T</h1><div>{}</div></article>", "<main><div>{}</div></main>", "<div class='post'>{}</div>", "<div class='page'><div><article>{}</article></div></div>"):
        got = main_text(PAGE.format(main=main.format("".join(parts)))).split("\n")
        assert got[-34:][:2] == ["Opening", "Short."] and got[-1] == "The end." and len(got) == 34 + ("<h1>" in main)
    divided = "<article><div><p>One.</p></div><div>" + long + "</div><article><p>Quoted.</p></article><div><p>Last.</p></div></article>"
    assert main_text(PAGE.format(main=divided)).split("\n")[0] == "One." and main_text(PAGE.format(main=divided)).endswith("Quoted.\nLast.")


def test_quotes_count_behind_an_equals_sign():
    for tag in ("<p data-x=it's>", '<p title="5" screen">', "<p '>", '<p title = "a > b">', "<p a=\"it's\" b='\"'>", "<p a=''b=\"\">", '<p "a>', "<p/ a=x/>", "<p =x>"):
        assert main_text(f"<article>{tag}One, two.</p><p>Don't, \"really\".</p></article>") == "One, two.\nDon't, \"really\".", tag
    assert main_text('<article><p>One.</p><p title="open>Two.</p><p>Three.</p></article>') == "One.\nTwo.\nThree."
    assert main_text('<article><p>One.</p><p a="x"b=\'>Two.</p><p>Three.</p></article>') == "One.\nTwo.\nThree."
    assert main_text("<p>a</p><!--><p>b</p><!-- c --!><p>d</p><!-- e > f") == "a\nb\nd"
    assert main_text("<p>a</p>b <!-- c") == "a\nb"
    assert main_text("<article><p hidden>a</p><div style='display: none'><p>b</p></div><p>c</p></article><div hidden><p>d</p></div>") == "c"


def test_subjects_of_articles_stay_and_remarks_go():
    words = "Words, of the part, that go on. " * 20
    for name in ("market-share", "social", "guard-rail"):
        assert main_text(PAGE.format(main=f'<article><p>One.</p><section class="{name}"><p>{words}</p></section></article>')) == "One.\n" + words.strip(), name
    for name in ("market-share", "social", "main-menu"):
        assert main_text(PAGE.format(main=f'<article><p>One.</p><div class="{name}"><a href=x>{words}</a></div></article>')) == "One.", name
    for names in ('class="card comment"', 'id="c12" class="comment"', 'class="h-entry comment-item"', 'class="post-comment"'):
        assert main_text(PAGE.format(main=f"<article><p>One.</p><article {names}><p>{words}</p></article></article>")) == "One.", names
        assert main_text(PAGE.format(main=f"<article><p>One.</p></article><article {names}><p>{words}</p></article>")) == "One.", names
    for names in ('class="post category-comments"', 'class="post no-comments"', 'id="post-1" class="entry tag-share"'):
        assert main_text(PAGE.format(main=f"<article {names}><p>One, two.</p></article>")) == "One, two.", names


def test_open_tags_take_time_in_proportion():
    def seconds(page):
        begin = time.process_time()
        main_text(page)
        return time.process_time() - begin

    for piece in ("<p <", "<div>", "<p><b>", "<p><button><div>", "<div class='side-x'>", "<li><ul>", "<!", "<!--", "<a b='>\">", "<a b=", "</i>", "<td><p>", "<a b=\"", "<section id='ad-x'>"):
        assert seconds(piece * (250_000 // len(piece)) + ">") < 5, piece
    assert seconds("<p " + "a" * 250_000 + " " * 250_000 + ">") < 5
