import html as escapes
import re

import duckdb
import pytest

from freshet.llm import html_blocks as hb
from tests.llm.helpers import LONG

GOOD = "The house of the man is on the hill and it was built by the people that live in the valley for the king of the land, as this is what they said to the world at the time of the war."
CASES = {
    "": "",
    "<": "<",
    "a < b &amp; c": "a < b & c",
    "<p>x<p>y": "x\ny",
    "<!-- hidden --><p>shown": "shown",
    "<script>if (a < b) { '</p>' }</script><style>p{}</style><p>shown</p>": "shown",
    f"<article><h1>Head &eacute;</h1><p>{GOOD}</p><p>Brief.</p></article><footer>of the end</footer>": f"Head é\n{GOOD}\nBrief.",
    f"<main><p>{GOOD}</p><div class='comments'><p>{GOOD} too</p></div><p>End.</p></main>": f"{GOOD}\nEnd.",
    f"<body><div id=menu><a href=1>Home</a></div><h2>Head</h2><p>{GOOD}</p><p>Short one.</p><p>{GOOD}</p><p>&copy; 2020</p>": f"Head\n{GOOD}\nShort one.\n{GOOD}",
    f"<article><p>{GOOD}</p><p><a href=1>all</a> <a href=2>of this is</a> <a href=3>links and the</a></p></article>": GOOD,
    f"<article><p>a  b\n\tc&nbsp;d <b>e</b>f<br>g</p><form>Name<input></form><aside>{GOOD}</aside></article>": "a b c d ef\ng",
    f"<article><header><h1>T</h1></header><div class='ad-box'>{GOOD}</div><p>{GOOD}</p></article>": f"T\n{GOOD}",
    f"<div class=cookie-notice>{GOOD}</div><article><p>text</p></article><nav><ul><li>x</ul></nav>": "text",
    f"<body class='nav-open has-sidebar'><article class=post><div class='entry-header'><h1>T</h1></div><p>{GOOD}</p><div class='alert'>x</div></article>": f"T\n{GOOD}",
    f"<div class='page-header'><h1>Site</h1></div><div class='layout with-sidebar'><p>{GOOD}</p><p>{GOOD}</p></div>": f"{GOOD}\n{GOOD}",
    "<article><p>un<i>closed <b>marks</p><p>next</article>": "unclosed marks\nnext",
}


@pytest.mark.parametrize("page", list(CASES))
def test_cases(page):
    assert hb.main_text(page) == CASES[page]


CARDS = "<article class=card><a href=1><h3>Blue shoes</h3></a><p>On sale now.</p></article><article class=card><h3>Red hat</h3><p>Ten left.</p></article>"


def test_text_in_a_div_beside_article_cards():
    text = f"<div id=story><h1>Head</h1><p>{GOOD}</p><p>Brief.</p><p>{GOOD} Again.</p></div>"
    expected = f"Head\n{GOOD}\nBrief.\n{GOOD} Again."
    assert hb.main_text(f"<body>{text}{CARDS}</body>") == expected
    assert hb.main_text(f"<body>{CARDS}{text}</body>") == expected
    # a second, small article does not take the place of the text either
    assert hb.main_text(f"<body>{text}<article><p>{GOOD} Too.</p></article></body>") == f"{expected}\n{GOOD} Too."


OTHERS = {
    "Dutch": "Het gemeentebestuur heeft gisteren besloten dat er komend voorjaar een nieuwe brug over het kanaal wordt gebouwd, zodat fietsers niet langer hoeven om te rijden wanneer ze naar het station gaan.",
    "Polish": "Rada miasta postanowiła wczoraj, że wiosną przyszłego roku nad kanałem powstanie nowy most, dzięki któremu rowerzyści nie będą już musieli nadkładać drogi, kiedy jadą na dworzec kolejowy.",
    "Russian": "Городской совет вчера решил, что весной будущего года через канал построят новый мост, чтобы велосипедистам больше не приходилось ехать в объезд, когда они направляются к вокзалу.",
    "Turkish": "Belediye meclisi dün, bisikletlilerin istasyona giderken artık yolu uzatmak zorunda kalmaması için önümüzdeki baharda kanalın üzerine yeni bir köprü yapılmasına karar verdi.",
    "Chinese": "市议会昨天决定明年春天在运河上修建一座新桥,这样骑自行车的人去火车站时就不必再绕远路了。工程预计持续六个月,费用由市政府和铁路公司共同承担。",
    "Thai": "สภาเมืองมีมติเมื่อวานนี้ให้สร้างสะพานใหม่ข้ามคลองในฤดูใบไม้ผลิหน้าเพื่อให้ผู้ขี่จักรยานไม่ต้องอ้อมไกลเมื่อเดินทางไปสถานีรถไฟ",
}


@pytest.mark.parametrize("name", list(OTHERS))
def test_languages_without_stop_words(name):
    text, links = OTHERS[name], "".join(f"<a href={i}>{OTHERS[name][:40]}</a> " for i in range(5))
    page = f"<div id=top>{links}</div><div id=story><h1>1 2 3</h1><p>{text}</p><p>{text} {text}</p><p>4 5</p><p>{text}</p></div>"
    assert hb.main_text(page) == f"1 2 3\n{text}\n{text} {text}\n4 5\n{text}"
    # a short notice in a listed language does not make it known
    assert f"{text} {text}" in hb.main_text(page.replace("<p>4 5</p>", f"<p>{text * 8}</p><p>{GOOD}</p>"))


def test_listed_languages_are_judged_by_stop_words():
    assert hb.main_text(f"<p>{GOOD}</p><p>{'xyz ' * 50}</p><p>{GOOD} {GOOD}</p><p>{'link ' * 50}</p>") == f"{GOOD}\n{GOOD} {GOOD}"


def test_passes():
    blocks = hb.blocks_of(f"<p>{GOOD}</p><p>tiny</p><p>{GOOD} {GOOD}</p><p>{'link ' * 50}</p><p>tiny</p><p>{'xyz ' * 50}</p>")
    for b in blocks:
        b.label = hb.first_pass(b, False)
    assert [b.label for b in blocks] == ["near", "short", "good", "bad", "short", "bad"]
    hb.second_pass(blocks)
    assert [b.label for b in blocks] == ["good", "good", "good", "bad", "bad", "bad"]


def test_given_pages(spark, sf):
    """In the given pages the article is what stands in the article element; a plain reading of it is the measure."""
    rows = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    found = {r["page_id"]: r for r in hb.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for page, text in rows:
        article = re.search(r"(?s)<article>(.*?)</article>", text).group(1)
        parts = (" ".join(escapes.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", article))
        assert found[page]["text"] == "\n".join(x for x in parts if x)
        assert found[page]["n_chars"] == len(found[page]["text"])


def test_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, None, 1), (1, None, None, 1), (None, "u", "", 1), (3, "u", f"<article>{LONG}</article>", 1)], "page_id long, url string, html string, text int"
    )
    found = sorted(((r[0] or 0, r[1], r[2], r[3]) for r in hb.extract(rows).collect()), key=str)
    assert found == sorted([(1, None, "", 0), (1, None, "", 0), (0, "u", "", 0), (3, "u", LONG, len(LONG))], key=str)
    assert hb.extract(rows.limit(0)).count() == 0


FIVE = [f"{GOOD} Part {i} of the story is told in this place." for i in range(5)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in FIVE)
LAYOUTS = {
    "a form around the page": f"<body><form id=aspnetForm><div class=menu><a href=1>Home</a></div>{PARAGRAPHS}</form></body>",
    "a builder's widgets": "<body>" + "".join(f"<div class='elementor-widget elementor-text'><p>{x}</p></div>" for x in FIVE) + "<div class=comments><p>I liked it a lot.</p></div></body>",
    "a class of the columns": f"<body><div class='layout-sidebar-right'>{PARAGRAPHS}</div><footer>of the end</footer></body>",
    "a section of an article": f"<article><section id='notice-of-results'>{PARAGRAPHS}</section></article>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_marks_of_layout_are_void(name):
    assert hb.main_text(LAYOUTS[name]) == "\n".join(FIVE)


def test_other_marks_hold():
    """Beside good text, and for what is never an article's own, marks keep their meaning."""
    page = f"<body>{PARAGRAPHS}<div class=sidebar>{PARAGRAPHS}</div><form>{PARAGRAPHS}</form></body>"
    assert hb.main_text(page) == "\n".join(FIVE)
    for mark in ("comments", "nav", "advert", "cookie-notice"):
        assert hb.main_text(f"<body><p>Short text.</p><div class={mark}>{PARAGRAPHS}</div></body>") == "Short text."


def test_broken_pages_are_read_in_linear_time():
    import time

    pages = ["<a " * 350_000, '<a "' * 250_000, "<a b='c>" * 130_000, "<b>" * 330_000, "<p><b>" * 160_000, "<div>" * 100_000 + "</i>" * 120_000, "<b>" * 100_000 + "<div>" * 60_000 + "</b>" * 100_000,
             "<![CDATA[" * 110_000, "<!-- " * 200_000, "<a href=1>" * 100_000 + "</div>" * 50_000, "<" * 1_000_000, '<p title="x' * 90_000]
    for page in pages:
        began = time.time()
        hb.main_text(page)
        assert time.time() - began < 6, page[:30]


def plain_labels(blocks):
    """Both passes by the rules' wording, each block looking through all others."""
    known = hb.knows_language(blocks)
    labels = []
    for b in blocks:
        letters = len(b.text) if known else hb._letters(b.text)
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stops = sum(w in hb.STOP_WORDS for w in words) / len(words) if words else 0
        rights = not b.main and len(b.text) < 200 and hb._RIGHTS.search(b.text)
        if b.link_chars > 0.4 * len(b.text) or rights:
            labels.append("bad")
            continue
        long = "good" if letters > 200 else "near"
        label = "short" if letters < 70 else long if not known or stops >= 0.3 else "near" if stops >= 0.15 else "bad"
        labels.append({"bad": "near", "near": "good"}.get(label, label) if b.main else label)

    def beside(labels, i, step, keep=lambda j: True):
        j = i + step
        while 0 <= j < len(labels):
            if keep(j) and labels[j] in ("good", "bad"):
                return labels[j]
            j += step
        return ""

    labels = [("bad" if (beside(labels, i, -1), beside(labels, i, 1)) == ("bad", "bad") else "good") if x == "near" else x for i, x in enumerate(labels)]
    if "good" not in labels:
        labels = ["good" if x == "short" else x for x in labels]
    out = []
    for i, x in enumerate(labels):
        if x == "short":
            same = lambda j, i=i: blocks[j].main == blocks[i].main
            around = [beside(labels, i, -1, same), beside(labels, i, 1, same)]
            known_around = {a for a in around if a}
            x = known_around.pop() if len(known_around) == 1 else "good" if known_around and (blocks[i].main or blocks[i].heading and around[1] == "good") else "bad"
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_both_passes_against_plain_rules(seed):
    import random

    pick = random.Random(seed)
    texts = [GOOD, GOOD[:90] + ".", "Short line", "Prices colours sizes weights makers numbers streets towns rivers lakes hills roads cars", "© 2020 us", "Head", "of the and to a in is that"]
    for _ in range(40):
        blocks = []
        for _ in range(pick.randint(0, 12)):
            b = hb.Block("", pick.random() < 0.4, pick.random() < 0.2)
            b.text = pick.choice(texts)
            b.link_chars = pick.choice([0, 0, 0, len(b.text), len(b.text) // 3])
            blocks.append(b)
        expected, known = plain_labels(blocks), hb.knows_language(blocks)
        for b in blocks:
            b.label = hb.first_pass(b, b.main, known)
        hb.second_pass(blocks)
        assert [b.label for b in blocks] == expected
