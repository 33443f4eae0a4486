"""Main text of pages whose markup misleads, and of hostile ones."""

import time

import pytest

from millrace.llm import pages

P1 = "The river rose slowly during the night and nobody in the village took notice of it at all."
P2 = "By the morning two bridges were gone, and the road to the north lay under a metre of water."
P3 = "Help arrived late in the afternoon, when the rain had stopped and the sky was clear again."
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1}\n{P2}\n{P3}"
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport and weather</a></li></ul>"

PAGES = {
    "plain div": (f"<body><div>{MENU}</div><div>{BODY}</div><div><a href=/x>Imprint</a> <a href=/y>Contact</a></div>", TEXT),
    "wrapper named after its sidebar": (f"<body><div class='page has-sidebar'><article>{BODY}</article></div>", TEXT),
    "post named after what it lacks": (f"<body><div class='post related-none'><h1>Flood</h1>{BODY}</div>", f"Flood\n{TEXT}"),
    "wrapper with an unlucky id": (f"<body><div id='overlay'><div>{BODY}</div></div><div>{MENU}</div>", TEXT),
    "inline element with a listed word": ("<body><article><p>We use <span class='social'>networks</span> every day, more than ever before.</p></article>", "We use networks every day, more than ever before."),
    "links inside the article": (f"<body><article>{BODY}<ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul></article>", f"{TEXT}\nFirst source\nSecond source"),
    "own header": (f"<body><header><h1>The Daily</h1></header><div class=post><header><h1>Flood</h1></header>{BODY}</div>", f"Flood\n{TEXT}"),
    "comments": (f"<body><div class=story>{BODY}</div><div class=comments><p>I don't believe a word of this, it is made up from start to end.</p></div>", TEXT),
    "comments within the article": (f"<body><article>{BODY}<section id=comments><p>First! And I was there too, it was just like that.</p></section></article>", TEXT),
    "comments that are articles": (f"<body><article><h1>Flood</h1>{BODY}</article><section class=comments><article class=comment><p>No.</p></article></section>", f"Flood\n{TEXT}"),
    "advert between paragraphs": (f"<body><main><p>{P1}</p><div class='ad box'><p>Buy now, cheap boots!</p></div><p>{P2}</p></main>", f"{P1}\n{P2}"),
    "two candidates": (f"<body><div id=a><p>Short teaser.</p></div><div id=b>{BODY}</div><div id=c><p>Another teaser, not long.</p></div>", TEXT),
    "sidebar of texts": (f"<body><table><tr><td class=sidebar><p>About us. We are a paper.</p></td><td><div>{BODY}</div></td></tr></table>", TEXT),
    "newsletter form": (f"<body><div><form><p>Your address please</p></form>{BODY}</div>", TEXT),
    "cookie notice": (f"<body><div class='cookie-consent'><p>We value your privacy and use cookies.</p></div><div>{BODY}</div>", TEXT),
    "hidden": (f"<body><div style='display:none'><p>{P3} {P3}</p></div><div>{BODY}</div>", TEXT),
    "unclosed paragraphs": (f"<body><div>{MENU}</div><div><p>{P1}<p>{P2}<p>{P3}</div>", TEXT),
    "stray quote": (f"<body><div title='it's\">{BODY}</div>", TEXT),
    "references": ("<body><article><p>Caf&eacute; &amp; bar&nbsp;&#8211; caf&#233;</p></article>", "Café & bar – café"),
    "comparison signs": ("<body><article><p>1 < 2 and 3 > 2, as all of us know quite well.</p></article>", "1 < 2 and 3 > 2, as all of us know quite well."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    page, text = PAGES[name]
    assert pages.main_text(page) == text


def test_density_decides(monkeypatch):
    """With all densities equal some of the pages above must go wrong."""
    whole = pages.measure

    def flattened(root):
        nodes = whole(root)
        for node in nodes:
            node.density = 1.0
        for node in nodes:
            node.total = sum(1.0 for c in node.children if isinstance(c, pages.Node) and c.tag in pages.BLOCK)
        return nodes

    monkeypatch.setattr(pages, "measure", flattened)
    assert sum(pages.main_text(page) != text for page, text in PAGES.values()) >= 2


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<i>", "<i></b>", "<b><div><i></b>", '<a x=">" ', "<![CDATA[>", "<!x", "<p><i>", "<body>", "</p>", "<li><ul></li>", "<td><div></tr>", "<a title=\"'\">", "&amp", "<!--", "<div>"],
)
def test_time_grows_with_length(unit):
    page = unit * ((5 << 20) // len(unit)) if unit == "<a " else unit * ((1 << 20) // len(unit))
    begin = time.time()
    pages.main_text(page + '"')
    assert time.time() - begin < 20
