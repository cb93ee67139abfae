"""Pages without article or main: no content line is lost."""

import pytest

from driftline.llm.html_text import content_lines, main_text, page_lines


def words(tag, n):
    return " ".join(f"{tag}{i:03}" for i in range(n // (len(tag) + 4) + 1))


LIST = (
    f"<html><body><nav><a>home</a></nav><div><h1>The heading</h1><p>{words('first', 200)}</p><ul>"
    + "".join(f"<li>{words(f'item{k}', 300)}</li>" for k in range(4)) + f"</ul><p>{words('last', 200)}</p></div></body></html>"
)
SIBLINGS = (
    "<html><body><div>" + "".join(f"<p>{words(f'big{k}', 300)}</p>" for k in range(6)) + "</div><div>"
    + "".join(f"<p>{words(f'small{k}', 300)}</p>" for k in range(2)) + "</div></body></html>"
)


@pytest.mark.parametrize("page", [LIST, SIBLINGS], ids=["list", "siblings"])
def test_no_content_line_is_lost(page):
    lines = page_lines(page)
    text = main_text(page)
    marked = [line.text for line, content in zip(lines, content_lines(lines)) if content and not line.element.silent]
    assert marked and all(t in text for t in marked)
    assert text == " ".join(line.text for line in lines if not line.element.silent)


MENU = "<div><ul>" + "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(30)) + "</ul></div>"
ADVERT = "<div><img src='x.png'><p><a href='/buy'>Buy now and save</a></p></div>"
PROSE = [words(t, 400) for t in ("one", "two", "three", "four")]
P = "".join(f"<p>{w}</p>" for w in PROSE[:2]), "".join(f"<p>{w}</p>" for w in PROSE[2:])
#: Pages whose menus, adverts and teasers have no name that says so: html and wanted text.
UNNAMED = {
    "menu_beside_prose": (f"<body>{MENU}<div><h1>The heading</h1>{P[0]}<p>Short.</p>{P[1]}</div></body>", ["The heading", *PROSE[:2], "Short.", *PROSE[2:]]),
    "menu_after_prose": (f"<body><div>{P[0]}{P[1]}</div>{MENU}</body>", PROSE),
    "menu_in_article": (f"<body><article>{P[0]}{MENU}{P[1]}</article></body>", PROSE),
    "advert_in_article": (f"<body><article>{P[0]}{ADVERT}{P[1]}</article></body>", PROSE),
    "advert_and_menu": (f"<body>{MENU}<div>{P[0]}{ADVERT}{P[1]}</div>{MENU}</body>", PROSE),
    "advert_between": (f"<body><div>{P[0]}{ADVERT}{P[1]}</div></body>", PROSE),
    "two_articles": (f"<body>{MENU}<article>{P[0]}{ADVERT}</article><article>{P[1]}</article></body>", PROSE),
    "teasers": (
        f"<body><article>{P[0]}{P[1]}</article>"
        + "".join(f"<article><h3><a href='/{k}'>Story {k}</a></h3></article>" for k in range(8)) + "</body>", PROSE,
    ),
    "line_at_the_end": (f"<body><div>{P[0]}{P[1]}</div>{MENU}<div><div>All rights</div><div>Contact</div><div>Imprint</div></div></body>", PROSE),
}
#: Everything here belongs to the text, however short or full of links.
WHOLE = {
    "list_in_prose": (f"<body><div>{P[0]}<ul><li>milk</li><li>eggs</li><li>flour</li></ul>{P[1]}</div></body>", [*PROSE[:2], "milk", "eggs", "flour", *PROSE[2:]]),
    "list_at_the_end": (f"<body><div>{P[0]}<ul><li>milk</li><li>eggs</li><li>flour</li><li>salt</li></ul></div></body>", [*PROSE[:2], "milk", "eggs", "flour", "salt"]),
    "links_in_prose": (f"<body><article><p>{PROSE[0]} <a href='/a'>a link</a> and <a href='/b'>one</a>.</p></article></body>", [f"{PROSE[0]} a link and one."]),
    "short_article": (f"<body>{MENU}<article><p>Few words.</p></article></body>", ["Few words."]),
    "two_short_articles": ("<body><article><p>Few words.</p></article><article><p>More.</p></article></body>", ["Few words.", "More."]),
    "quoted_link": (f"<body><article>{P[0]}<blockquote><a href='/s'>as it was said</a></blockquote></article></body>", [*PROSE[:2], "as it was said"]),
    "only_links": ("<body><p><a href='/a'>One</a></p></body>", ["One"]),
    "unclosed": (f"<body><article><p>{PROSE[0]}<p>{PROSE[1]}", PROSE[:2]),
}


@pytest.mark.parametrize("name", [*UNNAMED, *WHOLE])
def test_regions(name):
    html, want = {**UNNAMED, **WHOLE}[name]
    assert main_text(html) == " ".join(want)


def test_density_decides(monkeypatch):
    """Without the clusters of smoothed ratios, the pages above lose or gain text."""
    for answer in (True, False):
        monkeypatch.setattr("driftline.llm.html_text.content_lines", lambda lines, slack=0.0: [answer] * len(lines))
        assert any(main_text(html) != " ".join(want) for html, want in UNNAMED.values())
    monkeypatch.setattr("driftline.llm.html_text.content_lines", lambda lines, slack=0.0: [True] * len(lines))
    wrong = [name for name, (html, want) in UNNAMED.items() if main_text(html) != " ".join(want)]
    assert wrong == list(UNNAMED)


def test_deep_pages_take_linear_time():
    deep = "<div>" * 50_000 + "<p>text</p>" + "</div>" * 50_000
    assert main_text(deep) == "text"
