"""Hostile pages take linear time; languages without a stop-word list keep their text; precision and recall on generated pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from timbral.llm.html_text import BREAKS, DROPPED, blocks, main_text

MB = 1 << 20


@pytest.mark.parametrize(
    "piece",
    ["<a ", '<a "', "<a b='", '<a b="', "<", "</", "<!", "<?", "<!-- -- ", "<![CDATA[", "<div>", "</div>", "<div></section>", "<article>", "<body>", "<head>", "<html><body>", "<svg>", "<select>", "<script>", "<a href=x>", "<a b=\">\" ", "<a x='<p y=\"", "= ", "&", "&#", "<br>", "<p>x", "<li><ul>", "<a =" + " " * 50],
)
def test_a_megabyte_of_a_piece_is_linear(piece):
    took = []
    for size in (MB // 4, MB):
        began = time.process_time()
        main_text("<p>" + piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < max(12 * took[0], 6)


RUSSIAN = "Это первый длинный абзац статьи о погоде, и в нём достаточно слов, чтобы он был главным текстом страницы. " * 3
CHINESE = "这是一篇关于天气的文章的第一段，它有足够的长度，因此应当被视为页面的正文内容。" * 8


@pytest.mark.parametrize("text", [RUSSIAN.strip(), CHINESE])
def test_other_languages_keep_their_text(text):
    page = f"<html><body><nav><a href=/>Меню</a></nav><div><p>{text}</p><p>{text}</p></div><div><a href=/1>{text[:90]}</a></div><footer>{text}</footer></body></html>"
    assert main_text(page) == f"{text}\n{text}"


ENGLISH = "the of and to in is that it was for on with as they at be this from have or by one had not but what all were when we there can an your which their said if do".split()
NOUNS = "river table garden engine market window letter doctor winter bridge paper kitchen village teacher record".split()


def prose(rng, n):
    text = " ".join(rng.choice(ENGLISH) if rng.random() < 0.5 else rng.choice(NOUNS) for _ in range(n))
    return text[0].upper() + text[1:] + "."


def page_of(rng):
    """A page and its article: headings, paragraphs, lists and quotes among the usual regions beside it."""
    article, shown = [], []
    for _ in range(rng.randrange(3, 9)):
        kind = rng.random()
        if kind < 0.2:
            text = prose(rng, rng.randrange(3, 7))
            article.append(text)
            shown.append(f"<h2>{text}</h2>")
        text = prose(rng, rng.randrange(25, 90))
        article.append(text)
        words = text.split(" ")
        words[3] = f"<a href='/x'>{words[3]}</a>"
        words[7] = f"<b>{words[7]}</b>"
        shown.append(rng.choice(["<p>{}</p>", "<p class=lead>{}", "<blockquote>{}</blockquote>", "<div>{}</div>"]).format(" ".join(words)))
        if kind > 0.85:
            text = prose(rng, rng.randrange(2, 6))
            article.append(text)
            shown.append(f"<p>{text}</p>")
    links = "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a></li>" for k in range(9))
    around = [f"<nav><ul>{links}</ul></nav>", f"<header><h1>{prose(rng, 3)}</h1><p>{prose(rng, 30)}</p></header>"]
    after = [f"<aside><p>{prose(rng, 40)}</p></aside>", f"<div class='related-posts'><ul>{links}</ul><p>{prose(rng, 30)}</p></div>", f"<div id=comments><p>{prose(rng, 60)}</p></div>", f"<footer><p>{prose(rng, 30)}</p></footer>", f"<script>var a='<p>{prose(rng, 9)}</p>'</script>", f"<form><label>{prose(rng, 4)}</label><p>{prose(rng, 20)}</p></form>", f"<ul class=x>{links}</ul>"]
    rng.shuffle(after)
    shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div><div class='post no-sidebar'>{}</div></div>"])
    return f"<html><head><title>{prose(rng, 3)}</title></head><body>{''.join(around)}{shell.format(''.join(shown))}{''.join(after)}</body></html>", article


def test_precision_and_recall_of_generated_pages():
    rng = random.Random(4)
    hit = said = meant = 0
    for _ in range(300):
        page, article = page_of(rng)
        got = main_text(page).split("\n")
        hit += sum(len(x) for x in got if x in article)
        said += sum(map(len, got))
        meant += sum(map(len, article))
    assert hit / meant > 0.98, hit / meant
    assert hit / said > 0.97, hit / said


def test_every_paragraph_of_a_mixed_page():
    english = (prose(random.Random(1), 70) + " ") * 2
    facts = "Prices: apples 3, pears 4, plums 5, cherries 6, melons 7, grapes 8, peaches 9, figs 10, dates 11."
    for order in ([english, RUSSIAN], [RUSSIAN, english], [RUSSIAN, CHINESE, english]):
        page = "<html><body><nav><a href=/>Home</a></nav><div>" + "".join(f"<p>{t}</p>" for t in order) + f"<table><tr><td>{facts}</td></tr></table></div><footer>{english}</footer></body></html>"
        assert main_text(page) == "\n".join([*(t.strip() for t in order), facts])


@pytest.mark.parametrize("around", ["{}", "<nav><a href=/>Home</a></nav>{}<footer>All rights reserved</footer>", "<div class=menu>Menu</div><div>{}</div>"])
def test_pages_of_short_paragraphs(around):
    short = "<p>Short note about the cat.</p><p>And one on the dog.</p>"
    assert main_text(f"<body>{around.format(short)}</body>") == "Short note about the cat.\nAnd one on the dog."
    assert main_text(f"<body>{around.format('')}</body>") == ""


def mixed_page_of(rng):
    """A page of paragraphs in listed and other languages, tables of facts, lists and short paragraphs."""
    article, shown = [], []

    def add(form, *texts):
        article.extend(texts)
        shown.append(form.format(*texts))

    for n in range(rng.randrange(3, 9)):
        kind = rng.random()
        if n == 0 or kind < 0.4:
            add("<p>{}</p>", prose(rng, rng.randrange(40, 90)))
        elif kind < 0.55:
            add("<p>{}</p>", rng.choice([RUSSIAN, CHINESE]).strip()[: rng.randrange(80, 300)].strip())
        elif kind < 0.7:
            add("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td></tr></table>", *(f"{rng.choice(NOUNS)} {rng.randrange(100)}, {rng.choice(NOUNS)} {rng.randrange(100)}" * rng.randrange(1, 5) for _ in range(3)))
        elif kind < 0.85:
            add("<ul><li>{}</li><li>{}</li></ul>", prose(rng, rng.randrange(3, 30)), " ".join(rng.choice(NOUNS) for _ in range(rng.randrange(3, 30))))
        else:
            add("<p>{}</p>", prose(rng, rng.randrange(2, 8)))
    links = "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a></li>" for k in range(9))
    after = [f"<aside><p>{prose(rng, 40)}</p></aside>", f"<div class='related-posts'><ul>{links}</ul><p>{prose(rng, 30)}</p></div>", f"<div id=comments><p>{prose(rng, 60)}</p></div>", f"<footer><p>{prose(rng, 30)}</p></footer>", f"<ul class=x>{links}</ul>"]
    rng.shuffle(after)
    shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>"])
    return f"<html><body><nav><ul>{links}</ul></nav>{shell.format(''.join(shown))}{''.join(after)}</body></html>", article


def test_precision_and_recall_of_mixed_pages():
    rng = random.Random(8)
    hit = said = meant = 0
    for _ in range(300):
        page, article = mixed_page_of(rng)
        got = main_text(page).split("\n")
        hit += sum(len(x) for x in got if x in article)
        said += sum(map(len, got))
        meant += sum(map(len, article))
    assert hit / meant > 0.98, hit / meant
    assert hit / said > 0.98, hit / said


class Plain(HTMLParser):
    """Texts between block-level tags, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.parts, self.skipped = [], [], 0

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skipped += 1
        elif tag in BREAKS and not self.skipped:
            self.cut()

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skipped -= 1
        elif tag in BREAKS and not self.skipped:
            self.cut()

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def test_blocks_are_those_of_a_plain_parser():
    rng = random.Random(6)
    for _ in range(200):
        page, _ = page_of(rng)
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert [b.text for b in blocks(page)] == plain.out
