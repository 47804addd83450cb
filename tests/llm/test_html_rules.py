"""Block rules on pages where no landmark element gives the answer away."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from spanframe.llm.html_text import main_text

ITALIAN = "La vecchia officina del paese produce ancora utensili a mano, e gli artigiani accolgono volentieri chiunque voglia imparare. Ogni mattina si accende la fornace."
POLISH = "Stara kuźnia we wsi nadal wytwarza narzędzia ręczne, a rzemieślnicy chętnie przyjmują każdego, kto chce się uczyć. Każdego ranka rozpala się piec."
JAPANESE = "村の古い鍛冶場では今も手仕事の道具が作られており、職人たちは学びたい人を誰でも喜んで迎え入れる。毎朝、炉に火が入れられ、昼には鉄を打つ音が通りに響きわたる。夕方になると職人たちは道具を片づけて家へ帰る。"
LINKS = '<p><a href="/x">Leggi anche: tutte le altre notizie della settimana in una pagina</a></p>'


@pytest.mark.parametrize("prose", [ITALIAN, POLISH, JAPANESE])
@pytest.mark.parametrize("element", ["article", "div"])
def test_long_prose_beside_links_stays_in_any_language(prose, element):
    page = f"<body><nav><a href=/>Home</a></nav><{element}><p>{prose}</p>{LINKS}<p>{prose}</p>{LINKS}</{element}></body>"
    assert main_text(page) == f"{prose}\n{prose}"


def test_short_blocks_of_an_article_beside_links():
    page = f"<article><p>Una frase.</p>{LINKS}<p>{ITALIAN}</p>{LINKS}<p>Altro</p>{LINKS}</article>"
    assert main_text(page) == f"Una frase.\n{ITALIAN}"  # the block between two blocks of links is one of theirs


def test_head_of_an_article_keeps_its_title():
    for head in ("<header>", '<header class="entry-header">', '<header class="header">', '<div class="post-header">'):
        close = "</div>" if "div" in head else "</header>"
        page = f'<body><header class="site-header"><h1>Site</h1></header><article>{head}<h1>Title</h1>{close}<p>{ITALIAN}</p><div class="entry-footer">by me</div></article></body>'
        assert main_text(page) == f"Title\n{ITALIAN}", head


def test_pages_without_a_landmark_give_the_article():
    """All pages with their main element renamed, so that the rules decide every block."""
    both = found = true = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        blank = re.sub(r"<(/?)(article|main)\b", r"<\1div", page or "")
        want, got = Counter(filter(None, main_text(page).split("\n"))), Counter(filter(None, main_text(blank).split("\n")))
        both, found, true = both + (want & got).total(), found + got.total(), true + want.total()
    assert 2 * both / (found + true) >= 0.95


def test_pages_give_their_article_element():
    """The article of each page, cut out by its tags, has all the text and nothing more."""
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist():
        inside = re.findall(r"<article\b.*?</article>", page or "", re.S)
        if inside:
            assert main_text(page) == main_text("".join(inside))
