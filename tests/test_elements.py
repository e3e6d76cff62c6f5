"""Cards and blocks by their own extents."""

import random
import re

import pytest

from forecourt.operators import elements, extract

PAGE = "page_id long, url string, html string"


def found(spark, html, **how):
    rows = extract.listing_links(spark.createDataFrame([(1, "https://h", html)], PAGE), **how).collect()
    return sorted((r.pos, r.url.removeprefix("https://h/for-sale/used/")) for r in rows)


def card(n, more="", cls="card"):
    return f'<div class="{cls}">{more}<a href="/for-sale/used/{n}">x</a></div>'


def test_a_mark_outside_of_cards_takes_none(spark):
    assert found(spark, card(1) + card(2) + "<aside><span>Sponsored</span></aside>") == [(0, "1"), (1, "2")]


def test_a_card_without_a_link_takes_none_from_elsewhere(spark):
    assert found(spark, card(1) + '<div class="card">no link</div><footer><a href="/for-sale/used/99">all</a></footer>') == [(0, "1")]


def test_nested_and_framed_cards(spark):
    mark = "<span>Sponsored</span>"
    assert found(spark, f'<div class="cards">{card(1)}{card(2, mark)}{card(3)}</div>') == [(1, "1"), (3, "3")]
    assert found(spark, f'<div class="cards">{card(1)}{card(3)}</div>') == [(0, "1"), (1, "1"), (2, "3")]
    assert found(spark, f'<div class="card">{mark}<div class="card-body">{card(2)}</div></div>{card(5)}') == [(3, "5")]
    assert found(spark, f'<div class="card sponsored"><div>{card(2)}</div></div>{card(5)}') == [(2, "5")]
    assert found(spark, f'<div class="card"><div class="card sponsored">{card(2)}</div><a href="/for-sale/used/7">own</a></div>') == [(0, "7")]


def test_cards_that_are_not_closed_end_at_the_next(spark):
    assert found(spark, '<div class="card"><a href="/for-sale/used/1">a<div class="card"><span>sponsored</span><a href="/for-sale/used/2">b') == [(0, "1")]
    assert found(spark, '<li class="x"><a href="/for-sale/used/1">a<li><b>none</b><li><a href="/for-sale/used/3">', opening=r"<li\b") == [(0, "1"), (2, "3")]


def test_stray_tags_scripts_and_comments(spark):
    stray = f'</div></article><script>var a = "<div class=\'card\'>"</script><!-- <div class="card"><a href="/for-sale/used/9"> -->{card(1)}</div>{card(2)}'
    assert found(spark, stray) == [(0, "1"), (1, "2")]
    assert found(spark, None) == [] and found(spark, "") == [] and found(spark, "<div class='card'>") == []


def test_pages_without_own_links_fall_back_to_their_anchors(spark):
    assert found(spark, f'<a href="/x">no</a>{card(1, "<span>Sponsored</span>")}<a href="/for-sale/used/2">b</a>') == [(1, "1"), (2, "2")]


def test_repeated_page_ids_are_pages_of_their_own(spark):
    pages = spark.createDataFrame([(None, "https://h", card(1)), (None, "https://h", card(2)), (3, "https://h", card(3)), (3, "https://h", '<a href="/for-sale/used/4">')], PAGE)
    assert sorted(r.url[-1] for r in extract.listing_links(pages).collect()) == ["1", "2", "3", "4"]


def test_blocks_in_adverts_go_with_them(spark):
    html = '<div>a</div><div class="x ad"><div>in it</div><p>too</p></div><p>Sponsored</p><div>sponsored<p>by</p></div><p>b<div class="adult">c</div>'
    rows = extract.blocks(spark.createDataFrame([(1, "u", html)], PAGE)).orderBy("pos").collect()
    assert [(r.pos, re.sub("<[^>]*>", "", r.block)) for r in rows] == [(0, "a"), (7, "b"), (8, "c")]


@pytest.mark.parametrize("seed", range(3))
def test_extents_equal_a_stack(spark, seed):
    """Well-formed and broken pages: a tag ends where a counter of its name says so."""
    r = random.Random(seed)
    pages = [(i, "u", "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "x"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = {}
    for t in elements.with_extents(elements.tags(spark.createDataFrame(pages, PAGE), ["div", "p"])).where("NOT closing").collect():
        got.setdefault(t.page_id, {})[t.pos] = t.stop
    for i, _, html in pages:
        tags = re.findall("<[^>]*>", html)
        want = {}
        for k, tag in enumerate(tags):
            if tag[1] != "/":
                level, want[k] = 1, None
                for j in range(k + 1, len(tags)):
                    if tags[j].strip("</>") == tag.strip("<>"):
                        level += -1 if tags[j][1] == "/" else 1
                        if level == 0:
                            want[k] = j
                            break
        assert got.get(i, {}) == want, html


def test_tags_are_shuffled_once_and_pages_never(spark):
    pages = spark.createDataFrame([(1, "https://h", card(1))], PAGE)
    plan = extract.listing_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
