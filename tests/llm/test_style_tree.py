import math
import random
import time
from collections import Counter, defaultdict

import pytest

from ladderworks.llm.site_style_tree import CONTENT_WEIGHT, LOW, MAX_DEPTH, NOISE, SHORT_WORDS, blocks, extract_main_text, main_text, page_facts, style_tree

SCHEMA = "page_id bigint, url string, html string, text string, host string, low string, _row string"


def prose(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def story(i, paragraphs=6):
    rng = random.Random(i)
    return [prose(rng, 4), *[prose(rng, rng.randint(10, 40)) for _ in range(paragraphs)]]


def told(texts):
    return f"<h2>{texts[0]}</h2>" + "".join(f"<p>{t}</p>" for t in texts[1:])


def page(i, body=None):
    """A page none of whose names tells what it is; menu and advert are new on every page, two lines are on all."""
    rng = random.Random(1000 + i)
    menu = "".join(f"<div class='item-x'><a href='/{w}'>{w}</a></div>" for w in prose(rng, 5).split())
    return (
        f"<html><head><title>T{i}</title></head><body><div class='xa'>{menu}</div><div class='xb'>Welcome to the site</div><div class='xc'>{prose(rng, 8)}</div>"
        f"<div class='xd s{i}'>{told(story(i)) if body is None else body}</div><div class='xe'>All of it by us since {1900 + i}</div></body></html>"
    )


def on(host, pages):
    return [(i, f"http://{host}/{i}", html) for i, html in pages]


LINE = "<p>Subscribe to our letter today</p>"
REMARK = "<div class='user-comments'><p>{}</p></div>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    own = on("h.org", [(i, page(i)) for i in range(24)]) + on("few.org", [(100 + i, page(i)) for i in range(3)])
    own += on("wrapped.org", [(300 + i, f"<div id=page><div class=ya><article>{told(story(i))}{LINE}<p>{story(99)[1]}</p></article></div><div class=yb>{prose(rng, 6)}</div></div>") for i in range(20)])
    own += on("rare.org", [(400 + i, f"<div class={'za' if i % 6 else 'zb'}>{told(story(i))}</div><div class=zc>{prose(rng, 6)}</div>") for i in range(72)])
    own += on("copies.org", [(500 + i, page(3)) for i in range(15)])
    own += on("talk.org", [(600 + i, f"<div class=v1>{told(story(i))}{REMARK.format(prose(rng, 150))}</div><article class=comment>{prose(rng, 200)}</article>") for i in range(15)])
    own += on("cards.org", [(700 + i, f"<article class=teaser><p>{prose(rng, 80)}</p></article><div id=story>{told(story(i, 9))}</div>") for i in range(12)])
    return own + [(200, None, None), (201, "", ""), (202, "http://h.org/0", page(0)), (None, "http://h.org/0", page(0))]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "x", "l", "r") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(pages):
    return {r.page_id: r.text for r in extract_main_text(pages).collect()}


def host_of(url):
    return url.split("//")[1].split("/")[0].lower() if url and "//" in url else ""


def entropy(counts, m):
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts) / math.log(m) if m > 1 else 0.0


def plain_branches(rows):
    """(pages, presentation, content, information a page) of every node of each host, features counted page by page."""
    seen, shape, features, above = Counter(), defaultdict(list), defaultdict(lambda: defaultdict(list)), {}
    for _, url, html in rows:
        found, nodes = blocks(html or "", frozenset())
        host, own = host_of(url), defaultdict(list)
        for n in nodes:
            if not n.code:
                own[n.path].extend(n.children)
                above[host, n.path] = [*n.ancestors(), n.path]
        for path, children in own.items():
            seen[host, path] += 1
            shape[host, path].append(tuple(children))
        words = Counter()
        for b in found:
            masked = "".join("0" if c.isdigit() else c for c in b.text.lower())
            while "00" in masked:
                masked = masked.replace("00", "0")
            words.update([(b.node.path, w, 1) for w in masked.split()] if len(masked.split()) <= SHORT_WORDS else {(b.node.path, masked, len(masked.split()))})
        for (path, w, size), n in words.items():
            features[host, path][w, size].append(n)
    sums = defaultdict(lambda: [0.0, 0.0])
    for (host, path), found in features.items():
        for (_, size), counts in found.items():
            for p in above[host, path]:
                sums[host, p][0] += size
                sums[host, p][1] += size * (1 - entropy(counts, seen[host, path]))
    out = {}
    for key, m in seen.items():
        w, own = sums[key] if key in sums else (0, 0)
        out[key] = (m, entropy(list(Counter(shape[key]).values()), m) if m > 1 else 1.0, own / w if w else 1.0, own / m)
    return out


def test_tree_against_plain_entropies(pages, rows):
    got = {(r.host, r.path): r for r in style_tree(pages).collect()}
    want = plain_branches(rows)
    assert set(got) == set(want) and len(got) > 40
    for k, (m, presentation, content, _) in want.items():
        assert (got[k].pages, got[k].presentation, got[k].content) == (m, pytest.approx(presentation, abs=1e-9), pytest.approx(content, abs=1e-9))
    assert {r.prior for r in got.values()} == {NOISE, 1.0}
    assert {h for h, _ in got if got[h, 0].decided} == {"h.org", "wrapped.org", "rare.org", "talk.org", "cards.org"}


def test_share_and_composite_of_a_host(pages, rows):
    want = {p: v for (h, p), v in plain_branches(rows).items() if h == "h.org"}
    nodes = {n.path: n for n in blocks(page(0), frozenset())[1] if not n.code}
    style = {n.path: s for n in nodes.values() for s in ["/".join(map(str, n.ancestors()))]}
    main = max((p for p in nodes if nodes[p].depth == 3), key=lambda p: want[p][3])
    for r in style_tree(pages, names=False).where("host = 'h.org'").collect():
        n = nodes[r.path] if r.path in nodes else None
        if n is None or n.tag in ("", "html", "body") or str(main) in style[r.path] or r.path == main:
            assert r.importance == 1.0
            continue
        top = n
        while top.depth > 3:
            top = top.up
        share = min(1.0, want[top.path][3] / want[main][3])
        composite = CONTENT_WEIGHT * want[r.path][2] + (1 - CONTENT_WEIGHT) * want[r.path][1]
        assert r.share == pytest.approx(share, abs=1e-9) and r.importance == pytest.approx(share * composite, abs=1e-9) and r.importance < LOW


def test_entropies_alone_find_the_story(pages, texts):
    bare = {r.page_id: r.text for r in extract_main_text(pages, names=False).collect()}
    for i in range(24):
        assert bare[i] == texts[i] == "\n".join(story(i))
        assert main_text(page(i), frozenset(), decided=True) != bare[i]  # nothing but the tree removes it
    assert texts[100].startswith(prose(random.Random(1000), 5).split()[0])  # too few pages to know
    assert bare[202] == texts[202] == texts[0] and texts[200] == texts[201] == ""


def test_wrapped_articles_and_lines_of_every_page(texts):
    for i in range(20):  # the copied paragraph is on all pages too, and so is a leaf of no importance
        assert texts[300 + i] == "\n".join(story(i))


def test_rare_templates_and_copies_stay(texts):
    assert all(texts[400 + i] == "\n".join(story(i)) for i in range(72))
    assert all(set(story(3)) <= set(texts[500 + i].split("\n")) for i in range(15))


def test_comments_and_teasers_go(texts):
    assert all(texts[600 + i] == "\n".join(story(i)) for i in range(15))
    assert all(texts[700 + i] == "\n".join(story(i, 9)) for i in range(12))


def test_names_without_a_tree():
    kinds = ["user-reviews", "sidebar-box", "share-buttons", "comments", "ad_1", "related-links"]
    assert main_text("<article><h1>a</h1>" + "".join(f"<div class='{k}'>no</div>" for k in kinds) + "<p>b</p></article>") == "a\nb"
    assert main_text("<div class='layout has-sidebar'><article><div class='article-header'><h1>a</h1></div><p>b</p></article></div>") == "a\nb"
    assert main_text("<article class='teaser'>long long teaser</article><div id=story>told</div>") == "told"


def test_paths_end_at_the_greatest_depth():
    nodes, _, _ = page_facts("<div>" * 300 + "x")
    assert len(nodes) == MAX_DEPTH + 1 and max(n.depth for n, _ in nodes.values()) == MAX_DEPTH


def test_repeated_rows_columns_and_empty_table(pages):
    found = extract_main_text(pages)
    assert found.where("url = 'http://h.org/0'").count() == 3
    assert found.columns == ["page_id", "url", "host", "low", "_row", "text"]
    assert {(r["_row"], r.low, r.host) for r in found.collect()} == {("r", "l", "x")}
    assert extract_main_text(pages.limit(0)).collect() == [] and style_tree(pages.limit(0)).collect() == []


def test_salted_join_gives_the_same(pages, texts):
    assert {r.page_id: r.text for r in extract_main_text(pages, broadcast_bytes=0).collect()} == texts


@pytest.mark.parametrize(
    "html",
    ["<div>" * 50000 + "x", "<div>" * 50000 + "</span>" * 50000, "<p " * 20000, "<p " * 20000 + ">", "<p a=\"x'>" * 20000 + "<p b='", "<ul><li>a" * 30000, "<table><tr><td>" * 20000 + "</b>" * 20000, "<b>" * 50000 + "</i>" * 50000],
)
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    main_text(html)
    assert len(page_facts(html)) <= 60000 and time.process_time() - began < 4


def test_markup():
    assert main_text("a<!-- <p>x</p> -->b<!doctype html><?php x ?>c<p title='1 > 2' data-x=\"<b>\">d<p>e<br>f&lt;g</p>") == "abc\nd\ne f<g"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert main_text("<p>don't <b>stop</p><script>if (a < b) '</p>'</script>x <svg/>y") == "don't stop\nx\ny"
    assert [b.text for b in blocks("<p>a</p><nav>b</nav>", frozenset())[0]] == ["a", "b"]
