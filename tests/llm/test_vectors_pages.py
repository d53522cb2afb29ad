"""Clusters, vector codes and page texts against brute force, odd rows and planted templates."""

import hashlib
import html as markup
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridstrata.llm import codes, extraction, vafile, whole
from gridstrata.llm.queries import ORACLES, QUERIES
from gridstrata.sources.tables import table
from tests.oracle import compare, connect

CLASHING = "vec_id long, embedding array<double>, label int, part int, slice string, cluster int, entry int, v string, id int"


@pytest.fixture(scope="module")
def vectors(base):
    def build(rows):
        return base.createDataFrame([(i, v, lab, 7, "x", 3, 1, None, 5) for i, v, lab in rows], CLASHING)

    return build


def odd_vectors(width=64):
    rng = np.random.default_rng(5)
    some = [(i, rng.normal(0, 0.3, width).tolist(), i % 3 if i % 5 else None) for i in range(300)]
    same = [(1000 + i, some[7][1], 1) for i in range(400)]  # a hot vector
    ties = [(2000 + i, [0.5 * (i % 2)] * width, None) for i in range(40)]
    odd = [(3000, None, 1), (3001, [], 1), (3002, [1.0] * 3, 2), (3003, [float("nan")] * width, 1), (3004, [None] * width, 1),
           (3005, [float("inf")] + [0.0] * (width - 1), 0), (3006, [0.0] * width, 0), (7, some[8][1], 2), (7, some[8][1], 2),
           (None, some[9][1], 2), (3007, [1e300] * width, 0), (3008, [-1e300] * width, 0)]
    return some + same + ties + odd


def whole_numbers(v, scale):
    return [max(-whole.LARGEST, min(whole.LARGEST, int(np.floor(max(-1e9, min(1e9, x * scale)))))) for x in v]


def fits(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_clusters(rows, count=16, rounds=3):
    kept = [(i, whole_numbers(v, 64)) for i, v, _ in rows if fits(v) and len(v) == 64]
    mark = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:count]]
    x = np.array([v for _, v in kept], object)
    for step in range(rounds + 1):
        away = np.array([[((a - np.array(c, object)) ** 2).sum() for c in centroids] for a in x], object)
        near = [min(range(len(centroids)), key=lambda c: (d[c], c)) for d in away]
        if step < rounds:
            for c in range(len(centroids)):
                own = x[[k for k, n in enumerate(near) if n == c]]
                if len(own):
                    centroids[c] = [s // len(own) for s in own.sum(axis=0)]
    return [(i, n, int(away[k][n])) for k, ((i, _), n) in enumerate(zip(kept, near))], centroids


def test_cells_hold_their_values_and_intervals_hold_all_distances():
    rng = np.random.default_rng(2)
    for n, bits in ((1, 6), (5, 2), (700, 3), (700, 6)):
        x = rng.integers(-40, 40, (n, 6)) * rng.integers(0, 2, (n, 6))
        cell, low, high = vafile.cells(x, bits)
        at = np.arange(6)
        assert (low[at, cell] <= x).all() and (x <= high[at, cell]).all()
        c = rng.integers(-40, 40, (5, 6))
        lower, upper = vafile.intervals(cell, low, high, c)
        o = c.sum(axis=0) // len(c)
        exact = vafile.distances(x, c) - ((x - o) ** 2).sum(axis=1, keepdims=True)
        assert (lower <= exact).all() and (exact <= upper).all()


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_equal_brute_force(vectors, bits):
    rows = odd_vectors()
    found, centroids = vafile.clusters(vectors(rows), bits=bits)
    want, last = brute_clusters(rows)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert centroids.tolist() == [list(c) for c in last]
    got = vafile.report(found, centroids).collect()
    assert len(got) == len(want) and {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, last[r.cluster])).encode()).hexdigest()


def test_few_vectors_and_none(vectors):
    rows = odd_vectors()[:5]
    assert sorted(map(tuple, vafile.clusters(vectors(rows))[0].collect())) == sorted(brute_clusters(rows)[0])
    none = vafile.report(*vafile.clusters(vectors([])))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    empty = codes.report(*codes.quantise(vectors([])))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    few, books = codes.quantise(vectors(rows))
    assert books.shape[1] == 5 and few.count() == 5


def brute_codes(rows, width, entries=64, rounds=2):
    kept = [(i, whole_numbers(v, 256) + [0] * (width - len(v)), lab) for i, v, lab in rows if fits(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    step = width // 16
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), 16, step)
    books = np.array([v for _, v, _ in first], np.int64).reshape(len(first), 16, step).transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        away = np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(16)], axis=1)
        near = away.argmin(axis=2)
        if turn < rounds:
            for p in range(16):
                for e in range(len(first)):
                    own = x[near[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(axis=0) // len(own)
    out = [(i, bytes(near[k].astype(np.uint8)).hex(), int(away[k].min(axis=1).sum()), lab) for k, (i, _, lab) in enumerate(kept)]
    sums = Counter()
    for *_, error, lab in out:
        sums[lab] += error
    return [(i, code, error, sums[lab]) for i, code, error, lab in out], books


def test_shortlists_hold_the_nearest_entries():
    rng = np.random.default_rng(3)
    for n, dims, k in ((1, 4, 3), (33, 1, 64), (500, 4, 64), (500, 70, 9)):
        parts, entries = rng.integers(-9, 9, (n, dims)), rng.integers(-9, 9, (k, dims))
        blocks = codes.Blocks(parts, 8)
        near, alone = blocks.nearest(entries)
        want = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert near.tolist() == want[blocks.order].tolist()
        assert blocks.sums.sum(axis=0).tolist() == parts.sum(axis=0).tolist()
        assert len(alone) == len(blocks.counts) == -(-n // 8)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    walk = grid[np.argsort(codes.hilbert(grid), kind="stable")]
    assert len(np.unique(codes.hilbert(grid))) == len(grid)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).mean() == 1


@pytest.mark.parametrize("width", [64, 30])
def test_codes_equal_brute_force(vectors, width):
    rows = odd_vectors(width)
    found, books = codes.quantise(vectors(rows))
    want, last = brute_codes(rows, 64 if width == 64 else 32)
    assert books.tolist() == last.tolist()
    got = codes.report(found, books).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, last.ravel().tolist())).encode()).hexdigest()}


@pytest.mark.parametrize("name", ["op11_va_clusters", "op12_hilbert_codes"])
def test_vector_queries_equal_sql(base, small, name):
    assert compare(QUERIES[name](base, small).toPandas(), connect(small).execute(ORACLES[name]).fetchdf()) is None


def plain_article(source):
    """Blocks of the article of a given page, by splitting at its tags."""
    article = re.search(r"<article>(.*)</article>", source, flags=re.S)[1]
    blocks = (" ".join(markup.unescape(re.sub("<br>", " ", b).replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_given_pages_equal_a_plain_reading(base, small):
    pages = table(base, small, "pages").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op13_site_templates"](base, small).collect()}
    assert got == {p.page_id: (p.url, t := plain_article(p.html), len(t)) for p in pages}


def text_of(source):
    return extraction.Cut(source).text()


def test_trees_and_blocks():
    assert text_of("<p>a<p>b<ul><li>c<li>d</ul>e") == "a\nb\nc\nd\ne"
    assert text_of("<div>one  \n two<br>three</div>&amp;&lt;b&gt;&nbsp;x") == "one two three\n&<b> x"
    assert text_of("<article><h1>T</h1><div class=share>s</div><p>a <b>b</b>c</p></article>tail") == "T\na bc"
    assert text_of("<main><nav>m</nav><p>x</p><aside>y</aside></main><footer>f</footer>") == "x"
    assert text_of("<body class='has-sidebar'><div id=content><p>long enough text</p></div><div class='sidebar'>s</div><form>f<input></form></body>") == "long enough text"
    assert text_of("<article><header><h1>T</h1></header><p>x</p><section id='comments'><article class=comment>c</article></section><footer>by</footer></article>") == "T\nx"
    assert text_of("<script>var a='<p>no</p>';</script><style>p{}</style><p>a &notanentity; &#99999999999; &#" + "9" * 6000 + ";") == "a ¬anentity; � �"
    assert text_of("a <!-- c > --> b <!DOCTYPE x><![CDATA[c]]> 1 < 2 <3 </> <p") == "a b c 1 < 2 <3"
    assert text_of("") == text_of("<p> </p>") == ""
    assert text_of("<article><table><tr><td>1<td>2<tr><td>3</table></article>") == "1\n2\n3"


PLANTED = [
    (f"http://Site.example:80/{i}", f"<body><div class='x{i}'><div>Site name {'one two three four' if i % 2 else 'five six'}</div><span>menu a</span></div>"
     f"<div><p>Own words {i} of this page, and more of them than anything else on it {i * i}.</p><p>{'A shared quote.' if i < 2 else f'Other {i}.'}</p></div>"
     f"<div><p>Follow us on every channel.</p></div></body>") for i in range(40)]


def test_recurring_subtrees_of_a_host_go(base):
    rows = [(i, u, h) for i, (u, h) in enumerate(PLANTED)]
    rows += [(100 + i, f"https://copies.example/{i}", "<div><p>The same text on many pages.</p></div><div>Foot</div>") for i in range(30)]
    rows += [(200, "https://alone.example/", PLANTED[3][1]), (201, None, PLANTED[3][1]), (202, "no url", PLANTED[3][1])]
    df = base.createDataFrame([(*r, 1, "x", b"y") for r in rows], "page_id long, url string, html string, host int, text string, page binary")
    got = {r.page_id: r.text for r in extraction.main_text(df).collect()}
    for i in range(40):
        quote = "A shared quote." if i < 2 else f"Other {i}."
        assert got[i] == f"Own words {i} of this page, and more of them than anything else on it {i * i}.\n{quote}"
    assert {got[100 + i] for i in range(30)} == {"The same text on many pages.\nFoot"}  # copies of one page are one page
    assert got[200] == got[201] == got[202] == text_of(PLANTED[3][1])
    counts = defaultdict(set)
    for _, u, h in rows[:40]:
        cut = extraction.Cut(h)
        for k in cut.open():
            counts[cut.page.hashes[k] - (1 << 63)].add(cut.text())
    found = {r.subtree: r.n for r in extraction.templates(extraction.subtrees(df)).collect()}
    assert found == {k: len(v) for k, v in counts.items() if len(v) >= 3}


def test_article_paragraphs_stay_when_they_recur(base):
    page = "<nav>a b</nav><article><h1>Title {0}</h1><p>License line.</p><p>Text number {0} of the site.</p><div><span>Read on elsewhere</span></div></article><div>Notes {1}</div>"
    df = base.createDataFrame([(i, f"https://h.example/{i}", page.format(i, i % 3)) for i in range(12)], "page_id int, url string, html string")
    assert {r.page_id: r.text for r in extraction.main_text(df).collect()} == {i: f"Title {i}\nLicense line.\nText number {i} of the site." for i in range(12)}


def test_odd_pages(base):
    rows = [(1, "http://a.b/", None), (1, "http://a.b/", None), (None, None, "<p>x"), (2, "http://a.b/", ""), (3, "http://a.b/", "<p>" * 50_000 + "deep"),
            (4, "x", "\x00 😀 y".encode("utf-16", "surrogatepass").decode("utf-16")), (5, "http://a.b/", "<script>only"), (6, "http://a.b/", "&#xD800;z")]
    df = base.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extraction.main_text(df).collect()), key=repr)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "x", 1), (2, "", 0), (3, "deep", 4), (4, "\x00 😀 y", 5), (5, "", 0), (6, "�z", 2)], key=repr)
    assert extraction.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("source", [
    "a" * 10**6, "<" * 10**6, '<a "' * 250_000, "<div>" * 200_000, "<p><table><tr><td>" + "<div>" * 200_000, "<!--" * 250_000, "&#" + "9" * 10**6, "<p>" * 300_000,
    "<b>" * 200_000 + "</b>" * 200_000, "<ul>" + "<li>x" * 200_000, '<p class="' + "a " * 400_000 + '">x', "</p>" * 250_000, "x&amp" * 200_000, "<textarea>" * 100_000])
def test_long_pages_take_time_in_proportion(source):
    start = time.process_time()
    cut = extraction.Cut(source)
    cut.open()
    cut.text()
    assert time.process_time() - start < 15


def test_random_tags_never_fail():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<b", ">", "x ", "&amp;", "<table>", "<td>", "</table>", "<article>", "</article>", "<!--", "-->", "<li>", "<script>", "</script>", "\n", "'", '"', "<br/>", "<select><option>"]
    for _ in range(3000):
        source = "".join(rng.choices(bits, k=rng.randrange(40)))
        cut = extraction.Cut(source)
        cut.open()
        assert "\n\n" not in cut.text()
