"""Page text, centroids and periodic runs against independent versions in plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import centroids, queries, runs, sitestyle
from lodestar.llm.markup import read_page

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Periodic runs ------------------------------------------------------------------------------------------------------


def brute_runs(words: list[str]) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q):
                found.setdefault((s, e), q)  # the smallest period comes first
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def changed(doc_id: int | None, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id: int | None, text: str | None) -> tuple:
    words = changed(doc_id, text)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(brute_collapse(words, found)))


def test_runs_of_the_driver_table(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, SF).collect()))
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs)


def periodic_texts(n: int) -> list[str]:
    rng, out = random.Random(3), []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(1, 90):
            kind = rng.random()
            if kind < 0.5:
                words += [rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(1, 5))]
            else:
                unit = [rng.choice("ab") for _ in range(rng.randint(1, 9))]
                words += (unit * 12)[: rng.randint(len(unit), 8 * len(unit))]
        out.append(" ".join(words))
    return out


def test_runs_of_random_texts(spark: SparkSession) -> None:
    """Few words, so runs nest and overlap; and runs of runs."""
    texts = periodic_texts(600)
    texts += ["x " * 3000, ("a b " * 9 + "c ") * 7, ("a a a a a a b " * 5 + "d ") * 6, "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", None, "", " \n\t "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in runs.find_runs(docs).collect():
        words = WORD.findall(texts[r["doc_id"]] or "")
        want = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == want, r["doc_id"]
        assert r["collapsed"] == brute_collapse(words, want)


def test_deceived_hashes(monkeypatch: pytest.MonkeyPatch) -> None:
    """If hashes call everything equal, runs are still right."""
    word = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 3, 3, 3, 3, 3, 3, -1])
    want = runs.repetitions(word, 17)
    assert want == [(0, 8, 2), (9, 16, 1)]
    monkeypatch.setattr(runs.Words, "same", lambda self, i, q, m: np.ones(len(i), bool))
    assert runs.repetitions(word, 17) == want


def test_runs_of_a_very_long_text(spark: SparkSession) -> None:
    rng = random.Random(1)
    unit = [f"w{rng.randint(0, 5000)}" for _ in range(20_000)]
    words = [f"v{i}" for i in range(5000)] + unit * 5 + ["end"] + ["la"] * 40_000
    row = runs.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(5000, 100_000, 20_000), (105_001, 40_000, 1)]
    assert row["collapsed"] == " ".join(words[:25_000] + ["end", "la"])


def test_runs_keep_other_columns(spark: SparkSession) -> None:
    rows = [(None, "a " * 6, 1, "p"), (None, "a " * 6, 1, "p"), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, key string")
    got = runs.find_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "key", "collapsed"]
    assert sorted((r["key"] or "", len(r["runs"]), r["collapsed"]) for r in got.collect()) == [("", 0, ""), ("p", 1, "a"), ("p", 1, "a")]
    assert runs.find_runs(docs.limit(0)).count() == 0


# Centroids ----------------------------------------------------------------------------------------------------------


def brute_clusters(rows: list[tuple], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    at = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        at = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if mine[j] else c for j, c in enumerate(at)]
    done = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in done:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in done]


def ordered(rows: list) -> list[tuple]:
    return sorted(map(tuple, rows), key=str)


def test_clusters_of_the_driver_table(spark: SparkSession) -> None:
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = ordered(queries.op12_centroid_clustering(spark, SF).collect())
    assert got == ordered(brute_clusters(rows))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(queries.oracle_sql()["op12_centroid_clustering"])
    assert [d[0] for d in cur.description] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(cur.fetchall()) == got


def test_clusters_of_odd_rows(spark: SparkSession) -> None:
    rng = random.Random(4)
    make = lambda: [rng.uniform(-2, 2) for _ in range(64)]
    same = make()
    rows = [(i, make()) for i in range(60)] + [(i % 3, same) for i in range(40)] + [(None, make()), (None, same), (7, None), (8, [1.0] * 63), (9, [1.0] * 65)]
    rows += [(10, [float("nan")] + [0.0] * 63), (11, [float("inf")] + [0.0] * 63), (12, [None] + [0.0] * 63), (13, [1e30] + [0.0] * 63)]
    kept = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string")
    assert ordered(centroids.cluster(kept).collect()) == ordered(brute_clusters(rows[:-1]))
    few = rows[:5] + rows[60:62]
    assert ordered(centroids.cluster(kept.sparkSession.createDataFrame(few, "vec_id bigint, embedding array<float>")).collect()) == ordered(
        brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in few])
    )
    assert centroids.cluster(kept.limit(0)).count() == 0


def test_partial_distances_save_work() -> None:
    """All nearest centroids are right, and those that are far are given up before all dimensions are looked at."""
    rng = np.random.default_rng(2)
    at = rng.integers(-60, 60, (16, 64)) * np.linspace(3, 0.1, 64).astype(int).clip(1)
    x = at[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))
    order = np.argsort(-x.var(0))
    label, best, work = centroids.nearest(x, at, order)
    every = ((x[:, None, :] - at[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (label == every.argmin(1)).all()
    assert work < 0.6 * every.size * 64
    ties = np.zeros((3, 64), np.int64)
    assert centroids.nearest(ties, np.zeros((4, 64), np.int64), np.arange(64))[0].tolist() == [0, 0, 0]


# Pages --------------------------------------------------------------------------------------------------------------


class Article(HTMLParser):
    """The text of <article>, block by block, another way."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside += tag == "article"
        self.blocks[-1] += " " if tag == "br" else ""
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag: str) -> None:
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.blocks[-1] += data


def article_of(html: str | None) -> str:
    reader = Article()
    reader.feed(html or "")
    reader.close()
    return "\n\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


def test_pages_of_the_driver_table(spark: SparkSession) -> None:
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op11_html_extraction(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article_of(p["html"]), p["page_id"]
        assert got[p["page_id"]]["n_chars"] == len(article_of(p["html"])) and got[p["page_id"]]["url"] == p["url"]


def site(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def sentences(rng: random.Random, n: int) -> list[str]:
    return [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 30))) for _ in range(n)]


def test_unnamed_templates_are_found_by_entropy(spark: SparkSession) -> None:
    """Two sites whose markup names nothing: what repeats over a site goes, what differs stays, one text on many pages included."""
    rng, rows, want = random.Random(9), [], {}
    licence = "this text is under a licence that allows copies"
    for k in range(120):
        host, bars = (("a.example", ["home about contact", "archive feeds"]), ("b.example", ["start page", "legal terms", "write to us"]))[k % 2]
        body = sentences(rng, rng.randint(1, 6)) + ([licence] if k % 3 == 0 else [])
        bar = "".join(f"<li><a href=/x>{x}</a>" for x in rng.choice(bars).split())
        html = f"<html><body><div><ul>{bar}</ul></div><div>{''.join(f'<p>{x}' for x in body)}</div><div>{rng.choice(bars)} &copy; {host}</div></body></html>"
        rows.append((k, f"http://user@{host.upper()}:8080/{k}", html))
        want[k] = "\n\n".join(body)
    lone = "<body><div>menu</div><div><p>only page of its host</div>"
    rows += [(500, "https://c.example/", lone), (501, None, lone), (502, "no url", None)]
    want |= {500: "menu\n\nonly page of its host", 501: "menu\n\nonly page of its host", 502: ""}
    pages = site(spark, rows)
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(pages).collect()}
    assert got == want
    trees = sitestyle.style_trees(pages)
    low = sitestyle.importance(trees).where("importance < 0.5 AND pages > 20")
    assert {r["host"] for r in low.collect()} == {"a.example", "b.example"}


def test_named_parts_and_copies(spark: SparkSession) -> None:
    """Parts that the markup names go on any page; an article on all pages of a host stays, by whatever adverts it stands."""
    body = "<header><h1>Head</h1></header><p>one <b>two</b><br>three<p>caf&eacute; &lt;x&gt; &#8364;"
    extra = "<aside>side</aside><form><p>name <input></form><div class='post-comments'><article>first!</article></div><p class=cookie-notice>we use cookies"
    page = lambda k: (
        f"<head><title>t</title></head><body><header>site</header><nav>menu</nav>loose {k}<div class='ad-slot{k}'>buy {k}</div><article class=with-sidebar>{body}{extra}</article><div>around {k}</div><footer>end</footer>"
    )
    rows = [(k, "http://h.example/x", page(k % 30)) for k in range(60)]
    got = sitestyle.main_text(site(spark, rows)).collect()
    assert {r["text"] for r in got} == {"Head\n\none two three\n\ncafé <x> €"} and len(got) == 60
    same = "<body><div>bar</div><div><p>the same page</div>"
    copies = sitestyle.main_text(site(spark, [(k, "http://h.example/", same) for k in range(50)])).collect()
    assert {r["text"] for r in copies} == {"bar\n\nthe same page"}
    near = [(k, "http://h.example/", f"<body><div>bar</div><div><p>the same page</div><div class=ad>{k}</div>") for k in range(50)]
    assert {r["text"] for r in sitestyle.main_text(site(spark, near)).collect()} == {"bar\n\nthe same page"}


def test_pages_keep_other_columns(spark: SparkSession) -> None:
    rows = [(None, "http://h.example", "<p>a", "k", "l", 3, "t"), (1, "http://h.example", None, None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, _host string, low int, text string")
    got = sitestyle.main_text(pages)
    assert got.columns == ["page_id", "url", "html", "key", "_host", "low", "text", "n_chars"]
    assert sorted((r["key"] or "", r["text"], r["n_chars"]) for r in got.collect()) == [("", "", 0)] * 2 + [("k", "a", 1)] * 2
    assert sitestyle.main_text(pages.limit(0)).count() == 0


def texts_of(page: str) -> list[str]:
    return [t for _, t in read_page(page).blocks]


def test_markup() -> None:
    assert texts_of("<script>var a='<p>x</p>'</script>a<!-- <p>no --><style>p{}</style>b") == ["ab"]
    assert texts_of("<table><tr><td>1<td>2<tr><th>3</table>x<p title='a>b'>y<hr>z") == ["1", "2", "3", "x", "y", "z"]
    assert texts_of("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == ["a", "b", "c", "d"]
    assert texts_of("a < b &amp;&ampc &am 1<2") == ["a < b &&c &am 1<2"]
    assert texts_of("<p>a<div>b</p>c") == ["a", "b", "c"]
    assert texts_of("x<!-- open <p>y") == ["x"] and texts_of("x<p>y<p class=") == ["x", "y"] and texts_of("") == []
    assert texts_of("<title>no</title><p>a b\n\tc") == ["a b c"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "y"
    assert texts_of(deep) == ["x", "y"] and max(b.depth for b in read_page(deep).branches) == 64
    assert len(texts_of("<p>word" * 20_000)) == 20_000 and texts_of("<" * 100_000) == ["<" * 100_000]
