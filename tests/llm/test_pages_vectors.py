"""Pages and vectors."""

import numpy as np
import pytest

from weft.llm import ann, htmltext

DATA = "/root/testdata/sf0.01"
FRAME = '<html><head><title>t</title></head><body><header>Site</header><nav>menu</nav><div class="cookie-notice">cookies</div><div class="wrap"><div class="sidebar"><p>side</p></div><div class="{c}">{body}</div><div class="comments"><p>{noise}</p></div></div><footer>foot</footer></body></html>'


def page(body, c="post-content post-12", noise="nice"):
    return FRAME.format(c=c, body=body, noise=noise)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  words", "just words"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a &lt; b &amp; c&nbsp;d &#233;</p>", "a < b & c d é"),
        (page("<h2>T</h2><p>one <b>bold</b><br>two<ul><li>x<li>y</ul><div class='ad'>BUY</div><form>f</form><script>if(a<b)</script>"), "T\none bold two\nx\ny"),
        (page("<table><tr><td>c1<td>c2</table>"), "c1\nc2"),
        ("<article><header><h1>Head</h1></header><p>x<!-- no --></p></article><aside>no</aside>", "Head\nx"),
        ("<p>unclosed <b>tag", "unclosed tag"),
        ('<div><p title="a>b">quoted</p></div>', "quoted"),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html, None) == text


def test_hosts_agree(spark):
    """A page whose comments outweigh its article is put right by the other pages of its host."""
    pages = [(i, f"https://a.example/{i}", page(f"<p>{'article text ' * 30}{i}</p>")) for i in range(6)]
    noise = '<div class="talk"><p>' + "loud talk " * 60 + "</p></div>"
    pages.append((9, "https://a.example/9", page("<p>" + "short article here " * 10 + "</p>").replace("</body>", noise + "</body>")))
    pages += [(20, None, "<p>no host</p>"), (21, "https://b.example/", None), (22, "https://b.example/", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, _path string")
    got = {r.page_id: r.text for r in htmltext.op6(df).collect()}
    assert got[9] == ("short article here " * 10).strip() and got[0].endswith("text 0")
    assert got[20] == "no host" and got[21] == "" and got[22] == ""
    assert htmltext.extract(df).columns == ["page_id", "url", "_path", "text"]
    assert htmltext.op6(df.limit(0)).count() == 0


def brute(rows, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 50 == 0:
            c = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
            best = [j for j in np.lexsort((ids, -c)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(c[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in ann.op2(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (50, [0.0, 1e-30]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    got = found(df)
    assert [v for v, _ in got[0]] == [2, 3, 1, 50] and len(got[50]) == 4
    assert ann.op2(df.limit(0)).count() == 0


def test_rows_with_one_id_ask_and_answer_each(spark):
    """Two rows with id 50 that differ, two that are equal, and a hot vector: each row gets its own answer."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = [tuple(r) for r in ann.op2(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(r[:2] for r in got) == sorted((q, k) for q in (50, 50, 100, 100) for k in range(1, 6))
    assert sorted(r[2] for r in got if r[:2] == (50, 1)) == [1, 2] and [r[2] for r in got if r[:2] == (100, 1)] == [100, 100]
    hot = [(7, [1.0, 2.0, 3.0])] * 1000 + [(50, [1.0, 2.0, 2.5]), *((i, [float(i), 1.0, 0.0]) for i in range(51, 99))]
    got = ann.op2(spark.createDataFrame(hot, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(50, 7)] * 5


def test_equal_vectors_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    rows = [(i, (base[0] if i % 3 == 0 else base[i % 40]).astype(np.float32).tolist()) for i in range(900)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 100)
    monkeypatch.setattr(ann, "QUERIES", 3)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want, got = brute([(r.vec_id, r.embedding) for r in df.collect()]), found(df)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and got.keys() == want.keys()
    for q, best in got.items():
        known = dict(want[q])
        assert all(s == pytest.approx(known[v], abs=1e-12) for v, s in best if v in known)
