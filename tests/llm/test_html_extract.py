import numpy as np
import pytest
from chronoline.llm import html_extract as H
from chronoline.llm.html_blocks import leaf_blocks
from chronoline.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def labeller():
    return H.trained_labeller()


def test_gradients_equal_differences():
    pages = labelled_pages(3, 7)
    model = H.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    batch = H.Batch([b for b, _ in pages])
    labels = np.zeros((batch.n, batch.t))
    for i, (_, y) in enumerate(pages):
        labels[i, : len(y)] = y

    def loss():
        z, _ = model.forward(batch)
        return float(((np.logaddexp(0, z) - labels * z) * batch.mask).sum() / batch.mask.sum())

    grads = model.gradients(batch, labels)
    r = np.random.default_rng(0)
    for name, p in model.p.items():
        at = tuple(np.unravel_index(np.argmax(np.abs(grads[name])), p.shape)) if r.random() < 2 else None
        old = p[at]
        p[at] = old + 1e-4
        high = loss()
        p[at] = old - 1e-4
        low = loss()
        p[at] = old
        assert grads[name][at] == pytest.approx((high - low) / 2e-4, rel=2e-2, abs=1e-6), name


def test_held_out_pages(labeller):
    pages = labelled_pages(200, 4321)
    kept = np.concatenate(labeller.main_blocks([b for b, _ in pages]))
    wanted = np.concatenate([np.array(y) for _, y in pages])
    assert (kept == wanted).mean() > 0.985


def test_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><p>a &amp; <b>b\n c</b><br>d<p>e<script>x='</p>'</script> f<!-- g --><ul><li>h<li><a href='>'>i</a></ul>&copy; &#x41;"
    assert [b.text for b in leaf_blocks(page)] == ["a & b c d", "e f", "h", "i", "© A"]
    assert [b.text for b in leaf_blocks("")] == [] == [b.text for b in leaf_blocks(None)]
    assert leaf_blocks("<div class='Side bar'><p>x</div>")[0].path == ("div", "div.side", "div.bar", ".side", ".bar", "p")


def test_text_behind_embedded_elements():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a<svg class=i /> b<p>c<p>d<svg/></p>e") == ["a b", "c", "d", "e"]
    assert texts("<article><object data=x><p>a</p><p>b</p></article><p>c") == ["a", "b", "c"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds<p><object>no plugin</object> b") == ["if x=1 holds", "no plugin b"]
    assert texts("<p>a <svg><title/><style/><text>axis</text><title>hidden</title></svg> b<p>c") == ["a axis b", "c"]
    assert texts("<p>a<svg><path><p>b<title>gone</title>c") == ["a", "b c"]
    assert texts("<p>a<template>x<template>y</template>z</template>b<template>c<p>d") == ["a b c", "d"]
    assert texts("<p>a<script>never closed <p>b") == ["a"]


def test_articles_of_the_pages_table(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in H.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = r["html"].split("<article>")[1]
        assert r["n_chars"] == len(r["text"]) > 0
        assert all(line in " ".join(b.text for b in leaf_blocks(article)) for line in r["text"].split("\n"))
        assert "middot" not in r["text"] and "·" not in r["text"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<p>only"), (3, "u", "<<<>>> < p <"), (4, "u", "<article>" + "<p>Some prose of the article here.</p>" * 3000 + "</article>")]
    out = H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text")).collect()
    assert len(out) == 6 and {r["text"] for r in out if r["page_id"] in (1, 2)} == {""}
    assert next(r for r in out if r["page_id"] == 4)["text"].count("\n") == 2999


def test_comments_end_as_html_ends_them():
    from chronoline.llm.html_blocks import leaf_blocks

    for comment in ("<!-->", "<!--->", "<!---->", "<!-- x -->", "<!-- x --!>", "<!--x->y-->", "<!--<!-- x -->", "<!--\n-->"):
        assert [b.text for b in leaf_blocks(f"<p>a{comment}b</p><p>c</p>")] == ["ab", "c"], comment
    assert [b.text for b in leaf_blocks("<p>a</p><!-- open <p>b</p>")] == ["a"]


def test_no_pages(spark):
    from chronoline.llm import html_extract

    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract_main_text(pages).count() == 0


def test_batches_equal_a_page_by_page_walk():
    """Every block's score by a walk over one page in plain form: vectors, both directions, output; and the text joined from the blocks over nought."""
    import numpy as np
    from chronoline.llm import html_extract as H
    from chronoline.llm.html_training import labelled_pages

    labeller = H.Labeller(3)
    p = {k: v.astype(float) for k, v in labeller.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def steps(xs, w, u, b):
        h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), []
        for x in xs:
            i, f, o, a = np.split(x @ w + h @ u + b, 4)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(a)
            h = sigmoid(o) * np.tanh(c)
            out.append(h)
        return out

    def walk(blocks):
        xs, run = [], 0
        for i, b in enumerate(blocks):
            run = run + 1 if i and blocks[i - 1].path == b.path else 0
            x = np.array(H._dense(b, i, len(blocks), run)) @ p["dense"] + p["bias"] + sum(p["table"][r] for r in H._path_rows(b.path))
            words = H._word_rows(b.text)
            xs.append(np.tanh(x + sum(p["table"][r] for r in words) / max(1, len(words))))
        ahead, back = steps(xs, p["wf"], p["uf"], p["bf"]), steps(xs[::-1], p["wb"], p["ub"], p["bb"])[::-1]
        return [float(np.concatenate(v) @ p["out"][:, 0] + p["out_bias"][0]) for v in zip(ahead, back, xs)]

    pages = [blocks for blocks, _ in labelled_pages(12, 5)] + [[]]
    want = [walk(b) for b in pages]
    middle = float(np.median([v for w in want for v in w]))
    labeller.p["out_bias"] = labeller.p["out_bias"] - np.float32(middle)
    kept = labeller.main_blocks(pages)
    for w, k in zip(want, kept):
        sure = np.abs(np.array(w) - middle) > 1e-4
        assert ((np.array(w) > middle) == k)[sure].all()
    assert 0.3 < np.mean(np.concatenate(kept)) < 0.7
    html = "<html><body><p>One &amp; two</p><div><p>three\n  four</p></div></body></html>"
    blocks = H.leaf_blocks(html)
    assert H.main_texts(labeller, [html, None, ""]) == ["\n".join(b.text for b, k in zip(blocks, labeller.main_blocks([blocks])[0]) if k), "", ""]
