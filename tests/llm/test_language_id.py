from voxelbase.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_text_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = L.fit(docs.where("doc_id % 5 <> 0"))
    rows = docs.where("doc_id % 5 = 0 and length(text) > 100").collect()
    right = sum(langs[int((table[:, L.trigrams(r.text)].sum(axis=1)).argmax())] == r.lang for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.97


def test_evidence_moves_short_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fr = docs.where("lang = 'fr' and length(text) > 1500").first().text
    page = lambda text, lang="": f"<html{lang}><script>if (a<b) the()</script><body>{text[:600]}</body></html>"
    rows = [(i, "http://user@fr.example.org:80/x", page(fr[i * 20 :])) for i in range(30)]
    rows += [(100, "http://fr.example.org/y", page("")), (101, None, page("", ' class="a" lang="de-AT"')), (102, "junk", None), (103, "http://new.example.de/", page(fr, ' lang="de"')), (103, "http://new.example.de/", page(fr, ' lang="de"'))]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert all(got[i].lang == "fr" for i in range(30)) and got[0].host == "fr.example.org"
    assert got[100].lang == "fr" and got[100].confidence > 0.5  # the host's other pages decide
    assert got[101].declared_lang == "de" and got[102].host == "" and got[102].lang
    assert got[103].lang == "fr"  # a long text outweighs a wrong declaration


def test_all_pages_once_and_empty_tables(spark):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(pages, docs).toPandas()
    assert len(rows) == pages.count() and rows.page_id.is_unique and rows.confidence.between(0, 1).all()
    assert (rows.lang == rows.text_lang).mean() > 0.9
    assert L.identify(pages.limit(0), docs).count() == 0
    assert L.identify(pages, docs.limit(0)).where("lang is null").count() == len(rows)


def test_broken_markup_is_read_in_linear_time():
    import time

    t = time.time()
    for page in ("<script>" * 130_000, "<!--" * 250_000, "<" * 1_000_000, "<style " * 140_000, "&" * 1_000_000):
        L.visible(page)
    assert time.time() - t < 10
    assert L.visible("a<b>c</b><script>x<y</script >d<!-- e --> f &amp; g <br") == "a c  d  f   g <br"


def test_posteriors_match_one_by_one(spark):
    """Every page's posterior from the stated formula, page by page."""
    import re
    from collections import defaultdict

    import numpy as np

    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    langs, table = L.fit(docs)
    n, rows = len(langs), []
    for p in pages.collect():
        m = re.match(L.HOST, p.url or "")
        host = m[1].lower() if m else ""
        tag = re.search(L.HTML_TAG, p.html or "")
        d = re.search(L.DECLARED, tag[0]) if tag else None
        counts = np.bincount(L.trigrams(L.visible(p.html)), minlength=table.shape[1])
        ll = table.astype(float) @ counts * L.TEMPER
        ll = np.maximum(ll - ll.max(), -L.MOST_EVIDENCE)
        d = d[1].lower() if d else None
        rows.append((p.page_id, host, host.rsplit(".", 1)[-1], langs.index(d) + 1 if d in langs else 0, ll, np.exp(ll) / np.exp(ll).sum()))
    said, by_host, by_suffix, pages_of, suffixes = defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n)), defaultdict(int), defaultdict(int)
    for _, h, s, d, _, post in rows:
        said[d] += post
        by_host[h] += post
        by_suffix[s] += post
        pages_of[h] += 1
        suffixes[s] += 1
    every = sum(said.values()) + 1
    world = every / every.sum()
    got = {r.page_id: r for r in L.identify(pages, docs).collect()}
    for page, h, s, d, ll, post in rows:
        agree = 0 if not d else np.log((said[d] + L.SMOOTH_DECLARED * (0.5 / n + 0.5 * (np.arange(n) == d - 1))) / (every + L.SMOOTH_DECLARED))
        suffix = (np.maximum(by_suffix[s] - post, 0) + L.SMOOTH_SUFFIX * world) / (suffixes[s] - 1 + L.SMOOTH_SUFFIX)
        prior = (np.maximum(by_host[h] - post, 0) + L.SMOOTH_HOST * suffix) / (pages_of[h] - 1 + L.SMOOTH_HOST)
        z = ll + np.log(prior) + agree
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[page].confidence - p.max()) < 1e-6 and p[langs.index(got[page].lang)] > p.max() - 1e-6
