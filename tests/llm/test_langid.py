import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from alphaline.llm import langid

DOCS = [
    (1, "the cat and the dog are in the garden " * 3, "en", "s1"),
    (2, "le chat et le chien sont dans le jardin " * 3, "fr", "s1"),
    (3, "der Hund und die Katze sind im Garten " * 3, "de", "s2"),
    (4, "the bird is in the tree and it sings", "en", "s2"),
    (5, "les oiseaux sont dans les arbres", None, "s1"),
    (5, "les oiseaux sont dans les arbres", None, "s1"),
    (6, "", None, "s2"),
    (7, None, "fr", None),
    (None, "das ist der Garten", None, "s2"),
]
PAGES = [
    (1, "http://a.site.fr/x", '<html lang="fr"><script>the the the</script><p>le jardin est dans</p></html>'),
    (2, "http://b.site.fr/y", "<html><p>ok</p></html>"),
    (3, "https://c.org/", '<HTML xml:lang="EN"><p>the garden</p>'),
    (4, None, None),
    (5, "http://b.site.fr/z", '<html lang="xx"><p>chat chien</p></html>'),
]


def trigram_codes(data):
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    return [((low[k] << 16 | low[k + 1] << 8 | low[k + 2]) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.FEATURE_BITS) for k in range(len(low) - 2)]


def brute_force():
    counts = defaultdict(Counter)
    for i, text, lang, _ in DOCS:
        if lang and text is not None and i is not None:
            counts[lang].update(trigram_codes(text.encode()))
    langs = sorted(counts)
    size = 1 << langid.FEATURE_BITS
    totals = {k: sum(counts[k].values()) + 0.5 * size for k in langs}
    rows = []
    for i, text, _, source in DOCS:
        rows.append(("document", i, None, None if source is None else f"source:{source}", None, None, (text or "").encode()))
    for i, url, page in PAGES:
        raw = (page or "").encode()
        found = re.search(rb"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})", raw)
        body = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", b" ", raw)
        host = re.match("[^/?#]*", url.split("://")[1])[0] if url else None
        rows.append(("page", None, i, host, host and host.split(".")[-1], found and found[1].decode().lower(), body))

    def normal(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    scores = [[langid.EVIDENCE * sum(math.log((counts[k][c] + 0.5) / totals[k]) for c in trigram_codes(r[6])) for k in langs] for r in rows]
    q = [normal(s) for s in scores]
    whole = [1 + sum(x[k] for x in q) for k in range(len(langs))]
    base = [x / sum(whole) for x in whole]
    host, suffix, tag = (defaultdict(lambda: [0.0] * len(langs)) for _ in range(3))
    for r, x in zip(rows, q, strict=True):
        for table, key in ((host, r[3]), (suffix, r[4]), (tag, r[5])):
            if key is not None:
                table[key] = [a + b for a, b in zip(table[key], x, strict=True)]

    def smooth(sums, parent, strength):
        return [(s + strength * p) / (sum(sums) + strength) for s, p in zip(sums, parent, strict=True)]

    out = []
    for r, s, x in zip(rows, scores, q, strict=True):
        parent = smooth(suffix[r[4]], base, langid.SUFFIX_STRENGTH) if r[4] is not None else base
        prior = smooth(host[r[3]], parent, langid.HOST_STRENGTH) if r[3] is not None else base
        final = [a + math.log(p) for a, p in zip(s, prior, strict=True)]
        if r[5] is not None:
            final = [f + math.log((tag[r[5]][k] + langid.DECLARED_STRENGTH * sum(tag[r[5]]) / sum(whole)) / (whole[k] + langid.DECLARED_STRENGTH)) for k, f in enumerate(final)]
        p = normal(final)
        out.append((*r[:3], langs[p.index(max(p))], max(p), langs[x.index(max(x))]))
    return out


def test_language_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({"host": F.lit(1), "q0": F.lit(2), "declared": F.lit(3)}).repartition(3)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"suffix": F.lit(1), "scores": F.lit(2)}).repartition(2)
    found = sorted(((r.kind, r.doc_id, r.page_id, r.lang, r.text_lang, r.confidence) for r in langid.identify(docs, pages).collect()), key=str)
    expected = sorted(((k, d, p, lang, text, c) for k, d, p, lang, c, text in brute_force()), key=str)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert all(abs(f[5] - e[5]) < 1e-4 for f, e in zip(found, expected, strict=True))


def many_languages(n):
    """Each language has an alphabet of its own; the first three documents of each are labelled."""
    rng = random.Random(1)
    rows = []
    for k in range(n):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(8)]
        for copy in range(4):
            text = " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(25))
            rows.append((4 * k + copy, text, f"l{k:04d}" if copy < 3 else None, f"s{k % 7}"))
    return rows


def test_three_hundred_languages(spark):
    rows = many_languages(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    pages = spark.createDataFrame([(1, "http://a.b/", f"<p>{rows[403][1]}</p>")], "page_id long, url string, html string")
    found = {(r.kind, r.doc_id): r.lang for r in langid.identify(docs, pages).collect()}
    right = sum(found["document", i] == f"l{i // 4:04d}" for i, *_ in rows)
    assert right >= 0.98 * len(rows) and found["page", None] == "l0100"


def test_the_plan_does_not_grow_with_the_languages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    nodes = []
    for n in (3, 60):
        docs = spark.createDataFrame(many_languages(n), "doc_id long, text string, lang string, source string")
        plan = langid.identify(docs, pages)._jdf.queryExecution().optimizedPlan().treeString().split("\n")
        nodes.append(len(plan))
    assert nodes[0] == nodes[1]


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(many_languages(9), "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = lambda: sorted(map(tuple, langid.identify(docs, pages).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 4)
    assert rows() == whole


def test_dirty_labels_are_languages_too(spark):
    rows = [(k, "some words here", f"l{k:03d}", "s") for k in range(100)] + [(200 + k, "le chat dort", "fr", "s") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = langid.fit(docs)
    langs = sorted(r.lang for r in models.collect())
    assert len(langs) == 101 and "fr" in langs and langid.table_of(models, langs[:70]).shape == (70, 1 << langid.FEATURE_BITS)
