import hashlib
import json
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alphaline.llm import components, decontam, langid, lines, mixing, quality, queries, recompress, simhash, suffixes, toolcalls, urls
from tests.conftest import DATA
from tests.llm.cases import SCHEMA, documents, texts
from tests.oracle import rows, sql_rows

SPACED = re.compile("[^\x20\x09-\x0d]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == sql_rows(queries.ORACLES[name], DATA)


def test_decontamination_equals_brute_force(spark):
    base = texts()[0][1]
    items = [(0, " ".join(base.split()[120:150])), (1, None), (2, ""), (3, "THREE, short words"), (3, "three short words"), (None, "tie"), (10, "same " * 14), (4, "ñandú 日本語")]
    found = got(decontam.contamination(documents(spark), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    windows = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows[tuple(w[k : k + 13])].add(i)
    expected = []
    for i, t in texts():
        w, hit, ids = WORDS.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        expected.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert found == sorted(expected, key=str)


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = decontam.contamination(docs, items).toPandas()
    monkeypatch.setattr(decontam, "MAX_BROADCAST_PAIRS", 150)
    assert rows(decontam.contamination(docs, items).toPandas()) == rows(whole)


def test_substrings_equal_brute_force(spark):
    first = {}
    for i, t in texts():
        w = SPACED.findall(t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    expected = []
    for i, t in texts():
        w, gone = SPACED.findall(t or ""), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got(recompress.substring_report(documents(spark)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=str)


def test_determined_symbols_recur_with_their_window():
    rng = np.random.default_rng(0)
    for trial in range(60):
        alphabet = int(rng.integers(1, 6))
        window = rng.integers(0, alphabet, 13).astype(np.uint64)
        parsed = []
        for _ in range(2):
            left, right = (rng.integers(0, alphabet, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
            line = np.concatenate([left, window, right])
            names, first, last, low, high = recompress.recompress(line, np.array([0, len(line)]))
            inside = (low >= len(left)) & (high < len(left) + 13)
            parsed.append({(int(n), int(f) - len(left), int(e) - len(left)) for n, f, e in zip(names[inside], first[inside], last[inside], strict=True)})
            everything = {(int(n), int(f) - len(left), int(e) - len(left)) for n, f, e in zip(names, first, last, strict=True)}
            parsed.append(everything)
        assert parsed[0] <= parsed[3] and parsed[2] <= parsed[1], trial


def fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(spark):
    prints = [fingerprint(t) for _, t in texts()]
    group = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    lowest = {}
    for k, (i, _) in enumerate(texts()):
        lowest[group[k]] = min(i, lowest.get(group[k], i))
    expected = [(i, f"{prints[k]:016x}", lowest[group[k]]) for k, (i, _) in enumerate(texts())]
    assert got(simhash.simhash_report(documents(spark)), "doc_id", "fingerprint", "component_id") == sorted(expected, key=str)


@pytest.mark.parametrize("parts", [3, 4, 5, 7])
def test_shards_miss_no_link(spark, parts):
    rng = np.random.default_rng(parts)
    pairs = []
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 2, replace=False):
            b ^= 1 << int(bit)
        pairs.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)))
    both = spark.createDataFrame(pairs, "a long, b long")
    left = both.withColumn("fp", F.col("a")).select("a", "b", simhash.shard_keys(parts).alias("ka")).withColumn("fp", F.col("b")).select("ka", simhash.shard_keys(parts).alias("kb"))
    assert left.where(F.arrays_overlap("ka", "kb")).count() == 200


def test_parts_grow_with_the_corpus():
    assert simhash.parts_for(1000) == 3 < simhash.parts_for(10**10) <= simhash.parts_for(10**12)


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(3)
    values = list({int(x) for x in rng.integers(0, 1 << 12, 500)})
    tree = simhash.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.near(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    assert dict(found.collect()) == {x: find(x) for x in parent}


def test_quality_equals_brute_force(spark):
    expected = []
    for i, t in texts():
        w = SPACED.findall(t or "")
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        base = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeat), base))
    found = quality.quality_report(documents(spark))
    assert got(found, "doc_id", *quality.COUNTS, "base_failed") == sorted(expected, key=str)
    assert found.where("base_failed AND kept").count() == 0
    kept = quality.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns and {0, 15} <= {r.doc_id for r in kept.collect()}


def test_urls_with_redirects(spark):
    link = '<link rel="canonical" href="%s">'
    pages = [
        (0, "http://a.example.net/es/1", None),
        (1, "https://x.example.org/p?utm_source=f", link % "http://a.example.net/es/1"),
        (2, "http://m.x.example.org/p/", ""),
        (3, "https://y.example.org/q", '<meta http-equiv="refresh" content="0; url=/r">'),
        (4, "https://y.example.org/r.html", link % "http://shop.com/ok"),
        (5, "http://y.example.org/r", link % "http://a.example.net/fr/9"),
        (6, None, link % "http://a.example.net/es/1"),
        (7, "no scheme/es/", "<html>"),
        (8, "HTTP://WWW.Example.COM/en/x?y#z", None),
        (9, "http://b.Example.com/en/", None),
        (10, "ftp://com", None),
        (11, "http://alone.org/", None),
        (11, "http://alone.org/", None),
    ]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    declared = {r.page_id: r.verdict for r in urls.judge_urls(frame, urls.rule_table(spark)).collect()}
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame, urls.rule_table(spark), normal_forms=True).collect()}
    # without normal forms page 2 has no alias, and 5 has its own blocked target only
    assert declared == {k: v[3] for k, v in found.items()} | {2: "allow", 5: "block"}
    assert found == {
        0: ("a.example.net", "/es/1", "net/es/", "block"),
        1: ("x.example.org", "/p", None, "block"),
        2: ("m.x.example.org", "/p/", None, "block"),
        3: ("y.example.org", "/q", None, "allow"),
        4: ("y.example.org", "/r.html", None, "allow"),
        5: ("y.example.org", "/r", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        9: ("b.example.com", "/en/", "example.com/en/", "block"),
        10: ("com", "", None, "allow"),
        11: ("alone.org", "/", None, "allow"),
    }


def brute_repeats(everything, width=400):
    counts = Counter()
    for _, t in everything:
        b = (t or "").encode()
        counts.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = []
    for i, t in everything:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=str)


def test_suffixes_equal_brute_force(spark):
    some = [(i, t) for i, t in texts() if i != 15] + [(None, "xy" * 500), (30, "q" + "xy" * 300), (31, "x" * 399)]
    docs = spark.createDataFrame(some, "doc_id long, text string").withColumn("key", F.lit(1))
    assert got(suffixes.repeat_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(some)


def test_suffix_queue_beyond_memory(spark, monkeypatch):
    queue_all = []
    for limit in (64 << 20, 500):
        monkeypatch.setattr(suffixes, "MEMORY_BYTES", limit)
        queue = suffixes.SuffixQueue()
        rng = np.random.default_rng(1)
        body = bytes(rng.integers(97, 99, 900).astype(np.uint8))
        sent = sorted((7, body[k : k + 400] + bytes([k]), body[max(k - 90, 0) : k][::-1]) for k in range(0, 60, 3))
        for k, (name, right, left) in enumerate(sent + sent[:1]):
            queue.push(name, right, left, np.array([(k, b"", 0)], suffixes.OWNER).tobytes())
        queue_all.append([x.tolist() for x in suffixes._queue_spans(queue)])
        queue.close()
    assert queue_all[0] == queue_all[1]


def test_induced_order_is_the_suffix_order():
    rng = np.random.default_rng(2)
    lefts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 12, 40)]
    rights = sorted(bytes(rng.integers(97, 100, 8).astype(np.uint8)) for _ in lefts)
    lcp = np.array([0] + [suffixes.common_prefix(a, b) for a, b in zip(rights, rights[1:], strict=False)], np.int32)
    left = np.frombuffer(b"".join(lefts), np.uint8)
    for distance, order, values in suffixes.induce(left, np.array([len(x) for x in lefts]), lcp):
        suffix = [lefts[k][len(lefts[k]) - distance :] + rights[k] for k in order]
        assert suffix == sorted(suffix)
        assert values[1:].tolist() == [suffixes.common_prefix(a, b) for a, b in zip(suffix, suffix[1:], strict=False)]


def test_lines_equal_brute_force(spark):
    keyed = sorted({(i, t) for i, t in texts() if t is not None})
    worded = {(i, t): [(n, line) for n, line in enumerate(t.split("\n")) if SPACED.search(line)] for i, t in keyed}
    seen, gone = set(), defaultdict(set)
    for key in keyed:
        for k in range(len(worded[key]) - 2):
            window = tuple(line for _, line in worded[key][k : k + 3])
            if window in seen:
                gone[key] |= {n for n, _ in worded[key][k : k + 3]}
            seen.add(window)
    expected = []
    for i, t in texts():
        parts = [] if t is None else t.split("\n")
        expected.append((i, len(parts), len(gone[i, t]), sha("\n".join(p for n, p in enumerate(parts) if n not in gone[i, t]))))
    found = lines.line_report(documents(spark))
    assert got(found, "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(expected, key=str)
    left = lines.drop_repeated_lines(documents(spark))
    assert left.columns == documents(spark).columns


def test_tool_calls(spark):
    call = lambda i, args, **more: {"id": i, "name": "add", "arguments": args, **more}
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}, "m": {"enum": ["x"]}}, "additionalProperties": False}}
    turns = [
        (1, 0, "assistant", json.dumps({"tool_calls": [call("c2", {"a": 1}, depends_on=["c1"]), call("c1", '{"a": 2}')]})),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": {"b": 1, "a": [2]}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": None})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c2", "content": 2})),
        (1, 4, "tool", json.dumps({"tool_call_id": "none", "content": 2})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("c1", {"a": 10, "z": 1})]})),
        (1, 6, "assistant", json.dumps({"tool_calls": [call("p", {"a": 1}, depends_on=["q"]), call("q", {}, depends_on=["p"])]})),
        (1, 7, "assistant", "{broken"),
        (None, 8, "tool", json.dumps({"tool_call_id": "c1", "content": 2})),
        (2, 0, None, None),
    ]
    found = toolcalls.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), schema, exchanges=False).collect()
    by = {(r.conv_id, r.turn, r.part): r for r in found}
    assert len(by) == 12
    assert {k: r.status for k, r in by.items()} == {
        (1, 0, 0): "linked", (1, 0, 1): "linked", (1, 1, 0): "linked", (1, 2, 0): "linked", (1, 3, 0): "extra", (1, 4, 0): "orphan",
        (1, 5, 0): "duplicate", (1, 6, 0): "cycle", (1, 6, 1): "cycle", (1, 7, 0): "message", (None, 8, 0): "message", (2, 0, 0): "message",
    }
    assert by[1, 0, 1].line == '{"arguments":{"a":2},"id":"c1","name":"add","type":"call"}'
    assert by[1, 1, 0].line == '{"content":{"a":[2],"b":1},"id":"c1","type":"result"}'
    assert by[1, 5, 0].problems == "$.a: over 9; $.z: unknown" and not by[1, 6, 1].valid
    key = {k: (r.anchor, r.level) for k, r in by.items()}
    assert key[1, 0, 1] < key[1, 1, 0] and key[1, 0, 1] < key[1, 0, 0] < key[1, 2, 0]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = langid.identify(train, spark.read.parquet(f"{DATA}/pages.parquet"))
    assert found.count() == docs.count() + 50
    truth = docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth"))
    assert truth.join(found, "doc_id").select(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0] >= 0.97


def test_language_edges(spark):
    docs = documents(spark)
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b.fr/x", '<html lang="FR-ca"><script>en</script>'), (2, "http://a.b.fr/x", "")], "page_id long, url string, html string")
    found = langid.identify(docs, pages).collect()
    assert len(found) == len(texts()) + 3 and {r.lang for r in found} == {"en"}
    none = langid.identify(docs.where("doc_id < 0"), pages).collect()
    assert {r.lang for r in none} == {"und"} and len(none) == 3


def shares(found):
    total = found.n_tokens.sum()
    return {d: (found.rate * found.n_tokens * found[f"p_{d}"]).sum() / total for d in mixing.DOMAINS}


def test_mixing_reaches_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.mix(docs, labels, keep=["doc_id"]).toPandas()
    assert len(found) == docs.count() and (found.rate >= 0).all()
    assert all(abs(x - mixing.TARGETS[d]) < 1e-4 for d, x in shares(found).items())
    # expected shares of the labelled documents against their labels
    both = found.merge(labels.toPandas(), on="doc_id")
    domain = 2 * both.quality + both.toxic
    for k, d in enumerate(mixing.DOMAINS):
        assert abs(both.n_tokens[domain == k].sum() - (both.n_tokens * both[f"p_{d}"]).sum()) < 0.02 * both.n_tokens.sum(), d


def test_mixing_posteriors_hold_on_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.mix(docs, labels.where("pmod(xxhash64(doc_id, 5), 2) = 0"), keep=["doc_id"]).toPandas()
    both = found.merge(labels.where("pmod(xxhash64(doc_id, 5), 2) = 1").toPandas(), on="doc_id")
    domain = 2 * both.quality + both.toxic
    for k, d in enumerate(mixing.DOMAINS):
        assert abs(both.n_tokens[domain == k].sum() - (both.n_tokens * both[f"p_{d}"]).sum()) < 0.04 * both.n_tokens.sum(), d


def test_rates_equal_brute_force_least_squares(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.1, 2.0, 0.5], 300)
    n = rng.integers(1, 2000, 300)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(n, p, strict=True)], "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    rate, gap = mixing.fit_rates(table)
    fitted = np.array([r.rate for r in table.select(rate.alias("rate")).collect()])
    # plain projected gradient on the penalised problem: closest rates to 1, in tokens, that meet the targets
    goal, weight = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]), n / n.sum()
    multipliers = np.zeros(4)
    for _ in range(200_000):
        brute = np.maximum(0, 1 - p @ multipliers)
        multipliers += 0.5 * (weight * brute @ p - goal)
    assert gap < mixing.TOLERANCE and np.abs(weight * fitted @ p - goal).max() < 1e-4
    assert np.abs(fitted - brute).max() < 0.01


def test_unreachable_targets_are_told(spark):
    table = spark.createDataFrame([(100, 0.25, 0.25, 0.25, 0.25)] * 5, "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    rate, gap = mixing.fit_rates(table)
    assert gap > 0.1 and table.select(rate.alias("r")).where("r >= 0").count() == 5


def test_cuckoo_slots():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 700):
        hashes = [int(h) for h in rng.integers(-(1 << 63), 1 << 63, n)]
        count, slots = mixing.cuckoo(hashes)
        assert sorted(k for k in slots if k >= 0) == list(range(n))
        assert all(slots[h & (count - 1)] == k or slots[h >> 32 & (count - 1)] == k for k, h in enumerate(hashes))


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = mixing.mix(documents(spark), labels)
    assert found.count() == len(texts()) and found.where("rate IS NULL OR rate < 0").count() == 0
    assert set(documents(spark).columns) <= set(found.columns) and found.where("text IS NOT NULL").count() == len(texts()) - 1
    assert mixing.mix(documents(spark), labels.where("doc_id > 99")).count() == len(texts())


def test_empty_tables(spark):
    docs = documents(spark).where("doc_id < 0")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for found in (
        decontam.contamination(docs, items), recompress.substring_report(docs), simhash.simhash_report(docs), quality.quality_report(docs),
        suffixes.repeat_report(docs), lines.line_report(docs), langid.identify(docs, pages), mixing.mix(docs, labels),
        urls.judge_urls(pages, urls.rule_table(spark)), toolcalls.format_chats(chats),
    ):
        assert found.count() == 0
    assert decontam.contamination(documents(spark), items).where("n_hit > 0").count() == 0


def test_nulls_in_every_column(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "a b c " * 30, None, None, None), (1, "a b c " * 30, None, None, None)], SCHEMA)
    items = spark.createDataFrame([(1, "a b c " * 5)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (decontam.contamination(docs, items), recompress.substring_report(docs), simhash.simhash_report(docs), quality.quality_report(docs), suffixes.repeat_report(docs), lines.line_report(docs), mixing.mix(docs, labels)):
        assert found.count() == 3


def test_substrings_with_large_and_repeated_ids(spark):
    body = " ".join(f"w{k}" for k in range(20))
    low, high, twice = 2**60 + 5, 2**62 + 2**61 + 7, 2**62 + 9
    rows = [(low, body), (high, "x " + body), (twice, "some other words"), (twice, body + " y"), (-(2**63), "alone"), (2**63 - 1, body), (None, body)]
    found = recompress.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = sorted((r.doc_id is None, r.doc_id, r.kept_text) for r in found if r.doc_id is not None)
    assert left == sorted([(False, low, body), (False, high, "x"), (False, twice, "some other words"), (False, twice, "y"), (False, -(2**63), "alone"), (False, 2**63 - 1, "")])
    assert [r.kept_text for r in found if r.doc_id is None] == [body]


def test_suffixes_with_equal_checksums_and_no_ids(spark):
    import zlib

    # four bytes put before a suffix can give any text any CRC-32: search for two that agree
    rng, seen = np.random.default_rng(8), {}
    body = bytes(rng.integers(97, 123, 500).astype(np.uint8)).decode()
    while True:
        text = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 8))
        if (crc := zlib.crc32(text.encode())) in seen and seen[crc] != text:
            break
        seen[crc] = text
    some = [(7, text + body), (7, seen[crc] + body), (7, "short"), (None, body), (None, body), (None, body + "z"), (None, None), (None, "y" * 300)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert got(suffixes.repeat_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(some)


def test_suffixes_remove_planted_passages_and_leave_clean_texts(spark):
    from tests.llm.cases import words

    passages = [" ".join(words(900 + k, 110)) for k in range(3)]
    rows = [(k, " ".join(words(1000 + k, 120)) + (" " + passages[k % 3] + " " + " ".join(words(2000 + k, 50)) if k % 2 else "")) for k in range(40)]
    found = {r.doc_id: r.n_removed for r in suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(len(p.encode()) >= 400 for p in passages)
    assert {k for k, n in found.items() if n > 0} == {k for k in range(40) if k % 2}
    assert all(found[k] >= len(passages[k % 3].encode()) for k in range(1, 40, 2))


def test_suffixes_of_a_table_in_which_every_text_is_doubled(spark):
    from tests.llm.cases import words

    # every segment has several owners, and different segments share windows: induction finds nothing new
    passage = " ".join(words(950, 110))
    some = [(k, " ".join(words(1950 + k // 2, 80)) + " " + passage + " " + " ".join(words(2950 + k // 2, 80))) for k in range(6)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
    assert got(suffixes.repeat_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(some)


def test_tool_calls_with_hostile_json(spark):
    deep = '{"tool_call_id": "c", "content": ' + "[" * 100_000 + "]" * 100_000 + "}"
    middle = '{"tool_calls": [{"id": "m", "name": "add", "arguments": ' + '{"a":' * 900 + "1" + "}" * 900 + "}]}"
    turns = [
        (1, 0, "assistant", '{"tool_calls": [{"id": "c\\ud800", "name": "add", "arguments": {"a": "\\udfff x \\ud83d\\ude00"}}]}'),
        (1, 1, "tool", '{"tool_call_id": "c\\ud800", "content": "\\ud800"}'),
        (1, 2, "tool", deep),
        (1, 3, "assistant", middle),
        (1, 4, "tool", '{"tool_call_id": "c", "content": 1e999}'),
        (1, 5, "tool", '{"tool_call_id": "c", "content": NaN}'),
        (1, 6, "assistant", '{"tool_calls": [{"id": "d", "name": "add", "arguments": "{\\"a\\": -Infinity}"}]}'),
        (1, 7, "tool", '{"tool_call_id": "c", "content": ' + "9" * 5000 + "}"),
        (1, 7, "tool", '{"tool_call_id": "c", "content": ' + "9" * 5000 + "}"),
        (1, None, "user", "x" * 3_000_000),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit(1), "line": F.lit(2), "level": F.lit(3)})
    found = toolcalls.format_chats(frame, {"add": {"type": "object"}}, exchanges=False).collect()
    by = {r.turn: r for r in found}
    assert len(found) == 10
    assert by[0].line == '{"arguments":{"a":"� x \U0001f600"},"id":"c�","name":"add","type":"call"}'
    assert (by[0].status, by[1].status, by[1].line) == ("linked", "linked", '{"content":"�","id":"c�","type":"result"}')
    assert {by[k].kind for k in (2, 4, 5, 7, None)} == {"message"}
    assert by[6].kind == "call" and '"arguments":"{\\"a\\": -Infinity}"' in by[6].line
    for r in found:
        json.loads(r.line)


def test_urls_tie_and_switch(spark):
    rules = spark.createDataFrame([("block", "a.b.com", "/"), ("allow", "b.com", "/xx"), ("block", "c.org", "/p")], "verdict string, rule_host string, rule_path string")
    pages = spark.createDataFrame([(1, "http://a.b.com/xx1", None), (2, "http://c.org/p", None), (3, "http://www.c.org/q", "")], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()} == {1: ("b.com/xx", "allow"), 2: ("c.org/p", "block"), 3: (None, "allow")}


@pytest.mark.parametrize("flush", [1, 40, 1 << 21])
def test_flushes_settle_what_they_can(spark, monkeypatch, flush):
    from alphaline.llm import packed

    monkeypatch.setattr(packed, "FLUSH_NAMES", flush)
    common = " ".join(f"c{k}" for k in range(120))
    rows = [(k, f"{'a' * (k % 5)} {common} own{k} " + " ".join(f"u{k}x{j}" for j in range(30))) for k in range(40)] + [(7, common + " again"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    expected = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        expected.append((i, len(w), len(gone)))
    assert got(recompress.substring_report(docs), "doc_id", "n_words", "n_removed") == sorted(expected, key=str)
    assert got(suffixes.repeat_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_a_hot_name_reaches_its_bucket_twice():
    from alphaline.llm import packed

    names, ids = np.full(5000, 9, np.uint64), np.arange(5000, dtype=np.int64)
    ties, places = np.zeros(5000, np.int64), np.zeros(5000, np.int32)
    for settled in (packed.settle_shared(names, ids, ties), packed.settle_repeated(names, ids, ties)):
        assert settled[0].sum() == 2 and len(settled[1]) == 4998
    later = packed.settle_later(names, ties.astype(np.uint16), ties.astype(np.uint8), ids, ties, places)
    assert np.flatnonzero(later[0]).tolist() == [0] and later[1].tolist() == list(range(1, 5000))
