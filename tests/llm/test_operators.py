import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import chunk_dedup, decontamination, fingerprint, html_text, lm_score, minhash_dedup, pieces, sharding, suffix_dedup, toxicity
from tidewright.llm import queries as Q
from tidewright.llm.common import table, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, o string, t string, kept string, toxic string, spans string, severity string, shard string"
random.seed(7)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(4000)]


def prose(n, rng=random):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, PASSAGE, LONG = prose(150), prose(70), prose(20_000)


def near(text, k=1):
    w = text.split()
    for i in random.sample(range(len(w)), k):
        w[i] = "changed"
    return " ".join(w)


TEXTS = {
    1: BASE,
    2: BASE,
    3: near(BASE),
    4: prose(90) + " " + PASSAGE + " " + prose(40),
    5: prose(30) + " " + PASSAGE + " " + prose(60),
    6: "",
    7: None,
    8: "one",
    9: "É日本\n\n  two  words\x00 " + "x" * 300,
    10: LONG,
    11: LONG[:50_000],
    12: "same line\n" * 60,
    13: BASE.upper(),
}


def rows_of(texts):
    extra = ["en", "s", 1, "o", "t", "kept", "toxic", "spans", "severity", "shard"]
    return [(i, t, *extra) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, ties, repeated rows and columns whose names the operators use."""
    texts = [*TEXTS.items(), (1, BASE), (None, "no id here at all, none"), (None, None), (5, TEXTS[5])]
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_near_duplicates(odd, empty):
    found = minhash_dedup.near_duplicates(minhash_dedup.keyed(odd)).collect()
    classes = {(r["o"], r["class_o"]) for r in found}
    assert {(1, 1), (2, 1), (3, 1), (13, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)} <= classes
    assert len(found) == odd.count()
    assert minhash_dedup.near_duplicates(minhash_dedup.keyed(empty)).count() == 0


def test_near_duplicate_stage_keeps_one(spark, odd, sf):
    out = minhash_dedup.stage(spark, odd, sf)
    assert out.columns == odd.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[1] == 1 and not {2, 3, 13} & set(ids) and ids[5] == 1 and ids[6] == ids[7] == 1
    assert {r["severity"] for r in out.collect()} == {"severity"}


def test_links_match_brute_force():
    docs = []
    for _ in range(12):
        base = prose(60)
        docs += [base] + [near(base, k) for k in (1, 2, 3, 6)] + [base + " " + " ".join(base.split()[:20])]
    data, starts = utf8(pa.array(docs))
    text, value, weight, _ = minhash_dedup.shingles(data, starts)
    cuts = np.searchsorted(text, np.arange(len(docs) + 1))
    sets = [(value[a:b], weight[a:b], bool((weight[a:b] == 1).all())) for a, b in zip(cuts[:-1], cuts[1:])]

    def brute(a, b):
        x, y = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (a, b))
        return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)

    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            s = brute(sets[i], sets[j])
            assert abs(s - minhash_dedup.probability_jaccard(sets[i], sets[j])) < 1e-9
            if s >= 0.8:
                parent[root(i)] = root(j)
    expected = {frozenset(k for k in range(len(docs)) if root(k) == r) for r in {root(k) for k in range(len(docs))}}
    mine = list(range(len(docs)))

    def find(i):
        while mine[i] != i:
            i = mine[i]
        return i

    for i, j in minhash_dedup.links_among(sets, None, 0.8):
        mine[find(i)] = find(j)
    assert expected == {frozenset(k for k in range(len(docs)) if find(k) == r) for r in {find(k) for k in range(len(docs))}}


def test_large_group_of_near_copies(spark):
    base = prose(150)
    texts = [(i, near(base, 1 + i % 3)) for i in range(400)] + [(1000, base), (1001, prose(150))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["o"]: r["class_o"] for r in minhash_dedup.near_duplicates(minhash_dedup.keyed(df), block=32).collect()}
    assert found[1000] == 0 and found[1001] == 1001 and sum(v == 0 for v in found.values()) == 401


def test_classes_equal_those_of_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.collect()
    data, starts = utf8(pa.array([r["text"] for r in rows]))
    text, value, weight, _ = minhash_dedup.shingles(data, starts)
    cuts = np.searchsorted(text, np.arange(len(rows) + 1))
    sets = [(value[a:b], weight[a:b], bool((weight[a:b] == 1).all())) for a, b in zip(cuts[:-1], cuts[1:])]
    having: dict = {}
    for i, s in enumerate(sets):
        for x in s[0].tolist():
            having.setdefault(x, []).append(i)
    maybe = Counter((i, j) for own in having.values() for k, i in enumerate(own) for j in own[k + 1 :])
    links = [(i, j) for (i, j), n in maybe.items() if n >= 0.4 * min(len(sets[i][0]), len(sets[j][0])) and minhash_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12]
    found = {r["o"]: r["class_o"] for r in minhash_dedup.near_duplicates(minhash_dedup.keyed(docs)).collect()}
    together = [found[rows[i]["doc_id"]] == found[rows[j]["doc_id"]] for i, j in links]
    assert len(links) > 50 and np.mean(together) >= 0.95
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[root(i)] = root(j)
    at = {r["doc_id"]: i for i, r in enumerate(rows)}
    assert all(root(at[o]) == root(at[c]) for o, c in found.items())  # no class joins what links don't


def test_links_beside_the_leader_are_found(spark):
    """A chain: texts near their neighbours, not near the leader."""
    words = prose(200, random.Random(9)).split()
    texts = []
    for i in range(12):
        words = words[:]
        words[i * 15 + 3] = f"new{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["class_o"] for r in minhash_dedup.near_duplicates(minhash_dedup.keyed(df), block=3).collect()} == {0}


def test_chunk_dedup(odd, empty):
    found = by_id(chunk_dedup.remove_repeats(odd))
    assert found[1][0]["n_removed"] == found[1][1]["n_removed"] == 0
    assert found[2][0]["kept"] == "" and found[2][0]["sources"] == [1]
    assert found[5][0]["n_removed"] >= 0.5 * len(PASSAGE) and found[5][0]["sources"] == [4]
    assert found[7][0]["kept"] is None and found[6][0]["kept"] == ""
    assert found[12][0]["n_removed"] > 300  # repeats within a text
    assert found[11][0]["n_removed"] > 45_000
    assert chunk_dedup.remove_repeats(empty).count() == 0


def test_chunk_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    lines = [prose(rng.randint(3, 25), rng) for _ in range(30)]
    docs = [(i if i % 4 else None, "\n".join(rng.choice(lines) if rng.random() < 0.5 else prose(8, rng) for _ in range(rng.randint(0, 12))) + f" {i}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = df.select("doc_id", "text", chunk_dedup.text_tag().alias("t"), chunk_dedup.ordered_id().alias("o")).collect()
    seen, expected = set(), Counter()
    for r in sorted(rows, key=lambda r: (r["o"], r["t"])):
        data, starts = utf8(pa.array([r["text"]]))
        ends, _ = chunk_dedup.chunk_ends(data, starts)
        raw, kept, run = bytes(data), b"", b""
        for a, b in zip([0, *ends[:-1]], ends):
            if raw[a:b] in seen:
                run += raw[a:b]
            else:
                kept += (run if len(run) < 64 else b"") + raw[a:b]
                run = b""
                seen.add(raw[a:b])
        expected[r["doc_id"], (kept + (run if len(run) < 64 else b"")).decode()] += 1
    assert Counter((r["doc_id"], r["kept"]) for r in chunk_dedup.remove_repeats(df).collect()) == expected


def test_chunks_resist_insertions():
    text = prose(400)
    a, b = (utf8(pa.array([x])) for x in (text, "inserted " + text))
    pick = lambda data, ends: {bytes(data[i:j]) for i, j in zip([0, *ends[:-1]], ends)}
    one, two = pick(a[0], chunk_dedup.chunk_ends(*a)[0].tolist()), pick(b[0], chunk_dedup.chunk_ends(*b)[0].tolist())
    assert len(one & two) >= len(one) - 4


def test_chunks_equal_their_concatenation_and_split():
    texts = [t or "" for t in TEXTS.values()]
    data, starts = utf8(pa.array(texts))
    ends, counts = chunk_dedup.chunk_ends(data, starts)
    at = 0
    for t, n in zip(texts, counts):
        own, c = chunk_dedup.chunk_ends(*utf8(pa.array([t])))
        offset = at and ends[at - 1]
        assert c[0] == n and (ends[at : at + n] - offset == own).all()
        at += n
        for a, b in zip([0, *own[:-1]], own):
            t.encode()[a:b].decode()


def test_lm_score(spark, odd, empty):
    found = by_id(lm_score.score(odd))
    assert sum(map(len, found.values())) == odd.count()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    import zlib

    learn = [t or "" for i, t in docs if zlib.crc32(str("" if i is None else i).encode()) % 10]
    counts = Counter(w for t in learn for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    for i, t in docs:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((len(learn) + 0.1) / (n + 0.1 * (v + 1)))
        r = found[i]
        assert any(abs(x["base_score"] - base) < 1e-6 * max(1, abs(base)) and x["n_tokens"] == len(words) + 1 and x["n_known"] == 1 + sum(w in counts for w in words) and x["train_tokens"] == n for x in r)
        assert all(x["score"] < 0 and math.isfinite(x["score"]) for x in r)
    assert lm_score.score(empty).count() == 0


def test_lm_probabilities_add_to_one():
    counts = np.zeros(256)
    counts[[97, 98, 32, 10]] = [5, 3, 2, 1]
    code = lm_score.Code(counts)
    tables = lm_score.logits(np.zeros(int(lm_score.OFFSETS[-1]), np.float32), code)
    rare = lm_score.SYMBOLS - 1
    total = 0.0
    for byte in range(256):
        data, starts = np.array([97, byte], np.uint8), np.array([0, 2])
        total += 2 ** float(lm_score.score_texts(data, starts, tables, code)[0]) / 2 ** float(lm_score.score_texts(data[:1], np.array([0, 1]), tables, code)[0])
    assert abs(total - 1) < 1e-3 and code.symbol[255] <= rare


def test_lm_beats_unigrams_on_held_out(spark, sf):
    found = lm_score.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > 0.9 * found["sum(base_score)"]  # both are negative: 10 % fewer digits


def test_lm_match_layer(spark):
    rng = random.Random(12)
    texts = [prose(200, rng) for _ in range(20)]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts)), (200, " ".join(texts[4].split()[:100]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in lm_score.score(df, training=lm_score.F.col("doc_id") < 20).collect()}
    copies = [found[100 + i] for i in range(20)]
    assert sum(r["n_matched"] for r in copies) > 0.35 * 20 * 200 and sum(r["score"] for r in copies) > 0.75 * sum(r["base_score"] for r in copies)
    assert all(found[i]["n_matched"] == 0 for i in range(20))  # no text is predicted from itself


def test_wu_manber_finds_what_a_scan_finds():
    rng = random.Random(5)
    for _ in range(200):
        patterns = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))}
        text = bytes(rng.choice(b"ab c") for _ in range(200))
        expected = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
        assert sorted(decontamination.Search(list(patterns)).find(text)) == expected


def test_decontamination_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (4, ""), (None, BASE), (1, PASSAGE)], "item_id long, text string")
    for size in (100_000, 7):  # patterns in one set, and in many
        found = by_id(decontamination.find_spans(odd, items, set_patterns=size))
        assert found[4][0]["items"] == ["1"] and found[4][0]["spans"] == [90, 160]
        assert found[8][0]["items"] == ["2"] and found[1][0]["items"] == [] and found[7][0]["n_words"] == 0
    assert decontamination.find_spans(empty, items).count() == 0
    assert decontamination.find_spans(odd, items.where("false")).where("size(spans) > 0").count() == 0


def test_sharding(spark, odd, empty):
    out = sharding.assign(odd, limit=20_000).collect()
    assert len(out) == odd.count()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["n_bytes"]
    for r in out:
        assert sizes[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 20_000 or r["n_bytes"] > 20_000)
    shards = sorted(sizes)
    assert all(not b.startswith(a) for a, b in zip(shards, shards[1:]))
    assert sharding.assign(empty).count() == 0
    # rows that share a key are told apart by their texts
    same = spark.createDataFrame([(1, prose(50)) for _ in range(40)], "doc_id long, text string")
    assert all(r["shard_bytes"] <= 2000 for r in sharding.assign(same, limit=2000).collect())


PAGE = '<html><head><title>T</title></head><body><nav><a>Home</a></nav><div id="x">Plain {}</div><div>Join our list</div><aside>side</aside><div class="comments"><p>hi</p></div><script>var a="<p>no</p>"</script></body></html>'


def test_html_lines():
    page = '<body><header>top</header><article><header><h1>A &amp; B</h1></header><p>one<br>two  &copy;\n three<p>four <b>bold</b> end<ul><li>x<li>y</ul><div class="share">share</div><form>f</form></article><footer>foot</footer></body>'
    assert [t for k, t in html_text.lines(page) if k] == ["A & B", "one two © three", "four bold end", "x", "y"]
    assert html_text.lines("") == [] and html_text.lines("<p>cut short <a href=") == [(1, "cut short")]
    assert [t for k, t in html_text.lines("<p>no article</p><nav>n</nav>") if k] == ["no article"]


def test_html_differencing(spark):
    rows = [(i, f"http://h.example/a/{i}", PAGE.format(i)) for i in range(4)] + [(9, None, PAGE.format(9)), (10, "http://other.example/z", PAGE.format(10)), (11, "http://h.example/a/2", None), (None, "::", ""), (3, "http://h.example/a/3", PAGE.format(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.extract(pages).collect()
    assert len(out) == len(rows)
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[0] == "Plain 0" and texts[3] == "Plain 3"  # the shared line went
    assert texts[9] == "Plain 9\nJoin our list" and texts[10] == "Plain 10\nJoin our list" and texts[11] == "" and texts[None] == ""
    assert html_text.extract(pages.where("false")).count() == 0
    assert {r["n_shared"] for r in out if r["page_id"] in (0, 3)} == {4}  # the menu, a plain line, the sidebar and a comment


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 10))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.common_lines(a, b)) == best[-1][-1]


def test_html_on_given_pages(spark, sf):
    import re

    pages = table(spark, sf, "pages")
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in html_text.extract(pages).collect():
        body = "\n".join(" ".join(x.split()) for x in docs[int(re.search(r"/(\d+)", r["url"])[1])].split("\n") if x.strip())
        assert r["text"].split("\n", 1)[1] == body


def test_fingerprints(spark, odd, empty):
    rows = fingerprint.compare(odd).collect()
    assert len(rows) == odd.count()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], r)
    assert list(found[1]["sketch"]) == list(found[2]["sketch"]) == list(found[13]["sketch"])
    assert found[6]["sketch"] == [] and found[7]["sketch"] == []
    order = [i for i in sorted((i for i in found if i is not None), reverse=True)]
    for a, b in zip(order, order[1:]):
        text, after = TEXTS[a] or "", TEXTS[b] or ""
        k = len(text) // 3
        assert found[a]["edited"] == text[: len(text) - k] + after[:k]
        assert found[a]["next_doc_id"] == b
    assert fingerprint.compare(empty).count() == 0


def test_sketches_and_neighbours_match_brute_force(spark):
    import xxhash

    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randrange(-(1 << 62), 1 << 62)]), prose(rng.randint(0, 40), rng)) for _ in range(90)]
    rows += rows[:5]
    h64 = lambda raw, seed=42: xxhash.xxh64(raw, seed=seed).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def sketch(text):
        words = [h64(w.encode()) for w in text.lower().split()]
        found = set()
        for i in range(max(1, len(words) - 4)):
            seed = 42
            for w in words[i : i + 5]:
                seed = h64(w.to_bytes(8, "little"), seed)
            found.add(signed(seed))
        return sorted(found)[:64] if words else []

    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), signed(h64(r[1].encode()))))
    after = dict(zip(order, order[1:] + order[:1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fingerprint.compare(df).collect()
    assert len(got) == len(rows)
    key = {}
    for i, t in order:
        k = len(t) // 3
        key.setdefault((i, t[: len(t) - k] + after[i, t][1][:k]), (i, t))
    for r in got:
        i, t = key[r["doc_id"], r["edited"]]
        assert list(r["sketch"]) == sketch(t) and list(r["edited_sketch"]) == sketch(r["edited"]) and list(r["next_sketch"]) == sketch(after[i, t][1])


def test_fingerprint_estimates(spark):
    from pyspark.sql import functions as F

    a, b = prose(3000), prose(1500)
    df = spark.createDataFrame([(a + " " + b, a)], "x string, y string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "x", "sx"), "y", "sy")
    r = df.select(fingerprint.resemblance(F.col("sx"), F.col("sy")).alias("r"), fingerprint.containment(F.col("sy"), F.col("sx")).alias("c"), fingerprint.distinct_count(F.col("sx")).alias("n"), fingerprint.merge(F.col("sx"), F.col("sy")).alias("m"), "sx").first()
    assert abs(r["r"] - 2 / 3) < 0.2 and r["c"] > 0.75 and 2800 < r["n"] < 6500 and list(r["m"]) == list(r["sx"])


def test_samples_are_distinct_and_decode(spark, odd, empty):
    out = pieces.encode(odd, k=4)
    rows = out.collect()
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    for i, t in TEXTS.items():
        own = seen[i]
        assert len({tuple(r["pieces"]) for r in own}) == len({r["rank"] for r in own})
        values = [r["perturbed"] for r in sorted(own[: len({x["rank"] for x in own})], key=lambda r: r["rank"])]
        assert values == sorted(values, reverse=True)
    assert len(seen[6]) == 1 and seen[6][0]["pieces"] == []
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(out).collect()}
    assert back == {(i, t or "") for i, t in [*TEXTS.items(), (None, "no id here at all, none"), (None, "")]}
    assert pieces.encode(empty).count() == 0


def test_sampling_follows_the_lattice():
    s = pieces.sampler(pieces.MODEL, 1.0)
    data = np.frombuffer(b"the cats", np.uint8)
    _, everything, _, _ = s.sample([b"k"], data, np.array([0, len(data)]), 500)
    p = {tuple(x.pieces.tolist()): math.exp(x.log_p) for x in everything[0]}
    assert abs(sum(p.values()) - 1) < 1e-9 and len(p) == len(everything[0])
    n = 3000
    _, samples, kappa, log_z = s.sample([b"%d" % i for i in range(n)], np.tile(data, n), np.arange(n + 1) * len(data), 2)
    first, second = (Counter(tuple(x[k].pieces.tolist()) for x in samples) for k in (0, 1))
    for q in sorted(p, key=p.get, reverse=True)[:3]:
        assert abs(first[q] / n - p[q]) < 0.03
        assert abs(second[q] / n - sum(p[x] * p[q] / (1 - p[x]) for x in p if x != q)) < 0.04
    total = sum(math.exp(y.log_p - pieces.log_inclusion(y.log_p + z - k)) for x, k, z in zip(samples, kappa, log_z) for y in x) / n
    assert abs(total - 1) < 0.05


def brute_suffix(docs, length):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = []
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            else:
                seen.add(b[p : p + length])
        del own
        out[i] = bytes(x for x, g in zip(b, gone) if not g)
    return out


def test_suffix_dedup(odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.dropDuplicates(["doc_id", "text"]).collect()]
    docs = sorted((d for d in docs if d[0] is not None))
    expected = brute_suffix(docs, 100)
    rows = [r for r in suffix_dedup.dedup(odd).collect() if r["doc_id"] is not None]
    for r in rows:
        assert bytes(r["kept"]) == expected[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_on_overlaps(spark):
    rng = random.Random(11)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute_suffix(docs, 12)
    for hot in (suffix_dedup.HOT, 3):  # groups by anchor, and by string where an anchor is hot
        for r in suffix_dedup.dedup(df, length=12, gram=5, hot=hot).collect():
            assert bytes(r["kept"]) == expected[r["doc_id"]]


def test_suffix_dedup_of_a_passage_with_other_surroundings(spark):
    rng = random.Random(10)
    docs = [(i, prose(8, rng) + " " + PASSAGE[:140] + " " + prose(8, rng)) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute_suffix(docs, 100)
    for hot in (suffix_dedup.HOT, 10):
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(df, hot=hot).collect()} == expected


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    for _ in range(60):
        flat = rng.integers(97, 99 + rng.integers(0, 3), 200).astype(np.uint8)
        at = rng.permutation(180)[: rng.integers(1, 180)]
        position = rng.permutation(len(at)) if rng.random() < 0.5 else np.arange(len(at)) // 2
        strings = [bytes(flat[i : i + 12]) for i in at]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), 12)
        expected = [max((same(strings[i], strings[j]) for j in range(len(at)) if position[j] < position[i]), default=0) for i in range(len(at))]
        got = suffix_dedup.longest_previous_factors(flat, at, position, 12)
        if len(set(position.tolist())) == len(at):
            assert got.tolist() == expected
        else:  # places given twice: only whole factors matter
            assert [g == 12 for g in got] == [e == 12 for e in expected]


def test_toxicity(spark, odd, empty, sf):
    docs = [(i, prose(30) + (" vile" if i % 3 == 0 else "") + (" vile scum" if i % 6 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 6 != 0)) for i, _ in docs] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(r["toxic"] == (i % 3 == 0) for i, r in got.items())
    assert np.mean([r["severity"] for i, r in got.items() if i % 6 == 0]) > np.mean([r["severity"] for i, r in got.items() if i % 6 == 3])
    assert model.bias[0] <= model.bias[1]
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels).words == []
    assert not any(r["toxic"] for r in toxicity.score(df, toxicity.Model()).collect())


def test_fit_is_the_most_likely():
    rng = np.random.default_rng(2)
    n, k = 150, 6
    x = rng.poisson(0.6, (n, k)).astype(float)
    grade = np.digitize(x @ rng.normal(0, 1, k) + rng.logistic(0, 1, n), [0.5, 2.0])
    row, col = np.nonzero(x)
    weights, bias = toxicity.fit_ordinal(row, col, x[row, col], grade, np.ones(n), k)

    def likelihood(w, b):
        total = 0.0
        for own, g in zip(x, grade):
            above = [1.0] + [1 / (1 + math.exp(c - float(own @ w))) for c in b] + [0.0]
            total += math.log(above[g] - above[g + 1]) / n
        return total - toxicity.RIDGE / k * float(w @ w)

    best = likelihood(weights, bias)
    for i in range(k):
        for step in (0.1, -0.1):
            other = weights.copy()
            other[i] += step
            assert likelihood(other, bias) <= best + 1e-5
    assert likelihood(weights, bias + 0.1) <= best + 1e-5 and likelihood(weights, bias - 0.1) <= best + 1e-5


def test_toxicity_is_right_on_given_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.drop("quality").withColumnRenamed("toxic", "label"), "doc_id").groupBy("label", "toxic").count().collect()
    n = {(r["label"], r["toxic"]): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.01 * n[0, False] and n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0))


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in Q.QUERIES}
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)
